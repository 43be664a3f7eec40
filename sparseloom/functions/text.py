"""Text preparation as native columns, and chunking as an Arrow function. White space is Python's: (?U)\\s with the information separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import _col

WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Terms whose presence in a lower-case title marks a text as not a narrative.
NOT_NARRATIVE = ("play", "screenplay", "script", "poems", "poetry", "sonnets", "dialogues", "theatre", "theater")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{WS}+|{WS}+$", "")


def passage_text(title: Column | str, text: Column | str) -> Column:
    return strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit("\n"), F.coalesce(_col(text), F.lit(""))))


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"[^\p{IsWhite_Space}\x1c-\x1f]+")), F.lit(0))


def non_blank(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def split_paragraphs(text: Column | str) -> Column:
    """Pieces between blank lines, stripped, without empty ones."""
    return non_blank(F.split(_col(text), rf"\n{WS}*\n+"))


def split_sentences(text: Column | str) -> Column:
    """Pieces that end with a full stop, question or exclamation mark and white space."""
    return non_blank(F.split(_col(text), r"(?<=[.!?])[ \t\n\r]+"))


def merge_pieces(pieces: list[str], least: int, most: int, joiner: str) -> list[str]:
    """See `chunk_pieces`. One walk over the pieces, each counted once."""
    bounds, start, words = [], 0, 0  # (first piece, piece after the last) of every chunk
    for at, piece in enumerate(pieces):
        n = len(piece.split())
        if at > start and words + n > most:
            bounds.append((start, at))
            start, words = at, n
        elif words + n >= least:
            bounds.append((start, at + 1))
            start, words = at + 1, 0
        else:
            words += n
    if start < len(pieces):
        if bounds and words < least // 2:
            start = bounds.pop()[0]
        bounds.append((start, len(pieces)))
    return [joiner.join(pieces[a:b]) for a, b in bounds]


def chunk_pieces(pieces: Column | str, least: int = 250, most: int = 350, joiner: str = "\n\n") -> Column:
    """Pieces merged in order to chunks of about `least` to `most` words; null for null.

    A piece that would take the open chunk beyond `most` closes it and opens the next, which is then not held against `least`;
    else it is added, and a chunk of `least` words or more closes. A rest of fewer than half of `least` words joins the last chunk.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([None if p is None else merge_pieces(list(p), least, most, joiner) for p in series], dtype="object")

    return run(_col(pieces))


def strip_boilerplate(text: Column | str) -> Column:
    """The text after the line with `*** START OF` and before the next `*** END OF`, stripped. Markers that are missing cut
    nothing, and a start line that is the last line stays."""
    t = _col(text)
    start = F.instr(t, "*** START OF")
    tail = F.substring(t, start, F.length(t))
    line_end = F.instr(tail, "\n")
    body = F.when(start > 0, F.when(line_end > 0, F.substring(tail, line_end + 1, F.length(t))).otherwise(tail)).otherwise(t)
    end = F.instr(body, "*** END OF")
    return strip(F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body))


def strip_html(text: Column | str) -> Column:
    """Tags to spaces, runs of blanks to one, three or more line ends to two - where `<` is among the first 200 characters."""
    t = _col(text)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.when(F.instr(F.substring(t, 1, 200), "<") > 0, clean).otherwise(t)


def is_narrative(title: Column | str, terms: tuple[str, ...] = NOT_NARRATIVE) -> Column:
    """Whether the title, in lower case, has none of the terms; a missing title has none."""
    low = F.lower(F.coalesce(_col(title), F.lit("")))
    out = F.lit(True)
    for term in terms:
        out = out & ~low.contains(term)
    return out


def chunk_id(slug: Column | str, number: Column | str) -> Column:
    return F.format_string("%s-%04d", _col(slug), _col(number))
