"""Mixing sources to target weights (problem 9).

Tokens are aggregated per source; from them follows each source's repetition rate; every document is then emitted floor(rate)
times and once more if a hash of its id, seeded, falls below the fraction. The rates table has one row per target.
The size of the mix goes with all the targets' sources have: no single source decides it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small
from .tokens import TOKENIZER, token_count

#: The default size of a mix, as a share of the tokens in the targets' sources; half leaves sources whose weight exceeds their
#: part of the corpus room to be repeated. Seeds of which each source takes the best.
TOTAL_SHARE, SEEDS = 0.5, 32


def canonical_source(source):
    """A source as the targets write it: trimmed, lower case, hyphens and spaces as underscores; blank becomes null."""
    s = F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[-\s]+", "_")
    return F.when(s != "", s)


def sized_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source (tidied), tokens of the documents that have any."""
    return documents.filter("doc_id is not null").select("doc_id", canonical_source(F.col("source")).alias("source"), token_count(F.col("text"), path).alias("tokens")).filter("tokens > 0")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, weight (as a share of all weights), max_repeats, documents, available, rate.

    `total_tokens` is the size to reach, by default `TOTAL_SHARE` of what the targets' sources have. Each source gives its weight
    of it, but no more than its cap allows; what capped sources cannot give the others give, by their weights, until the
    total or every cap is reached. Targets without documents have rate 0, and the others' weights among themselves decide.
    Null, negative or zero weights and caps take no part; of repeated targets the greatest weight and cap count.
    """
    t = targets.select(canonical_source(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("double").alias("max_repeats"))
    t = t.filter("source is not null and weight > 0 and weight < double('infinity') and max_repeats > 0").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    t = t.join(have, "source", "left").fillna(0, ["documents", "available"])
    # one row per target, so windows over one small partition; sources in the order in which a growing total meets their caps
    whole = Window.partitionBy()
    before = Window.partitionBy().orderBy("meets", "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"live": F.when(F.col("available") > 0, F.col("weight")).otherwise(0.0), "cap": F.col("max_repeats") * F.col("available"), "all_weights": F.sum("weight").over(whole)})
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.lit(TOTAL_SHARE) * F.sum("available").over(whole)
    t = t.withColumns({"meets": F.when(F.col("live") > 0, F.col("cap") / F.col("live")), "total": total})
    given, gone = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "live"))
    # tokens per weight if all sources before this one are at their caps and no other is
    level = (F.col("total") - given) / F.greatest(F.sum("live").over(whole) - gone, F.lit(1e-300))
    t = t.withColumn("level", F.when(F.col("live") > 0, level))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("meets"), F.struct("meets", "source", "level"))).over(whole)["level"])
    rate = F.when(F.col("live") > 0, F.least(F.col("max_repeats"), F.coalesce(F.col("level") * F.col("live") / F.col("available"), F.col("max_repeats")))).otherwise(F.lit(0.0))
    return t.select("source", (F.col("weight") / F.col("all_weights")).alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"), "documents", "available", rate.alias("rate"))


def _number(seed, key: str):
    """53 bits of a hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(seed, F.col(key)), 11) / F.lit(float(1 << 53))


def _whole():
    return F.floor(F.col("rate") + F.lit(1e-9))


def seeded(sizes: DataFrame, rate_table: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """`rate_table` with the seed of every source: of `SEEDS` seeds the one whose extra copies come nearest to the tokens wanted, so
    that a few long documents do not decide a source's share. One aggregation, whatever the number of seeds."""
    met = sizes.join(rate_table.select("source", "rate"), "source")
    part = F.col("rate") - _whole()
    drawn = {f"s{k}": F.sum(F.when(_number(F.lit(seed + k), key) < part, F.col("tokens")).otherwise(0)) for k in range(SEEDS)}
    sums = met.groupBy("source").agg(*(v.alias(k) for k, v in drawn.items()))
    wanted = F.greatest(part, F.lit(0.0)) * F.col("available")
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{k}") - wanted).alias("off"), F.lit(seed + k).alias("seed")) for k in range(SEEDS))))["seed"]
    return rate_table.join(sums, "source", "left").select(*rate_table.columns, F.coalesce(best, F.lit(seed)).alias("seed"))


def draw(sizes: DataFrame, rate_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix by rates and seeds: key, source, copy_no (from 1), tokens. The same rows and seeds give the same draw, in any
    order and partitioning."""
    chosen = sizes.join(rate_table.select("source", "rate", "seed"), "source")
    copies = (_whole() + (_number(F.col("seed"), key) < F.col("rate") - _whole()).cast("long")).cast("int")
    return chosen.withColumn("copies", copies).filter("copies > 0").select(key, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "tokens")


def _planned(documents: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, path: str) -> tuple[DataFrame, DataFrame]:
    sizes = checkpoint(sized_documents(documents, path))  # three columns; else every text is tokenised three times
    return sizes, small(seeded(sizes, small(rates(sizes, targets, total_tokens)), seed))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, path: str = TOKENIZER) -> DataFrame:
    """Documents drawn to the targets' weights; see `rates`, `seeded` and `draw`. Documents of sources without a target, with a
    null source or without tokens are not drawn. Repeated doc_ids count as they come."""
    return draw(*_planned(documents, targets, total_tokens, seed, path))


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, path: str = TOKENIZER) -> DataFrame:
    """Per target: source, weight, max_repeats, documents, available, rate, emitted, drawn_tokens, share (of all drawn tokens)."""
    sizes, table = _planned(documents, targets, total_tokens, seed, path)
    got = draw(sizes, table).groupBy("source").agg(F.count(F.lit(1)).alias("emitted"), F.sum("tokens").alias("drawn_tokens"))
    out = table.drop("seed").join(got, "source", "left").fillna(0, ["emitted", "drawn_tokens"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target
    return out.withColumn("all_drawn", total).withColumn("share", F.when(F.col("all_drawn") > 0, F.col("drawn_tokens") / F.col("all_drawn")).otherwise(F.lit(0.0))).drop("all_drawn")
