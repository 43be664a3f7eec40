"""Top N items within every group (problem 4).

Secondary sort. Each input partition is sorted by (group, score, item) and streamed through Arrow batches that let only the
first N distinct items of a group pass, before anything is shuffled; what is left is hash-partitioned by group, sorted and
streamed again. No group is ever held in memory: the state is the last group's name and at most N item names.
A group with a third of all rows sends at most N rows per input partition to its reducer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _first_n(n: int, numbered: bool = False):
    """Lets the first n distinct items of every group of rows in order pass; `numbered`, with their position (from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, set()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups, items = batch.column(0), batch.column(1)
            change = pc.indices_nonzero(pc.not_equal(groups[1:], groups[:-1])).to_numpy() + 1 if batch.num_rows > 1 else []
            starts = [0, *map(int, change)]
            ends = [*starts[1:], batch.num_rows]
            names = groups.take(pa.array(starts)).to_pylist()
            keep: list[int] = []
            position: list[int] = []
            for name, start, end in zip(names, starts, ends):
                if name != last:
                    last, taken = name, set()
                at, step = start, 2 * n
                while len(taken) < n and at < end:
                    for item in items.slice(at, min(step, end - at)).to_pylist():
                        if item not in taken:
                            taken.add(item)
                            keep.append(at)
                            position.append(len(taken))
                            if len(taken) == n:
                                break
                        at += 1
                    step *= 4
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(position, pa.int32())], names=[*kept.schema.names, "position"]) if numbered else kept

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """The `n` items with the smallest score of every group: columns group, item, score, position (from 1).

    Rows with a null group or item, or a null, NaN or negative score, are no candidates. An item that is named more than
    once in a group counts once, with its smallest score. Equal scores are ordered by item (strings in byte order).
    A group with fewer than `n` items gives what it has; an empty table gives an empty one. Other columns of `df` play no
    part, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), s.alias("s"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & (F.col("s") >= 0) & ~F.isnan(F.col("s").cast("double")))
    order = ["g", "s", "i"]
    local = rows.sortWithinPartitions(*order).mapInArrow(_first_n(n), rows.schema)
    # each group is in one partition here, in order, with at most n rows from every partition before
    final = local.repartition("g").sortWithinPartitions(*order).mapInArrow(_first_n(n, True), StructType([*rows.schema.fields, StructField("position", IntegerType())]))
    return final.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "position")
