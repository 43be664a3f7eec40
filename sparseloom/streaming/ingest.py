"""Continuous ingest into a segmented index by Structured Streaming.

Every micro-batch is appended under its batch id; the index's manifest remembers the ids, so a batch that is replayed after a
failure changes nothing. Vectors that cannot be encoded are left out of the batch (and can be written elsewhere).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vec
from ..operators.segments import SegmentedIndex
from ..operators.textprep import numbered


def usable(items: DataFrame, dim: int) -> DataFrame:
    return items.filter(F.coalesce((F.size("vec") == dim) & vec.is_finite(vec.as_double("vec")), F.lit(False)) & F.col("id").isNotNull())


def append_batch(index: SegmentedIndex, query_name: str = "ingest", rejected: Callable[[DataFrame, int], None] | None = None, improve_every: int | None = None, compact_every: int | None = 64):
    """A function for foreachBatch: items are id, vec[, idx]. With improve_every, every so many batches train the encoder on; after
    every compact_every batches the folders they wrote become one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        dim = index.manifest().vector_dim
        good = usable(batch, dim)
        rows = good if "idx" in batch.columns else numbered(good.select("id", "vec"), ["id"]).withColumnRenamed("n", "idx")
        if rejected is not None:
            rejected(batch.join(good.select("id"), "id", "left_anti"), batch_id)
        name = f"{query_name}-{batch_id}"
        if compact_every and batch_id and batch_id % compact_every == 0 and name not in index.manifest().batches:
            index.compact()
        if improve_every and batch_id % improve_every == improve_every - 1:
            if name not in index.manifest().batches and not rows.isEmpty():
                index.improve(rows, batch_id=name)
            return
        index.append(rows, batch_id=name)

    return run


def ingest(stream: DataFrame, index: SegmentedIndex, checkpoint: str, query_name: str = "ingest", available_now: bool = True, **options) -> StreamingQuery:
    writer = stream.writeStream.queryName(query_name).option("checkpointLocation", checkpoint).foreachBatch(append_batch(index, query_name, **options))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
