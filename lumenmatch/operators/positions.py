"""Positions and chunks for ordered groups of any size.

A window over a whole group puts the group into one task. These helpers split a group into ordered pieces first, so a
group holding a third of all rows is spread over many tasks: ``dense_positions`` numbers rows through per-piece counts,
``with_halo`` copies the rows around piece borders so that neighbour windows stay inside a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def dense_positions(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """Row number from 0 within ``keys`` by ``order``. ``bucket`` must not decrease along the order.

    Only the per-bucket counts are windowed over the whole key; rows are numbered inside (key, bucket).
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_local") - 1)
        .drop("_bucket", "_local", "_offset")
    )


def with_halo(df: DataFrame, position: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Assign rows to chunks of ``chunk`` positions and copy border rows into the neighbour chunk.

    Adds ``_chunk`` and ``_own``. Each chunk then also sees ``before`` rows ahead of it and ``after`` rows behind it;
    filter on ``_own`` after the window step.
    """
    pos = F.col(position)
    own = F.floor(pos / chunk)
    offset = pos - own * chunk
    homes = F.array_compact(
        F.array(
            F.struct(own.alias("_chunk"), F.lit(True).alias("_own")),
            F.when((offset < after) & (own > 0), F.struct((own - 1).alias("_chunk"), F.lit(False).alias("_own"))),
            F.when(offset >= chunk - before, F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_own"))),
        )
    )
    return df.select("*", F.inline(homes))
