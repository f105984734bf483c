"""Ordered logic over groups of any size: hot groups are cut into ordered blocks, and values carried across them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import small


def with_blocks(df: DataFrame, key: str, order: str, hot_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """Add ``blk``, and say whether any key is hot. ``blk`` is 0 for ordinary keys; for keys of more than ``hot_rows`` rows the number of the quantile of
    ``order`` (a long) the row lies in, of so many that a block has about half of ``hot_rows``. Rows equal in key and order share a block; a later block holds only
    later rows. Hot keys number at most rows / hot_rows, and each adds one row to the side that is broadcast.
    """
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(F.col(key).alias("_k"), "_n")
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        return df.withColumn("blk", F.lit(0)), False
    blocks = min(10_000, max(8, 2 * most // hot_rows))
    hot = small(hot.select("_k"))
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = df.join(hot, F.col(key) == F.col("_k"), "left_semi").groupBy(F.col(key).alias("_k")).agg(F.percentile_approx(order, cuts, 10_000).alias("_cuts"))
    out = df.join(small(bounds), F.col(key) == F.col("_k"), "left")
    blk = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    return out.withColumn("blk", F.when(F.col("_cuts").isNull(), 0).otherwise(blk)).drop("_k", "_cuts"), True
