"""Score cutoffs that keep a target fraction per source, from a persistent dyadic count tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import Scratch, small


class DyadicCountTree:
    """Counts of integer-coded scores in [0, 1] per source, kept as a table of node counts.

    A score's code is floor(score * 2^depth), at most 2^depth - 1; the node of a code at level l is its
    first l bits. Every batch adds its own file of (source, level, node, n) under ``path``; the tree is their
    sum. A batch written twice under the same name counts once, and a batch of withdrawn records is added
    with weight -1. Nodes per source are at most 2^(depth+1), however many records there are.
    """

    def __init__(self, spark: SparkSession, path: str, depth: int = 16):
        self.spark, self.path, self.depth = spark, path.rstrip("/"), depth

    def code(self, score: Column) -> Column:
        top = 1 << self.depth
        return F.least(F.floor(score * top), F.lit(top - 1)).cast("long")

    def add(self, batch: DataFrame, source: str, score: str, name: str, weight: Column | int = 1) -> None:
        """Add the records of a batch, each with its weight (-1: withdrawn); rows with a null source or score are no records."""
        leaves = (
            batch.filter(F.col(source).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
            .groupBy(F.col(source).alias("source"), self.code(F.col(score)).alias("code"))
            .agg(F.sum(weight if isinstance(weight, Column) else F.lit(weight)).cast("long").alias("n"))
        )
        levels = F.explode(F.sequence(F.lit(0), F.lit(self.depth))).alias("level")
        nodes = leaves.select("source", "code", "n", levels).groupBy(
            "source", "level", F.expr(f"shiftright(code, {self.depth} - level)").alias("node")
        ).agg(F.sum("n").alias("n"))
        nodes.write.mode("overwrite").parquet(f"{self.path}/batch={name}")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("source", "level", "node").agg(F.sum("n").alias("n"))

    def descend(self, targets: DataFrame, source: str, fraction: str) -> DataFrame:
        """(source, total, want, leaf, above): the leaf in which the target rank lies, and the records above it.

        ``want`` is the least number of records that is at least the fraction of the total (at least one). A
        fraction of null, NaN or 0 and less keeps nothing: such sources and sources without records are left out; above 1 it
        reads as 1.
        """
        depth = self.depth

        def walk(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
            count = {(int(a), int(b)): int(n) for a, b, n in zip(nodes["level"], nodes["node"], nodes["n"])}
            total, fraction = count.get((0, 0), 0), min(1.0, float(nodes["fraction"].iloc[0]))
            want = max(1, math.ceil(fraction * total - 1e-9))
            if total <= 0:
                return pd.DataFrame({"source": [], "total": [], "want": [], "leaf": [], "above": []})
            node, above = 0, 0
            for level in range(1, depth + 1):
                right = count.get((level, 2 * node + 1), 0)
                if above + right >= want:
                    node = 2 * node + 1
                else:
                    above, node = above + right, 2 * node
            return pd.DataFrame({"source": [key[0]], "total": [total], "want": [want], "leaf": [node], "above": [above]})

        t = targets.filter(F.col(source).isNotNull() & (F.col(fraction) > 0) & ~F.isnan(fraction))
        t = t.groupBy(F.col(source).alias("source")).agg(F.max(fraction).alias("fraction"))
        return self.nodes().filter("n <> 0").join(t, "source").groupBy("source").applyInPandas(walk, "source string, total long, want long, leaf long, above long")

    def cutoffs(self, records: DataFrame, source: str, score: str, targets: DataFrame, target_source: str, fraction: str, scratch: Scratch | None = None) -> DataFrame:
        """(source, total, want, cutoff, kept): the highest score with at least ``want`` records at or above it.

        Only the records of the leaves found are read again; they are counted by distinct score and summed
        from the top. The result, a row per source, is a written table, as is what the descent gives: neither is computed twice.
        """
        scratch = scratch or Scratch(self.spark, "cutoffs")
        found = small(scratch.write(self.descend(targets, target_source, fraction), "found"))
        rows = records.select(F.col(source).alias("source"), F.col(score).alias("cutoff")).filter("cutoff is not null and not isnan(cutoff)")
        rows = rows.withColumn("leaf", self.code(F.col("cutoff")))
        counts = rows.join(found, ["source", "leaf"]).groupBy("source", "total", "want", "above", "cutoff").agg(F.count("*").alias("n"))
        down = Window.partitionBy("source").orderBy(F.col("cutoff").desc())
        sums = counts.withColumn("kept", F.col("above") + F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        first = sums.filter("kept >= want").withColumn("_rn", F.row_number().over(down)).filter("_rn = 1")
        return scratch.write(first.select("source", "total", "want", "cutoff", "kept"), "cutoffs")
