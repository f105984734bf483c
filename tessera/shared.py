"""Session helpers: reading tables, materialising intermediate results, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is ever broadcast on purpose.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one
    process (tests). On a cluster without it there is no such folder, and nothing is guessed."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    Tables are removed by :meth:`drop` as soon as nothing reads them; what a returned DataFrame still
    reads stays until :meth:`clean`, which removes all tables of this process, for when the results are written.
    """

    _roots: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        Scratch._roots.append((spark, self.root))

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        for own, root in cls._roots:
            if own is spark:
                remove(spark, root)
        cls._roots = [x for x in cls._roots if x[0] is not spark]

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            remove(self.spark, df._tessera_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system it is in; one that is not there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only after counting that it has at most ``limit`` rows. A side that is not a written table is written
    first, so that it is computed once, for the count and for the join."""
    if not hasattr(df, "_tessera_path"):
        df = Scratch(df.sparkSession, "side").write(df, "side")
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def epoch_us(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp read as UTC, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores added as it takes not to clash with a column of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def spread(df: DataFrame, by: str, per_core: int = 3) -> DataFrame:
    """For stages that take much CPU a row: where the input has fewer partitions than there are cores (a few large files),
    its rows are dealt out by a hash of ``by``. Large inputs have partitions enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(per_core * cores, by)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that Python stages need no path set on them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    root = shared_dir(spark).removeprefix("file://")
    folder = root if root.startswith("/") else tempfile.mkdtemp(prefix="tessera-")  # Spark's file server hands it out from there
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/tessera-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(path)
