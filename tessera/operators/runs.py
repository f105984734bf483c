"""Audit of ingestion runs: an append-only log of starts and ends, the last state of each job, and its health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.rules import first_match
from tessera.operators.selection import leading_run
from tessera.shared import epoch_us

SCHEMA = "job string, run long, at timestamp_ntz, event string, cursor string, error string"


def log(spark, path: str, rows: list[tuple]) -> None:
    """Append events (job, run, at, event in start | done | failed, cursor, error); nothing is ever rewritten."""
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def runs(events: DataFrame) -> DataFrame:
    """One row a run: start, end (null while it runs), ok (null while it runs), cursor and error of its end."""
    over = F.col("event") != "start"
    return events.filter("job is not null and run is not null").groupBy("job", "run").agg(
        F.min(F.when(~over, F.col("at"))).alias("started"), F.max(F.when(over, F.col("at"))).alias("ended"), F.max(F.when(over, F.col("event") == "done")).alias("ok"),
        F.max_by("cursor", F.when(over, F.col("at"))).alias("cursor"), F.max_by("error", F.when(over, F.col("at"))).alias("error"),
    )


def resume_from(events: DataFrame) -> DataFrame:
    """(job, cursor, since): where each job's next run goes on, by its last run that succeeded."""
    good = runs(events).filter("ok")
    return good.groupBy("job").agg(F.max_by("cursor", "ended").alias("cursor"), F.max("ended").alias("since"))


def health(events: DataFrame, now: Column, stuck_minutes: float = 30, failures: int = 5, stale_minutes: float = 60) -> DataFrame:
    """(job, verdict, run of failures): STUCK with a run open for too long, FAILING after ``failures`` failed runs in a row, STALE
    without a success for too long, else OK. Open runs break no row of failures."""
    r = runs(events)
    minutes = lambda c: (epoch_us(now) - epoch_us(c)) / 6e7
    closed = r.filter("ok is not null")
    row = leading_run(closed, "job", F.col("ok"), F.col("started").desc(), F.col("run").desc()).withColumnRenamed("run", "failed_runs")
    state = r.groupBy("job").agg(F.coalesce(F.bool_or(F.col("ok").isNull() & (minutes(F.col("started")) > stuck_minutes)), F.lit(False)).alias("stuck"), F.max(F.when(F.col("ok"), F.col("ended"))).alias("last"))
    j = state.join(row, "job", "left").withColumn("failed_runs", F.coalesce("failed_runs", F.lit(0)))
    verdict = first_match([("STUCK", F.col("stuck")), ("FAILING", F.col("failed_runs") >= failures), ("STALE", F.col("last").isNull() | (minutes(F.col("last")) > stale_minutes))], F.lit("OK"))
    return j.select("job", verdict.alias("verdict"), "failed_runs")


def stuck_cursors(events: DataFrame, fetched: DataFrame, times: int = 3) -> DataFrame:
    """(job, cursor) of the jobs whose last ``times`` runs all read on from the same cursor and fetched nothing: their cursor is to be
    dropped. ``fetched``: (job, run, n). Runs without a count say nothing and are passed over."""
    r = runs(events).join(fetched.select("job", "run", "n"), ["job", "run"])
    last = r.withColumn("_k", F.row_number().over(Window.partitionBy("job").orderBy(F.col("started").desc(), F.col("run").desc()))).filter(F.col("_k") <= times)
    g = last.groupBy("job").agg(F.count("*").alias("_n"), F.sum("n").alias("_sum"), F.min("cursor").alias("cursor"), F.max("cursor").alias("_to"))
    return g.filter((F.col("_n") == times) & (F.col("_sum") == 0) & (F.col("cursor") == F.col("_to"))).select("job", "cursor")


def next_turn(rows: DataFrame, key: str, after, limit: int) -> tuple[DataFrame, object]:
    """The next ``limit`` rows by ``key`` after the last turn's cursor, and this turn's: null when the end is reached, so that the next
    turn begins anew. A key must be unique and not null."""
    page = (rows if after is None else rows.filter(F.col(key) > F.lit(after))).filter(F.col(key).isNotNull()).orderBy(key).limit(limit)
    n, last = page.agg(F.count("*"), F.max(key)).first()
    return page, last if n == limit else None
