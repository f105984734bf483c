"""Quotes as a stream: the batch's deduplication per micro-batch, stateful deduplication, and windowed counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.quotes import EPSILON, INTERVAL, accepted, latest_quotes, merge_latest
from tessera.shared import remove


def read_quotes(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files that arrive in a folder, a few a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, store: str, checkpoint: str, epsilon: float = EPSILON, interval: int = INTERVAL, monotonic: bool = False) -> StreamingQuery:
    """Append recorded quotes under ``store``/quotes and keep ``store``/latest, exactly once.

    Every micro-batch is one cycle and is compared with the latest values as they stood before it. Files are named by the
    batch's number, so a batch that is run again replaces its own output; the latest values of batch k lie in
    latest/k; those before the last two are removed, as a batch that is run again reads the one before it at most.
    """
    spark = stream.sparkSession

    def cycle(batch: DataFrame, k: int) -> None:
        kept = ["outcome_id", "ts", "price"]
        stored = spark.read.parquet(f"{store}/latest/{k - 1}") if k else None
        rows = accepted(batch, stored, epsilon, interval).filter("recorded").drop("in_cycle", "recorded")
        rows.write.mode("overwrite").parquet(f"{store}/quotes/batch={k}")
        new = latest_quotes(spark.read.parquet(f"{store}/quotes/batch={k}")).select(*kept)
        now = new if stored is None else merge_latest(stored.select(*kept), new, monotonic)
        now.write.mode("overwrite").parquet(f"{store}/latest/{k}")
        if k > 1:
            remove(spark, f"{store}/latest/{k - 2}")

    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stateful(stream: DataFrame, epsilon: float = EPSILON, interval: int = INTERVAL) -> DataFrame:
    """Quotes recorded against the last recorded quote of their outcome, kept as state: a quote within ``interval`` seconds of it
    in the same price bucket is dropped. Stricter than :func:`ingest`, which looks at a whole cycle at once."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        ts, bucket = last
        for part in parts:
            out = []
            for row in part.sort_values("arrival").itertuples(index=False):
                b, t = math.floor(row.price / epsilon + 0.5), row.ts.value // 1000
                if ts is None or t - ts >= interval * 1_000_000 or b != bucket:
                    out.append(row)
                    ts, bucket = t, b
            yield pd.DataFrame(out, columns=part.columns)
        if ts is not None:
            state.update((ts, bucket))

    rows = stream.select("arrival", "outcome_id", F.col("ts").cast("timestamp").alias("ts"), "price").filter("outcome_id is not null and ts is not null and price is not null")
    schema = "arrival long, outcome_id long, ts timestamp, price double"
    return rows.groupBy("outcome_id").applyInPandasWithState(one, schema, "ts long, bucket long", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str = "1 hour", *by: str) -> DataFrame:
    """Counts per window; in a stream, windows close ``late`` after their end and later rows are dropped."""
    rows = events.withColumn("_ts", F.col(ts))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
