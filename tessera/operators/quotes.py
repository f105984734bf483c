"""Quotes: resolving outcomes, deduplication in buckets, latest values, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import price_bucket, time_bucket
from tessera.shared import epoch_us

EPSILON, INTERVAL = 0.001, 60


def resolve_outcomes(quotes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Quotes (market_id, external_id, name, ...) with outcome_id: by the market's external id, else by its outcome's
    name without regard to case; quotes of unknown outcomes are dropped. The least id counts where several fit."""
    by_ext = outcomes.filter("external_id is not null").groupBy("market_id", "external_id").agg(F.min("id").alias("_e"))
    by_name = outcomes.filter("name is not null").groupBy("market_id", F.lower(F.trim("name")).alias("_name")).agg(F.min("id").alias("_i"))
    q = quotes.withColumn("_name", F.lower(F.trim("name")))
    q = q.join(by_ext, ["market_id", "external_id"], "left").join(by_name, ["market_id", "_name"], "left")
    return q.withColumn("outcome_id", F.coalesce("_e", "_i")).drop("_e", "_i", "_name").filter("outcome_id is not null")


def accepted(quotes: DataFrame, latest: DataFrame | None = None, epsilon: float = EPSILON, interval: int = INTERVAL) -> DataFrame:
    """Quotes of one cycle that are recorded, with ``in_cycle`` (first of its bucket) and ``recorded``.

    (a) Of the quotes of an outcome in one time bucket and one price bucket the first to arrive counts; the bucket is
    used up even if that one is then not recorded. (b) Against the latest quote stored before the cycle (outcome_id, ts, price)
    it is recorded if there is none, if ``interval`` seconds have passed, or if the price bucket differs; a late quote
    (older than the stored one) by its price alone. Quotes without outcome_id, ts or price are never recorded.
    """
    whole = F.col("outcome_id").isNotNull() & F.col("ts").isNotNull() & F.col("price").isNotNull() & ~F.isnan("price")
    w = Window.partitionBy("outcome_id", time_bucket(F.col("ts"), interval), price_bucket(F.col("price"), epsilon)).orderBy("arrival")
    q = quotes.filter(whole).withColumn("in_cycle", F.row_number().over(w) == 1)
    if latest is None:
        return q.withColumn("recorded", F.col("in_cycle"))
    old = latest.select("outcome_id", F.col("ts").alias("_ts"), F.col("price").alias("_price"))
    q = q.join(old, "outcome_id", "left")
    fresh = F.col("_ts").isNull() | ((epoch_us("ts") - epoch_us("_ts")) >= interval * 1_000_000)
    moved = price_bucket(F.col("price"), epsilon) != price_bucket(F.col("_price"), epsilon)
    return q.withColumn("recorded", F.col("in_cycle") & (fresh | moved)).drop("_ts", "_price")


def latest_quotes(quotes: DataFrame, *keep: str) -> DataFrame:
    """The quote with the latest ts of every outcome, the first to arrive of equal ones. The best row of each
    outcome is found before the shuffle, so a busy outcome is no hot spot."""
    w = Window.partitionBy("outcome_id").orderBy(F.col("ts").desc(), F.col("arrival"))
    q = quotes.filter("outcome_id is not null and ts is not null")
    return q.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("outcome_id", "ts", *(keep or ("price",)))


def merge_latest(stored: DataFrame, batch: DataFrame, monotonic: bool = False) -> DataFrame:
    """Stored latest values overwritten by the batch's; with ``monotonic`` only by later ones."""
    new = batch.select(*stored.columns)
    if not monotonic:
        return stored.join(new, "outcome_id", "left_anti").unionByName(new)
    w = Window.partitionBy("outcome_id").orderBy(F.col("ts").desc_nulls_last(), F.col("_new").desc())
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def freshness(outcomes: DataFrame, latest: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row: outcomes, those with a quote, and those with one at most ``hours`` old, and the share of fresh ones."""
    age = (epoch_us(now) - epoch_us("ts")) / 3.6e9
    x = outcomes.select(F.col("id").alias("outcome_id")).join(latest.select("outcome_id", "ts"), "outcome_id", "left")
    return x.agg(
        F.count("*").alias("n_outcomes"), F.count("ts").alias("n_quoted"), F.count_if(age <= hours).alias("n_fresh"),
        F.round(F.count_if(age <= hours) / F.count("*"), 6).alias("fresh_share"),
    )
