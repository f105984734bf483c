"""Links between records of two sources: which row of a link is current, and its score value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

LINK_KEY = ("left_venue", "left_market_id", "right_venue", "right_market_id")


def score_value(score: Column) -> Column:
    """Scores above 1 read as 1, below 0 as 0; null and NaN are no score (null)."""
    return F.when(score.isNull() | F.isnan(score), None).when(score > 1, 1.0).when(score <= 0, 0.0).otherwise(score)


def label(c: Column) -> Column:
    """Status and topic words compare without regard to letter case and outer blanks."""
    return F.upper(F.trim(c))


def current_links(links: DataFrame, keep: tuple[str, ...] = (), salts: int | None = None) -> DataFrame:
    """One row per link: the latest updated_at, then the greatest id; exact copies count once.

    Result: the four key columns, ``id``, ``salt`` and the columns in ``keep``. Rows are partitioned by
    (left_market_id, salt), where salt is a hash of the right id: all rows of a link meet in one place, while
    a left market holding a third of all rows spreads over ``salts`` slices (by default so many that a slice of one
    that held all rows would have about a million; the count comes from the files' footers). Rows whose left or right id is
    null tie nothing together and are left out; a null venue is a value like any other, a null updated_at is
    older than all others. Further columns of the input are ignored.
    """
    w, rows = _by_link(links, keep, salts)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "updated_at")


def link_states(links: DataFrame, at: Column, keep: tuple[str, ...] = (), salts: int | None = None) -> DataFrame:
    """The rows that are current now or were current at the time ``at``, when no later updated_at was known: ``was`` and ``now`` say
    which. Otherwise like :func:`current_links`, in the same one pass."""
    w, rows = _by_link(links, keep, salts)
    old = rows.withColumn("_old", F.coalesce(F.col("updated_at") <= at, F.lit(True)))
    first = old.withColumn("_rn", F.row_number().over(w)).withColumn("_before", F.sum(F.col("_old").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    states = first.select("*", (F.col("_old") & (F.col("_before") == 1)).alias("was"), (F.col("_rn") == 1).alias("now"))
    return states.filter("was or now").drop("_rn", "_old", "_before", "updated_at")


def _by_link(links: DataFrame, keep: tuple[str, ...], salts: int | None) -> tuple[WindowSpec, DataFrame]:
    salts = salts or max(64, links.count() // 1_000_000)
    rows = (
        links.filter("left_market_id is not null and right_market_id is not null and id is not null")
        .select(*LINK_KEY, "id", "updated_at", *[c for c in keep if c not in LINK_KEY])
        .withColumn("salt", F.pmod(F.xxhash64("right_market_id"), F.lit(salts)).cast("int"))
        .repartition("left_market_id", "salt")
    )
    w = Window.partitionBy("left_market_id", "salt", "left_venue", "right_venue", "right_market_id").orderBy(
        F.col("updated_at").desc_nulls_last(), F.col("id").desc()
    )
    return w, rows
