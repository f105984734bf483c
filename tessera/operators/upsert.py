"""Keyed merges of a batch into a stored table, expressed as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def merge(stored: DataFrame, batch: DataFrame, key: list[str], rules: dict[str, Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of both tables with ``change``: created, updated, unchanged, or untouched (only stored).

    A column takes the batch's value, or what its rule makes of (stored, batch); columns in ``keep`` and those the batch does not
    have are never changed once stored, and are null in new rows the batch has no value for. Columns only the batch has are ignored. Keys should be unique in each table; keys with a null match nothing.
    """
    rules, keep = rules or {}, {*(keep or []), *(c for c in stored.columns if c not in batch.columns)}
    values = [c for c in stored.columns if c not in key]
    s = stored.select(*key, F.struct(*values).alias("s"), F.lit(True).alias("in_s"))
    b = batch.select(*key, F.struct(*[c if c in batch.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in values]).alias("b"), F.lit(True).alias("in_b"))
    j = s.join(b, key, "full")
    both = F.col("in_s") & F.col("in_b")

    def value(c: str) -> Column:
        old, new = F.col("s")[c], F.col("b")[c]
        merged = old if c in keep else rules[c](old, new) if c in rules else new
        return F.when(both, merged).when(F.col("in_s"), old).otherwise(new)

    out = j.select(*key, *[value(c).alias(c) for c in values], "s", both.alias("both"), F.col("in_s").alias("in_s"))
    same = F.struct(*values).eqNullSafe(F.col("s"))
    change = F.when(F.col("both") & same, "unchanged").when(F.col("both"), "updated").when(F.col("in_s"), "untouched").otherwise("created")
    return out.withColumn("change", change).drop("s", "both", "in_s")


def changed_only(old: Column, new: Column) -> Column:
    """Rule: the new value where there is one."""
    return F.coalesce(new, old)


def greater(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def remove(stored: DataFrame, doomed: Column) -> DataFrame:
    """Rows for which the condition is not true; null counts as not true."""
    return stored.filter(~F.coalesce(doomed, F.lit(False)))


def diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one table has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))
