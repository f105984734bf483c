"""Ordered rules: the first that holds names the class; and profiles of what holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import small


def first_match(rules: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The name of the first rule that is true; one chain of conditions inside the projection, without a join."""
    out = None
    for name, holds in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out if otherwise is None else out.otherwise(otherwise)


def all_matches(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that are true, in order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


def match_table(rows: DataFrame, text: str, rules: DataFrame, id: str = "id") -> DataFrame:
    """(id, label, ord) of the first rule of a table (ord, pattern, label) whose pattern the text contains. For many rules
    with a literal word as ``pattern``: the text's words are joined to them, so the cost does not grow with the table."""
    words = rows.select(id, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("pattern"))
    hit = words.join(small(rules), "pattern")
    return hit.groupBy(id).agg(F.min(F.struct("ord", "label")).alias("m")).select(id, "m.label", "m.ord")


def zero_filled(counts: DataFrame, by: str, domain: list[str], value: str = "n") -> DataFrame:
    """Counts with a row for every value of the domain."""
    spark = counts.sparkSession
    d = spark.createDataFrame([(x,) for x in domain], f"{by} string")
    return d.join(counts, by, "left").select(by, F.coalesce(value, F.lit(0)).alias(value))
