"""A declarative linkage pipeline: read signals, block, gate, score, select, merge. Each part is an expression over columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocking import meet
from tessera.operators.selection import greedy_capped
from tessera.operators.upsert import merge


@dataclass(frozen=True)
class Pipeline:
    """``keys``: array of block keys of a row; ``gates``: conditions on a pair (columns l_* and r_*); ``scores``: weighted
    component scores; ``given``: what these share, by name; ``least``: lowest score kept. ``keys_right``: those of right rows, where they are others. Every pair that meets
    at a key is gated and scored; caps come after, in the choice."""

    name: str
    keys: Callable[[], Column]
    scores: dict[str, tuple[float, Column]]
    gates: list[Column] = field(default_factory=list)
    least: float = 0.6
    keys_right: Callable[[], Column] | None = None
    per_left: int = 5
    per_right: int = 5
    gap: float = 0.0
    keep_close: bool = False
    given: dict[str, Column] = field(default_factory=dict)


REGISTRY: dict[str, Pipeline] = {}


def register(p: Pipeline) -> Pipeline:
    """Make a pipeline known by its name, in any letter case; a later one of the same name replaces it."""
    REGISTRY[p.name.upper()] = p
    return p


def pipeline(name: str) -> Pipeline:
    try:
        return REGISTRY[name.strip().upper()]
    except KeyError:
        raise KeyError(f"no pipeline {name!r}; there are {sorted(REGISTRY)}") from None


def scored(p: Pipeline, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, components, score) of the candidate pairs that pass the gates and reach the least score.

    Pairs are compared where their keys meet and are never shuffled; a pair that shares several keys is kept at the first of them.
    Components are compared in the order given, so the cheap and heavy ones should come first. Each is a generated row of one, as the
    optimizer would else repeat its expression in every filter and sum that uses it.
    """
    once = lambda j, name, c: j.select("*", F.inline(F.array(F.struct(c.alias(name)))))
    mine, other = p.keys(), (p.keys_right or p.keys)()
    x = left.select(F.col("id").alias("l"), *[F.col(c).alias(f"l_{c}") for c in left.columns], F.array_distinct(mine).alias("_lk"))
    y = right.select(F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in right.columns], F.array_distinct(other).alias("_rk"))
    j = meet(x, y, "_lk", "_rk").filter(F.col("l") != F.col("r"))
    for g in p.gates:
        j = j.filter(g)
    for n, c in p.given.items():
        j = once(j, n, c)
    sofar, rest = F.lit(0.0), sum(w for w, _ in p.scores.values())
    for n, (w, c) in p.scores.items():  # components are at most 1: a pair that cannot reach the least score any more is compared no further
        j, sofar, rest = once(j, n, c), sofar + F.lit(w) * F.col(n), rest - w
        j = j.filter(sofar + rest >= p.least - 1e-6)
    j = j.select("l", "r", *p.scores, "_k", "_lk", "_rk")
    total = sum((F.lit(w) * F.col(n) for n, (w, _) in p.scores.items()), F.lit(0.0))
    j = j.withColumn("score", F.round(total, 6)).filter(F.col("score") >= p.least)
    return j.filter(F.col("_k") == F.array_min(F.array_intersect("_lk", "_rk"))).drop("_k", "_lk", "_rk")


def run(p: Pipeline, left: DataFrame, right: DataFrame) -> DataFrame:
    """Scored pairs chosen one by one under the caps of both sides."""
    return greedy_capped(scored(p, left, right), p.per_left, p.per_right, p.gap, p.keep_close)


def store(links: DataFrame, found: DataFrame) -> DataFrame:
    """Found pairs (l, r, score) merged into stored links: a confirmed link keeps its score and status, every link the columns
    that finding says nothing of. One join, whatever the links' columns."""
    new = found.select(F.col("l").alias("left_market_id"), F.col("r").alias("right_market_id"), F.struct(F.lit("suggested").alias("status"), F.col("score").cast(links.schema["score"].dataType).alias("score")).alias("_v"))
    stored = links.withColumn("_v", F.struct(F.col("status").alias("status"), F.col("score").alias("score"))).drop("status", "score")
    confirmed = lambda v: F.lower(F.trim(v["status"])) == "confirmed"
    rows = merge(stored, new, ["left_market_id", "right_market_id"], {"_v": lambda old, new: F.when(confirmed(old), old).otherwise(new)})
    return rows.select(*[F.col("_v")[c].alias(c) if c in ("status", "score") else F.col(c) for c in links.columns], "change")
