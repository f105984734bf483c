"""Consolidating pairwise matches into groups by random contraction of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import Scratch


def _look_up(rows: DataFrame, key: str, names: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Rows with what ``names`` says of their ``key``. ``hot``: keys that very many rows have; their names are few and are sent to the
    rows, so that only rows of ordinary keys are shuffled to their names."""
    if hot is None:
        return rows.join(names, key, how)
    few = F.broadcast(names.join(F.broadcast(hot), key, "left_semi"))
    often = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(names, key, how))


def _hot(counts: DataFrame, key: str, most: int, scratch: Scratch) -> DataFrame | None:
    """The keys of (key, n) with n above ``most``, or None without any. At most rows / most of them."""
    hot = scratch.write(counts.filter(F.col("n") > most).select(key), "hot")
    if hot.isEmpty():
        scratch.drop(hot)
        return None
    return hot


def connected_components(edges: DataFrame, left: str, right: str, seed: int = 17, max_rounds: int = 200, hot_rows: int = 100_000) -> DataFrame:
    """(vertex, group): every vertex of an edge with the smallest vertex reachable over edges in any direction.

    Each round orders the vertices by a fresh hash; a vertex hooks to the first of itself and its
    neighbours in that order. Edges are relabelled by the hooks, loops and repeated edges are dropped, and the
    round's hooks are kept. When no edge is left, the hooks are composed from the last round back, each step a written table. Each round
    leaves three quarters of the vertices or fewer on average, so the number of rounds grows with the logarithm of the
    graph. All sums per vertex are combined before the shuffle. Vertices with more than ``hot_rows`` edges (or a hundred thousandth of
    all edges, if that is more, so that they are never more than 200,000) do not gather their edges in one task: their hooks are sent to the edges.

    Edges with a null end are left out. A vertex linked only to itself is a group of one. An empty table
    gives an empty one. Columns other than ``left`` and ``right`` are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).filter("u is not null and v is not null")
    start = scratch.write(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    most = max(hot_rows, start.count() // 100_000)
    graph, hooks = start.filter("u <> v"), []
    for r in range(max_rounds):
        if graph.isEmpty():
            break
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = F.xxhash64(F.col("v"), F.lit(seed + 7919 * r))
        best = both.groupBy("u").agg(F.min_by("v", rank).alias("v"), F.min(rank).alias("h"), F.count("*").alias("n"))
        own = F.xxhash64(F.col("u"), F.lit(seed + 7919 * r))
        hook = scratch.write(best.select("u", F.when(F.col("h") < own, F.col("v")).otherwise(F.col("u")).alias("to"), "n"), "hooks")
        hooks.append(hook)
        hot = _hot(hook, "u", most, scratch)
        moved = _look_up(graph, "u", hook.select("u", F.col("to").alias("a")), hot)
        moved = _look_up(moved, "v", hook.select(F.col("u").alias("v"), F.col("to").alias("b")), None if hot is None else hot.select(F.col("u").alias("v")))
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        before, graph = graph, scratch.write(moved, "edges")
        if r:
            scratch.drop(before)
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    group = None
    for hook in reversed(hooks):
        if group is None:
            group = scratch.write(hook.select("u", F.col("to").alias("g")), "groups")
            continue
        hot = _hot(hook.groupBy("to").agg(F.count("*").alias("n")), "to", most, scratch)
        before, later = group, group.select(F.col("u").alias("to"), F.col("g").alias("g2"))
        group = scratch.write(_look_up(hook.select("u", "to"), "to", later, hot, "left").select("u", F.coalesce("g2", "to").alias("g")), "groups")
        scratch.drop(before, hook)
    if group is None:
        group = start.select("u", F.col("u").alias("g")).limit(0)
    least = group.groupBy("g").agg(F.min("u").alias("group"), F.count("*").alias("n"))
    grouped = _look_up(group, "g", least.drop("n"), _hot(least, "g", most, scratch)).select(F.col("u").alias("vertex"), "group")
    alone = start.filter("u = v").select(F.col("u").alias("vertex")).join(group.select(F.col("u").alias("vertex")), "vertex", "left_anti")
    return grouped.unionByName(alone.select("vertex", F.col("vertex").alias("group")))
