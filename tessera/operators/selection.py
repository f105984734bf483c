"""Choosing among scored pairs and ranked rows: capped greedy matching, gaps, brackets, running caps, runs, medians."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import Scratch, small


def greedy_capped(pairs: DataFrame, cap_left: int, cap_right: int, gap: float = 0.0, keep_close: bool = False, finish: int = 50_000, once: bool = False) -> DataFrame:
    """Greedy matching of (l, r, score) with caps on both sides, as if pairs were taken one by one by falling score (ties by
    l, then r). A pair is taken unless its left or right row is full, or the gap rule of its right row's best
    pair forbids it: with ``gap`` a pair less than gap below the best is skipped; with ``keep_close`` one more than gap
    below it.

    The order is kept without sorting everything in one place: a pair that comes first among the undecided pairs of both
    of its rows can be decided, as all that it depends on is. Each round decides all such pairs, and drops all those that a full
    row or the best pair of their right row already rules out; the first of all undecided pairs is always decided, so
    the rounds come to an end. Once at most ``finish`` are left, one task takes them in order. Where the pairs of the best scores are at most
    60 times ``finish``, one task takes those in order too, instead of a round: all others come after them. Null and NaN scores and
    null ends are left out; of repeated (l, r) the best score counts. ``once`` says that none is repeated, which spares a shuffle of all pairs.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "greedy")
    rows = pairs.filter("l is not null and r is not null and score is not null and not isnan(score)")
    rows = rows if once else rows.groupBy("l", "r").agg(F.max("score").alias("score"))
    zero = F.lit(0)
    left = scratch.write(rows.select("l", "r", "score", zero.alias("n_l"), zero.alias("n_r"), F.lit(None).cast("double").alias("best")), "open")
    order = [F.col("score").desc(), F.col("l"), F.col("r")]
    taken = []

    def fits() -> Column:
        free = (F.col("n_l") < cap_left) & (F.col("n_r") < cap_right)
        if not gap:
            return free
        below = F.col("best") - F.col("score")
        return free & (F.col("best").isNull() | (below <= gap if keep_close else below >= gap))

    def one_by_one(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_l, n_r, best = {}, {}, {}
        for part in parts:
            kept = []
            for k, (l, r, s, a, b, top) in enumerate(zip(*(part.column(c).to_pylist() for c in ("l", "r", "score", "n_l", "n_r", "best")))):
                x, y = n_l.get(l, a), n_r.get(r, b)
                if x >= cap_left or y >= cap_right:
                    continue
                top = best.get(r, top)
                if gap and top is not None and (top - s > gap if keep_close else top - s < gap):
                    continue
                n_l[l], n_r[r] = x + 1, y + 1
                if gap:
                    best.setdefault(r, s if top is None else top)
                kept.append(k)
            yield part.select(["l", "r", "score"]).take(pa.array(kept, pa.int64()))

    kinds = ", ".join(f"{c} {dict(left.dtypes)[c]}" for c in ("l", "r", "score"))

    def in_order(some: DataFrame) -> DataFrame:
        return some.repartition(1).sortWithinPartitions(*order).mapInArrow(one_by_one, kinds)

    def first_of(left: DataFrame) -> float | None:
        """A score that 1 to 60 * ``finish`` pairs reach, if it is easily found."""
        low, high = left.agg(F.min("score"), F.max("score")).first()
        if not finish or not math.isfinite(high - low):
            return None
        step = (high - low) / 2_000 or 1.0
        counts = left.groupBy(F.floor((F.col("score") - low) / step).alias("k")).agg(F.count("*").alias("n"), F.min("score").alias("s")).orderBy(F.desc("k")).collect()
        edge, n = None, 0
        for r in counts:
            n += r.n
            if n > 60 * finish:
                break
            edge = r.s
        return edge

    while left.count() > finish:
        edge = first_of(left)
        if edge is not None:
            won = scratch.write(in_order(left.filter(F.col("score") >= edge)), "won")
            rest = left.filter(F.col("score") < edge)
        else:
            first = left.withColumn("_a", F.row_number().over(Window.partitionBy("l").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
            marked = scratch.write(first.withColumn("_now", (F.col("_a") == 1) & (F.col("_b") == 1)).withColumn("_yes", F.col("_now") & fits()), "round")
            won = marked.filter("_yes")
            rest = marked.filter("not _now").drop("_a", "_b", "_now", "_yes")
        taken.append(won.select("l", "r", "score"))
        by_l = small(scratch.write(won.groupBy("l").agg(F.count("*").cast("int").alias("_l")), "side"), 1_000_000)
        by_r = small(scratch.write(won.groupBy("r").agg(F.count("*").cast("int").alias("_r"), F.max("score").alias("_s")), "side"), 1_000_000)
        rest = rest.join(by_l, "l", "left").join(by_r, "r", "left")
        rest = rest.select("l", "r", "score", (F.col("n_l") + F.coalesce("_l", zero)).alias("n_l"), (F.col("n_r") + F.coalesce("_r", zero)).alias("n_r"), F.coalesce("best", "_s").alias("best"))
        before, left = left, scratch.write(rest.filter(fits()), "open")
        scratch.drop(before)

    out = in_order(left)
    for t in taken:
        out = out.unionByName(t)
    return out


def winner_only(pairs: DataFrame, gap: float) -> DataFrame:
    """Of each left row all pairs, or only the best where it leads the second by ``gap`` or more."""
    w = Window.partitionBy("l").orderBy(F.col("score").desc(), F.col("r"))
    two = pairs.select("l", "r", "score").withColumn("_n", F.row_number().over(w)).filter("_n <= 2")  # two a row and partition are shuffled, not all
    lead = two.groupBy("l").agg((F.max("score") - F.min("score")).alias("_lead"), F.count("*").alias("_of"), F.min_by("r", "_n").alias("_r"))
    won = lead.filter((F.col("_of") == 2) & (F.col("_lead") >= gap)).select("l", "_r")
    return pairs.join(won, "l", "left").filter(F.col("_r").isNull() | (F.col("r") == F.col("_r"))).select(*pairs.columns)


def keep_close(pairs: DataFrame, gap: float) -> DataFrame:
    """Of each left row the pairs less than ``gap`` below its best."""
    top = pairs.groupBy("l").agg(F.max("score").alias("_top"))
    return pairs.join(top, "l").filter((F.col("_top") == F.col("score")) | (F.col("_top") - F.col("score") < gap)).select(*pairs.columns)


def brackets(rows: DataFrame, left: str, key: str, score: str, tie: str, groups: int, lines: int) -> DataFrame:
    """Of each left row the ``groups`` groups of ``key`` with the best scores, and of each the ``lines`` best rows; equal
    scores by ``tie``, a number. A left row of any size is reduced before it is shuffled: its rows to ``lines`` a group, its groups to ``groups``."""
    in_group = Window.partitionBy(left, key).orderBy(F.col(score).desc(), F.col(tie))
    x = rows.withColumn("line", F.row_number().over(in_group)).filter(F.col("line") <= lines)
    best = rows.groupBy(left, key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"))).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(left).orderBy(F.col("_b.s").desc(), F.col("_b.t").desc(), F.col(key)))
    best = best.withColumn("bracket", rank).filter(F.col("bracket") <= groups).drop("_b")
    return x.join(best, [left, key]).select(*rows.columns, "line", "bracket")


def central_line(rows: DataFrame, group: list[str], value: str, score: str, tie: str) -> DataFrame:
    """Of each group the row nearest to the upper median of ``value``; equally near ones by score, then ``tie``."""
    w = Window.partitionBy(*group)
    n = rows.withColumn("_n", F.count(value).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), F.col(tie))))
    med = n.withColumn("_m", F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col(value))).over(w))
    near = w.orderBy(F.abs(F.col(value) - F.col("_m")).asc_nulls_last(), F.col(score).desc(), F.col(tie))
    return med.withColumn("_r", F.row_number().over(near)).filter("_r = 1").withColumnRenamed("_m", "median").drop("_n", "_k", "_r")


def running_cap(rows: DataFrame, by: list[str], cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows of each group; exact, as later rows never free a place."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def shared_key_cap(rows: DataFrame, right: str, keys: str, cap: int, row: str, *order: Column) -> DataFrame:
    """Rows in order, each taken if any of its keys has been used fewer than ``cap`` times on its right row, whereupon all of
    its keys are used. The first ``cap`` rows of a key are always taken, so the key is used up exactly after them:
    a row is taken if and only if it is among the first ``cap`` of one of its keys. No feedback is left."""
    each = rows.withColumn("_k", F.explode(F.array_distinct(keys)))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(right, "_k").orderBy(*order))).filter(F.col("_n") <= cap)
    return rows.join(first.select(right, row).distinct(), [right, row], "left_semi")


def guarded_caps(rows: DataFrame, left: str, exact: Column, cap: int, loose_cap: int, *order: Column) -> DataFrame:
    """Per left row exact rows up to ``cap``, then at most ``loose_cap`` others in the places left."""
    x = rows.withColumn("_e", F.coalesce(exact, F.lit(False)))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(left, "_e").orderBy(*order))).filter(F.col("_n") <= max(cap, loose_cap))
    x = x.withColumn("_x", F.sum(F.col("_e").cast("int")).over(Window.partitionBy(left)))  # over the few rows left of each
    free = F.least(F.lit(loose_cap), cap - F.least(F.col("_x"), F.lit(cap)))
    return x.filter(F.when(F.col("_e"), F.col("_n") <= cap).otherwise(F.col("_n") <= free)).drop("_e", "_n", "_x")


def capped_by_priority(rows: DataFrame, id: str, group: str, priority: str, arrival: str, per_group: int, total: int) -> DataFrame:
    """One row per id (highest priority, then earliest); then by falling priority and arrival at most ``per_group`` of a
    group and ``total`` in all. Only the survivors of the group caps are ranked together."""
    best = running_cap(rows, [id], 1, F.col(priority).desc(), F.col(arrival))
    kept = running_cap(best, [group], min(per_group, total), F.col(priority).desc(), F.col(arrival), F.col(id))
    return kept.orderBy(F.col(priority).desc(), F.col(arrival), F.col(id)).limit(total)


def leading_run(rows: DataFrame, by: str, ok: Column, *order: Column) -> DataFrame:
    """(by, run): how many rows of each group come before its first ok one, in the order given."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("_ok", F.sum(ok.cast("int")).over(w))
    return x.groupBy(by).agg(F.count_if(F.col("_ok") == 0).alias("run"))


def sample_per_group(rows: DataFrame, by: list[str], n: int, seed: int, id: str) -> DataFrame:
    """``n`` rows of each group in an order fixed by the seed."""
    return running_cap(rows, by, n, F.xxhash64(F.col(id), F.lit(seed)), F.col(id))
