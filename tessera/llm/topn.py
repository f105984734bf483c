"""Top N items within every group, by partition lower bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import Scratch, unused


def top_n(items: DataFrame, group: str, slice_by: str, score: str, ties: list[str], n: int, out: str = "rank") -> DataFrame:
    """The ``n`` best rows of each group: highest ``score`` first, ties by ``ties`` ascending.

    ``slice_by`` divides a group into slices that sit in different partitions; ``items`` should already be
    partitioned by (group, slice_by). The n-th best score of a slice is a lower bound for the n-th best of
    its group, as the slice alone has n rows that reach it. The greatest bound of each group is joined back,
    rows below it are dropped (rows equal to it stay, for the tie rule), and only the survivors are shuffled
    to be ranked. Groups smaller than n in every slice have no bound and are ranked as they are.

    Null groups and null or NaN scores are left out. An empty table gives an empty one. ``ties`` must make
    the order total, else equal rows are taken in any order. Adds the column ``out`` (from 1),
    in place of one of that name; all other columns stay as they are.
    """
    n_, g_, bound_ = unused(items, "_local", "_g", "_bound")
    rows = items.filter(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties]]
    local = rows.withColumn(n_, F.row_number().over(Window.partitionBy(group, slice_by).orderBy(*order))).filter(F.col(n_) <= n)
    local = Scratch(items.sparkSession, "topn").write(local, "local")  # the slices are ranked once, for the bounds and for what they are joined to
    bounds = local.filter(F.col(n_) == n).groupBy(F.col(group).alias(g_)).agg(F.max(score).alias(bound_))
    kept = local.join(bounds, F.col(group) == F.col(g_), "left").filter(F.col(bound_).isNull() | (F.col(score) >= F.col(bound_)))
    ranked = kept.drop(n_, g_, bound_).withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)
