"""Changes of state as keyed merges that can be run again: decisions on links, taking them back, archiving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(links: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Links with the latest decision (key, status, reason, decided_at) on each; ``changed`` says whether that changed the row, so a
    second run changes none. Equal times go by status, then reason. Decisions on unknown links, without status or key are ignored; links
    without a decision and all other columns stay as they are."""
    last = decisions.filter(F.col(key).isNotNull() & F.col("status").isNotNull()).groupBy(key).agg(F.max(F.struct("decided_at", "status", "reason")).alias("_d"))
    j = links.join(last, key, "left")
    new = F.col("_d").isNotNull()
    changed = new & ~(F.col("status").eqNullSafe(F.col("_d.status")) & F.col("reason").eqNullSafe(F.col("_d.reason")))
    values = {"status": F.when(new, F.col("_d.status")).otherwise(F.col("status")), "reason": F.when(new, F.col("_d.reason")).otherwise(F.col("reason"))}
    return j.select(*[values[c].alias(c) if c in values else F.col(c) for c in links.columns], changed.alias("changed"))


def roll_back(links: DataFrame, reason: Column, to: str = "suggested") -> DataFrame:
    """Confirmed and rejected links whose ``reason`` condition holds are open again, without a reason; ``changed`` marks them."""
    undo = F.coalesce(F.lower(F.trim("status")).isin("confirmed", "rejected") & reason, F.lit(False))
    values = {"status": F.when(undo, to).otherwise(F.col("status")), "reason": F.when(undo, F.lit(None)).otherwise(F.col("reason"))}
    return links.select(*[values[c].alias(c) if c in values else F.col(c) for c in links.columns], undo.alias("changed"))


def archive(markets: DataFrame, now: Column, resolved_days: int = 30, closed_days: int = 14) -> DataFrame:
    """Resolved markets last updated more than ``resolved_days`` ago and closed ones whose close_time is more than ``closed_days`` past
    are archived; ``changed`` marks them. A missing time archives nothing."""
    days = lambda n: F.expr(f"interval {n} days")
    old = ((F.col("status") == "resolved") & (F.col("updated_at") < now - days(resolved_days))) | ((F.col("status") == "closed") & (F.col("close_time") < now - days(closed_days)))
    old = F.coalesce(old, F.lit(False))
    return markets.select(*[F.when(old, "archived").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in markets.columns], old.alias("changed"))
