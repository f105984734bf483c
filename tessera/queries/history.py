"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.history import history
from tessera.shared import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(table(spark, sf_dir, "market_snapshots")).versions().select("market_id", F.col("valid_from").alias("valid_from_us"))


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in force, with valid and recorded times."""
    rows = history(table(spark, sf_dir, "market_snapshots")).in_force()
    return rows.select("market_id", F.col("at").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"), F.col("now_title").alias("title"), F.col("now_status").alias("status"), F.col("closes").alias("closes_minute"), "begins", F.col("recorded_at").alias("recorded_at_us"))


def p3_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that later receipts superseded, with when. Which states were ever recorded depends on the batches, so there is no SQL."""
    return history(table(spark, sf_dir, "market_snapshots")).ledger().filter("superseded_at is not null").select("market_id", "at", "valid_to", "now_title", "now_status", "closes", "recorded_at", "superseded_at")


QUERIES = {"p3_found": p3_found, "p3_ledger": p3_ledger, "p3_superseded": p3_superseded}

SQL = {
    "p3_found": r"""
with o as (
  select market_id, captured_at, trim(regexp_replace(title, '\s+', ' ', 'g')) as title, lower(trim(status)) as status,
         date_trunc('minute', close_time) as closes,
         row_number() over (partition by market_id, captured_at order by received_at desc, obs_id desc) as rn
  from market_snapshots where market_id is not null and captured_at is not null),
h as (
  select market_id, captured_at, closes,
         last_value(title ignore nulls) over w as t, last_value(status ignore nulls) over w as s
  from o where rn = 1 window w as (partition by market_id order by captured_at rows between unbounded preceding and current row)),
v as (
  select *, lag(t) over w as pt, lag(s) over w as ps, lag(closes) over w as pc, row_number() over w as n
  from h window w as (partition by market_id order by captured_at))
select market_id, epoch_us(captured_at) as valid_from_us from v
where n = 1 or t is distinct from pt or s is distinct from ps or closes is distinct from pc
""",
    "p3_ledger": r"""
with o as (
  select market_id, epoch_us(captured_at) as vf, trim(regexp_replace(title, '\s+', ' ', 'g')) as title, lower(trim(status)) as status, epoch_us(date_trunc('minute', close_time)) // 60000000 as closes,
         coalesce(epoch_us(received_at), -4611686018427387904) as r, min(coalesce(epoch_us(received_at), -4611686018427387904)) over (partition by market_id, captured_at) as f,
         row_number() over (partition by market_id, captured_at order by received_at desc nulls last, obs_id desc) as rn
  from market_snapshots where market_id is not null and captured_at is not null),
h as (
  select market_id, vf, closes, r, last_value(title ignore nulls) over w as t, last_value(status ignore nulls) over w as s,
         last_value(case when title is not null then r end ignore nulls) over w as tr, last_value(case when status is not null then r end ignore nulls) over w as sr
  from o where rn = 1 window w as (partition by market_id order by vf rows between unbounded preceding and current row)),
x as (select market_id, vf, f from o where rn = 1),
n as (select market_id, vf, lead(vf) over (partition by market_id order by vf) as nat, lead(f) over (partition by market_id order by vf) as nf from x),
v as (
  select h.*, n.nat, n.nf, lag(t) over w as pt, lag(s) over w as ps, lag(closes) over w as pc, row_number() over w as k
  from h join n using (market_id, vf) window w as (partition by market_id order by vf))
select market_id, vf as valid_from_us, nat as valid_to_us, t as title, s as status, closes as closes_minute, k = 1 or t is distinct from pt or s is distinct from ps or closes is distinct from pc as begins,
  greatest(r, tr, sr, nf) as recorded_at_us from v
""",
}
