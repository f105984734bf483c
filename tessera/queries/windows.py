"""Ranking, gaps, brackets, caps, runs and greedy matching (survey 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import selection as S
from tessera.queries.registry import query


def _pairs(t):
    """(l, r, score, topic) of every link with a score within bounds, the best of repeated ones; the hot market's too."""
    s = t.market_links.filter("score is not null and not isnan(score) and score between 0 and 1")
    return s.groupBy(F.col("left_market_id").alias("l"), F.col("right_market_id").alias("r")).agg(F.max("score").alias("score"), F.min(F.upper(F.trim("topic"))).alias("topic"))


_P = "p as (select left_market_id as l, right_market_id as r, max(score) as score, min(upper(trim(topic))) as topic from market_links where score is not null and not isnan(score) and score between 0 and 1 group by 1, 2)"


@query("x_winner_only", f"""
with {_P}, n as (select *, row_number() over w as k, lead(score) over w as second from p window w as (partition by l order by score desc, r)),
g as (select *, max(case when k = 1 then score - second end) over (partition by l) as lead from n)
select l, r, score from g where k = 1 or lead is null or lead < 0.08
""")
def _(t):
    return S.winner_only(_pairs(t), 0.08).select("l", "r", "score")


@query("x_keep_close", f"with {_P} select l, r, score from (select *, max(score) over (partition by l) as top from p) where top = score or top - score < 0.1")
def _(t):
    return S.keep_close(_pairs(t), 0.1).select("l", "r", "score")


@query("x_brackets", f"""
with {_P}, a as (select *, row_number() over (partition by l, topic order by score desc, r) as line, max(score) over (partition by l, topic) as s from p where topic is not null),
b as (select *, min(case when line = 1 then r end) over (partition by l, topic) as tie from a), c as (select *, dense_rank() over (partition by l order by s desc, tie, topic) as bracket from b where line <= 2)
select l, r, topic, cast(line as bigint) as line, cast(bracket as bigint) as bracket from c where bracket <= 3
""")
def _(t):
    b = S.brackets(_pairs(t).filter("topic is not null"), "l", "topic", "score", "r", 3, 2)
    return b.select("l", "r", "topic", F.col("line").cast("bigint").alias("line"), F.col("bracket").cast("bigint").alias("bracket"))


@query("x_bracket_sizes", f"with {_P}, g as (select l, topic, count(*) as n from p group by 1, 2) select n as size, cast(count(*) as bigint) as groups from g group by 1")
def _(t):
    g = _pairs(t).groupBy("l", "topic").agg(F.count("*").alias("size"))
    return g.groupBy("size").agg(F.count("*").alias("groups"))


@query("x_right_cap", f"with {_P} select l, r from (select *, row_number() over (partition by r, topic order by l, score desc) as k from p) where k <= 3")
def _(t):
    return S.running_cap(_pairs(t), ["r", "topic"], 3, F.col("l"), F.col("score").desc()).select("l", "r")


@query("x_shared_key_cap", f"""
with {_P}, e as (select l, r, score, unnest(list_distinct([coalesce(topic, ''), cast(l % 5 as varchar), cast(l % 7 as varchar)])) as k from p),
f as (select distinct l, r from (select *, row_number() over (partition by r, k order by score desc, l) as n from e) where n <= 2) select l, r from f
""")
def _(t):
    keys = F.array(F.coalesce("topic", F.lit("")), (F.col("l") % 5).cast("string"), (F.col("l") % 7).cast("string"))
    return S.shared_key_cap(_pairs(t).withColumn("keys", keys), "r", "keys", 2, "l", F.col("score").desc(), F.col("l")).select("l", "r")


@query("x_guarded_caps", f"""
with {_P}, e as (select *, score >= 0.9 as exact from p), n as (select *, row_number() over (partition by l, exact order by score desc, r) as k, sum(exact::int) over (partition by l) as x from e)
select l, r from n where case when exact then k <= 5 else k <= least(2, 5 - least(x, 5)) end
""")
def _(t):
    return S.guarded_caps(_pairs(t), "l", F.col("score") >= 0.9, 5, 2, F.col("score").desc(), F.col("r")).select("l", "r")


@query("x_capped_priority", """
with b as (select * from (select left_market_id as id, left_venue as g, case lower(trim(status)) when 'confirmed' then 100 when 'suggested' then 50 else 0 end as p, id as a, row_number() over (partition by left_market_id order by case lower(trim(status)) when 'confirmed' then 100 when 'suggested' then 50 else 0 end desc, id) as k from market_links) where k = 1),
c as (select * from (select *, row_number() over (partition by g order by p desc, a, id) as k2 from b) where k2 <= 300)
select id, g, cast(p as bigint) as p from c order by p desc, a, id limit 400
""")
def _(t):
    s = F.lower(F.trim("status"))
    rows = t.market_links.select(F.col("left_market_id").alias("id"), F.col("left_venue").alias("g"), F.when(s == "confirmed", 100).when(s == "suggested", 50).otherwise(0).cast("bigint").alias("p"), F.col("id").alias("a"))
    rows = rows.groupBy("id", "g", "p").agg(F.min("a").alias("a"))
    return S.capped_by_priority(rows, "id", "g", "p", "a", 300, 400).select("id", "g", "p")


@query("x_leading_run", """
with e as (select user_id, event_type <> 'error' as ok, ts, event_id from events), r as (select user_id, sum(ok::int) over (partition by user_id order by ts desc, event_id rows unbounded preceding) as s from e)
select user_id, cast(count(*) filter (where s = 0) as bigint) as run from r group by 1
""")
def _(t):
    return S.leading_run(t.events, "user_id", F.col("event_type") != "error", F.col("ts").desc(), F.col("event_id"))


@query("x_running_totals", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as last3, rank() over (partition by user_id order by value desc) as by_value from events")
def _(t):
    w = Window.partitionBy("user_id")
    return t.events.select("user_id", "event_id", F.round(F.sum("value").over(w.orderBy("ts", "event_id").rowsBetween(-2, 0)), 6).alias("last3"), F.rank().over(w.orderBy(F.desc("value"))).cast("bigint").alias("by_value"))


@query("x_greedy")
def _(t):
    """Greedy matching with caps 3 and 2 and a gap of 0.02, over all scored pairs."""
    return S.greedy_capped(_pairs(t).select("l", "r", "score"), 3, 2, 0.02)


@query("x_greedy_close")
def _(t):
    """The opposite gap rule: only pairs close to the best of their right row."""
    return S.greedy_capped(_pairs(t).select("l", "r", "score"), 3, 3, 0.02, keep_close=True)
