"""Quotes, merges, sources, rules, scores, streams and the linkage pipeline (survey 2.1, 2.2, 2.5, 2.9, 2.11-2.13)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import scores as C
from tessera.functions.text import fuzzy, jaccard, tokenize
from tessera.operators import quotes as Q
from tessera.operators import upsert as U
from tessera.operators.rules import first_match, match_table
from tessera.plans.overlap import simple_run, simple_scored
from tessera.plans.pipeline import Pipeline
from tessera.queries.filters import _comparator_sql, _tokens_sql
from tessera.queries.registry import NOW, now, query
from tessera.shared import Scratch

_WHOLE = "outcome_id is not null and ts is not null and price is not null and not isnan(price)"
_CYCLE = f"c as (select *, row_number() over (partition by outcome_id, floor(epoch_us(ts) / 3600000000.0), floor(price / 0.01 + 0.5) order by arrival) = 1 as in_cycle from quotes where {_WHOLE})"


@query("q_in_cycle", f"with {_CYCLE} select arrival, in_cycle from c")
def _(t):
    return Q.accepted(t.quotes, None, 0.01, 3600).select("arrival", "in_cycle")


@query("q_against_latest", f"""
with h as (select max(arrival) // 2 as m from quotes), l as (select * from (select outcome_id, ts, price, row_number() over (partition by outcome_id order by ts desc, arrival) as k from quotes, h where arrival <= h.m and {_WHOLE}) where k = 1),
c as (select q.*, row_number() over (partition by outcome_id, floor(epoch_us(ts) / 3600000000.0), floor(price / 0.01 + 0.5) order by arrival) = 1 as in_cycle from quotes q, h where arrival > h.m and {_WHOLE})
select c.arrival, c.in_cycle and (l.ts is null or epoch_us(c.ts) - epoch_us(l.ts) >= 3600000000 or floor(c.price / 0.01 + 0.5) <> floor(l.price / 0.01 + 0.5)) as recorded from c left join l using (outcome_id)
""")
def _(t):
    half = t.quotes.agg(F.floor(F.max("arrival") / 2).alias("m"))
    q = t.quotes.crossJoin(F.broadcast(half))
    whole = "price is not null and not isnan(price)"
    stored = Q.latest_quotes(q.filter("arrival <= m").filter(whole))
    return Q.accepted(q.filter("arrival > m"), stored, 0.01, 3600).select("arrival", "recorded")


@query("q_latest", "select outcome_id, ts, price from (select *, row_number() over (partition by outcome_id order by ts desc, arrival) as k from quotes where outcome_id is not null and ts is not null) where k = 1")
def _(t):
    return Q.latest_quotes(t.quotes)


_LATEST2 = """
a as (select outcome_id, ts, price from (select *, row_number() over (partition by outcome_id order by ts desc, arrival) as k from quotes where raw is null and outcome_id is not null and ts is not null) where k = 1),
b as (select outcome_id, ts, price from (select *, row_number() over (partition by outcome_id order by ts desc, arrival) as k from quotes where raw is not null and outcome_id is not null and ts is not null) where k = 1)
"""


@query("q_merge_latest", f"with {_LATEST2} select * from b union all select * from a where outcome_id not in (select outcome_id from b)")
def _(t):
    part = lambda bare: Q.latest_quotes(t.quotes.filter(F.col("raw").isNull() == bare))
    return Q.merge_latest(part(True), part(False))


@query("q_merge_monotonic", f"with {_LATEST2} select outcome_id, case when b.ts is null or a.ts > b.ts then a.ts else b.ts end as ts, case when b.ts is null or a.ts > b.ts then a.price else b.price end as price from a full join b using (outcome_id)")
def _(t):
    part = lambda bare: Q.latest_quotes(t.quotes.filter(F.col("raw").isNull() == bare))
    return Q.merge_latest(part(True), part(False), monotonic=True)


@query("q_freshness", f"""
with l as (select outcome_id, max(ts) as ts from quotes group by 1)
select cast(count(*) as bigint) as n_outcomes, cast(count(l.ts) as bigint) as n_quoted, cast(count(*) filter (where date_diff('microsecond', l.ts, timestamp '{NOW}') <= 24 * 3600000000) as bigint) as n_fresh,
  round(count(*) filter (where date_diff('microsecond', l.ts, timestamp '{NOW}') <= 24 * 3600000000) / count(*), 6) as fresh_share from outcomes o left join l on l.outcome_id = o.id
""")
def _(t):
    return Q.freshness(t.outcomes, Q.latest_quotes(t.quotes), now(), 24)


@query("q_tumbling", "select time_bucket(interval 4 hour, ts) as start, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def _(t):
    from tessera.streaming.quotes import tumbling_counts

    return tumbling_counts(t.events, "ts", "4 hours", "1 hour", "event_type")


@query("q_random_walk")
def _(t):
    """Seeded price walks for the number of markets in the table."""
    from tessera.sources.books import seed_quotes

    return seed_quotes(t.spark, t.markets.count(), 20)


@query("src_metadata_prices", "select id, 'yes' as side, json_extract_string(metadata, '$.yesBid')::double / 100 as price from markets where json_extract_string(metadata, '$.yesBid') is not null")
def _(t):
    from tessera.sources.books import metadata_quotes

    return metadata_quotes(t.markets)


@query("src_books", "select outcome_id, case when bid is null then ask when ask is null then bid else (bid + ask) / 2 end as price from (select outcome_id, arrival, json_extract_string(raw, '$.bid')::double as bid, json_extract_string(raw, '$.ask')::double as ask from quotes where raw is not null) where bid is not null or ask is not null")
def _(t):
    from tessera.sources.books import mid_price

    b, a = (F.get_json_object("raw", f"$.{k}").cast("double") for k in ("bid", "ask"))
    return t.quotes.filter("raw is not null").select("outcome_id", mid_price(b, a).alias("price")).filter("price is not null")


@query("src_paged", "select p.paging, n_name as name from nation, (values ('offset'), ('cursor')) p(paging)")
def _(t):
    """The data source over the names of the nations, by offset and by cursor: a check of paging, not of size."""
    from tessera.sources.paged import register

    register(t.spark)
    names = json.dumps([{"name": r.n_name} for r in t.nation.select("n_name").orderBy("n_name").collect()])
    read = lambda paging: t.spark.read.format("paged").option("url", f"data:{names}").option("paging", paging).option("size", 10).load()
    name = F.get_json_object("item", "$.name").alias("name")
    return read("offset").select(F.lit("offset").alias("paging"), name).unionByName(read("cursor").select(F.lit("cursor").alias("paging"), name))


@query("src_map_flags", """
select external_id, title, coalesce(nullif(category, ''), 'none') as category, case when status = 'active' then 'active' when status = 'closed' or status is null then 'closed' else 'resolved' end as status, close_time
from markets where venue = 'polymarket' and external_id is not null and external_id <> ''
""")
def _(t):
    """Listings written as catalogue items with flags, and mapped back."""
    from tessera.sources.mapping import map_flagged

    s = F.col("status")
    item = F.struct(F.col("external_id").alias("id"), F.col("title").alias("question"), "category", F.lit("none").alias("groupItemTitle"), s.isin("active", "closed").alias("active"), (~(s == "active")).alias("closed"), F.date_format("close_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("endDate"))
    return map_flagged(t.markets.filter("venue = 'polymarket'").select(F.to_json(item).alias("item"))).select("external_id", "title", "category", "status", "close_time")


@query("src_map_outcomes", """
select m.external_id, o.name, case when lower(o.name) in ('yes', 'no') then lower(o.name) else 'other' end as side, cast(row_number() over (partition by m.id order by o.id) - 1 as bigint) as position
from markets m join outcomes o on o.market_id = m.id where m.venue = 'polymarket' and m.external_id <> '' and o.name is not null
""")
def _(t):
    """Outcomes written as lists, of every other listing as a text with a list in it, and mapped back."""
    from tessera.sources.mapping import map_flagged

    n = t.outcomes.filter("name is not null").groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).getField("name").alias("names"))
    m = t.markets.filter("venue = 'polymarket'").select("id", "external_id").join(n, F.col("id") == F.col("market_id"))
    as_list, as_text = (F.to_json(F.struct(F.col("external_id").alias("id"), o.alias("outcomes"))) for o in (F.col("names"), F.to_json("names")))
    items = m.select(F.when(F.xxhash64("id") % 2 == 0, as_list).otherwise(as_text).alias("item"))
    o = map_flagged(items).select("external_id", F.posexplode("outcomes").alias("position", "o"))
    return o.select("external_id", "o.name", "o.side", F.col("position").cast("bigint").alias("position"))


@query("src_map_words", """
select external_id, title || coalesce(' - ' || nullif(derived_topic, ''), '') as title, coalesce(nullif(category, ''), kalshi_event_ticker) as category, case status when 'closed' then 'closed' when 'resolved' then 'resolved' else 'active' end as status, kalshi_event_ticker as event_ticker,
  json_extract_string(metadata, '$.yesBid')::double as yes_bid
from markets where venue = 'kalshi' and external_id <> ''
""")
def _(t):
    """Listings written as catalogue items with a status word, and mapped back."""
    from tessera.sources.mapping import map_listed

    word = F.when(F.col("status") == "closed", "paused").when(F.col("status") == "resolved", "settled").when(F.col("status") == "active", "open").otherwise("other")
    item = F.struct(F.col("external_id").alias("ticker"), "title", F.col("derived_topic").alias("subtitle"), "category", F.col("kalshi_event_ticker").alias("event_ticker"), word.alias("status"), F.get_json_object("metadata", "$.yesBid").alias("yes_bid"))
    m = map_listed(t.markets.filter("venue = 'kalshi'").select(F.to_json(item).alias("item")))
    return m.select("external_id", "title", "category", "status", "event_ticker", F.get("outcomes", F.lit(0))["bid"].alias("yes_bid"))


@query("w_decide", """
with d as (select id, max(status) as s from (select id, 'confirmed' as status from market_links where score >= 0.9 and not isnan(score) union all select id, 'rejected' from market_links where score < 0.2) group by id)
select l.id, coalesce(d.s, l.status) as status, case when d.s is null then l.reason else 'review' end as reason, d.s is not null and (l.status is distinct from d.s or l.reason is distinct from 'review') as changed from market_links l left join d using (id)
""")
def _(t):
    from tessera.operators.states import decide

    l = t.market_links
    d = lambda c, s: l.filter(c).select("id", F.lit(s).alias("status"), F.lit("review").alias("reason"), F.lit(1).alias("decided_at"))
    return decide(l, d("score >= 0.9 and not isnan(score)", "confirmed").unionByName(d("score < 0.2", "rejected"))).select("id", "status", "reason", "changed")


@query("w_rollback", """
select id, case when u then 'suggested' else status end as status, case when u then null else reason end as reason, u as changed from (select *, coalesce(lower(trim(status)) in ('confirmed', 'rejected') and starts_with(algo_version, 'v3@'), false) as u from market_links)
""")
def _(t):
    from tessera.operators.states import roll_back

    return roll_back(t.market_links, F.col("algo_version").startswith("v3@")).select("id", "status", "reason", "changed")


@query("w_archive", f"""
select id, case when o then 'archived' else status end as status, o as changed from (select *, coalesce((status = 'resolved' and updated_at < timestamp '{NOW}' - interval 30 day) or (status = 'closed' and close_time < timestamp '{NOW}' - interval 14 day), false) as o from markets)
""")
def _(t):
    from tessera.operators.states import archive

    return archive(t.markets, now()).select("id", "status", "changed")


@query("c_number_pairing")
def _(t):
    """Numbers that the two titles of a link share one by one, within a hundredth."""
    from tessera.functions.text import numbers

    return t.market_links.select("id", C.pair_numbers(numbers(F.col("left_title")), numbers(F.col("right_title"))).alias("n"))


@query("c_comparator_factor", f"""
with k as (select id, {_comparator_sql('left_title')} as a, {_comparator_sql('right_title')} as b from market_links)
select id, cast(case when a = b then 1 when 'UNKNOWN' in (a, b) then 0.95 when 'WIN' in (a, b) then 0.9 when 'BETWEEN' in (a, b) then 0.7 else 0 end as double) as factor from k
""")
def _(t):
    """What the sides of a number that a link's titles name make of its score; the titles name no exact values."""
    from tessera.functions.text import comparator

    a, b = comparator(F.col("left_title")), comparator(F.col("right_title"))
    return t.market_links.select("id", C.comparator_factor(a, b).alias("factor"))


@query("c_date_gate", """
with p as (select l.id, cast(a.close_time as date) as a, cast(b.close_time as date) as b, case when l.id % 3 = 0 then 'day' when l.id % 3 = 1 then 'month' else 'none' end as strict from market_links l join markets a on a.id = l.left_market_id join markets b on b.id = l.right_market_id)
select id, case strict when 'day' then coalesce(abs(date_diff('day', a, b)) <= 2, false) when 'month' then coalesce(year(a) = year(b) and month(a) = month(b), false) else true end as passes from p
""")
def _(t):
    m = t.markets.select("id", F.col("close_time").cast("date").alias("d"))
    a, b = m.select(F.col("id").alias("left_market_id"), F.col("d").alias("a")), m.select(F.col("id").alias("right_market_id"), F.col("d").alias("b"))
    strict = F.when(F.col("id") % 3 == 0, "day").when(F.col("id") % 3 == 1, "month").otherwise("none")
    j = t.market_links.select("id", "left_market_id", "right_market_id").join(a, "left_market_id").join(b, "right_market_id")
    return j.select("id", C.date_gate(F.col("a"), F.col("b"), F.lit("day"), F.lit("day"), strict).alias("passes"))


_STORED = "s as (select id, title, status from markets where created_at < timestamp '2025-12-01'), b as (select id, case when metadata is null then upper(title) else title end as title, case when derived_topic is null then null else status end as status from markets where updated_at >= timestamp '2025-10-01')"


@query("w_upsert", f"""
with {_STORED}
select id, case when b.id is null then s.title else b.title end as title, case when s.id is null then b.status else coalesce(b.status, s.status) end as status,
  case when s.id is null then 'created' when b.id is null then 'untouched' when b.title is not distinct from s.title and coalesce(b.status, s.status) is not distinct from s.status then 'unchanged' else 'updated' end as change
from s full join b using (id)
""")
def _(t):
    new = t.markets.filter("updated_at >= timestamp_ntz'2025-10-01 00:00:00'")
    batch = new.select("id", F.when(F.col("metadata").isNull(), F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(F.col("derived_topic").isNotNull(), F.col("status")).alias("status"))
    return U.merge(t.markets.filter("created_at < timestamp_ntz'2025-12-01 00:00:00'").select("id", "title", "status"), batch, ["id"], {"status": U.changed_only})


@query("w_priority_merge", """
with o as (select left_market_id as id, cast(max(left_market_id % 90) as bigint) as p, 'old' as why from market_links where lower(trim(status)) = 'suggested' group by 1),
n as (select left_market_id as id, cast(max(right_market_id % 90) as bigint) as p, 'new' as why from market_links where lower(trim(status)) = 'confirmed' group by 1)
select id, greatest(coalesce(o.p, n.p), coalesce(n.p, o.p)) as p, case when o.id is null or n.p >= o.p then 'new' else 'old' end as why from o full join n using (id)
""")
def _(t):
    part = lambda s, c, w: t.market_links.filter(F.lower(F.trim("status")) == s).groupBy(F.col("left_market_id").alias("id")).agg(F.max(F.col(c) % 90).alias("p"), F.lit(w).alias("why"))
    o, n = part("suggested", "left_market_id", "old"), part("confirmed", "right_market_id", "new")
    j = U.merge(o.withColumn("v", F.struct("p", "why")).select("id", "v"), n.withColumn("v", F.struct("p", "why")).select("id", "v"), ["id"], {"v": lambda a, b: F.when(b["p"] >= a["p"], b).otherwise(F.struct(F.greatest(a["p"], b["p"]).alias("p"), a["why"].alias("why")))})
    return j.select("id", "v.p", "v.why")


@query("w_link_merge", """
with o as (select left_market_id as l, right_market_id as r, max(score) as score, max(lower(trim(status))) as status from market_links where reason is not null and score is not null and not isnan(score) group by 1, 2),
n as (select left_market_id as l, right_market_id as r, max(score) as score from market_links where reason is null and score is not null and not isnan(score) group by 1, 2)
select l, r, case when n.l is null or o.status = 'confirmed' then o.score else n.score end as score, case when o.status = 'confirmed' or n.l is null then o.status else 'suggested' end as status from o full join n using (l, r)
""")
def _(t):
    x = t.market_links.filter("score is not null and not isnan(score)")
    o = x.filter("reason is not null").groupBy(F.col("left_market_id").alias("l"), F.col("right_market_id").alias("r")).agg(F.max("score").alias("score"), F.max(F.lower(F.trim("status"))).alias("status"))
    n = x.filter("reason is null").groupBy(F.col("left_market_id").alias("l"), F.col("right_market_id").alias("r")).agg(F.max("score").alias("score"), F.lit("suggested").alias("status"))
    v = lambda d: d.select("l", "r", F.struct("score", "status").alias("v"))
    return U.merge(v(o), v(n), ["l", "r"], {"v": lambda a, b: F.when(a["status"] == "confirmed", a).otherwise(b)}).select("l", "r", "v.score", "v.status")


@query("w_cleanup", f"select id from market_links where not coalesce(updated_at < timestamp '{NOW}' - interval 200 day and lower(trim(status)) = 'suggested', false)")
def _(t):
    return U.remove(t.market_links, (F.col("updated_at") < now() - F.expr("interval 200 days")) & (F.lower(F.trim("status")) == "suggested")).select("id")


@query("w_backfill", "select id, case when algo_version is null or topic is null then 'legacy' else algo_version end as algo_version, case when algo_version is null or topic is null then 'unknown' else topic end as topic from market_links where lower(trim(status)) <> 'confirmed'")
def _(t):
    hole = F.col("algo_version").isNull() | F.col("topic").isNull()
    return t.market_links.filter(F.lower(F.trim("status")) != "confirmed").select("id", F.when(hole, "legacy").otherwise(F.col("algo_version")).alias("algo_version"), F.when(hole, "unknown").otherwise(F.col("topic")).alias("topic"))


@query("w_changed_only", r"""
with n as (select id, derived_topic, case when regexp_matches(lower(title), 'temperature|high temp') then 'CLIMATE' when contains(lower(title), 'winner') then 'SPORTS' else derived_topic end as topic from markets)
select id, topic from n where derived_topic is distinct from topic
""")
def _(t):
    s = F.lower("title")
    n = t.markets.select("id", "derived_topic", first_match([("CLIMATE", s.rlike("temperature|high temp")), ("SPORTS", s.contains("winner"))], F.col("derived_topic")).alias("topic"))
    return n.filter(~F.col("derived_topic").eqNullSafe(F.col("topic"))).select("id", "topic")


@query("w_csv_round_trip", "select id, case when isnan(score) then null else score end as score from market_links")
def _(t):
    scratch = Scratch(t.spark, "csv")
    rows = t.market_links.select("id", F.nanvl("score", F.lit(None).cast("double")).alias("score"))
    rows.write.mode("overwrite").option("header", True).csv(f"{scratch.root}/out")
    return t.spark.read.option("header", True).schema("id long, score double").csv(f"{scratch.root}/out")


@query("r_first_match", r"""
select p_partkey, case when regexp_matches(lower(p_type), 'promo') and not regexp_matches(lower(p_type), 'brass') then 'PROMO' when regexp_matches(lower(p_type), 'steel$') then 'STEEL' when p_size > 40 then 'BIG' else 'REST' end as label from part
""")
def _(t):
    p = F.lower("p_type")
    return t.part.select("p_partkey", first_match([("PROMO", p.rlike("promo") & ~p.rlike("brass")), ("STEEL", p.rlike("steel$")), ("BIG", F.col("p_size") > 40)], F.lit("REST")).alias("label"))


@query("r_rule_table", """
with r(ord, pattern, label) as (values (1, 'inflation', 'MACRO'), (2, 'cpi', 'MACRO'), (3, 'jobless', 'LABOUR'), (4, 'unemployment', 'LABOUR'), (5, 'rate', 'RATES'), (6, 'price', 'PRICE'), (7, 'above', 'LEVEL')),
w as (select id, unnest(list_distinct(string_split_regex(lower(title), '[^a-z0-9]+'))) as pattern from markets)
select id, arg_min(label, ord) as label, cast(min(ord) as bigint) as ord from w join r using (pattern) group by 1
""")
def _(t):
    rules = t.spark.createDataFrame([(1, "inflation", "MACRO"), (2, "cpi", "MACRO"), (3, "jobless", "LABOUR"), (4, "unemployment", "LABOUR"), (5, "rate", "RATES"), (6, "price", "PRICE"), (7, "above", "LEVEL")], "ord long, pattern string, label string")
    return match_table(t.markets, "title", rules)


_TIME = "case when a.c is null and b.c is null then 0.3 when a.c is null or b.c is null then 0.2 when abs(epoch_us(a.c) - epoch_us(b.c)) / 3.6e9 <= 12 then 1.0 when abs(epoch_us(a.c) - epoch_us(b.c)) / 3.6e9 <= 24 then 0.7 when abs(epoch_us(a.c) - epoch_us(b.c)) / 3.6e9 <= 48 then 0.4 when abs(epoch_us(a.c) - epoch_us(b.c)) / 3.6e9 <= 168 then 0.2 else 0.0 end"


@query("c_time_category", f"""
with m as (select id, close_time as c, category as g from markets), p as (select distinct left_market_id as l, right_market_id as r from market_links)
select l, r, cast({_TIME} as double) as time_score, cast(case when a.g is null and b.g is null then 0.5 when a.g is null or b.g is null then 0.3 when lower(trim(a.g)) = lower(trim(b.g)) then 1.0 when starts_with(lower(trim(a.g)), lower(trim(b.g))) or starts_with(lower(trim(b.g)), lower(trim(a.g))) then 0.8
  when list_has_any(list_filter(string_split_regex(lower(trim(a.g)), '[\\s_-]+'), lambda w: length(w) > 3), list_filter(string_split_regex(lower(trim(b.g)), '[\\s_-]+'), lambda w: length(w) > 3)) then 0.6 else 0.3 end as double) as category_score
from p join m a on a.id = l join m b on b.id = r
""")
def _(t):
    m = t.markets.select("id", "close_time", "category")
    p = t.market_links.select(F.col("left_market_id").alias("l"), F.col("right_market_id").alias("r")).distinct()
    a, b = m.select(F.col("id").alias("l"), F.col("close_time").alias("ca"), F.col("category").alias("ga")), m.select(F.col("id").alias("r"), F.col("close_time").alias("cb"), F.col("category").alias("gb"))
    return p.join(a, "l").join(b, "r").select("l", "r", C.time_score(F.col("ca"), F.col("cb")).alias("time_score"), C.category_score(F.col("ga"), F.col("gb")).alias("category_score"))


@query("c_number_entity", """
with a as (select o_custkey as k, list(distinct round(o_totalprice / 1000)) as n, list(distinct o_orderpriority) as e from orders group by 1), p as (select x.k as l, y.k as r, x.n as na, y.n as nb, x.e as ea, y.e as eb from a x join a y on y.k = x.k + 1),
s as (select l, r, list_transform(flatten(list_transform(na, lambda u: list_transform(nb, lambda v: {'u': u, 'v': v}))), lambda z: case when z.u = z.v then 1.0 when abs(z.u - z.v) / greatest(abs(z.u), abs(z.v)) < 0.01 then 0.95 when abs(z.u - z.v) / greatest(abs(z.u), abs(z.v)) < 0.05 then 0.8 when abs(z.u - z.v) / greatest(abs(z.u), abs(z.v)) < 0.1 then 0.5 else 0.0 end) as ns,
  len(list_intersect(ea, eb)) as i, len(list_distinct(list_concat(ea, eb))) as u from p)
select l, r, cast(list_max(ns) as double) as number_score, round(case when i = 0 then 0.0 else least(1.0, i / u + case when i >= 2 then 0.3 else 0.1 end) end, 6) as entity_score from s
""")
def _(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.round(F.col("o_totalprice") / 1000)).alias("n"), F.collect_set("o_orderpriority").alias("e"))
    x, y = a.select(F.col("k").alias("l"), F.col("n").alias("na"), F.col("e").alias("ea")), a.select((F.col("k") - 1).alias("l"), F.col("k").alias("r"), F.col("n").alias("nb"), F.col("e").alias("eb"))
    return x.join(y, "l").select("l", "r", C.number_score(F.col("na"), F.col("nb")).alias("number_score"), F.round(C.entity_score(F.col("ea"), F.col("eb")), 6).alias("entity_score"))


@query("c_ranges_days", """
with r as (select l_partkey as k, min(l_extendedprice) as lo, max(l_extendedprice) as hi, min(cast(l_shipdate as date)) as d from lineitem group by 1), p as (select a.k as l, a.lo as a1, a.hi as a2, b.lo as b1, b.hi as b2, abs(date_diff('day', a.d, b.d)) as g from r a join r b on b.k = a.k + 1)
select l, round(case when greatest(a2, b2) = least(a1, b1) then 1.0 else greatest(0, least(a2, b2) - greatest(a1, b1)) / (greatest(a2, b2) - least(a1, b1)) end, 6) as overlap, cast(case when g = 0 then 1.0 when g <= 1 then 0.95 when g <= 7 then 0.8 when g <= 30 then 0.5 when g <= 90 then 0.2 else 0.0 end as double) as day_score from p
""")
def _(t):
    r = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.min(F.col("l_shipdate").cast("date")).alias("d"))
    a, b = r.select(F.col("k").alias("l"), F.col("lo").alias("a1"), F.col("hi").alias("a2"), F.col("d").alias("da")), r.select((F.col("k") - 1).alias("l"), F.col("lo").alias("b1"), F.col("hi").alias("b2"), F.col("d").alias("db"))
    c = F.col
    return a.join(b, "l").select("l", F.round(C.range_overlap(c("a1"), c("a2"), c("b1"), c("b2")), 6).alias("overlap"), C.day_score(c("da"), c("db")).alias("day_score"))


@query("c_fuzzy", r"""
select id, round(case when greatest(length(a), length(b)) = 0 then 1 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end, 6) as alike from
 (select id, trim(regexp_replace(regexp_replace(lower(left_title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as a, trim(regexp_replace(regexp_replace(lower(right_title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as b from market_links)
""")
def _(t):
    return t.market_links.select("id", F.round(fuzzy(F.col("left_title"), F.col("right_title")), 6).alias("alike"))


@query("c_jaccard", f"""
with k as (select id, list_distinct({_tokens_sql('left_title')}) as a, list_distinct({_tokens_sql('right_title')}) as b from market_links)
select id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from k
""")
def _(t):
    return t.market_links.select("id", F.round(jaccard(tokenize(F.col("left_title")), tokenize(F.col("right_title"))), 6).alias("jaccard"))


@query("c_clamp", "select id, cast(case when score is null or isnan(score) then 0 else least(greatest(score, 0), 1) end as double) as s, floor(case when score is null or isnan(score) then 0 else least(greatest(score, 0), 1) end / 0.05 + 0.5)::bigint as bucket from market_links")
def _(t):
    s = C.clamp(F.col("score"))
    return t.market_links.select("id", s.alias("s"), C.price_bucket(s, 0.05).alias("bucket"))


def simple() -> Pipeline:
    """Word overlap, closeness in time and category; blocked on the words of five letters or more that both titles share."""
    shared = F.size(F.array_intersect("l_tok", "r_tok"))
    return Pipeline(
        "SIMPLE", lambda: F.filter("tok", lambda w: F.length(w) >= 5),
        {"words": (0.7, F.when(F.col("l_n") + F.col("r_n") == 0, 0.0).otherwise(F.col("shared") / (F.col("l_n") + F.col("r_n") - F.col("shared")))), "time": (0.2, C.time_score(F.col("l_close_time"), F.col("r_close_time"))), "category": (0.1, C.category_score(F.col("l_category"), F.col("r_category")))},
        gates=[F.col("l_venue") != F.col("r_venue")], least=0.35, per_left=3, per_right=3, given={"shared": shared},
    )


def _sides(t):
    m = t.markets.select("id", "venue", "close_time", "category", F.array_distinct(tokenize(F.col("title"))).alias("tok")).withColumn("n", F.size("tok"))
    return m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'")


@query("e_scored", f"""
with m as (select id, venue, close_time as c, category as g, list_distinct({_tokens_sql('title')}) as tok from markets), k as (select id, venue, unnest(list_filter(tok, lambda w: length(w) >= 5)) as w from m),
p as (select distinct a.id as l, b.id as r from k a join k b on a.w = b.w and a.venue = 'kalshi' and b.venue = 'polymarket'),
s as (select l, r, case when len(list_distinct(list_concat(a.tok, b.tok))) = 0 then 0 else len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok))) end as words, {_TIME} as t,
  case when a.g is null and b.g is null then 0.5 when a.g is null or b.g is null then 0.3 when lower(trim(a.g)) = lower(trim(b.g)) then 1.0 when starts_with(lower(trim(a.g)), lower(trim(b.g))) or starts_with(lower(trim(b.g)), lower(trim(a.g))) then 0.8
    when list_has_any(list_filter(string_split_regex(lower(trim(a.g)), '[\\s_-]+'), lambda w: length(w) > 3), list_filter(string_split_regex(lower(trim(b.g)), '[\\s_-]+'), lambda w: length(w) > 3)) then 0.6 else 0.3 end as g from p join m a on a.id = l join m b on b.id = r)
select l, r, round(0.0 + 0.7 * words + cast(0.2 as double) * t + cast(0.1 as double) * g, 6) as score from s where round(0.0 + 0.7 * words + cast(0.2 as double) * t + cast(0.1 as double) * g, 6) >= 0.35
""")
def _(t):
    """Every pair of listings of the two venues that shares a word and reaches the least score."""
    return simple_scored(*_sides(t), simple().least)


@query("e_pipeline")
def _(t):
    """The whole pipeline over all markets: block, gate, score, and choose greedily under the caps of both sides."""
    return simple_run(simple(), *_sides(t))


@query("st_ingest")
def _(t):
    """The quotes table streamed in and deduplicated cycle by cycle; the latest values at the end."""
    from tessera.streaming.quotes import ingest

    scratch = Scratch(t.spark, "stream")
    cols = ["arrival", "outcome_id", "ts", "price"]
    src = f"{scratch.root}/in"
    t.quotes.select(*cols).repartitionByRange(3, "arrival").sortWithinPartitions("arrival").write.parquet(src)
    stream = t.spark.readStream.schema(t.quotes.select(*cols).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest(stream, f"{scratch.root}/store", f"{scratch.root}/check", 0.01, 3600)
    q.awaitTermination()
    last = max(int(p["batchId"]) for p in q.recentProgress) if q.recentProgress else 0
    while last >= 0:
        try:
            return t.spark.read.parquet(f"{scratch.root}/store/latest/{last}")
        except Exception:
            last -= 1
    raise RuntimeError("nothing was ingested")


@query("e_topics")
def _(t):
    """Suggested links of every topic's pipeline, over all markets."""
    from tessera.plans.topics import suggest

    return suggest(t.markets)


@query("e_universal")
def _(t):
    """The pipeline that takes listings of any kind."""
    from tessera.plans.topics import suggest

    return suggest(t.markets, "UNIVERSAL")
