"""Joins: lookups, semi and anti, key blocking, bands, buckets, periods (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokenize, words
from tessera.operators import blocking as B
from tessera.operators.upsert import diff
from tessera.queries.filters import _tokens_sql
from tessera.queries.registry import NOW, now, query
from tessera.shared import Scratch


@query("j_quotes_by_venue", "select m.venue, cast(count(*) as bigint) as n from quotes q join outcomes o on q.outcome_id = o.id join markets m on o.market_id = m.id group by 1")
def _(t):
    o = t.outcomes.select(F.col("id").alias("outcome_id"), "market_id")
    m = t.markets.select(F.col("id").alias("market_id"), "venue")
    # counted per outcome before the joins: the quotes never travel
    return t.quotes.groupBy("outcome_id").count().join(o, "outcome_id").join(m, "market_id").groupBy("venue").agg(F.sum("count").alias("n"))


@query("j_outcomes_latest", f"""
with l as (select outcome_id, max(ts) as ts from quotes group by 1)
select m.venue, cast(count(*) as bigint) as n, cast(count(l.ts) as bigint) as quoted, cast(count(*) filter (where l.ts >= timestamp '{NOW}' - interval 24 hour) as bigint) as fresh
from outcomes o join markets m on o.market_id = m.id left join l on l.outcome_id = o.id group by 1
""")
def _(t):
    latest = t.quotes.groupBy("outcome_id").agg(F.max("ts").alias("ts"))
    x = t.outcomes.select(F.col("id").alias("outcome_id"), "market_id").join(t.markets.select(F.col("id").alias("market_id"), "venue"), "market_id").join(latest, "outcome_id", "left")
    return x.groupBy("venue").agg(F.count("*").alias("n"), F.count("ts").alias("quoted"), F.count_if(F.col("ts") >= now() - F.expr("interval 24 hours")).alias("fresh"))


@query("j_nested_outcomes", "select m.id, string_agg(o.side || ':' || o.id, ',' order by o.id) as sides from markets m join outcomes o on o.market_id = m.id where m.status = 'active' group by 1")
def _(t):
    n = t.outcomes.groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct("id", "side"))).alias("o"))
    j = t.markets.filter("status = 'active'").select("id").join(n, F.col("id") == F.col("market_id"))
    return j.select("id", F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["side"], x["id"])), ",").alias("sides"))


@query("j_resolve_outcomes", """
with q as (select o.market_id, case when o.side = 'yes' then o.external_id end as external_id, upper(o.name) as name, o.id as truth from outcomes o),
e as (select market_id, external_id, min(id) as i from outcomes where external_id is not null group by 1, 2), n as (select market_id, lower(trim(name)) as name, min(id) as i from outcomes where name is not null group by 1, 2)
select q.truth, coalesce(e.i, n.i) as outcome_id from q left join e on q.market_id = e.market_id and q.external_id = e.external_id left join n on q.market_id = n.market_id and lower(trim(q.name)) = n.name
where coalesce(e.i, n.i) is not null
""")
def _(t):
    from tessera.operators.quotes import resolve_outcomes

    q = t.outcomes.select("market_id", F.when(F.col("side") == "yes", F.col("external_id")).alias("external_id"), F.upper("name").alias("name"), F.col("id").alias("truth"))
    return resolve_outcomes(q, t.outcomes).select("truth", "outcome_id")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3))"


_TOKENS = f"list_distinct(list_filter({_tokens_sql('title')}, lambda w: length(w) >= 3))"


@query("j_token_index", f"""
with w as (select id, venue, unnest({_TOKENS}) as k from markets)
select a.id as l, b.id as r, cast(count(*) as bigint) as n_keys from w a join w b on a.k = b.k and a.venue = 'kalshi' and b.venue = 'polymarket' group by 1, 2
""")
def _(t):
    """All listings of the two venues that share a token of three letters or more (survey J5)."""
    m = t.markets.select("id", "venue", tokenize(F.col("title")).alias("w"))
    return B.token_pairs(m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'"), "w")


@query("j_token_overlap", f"""
with w as (select id, venue, unnest({_TOKENS}) as k from markets)
select a.id as l, b.id as r, cast(count(*) as bigint) as n_keys from w a join w b on a.k = b.k and a.venue = 'kalshi' and b.venue = 'polymarket' group by 1, 2 having count(*) >= 3
""")
def _(t):
    """Those that share three tokens: each listing is found by its rarer tokens only, and none is lost."""
    m = t.markets.select("id", "venue", tokenize(F.col("title")).alias("w"))
    return B.token_pairs(m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'"), "w", least=3)


_LONG = "list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 8))"


@query("j_entity_year_fallback", f"""
with m as (select id, venue, {_LONG} as e, year(close_time) as y, left(trim(lower(title)), 1) as c from markets),
k as (select id, venue, unnest(e) as e from m),
f as (select distinct a.id as l, b.id as r from k a join k b on a.e = b.e and a.venue = 'kalshi' and b.venue = 'polymarket'),
s as (select a.id as l, b.id as r from m a join m b on a.y = b.y and a.c = b.c and a.venue = 'kalshi' and b.venue = 'polymarket')
select * from f union all select * from s where l not in (select l from f)
""")
def _(t):
    """Listings that share a long word; for those that share none with anybody, year and initial."""
    long = F.filter(words(F.col("title")), lambda w: F.length(w) >= 8)
    m = t.markets.select("id", "venue", long.alias("e"), F.array(F.when(F.col("close_time").isNotNull(), F.concat(F.year("close_time").cast("string"), F.substring(F.trim(F.lower("title")), 1, 1)))).alias("y"))
    l, r = m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'")
    return B.key_join_or(l, r, "e", "y")


@query("j_entity_names")
def _(t):
    """The same join by the names read from titles; for
    those that find no namesake, the year and the first letter of a name. Titles that cannot be read pair with nothing."""
    from tessera.plans.topics import signals

    m = signals(t.markets).select("id", "venue", "names", "year")
    m = Scratch(t.spark, "entities").write(m.withColumn("initials", F.when(F.col("year").isNotNull(), F.transform("names", lambda n: F.concat_ws("|", "year", F.substring(n, 1, 1))))))
    l, r = m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'")
    return B.key_join_or(l, r, "names", "initials")


@query("j_period_compatible", """
with m as (select id, venue, cast(close_time as date) as d, regexp_extract(title, '([A-Z][a-z]{6,})', 1) as e, case id % 3 when 0 then 'month' when 1 then 'quarter' else 'year' end as kind from markets where close_time is not null and regexp_matches(title, '[A-Z][a-z]{6,}')),
p as (select *, case kind when 'month' then strftime(d, '%Y-%m') when 'quarter' then year(d) || '-Q' || quarter(d) else year(d)::varchar end as k from m)
select a.id as l, b.id as r, cast(case when a.kind = b.kind then 1 else 0 end as bigint) as exact from p a join p b on a.e = b.e and a.venue = 'kalshi' and b.venue = 'polymarket'
where a.k = b.k or (a.kind <> b.kind and ((a.kind = 'year' or b.kind = 'year') and year(a.d) = year(b.d) or (a.kind <> 'year' and b.kind <> 'year' and year(a.d) = year(b.d) and quarter(a.d) = quarter(b.d))))
""")
def _(t):
    kind = F.when(F.col("id") % 3 == 0, "month").when(F.col("id") % 3 == 1, "quarter").otherwise("year")
    m = t.markets.filter("close_time is not null").select("id", "venue", F.col("close_time").cast("date").alias("d"), F.regexp_extract("title", "([A-Z][a-z]{6,})", 1).alias("e"), kind.alias("kind")).filter("e <> ''")
    d = F.col("d")
    own = F.when(F.col("kind") == "month", F.date_format("d", "yyyy-MM")).when(F.col("kind") == "quarter", F.format_string("%04d-Q%d", F.year(d), F.quarter(d))).otherwise(F.year(d).cast("string"))
    a = m.filter("venue = 'kalshi'").select(F.col("id").alias("l"), "e", F.col("kind").alias("a"), F.explode(B.period_keys(d, F.col("kind"))).alias("k"))
    b = m.filter("venue = 'polymarket'").select(F.col("id").alias("r"), "e", F.col("kind").alias("b"), own.alias("k"))
    return a.join(b, ["e", "k"]).select("l", "r", F.when(F.col("a") == F.col("b"), 1).otherwise(0).cast("bigint").alias("exact")).distinct()


@query("j_period_ranked", """
with m as (select id, venue, cast(close_time as date) as d, regexp_extract(title, '([A-Z][a-z]{6,})', 1) as e, case id % 3 when 0 then 'month' when 1 then 'quarter' else 'year' end as kind from markets where close_time is not null and regexp_matches(title, '[A-Z][a-z]{6,}')),
p as (select a.id as l, b.id as r, a.kind as x, b.kind as y from m a join m b on a.e = b.e and a.venue = 'kalshi' and b.venue = 'polymarket' and year(a.d) = year(b.d)
  and case when 'year' in (a.kind, b.kind) then true when 'quarter' in (a.kind, b.kind) then quarter(a.d) = quarter(b.d) else month(a.d) = month(b.d) end),
w as (select l, r, case when x = y then 1.0 when 'year' not in (x, y) then 0.6 when 'month' not in (x, y) then 0.55 else 0.45 end as w from p)
select l, r, cast(w as double) as weight, k as rank from (select *, row_number() over (partition by l order by w desc, r) as k from w) where k <= 10
""")
def _(t):
    """The ten best candidates of compatible periods, weighted by how their kinds fit."""
    from tessera.functions.scores import period_weight

    kind = F.when(F.col("id") % 3 == 0, "month").when(F.col("id") % 3 == 1, "quarter").otherwise("year")
    m = t.markets.filter("close_time is not null").select("id", "venue", F.col("close_time").cast("date").alias("d"), F.regexp_extract("title", "([A-Z][a-z]{6,})", 1).alias("e"), kind.alias("kind")).filter("e <> ''")
    d = F.col("d")
    own = F.when(F.col("kind") == "month", F.date_format("d", "yyyy-MM")).when(F.col("kind") == "quarter", F.format_string("%04d-Q%d", F.year(d), F.quarter(d))).otherwise(F.year(d).cast("string"))
    a = m.filter("venue = 'kalshi'").select(F.col("id").alias("l"), "e", F.col("kind").alias("a"), F.explode(B.period_keys(d, F.col("kind"))).alias("k"))
    b = m.filter("venue = 'polymarket'").select(F.col("id").alias("r"), "e", F.col("kind").alias("b"), own.alias("k"))
    w = a.join(b, ["e", "k"]).select("l", "r", period_weight(F.col("a"), F.col("b")).alias("weight"))
    return B.cap_per(w, "l", 10, F.col("weight").desc(), F.col("r")).select("l", "r", "weight", F.col("rank").cast("bigint").alias("rank"))


@query("j_entity_ranked", f"""
with k as (select id, venue, close_time as c, unnest({_LONG}) as e from markets),
p as (select a.id as l, b.id as r, count(*) as n, min(abs(epoch_us(a.c) - epoch_us(b.c))) as apart from k a join k b on a.e = b.e and a.venue = 'kalshi' and b.venue = 'polymarket' group by 1, 2)
select l, r, cast(n as bigint) as n_keys, rank from (select *, row_number() over (partition by l order by n desc, apart nulls last, r) as rank from p) where rank <= 20
""")
def _(t):
    """The twenty best candidates of every listing that share a long word: most words, then nearest in time."""
    from tessera.shared import epoch_us

    m = t.markets.select("id", "venue", epoch_us("close_time").alias("c"), F.filter(words(F.col("title")), lambda w: F.length(w) >= 8).alias("w"))
    return B.nearest_sharing(m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'"), "w", "c", 20).select("l", "r", "n_keys", F.col("rank").cast("bigint").alias("rank"))


@query("j_band_days", """
with m as (select id, venue, derived_topic as k, upper(left(trim(title), 3)) as e, cast(close_time as date) as d from markets where close_time is not null and derived_topic is not null)
select a.id as l, b.id as r, abs(date_diff('day', a.d, b.d)) as apart from m a join m b on a.k = b.k and a.e = b.e and a.venue = 'kalshi' and b.venue = 'polymarket' where abs(date_diff('day', a.d, b.d)) <= 1
""")
def _(t):
    m = t.markets.filter("close_time is not null and derived_topic is not null").select("id", "venue", F.col("derived_topic").alias("k"), F.upper(F.substring(F.trim("title"), 1, 3)).alias("e"), F.col("close_time").cast("date").alias("d"))
    a = m.filter("venue = 'kalshi'").select(F.col("id").alias("l"), "k", "e", F.col("d").alias("da"), F.explode(B.near_days(F.col("d"))).alias("d"))
    b = m.filter("venue = 'polymarket'").select(F.col("id").alias("r"), "k", "e", "d")
    return a.join(b, ["k", "e", "d"]).select("l", "r", F.abs(F.datediff("da", "d")).cast("bigint").alias("apart"))


@query("j_time_bucket", "select a.event_id as l, b.event_id as r from events a join events b on a.user_id = b.user_id and time_bucket(interval 1 hour, a.ts) = time_bucket(interval 1 hour, b.ts) and a.event_type = 'click' and b.event_type = 'view'")
def _(t):
    from tessera.functions.scores import time_bucket

    e = t.events.select("event_id", "user_id", "event_type", time_bucket(F.col("ts"), 3600).alias("k"))
    a, b = e.filter("event_type = 'click'").select(F.col("event_id").alias("l"), "user_id", "k"), e.filter("event_type = 'view'").select(F.col("event_id").alias("r"), "user_id", "k")
    return a.join(b, ["user_id", "k"]).select("l", "r")


@query("j_near_months", """
with m as (select id, venue, regexp_extract(title, 'Bank of ([A-Z][a-z]+)', 1) as e, year(close_time) * 12 + month(close_time) as k from markets where close_time is not null)
select a.id as l, b.id as r, cast(abs(a.k - b.k) as bigint) as apart from m a join m b on a.e = b.e and a.e <> '' and a.venue = 'kalshi' and b.venue = 'polymarket' and abs(a.k - b.k) <= 1
""")
def _(t):
    m = t.markets.filter("close_time is not null").select("id", "venue", "close_time", F.regexp_extract("title", "Bank of ([A-Z][a-z]+)", 1).alias("e")).filter("e <> ''")
    month = F.year("close_time") * 12 + F.month("close_time")
    a = m.filter("venue = 'kalshi'").select(F.col("id").alias("l"), "e", month.alias("ka"), F.explode(B.near_months(F.col("close_time"))).alias("k"))
    b = m.filter("venue = 'polymarket'").select(F.col("id").alias("r"), "e", month.alias("k"))
    return a.join(b, ["e", "k"]).select("l", "r", F.abs(F.col("ka") - F.col("k")).cast("bigint").alias("apart"))


@query("j_candidate_cap", f"""
with w as (select id, venue, unnest({_WORDS}) as k from markets),
p as (select a.id as l, b.id as r, count(*) as n from w a join w b on a.k = b.k and a.venue = 'kalshi' and b.venue = 'polymarket' group by 1, 2)
select l, r, cast(n as bigint) as n_keys, k as rank from (select *, row_number() over (partition by l order by n desc, r) as k from p) where k <= 5
""")
def _(t):
    """The five best candidates of every listing, of all topics and of none."""
    m = t.markets.select("id", "venue", words(F.col("title")).alias("w"))
    return B.most_sharing(m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'"), "w", 5).select("l", "r", "n_keys", F.col("rank").cast("bigint").alias("rank"))


@query("j_event_enrichment", """
with e as (select kalshi_event_ticker as ticker, count(*) as n, min(close_time) as first_close from markets where kalshi_event_ticker is not null group by 1)
select m.id, e.ticker, cast(e.n as bigint) as n, e.first_close from markets m left join e on e.ticker = coalesce(m.kalshi_event_ticker, json_extract_string(m.metadata, '$.eventTicker')) where m.venue = 'kalshi'
""")
def _(t):
    e = t.markets.filter("kalshi_event_ticker is not null").groupBy(F.col("kalshi_event_ticker").alias("ticker")).agg(F.count("*").alias("n"), F.min("close_time").alias("first_close"))
    m = t.markets.filter("venue = 'kalshi'").select("id", F.coalesce("kalshi_event_ticker", F.get_json_object("metadata", "$.eventTicker")).alias("k"))
    return m.join(e, F.col("k") == F.col("ticker"), "left").select("id", "ticker", "n", "first_close")


@query("j_has_confirmed", """
with c as (select left_market_id as id from market_links where lower(trim(status)) = 'confirmed' union select right_market_id from market_links where lower(trim(status)) = 'confirmed')
select m.id, m.id in (select id from c) as linked from markets m
""")
def _(t):
    c = t.market_links.filter(F.lower(F.trim("status")) == "confirmed")
    ends = c.select(F.col("left_market_id").alias("id")).unionByName(c.select(F.col("right_market_id").alias("id"))).distinct().withColumn("y", F.lit(True))
    return t.markets.select("id").join(ends, "id", "left").select("id", F.coalesce("y", F.lit(False)).alias("linked"))


@query("j_missing_keys", """
with a as (select distinct market_id as k from market_snapshots), b as (select distinct left_market_id as k from market_links)
select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)
""")
def _(t):
    return diff(t.market_snapshots.select(F.col("market_id").alias("k")), t.market_links.select(F.col("left_market_id").alias("k")), "k")


@query("j_cross_venue", "select id from market_links where left_market_id <> right_market_id and left_venue <> right_venue and score >= 0.9 and not isnan(score)")
def _(t):
    return t.market_links.filter("left_market_id <> right_market_id and left_venue <> right_venue and score >= 0.9 and not isnan(score)").select("id")


@query("j_link_titles", """
select l.id, coalesce(a.title, l.left_title) as a, coalesce(b.title, l.right_title) as b from market_links l left join markets a on a.id = l.left_market_id left join markets b on b.id = l.right_market_id
""")
def _(t):
    m = t.markets.select("id", "title")
    l = t.market_links.select("id", "left_market_id", "right_market_id", "left_title", "right_title")
    a, b = m.select(F.col("id").alias("left_market_id"), F.col("title").alias("ta")), m.select(F.col("id").alias("right_market_id"), F.col("title").alias("tb"))
    return l.join(a, "left_market_id", "left").join(b, "right_market_id", "left").select("id", F.coalesce("ta", "left_title").alias("a"), F.coalesce("tb", "right_title").alias("b"))


@query("j_star", """
select n_name, cast(count(*) as bigint) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderdate >= timestamp '1994-01-01' group by 1
""")
def _(t):
    o = t.orders.filter("o_orderdate >= timestamp_ntz'1994-01-01'").select("o_orderkey", "o_custkey")
    x = t.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    return x.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", F.round("v", 2).alias("revenue"))


def _typed_keys(markets):
    m = markets.filter("close_time is not null").select("id", "venue", F.lower(F.trim("category")).alias("g"), F.date_format("close_time", "yyyy-MM-dd").alias("d"), F.col("derived_topic").alias("k"))
    key = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat_ws("|", F.lit(kind), c, "d"))
    keys = F.array(key("a", "k"), key("b", "g"))
    return B.key_join(m.filter("venue = 'kalshi'"), m.filter("venue = 'polymarket'"), keys, keys)


@query("j_typed_keys", """
with m as (select id, venue, lower(trim(category)) as g, cast(cast(close_time as date) as varchar) as d, derived_topic as k from markets where close_time is not null),
e as (select id, venue, unnest([case when k is not null then 'a|' || k || '|' || d end, case when g is not null then 'b|' || g || '|' || d end]) as key from m)
select a.id as l, b.id as r, cast(count(*) as bigint) as n_keys from e a join e b on a.key = b.key and a.venue = 'kalshi' and b.venue = 'polymarket' group by 1, 2
""")
def _(t):
    return _typed_keys(t.markets)


@query("j_team_pairs", r"""
with k as (select id, regexp_extract(title, '^([A-Za-z]+) at ([A-Za-z]+) winner', 1) as a, regexp_extract(title, '^([A-Za-z]+) at ([A-Za-z]+) winner', 2) as b from markets where venue = 'kalshi'),
p as (select id, regexp_extract(title, '^([A-Za-z]+)( [A-Za-z]+)? vs\.? ([A-Za-z]+)', 1) as a, regexp_extract(title, '^([A-Za-z]+)( [A-Za-z]+)? vs\.? ([A-Za-z]+)', 3) as b from markets where venue = 'polymarket')
select k.id as l, p.id as r from k join p on k.a <> '' and p.a <> '' and least(k.a, k.b) = least(p.a, p.b) and greatest(k.a, k.b) = greatest(p.a, p.b)
""")
def _(t):
    def sides(venue, pattern, i, j, name):
        m = t.markets.filter(F.col("venue") == venue).select(F.col("id").alias(name), F.regexp_extract("title", pattern, i).alias("a"), F.regexp_extract("title", pattern, j).alias("b")).filter("a <> ''")
        return m.select(name, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))

    return sides("kalshi", "^([A-Za-z]+) at ([A-Za-z]+) winner", 1, 2, "l").join(sides("polymarket", r"^([A-Za-z]+)( [A-Za-z]+)? vs\.? ([A-Za-z]+)", 1, 3, "r"), ["x", "y"]).select("l", "r")
