"""Counts, distributions, funnels and overlap reports (survey 2.6, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import words
from tessera.operators.rules import all_matches, first_match, zero_filled
from tessera.operators.selection import central_line, sample_per_group
from tessera.queries.registry import NOW, now, query

STATUSES = ["active", "closed", "resolved", "archived"]


@query("a_status_zero_filled", "select s.status, cast(count(m.id) as bigint) as n from (values ('active'), ('closed'), ('resolved'), ('archived'), ('paused')) s(status) left join markets m on m.status = s.status and m.venue = 'kalshi' group by 1")
def _(t):
    c = t.markets.filter("venue = 'kalshi'").groupBy("status").agg(F.count("*").alias("n"))
    return zero_filled(c, "status", [*STATUSES, "paused"])


@query("a_link_stats", "select lower(trim(status)) as status, cast(count(*) as bigint) as n, round(avg(case when isnan(score) then null else least(greatest(score, 0), 1) end), 6) as mean from market_links group by 1")
def _(t):
    s = F.when(~F.isnan("score"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return t.market_links.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"))


@query("a_by_version", "select algo_version, cast(count(*) as bigint) as n, cast(count(topic) as bigint) as with_topic from market_links group by 1")
def _(t):
    return t.market_links.groupBy("algo_version").agg(F.count("*").alias("n"), F.count("topic").alias("with_topic"))


@query("a_json_filtered", """
select regexp_extract(json_extract_string(metadata, '$.eventTicker'), '^([A-Z0-9]+)', 1) as series, cast(count(*) as bigint) as n, cast(count(*) filter (where list_contains(json_keys(metadata), 'mveCollectionTicker')) as bigint) as with_key
from markets where json_extract_string(metadata, '$.eventTicker') is not null group by 1 order by n desc, series limit 30
""")
def _(t):
    from tessera.functions.text import has_key

    k = F.get_json_object("metadata", "$.eventTicker")
    d = t.markets.filter(k.isNotNull()).groupBy(F.regexp_extract(k, "^([A-Z0-9]+)", 1).alias("series")).agg(F.count("*").alias("n"), F.count_if(has_key(F.col("metadata"), "mveCollectionTicker")).alias("with_key"))
    return d.orderBy(F.desc("n"), "series").limit(30)


@query("a_distinct_json", "select venue, cast(count(distinct json_extract_string(metadata, '$.eventTicker')) as bigint) as events, cast(count(distinct category) as bigint) as categories from markets group by 1")
def _(t):
    return t.markets.groupBy("venue").agg(F.count_distinct(F.get_json_object("metadata", "$.eventTicker")).alias("events"), F.count_distinct("category").alias("categories"))


@query("a_scalar_row", "select (select cast(count(*) as bigint) from markets) as markets, (select cast(count(*) as bigint) from outcomes) as outcomes, (select cast(count(distinct outcome_id) as bigint) from quotes) as quoted, (select max(ts) from quotes) as last_quote")
def _(t):
    a, b = t.markets.agg(F.count("*").alias("markets")), t.outcomes.agg(F.count("*").alias("outcomes"))
    return a.crossJoin(b).crossJoin(t.quotes.agg(F.count_distinct("outcome_id").alias("quoted"), F.max("ts").alias("last_quote")))


@query("a_top_series", "select kalshi_event_ticker as event, cast(count(*) as bigint) as n from markets where kalshi_event_ticker is not null group by 1 order by n desc, event limit 10")
def _(t):
    return t.markets.filter("kalshi_event_ticker is not null").groupBy(F.col("kalshi_event_ticker").alias("event")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event").limit(10)


@query("a_grouping_sets", "select venue, status, cast(grouping(venue) * 2 + grouping(status) as bigint) as level, cast(count(*) as bigint) as n from markets group by grouping sets ((venue), (status), (venue, status), ())")
def _(t):
    return t.markets.groupingSets([[F.col("venue")], [F.col("status")], [F.col("venue"), F.col("status")], []], "venue", "status").agg((F.grouping("venue") * 2 + F.grouping("status")).cast("bigint").alias("level"), F.count("*").alias("n"))


@query("a_topic_pivot", """
with c as (select derived_topic as topic, count(*) filter (where venue = 'kalshi') as k, count(*) filter (where venue = 'polymarket') as p from markets where derived_topic is not null group by 1)
select topic, cast(k as bigint) as kalshi, cast(p as bigint) as polymarket, cast(least(k, p) as bigint) as overlap, k > 0 and p > 0 as both_sides from c
""")
def _(t):
    c = t.markets.filter("derived_topic is not null").groupBy(F.col("derived_topic").alias("topic")).pivot("venue", ["kalshi", "polymarket"]).count().fillna(0)
    k, p = F.col("kalshi"), F.col("polymarket")
    return c.select("topic", "kalshi", "polymarket", F.least(k, p).alias("overlap"), ((k > 0) & (p > 0)).alias("both_sides"))


@query("a_histogram", """
select case when score < 0.5 then '<0.5' when score < 0.6 then '0.5-0.6' when score < 0.75 then '0.6-0.75' when score < 0.9 then '0.75-0.9' else '0.9+' end as bin, cast(count(*) as bigint) as n
from market_links where score is not null and not isnan(score) group by 1
""")
def _(t):
    s = F.col("score")
    b = first_match([("<0.5", s < 0.5), ("0.5-0.6", s < 0.6), ("0.6-0.75", s < 0.75), ("0.75-0.9", s < 0.9)], F.lit("0.9+"))
    return t.market_links.filter("score is not null and not isnan(score)").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("a_last_n_categories", """
select case when value > 200 then 'large' when json_extract_string(props, '$.k')::bigint % 2 = 0 then 'even' else 'other' end as kind, cast(count(*) as bigint) as n
from (select * from events where event_type = 'error' order by ts desc, event_id limit 500) group by 1
""")
def _(t):
    last = t.events.filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(500)
    kind = first_match([("large", F.col("value") > 200), ("even", F.get_json_object("props", "$.k").cast("bigint") % 2 == 0)], F.lit("other"))
    return last.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("a_time_cutoffs", f"""
select cast(count(*) filter (where ts >= timestamp '{NOW}' - interval 1 hour) as bigint) as h1, cast(count(*) filter (where ts >= timestamp '{NOW}' - interval 24 hour) as bigint) as h24,
  cast(count(*) filter (where ts >= timestamp '{NOW}' - interval 168 hour) as bigint) as h168, max(ts) as last_ts, cast(date_diff('second', max(ts), timestamp '{NOW}') as bigint) as age from quotes where ts <= timestamp '{NOW}'
""")
def _(t):
    c = lambda h: F.count_if(F.col("ts") >= now() - F.expr(f"interval {h} hours")).alias(f"h{h}")
    return t.quotes.filter(F.col("ts") <= now()).agg(c(1), c(24), c(168), F.max("ts").alias("last_ts"), F.timestamp_diff("SECOND", F.max("ts"), now()).alias("age"))


@query("a_keyword_counts", """
with k as (select unnest(['temperature', 'inflation', 'truce', 'winner', 'above']) as kw)
select kw, venue, cast(count(*) as bigint) as n from markets, k where contains(lower(title), kw) group by 1, 2
""")
def _(t):
    hit = all_matches([(w, F.lower("title").contains(w)) for w in ("temperature", "inflation", "truce", "winner", "above")])
    return t.markets.select("venue", F.explode(hit).alias("kw")).groupBy("kw", "venue").agg(F.count("*").alias("n"))


@query("a_key_sets", """
with p as (select category as e, venue, list_sort(list(distinct strftime(close_time, '%Y-%m'))) as k from markets where close_time is not null and category is not null group by 1, 2),
e as (select lower(e) as e, list_distinct(flatten(list(k) filter (where venue = 'kalshi'))) as a, list_distinct(flatten(list(k) filter (where venue = 'polymarket'))) as b from p group by 1)
select e, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') as shared, cast(len(list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x))) as bigint) as only_a, cast(len(list_filter(coalesce(b, []), lambda x: not list_contains(coalesce(a, []), x))) as bigint) as only_b from e
""")
def _(t):
    m = t.markets.filter("close_time is not null and category is not null").select(F.lower("category").alias("e"), "venue", F.date_format("close_time", "yyyy-MM").alias("k"))
    s = m.groupBy("e").agg(F.collect_set(F.when(F.col("venue") == "kalshi", F.col("k"))).alias("a"), F.collect_set(F.when(F.col("venue") == "polymarket", F.col("k"))).alias("b"))
    return s.select("e", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"), F.size(F.array_except("a", "b")).cast("bigint").alias("only_a"), F.size(F.array_except("b", "a")).cast("bigint").alias("only_b"))


@query("a_funnel", f"""
select venue, cast(count(*) as bigint) as all_rows, cast(count(*) filter (where a) as bigint) as s1, cast(count(*) filter (where a and b) as bigint) as s2, cast(count(*) filter (where a and b and c) as bigint) as s3,
  case when count(*) filter (where a) = 0 then 'NO_DATA' when count(*) filter (where a and b) = 0 then 'OUT_OF_WINDOW' when count(*) filter (where a and b and c) = 0 then 'TYPE_MISMATCH' else 'OK' end as verdict
from (select venue, coalesce(derived_topic = 'CRYPTO_DAILY', false) as a, coalesce(close_time >= timestamp '{NOW}', false) as b, coalesce(status = 'active', false) as c from markets) group by 1
""")
def _(t):
    f = lambda c: F.coalesce(c, F.lit(False))
    m = t.markets.select("venue", f(F.col("derived_topic") == "CRYPTO_DAILY").alias("a"), f(F.col("close_time") >= now()).alias("b"), f(F.col("status") == "active").alias("c"))
    g = m.groupBy("venue").agg(F.count("*").alias("all_rows"), F.count_if("a").alias("s1"), F.count_if(F.col("a") & F.col("b")).alias("s2"), F.count_if(F.col("a") & F.col("b") & F.col("c")).alias("s3"))
    return g.withColumn("verdict", first_match([("NO_DATA", F.col("s1") == 0), ("OUT_OF_WINDOW", F.col("s2") == 0), ("TYPE_MISMATCH", F.col("s3") == 0)], F.lit("OK")))


_RULES = [("weather", "temperature|high temp|reach"), ("film", "opening weekend|box office"), ("rates", "central bank|bank of|rate decision"), ("prices", "inflation|cpi"), ("jobs", "jobless|unemployment"), ("vote", "election|race|vote"), ("peace", "ceasefire|truce"), ("trade", "trade (pact|treaty|deal|agreement)")]
_CASE = "case " + " ".join(f"when regexp_matches(lower(title), '{p}') then '{n}'" for n, p in _RULES) + " else 'other' end"


@query("a_confusion", f"select {_CASE} as truth, coalesce(derived_topic, 'none') as topic, cast(count(*) as bigint) as n from markets group by 1, 2")
def _(t):
    truth = first_match([(n, F.lower("title").rlike(p)) for n, p in _RULES], F.lit("other"))
    return t.markets.groupBy(truth.alias("truth"), F.coalesce("derived_topic", F.lit("none")).alias("topic")).agg(F.count("*").alias("n"))


@query("a_samples_by_group", "select topic, n, ids from (select derived_topic as topic, cast(count(*) as bigint) as n, array_to_string(list_sort(list(id))[1:5], ',') as ids from markets group by 1)")
def _(t):
    w = Window.partitionBy("derived_topic").orderBy("id")
    n = t.markets.groupBy("derived_topic").agg(F.count("*").alias("n"))
    s = t.markets.select("derived_topic", "id", F.row_number().over(w).alias("k")).filter("k <= 5").groupBy("derived_topic").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return n.join(s, n.derived_topic.eqNullSafe(s.derived_topic)).select(n.derived_topic.alias("topic"), "n", "ids")


@query("a_group_sizes", "select size, cast(count(*) as bigint) as groups from (select cast(count(*) as bigint) as size from market_links group by left_market_id) group by 1")
def _(t):
    return t.market_links.groupBy("left_market_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query("a_upper_median", """
with r as (select p_brand, p_partkey, p_retailprice, p_size, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as k from part),
m as (select p_brand, p_retailprice as median from r where k = n // 2 + 1),
d as (select r.p_brand, r.p_partkey, m.median, row_number() over (partition by r.p_brand order by abs(r.p_retailprice - m.median), r.p_size desc, r.p_partkey) as o from r join m using (p_brand))
select p_brand, p_partkey, median from d where o = 1
""")
def _(t):
    return central_line(t.part.select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", "p_size", "p_partkey").select("p_brand", "p_partkey", "median")


@query("a_stale_rates", f"""
select venue, cast(count(*) filter (where status = 'active' and close_time < timestamp '{NOW}') as bigint) as stale, round(count(*) filter (where status = 'active' and close_time < timestamp '{NOW}') / count(*), 6) as rate,
  cast(count(*) filter (where status = 'active' and close_time < timestamp '{NOW}' - interval 48 hour) as bigint) as major from markets group by 1
""")
def _(t):
    s = (F.col("status") == "active") & (F.col("close_time") < now())
    return t.markets.groupBy("venue").agg(F.count_if(s).alias("stale"), F.round(F.count_if(s) / F.count("*"), 6).alias("rate"), F.count_if(s & (F.col("close_time") < now() - F.expr("interval 48 hours"))).alias("major"))


@query("a_rule_tallies", """
select rule, cast(count(*) as bigint) as n, round(avg(score), 6) as mean from (select score, unnest(list_filter([case when score < 0.55 then 'LOW' end, case when left_venue = right_venue then 'SAME_VENUE' end, case when reason is null then 'NO_REASON' end, case when updated_at > created_at + interval 24 hour then 'TOUCHED' end], lambda x: x is not null)) as rule
from market_links where score is not null and not isnan(score)) group by 1
""")
def _(t):
    s = F.col("score")
    hit = all_matches([("LOW", s < 0.55), ("SAME_VENUE", F.col("left_venue") == F.col("right_venue")), ("NO_REASON", F.col("reason").isNull()), ("TOUCHED", F.col("updated_at") > F.col("created_at") + F.expr("interval 24 hours"))])
    return t.market_links.filter("score is not null and not isnan(score)").select("score", F.explode(hit).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("a_cube_breakdown", "select venue, status, is_mve, cast(count(*) as bigint) as n from markets group by cube (venue, status, is_mve)")
def _(t):
    return t.markets.cube("venue", "status", "is_mve").agg(F.count("*").alias("n"))


@query("a_rollup_time", "select year(close_time) as y, month(close_time) as m, cast(count(*) as bigint) as n from markets where close_time is not null group by rollup (year(close_time), month(close_time))")
def _(t):
    return t.markets.filter("close_time is not null").rollup(F.year("close_time").cast("bigint").alias("y"), F.month("close_time").cast("bigint").alias("m")).agg(F.count("*").alias("n"))


@query("a_coverage", "select venue, cast(count(*) as bigint) as n, round(100.0 * count(kalshi_event_ticker) / count(*), 4) as pct_event, round(100.0 * count(metadata) / count(*), 4) as pct_meta from markets group by 1")
def _(t):
    pct = lambda c, n: F.round(F.lit(100.0) * F.count(c) / F.count("*"), 4).alias(n)
    return t.markets.groupBy("venue").agg(F.count("*").alias("n"), pct("kalshi_event_ticker", "pct_event"), pct("metadata", "pct_meta"))


@query("a_json_keys", """
select k, cast(count(*) as bigint) as n, cast(count(*) filter (where json_type(metadata, '$.' || k) = 'NULL') as bigint) as nulls from (select metadata, unnest(json_keys(metadata)) as k from markets where metadata is not null) group by 1
""")
def _(t):
    k = t.markets.filter("metadata is not null").select(F.from_json("metadata", "map<string,string>").alias("m")).select(F.explode("m").alias("k", "v"))
    return k.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))


@query("a_tag_distribution", "select tag, cast(count(*) as bigint) as n from (select unnest(string_split(algo_version, '@')) as tag from market_links where algo_version is not null) group by 1")
def _(t):
    return t.market_links.filter("algo_version is not null").select(F.explode(F.split("algo_version", "@")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("a_pair_potential", """
with c as (select cast(close_time as date) as d, count(*) filter (where venue = 'kalshi') as a, count(*) filter (where venue = 'polymarket') as b from markets where close_time is not null group by 1)
select cast(d as varchar) as d, cast(a * b as bigint) as pairs from c where a > 0 and b > 0 order by pairs desc, d limit 50
""")
def _(t):
    c = t.markets.filter("close_time is not null").groupBy(F.date_format("close_time", "yyyy-MM-dd").alias("d")).agg(F.count_if(F.col("venue") == "kalshi").alias("a"), F.count_if(F.col("venue") == "polymarket").alias("b"))
    return c.filter("a > 0 and b > 0").select("d", (F.col("a") * F.col("b")).alias("pairs")).orderBy(F.desc("pairs"), "d").limit(50)


@query("a_strict_broad", r"""
select derived_topic, cast(count(*) filter (where regexp_matches(lower(title), '(^|[^a-z0-9_])cut([^a-z0-9_]|$)')) as bigint) as strict, cast(count(*) filter (where contains(lower(title), 'cut') and not regexp_matches(lower(title), '(^|[^a-z0-9_])cut([^a-z0-9_]|$)')) as bigint) as broad_only from markets group by 1
""")
def _(t):
    strict, broad = F.lower("title").rlike("(^|[^a-z0-9_])cut([^a-z0-9_]|$)"), F.lower("title").contains("cut")
    return t.markets.groupBy("derived_topic").agg(F.count_if(strict).alias("strict"), F.count_if(broad & ~strict).alias("broad_only"))


@query("a_missing_gaps", "select lang, cast(count(*) as bigint) as n, cast(count(*) filter (where text is null or text = '') as bigint) as empty, cast(count(*) filter (where market_id is null) as bigint) as unlinked, cast(max(n_chars) as bigint) as longest from documents group by 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(F.col("market_id").isNull()).alias("unlinked"), F.max("n_chars").alias("longest"))


@query("a_word_counts", "select w, cast(count(*) as bigint) as n from (select unnest(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) as w from markets) group by 1 order by n desc, w limit 100")
def _(t):
    return t.markets.select(F.explode(words(F.col("title"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(100)


@query("a_seeded_sample")
def _(t):
    """Five markets of each topic in an order fixed by a seed: a sampling operator, so the limit is the feature."""
    return sample_per_group(t.markets.filter("derived_topic is not null").select("id", "derived_topic", "title"), ["derived_topic"], 5, 42, "id")


@query("a_set_operations", """
(select left_market_id as id from market_links where score >= 0.9 and not isnan(score) intersect select market_id from market_snapshots) except (select market_id from outcomes where external_id is null)
""")
def _(t):
    a = t.market_links.filter("score >= 0.9 and not isnan(score)").select(F.col("left_market_id").alias("id"))
    return a.intersect(t.market_snapshots.select("market_id")).subtract(t.outcomes.filter("external_id is null").select("market_id"))
