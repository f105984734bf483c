"""Filters, pages and searches (survey 2.3, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import json_ticker, ticker_prefix, tokenize
from tessera.queries.registry import NOW, now, query


@query("f_active_top", f"select id, updated_at from markets where lower(trim(status)) in ('active', 'closed') order by updated_at desc nulls last, id limit 200")
def _(t):
    return t.markets.filter(F.lower(F.trim("status")).isin("active", "closed")).select("id", "updated_at").orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(200)


@query("f_recent_window", f"select id from markets where status = 'active' or (status = 'closed' and close_time >= timestamp '{NOW}' - interval 72 hour)")
def _(t):
    return t.markets.filter((F.col("status") == "active") | ((F.col("status") == "closed") & (F.col("close_time") >= now() - F.expr("interval 72 hours")))).select("id")


@query("f_keyset_page", "select id, title from markets where id > 100 and status = 'active' order by id limit 50")
def _(t):
    return t.markets.filter("id > 100 and status = 'active'").select("id", "title").orderBy("id").limit(50)


@query("f_nulls_first", "select id, close_time from markets where status = 'active' order by close_time desc nulls first, id desc limit 200")
def _(t):
    """A page in the order that puts listings without a close_time first."""
    return t.markets.filter("status = 'active'").select("id", "close_time").orderBy(F.col("close_time").desc_nulls_first(), F.col("id").desc()).limit(200)


@query("f_offset_page", "select id from market_links where score >= 0.5 and not isnan(score) order by score desc, id limit 100 offset 300")
def _(t):
    d = t.market_links.filter("score >= 0.5 and not isnan(score)").select("id", "score").orderBy(F.col("score").desc(), "id")
    return d.offset(300).limit(100).select("id")


@query("f_two_sided", """
with o as (select market_id from outcomes group by market_id having count(*) = 2 and count(distinct side) = 2 and min(side) = 'no' and max(side) = 'yes'),
p as (select id from markets where lower(title) like '%price%' or lower(title) like '%above%' order by id desc limit 500)
select p.id from p join o on p.id = o.market_id
""")
def _(t):
    page = t.markets.filter(F.col("title").ilike("%price%") | F.col("title").ilike("%above%")).select("id").orderBy(F.desc("id")).limit(500)
    sides = t.outcomes.groupBy("market_id").agg(F.count("*").alias("n"), F.collect_set("side").alias("s")).filter((F.col("n") == 2) & (F.size("s") == 2) & F.array_contains("s", "yes") & F.array_contains("s", "no"))
    return page.join(sides, F.col("id") == F.col("market_id"), "left_semi")


@query("f_title_regex", r"select id, close_time from markets where lower(title) like '%inflation%' or regexp_matches(lower(title), '(^|[^a-z0-9_])cpi([^a-z0-9_]|$)') order by close_time desc nulls last, id limit 300")
def _(t):
    hit = F.col("title").ilike("%inflation%") | F.lower("title").rlike("(^|[^a-z0-9_])cpi([^a-z0-9_]|$)")
    return t.markets.filter(hit).select("id", "close_time").orderBy(F.col("close_time").desc_nulls_last(), "id").limit(300)


@query("f_flag_three_valued", "select derived_topic, cast(count(*) filter (where is_mve) as bigint) as yes, cast(count(*) filter (where not is_mve) as bigint) as no, cast(count(*) filter (where is_mve is null) as bigint) as unknown from markets group by 1")
def _(t):
    f = F.col("is_mve")
    return t.markets.groupBy("derived_topic").agg(F.count_if(f).alias("yes"), F.count_if(~f).alias("no"), F.count_if(f.isNull()).alias("unknown"))


@query("f_window_reasons", f"""
select reason, cast(count(*) as bigint) as n from (select unnest(list_filter([
  case when status in ('resolved', 'archived') then 'over' end, case when status = 'active' and close_time < timestamp '{NOW}' - interval 1 hour then 'stale' end,
  case when close_time is null then 'no_time' end, case when status = 'closed' and close_time < timestamp '{NOW}' - interval 168 hour then 'old' end], lambda x: x is not null)) as reason from markets) group by 1
""")
def _(t):
    from tessera.operators.rules import all_matches

    c, s = F.col("close_time"), F.col("status")
    why = all_matches([("over", s.isin("resolved", "archived")), ("stale", (s == "active") & (c < now() - F.expr("interval 1 hour"))), ("no_time", c.isNull()), ("old", (s == "closed") & (c < now() - F.expr("interval 168 hours")))])
    return t.markets.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("f_keyword_phrase", r"""
select id from (select id, ' ' || array_to_string(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' as t from markets)
where t like '% opening weekend %' or t like '% rate decision %' or t like '% truce %'
""")
def _(t):
    from tessera.functions.text import has_phrase, words

    w = words(F.col("title"))
    return t.markets.filter(has_phrase(w, "opening weekend") | has_phrase(w, "rate decision") | has_phrase(w, "truce")).select("id")


@query("f_prefix_exclusion", r"""
select id from markets where not coalesce(regexp_matches(upper(trim(kalshi_event_ticker)), '^KX[AB]'), false) and not regexp_matches(lower(coalesce(title, '')), ' vs |winner|kestrels')
""")
def _(t):
    bad = F.coalesce(F.upper(F.trim("kalshi_event_ticker")).rlike("^KX[AB]"), F.lit(False)) | F.lower(F.coalesce("title", F.lit(""))).rlike(" vs |winner|kestrels")
    return t.markets.filter(~bad).select("id")


@query("f_ticker_like", "select json_extract_string(metadata, '$.eventTicker') as ticker, cast(count(*) as bigint) as n from markets where json_extract_string(metadata, '$.eventTicker') like 'KXA%' or json_extract_string(metadata, '$.eventTicker') like '%-26JAN' group by 1")
def _(t):
    k = F.get_json_object("metadata", "$.eventTicker")
    return t.markets.filter(k.like("KXA%") | k.like("%-26JAN")).groupBy(k.alias("ticker")).agg(F.count("*").alias("n"))


@query("f_link_best", "select id, score from market_links where upper(trim(topic)) = 'SPORTS' and lower(trim(status)) = 'suggested' and not isnan(score) order by score desc nulls last, id limit 100")
def _(t):
    d = t.market_links.filter((F.upper(F.trim("topic")) == "SPORTS") & (F.lower(F.trim("status")) == "suggested") & ~F.isnan("score"))
    return d.select("id", "score").orderBy(F.col("score").desc_nulls_last(), "id").limit(100)


@query("f_reason_parts", r"""
select id, regexp_extract(reason, 'entity=([A-Z0-9]+)', 1) as entity, try_cast(nullif(regexp_extract(reason, 'text=([0-9.]+)', 1), '') as double) as txt,
  try_cast(nullif(regexp_extract(reason, 'date=[0-9.]+\((\d+)d\)', 1), '') as bigint) as day_gap
from market_links where reason like '%dateType=%'
""")
def _(t):
    part = lambda p: F.regexp_extract("reason", p, 1)
    num = lambda p, kind: F.when(part(p) != "", part(p).cast(kind))
    return t.market_links.filter("reason like '%dateType=%'").select("id", part("entity=([A-Z0-9]+)").alias("entity"), num("text=([0-9.]+)", "double").alias("txt"), num(r"date=[0-9.]+\((\d+)d\)", "bigint").alias("day_gap"))


@query("f_version_prefix", "select algo_version, cast(count(*) as bigint) as n from market_links where starts_with(algo_version, 'v3@') group by 1")
def _(t):
    return t.market_links.filter(F.col("algo_version").startswith("v3@")).groupBy("algo_version").agg(F.count("*").alias("n"))


@query("f_upcoming", f"select id, close_time from markets where (close_time >= timestamp '{NOW}' or close_time is null) and (status = 'active' or status is null) order by close_time asc nulls last, id limit 100")
def _(t):
    d = t.markets.filter(((F.col("close_time") >= now()) | F.col("close_time").isNull()) & ((F.col("status") == "active") | F.col("status").isNull()))
    return d.select("id", "close_time").orderBy(F.col("close_time").asc_nulls_last(), "id").limit(100)


@query("f_year_funnel", """
select venue, cast(count(*) as bigint) as n, cast(count(*) filter (where y is null) as bigint) as no_year, cast(count(*) filter (where y < 2026) as bigint) as early,
  cast(count(*) filter (where y > 2026) as bigint) as late, cast(count(*) filter (where y = 2026) as bigint) as kept
from (select venue, coalesce(try_cast(nullif(regexp_extract(title, '(20[0-9][0-9])', 1), '') as int), year(close_time)) as y from markets) group by 1
""")
def _(t):
    told = F.regexp_extract("title", "(20[0-9][0-9])", 1)
    y = F.coalesce(F.when(told != "", told.cast("int")), F.year("close_time"))
    c = lambda x: F.count_if(x)
    return t.markets.select("venue", y.alias("y")).groupBy("venue").agg(
        F.count("*").alias("n"), c(F.col("y").isNull()).alias("no_year"), c(F.col("y") < 2026).alias("early"), c(F.col("y") > 2026).alias("late"), c(F.col("y") == 2026).alias("kept")
    )


@query("f_rare_extension", f"""
with base as (select id, derived_topic from markets where close_time >= timestamp '{NOW}' - interval 24 hour and close_time < timestamp '{NOW}' + interval 24 hour),
gone as (select distinct derived_topic from markets where derived_topic is not null except select derived_topic from base where derived_topic is not null),
more as (select m.id, m.derived_topic from markets m join gone using (derived_topic) where close_time >= timestamp '{NOW}' - interval 168 hour and close_time < timestamp '{NOW}' + interval 168 hour)
select distinct id, derived_topic from (select * from base union all select * from more)
""")
def _(t):
    m = t.markets.select("id", "derived_topic", "close_time")
    within = lambda h: (F.col("close_time") >= now() - F.expr(f"interval {h} hours")) & (F.col("close_time") < now() + F.expr(f"interval {h} hours"))
    base = m.filter(within(24))
    gone = m.filter("derived_topic is not null").select("derived_topic").distinct().join(base.select("derived_topic"), "derived_topic", "left_anti")
    more = m.filter(within(168)).join(gone, "derived_topic", "left_semi")
    return base.unionByName(more.select(*base.columns)).select("id", "derived_topic").distinct()


@query("f_events_nested", "select user_id, event_id, ts from events where try_cast(json_extract_string(props, '$.k') as bigint) >= 90 and event_type = 'purchase'")
def _(t):
    return t.events.filter((F.get_json_object("props", "$.k").cast("bigint") >= 90) & (F.col("event_type") == "purchase")).select("user_id", "event_id", "ts")


@query("s_tickers", r"""
select id, upper(trim(kalshi_event_ticker)) as ticker, nullif(regexp_extract(upper(trim(kalshi_event_ticker)), '^([^-_]*)', 1), '') as prefix, upper(trim(json_extract_string(metadata, '$.eventTicker'))) as from_json,
  coalesce(regexp_matches(upper(kalshi_event_ticker), 'UPDOWN|INTRADAY|15MIN|30MIN|1HR|HOURLY'), false) as intraday
from markets where venue = 'kalshi'
""")
def _(t):
    from tessera.functions.text import is_intraday_ticker, ticker

    c = F.col("kalshi_event_ticker")
    return t.markets.filter("venue = 'kalshi'").select("id", ticker(c).alias("ticker"), ticker_prefix(c).alias("prefix"), json_ticker(F.col("metadata"), "eventTicker", "event_ticker").alias("from_json"), is_intraday_ticker(c).alias("intraday"))


@query("s_key_present", "select has_key, cast(count(*) as bigint) as n from (select list_contains(json_keys(metadata), 'mveCollectionTicker') as has_key from markets) group by 1")
def _(t):
    from tessera.functions.text import has_key

    return t.markets.groupBy(has_key(F.col("metadata"), "mveCollectionTicker").alias("has_key")).agg(F.count("*").alias("n"))




def _tokens_sql(col: str) -> str:
    from tessera.functions.text import STOP_WORDS

    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    base = rf"regexp_replace(regexp_replace(lower({col}), '[^a-z0-9_\s-]', ' ', 'g'), '\bv\.?\s*', 'vs ', 'g')"
    return rf"list_filter(string_split_regex({base}, '\s+'), lambda w: length(w) >= 2 and not list_contains({stop}, w))"


@query("s_tokens", f"select id, array_to_string({_tokens_sql('title')}, ' ') as norm, cast(len({_tokens_sql('title')}) as bigint) as n from markets")
def _(t):
    k = tokenize(F.col("title"))
    return t.markets.select("id", F.array_join(k, " ").alias("norm"), F.size(k).cast("bigint").alias("n"))


@query("s_slug", r"select id, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from markets")
def _(t):
    from tessera.functions.text import slugify

    return t.markets.select("id", slugify(F.col("title")).alias("slug"))


@query("s_titles_read")
def _(t):
    """Kind, subject, threshold, direction and date read from every title."""
    from tessera.functions.signals import read_signals

    return read_signals(t.markets)


def _words_sql(words) -> str:
    return "|".join(words)


def _comparator_sql(title: str = "title") -> str:
    from tessera.functions import text as X

    t = f"lower({title})"
    return (
        f"case when regexp_matches({t}, '{X.BETWEEN.replace(chr(39), chr(39) * 2)}') then 'BETWEEN' when regexp_matches({t}, '{_words_sql(X.AT_LEAST_WORDS)}') then 'GE' "
        f"when regexp_matches({t}, '{_words_sql(X.AT_MOST_WORDS)}') then 'LE' when regexp_matches({t}, '{_words_sql(X.WIN_WORDS)}') then 'WIN' else 'UNKNOWN' end"
    )


@query("s_comparator", f"select id, {_comparator_sql()} as comparator from markets")
def _(t):
    from tessera.functions.text import comparator

    return t.markets.select("id", comparator(F.col("title")).alias("comparator"))


@query("s_numbers", r"""
with t as (select id, regexp_replace(lower(title), '\b(january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sept|sep|october|oct|november|nov|december|dec)\s+[0-9]{1,2}($|[^0-9,.])', ' \2', 'g') as t from markets),
m as (select id, unnest(regexp_extract_all(t, '\$?[0-9][0-9,]*(?:\.[0-9]+)?(?:k|m|b|t|\s*thousand|\s*million|\s*billion|\s*trillion)?(?:\b|\s*%)(?:\s*%)?')) as m from t),
p as (select id, try_cast(replace(regexp_extract(m, '[0-9][0-9,]*(\.[0-9]+)?'), ',', '') as double) as d, regexp_extract(m, '[a-z]+') as u, contains(m, '%') as pct, starts_with(m, '$') as usd from m),
n as (select *, round(d * case when u in ('k', 'thousand') then 1e3 when u in ('m', 'million') then 1e6 when u in ('b', 'billion') then 1e9 when u in ('t', 'trillion') then 1e12 else 1.0 end, 6) as n from p)
select distinct id, n as number from n where pct or (n >= 1 and not (n between 1900 and 2100) and (usd or u <> '' or n > 31))
""")
def _(t):
    """Numbers of every title with their multipliers applied."""
    from tessera.functions.text import numbers

    return t.markets.select("id", F.explode(numbers(F.col("title"))).alias("number"))


_ALIASES = [("rate decision", "RATES"), ("central bank", "RATES"), ("opening weekend", "FILM"), ("box office", "FILM"), ("high temp", "WEATHER"), ("temperature", "WEATHER"), ("jobless rate", "JOBS"), ("unemployment", "JOBS"), ("trade treaty", "TRADE")]


@query("j_alias_lookup", f"""
with w as (select id, list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> '') as t from markets), a(alias, canon) as (values {", ".join(f"('{x}', '{y}')" for x, y in _ALIASES)}),
g as (select id, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))) as alias from w)
select id, string_agg(distinct canon, ',' order by canon) as names from g join a using (alias) group by 1
""")
def _(t):
    from tessera.functions.text import n_grams, words
    from tessera.shared import small

    a = t.spark.createDataFrame(_ALIASES, "alias string, canon string")
    g = t.markets.select("id", F.explode(n_grams(words(F.col("title")), 2)).alias("alias"))
    return g.join(small(a), "alias").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("canon")), ",").alias("names"))
