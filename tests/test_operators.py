"""Selection, quotes, merges, sources and streams against plain sequential versions."""

import json
import random
import urllib.error
from datetime import datetime as D
from datetime import timedelta
from math import floor

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as C
from tessera.functions import text as T
from tessera.operators import blocking as B
from tessera.operators import quotes as Q
from tessera.operators import selection as S
from tessera.operators import upsert as U
from tessera.sources import books, paged

T0 = D(2026, 1, 1)


def plain_greedy(rows, cl, cr, gap, close):
    best, seen = {}, {}
    for l, r, s in rows:
        if None not in (l, r, s) and s == s:
            seen[l, r] = max(s, seen.get((l, r), s))
    nl, nr, out = {}, {}, []
    for (l, r), s in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if nl.get(l, 0) >= cl or nr.get(r, 0) >= cr:
            continue
        if gap and r in best and (best[r] - s > gap if close else best[r] - s < gap):
            continue
        best.setdefault(r, s)
        nl[l], nr[r] = nl.get(l, 0) + 1, nr.get(r, 0) + 1
        out.append((l, r, s))
    return sorted(out)


@pytest.mark.parametrize("gap,close", [(0.0, False), (0.05, False), (0.05, True)])
def test_greedy_in_rounds_equals_one_by_one(spark, gap, close):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.3 else rnd.randint(1, 40), 7 if rnd.random() < 0.3 else rnd.randint(1, 40), rnd.choice([0.5, 0.75, 0.9, round(rnd.random(), 2)])) for _ in range(500)]
    rows += [(None, 1, 0.5), (1, None, 0.5), (1, 1, None), (1, 1, float("nan"))]
    df = spark.createDataFrame(rows, "l long, r long, score double")
    want = plain_greedy(rows, 3, 2, gap, close)
    for finish in (10_000, 40, 0):
        got = S.greedy_capped(df, 3, 2, gap, close, finish=finish)
        assert sorted((r.l, r.r, r.score) for r in got.collect()) == want
    assert S.greedy_capped(df.limit(0), 3, 2).count() == 0


def test_shared_key_cap_equals_one_by_one(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(1, 3), i, rnd.sample("abcde", rnd.randint(1, 3)), rnd.random()) for i in range(80)]
    used, want = {}, []
    for r, i, ks, s in sorted(rows, key=lambda x: (-x[3], x[1])):
        if any(used.get((r, k), 0) < 2 for k in ks):
            want.append(i)
            for k in ks:
                used[r, k] = used.get((r, k), 0) + 1
    df = spark.createDataFrame(rows, "r long, i long, ks array<string>, s double")
    assert sorted(x.i for x in S.shared_key_cap(df, "r", "ks", 2, "i", F.col("s").desc(), F.col("i")).collect()) == sorted(want)


def quotes_of(seed, n=400):
    rnd = random.Random(seed)
    return [(i, rnd.choice([1, 1, 1, 2, 3, None]), T0 + timedelta(seconds=rnd.randint(0, 900)), rnd.choice([0.5, 0.5004, 0.5006, 0.7, None, float("nan")])) for i in range(n)]


def plain_cycle(rows, stored, eps=0.001, gap=60):
    seen, kept = set(), []
    for a, o, ts, p in sorted(rows):
        if None in (o, ts, p) or p != p:
            continue
        sec = (ts - D(1970, 1, 1)).total_seconds()
        key = (o, sec // gap, floor(p / eps + 0.5))
        if key in seen:
            continue
        seen.add(key)
        if o in stored:
            t0, p0 = stored[o]
            if (ts - t0).total_seconds() < gap and floor(p / eps + 0.5) == floor(p0 / eps + 0.5):
                continue
        kept.append((a, o, ts, p))
    new = dict(stored)
    best = {}
    for a, o, ts, p in kept:
        if o not in best or ts > best[o][0]:
            best[o] = (ts, p)
    new.update(best)
    return kept, new


SCHEMA = "arrival long, outcome_id long, ts timestamp_ntz, price double"


def test_quote_cycles_equal_simulation(spark):
    stored, latest = {}, None
    for seed in (3, 4, 5):
        rows = quotes_of(seed)
        got = Q.accepted(spark.createDataFrame(rows, SCHEMA), latest).filter("recorded")
        kept, stored = plain_cycle(rows, stored)
        assert sorted(r.arrival for r in got.collect()) == sorted(a for a, *_ in kept)
        new = Q.latest_quotes(got)
        latest = spark.createDataFrame([tuple(r) for r in (new if latest is None else Q.merge_latest(latest, new)).collect()], "outcome_id long, ts timestamp_ntz, price double")
        assert {r.outcome_id: (r.ts, r.price) for r in latest.collect()} == stored


def test_quote_stream_equals_simulation(spark, tmp_path):
    from tessera.streaming.quotes import ingest

    stored = {}
    for k, seed in enumerate((6, 7)):
        rows = quotes_of(seed, 200)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        _, stored = plain_cycle(rows, stored)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        ingest(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    assert {r.outcome_id: (r.ts, r.price) for r in spark.read.parquet(f"{tmp_path}/store/latest/1").collect()} == stored


def test_stateful_stream(spark, tmp_path):
    from tessera.streaming.quotes import dedup_stateful

    rows = [(1, 1, T0, 0.5), (2, 1, T0 + timedelta(seconds=59), 0.5), (3, 1, T0 + timedelta(seconds=60), 0.5), (4, 1, T0 + timedelta(seconds=61), 0.5006), (5, None, T0, 0.5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = dedup_stateful(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("dedup").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.arrival for r in spark.table("dedup").collect()) == [1, 3, 4]


def test_merge_changes(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (None, "n", 0)], "id long, x string, keep long")
    b = spark.createDataFrame([(2, "b", 9), (3, "c", 9), (4, "d", 9)], "id long, x string, keep long")
    got = {(r.id, r.x, r.keep, r.change) for r in U.merge(a, b, ["id"], keep=["keep"]).collect()}
    assert got == {(1, "a", 1, "untouched"), (2, "b", 2, "unchanged"), (3, "c", 3, "updated"), (4, "d", 9, "created"), (None, "n", 0, "untouched")}
    assert {(r.id, r.side) for r in U.diff(a.filter("id is not null"), b, "id").collect()} == {(1, "left"), (4, "right")}


def test_blocking(spark):
    l = spark.createDataFrame([(1, ["bitcoin", "price"]), (2, ["price", "to"]), (3, []), (4, None)], "id long, t array<string>")
    r = spark.createDataFrame([(10, ["bitcoin", "price", "bitcoin"]), (11, ["to"]), (12, ["price"])], "id long, t array<string>")
    pairs = {(x.l, x.r, x.n_keys) for x in B.token_pairs(l, r, "t").collect()}
    assert pairs == {(1, 10, 2), (2, 10, 1), (1, 12, 1), (2, 12, 1)}
    both = B.with_fallback(B.token_pairs(l, r, "t", least=2), l, spark.createDataFrame([(1, 12), (3, 11)], "l long, r long"))
    assert {(x.l, x.r) for x in both.collect()} == {(1, 10), (3, 11)}
    row = spark.createDataFrame([(D(2026, 2, 28).date(),)], "d date").select(B.near_days(F.col("d")).alias("a"), B.near_months(F.col("d")).alias("m"), B.period_keys(F.col("d"), F.lit("quarter")).alias("q")).first()
    assert [x.day for x in row.a] == [27, 28, 1] and row.m == [24313, 24314, 24315] and row.q == ["2026-Q1", "2026", "2026-01", "2026-02", "2026-03"]


def test_scalars(spark):
    c = F.col
    rows = [(0.5, "Will the Lakers v. Celtics game be on?", " kxbtc-26JAN23 "), (float("nan"), None, ""), (1.06, "", None), (-0.1, "a - b", "A_B")]
    got = spark.createDataFrame(rows, "s double, t string, k string").select(C.clamp(c("s")).alias("s"), T.normalize_title(c("t")).alias("n"), T.slugify(c("t")).alias("g"), T.ticker(c("k")).alias("k"), T.ticker_prefix(c("k")).alias("p"), T.is_dated_ticker(c("k")).alias("d")).collect()
    assert [r.s for r in got] == [0.5, 0.0, 1.0, 0.0]
    assert got[0].n == "lakers vs celtics game" and got[1].n is None and got[2].n == ""
    assert [r.k for r in got] == ["KXBTC-26JAN23", None, None, "A_B"] and [r.p for r in got] == ["KXBTC", None, None, "A"] and got[0].d
    assert spark.range(1).select(C.from_epoch(F.lit(1_700_000_000)).cast("long").alias("a"), C.from_epoch(F.lit(1_700_000_000_000)).cast("long").alias("b")).first() == (1_700_000_000, 1_700_000_000)
    assert spark.range(1).select(C.price_bucket(F.lit(-0.0005), 0.001).alias("a")).first().a == 0


def test_retry():
    calls, naps = [], []

    def call():
        calls.append(1)
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 503, "", None, None)
        if len(calls) == 2:
            raise urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None)
        if len(calls) == 3:
            raise ConnectionError
        return b"ok"

    assert paged.with_retry(call, sleep=naps.append, rnd=random.Random(1)) == b"ok"
    assert 1 <= naps[0] <= 1.25 and naps[1] == 7 and 4 <= naps[2] <= 5

    def gone():
        raise urllib.error.HTTPError("u", 404, "", None, None)

    with pytest.raises(urllib.error.HTTPError):
        paged.with_retry(gone, sleep=naps.append)


def test_paged_source_and_stream(spark, tmp_path):
    paged.register(spark)
    for k in range(3):
        body = {"items": [{"n": 4 * k + i} for i in range(4 if k < 2 else 2)], "cursor": f"c{k + 1}" if k < 2 else None}
        for name in (str(4 * k), "first" if not k else f"c{k}"):
            (tmp_path / f"{name}.json").write_text(json.dumps(body))
    n = F.get_json_object("item", "$.n").cast("int")
    for paging in ("offset", "cursor"):
        df = spark.read.format("paged").option("url", f"file:{tmp_path}").option("paging", paging).option("size", 4).option("pages", 6).load()
        assert sorted(r.n for r in df.select(n.alias("n")).collect()) == list(range(10))


def test_catalogue_books_and_seed(spark):
    item = json.dumps({"ticker": "S", "category": "c", "events": [{"ticker": "E", "title": "t", "markets": [{"ticker": "M1", "title": "a"}, {"ticker": "M1", "title": "b"}, {"ticker": None}]}]})
    got = paged.nested(spark.createDataFrame([(item,), ("{}",), (None,)], "item string")).collect()
    assert [(r.ticker, r.series, r.event, r.title) for r in got] == [("M1", "S", "E", "a")]
    b = "array<struct<price:double,size:double>>"
    rows = [("x", [(0.4, 10.0), (0.3, 5.0)], [(0.6, 2.0)]), ("y", [], [(0.7, None)]), ("z", None, None)]
    q = books.book_quotes(spark.createDataFrame(rows, f"token string, bids {b}, asks {b}")).collect()
    assert sorted((r.token, r.price, r.liquidity) for r in q) == [("x", 0.5, 12.0), ("y", 0.7, 0.0)]
    walk = books.seed_quotes(spark, 3, 50, step=0.4).collect()
    assert len(walk) == 150 and all(0.01 <= r.price <= 0.99 for r in walk)
    assert walk == books.seed_quotes(spark, 3, 50, step=0.4).collect()


def test_pipeline_registry_and_store(spark):
    from tessera.plans import pipeline as P
    from tessera.queries.tables import simple

    p = P.register(simple())
    assert P.pipeline(" simple ") is p
    with pytest.raises(KeyError):
        P.pipeline("none")
    links = spark.createDataFrame([(1, 2, "confirmed", 0.9), (1, 3, "rejected", 0.2)], "left_market_id long, right_market_id long, status string, score double")
    found = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.6), (4, 5, 0.7)], "l long, r long, score double")
    got = {(r.left_market_id, r.right_market_id, r.status, r.score) for r in P.store(links, found).collect()}
    assert got == {(1, 2, "confirmed", 0.9), (1, 3, "suggested", 0.6), (4, 5, "suggested", 0.7)}


def test_runs_and_health(spark, tmp_path):
    from tessera.operators import runs as R

    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", 1, at(0), "start", None, None), ("a", 1, at(1), "done", "c1", None), ("a", 2, at(50), "start", None, None), ("a", 2, at(51), "done", "c2", None)]
    rows += [("b", k, at(k), "start", None, None) for k in range(6)] + [("b", 0, at(0), "done", "x", None)] + [("b", k, at(k + 1), "failed", None, "e") for k in range(1, 6)]
    rows += [("c", 1, at(0), "start", None, None), ("d", 1, at(-200), "start", None, None), ("d", 1, at(-199), "done", None, None), (None, None, None, None, None, None)]
    R.log(spark, f"{tmp_path}/log", rows[:5])
    R.log(spark, f"{tmp_path}/log", rows[5:])
    events = spark.read.parquet(f"{tmp_path}/log")
    now = F.lit(at(60))
    assert {r.job: (r.verdict, r.failed_runs) for r in R.health(events, now).collect()} == {"a": ("OK", 0), "b": ("FAILING", 5), "c": ("STUCK", 0), "d": ("STALE", 0)}
    assert {r.job: r.cursor for r in R.resume_from(events).collect()} == {"a": "c2", "b": "x", "d": None}


def test_wide_scans_read_only_what_they_need(spark):
    import os

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    plan = entry.queries()["q_latest"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in plan and "liquidity" not in plan and "WindowGroupLimit" in plan
    plan = entry.queries()["f_keyset_page"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(id,100)" in plan and "metadata" not in plan


def test_greedy_drops_refused_pairs_together(spark):
    """A hot left row whose right rows all have a better pair that the gap rule protects loses its pairs in one round."""
    rows = [(0, r, 0.895) for r in range(300)] + [(1 + r, r, 0.9) for r in range(300)]
    df = spark.createDataFrame(rows, "l long, r long, score double")
    got = sorted((x.l, x.r, x.score) for x in S.greedy_capped(df, 3, 2, 0.02, finish=0).collect())
    assert got == plain_greedy(rows, 3, 2, 0.02, False) == [(1 + r, r, 0.9) for r in range(300)]


def test_gaps_brackets_and_caps_equal_windows(spark):
    from pyspark.sql.window import Window

    rnd = random.Random(8)
    rows = [(1 if rnd.random() < 0.5 else rnd.randint(2, 9), i, rnd.choice([0.5, 0.7, 0.72, 0.9]), rnd.choice("ab")) for i in range(120)]
    df = spark.createDataFrame(rows, "l long, r long, score double, k string").withColumn("extra", F.lit("e"))
    by = {}
    for l, r, s, _ in sorted(rows, key=lambda x: (-x[2], x[1])):
        by.setdefault(l, []).append((s, r))
    won = lambda o: len(o) > 1 and o[0][0] - o[1][0] >= 0.1
    assert sorted(x.r for x in S.winner_only(df, 0.1).collect()) == sorted(r for o in by.values() for s, r in (o[:1] if won(o) else o))
    assert sorted(x.r for x in S.keep_close(df, 0.1).collect()) == sorted(r for o in by.values() for s, r in o if s == o[0][0] or o[0][0] - s < 0.1)
    assert S.keep_close(df, 0.1).columns == S.winner_only(df, 0.1).columns == df.columns
    n = F.row_number().over(Window.partitionBy("l").orderBy(F.col("_m").desc(), "_t", "k"))
    g = df.groupBy("l", "k").agg(F.max("score").alias("_m"), F.min_by("r", F.struct(-F.col("score"), "r")).alias("_t")).withColumn("b", n)
    want = {(x.l, x.k, x.b) for x in g.collect()}
    got = S.brackets(df, "l", "k", "score", "r", 2, 3).collect()
    assert {(x.l, x.k, x.bracket) for x in got} == want and max(x.line for x in got) == 3


def test_store_keeps_what_finding_does_not_name(spark):
    from tessera.plans.pipeline import store

    links = spark.createDataFrame([(1, 2, "confirmed", 0.9, "T", "a"), (3, 4, "suggested", 0.5, "U", "b"), (5, 6, "rejected", 0.1, None, "c")], "left_market_id long, right_market_id long, status string, score double, topic string, left_title string")
    found = spark.createDataFrame([(1, 2, 0.3), (3, 4, 0.7), (7, 8, 0.6)], "l long, r long, score double")
    got = {(x.left_market_id, x.status, x.score, x.topic, x.left_title, x.change) for x in store(links, found).collect()}
    assert got == {(1, "confirmed", 0.9, "T", "a", "unchanged"), (3, "suggested", 0.7, "U", "b", "updated"), (5, "rejected", 0.1, None, "c", "untouched"), (7, "suggested", 0.6, None, None, "created")}
    part = U.merge(links, spark.createDataFrame([(1, 2, "x")], "left_market_id long, right_market_id long, topic string"), ["left_market_id", "right_market_id"])
    assert {(x.left_market_id, x.status, x.topic) for x in part.collect()} == {(1, "confirmed", "x"), (3, "suggested", "U"), (5, "rejected", None)}


@pytest.mark.parametrize("paging", ["offset", "cursor"])
def test_paged_stream_delivers_the_last_page_and_what_is_added(spark, tmp_path, paging):
    paged.register(spark)
    items = [{"n": i} for i in range(10)]

    def write(items):
        for k in range(0, len(items), 4):
            page = {"items": items[k : k + 4], "cursor": f"c{k + 4}" if k + 4 < len(items) else None}
            name = str(k) if paging == "offset" else "first" if k == 0 else f"c{k}"
            (tmp_path / f"{name}.json").write_text(json.dumps(page))

    write(items)
    options = {"url": f"file:{tmp_path}", "paging": paging, "size": "4"}
    got = [r.item for r in spark.read.format("paged").options(**options, parallel="2").load().collect()]
    assert sorted(json.loads(x)["n"] for x in got) == list(range(10))
    stream = paged._Stream(options)
    at, seen, steps = stream.initialOffset(), [], []
    for _ in range(6):
        rows, end = stream.read(at)
        rows = list(rows)
        assert list(stream.readBetweenOffsets(at, end)) == rows
        seen, at = seen + rows, end
        steps.append(len(rows))
    assert [json.loads(r[2])["n"] for r in seen] == list(range(10)) and steps == [4, 4, 2, 0, 0, 0]
    write([{"n": i} for i in range(13)])  # the last page fills up, and another follows
    for _ in range(4):
        rows, at = stream.read(at)
        seen += list(rows)
    assert [json.loads(r[2])["n"] for r in seen] == list(range(13))
    assert [json.loads(r[2])["n"] for r in stream.readBetweenOffsets(stream.initialOffset(), at)] == list(range(13))
    q = spark.readStream.format("paged").options(**options).load().writeStream.format("memory").queryName(f"paged_{paging}").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        q.processAllAvailable()
        assert spark.table(f"paged_{paging}").count() == 13
    finally:
        q.stop()


def test_catalogue_without_page_limit(spark):
    paged.register(spark)
    url = "data:" + json.dumps([{"n": i} for i in range(2503)])
    for paging in ("offset", "cursor"):
        assert spark.read.format("paged").option("url", url).option("paging", paging).option("size", 2).load().count() == 2503
    assert spark.read.format("paged").option("url", "data:[]").load().count() == 0
    assert spark.read.format("paged").option("url", url).option("size", 2).option("pages", 3).load().count() == 6


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from tessera.shared import shared_dir

    conf = N(get=lambda *a: None)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(N(conf=conf, sparkContext=N(master=master, getConf=lambda: conf)))


def test_scratch_tables_can_be_cleaned(spark):
    from pathlib import Path

    from tessera.shared import Scratch, small

    before = len(Scratch._roots)
    a = Scratch(spark, "x").write(spark.range(3))
    b = small(spark.range(5))
    assert b.count() == 5 and a.count() == 3 and len(Scratch._roots) == before + 2
    paths = [Path(root.removeprefix("file://")) for _, root in Scratch._roots[before:]]
    assert all(p.exists() for p in paths)
    Scratch.clean(spark)
    assert not any(p.exists() for p in paths) and not Scratch._roots
