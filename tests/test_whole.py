"""Nothing is left out: pipelines and joins against plain versions over all pairs."""

import random
from datetime import datetime as D

from pyspark.sql import functions as F

from tessera.operators import blocking as B
from tessera.plans.pipeline import run, scored
from tessera.queries.tables import simple

T0 = D(2026, 1, 1)


def test_no_candidate_is_dropped_before_it_is_scored(spark):
    cols = "id long, venue string, close_time timestamp_ntz, category string, tok array<string>"
    counted = lambda rows: spark.createDataFrame(rows, cols).withColumn("n", F.size("tok"))
    l = counted([(1, "kalshi", T0, "x", ["senate", "election", "zulek"])])
    r = [(k, "polymarket", T0, "x", ["senate", "election", f"w{k}"]) for k in range(100, 350)] + [(900, "polymarket", T0, "x", ["zulek", "race"])]
    r = counted(r)
    got = {x.r: x.score for x in scored(simple(), l, r).collect()}
    assert set(got) == {*range(100, 350), 900} and got[900] == 0.475
    r = r.filter("id < 200").unionByName(counted([(901, "polymarket", T0, "x", ["senate", "election", "zulek"])]))
    assert 901 in {x.r for x in run(simple(), l, r).collect()}


def test_meeting_in_slices_finds_every_pair_once_a_key(spark):
    rnd = random.Random(4)
    rows = lambda: [(i, rnd.sample(["hot", "a", "b", "c", None], rnd.randint(0, 3)) + ["hot"] * (i % 2)) for i in range(60)]
    x, y = [(i, sorted(set(k), key=str)) for i, k in rows()], [(i, sorted(set(k), key=str)) for i, k in rows()]
    want = sorted((i, j, k) for i, a in x for j, b in y for k in set(a) & set(b) if k)
    a, b = spark.createDataFrame(x, "l long, lk array<string>"), spark.createDataFrame(y, "r long, rk array<string>")
    for most in (10_000_000, 50):
        assert sorted((p.l, p.r, p._k) for p in B.meet(a, b, "lk", "rk", most).collect()) == want


SIGNALS = (
    "id long, venue string, kind string, close_time timestamp_ntz, category string, tok array<string>, name string, name2 string, names array<string>, "
    "threshold double, direction string, detail string, hour int, day date, month int, year int"
)


def listing(i, venue, kind, day, detail="", threshold=5.0):
    return (i, venue, kind, day, "c", ["zulek"], "zulek", "morav", ["zulek", "morav"], threshold, "up", detail, 6, day.date(), day.year * 12 + day.month, day.year)


def test_a_topic_compares_all_listings_of_a_name(spark):
    from tessera.plans.topics import TOPICS

    topics = {t.name: t for t in TOPICS}
    pair = lambda kind, days, **k: (
        spark.createDataFrame([listing(1, "kalshi", kind, D(2026, 1, 31), **k)], SIGNALS),
        spark.createDataFrame([listing(100 + i, "polymarket", kind, d, **k) for i, d in enumerate(days)], SIGNALS),
    )
    found = lambda name, *sides: {x.r for x in scored(topics[name].pipeline(), *sides).collect()}
    far, same, reach = D(2026, 6, 1), D(2026, 1, 31), [D(2026, 1, 23), D(2026, 1, 24), D(2026, 2, 7), D(2026, 2, 8)]
    assert found("FINANCE", *pair("index", [far] * 250 + [same, *reach])) == {350, 352, 353}
    assert found("UNIVERSAL", *pair("index", [same] * 250)) == set(range(100, 350))
    assert found("CLIMATE", *pair("weather", [D(2026, 1, 29), D(2026, 1, 30), same, D(2026, 2, 1), D(2026, 2, 2)])) == {101, 102, 103}
    assert found("SPORTS", *pair("game", [D(2026, 1, 29), D(2026, 1, 30), same, D(2026, 2, 1)])) == {101, 102, 103}
    assert found("COMMODITIES", *pair("goods", [D(2025, 11, 30), D(2025, 12, 31), D(2026, 2, 1), D(2026, 3, 1)], detail="oil")) == {101, 102}
    assert found("ELECTIONS", *pair("election", [far] * 250 + [same], detail="senate")) == set(range(100, 351))


def test_frequent_tokens_are_keys_too(spark):
    rnd = random.Random(5)
    rows = lambda: [(i, ["otters", *rnd.sample(["ab", "abc", "rooks", "trade"], rnd.randint(0, 3))] if i % 4 else ["ab"]) for i in range(80)]
    x, y = rows(), rows()
    shared = lambda a, b: sum(len(k) >= 3 for k in set(a) & set(b))
    sides = [spark.createDataFrame(s, "id long, w array<string>") for s in (x, y)]
    for least in (1, 2):
        want = sorted((i, j, n) for i, a in x for j, b in y if (n := shared(a, b)) >= least)
        assert sorted(map(tuple, B.token_pairs(*sides, "w", least).collect())) == want


def test_token_index_over_all_listings(spark, tmp_path):
    import __spark_entry__ as entry

    cols = "id long, venue string, title string, close_time timestamp_ntz"
    rows = [(k, "kalshi", f"Otters beat x{k}", T0 if k % 2 else None) for k in range(50)] + [(100 + k, "polymarket", f"Otters lose y{k}", T0) for k in range(50)]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/markets.parquet")
    assert entry.queries()["j_token_index"](spark, str(tmp_path)).count() == 2500


def test_queries_cover_every_topic_and_status(spark, tmp_path):
    import __spark_entry__ as entry

    cols = "id long, venue string, title string, category string, status string, derived_topic string, close_time timestamp_ntz, created_at timestamp_ntz"
    listings = [(None, "active"), ("SPORTS", "closed"), ("ELECTIONS", "resolved"), ("MACRO", "archived")]
    rows = [(10 * k + v, venue, f"Vodular at Miletar{k} winner? 31-Jan-26" if v else f"Miletar{k} Otters vs. Vodular Rooks, January 31st, 2026", f"c{k}", status, topic, T0, T0) for k, (topic, status) in enumerate(listings) for v, venue in enumerate(("polymarket", "kalshi"))]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/markets.parquet")
    own = {(10 * k + 1, 10 * k) for k in range(4)}
    for name in ("e_scored", "e_pipeline", "j_candidate_cap", "j_typed_keys", "j_entity_names"):
        assert own <= {(p.l, p.r) for p in entry.queries()[name](spark, str(tmp_path)).collect()}, name
    spark.createDataFrame([(1, "kalshi", "Wheat Morav above $5", "c", "active", None, None, T0), (2, "polymarket", "Will Morav wheat settle above $5?", "c", "active", None, None, T0)], cols).write.parquet(f"{tmp_path}/undated/markets.parquet")
    assert [(p.l, p.r) for p in entry.queries()["j_entity_names"](spark, f"{tmp_path}/undated").collect()] == [(1, 2)]
