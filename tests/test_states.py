"""Decisions, archiving, mapping of catalogue items, chunked writing, cursors and pairing, against plain versions."""

import json
import random
from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from tessera.functions import scores as C
from tessera.operators import runs, states
from tessera.operators.chunks import write_in_chunks
from tessera.sources import mapping

T0 = D(2026, 1, 1)


def test_decisions_are_idempotent_and_keep_other_columns(spark):
    links = spark.createDataFrame([(1, "suggested", None, "x"), (2, "confirmed", "r", "y"), (3, "rejected", "old", "z"), (None, "suggested", None, "n")], "id long, status string, reason string, decided_at string")
    d = spark.createDataFrame([(1, "confirmed", "r", 1), (1, "rejected", "q", 2), (2, "confirmed", "r", 1), (9, "confirmed", "r", 1), (3, None, "r", 1), (None, "confirmed", "r", 1)], "id long, status string, reason string, decided_at int")
    once = states.decide(links, d)
    key = lambda r: str(r)
    assert sorted(map(tuple, once.collect()), key=key) == sorted([(1, "rejected", "q", "x", True), (2, "confirmed", "r", "y", False), (3, "rejected", "old", "z", False), (None, "suggested", None, "n", False)], key=key)
    assert states.decide(once.drop("changed"), d).filter("changed").isEmpty() and states.decide(links.limit(0), d).isEmpty()
    back = {r.id: (r.status, r.reason, r.changed) for r in states.roll_back(once.drop("changed"), F.col("reason").isin("q", "r")).collect()}
    assert back == {1: ("suggested", None, True), 2: ("suggested", None, True), 3: ("rejected", "old", False), None: ("suggested", None, False)}


def test_archive(spark):
    days = lambda n: T0 - timedelta(days=n)
    rows = [(1, "resolved", days(31), None), (2, "resolved", days(30), None), (3, "closed", days(99), days(15)), (4, "closed", days(99), None), (5, "active", days(99), days(99)), (6, None, None, None), (7, "archived", days(99), days(99))]
    got = states.archive(spark.createDataFrame(rows, "id long, status string, updated_at timestamp_ntz, close_time timestamp_ntz"), F.lit(T0).cast("timestamp_ntz"))
    assert {r.id: r.status for r in got.collect()} == {1: "archived", 2: "resolved", 3: "archived", 4: "closed", 5: "active", 6: None, 7: "archived"}
    assert sorted(r.id for r in got.filter("changed").collect()) == [1, 3]


def test_items_of_every_shape(spark):
    flagged = [
        {"id": 7, "question": "Q", "active": True, "closed": False, "outcomes": '["Yes","No"]', "outcomePrices": ["0.4"], "clobTokenIds": '["a","b"]', "endDate": "2026-01-02T03:04:05", "categories": [{"slug": "", "label": "L"}, {"slug": "", "label": ""}]},
        {"id": "8", "active": False, "closed": True, "outcomes": "not a list", "endDate": "soon", "category": "", "groupItemTitle": "g"},
        {"id": "9", "active": True, "closed": True, "outcomes": ["Maybe"]}, {"id": "10"}, {"question": "without id"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in flagged] + [("no json",), (None,)], "item string")
    got = {r.external_id: r for r in mapping.map_flagged(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"7": "active", "8": "resolved", "9": "closed", "10": "closed"}
    assert [tuple(o) for o in got["7"].outcomes] == [("Yes", "yes", "a", 0.4), ("No", "no", "b", None)] and got["7"].close_time == D(2026, 1, 2, 3, 4, 5) and got["7"].categories == ["L"]
    assert got["8"].outcomes == [] and got["8"].close_time is None and got["8"].category == "g" and got["9"].outcomes[0].side == "other"
    listed = [{"ticker": "A", "title": "T", "subtitle": "s", "status": "settled", "event_ticker": "E", "yes_bid": 40, "no_ask": "x"}, {"ticker": "B", "title": "T", "status": "unopened", "category": "c"}, {"title": "none"}]
    got = {r.external_id: r for r in mapping.map_listed(spark.createDataFrame([(json.dumps(x),) for x in listed], "item string")).collect()}
    assert (got["A"].title, got["A"].status, got["A"].category, got["A"].outcomes[0].bid, got["A"].outcomes[1].ask) == ("T - s", "resolved", "E", 40.0, None)
    assert (got["B"].title, got["B"].status, got["B"].category) == ("T", "active", "c") and set(got) == {"A", "B"}


def test_numbers_are_paired_once_and_in_order(spark):
    rnd = random.Random(3)
    one = lambda: [rnd.choice([0.0, 100.0, 100.5, 101.0, 99.5, 250.0, -3.0, None]) for _ in range(rnd.randint(0, 6))]
    rows = [(i, one(), one()) for i in range(200)] + [(999, None, [1.0])]

    def plain(a, b):
        used = set()
        for x in a:
            for i, y in enumerate(b):
                if i not in used and x is not None and y is not None and (x == y or (max(abs(x), abs(y)) and abs(x - y) / max(abs(x), abs(y)) <= 0.01)):
                    used.add(i)
                    break
        return len(used)

    got = {r.i: r.n for r in spark.createDataFrame(rows, "i long, a array<double>, b array<double>").select("i", C.pair_numbers(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got.pop(999) is None and got == {i: plain(a, b) for i, a, b in rows[:-1]}


def test_factors_and_weights(spark):
    c = lambda f, *x: spark.range(1).select(f(*[F.lit(v) for v in x]).alias("v")).first().v
    assert [c(C.comparator_factor, *x) for x in (("GE", "GE"), ("GE", "LE"), ("LE", None), ("WIN", "GE"), ("BETWEEN", "LE"), ("EXACT", "GE"), ("EXACT", "BETWEEN"))] == [1.0, 0.0, 0.95, 0.9, 0.7, 0.5, 0.8]
    kinds = lambda a, b: C.type_factor(a, b, [("SPREAD", "TOTAL")])
    assert [c(kinds, *x) for x in (("X", "X"), (None, "X"), ("TOTAL", "SPREAD"), ("X", "TOTAL"))] == [1.0, 0.9, 0.8, 0.3]
    assert [c(C.period_weight, *x) for x in (("month", "month"), ("quarter", "month"), ("quarter", "year"), ("year", "month"))] == [1.0, 0.6, 0.55, 0.45]
    day = lambda a, b, p, q, s: c(C.date_gate, a and a.date(), b and b.date(), p, q, s)
    assert day(T0, T0 + timedelta(days=2), "day", "day", "day") and not day(T0, T0 + timedelta(days=3), "day", "day", "day") and not day(T0, T0, "day", "month", "day")
    assert day(T0, T0 + timedelta(days=30), "month", "day", "month") and not day(T0, D(2025, 1, 1), "month", "month", "month") and day(T0, T0 + timedelta(days=900), "day", "day", "")


def test_chunks_shrink_and_nothing_is_unaccounted_for(spark, tmp_path):
    def write(chunk):
        if len(chunk) > 16:
            raise MemoryError("too large")
        if (chunk["id"] == 77).any():
            raise ValueError("bad row")
        for i in chunk["id"]:
            (tmp_path / f"out-{i}").write_text("x")

    rows = spark.range(200).repartition(2)
    got = write_in_chunks(rows, write, size=100, least=4, pause=0.0).collect()
    assert sum(r["items"] for r in got) == 200 and all(r["written"] + r["skipped"] == r["items"] for r in got)
    assert sum(r["skipped"] for r in got) == 4 and [e for r in got for e in r["errors"]] == ["bad row"] and all(r["reductions"] >= 3 for r in got)
    assert len(list(tmp_path.glob("out-*"))) == 196 and not (tmp_path / "out-77").exists()
    fatal = write_in_chunks(spark.range(10).coalesce(1), write, size=100, least=4, may_pass=lambda e: False, pause=0.0).collect()
    assert [(r["written"], r["skipped"], r["retries"]) for r in fatal] == [(10, 0, 0)]
    empty = write_in_chunks(spark.range(0), write).collect()
    assert sum(r["items"] for r in empty) == 0


def test_stuck_cursors_and_turns(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = []
    for job, cursors in (("a", ["x", "x", "x"]), ("b", ["x", "y", "x"]), ("c", ["x", "x"]), ("d", ["x", "x", "x"]), ("e", [None, None, None])):
        for k, cur in enumerate(cursors):
            rows += [(job, k, at(10 * k), "start", None, None), (job, k, at(10 * k + 1), "done", cur, None)]
    events = spark.createDataFrame(rows, runs.SCHEMA)
    fetched = spark.createDataFrame([(j, k, 1 if (j, k) == ("d", 1) else 0) for j in "abcde" for k in range(3)], "job string, run long, n long")
    assert [tuple(r) for r in runs.stuck_cursors(events, fetched).collect()] == [("a", "x")]
    df = spark.createDataFrame([(i,) for i in range(1, 8)] + [(None,)], "id long")
    seen, after = [], None
    for _ in range(3):
        page, after = runs.next_turn(df, "id", after, 3)
        seen.append([r.id for r in page.collect()])
    assert seen == [[1, 2, 3], [4, 5, 6], [7]] and after is None
    assert runs.next_turn(df.limit(0), "id", 5, 3)[1] is None
