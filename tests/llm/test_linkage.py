"""Titles are read alike in both venues' words, and the label model learns from votes alone."""

from datetime import datetime as D

import numpy as np
import pytest

from tessera.llm.linkage import LabelModel, link
from tessera.functions.titles import fold, parse, skeleton

SAME = [
    ("Max temperature Gulugir 2025-08-26: >= 38 degrees", "Will it reach 38°C in Gülugir on August 26th?"),
    ("crude (Cilevath) at most $54.2k, Oct 27, 2025", "Will Cilevath crude settle below $54,200 on 27 October 2025?"),
    ("Rukocon price 5/31/26 - $140k or below", "Rukocon under 140000 USD on May 31?"),
    ("Zulekar (ZLKR) up or down, hour 06, 4-Mar-26", "Zulekar Up or Down - March 4, 2026, 06:00 UTC"),
    ("Who wins the 2027 Tobasur senate vote? - O. Rogizast", "Oskend Rogizast to win 2027 Tobasur senate election?"),
    ("Box office: Nofubuth, weekend of 10/7/25, $83m+", 'Will "Nofubuth" gross over $83 million in its opening weekend of Oct 7, 2025?'),
    ("Vufirur40 close Apr 1, 2026 - below 32k", "Will the Vufirur 40 close below 32,000 on April 1st?"),
    ("Pufocor-Dekefuth trade agreement by 2025-12-31", "Will Dekefuth &amp; Pufocor sign a trade deal before Dec 31?"),
    ("Jobless rate Minocin: Mar 2026 reading lower than 2.7%", "Minocin unemployment below 2.7 percent in March 2026?"),
    ("CPI Vutefol: May-26 reading higher than 5.7%", "Will Vutefol annual inflation exceed 5.7% in May 2026?"),
    ("2026-10 rate decision Momaden: 50bp increase", "Will the Bank of Momaden raise rates by 50 bps in October 2026?"),
    ("Vodular at Miletar winner? 31-Jan-26", "Miletar Otters vs. Vodular Rooks, January 31st"),
]
CLOSE = D(2026, 1, 10)


@pytest.mark.parametrize("a,b", SAME)
def test_titles_read_alike(a, b):
    near = {"August 26th": D(2025, 8, 27), "Dec 31": D(2026, 1, 1), "May 31": D(2026, 6, 1), "April 1st": D(2026, 4, 1), "January 31st": D(2026, 2, 1)}
    near = next((close for k, close in near.items() if k in b), CLOSE)
    x, y = parse(a, near), parse(b, near)
    first = lambda p: [n[:1] if len(n) == 1 else n for n in p["names"]]
    if x["kind"] == "election":
        assert x["names"][:2] == y["names"][:2] and x["names"][2][0] == y["names"][2][0]
    elif x["kind"] == "intraday":
        assert x["names"][0] == y["names"][0]
    else:
        assert first(x) == first(y)
    assert {k: v for k, v in x.items() if k != "names"} == {k: v for k, v in y.items() if k != "names"}


def test_odd_titles():
    for t in (None, "", "   ", "?", "12345", "a the of"):
        assert parse(t) is None
    assert parse("x" * 5000 + " above $5")["threshold"] == 5
    assert fold("  Tavünund – “X” ") == "tavunund - x" and skeleton("velllonin") == "vln"


def test_label_model_finds_matches():
    """Pairs that differ in one respect agree in the rest by more than chance, which voters taken as independent would call a match."""
    rnd = np.random.default_rng(1)
    n = 20_000
    kind = rnd.choice(4, n, p=[0.3, 0.3, 0.2, 0.2])  # matches, and pairs that differ in the first, second or third respect
    says_no = np.array([[0.01, 0.01, 0.01, 0.005], [0.97, 0.1, 0.2, 0.6], [0.2, 0.98, 0.1, 0.5], [0.1, 0.3, 0.97, 0.4]])
    votes = np.where(rnd.random((n, 4)) < says_no[kind], 0, 2)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter: no new evidence
    votes[rnd.random((n, 5)) < 0.1] = 1
    pats, inv, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = LabelModel(5, errors=0.02).fit(pats, counts.astype(float))
    assert any({0, 4} <= set(f) for f in m.factors)
    post = m.posterior(votes)
    clear = (votes != 1).sum(1) >= 4
    assert (((post > 0.5) == (kind == 0))[clear]).mean() > 0.95
    # one vote decides: all yes is a match, and the same with a no is none
    assert m.posterior(np.array([[2, 2, 2, 2, 2], [2, 0, 2, 2, 2], [2, 2, 0, 2, 2]])).round().tolist() == [1, 0, 0]
    assert LabelModel(3).fit(np.zeros((0, 3), int), np.zeros(0)).posterior(np.array([[2, 2, 2], [0, 0, 1]])).round().tolist() == [1, 0]
    assert m.posterior(np.zeros((0, 5), int)).tolist() == []


def test_link(spark):
    rows, want = [], set()
    for i, (a, b) in enumerate(SAME):
        for j, close in enumerate((D(2025, 10, 1), None)):
            if j == 0:
                rows += [(2 * i + 1, "kalshi", a, "Sports", None), (2 * i + 2, "polymarket", b, None, None)]
    # explicit dates only, so that nothing depends on close times
    full = [r for r in rows if r[0] not in (2, 6, 14, 16, 24)]
    want = {(a, a + 1) for a in range(1, 24, 2) if (a + 1) not in (2, 6, 14, 16, 24)}
    extra = [
        (100, "kalshi", "Box office: Nofbuuth, weekend of 10/7/25, $83m+", "Entertainment", None),
        (101, "polymarket", "Bolagol above $55 on Oct 7, 2025?", "Crypto", None),
        (102, "kalshi", "BLGL at or above $55", "Financials", D(2025, 10, 8, 3)),
        (103, "kalshi", "Bolagol price Oct 7, 2025 - $55.5 or above", "Financials", None),
        (104, "kalshi", "Bolagol price Oct 7, 2025 - $55 or below", "Financials", None),
        (105, "kalshi", None, None, None),
        (None, "kalshi", "Bolagol price Oct 7, 2025 - $55 or above", None, None),
        (101, "polymarket", "Bolagol above $55 on Oct 7, 2025?", "Crypto", None),
    ]
    want |= {(12, 100), (101, 102)}
    df = spark.createDataFrame(full + extra, "id long, venue string, title string, category string, close_time timestamp_ntz")
    from pyspark.sql import functions as F

    df = df.withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("kind", F.lit("x")).withColumn("a", F.lit(1))
    got = {(r.market_id_a, r.market_id_b) for r in link(df).pairs.filter("confidence >= 0.5").collect()}
    assert got == want
    assert link(df.limit(0)).pairs.count() == 0


def test_link_hot_question_and_nulls(spark):
    q = "Will the Bank of Momaden raise rates by 50 bps in October 2026?"
    rows = [(i, "polymarket", q if i % 2 else q.upper(), None, None, None) for i in range(1, 151)]
    rows += [(1000, "kalshi", "2026-10 rate decision Momaden: 50bp increase", "Economics", D(2026, 10, 7), None), (1001, "kalshi", "Bank of Moamden Oct-26 decision - hike 50bp", "", None, D(2026, 1, 1))]
    rows += [(i, "kalshi", f"2026-10 rate decision Nudakex: {25 * (i % 9)}bp increase", None, None, None) for i in range(2000, 2300)]
    rows += [(5000, None, q, None, None, None), (5001, "kalshi", None, None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, venue string, title string, category string, close_time timestamp_ntz, created_at timestamp_ntz")
    got = {(r.market_id_a, r.market_id_b) for r in link(df).pairs.filter("confidence >= 0.5").collect()}
    assert got == {(i, k) for i in range(1, 151) for k in (1000, 1001)}
