"""Pairs with rare vote patterns are scored, not dropped."""

from datetime import datetime as D

from tessera.llm.linkage import link


def test_rare_patterns_are_scored(spark):
    titles = [("Box office: Nofubuth, weekend of 10/7/25, $83m+", 'Will "Nofubuth" gross over $83 million in its opening weekend of Oct 7, 2025?'), ("CPI Vutefol: May-26 reading higher than 5.7%", "Will Vutefol annual inflation exceed 5.7% in May 2026?"), ("2026-10 rate decision Momaden: 50bp increase", "Will the Bank of Momaden raise rates by 25 bps in October 2026?")]
    rows = [(10 * k + v, ("kalshi", "polymarket")[v], t, "c" if k else None, D(2026, 1, 10 + 5 * v * k), D(2025, 1, 1)) for k, pair in enumerate(titles) for v, t in enumerate(pair)]
    m = spark.createDataFrame(rows, "id long, venue string, title string, category string, close_time timestamp_ntz, created_at timestamp_ntz")
    got = {n: link(m, most_patterns=n).pairs.collect() for n in (1, 200_000)}
    ids = {n: {(r.market_id_a, r.market_id_b) for r in rows} for n, rows in got.items()}
    assert len(ids[200_000]) >= 2 and ids[1] == ids[200_000] and all(0 <= r.confidence <= 1 for r in got[1])
