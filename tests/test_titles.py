"""Values read from titles, and the topics' pipelines on small markets."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.topics import TOPICS, suggest

NUMBERS = [
    ("price is 3700", [3700.0]), ("1.2m downloads", [1200000.0]), ("1.2 million downloads", [1200000.0]), ("inflation at 2.5%", [2.5]), ("page 5", []), ("$5 a month", [5.0]),
    ("above $79,000 on Jan 21, 2026", [79000.0]), ("between $3,700 and $3,800", [3700.0, 3800.0]), ("0.5% or 3%", [0.5, 3.0]), ("", []), ("no number", []), ("$100k and $100,000", [100000.0]), ("rate decision 50 bps", [50.0]), ("market 45", [45.0]), ("margin 40", [40.0]), ("on march 21", []), ("sept 30", []),
]
COMPARATORS = [("BTC reaches 100k", "GE"), ("ETH between $3700 and $3800", "BETWEEN"), ("Trump wins election", "WIN"), ("BTC below 90k", "LE"), ("Who knows", "UNKNOWN"), ("government plans", "GE")]


def test_numbers_comparators_and_verdicts(spark):
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t, _ in NUMBERS] + [(None,)], "t string").select("t", T.numbers(F.col("t")).alias("n")).collect()}
    assert got.pop(None) in (None, []) and got == dict(NUMBERS)
    c = spark.createDataFrame([(t,) for t, _ in COMPARATORS], "t string").select("t", T.comparator(F.col("t")).alias("c"), T.comparator(F.col("t"), True).alias("w")).collect()
    assert {r.t: r.c for r in c} == dict(COMPARATORS) and {r.t: r.w for r in c}["government plans"] == "UNKNOWN"
    v = spark.createDataFrame([("Yes.",), ("no",), ("UNCERTAIN",), ("I know nothing",)], "t string").select(T.verdict(F.col("t")).alias("v")).collect()
    assert [r.v for r in v] == ["YES", "NO", "UNCERTAIN", "UNCERTAIN"]


def test_versus(spark):
    t = [("Lions v Vikings", "lions vs vs ikings"), ("Lions vs. Bears", "lions vs bears"), ("co-v. x", "co-vs"), ("over v", "vs")]
    got = {r.t: r.n for r in spark.createDataFrame([(a,) for a, _ in t], "t string").select("t", T.normalize_title(F.col("t")).alias("n")).collect()}
    assert got == dict(t)


def test_n_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "t array<string>")
    assert [sorted(r.g) for r in df.select(T.n_grams(F.col("t"), 2).alias("g")).collect()] == [["a", "a b", "b", "b c", "c"], [], ["x"]]


ROWS = [
    (1, "kalshi", "Bank of Momaden 2026-10 decision - hike 50bp", D(2026, 10, 7)), (2, "polymarket", "Will the Bank of Momaden raise rates by 50 bps in October 2026?", D(2026, 10, 8)),
    (3, "polymarket", "Will the Bank of Momaden cut rates by 50 bps in March 2026?", D(2026, 3, 8)),
    (4, "kalshi", "Max temperature Gulugir 2025-08-26: >= 38 degrees", D(2025, 8, 27)), (5, "polymarket", "Will it reach 38°C in Gulugir on August 26, 2025?", D(2025, 8, 26)),
    (6, "polymarket", "Will it reach 38°C in Gulugir on August 29, 2025?", D(2025, 8, 29)),
    (7, "kalshi", "Vodular at Miletar winner? 31-Jan-26", None), (8, "polymarket", "Miletar Otters vs. Vodular Rooks, January 31, 2026", None), (9, "polymarket", "Miletar Otters vs. Samecan Rooks, January 31, 2026", None),
    (10, "kalshi", None, None), (11, "polymarket", "", None),
]


def test_topics(spark):
    df = spark.createDataFrame(ROWS, "id long, venue string, title string, close_time timestamp_ntz").withColumn("category", F.lit(None).cast("string")).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    got = {(r.topic, r.l, r.r) for r in suggest(df).collect()}
    assert got == {("RATES", 1, 2), ("CLIMATE", 4, 5), ("SPORTS", 7, 8)}
    assert {(r.l, r.r) for r in suggest(df, "rates").collect()} == {(1, 2)}
    assert len({t.name for t in TOPICS}) == 12


def test_command_line(capsys):
    from tessera.__main__ import main

    assert main(["list"]) == 0 and "p3_found" in capsys.readouterr().out
    assert main(["sql", "q_latest"]) == 0 and "select" in capsys.readouterr().out
    assert main([]) == 2


@pytest.mark.parametrize("name", ["RATES", "universal"])
def test_pipelines_are_registered(spark, name):
    from tessera.plans.pipeline import pipeline

    spark.range(1)
    for t in TOPICS:
        t.pipeline()
    assert pipeline(name).name == name.upper()
