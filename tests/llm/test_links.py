"""Top N, cutoffs and components against brute force."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.cutoff import DyadicCountTree
from tessera.llm.topn import top_n
from tessera.operators.links import current_links, score_value
from tessera.shared import Scratch

LINK = "id long, left_venue string, left_market_id long, right_venue string, right_market_id long, score double, updated_at timestamp_ntz, rank string"


def test_top_n_hot_group_ties_and_nulls(spark):
    rnd = random.Random(5)
    rows = [(1 if rnd.random() < 0.5 else rnd.randint(2, 60), i, rnd.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")])) for i in range(3000)]
    rows += [(None, 5000, 0.9)]
    df = spark.createDataFrame(rows, "g long, i long, s double").withColumn("slice", F.pmod("i", F.lit(7))).withColumns({"_bound": F.lit("x"), "_g": F.lit(1), "_LOCAL": F.lit(2)})
    got = sorted((r.g, r.i, r.rank) for r in top_n(df, "g", "slice", "s", ["i"], 5).collect())
    want, by = [], defaultdict(list)
    for g, i, s in rows:
        if g is not None and s is not None and not math.isnan(s):
            by[g].append((-s, i))
    for g, xs in by.items():
        want += [(g, i, k + 1) for k, (_, i) in enumerate(sorted(xs)[:5])]
    assert got == sorted(want)
    assert top_n(df.limit(0), "g", "slice", "s", ["i"], 5).count() == 0


def test_current_links(spark):
    from datetime import datetime as D

    a, b = D(2025, 1, 1), D(2025, 1, 2)
    rows = [(1, "k", 1, "p", 2, 0.5, a, "x"), (1, "k", 1, "p", 2, 0.5, a, "x"), (2, "k", 1, "p", 2, 0.7, b, "x"), (3, "k", 1, "p", 2, 0.1, b, "x"), (4, None, 1, "p", 2, 2.0, None, "x"), (5, "k", None, "p", 2, 1.0, a, "x")]
    got = current_links(spark.createDataFrame(rows, LINK), keep=("score",)).select("id", score_value(F.col("score")).alias("v")).collect()
    assert sorted((r.id, r.v) for r in got) == [(3, 0.1), (4, 1.0)]


def test_link_states_are_current_links_then_and_now(spark):
    from datetime import datetime as D

    from tessera.operators.links import link_states

    rnd = random.Random(9)
    rows = [(i, "k", rnd.randint(1, 4), "p", rnd.randint(1, 6), 0.5, rnd.choice([None, *[D(2025, 1, d) for d in range(1, 9)]]), "x") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:40], LINK)
    then = D(2025, 1, 4)
    got = link_states(df, F.lit(then).cast("timestamp_ntz")).select("id", "was", "now").collect()
    assert sorted(r.id for r in got if r.now) == sorted(r.id for r in current_links(df).collect())
    old = df.filter(F.col("updated_at").isNull() | (F.col("updated_at") <= F.lit(then)))
    assert sorted(r.id for r in got if r.was) == sorted(r.id for r in current_links(old).collect())


def test_cutoff_matches_sorting_and_batches(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["A", "B", "C", None]), rnd.choice([rnd.random(), 1.0, 0.0, 0.25, None])) for _ in range(2000)] + [("ONE", 0.5)]
    df = spark.createDataFrame(rows, "t string, s double")
    targets = spark.createDataFrame([("A", 0.1), ("B", 0.5), ("C", 1.0), ("ONE", 0.01), ("NONE", 0.5), (None, 0.5)], "topic string, f double")
    tree = DyadicCountTree(spark, Scratch(spark, "t").root, depth=4)
    tree.add(df.limit(700), "t", "s", "a")
    tree.add(df.limit(700), "t", "s", "a")
    tree.add(df.exceptAll(df.limit(700)), "t", "s", "b")
    got = {r.source: (r.cutoff, r.kept, r.total) for r in tree.cutoffs(df, "t", "s", targets, "topic", "f").collect()}
    want = {}
    for t, f in (("A", 0.1), ("B", 0.5), ("C", 1.0), ("ONE", 0.01)):
        s = sorted((x for g, x in rows if g == t and x is not None), reverse=True)
        c = s[max(1, math.ceil(f * len(s))) - 1]
        want[t] = (c, sum(x >= c for x in s), len(s))
    assert got == want
    tree.add(df.filter("t = 'A'"), "t", "s", "withdrawn", weight=-1)
    assert "A" not in {r.source for r in tree.descend(targets, "topic", "f").collect()}
    again = DyadicCountTree(spark, tree.path, depth=4)  # the tree lasts: opened anew it knows all batches
    again.add(df.filter("t = 'A'").withColumn("w", F.lit(1)), "t", "s", "back", F.col("w"))
    assert {r.source: (r.cutoff, r.kept, r.total) for r in again.cutoffs(df, "t", "s", targets, "topic", "f").collect()} == want


def test_components_match_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(1, 400), rnd.randint(1, 400)) for _ in range(260)]
    edges += [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2200)] + [(9000, 9000), (None, 1), (2, None)]
    edges += [(3000, 3000 + i) for i in range(300)] + [(3300 + i, 3000 + i) for i in range(300)]  # a hub and what hangs on its neighbours
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.group for r in connected_components(df, "a", "b").collect()}
    assert got == {r.vertex: r.group for r in connected_components(df, "a", "b", hot_rows=40).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in list(parent)}
    assert max(Counter(got.values()).values()) == 600
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_hot_source_and_null_fractions(spark):
    rows = [("HOT", (i % 100) / 100) for i in range(3000)] + [("A", 0.5), (None, 0.5), ("B", None)]
    df = spark.createDataFrame(rows, "t string, s double").withColumn("source", F.lit("x")).withColumn("cutoff", F.lit(1))
    targets = spark.createDataFrame([("HOT", 0.25), ("A", None), ("B", 0.5), ("A", float("nan")), (None, 1.0)], "t string, f double")
    tree = DyadicCountTree(spark, Scratch(spark, "t").root)
    tree.add(df, "t", "s", "one")
    got = tree.cutoffs(df, "t", "s", targets, "t", "f").collect()
    assert [(r.source, r.cutoff, r.kept, r.total) for r in got] == [("HOT", 0.75, 750, 3000)]
    empty = DyadicCountTree(spark, Scratch(spark, "t").root)
    empty.add(df.limit(0), "t", "s", "none")
    assert empty.cutoffs(df.limit(0), "t", "s", targets, "t", "f").count() == 0
