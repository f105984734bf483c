"""Work and shuffles that stay small where pairs are many, and results that stay whole."""

import random

from pyspark.sql import functions as F

from tessera.operators import blocking as B


def shuffled(spark, make):
    """(rows made, MB shuffled) of a query."""
    total = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])
    before = total()
    n = make().count()
    return n, (total() - before) / 1e6


def test_nearest_sharing_is_the_plain_ranking(spark):
    rnd = random.Random(7)
    some = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", None]
    rows = lambda: [(i, rnd.choice([None, *range(6)]), rnd.sample(some, rnd.randint(0, 7 if i % 9 == 0 else 4))) for i in range(70)]
    x, y = rows(), rows()
    want = set()
    for i, c, a in x:
        met = [(-n, *((1, 0) if c is None or d is None else (0, abs(c - d))), j) for j, d, b in y if (n := len((set(a) & set(b)) - {None}))]
        want |= {(i, j, -n, k + 1) for k, (n, _, _, j) in enumerate(sorted(met)[:6])}
    sides = [spark.createDataFrame(s, "id long, c long, w array<string>") for s in (x, y)]
    assert {(p.l, p.r, p.n_keys, p.rank) for p in B.nearest_sharing(*sides, "w", "c", 6).collect()} == want


def test_j_entity_ranked_does_not_shuffle_pairs(spark, tmp_path):
    import __spark_entry__ as entry

    m = spark.range(5_000).select("id", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket").alias("venue"), F.lit("the election of otters").alias("title"), F.timestamp_seconds(F.col("id") * 997 % 5000).cast("timestamp_ntz").alias("close_time"))
    m.write.parquet(f"{tmp_path}/markets.parquet")
    n, mb = shuffled(spark, lambda: entry.queries()["j_entity_ranked"](spark, str(tmp_path)))
    assert n == 2_500 * 20 and mb < 4


def test_pairs_by_key_or_else_by_another_are_not_shuffled(spark):
    rnd = random.Random(8)
    rows = lambda n: [(i, rnd.sample(["a", "b", "c", "d", None], rnd.randint(0, 3)), rnd.sample(["x", "y", None], rnd.randint(0, 2))) for i in range(n)]
    x, y = rows(60) + [(99, None, ["x"]), (98, ["a"], None)], [(i, [k for k in a if k != "d"], b) for i, a, b in rows(60)]
    pairs = lambda a, b: len((set(a or ()) & set(b or ())) - {None})
    first = sorted((i, j) for i, a, _ in x for j, b, _ in y if pairs(a, b))
    want = first + [(i, j) for i, _, a in x for j, _, b in y if i not in {i for i, _ in first} and pairs(a, b)]
    l, r = (spark.createDataFrame(s, "id long, k array<string>, o array<string>") for s in (x, y))
    assert sorted(map(tuple, B.key_join_or(l, r, "k", "o").collect())) == sorted(want)
    assert sorted(map(tuple, B.key_join(l, r, F.col("k"), F.col("k")).collect())) == sorted((i, j, n) for i, a, _ in x for j, b, _ in y if (n := pairs(a, b)))


def _two_venues(spark, path, title):
    m = spark.range(4_000).select("id", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket").alias("venue"), title.alias("title"), F.lit("c").alias("category"), F.lit("2026-01-05 10:00").cast("timestamp_ntz").alias("close_time"), F.lit("2026-01-01").cast("timestamp_ntz").alias("created_at"))
    m.write.parquet(f"{path}/markets.parquet")
    return str(path)


def test_j_entity_names_does_not_shuffle_pairs(spark, tmp_path):
    import __spark_entry__ as entry

    d = _two_venues(spark, tmp_path, F.format_string("Wheat Morav above $%d", F.col("id") + 5))
    n, mb = shuffled(spark, lambda: entry.queries()["j_entity_names"](spark, d))
    assert n == 2_000 * 2_000 and mb < 4


def test_j_entity_year_fallback_does_not_shuffle_pairs(spark, tmp_path):
    import __spark_entry__ as entry

    d = _two_venues(spark, tmp_path, F.when(F.col("id") < 2_000, "the election").otherwise("the race"))
    n, mb = shuffled(spark, lambda: entry.queries()["j_entity_year_fallback"](spark, d))
    assert n == 1_000 * 1_000 + 1_000 * 2_000 and mb < 4


def test_most_sharing_is_the_plain_ranking():
    import pandas as pd

    rnd = random.Random(9)
    some = [f"w{i:02}" for i in range(30)]
    rows = lambda: [(i, rnd.sample(some[: rnd.choice([4, 10, 30])], rnd.randint(0, 4))) for i in range(150)]
    x, y = rows(), rows()
    shared = lambda a, b: len(set(a) & set(b))
    want = {(i, j, -n) for i, a in x for n, j in sorted((-shared(a, b), j) for j, b in y if shared(a, b))[:5]}
    sides = [pd.DataFrame({k: [i for i, _ in s], "w": [w for _, w in s]}) for s, k in ((x, "l"), (y, "r"))]
    for bits in (0, 3, 62):
        assert {*B._most_shared(*sides, 5, bits).itertuples(index=False, name=None)} == want, bits


def test_most_sharing_over_cells_does_not_shuffle_pairs(spark):
    rows = lambda n: spark.range(n).select("id", F.array(F.lit("hot"), F.lit("warm"), F.concat(F.lit("word"), F.col("id") % 40)).alias("w"))
    l, r = rows(3_000), rows(2_500)
    n, mb = shuffled(spark, lambda: B.most_sharing(l, r, "w", 5, rows=1_000))
    assert n == 15_000 and mb < 4
    got = [(p.r, p.n_keys) for p in B.most_sharing(l.filter("id = 41"), r, "w", 5, rows=1_000).orderBy("rank").collect()]
    assert got == [(1, 3), (41, 3), (81, 3), (121, 3), (161, 3)]


def test_greedy_takes_the_best_scores_in_few_jobs(spark):
    """One score for all pairs of a block makes as many rounds as the block is wide; taken in order they are one step."""
    from tessera.operators import selection as S

    pairs = spark.range(40 * 40 * 5).select(F.expr("id div 40").alias("l"), F.expr("id % 40 + 40 * (id div 1600)").alias("r"), F.expr("0.5 + (id div 1600) * 0.1").alias("score"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("greedy", "greedy")
    got = {(x.l, x.r, x.score) for x in S.greedy_capped(pairs, 30, 30, finish=400).collect()}
    jobs = len(tracker.getJobIdsForGroup("greedy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n_l, n_r, want = {}, {}, set()
    for s, l, r in sorted((-x.score, x.l, x.r) for x in pairs.collect()):
        if n_l.get(l, 0) < 30 and n_r.get(r, 0) < 30:
            n_l[l], n_r[r] = n_l.get(l, 0) + 1, n_r.get(r, 0) + 1
            want.add((l, r, -s))
    assert got == want and jobs < 80, jobs


def test_sharing_in_memory_is_the_plain_count(spark):
    """Hot and rare tokens, many slices, rows of few tokens: every pair with its number of shared tokens."""
    rnd = random.Random(10)
    some = [f"tok{i:03}" for i in range(150)]
    rows = lambda: [(i, rnd.sample(some[: rnd.choice([3, 70, 150])], rnd.randint(0, 3)) + rnd.sample(["hot", "warm", "mild", "ab", None], rnd.randint(0, 5))) for i in range(300)] + [(900, None), (901, [])]
    x, y = rows(), rows()
    l, r = (spark.createDataFrame(s, "id long, w array<string>") for s in (x, y))
    keys = lambda a: {k for k in a or () if k and len(k) >= 3}
    for least in (1, 2, 3):
        want = sorted((i, j, n) for i, a in x for j, b in y if (n := len(keys(a) & keys(b))) >= least)
        for rows_ in (200_000, 70):
            assert sorted(map(tuple, B.token_pairs(l, r, "w", least, rows=rows_).collect())) == want, (least, rows_)


def test_token_pairs_are_made_in_memory(spark):
    """36 million pairs of rows with six hot tokens each: seconds, where comparing the arrays of every pair took minutes."""
    import time

    rows = lambda n: spark.range(n).select("id", F.array(*[F.lit(f"hot{k}") for k in range(6)], F.concat(F.lit("word"), F.col("id") % 40)).alias("w"))
    took = {}
    for n in (100, 6_000):
        began = time.time()
        got, mb = shuffled(spark, lambda: B.token_pairs(rows(n), rows(n), "w", 3))
        took[n] = time.time() - began
        assert got == n * n and mb < 8
    assert took[6_000] < took[100] + 10, took


def test_scores_made_in_memory_are_the_pipelines(spark):
    """Missing times and categories, times just at the bounds, hot words: the same pairs and scores as the pipeline over all pairs that meet."""
    from datetime import datetime, timedelta

    from tessera.plans.overlap import simple_scored
    from tessera.plans.pipeline import scored
    from tessera.queries.tables import simple

    rnd = random.Random(11)
    some = ["2026", "cut", "otters", "weekend", "opening", "zulek", "morav", "tarin", "rooks", "millers", *(f"name{i}" for i in range(30))]
    start = datetime(2026, 1, 1)
    times = [start + timedelta(hours=h, microseconds=u) for h in (0, 12, 24, 48, 168, 336, 5000) for u in (0, 1)] + [None]
    cats = [None, "", "Sports", " sports ", "Sport", "World Cup-finals", "finals 2026", "Crypto"]

    def side(venue, k):
        rows = [(k + i, venue, rnd.choice(times), rnd.choice(cats), rnd.sample(some[: rnd.choice([6, 10, 40])], rnd.randint(0, 6))) for i in range(150)] + [(k + 999, venue, None, None, None)]
        return spark.createDataFrame(rows, "id long, venue string, close_time timestamp_ntz, category string, tok array<string>").withColumn("n", F.size("tok"))

    l, r = side("kalshi", 0), side("polymarket", 2_000)
    want = sorted((x.l, x.r, x.score) for x in scored(simple(), l, r).collect())
    assert len(want) > 500
    for rows in (200_000, 60):
        assert sorted(map(tuple, simple_scored(l, r, 0.35, rows).collect())) == want


def test_e_scored_does_not_compare_pairs_far_apart(spark, tmp_path):
    """225 million pairs share a word, of which those about the same time reach the least score."""
    import time

    import __spark_entry__ as entry

    took = {}
    for n in (100, 15_000):
        m = spark.range(2 * n).select("id", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket").alias("venue"), F.format_string("weekend opening of otters%d", F.col("id")).alias("title"), F.lit("c").alias("category"), F.timestamp_seconds(F.expr("id div 2") * 1_209_600).cast("timestamp_ntz").alias("close_time"))
        m = m.withColumn("title", F.when(F.col("venue") == "kalshi", F.col("title")).otherwise(F.format_string("weekend rooks%d beat millers%d", F.col("id"), F.col("id"))))
        m.write.parquet(f"{tmp_path}/{n}/markets.parquet")
        began = time.time()
        assert entry.queries()["e_scored"](spark, f"{tmp_path}/{n}").count() == n
        took[n] = time.time() - began
    assert took[15_000] < took[100] + 10, took


def test_e_pipeline_chooses_from_scores_made_in_memory(spark, tmp_path):
    """The same choice as over all pairs that meet, with ids that occur twice; and 36 million pairs that share a word are not compared one by one."""
    import time

    import __spark_entry__ as entry
    from tessera.plans.overlap import simple_run
    from tessera.plans.pipeline import run
    from tessera.queries.tables import simple

    rnd = random.Random(12)
    some = ["2026", "otters", "weekend", "opening", "zulek", *(f"name{i}" for i in range(12))]
    cols = "id long, venue string, close_time timestamp_ntz, category string, tok array<string>"
    side = lambda venue, ids: spark.createDataFrame([(k, venue, None, rnd.choice(["a", "b", None]), rnd.sample(some, rnd.randint(0, 5))) for k in ids], cols).withColumn("n", F.size("tok"))
    for ids in (range(60), [*range(60), 7, 7, 8]):
        l, r = side("kalshi", ids), side("polymarket", [k + 1_000 for k in ids])
        want = sorted(map(tuple, run(simple(), l, r).collect()))
        assert len(want) > 50
        for rows in (600_000, 25):
            assert sorted(map(tuple, simple_run(simple(), l, r, rows).collect())) == want
    took = {}
    for n in (100, 6_000):
        m = spark.range(2 * n).select("id", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket").alias("venue"), F.lit("c").alias("category"), F.timestamp_seconds(F.expr("id div 2") * 1_209_600).cast("timestamp_ntz").alias("close_time"))
        m = m.withColumn("title", F.when(F.col("venue") == "kalshi", F.format_string("weekend opening of otters%d", F.col("id"))).otherwise(F.format_string("weekend rooks%d beat millers%d", F.col("id"), F.col("id"))))
        m.write.parquet(f"{tmp_path}/{n}/markets.parquet")
        began = time.time()
        assert entry.queries()["e_pipeline"](spark, f"{tmp_path}/{n}").count() == n
        took[n] = time.time() - began
    assert took[6_000] < took[100] + 10, took


def test_right_rows_go_to_cells_in_compressed_batches(spark, tmp_path):
    """Every cell has all right rows of its slice: as rows of strings that was the most of what j_token_index wrote to disk."""
    import __spark_entry__ as entry

    title = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket"), *[F.format_string("zulek%05d", F.col("id") * k % 9973) for k in (1, 3, 5, 7)])
    m = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "kalshi").otherwise("polymarket").alias("venue"), title.alias("title"))
    m.write.parquet(f"{tmp_path}/markets.parquet")
    n, mb = shuffled(spark, lambda: entry.queries()["j_token_index"](spark, str(tmp_path)))
    assert n > 10_000 and mb < 4, (n, mb)


def test_j_token_index_is_written_in_little_space(spark, tmp_path):
    """Pairs are more than any other result: the same right ids come again soon, so that a pair takes less than a byte of a file, not four."""
    import __spark_entry__ as entry

    m = spark.range(30_300).select("id", F.when(F.col("id") < 300, "kalshi").otherwise("polymarket").alias("venue"), F.format_string("otters beat rooks%d zulek%d", F.col("id") % 5, F.col("id")).alias("title"))
    m.write.parquet(f"{tmp_path}/in/markets.parquet")
    entry.queries()["j_token_index"](spark, f"{tmp_path}/in").write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300 * 30_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 300 * 30_000
