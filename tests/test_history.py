"""The ledger against a plain reading of the rules, row by row."""

import random
from datetime import datetime, timedelta

from tessera.operators.history import history, observations, timeline
from pyspark.sql import functions as F

SCHEMA = "obs_id long, market_id long, venue string, title string, status string, close_time timestamp_ntz, captured_at timestamp_ntz, received_at timestamp_ntz"
T0 = datetime(2025, 6, 1)
EPOCH = datetime(1970, 1, 1)


def us(t):
    return int((t - EPOCH) / timedelta(microseconds=1))


def plain(rows):
    """(market_id, valid_from) of every version."""
    last = {}
    for r in rows:
        if r[1] is None or r[6] is None:
            continue
        k = (r[1], r[6])
        if k not in last or (r[7] or datetime.min, r[0]) >= (last[k][7] or datetime.min, last[k][0]):
            last[k] = r
    out, held = [], {}
    for (m, at), r in sorted(last.items()):
        old = held.get(m)
        title = " ".join(r[3].split()) if r[3] is not None else (old[0] if old else None)
        status = r[4].strip().lower() if r[4] is not None else (old[1] if old else None)
        now = (title, status, r[5].replace(second=0) if r[5] else None)
        if old is None or now != old:
            out.append((m, us(at)))
        held[m] = now
    return sorted(out)


def rows_of(seed, n=300, markets=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        m = 1 if rnd.random() < 0.4 else rnd.randint(1, markets)
        at = T0 + timedelta(hours=rnd.randint(0, 120))
        rows.append((
            i, m, "v", rnd.choice([None, "A b", " A  b ", "a b", "C", ""]), rnd.choice([None, "active", "ACTIVE", "closed"]),
            rnd.choice([None, T0, T0 + timedelta(seconds=30), T0 + timedelta(minutes=1)]), at,
            at + timedelta(minutes=rnd.randint(1, 9) if rnd.random() < 0.8 else rnd.randint(10, 9000)),
        ))
    return rows + rows[:20]


def got(df):
    return sorted((r.market_id, r.valid_from) for r in df.collect())


def test_versions_match_plain_reading(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        assert got(history(spark.createDataFrame(rows, SCHEMA)).versions()) == plain(rows)


def test_hot_market_in_blocks(spark):
    rows = rows_of(3, 500, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(history(df, hot_rows=40).versions()) == plain(rows)
    whole, cut = (timeline(observations(df), hot_rows=h).orderBy("market_id", "at").collect() for h in (10_000, 40))
    assert whole == cut


def test_late_update_supersedes_without_overwriting(spark):
    rows = [
        (1, 1, "v", "A", "active", None, T0, T0),
        (2, 1, "v", "A", "active", None, T0 + timedelta(days=2), T0 + timedelta(days=2)),
        (3, 1, "v", "B", "active", None, T0 + timedelta(days=1), T0 + timedelta(days=9)),
    ]
    book = history(spark.createDataFrame(rows, SCHEMA), batches=3)
    assert got(book.versions()) == [(1, us(T0 + timedelta(days=d))) for d in (0, 1, 2)]
    closed = book.ledger().filter("superseded_at is not null").collect()
    assert any(r.valid_to == us(T0 + timedelta(days=2)) and r.superseded_at == us(T0 + timedelta(days=9)) for r in closed)
    seen = book.ledger().filter(F.col("recorded_at") <= us(T0 + timedelta(days=3))).filter(F.coalesce("superseded_at", F.lit(1 << 62)) > us(T0 + timedelta(days=3)))
    assert sorted((r.at, r.valid_to) for r in seen.collect()) == [(us(T0), us(T0 + timedelta(days=2))), (us(T0 + timedelta(days=2)), None)]


def test_empty_and_null_rows(spark):
    assert history(spark.createDataFrame([], SCHEMA)).versions().count() == 0
    rows = [(None, None, None, None, None, None, None, None), (1, 1, None, None, None, None, T0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(1)).withColumn("blk", F.lit("x"))
    assert got(history(df).versions()) == [(1, us(T0))]


def test_rows_in_force_do_not_depend_on_the_batches(spark, tmp_path):
    df = spark.createDataFrame(rows_of(5, 200, 4), SCHEMA)
    cols = ["market_id", "at", "valid_to", "now_title", "now_status", "closes", "begins", "recorded_at"]
    force = lambda book: sorted(map(tuple, book.in_force().select(*cols).collect()), key=str)
    want = force(history(df, batches=1))
    for batches, hot in ((2, 100_000), (5, 100_000), (3, 30)):
        assert force(history(df, batches=batches, hot_rows=hot)) == want


def test_a_ledger_lasts_and_is_only_appended_to(spark, tmp_path):
    from tessera.operators.history import BitemporalLedger

    rows = sorted(rows_of(6, 200, 4), key=lambda r: r[7])
    path, files = f"{tmp_path}/ledger", []
    for k in range(4):
        part = observations(spark.createDataFrame(rows[k * 55 : (k + 1) * 55], SCHEMA))
        BitemporalLedger(spark, path=path).apply(part)
        now = {f: f.read_bytes() for f in (tmp_path / "ledger").rglob("*.parquet")}
        assert all(now[f] == b for f, b in files)  # what was written stays as it was
        files = list(now.items())
    book = BitemporalLedger(spark, path=path)
    assert book.batches() == 4 and got(book.versions()) == plain(rows)
    (tmp_path / "ledger/rows/batch=4").mkdir()  # a batch without closings does not count
    assert book.batches() == 4 and got(book.versions()) == plain(rows)
    all_rows = book.ledger()
    assert all_rows.filter("superseded_at is null").count() == book.in_force().count() < all_rows.count()
    assert all_rows.filter("superseded_at < recorded_at").isEmpty()
