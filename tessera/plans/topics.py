"""Pipelines for the topics of listings, declared over the signals read from titles.

Each says which signals block, which must agree, and how much each component weighs. The weights are fixed values; the
signals are columns name, name2, threshold, direction, detail, hour, day and month of both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores as C
from tessera.functions.signals import read_signals
from tessera.functions.text import jaccard, tokenize
from tessera.operators.blocking import near_days
from tessera.plans.pipeline import Pipeline, register


def signals(markets: DataFrame) -> DataFrame:
    """Markets with their signals: the day is the title's, else the one close_time stands for; unread titles are left out."""
    s = read_signals(markets).withColumnRenamed("day", "dom")
    m = markets.select("id", "venue", "close_time", "category", tokenize(F.col("title")).alias("tok"))
    told = F.when(F.col("dom").isNotNull() & F.col("month").isNotNull() & F.col("year").isNotNull(), F.expr("try_to_date(format_string('%04d-%02d-%02d', year, month, dom))"))
    close = (F.col("close_time") - F.expr("interval 12 hours")).cast("date")
    month = F.coalesce(F.col("year") * 12 + F.col("month"), F.year(close) * 12 + F.month(close))
    j = m.join(s, "id")
    return j.select(
        "id", "venue", "kind", "close_time", "category", "tok", F.get("names", F.lit(0)).alias("name"), F.get("names", F.lit(1)).alias("name2"), "names",
        "threshold", "direction", "detail", "hour", F.coalesce(told, close).alias("day"), month.cast("int").alias("month"), F.coalesce("year", F.year(close)).cast("int").alias("year"),
    )


def _l(c: str) -> Column:
    return F.col(f"l_{c}")


def _r(c: str) -> Column:
    return F.col(f"r_{c}")


def _same(c: str) -> Column:
    return F.coalesce(_l(c) == _r(c), F.lit(False))


def _yes(c: Column, unknown: float = 0.0) -> Column:
    return F.coalesce(c.cast("double"), F.lit(unknown))


def _text() -> Column:
    return F.coalesce(jaccard(_l("tok"), _r("tok")), F.lit(0.0))


def _names() -> Column:
    return C.entity_score(_l("names"), _r("names"))


def _days(table: list[tuple[float, float]]) -> Column:
    return F.coalesce(C.steps(F.abs(F.datediff(_l("day"), _r("day"))), table, 0.0), F.lit(0.0))


def _numbers(table: list[tuple[float, float]]) -> Column:
    a, b = _l("threshold"), _r("threshold")
    gap = F.when(a == b, 0.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(C.steps(gap, table, 0.0), F.lit(0.5))


_NEAR = [(0.0, 1.0), (0.01, 0.9), (0.05, 0.7), (0.1, 0.4)]


@dataclass(frozen=True)
class Topic:
    name: str
    kinds: tuple[str, ...]
    keys: tuple[Callable[[], Column], Callable[[], Column]]
    gates: Callable[[], list[Column]]
    scores: Callable[[], dict[str, tuple[float, Column]]]
    least: float = 0.6
    cap: int = 3

    def pipeline(self) -> Pipeline:
        return register(Pipeline(self.name, self.keys[0], self.scores(), [_l("venue") != _r("venue"), *self.gates()], self.least, per_left=self.cap, per_right=self.cap, gap=0.02, keys_right=self.keys[1]))


def _key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def _days_near(reach: int, *parts: str) -> tuple[Callable[[], Column], Callable[[], Column]]:
    """Keys of both sides that meet exactly where the parts are equal and the days at most ``reach`` apart: the left side has a key for
    each day of the band, the right side its own."""
    key = lambda day: F.concat_ws("|", _key(*parts), day.cast("string"))
    return lambda: F.transform(near_days(F.col("day"), reach), key), lambda: F.when(F.col("day").isNotNull(), F.array(key(F.col("day"))))


def _months_near(*parts: str) -> tuple[Callable[[], Column], Callable[[], Column]]:
    key = lambda month: F.concat_ws("|", _key(*parts), month.cast("string"))
    return lambda: F.transform(F.sequence(F.col("month") - 1, F.col("month") + 1), key), lambda: F.when(F.col("month").isNotNull(), F.array(key(F.col("month"))))


def _both(keys: Callable[[], Column]) -> tuple[Callable[[], Column], Callable[[], Column]]:
    return keys, keys


TOPICS = (
    Topic("CRYPTO_DAILY", ("price",), _days_near(1, "name"), lambda: [_same("name"), F.abs(F.datediff(_l("day"), _r("day"))) <= 1],
          lambda: {"entity": (0.45, _yes(_same("name"))), "date": (0.35, _days([(0, 1.0), (1, 0.6)])), "number": (0.15, _numbers(_NEAR)), "text": (0.05, _text())}, cap=5),
    Topic("CRYPTO_INTRADAY", ("intraday",), _both(lambda: F.array(_key("name", "day", "hour"))), lambda: [_same("name"), _same("hour"), _same("day")],
          lambda: {"entity": (0.6, _yes(_same("name"))), "bucket": (0.3, _yes(_same("hour") & _same("day"))), "text": (0.1, _text())}, 0.75),
    Topic("MACRO", ("inflation", "jobless"), _both(lambda: F.array(_key("kind", "name", "month"))), lambda: [_same("kind"), _same("name"), _same("month")],
          lambda: {"entity": (0.5, _names()), "period": (0.35, _yes(_same("month"))), "text": (0.15, _text())}, 0.55),
    Topic("RATES", ("rates",), _months_near("name"), lambda: [_same("name"), F.abs(_l("month") - _r("month")) <= 1],
          lambda: {"bank": (0.4, _yes(_same("name"))), "date": (0.3, F.when(_same("month"), 0.8).otherwise(0.4)), "action": (0.15, _yes(_same("detail"))), "bps": (0.1, C.steps(F.abs(_l("threshold") - _r("threshold")), [(0, 1.0), (25, 0.7), (50, 0.4)], 0.0)), "text": (0.05, _text())}),
    Topic("ELECTIONS", ("election",), _both(lambda: F.array(F.concat(F.lit("a|"), _key("name2", "detail", "year")), F.concat(F.lit("b|"), _key("name", "detail", "year")))), lambda: [_same("detail"), _same("year")],
          lambda: {"country": (0.2, _yes(_same("name2"))), "office": (0.2, _yes(_same("detail"))), "year": (0.15, _yes(_same("year"))), "candidates": (0.25, _names()), "text": (0.2, _text())}, 0.55),
    Topic("GEOPOLITICS", ("ceasefire", "trade"), _both(lambda: F.array(_key("kind", "name", "year"), _key("kind", "name2", "year"))), lambda: [_same("kind"), _same("year")],
          lambda: {"parties": (0.55, _names()), "event": (0.2, _yes(_same("kind"))), "date": (0.15, _days([(0, 1.0), (1, 0.9), (7, 0.7), (31, 0.4)])), "text": (0.1, _text())}, 0.55),
    Topic("ENTERTAINMENT", ("film",), _both(lambda: F.array(_key("name", "year"))), lambda: [_same("name"), _same("year")],
          lambda: {"show": (0.3, _yes(_same("name"))), "number": (0.25, _numbers(_NEAR)), "year": (0.15, _yes(_same("year"))), "date": (0.2, _days([(0, 1.0), (1, 0.9), (7, 0.5)])), "text": (0.1, _text())}, 0.5),
    Topic("FINANCE", ("index",), _days_near(7, "name"), lambda: [_same("name"), F.abs(F.datediff(_l("day"), _r("day"))) <= 7],
          lambda: {"instrument": (0.35, _yes(_same("name"))), "direction": (0.15, _yes(_same("direction"))), "date": (0.25, _days([(0, 1.0), (1, 0.9), (7, 0.5)])), "target": (0.15, _numbers([(0.0, 1.0), (0.001, 1.0), (0.01, 0.8), (0.05, 0.5), (0.1, 0.2)])), "text": (0.1, _text())}, cap=5),
    Topic("COMMODITIES", ("goods",), _months_near("name", "detail"), lambda: [_same("name"), _same("detail"), F.abs(_l("month") - _r("month")) <= 1],
          lambda: {"underlying": (0.45, _yes(_same("detail") & _same("name"))), "date": (0.3, _days([(0, 1.0), (1, 0.9), (7, 0.6), (31, 0.3)])), "number": (0.1, _numbers(_NEAR)), "direction": (0.1, _yes(_same("direction"))), "text": (0.05, _text())}),
    Topic("CLIMATE", ("weather",), _days_near(1, "name"), lambda: [_same("name"), F.abs(F.datediff(_l("day"), _r("day"))) <= 1],
          lambda: {"kind": (0.35, _yes(_same("kind"))), "date": (0.3, _days([(0, 1.0), (1, 0.6)])), "threshold": (0.2, _numbers(_NEAR)), "region": (0.1, _yes(_same("name"))), "text": (0.05, _text())}),
    Topic("SPORTS", ("game",), _days_near(1, "name", "name2"), lambda: [_same("name"), _same("name2"), F.abs(F.datediff(_l("day"), _r("day"))) <= 1],
          lambda: {"teams": (0.65, _names()), "time": (0.2, _days([(0, 1.0), (1, 0.5)])), "text": (0.15, _text())}, 0.55, 5),
    Topic("UNIVERSAL", (), _both(lambda: F.array(_key("kind", "name", "day"))), lambda: [_same("kind")],
          lambda: {"entity": (0.5, _names()), "number": (0.15, _numbers([(0.0, 1.0), (0.001, 0.95), (0.01, 0.85), (0.05, 0.6)])), "time": (0.1, C.time_score(_l("close_time"), _r("close_time"))), "text": (0.15, _text()), "category": (0.1, C.category_score(_l("category"), _r("category")))}),
)


def suggest(markets: DataFrame, topic: str | None = None, left: str = "kalshi", right: str = "polymarket") -> DataFrame:
    """(topic, l, r, score) over one or all topics: candidates, gates, scores, then the greedy choice under both sides' caps."""
    from functools import reduce

    from tessera.operators.selection import greedy_capped
    from tessera.plans.pipeline import scored
    from tessera.shared import Scratch

    scratch = Scratch(markets.sparkSession, "signals")
    every = scratch.write(signals(markets), "signals")
    out = []
    for t in TOPICS:
        if topic and t.name != topic.strip().upper() or not topic and not t.kinds:
            continue
        rows = every.filter(F.col("kind").isin(*t.kinds)) if t.kinds else every
        p = t.pipeline()
        pairs = scored(p, rows.filter(F.col("venue") == left), rows.filter(F.col("venue") == right)).select("l", "r", "score")
        out.append((t, p, pairs))
    # the topics' pairs are chosen together: a listing belongs to one topic, and caps are the topic's
    parts = []
    for cap in sorted({t.cap for t, _, _ in out}):
        mine = [pairs.withColumn("topic", F.lit(t.name)) for t, _, pairs in out if t.cap == cap]
        pool = scratch.write(reduce(DataFrame.unionByName, mine), "pool")
        best = pool.groupBy("l", "r").agg(F.max_by("topic", "score").alias("topic"))
        parts.append(greedy_capped(pool.select("l", "r", "score"), cap, cap, 0.02).join(best, ["l", "r"]))
    return reduce(DataFrame.unionByName, parts).select("topic", "l", "r", "score")
