"""Matching records of two sources without a common key, by a label model over heuristic votes.

Many matching functions vote yes, no or nothing on each candidate pair; a generative model learns from the
votes alone how accurate and how correlated they are, and gives each pair a posterior.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.titles import parse, skeleton
from tessera.shared import Scratch, small, spread

#: Categories that say nothing.
VAGUE = ("", "other", "misc", "trending")
TWO_NAMES = ("game", "ceasefire", "trade")
_PARSED = (
    "id long, venue string, kind string, name string, name2 string, first string, skel string, skel2 string, threshold double, direction string, "
    "detail string, hour int, told string, day string, closes long, category string"
)


class LabelModel:
    """A generative model of votes in {0: no, 1: nothing, 2: yes}; correlated voters are modelled jointly.

    A pair is a match, or it differs in one respect or another: there is a latent class of matches and one of others for each
    factor of voters, so that what differs in one respect may well agree in the rest. Fitted by expectation maximisation to
    counts of vote patterns, under constraints that let the classes be told apart without labels: of the matches at most
    ``errors`` have a no from any one voter, and of a factor's class at most ``errors`` have none within that factor. Voters whose votes depend on each other among the
    matches or among the others beyond ``link`` (a mutual information in nats, or what chance makes of few pairs) are put in one factor of at most three voters, which
    has a table over their joint votes. A voter that says nothing is no evidence: votes are counted among those that are cast.
    """

    def __init__(self, voters: int, link: float = 0.02, rounds: int = 100, smooth: float = 0.5, errors: float = 0.01):
        self.voters, self.link, self.rounds, self.smooth, self.errors = voters, link, rounds, smooth, errors
        self.factors: list[tuple[int, ...]] = [(v,) for v in range(voters)]
        self.tables: list[np.ndarray] = []
        self.prior = np.full(voters + 1, 1 / (voters + 1))

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(votes[:, v] * 3**i for i, v in enumerate(f)) for f in self.factors]

    def _table(self, counts: np.ndarray, voters: int, own: int) -> np.ndarray:
        """Shares of each class's votes; ``own`` is the class of pairs that differ in this factor."""
        digits = np.arange(3**voters)[:, None] // 3 ** np.arange(voters) % 3
        silent = (digits == 1) @ 2 ** np.arange(voters)
        t = counts + self.smooth * np.prod(np.array([0.1, 0.5, 0.9])[digits], 1)  # what little is known before: most votes are yes
        for mask in np.unique(silent):
            here = silent == mask
            t[:, here] /= t[:, here].sum(1, keepdims=True)
            for i in range(voters):
                no, yes = here & (digits[:, i] == 0), here & (digits[:, i] == 2)
                if (p := t[0][no].sum()) > self.errors:
                    t[0][no] *= self.errors / p
                    t[0][yes] *= (1 - self.errors) / (1 - p)
            no = here & (digits == 0).any(1)
            if (p := t[own][here & ~no].sum()) > self.errors:
                t[own][here & ~no] *= self.errors / p
                t[own][no] *= (1 - self.errors) / max(1 - p, 1e-300)
        return t

    def _em(self, votes: np.ndarray, n: np.ndarray, match: np.ndarray) -> np.ndarray:
        codes = self._codes(votes)
        objects = np.stack([(votes[:, f] == 0).any(1) for f in self.factors]) + 1e-3
        shares = np.vstack([match, (1 - match) * objects / objects.sum(0)])
        for _ in range(self.rounds):
            w = shares * n
            self.prior = (w.sum(1) + 2) / (w.sum() + 2 * len(w))
            self.tables = [self._table(np.stack([np.bincount(c, x, 3 ** len(f)) for x in w]), len(f), k) for k, (f, c) in enumerate(zip(self.factors, codes), 1)]
            new = self._shares(votes)
            done, shares = np.abs(new - shares).max() < 1e-6, new
            if done:
                break
        return shares[0]

    def fit(self, votes: np.ndarray, n: np.ndarray) -> LabelModel:
        """``votes``: a pattern a row; ``n``: how often each occurs. Starts from how many voters say no."""
        if not len(n):
            return self
        post = self._em(votes, n, 0.9 * 0.1 ** (votes == 0).sum(1))
        parent = list(range(self.voters))
        strength = []
        for a, b in itertools.combinations(range(self.voters), 2):
            mi, cast = 0.0, (votes[:, a] != 1) & (votes[:, b] != 1)
            for w in ((1 - post) * n * cast, post * n * cast):
                joint = np.bincount(votes[:, a] * 3 + votes[:, b], w, 9).reshape(3, 3)[::2, ::2] + 1e-9
                joint /= joint.sum()
                mi += w.sum() / n.sum() * float((joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum())
            strength.append((mi, a, b))
        for mi, a, b in sorted(strength, reverse=True):
            ga, gb = parent[a], parent[b]
            if mi < max(self.link, 4 / n.sum()) or ga == gb or parent.count(ga) + parent.count(gb) > 3:
                continue
            parent = [ga if g == gb else g for g in parent]
        self.factors = [tuple(v for v in range(self.voters) if parent[v] == g) for g in sorted(set(parent))]
        self._em(votes, n, post)
        return self

    def _shares(self, votes: np.ndarray) -> np.ndarray:
        score = np.repeat(np.log(self.prior)[:, None], len(votes), 1)
        for t, c in zip(self.tables, self._codes(votes)):
            score += np.log(t)[:, c]
        score = np.exp(score - score.max(0, initial=-np.inf)) if len(votes) else score
        return score / score.sum(0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of a match; without a fit, by the balance of the votes."""
        if not self.tables:
            return 1 / (1 + np.exp(-2.0 * (votes - 1).sum(1)))
        return self._shares(votes)[0]


def read_titles(markets: DataFrame) -> DataFrame:
    """What the titles say, a row per market whose title can be read. ``told`` is the day, month or year in the title,
    ``day`` the same or, where the title has none, the day that close_time stands for (a listing closes between
    noon of its day and noon of the next; one about an hour, in the hour after)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, venue, title, cat, close, made in zip(part["id"], part["venue"], part["title"], part["category"], part["close_time"], part["created_at"]):
                close, made = (x.to_pydatetime() if x is not None and not pd.isna(x) else None for x in (close, made))
                p = parse(title if isinstance(title, str) else None, close, made)
                if p is None:
                    continue
                y, m, d = p["year"], p["month"], p["day"]
                told = None if y is None else f"{y}" if m is None else f"{y}-{m:02d}" if d is None else f"{y}-{m:02d}-{d:02d}"
                day = told
                if told is None and close is not None:
                    day = (pd.Timestamp(close) - pd.Timedelta(hours=1 if p["kind"] == "intraday" else 12)).strftime("%Y-%m-%d")
                names = p["names"]
                second = names[1] if p["kind"] in (*TWO_NAMES, "election") and len(names) > 1 else None
                first = names[2] if p["kind"] == "election" and len(names) > 2 else None
                cat = cat.strip().lower() if isinstance(cat, str) else ""
                us = None if close is None else int(pd.Timestamp(close).value // 1000)
                out.append((i, venue, p["kind"], names[0], second, first, skeleton(names[0]), skeleton(second or ""), p["threshold"], p["direction"], p["detail"], p["hour"], told, day, us, "" if cat in VAGUE else cat))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.split(", ")])
            for c in ("hour", "closes"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    cols = [F.col("id").cast("long"), "venue", "title", "category", F.col("close_time").cast("timestamp_ntz"), F.col("created_at").cast("timestamp_ntz")]
    rows = markets.filter("id is not null and venue is not null").select(*cols).dropDuplicates(["id"])
    return spread(rows, "id").mapInPandas(run, _PARSED)


def _shorter(c: Column) -> Column:
    """The skeleton itself and with each single letter left out: two that are one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), cut))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _detail() -> list[Column]:
    return [F.col("kind"), _text("threshold"), F.col("direction"), F.col("detail"), _text("hour")]


def candidates(parsed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different venues whose names' consonants (one of the two names, where a title has two) are at most one
    edit apart and which, besides, agree in one of these: day, number and hour; day, kind and detail. So numbers, directions,
    kinds and details may differ, and it is for the votes to tell. A listing whose title has no day also meets those of
    the days before and after that of its close_time; one without either meets every day of its name, number and hour."""
    two = F.col("kind").isin(*TWO_NAMES)
    skels = F.when(two, F.concat(_shorter(F.col("skel")), _shorter(F.col("skel2")))).otherwise(_shorter(F.col("skel")))
    number = F.concat_ws("|", _text("threshold"), _text("hour"))
    asked = F.concat_ws("|", "kind", "detail")
    keyed = parsed.select("id", "venue", "told", "day", number.alias("number"), asked.alias("asked"), F.explode(F.array_distinct(skels)).alias("s"))
    keyed = keyed.withColumn("around", F.when(F.col("told").isNull(), F.expr("transform(array(-1, 1), i -> cast(date_add(try_cast(day as date), i) as string))")))
    own = F.array(F.xxhash64(F.lit("n"), "day", "number", "s"), F.xxhash64(F.lit("a"), "day", "asked", "s"))
    dated = keyed.filter("day is not null")
    at_home = dated.select("id", "venue", F.explode(own).alias("k"))
    beside = dated.filter("around is not null").select("id", "venue", F.explode(F.array_compact("around")).alias("day"), "number", "s").select("id", "venue", F.xxhash64(F.lit("n"), "day", "number", "s").alias("k"))
    undated = keyed.filter("day is null").select("id", "venue", F.xxhash64(F.lit("u"), "number", "s").alias("k"))
    anywhere = keyed.select("id", "venue", F.xxhash64(F.lit("u"), "number", "s").alias("k")).join(undated.select("k").distinct(), "k", "left_semi")
    parts = [
        at_home.alias("x").join(at_home.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.venue") < F.col("y.venue"))),
        beside.alias("x").join(at_home.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.venue") != F.col("y.venue"))),
        undated.alias("x").join(anywhere.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.venue") != F.col("y.venue"))),
    ]
    first = F.col("x.venue") < F.col("y.venue")
    pairs = [p.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("a"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("b")) for p in parts]
    return reduce(DataFrame.unionByName, pairs).distinct()


def near_misses(parsed: DataFrame, rows: int, per_block: int = 6) -> DataFrame:
    """A bounded sample of pairs that agree in a part of what the titles say, for fitting only: of at most ``rows`` listings
    of names taken by hash those with the same name and day or name and details, of as many listings taken by hash those with the
    same kind and day or kind and details; at most ``per_block`` listings of a venue and block."""
    total = parsed.count()
    every = F.lit(max(1, total // max(1, rows)))
    named = parsed.filter(F.pmod(F.xxhash64("kind", "skel"), every) == 0).limit(2 * rows)
    others = parsed.filter(F.pmod(F.xxhash64("id"), every) == 0).limit(2 * rows)
    parts = []
    for part, keys in ((named, (("a", "kind", "skel", "day"), ("b", "skel", *_detail()))), (others, (("c", "kind", "day"), ("d", *_detail())))):
        key = F.explode(F.array(*[F.xxhash64(F.lit(k[0]), *k[1:]) for k in keys]))
        parts.append(part.select("id", "venue", key.alias("k")))
    by = Window.partitionBy("k", "venue").orderBy(F.xxhash64("id"))
    keyed = parts[0].unionByName(parts[1]).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_block)
    x, y = keyed.alias("x"), keyed.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.venue") < F.col("y.venue"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _edits(a: Column, b: Column) -> Column:
    """Edits between two words, a swap of letters as one."""
    d = F.levenshtein(a, b)
    swap = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(swap, 1).otherwise(d)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _alike(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """Names at most one edit apart (two where the consonants agree), or one the other's abbreviation by consonants (itself
    at most one edit apart)."""
    short = ~a.rlike("[aeiou]") | ~b.rlike("[aeiou]")
    return (_edits(a, b) <= 1) | ((sa == sb) & (_edits(a, b) <= 2)) | (short & (_edits(sa, sb) <= 1))


VOTERS = ("kind", "same_name", "close_name", "same_skeleton", "second_name", "first_name", "told_day", "day", "closes", "threshold", "direction", "detail", "hour", "category")


def votes(pairs: DataFrame, parsed: DataFrame, supports: DataFrame) -> DataFrame:
    """The vote of each matching function on each pair, as a string of digits in the order of ``VOTERS``.
    ``supports`` has the (category, kind) that go together in the data."""
    p = parsed.join(supports.withColumnRenamed("kind", "k2"), (F.col("category") == F.col("cat")) & (F.col("kind") == F.col("k2")), "left").drop("k2", "cat")
    x = p.select([F.col(c).alias(f"x_{c}") for c in p.columns])
    y = p.select([F.col(c).alias(f"y_{c}") for c in p.columns])
    j = pairs.join(x, F.col("a") == F.col("x_id")).join(y, F.col("b") == F.col("y_id"))
    X, Y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    same = lambda c: X(c) == Y(c)
    close = _alike(X("name"), Y("name"), X("skel"), Y("skel"))
    close2 = _edits(X("name2"), Y("name2")) <= 1
    crossed = (_edits(X("name"), Y("name2")) <= 1) & (_edits(X("name2"), Y("name")) <= 1)
    close, close2 = close | F.coalesce(crossed, F.lit(False)), close2 | crossed
    initial = X("first").substr(1, 1) == Y("first").substr(1, 1)
    one = F.length(F.least(X("first"), Y("first"))) + F.length(F.greatest(X("first"), Y("first")))
    whole = (F.length(X("first")) > 1) & (F.length(Y("first")) > 1)
    first = initial & (~whole | (_edits(X("first"), Y("first")) <= 2)) & (one > 0)
    apart = F.abs(X("closes") - Y("closes")) / 3.6e9
    fits = X("supported") & Y("supported")
    ballots = {
        "kind": _vote(same("kind"), ~same("kind")),
        "same_name": _vote(same("name"), F.lit(False)),
        "close_name": _vote(close, ~close),
        "same_skeleton": _vote(same("skel"), _edits(X("skel"), Y("skel")) > 1),
        "second_name": _vote(close2, ~close2),
        "first_name": _vote(first, ~first),
        "told_day": _vote(same("told"), X("told") != Y("told")),
        "day": _vote(same("day"), X("day") != Y("day")),
        "closes": _vote(apart <= 48, apart > 240),
        "threshold": _vote(same("threshold"), ~X("threshold").eqNullSafe(Y("threshold"))),
        "direction": _vote(same("direction") & (X("direction") != ""), X("direction") != Y("direction")),
        "detail": _vote(same("detail") & (X("detail") != ""), X("detail") != Y("detail")),
        "hour": _vote(same("hour"), ~X("hour").eqNullSafe(Y("hour"))),
        "category": _vote(fits, (X("category") != "") & X("supported").isNull() | (Y("category") != "") & Y("supported").isNull()),
    }
    return j.select("a", "b", F.concat(*[ballots[v].cast("string") for v in VOTERS]).alias("pattern"))


@dataclass
class Linkage:
    pairs: DataFrame
    model: LabelModel


def _ballots(patterns: Sequence[str]) -> np.ndarray:
    return np.array([[int(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(VOTERS))


def link(markets: DataFrame, fit_rows: int = 40_000, most_patterns: int = 200_000) -> Linkage:
    """(market_id_a, market_id_b, confidence, pattern) of every candidate pair, smaller id first.

    The confidence is the label model's posterior of the pair's votes, and nothing else decides: whoever wants the
    matches takes those above a confidence. The model is fitted to the most frequent ``most_patterns`` vote patterns of all candidates
    and of a sample of near misses (at most 4 * ``fit_rows`` listings), counted on the cluster; every pair's posterior is then
    computed from the model's tables, however rare its pattern. Markets with null id, venue or unreadable title
    pair with nothing; repeated ids count once; null close_time and category vote nothing.
    """
    spark = markets.sparkSession
    scratch = Scratch(spark, "linkage")
    parsed = scratch.write(read_titles(markets), "parsed")
    share = parsed.filter("category <> ''").groupBy(F.col("category").alias("cat"), "kind").count()
    share = share.withColumn("of", F.sum("count").over(Window.partitionBy("cat"))).filter("count >= 0.05 * of")
    supports = small(scratch.write(share.select("cat", "kind", F.lit(True).alias("supported")), "supports"))
    every = scratch.write(votes(candidates(parsed), parsed, supports), "votes")
    sample = votes(near_misses(parsed, fit_rows), parsed, supports)
    got = every.select("pattern").unionByName(sample.select("pattern")).groupBy("pattern").count().orderBy(F.desc("count"), "pattern").limit(most_patterns).collect()
    model = LabelModel(len(VOTERS)).fit(_ballots([r[0] for r in got]), np.array([r[1] for r in got], dtype=float))

    @F.pandas_udf("double")
    def posterior(pattern: pd.Series) -> pd.Series:
        codes, names = pd.factorize(pattern)
        return pd.Series(model.posterior(_ballots(names))[codes])

    pairs = every.select(F.least("a", "b").alias("market_id_a"), F.greatest("a", "b").alias("market_id_b"), posterior("pattern").alias("confidence"), "pattern")
    return Linkage(pairs, model)
