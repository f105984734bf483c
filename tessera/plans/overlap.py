"""The SIMPLE pipeline's scores without making the pairs that cannot reach the least one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocking import _flat, in_cells
from tessera.operators.selection import greedy_capped
from tessera.plans.pipeline import Pipeline
from tessera.shared import epoch_us

HOUR = 3_600_000_000
WEEK = 168 * HOUR


@cache
def rounded(x: float) -> float:
    """To six digits, halves away from zero in the shortest decimal form, as Spark rounds a double."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


class Categories:
    """Scores of a left category against right ones, each made when it first occurs. A category is its lower case, trimmed, and its words of over three letters."""

    def __init__(self, rights: pa.RecordBatch):
        self.codes, self.known = self._coded(rights)
        self.rows: dict = {}

    @staticmethod
    def _coded(rows: pa.RecordBatch) -> tuple[np.ndarray, list]:
        code = rows.column("g").dictionary_encode()
        known = [*code.dictionary.to_pylist(), None]
        return pc.fill_null(code.indices, len(known) - 1).to_numpy(), known

    @staticmethod
    def score(a: str | None, b: str | None) -> float:
        if a is None or b is None:
            return 0.5 if a is b else 0.3
        (x, *v), (y, *w) = a.split("\x01"), b.split("\x01")
        return 1.0 if x == y else 0.8 if x.startswith(y) or y.startswith(x) else 0.6 if {*v} & {*w} else 0.3

    def of(self, category: str | None, places: np.ndarray) -> np.ndarray:
        row = self.rows.get(category)
        if row is None:
            if len(self.rows) * len(self.known) > 5_000_000:
                self.rows.clear()
            row = self.rows[category] = np.full(len(self.known), np.nan)
        codes = self.codes[places]
        got = row[codes]
        if np.isnan(got).any():
            for k in np.unique(codes[np.isnan(got)]):
                row[k] = self.score(category, self.known[k])
            got = row[codes]
        return got


class Signatures:
    """Right rows in the order given, by the frequent tokens they have: a bit each in ``words``, one or more words of 64 a row. Rows of equal bits, number of
    tokens and ``kind`` are a class. The rows of the other tokens are in postings. A token of ``long`` letters or more is a long one."""

    def __init__(self, tokens: pa.ListArray, kind: np.ndarray, long: int = 5, most: int = 8):
        code = tokens.values.dictionary_encode()
        self.tokens, code = code.dictionary, code.indices.to_numpy().astype("int64")
        self.n = np.diff(tokens.offsets.to_numpy()).astype("int64")
        place = np.repeat(np.arange(len(self.n), dtype="int32"), self.n)
        often = np.bincount(code, minlength=len(self.tokens))
        self.long = pc.utf8_length(self.tokens).to_numpy() >= long
        hot = np.argsort(-often, kind="stable")
        hot = hot[: min(64 * most, max(64, -(-int((often * 100 > len(self.n)).sum()) // 64) * 64))]
        self.at = np.full(len(self.tokens), -1, dtype="int64")
        self.at[hot] = np.arange(len(hot))
        self.words = [self._bits(place, code, k, len(self.n)) for k in range(-(-len(hot) // 64))]
        self.long_bits = [np.bitwise_or.reduce(np.uint64(1) << (self.at[mine] % 64).astype("uint64"), initial=np.uint64(0)) for k in range(len(self.words)) for mine in [hot[64 * k : 64 * k + 64][self.long[hot[64 * k : 64 * k + 64]]]]]
        cold = self.at[code] < 0
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code[cold], minlength=len(self.tokens)))])
        self.place = place[cold][np.argsort(code[cold], kind="stable")]
        keys = (*self.words, self.n, kind)
        self.order = np.lexsort(keys)
        new = np.ones(len(self.n), dtype=bool)
        new[1:] = np.any([x[self.order][1:] != x[self.order][:-1] for x in keys], axis=0)
        self.starts = np.flatnonzero(new)
        self.many = np.diff(np.append(self.starts, len(self.n)))
        first = self.order[self.starts]
        self.class_words, self.class_n, self.class_kind = [x[first] for x in self.words], self.n[first], kind[first]
        self.known: dict = {}
        self.held = 0
        self.seen = np.zeros(len(self.n), dtype=bool)

    def _bits(self, place: np.ndarray, code: np.ndarray, k: int, size: int) -> np.ndarray:
        out, at = np.zeros(size, dtype="uint64"), self.at[code]
        own = (at >= 64 * k) & (at < 64 * k + 64)
        np.bitwise_or.at(out, place[own], np.uint64(1) << (at[own] - 64 * k).astype("uint64"))
        return out

    def read(self, tokens: pa.ListArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each row its bits (an array a word) and the tokens it shares with any right row that have no bit."""
        code = pc.fill_null(pc.index_in(tokens.values, value_set=self.tokens), -1).to_numpy().astype("int64")
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        row, code = row[code >= 0], code[code >= 0]
        bits = [self._bits(row, code, k, len(tokens)) for k in range(len(self.words))]
        cold = self.at[code] < 0
        return bits, np.split(code[cold], np.searchsorted(row[cold], np.arange(1, len(tokens))))

    @staticmethod
    def counted(words: list[np.ndarray], mine: tuple) -> np.ndarray:
        out = None
        for x, m in zip(words, mine):
            if m or out is None:
                got = np.bitwise_count(x & m)
                out = got.astype("uint16") if out is None else out + got
        return out

    def classes(self, mine: tuple, n: int, need: np.ndarray) -> np.ndarray:
        """The classes of which the bits alone share ``need`` (by kind, number of tokens) or more."""
        key = (mine, n, need.tobytes())
        got = self.known.get(key)
        if got is None:
            if self.held > 5_000_000:
                self.known.clear()
                self.held = 0
            got = self.known[key] = np.flatnonzero(self.counted(self.class_words, mine) >= need[self.class_kind, self.class_n])
            self.held += len(got) + 20
        return got

    def members(self, classes: np.ndarray) -> np.ndarray:
        many = self.many[classes]
        return self.order[np.repeat(self.starts[classes] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def met(self, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, counts, whether a long one is among them) of the right rows that share tokens without a bit."""
        if not len(cold):
            return self.order[:0], self.order[:0], self.seen[:0]
        if len(cold) == 1:
            place = self.place[self.ends[cold[0]] : self.ends[cold[0] + 1]].astype("int64")
            return place, np.ones(len(place), dtype="int64"), np.full(len(place), self.long[cold[0]])
        parts = [self.place[self.ends[k] : self.ends[k + 1]] for k in cold]
        place, back = np.unique(np.concatenate(parts), return_inverse=True)
        long = np.bincount(back, np.repeat(self.long[cold], [len(x) for x in parts]), minlength=len(place)) > 0
        return place.astype("int64"), np.bincount(back, minlength=len(place)), long


def _each(least: float) -> Callable:
    """Right rows are placed in order of their times, those without one last. How many words a pair must share for the least score depends on how far
    apart in time it is: within a day of a left row all right rows are looked at, within a week those that share some more, and of all others those
    of the classes that share enough. Right rows that share an infrequent word are looked at one by one."""

    def each(rights: pa.RecordBatch) -> Callable:
        rights = rights.take(pc.sort_indices(rights, sort_keys=[("t", "ascending")], null_placement="at_end"))
        size, ids = rights.num_rows, rights.column("id").to_numpy()
        timed = size - rights.column("t").null_count
        p, cats = Signatures(pa.ListArray.from_arrays(*_flat(rights.column("w"))), (np.arange(size) >= timed).astype("int64")), Categories(rights)
        bounds, steps = np.array([12, 24, 48, 168]) * HOUR, np.array([1.0, 0.7, 0.4, 0.2, 0.0])
        times, top = rights.column("t").slice(0, timed).to_numpy(), int(p.n.max())

        @cache
        def need(n: int, time: float, untimed: float) -> np.ndarray:
            """Fewest shared words by kind (with a time, without) and number of words of a right row, if the category is equal."""
            both = n + np.arange(top + 1)
            alike = np.maximum(0, (least - 0.1 - 0.2 * np.array([[time], [untimed]]) - 1e-5) / 0.7)
            return np.maximum(1, np.ceil(alike * both / (1 + alike) - 1e-9)).astype("int64").clip(max=1 << 14).astype("int16")

        def scores(l: int, n: int, t: int | None, g: str | None, found: np.ndarray, shared: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            words = shared / (n + p.n[found] - shared)
            if t is None:
                time = np.where(found < timed, 0.2, 0.3)
            else:
                apart = np.abs(times[np.minimum(found, timed - 1)] - t) if timed else np.zeros(len(found), dtype="int64")
                time = np.where(found >= timed, 0.2, steps[np.searchsorted(bounds, apart)])
            total = 0.0 + 0.7 * words + 0.2 * time
            ok = total + 0.1 >= least - 2e-6
            found, total = found[ok], total[ok]
            total = total + 0.1 * cats.of(g, found)
            ok = (total >= least - 2e-6) & (ids[found] != l)
            return l, total[ok], ids[found[ok]]

        def call(lefts: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            w = pa.ListArray.from_arrays(*_flat(lefts.column("w")))
            sizes = pc.list_value_length(w).to_pylist()
            words, colds = p.read(w)
            for l, n, t, g, cold, *bits in zip(lefts.column("id").to_pylist(), sizes, lefts.column("t").to_pylist(), lefts.column("g").to_pylist(), colds, *words):
                bits = tuple(bits)
                rare, times_met, rare_long = p.met(cold)
                first = last = 0
                found = []
                if t is not None:
                    first, a, b, last = (int(x) for x in (*np.searchsorted(times, (t - WEEK, t - 24 * HOUR), "left"), *np.searchsorted(times, (t + 24 * HOUR, t + WEEK), "right")))
                    for x, y, near in ((first, a, 0.4), (a, b, 1.0), (b, last, 0.4)):
                        if x < y:
                            found.append(np.flatnonzero(p.counted([k[x:y] for k in p.words], bits) >= need(n, near, near)[0][p.n[x:y]]) + x)
                apart = (0.2, 0.3) if t is None else (0.0, 0.2)
                far = p.members(p.classes(bits, n, need(n, *apart)))
                found.append(far[(far < first) | (far >= last)] if last else far)
                found = np.concatenate(found)
                if len(rare):
                    p.seen[rare] = True
                    found = found[~p.seen[found]]
                    p.seen[rare] = False
                long = np.zeros(len(found) + len(rare), dtype=bool)
                long[len(found) :] = rare_long
                found = np.concatenate([found, rare])
                own = [k[found] & m for k, m in zip(p.words, bits)]
                shared = sum(np.bitwise_count(k).astype("int64") for k in own)
                shared[len(found) - len(rare) :] += times_met
                for k, m in zip(own, p.long_bits):
                    long |= (k & m) != 0
                if long.any():
                    yield scores(l, n, t, g, found[long], shared[long])

        return call

    return each


def _rounded(least: float) -> Callable:
    def made(out: list[tuple]) -> pa.RecordBatch:
        l, r = np.repeat(np.array([x[0] for x in out], dtype="int64"), [len(x[2]) for x in out]), np.concatenate([x[2] for x in out])
        totals, at = np.unique(np.concatenate([x[1] for x in out]), return_inverse=True)
        score = np.array([rounded(float(x)) for x in totals])[at]
        ok = score >= least
        return pa.RecordBatch.from_arrays([pa.array(l[ok]), pa.array(r[ok]), pa.array(score[ok])], names=["l", "r", "score"])

    return made


def simple_scored(left: DataFrame, right: DataFrame, least: float, rows: int = 600_000) -> DataFrame:
    """(l, r, score) of ``scored(simple(), left, right)``: sides with an id, close_time, category and tok, an array of distinct words."""
    long_words = F.filter(F.split(F.trim(F.lower("category")), r"[\s_-]+"), lambda w: F.length(w) > 3)
    g = F.when(F.col("category").isNotNull(), F.array_join(F.concat(F.array(F.trim(F.lower("category"))), long_words), "\x01"))
    l, r = (x.filter(F.size("tok") > 0).select("id", F.array_compact("tok").alias("w"), epoch_us("close_time").alias("t"), g.alias("g")) for x in (left, right))
    return in_cells(l, r, _each(least), _rounded(least), "l long, r long, score double", rows)


def simple_run(p: Pipeline, left: DataFrame, right: DataFrame, rows: int = 600_000) -> DataFrame:
    """What ``run(simple(), left, right)`` chooses, from the scores made in memory."""
    once = all(x.groupBy("id").count().filter("count > 1").isEmpty() for x in (left, right))
    return greedy_capped(simple_scored(left, right, p.least, rows), p.per_left, p.per_right, p.gap, p.keep_close, once=once)
