"""Candidate pairs by equality of exploded keys: token, entity, band, bucket and month joins. None is a cross join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import Scratch, small


def key_join(left: DataFrame, right: DataFrame, keys_left: Column, keys_right: Column, on: str = "id") -> DataFrame:
    """Distinct (l, r) that share a key; ``n_keys`` counts the keys shared. Arrays of keys are made distinct first, null keys
    match nothing. Only ids and keys are shuffled: a pair is made at the first key it shares."""
    own = lambda side, keys, id, name: side.select(F.col(on).alias(id), F.array_compact(F.array_distinct(keys)).alias(name))
    one = lambda name: F.when(F.size(name) == 1, F.element_at(name, 1))
    j = meet(own(left, keys_left, "l", "_lk"), own(right, keys_right, "r", "_rk"), "_lk", "_rk").withColumn("_n", F.when(F.coalesce(one("_lk"), one("_rk")).isNull(), F.array_intersect("_lk", "_rk")))
    return j.filter(F.col("_n").isNull() | (F.col("_k") == F.array_min("_n"))).select("l", "r", F.coalesce(F.nullif(F.size("_n"), F.lit(-1)), F.lit(1)).cast("bigint").alias("n_keys"))


def meet(left: DataFrame, right: DataFrame, keys_left: str, keys_right: str, most: int = 10_000_000) -> DataFrame:
    """Whole rows of both sides at every key ``_k`` they share, without a shuffle of pairs. A key with more than ``most`` pairs
    is cut into the cells of a square: its left rows are dealt out to rows of cells, its right rows to columns. No pair is left out."""
    a = left.withColumn("_k", F.explode(keys_left)).filter("_k is not null")
    b = right.withColumn("_k", F.explode(keys_right)).filter("_k is not null")
    n = a.groupBy("_k").agg(F.count("*").alias("a")).join(b.groupBy("_k").agg(F.count("*").alias("b")), "_k")
    hot = n.filter(F.col("a") * F.col("b") > most).select("_k", F.ceil(F.sqrt(F.col("a") * F.col("b") / most)).cast("int").alias("_n"))
    if hot.isEmpty():
        return a.hint("merge").join(b, "_k")
    hot, n = small(hot), F.coalesce("_n", F.lit(1))
    dealt = lambda id: F.pmod(F.xxhash64(id), n).cast("int")
    copies = F.explode(F.sequence(F.lit(0), n - 1))
    a = a.join(hot, "_k", "left").withColumn("_row", dealt("l")).withColumn("_column", copies).drop("_n")
    b = b.join(hot, "_k", "left").withColumn("_column", dealt("r")).withColumn("_row", copies).drop("_n")
    return a.hint("merge").join(b, ["_k", "_row", "_column"]).drop("_row", "_column")


class Postings:
    """The right rows of each token, by place, and a bit mask of the 64 most frequent tokens a row. With ``long``, a token of so many
    letters or more counts ``LONG`` besides 1."""

    LONG = 1 << 16

    def __init__(self, ids: np.ndarray, tokens: pa.ListArray, long: int | None = None):
        code = tokens.values.dictionary_encode()
        self.tokens, code = code.dictionary, code.indices.to_numpy().astype("int64")
        place = np.repeat(np.arange(len(ids), dtype="int32"), np.diff(tokens.offsets.to_numpy()))
        self.ids, self.size = ids, len(ids)
        self.often = np.bincount(code, minlength=len(self.tokens))
        self.ends = np.concatenate([[0], np.cumsum(self.often)])
        self.place = place[np.argsort(code, kind="stable")]
        hot = np.argsort(-self.often, kind="stable")[:64]
        self.bit = np.zeros(len(self.tokens), dtype="uint64")
        self.bit[hot] = np.uint64(1) << np.arange(len(hot), dtype="uint64")
        self.masks = np.zeros(self.size, dtype="uint64")
        np.bitwise_or.at(self.masks, place, self.bit[code])
        self.count = np.zeros(self.size, dtype="uint16" if long is None else "uint32")
        self.weight = np.ones(len(self.tokens), dtype=self.count.dtype)
        if long is not None:
            self.weight += (pc.utf8_length(self.tokens).to_numpy() >= long).astype("uint32") * np.uint32(self.LONG)
        self._dense: dict[int, np.ndarray] = {}

    def of(self, token: int) -> np.ndarray:
        return self.place[self.ends[token] : self.ends[token + 1]]

    def dense(self, token: int) -> np.ndarray:
        got = self._dense.get(token)
        if got is None:
            got = self._dense[token] = np.zeros(self.size, dtype=self.count.dtype)
            got[self.of(token)] = self.weight[token]
        return got

    def codes(self, tokens: pa.ListArray) -> list[np.ndarray]:
        """The tokens of each row that some right row has, the rarest first."""
        code = pc.fill_null(pc.index_in(tokens.values, value_set=self.tokens), -1).to_numpy().astype("int64")
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        row, code = row[code >= 0], code[code >= 0]
        o = np.lexsort((code, self.often[code], row))
        return np.split(code[o], np.searchsorted(row, np.arange(1, len(tokens))))

    def within(self, mine: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of the right rows from place ``first`` to before ``last`` that have any of the tokens."""
        count = self.count[first:last]
        for k in mine:
            if self.often[k] * 32 > self.size:
                count += self.dense(k)[first:last]
            else:
                own = self.of(k)
                a, b = np.searchsorted(own, (first, last))
                count[own[a:b] - first] += self.weight[k]
        found = np.flatnonzero(count)
        shared = count[found]
        count.fill(0)
        return found + first, shared

    def sharing(self, mine: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of the right rows that share at least ``least`` of the tokens. Rows that do share one of all but ``least`` - 1 of
        them; the most frequent ones are then left to the masks."""
        if len(mine) < least:
            return self.place[:0], self.count[:0]
        near, last = mine, mine[:0]
        if least > 1 and self.bit[mine[1 - least :]].all():
            near, last = mine[: 1 - least], mine[1 - least :]
        met, count = int(self.often[near].sum()), self.count
        if met * 16 < self.size:
            found = np.concatenate([self.of(k) for k in near])
            for k in near:
                count[self.of(k)] += self.weight[k]
            shared = count[found]
            count[found] = 0
        else:
            found, shared = self.within(near, 0, self.size)
        if least > 1:
            if len(last):
                masks = self.masks[found]
                shared = shared + np.bitwise_count(masks & np.bitwise_or.reduce(self.bit[last]))
                if (heavy := last[self.weight[last] > 1]).size:
                    shared = shared + np.bitwise_count(masks & np.bitwise_or.reduce(self.bit[heavy])).astype(count.dtype) * count.dtype.type(self.LONG)
            keep = (shared & (self.LONG - 1) if count.dtype == "uint32" else shared) >= least
            found, shared = found[keep], shared[keep]
        if met * 16 < self.size and len(near) > 1 and len(found) > 1:
            found, first = np.unique(found, return_index=True)
            shared = shared[first]
        return found, shared


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every batch of rows as one row: how many they are, and their compressed bytes."""
    for part in parts:
        if part.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "z"])


def _cells(parts: Iterator[pa.RecordBatch], each: Callable, made: Callable, pairs: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Of one cell, right rows first (``side`` 0, packed): what ``each(rights)`` returns is called with every batch of left rows, and yields
    (left id, value, right ids). What it yields is passed to ``made`` in lots of about ``pairs`` pairs."""
    rights, call, out, waiting = [], None, [], 0
    for part in parts:
        right, left = part.filter(pc.equal(part.column("side"), 0)), part.filter(pc.equal(part.column("side"), 1))
        for z in right.column("z"):
            rights += pa.ipc.open_stream(z.as_buffer())
        if left.num_rows and (call or rights):
            if not call:
                call = each(pa.Table.from_batches(rights).combine_chunks().to_batches()[0])
                rights = []
            for x in call(left):
                if len(x[2]):
                    out.append(x)
                    waiting += len(x[2])
                    if waiting >= pairs:
                        yield made(out)
                        out, waiting = [], 0
    if out:
        yield made(out)


def _listed(value: str) -> Callable:
    def made(out: list[tuple]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype("int32")
        r = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[2] for x in out])))
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[0] for x in out], dtype="int64")), pa.array(np.array([x[1] for x in out])), r], names=["l", value, "r"])

    return made


def in_cells(left: DataFrame, right: DataFrame, each: Callable, made: Callable, kinds: str, rows: int = 500_000) -> DataFrame:
    """What ``made`` makes (columns ``kinds``) of the pairs that ``each`` finds, of sides with an ``id`` and the same columns: right rows are in slices of
    about ``rows``, and each cell of a slice and a share of the left rows is in memory by itself. Right rows go to all cells of their slice in compressed batches."""
    scratch, cores = Scratch(left.sparkSession, "cells"), left.sparkSession.sparkContext.defaultParallelism
    a, b = scratch.write(left, "l"), scratch.write(right.mapInArrow(_packed, "n long, z binary"), "r")
    across = max(1, -(-(b.agg(F.sum("n")).first()[0] or 0) // rows))
    down = max(-(-2 * cores // across), -(-a.count() // rows), 1)
    cell = lambda row, column: (row * across + column).cast("int")
    a = a.select("*", F.lit(1).alias("side"), F.pmod(F.xxhash64("id"), F.lit(down)).alias("_row"))
    a = a.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_column")).withColumn("_b", cell(F.col("_row"), F.col("_column")))
    b = b.withColumn("_n", F.monotonically_increasing_id()).withColumn("_column", F.pmod(F.shiftright("_n", 33) + F.col("_n").bitwiseAND((1 << 33) - 1), F.lit(across)))
    b = b.select("z", F.lit(0).alias("side"), "_column", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_row")).withColumn("_b", cell(F.col("_row"), F.col("_column")))
    both = a.drop("_row", "_column").unionByName(b.drop("_row", "_column"), allowMissingColumns=True).repartitionById(down * across, "_b").sortWithinPartitions("side", "id")
    return both.mapInArrow(lambda parts: _cells(parts, each, made), kinds)


def _sharing(least: int) -> Callable:
    def each(rights: pa.RecordBatch) -> Callable:
        p = Postings(rights.column("id").to_numpy(), pa.ListArray.from_arrays(*_flat(rights.column("w"))))

        def call(lefts: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
            for l, mine in zip(lefts.column("id").to_numpy(), p.codes(pa.ListArray.from_arrays(*_flat(lefts.column("w"))))):
                found, shared = p.sharing(mine, least)
                if len(found):
                    most = int(shared.max())
                    for n in range(int(shared.min()), most + 1):
                        own = found if n == most and int(shared.min()) == most else found[shared == n]
                        yield l, n, p.ids[own]

        return call

    return each


def _alike(masks: np.ndarray) -> np.ndarray:
    """An order in which rows that have the same of the most frequent tokens are next to each other, the most frequent token first."""
    bits = np.unpackbits(masks.view("uint8").reshape(-1, 8), axis=1, bitorder="little")
    return np.argsort(np.packbits(bits, axis=1).view(">u8").ravel(), kind="stable")


def _tiled(tile: int = 512, group: int = 2_000_000) -> Callable:
    """All pairs that share a token, as arrays of right ids of one left row and number of tokens. Of a group of left rows with frequent tokens alike, those of a tile of
    such right rows follow each other, so that the same ids come again within few thousand pairs and files of them are compressed well."""

    def each(rights: pa.RecordBatch) -> Callable:
        made = lambda: Postings(rights.column("id").to_numpy(), pa.ListArray.from_arrays(*_flat(rights.column("w"))))
        rights = rights.take(pa.array(_alike(made().masks)))
        p = made()
        edges = np.arange(0, p.size + tile, tile)

        def out(rows: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            rows.sort(key=lambda x: x[1])
            base = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])])
            cuts = np.stack([np.searchsorted(x[2], edges) for x in rows]) + base[:-1, None]
            starts, many = cuts[:, :-1].T.ravel(), np.diff(cuts, axis=1).T.ravel()
            l, n = (np.tile(np.array([x[k] for x in rows], dtype="int64"), len(edges) - 1) for k in (0, 1))
            some = np.flatnonzero(many)
            starts, many = starts[some], many[some]
            at = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(base[-1])
            return l[some], n[some], p.ids[np.concatenate([x[2] for x in rows])[at]], many

        def call(lefts: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            ids, codes = lefts.column("id").to_numpy(), p.codes(pa.ListArray.from_arrays(*_flat(lefts.column("w"))))
            rows, waiting = [], 0
            for k in _alike(np.array([np.bitwise_or.reduce(p.bit[mine], initial=np.uint64(0)) for mine in codes], dtype="uint64")):
                if not len(codes[k]):
                    continue
                found, shared = p.sharing(codes[k], 1)
                for n in range(int(shared.min()), int(shared.max()) + 1):
                    rows.append((ids[k], n, found[shared == n]))
                waiting += len(found)
                if waiting >= group:
                    yield out(rows)
                    rows, waiting = [], 0
            if rows:
                yield out(rows)

        return call

    return each


def _tiles(out: list[tuple]) -> pa.RecordBatch:
    l, n, r, many = (np.concatenate([x[k] for x in out]) for k in range(4))
    ends = np.concatenate([[0], np.cumsum(many)]).astype("int32")
    return pa.RecordBatch.from_arrays([pa.array(l), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(r))], names=["l", "n_keys", "r"])


def _flat(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Offsets from 0 and the values they are in, whatever the array is a slice of."""
    ends = lists.offsets.to_numpy()
    return pa.array(ends - ends[0]), lists.flatten()


def token_pairs(left: DataFrame, right: DataFrame, tokens: str, least: int = 1, shortest: int = 3, on: str = "id", rows: int = 500_000) -> DataFrame:
    """(l, r, n_keys) of the pairs that share at least ``least`` tokens of ``shortest`` letters or more; no token is left out, however frequent.

    Shared tokens are counted in memory, a slice of the right side at a time. With ``least`` above 1 the most frequent tokens of a row, ``least`` - 1
    of them, find no rows and are only counted. The result grows with the square of the rows that share tokens.
    """
    mine = F.filter(F.array_distinct(F.array_compact(tokens)), lambda t: F.length(t) >= shortest)
    l, r = (x.select(F.col(on).alias("id"), mine.alias("w")).filter(F.size("w") >= least) for x in (left, right))
    each, made = (_tiled(), _tiles) if least == 1 else (_sharing(least), _listed("n_keys"))
    return in_cells(l, r, each, made, "l long, n_keys long, r array<long>", rows).select("l", F.explode("r").alias("r"), "n_keys")


def near_days(day: Column, reach: int = 1) -> Column:
    """Keys of a band join: the days within ``reach`` of a day. Explode on one side only."""
    return F.sequence(F.date_sub(day, reach), F.date_add(day, reach), F.expr("interval 1 day"))


def near_months(day: Column, reach: int = 1) -> Column:
    """Month numbers (year * 12 + month) within ``reach`` of a day's month."""
    m = F.year(day) * 12 + F.month(day)
    return F.sequence(m - reach, m + reach)


def period_keys(day: Column, kind: Column) -> Column:
    """Keys under which a period meets the compatible ones: a month its month, quarter and year; a quarter its months,
    itself and its year; a year all of its own."""
    y, m, q = F.year(day), F.month(day), F.quarter(day)
    month, quarter, year = F.format_string("%04d-%02d", y, m), F.format_string("%04d-Q%d", y, q), F.format_string("%04d", y)
    months = lambda a, b: F.transform(F.sequence(a, b), lambda i: F.format_string("%04d-%02d", y, i))
    quarters = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.format_string("%04d-Q%d", y, i))
    return (
        F.when(kind == "month", F.array(month, quarter, year))
        .when(kind == "quarter", F.concat(F.array(quarter, year), months(q * 3 - 2, q * 3)))
        .when(kind == "year", F.concat(F.array(year), quarters, months(F.lit(1), F.lit(12))))
    )


def with_fallback(first: DataFrame, left: DataFrame, second: DataFrame, on: str = "id") -> DataFrame:
    """The pairs of ``first``; for left rows that have none there, those of ``second``."""
    alone = left.select(F.col(on).alias("l")).join(first.select("l").distinct(), "l", "left_anti")
    return first.select("l", "r").unionByName(second.join(alone, "l", "left_semi").select("l", "r"))


def key_join_or(left: DataFrame, right: DataFrame, keys: str, others: str, on: str = "id") -> DataFrame:
    """(l, r) that share one of ``keys``; for left rows that share none with any right row, those that share one of ``others``. Which rows
    those are is seen from the keys alone, before any pair is made."""
    scratch = Scratch(left.sparkSession, "keys")
    l, r = (scratch.write(x.select(on, *[F.array_compact(F.array_distinct(c)).alias(c) for c in (keys, others)]), "side") for x in (left, right))
    there = r.select(F.explode(keys).alias("_k")).distinct()
    met = l.select(on, F.explode(keys).alias("_k")).join(there, "_k", "left_semi").select(on).distinct()
    alone = scratch.write(l.join(met, on, "left_anti"), "alone")
    first, second = key_join(l, r, F.col(keys), F.col(keys), on), key_join(alone, r, F.col(others), F.col(others), on)
    return first.select("l", "r").unionByName(second.select("l", "r"))


def cap_per(pairs: DataFrame, side: str, cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` pairs of every left (or right) row in the order given. Ranks are limited before the
    shuffle, so a row with many candidates sends only its best."""
    w = Window.partitionBy(side).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def _subsets(words: str) -> Column:
    """(key, n) of every set of one or more of the words, which are in one order in all rows."""
    none = F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("n")))
    grown = lambda acc, w: F.transform(acc, lambda x: F.struct(F.concat(x["key"], F.lit("\x01"), w).alias("key"), (x["n"] + 1).alias("n")))
    return F.slice(F.aggregate(words, none, lambda acc, w: F.concat(acc, grown(acc, w))), 2, 1 << 30)


def _nearest(lefts: pd.DataFrame, rights: pd.DataFrame, n: int, rows: int = 20_000) -> pd.DataFrame:
    """For every left row the ``n`` right rows of its key that are nearest in time, then those without a time (all of them, where the left
    row has none), the smaller id first among equals. ``apart`` is -1 where a time is missing."""
    code, keys = pd.factorize(rights["key"])
    rc, rr, rt, rnone = np.asarray(code, dtype="int64"), rights["r"].to_numpy("int64"), rights["t"].to_numpy("int64"), rights["none"].to_numpy(bool)
    at = keys.get_indexer(lefts["key"])
    lefts, lc = lefts[at >= 0], at[at >= 0].astype("int64")
    ll, lt, lnone, ln = lefts["l"].to_numpy("int64"), lefts["t"].to_numpy("int64"), lefts["none"].to_numpy(bool), lefts["n"].to_numpy("int64")
    times = np.unique(np.concatenate([rt, lt]))
    size = len(times) + 1
    ri, li = np.searchsorted(times, rt), np.searchsorted(times, lt)

    def ordered(own: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = rc[own] * size + rank[own]
        o = np.lexsort((rr[own], place))
        return own[o], place[o]

    told, untold, zero = np.flatnonzero(~rnone), np.flatnonzero(rnone), np.zeros(len(rc), dtype="int64")
    on, back, without, every = ordered(told, ri), ordered(told, size - 1 - ri), ordered(untold, zero), ordered(np.arange(len(rc)), zero)
    out = []
    for a in range(0, len(ll), rows):
        part = slice(a, a + rows)
        c, i, no, end = lc[part], li[part], lnone[part], (lc[part] + 1) * size
        found, live, sort = [], [], []
        starts = ((on, c * size + i, "left", 0, ~no), (back, c * size + size - 1 - i, "right", 0, ~no), (without, c * size, "left", 1, ~no), (every, c * size, "left", 1, no))
        for (own, place), key, how, rank, wanted in starts:
            first, last = np.searchsorted(place, key, how), np.searchsorted(place, end, "left")
            spot = first[:, None] + np.arange(n)
            live.append((spot < last[:, None]) & wanted[:, None])
            found.append(own[np.minimum(spot, len(own) - 1)] if len(own) else np.zeros(spot.shape, dtype="int64"))
            sort.append(np.full(spot.shape, rank))
        found, live, sort = np.hstack(found), np.hstack(live), np.where(np.hstack(live), np.hstack(sort), 2)
        apart = np.where(sort == 0, np.abs(rt[found] - lt[part][:, None]), -1)
        best = np.lexsort((rr[found], apart, sort), axis=-1)[:, :n]
        take = lambda x: np.take_along_axis(x, best, 1)
        ok = take(live)
        many = ok.sum(1)
        out.append(pd.DataFrame({"l": np.repeat(ll[part], many), "r": rr[take(found)[ok]], "n_keys": np.repeat(ln[part], many), "apart": take(apart)[ok]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype="int64") for c in ("l", "r", "n_keys", "apart")})


def nearest_sharing(left: DataFrame, right: DataFrame, words: str, time: str, n: int, on: str = "id", most: int = 5, rows: int = 400_000) -> DataFrame:
    """(l, r, n_keys, apart, rank): of each left row the ``n`` right rows that share most words with it, then those nearest in ``time`` (a
    number; unknown distances last), then by id. Exact, and pairs are not enumerated.

    Each set of words of a row is a key, and of a left row and key only the ``n`` nearest right rows are made: a pair that shares exactly
    the set S and is not among the n nearest that have S comes after n others, which share S or more. Rows of more than ``most`` words have too
    many sets and are joined word by word.
    """
    scratch = Scratch(left.sparkSession, "nearest")

    def side(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        x = rows.select(F.col(on).alias(name), F.col(time).cast("bigint").alias("t"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("w")).filter(F.size("w") > 0)
        x = scratch.write(x, name)
        return x, x.filter(F.size("w") > most)

    (l, l_long), (r, r_long) = side(left, "l"), side(right, "r")
    buckets = max(12, l.sparkSession.sparkContext.defaultParallelism * 2, (l.count() + r.count()) // rows)
    few = lambda x, *own: x.filter(F.size("w") <= most).select(*own, F.coalesce("t", F.lit(0)).alias("t"), F.col("t").isNull().alias("none"), F.inline(_subsets("w"))).withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = few(l, "l").groupBy("_b").cogroup(few(r, "r").groupBy("_b")).applyInPandas(lambda a, b: _nearest(a, b, n), "l long, r long, n_keys long, apart long")
    for a, b in ((l_long, r), (l.filter(F.size("w") <= most), r_long)):
        if not (a.isEmpty() or b.isEmpty()):
            x, y = a.select("l", F.col("t").alias("ta"), F.explode("w").alias("k")), b.select("r", F.col("t").alias("tb"), F.explode("w").alias("k"))
            far = x.join(y, "k").groupBy("l", "r").agg(F.count("*").alias("n_keys"), F.min(F.abs(F.col("ta") - F.col("tb"))).alias("apart"))
            found = found.unionByName(far.withColumn("apart", F.coalesce("apart", F.lit(-1).cast("bigint"))))
    pairs = found.repartition("l").groupBy("l", "r").agg(F.max("n_keys").alias("n_keys"), F.max("apart").alias("apart")).withColumn("apart", F.nullif("apart", F.lit(-1).cast("bigint")))
    return cap_per(pairs, "l", n, F.col("n_keys").desc(), F.col("apart").asc_nulls_last(), F.col("r"))


def _postings(rows: pd.Series) -> tuple[pd.Index, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, token of each entry, row of each entry, entries a row) of arrays of distinct tokens."""
    many = rows.map(len).to_numpy("int64")
    code, tokens = pd.factorize(np.concatenate([np.asarray(x, dtype=object) for x in rows]) if many.sum() else np.zeros(0, dtype=object))
    return tokens, np.asarray(code, dtype="int64"), np.repeat(np.arange(len(rows)), many), many


def _most_shared(lefts: pd.DataFrame, rights: pd.DataFrame, n: int, bits: int = 62) -> pd.DataFrame:
    """For every left row the ``n`` right rows that share most tokens with it, the smaller id first among equals.

    A left row first meets right rows by its rarer tokens only; those it shares of the ``bits`` most frequent ones are read from a bit
    mask. A row met by frequent tokens alone shares at most as many as there are: if the n-th best has more, none of those matters;
    else the row is looked up by all of its tokens.
    """
    rights = rights.sort_values("r", kind="stable")  # places in order of ids
    tokens, code, place, _ = _postings(rights["w"])
    ids, size = rights["r"].to_numpy("int64"), len(rights)
    often = np.bincount(code, minlength=len(tokens))
    posted = np.split(place[np.argsort(code, kind="stable")].astype("int32"), np.cumsum(often)[:-1]) if len(tokens) else []
    hot = np.argsort(-often, kind="stable")[:bits]
    bit = np.zeros(len(tokens), dtype="uint64")
    bit[hot] = np.uint64(1) << np.arange(len(hot), dtype="uint64")
    masks = np.zeros(size, dtype="uint64")
    np.bitwise_or.at(masks, place, bit[code])
    number = {t: k for k, t in enumerate(tokens)}

    def best(found: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(found) > n:  # places rise with ids, so among equals the first are wanted
            least = np.partition(shared, len(shared) - n)[len(shared) - n]
            more, same = np.flatnonzero(shared > least), np.flatnonzero(shared == least)
            keep = np.concatenate([more, same[: n - len(more)]])
            found, shared = found[keep], shared[keep]
        o = np.lexsort((found, -shared))
        return found[o], shared[o]

    known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
    out_l, out_r, out_n = [], [], []
    for l, own in zip(lefts["l"].to_numpy("int64"), lefts["w"]):
        mine = sorted((number[t] for t in own if t in number), key=lambda k: (often[k], k))
        got = known.get(key := tuple(mine))
        if got is None:
            cold, warm = [k for k in mine if not bit[k]], [k for k in mine if bit[k]]
            got = (np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))
            for used in range(len(warm) + 1):  # the rarest of the frequent ones join in as long as what is left could matter
                near = cold + warm[:used]
                left_out = len(warm) - used
                if near and (left_out == 0 or sum(often[k] for k in near) > 0):
                    met = np.concatenate([posted[k] for k in near])
                    if len(met) * 8 > size:
                        shared = np.bincount(met, minlength=size)
                        found = np.flatnonzero(shared)
                        shared = shared[found]
                    else:
                        found, shared = np.unique(met, return_counts=True)
                    if left_out:
                        rest = np.bitwise_or.reduce(bit[warm[used:]])
                        shared = shared + np.bitwise_count(masks[found] & rest)
                    found, shared = best(found, shared)
                    if left_out == 0 or len(found) == n and shared[-1] > left_out:
                        got = (ids[found], shared)
                        break
            if len(known) > 50_000:
                known.clear()
            known[key] = got
        out_l.append(np.full(len(got[0]), l))
        out_r.append(got[0])
        out_n.append(got[1])
    some = lambda x: np.concatenate(x).astype("int64") if x else np.zeros(0, dtype="int64")
    return pd.DataFrame({"l": some(out_l), "r": some(out_r), "n_keys": some(out_n)})


def _numbered(left: DataFrame, right: DataFrame, rows: int, on: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with a column ``_b``, and the number of cells: every left row meets every right row in exactly one of the cells that it
    numbers. Right rows are in slices of about ``rows``; left rows are dealt out so that there are at least four cells a core."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-right.count() // rows))
    down = max(-(-4 * cores // across), -(-left.count() // rows), 1)
    a = left.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: F.pmod(F.xxhash64(on), F.lit(down)) * across + i)))
    b = right.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: i * across + F.pmod(F.xxhash64(on), F.lit(across)))))
    return a, b, down * across


def dealt(left: DataFrame, right: DataFrame, rows: int = 200_000, on: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both sides in partitions by cells of which each left row shares exactly one with each right row."""
    a, b, n = _numbered(left, right, rows, on)
    return a.repartition(n, "_b"), b.repartition(n, "_b")


def most_sharing(left: DataFrame, right: DataFrame, tokens: str, n: int, shortest: int = 3, on: str = "id", rows: int = 200_000) -> DataFrame:
    """(l, r, n_keys, rank): of each left row the ``n`` right rows that share most tokens of ``shortest`` letters or more, the smaller id
    first among equals. Exact; pairs are counted in memory, a slice of the right side at a time, and only the best of each slice leave it."""
    scratch = Scratch(left.sparkSession, "tokens")
    mine = F.filter(F.array_distinct(F.array_compact(tokens)), lambda t: F.length(t) >= shortest)
    l, r = (scratch.write(x.select(F.col(on).alias(k), mine.alias("w")).filter(F.size("w") > 0), k) for x, k in ((left, "l"), (right, "r")))
    a, b = dealt(l.withColumnRenamed("l", "id"), r.withColumnRenamed("r", "id"), rows)
    a, b = a.withColumnRenamed("id", "l"), b.withColumnRenamed("id", "r")
    found = a.groupBy("_b").cogroup(b.groupBy("_b")).applyInPandas(lambda x, y: _most_shared(x, y, n), "l long, r long, n_keys long")
    return cap_per(found, "l", n, F.col("n_keys").desc(), F.col("r"))
