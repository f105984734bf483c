"""Filling containers of fixed capacity with items: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import base64
import bisect
import os
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import Scratch, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE splits a text before it merges bytes.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER, split: str = SPLIT):
    """Text -> token ids, from a file of ranks (base64 bytes and a number a line) or a tokenizers JSON file. The names of
    special tokens in a text are ordinary text."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, split: str = SPLIT) -> DataFrame:
    """(doc_id, tokens) of every document's whole text; null and empty texts have none. ``tokenizer`` is the path
    of a public tokenizer's file, which every executor must be able to read."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, split)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": [len(encode(t)) if isinstance(t, str) and t else 0 for t in part["text"]]})

    docs = documents.select(F.col("doc_id").cast("long"), "text")
    return spread(docs, "doc_id").mapInPandas(count, "doc_id long, tokens long")


@dataclass
class Packing:
    """Bins of item numbers, with what each holds."""

    bins: list[list[int]]
    load: list[int]

    def fitness(self, capacity: int) -> float:
        """Mean squared fill: fewer bins, and of as many those that are filled most unevenly, count as better."""
        return sum((x / capacity) ** 2 for x in self.load) / max(1, len(self.load))


def best_fit(sizes: list[int], items: list[int], capacity: int, bins: list[list[int]], load: list[int]) -> Packing:
    """Put the items, in the order given, each into the fullest bin that has room, opening bins as needed."""
    order = sorted(range(len(bins)), key=lambda b: capacity - load[b])
    rooms = [capacity - load[b] for b in order]
    for i in items:
        s = sizes[i]
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            bins.append([i])
            load.append(s)
            b, room = len(bins) - 1, capacity - s
        else:
            b, room = order.pop(at), rooms.pop(at) - s
            bins[b].append(i)
            load[b] += s
        at = bisect.bisect_left(rooms, room)
        rooms.insert(at, room)
        order.insert(at, b)
    return Packing(bins, load)


def refill(sizes: list[int], capacity: int, bins: list[list[int]], load: list[int], loose: list[int], rnd: random.Random, tries: int = 12) -> list[int]:
    """Exchange one or two items of a bin for one or two loose ones that fill it better, bin by bin; returns what is loose then.
    The loose items only get smaller, so they are put back the more easily."""
    loose = sorted(loose, key=lambda i: sizes[i])
    for b in rnd.sample(range(len(bins)), len(bins)):
        room = capacity - load[b]
        if not room or not loose:
            continue
        own = rnd.sample(bins[b], min(tries, len(bins[b])))
        outs = [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[:k]]
        have, best = [sizes[i] for i in loose], (0, (), ())
        for out in outs:
            gone = sum(sizes[i] for i in out)
            most = gone + room
            k = bisect.bisect_right(have, most) - 1
            if k >= 0 and have[k] - gone > best[0]:
                best = (have[k] - gone, out, (k,))
            x, y = 0, len(have) - 1
            while x < y:  # the pair that comes nearest from below
                got = have[x] + have[y]
                if got > most:
                    y -= 1
                else:
                    if got - gone > best[0]:
                        best = (got - gone, out, (x, y))
                    x += 1
            if best[0] == room:
                break
        gain, out, into = best
        if gain > 0:
            new = [loose[k] for k in into]
            bins[b] = [i for i in bins[b] if i not in out] + new
            load[b] += gain
            loose = sorted([i for i in loose if i not in new] + list(out), key=lambda i: sizes[i])
    return loose


def settle(sizes: list[int], capacity: int, bins: list[list[int]], load: list[int], loose: list[int], rnd: random.Random) -> Packing:
    """Put loose items back: first in exchange for smaller ones, as long as that helps, then by best fit, largest first."""
    for _ in range(3):
        before, loose = sorted(loose), refill(sizes, capacity, bins, load, loose, rnd)
        if sorted(loose) == before:
            break
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, bins, load)


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rnd: random.Random) -> Packing:
    """Inject whole, well-filled bins of ``b`` into ``a``: bins of ``a`` that share an item with them are dissolved, and
    their other items are put back."""
    n = max(1, int(len(b.bins) * rnd.uniform(0.1, 0.5)))
    picked = sorted(rnd.sample(range(len(b.bins)), min(len(b.bins), 2 * n)), key=lambda x: -b.load[x])[:n]
    bins, load, taken, loose = [], [], set(), []
    for x in picked:
        bins.append(list(b.bins[x]))
        load.append(b.load[x])
        taken.update(b.bins[x])
    for x, own in enumerate(a.bins):
        if taken.isdisjoint(own):
            bins.append(list(own))
            load.append(a.load[x])
        else:
            loose += [i for i in own if i not in taken]
    return settle(sizes, capacity, bins, load, loose, rnd)


def mutate(p: Packing, sizes: list[int], capacity: int, rnd: random.Random) -> Packing:
    """Dissolve the emptiest bin and a few others, and put their items back."""
    if len(p.bins) < 2:
        return p
    worst = sorted(range(len(p.bins)), key=lambda x: p.load[x])[: rnd.randint(1, 3)]
    gone = {*worst, *rnd.sample(range(len(p.bins)), min(len(p.bins), rnd.randint(1, 4)))}
    loose = [i for x in gone for i in p.bins[x]]
    rest = [x for x in range(len(p.bins)) if x not in gone]
    return settle(sizes, capacity, [list(p.bins[x]) for x in rest], [p.load[x] for x in rest], loose, rnd)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer: what the items fill together, or the items of which no two fit into one."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def decreasing(sizes: list[int], capacity: int) -> Packing:
    return best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity, [], [])


def evolve(sizes: list[int], capacity: int, seeds: list[Packing], rnd: random.Random, population: int, generations: int) -> list[Packing]:
    """Best packings first, from a population of the seeds, best fit decreasing, and best fit in random orders."""
    items = list(range(len(sizes)))
    pool = list(seeds) or [decreasing(sizes, capacity)]
    least = least_bins(sizes, capacity)
    while len(pool) < population:
        jittered = sorted(items, key=lambda i: -sizes[i] * rnd.uniform(0.7, 1.3))
        pool.append(best_fit(sizes, jittered, capacity, [], []))
    key = lambda p: (len(p.bins), -p.fitness(capacity))
    pool.sort(key=key)
    for _ in range(generations):
        if len(pool[0].bins) <= least:
            break
        young = []
        for _ in range(population // 2):
            a, b = (min(rnd.sample(range(len(pool)), min(2, len(pool)))) for _ in range(2))
            child = cross(pool[a], pool[b], sizes, capacity, rnd) if a != b else mutate(pool[a], sizes, capacity, rnd)
            young.append(mutate(child, sizes, capacity, rnd) if rnd.random() < 0.5 else child)
        pool = sorted(pool + young, key=key)[:population]
    return pool


def _packing(of_item: list[int], sizes: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(of_item, default=-1) + 1)]
    load = [0] * len(bins)
    for i, b in enumerate(of_item):
        bins[b].append(i)
        load[b] += sizes[i]
    return Packing(bins, load)


_ELITE = "shard long, island int, place int, n_bins int, least int, fitness double, bin array<int>"


def _epoch(groups: DataFrame, capacity: int, seed: int, epoch: int, population: int, generations: int, elites: int) -> DataFrame:
    """One row per (shard, island) with sizes and the packings that start it -> its ``elites`` best packings. Without
    generations: best fit decreasing alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for shard, island, sizes, starts in zip(part["shard"], part["island"], part["sizes"], part["starts"]):
                sizes = [int(s) for s in sizes]
                rnd = random.Random(f"{seed}/{epoch}/{shard}/{island}")
                seeds = [_packing([int(b) for b in s], sizes) for s in (starts if starts is not None else [])]
                found = evolve(sizes, capacity, seeds, rnd, population, generations)[:elites] if generations else [decreasing(sizes, capacity)]
                for place, p in enumerate(found):
                    of_item = [0] * len(sizes)
                    for b, own in enumerate(p.bins):
                        for i in own:
                            of_item[i] = b
                    out.append((shard, island, place, len(p.bins), least_bins(sizes, capacity), p.fitness(capacity), of_item))
            yield pd.DataFrame(out, columns=["shard", "island", "place", "n_bins", "least", "fitness", "bin"])

    return groups.mapInPandas(run, _ELITE)


def pack(
    items: DataFrame, capacity: int, seed: int = 11, shard_items: int = 2_000, islands: int = 3, epochs: int = 3,
    population: int = 8, generations: int = 16, elites: int = 2, full: float = 0.995, levels: int = 3,
) -> DataFrame:
    """Assign documents (doc_id, tokens) to containers: (doc_id, piece, start, tokens, container_id).

    A document larger than the capacity is divided: as many whole containers as it fills, and its rest as an
    item. Items are dealt into shards of about ``shard_items`` by hash and packed by best fit decreasing. Where that needs
    no more containers than :func:`least_bins`, nothing can be better and the shard is done. Every other shard evolves on ``islands``
    islands at once; after each epoch an island's best packings stay and travel to the next island of the ring, until the bound
    is reached or the epochs are over. Of the best packing of a shard the containers at least ``full`` full are final; the items of the others are dealt out
    anew over fewer shards, up to ``levels`` times. So a task holds one shard however many documents there are.

    Every row is assigned, documents without tokens too (they take no room); a null tokens reads as 0, negative ones as 0.
    Repeated and null doc_ids are items of their own. An empty table gives an empty one. ``capacity`` must be positive.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    docs = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    docs = scratch.write(docs.withColumn("rid", F.monotonically_increasing_id()), "documents")
    whole = F.expr(f"tokens div {capacity}")
    big = docs.filter(F.col("tokens") > capacity).withColumn("n", whole)
    divided = big.select("doc_id", "rid", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("tokens"),
        F.concat_ws("-", F.lit("w"), "rid", "piece").alias("container_id"),
    )
    large = F.col("tokens") > capacity
    rest = docs.select(
        "rid", "doc_id", F.when(large, whole).otherwise(0).cast("int").alias("piece"), F.when(large, whole * capacity).otherwise(0).cast("long").alias("start"),
        F.when(large, F.col("tokens") % capacity).otherwise(F.col("tokens")).cast("long").alias("tokens"), large.alias("large"),
    ).filter("not (large and tokens = 0)").drop("large")
    done = [divided]
    for level in range(levels):
        count = rest.count()
        if not count:
            break
        shards = max(1, -(-count // shard_items))
        last = level == levels - 1 or shards == 1
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(seed + level)), F.lit(shards)).cast("long"))
        row = F.struct("rid", "doc_id", "piece", "start", "tokens")
        groups = scratch.write(dealt.groupBy("shard").agg(F.array_sort(F.collect_list(row)).alias("rows")), "groups")
        sizes = groups.select("shard", F.col("rows.tokens").alias("sizes"))
        few = lambda df, n: df.repartition(min(n, max(4 * spark.sparkContext.defaultParallelism, n // 8)), "shard", "island")
        none = F.lit(None).cast("array<array<int>>").alias("starts")
        best = scratch.write(_epoch(few(sizes.withColumn("island", F.lit(0)).select("*", none), shards), capacity, seed, 0, 1, 0, 1), "first")
        ready = [best.filter("n_bins <= least") if epochs else best]
        for epoch in range(epochs):
            unready = best.groupBy("shard").agg(F.min("n_bins").alias("n"), F.max("least").alias("l")).filter("n > l").select("shard")
            unready = scratch.write(sizes.join(unready, "shard"), "unready")
            count = unready.count()
            if not count:
                scratch.drop(unready)
                break
            base = few(unready.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))), count * islands)
            if not epoch:
                starts = base.select("*", none)
            else:
                moved = best.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "bin").filter(F.lit(islands > 1))
                known = best.select("shard", "island", "bin").unionByName(moved).groupBy("shard", "island").agg(F.collect_list("bin").alias("starts"))
                starts = base.join(known, ["shard", "island"])
            now = scratch.write(_epoch(starts, capacity, seed + level, epoch, population, generations, elites), "elites")
            scratch.drop(unready)
            ready.append(now if epoch == epochs - 1 else now.filter("n_bins <= least"))
            best = now
        best = reduce(DataFrame.unionByName, ready)
        top = best.groupBy("shard").agg(F.min(F.struct("n_bins", -F.col("fitness"), "island", "place", "bin")).getField("bin").alias("bin"))
        placed = groups.join(top, "shard").select("shard", F.explode(F.arrays_zip("rows", "bin")).alias("x")).select("shard", "x.rows.*", F.col("x.bin").alias("bin"))
        placed = scratch.write(placed, "placed")
        scratch.drop(groups)
        name = F.concat_ws("-", F.lit(str(level)), "shard", "bin").alias("container_id")
        out = ("doc_id", "piece", "start", "tokens")
        if last:
            done.append(placed.select(*out, name))
            break
        loads = placed.groupBy("shard", "bin").agg((F.sum("tokens") >= full * capacity).alias("is_full"))
        marked = placed.join(loads, ["shard", "bin"])
        done.append(marked.filter("is_full").select(*out, name))
        rest = scratch.write(marked.filter("not is_full").select("rid", *out), "rest")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
