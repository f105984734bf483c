"""Evaluation passages inside training text: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache, reduce
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import byte_of, utf8_reader
from tessera.shared import Scratch, spread

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_ENTITY = re.compile(r"&#?\w{1,10};")
_APOSTROPHES = "'’‘`´"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_GROUPED = re.compile(r"(\d)[-.,\u00a0\u202f\u2009](?=\d)")
_HYPHEN = re.compile(r"-\n\s*(?=[a-zß-ÿ])")
_WORDS = re.compile(r"[^\W_]+")
_HOLED = re.compile("[^\\W_]+(?:\ufffd+[^\\W_]*)*|\ufffd+[^\\W_]+(?:\ufffd+[^\\W_]*)*")
_ASCII = re.compile(r"[^a-z0-9]")
_PLAIN = re.compile(r"[¡-ſ‐-⁞€°™]+\Z")
_DAMAGE = ("cp1252", "cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")


@cache
def _maybe_damaged() -> re.Pattern:
    """A character that may be the first of a UTF-8 character read in one of the encodings, and one that may follow it."""
    pairs = []
    for enc in dict.fromkeys(_DAMAGE):
        table = byte_of(enc)
        lead, cont = ("[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]" for lo, hi in ((0xC2, 0xE3), (0x80, 0xBF)))
        pairs.append(lead + cont)
    return re.compile("|".join(pairs))


def _mended(text: str) -> str:
    """Runs that read as one common Western character in UTF-8 replaced by it; good enough to compare words."""
    if not _maybe_damaged().search(text):
        return text
    for enc in _DAMAGE:
        text = utf8_reader(enc, _PLAIN)(text)
    return text


def words(text: str | None) -> tuple[list[str], list[str]]:
    """The words of a text in two forms, without letter case, punctuation, markup and line breaks.

    In the first form accents are removed; in the second every character above ASCII is, so that a word whose
    accents are damaged beyond repair still equals its original. Words of a script without ASCII keep their first
    form in both. Null gives no words.
    """
    if not text:
        return [], []
    if not text.isascii():
        text = _mended(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    text = text.lower()
    for c in _APOSTROPHES:
        if c in text:
            text = text.replace(c, "")
    text = _GROUPED.sub(r"\1", text)
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        found = _WORDS.findall(text)
        return found, found
    for c in _INVISIBLE:
        if c in text:
            text = text.replace(c, "")
    found = (_HOLED if "\ufffd" in text else _WORDS).findall(unicodedata.normalize("NFC", text))
    both = [(w, w) if w.isascii() else _forms(w) for w in found]
    return [a for a, _ in both], [b for _, b in both]


@lru_cache(maxsize=200_000)
def _forms(word: str) -> tuple[str, str]:
    first = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return first, _ASCII.sub("", word) or first


def _number(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def align(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], match: float = 2.0, mismatch: float = -1.0, gap: float = -0.7) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers in two forms: (words carried, first and last doc word of the best local alignment).
    Words that are the same are carried. A few changed ones are too: those of a stretch in which words are aligned with others, if
    it is shorter than both runs of equal words beside it, and in all at most one for every five equal words."""
    (ia, ib), (da, db) = item, doc
    m, n = len(ia), len(da)
    if not m or not n:
        return 0, 0, 0
    h = np.zeros((m + 1, n + 1))
    slope = gap * np.arange(n + 1)
    same = (ia[:, None] == da[None, :]) | (ib[:, None] == db[None, :])
    step = np.where(same, match, mismatch)
    for i in range(1, m + 1):
        row = np.maximum(h[i - 1] + gap, 0.0)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + step[i - 1])
        h[i] = np.maximum.accumulate(row - slope) + slope
    i, j = divmod(int(h.argmax()), n + 1)
    last, first, steps = j - 1, j - 1, []
    while i > 0 and j > 0 and h[i, j] > 1e-9:
        if abs(h[i, j] - (h[i - 1, j - 1] + step[i - 1, j - 1])) < 1e-9:
            i, j, first = i - 1, j - 1, j - 1
            steps.append(bool(same[i, j]))
        elif abs(h[i, j] - (h[i - 1, j] + gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    runs = [(equal, sum(1 for _ in run)) for equal, run in groupby(steps)]  # the first and last are equal: a best alignment ends in matches
    equal = sum(n for e, n in runs if e)
    changed = sum(n for k, (e, n) in enumerate(runs) if not e and 0 < k < len(runs) - 1 and n < min(runs[k - 1][1], runs[k + 1][1]))
    return equal + min(changed, equal // 5), first, last


@dataclass
class Items:
    """A block of test items: their words as numbers, and their n-gram seeds with the places they stand in."""

    n: int
    ids: list[int] = field(default_factory=list)
    forms: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    seeds: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    grams: dict[tuple[str, ...], int] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], n: int = 3) -> Items:
        out, seeds = cls(n), defaultdict(list)
        for item_id, passage in rows:
            first, second = words(passage)
            if not first:
                continue
            k = len(out.ids)
            out.ids.append(item_id)
            out.forms.append((np.array([_number(w) for w in first]), np.array([_number(w) for w in second])))
            for p in range(max(1, len(first) - n + 1)):
                for form in {tuple(first[p : p + n]), tuple(second[p : p + n])}:
                    seed = out.grams[form] = _number(" ".join(form))
                    seeds[seed].append((k, p))
        out.seeds = dict(seeds)
        return out

    def hits(self, first: list[str], second: list[str]) -> dict[int, list[int]]:
        """Places in the document of each seed that occurs in it, in either form."""
        out: dict[int, list[int]] = {}
        grams = self.grams
        for form in (first, second) if second != first else (first,):
            for size in self.sizes:
                runs = [form[k:] for k in range(size)]
                if grams.keys().isdisjoint(zip(*runs)):
                    continue
                for p, gram in enumerate(zip(*runs)):
                    if gram in grams:
                        out.setdefault(grams[gram], []).append(p)
        return out

    @cached_property
    def sizes(self) -> list[int]:
        """Lengths of the seeds: ``n``, and those of items that are shorter."""
        return sorted({len(g) for g in self.grams})

    def rare(self, frequency: dict[int, int], most: int, items: int = 2) -> Items:
        """Without common seeds: those in more than ``most`` texts or more than ``items`` items, unless they are in the
        rarer half of some item's own."""
        spread = {s: len({k for k, _ in places}) for s, places in self.seeds.items()}
        keep = {s for s in self.seeds if frequency.get(s, 0) <= most and spread[s] <= items}
        own = defaultdict(list)
        for s, places in self.seeds.items():
            for k in {k for k, _ in places}:
                own[k].append(s)
        for seeds in own.values():
            seeds.sort(key=lambda s: (spread[s], frequency.get(s, 0), s))
            keep.update(seeds[: (len(seeds) + 1) // 2])
        return Items(self.n, self.ids, self.forms, {s: p for s, p in self.seeds.items() if s in keep}, {g: s for g, s in self.grams.items() if s in keep})

    @cached_property
    def early(self) -> tuple[set[int], dict[int, float]]:
        """What can be told before frequencies are known: seeds that may turn out rare, and for each item the fewest places
        with a rare seed that it can be left with. Seeds are ranked by the items they are in before their frequency, so the rarer
        half of an item's seeds is among those in no more items than the one in the middle."""
        spread = {s: len({k for k, _ in places}) for s, places in self.seeds.items()}
        own = defaultdict(list)
        for s, places in self.seeds.items():
            for k in {k for k, _ in places}:
                own[k].append(spread[s])
        middle = {k: sorted(v)[(len(v) + 1) // 2 - 1] for k, v in own.items()}
        maybe = {s for s, places in self.seeds.items() if any(spread[s] <= max(2, middle[k]) for k, _ in places)}
        return maybe, {k: (len(v) + 1) // 2 / 2 for k, v in own.items()}

    def possible(self, found: dict[int, list[int]], seeded: float) -> bool:
        """Whether the seeds found in a text can make any item worth aligning."""
        maybe, fewest = self.early
        places: dict[int, set[int]] = {}
        for s in found:
            if s in maybe:
                for k, p in self.seeds[s]:
                    places.setdefault(k, set()).add(p)
        return any(len(ps) >= seeded * fewest[k] for k, ps in places.items())

    @cached_property
    def own(self) -> dict[int, int]:
        """Number of places of each item at which a seed stands."""
        out: dict[int, set[int]] = defaultdict(set)
        for places in self.seeds.values():
            for k, p in places:
                out[k].add(p)
        return {k: len(ps) for k, ps in out.items()}

    def leaks(self, text: str | None, share: float, seeded: float) -> list[tuple[int, int, int, int, int]]:
        """(item_id, matched words, item words, first, last word in the document) of the items the text carries.

        Only items of which a share ``seeded`` of the seeds stands in one place of the text are aligned.
        """
        first, second = words(text)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, at in self.hits(first, second).items():
            for k, p in self.seeds[s]:
                places[k] += [(d, p) for d in at]
        if not places:
            return []
        doc, out = None, []
        for k, pairs in sorted(places.items()):
            m, least = len(self.forms[k][0]), max(1.0, seeded * self.own[k])
            if len({p for _, p in pairs}) < least:
                continue
            if doc is None:
                doc = np.array([_number(w) for w in first]), np.array([_number(w) for w in second])
            best, reach = None, m + 60
            spots, at, shift = sorted({d for d, _ in pairs}), defaultdict(set), defaultdict(list)
            for d, p in pairs:
                at[d].add(p)
                shift[d].append(d - p)
            cuts = [0, *[i for i in range(1, len(spots)) if spots[i] - spots[i - 1] > reach], len(spots)]
            for a, b in zip(cuts, cuts[1:]):
                near = spots[a:b]
                if len(set().union(*(at[d] for d in near))) < least:
                    continue
                starts = [x for d in near for x in shift[d]]
                lo, hi = max(0, near[0] - reach, min(starts) - 60), min(len(first), near[-1] + reach, max(starts) + m + 60)
                hits, x, y = align(self.forms[k], (doc[0][lo:hi], doc[1][lo:hi]))
                if best is None or hits > best[0]:
                    best = hits, x + lo, y + lo
            if best and best[0] >= share * m - 1e-9:
                out.append((self.ids[k], best[0], m, best[1], best[2]))
        return out


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.6, n: int = 3, rare_share: float = 0.001, rare_least: int = 50, seeded: float = 0.1, block: int = 12_000_000) -> DataFrame:
    """(doc_id, item_id, matched, item_words, first_word, last_word) for each document that carries, in one place
    and in order, at least ``share`` of an item's words. ``matched`` counts the words that are the same and
    a few changed ones (see :func:`align`); a date or number written with separators is one word.

    Items are taken in blocks of about ``block`` characters (one pass over the documents each), so what is sent to the executors is
    bounded. A seed is rare if at most max(rare_least, rare_share * documents) different texts and two items have it; of
    each item the rarer half of the seeds always counts, so no item is left without. A share ``seeded`` of an item's
    rare seeds must stand in one place, which keeps out other questions made by the same pattern. Documents and items with null
    or empty text carry nothing; an item shorter than ``n`` words is one seed. Extra columns are ignored.
    """
    spark = documents.sparkSession
    docs = spread(documents.select("doc_id", "text").filter("doc_id is not null and length(text) > 0"), "doc_id")
    total = documents.count()
    most = max(rare_least, int(rare_share * total))
    numbered = items.select(F.col("item_id").cast("long"), "passage").filter("item_id is not null and length(passage) > 0").distinct()
    blocks = max(1, -(-(numbered.agg(F.sum(F.length("passage"))).first()[0] or 0) // block))
    found = []
    for b in range(blocks):
        rows = numbered.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "passage").collect()
        every = Items.of([(r[0], r[1]) for r in rows], n)
        if not every.ids:
            continue
        found.append(_block(spark, docs, every, most, share, seeded))
    schema = "doc_id long, item_id long, matched int, item_words int, first_word int, last_word int"
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def _block(spark, docs: DataFrame, every: Items, most: int, share: float, seeded: float) -> DataFrame:
    """One block of items: a pass over the documents notes the seeds each text has, and keeps the texts in which an item may
    stand; from the notes come the seeds' frequencies, and the kept texts are aligned with the rare ones."""
    sent, scratch = spark.sparkContext.broadcast(every), Scratch(spark, "leakage")

    def note(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = sent.value
        for part in parts:
            out = []
            for d, t in zip(part["doc_id"], part["text"]):
                found = items.hits(*words(t))
                if found:
                    out.append((d, xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1, list(found), t if items.possible(found, seeded) else None))
            yield pd.DataFrame(out, columns=["doc_id", "t", "seeds", "text"])

    noted = scratch.write(docs.mapInPandas(note, "doc_id long, t long, seeds array<long>, text string"), "noted")
    pairs = noted.select(F.explode("seeds").alias("seed"), "t").distinct()
    frequency = {r[0]: r[1] for r in pairs.groupBy("seed").count().filter(F.col("count") > min(most, 1)).collect()}
    rare = spark.sparkContext.broadcast(every.rare(frequency, most))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = rare.value
        for part in parts:
            out = [(d, *x) for d, t in zip(part["doc_id"], part["text"]) for x in items.leaks(t, share, seeded)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "item_words", "first_word", "last_word"])

    kept = spread(noted.filter("text is not null").select("doc_id", "text"), "doc_id")
    return kept.mapInPandas(look, "doc_id long, item_id long, matched int, item_words int, first_word int, last_word int")
