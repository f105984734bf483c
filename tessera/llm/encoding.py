"""Text decoded with the wrong character encoding: finding it, and restoring the original.

Every candidate decoding of a passage is compressed with zstandard dictionaries, one per language; the
candidate with the least description length, the cost of its chain of decodings included, is taken.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import Scratch, spread

#: Encodings in which UTF-8 bytes may have been read.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "iso8859-2", "iso8859-15")
#: Single-byte encodings taken for each other: (read as, written in).
SWAPS = (
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"),
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "iso8859-2"), ("iso8859-2", "cp1252"), ("cp1251", "cp1250"), ("cp1250", "cp1251"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
)
#: Bytes of description length that each step of a chain costs.
STEP = 1.5
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
FOREIGN = re.compile(r"[^\x00-\x7f]")
WORD = re.compile(r"[^\t-\r ]*[^\x00-\x7f][^\t-\r ]*")
#: A run of characters above ASCII with its neighbours.
RUN = re.compile(r"[\x20-\x7f]?[^\x00-\x7f]+[\x20-\x7f]?")


@cache
def byte_of(enc: str) -> dict[str, int]:
    """The byte of each character above ASCII; bytes without a character stand for the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        out[bytes([b]).decode(enc, "ignore") or chr(b)] = b
    return {c: b for c, b in out.items() if ord(c) > 0x7F}


@cache
def utf8_reader(enc: str, only: re.Pattern | None = None):
    """Replaces each run of characters that is one UTF-8 character read in ``enc`` (of those that match ``only``)."""
    table = byte_of(enc)

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"

    cont = cls(0x80, 0xBF)
    found = re.compile(f"{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{cont}|{cls(0xF0, 0xF4)}{cont}{cont}{cont}")

    def one(m: re.Match) -> str:
        try:
            c = bytes(table[c] for c in m.group()).decode("utf-8")
            return c if only is None or only.match(c) else m.group()
        except UnicodeDecodeError:
            return m.group()

    return lambda text: found.sub(one, text)


@cache
def swap_table(read: str, written: str) -> dict[int, str]:
    back = {b: c for c, b in byte_of(written).items()}
    return {ord(c): back[b] for c, b in byte_of(read).items() if b in back and back[b] != c}


_RUNS = re.compile(r"[^\x00-\x7f]+")
_AFTER = re.compile(r"[^\x00-\x7f]+[\x20-\x7f]?")


def swapped(text: str, read: str, written: str) -> str:
    return text.translate(swap_table(read, written))


def steps(text: str) -> list[tuple[str, str]]:
    """(decoded text, step) for every single decoding that changes the text."""
    seen, out = {text}, []
    for enc in UTF8_READ_AS:
        d = utf8_reader(enc)(text)
        if d not in seen:
            seen.add(d)
            out.append((d, f"utf-8<{enc}"))
    for read, written in SWAPS:
        d = swapped(text, read, written)
        if d not in seen:
            seen.add(d)
            out.append((d, f"{written}<{read}"))
    return out


class Apart:
    """A text's runs of characters above ASCII, which are all that decoding changes, and the ASCII between them."""

    def __init__(self, text: str):
        self.gaps, self.runs = _RUNS.split(text), "\0".join(_RUNS.findall(text))

    def whole(self, runs: str) -> str:
        own = runs.split("\0")
        return "".join([x for pair in zip(self.gaps, own) for x in pair] + self.gaps[len(own) :])


def decodings(text: str, depth: int = 2) -> list[tuple[str, tuple[str, ...]]]:
    """(decoded text, chain) for every chain that changes the text, the shortest chain first: UTF-8 read in some encoding up to
    ``depth`` times over, and encodings taken for each other, alone."""
    if text.isascii():
        return []
    apart = Apart(text)
    seen, out = {apart.runs}, []
    level = [(d, (step,)) for d, step in steps(apart.runs)]
    for _ in range(depth):
        level = [(d, chain) for d, chain in level if not (d in seen or seen.add(d))]
        out += level
        level = [(d, (*chain, f"utf-8<{enc}")) for t, chain in level if chain[0].startswith("utf-8") for enc in UTF8_READ_AS if (d := utf8_reader(enc)(t)) not in seen]
    return [(apart.whole(d), chain) for d, chain in out]


def segments(text: str) -> list[str]:
    """The text in pieces that join to it again: lines, and sentences of longer lines."""
    out = []
    for line in re.split(r"(?<=\n)", text):
        out += re.split(r"(?<=[.!?…] )", line) if len(line) > 80 else [line]
    return [s for s in out if s]


def _words(text: str) -> list[str]:
    """The words with a character above ASCII. Only ASCII blanks part words: U+00A0 and U+0085 may be halves of a character."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split() if not w.isascii()]  # bytes know ASCII blanks only


def _pairs(text: str) -> set[str]:
    return {text[m.start() - 1 : m.start() + 1] if m.start() else " " + text[0] for m in FOREIGN.finditer(text)} | {text[m.start() : m.start() + 2] for m in FOREIGN.finditer(text)}


_SHORT = re.compile("[\x80-\u07ff]")
_DIGIT = re.compile(r"\d+")


def packed(text: str) -> bytes:
    """The bytes that are compressed: UTF-8 in which characters of two bytes take three, as else a chain that
    ends in shorter characters would look like a shorter description."""
    return _SHORT.sub(lambda m: m.group() + "\x01", text).encode("utf-8", "surrogatepass")


def chain_cost(chain: tuple[str, ...]) -> float:
    """Bytes that a chain costs: ``STEP`` for each decoding, a little more for rarer encodings and for a change of encoding."""
    rare = sum(0.02 * UTF8_READ_AS.index(c[6:]) if c.startswith("utf-8<") else 0.7 for c in chain)
    return STEP * len(chain) + rare + 0.5 * (len(set(chain)) > 1)


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """A zstandard dictionary per language, and the character pairs known from sound text."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    pairs: frozenset[str] = frozenset()
    level: int = 3
    beam: int = 4
    _made: list | None = None
    _known: dict[str, frozenset[str]] = field(default_factory=dict)
    _hope: dict[str, bool] = field(default_factory=dict)
    _done: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "pairs": self.pairs, "level": self.level, "beam": self.beam, "_made": None, "_known": {}, "_hope": {}, "_done": {}}

    def unknown(self, word: str) -> frozenset[str]:
        """Unknown character pairs of a word with its blanks; words come again and again, so they are kept, up to a bound."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 300_000:
                self._known.clear()
            got = self._known[word] = frozenset(_pairs(_DIGIT.sub("0", f" {word} ")) - self.pairs)
        return got

    def length(self, texts: list[str]) -> list[int]:
        """Least compressed size of each text over the dictionaries."""
        if self._made is None:
            self._made = []
            for d in self.dictionaries.values():
                self._made.append(_compressor(d, self.level))
            if not self._made:
                self._made.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False))
        out = []
        for t in texts:
            b = packed(t)
            out.append(min(len(c.compress(b)) for c in self._made))
        return out

    def hopeful(self, word: str) -> bool:
        """Whether some chain describes the word alone in fewer bytes, or leaves fewer unknown pairs in it; kept like the pairs. Without
        such a word a passage is not tried."""
        got = self._hope.get(word)
        if got is None:
            if len(self._hope) > 300_000:
                self._hope.clear()
            texts = [word, *(d for d, _ in decodings(word))]
            now, *then = (n + self.strange(t) for n, t in zip(self.length([f" {t} " for t in texts]), texts))
            got = self._hope[word] = min(then, default=now) < now
        return got

    def strange(self, text: str) -> int:
        """How many character pairs of the text are unknown: each is described by a byte more, as an escape."""
        own = [u for w in _words(text) if (u := self.unknown(w))]
        return len(frozenset().union(*own)) if own else 0

    def restore_segment(self, seg: str) -> tuple[str, tuple[str, ...]]:
        """The text with the least description length of all candidates, and its chain; the passage itself with none. Passages come
        again and again, so what was found is kept, up to a bound."""
        got = self._done.get(seg)
        if got is None:
            if len(self._done) > 20_000:
                self._done.clear()
            got = self._done[seg] = self._restored(seg)
        return got

    def _restored(self, seg: str) -> tuple[str, tuple[str, ...]]:
        """Every chain is compressed; where the best leaves unknown pairs, the ``beam`` best are decoded a step further, in any way."""
        odd = [m.span() for m in WORD.finditer(seg) if self.unknown(m.group())]
        if not any(self.hopeful(seg[x:y]) for x, y in odd):
            return seg, ()
        a, b = odd[0][0], odd[-1][1]
        options: dict[str, tuple[str, ...]] = {seg: ()}
        for t, chain in decodings(seg):
            options.setdefault(t, chain)
        if not (seg[:a].isascii() and seg[b:].isascii()):  # the damage may be but a stretch
            for t, chain in decodings(seg[a:b], 1):
                options.setdefault(seg[:a] + t + seg[b:], chain)
        costs = self._costs(list(options.items()))
        best = min(costs)
        if self.strange(best[3]):
            more: dict[str, tuple[str, ...]] = {}
            for _, _, chain, t in sorted(costs)[: self.beam]:
                if chain:
                    for d, step in decodings(t, 1):
                        if d not in options:
                            more.setdefault(d, (*chain, *step))
            best = min([best, *self._costs(list(more.items()), len(costs))])
        return best[3], best[2]

    def _costs(self, options: list[tuple[str, tuple[str, ...]]], first: int = 0) -> list[tuple[float, int, tuple[str, ...], str]]:
        sizes = self.length([t for t, _ in options])
        return [(n + chain_cost(chain) + self.strange(t), first + i, chain, t) for i, (n, (t, chain)) in enumerate(zip(sizes, options))]

    def restore(self, text: str | None) -> tuple[str | None, str, bool]:
        """(text, chains taken, whether damaged): null and empty texts are sound; damage that left nothing to
        decode (replacement characters, stray C1 controls) stays as it is but counts as damage."""
        if not text or text.isascii():
            return text, "", False
        if not any(self.unknown(w) and self.hopeful(w) for w in _words(text)):  # no passage would be tried
            return text, "", LOST.search(text) is not None
        out, chains = [], {}
        for seg in segments(text):
            t, chain = (seg, ()) if seg.isascii() else self.restore_segment(seg)
            out.append(t)
            if chain:
                chains[" ".join(chain)] = True
        return "".join(out), "; ".join(chains), bool(chains) or LOST.search(text) is not None


def _dictionary(sound: list[bytes], size: int) -> bytes:
    """Trained, or made of the most frequent passages, whichever compresses held-out passages better."""
    held, rest = sound[::10][:500], [s for i, s in enumerate(sound) if i % 10] or sound
    often = [s for s, _ in Counter(rest).most_common()]
    plain = b"".join(reversed(often[: max(1, size // 40)]))[-size:]
    try:
        trained = zstandard.train_dictionary(min(size, max(1024, sum(map(len, rest)) // 4)), rest, level=9).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return plain
    return min((trained, plain), key=lambda d: sum(map(len, map(_compressor(d, 9).compress, held))))


def fit(texts: list[tuple[str, str]], size: int = 112_640) -> Model:
    """A model from (language, text) rows of which most are sound.

    A run of characters above ASCII, with its neighbours, counts as damaged where a decoding of it is at least three times as frequent
    in the sample (digits read alike); passages with damaged runs are left out, and dictionaries are trained on the rest.
    """
    runs: Counter[str] = Counter()
    cut: dict[str, list[str]] = defaultdict(list)
    for lang, text in texts:
        if text:
            cut[lang] += segments(text)
    for segs in cut.values():
        for s in segs:
            runs.update(_DIGIT.sub("0", m.group()) for m in RUN.finditer(s))
    damaged = {w for w, n in runs.items() if LOST.search(w) or any(runs[d] >= 3 * n for d, _ in decodings(w) if not d.isascii() or len(d) > 1)}
    pairs: Counter[str] = Counter()
    dictionaries = {}
    for lang, segs in sorted(cut.items()):
        sound = []
        for s in segs:
            if not any(_DIGIT.sub("0", m.group()) in damaged for m in RUN.finditer(s)):
                sound.append(packed(s))
                pairs.update({p for w in _words(s) for p in _pairs(_DIGIT.sub("0", f" {w} "))})
        if sound:
            dictionaries[lang] = _dictionary(sound, size)
    return Model(dictionaries, frozenset(p for p, n in pairs.items() if n >= 3))


def _trained(passages: list[bytes], size: int) -> bytes:
    """A dictionary of all passages in one quick pass of fixed parameters; empty where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, passages)) // 4)), passages, k=1024, d=8, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _slice_dictionary(sound: list[bytes], size: int) -> bytes:
    """Trained on all passages; of few, made of the most frequent ones if that way makes a dictionary of nine tenths that compresses the other tenth better."""

    def plain(passages: list[bytes]) -> bytes:
        often = [s for s, _ in Counter(passages).most_common(max(1, size // 40))]
        return b"".join(reversed(often))[-size:]

    if sum(map(len, sound)) < 20 * size:
        held, rest = sound[::10], [s for i, s in enumerate(sound) if i % 10] or sound
        tried, total = _trained(rest, size), lambda d: sum(map(len, map(_compressor(d, 3).compress, held)))
        if not tried or total(plain(rest)) < total(tried):
            return plain(sound)
    return _trained(sound, size) or plain(sound)


def _merged(dictionaries: list[bytes], size: int) -> bytes:
    """One dictionary of several: trained on their contents, in which each slice has put what stands in it most often."""
    pieces = [d[i : i + 1024] for d in dictionaries for i in range(0, len(d), 1024)]
    return dictionaries[0] if len(dictionaries) == 1 else _trained(pieces, size) or b"".join(d[-(size // len(dictionaries)) :] for d in dictionaries)


def _text_runs(text: str) -> list[tuple[int, str]]:
    """(place of its first character above ASCII, run with digits read alike) of every run of a text, as ``RUN`` finds them."""
    out, last = [], 0
    for m in _AFTER.finditer(text):
        at, end = m.span()
        first = at - (at > last and " " <= text[at - 1] <= "\x7f")
        out.append((at, _DIGIT.sub("0", text[first:end])))
        last = end
    return out


def _sound(text: str, damaged: frozenset[str]) -> list[str]:
    """The passages of a text without a damaged run."""
    bad = [] if text.isascii() else [at for at, w in _text_runs(text) if w in damaged or LOST.search(w)]
    out, end, k = [], 0, 0
    for s in segments(text):
        end += len(s)
        first = k
        while k < len(bad) and bad[k] < end:
            k += 1
        if k == first:
            out.append(s)
    return out


def _learn(texts: list[str], damaged: frozenset[str], size: int) -> tuple[bytes, int, Counter[str]]:
    """(dictionary, passages, how often each character pair stands in them) of the sound passages of the texts."""
    packs, words = [], Counter()
    for t in texts:
        sound = _sound(t, damaged)
        packs += [s.encode() if s.isascii() else packed(s) for s in sound]
        words.update("".join(sound).encode("utf-8", "surrogatepass").split())
    pairs: Counter[str] = Counter()
    for w, n in words.items():
        if not w.isascii():
            for p in _pairs(_DIGIT.sub("0", f" {w.decode('utf-8', 'surrogatepass')} ")):
                pairs[p] += n
    return _slice_dictionary(packs, size) if packs else b"", len(packs), pairs


def _damaged_runs(rows: DataFrame, scratch: Scratch) -> frozenset[str]:
    """The runs of all rows of which a decoding is at least three times as frequent. Those with lost characters are known by sight and left out."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        frame = lambda: pd.DataFrame({"w": list(seen), "n": list(seen.values())})
        for part in parts:
            for t in part["t"]:
                if not t.isascii():
                    seen.update(w for _, w in _text_runs(t))
            if len(seen) > 200_000:
                yield frame()
                seen.clear()
        yield frame()

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [(w, n, d) for w, n in zip(part["w"], part["n"]) for d, _ in decodings(w) if not d.isascii() or len(d) > 1]
            yield pd.DataFrame(got, columns=["w", "n", "d"])

    runs = scratch.write(rows.select("t").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "runs")
    often = runs.filter("n >= 3").select(F.col("w").alias("d"), F.col("n").alias("m"))
    bad = runs.filter(~F.col("w").rlike(LOST.pattern)).mapInPandas(decoded, "w string, n long, d string").join(often, "d").filter("m >= 3 * n")
    return frozenset(r.w for r in bad.select("w").distinct().collect())


def fit_on(documents: DataFrame, text: str = "text", lang: str = "lang", languages: int = 40, chars: int = 4_000_000, size: int = 112_640, merge: int = 16, rare: int = 30_000) -> Model:
    """A model of all documents, each text once a language: the runs of the whole table say which are damaged, all passages without such
    runs are trained on and their character pairs counted.

    A language has a dictionary; texts without a language, and those of all but the ``languages`` most frequent, share one. The texts of a
    language are trained on in slices of about ``chars`` characters, and the slices' dictionaries are merged, ``merge`` at a time, until
    one is left. A pair is known that stands in a language's passages three times, and once in ``rare`` passages, so that
    what damage is left over does not become known as tables grow.
    """
    scratch = Scratch(documents.sparkSession, "fit")
    rows = documents.select(F.coalesce(F.lower(F.trim(lang)), F.lit("")).alias("l"), F.col(text).alias("t")).filter(F.length("t") > 0)
    sizes = rows.groupBy("l").agg(F.sum(F.length("t")).alias("n"))
    own = sizes.filter("l != ''").orderBy(F.desc("n"), "l").limit(languages).collect()
    rest = sizes.filter(~F.col("l").isin([r.l for r in own])).agg(F.sum("n")).first()[0] or 0
    if not own and not rest:
        return fit([])
    damaged = documents.sparkSession.sparkContext.broadcast(_damaged_runs(rows, scratch))
    slices = F.create_map(*[F.lit(x) for l, n in [*((r.l, r.n) for r in own), ("", rest)] for x in (l, -(-n // chars) or 1)])
    rows = rows.withColumn("l", F.when(F.col("l").isin([r.l for r in own]), F.col("l")).otherwise("")).withColumn("s", F.pmod(F.xxhash64("t"), F.try_element_at(slices, F.col("l"))))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        d, n, pairs = _learn(sorted(part["t"].unique()), damaged.value, size)
        return pd.DataFrame({"l": [part["l"].iloc[0]], "s": [int(part["s"].iloc[0])], "n": [n], "d": [d], "p": [list(pairs)], "c": [list(pairs.values())]})

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        return pd.DataFrame({"l": [part["l"].iloc[0]], "s": [int(part["s"].iloc[0]) // merge], "d": [_merged(list(part["d"]), size)]})

    got = scratch.write(rows.groupBy("l", "s").applyInPandas(learn, "l string, s long, n long, d binary, p array<string>, c array<long>"), "slices")
    n = got.groupBy("l").agg(F.sum("n").alias("n"))
    pairs = got.select("l", F.explode(F.arrays_zip("p", "c")).alias("x")).groupBy("l", F.col("x.p").alias("p")).agg(F.sum("x.c").alias("c"))
    known = pairs.join(F.broadcast(n), "l").filter(F.col("c") >= F.greatest(F.lit(3), F.col("n") / rare)).select("p").distinct().collect()
    dictionaries, most = got.filter("length(d) > 0").select("l", "s", "d"), max(-(-n // chars) for n in (*(r.n for r in own), rest))
    while most > 1:
        dictionaries = scratch.write(dictionaries.groupBy("l", F.floor(F.col("s") / merge).alias("_g")).applyInPandas(joined, "l string, s long, d binary"), "merged")
        most = -(-most // merge)
    return Model({r.l: bytes(r.d) for r in dictionaries.orderBy("l").collect()}, frozenset(r.p for r in known))


def restore(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``restored``, ``chains`` and ``damaged`` for every document, in one pass without shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f for f in documents.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keep), "restored string, chains string, damaged boolean"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            got = [m.restore(t if isinstance(t, str) else None) for t in part["_text"]]
            out = part[list(keep)].copy()
            out["restored"], out["chains"], out["damaged"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            yield out

    return spread(documents.select(*keep, F.col(text).alias("_text")), keep[0]).mapInPandas(run, schema)
