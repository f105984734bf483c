"""Component scores of a pair, buckets and clamps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.shared import epoch_us


def steps(x: Column, table: list[tuple[float, float]], rest: float, strict: bool = False) -> Column:
    """The value of the first bound that ``x`` does not exceed (with ``strict``: stays below)."""
    out = None
    for bound, value in table:
        hit = x < bound if strict else x <= bound
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(rest)


def time_score(a: Column, b: Column) -> Column:
    """By hours apart: 12 -> 1, 24 -> .7, 48 -> .4, a week -> .2, else 0; one time missing .2, both .3."""
    hours = F.abs(epoch_us(a) - epoch_us(b)) / 3.6e9
    return F.when(a.isNull() & b.isNull(), 0.3).when(a.isNull() | b.isNull(), 0.2).otherwise(steps(hours, [(12, 1.0), (24, 0.7), (48, 0.4), (168, 0.2)], 0.0))


def category_score(a: Column, b: Column) -> Column:
    """Equal 1, one the start of the other .8, a shared word of over three letters .6, else .3; one missing .3, both .5."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    long_words = lambda c: F.filter(F.split(c, r"[\s_-]+"), lambda w: F.length(w) > 3)
    return (
        F.when(a.isNull() & b.isNull(), 0.5).when(a.isNull() | b.isNull(), 0.3).when(x == y, 1.0)
        .when(x.startswith(y) | y.startswith(x), 0.8).when(F.arrays_overlap(long_words(x), long_words(y)), 0.6).otherwise(0.3)
    )


def number_score(a: Column, b: Column) -> Column:
    """Best over all pairs of two arrays: equal 1, within 1 % .95, 5 % .8, 10 % .5; 0 where either is empty."""

    def one(x: Column, y: Column) -> Column:
        gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))
        return F.when(x == y, 1.0).otherwise(steps(gap, [(0.01, 0.95), (0.05, 0.8), (0.1, 0.5)], 0.0, strict=True))

    best = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y))))
    return F.coalesce(F.array_max(best), F.lit(0.0))


def pair_numbers(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """How many numbers of one array find one of the other, each used once: in order, every number of ``a`` takes the first of ``b`` still
    free within ``tolerance`` of the greater of both. The order matters, so this is a fold, not an intersection. Null
    numbers find none; null where an array is."""
    used = F.transform(b, lambda y: F.lit(False))

    def take(acc: Column, x: Column) -> Column:
        near = lambda y: F.when(x.isNull() | y.isNull(), False).when(F.greatest(F.abs(x), F.abs(y)) == 0, True).otherwise(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)) <= tolerance)
        free = F.zip_with(acc["used"], b, lambda u, y: ~u & near(y))
        at = F.array_position(free, True)
        return F.struct((acc["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"), F.transform(acc["used"], lambda u, i: u | (i == at - 1)).alias("used"))

    return F.aggregate(a, F.struct(F.lit(0).alias("n"), used.alias("used")), take)["n"]


def comparator_factor(a: Column, b: Column) -> Column:
    """What a pair's score is multiplied by for the sides of a number its titles name: equal 1; opposite 0; one unknown .95; a win .9;
    a range and one side .7; an exact value and one side .5; else .8. Null reads as UNKNOWN."""
    a, b = F.coalesce(a, F.lit("UNKNOWN")), F.coalesce(b, F.lit("UNKNOWN"))
    either = lambda w: (a == w) | (b == w)
    side = lambda c: c.isin("GE", "LE")
    with_side = lambda w: ((a == w) & side(b)) | ((b == w) & side(a))
    return (
        F.when(a == b, 1.0).when(either("UNKNOWN"), 0.95).when(either("WIN"), 0.9).when(with_side("BETWEEN"), 0.7)
        .when(side(a) & side(b), 0.0).when(with_side("EXACT"), 0.5).otherwise(0.8)
    )


def type_factor(a: Column, b: Column, compatible: list[tuple[str, str]]) -> Column:
    """The same for kinds of question: equal 1; one unknown .9; a compatible pair .8; else .3. Null reads as UNKNOWN."""
    a, b = F.coalesce(a, F.lit("UNKNOWN")), F.coalesce(b, F.lit("UNKNOWN"))
    fits = F.lit(False)
    for x, y in compatible:
        fits = fits | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a == b, 1.0).when((a == "UNKNOWN") | (b == "UNKNOWN"), 0.9).when(fits, 0.8).otherwise(0.3)


def date_gate(a: Column, b: Column, precision_a: Column, precision_b: Column, strict: Column, days: int = 2) -> Column:
    """Whether two dates let a pair pass. ``strict`` is "day" (both known to the day and at most ``days`` apart), "month" (the same
    month, both known to it) or anything else (always)."""
    by_day = (precision_a == "day") & (precision_b == "day") & (F.abs(F.datediff(a, b)) <= days)
    by_month = precision_a.isin("day", "month") & precision_b.isin("day", "month") & (F.trunc(a, "month") == F.trunc(b, "month"))
    return F.when(strict == "day", F.coalesce(by_day, F.lit(False))).when(strict == "month", F.coalesce(by_month, F.lit(False))).otherwise(True)


def period_weight(a: Column, b: Column) -> Column:
    """Of compatible periods by their kinds: the same 1, month and quarter .6, quarter and year .55, month and year .45."""
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a == b, 1.0).when(pair("month", "quarter"), 0.6).when(pair("quarter", "year"), 0.55).when(pair("month", "year"), 0.45)


def entity_score(a: Column, b: Column) -> Column:
    """Jaccard plus .1 for one shared element, .3 for more, at most 1; nothing shared 0."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(shared <= 0, 0.0).otherwise(F.least(F.lit(1.0), shared / union + F.when(shared >= 2, 0.3).otherwise(0.1)))


def day_score(a: Column, b: Column) -> Column:
    """By days apart: 0 -> 1, 1 -> .95, 7 -> .8, 30 -> .5, 90 -> .2, else 0; a missing day 0."""
    return F.coalesce(steps(F.abs(F.datediff(a, b)), [(0, 1.0), (1, 0.95), (7, 0.8), (30, 0.5), (90, 0.2)], 0.0), F.lit(0.0)) * F.when(a.isNull() | b.isNull(), 0).otherwise(1)


def range_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length shared by two ranges over the length they cover together; two equal points 1."""
    shared = F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))
    cover = F.greatest(hi1, hi2) - F.least(lo1, lo2)
    return F.when(cover == 0, 1.0).otherwise(shared / cover)


def clamp(x: Column) -> Column:
    """Into [0, 1]; NaN and null 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def price_bucket(price: Column, epsilon: float) -> Column:
    """Nearest multiple of epsilon, halves upwards."""
    return F.floor(price / epsilon + 0.5).cast("long")


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(epoch_us(ts) / (seconds * 1_000_000)).cast("long")


def from_epoch(x: Column) -> Column:
    """A timestamp from a number of seconds, or of milliseconds where it is above 1e12."""
    return F.timestamp_millis(F.when(x > 1_000_000_000_000, x.cast("long")).otherwise((x.cast("double") * 1000).cast("long")))
