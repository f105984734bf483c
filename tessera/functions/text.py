"""Text and ticker functions as column expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a title loses before it is compared.
STOP_WORDS = (
    "will", "the", "a", "an", "to", "in", "on", "for", "of", "does", "is", "are", "be", "during", "under", "over", "than", "by", "at", "with", "from", "as", "this",
    "that", "it", "its", "or", "and", "but", "if", "then", "so", "because", "what", "which", "who", "whom", "how", "when", "where", "why", "have", "has", "had", "do",
    "did", "was", "were", "been", "being", "can", "could", "would", "should", "may", "might", "must", "shall", "before", "after", "above", "below",
)


def normalize_title(title: Column) -> Column:
    """Lower case; punctuation but hyphens as blanks; a word that starts with v read as "vs" and the rest; stop words
    and single letters dropped. Null stays null."""
    return F.array_join(tokenize(title), " ")


def tokenize(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"[^a-z0-9_\s-]", " ")
    t = F.regexp_replace(t, r"\bv\.?\s*", "vs ")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty arrays have 0; null where either is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def has_phrase(tokens: Column, phrase: str) -> Column:
    """Whether the words of the phrase stand next to each other among the tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {phrase} ")


def fuzzy(a: Column, b: Column) -> Column:
    """1 - edits / longer length, over letters, digits and single blanks; two empty texts are alike."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))
    x, y = plain(a), plain(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)


def slugify(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s_-]+", "-"), "^-+|-+$", "")


def ticker(c: Column) -> Column:
    """Upper case without outer blanks; empty is null."""
    t = F.upper(F.trim(c))
    return F.when(t != "", t)


def ticker_prefix(c: Column, longest: int = 20) -> Column:
    t = F.split(ticker(c), "[-_]").getItem(0)
    return F.when(t != "", F.substring(t, 1, longest))


def json_ticker(metadata: Column, *keys: str) -> Column:
    """The first of the keys that the JSON object has, as a ticker."""
    return ticker(F.coalesce(*[F.get_json_object(metadata, f"$.{k}") for k in keys]))


def has_key(metadata: Column, key: str) -> Column:
    """Whether a JSON object has the key, even with value null; null where there is no object."""
    return F.array_contains(F.json_object_keys(metadata), key)


def is_intraday_ticker(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike("UPDOWN|INTRADAY|15MIN|30MIN|1HR|HOURLY"), F.lit(False))


def is_dated_ticker(c: Column) -> Column:
    return F.coalesce(ticker(c).rlike("[0-9]{2}[A-Z]{3}[0-9]{0,2}$"), F.lit(False)) & ~is_intraday_ticker(c)


def season_of_ticker(c: Column) -> Column:
    """The part of a ticker before its first date-like part."""
    return F.regexp_extract(ticker(c), "^([A-Z0-9]+?)(?:-|$)", 1)


# Words that say on which side of a number, or that somebody wins.
AT_LEAST_WORDS = ("above", "over", "exceed", "exceeds", "exceeding", "reach", "reaches", "reaching", "hit", "hits", "at least", "greater than", "more than", "higher than", "surpass", "surpasses", "top", "tops")
AT_MOST_WORDS = ("below", "under", "less than", "at most", "lower than", "fall below", "falls below", "drop below", "drops below", "not exceed", "not reach", "fail to reach")
WIN_WORDS = ("win", "wins", "winning", "winner", "beat", "beats", "defeat", "defeats", "elected", "election winner", "victory", "champion", "champions", "championship")
# How a range of numbers is written.
BETWEEN = r"between\s+\$?[0-9,]+\s+and\s+\$?[0-9,]+|from\s+\$?[0-9,]+\s+to\s+\$?[0-9,]+|\$?[0-9,]+\s*[-–]\s*\$?[0-9,]+|\$?[0-9,]+\s+to\s+\$?[0-9,]+"


def comparator(title: Column, whole_words: bool = False) -> Column:
    """BETWEEN, GE, LE, WIN or UNKNOWN, in this order. By default a word counts wherever its letters stand ("government" has
    "over" in it), as existing links were made so; ``whole_words`` mends that."""
    t = F.lower(title)

    def has(words: tuple[str, ...]) -> Column:
        p = "|".join(words)
        return t.rlike(f"(^|[^a-z0-9_])({p})([^a-z0-9_]|$)" if whole_words else p)

    return F.when(t.rlike(BETWEEN), "BETWEEN").when(has(AT_LEAST_WORDS), "GE").when(has(AT_MOST_WORDS), "LE").when(has(WIN_WORDS), "WIN").otherwise("UNKNOWN")


MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def numbers(title: Column) -> Column:
    """Numbers of a title, distinct and rising. k, m, b, t and the words for them multiply. Left out: numbers below 1, years
    (1900 to 2100), 1 to 31 without a dollar sign, multiplier or percent sign, and days after a month's name or its first three letters."""
    t = F.regexp_replace(F.lower(title), rf"\b({MONTH})\s+[0-9]{{1,2}}(?![0-9,.])", " ")
    part = lambda k: F.regexp_extract_all(t, F.lit(r"(\$?)([0-9][0-9,]*(?:\.[0-9]+)?)(k|m|b|t|\s*thousand|\s*million|\s*billion|\s*trillion)?(\b|\s*%)(\s*%)?"), F.lit(k))

    def one(x: Column) -> Column:
        digits, unit = F.regexp_replace(x["1"], ",", ""), F.trim(x["2"])
        scale = F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("m", "million"), 1e6).when(unit.isin("b", "billion"), 1e9).when(unit.isin("t", "trillion"), 1e12).otherwise(1.0)
        n = F.round(digits.try_cast("double") * scale, 6)
        pct = F.concat(x["3"], x["4"]).contains("%")
        marked = (x["0"] == "$") | (unit != "") | pct
        fits = ((n >= 1) | pct) & ~((n >= 1900) & (n <= 2100) & ~pct) & (marked | (n > 31))
        return F.when(fits, n)

    rows = F.arrays_zip(part(1).alias("0"), part(2).alias("1"), part(3).alias("2"), part(4).alias("3"), part(5).alias("4"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(rows, one))))


def n_grams(tokens: Column, longest: int = 3) -> Column:
    """Runs of one to ``longest`` tokens, as texts: what an alias table is joined to."""

    def run(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))

    runs = [run(n) for n in range(1, longest + 1)]
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*runs)))


def verdict(answer: Column) -> Column:
    """YES, NO or UNCERTAIN of a free answer: yes is looked for first, no as a word of its own."""
    a = F.upper(answer)
    return F.when(a.contains("YES"), "YES").when(a.rlike("(^|[^A-Z])NO([^A-Z]|$)"), "NO").otherwise("UNCERTAIN")
