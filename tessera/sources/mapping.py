"""Catalogue items (JSON) mapped to listings and their outcomes, for the two shapes catalogues have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_list(item: Column, key: str, element: str = "string") -> Column:
    """A list that an item holds as an array or as a text with one in it; anything else is an empty list."""
    got = F.from_json(F.get_json_object(item, f"$.{key}"), f"array<{element}>")
    return F.coalesce(F.filter(got, lambda x: x.isNotNull()), F.array().cast(f"array<{element}>"))


def status_of_flags(active: Column, closed: Column) -> Column:
    """From two flags, a missing one as false: closed and no longer active is resolved; neither is closed."""
    a, c = F.coalesce(active, F.lit(False)), F.coalesce(closed, F.lit(False))
    return F.when(c & ~a, "resolved").when(c, "closed").when(a, "active").otherwise("closed")


def status_of_word(word: Column) -> Column:
    """From a word: paused is closed, settled is resolved; open, not yet open and unknown words are active."""
    return F.when(word.isin("paused", "closed"), "closed").when(word == "settled", "resolved").otherwise("active")


def side_of(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.isin("yes", "no"), n).otherwise("other")


def _text(item: Column, *keys: str) -> Column:
    """The first of the keys that holds a text that is not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(item, f"$.{k}"), F.lit("")) for k in keys])


_TIME = "timestamp_ntz"


def map_flagged(items: DataFrame, item: str = "item") -> DataFrame:
    """Items with flags and parallel lists (outcomes, outcomePrices, clobTokenIds) -> one row an item: external_id, title, category,
    status, close_time, outcomes (name, side, external_id, price by position; null where a list is shorter), categories and tags
    (their slugs, or labels). Items without id or that are no JSON give no row; a time that cannot be read is null."""
    c = F.col(item)
    names, prices, tokens = (json_list(c, k) for k in ("outcomes", "outcomePrices", "clobTokenIds"))
    outcome = lambda n, i: F.struct(n.alias("name"), side_of(n).alias("side"), F.get(tokens, i).alias("external_id"), F.get(prices, i).try_cast("double").alias("price"))
    slugs = lambda k: F.filter(F.transform(json_list(c, k, "struct<slug:string,label:string>"), lambda x: F.coalesce(F.nullif(x["slug"], F.lit("")), x["label"])), lambda x: x != "")
    rows = items.select(
        _text(c, "id").alias("external_id"), F.get_json_object(c, "$.question").alias("title"), _text(c, "category", "groupItemTitle").alias("category"),
        status_of_flags(F.get_json_object(c, "$.active").try_cast("boolean"), F.get_json_object(c, "$.closed").try_cast("boolean")).alias("status"),
        F.get_json_object(c, "$.endDate").try_cast(_TIME).alias("close_time"), F.transform(names, outcome).alias("outcomes"), slugs("categories").alias("categories"), slugs("tags").alias("tags"),
    )
    return rows.filter("external_id is not null")


def map_listed(items: DataFrame, item: str = "item") -> DataFrame:
    """Items with a status word and yes and no quotes in cents -> the same columns but categories and tags, and the tickers of event
    and series. The title is followed by the subtitle, if there is one; without category the event's ticker stands for it."""
    c = F.col(item)
    number = lambda k: F.get_json_object(c, f"$.{k}").try_cast("double")
    quote = lambda s: F.struct(F.lit(s.capitalize()).alias("name"), F.lit(s).alias("side"), number(f"{s}_bid").alias("bid"), number(f"{s}_ask").alias("ask"))
    subtitle = _text(c, "subtitle")
    rows = items.select(
        _text(c, "ticker").alias("external_id"), F.concat(F.get_json_object(c, "$.title"), F.coalesce(F.concat(F.lit(" - "), subtitle), F.lit(""))).alias("title"),
        _text(c, "category", "event_ticker").alias("category"), status_of_word(F.get_json_object(c, "$.status")).alias("status"), F.get_json_object(c, "$.close_time").try_cast(_TIME).alias("close_time"),
        F.array(quote("yes"), quote("no")).alias("outcomes"), _text(c, "event_ticker").alias("event_ticker"), _text(c, "series_ticker").alias("series_ticker"),
    )
    return rows.filter("external_id is not null")
