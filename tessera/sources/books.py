"""Order books and metadata read as quotes, and generated seed data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mid_price(bid: Column, ask: Column) -> Column:
    """The middle, or the one side there is; null with neither."""
    return F.coalesce((bid + ask) / 2, bid, ask)


def book_quotes(books: DataFrame) -> DataFrame:
    """Books (token, bids and asks as arrays of struct<price, size>, best first) -> (token, price, liquidity); books without
    levels give none. Liquidity is the size at the top of both sides; a missing size counts 0."""
    top = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    q = books.select("token", mid_price(top("bids", "price"), top("asks", "price")).alias("price"), (F.coalesce(top("bids", "size"), F.lit(0.0)) + F.coalesce(top("asks", "size"), F.lit(0.0))).alias("liquidity"))
    return q.filter("price is not null")


def depth(levels: Column) -> Column:
    """Total size over all levels of one side."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["size"], F.lit(0.0)))


def metadata_quotes(markets: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(id, side, price) from bids and asks in cents kept in a market's JSON metadata; a side without any gives none."""
    cents = lambda k: F.get_json_object(metadata, f"$.{k}").try_cast("double")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (mid_price(cents(f"{s}Bid"), cents(f"{s}Ask")) / 100).alias("price")) for s in ("yes", "no")])
    return markets.select("id", F.explode(sides).alias("q")).select("id", "q.side", "q.price").filter("price is not null")


def seed_quotes(spark: SparkSession, markets: int, steps: int, seed: int = 7, step: float = 0.02) -> DataFrame:
    """(outcome_id, step, price): a random walk per outcome, held within [0.01, 0.99] at every step; the same for the same seed."""
    noise = lambda i: ((F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(2_000_001)) - 1_000_000) / 1_000_000.0) * step
    start = F.array(F.lit(0.5))
    hold = lambda x: F.least(F.greatest(x, F.lit(0.01)), F.lit(0.99))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), start, lambda acc, i: F.concat(acc, F.array(hold(F.element_at(acc, -1) + noise(i))))) if steps > 1 else start
    return spark.range(markets).select(F.col("id").alias("outcome_id"), F.posexplode(walk).alias("step", "price"))
