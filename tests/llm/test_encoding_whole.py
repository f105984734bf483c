"""The model of a table is made of all its texts."""

from pyspark.sql import functions as F

from tessera.llm import encoding as E


def test_every_text_counts(spark):
    """Each of 3,000 documents has a word of its own three times: all of their pairs are known, whatever the language or the length."""
    own = lambda i: chr(0x0E01 + i % 40) + chr(0x1D00 + i // 40)
    rows = [(["aa", f"b{i % 50}", None][i % 3], " ".join([own(i)] * 3 + ["plain words."] * (i % 7 == 0) * 400)) for i in range(3_000)]
    rows = spark.createDataFrame(rows, "lang string, text string")
    for chars in (4_000_000, 60_000):
        model = E.fit_on(rows, chars=chars, rare=10**9)
        assert {own(i) for i in range(3_000)} <= model.pairs
        assert len(model.dictionaries) == 41 and {"", "aa"} <= set(model.dictionaries)


def test_damage_is_told_by_counts_of_the_whole_table(spark):
    """A damaged run is found however often it stands, if its decoding is three times as frequent in all."""
    sound, torn = "le café ferme. ", "le cafÃ© ferme. "
    rows = spark.range(4_000).select(F.lit("fr").alias("lang"), F.concat(F.when(F.col("id") % 5 == 0, torn).otherwise(sound), F.col("id").cast("string")).alias("text"))
    model = E.fit_on(rows, chars=20_000)
    assert "fé" in model.pairs and not any("Ã" in p for p in model.pairs)
    assert model.restore(torn + "9")[0] == sound + "9"


def test_merged_dictionaries_compress_like_one(spark):
    words = [f"word{i:03}é" for i in range(400)]
    rows = spark.range(3_000).select(F.lit("fr").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array(*map(F.lit, words))[F.pmod(F.xxhash64("id", i), F.lit(400)).cast("int")]), " ").alias("text"))
    texts = [r.text for r in rows.limit(200).collect()]
    one, many = E.fit_on(rows), E.fit_on(rows, chars=20_000, merge=4)
    assert sum(many.length(texts)) < 1.1 * sum(one.length(texts)) and list(many.dictionaries) == ["fr"]
