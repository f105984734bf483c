"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encoding
from tessera.llm.components import connected_components
from tessera.llm.cutoff import DyadicCountTree
from tessera.llm.leakage import find_leaks
from tessera.llm.linkage import link
from tessera.llm.packing import pack, token_counts
from tessera.llm.topn import top_n
from tessera.operators.links import current_links, label, link_states, score_value
from tessera.shared import Scratch, small, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = current_links(table(spark, sf_dir, "market_links"), keep=("score",))
    scored = links.withColumn("value", score_value(F.col("score")))
    best = top_n(scored, "left_market_id", "salt", "value", ["right_market_id", "id"], 5)
    return best.select("left_market_id", F.col("id").alias("link_id"))


def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links come in two batches, as they would have arrived: those of the first half of the time, and what changed after. The
    tree is given each batch's node counts; a link that a later row replaces is withdrawn from it."""
    scratch = Scratch(spark, "cutoff")
    links = table(spark, sf_dir, "market_links")
    span = links.agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b"))
    middle = span.select(F.col("a") + (F.col("b") - F.col("a")) / 2).first()[0]
    known = link_states(links, F.lit(middle).cast("timestamp_ntz"), keep=("score", "topic"))
    rows = known.select(label(F.col("topic")).alias("topic"), F.col("id").alias("link_id"), score_value(F.col("score")).alias("value"), "was", "now")
    rows = scratch.write(rows.filter("topic is not null and topic <> '' and value is not null"), "links")
    targets = table(spark, sf_dir, "topic_targets").select(label(F.col("topic")).alias("topic"), "target_fraction")
    tree = DyadicCountTree(spark, f"{scratch.root}/tree")
    tree.add(rows.filter("was"), "topic", "value", "first")
    tree.add(rows.filter("was <> now"), "topic", "value", "second", F.when(F.col("now"), 1).otherwise(-1))
    current = rows.filter("now")
    return current, tree.cutoffs(current, "topic", "value", targets, "topic", "target_fraction", scratch)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cutoffs = _cutoffs(spark, sf_dir)
    c = small(cutoffs.select(F.col("source").alias("topic"), "cutoff"))
    return rows.join(c, "topic").filter("value >= cutoff").select("topic", "link_id")


def p2_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cutoffs = _cutoffs(spark, sf_dir)
    return cutoffs.select(F.col("source").alias("topic"), F.col("total").alias("n_links"), "cutoff", F.col("kept").alias("n_kept"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "markets")).pairs.filter("confidence >= 0.5")
    return found.select("market_id_a", "market_id_b", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("market_id_a", "market_id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = current_links(table(spark, sf_dir, "market_links"), keep=("status",))
    edges = links.filter(label(F.col("status")) == "CONFIRMED").select("left_market_id", "right_market_id")
    return connected_components(edges, "left_market_id", "right_market_id").select(F.col("group").alias("group_id"), F.col("vertex").alias("market_id"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), 2048)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoding.restore(docs, encoding.fit_on(docs)).filter("damaged")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(spark, sf_dir).select("doc_id", "restored", "chains")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_cutoffs": p2_cutoffs, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p6_containers": p6_containers, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_restored": p8_restored}

_CURRENT = """
c as (select * from (select *, row_number() over (partition by left_venue, left_market_id, right_venue, right_market_id
        order by updated_at desc nulls last, id desc) as rn from market_links where left_market_id is not null and right_market_id is not null and id is not null) where rn = 1),
s as (select *, case when score is null or isnan(score) then null when score > 1 then 1.0 when score <= 0 then 0.0 else score end as value from c)
"""
_RANKED = f"""
with {_CURRENT},
r as (select upper(trim(topic)) as topic, id as link_id, value from s where value is not null and trim(topic) <> ''),
n as (select topic, value, count(*) as k from r group by 1, 2),
a as (select topic, value, sum(k) over (partition by topic order by value desc) as kept, sum(k) over (partition by topic) as total from n),
x as (select a.topic, max(a.value) as cutoff from a join topic_targets t on upper(trim(t.topic)) = a.topic where kept >= t.target_fraction * total group by 1)
"""
SQL = {
    "p1_found": f"""
with {_CURRENT}
select left_market_id, id as link_id from (
  select *, row_number() over (partition by left_market_id order by value desc, right_market_id, id) as k from s where value is not null) where k <= 5
""",
    "p2_found": f"{_RANKED} select r.topic, r.link_id from r join x using (topic) where r.value >= x.cutoff",
    "p2_cutoffs": f"""{_RANKED}
select topic, cast(count(*) as bigint) as n_links, x.cutoff, cast(count(*) filter (where value >= cutoff) as bigint) as n_kept from r join x using (topic) group by topic, x.cutoff
""",
    "p5_found": f"""
with recursive {_CURRENT},
p as (select left_market_id as a, right_market_id as b from c where upper(trim(status)) = 'CONFIRMED'), e as (select a, b from p union select b, a from p),
g(v, m) using key (v) as (
  select distinct a, a from e
  union
  select e.b, min(g.m) from g join e on e.a = g.v join recurring.g r on r.v = e.b where g.m < r.m group by e.b)
select m as group_id, v as market_id from g
""",
}
