"""Queries of the training-data operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.llm.cooccurrence import pair_associations
from recallgrid.llm.distinctive import most_distinctive, term_weights
from recallgrid.llm.frequency import word_frequencies
from recallgrid.llm.mixing import mix_sources
from recallgrid.llm.neighbours import nearest_neighbours
from recallgrid.llm.packing import pack_texts, packing_report
from recallgrid.llm.similar_sets import expand_pairs, similar_sets
from recallgrid.llm.spam import FEATURES, spam_scores
from recallgrid.session import read_table


def p1_found(spark, sf_dir):
    weights = term_weights(read_table(spark, sf_dir, "postings_v2"), read_table(spark, sf_dir, "node_map"), only=read_table(spark, sf_dir, "probe_nodes"))
    return most_distinctive(weights).select("nid", "tid")


def p1_weights(spark, sf_dir):
    return term_weights(read_table(spark, sf_dir, "postings_v2"), read_table(spark, sf_dir, "node_map"))


def p2_counts(spark, sf_dir):
    return word_frequencies(read_table(spark, sf_dir, "postings_v2"), read_table(spark, sf_dir, "terms"), read_table(spark, sf_dir, "node_map"))


def p2_found(spark, sf_dir):
    return p2_counts(spark, sf_dir).filter("mark <> ''").select("tid", "mark")


def _used(spark, sf_dir):
    return read_table(spark, sf_dir, "feedback").filter("used")


def p3_found(spark, sf_dir):
    return pair_associations(_used(spark, sf_dir), "query_hash", "node_id", min_count=5, min_lift=8.0).select(F.col("item_a").alias("node_a"), F.col("item_b").alias("node_b"))


def p3_pairs(spark, sf_dir):
    out = pair_associations(_used(spark, sf_dir), "query_hash", "node_id")
    return out.select(F.col("item_a").alias("node_a"), F.col("item_b").alias("node_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def plain_tag(tag):
    """Blanks around, then one leading ``#``, then letter case don't count."""
    return F.lower(F.regexp_replace(F.trim(tag), "^#", ""))


def p6_found(spark, sf_dir):
    members, pairs = similar_sets(read_table(spark, sf_dir, "nodes"), "id", "tags", plain_tag)
    return expand_pairs(members, pairs).select("node_a", "node_b")


def p6_pairs(spark, sf_dir):
    """Pairs of class representatives with their similarity, and ``rep_a = rep_b`` rows with the class size."""
    members, pairs = similar_sets(read_table(spark, sf_dir, "nodes"), "id", "tags", plain_tag)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_nodes"))
    classes = sizes.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("similarity"), "n_nodes")
    links = pairs.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.round(F.col("shared") / F.col("joint"), 6).alias("similarity"), F.lit(None).cast("long").alias("n_nodes"))
    return classes.unionByName(links)


def p6_members(spark, sf_dir):
    """The class of equal sets to which each node belongs; with p6_pairs the whole result, without expanding copies."""
    return similar_sets(read_table(spark, sf_dir, "nodes"), "id", "tags", plain_tag)[0].select(F.col("id").alias("node_id"), "rep")


def p7_neighbours(spark, sf_dir):
    out = nearest_neighbours(read_table(spark, sf_dir, "vectors"), "node_id", "vec", 64, min_similarity=None, k=5)
    return out.select(F.col("id").alias("node_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "place")


def p7_found(spark, sf_dir):
    near = nearest_neighbours(read_table(spark, sf_dir, "vectors"), "node_id", "vec", 64, min_similarity=0.88, k=5)
    return near.select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def p8_containers(spark, sf_dir):
    return pack_texts(read_table(spark, sf_dir, "documents"))


def p8_report(spark, sf_dir):
    return packing_report(p8_containers(spark, sf_dir))


def p9_mixture(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))[1]


def p10_scores(spark, sf_dir):
    out = spam_scores(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "group", *[F.round(f, 6).alias(f) for f in FEATURES], F.round("distance", 4).alias("distance"), F.round("listed", 6).alias("listed"), "spam")


def p10_found(spark, sf_dir):
    return spam_scores(read_table(spark, sf_dir, "documents")).filter("spam").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_weights": p1_weights,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p6_members": p6_members,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}

_PAIRS = """
with used as (select distinct query_hash as q, node_id as i from feedback where used and query_hash is not null and node_id is not null),
counts as (select i, count(*) as n from used group by i), total as (select count(distinct q) as n from used),
ab as (select x.i as a, y.i as b, count(*) as n_ab from used x join used y on x.q = y.q and x.i < y.i group by all)
select a as node_a, b as node_b, n_ab, ca.n as n_a, cb.n as n_b, n_ab * cast(total.n as double) / (ca.n * cb.n) as lift
from ab join counts ca on ca.i = a join counts cb on cb.i = b cross join total
"""
_TAGS = """
with tagged as (
  select id, list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(regexp_replace(trim(t), '^#', ''))), lambda t: t is not null))) as s from nodes
), sets as (select id, s, min(id) over (partition by s) as rep, count(*) over (partition by s) as n from tagged where id is not null and len(s) >= 4),
"""
_TAG_PAIRS = """
pairs as (
  select x.id as a, y.id as b, len(list_intersect(x.s, y.s)) as shared, len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) as joint
  from {rows} x join {rows} y on x.id < y.id and len(x.s) * 10 >= len(y.s) * 7 and len(y.s) * 10 >= len(x.s) * 7 and list_has_any(x.s, y.s)
)
"""

ORACLES = {
    "p3_found": f"select node_a, node_b from ({_PAIRS}) where n_ab >= 5 and lift >= 8",
    "p3_pairs": f"select node_a, node_b, n_ab, n_a, n_b, round(lift, 6) as lift from ({_PAIRS})",
    "p6_found": _TAGS + _TAG_PAIRS.format(rows="sets") + "select a as node_a, b as node_b from pairs where shared * 10 >= joint * 7",
    "p6_members": _TAGS.rstrip().rstrip(",") + " select id as node_id, rep from sets",
    "p6_pairs": _TAGS
    + "reps as (select * from sets where id = rep), "
    + _TAG_PAIRS.format(rows="reps")
    + """select rep as rep_a, rep as rep_b, 1.0::double as similarity, n as n_nodes from reps
    union all select a, b, round(shared::double / joint, 6), null from pairs where shared * 10 >= joint * 7""",
}
