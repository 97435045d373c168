"""Queries on reference integrity and skewed keys, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators.references import ReferenceField, orphan_references, orphan_report
from recallgrid.operators.skew import dominant_keys, tree_aggregate
from recallgrid.session import read_table


def p4_found(spark, sf_dir):
    edges, feedback = read_table(spark, sf_dir, "edges"), read_table(spark, sf_dir, "feedback")
    fields = [
        ReferenceField("edges", "src", "updated", edges),
        ReferenceField("edges", "dst", "updated", edges),
        ReferenceField("feedback", "node_id", "ts", feedback),
    ]
    return orphan_references(fields, read_table(spark, sf_dir, "nodes"), read_table(spark, sf_dir, "removals"))


def p4_report(spark, sf_dir):
    return orphan_report(p4_found(spark, sf_dir))


def p5_found(spark, sf_dir):
    postings = read_table(spark, sf_dir, "postings_v2")
    return dominant_keys(postings, "tid", share=0.03).select("tid")


def p5_results(spark, sf_dir):
    """Per tid: rows, nodes, sum of tf, and the three largest tf with their nodes."""
    out = tree_aggregate(read_table(spark, sf_dir, "postings_v2"), "tid", "nid", "tf")
    shown = F.transform("top", lambda x: F.concat(x["record"].cast("string"), F.lit(":"), x["value"].cast("long").cast("string")))
    return out.select("tid", "n_rows", F.col("n_records").alias("n_nodes"), F.round("value_sum", 6).alias("sum_tf"), F.array_join(shown, " ").alias("top_tf"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_results": p5_results}

_ORPHANS = """
with refs as (
  select 'edges' as ref_table, 'src' as ref_field, src as ref_id, updated as t from edges
  union all select 'edges', 'dst', dst, updated from edges
  union all select 'feedback', 'node_id', node_id, ts from feedback
), gone as (select distinct node_id from removals)
select distinct r.ref_table, r.ref_field, strftime(make_timestamp(cast(floor(r.t) as bigint) * 1000000), '%Y-%m') as ref_month, r.ref_id,
  case when n.id is not null then 'later' when g.node_id is not null then 'removed' else 'never' end as state
from refs r left join nodes n on n.id = r.ref_id left join gone g on g.node_id = r.ref_id
where r.ref_id is not null and (n.id is null or n.indexed_at > r.t)
"""

ORACLES = {
    "p4_found": _ORPHANS,
    "p4_report": f"select ref_table, ref_field, ref_month, state, count(*) as n_ids from ({_ORPHANS}) group by all",
    "p5_found": "select tid from postings_v2 where tid is not null group by tid having count(*) > 0.03 * (select count(*) from postings_v2)",
    "p5_results": """
with per_node as (
  select tid, nid, count(*) as n, max(case when tf > 0 and not isnan(tf) then tf end) as v from postings_v2 where tid is not null group by tid, nid
), ranked as (
  select *, row_number() over (partition by tid order by v desc nulls last, nid) as i from per_node
)
select tid, cast(sum(n) as bigint) as n_rows, count(v) as n_nodes, round(coalesce(sum(v), 0), 6) as sum_tf,
  coalesce(string_agg(case when i <= 3 and v is not null then nid || ':' || cast(v as bigint) end, ' ' order by i), '') as top_tf
from ranked group by tid
""",
}
