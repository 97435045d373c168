"""Hybrid retrieval over the stored tables, for the batch of queries that ``probe_nodes`` names.

A query asks for nodes like the probe: its terms are the probe node's terms, its vector the node's vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recallgrid.operators import dense, features, fusion, graph, lexical, metrics, ranker
from recallgrid.operators.skew import hot_split_join
from recallgrid.plans.corpus import _words_of
from recallgrid.session import cut_lineage, numbered, read_table

NOW = 1_770_000_000.0
SEED_K, SLICE_K, EXPAND_K = 24, 96, 16


def _nodes(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "nodes").withColumnRenamed("id", "node_id").drop("indexed_at")
    ids = read_table(spark, sf_dir, "node_map").select("nid", F.col("id").alias("node_id"))
    return nodes.join(ids, "node_id")


def _queries(spark, sf_dir):
    probes = read_table(spark, sf_dir, "probe_nodes").select(F.col("probe_id").alias("qid"), "nid")
    return probes.join(read_table(spark, sf_dir, "node_map"), "nid").select("qid", "nid", F.col("id").alias("node_id"))


def _index(spark, sf_dir):
    rows = read_table(spark, sf_dir, "postings_v2").filter("tf > 0 and not isnan(tf) and nid is not null and tid is not null").groupBy("nid", "tid").agg(F.max("tf").alias("tf"))
    lengths = _nodes(spark, sf_dir).select("nid", "node_id", F.col("text_len").alias("doc_len"))
    return rows.join(lengths, "nid").select(F.col("tid").alias("term"), "node_id", "tf", "doc_len")


def _vectors(spark, sf_dir):
    rows = dense.well_formed(read_table(spark, sf_dir, "vectors"), 64)
    return rows.groupBy("node_id").agg(F.min("vec").alias("vec"))


def _edges(spark, sf_dir):
    return graph.latest_edges(read_table(spark, sf_dir, "edges"))


def _lexical(spark, sf_dir):
    """The queries' terms, the index, their document frequencies, and the corpus statistics."""
    index = cut_lineage(_index(spark, sf_dir))
    stats = _nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("text_len", F.lit(0))).alias("mean")).first()
    terms = cut_lineage(_queries(spark, sf_dir).join(index, "node_id").select("qid", "term", F.lit(1.0).alias("weight")))
    df = cut_lineage(lexical.document_frequency(terms, index))
    return terms, index, df, max(1, stats["n"]), max(1.0, stats["mean"] or 0.0)


def _best(spark, sf_dir, k):
    return lexical.bm25_top_k(*_lexical(spark, sf_dir), k)


def _cosine(spark, sf_dir):
    vectors = cut_lineage(_vectors(spark, sf_dir))
    asked = _queries(spark, sf_dir).join(vectors, "node_id").select("qid", "vec")
    return dense.cosine_top_k(asked, vectors, SLICE_K)


def _seeds(bm25, cosine):
    return fusion.reciprocal_rank_fusion([bm25, cosine.filter(F.col("rank") < SEED_K)])


def _walks(spark, sf_dir, rrf, others=None, digits=None):
    adj = cut_lineage(graph.adjacency(_edges(spark, sf_dir), NOW))
    return graph.pagerank(adj, rrf.withColumnRenamed("rrf", "score"), tolerance=None, others=others, digits=digits)


def _stages(spark, sf_dir, others):
    corpus = _lexical(spark, sf_dir)
    cosine = cut_lineage(_cosine(spark, sf_dir))
    rrf = cut_lineage(_seeds(lexical.bm25_top_k(*corpus, SEED_K), cosine))
    walks = cut_lineage(_walks(spark, sf_dir, rrf, others))
    return corpus, cosine, rrf, walks


def _candidates(spark, sf_dir):
    corpus, cosine, rrf, walks = _stages(spark, sf_dir, others=EXPAND_K)
    chosen = cut_lineage(rrf.select("qid", "node_id").unionByName(graph.expansion(walks, rrf, EXPAND_K).select("qid", "node_id")))
    bm25 = lexical.bm25_of(chosen, *corpus)
    titles = _queries(spark, sf_dir).join(_nodes(spark, sf_dir).select("node_id", F.col("title").alias("q_title")), "node_id").select("qid", "q_title")
    nodes = _nodes(spark, sf_dir)
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), " "), lambda w: F.length(w) > 1))
    asked = F.filter(F.split(F.lower(F.coalesce("q_title", F.lit(""))), " "), lambda w: F.length(w) > 1)
    return features.candidate_features(chosen.join(titles, "qid"), bm25, cosine, rrf, walks, nodes, NOW, F.arrays_overlap(own, asked))


def _observed(spark, sf_dir):
    """Normaliser of the features logged with feedback, one row."""
    rows = ranker.usable_feedback(read_table(spark, sf_dir, "feedback"))
    named = rows.select(*[F.col("features")[i].cast("double").alias(f) for i, f in enumerate(features.FEATURES)])
    return features.normaliser(named)


def _ranked(spark, sf_dir):
    rows = _candidates(spark, sf_dir).join(F.broadcast(_observed(spark, sf_dir)))  # one row
    return rows.withColumn("score", features.linear_score() + features.trust_bonus(NOW)).withColumn("sources", features.source_labels())


def stored_bm25(spark, sf_dir):
    return _best(spark, sf_dir, SEED_K).select("qid", "node_id", F.round("score", 6).alias("score"), "rank")


def cosine_topk(spark, sf_dir):
    return _cosine(spark, sf_dir).select("qid", "node_id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark, sf_dir):
    return _seeds(_best(spark, sf_dir, SEED_K), _cosine(spark, sf_dir)).select("qid", "node_id", F.round("rrf", 9).alias("rrf"))


def ppr_by_type(spark, sf_dir):
    """All nodes in reach of each query: too many rows to be kept before they are written."""
    return _walks(spark, sf_dir, cut_lineage(_seeds(_best(spark, sf_dir, SEED_K), _cosine(spark, sf_dir))), digits=8)


def graph_expand(spark, sf_dir):
    _, _, rrf, walks = _stages(spark, sf_dir, others=EXPAND_K)
    return graph.expansion(walks, rrf).select("qid", "node_id", F.round("score", 8).alias("score"))


def features14(spark, sf_dir):
    return _candidates(spark, sf_dir).select("qid", "node_id", *[F.round(f, 6).alias(f) for f in features.FEATURES])


def hybrid_search(spark, sf_dir):
    """The eight best nodes per query."""
    best = fusion.top_k(_ranked(spark, sf_dir), 8)
    return best.select("qid", "node_id", F.round("score", 5).alias("score"), F.array_join("sources", ",").alias("sources"), "rank")


def search_kinds(spark, sf_dir):
    """The same for two kinds only, and without negative scores."""
    kept = features.above(features.of_kinds(_ranked(spark, sf_dir), ["fact", "note"]), 0.0)
    return fusion.top_k(kept, 8).select("qid", "node_id", "kind", F.round("score", 5).alias("score"), "rank")


def normaliser_stats(spark, sf_dir):
    row = _observed(spark, sf_dir)
    one = [F.struct(F.lit(f).alias("feature"), F.round(f"mu_{f}", 6).alias("mu"), F.round(f"var_{f}", 6).alias("var")) for f in features.FEATURES]
    return row.select(F.explode(F.array(*one)).alias("s")).select("s.*")


def zscore(spark, sf_dir):
    """Normalised features and linear score of each usable row of the log."""
    rows = ranker.usable_feedback(read_table(spark, sf_dir, "feedback"))
    named = rows.select("rid", *[F.col("features")[i].cast("double").alias(f) for i, f in enumerate(features.FEATURES)]).join(F.broadcast(_observed(spark, sf_dir)))
    return named.select("rid", *[F.round(features.z_score(f), 5).alias(f"z_{f}") for f in features.FEATURES[:3]], F.round(features.linear_score(), 5).alias("linear"))


def tag_edges(spark, sf_dir):
    rows = numbered(_nodes(spark, sf_dir).select("nid", "node_id", "tags"), "nid")
    return graph.tag_edges(rows).select("src", "dst", F.round("w", 6).alias("w"))


def adjacency(spark, sf_dir):
    return graph.adjacency(_edges(spark, sf_dir), NOW).select("etype", "src", "dst", F.round("p", 6).alias("p"))


def link_symmetric(spark, sf_dir):
    return graph.symmetric_links(_edges(spark, sf_dir).filter("etype = 0")).select("src", "dst", F.round("w", 6).alias("w"))


def edges_latest(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", "etype", "w", "updated")


def knn_edges(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))
    return dense.knn_edges(dense.well_formed(rows, 64)).select("src", "dst", F.round("w", 5).alias("w"))


def geometry_corr(spark, sf_dir):
    """Correlation of the pairwise cosines of the embeddings with those of their first 16 entries."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))
    return geometry(rows.select("node_id", "vec", F.slice("vec", 1, 16).alias("other")))


def _pair_sums(rows):
    """``n, sum x, sum y, sum xx, sum yy, sum xy`` over all pairs of ``rows(node_id, vec, other)`` with the cosines x of
    ``vec`` and y of ``other``: of unit rows A and B, the Gram and cross matrices and the column sums have them all."""
    good = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0)

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                a, b = (dense.unit(dense.matrix(batch.column(c))) for c in ("vec", "other"))
                own = [a.T @ a, b.T @ b, a.T @ b, a.sum(axis=0), b.sum(axis=0)]
                n, sums = n + len(a), own if sums is None else [s + o for s, o in zip(sums, own)]
        if sums is not None:
            flat = np.concatenate([np.ravel(s) for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([a.shape[1]]), pa.array([b.shape[1]]), pa.array([flat.tolist()])], names=["n", "p", "q", "sums"])

    parts = rows.filter(good("vec") & good("other")).select("vec", "other").mapInArrow(run, "n long, p long, q long, sums array<double>")
    total = parts.agg(F.sum("n").alias("n"), F.max("p").alias("p"), F.max("q").alias("q")).first()
    if not total["n"]:
        return 0, *[0.0] * 5
    # One row per entry of the matrices, whatever the number of rows.
    entries = parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").toArrow().column("s").to_numpy()
    n, p, q = total["n"], total["p"], total["q"]
    aa, bb, ab, a, b = np.split(entries, np.cumsum([p * p, q * q, p * q, p]))
    half = lambda x, own: (float((x**2).sum()) - own) / 2
    return n * (n - 1) // 2, half(a, n), half(b, n), half(aa, n), half(bb, n), half(ab, n)


def geometry(rows):
    """``corr, n_pairs``: the correlation of the cosines of all pairs of ``rows(node_id, vec, other)``, without pairing them."""
    m, x, y, xx, yy, xy = _pair_sums(rows)
    spread_x, spread_y = (max(0.0, s2 / m - (s / m) ** 2) ** 0.5 if m else 0.0 for s, s2 in ((x, xx), (y, yy)))
    corr = 0.0 if spread_x < 1e-9 or spread_y < 1e-9 else (xy / m - x * y / m**2) / (spread_x * spread_y)
    return rows.sparkSession.createDataFrame([(round(corr, 6), m)], "corr double, n_pairs long")


def hash_embed_norms(spark, sf_dir):
    """Hash embeddings of all documents: their length, which is 1 or (without tokens) 0."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("body"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return dense.hash_embed(docs).select(F.col("node_id").alias("doc_id"), F.round(F.sqrt(square), 4).alias("norm"))


def retrieval_quality(spark, sf_dir):
    """Quality of the lexical ranking against the probes' direct neighbours."""
    gold = _queries(spark, sf_dir).join(_edges(spark, sf_dir).select(F.col("src").alias("node_id"), "dst"), "node_id").select("qid", F.col("dst").alias("node_id"))
    per_query = metrics.retrieval_metrics(_best(spark, sf_dir, 10), gold)
    return per_query.select("qid", "r1", "r5", "r10", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


def quality_means(spark, sf_dir):
    return metrics.mean_metrics(retrieval_quality(spark, sf_dir)).select("n_queries", *[F.round(m, 5).alias(m) for m in ("r1", "r5", "r10", "mrr", "ndcg")])


def postings_spelled(spark, sf_dir):
    """Postings of the older layout: terms and node ids spelled out, counted per term."""
    ids = read_table(spark, sf_dir, "node_map").select("nid")
    rows = read_table(spark, sf_dir, "postings_v2").filter("tf > 0 and not isnan(tf)").join(ids, "nid", "left_semi")
    spelled = hot_split_join(rows, read_table(spark, sf_dir, "terms"), "tid").groupBy("term")
    return spelled.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tf"), 6).alias("tf"))


_NAMES = """stored_bm25 cosine_topk rrf_fusion ppr_by_type graph_expand features14 hybrid_search search_kinds normaliser_stats zscore tag_edges adjacency
link_symmetric edges_latest knn_edges geometry_corr hash_embed_norms retrieval_quality quality_means postings_spelled""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ── SQL ──────────────────────────────────────────────────────────────────────────────────────────────

_FEEDBACK = """fb as (select rid, ts, query_hash, list_transform(features, lambda x: x::double) as f, used, substr(query_hash, 16, 1) in ('0', '4', '8', 'c') as held_out from feedback
  where features is not null and used is not null and query_hash is not null and ts is not null and len(features) = 14 and len(list_filter(features, lambda x: x is null or isnan(x))) = 0)"""
_OBSERVED = _FEEDBACK + ",\nobs as (select " + ", ".join(f"coalesce(avg(f[{i}]), 0.0::double) as mu_{n}, coalesce(var_pop(f[{i}]), 1.0::double) as var_{n}" for i, n in enumerate(features.FEATURES, 1)) + " from fb)"
_Z = lambda value, n: f"greatest(-8.0::double, least(8.0::double, ({value} - mu_{n}) / sqrt(var_{n} + 1e-6::double)))"
_LINEAR = lambda value: " + ".join(f"{w}::double * {_Z(value(i, n), n)}" for i, (n, w) in enumerate(zip(features.FEATURES, features.LINEAR_WEIGHTS)))

_BASE = f"""with ns as (select m.nid, n.* exclude (indexed_at) from nodes n join node_map m on m.id = n.id),
q as (select p.probe_id as qid, m.nid, m.id as node_id from probe_nodes p join node_map m using (nid)),
idx as (select p.tid, ns.id as node_id, p.tf, ns.text_len from (select nid, tid, max(tf) as tf from postings_v2 where tf > 0 and not isnan(tf) and nid is not null and tid is not null group by nid, tid) p join ns using (nid)),
stat as (select greatest(1, count(*))::double as n, greatest(1.0::double, avg(coalesce(text_len, 0))) as mean from ns),
df as (select tid, count(*)::double as df from idx group by tid),
qt as (select q.qid, idx.tid from q join idx using (node_id)),
bm as (select qt.qid, idx.node_id, sum(ln(1 + (stat.n - df.df + 0.5::double) / (df.df + 0.5::double)) * idx.tf * 2.2::double / (idx.tf + 1.2::double * (0.25::double + 0.75::double * coalesce(idx.text_len::double, stat.mean) / stat.mean))) as score
  from qt join idx using (tid) join df using (tid) cross join stat group by qt.qid, idx.node_id),
bmr as (select *, row_number() over (partition by qid order by round(score, 9) desc, node_id) - 1 as rank from bm),
vs as (select node_id, list_transform(min(vec), lambda x: x::double) as vec from vectors where vec is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by node_id),
vn as (select node_id, vec, sqrt(list_dot_product(vec, vec)) as norm from vs),
cosr as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, node_id) - 1 as rank from (
  select q.qid, b.node_id, list_dot_product(a.vec, b.vec) / (a.norm * b.norm) as score from q join vn a on a.node_id = q.node_id cross join vn b)) where rank < {SLICE_K}),
rrf as (select qid, node_id, sum(1.0::double / (60 + rank)) as rrf from (select qid, node_id, rank from bmr where rank < {SEED_K} union all select qid, node_id, rank from cosr where rank < {SEED_K}) group by qid, node_id),
ed as (select src, dst, etype, (max({{'updated': updated, 'w': w}})).w as w, max(updated) as updated from edges where src is not null and dst is not null and etype is not null and w is not null and not isnan(w) group by src, dst, etype),
sym as (select src, dst, max(w) as w from (select src, dst, w from ed where etype = 0 union all select dst, src, w from ed where etype = 0) group by src, dst),
typed as (select * from (select 0 as etype, src, dst, w from sym union all select etype, src, dst, w from ed where etype in (1, 2)
  union all select etype, src, dst, w * pow(0.9::double, greatest(0.0::double, ({NOW}::double - updated) / 604800)) from ed where etype = 3) where w > 0),
adj as materialized (select etype, src, dst, w / sum(w) over (partition by etype, src) as p from typed),
has as materialized (select distinct etype, src from adj),
restart as materialized (select t.etype, qid, node_id, rrf / sum(rrf) over (partition by t.etype, qid) as v from rrf cross join (select distinct etype from adj) t),
r0 as (select qid, etype, node_id, v as score from restart)"""


def _round_sql(i: int) -> str:
    return f"""l{i} as materialized (select qid, etype, sum(0.5::double * score) as lost from r{i - 1} anti join has on has.etype = r{i - 1}.etype and has.src = r{i - 1}.node_id group by qid, etype),
r{i} as materialized (select qid, etype, node_id, sum(score) as score from (
  select r.qid, r.etype, a.dst as node_id, 0.5::double * r.score * a.p as score from r{i - 1} r join adj a on a.etype = r.etype and a.src = r.node_id
  union all select s.qid, s.etype, s.node_id, s.v * (0.5::double + coalesce(l.lost, 0)) from restart s left join l{i} l on l.qid = s.qid and l.etype = s.etype) group by qid, etype, node_id)"""


_WALKS = _BASE + ",\n" + ",\n".join(_round_sql(i) for i in range(1, 21))
_EXPAND = _WALKS + """,
ex as (select qid, node_id, score from (select *, row_number() over (partition by qid order by round(score, 9) desc, node_id) as i from (
  select qid, node_id, max(score) as score from r20 anti join rrf on rrf.qid = r20.qid and rrf.node_id = r20.node_id group by qid, node_id)) where i <= 16)"""
_TITLE_WORDS = lambda c: f"list_filter(string_split(lower(coalesce({c}, '')), ' '), lambda w: length(w) > 1)"
_DAYS = f"greatest(0.0::double, ({NOW}::double - coalesce(nullif(n.updated_at, 0), {NOW}::double)) / 86400)"
_CANDIDATES = _EXPAND + f""",
pp as (select qid, node_id, max(score) filter (etype = 0) as ppr_link, max(score) filter (etype = 1) as ppr_tag, max(score) filter (etype = 2) as ppr_knn, max(score) filter (etype = 3) as ppr_co from r20 group by qid, node_id),
cand as (select c.qid, c.node_id, n.kind, n.trust, n.trust_updated, bm.score is not null as by_bm25, coalesce(cosr.score, 0) > 0 as by_vector, rrf.rrf is null as by_graph,
  coalesce(bm.score, 0.0::double) as bm25, coalesce(cosr.score, 0.0::double) as cosine, coalesce(rrf.rrf, 0.0::double) as rrf, coalesce(ppr_link, 0.0::double) as ppr_link, coalesce(ppr_tag, 0.0::double) as ppr_tag,
  coalesce(ppr_knn, 0.0::double) as ppr_knn, coalesce(ppr_co, 0.0::double) as ppr_co, 1 / (1 + ln(1 + {_DAYS})) as recency, ln(1 + coalesce(n.access_count, 0)::double) as freq,
  coalesce(n.importance, 1.0::double) as importance, case when n.pinned then 1.0::double else 0.0::double end as pinned,
  case when list_has_any({_TITLE_WORDS('n.title')}, {_TITLE_WORDS('qn.title')}) then 1.0::double else 0.0::double end as title_hit,
  case n.kind when 'fact' then 1.0::double when 'insight' then 0.8::double when 'note' then 0.5::double when 'digest' then 0.4::double when 'turn' then 0.2::double else 0.5::double end as kind_prior,
  least(1.0::double, coalesce(n.text_len, 0) / 512.0::double) as len_norm
  from (select qid, node_id from rrf union all select qid, node_id from ex) c join q on q.qid = c.qid join ns qn on qn.nid = q.nid join ns n on n.id = c.node_id
  left join bm on bm.qid = c.qid and bm.node_id = c.node_id left join cosr on cosr.qid = c.qid and cosr.node_id = c.node_id left join rrf on rrf.qid = c.qid and rrf.node_id = c.node_id
  left join pp on pp.qid = c.qid and pp.node_id = c.node_id)"""
EFFECTIVE = f"""case when coalesce(trust, 0.5::double) = 0.5 or coalesce(trust_updated, 0) <= 0 then coalesce(trust, 0.5::double)
  else 0.5::double + (trust - 0.5::double) * pow(0.5::double, greatest(0.0::double, ({NOW}::double - trust_updated) / 86400) / 45) end"""
_RANKED = _CANDIDATES + f""",
{_OBSERVED},
scored as (select qid, node_id, kind, by_bm25, by_vector, by_graph, {_LINEAR(lambda i, n: n)} + ({EFFECTIVE} - 0.5::double) * 4 as score from cand cross join obs)"""

_DOT = "list_dot_product({a}, {b})"
ORACLES = {
    "stored_bm25": _BASE + f" select qid, node_id, round(score, 6) as score, cast(rank as int) as rank from bmr where rank < {SEED_K}",
    "cosine_topk": _BASE + " select qid, node_id, round(score, 6) as score, cast(rank as int) as rank from cosr",
    "rrf_fusion": _BASE + " select qid, node_id, round(rrf, 9) as rrf from rrf",
    "ppr_by_type": _WALKS + " select qid, etype, node_id, round(score, 8) as score from r20",
    "graph_expand": _EXPAND + " select qid, node_id, round(score, 8) as score from ex",
    "features14": _CANDIDATES + " select qid, node_id, " + ", ".join(f"round({f}, 6) as {f}" for f in features.FEATURES) + " from cand",
    "hybrid_search": _RANKED
    + """ select qid, node_id, round(score, 5) as score, concat_ws(',', case when by_bm25 then 'bm25' end, case when by_vector then 'vector' end, case when by_graph then 'graph' end) as sources, cast(i - 1 as int) as rank
      from (select *, row_number() over (partition by qid order by round(score, 9) desc, node_id) as i from scored) where i <= 8""",
    "search_kinds": _RANKED
    + """ select qid, node_id, kind, round(score, 5) as score, cast(i - 1 as int) as rank
      from (select *, row_number() over (partition by qid order by round(score, 9) desc, node_id) as i from scored where kind in ('fact', 'note') and score >= 0) where i <= 8""",
    "normaliser_stats": f"with {_OBSERVED} " + " union all ".join(f"select '{n}' as feature, round(mu_{n}, 6) as mu, round(var_{n}, 6) as var from obs" for n in features.FEATURES),
    "zscore": f"with {_OBSERVED} select rid, " + ", ".join(f"round({_Z(f'f[{i}]', n)}, 5) as z_{n}" for i, n in enumerate(features.FEATURES[:3], 1)) + f", round({_LINEAR(lambda i, n: f'f[{i + 1}]')}, 5) as linear from fb cross join obs",
    "tag_edges": """with ns as (select row_number() over (order by m.nid) - 1 as seq, n.id, list_distinct(list_filter(n.tags, lambda t: t is not null)) as tags from nodes n join node_map m on m.id = n.id),
      t as (select seq, id, unnest(tags) as tag from ns where tags is not null),
      f as (select seq, id, row_number() over (partition by tag order by seq) - 1 as df, list(id) over (partition by tag order by seq rows between 6 preceding and 1 preceding) as mates from t),
      l as (select id as src, unnest(mates) as dst, 0.5::double * ln(1 + greatest(1, seq)::double / df) as w from f where df >= 2 and df <= greatest(40, floor(greatest(1, seq) * 0.3::double))),
      m as (select src, dst, max(w) as w from l group by src, dst)
      select src, dst, round(w, 6) as w from (select *, row_number() over (partition by src order by round(w, 9) desc, dst) as i from m) where i <= 12""",
    "adjacency": _BASE + " select etype, src, dst, round(p, 6) as p from adj",
    "link_symmetric": _BASE + " select src, dst, round(w, 6) as w from sym",
    "edges_latest": _BASE + " select src, dst, etype, w, updated from ed",
    "knn_edges": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from e),
      s as (select a.vec_id as src, b.vec_id as dst, list_dot_product(a.v, b.v) / (a.norm * b.norm) as w from n a join n b on b.vec_id < a.vec_id and b.vec_id >= a.vec_id - 4096)
      select src, dst, round(w, 5) as w from (select *, row_number() over (partition by src order by w desc, dst) as i from s) where i <= 6 and w >= 0.25""",
    "geometry_corr": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, list_transform(embedding[1:16], lambda x: x::double) as o from embeddings),
      n as (select vec_id, v, o, sqrt(list_dot_product(v, v)) as nv, sqrt(list_dot_product(o, o)) as no from e)
      select round(corr(list_dot_product(a.v, b.v) / (a.nv * b.nv), list_dot_product(a.o, b.o) / (a.no * b.no)), 6) as corr, count(*) as n_pairs from n a join n b on a.vec_id < b.vec_id""",
    "retrieval_quality": _BASE
    + """, gold as (select distinct q.qid, ed.dst as node_id from q join ed on ed.src = q.node_id), sz as (select qid, count(*) as n from gold group by qid),
      h as (select b.qid, min(b.rank) as first, sum(1.0::double / log2(b.rank + 2)) as dcg from bmr b semi join gold g on g.qid = b.qid and g.node_id = b.node_id where b.rank < 10 group by b.qid)
      select qid, case when first < 1 then 1.0::double else 0.0::double end as r1, case when first < 5 then 1.0::double else 0.0::double end as r5, case when first < 10 then 1.0::double else 0.0::double end as r10,
        round(coalesce(1.0::double / (first + 1), 0), 6) as mrr, round(coalesce(dcg / list_sum(list_transform(range(0, least(n, 10)), lambda i: 1.0::double / log2(i + 2))), 0), 6) as ndcg from sz left join h using (qid)""",
    "postings_spelled": """select t.term, count(*) as n, round(sum(p.tf), 6) as tf from postings_v2 p join terms t using (tid) where p.tf > 0 and not isnan(p.tf) and p.nid in (select nid from node_map) group by t.term""",
}
ORACLES["hash_embed_norms"] = f"select doc_id, case when coalesce(len({_words_of('text')}), 0) > 0 then 1.0::double else 0.0::double end as norm from documents"
ORACLES["quality_means"] = f"select count(*) as n_queries, round(avg(r1), 5) as r1, round(avg(r5), 5) as r5, round(avg(r10), 5) as r10, round(avg(mrr), 5) as mrr, round(avg(ndcg), 5) as ndcg from ({ORACLES['retrieval_quality']})"
