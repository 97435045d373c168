"""Queries on interaction logs and on the upkeep of the stored tables, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recallgrid.functions.text import is_held_out, query_hash
from recallgrid.operators import graph, learning, ranker
from recallgrid.operators.features import FEATURES, LINEAR_WEIGHTS, effective_trust
from recallgrid.plans.retrieval import EFFECTIVE, NOW, _FEEDBACK
from recallgrid.session import ensure_checkpoint_dir, read_table
from recallgrid.sources import store
from recallgrid.streaming.feedback import run_available, trust_stream, usage_per_window


def _feedback(spark, sf_dir):
    return read_table(spark, sf_dir, "feedback")


def _nodes(spark, sf_dir):
    return read_table(spark, sf_dir, "nodes").withColumnRenamed("id", "node_id")


def _coaccess(spark, sf_dir, **options):
    used = _feedback(spark, sf_dir).filter("used").select(F.col("query_hash").alias("query"), "node_id", "ts")
    return learning.coaccess_edges(used, **options).select("src", "dst", F.round("w", 6).alias("w"), "updated")


def hebbian_coaccess(spark, sf_dir):
    return _coaccess(spark, sf_dir)


def coaccess_pruned(spark, sf_dir):
    return _coaccess(spark, sf_dir, floor=0.05, now=NOW)


def trust_fold(spark, sf_dir):
    events = _feedback(spark, sf_dir).select("node_id", "ts", F.col("used").alias("helpful"), "rid")
    return learning.trust_fold(events).select("node_id", F.round("trust", 6).alias("trust"), "trust_updated")


def trust_effective(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", F.round(effective_trust(F.col("trust"), F.col("trust_updated"), NOW), 6).alias("trust"))


def _judged(spark, sf_dir):
    """Held-out pairs of used and unused nodes; the cosine feature alone plays the learner."""
    rows = ranker.usable_feedback(_feedback(spark, sf_dir)).filter("held_out")
    linear = F.lit(0.0)
    for i, w in enumerate(LINEAR_WEIGHTS):
        linear = linear + F.col("features")[i].cast("double") * w
    scored = rows.select("query_hash", "used", F.col("features")[1].cast("double").alias("learned"), F.round(linear, 9).alias("linear"))
    good = scored.filter("used").select("query_hash", F.col("learned").alias("lu"), F.col("linear").alias("hu"))
    bad = scored.filter("not used").select("query_hash", F.col("learned").alias("lg"), F.col("linear").alias("hg"))
    return ranker.referee_counts(good.join(bad, "query_hash"), F.col("lu") > F.col("lg"), F.col("hu") > F.col("hg"))


def referee_counts(spark, sf_dir):
    return _judged(spark, sf_dir)


def blend_gate(spark, sf_dir):
    n = (F.col("wins") + F.col("losses")).cast("double")
    counts = _judged(spark, sf_dir)
    # Both directions, so that the open and the closed gate are seen.
    return counts.select(
        "events",
        F.round(ranker.wilson_lower(F.col("wins").cast("double"), n), 6).alias("lower"),
        F.round(ranker.blend_share(F.col("events"), F.col("wins"), F.col("losses")), 6).alias("share"),
        F.round(ranker.blend_share(F.col("events"), F.col("events"), F.lit(0)), 6).alias("share_if_all_won"),
    )


def ranker_gate(spark, sf_dir):
    """The learner trained on the log, against the linear score on the queries it never saw."""
    learner = ranker.train_on_log(_feedback(spark, sf_dir))
    return ranker.gate(_feedback(spark, sf_dir), learner).withColumn("share", F.round("share", 6))


def mlp_score(spark, sf_dir):
    learner = ranker.train_on_log(_feedback(spark, sf_dir))
    scored = ranker.score_rows(ranker.usable_feedback(_feedback(spark, sf_dir)).select("rid", "features"), learner)
    return scored.select("rid", F.round("learned", 5).alias("learned"), F.round("linear", 5).alias("linear"))


def holdout_split(spark, sf_dir):
    return _feedback(spark, sf_dir).select("query_hash").distinct().withColumn("held_out", is_held_out(F.col("query_hash")))


def query_tokens(spark, sf_dir):
    title = F.coalesce("title", F.lit(""))
    return _nodes(spark, sf_dir).select("node_id", query_hash(title).alias("hash"), query_hash(F.concat(title, F.lit("|"), F.lit(str(int(NOW))))).alias("token"))


def ignored_nodes(spark, sf_dir):
    """Per query the number of nodes shown but not used."""
    rows = _feedback(spark, sf_dir).filter("node_id is not null")
    shown = rows.filter("shown").select("query_hash", "node_id").distinct()
    used = rows.filter("used").select("query_hash", "node_id").distinct()
    return shown.join(used, ["query_hash", "node_id"], "left_anti").groupBy("query_hash").agg(F.count(F.lit(1)).alias("n_ignored"))


def access_touch(spark, sf_dir):
    log = _feedback(spark, sf_dir).filter("shown").select("node_id", "ts")
    return store.record_access(_nodes(spark, sf_dir).select("node_id", "access_count", "last_access"), log)


def touch_updated(spark, sf_dir):
    at = _feedback(spark, sf_dir).filter("used and node_id is not null").groupBy("node_id").agg(F.max("ts").alias("ts"))
    return store.touch(_nodes(spark, sf_dir).select("node_id", "updated_at"), at)


def feedback_ring(spark, sf_dir):
    log = _feedback(spark, sf_dir).select("rid", "ts", "query_hash", "node_id")
    return store.append_capped(log, log.limit(0), 4096)


def replay_window(spark, sf_dir):
    log = _feedback(spark, sf_dir).select("rid", "ts", "query_hash", "node_id")
    return store.newest(log, 256, [F.col("ts").desc_nulls_last(), F.col("rid").desc()])


def recent_queries(spark, sf_dir):
    """The bounded registry of queries that can still get feedback."""
    log = _feedback(spark, sf_dir).groupBy("query_hash").agg(F.max("ts").alias("ts"))
    return store.newest(log, 64, [F.col("ts").desc_nulls_last(), F.col("query_hash")])


def remove_cascade(spark, sf_dir):
    """Rows that each table keeps once the removed nodes are gone from it."""
    gone = read_table(spark, sf_dir, "removals").select("node_id").distinct()
    ids = read_table(spark, sf_dir, "node_map").withColumnRenamed("id", "node_id")
    postings = read_table(spark, sf_dir, "postings_v2").select("nid").join(ids, "nid", "left")
    edges = read_table(spark, sf_dir, "edges").select("src", "dst")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    tables = {"nodes": _nodes(spark, sf_dir), "vectors": read_table(spark, sf_dir, "vectors"), "feedback": _feedback(spark, sf_dir), "postings_v2": postings}
    kept = {name: rows.select("node_id").join(gone, "node_id", "left_anti") for name, rows in tables.items()} | {"edges": edges}
    out = None
    for name, rows in kept.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def upsert_trust(spark, sf_dir):
    """Nodes after the trust fold has replaced the rows it knows."""
    folded = learning.trust_fold(_feedback(spark, sf_dir).select("node_id", "ts", F.col("used").alias("helpful"), "rid")).select("node_id", "trust")
    nodes = _nodes(spark, sf_dir).select("node_id", "trust")
    return store.merge(nodes, folded.join(nodes, "node_id", "left_semi"), ["node_id"]).select("node_id", F.round("trust", 6).alias("trust"))


def edges_pruned(spark, sf_dir):
    return store.pruned(graph.latest_edges(read_table(spark, sf_dir, "edges")), graph.COACCESS, 0.6).select("src", "dst", "etype", "w")


def engine_stats(spark, sf_dir):
    counts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in ("nodes", "feedback")]
    edges = read_table(spark, sf_dir, "edges").groupBy("etype").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edges:"), F.col("etype").cast("string")).alias("what"), "n")
    return counts[0].unionByName(counts[1]).unionByName(edges)


def nodes_lookup(spark, sf_dir):
    """Rows of the probes' nodes, decoded as the store decodes an older layout."""
    ids = read_table(spark, sf_dir, "probe_nodes").join(read_table(spark, sf_dir, "node_map"), "nid").select(F.col("id").alias("node_id"))
    rows = _nodes(spark, sf_dir).join(ids.distinct(), "node_id", "left_semi")
    legacy = rows.withColumn("tags", F.to_json("tags")).withColumn("pinned", F.col("pinned").cast("int"))
    decoded = store.decode_nodes(legacy)
    return decoded.select("node_id", "kind", "title", F.size("tags").alias("n_tags"), "pinned", "trust")


def _feedback_stream(spark, sf_dir):
    schema = _feedback(spark, sf_dir).schema
    # A pattern, as a stream doesn't take the path of a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/feedback.parque[t]")


def _streamed(spark, stream, mode, keys):
    """The last row per key that a stream emits, through a table in the shared folder."""
    out = f"{ensure_checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    run_available(stream, mode, write)
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("v")).select(*keys, *[f"v.{c}" for c in values])


def stream_trust(spark, sf_dir):
    events = _feedback_stream(spark, sf_dir).select("node_id", "ts", F.col("used").alias("helpful"), "rid")
    out = _streamed(spark, trust_stream(events), "update", ["node_id"])
    return out.select("node_id", F.round("trust", 6).alias("trust"), "trust_updated")


def stream_usage(spark, sf_dir):
    out = _streamed(spark, usage_per_window(_feedback_stream(spark, sf_dir).select("ts", "shown", "used"), late="3650 days"), "update", ["window_start"])
    return out.select(F.unix_seconds("window_start").alias("window_start"), "n_shown", "n_used")


_NAMES = """stream_trust stream_usage hebbian_coaccess coaccess_pruned trust_fold trust_effective referee_counts blend_gate ranker_gate mlp_score holdout_split query_tokens
ignored_nodes access_touch touch_updated feedback_ring replay_window recent_queries remove_cascade upsert_trust edges_pruned engine_stats nodes_lookup""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ── SQL ──────────────────────────────────────────────────────────────────────────────────────────────

_PAIR_TIMES = """with u as (select query_hash as q, node_id as n, min(ts) as ts from feedback where used and query_hash is not null and node_id is not null and ts is not null group by all),
w as (select q, min(ts) as at from u group by q), t as (select a.n as src, b.n as dst, list(w.at order by w.at) as times from u a join u b on a.q = b.q and a.n <> b.n join w on w.q = a.q group by all),
s as (select src, dst, list_reduce(list_transform(times, lambda x: {'w': 0.0::double, 'at': x}), lambda s, e: {'w': s.w * pow(0.9::double, (e.at - s.at) / 604800) + 0.3::double * (1 - s.w * pow(0.9::double, (e.at - s.at) / 604800)), 'at': e.at},
  {'w': 0.0::double, 'at': times[1]}) as s from t)"""
_TRUST = """with t as (select node_id, list({'t': 0.0::double, 'at': ts, 'h': used} order by ts, rid) as steps from feedback where node_id is not null and ts is not null and used is not null group by node_id),
s as (select node_id, list_reduce(steps, lambda s, e: {'t': least(1.0::double, greatest(0.0::double, (case when s.t = 0.5 or s.at <= 0 then s.t else 0.5::double + (s.t - 0.5::double) * pow(0.5::double, greatest(0.0::double, (e.at - s.at) / 86400) / 45) end)
  + case when e.h then 0.05::double else -0.1::double end)), 'at': e.at, 'h': e.h}, {'t': 0.5::double, 'at': 0.0::double, 'h': true}) as s from t)"""
_JUDGED = f"""with {_FEEDBACK}, sc as (select query_hash, used, f[2] as learned, round({" + ".join(f"f[{i}] * {w}::double" for i, w in enumerate(LINEAR_WEIGHTS, 1))}, 9) as linear from fb where held_out),
c as (select count(*) as events, count(*) filter (a.learned > b.learned and not a.linear > b.linear) as wins, count(*) filter (a.linear > b.linear and not a.learned > b.learned) as losses
  from sc a join sc b on a.query_hash = b.query_hash and a.used and not b.used)"""
_LOWER = "case when {n} > 0 then ({w}::double / {n} + 4.5::double / {n} - 3 * sqrt(({w}::double / {n}) * (1 - {w}::double / {n}) / {n} + 9.0::double / (4.0::double * {n} * {n}))) / (1 + 9.0::double / {n}) else 0.0::double end"
_SHARE = "case when events < 100 or {n} < 20 or {low} <= 0.52 then 0.0::double else least(0.7::double, 5 * ({low} - 0.52::double)) end"
_L1 = _LOWER.format(n="(wins + losses)::double", w="wins")
_L2 = _LOWER.format(n="events::double", w="events")

ORACLES = {
    "stream_trust": _TRUST + " select node_id, round(s.t, 6) as trust, s.at as trust_updated from s",
    "stream_usage": "select cast(floor(ts / 86400) as bigint) * 86400 as window_start, count(*) filter (shown) as n_shown, count(*) filter (used) as n_used from feedback where ts is not null group by 1",
    "hebbian_coaccess": _PAIR_TIMES + " select src, dst, round(s.w, 6) as w, s.at as updated from s",
    "coaccess_pruned": _PAIR_TIMES + f" select src, dst, round(s.w, 6) as w, s.at as updated from s where s.w * pow(0.9::double, ({NOW}::double - s.at) / 604800) >= 0.05::double",
    "trust_fold": _TRUST + " select node_id, round(s.t, 6) as trust, s.at as trust_updated from s",
    "trust_effective": f"select id as node_id, round({EFFECTIVE}, 6) as trust from nodes",
    "referee_counts": _JUDGED + " select events, wins, losses from c",
    "blend_gate": _JUDGED + f" select events, round({_L1}, 6) as lower, round({_SHARE.format(n='(wins + losses)', low=_L1)}, 6) as share, round({_SHARE.format(n='events', low=_L2)}, 6) as share_if_all_won from c",
    "holdout_split": "select distinct query_hash, substr(query_hash, 16, 1) in ('0', '4', '8', 'c') as held_out from feedback",
    "query_tokens": f"select id as node_id, substr(sha1(coalesce(title, '')), 1, 16) as hash, substr(sha1(coalesce(title, '') || '|{int(NOW)}'), 1, 16) as token from nodes",
    "ignored_nodes": """select query_hash, count(*) as n_ignored from (select distinct query_hash, node_id from feedback where shown and node_id is not null
      except select query_hash, node_id from feedback where used and node_id is not null) group by query_hash""",
    "access_touch": """select n.id as node_id, coalesce(n.access_count, 0) + coalesce(l.c, 0) as access_count, greatest(n.last_access, l.ts) as last_access
      from nodes n left join (select node_id, count(*) as c, max(ts) as ts from feedback where shown and node_id is not null group by node_id) l on l.node_id = n.id""",
    "touch_updated": "select n.id as node_id, coalesce(l.ts, n.updated_at) as updated_at from nodes n left join (select node_id, max(ts) as ts from feedback where used and node_id is not null group by node_id) l on l.node_id = n.id",
    "feedback_ring": "select rid, ts, query_hash, node_id from feedback where rid > (select max(rid) from feedback) - 4096",
    "replay_window": "select rid, ts, query_hash, node_id from feedback order by ts desc nulls last, rid desc limit 256",
    "recent_queries": "select query_hash, max(ts) as ts from feedback group by query_hash order by ts desc nulls last, query_hash limit 64",
    "remove_cascade": """with g as (select distinct node_id from removals)
      select 'nodes' as table_name, count(*) as n from nodes where id not in (from g) union all select 'vectors', count(*) from vectors where node_id not in (from g)
      union all select 'feedback', count(*) from feedback where node_id is null or node_id not in (from g)
      union all select 'postings_v2', count(*) from postings_v2 p left join node_map m using (nid) where m.id is null or m.id not in (from g)
      union all select 'edges', count(*) from edges where (src is null or src not in (from g)) and (dst is null or dst not in (from g))""",
    "upsert_trust": _TRUST + " select n.id as node_id, round(case when s.node_id is null then n.trust else s.s.t end, 6) as trust from nodes n left join s on s.node_id = n.id",
    "edges_pruned": """select src, dst, etype, (max({'updated': updated, 'w': w})).w as w from edges where src is not null and dst is not null and etype is not null and w is not null and not isnan(w) group by src, dst, etype
      having not (etype = 3 and (max({'updated': updated, 'w': w})).w < 0.6)""",
    "engine_stats": "select 'nodes' as what, count(*) as n from nodes union all select 'feedback', count(*) from feedback union all select 'edges:' || etype, count(*) from edges group by etype",
    "nodes_lookup": """select id as node_id, kind, title, cast(coalesce(len(tags), 0) as int) as n_tags, coalesce(pinned, false) as pinned, coalesce(trust, 0.5::double) as trust from nodes
      where id in (select m.id from probe_nodes p join node_map m using (nid))""",
}
