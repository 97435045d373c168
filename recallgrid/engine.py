"""The engine: index, search and learn over versioned tables, for batches of notes, queries and events."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.config import Config
from recallgrid.functions.text import content_digest, has_negation, is_held_out, lexical_tokens, query_hash
from recallgrid.operators import dense, distill, features, fusion, graph, hygiene, joins, learning, lexical, ranker
from recallgrid.session import cut_lineage, numbered
from recallgrid.sources import store as tables

#: Optional columns of notes: their type and default, as SQL.
NOTE = {
    "title": ("string", "''"),
    "kind": ("string", "'note'"),
    "tags": ("array<string>", "array()"),
    "links": ("array<string>", "array()"),
    "importance": ("double", "1.0D"),
    "pinned": ("boolean", "false"),
    "updated_at": ("double", "null"),
    "teacher_vec": ("array<float>", "null"),
    "teacher_model": ("string", "''"),
}


class MemoryEngine:
    """All verbs take and return DataFrames; searching changes nothing (see :meth:`record_access`)."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config, self.store = spark, config or Config(), tables.Store(spark, path)
        self._table = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **settings) -> "MemoryEngine":
        return cls(spark, path, Config(**settings))

    @classmethod
    def from_env(cls, spark: SparkSession, path: str, dotenv: str | None = None, **settings) -> "MemoryEngine":
        return cls(spark, path, Config.from_env(dotenv, **settings))

    def __enter__(self) -> "MemoryEngine":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._table is not None:
            self._table.unpersist()
            self._table = None

    # ── indexing ─────────────────────────────────────────────────────

    def _embedder(self):
        """The trained table as a broadcast of ``vocab_size`` rows, or nothing while it is the initial one."""
        if self._table is None:
            rows = self.store.read("embedder").orderBy("bucket").toArrow()
            if rows.num_rows:
                self._table = self.spark.sparkContext.broadcast(dense.matrix(rows.column("vec")).astype(np.float32))
        return self._table

    def _embed(self, rows: DataFrame, limit: int | None) -> DataFrame:
        c = self.config
        return dense.hash_embed(rows, c.vocab_size, c.dim, c.seed, limit, self._embedder())

    def index(self, notes: DataFrame, now: float | None = None) -> int:
        """Insert or replace ``notes(node_id, text, ...)`` (further columns: see ``NOTE``); returns the version.

        Notes whose digest is stored already only get their new time. New and changed notes are numbered
        after all others and linked to earlier notes by tags and similarity. Null ids are left out; of
        repeated ids one note is taken; a null text counts as empty.
        """
        c, now = self.config, time.time() if now is None else now
        rows = notes.filter("node_id is not null").dropDuplicates(["node_id"])
        for name, (kind, default) in NOTE.items():
            default = F.expr(default).cast(kind)
            rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), default) if name in rows.columns else default)
        body = F.when(F.col("title") != "", F.concat_ws("\n", "title", "text")).otherwise(F.coalesce("text", F.lit("")))
        teacher = F.when(F.col("teacher_vec").isNotNull(), F.col("teacher_model")).otherwise("")
        rows = rows.withColumn("body", body)
        digest = content_digest(F.col("body"), F.col("kind"), F.col("tags"), F.col("links"), F.col("importance"), F.col("pinned"), f"{c.dim}:{c.vocab_size}", teacher)
        rows = cut_lineage(rows.withColumn("content_sha", digest))
        base = self.store.version()
        nodes = self.store.read("nodes", base)
        same = tables.unchanged(rows, nodes).select("node_id", F.coalesce("updated_at", F.lit(None)).alias("ts"))
        touched = tables.touch(nodes.join(same.select("node_id"), "node_id", "left_semi"), same)
        fresh = rows.join(same.select("node_id"), "node_id", "left_anti")
        if fresh.isEmpty():
            return self.store.commit({}, base, [("nodes", "upsert", touched)])
        last = nodes.agg(F.max("seq")).first()[0]
        fresh = cut_lineage(numbered(fresh, "node_id").withColumn("seq", F.col("seq") + (0 if last is None else last + 1)))
        index = lexical.postings(fresh, c.title_boost, c.max_doc_tokens, **c.tokens)
        vectors = cut_lineage(self._embed(fresh, c.max_doc_tokens))
        lengths = index.groupBy("node_id").agg(F.max("doc_len").alias("text_len"))
        stamped = F.when(F.coalesce("updated_at", F.lit(0.0)) == 0, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at")
        kept = nodes.select("node_id", "access_count", "last_access", "trust", "trust_updated")
        new_nodes = fresh.join(lengths, "node_id", "left").join(kept, "node_id", "left").select(
            "seq", "node_id", "kind", "title", "tags", F.coalesce("text_len", F.lit(0)).alias("text_len"), stamped,
            F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("last_access", F.lit(0.0)).alias("last_access"),
            "pinned", "importance", F.coalesce("trust", F.lit(0.5)).alias("trust"), F.coalesce("trust_updated", F.lit(0.0)).alias("trust_updated"), "content_sha",
        )
        new_nodes = cut_lineage(touched.unionByName(new_nodes, allowMissingColumns=True))
        all_nodes = cut_lineage(tables.merge(nodes, new_nodes, ["node_id"]))
        ids = cut_lineage(fresh.select("node_id"))
        edges = self._derived_edges(fresh, all_nodes, tables.merge(self.store.read("vectors", base), vectors, ["node_id"]), now)
        taught = fresh.filter("teacher_vec is not null").select("node_id", F.col("teacher_model").alias("model"), F.col("teacher_vec").alias("vec"))
        kept_text = F.col("body") if c.store_text_maxlen is None else F.substring("body", 1, c.store_text_maxlen)
        # A note's old rows go, whatever its new text leaves of them.
        changes = [("nodes", "upsert", new_nodes), ("postings", "gone", ids), ("postings", "upsert", index.select("term", "node_id", "tf", "doc_len")), ("vectors", "upsert", vectors)]
        changes += [("edges", "unlinked", ids), ("edges", "upsert", edges), ("teachers", "upsert", taught)]
        if c.store_text:
            changes.append(("texts", "upsert", fresh.select("node_id", kept_text.alias("body"))))
        return self.store.commit({}, base, changes)

    def _derived_edges(self, fresh: DataFrame, nodes: DataFrame, vectors: DataFrame, now: float) -> DataFrame:
        c, ids = self.config, fresh.select(F.col("node_id").alias("src"))
        link = fresh.select(F.col("node_id").alias("src"), F.explode(F.array_distinct("links")).alias("dst")).filter("dst <> src")
        tag = graph.tag_edges(nodes.select("seq", "node_id", "tags"), c.tag_fanout).join(ids, "src", "left_semi")
        first = fresh.agg(F.min("seq")).first()[0]
        reached = nodes if c.knn_sample_cap is None else nodes.filter(F.col("seq") >= first - c.knn_sample_cap)
        near = vectors.join(reached.select("node_id", "seq"), "node_id")
        near = dense.well_formed(near, c.dim)
        knn = dense.knn_edges(near, c.knn_edges, c.knn_min_sim, c.knn_sample_cap, since=first).join(ids, "src", "left_semi")
        typed = lambda rows, etype, w: rows.select("src", "dst", F.lit(etype).alias("etype"), w.alias("w"), F.lit(now).alias("updated"))
        return typed(link, graph.LINK, F.lit(1.0)).unionByName(typed(tag, graph.TAG, F.col("w"))).unionByName(typed(knn, graph.KNN, F.col("w")))

    def remove(self, ids: DataFrame) -> int:
        """Drop nodes (``node_id``) with everything that belongs to them."""
        return self.store.commit({}, None, self.store.without(ids))

    # ── reading ──────────────────────────────────────────────────────

    def get_text(self, ids: DataFrame) -> DataFrame:
        return self.store.text(ids)

    def stats(self) -> DataFrame:
        """``what, n``: nodes, feedback rows, edges per type, the learner's counters and the vectors' width."""
        edges = self.store.read("edges").groupBy("etype").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edges:"), F.col("etype")).alias("what"), "n")
        rows = [self.store.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in ("nodes", "feedback")]
        learner, share = self._state()
        own = {"ranker:events": learner.events, "ranker:wins": learner.wins, "ranker:losses": learner.losses, "ranker:share_percent": round(100 * share), "dim": self.config.dim}
        return rows[0].unionByName(rows[1]).unionByName(edges).unionByName(self.spark.createDataFrame(list(own.items()), "what string, n long"))

    def edge(self, src: str, dst: str, etype: int) -> dict | None:
        """One edge, or None."""
        row = self.store.read("edges").filter((F.col("etype") == etype) & (F.col("src") == src) & (F.col("dst") == dst)).first()
        return row.asDict() if row else None

    def _lexical(self, queries: DataFrame) -> tuple:
        """The batch's terms, the index, document frequencies, corpus statistics and parameters."""
        c, index = self.config, self.store.read("postings")
        terms = cut_lineage(lexical.query_terms(queries, c.max_query_tokens, **c.tokens))
        return terms, index, cut_lineage(lexical.document_frequency(terms, index)), *lexical.corpus_stats(self.store.read("nodes"), "text_len")

    def _bm25(self, queries: DataFrame) -> DataFrame:
        c = self.config
        n, mean = lexical.corpus_stats(self.store.read("nodes"), "text_len")
        return lexical.bm25(lexical.query_terms(queries, c.max_query_tokens, **c.tokens), self.store.read("postings"), n, mean, c.bm25_k1, c.bm25_b)

    def _state(self) -> tuple[ranker.Learner, float]:
        """The stored learner (or a new one) and its share of the score."""
        row = self.store.read("params").filter("key = 'ranker'").first()
        learner = ranker.Learner(hidden=self.config.hidden, rate=self.config.lr, shrink=self.config.l2)
        if row is None:
            return learner, 0.0
        saved = json.loads(row["value"])
        learner.live, learner.calm = ([np.array(w) for w in saved[k]] for k in ("live", "calm"))
        learner.mu, learner.var = np.array(saved["mu"]), np.array(saved["var"])
        learner.events, learner.wins, learner.losses = (saved[k] for k in ("events", "wins", "losses"))
        learner.seen = saved.get("seen", saved["events"])
        return learner, saved["share"]

    def candidates(self, queries: DataFrame, now: float) -> DataFrame:
        """Every candidate of ``queries(qid, text)`` with its features."""
        c = self.config
        queries = queries.select("qid", "text")
        corpus, form = self._lexical(queries), {"k1": c.bm25_k1, "b": c.bm25_b}
        asked = self._embed(queries.select(F.col("qid").alias("node_id"), F.col("text").alias("body")), c.max_query_tokens).select(F.col("node_id").alias("qid"), "vec")
        cosine = cut_lineage(dense.cosine_top_k(asked, self.store.read("vectors"), max(64, 4 * c.vector_seed_k)))
        rrf = cut_lineage(fusion.reciprocal_rank_fusion([lexical.bm25_top_k(*corpus, c.bm25_seed_k, **form), cosine.filter(F.col("rank") < c.vector_seed_k)]))
        adj = graph.adjacency(self.store.read("edges"), now, c.hebb_decay)
        walks = cut_lineage(graph.pagerank(adj, rrf.withColumnRenamed("rrf", "score"), c.ppr_alpha, c.ppr_iters, others=c.graph_expand_k))
        chosen = rrf.select("qid", "node_id").unionByName(graph.expansion(walks, rrf, c.graph_expand_k).select("qid", "node_id"))
        bm25 = lexical.bm25_of(chosen, *corpus, **form)
        words = F.udf(lambda t, korean: [w for w in lexical_tokens(t or "", sizes=c.char_ngrams if korean else (), strip=c.suffix_strip, cross=korean and c.cross_space, limit=c.max_query_tokens if korean else None) if len(w) > 1], "array<string>", useArrow=True)
        chosen = chosen.join(queries.select("qid", words("text", F.lit(True)).alias("q_words")), "qid")
        nodes = self.store.read("nodes").withColumn("title_words", words("title", F.lit(False)))
        return features.candidate_features(chosen, bm25, cosine, rrf, walks, nodes, now, F.arrays_overlap("q_words", "title_words"))

    def search(self, queries: DataFrame, top_k: int | None = None, kinds: list[str] | None = None, now: float | None = None, seed: int | None = None) -> DataFrame:
        """``qid, node_id, score, title, kind, features, sources, rank, query_token`` for ``queries(qid, text)``.

        ``top_k`` of 0 or less gives nothing. ``kinds`` filters after candidates are made. With the configured
        ``epsilon``, the last place of some queries goes to another candidate; ``seed`` (by default the time)
        repeats the choice.
        """
        c, now = self.config, time.time() if now is None else now
        learner, share = self._state()
        rows = self.candidates(queries, now)
        stats = {}
        for i, f in enumerate(features.FEATURES):
            stats |= {f"mu_{f}": F.lit(float(learner.mu[i])), f"var_{f}": F.lit(float(learner.var[i]))}
        rows = rows.withColumns(stats).withColumn("linear_score", features.linear_score())
        if share > 0:
            rows = rows.withColumn("features", F.array(*features.FEATURES))
            rows = ranker.score_rows(rows, learner).withColumn("linear_score", (1 - share) * F.col("linear_score") + share * F.col("learned"))
        rows = rows.withColumn("score", F.col("linear_score") + features.trust_bonus(now, c.trust_half_life_days, c.trust_weight))
        best = fusion.explore(features.of_kinds(rows, kinds), c.top_k if top_k is None else top_k, c.epsilon, int(now) if seed is None else seed)
        named = F.create_map(*[x for f in features.FEATURES for x in (F.lit(f), F.col(f))])
        best = best.join(queries.select("qid", "text"), "qid")
        token = query_hash(F.concat("text", F.lit(f"|{now}"))).alias("query_token")
        return best.select("qid", "node_id", "score", "title", "kind", named.alias("features"), features.source_labels().alias("sources"), "rank", token)

    def record_access(self, hits: DataFrame, now: float | None = None) -> int:
        """Count a search's results as accesses."""
        log = hits.select("node_id", F.lit(time.time() if now is None else now).alias("ts"))
        base = self.store.version()
        seen = self.store.read("nodes", base).join(log.select("node_id").distinct(), "node_id", "left_semi")
        return self.store.commit({}, base, [("nodes", "upsert", tables.record_access(seen, log))])

    def search_join(self, entities: list[str], mode: str = "and", top_k: int | None = None) -> DataFrame:
        """``node_id, score, title, kind`` of the nodes related to all (``and``) or any (``or``) of the entities."""
        if mode not in ("and", "or"):
            raise ValueError("mode is 'and' or 'or'")
        c, names = self.config, [e for e in entities if e and e.strip()]
        rows = self.spark.createDataFrame([(str(i), e) for i, e in enumerate(names)], "qid string, text string")
        bm25 = cut_lineage(self._bm25(rows))
        seeds = fusion.top_k(bm25, c.bm25_seed_k)
        walks = graph.pagerank(graph.adjacency(self.store.read("edges"), time.time(), c.hebb_decay), seeds, c.ppr_alpha, c.ppr_iters)
        rels = joins.relatedness(bm25.withColumnRenamed("qid", "entity"), walks.withColumnRenamed("qid", "entity"))
        scored = joins.related_to_all(rels, len(names)) if mode == "and" else joins.related_to_any(rels, max(1, len(names)))
        best = fusion.top_k(scored.withColumn("all", F.lit(0)), c.top_k if top_k is None else top_k, by="all")
        return best.join(self.store.read("nodes").select("node_id", "title", "kind"), "node_id", "left").select("node_id", "score", "title", "kind", F.array(F.lit(f"join:{mode}")).alias("sources"))

    def contradictions(self, ids: DataFrame, top_k: int = 5, min_score: float = 0.15) -> DataFrame:
        """Conflicts of the nodes ``ids(node_id)`` with all others that share words with them."""
        c = self.config
        words = F.udf(lambda t: list(dict.fromkeys(w for w in lexical_tokens(t or "", sizes=(), strip=c.suffix_strip, cross=False, limit=c.max_doc_tokens) if len(w) > 1)), "array<string>", useArrow=True)
        texts = self.store.read("nodes").select("node_id", "title").join(self.store.read("texts"), "node_id", "left")
        texts = texts.select("node_id", F.coalesce("body", "title", F.lit("")).alias("body")).filter("body <> ''")
        sets = cut_lineage(texts.select("node_id", words("body").alias("words"), has_negation(F.col("body")).alias("negated"), "body"))
        asked = sets.join(ids.select("node_id").distinct(), "node_id", "left_semi")
        # A score is at most 2.5 times the jaccard.
        best = hygiene.overlapping(asked, sets.select(F.col("node_id").alias("other_id"), "words"), max(0.0, min_score) / 2.5)
        vectors = self._embed(sets.select("node_id", "body"), c.max_doc_tokens)
        mine = asked.join(vectors, "node_id").select("node_id", "negated", "vec")
        other = sets.join(vectors, "node_id").select(F.col("node_id").alias("other_id"), F.col("negated").alias("other_negated"), F.col("vec").alias("other_vec"))
        cosine = F.aggregate(F.zip_with("vec", "other_vec", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        return hygiene.contradictions(best.join(mine, "node_id").join(other, "other_id").withColumn("cosine", cosine), top_k, min_score)

    # ── learning ─────────────────────────────────────────────────────

    def feedback(self, events: DataFrame) -> dict:
        """Learn from ``events(query, node_id, used, ts, features, label_src)``, a row per node that was shown.

        Nodes used together get co-access edges, used nodes gain trust, rows of queries that aren't held out
        train the stored learner on and join the capped log for replay, and it is judged on the held-out rows.
        Returns ``version``, ``applied`` (rows that counted), ``pairs`` and mean ``loss`` of the training, and the learner's ``events``,
        ``wins``, ``losses`` and ``share``.
        """
        c, base = self.config, self.store.version()
        rows = events.filter("query is not null and node_id is not null and used is not null and ts is not null").withColumn("query_hash", query_hash(F.col("query")))
        rows = cut_lineage(rows)
        used = rows.filter("used")
        edges = self.store.read("edges", base)
        stored = edges.filter(F.col("etype") == graph.COACCESS)
        co = learning.coaccess_edges(used.select("query", "node_id", "ts"), c.hebb_eta, c.hebb_decay, stored=stored).withColumn("etype", F.lit(graph.COACCESS))
        nodes = self.store.read("nodes", base)
        steps = used.select("node_id", "ts", F.lit(True).alias("helpful"), F.monotonically_increasing_id().alias("rid"))
        # Edges that the events left as they were stay where they are stored.
        co = co.select(*edges.columns).join(stored.select(*edges.columns), edges.columns, "left_anti")
        return self._commit_learning(base, nodes, steps, rows, co)

    def learn(self, events: DataFrame) -> dict:
        """The same for callers with their own features; needs used and unused rows per query to train."""
        return self.feedback(events)

    def trust_feedback(self, events: DataFrame) -> int:
        """Raise or lower trust for ``events(node_id, helpful, ts)``; unknown nodes are ignored."""
        base = self.store.version()
        steps = events.select("node_id", "ts", "helpful", F.monotonically_increasing_id().alias("rid"))
        return self.store.commit({}, base, [("nodes", "upsert", self._with_trust(self.store.read("nodes", base), steps))])

    def _with_trust(self, nodes: DataFrame, steps: DataFrame) -> DataFrame:
        """The nodes of ``steps`` with their new trust."""
        c = self.config
        known = steps.join(nodes.select("node_id"), "node_id", "left_semi")
        nodes = nodes.join(known.select("node_id").distinct(), "node_id", "left_semi")
        touched = nodes.select("node_id", "trust", "trust_updated")
        folded = learning.trust_fold(known, c.trust_helpful, c.trust_unhelpful, c.trust_half_life_days, stored=touched)
        folded = folded.select("node_id", F.col("trust").alias("__t"), F.col("trust_updated").alias("__u"))
        rows = nodes.join(folded, "node_id", "left")
        return rows.withColumn("trust", F.coalesce("__t", "trust")).withColumn("trust_updated", F.coalesce("__u", "trust_updated")).drop("__t", "__u")

    def _commit_learning(self, base: int, nodes: DataFrame, steps: DataFrame, rows: DataFrame, edges: DataFrame) -> dict:
        c = self.config
        log = self.store.read("feedback", base)
        kept, changes = {}, [("nodes", "upsert", self._with_trust(nodes, steps)), ("edges", "upsert", edges)]
        report = {"applied": rows.count(), "pairs": 0, "loss": 0.0}
        if "features" in rows.columns:
            last = log.agg(F.max("rid")).first()[0] or 0
            fresh = numbered(rows.withColumn("__id", F.monotonically_increasing_id()), "__id", "rid").withColumn("rid", F.col("rid") + last + 1)
            fresh = cut_lineage(fresh.withColumn("shown", F.lit(True)).withColumn("label_src", F.col("label_src") if "label_src" in rows.columns else F.lit("implicit")))
            names = log.columns
            trains = fresh.filter(~is_held_out(F.col("query_hash"))).select(*names)
            learner, _ = self._state()
            learner = ranker.train_on_log(trains, start=learner, replayed=log)
            log = cut_lineage(tables.append_capped(log, trains, c.replay_cap))
            judged = ranker.gate(fresh.select(*names), learner, c.blend_min_events).first()
            wins, losses = learner.wins + judged["wins"], learner.losses + judged["losses"]
            events = judged["events"]
            share = self.spark.range(1).select(ranker.blend_share(F.lit(events), F.lit(wins), F.lit(losses), c.blend_min_events)).first()[0]
            plain = lambda ws: [np.asarray(w).tolist() for w in ws]
            state = {"live": plain(learner.live), "calm": plain(learner.calm), "mu": learner.mu.tolist(), "var": learner.var.tolist(), "events": events, "wins": wins, "losses": losses, "seen": learner.seen, "share": float(share)}
            row = self.spark.createDataFrame([("ranker", json.dumps(state))], "key string, value string")
            kept = {"feedback": log}
            changes.append(("params", "upsert", row))
            report |= {"pairs": learner.pairs, "loss": learner.loss / max(1, learner.pairs), "events": events, "wins": wins, "losses": losses, "share": float(share)}
        return {"version": self.store.commit(kept, base, changes)} | report

    def distill(self, most_pairs: int = 20_000) -> dict:
        """Fit the embedding table to the stored teacher vectors and, if it got better, embed all texts anew.

        The fit uses at most about ``most_pairs`` pairs, chosen by hash; every text is embedded.
        """
        c, base = self.config, self.store.version()
        texts = self.store.read("texts", base)
        missing = self.store.read("nodes", base).join(texts, "node_id", "left_anti")
        pairs = self.store.read("teachers", base).join(texts, "node_id")
        n = pairs.count()
        parts = max(1, -(-n // most_pairs))
        rows = pairs.filter(F.pmod(F.xxhash64("node_id"), F.lit(parts)) == 0).orderBy("node_id").limit(2 * most_pairs).select("body", "vec").toArrow()
        table = self._embedder().value if self._embedder() is not None else dense.initial_table(c.vocab_size, c.dim, c.seed)
        teachers = dense.matrix(rows.column("vec")) if rows.num_rows else np.zeros((0, 1))
        fit = distill.fit_table(rows.column("body").to_pylist(), teachers, table, c.distill_epochs, c.distill_lr, c.distill_batch)
        report = {"pairs": n, "trained": fit.trained, "corr_before": fit.before, "corr_after": fit.after, "swapped": False}
        if not fit.accepted or not missing.isEmpty():
            return report
        self.close()
        self._table = self.spark.sparkContext.broadcast(fit.table)
        stored = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(fit.table)], "bucket int, vec array<float>")
        self.store.commit({"embedder": stored, "vectors": self._embed(texts, c.max_doc_tokens)}, base)
        return report | {"swapped": True}
