"""Async single-document and single-query handles over the batch engine, for hosts with an event loop."""

from __future__ import annotations

import asyncio
import time
from collections import OrderedDict

from recallgrid.engine import NOTE, MemoryEngine
from recallgrid.operators.features import FEATURES

REMEMBERED_QUERIES = 64


def note_row(doc_id: str, text: str, metadata: dict | None) -> dict:
    """A row for :meth:`MemoryEngine.index`; ``category`` stands in for ``kind``, an importance of 0 for none."""
    given = metadata or {}
    row = {name: given.get(name) for name in NOTE if name != "updated_at"}
    row["kind"] = given.get("kind") or given.get("category")
    row["importance"] = float(given.get("importance") or 1.0)
    return {"node_id": doc_id, "text": text or "", **row}


class VectorHandle:
    """Index, search, remove, reindex and fetch by document; Spark jobs run off the event loop."""

    def __init__(self, engine: MemoryEngine, name: str = "recallgrid"):
        self.engine, self.name = engine, name

    @property
    def descriptor(self) -> dict:
        return {"backend": self.name, "model": "static-hash", "dimension": self.engine.config.dim, "local": True, "api_calls": 0}

    def _index(self, rows: list[dict]) -> int:
        schema = "node_id string, text string, " + ", ".join(f"{n} {kind}" for n, (kind, _) in NOTE.items() if n != "updated_at")
        if rows:
            names = [c.split()[0] for c in schema.split(", ")]
            self.engine.index(self.engine.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))
        return len(rows)

    async def index(self, doc_id: str, text: str, metadata: dict | None = None) -> None:
        await asyncio.to_thread(self._index, [note_row(doc_id, text, metadata)])

    async def index_batch(self, docs: list[dict]) -> int:
        return await asyncio.to_thread(self._index, [note_row(d["id"], d.get("text"), d.get("metadata")) for d in docs])

    def _search(self, query: str, top_k: int, threshold: float) -> list[dict]:
        rows = self.engine.search(self.engine.spark.createDataFrame([("q", query)], "qid string, text string"), top_k)
        found = rows.filter(rows["score"] >= threshold).orderBy("rank").collect()
        return [{"id": r["node_id"], **{k: r[k] for k in ("score", "title", "kind", "sources", "query_token")}} for r in found]

    async def search(self, query: str, *, top_k: int = 8, score_threshold: float = 0.0) -> list[dict]:
        return await asyncio.to_thread(self._search, query, top_k, score_threshold)

    async def remove(self, doc_id: str) -> None:
        await asyncio.to_thread(lambda: self.engine.remove(self.engine.spark.createDataFrame([(doc_id,)], "node_id string")))

    async def reindex(self) -> int:
        """Fit the embedding table to the teachers; returns the number of pairs."""
        return (await asyncio.to_thread(self.engine.distill))["pairs"]

    async def fetch_document(self, doc_id: str) -> dict | None:
        row = await asyncio.to_thread(lambda: self.engine.store.read("nodes").filter(f"node_id = '{doc_id.replace(chr(39), chr(92) + chr(39))}'").first())
        return row.asDict() if row else None


class Retriever:
    """Ranked hits per query, and feedback by the token of one of the last queries."""

    def __init__(self, engine: MemoryEngine):
        self.engine = engine
        self._recent: OrderedDict[str, tuple[str, dict]] = OrderedDict()

    def _retrieve(self, query: str, top_k: int, kinds: list[str] | None) -> list:
        rows = self.engine.search(self.engine.spark.createDataFrame([("q", query)], "qid string, text string"), top_k, kinds).orderBy("rank").collect()
        if rows:
            self._recent[rows[0]["query_token"]] = (query, {r["node_id"]: [r["features"][f] for f in FEATURES] for r in rows})
            while len(self._recent) > REMEMBERED_QUERIES:
                self._recent.popitem(last=False)
        return rows

    async def retrieve(self, query: str, *, top_k: int = 8, kinds: list[str] | None = None) -> list:
        return await asyncio.to_thread(self._retrieve, query, top_k, kinds)

    def _feedback(self, token: str, used: list[str], label_src: str) -> dict:
        if token not in self._recent:
            return {"applied": 0.0}
        query, shown = self._recent[token]
        now = time.time()
        rows = [(query, n, n in used, now, [float(x) for x in x14], label_src) for n, x14 in shown.items()]
        self.engine.feedback(self.engine.spark.createDataFrame(rows, "query string, node_id string, used boolean, ts double, features array<float>, label_src string"))
        n_used = sum(r[2] for r in rows)
        return {"applied": 1.0, "pairs": float(n_used * (len(rows) - n_used))}

    async def feedback(self, query_token: str, used_ids: list[str], *, label_src: str = "implicit") -> dict:
        return await asyncio.to_thread(self._feedback, query_token, list(used_ids), label_src)
