"""Schemas of the stored tables."""

from __future__ import annotations

_DDL = {
    "nodes": """seq long, node_id string, kind string, title string, tags array<string>, text_len int, updated_at double, access_count long,
        last_access double, pinned boolean, importance double, trust double, trust_updated double, content_sha string""",
    "texts": "node_id string, body string",
    "postings": "term string, node_id string, tf double, doc_len int",
    "vectors": "node_id string, vec array<float>",
    "teachers": "node_id string, model string, vec array<float>",
    "edges": "src string, dst string, etype int, w double, updated double",
    "feedback": "rid long, ts double, query_hash string, node_id string, features array<float>, shown boolean, used boolean, label_src string",
    "embedder": "bucket int, vec array<float>",
    "params": "key string, value string",
}
KEYS = {
    "nodes": ["node_id"],
    "texts": ["node_id"],
    "postings": ["node_id"],
    "vectors": ["node_id"],
    "teachers": ["node_id"],
    "edges": ["src", "dst", "etype"],
    "feedback": ["rid"],
    "embedder": ["bucket"],
    "params": ["key"],
}


def ddl(table: str) -> str:
    return _DDL[table]
