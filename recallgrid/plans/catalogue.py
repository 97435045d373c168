"""All query modules outside the optional subpackage."""

from __future__ import annotations

from recallgrid.plans import corpus, interactions, quality, retrieval

MODULES = [quality, corpus, retrieval, interactions]


def flagship(spark, sf_dir):
    return corpus.bm25_topk(spark, sf_dir)
