"""Token counts with a public byte-level BPE vocabulary; its file is a parameter."""

from __future__ import annotations

import base64
import os

import pyarrow as pa

from recallgrid.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark, path: str) -> None:
    """Send a rank file that lies on the driver to the executors of a cluster, where :func:`encoder` finds it."""
    if not spark.sparkContext.master.startswith("local[") and "://" not in path and os.path.exists(path):
        spark.sparkContext.addFile(path)


def encoder(path: str = DEFAULT_VOCABULARY):
    """The encoding of a rank file, read once per Python worker: of the file itself, or the copy shipped with the job."""
    from pyspark import SparkFiles
    import tiktoken
    from tiktoken.registry import ENCODINGS

    if path not in ENCODINGS:
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ENCODINGS[path] = tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ENCODINGS[path]


def encode(enc, text: str | None) -> list[int]:
    return enc.encode_ordinary(text) if text else []


def count_tokens(documents, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY):
    """The columns ``keep`` and ``n_tokens long`` of the whole text (0 for a null or empty one)."""
    from pyspark.sql.types import LongType, StructField, StructType

    ship(documents.sparkSession, path)
    rows = spread(documents.select(*keep, text), keep[0])
    schema = StructType([*(rows.schema[c] for c in keep), StructField("n_tokens", LongType())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            sizes = [len(encode(enc, t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, schema)
