"""Versioned Parquet tables with atomic commits over several tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.operators.graph import COACCESS
from recallgrid.schema import KEYS, ddl
from recallgrid.session import cut_lineage


class ConflictError(RuntimeError):
    """Another writer committed first."""


class Store:
    """Tables below ``path``; a manifest names the folders that hold each table's rows.

    A table is a folder of rows and up to ``MOST_CHANGES`` small folders of later changes: rows that replace those with
    the same key, or ids of nodes that are gone. Readers put them together (the changes are small, so they meet the rows
    by a broadcast), and the next change beyond that number writes the table anew. So writing a few notes costs what
    they are, not what the table is.

    A commit writes its folders, claims the next number by a file that only one writer can create, and renames the finished
    manifest into place: readers see all of a commit or nothing of it, and of two writers one fails. A claim that was left
    without a manifest for ``CLAIM_SECONDS`` (its writer died) may be taken over. Works on every file system Hadoop knows.
    """

    MOST_CHANGES, CLAIM_SECONDS = 8, 600.0

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/_manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _manifest(self, version: int) -> dict[str, list]:
        """Per table its folders, each with what it holds: ``rows`` first, then ``upsert``, ``gone`` or ``unlinked``."""
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._read(table, self._manifest(self.version() if version is None else version).get(table, []))

    def _read(self, table: str, parts: list) -> DataFrame:
        out = self.spark.createDataFrame([], ddl(table))
        for what, folder in parts:
            schema = ddl(table) if what in ("rows", "upsert") else "node_id string"
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
            out = part if what == "rows" else merge(out, part, KEYS[table]) if what == "upsert" else self._less(table, out, part, what)
        return out.select(*self.spark.createDataFrame([], ddl(table)).columns) if len(parts) > 1 else out

    @staticmethod
    def _less(table: str, rows: DataFrame, ids: DataFrame, what: str) -> DataFrame:
        ids = ids.select("node_id").distinct()
        if table != "edges":
            return rows.join(ids, "node_id", "left_anti")
        if what == "unlinked":
            return rows.join(ids.select(F.col("node_id").alias("src"), F.lit(True).alias("__own")), "src", "left").filter(F.col("__own").isNull() | (F.col("etype") == COACCESS)).select(*rows.columns)
        for end in ("src", "dst"):
            rows = rows.join(ids.withColumnRenamed("node_id", end), end, "left_anti")
        return rows

    def _write(self, table: str, rows: DataFrame, what: str) -> list:
        folder = f"{table}/{uuid.uuid4().hex}"
        if what in ("gone", "unlinked"):
            rows.select("node_id").write.parquet(f"{self.path}/{folder}")
            return [what, folder]
        names = self.spark.createDataFrame([], ddl(table)).schema
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names])
        if table == "postings":
            # Ranges of terms and nodes: a frequent term takes as many files as its postings need.
            shaped = shaped.repartitionByRange("term", "node_id").sortWithinPartitions("term", "node_id")
        elif table == "edges":
            shaped = shaped.repartitionByRange("etype", "src", "dst").sortWithinPartitions("etype", "src")
        shaped.write.parquet(f"{self.path}/{folder}")
        return [what, folder]

    def commit(self, tables: dict[str, DataFrame], base: int | None = None, changes: list[tuple[str, str, DataFrame]] | None = None) -> int:
        """Replace ``tables`` by new rows and apply ``changes`` in one step; columns that are missing become null.

        A change is ``(table, what, rows)``: ``upsert`` puts rows in place of those with the same key, ``gone`` takes the
        rows of ``rows(node_id)`` away (of edges those with either end there), ``unlinked`` the edges from them but co-access.
        """
        base = self.version() if base is None else base
        manifest = self._manifest(base)
        for table, rows in tables.items():
            manifest[table] = [self._write(table, rows, "rows")]
        for table, what, rows in changes or []:
            parts = manifest.get(table) or [self._write(table, self.spark.createDataFrame([], ddl(table)), "rows")]
            manifest[table] = [*parts, self._write(table, rows, what)]
        for table, parts in manifest.items():
            if len(parts) > self.MOST_CHANGES + 1:
                manifest[table] = [self._write(table, self._read(table, parts), "rows")]
        self._publish(base + 1, manifest)
        return base + 1

    def _publish(self, version: int, manifest: dict) -> None:
        name = f"{self.path}/_manifests/{version:012d}"
        final, claim, draft = self._path(f"{name}.json"), self._path(f"{name}.claim"), self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        if self._fs.exists(final):
            raise ConflictError(f"version {version} exists")
        if self._fs.exists(claim) and self._fs.getFileStatus(claim).getModificationTime() < (time.time() - self.CLAIM_SECONDS) * 1000:
            self._fs.delete(claim, False)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._fs.create(claim, False).close()
        except Exception as error:
            self._fs.delete(draft, False)
            raise ConflictError(f"version {version} is being written") from error
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {version} exists")

    def upsert(self, table: str, rows: DataFrame, version: int | None = None) -> DataFrame:
        """The table with ``rows`` in place of those with the same key."""
        return merge(self.read(table, version), rows, KEYS[table])

    def ids(self, wanted: DataFrame | None = None) -> DataFrame:
        """All nodes, or those of ``wanted(node_id)``."""
        nodes = self.read("nodes")
        return nodes if wanted is None else nodes.join(wanted.select("node_id").distinct(), "node_id", "left_semi")

    def text(self, wanted: DataFrame | None = None) -> DataFrame:
        texts = self.read("texts")
        return texts if wanted is None else texts.join(wanted.select("node_id").distinct(), "node_id", "left_semi")

    def without(self, removed: DataFrame) -> list[tuple[str, str, DataFrame]]:
        """The changes that take the rows of ``removed(node_id)`` out of every table; of edges both ends count."""
        gone = cut_lineage(removed.filter("node_id is not null").select("node_id").distinct())
        return [(t, "gone", gone) for t in ("nodes", "texts", "postings", "vectors", "teachers", "feedback", "edges")]

    def param(self, key: str) -> str | None:
        row = self.read("params").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_param(self, key: str, value: str | None, base: int | None = None) -> int:
        """Store a parameter, or delete it (None)."""
        rows = self.read("params", base).filter(F.col("key") != key)
        if value is not None:
            rows = rows.unionByName(self.spark.createDataFrame([(key, value)], ddl("params")))
        return self.commit({"params": cut_lineage(rows)}, base)

    def vacuum(self, older_than: float = 3600.0) -> int:
        """Delete folders that the current manifest doesn't name and that are older than so many seconds (a younger one
        may belong to a commit under way); returns their number."""
        keep = {folder for parts in self._manifest(self.version()).values() for _, folder in parts}
        count, before = 0, (time.time() - older_than) * 1000
        for table in KEYS:
            folder = self._path(f"{self.path}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{table}/{status.getPath().getName()}" not in keep and status.getModificationTime() <= before:
                    count += bool(self._fs.delete(status.getPath(), True))
        return count


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` less the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def touch(nodes: DataFrame, at: DataFrame, column: str = "updated_at") -> DataFrame:
    """Nodes with ``column`` set from ``at(node_id, ts)``."""
    return nodes.join(at.select("node_id", F.col("ts").alias("__ts")), "node_id", "left").withColumn(column, F.coalesce("__ts", column)).drop("__ts")


def record_access(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Nodes with access counts and times from an access log ``(node_id, ts)``."""
    seen = log.filter("node_id is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__ts"))
    rows = nodes.join(seen, "node_id", "left")
    rows = rows.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__n", F.lit(0)))
    return rows.withColumn("last_access", F.greatest("last_access", "__ts")).drop("__n", "__ts")


def append_capped(log: DataFrame, fresh: DataFrame, cap: int, key: str = "rid") -> DataFrame:
    """The log with new rows, less those more than ``cap`` numbers behind the newest."""
    both = log.unionByName(fresh, allowMissingColumns=True)
    newest = both.agg(F.max(key).alias("__newest"))
    return both.join(F.broadcast(newest)).filter(F.col(key) > F.col("__newest") - cap).drop("__newest")


def newest(log: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return log.orderBy(*order).limit(n)


def pruned(edges: DataFrame, etype: int, floor: float) -> DataFrame:
    return edges.filter(~((F.col("etype") == etype) & (F.col("w") < floor)))


def decode_nodes(rows: DataFrame) -> DataFrame:
    """Rows of an older layout: tags as JSON text, flags as numbers, no trust."""
    kinds = dict(rows.dtypes)
    if kinds.get("tags") == "string":
        rows = rows.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    if kinds.get("pinned") != "boolean":
        rows = rows.withColumn("pinned", F.coalesce(F.col("pinned").cast("boolean"), F.lit(False)))
    for column, default in (("trust", 0.5), ("trust_updated", 0.0), ("content_sha", "")):
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in kinds else F.lit(default))
    return rows


def intern_terms(postings: DataFrame, terms: DataFrame, node_map: DataFrame) -> DataFrame:
    """Postings ``(term, node_id, tf)`` with the numbers of a dictionary, ``tid, nid, tf``; unknown keys are left out."""
    return postings.join(terms, "term").join(node_map.withColumnRenamed("id", "node_id"), "node_id").select("tid", "nid", "tf")


def spell_postings(postings: DataFrame, terms: DataFrame, node_map: DataFrame) -> DataFrame:
    """Numbered postings with their terms and nodes spelled out."""
    return postings.join(terms, "tid").join(node_map, "nid").select("term", F.col("id").alias("node_id"), "tf")


def unchanged(incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """``incoming(node_id, content_sha)`` whose digest the stored node already has."""
    return incoming.join(nodes.select("node_id", "content_sha"), ["node_id", "content_sha"], "left_semi")


def recent_per(rows: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__i") <= n).drop("__i")
