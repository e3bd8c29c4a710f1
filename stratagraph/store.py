"""Snapshots as partitions: commit, copy-forward, retention.

Every fact table is Parquet partitioned by snapshot_id.  A commit writes its
partitions first and publishes the snapshot by one small file last; readers
look only at published snapshots, so a commit that dies half-way is invisible
and can be repeated (dynamic overwrite of its own partitions).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Key, and which row of a key wins: 'error', 'first' or 'last' in order of ``seq``.
TABLES = {
    "packages": (("import_path",), "error"),
    "files": (("rel_path",), "error"),
    "symbols": (("symbol_key",), "error"),
    "package_deps": (("from_package_import_path", "to_package_import_path"), "error"),
    "refs": (("from_package_import_path", "file_path", "line", "col", "to_symbol_key", "from_symbol_key"), "first"),
    "call_edges": (("caller_symbol_key", "callee_symbol_key", "file_path", "line", "col"), "first"),
    "test_links": (("test_key", "symbol_key", "link_kind"), "first"),
    "tests": (("test_key",), "last"),
}
#: The column that says which package a row belongs to; files are written whole by every commit.
OWNER = {
    "packages": "import_path", "symbols": "package_import_path", "package_deps": "from_package_import_path", "refs": "from_package_import_path",
    "call_edges": "caller_package_import_path", "test_links": "test_package_import_path", "tests": "package_import_path",
}


def one_per_key(rows: DataFrame, key: tuple[str, ...], policy: str, seq: str = "seq") -> DataFrame:
    """The first or last row of each key by ``seq``; 'error' keeps all and is checked at commit."""
    if policy == "error":
        return rows.drop(seq)
    order = F.col(seq) if policy == "first" else F.desc(seq)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n", seq)


def copy_forward(previous: DataFrame, owner: str, impacted: DataFrame) -> DataFrame:
    """Rows of packages that are not impacted (``impacted``: import_path); with none impacted, all rows."""
    return previous.join(impacted.select(F.col("import_path").alias(owner)), owner, "left_anti")


def expired(ids: list[int], limit: int, current: int | None) -> list[int]:
    """The snapshots that go if the newest ``limit`` are kept; the current one stays, and with no limit all do."""
    if limit <= 0:
        return []
    newest = sorted(ids, reverse=True)
    return sorted(i for i in newest[limit:] if i != current)


class Store:
    """A project's snapshots in one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- the published state: one small JSON file per commit

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def snapshots(self) -> list[dict]:
        """Published snapshots by ascending id."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return []
        rows = self.spark.read.text(str(folder.toString()), wholetext=True, pathGlobFilter="*.json").collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda s: s["id"])

    def current(self) -> int | None:
        found = self.snapshots()
        return found[-1]["id"] if found else None

    def _publish(self, entry: dict) -> None:
        fs, folder = self._fs()
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(folder)
        part, done = (jvm.org.apache.hadoop.fs.Path(folder, f"{entry['id']}.{end}") for end in ("tmp", "json"))
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs.delete(done, False)
        fs.rename(part, done)

    # -- tables

    def table(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        sid = self.current() if snapshot_id is None else snapshot_id
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("snapshot_id") == sid)

    def commit(self, tables: dict[str, DataFrame], kind: str = "index", note: str = "", impacted: DataFrame | None = None, limit: int = 0) -> int:
        """Write a new snapshot and return its id.

        ``impacted`` None means a full index; otherwise rows of all other
        packages are copied forward from the current snapshot.  Rows may carry
        ``seq``, their order of extraction.  A repeated key of a table that
        allows none is an error, and nothing is published.
        """
        parent = self.current()
        sid = (parent or 0) + 1
        counts = {}
        for name, rows in tables.items():
            key, policy = TABLES[name]
            rows = one_per_key(rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0)), key, policy)
            if impacted is not None and parent is not None and name in OWNER:
                rows = rows.unionByName(copy_forward(self.table(name, parent).drop("snapshot_id"), OWNER[name], impacted), allowMissingColumns=True)
            written = rows.withColumn("snapshot_id", F.lit(sid).cast("long"))
            written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.path}/{name}")
            mine = self.table(name, sid)
            if policy == "error" and not mine.groupBy(*key).count().where("count > 1").isEmpty():
                raise ValueError(f"{name}: a key occurs twice")
            counts[name] = mine.count()
        self._publish({"id": sid, "parent_id": parent, "kind": kind, "note": note, "counts": counts})
        if limit:
            self.enforce(limit)
        return sid

    def delete(self, ids: list[int]) -> None:
        """Unpublish snapshots, then drop their partitions; the current one stays."""
        if self.current() in ids:
            raise ValueError("the current snapshot can't be deleted")
        fs, folder = self._fs()
        jvm = self.spark.sparkContext._jvm
        for sid in ids:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{sid}.json"), False)
            for name in TABLES:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/snapshot_id={sid}"), True)

    def enforce(self, limit: int) -> list[int]:
        """Keep the newest ``limit`` snapshots; returns the ids that went."""
        ids = [s["id"] for s in self.snapshots()]
        gone = expired(ids, limit, self.current())
        self.delete(gone)
        return gone
