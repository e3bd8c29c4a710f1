"""Differences between two snapshots as single lists; ``history`` has those of all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..facts import Facts
from . import metrics

CALL_KEY = ["caller_symbol_key", "callee_symbol_key", "file_path", "line", "col"]
REF_KEY = ["from_symbol_key", "to_symbol_key", "from_package_import_path", "file_path", "line", "col", "kind"]
LINK_KEY = ["test_package_import_path", "test_key", "symbol_key", "link_kind", "confidence"]
PACKAGE_COUNTS = ["file_count", "symbol_count", "test_count", "local_deps", "reverse_deps"]


def _only(f: Facts, table: str, here: int, there: int, key: list[str]) -> DataFrame:
    return f.at(table, here).join(f.at(table, there).select(*key), key, "left_anti")


def added_files(f: Facts, old: int, new: int) -> DataFrame:
    return _only(f, "files", new, old, ["rel_path"])


def deleted_files(f: Facts, old: int, new: int) -> DataFrame:
    return _only(f, "files", old, new, ["rel_path"])


def changed_files(f: Facts, old: int, new: int) -> DataFrame:
    before = f.at("files", old).select("rel_path", F.col("content_hash").alias("_before"))
    return f.at("files", new).join(before, "rel_path").where("NOT content_hash <=> _before").drop("_before")


def added_symbols(f: Facts, old: int, new: int) -> DataFrame:
    return _only(f, "symbols", new, old, ["qname"])


def removed_symbols(f: Facts, old: int, new: int) -> DataFrame:
    return _only(f, "symbols", old, new, ["qname"])


def changed_symbols(f: Facts, old: int, new: int) -> DataFrame:
    """Symbols of one qname whose signature, file or line differ; a repeated qname fans out."""
    cols = ["qname", "package_import_path", "file_path", "signature", "line"]
    a = f.at("symbols", old).select("qname", *[F.col(c).alias(f"from_{c}") for c in cols[1:]])
    b = f.at("symbols", new).select("qname", *[F.col(c).alias(f"to_{c}") for c in cols[1:]])
    both = a.join(b, "qname")
    contract = F.col("from_signature") != F.col("to_signature")
    moved = (F.col("from_file_path") != F.col("to_file_path")) | (F.col("from_line") != F.col("to_line"))
    return both.withColumn("contract_changed", contract).withColumn("moved", moved).where("contract_changed OR moved")


def edge_changes(f: Facts, table: str, key: list[str], old: int, new: int) -> DataFrame:
    """Edges of only one snapshot, with change 'added' or 'removed'."""
    plus = _only(f, table, new, old, key).select(*key, F.lit("added").alias("change"))
    return plus.unionAll(_only(f, table, old, new, key).select(*key, F.lit("removed").alias("change")))


def dep_changes(f: Facts, old: int, new: int) -> DataFrame:
    """Local package dependencies of only one snapshot; the other side may be any."""
    key = ["from_package_import_path", "to_package_import_path"]
    plus = f.at("package_deps", new).where("is_local").join(f.at("package_deps", old).select(*key), key, "left_anti")
    minus = f.at("package_deps", old).where("is_local").join(f.at("package_deps", new).select(*key), key, "left_anti")
    return plus.select(*key, F.lit("added").alias("change")).unionAll(minus.select(*key, F.lit("removed").alias("change")))


def changed_packages(f: Facts, old: int, new: int) -> DataFrame:
    """Packages whose counts differ, absent ones counting 0."""
    a = metrics.package_metrics(f, old).select("import_path", *[F.col(c).alias(f"from_{c}") for c in PACKAGE_COUNTS])
    b = metrics.package_metrics(f, new).select("import_path", *[F.col(c).alias(f"to_{c}") for c in PACKAGE_COUNTS])
    both = a.join(b, "import_path", "full_outer").fillna(0)
    return both.where(" OR ".join(f"from_{c} <> to_{c}" for c in PACKAGE_COUNTS))


def first_seen(f: Facts) -> DataFrame:
    return f.symbols.groupBy("qname").agg(F.min("snapshot_id").alias("first_snapshot"), F.max("snapshot_id").alias("last_snapshot"), F.count_distinct("snapshot_id").alias("snapshots"))
