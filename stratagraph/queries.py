"""Registered queries of the core library, and their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import detail_queries, graph_queries, text_queries, view_queries  # noqa: F401  they register their queries
from .operators.orphans import orphan_references, orphan_report
from .operators.snapshot_delta import snapshot_changes
from .registry import QUERIES, SQL, query
from .tables import digest_text, load, present, slash_path

__all__ = ["QUERIES", "SQL"]


# --- references to records that do not exist ---------------------------------

#: Owner and target columns of the tables that refer to symbols.
REFERENCES = {
    "refs": ("from_symbol_key", "to_symbol_key"),
    "call_edges": ("caller_symbol_key", "callee_symbol_key"),
    "test_links": ("test_key", "symbol_key"),
}

_ORPHANS = " UNION ".join(
    f"""SELECT '{t}' AS table_name, r.snapshot_id, r.{owner} AS owner_key, r.{target} AS missing_key FROM {t} r
    WHERE r.snapshot_id IS NOT NULL AND r.{target} IS NOT NULL AND r.{target} <> ''
      AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.snapshot_id = r.snapshot_id AND s.symbol_key = r.{target})
      AND NOT EXISTS (SELECT 1 FROM external_symbols e WHERE e.symbol_key = r.{target})"""
    for t, (owner, target) in REFERENCES.items()
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        t: load(spark, sf_dir, t).select(F.col("snapshot_id").alias("period"), F.col(owner).alias("owner_key"), F.col(target).alias("missing_key"))
        for t, (owner, target) in REFERENCES.items()
    }
    parents = load(spark, sf_dir, "symbols").select(F.col("snapshot_id").alias("period"), F.col("symbol_key").alias("key"))
    return orphan_references(tables, parents, load(spark, sf_dir, "external_symbols").select(F.col("symbol_key").alias("key")))


@query(_ORPHANS)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).withColumnRenamed("period", "snapshot_id")


@query(
    f"""SELECT table_name, snapshot_id, count(*) AS orphan_rows, count(DISTINCT owner_key) AS owners,
    count(DISTINCT missing_key) AS missing_keys FROM ({_ORPHANS}) GROUP BY ALL"""
)
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir)).withColumnRenamed("period", "snapshot_id")


# --- what changed between full snapshots -------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sorted(r.id for r in load(spark, sf_dir, "snapshots").select("id").distinct().collect() if r.id is not None)
    files, symbols, edges = (load(spark, sf_dir, t) for t in ("files", "symbols", "call_edges"))
    absent_is_empty = [F.coalesce(c, F.lit("")) for c in ("signature", "doc", "file_path")]
    tables = {
        "files": files.select(F.col("snapshot_id").alias("period"), slash_path("rel_path").alias("record_key"), digest_text("content_hash").alias("value"), "loaded_at"),
        "symbols": symbols.select(F.col("snapshot_id").alias("period"), F.col("symbol_key").alias("record_key"), F.struct(*absent_is_empty).alias("value"), "loaded_at"),
        "call_edges": edges.where(present("callee_symbol_key")).select(
            F.col("snapshot_id").alias("period"),
            F.concat(F.coalesce("caller_symbol_key", F.lit("")), F.lit(" -> "), "callee_symbol_key").alias("record_key"),
            F.lit("").alias("value"),
        ),
    }
    return snapshot_changes(spark, tables, list(zip(ids, ids[1:]))).withColumnRenamed("period", "snapshot_id")


_DIGEST_SQL = "nullif(regexp_replace(regexp_replace(lower(content_hash), '\\s+', '', 'g'), '^[a-z0-9_-]*[:=$]', ''), '')"
_CHANGES = f"""WITH pairs AS (SELECT id AS later, lag(id) OVER (ORDER BY id) AS earlier FROM (SELECT DISTINCT id FROM snapshots)),
recs AS (
  SELECT 'files' AS table_name, snapshot_id, key, arg_max(d, loaded_at) AS v, arg_max(d IS NOT NULL, loaded_at) AS has FROM (
    SELECT snapshot_id, regexp_replace(replace(rel_path, '\\', '/'), '^(\\./+)+', '') AS key, {_DIGEST_SQL} AS d, loaded_at FROM files)
  GROUP BY ALL
  UNION ALL
  SELECT 'symbols', snapshot_id, symbol_key,
    arg_max(concat_ws('|', len(coalesce(signature, '')), coalesce(signature, ''), len(coalesce(doc, '')), coalesce(doc, ''), coalesce(file_path, '')), loaded_at), true
  FROM symbols WHERE symbol_key IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT DISTINCT 'call_edges', snapshot_id, coalesce(caller_symbol_key, '') || ' -> ' || callee_symbol_key, '', true
  FROM call_edges WHERE callee_symbol_key <> ''),
sides AS (
  SELECT r.table_name, p.later AS snapshot_id, r.key, r.v, r.has, 1 AS side FROM recs r JOIN pairs p ON r.snapshot_id = p.later WHERE p.earlier IS NOT NULL
  UNION ALL
  SELECT r.table_name, p.later, r.key, r.v, r.has, -1 FROM recs r JOIN pairs p ON r.snapshot_id = p.earlier),
cmp AS (
  SELECT table_name, snapshot_id, key AS record_key, max(side) AS hi, min(side) AS lo, bool_and(has) AS both_have, count(DISTINCT v) AS versions
  FROM sides GROUP BY ALL)
SELECT table_name, snapshot_id, record_key,
  CASE WHEN lo = 1 THEN 'added' WHEN hi = -1 THEN 'removed' ELSE 'changed' END AS change_kind
FROM cmp WHERE lo = 1 OR hi = -1 OR (both_have AND versions > 1)"""


@query(_CHANGES)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"SELECT table_name, snapshot_id, change_kind, count(*) AS record_count FROM ({_CHANGES}) GROUP BY ALL")
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("table_name", "snapshot_id", "change_kind").agg(F.count(F.lit(1)).alias("record_count"))
