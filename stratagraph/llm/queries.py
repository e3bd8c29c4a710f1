"""Registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..tables import load, present, valid_rows
from ..workspace import stage
from . import code_origin, doc_pairs, mixture, tokens, topn, truncation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- generated, minified, vendored files ------------------------------------


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_origin.found_files(load(spark, sf_dir, "scan_files"))


@query()
def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_origin.kept_files(load(spark, sf_dir, "scan_files"), load(spark, sf_dir, "scan_options"))


# --- top N items within every group -----------------------------------------

TOP = 5

_RANKED = """WITH r AS (
  SELECT snapshot_id, symbol_key, score FROM ranked_symbols
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, symbol_key ORDER BY loaded_at DESC) = 1),
s AS (
  SELECT snapshot_id, symbol_key, qname, package_import_path FROM symbols
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, symbol_key ORDER BY loaded_at DESC) = 1),
ranked AS (
  SELECT snapshot_id, s.package_import_path, symbol_key, r.score,
    row_number() OVER (PARTITION BY snapshot_id, s.package_import_path ORDER BY r.score DESC, s.qname, symbol_key) AS rank
  FROM r JOIN s USING (snapshot_id, symbol_key) WHERE r.score IS NOT NULL AND s.package_import_path <> '')"""


def _ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("snapshot_id", "symbol_key")
    ranked = valid_rows(load(spark, sf_dir, "ranked_symbols").select(*key, "score", "loaded_at"), key).where("score IS NOT NULL")
    symbols = valid_rows(load(spark, sf_dir, "symbols").select(*key, "qname", "package_import_path", "loaded_at"), key).where(present("package_import_path"))
    return ranked.drop("loaded_at").join(symbols.drop("loaded_at"), list(key)).withColumn("qname", F.coalesce("qname", F.lit("")))


@query(f"{_RANKED} SELECT snapshot_id, package_import_path, symbol_key FROM ranked WHERE rank <= {TOP}")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n(_ranked_items(spark, sf_dir), ["snapshot_id", "package_import_path"], "score", ["qname", "symbol_key"], TOP)
    return best.select("snapshot_id", "package_import_path", "symbol_key")


@query(f"{_RANKED} SELECT snapshot_id, package_import_path, symbol_key, score, rank FROM ranked WHERE rank <= 1")
def p4_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n(_ranked_items(spark, sf_dir), ["snapshot_id", "package_import_path"], "score", ["qname", "symbol_key"], 1)
    return best.select("snapshot_id", "package_import_path", "symbol_key", "score", "rank")


# --- functions paired with their documentation -------------------------------


def _latest(spark: SparkSession, sf_dir: str) -> int | None:
    return load(spark, sf_dir, "snapshots").agg(F.max("id")).first()[0]


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.latest_pairs(load(spark, sf_dir, "symbols"), _latest(spark, sf_dir)).select("symbol_key")


@query()
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.latest_pairs(load(spark, sf_dir, "symbols"), _latest(spark, sf_dir))


@query()
def p5_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs.source_pairs(load(spark, sf_dir, "scan_files"), ["project", "rel_path"])


# --- encoding of the corpus ---------------------------------------------------


@query()
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf_dir, "documents"))


@query()
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents").select("doc_id", "text"))


# --- mixing sources to target weights ------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = stage(tokens.token_counts(load(spark, sf_dir, "documents").select("doc_id", "source", "text")), "mixture-sizes")
    return mixture.mix(sized, load(spark, sf_dir, "mix_targets"))


@query()
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.reached_shares(*_mixed(spark, sf_dir))


# --- text cut off by field limits -----------------------------------------------


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(load(spark, sf_dir, "documents")).where("cut").select("doc_id")


@query()
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(truncation.judged(load(spark, sf_dir, "documents")))
