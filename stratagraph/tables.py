"""Loading of the engine's tables and their cleaned forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Primary keys of the versioned fact tables.
KEYS = {
    "files": ("snapshot_id", "rel_path"),
    "symbols": ("snapshot_id", "symbol_key"),
    "call_edges": ("snapshot_id", "caller_symbol_key", "callee_symbol_key", "file_path", "line", "col"),
    "refs": ("snapshot_id", "from_package_import_path", "file_path", "line", "col", "to_symbol_key", "from_symbol_key"),
    "test_links": ("snapshot_id", "test_key", "symbol_key", "link_kind"),
    "ranked_symbols": ("snapshot_id", "symbol_key"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(column: Column | str) -> Column:
    """Absence is '' or null in these tables."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & (column != "")


def valid_rows(df: DataFrame, keys: tuple[str, ...], newest: str = "loaded_at") -> DataFrame:
    """One row per key: the one delivered last.

    Copies count once.  Two rows of one key with the same time are ordered by
    their remaining columns, so the choice does not depend on row order.  Null
    times lose against any time; null key parts form a key of their own.
    """
    rest = [c for c in df.columns if c not in keys and c != newest]
    best = df.groupBy(*keys).agg(F.max(F.struct(newest, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def digest_text(column: Column | str) -> Column:
    """A hex digest in one spelling: no algorithm prefix, blanks or upper case; absent digests are null."""
    column = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.regexp_replace(F.lower(column), r"\s+", ""), r"^[a-z0-9_-]*[:=$]", "")
    return F.when(bare != "", bare)


def slash_path(column: Column | str) -> Column:
    """A relative path with '/' separators and no leading './'."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.translate(column, "\\", "/"), r"^(\./+)+", "")
