"""Counts per symbol, package and file, from which every ranking starts.

Each fact table is aggregated on its own and then joined, so no join fans out
and a hot callee is one row before any join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import CALLABLE_KINDS, TYPE_KINDS, Facts


def callers(f: Facts, sid: int | None = None) -> DataFrame:
    return f.at("calls", sid).groupBy(F.col("callee_symbol_key").alias("symbol_key")).agg(F.count(F.lit(1)).alias("caller_count"))


def callees(f: Facts, sid: int | None = None) -> DataFrame:
    return f.at("calls", sid).groupBy(F.col("caller_symbol_key").alias("symbol_key")).agg(F.count(F.lit(1)).alias("callee_count"))


def references(f: Facts, sid: int | None = None) -> DataFrame:
    inside = f.at("refs", sid).where("from_symbol_key <> ''")
    return inside.groupBy(F.col("to_symbol_key").alias("symbol_key")).agg(F.count(F.lit(1)).alias("reference_count"))


def tests(f: Facts, sid: int | None = None) -> DataFrame:
    return f.at("test_links", sid).groupBy("symbol_key").agg(F.count_distinct("test_key").alias("test_count"))


def _left(base: DataFrame, parts: list[DataFrame], on: str, counts: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), parts, base).fillna(0, counts)


def package_metrics(f: Facts, sid: int | None = None) -> DataFrame:
    """Per package: symbols, tests, local dependencies and reverse dependencies, and its importance."""
    symbols = f.at("symbols", sid).groupBy(F.col("package_import_path").alias("import_path")).agg(F.count(F.lit(1)).alias("symbol_count"))
    tested = f.at("tests", sid).groupBy(F.col("package_import_path").alias("import_path")).agg(F.count(F.lit(1)).alias("test_count"))
    local = f.at("package_deps", sid).where("is_local")
    deps = local.groupBy(F.col("from_package_import_path").alias("import_path")).agg(F.count_distinct("to_package_import_path").alias("local_deps"))
    rdeps = local.groupBy(F.col("to_package_import_path").alias("import_path")).agg(F.count_distinct("from_package_import_path").alias("reverse_deps"))
    counts = ["symbol_count", "test_count", "local_deps", "reverse_deps"]
    joined = _left(f.at("packages", sid), [symbols, tested, deps, rdeps], "import_path", counts)
    return joined.withColumn("importance", F.col("reverse_deps") * 4 + F.col("symbol_count") + F.col("test_count") * 2)


def package_counts(f: Facts) -> DataFrame:
    """The counts of every package of every snapshot: snapshot_id, import_path, file_count, symbol_count, test_count, local_deps, reverse_deps."""
    key = ["snapshot_id", "import_path"]
    symbols = f.symbols.groupBy("snapshot_id", F.col("package_import_path").alias("import_path")).agg(F.count(F.lit(1)).alias("symbol_count"))
    tested = f.tests.groupBy("snapshot_id", F.col("package_import_path").alias("import_path")).agg(F.count(F.lit(1)).alias("test_count"))
    local = f.package_deps.where("is_local")
    deps = local.groupBy("snapshot_id", F.col("from_package_import_path").alias("import_path")).agg(F.count_distinct("to_package_import_path").alias("local_deps"))
    rdeps = local.groupBy("snapshot_id", F.col("to_package_import_path").alias("import_path")).agg(F.count_distinct("from_package_import_path").alias("reverse_deps"))
    joined = reduce(lambda a, b: a.join(b, key, "left"), [symbols, tested, deps, rdeps], f.packages.select(*key, "file_count"))
    return joined.fillna(0, ["symbol_count", "test_count", "local_deps", "reverse_deps"])


def symbol_metrics(f: Facts, sid: int | None = None) -> DataFrame:
    """Symbols with their caller, callee, reference, test, reverse-dependency and method counts."""
    parts = [callers(f, sid), callees(f, sid), references(f, sid), tests(f, sid)]
    rows = _left(f.at("symbols", sid), parts, "symbol_key", ["caller_count", "callee_count", "reference_count", "test_count"])
    packages = package_metrics(f, sid).select(F.col("import_path").alias("package_import_path"), F.col("reverse_deps").alias("reverse_package_deps"), F.col("importance").alias("package_importance"))
    methods = type_methods(f, sid)
    return (
        rows.join(packages, "package_import_path", "left")
        .join(methods, ["package_import_path", "name"], "left")
        .withColumn("method_count", F.when(F.col("kind").isin(*TYPE_KINDS), F.coalesce("method_count", F.lit(0))).otherwise(F.lit(0)))
        .fillna(0, ["reverse_package_deps", "package_importance"])
    )


def type_methods(f: Facts, sid: int | None = None) -> DataFrame:
    """Methods per package and receiver name, with one leading '*' dropped."""
    methods = f.at("symbols", sid).where("kind = 'method'")
    return methods.groupBy("package_import_path", F.regexp_replace("receiver", r"^\*", "").alias("name")).agg(F.count(F.lit(1)).alias("method_count"))


def inbound_calls(f: Facts, sid: int | None = None) -> DataFrame:
    """Per file: distinct (caller, file, line) of calls into its symbols."""
    targets = f.at("symbols", sid).select(F.col("symbol_key").alias("callee_symbol_key"), F.col("file_path").alias("rel_path"))
    sites = f.at("calls", sid).select("callee_symbol_key", F.concat_ws("|", "caller_symbol_key", "file_path", F.col("line").cast("string")).alias("site"))
    return sites.join(targets, "callee_symbol_key").groupBy("rel_path").agg(F.count_distinct("site").alias("inbound_calls"))


def inbound_refs(f: Facts, sid: int | None = None) -> DataFrame:
    targets = f.at("symbols", sid).select(F.col("symbol_key").alias("to_symbol_key"), F.col("file_path").alias("rel_path"))
    sites = f.at("refs", sid).where("from_symbol_key <> ''").select("to_symbol_key", F.concat_ws("|", "from_symbol_key", "file_path", F.col("line").cast("string")).alias("site"))
    return sites.join(targets, "to_symbol_key").groupBy("rel_path").agg(F.count_distinct("site").alias("inbound_refs"))


def _relevant() -> Column:
    return F.col("kind").isin(*CALLABLE_KINDS, *TYPE_KINDS) & ~F.col("is_test")


def file_summaries(f: Facts, sid: int | None = None) -> DataFrame:
    """One row per file: symbols by kind, declared and related tests, linked symbols, inbound calls and references."""
    linked = f.at("test_links", sid).select("symbol_key").distinct().withColumn("_linked", F.lit(True))
    rows = f.at("symbols", sid).join(linked, "symbol_key", "left")
    by_file = rows.groupBy(F.col("file_path").alias("rel_path")).agg(
        F.count(F.lit(1)).alias("symbol_count"),
        F.count_if((F.col("kind") == "func") & ~F.col("is_test")).alias("func_count"),
        F.count_if((F.col("kind") == "method") & ~F.col("is_test")).alias("method_count"),
        F.count_if(F.col("kind").isin(*TYPE_KINDS) & ~F.col("is_test")).alias("type_count"),
        F.count_if(_relevant()).alias("relevant_symbols"),
        F.count_if(_relevant() & F.coalesce("_linked", F.lit(False))).alias("linked_symbols"),
    )
    declared = f.at("tests", sid).groupBy(F.col("file_path").alias("rel_path")).agg(F.count(F.lit(1)).alias("declared_tests"))
    related = (
        f.at("test_links", sid)
        .select("test_key", "symbol_key")
        .join(f.at("symbols", sid).select("symbol_key", F.col("file_path").alias("rel_path")), "symbol_key")
        .groupBy("rel_path")
        .agg(F.count_distinct("test_key").alias("related_tests"))
    )
    counts = ["symbol_count", "func_count", "method_count", "type_count", "relevant_symbols", "linked_symbols", "declared_tests", "related_tests", "inbound_calls", "inbound_refs"]
    files = f.at("files", sid).select("rel_path", "package_import_path", "size_bytes", "is_test")
    joined = _left(files, [by_file, declared, related, inbound_calls(f, sid), inbound_refs(f, sid)], "rel_path", counts)
    rdeps = package_metrics(f, sid).select(F.col("import_path").alias("package_import_path"), F.col("reverse_deps").alias("reverse_package_deps"))
    return joined.join(rdeps, "package_import_path", "left").fillna(0, ["reverse_package_deps"])


def table_counts(f: Facts) -> DataFrame:
    """Rows per table and snapshot."""
    tables = ("symbols", "calls", "refs", "test_links", "files", "packages", "package_deps", "tests")
    parts = [getattr(f, t).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(t)) for t in tables]
    return reduce(DataFrame.unionByName, parts).select("table_name", "snapshot_id", "row_count")
