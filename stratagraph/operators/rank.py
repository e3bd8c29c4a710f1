"""Scores, labels, risk notes and the ranked lists of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import CALLABLE_KINDS, TYPE_KINDS, Facts
from . import delta, metrics

# fixed values: weights of the scores
FUNCTION_WEIGHTS = {"caller_count": 5, "callee_count": 1, "reference_count": 2, "test_count": 3, "reverse_package_deps": 2}
TYPE_WEIGHTS = {"reference_count": 4, "test_count": 3, "method_count": 2, "reverse_package_deps": 2}
FILE_WEIGHTS = {"inbound_calls": 5, "inbound_refs": 3, "related_tests": 3, "reverse_package_deps": 2, "relevant_symbols": 1, "declared_tests": 2}
RELEVANCE_WEIGHTS = {"caller_count": 7, "reference_count": 4, "test_count": 6, "reverse_package_deps": 5, "package_importance": 2}
KIND_BOOST = {"method": 9, "func": 8, "struct": 7, "class": 7, "interface": 6, "type": 6, "alias": 6}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
LINK_RANK = {"direct": 3, "receiver_match": 3, "related": 2, "name_match": 2, "global_name_match": 1}
CHANGED_PACKAGE_BONUS = 5


def weighted(weights: dict[str, int]) -> Column:
    first, *rest = [F.col(c) * w for c, w in weights.items()]
    for part in rest:
        first = first + part
    return first


def lookup(column: str, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def impact_label(total: Column) -> Column:
    return F.when(total >= 12, "high").when(total >= 5, "medium").otherwise("low")


def importance_label(score: Column) -> Column:
    return F.when(score >= 18, "high").when(score >= 7, "medium").otherwise("low")


def entry_file(path: str) -> Column:
    """Bonus of files where programs start; the first rule that fits."""
    p = F.concat(F.lit("/"), F.col(path))

    def inside(*names: str) -> Column:
        hit = p.contains(f"/{names[0]}/")
        for n in names[1:]:
            hit = hit | p.contains(f"/{n}/")
        return hit

    return (
        F.when(p.endswith("/__main__.py"), 4)
        .when(p.endswith("/main.go") | p.endswith("/main.rs"), 4)
        .when(inside("cmd"), 3)
        .when(inside("bin"), 3)
        .when(inside("cli"), 3)
        .when(inside("scripts"), 2)
        .when(inside("examples", "example"), 2)
        .otherwise(0)
    )


def entry_symbol() -> Column:
    return F.when((F.lower(F.trim("name")) == "main") & (F.col("kind") == "func"), 2).otherwise(0)


def directory(path: str) -> Column:
    """The directory of a path, '.' at the top."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def with_change(f: Facts, rows: DataFrame, path: str, package: str) -> DataFrame:
    """Adds change_boost and change_distance: 8/0 changed file, 5/1 same package, 3/2 same directory, else 0/-1.

    Changes are those since the parent of the current snapshot; the first snapshot has none.
    """
    if f.parent is None:
        return rows.withColumn("change_boost", F.lit(0)).withColumn("change_distance", F.lit(-1))
    touched = delta.added_files(f, f.parent, f.current).select("rel_path").unionAll(delta.changed_files(f, f.parent, f.current).select("rel_path")).distinct()
    files = touched.select(F.col("rel_path").alias(path), F.lit(True).alias("_file"))
    dirs = touched.select(directory("rel_path").alias("_dir")).distinct().withColumn("_near", F.lit(True))
    packages = delta.changed_packages(f, f.parent, f.current).select(F.col("import_path").alias(package), F.lit(True).alias("_package")).where(f"{package} <> ''")
    joined = rows.withColumn("_dir", directory(path)).join(files, path, "left").join(packages, package, "left").join(dirs, "_dir", "left")
    boost = F.when(F.col("_file"), 8).when(F.col("_package"), 5).when(F.col("_near"), 3).otherwise(0)
    distance = F.when(F.col("_file"), 0).when(F.col("_package"), 1).when(F.col("_near"), 2).otherwise(-1)
    return joined.withColumn("change_boost", boost).withColumn("change_distance", distance).drop("_dir", "_file", "_package", "_near")


# -- reasons of a score, in order ------------------------------------------------------


def _counted(*pairs: tuple[str, str]) -> list[Column]:
    return [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + text))) for c, text in pairs]


def entry_why(path: str) -> Column:
    """Why a file gets the bonus of ``entry_file``."""
    p = F.concat(F.lit("/"), F.col(path))
    rules = [(p.endswith("/__main__.py"), "python entrypoint file"), (p.endswith("/main.go") | p.endswith("/main.rs"), "main entrypoint file")]
    rules += [(p.contains(f"/{d}/"), f"{said} entrypoint surface") for d, said in (("cmd", "cmd"), ("bin", "bin"), ("cli", "cli"), ("scripts", "script"), ("examples", "example"), ("example", "example"))]
    out = F.lit(None).cast("string")
    for hit, text in reversed(rules):
        out = F.when(hit, text).otherwise(out)
    return out


def _change_why() -> Column:
    return F.when(F.col("change_distance") == 0, "recently changed file").when(F.col("change_distance") == 1, "near recent changes in same package").when(F.col("change_distance") == 2, "near recent changes in same directory")


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), "; ")


def symbol_reasons() -> Column:
    counts = _counted(("caller_count", "callers"), ("reference_count", "inbound refs"), ("test_count", "direct tests"), ("reverse_package_deps", "reverse package deps"), ("method_count", "attached methods"))
    return _joined([*counts, entry_why("file_path"), F.when(entry_symbol() > 0, "main entrypoint symbol"), _change_why()])


def package_reasons() -> Column:
    return _joined([*_counted(("reverse_deps", "reverse package deps"), ("symbol_count", "indexed symbols"), ("test_count", "related tests")), F.when(F.col("changed"), "recently changed package")])


def file_reasons() -> Column:
    counts = _counted(("inbound_calls", "inbound calls"), ("inbound_refs", "inbound refs"), ("related_tests", "related tests"), ("reverse_package_deps", "reverse package deps"), ("relevant_symbols", "relevant symbols"))
    return _joined([*counts, entry_why("rel_path"), _change_why()])


def _ranked_symbols(f: Facts, kinds: tuple[str, ...], weights: dict[str, int], limit: int) -> DataFrame:
    """Two stages: the best by graph score, at least 24, then the best of those with bonuses."""
    rows = metrics.symbol_metrics(f).where(F.col("kind").isin(*kinds)).withColumn("graph_score", weighted(weights))
    pool = rows.orderBy(F.desc("graph_score"), "qname", "symbol_key").limit(max(4 * limit, 24))
    scored = with_change(f, pool, "file_path", "package_import_path").withColumn("score", F.col("graph_score") + entry_file("file_path") + entry_symbol() + F.col("change_boost"))
    return scored.orderBy(F.desc("score"), "qname", "symbol_key").limit(limit)


def top_functions(f: Facts, limit: int = 8) -> DataFrame:
    return _ranked_symbols(f, CALLABLE_KINDS, FUNCTION_WEIGHTS, limit)


def top_types(f: Facts, limit: int = 8) -> DataFrame:
    return _ranked_symbols(f, TYPE_KINDS, TYPE_WEIGHTS, limit)


def top_packages(f: Facts, limit: int = 8) -> DataFrame:
    pool = metrics.package_metrics(f).orderBy(F.desc("reverse_deps"), F.desc("symbol_count"), F.desc("test_count"), "import_path").limit(max(4 * limit, 24))
    if f.parent is None:
        changed = pool.select("import_path", F.lit(True).alias("_changed")).limit(0)
    else:
        changed = delta.changed_packages(f, f.parent, f.current).select("import_path", F.lit(True).alias("_changed"))
    scored = pool.join(changed, "import_path", "left").withColumn("score", F.col("importance") + F.when(F.col("_changed"), CHANGED_PACKAGE_BONUS).otherwise(0)).withColumn("changed", F.coalesce("_changed", F.lit(False))).drop("_changed")
    return scored.orderBy(F.desc("score"), "import_path").limit(limit)


def scored_files(f: Facts) -> DataFrame:
    rows = metrics.file_summaries(f).withColumn("graph_score", weighted(FILE_WEIGHTS))
    return with_change(f, rows, "rel_path", "package_import_path").withColumn("quality_score", F.col("graph_score") + entry_file("rel_path") + F.col("change_boost"))


def top_files(f: Facts, limit: int = 8) -> DataFrame:
    return scored_files(f).orderBy(F.desc("quality_score"), "rel_path").limit(limit)


def coverage() -> Column:
    return F.when(F.col("relevant_symbols") > 0, F.expr("linked_symbols * 100 div relevant_symbols")).otherwise(F.lit(-1).cast("long"))


def _notes(*parts: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), " | "), F.lit("")), F.lit("contained"))


def symbol_risk() -> Column:
    total = F.col("caller_count") + F.col("reference_count") + F.col("test_count") + F.col("reverse_package_deps")
    impact = impact_label(total)
    return _notes(
        F.when(impact != "low", F.concat(F.lit("blast="), impact)),
        F.when((F.col("caller_count") > 0) & (F.col("callee_count") > 0), F.lit("seam")),
        F.when(F.col("score") >= 18, F.lit("hotspot")),
        F.when((F.col("test_count") == 0) & (F.col("caller_count") + F.col("reference_count") + F.col("reverse_package_deps") >= 3), F.lit("tests=thin")),
        F.when(F.col("reverse_package_deps") >= 3, F.concat(F.lit("pkg-rdeps="), F.col("reverse_package_deps").cast("string"))),
        F.when(F.col("method_count") >= 3, F.lit("hub-type")),
    )


def neighbourhood_risk() -> Column:
    """Risk of a symbol by its neighbourhood: callers, callees, references both ways, tests, users of its package and the package's importance."""
    c = {n: F.col(n) for n in ("caller_count", "callee_count", "reference_count", "refs_out", "test_count", "reverse_package_deps", "package_importance")}
    used = c["caller_count"] + c["reference_count"] + c["reverse_package_deps"]
    impact = impact_label(used + c["test_count"])
    return _notes(
        F.when(impact != "low", F.concat(F.lit("blast="), impact)),
        F.when(((c["caller_count"] > 0) & (c["callee_count"] > 0)) | ((c["reference_count"] > 0) & (c["refs_out"] > 0)), F.lit("seam")),
        F.when(c["reverse_package_deps"] >= 3, F.concat(F.lit("pkg-rdeps="), c["reverse_package_deps"].cast("string"))),
        F.when((c["test_count"] == 0) & (used >= 3), F.lit("tests=thin")),
        F.when((c["package_importance"] >= 6) | (used >= 8), F.lit("hotspot")),
    )


def top_file_summaries(f: Facts, limit: int = 8) -> DataFrame:
    """The files to look at first, ties broken by graph score, relevant symbols, related tests and recency."""
    rows = scored_files(f).withColumn("_recent", F.col("change_distance") == 0)
    return rows.orderBy(F.desc("quality_score"), F.desc("graph_score"), F.desc("relevant_symbols"), F.desc("related_tests"), F.desc("_recent"), "rel_path").limit(limit).drop("_recent")


def package_risk() -> Column:
    return _notes(
        F.when(F.col("reverse_deps") >= 3, F.concat(F.lit("rdeps="), F.col("reverse_deps").cast("string"))),
        F.when((F.col("local_deps") > 0) & (F.col("reverse_deps") > 0), F.lit("seam")),
        F.when((F.col("test_count") == 0) & ((F.col("reverse_deps") >= 2) | (F.col("symbol_count") >= 6)), F.lit("tests=thin")),
        F.when((F.col("file_count") >= 5) | (F.col("symbol_count") >= 10), F.lit("wide-surface")),
    )


def file_risk(hot: str = "hot_score", recent: str = "recent") -> Column:
    weak = (F.col("relevant_symbols") > 0) & ((F.col("related_tests") == 0) | (coverage() < 35))
    return _notes(
        F.when(F.col(hot) >= 36, F.lit("hotspot")).when((F.col(hot) >= 18) | (F.col("relevant_symbols") >= 5), F.lit("dense-logic")),
        F.when(F.col(recent) & weak, F.lit("recent+weak-tests")).when(F.col(recent), F.lit("recent")).when(weak, F.lit("weak-test-link")),
    )


def risky_files(f: Facts, hot_limit: int = 64) -> DataFrame:
    """All files with their risk: the hot score counts only for the ``hot_limit`` best files."""
    rows = scored_files(f)
    hot = rows.orderBy(F.desc("quality_score"), "rel_path").limit(hot_limit).select("rel_path", F.col("quality_score").alias("_hot"))
    joined = rows.join(hot, "rel_path", "left").withColumn("hot_score", F.coalesce("_hot", F.lit(0))).withColumn("recent", F.col("change_distance") == 0)
    return joined.withColumn("risk", file_risk()).withColumn("coverage", coverage()).drop("_hot")


def weak_areas(f: Facts, limit: int = 6) -> DataFrame:
    """Recently changed files that are no tests and whose risk names weak tests."""
    rows = risky_files(f).where(F.col("recent") & ~F.col("is_test") & F.col("risk").contains("weak-test"))
    return rows.orderBy(F.desc("hot_score"), "coverage", "rel_path").limit(limit)


def thin_symbols(f: Facts, limit: int = 6, pool: int = 8) -> DataFrame:
    """Ranked functions and types without a direct test and a score of at least 7."""
    both = top_functions(f, pool).unionByName(top_types(f, pool))
    return both.where("test_count = 0 AND score >= 7").orderBy(F.desc("score"), "qname", "symbol_key").limit(limit)


def ranked_with_risk(f: Facts, pool: int = 8) -> DataFrame:
    return top_functions(f, pool).unionByName(top_types(f, pool)).withColumn("risk", symbol_risk())
