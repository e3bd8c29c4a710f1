"""Neighbourhoods of a symbol and bounded walks over the call graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..facts import Facts
from ..workspace import stage
from ..functions import text as T
from . import metrics
from .rank import CONFIDENCE_RANK, LINK_RANK, impact_label, lookup

_SHOWN = ["qname", "package_import_path", "name", "kind"]


def _named(f: Facts, rows: DataFrame, key: str, sid: int | None) -> DataFrame:
    names = f.at("symbols", sid).select(F.col("symbol_key").alias(key), *_SHOWN)
    return rows.join(names, key)


def callers(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    edges = f.at("calls", sid).where(F.col("callee_symbol_key") == symbol_key).select("caller_symbol_key", "file_path", "line", "col", "dispatch")
    return _named(f, edges, "caller_symbol_key", sid)


def callees(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    edges = f.at("calls", sid).where(F.col("caller_symbol_key") == symbol_key).select("callee_symbol_key", "file_path", "line", "col", "dispatch")
    return _named(f, edges, "callee_symbol_key", sid)


def references_in(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    rows = f.at("refs", sid).where((F.col("to_symbol_key") == symbol_key) & (F.col("from_symbol_key") != "")).select("from_symbol_key", "file_path", "line", "col", F.col("kind").alias("ref_kind"))
    return _named(f, rows, "from_symbol_key", sid)


def references_out(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    rows = f.at("refs", sid).where(F.col("from_symbol_key") == symbol_key).select("to_symbol_key", "file_path", "line", "col", F.col("kind").alias("ref_kind"))
    return _named(f, rows, "to_symbol_key", sid)


def link_score() -> object:
    return F.lit(240) + lookup("confidence", CONFIDENCE_RANK, 0) * 20 + lookup("link_kind", LINK_RANK, 0) * 6


def tests_of(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    links = f.at("test_links", sid).where(F.col("symbol_key") == symbol_key).select("test_key", "link_kind", "confidence")
    return links.join(f.at("tests", sid), "test_key").withColumn("score", link_score())


def package_tests(f: Facts, import_path: str, limit: int = 10, sid: int | None = None) -> DataFrame:
    """Tests of a package by the number of symbols they are linked to."""
    mine = f.at("tests", sid).where(F.col("package_import_path") == import_path)
    counted = f.at("test_links", sid).groupBy("test_key").agg(F.count_distinct("symbol_key").alias("linked_symbols"))
    rows = mine.join(counted, "test_key", "left").fillna(0, ["linked_symbols"]).withColumn("score", F.col("linked_symbols") * 10)
    return rows.orderBy(F.desc("linked_symbols"), "file_path", "line", "name", "test_key").limit(limit)


def siblings(f: Facts, symbol_key: str, limit: int = 8, sid: int | None = None) -> DataFrame:
    """Other symbols of the package in the same file or with the same receiver ('' equals '')."""
    me = f.at("symbols", sid).where(F.col("symbol_key") == symbol_key).select(F.col("package_import_path").alias("_p"), F.col("file_path").alias("_f"), F.col("receiver").alias("_r"))
    near = f.at("symbols", sid).join(F.broadcast(me), F.col("package_import_path") == F.col("_p"))  # one row
    rows = near.where((F.col("symbol_key") != symbol_key) & ((F.col("file_path") == F.col("_f")) | (F.col("receiver") == F.col("_r"))))
    return rows.drop("_p", "_f", "_r").orderBy("file_path", "line", "symbol_key").limit(limit)


def walk(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Vertices within ``depth`` steps of ``start`` and the least number of steps: key, depth.

    ``edges``: src, dst.  Breadth first, one join per level; a level is written
    to the shared folder, so lineage stays flat and a lost executor costs one
    level.  The start itself comes back when a cycle leads to it.
    """
    spark = edges.sparkSession
    steps = stage(edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "walk-edges")
    frontier = spark.createDataFrame([(start,)], "key string")
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        reached = steps.join(frontier, steps["src"] == frontier["key"], "left_semi").select(F.col("dst").alias("key")).distinct()
        for earlier in levels:
            reached = reached.join(earlier.select("key"), "key", "left_anti")
        frontier = stage(reached, "walk-level").select("key")
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(level)))
    return reduce(DataFrame.unionAll, levels) if levels else spark.createDataFrame([], "key string, depth int")


def transitive_callers(f: Facts, symbol_key: str, depth: int = 3, sid: int | None = None) -> DataFrame:
    edges = f.at("calls", sid).select(F.col("callee_symbol_key").alias("src"), F.col("caller_symbol_key").alias("dst"))
    return _named(f, walk(edges, symbol_key, depth if depth >= 1 else 2).withColumnRenamed("key", "symbol_key"), "symbol_key", sid)


#: Keeps the parts of a place apart, below any letter of a path or name.
_PART, _STEP = "\x01", "\x02"


def callee_walk(f: Facts, symbol_key: str, depth: int = 4, sid: int | None = None) -> DataFrame:
    """Callees within ``depth`` steps as a breadth-first walk meets them: symbol_key, depth, parent_key, the use-site, place and names.

    A symbol's callees are visited in order of use-site (file, line, qname), so
    of several callers of a new symbol the one visited first is its parent;
    ``place`` is its position among the new callees of that parent.  Only keys
    with a record are met, and the start is not met again.
    """
    spark = f.spark
    names = f.at("symbols", sid).select(F.col("symbol_key").alias("callee_symbol_key"), "qname")
    site = F.concat_ws(_PART, "file_path", F.lpad(F.col("line").cast("string"), 10, "0"), "qname", "callee_symbol_key")
    edges = f.at("calls", sid).select("caller_symbol_key", "callee_symbol_key", "file_path", "line").join(names, "callee_symbol_key")
    steps = stage(edges.select("caller_symbol_key", F.col("callee_symbol_key").alias("key"), "file_path", "line", site.alias("site")), "walk-edges")
    frontier = spark.createDataFrame([(symbol_key, "")], "parent_key string, _order string")
    seen = [spark.createDataFrame([(symbol_key,)], "key string")]
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        reached = steps.join(frontier, steps["caller_symbol_key"] == frontier["parent_key"])
        reached = reached.select("key", F.struct(F.concat("_order", F.lit(_STEP), "site").alias("_order"), "parent_key", "file_path", "line", "site").alias("_at")).groupBy("key").agg(F.min("_at").alias("_at"))
        for earlier in seen:
            reached = reached.join(earlier, "key", "left_anti")
        found = stage(reached.select("key", "_at.*"), "walk-level")
        if found.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("parent_key").orderBy("site"))
        levels.append(found.select(F.col("key").alias("symbol_key"), F.lit(level).alias("depth"), "parent_key", F.col("file_path").alias("use_file_path"), F.col("line").alias("use_line"), place.alias("place")))
        frontier = found.select(F.col("key").alias("parent_key"), "_order")
        seen.append(found.select("key"))
    empty = spark.createDataFrame([], "symbol_key string, depth int, parent_key string, use_file_path string, use_line int, place int")
    return _named(f, reduce(DataFrame.unionAll, levels) if levels else empty, "symbol_key", sid)


def reverse_dependencies(f: Facts, packages: DataFrame, sid: int | None = None) -> DataFrame:
    """Packages that depend on any of the given ones (local or not)."""
    deps = f.at("package_deps", sid).join(packages.select(F.col("import_path").alias("to_package_import_path")), "to_package_import_path", "left_semi")
    return deps.select(F.col("from_package_import_path").alias("import_path")).distinct()


def provenance(f: Facts, targets: DataFrame, limit: int = 3) -> DataFrame:
    """At most ``limit`` pieces of evidence per target symbol, callers first, then references, then tests.

    ``targets``: symbol_key.  One window over the union serves all targets.
    """
    wanted = targets.select("symbol_key").distinct()
    names = f.at("symbols").select("symbol_key", "qname")
    calls = f.at("calls").select(F.col("callee_symbol_key").alias("symbol_key"), F.col("caller_symbol_key").alias("_by"), F.lit(1).alias("source_rank"), F.lit("call").alias("source"), "file_path", "line")
    refs = f.at("refs").where("from_symbol_key <> ''").select(F.col("to_symbol_key").alias("symbol_key"), F.col("from_symbol_key").alias("_by"), F.lit(2).alias("source_rank"), F.lit("reference").alias("source"), "file_path", "line")
    used = calls.unionAll(refs).join(wanted, "symbol_key", "left_semi").join(names.select(F.col("symbol_key").alias("_by"), F.col("qname").alias("label")), "_by").drop("_by")
    tested = (
        f.at("test_links").select("symbol_key", "test_key").distinct().join(wanted, "symbol_key", "left_semi").join(f.at("tests"), "test_key")
        .select("symbol_key", F.lit(3).alias("source_rank"), F.lit("test").alias("source"), "file_path", "line", F.col("name").alias("label"))
    )
    order = Window.partitionBy("symbol_key").orderBy("source_rank", "label", "file_path", "line")
    ranked = used.unionByName(tested).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def package_provenance(f: Facts, import_path: str, limit: int = 3) -> DataFrame:
    """At most ``limit`` pieces of evidence of a package: what depends on it, then its busiest symbols, then its tests."""
    users = f.at("package_deps").where(F.col("is_local") & (F.col("to_package_import_path") == import_path)).select(F.col("from_package_import_path").alias("label")).distinct()
    counts = {"callers": metrics.callers(f), "refs": metrics.references(f), "tests": metrics.tests(f)}
    mine = f.at("symbols").where(F.col("package_import_path") == import_path).select("symbol_key", "qname", "file_path", "line")
    for name, rows in counts.items():
        mine = mine.join(rows.toDF("symbol_key", name), "symbol_key", "left").fillna(0, [name])
    said = F.format_string("hot symbol in package ranking (callers=%d refs=%d tests=%d)", "callers", "refs", "tests")
    score = F.col("callers") * 5 + F.col("refs") * 2 + F.col("tests") * 3
    tests = f.at("tests").where(F.col("package_import_path") == import_path).join(f.at("test_links").select("test_key", "symbol_key").distinct(), "test_key", "left")
    tests = tests.groupBy("name", "file_path", "line").agg(F.count_distinct("symbol_key").alias("links"))
    none, zero = F.lit(""), F.lit(0)
    parts = [
        users.select(F.lit(1).alias("rank"), F.lit("reverse_dep").alias("source"), "label", none.alias("file_path"), zero.alias("line"), F.lit("reverse package dependency in local graph").alias("why"), zero.cast("long").alias("_o")).orderBy("label").limit(limit),
        mine.select(F.lit(2), F.lit("symbol"), "qname", "file_path", "line", said, (-score).alias("_o")).orderBy("_o", "qname", "file_path", "line").limit(limit),
        tests.select(F.lit(3), F.lit("test"), "name", "file_path", "line", F.format_string("package test signal (links=%d)", "links"), (-F.col("links")).alias("_o")).orderBy("_o", "file_path", "line", "name").limit(limit),
    ]
    rows = reduce(DataFrame.unionAll, parts)
    return rows.orderBy("rank", "_o", "file_path", "line", "label").limit(limit).drop("_o", "rank")


def test_guidance(f: Facts, symbol_key: str, limit: int = 8) -> DataFrame:
    """Tests to read before a change: direct ones, those of the first callers, callees and siblings, and of the package.

    Of a test found in several ways the best score counts; ``why`` joins the
    reasons, the best first, leaving out what a longer one contains.
    """
    from .views import link_why

    def first(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
        """The first ``n`` listed edges: a symbol may stand in several of them, its tests count once."""
        return rows.orderBy(*order).limit(n).select(F.col(key).alias("symbol_key"), F.col("name").alias("_near")).distinct()

    def related(keys: DataFrame, per: int, base: int, relation: str, covers: str) -> DataFrame:
        rows = f.at("test_links").join(keys, "symbol_key").select("symbol_key", "_near", "test_key", "link_kind", "confidence").join(f.at("tests"), "test_key").withColumn("_s", link_score())
        nth = F.row_number().over(Window.partitionBy("symbol_key").orderBy(F.desc("_s"), "file_path", "line", "name", "test_key", "link_kind"))
        score = F.lit(base + 60) + lookup("confidence", CONFIDENCE_RANK, 0) * 18 + lookup("link_kind", LINK_RANK, 0) * 6
        why = F.concat(F.lit(f"covers {covers} "), F.when(F.col("_near") == "", F.lit("nearby symbol")).otherwise(F.col("_near")), F.lit(" via "), link_why())
        return rows.withColumn("_n", nth).where(F.col("_n") <= per).select("test_key", "file_path", "line", "name", score.alias("score"), F.lit(relation).alias("relation"), why.alias("why"))

    me = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("package_import_path", "file_path", "name", "receiver").first()
    direct = tests_of(f, symbol_key).select("test_key", "file_path", "line", "name", (F.col("score") + 320).alias("score"), F.lit("direct").alias("relation"), link_why().alias("why"))
    family, named = T.same_family(F.lit(me["file_path"]), F.col("file_path")), T.name_affinity(F.lit(me["name"]), F.col("name"))
    fallback = F.lit(90) + F.col("score") + F.when(family, 60).otherwise(0) + F.when(named, 50).otherwise(0)
    fallback_why = F.concat(F.lit("same package fallback"), F.when(family, ", same file family").otherwise(""), F.when(named, ", name affinity").otherwise(""))
    parts = [
        direct,
        related(first(callers(f, symbol_key), "caller_symbol_key", 3, "qname", "file_path", "line", "col", "caller_symbol_key"), 3, 230, "caller", "caller"),
        related(first(callees(f, symbol_key), "callee_symbol_key", 3, "qname", "file_path", "line", "col", "callee_symbol_key"), 2, 210, "callee", "callee"),
        related(first(siblings(f, symbol_key), "symbol_key", 3, "file_path", "line", "symbol_key"), 2, 180, "sibling", "nearby"),
        package_tests(f, me["package_import_path"]).select("test_key", "file_path", "line", "name", fallback.alias("score"), F.lit("package").alias("relation"), fallback_why.alias("why")),
    ]
    rows = reduce(DataFrame.unionAll, parts)
    folded = rows.groupBy("test_key").agg(
        F.min("file_path").alias("file_path"), F.min("line").alias("line"), F.min("name").alias("name"), F.max("score").alias("score"),
        F.min_by("relation", F.struct((-F.col("score")).alias("s"), "relation", "why")).alias("relation"), F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "relation", "why"))).alias("_w"),
    )
    why = F.aggregate(F.transform("_w", lambda x: x["why"]), F.lit(""), T.merged_why)
    best = folded.withColumn("why", why).drop("_w")
    return best.orderBy(F.desc("score"), "file_path", "line", "name", "test_key").limit(limit)


def test_signal(f: Facts, symbol_key: str, limit: int = 8) -> DataFrame:
    """One row: direct and strong direct tests, nearby ones among the recommended, the summary of them, and a warning or ''."""
    direct = tests_of(f, symbol_key).agg(F.count(F.lit(1)).alias("direct"), F.count_if(lookup("confidence", CONFIDENCE_RANK, 0) >= 2).alias("strong"))
    nearby = test_guidance(f, symbol_key, limit).agg(F.count_if(F.col("relation") != "direct").alias("nearby"))
    package = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("package_import_path").first()[0]
    users = f.at("package_deps").where(F.col("is_local") & (F.col("to_package_import_path") == package)).agg(F.count_distinct("from_package_import_path").alias("users"))
    edges = [rows.agg(F.count(F.lit(1)).alias(n)) for rows, n in ((callers(f, symbol_key), "callers"), (references_in(f, symbol_key), "refs"))]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [direct, nearby, users, *edges])  # one row each
    impact = impact_label(F.col("callers") + F.col("refs") + F.col("direct") + F.col("users"))
    beside = F.when(F.col("nearby") > 0, F.format_string(" | nearby=%d", "nearby")).otherwise("")
    signal = (
        F.when(F.col("strong") > 0, F.concat(F.format_string("direct=%d strong", "strong"), beside)).when(F.col("direct") > 0, F.concat(F.format_string("direct=%d weak", "direct"), beside))
        .when(F.col("nearby") > 0, F.format_string("nearby-only=%d", "nearby")).when(impact == "low", F.lit("light coverage posture")).otherwise(F.lit("thin coverage"))
    )
    warning = F.when((F.col("strong") == 0) & (F.col("nearby") == 0) & (impact != "low"), F.lit("important symbol without good nearby tests")).otherwise("")
    return one.select("direct", "strong", "nearby", signal.alias("signal"), warning.alias("warning"))
