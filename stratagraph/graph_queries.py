"""Registered queries over the code graph: counts, joins, differences, walks, rankings and search.

Queries about one symbol or package take the busiest one (most callers, most
symbols) of the current snapshot, so they have an answer on any data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .facts import Facts, base
from .operators import delta, graph, metrics, rank, search
from .operators.rank import FUNCTION_WEIGHTS, TYPE_WEIGHTS
from .registry import query


def facts_query(sql: str | None = None, name: str | None = None, settle: bool = False) -> Callable:
    """Registers a query that is given the cleaned tables; ``sql`` may use them by their short names.

    Queries that use a table in many places ask for it to be settled first.
    """

    def register(body: Callable[[Facts], DataFrame]) -> Callable:
        query(base(sql) if sql else None, name or body.__name__)(lambda spark, sf_dir: body(Facts(spark, sf_dir, settle)))
        return body

    return register


# --- counts -----------------------------------------------------------------------


@facts_query("SELECT callee_symbol_key AS symbol_key, count(*) AS caller_count FROM ce_c GROUP BY 1")
def agg_caller_count(f: Facts) -> DataFrame:
    return metrics.callers(f)


@facts_query("SELECT caller_symbol_key AS symbol_key, count(*) AS callee_count FROM ce_c GROUP BY 1")
def agg_callee_count(f: Facts) -> DataFrame:
    return metrics.callees(f)


@facts_query("SELECT to_symbol_key AS symbol_key, count(*) AS reference_count FROM rf_c WHERE from_symbol_key <> '' GROUP BY 1")
def agg_ref_count(f: Facts) -> DataFrame:
    return metrics.references(f)


@facts_query("SELECT symbol_key, count(DISTINCT test_key) AS test_count FROM tl_c GROUP BY 1")
def agg_test_count(f: Facts) -> DataFrame:
    return metrics.tests(f)


def _pm(suffix: str = "_c", extra: str = "", on: str = "") -> str:
    """Package metrics; with ``extra`` = 'snapshot_id, ' over all snapshots."""
    key = f"{extra}import_path"
    return f"""SELECT p.*,
      coalesce(s.n, 0) AS symbol_count, coalesce(t.n, 0) AS test_count, coalesce(d.n, 0) AS local_deps, coalesce(r.n, 0) AS reverse_deps,
      coalesce(r.n, 0) * 4 + coalesce(s.n, 0) + coalesce(t.n, 0) * 2 AS importance
    FROM pk{suffix} p
    LEFT JOIN (SELECT {extra}package_import_path AS import_path, count(*) AS n FROM sym{suffix} GROUP BY ALL) s USING ({key})
    LEFT JOIN (SELECT {extra}package_import_path AS import_path, count(*) AS n FROM ts{suffix} GROUP BY ALL) t USING ({key})
    LEFT JOIN (SELECT {extra}from_package_import_path AS import_path, count(DISTINCT to_package_import_path) AS n FROM pd{suffix} WHERE is_local GROUP BY ALL) d USING ({key})
    LEFT JOIN (SELECT {extra}to_package_import_path AS import_path, count(DISTINCT from_package_import_path) AS n FROM pd{suffix} WHERE is_local GROUP BY ALL) r USING ({key})"""


_PM = f", pm AS ({_pm()})"
_PM_ALL = f", pma AS ({_pm('', 'snapshot_id, ')})"


@facts_query(f"{_PM} SELECT import_path, file_count, symbol_count, test_count, local_deps, reverse_deps, importance FROM pm", settle=True)
def agg_pkg_metrics(f: Facts) -> DataFrame:
    return metrics.package_metrics(f).select("import_path", "file_count", "symbol_count", "test_count", "local_deps", "reverse_deps", "importance")


@facts_query(
    f"""{_PM} SELECT import_path, symbol_count, test_count,
    (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT to_package_import_path AS x FROM pd_c WHERE is_local AND from_package_import_path = (SELECT p FROM anchor_pkg))) AS depends_on,
    (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT from_package_import_path AS x FROM pd_c WHERE is_local AND to_package_import_path = (SELECT p FROM anchor_pkg))) AS used_by
    FROM pm WHERE import_path = (SELECT p FROM anchor_pkg)""",
    settle=True,
)
def agg_pkg_summary(f: Facts) -> DataFrame:
    package = f.largest_package()
    local = f.at("package_deps").where("is_local")
    out = local.where(F.col("from_package_import_path") == package).agg(F.array_join(F.array_sort(F.collect_set("to_package_import_path")), ",").alias("depends_on"))
    used = local.where(F.col("to_package_import_path") == package).agg(F.array_join(F.array_sort(F.collect_set("from_package_import_path")), ",").alias("used_by"))
    mine = metrics.package_metrics(f).where(F.col("import_path") == package).select("import_path", "symbol_count", "test_count")
    return mine.join(F.broadcast(out)).join(F.broadcast(used))  # one row each


@facts_query(f"{_PM_ALL} SELECT snapshot_id, import_path, file_count, symbol_count FROM pma")
def agg_pkg_diff_metrics(f: Facts) -> DataFrame:
    symbols = f.symbols.groupBy("snapshot_id", F.col("package_import_path").alias("import_path")).agg(F.count(F.lit(1)).alias("symbol_count"))
    return f.packages.join(symbols, ["snapshot_id", "import_path"]).select("snapshot_id", "import_path", "file_count", "symbol_count")


_IN_CALLS = "SELECT t.file_path AS rel_path, count(DISTINCT c.caller_symbol_key || '|' || c.file_path || '|' || c.line) AS inbound_calls FROM ce_c c JOIN sym_c t ON t.symbol_key = c.callee_symbol_key GROUP BY 1"
_IN_REFS = "SELECT t.file_path AS rel_path, count(DISTINCT r.from_symbol_key || '|' || r.file_path || '|' || r.line) AS inbound_refs FROM rf_c r JOIN sym_c t ON t.symbol_key = r.to_symbol_key WHERE r.from_symbol_key <> '' GROUP BY 1"
_RELEVANT = "s.kind IN ('func', 'method', 'struct', 'interface', 'type', 'alias', 'class') AND NOT s.is_test"
_FS_ONLY = f""", fs AS (
  SELECT f.rel_path, f.package_import_path, f.size_bytes, f.is_test,
    count(DISTINCT s.symbol_key) AS symbol_count,
    count(DISTINCT CASE WHEN s.kind = 'func' AND NOT s.is_test THEN s.symbol_key END) AS func_count,
    count(DISTINCT CASE WHEN s.kind = 'method' AND NOT s.is_test THEN s.symbol_key END) AS method_count,
    count(DISTINCT CASE WHEN s.kind IN ('struct', 'interface', 'type', 'alias', 'class') AND NOT s.is_test THEN s.symbol_key END) AS type_count,
    count(DISTINCT t.test_key) AS declared_tests, count(DISTINCT tl.test_key) AS related_tests,
    count(DISTINCT CASE WHEN {_RELEVANT} THEN s.symbol_key END) AS relevant_symbols,
    count(DISTINCT CASE WHEN tl.test_key IS NOT NULL AND {_RELEVANT} THEN s.symbol_key END) AS linked_symbols,
    coalesce(max(ic.inbound_calls), 0) AS inbound_calls, coalesce(max(ir.inbound_refs), 0) AS inbound_refs, coalesce(max(pm.reverse_deps), 0) AS reverse_package_deps
  FROM fl_c f LEFT JOIN sym_c s ON s.file_path = f.rel_path LEFT JOIN ts_c t ON t.file_path = f.rel_path LEFT JOIN tl_c tl ON tl.symbol_key = s.symbol_key
    LEFT JOIN ({_IN_CALLS}) ic ON ic.rel_path = f.rel_path LEFT JOIN ({_IN_REFS}) ir ON ir.rel_path = f.rel_path LEFT JOIN pm ON pm.import_path = f.package_import_path
  GROUP BY f.rel_path, f.package_import_path, f.size_bytes, f.is_test)"""
_FS = f"{_PM}{_FS_ONLY}"
_FS_COLUMNS = ["rel_path", "package_import_path", "symbol_count", "func_count", "method_count", "type_count", "declared_tests", "related_tests", "relevant_symbols", "linked_symbols", "inbound_calls", "inbound_refs", "reverse_package_deps"]


@facts_query(f"{_FS} SELECT {', '.join(_FS_COLUMNS)} FROM fs", settle=True)
def agg_file_summary(f: Facts) -> DataFrame:
    return metrics.file_summaries(f).select(*_FS_COLUMNS)


@facts_query(_IN_CALLS)
def agg_inbound_calls(f: Facts) -> DataFrame:
    return metrics.inbound_calls(f)


@facts_query(_IN_REFS)
def agg_inbound_refs(f: Facts) -> DataFrame:
    return metrics.inbound_refs(f)


@facts_query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, snapshot_id, count(*) AS row_count FROM {t} GROUP BY 2"
        for n, t in (("symbols", "sym"), ("calls", "ce"), ("refs", "rf"), ("test_links", "tl"), ("files", "fl"), ("packages", "pk"), ("package_deps", "pd"), ("tests", "ts"))
    )
)
def agg_counts(f: Facts) -> DataFrame:
    return metrics.table_counts(f)


@facts_query("SELECT a.id, max(b.id) AS previous_id FROM snapshots a LEFT JOIN snapshots b ON b.id < a.id GROUP BY 1")
def agg_max_prev(f: Facts) -> DataFrame:
    ids = f.raw("snapshots").select("id").distinct()
    return ids.withColumn("previous_id", F.lag("id").over(Window.orderBy("id")))  # one row per snapshot


# --- joins --------------------------------------------------------------------------


def _names(alias: str = "s") -> str:
    return f"{alias}.qname, {alias}.package_import_path, {alias}.name, {alias}.kind"


@facts_query(f"SELECT c.caller_symbol_key, c.file_path, c.line, c.col, c.dispatch, {_names()} FROM ce_c c JOIN sym_c s ON s.symbol_key = c.caller_symbol_key WHERE c.callee_symbol_key = (SELECT k FROM anchor)")
def jn_callers(f: Facts) -> DataFrame:
    return graph.callers(f, f.busiest_symbol())


@facts_query(f"SELECT c.callee_symbol_key, c.file_path, c.line, c.col, c.dispatch, {_names()} FROM ce_c c JOIN sym_c s ON s.symbol_key = c.callee_symbol_key WHERE c.caller_symbol_key = (SELECT k FROM anchor)")
def jn_callees(f: Facts) -> DataFrame:
    return graph.callees(f, f.busiest_symbol())


@facts_query(f"SELECT r.from_symbol_key, r.file_path, r.line, r.col, r.kind AS ref_kind, {_names()} FROM rf_c r JOIN sym_c s ON s.symbol_key = r.from_symbol_key WHERE r.to_symbol_key = (SELECT k FROM anchor) AND r.from_symbol_key <> ''")
def jn_refs_in(f: Facts) -> DataFrame:
    return graph.references_in(f, f.busiest_symbol())


@facts_query(f"SELECT r.to_symbol_key, r.file_path, r.line, r.col, r.kind AS ref_kind, {_names()} FROM rf_c r JOIN sym_c s ON s.symbol_key = r.to_symbol_key WHERE r.from_symbol_key = (SELECT k FROM anchor)")
def jn_refs_out(f: Facts) -> DataFrame:
    return graph.references_out(f, f.busiest_symbol())


_CONF = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_LINK = "CASE link_kind WHEN 'direct' THEN 3 WHEN 'receiver_match' THEN 3 WHEN 'related' THEN 2 WHEN 'name_match' THEN 2 WHEN 'global_name_match' THEN 1 ELSE 0 END"


@facts_query(
    f"""SELECT l.test_key, l.link_kind, l.confidence, t.name, t.file_path, t.line, 240 + {_CONF} * 20 + {_LINK} * 6 AS score
    FROM tl_c l JOIN ts_c t ON t.test_key = l.test_key WHERE l.symbol_key = (SELECT k FROM anchor)"""
)
def jn_tests_for_symbol(f: Facts) -> DataFrame:
    return graph.tests_of(f, f.busiest_symbol()).select("test_key", "link_kind", "confidence", "name", "file_path", "line", "score")


@facts_query(
    """SELECT t.test_key, count(DISTINCT l.symbol_key) AS linked_symbols, count(DISTINCT l.symbol_key) * 10 AS score FROM ts_c t LEFT JOIN tl_c l ON l.test_key = t.test_key
    WHERE t.package_import_path = (SELECT p FROM anchor_pkg) GROUP BY t.test_key, t.file_path, t.line, t.name ORDER BY 2 DESC, t.file_path, t.line, t.name, t.test_key LIMIT 10"""
)
def jn_package_tests(f: Facts) -> DataFrame:
    return graph.package_tests(f, f.largest_package()).select("test_key", "linked_symbols", "score")


_SM = f"""{_PM}, sm AS (
  SELECT s.*, coalesce(a.n, 0) AS caller_count, coalesce(b.n, 0) AS callee_count, coalesce(c.n, 0) AS reference_count, coalesce(d.n, 0) AS test_count,
    coalesce(pm.reverse_deps, 0) AS reverse_package_deps, coalesce(pm.importance, 0) AS package_importance,
    CASE WHEN s.kind IN ('struct', 'interface', 'type', 'alias', 'class') THEN (SELECT count(*) FROM sym_c m WHERE m.package_import_path = s.package_import_path AND m.kind = 'method' AND (m.receiver = s.name OR m.receiver = '*' || s.name)) ELSE 0 END AS method_count
  FROM sym_c s
  LEFT JOIN (SELECT callee_symbol_key AS k, count(*) AS n FROM ce_c GROUP BY 1) a ON a.k = s.symbol_key
  LEFT JOIN (SELECT caller_symbol_key AS k, count(*) AS n FROM ce_c GROUP BY 1) b ON b.k = s.symbol_key
  LEFT JOIN (SELECT to_symbol_key AS k, count(*) AS n FROM rf_c WHERE from_symbol_key <> '' GROUP BY 1) c ON c.k = s.symbol_key
  LEFT JOIN (SELECT symbol_key AS k, count(DISTINCT test_key) AS n FROM tl_c GROUP BY 1) d ON d.k = s.symbol_key
  LEFT JOIN pm ON pm.import_path = s.package_import_path)"""
_SM_COLUMNS = ["symbol_key", "qname", "kind", "caller_count", "callee_count", "reference_count", "test_count", "reverse_package_deps", "package_importance", "method_count"]


@facts_query(f"{_SM} SELECT {', '.join(_SM_COLUMNS)} FROM sm", settle=True)
def jn_symbol_metrics(f: Facts) -> DataFrame:
    return metrics.symbol_metrics(f).select(*_SM_COLUMNS)


@facts_query("SELECT package_import_path, regexp_replace(receiver, '^\\*', '') AS name, count(*) AS method_count FROM sym_c WHERE kind = 'method' GROUP BY 1, 2")
def jn_type_methods(f: Facts) -> DataFrame:
    return metrics.type_methods(f)


@facts_query(
    """, ev AS (
      SELECT u.k AS symbol_key, u.source_rank, u.source, u.file_path, u.line, s.qname AS label FROM (
        SELECT callee_symbol_key AS k, caller_symbol_key AS by_key, 1 AS source_rank, 'call' AS source, file_path, line FROM ce_c
        UNION ALL SELECT to_symbol_key, from_symbol_key, 2, 'reference', file_path, line FROM rf_c WHERE from_symbol_key <> '') u JOIN sym_c s ON s.symbol_key = u.by_key
      UNION ALL SELECT l.symbol_key, 3, 'test', t.file_path, t.line, t.name FROM (SELECT DISTINCT symbol_key, test_key FROM tl_c) l JOIN ts_c t ON t.test_key = l.test_key)
    SELECT symbol_key, source, label, file_path, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY source_rank, label, file_path, line) AS rank FROM ev
      WHERE symbol_key IN (SELECT symbol_key FROM sym_c)) WHERE rank <= 3""",
    settle=True,
)
def win_evidence_top3(f: Facts) -> DataFrame:
    return graph.provenance(f, f.at("symbols").select("symbol_key")).select("symbol_key", "source", "label", "file_path", "line", "rank")


@facts_query(
    """SELECT s.symbol_key, s.file_path, s.line FROM sym_c s, (SELECT * FROM sym_c WHERE symbol_key = (SELECT k FROM anchor)) me
    WHERE s.package_import_path = me.package_import_path AND s.symbol_key <> me.symbol_key AND (s.file_path = me.file_path OR s.receiver = me.receiver) ORDER BY s.file_path, s.line, s.symbol_key LIMIT 8"""
)
def flt_siblings(f: Facts) -> DataFrame:
    return graph.siblings(f, f.busiest_symbol()).select("symbol_key", "file_path", "line")


@facts_query("SELECT symbol_key, name, kind, line, col FROM sym_c WHERE file_path = (SELECT file_path FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))")
def flt_file_symbols(f: Facts) -> DataFrame:
    path = f.at("symbols").where(F.col("symbol_key") == f.busiest_symbol()).first()["file_path"]
    return f.at("symbols").where(F.col("file_path") == path).select("symbol_key", "name", "kind", "line", "col").orderBy("line", "col")


@facts_query("SELECT min(symbol_key) AS symbol_key, qname, count(*) AS symbols FROM sym_c GROUP BY qname")
def flt_symbol_by_qname(f: Facts) -> DataFrame:
    return f.at("symbols").groupBy("qname").agg(F.min("symbol_key").alias("symbol_key"), F.count(F.lit(1)).alias("symbols"))


@facts_query("SELECT id, kind, scan_ms, analyze_ms, write_ms FROM snapshots WHERE id = (SELECT id FROM cur)")
def flt_current_snapshot(f: Facts) -> DataFrame:
    return f.raw("snapshots").where(F.col("id") == f.current).select("id", "kind", "scan_ms", "analyze_ms", "write_ms")


@facts_query("SELECT (SELECT id FROM cur) AS current_id, (SELECT count(*) FROM snapshots) AS snapshots, (SELECT sum(scan_ms) // count(*) FROM snapshots) AS average_scan_ms, (SELECT count(*) FROM sym_c) AS symbols, (SELECT count(*) FROM fl_c) AS files")
def prj_status(f: Facts) -> DataFrame:
    head = f.raw("snapshots").agg(F.max("id").alias("current_id"), F.count(F.lit(1)).alias("snapshots"), F.expr("sum(scan_ms) div count(1)").alias("average_scan_ms"))
    counts = [f.at(t).agg(F.count(F.lit(1)).alias(t)) for t in ("symbols", "files")]
    return head.join(F.broadcast(counts[0])).join(F.broadcast(counts[1]))  # one row each


# --- differences ----------------------------------------------------------------------


def _two(sql: str) -> str:
    """``{t_new}`` and ``{t_old}``: a table at the current and the previous snapshot."""
    import re

    return re.sub(r"\{(\w+)_(new|old)\}", lambda m: f"(SELECT * FROM {m[1]} WHERE snapshot_id = (SELECT id FROM {'cur' if m[2] == 'new' else 'prv'}))", sql)


@facts_query(_two("SELECT n.rel_path FROM {fl_new} n ANTI JOIN {fl_old} o USING (rel_path)"))
def anti_added_files(f: Facts) -> DataFrame:
    return delta.added_files(f, f.previous, f.current).select("rel_path")


@facts_query(_two("SELECT n.rel_path FROM {fl_old} n ANTI JOIN {fl_new} o USING (rel_path)"))
def anti_deleted_files(f: Facts) -> DataFrame:
    return delta.deleted_files(f, f.previous, f.current).select("rel_path")


@facts_query(_two("SELECT n.rel_path FROM {fl_new} n JOIN {fl_old} o USING (rel_path) WHERE n.content_hash IS DISTINCT FROM o.content_hash"))
def jn_changed_files(f: Facts) -> DataFrame:
    return delta.changed_files(f, f.previous, f.current).select("rel_path")


@facts_query(_two("SELECT DISTINCT n.rel_path FROM {fl_new} n LEFT JOIN {fl_old} o USING (rel_path) WHERE n.content_hash IS DISTINCT FROM o.content_hash OR o.snapshot_id IS NULL UNION SELECT n.rel_path FROM {fl_old} n ANTI JOIN {fl_new} o USING (rel_path)"))
def set_diff_files(f: Facts) -> DataFrame:
    a, b = f.previous, f.current
    return delta.added_files(f, a, b).select("rel_path").union(delta.changed_files(f, a, b).select("rel_path")).union(delta.deleted_files(f, a, b).select("rel_path")).distinct()


@facts_query(_two("SELECT n.symbol_key, n.qname FROM {sym_new} n ANTI JOIN {sym_old} o USING (qname)"))
def anti_added_symbols(f: Facts) -> DataFrame:
    return delta.added_symbols(f, f.previous, f.current).select("symbol_key", "qname")


@facts_query(_two("SELECT n.symbol_key, n.qname FROM {sym_old} n ANTI JOIN {sym_new} o USING (qname)"))
def anti_removed_symbols(f: Facts) -> DataFrame:
    return delta.removed_symbols(f, f.previous, f.current).select("symbol_key", "qname")


_CS = _two(
    """SELECT qname, o.file_path AS from_file_path, n.file_path AS to_file_path, o.line AS from_line, n.line AS to_line, o.signature <> n.signature AS contract_changed, o.file_path <> n.file_path OR o.line <> n.line AS moved
    FROM {sym_old} o JOIN {sym_new} n USING (qname) WHERE o.signature <> n.signature OR o.file_path <> n.file_path OR o.line <> n.line"""
)


@facts_query(_CS)
def jn_changed_symbols(f: Facts) -> DataFrame:
    return delta.changed_symbols(f, f.previous, f.current).select("qname", "from_file_path", "to_file_path", "from_line", "to_line", "contract_changed", "moved")


def _edges_sql(table: str, key: list[str]) -> str:
    k = ", ".join(key)
    return _two(f"SELECT {k}, 'added' AS change FROM {{{table}_new}} n ANTI JOIN {{{table}_old}} o USING ({k}) UNION ALL SELECT {k}, 'removed' FROM {{{table}_old}} n ANTI JOIN {{{table}_new}} o USING ({k})")


for _name, _table, _cte, _key in (("anti_calls", "calls", "ce", delta.CALL_KEY), ("anti_refs", "refs", "rf", delta.REF_KEY), ("anti_test_links", "test_links", "tl", delta.LINK_KEY)):
    facts_query(_edges_sql(_cte, _key), _name)(lambda f, t=_table, k=_key: delta.edge_changes(f, t, k, f.previous, f.current))

_DEP_KEY = "from_package_import_path, to_package_import_path"


@facts_query(
    _two(
        f"""SELECT {_DEP_KEY}, 'added' AS change FROM (SELECT * FROM {{pd_new}} WHERE is_local) n ANTI JOIN {{pd_old}} o USING ({_DEP_KEY})
    UNION ALL SELECT {_DEP_KEY}, 'removed' FROM (SELECT * FROM {{pd_old}} WHERE is_local) n ANTI JOIN {{pd_new}} o USING ({_DEP_KEY})"""
    )
)
def anti_pkg_deps(f: Facts) -> DataFrame:
    return delta.dep_changes(f, f.previous, f.current)


_FO = f"""{_PM_ALL}, fo AS (SELECT import_path, {', '.join(f'coalesce(o.{c}, 0) AS from_{c}, coalesce(n.{c}, 0) AS to_{c}' for c in delta.PACKAGE_COUNTS)}
  FROM (SELECT * FROM pma WHERE snapshot_id = (SELECT id FROM prv)) o FULL JOIN (SELECT * FROM pma WHERE snapshot_id = (SELECT id FROM cur)) n USING (import_path)),
foc AS (SELECT * FROM fo WHERE {' OR '.join(f'from_{c} <> to_{c}' for c in delta.PACKAGE_COUNTS)})"""


@facts_query(f"{_FO} SELECT * FROM foc", settle=True)
def fo_packages(f: Facts) -> DataFrame:
    return delta.changed_packages(f, f.previous, f.current)


@facts_query("SELECT DISTINCT from_package_import_path AS import_path FROM pd_c WHERE to_package_import_path = (SELECT p FROM anchor_pkg)")
def semi_reverse_deps(f: Facts) -> DataFrame:
    return graph.reverse_dependencies(f, f.at("packages").where(F.col("import_path") == f.largest_package()))


# --- the order of snapshots ---------------------------------------------------------------


@facts_query("SELECT qname, min(snapshot_id) AS first_snapshot, max(snapshot_id) AS last_snapshot, count(DISTINCT snapshot_id) AS snapshots FROM sym GROUP BY 1")
def win_first_seen(f: Facts) -> DataFrame:
    return delta.first_seen(f)


@facts_query("SELECT id, prev_id FROM pairs")
def win_prev_snapshot(f: Facts) -> DataFrame:
    return f.raw("snapshots").select("id").distinct().withColumn("prev_id", F.lag("id").over(Window.orderBy("id"))).where("prev_id IS NOT NULL")


# --- walks -----------------------------------------------------------------------------------


def _walk_sql(src: str, dst: str, depth: int) -> str:
    return f""", w AS (SELECT k AS key, 0 AS depth FROM anchor UNION SELECT c.{dst}, w.depth + 1 FROM w JOIN ce_c c ON c.{src} = w.key WHERE w.depth < {depth}),
    wm AS (SELECT key AS symbol_key, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1), wn AS (SELECT wm.symbol_key, wm.depth, {_names()} FROM wm JOIN sym_c s ON s.symbol_key = wm.symbol_key)"""


@facts_query(f"{_walk_sql('callee_symbol_key', 'caller_symbol_key', 3)} SELECT * FROM wn")
def rec_transitive_callers(f: Facts) -> DataFrame:
    return graph.transitive_callers(f, f.busiest_symbol(), 3)


@facts_query(f"{_walk_sql('callee_symbol_key', 'caller_symbol_key', 3)} SELECT DISTINCT package_import_path FROM wn WHERE package_import_path <> ''")
def rec_caller_packages(f: Facts) -> DataFrame:
    return graph.transitive_callers(f, f.busiest_symbol(), 3).where("package_import_path <> ''").select("package_import_path").distinct()


@facts_query("SELECT p AS import_path FROM anchor_pkg UNION SELECT from_package_import_path FROM pd_c WHERE to_package_import_path = (SELECT p FROM anchor_pkg)")
def rec_reverse_deps(f: Facts) -> DataFrame:
    mine = f.at("packages").where(F.col("import_path") == f.largest_package()).select("import_path")
    return mine.union(graph.reverse_dependencies(f, mine)).distinct()


@facts_query("SELECT a.id, a.parent_id, b.id IS NOT NULL OR a.parent_id IS NULL AS chained FROM snapshots a LEFT JOIN snapshots b ON b.id = a.parent_id")
def rec_snapshot_chain(f: Facts) -> DataFrame:
    a = f.raw("snapshots").select("id", "parent_id")
    b = a.select(F.col("id").alias("_id"))
    return a.join(b, F.col("parent_id") == F.col("_id"), "left").select("id", "parent_id", (F.col("_id").isNotNull() | F.col("parent_id").isNull()).alias("chained"))


# --- rankings -------------------------------------------------------------------------------------


def _weights(weights: dict[str, int]) -> str:
    return " + ".join(f"{c} * {w}" for c, w in weights.items())


def _entry(path: str) -> str:
    p = f"('/' || {path})"
    return (
        f"CASE WHEN suffix({p}, '/__main__.py') THEN 4 WHEN suffix({p}, '/main.go') OR suffix({p}, '/main.rs') THEN 4 WHEN contains({p}, '/cmd/') THEN 3 WHEN contains({p}, '/bin/') THEN 3 WHEN contains({p}, '/cli/') THEN 3"
        f" WHEN contains({p}, '/scripts/') THEN 2 WHEN contains({p}, '/examples/') OR contains({p}, '/example/') THEN 2 ELSE 0 END"
    )


def _dir(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '.' END"


_TOUCHED_ONLY = f""", touched AS ({_two("SELECT n.rel_path FROM {fl_new} n LEFT JOIN {fl_old} o USING (rel_path) WHERE o.snapshot_id IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash")}),
near AS (SELECT DISTINCT {_dir('rel_path')} AS d FROM touched)"""
_TOUCHED = f"{_FO}{_TOUCHED_ONLY}"


def _boost(path: str, package: str) -> str:
    return f"CASE WHEN {path} IN (SELECT rel_path FROM touched) THEN 8 WHEN {package} <> '' AND {package} IN (SELECT import_path FROM foc) THEN 5 WHEN {_dir(path)} IN (SELECT d FROM near) THEN 3 ELSE 0 END"


_SORT = "qname, symbol_key"


def _top_symbols(kinds: str, weights: dict[str, int], cte: str) -> str:
    return f"""{cte}0 AS (SELECT *, {_weights(weights)} AS graph_score FROM sm WHERE kind IN ({kinds})),
    {cte}p AS (SELECT * FROM {cte}0 ORDER BY graph_score DESC, {_SORT} LIMIT 32),
    {cte} AS (SELECT *, graph_score + {_entry('file_path')} + CASE WHEN lower(trim(name)) = 'main' AND kind = 'func' THEN 2 ELSE 0 END + {_boost('file_path', 'package_import_path')} AS score FROM {cte}p ORDER BY score DESC, {_SORT} LIMIT 8)"""


_TOP = f"{_SM}{_TOUCHED}, {_top_symbols(chr(39) + 'func' + chr(39) + ', ' + chr(39) + 'method' + chr(39), FUNCTION_WEIGHTS, 'tf')}, {_top_symbols(', '.join(repr(k) for k in ('struct', 'interface', 'type', 'alias', 'class')), TYPE_WEIGHTS, 'tt')}"


@facts_query(f"{_TOP} SELECT symbol_key, qname, graph_score, score FROM tf", settle=True)
def top_functions(f: Facts) -> DataFrame:
    return rank.top_functions(f).select("symbol_key", "qname", "graph_score", "score")


@facts_query(f"{_TOP} SELECT symbol_key, qname, graph_score, score FROM tt", settle=True)
def top_types(f: Facts) -> DataFrame:
    return rank.top_types(f).select("symbol_key", "qname", "graph_score", "score")


@facts_query(
    f"""{_PM}{_FO}, tp AS (SELECT * FROM pm ORDER BY reverse_deps DESC, symbol_count DESC, test_count DESC, import_path LIMIT 32)
    SELECT import_path, importance, importance + CASE WHEN import_path IN (SELECT import_path FROM foc) THEN 5 ELSE 0 END AS score FROM tp ORDER BY score DESC, import_path LIMIT 8""",
    settle=True,
)
def top_packages(f: Facts) -> DataFrame:
    return rank.top_packages(f).select("import_path", "importance", "score")


_SF_ONLY = f", sf0 AS (SELECT *, {_weights(rank.FILE_WEIGHTS)} AS graph_score, {_boost('rel_path', 'package_import_path')} AS change_boost FROM fs), sf AS (SELECT *, graph_score + {_entry('rel_path')} + change_boost AS quality_score FROM sf0)"
_FILES = f"{_FS}{_TOUCHED}{_SF_ONLY}"


@facts_query(f"{_FILES} SELECT rel_path, graph_score, quality_score FROM sf ORDER BY quality_score DESC, rel_path LIMIT 8", settle=True)
def top_files(f: Facts) -> DataFrame:
    return rank.top_files(f).select("rel_path", "graph_score", "quality_score")


_WEAK = "(relevant_symbols > 0 AND (related_tests = 0 OR linked_symbols * 100 // relevant_symbols < 35))"
_RISK = f"""{_FILES}, hot AS (SELECT rel_path, quality_score FROM sf ORDER BY quality_score DESC, rel_path LIMIT 64),
rk0 AS (SELECT sf.*, coalesce(hot.quality_score, 0) AS hot_score, sf.change_boost = 8 AS recent, CASE WHEN relevant_symbols > 0 THEN linked_symbols * 100 // relevant_symbols ELSE -1 END AS coverage FROM sf LEFT JOIN hot USING (rel_path)),
rk AS (SELECT *, coalesce(nullif(concat_ws(' | ', CASE WHEN hot_score >= 36 THEN 'hotspot' WHEN hot_score >= 18 OR relevant_symbols >= 5 THEN 'dense-logic' END,
  CASE WHEN recent AND {_WEAK} THEN 'recent+weak-tests' WHEN recent THEN 'recent' WHEN {_WEAK} THEN 'weak-test-link' END), ''), 'contained') AS risk FROM rk0)"""


@facts_query(f"{_RISK} SELECT rel_path, hot_score, coverage, risk FROM rk", settle=True)
def lb_risk_file(f: Facts) -> DataFrame:
    return rank.risky_files(f).select("rel_path", "hot_score", "coverage", "risk")


@facts_query(f"{_RISK} SELECT rel_path, hot_score, coverage FROM rk WHERE recent AND NOT is_test AND contains(risk, 'weak-test') ORDER BY hot_score DESC, coverage, rel_path LIMIT 6", settle=True)
def top_weak_areas(f: Facts) -> DataFrame:
    return rank.weak_areas(f).select("rel_path", "hot_score", "coverage")


_SRISK = """concat_ws(' | ', CASE WHEN tot >= 12 THEN 'blast=high' WHEN tot >= 5 THEN 'blast=medium' END, CASE WHEN caller_count > 0 AND callee_count > 0 THEN 'seam' END, CASE WHEN score >= 18 THEN 'hotspot' END,
  CASE WHEN test_count = 0 AND caller_count + reference_count + reverse_package_deps >= 3 THEN 'tests=thin' END, CASE WHEN reverse_package_deps >= 3 THEN 'pkg-rdeps=' || reverse_package_deps END, CASE WHEN method_count >= 3 THEN 'hub-type' END)"""
_RANKED = f"{_TOP}, rs AS (SELECT *, coalesce(nullif({_SRISK}, ''), 'contained') AS risk FROM (SELECT *, caller_count + reference_count + test_count + reverse_package_deps AS tot FROM (SELECT * FROM tf UNION ALL SELECT * FROM tt)))"


@facts_query(f"{_RANKED} SELECT symbol_key, score, risk FROM rs", settle=True)
def lb_risk_ranked_symbol(f: Facts) -> DataFrame:
    return rank.ranked_with_risk(f).select("symbol_key", "score", "risk")


@facts_query(f"{_RANKED} SELECT symbol_key, risk FROM rs WHERE risk <> 'contained' AND (contains(risk, 'blast=') OR contains(risk, 'hotspot') OR contains(risk, 'tests=thin') OR contains(risk, 'pkg-rdeps'))", settle=True)
def slice_risky(f: Facts) -> DataFrame:
    r = F.col("risk")
    return rank.ranked_with_risk(f).where((r != "contained") & (r.contains("blast=") | r.contains("hotspot") | r.contains("tests=thin") | r.contains("pkg-rdeps"))).select("symbol_key", "risk")


@facts_query(f"{_RANKED} SELECT symbol_key, risk FROM rs WHERE contains(risk, 'seam')", settle=True)
def slice_seams(f: Facts) -> DataFrame:
    return rank.ranked_with_risk(f).where(F.col("risk").contains("seam")).select("symbol_key", "risk")


@facts_query(f"{_RANKED} SELECT symbol_key, score FROM rs WHERE test_count = 0 AND score >= 7 ORDER BY score DESC, {_SORT} LIMIT 6", settle=True)
def top_thin_symbols(f: Facts) -> DataFrame:
    return rank.thin_symbols(f).select("symbol_key", "score")


_PRISK = "concat_ws(' | ', CASE WHEN reverse_deps >= 3 THEN 'rdeps=' || reverse_deps END, CASE WHEN local_deps > 0 AND reverse_deps > 0 THEN 'seam' END, CASE WHEN test_count = 0 AND (reverse_deps >= 2 OR symbol_count >= 6) THEN 'tests=thin' END, CASE WHEN file_count >= 5 OR symbol_count >= 10 THEN 'wide-surface' END)"


@facts_query(f"{_PM} SELECT import_path, coalesce(nullif({_PRISK}, ''), 'contained') AS risk FROM pm", settle=True)
def lb_risk_package(f: Facts) -> DataFrame:
    return metrics.package_metrics(f).select("import_path", rank.package_risk().alias("risk"))


@facts_query(f"{_PM} SELECT import_path FROM pm WHERE contains({_PRISK}, 'tests=thin')", settle=True)
def slice_low_tested(f: Facts) -> DataFrame:
    return metrics.package_metrics(f).where(rank.package_risk().contains("tests=thin")).select("import_path")


@facts_query(f"{_SM} SELECT symbol_key, caller_count + reference_count + test_count + reverse_package_deps AS total, CASE WHEN total >= 12 THEN 'high' WHEN total >= 5 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN package_importance >= 18 THEN 'high' WHEN package_importance >= 7 THEN 'medium' ELSE 'low' END AS importance FROM sm", settle=True)
def lb_impact(f: Facts) -> DataFrame:
    total = F.col("caller_count") + F.col("reference_count") + F.col("test_count") + F.col("reverse_package_deps")
    return metrics.symbol_metrics(f).select("symbol_key", total.alias("total"), rank.impact_label(total).alias("impact"), rank.importance_label(F.col("package_importance")).alias("importance"))


@facts_query(f"{_SM} SELECT symbol_key, {_weights(rank.RELEVANCE_WEIGHTS)} + CASE kind WHEN 'method' THEN 9 WHEN 'func' THEN 8 WHEN 'struct' THEN 7 WHEN 'class' THEN 7 WHEN 'interface' THEN 6 WHEN 'type' THEN 6 WHEN 'alias' THEN 6 ELSE 2 END AS relevance FROM sm", settle=True)
def sc_relevance(f: Facts) -> DataFrame:
    return metrics.symbol_metrics(f).select("symbol_key", (rank.weighted(rank.RELEVANCE_WEIGHTS) + rank.lookup("kind", rank.KIND_BOOST, 2)).alias("relevance"))


@facts_query("SELECT id, CASE WHEN greatest(scan_ms, analyze_ms, write_ms) <= 0 THEN 'none' WHEN scan_ms >= analyze_ms AND scan_ms >= write_ms THEN 'scan' WHEN analyze_ms >= write_ms THEN 'analyze' ELSE 'write' END AS bottleneck FROM snapshots")
def lb_timing_bottleneck(f: Facts) -> DataFrame:
    scan, analyze, write = F.col("scan_ms"), F.col("analyze_ms"), F.col("write_ms")
    label = F.when(F.greatest(scan, analyze, write) <= 0, "none").when((scan >= analyze) & (scan >= write), "scan").when(analyze >= write, "analyze").otherwise("write")
    return f.raw("snapshots").select("id", label.alias("bottleneck"))


@facts_query(f"{_SM} SELECT file_path, symbol_key, n FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {_weights(FUNCTION_WEIGHTS)} DESC, line, {_SORT}) AS n FROM sm) WHERE n <= 4", settle=True)
def win_file_first4(f: Facts) -> DataFrame:
    order = Window.partitionBy("file_path").orderBy(F.desc("_w"), "line", "qname", "symbol_key")
    rows = metrics.symbol_metrics(f).withColumn("_w", rank.weighted(FUNCTION_WEIGHTS)).withColumn("n", F.row_number().over(order))
    return rows.where("n <= 4").select("file_path", "symbol_key", "n")


@facts_query(f"{_SM}, u AS (SELECT symbol_key, {_weights(FUNCTION_WEIGHTS)} AS score FROM sm UNION ALL SELECT symbol_key, {_weights(TYPE_WEIGHTS)} FROM sm) SELECT symbol_key, max(score) AS score FROM u GROUP BY 1", settle=True)
def win_best_per_key(f: Facts) -> DataFrame:
    rows = metrics.symbol_metrics(f)
    both = rows.select("symbol_key", rank.weighted(FUNCTION_WEIGHTS).alias("score")).unionAll(rows.select("symbol_key", rank.weighted(TYPE_WEIGHTS).alias("score")))
    return both.groupBy("symbol_key").agg(F.max("score").alias("score"))


@facts_query(f"{_SM} SELECT symbol_key, n // 28 AS page FROM (SELECT symbol_key, row_number() OVER (ORDER BY qname, symbol_key) - 1 AS n FROM sm WHERE package_import_path = (SELECT p FROM anchor_pkg))")
def win_page(f: Facts) -> DataFrame:
    mine = f.at("symbols").where(F.col("package_import_path") == f.largest_package())
    place = F.row_number().over(Window.partitionBy("package_import_path").orderBy("qname", "symbol_key")) - 1
    return mine.select("symbol_key", F.floor(place / 28).alias("page"))


@facts_query(f"{_TOP}, u AS (SELECT * FROM tf UNION ALL SELECT * FROM tt) SELECT file_path, sum(score)::BIGINT AS score, arg_min(symbol_key, (line, symbol_key)) AS symbol_key FROM u GROUP BY 1", settle=True)
def vw_landing_hot(f: Facts) -> DataFrame:
    both = rank.top_functions(f).unionByName(rank.top_types(f))
    return both.groupBy("file_path").agg(F.sum("score").alias("score"), F.min_by("symbol_key", F.struct("line", "symbol_key")).alias("symbol_key"))


# --- search -------------------------------------------------------------------------------------------

#: What the search queries look for.
SYMBOL_QUERY, FUZZY_QUERY, PACKAGE_QUERY = "snapshot", "SnapshtLoad", "core"


def _score_sql(query: str) -> str:
    canon, most = "".join(c for c in query.lower() if c.isalnum()), max(2, len(query) // 4)
    q, n, t, qn, k = query.lower(), "lower(trim(name))", "tail", "lower(trim(qname))", "lower(trim(symbol_key))"
    c = {x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')" for x in ("nl", "tail", "ql", "kl")}
    sub = ".*".join(canon)
    best = "least(" + ", ".join(f"CASE WHEN {c[x]} <> '' THEN levenshtein({c[x]}, '{canon}') END" for x in ("nl", "tail", "ql", "kl")) + ")"
    return f""", s0 AS (SELECT *, {n} AS nl, {qn} AS ql, {k} AS kl, CASE WHEN regexp_extract({qn}, '[./]([^./]+)$', 1) <> '' THEN regexp_extract({qn}, '[./]([^./]+)$', 1) ELSE {qn} END AS tail FROM sm),
    s1 AS (SELECT *, CASE WHEN kl = '{q}' OR ql = '{q}' THEN 1200 WHEN nl = '{q}' OR tail = '{q}' THEN 1150 WHEN prefix(nl, '{q}') THEN 1025 WHEN prefix(tail, '{q}') THEN 1000 WHEN prefix(ql, '{q}') OR prefix(kl, '{q}') THEN 975
      WHEN contains(nl, '{q}') THEN 900 WHEN contains(tail, '{q}') THEN 875 WHEN contains(ql, '{q}') OR contains(kl, '{q}') THEN 850
      WHEN {c['nl']} = '{canon}' OR {c['tail']} = '{canon}' THEN 825 WHEN prefix({c['nl']}, '{canon}') OR prefix({c['tail']}, '{canon}') THEN 775
      WHEN contains({c['nl']}, '{canon}') OR contains({c['tail']}, '{canon}') OR contains({c['ql']}, '{canon}') OR contains({c['kl']}, '{canon}') THEN 725
      WHEN regexp_matches({c['nl']}, '{sub}') OR regexp_matches({c['tail']}, '{sub}') THEN 650 WHEN regexp_matches({c['ql']}, '{sub}') OR regexp_matches({c['kl']}, '{sub}') THEN 625
      WHEN {best} <= {most} THEN greatest(500 - {best} * 60, 320) ELSE 0 END AS score FROM s0),
    s2 AS (SELECT *, CASE WHEN score = 1200 THEN 'exact' WHEN score = 1150 THEN 'name' WHEN score >= 975 THEN 'prefix' WHEN score >= 850 THEN 'contains' WHEN score >= 725 THEN 'shape' WHEN score > 0 THEN 'fuzzy' ELSE '' END AS match_kind FROM s1)"""


for _name, _query in (("sr_symbol_score", SYMBOL_QUERY), ("sr_symbol_score_fuzzy", FUZZY_QUERY)):
    facts_query(f"{_SM}{_score_sql(_query)} SELECT symbol_key, score, match_kind FROM s2", _name)(
        lambda f, q=_query: search.score_symbols(f.at("symbols").select("symbol_key", "qname", "name"), q).select("symbol_key", "score", "match_kind")
    )

_KIND_SQL = "CASE match_kind WHEN 'exact' THEN 0 WHEN 'name' THEN 1 WHEN 'prefix' THEN 2 WHEN 'contains' THEN 3 WHEN 'shape' THEN 4 WHEN 'fuzzy' THEN 5 ELSE 9 END"


@facts_query(
    f"""{_SM}{_score_sql(SYMBOL_QUERY)}, s3 AS (SELECT *, CASE kind WHEN 'method' THEN 9 WHEN 'func' THEN 8 WHEN 'struct' THEN 7 WHEN 'class' THEN 7 WHEN 'interface' THEN 6 WHEN 'type' THEN 6 WHEN 'alias' THEN 6 ELSE 2 END AS boost,
      {_weights(rank.RELEVANCE_WEIGHTS)} + boost AS relevance FROM s2 WHERE score > 0)
    SELECT symbol_key, qname, match_kind, score, relevance FROM s3 ORDER BY {_KIND_SQL}, score DESC, relevance DESC, package_importance DESC, boost DESC, kind, line, qname, symbol_key LIMIT 40""",
    settle=True,
)
def sr_find_symbols(f: Facts) -> DataFrame:
    return search.find_symbols(f, SYMBOL_QUERY)


@facts_query(
    f"""{_PM}, m AS (SELECT *, CASE WHEN lower(import_path) = '{PACKAGE_QUERY}' THEN 1200 WHEN lower(name) = '{PACKAGE_QUERY}' THEN 1150 WHEN suffix(lower(import_path), '/{PACKAGE_QUERY}') THEN 1100 WHEN prefix(lower(import_path), '{PACKAGE_QUERY}') THEN 1000
      WHEN prefix(lower(name), '{PACKAGE_QUERY}') THEN 975 WHEN contains(lower(import_path), '{PACKAGE_QUERY}') THEN 875 WHEN contains(lower(name), '{PACKAGE_QUERY}') THEN 850 ELSE 0 END AS score FROM pm),
    m2 AS (SELECT import_path, CASE WHEN score = 1200 THEN 'exact' WHEN score >= 1100 THEN 'name' WHEN score >= 975 THEN 'prefix' ELSE 'contains' END AS match_kind, score FROM m WHERE score > 0)
    SELECT * FROM m2 ORDER BY {_KIND_SQL}, score DESC, import_path LIMIT 40""",
    settle=True,
)
def sr_find_packages(f: Facts) -> DataFrame:
    return search.find_packages(f, PACKAGE_QUERY)


#: What the text searches look for: any case, and a pattern.
TEXT_QUERY, TEXT_PATTERN = "call edge", "[Ff]ile hash (is|was|took)"


def _lines_sql(condition: str, column: str) -> str:
    return f""", li AS (SELECT project, rel_path, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS text, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line
      FROM scan_files WHERE content IS NOT NULL AND octet_length(encode(content)) <= 1048576)
    SELECT project, rel_path, line, octet_length(encode(substring(text, 1, {column}))) + 1 AS col FROM li WHERE {condition}"""


@facts_query(_lines_sql(f"contains(lower(text), '{TEXT_QUERY}')", f"instr(lower(text), '{TEXT_QUERY}') - 1"))
def sr_text(f: Facts) -> DataFrame:
    return search.text_lines(f.raw("scan_files"), ["project", "rel_path"], TEXT_QUERY).select("project", "rel_path", "line", "col")


@facts_query(_lines_sql(f"regexp_matches(text, '{TEXT_PATTERN}')", f"instr(text, regexp_extract(text, '{TEXT_PATTERN}')) - 1"))
def sr_regex(f: Facts) -> DataFrame:
    return search.text_lines(f.raw("scan_files"), ["project", "rel_path"], TEXT_PATTERN, regex=True).select("project", "rel_path", "line", "col")
