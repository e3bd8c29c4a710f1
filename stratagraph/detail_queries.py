"""Registered queries of smaller parts: walks with parents, guidance on tests, evidence, names, and single look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .facts import Facts
from .functions import text as T
from .graph_queries import _CONF, _FILES, _FS, _LINK, _PM, _SM, TEXT_QUERY, _lines_sql, _names, facts_query
from .operators import graph, metrics, rank, search
from .operators.history import Diffs
from .view_queries import _D_FILES, _LISTS, _TEST_WHY

# -- snapshots, packages and files one by one ---------------------------------------------


@facts_query("SELECT id, parent_id, kind, scan_ms, analyze_ms, write_ms FROM snapshots WHERE id = (SELECT id FROM prv)")
def flt_snapshot_by_id(f: Facts) -> DataFrame:
    return f.raw("snapshots").where(F.col("id") == f.previous).select("id", "parent_id", "kind", "scan_ms", "analyze_ms", "write_ms")


@facts_query("SELECT id, parent_id, kind FROM snapshots ORDER BY id DESC LIMIT 4")
def lim_snapshots(f: Facts) -> DataFrame:
    return f.raw("snapshots").select("id", "parent_id", "kind").orderBy(F.desc("id")).limit(4)


@facts_query(
    """SELECT import_path, file_count, (SELECT count(*) FROM sym WHERE snapshot_id = (SELECT id FROM prv) AND package_import_path = pk.import_path) AS symbol_count, (SELECT count(*) FROM ts WHERE snapshot_id = (SELECT id FROM prv) AND package_import_path = pk.import_path) AS test_count
    FROM pk WHERE snapshot_id = (SELECT id FROM prv) AND import_path = (SELECT p FROM anchor_pkg)"""
)
def vw_package_at_snapshot(f: Facts) -> DataFrame:
    return metrics.package_metrics(f, f.previous).where(F.col("import_path") == f.largest_package()).select("import_path", "file_count", "symbol_count", "test_count")


@facts_query(f"{_D_FILES} SELECT snapshot_id, rel_path, pkg AS package_import_path, change FROM d_file")
def jn_pkg_for_file(f: Facts) -> DataFrame:
    return Diffs(f).files.select("snapshot_id", "rel_path", "package_import_path", "change")


_HERE = "(SELECT file_path FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))"


@facts_query(f"{_FS} SELECT rel_path, symbol_count, relevant_symbols, related_tests, inbound_calls FROM fs WHERE rel_path = {_HERE}", settle=True)
def vw_file_summary(f: Facts) -> DataFrame:
    path = f.at("symbols").where(F.col("symbol_key") == f.busiest_symbol()).first()["file_path"]
    return metrics.file_summaries(f).where(F.col("rel_path") == path).select("rel_path", "symbol_count", "relevant_symbols", "related_tests", "inbound_calls")


@facts_query(f"SELECT rel_path FROM fl_c WHERE prefix(rel_path, split_part({_HERE}, '/', 1) || '/') OR rel_path = split_part({_HERE}, '/', 1)")
def flt_path_scope(f: Facts) -> DataFrame:
    path = f.at("symbols").where(F.col("symbol_key") == f.busiest_symbol()).first()["file_path"]
    return f.at("files").where(T.in_scope("rel_path", path.split("/")[0])).select("rel_path")


@facts_query(f"{_FILES} SELECT rel_path, quality_score FROM sf ORDER BY quality_score DESC, graph_score DESC, relevant_symbols DESC, related_tests DESC, change_boost = 8 DESC, rel_path LIMIT 8", settle=True)
def top_file_summaries(f: Facts) -> DataFrame:
    return rank.top_file_summaries(f).select("rel_path", "quality_score")


# -- evidence and risk -------------------------------------------------------------------------


@facts_query(
    """, ev AS (SELECT * FROM (SELECT 1 AS rank, 'reverse_dep' AS source, from_package_import_path AS label, '' AS file_path, 0 AS line, 'reverse package dependency in local graph' AS why, 0 AS o FROM (SELECT DISTINCT from_package_import_path FROM pd_c WHERE is_local AND to_package_import_path = (SELECT p FROM anchor_pkg)) ORDER BY label LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 2, 'symbol', qname, file_path, line, printf('hot symbol in package ranking (callers=%d refs=%d tests=%d)', c, r, t), -(c * 5 + r * 2 + t * 3) AS o FROM (
      SELECT s.*, (SELECT count(*) FROM ce_c WHERE callee_symbol_key = s.symbol_key) AS c, (SELECT count(*) FROM rf_c WHERE to_symbol_key = s.symbol_key AND from_symbol_key <> '') AS r, (SELECT count(DISTINCT test_key) FROM tl_c WHERE symbol_key = s.symbol_key) AS t
      FROM sym_c s WHERE package_import_path = (SELECT p FROM anchor_pkg)) ORDER BY o, qname, file_path, line LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 3, 'test', t.name, t.file_path, t.line, printf('package test signal (links=%d)', count(DISTINCT l.symbol_key)), -count(DISTINCT l.symbol_key) AS o FROM ts_c t LEFT JOIN tl_c l ON l.test_key = t.test_key WHERE t.package_import_path = (SELECT p FROM anchor_pkg) GROUP BY t.name, t.file_path, t.line ORDER BY o, t.file_path, t.line, t.name LIMIT 3))
    SELECT source, label, file_path, line, why FROM ev ORDER BY rank, o, file_path, line, label LIMIT 3"""
)
def jn_provenance_package(f: Facts) -> DataFrame:
    return graph.package_provenance(f, f.largest_package())


_NEAR_RISK = """concat_ws(' | ', CASE WHEN used + test_count >= 12 THEN 'blast=high' WHEN used + test_count >= 5 THEN 'blast=medium' END, CASE WHEN caller_count > 0 AND callee_count > 0 OR reference_count > 0 AND refs_out > 0 THEN 'seam' END,
  CASE WHEN reverse_package_deps >= 3 THEN 'pkg-rdeps=' || reverse_package_deps END, CASE WHEN test_count = 0 AND used >= 3 THEN 'tests=thin' END, CASE WHEN package_importance >= 6 OR used >= 8 THEN 'hotspot' END)"""


@facts_query(
    f"""{_SM} SELECT symbol_key, coalesce(nullif({_NEAR_RISK}, ''), 'contained') AS risk FROM (SELECT sm.*, coalesce(o.n, 0) AS refs_out, caller_count + reference_count + reverse_package_deps AS used FROM sm
      LEFT JOIN (SELECT from_symbol_key AS k, count(*) AS n FROM rf_c WHERE from_symbol_key <> '' GROUP BY 1) o ON o.k = sm.symbol_key)""",
    settle=True,
)
def lb_risk_symbol(f: Facts) -> DataFrame:
    out = f.at("refs").where("from_symbol_key <> ''").groupBy(F.col("from_symbol_key").alias("symbol_key")).agg(F.count(F.lit(1)).alias("refs_out"))
    return metrics.symbol_metrics(f).join(out, "symbol_key", "left").fillna(0, ["refs_out"]).select("symbol_key", rank.neighbourhood_risk().alias("risk"))


# -- walks ----------------------------------------------------------------------------------------

_SITE = "concat_ws(chr(1), c.file_path, lpad(c.line::VARCHAR, 10, '0'), s.qname, c.callee_symbol_key)"


def _levels_sql(depth: int) -> str:
    parts = [", b0 AS (SELECT caller_symbol_key AS key, '' AS o FROM ce_c WHERE caller_symbol_key IN (SELECT symbol_key FROM sym_c) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT key FROM b{j}" for j in range(i))
        parts.append(f""", b{i} AS (SELECT c.callee_symbol_key AS key, min(b.o || chr(2) || {_SITE}) AS o, arg_min(c.caller_symbol_key, b.o || chr(2) || {_SITE}) AS parent_key, arg_min(c.file_path, b.o || chr(2) || {_SITE}) AS use_file_path, arg_min(c.line, b.o || chr(2) || {_SITE}) AS use_line
        FROM b{i - 1} b JOIN ce_c c ON c.caller_symbol_key = b.key JOIN sym_c s ON s.symbol_key = c.callee_symbol_key WHERE c.callee_symbol_key NOT IN ({seen}) GROUP BY 1)""")
    union = " UNION ALL ".join(f"SELECT key AS symbol_key, {i} AS depth, parent_key, use_file_path, use_line, row_number() OVER (PARTITION BY parent_key ORDER BY o) AS place FROM b{i}" for i in range(1, depth + 1))
    return f"{''.join(parts)}, bw AS ({union})"


@facts_query(f"{_levels_sql(4)} SELECT bw.*, {_names()} FROM bw JOIN sym_c s ON s.symbol_key = bw.symbol_key")
def rec_callee_bfs(f: Facts) -> DataFrame:
    return graph.callee_walk(f, f.busiest_caller(), 4)


# -- guidance on tests --------------------------------------------------------------------------------


def _near_sql(name: str, keys: str, per: int, base: int, covers: str) -> str:
    return f"""SELECT test_key, file_path, line, name, {base + 60} + {_CONF} * 18 + {_LINK} * 6 AS score, '{name}' AS relation, 'covers {covers} ' || CASE WHEN near = '' THEN 'nearby symbol' ELSE near END || ' via ' || {_TEST_WHY} AS why FROM (
      SELECT t.test_key, t.file_path, t.line, t.name, l.link_kind, l.confidence, n.near, row_number() OVER (PARTITION BY n.key ORDER BY 240 + {_CONF} * 20 + {_LINK} * 6 DESC, t.file_path, t.line, t.name, t.test_key, l.link_kind) AS nth
      FROM ({keys}) n JOIN tl_c l ON l.symbol_key = n.key JOIN ts_c t ON t.test_key = l.test_key) WHERE nth <= {per}"""


def _first_sql(own: str, other: str) -> str:
    return f"SELECT DISTINCT key, near FROM (SELECT c.{own} AS key, s.name AS near FROM ce_c c JOIN sym_c s ON s.symbol_key = c.{own} WHERE c.{other} = (SELECT k FROM anchor) ORDER BY s.qname, c.file_path, c.line, c.col, c.{own} LIMIT 3)"


_STEM = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]*$', '')"
_FAMILY = f"({_STEM.format('(SELECT file_path FROM me)')} <> '' AND {_STEM.format('(SELECT file_path FROM me)')} = regexp_replace({_STEM.format('file_path')}, '_test$', ''))"
_AFFINITY = "(name <> '' AND contains(regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g'), regexp_replace(lower(trim((SELECT name FROM me))), '[^a-z0-9]', '', 'g')))"
_GUIDE = f"""{_LISTS}, g AS (
  SELECT t.test_key, t.file_path, t.line, t.name, 560 + {_CONF} * 20 + {_LINK} * 6 AS score, 'direct' AS relation, {_TEST_WHY} AS why FROM tl_c l JOIN ts_c t ON t.test_key = l.test_key WHERE l.symbol_key = (SELECT k FROM anchor)
  UNION ALL {_near_sql('caller', _first_sql('caller_symbol_key', 'callee_symbol_key'), 3, 230, 'caller')}
  UNION ALL {_near_sql('callee', _first_sql('callee_symbol_key', 'caller_symbol_key'), 2, 210, 'callee')}
  UNION ALL {_near_sql('sibling', "SELECT DISTINCT symbol_key AS key, name AS near FROM (SELECT * FROM l_sibling ORDER BY file_path, line, symbol_key LIMIT 3)", 2, 180, 'nearby')}
  UNION ALL SELECT test_key, file_path, line, name, 90 + n * 10 + CASE WHEN {_FAMILY} THEN 60 ELSE 0 END + CASE WHEN {_AFFINITY} THEN 50 ELSE 0 END, 'package', 'same package fallback' || CASE WHEN {_FAMILY} THEN ', same file family' ELSE '' END || CASE WHEN {_AFFINITY} THEN ', name affinity' ELSE '' END
  FROM (SELECT t.test_key, t.file_path, t.line, t.name, count(DISTINCT l.symbol_key) AS n FROM ts_c t LEFT JOIN tl_c l ON l.test_key = t.test_key WHERE t.package_import_path = (SELECT package_import_path FROM me) GROUP BY ALL ORDER BY n DESC, t.file_path, t.line, t.name, t.test_key LIMIT 10)),
gd AS (SELECT test_key, min(file_path) AS file_path, min(line) AS line, min(name) AS name, max(score) AS score, arg_min(relation, (-score, relation, why)) AS relation, list_reduce(list_prepend('', list(why ORDER BY score DESC, relation, why)),
    lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' OR contains(a, b) THEN a WHEN contains(b, a) THEN b ELSE a || '; ' || b END) AS why FROM (SELECT DISTINCT * FROM g) GROUP BY 1),
guide AS (SELECT * FROM gd ORDER BY score DESC, file_path, line, name, test_key LIMIT 8)"""


@facts_query(f"{_GUIDE} SELECT * FROM guide", settle=True)
def top_tests_guidance(f: Facts) -> DataFrame:
    return graph.test_guidance(f, f.busiest_symbol())


@facts_query(
    f"""{_GUIDE}, n AS (SELECT (SELECT count(*) FROM l_test) AS direct, (SELECT count(*) FROM tl_c JOIN ts_c USING (test_key) WHERE symbol_key = (SELECT k FROM anchor) AND {_CONF} >= 2) AS strong, (SELECT count(*) FROM guide WHERE relation <> 'direct') AS nearby,
      (SELECT count(*) FROM l_caller) + (SELECT count(*) FROM l_ref_in) + (SELECT count(*) FROM l_test) + (SELECT count(*) FROM l_used) AS total)
    SELECT direct, strong, nearby, CASE WHEN strong > 0 THEN printf('direct=%d strong', strong) || CASE WHEN nearby > 0 THEN printf(' | nearby=%d', nearby) ELSE '' END WHEN direct > 0 THEN printf('direct=%d weak', direct) || CASE WHEN nearby > 0 THEN printf(' | nearby=%d', nearby) ELSE '' END
      WHEN nearby > 0 THEN printf('nearby-only=%d', nearby) WHEN total < 5 THEN 'light coverage posture' ELSE 'thin coverage' END AS signal, CASE WHEN strong = 0 AND nearby = 0 AND total >= 5 THEN 'important symbol without good nearby tests' ELSE '' END AS warning FROM n""",
    settle=True,
)
def lb_test_signal(f: Facts) -> DataFrame:
    return graph.test_signal(f, f.busiest_symbol())


# -- names -------------------------------------------------------------------------------------------------

_NORM = "regexp_replace(lower(trim({0})), '[^a-z0-9]', '', 'g')"


@facts_query(
    f"""SELECT l.test_key, l.symbol_key, bool_or({_STEM.format('s.file_path')} <> '' AND {_STEM.format('s.file_path')} = regexp_replace({_STEM.format('t.file_path')}, '_test$', '')) AS same_family, bool_or(t.name <> '' AND contains({_NORM.format('t.name')}, {_NORM.format('s.name')})) AS affinity
    FROM tl_c l JOIN sym_c s ON s.symbol_key = l.symbol_key JOIN ts_c t ON t.test_key = l.test_key GROUP BY 1, 2"""
)
def fn_name_affinity(f: Facts) -> DataFrame:
    """Of every linked test and symbol: whether their files are of one family, and whether the test's name holds the symbol's."""
    symbols = f.at("symbols").select("symbol_key", F.col("file_path").alias("_file"), F.col("name").alias("_name"))
    rows = f.at("test_links").select("test_key", "symbol_key").distinct().join(symbols, "symbol_key").join(f.at("tests"), "test_key")
    return rows.select("test_key", "symbol_key", T.same_family("_file", "file_path").alias("same_family"), T.name_affinity("_name", "name").alias("affinity"))


_SHOWN = """CASE WHEN kind = 'method' AND prefix(signature, 'func(') AND receiver <> '' THEN 'func (' || receiver || ') ' || name || substring(signature, 5) WHEN kind IN ('func', 'method') AND prefix(signature, 'func(') THEN 'func ' || name || substring(signature, 5)
  WHEN kind IN ('struct', 'interface', 'type', 'alias', 'class') AND signature <> '' AND signature <> name THEN CASE WHEN prefix(signature, 'type ') THEN signature ELSE 'type ' || name || ' ' || signature END
  WHEN kind IN ('struct', 'interface', 'type', 'alias', 'class') AND name <> '' THEN 'type ' || name WHEN signature <> '' THEN signature ELSE name END"""


@facts_query(f"SELECT symbol_key, {_SHOWN} AS shown FROM sym_c")
def fn_display_signature(f: Facts) -> DataFrame:
    return f.at("symbols").select("symbol_key", T.display_signature().alias("shown"))


@facts_query("SELECT symbol_key, CASE WHEN qname = '' THEN name WHEN name = '' OR contains(qname, name) THEN qname WHEN contains(name, qname) THEN name ELSE qname || '; ' || name END AS merged FROM sym_c")
def fn_merge_why(f: Facts) -> DataFrame:
    return f.at("symbols").select("symbol_key", T.merged_why(F.col("qname"), F.col("name")).alias("merged"))


# -- ranked text --------------------------------------------------------------------------------------------------


@facts_query(
    f"""{_PM}{_FS.removeprefix(_PM)}{_lines_sql(f"contains(lower(text), '{TEXT_QUERY}')", f"instr(lower(text), '{TEXT_QUERY}') - 1").replace('SELECT project, rel_path, line, octet_length', ', hits AS (SELECT DISTINCT project, rel_path, line, octet_length').replace(' FROM li WHERE', ' FROM li WHERE')}),
    m AS (SELECT h.project || '/' || h.rel_path AS rel_path, max(coalesce(p.pkg, '')) AS pkg, h.line, h.col FROM hits h JOIN (SELECT project, rel_path, max(package_import_path) AS pkg FROM scan_files GROUP BY 1, 2) p USING (project, rel_path) GROUP BY 1, 3, 4),
    pf AS (SELECT m.rel_path, count(*) AS n, coalesce(max(fs.package_import_path), max(m.pkg), '') AS package_import_path, coalesce(max(fs.relevant_symbols), 0) AS rs, coalesce(max(fs.linked_symbols), 0) AS ls, coalesce(max(fs.related_tests), 0) AS rt, coalesce(max(fs.reverse_package_deps), 0) AS rd, coalesce(max(pm.importance), 0) AS imp
      FROM m LEFT JOIN fs ON fs.rel_path = m.rel_path LEFT JOIN pm ON pm.import_path = fs.package_import_path GROUP BY 1),
    sc AS (SELECT *, n * 100 + rs * 6 + ls * 8 + rt * 4 + rd * 10 + imp * 2 AS file_score FROM pf),
    ps AS (SELECT package_import_path, (sum(n) * 60 + max(imp) * 3 + max(rd) * 10 + sum(file_score // 4))::BIGINT AS package_score FROM sc GROUP BY 1)
    SELECT row_number() OVER (ORDER BY package_score DESC, package_import_path, file_score DESC, rel_path, line, col) AS rank, package_import_path, rel_path, line, col, file_score, package_score FROM m JOIN sc USING (rel_path) JOIN ps USING (package_import_path)
    ORDER BY rank LIMIT 40""",
    settle=True,
)
def sr_rank(f: Facts) -> DataFrame:
    keys = ["project", "rel_path", "package_import_path"]
    found = search.text_lines(f.raw("scan_files"), keys, TEXT_QUERY).select(*keys, "line", "col").distinct()  # copies of a file give the same lines
    found = found.select(F.concat_ws("/", "project", "rel_path").alias("rel_path"), "package_import_path", "line", "col")
    files = metrics.file_summaries(f).join(metrics.package_metrics(f).select(F.col("import_path").alias("package_import_path"), "importance"), "package_import_path", "left")
    return search.ranked_text(found, files.select("rel_path", "package_import_path", "relevant_symbols", "linked_symbols", "related_tests", "reverse_package_deps", "importance"), 40)
