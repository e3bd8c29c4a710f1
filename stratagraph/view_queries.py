"""Registered queries over differences, histories, co-change and the composite views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .facts import Facts
from .graph_queries import _CONF, _FO, _FS_ONLY, _LINK, _PM_ALL, _RANKED, _SF_ONLY, _TOUCHED_ONLY, _boost, _entry, _walk_sql, facts_query
from .operators import delta, history, views
from .operators.history import COUNTERS, WHY, Diffs
from .operators.rank import FUNCTION_WEIGHTS, TYPE_WEIGHTS
from .operators.views import CALL_WHY, LINK_WHY, REF_WHY

# -- differences of all pairs, in SQL -------------------------------------------------


def _sides(table: str) -> str:
    return f"""{table}_n AS (SELECT t.* FROM {table} t JOIN pairs p ON t.snapshot_id = p.id),
{table}_o AS (SELECT t.* REPLACE (p.id AS snapshot_id) FROM {table} t JOIN pairs p ON t.snapshot_id = p.prev_id)"""


def _edges(table: str, key: list[str], rest: str = "") -> str:
    on = f"snapshot_id, {', '.join(key)}"
    return f"SELECT {on}{rest}, 'added' AS change FROM {table}_n ANTI JOIN {table}_o USING ({on}) UNION ALL SELECT {on}{rest}, 'removed' FROM {table}_o ANTI JOIN {table}_n USING ({on})"


def _labelled(name: str, raw: str, labels: dict[str, tuple[str, str]]) -> str:
    """Adds to the rows of ``raw`` the qname of each key in the snapshot that holds the row."""
    columns = ", ".join(f"coalesce(CASE r.change WHEN 'added' THEN {out}n.qname ELSE {out}o.qname END, {absent}) AS {out}" for out, (_, absent) in labels.items())
    joins = " ".join(f"LEFT JOIN sym_n {out}n ON {out}n.snapshot_id = r.snapshot_id AND {out}n.symbol_key = r.{key} LEFT JOIN sym_o {out}o ON {out}o.snapshot_id = r.snapshot_id AND {out}o.symbol_key = r.{key}" for out, (key, _) in labels.items())
    return f"{name} AS (SELECT r.*, {columns} FROM ({raw}) r {joins})"


_D_SYMBOLS = f""", {_sides('sym')}, d_sym AS (
  SELECT n.snapshot_id, n.qname, 'added' AS change, NULL AS from_pkg, n.package_import_path AS to_pkg, NULL AS from_file, n.file_path AS to_file, NULL AS from_line, n.line AS to_line, false AS contract, false AS moved
  FROM sym_n n LEFT JOIN sym_o o ON o.snapshot_id = n.snapshot_id AND o.qname = n.qname WHERE o.qname IS NULL
  UNION ALL SELECT o.snapshot_id, o.qname, 'removed', o.package_import_path, NULL, o.file_path, NULL, o.line, NULL, false, false
  FROM sym_o o LEFT JOIN sym_n n ON o.snapshot_id = n.snapshot_id AND o.qname = n.qname WHERE n.qname IS NULL
  UNION ALL SELECT o.snapshot_id, o.qname, 'changed', o.package_import_path, n.package_import_path, o.file_path, n.file_path, o.line, n.line, o.signature <> n.signature, o.file_path <> n.file_path OR o.line <> n.line
  FROM sym_o o JOIN sym_n n ON o.snapshot_id = n.snapshot_id AND o.qname = n.qname WHERE o.signature <> n.signature OR o.file_path <> n.file_path OR o.line <> n.line)"""
_D_EDGES = f"""{_D_SYMBOLS}, {_sides('ce')}, {_sides('rf')}, {_sides('tl')},
{_labelled('d_call', _edges('ce', delta.CALL_KEY, ', dispatch'), {'caller_q': ('caller_symbol_key', 'r.caller_symbol_key'), 'callee_q': ('callee_symbol_key', 'r.callee_symbol_key')})},
{_labelled('d_ref', _edges('rf', delta.REF_KEY), {'from_q': ('from_symbol_key', "''"), 'to_q': ('to_symbol_key', 'r.to_symbol_key')})},
{_labelled('d_link', _edges('tl', delta.LINK_KEY), {'symbol_q': ('symbol_key', 'r.symbol_key')})}"""
_D_FILES = f""", {_sides('fl')}, d_file AS (
  SELECT n.snapshot_id, n.rel_path, coalesce(n.package_import_path, '') AS pkg, CASE WHEN o.rel_path IS NULL THEN 'added' ELSE 'changed' END AS change FROM fl_n n LEFT JOIN fl_o o ON o.snapshot_id = n.snapshot_id AND o.rel_path = n.rel_path
  WHERE o.rel_path IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash
  UNION ALL SELECT o.snapshot_id, o.rel_path, coalesce(o.package_import_path, ''), 'deleted' FROM fl_o o LEFT JOIN fl_n n ON o.snapshot_id = n.snapshot_id AND o.rel_path = n.rel_path WHERE n.rel_path IS NULL)"""
_D_PACKAGES = f"""{_PM_ALL}, {_sides('pma')}, d_pkg AS (
  SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.import_path, o.import_path) AS import_path, CASE WHEN o.import_path IS NULL THEN 'added' WHEN n.import_path IS NULL THEN 'removed' ELSE 'changed' END AS status,
    {', '.join(f'coalesce(n.{c}, 0) - coalesce(o.{c}, 0) AS d_{c}' for c in delta.PACKAGE_COUNTS)}
  FROM pma_n n FULL JOIN pma_o o ON n.snapshot_id = o.snapshot_id AND n.import_path = o.import_path
  WHERE n.import_path IS NULL OR o.import_path IS NULL OR {' OR '.join(f'n.{c} <> o.{c}' for c in delta.PACKAGE_COUNTS)}),
pdl AS (SELECT snapshot_id, from_package_import_path, to_package_import_path, bool_or(is_local) AS is_local FROM pd GROUP BY ALL), {_sides('pdl')},
d_dep AS (SELECT * FROM ({_edges('pdl', history.DEP_KEY, ', is_local')}) WHERE is_local)"""
_END = "SELECT snapshot_id, trim({q}) AS qname, change || '_{c}' AS event, {both} AS self_edge, {file} AS file, {pkg} AS pkg, {stage} + CASE change WHEN 'removed' THEN 1 ELSE 0 END AS stage, {o} AS o0, {p} AS o1 FROM {t}"
_EV = f"""{_D_EDGES}, ev AS (SELECT * FROM (
  {_END.format(q='caller_q', c='callees', both='false', file='trim(file_path)', pkg="''", stage=4, o='caller_q', p='callee_q', t='d_call')}
  UNION ALL {_END.format(q='callee_q', c='callers', both='caller_q = callee_q', file='trim(file_path)', pkg="''", stage=4, o='caller_q', p='callee_q', t='d_call')}
  UNION ALL {_END.format(q='to_q', c='refs_in', both='false', file='trim(file_path)', pkg="''", stage=6, o='to_q', p='from_q', t='d_ref')}
  UNION ALL {_END.format(q='from_q', c='refs_out', both='to_q = from_q', file='trim(file_path)', pkg='trim(from_package_import_path)', stage=6, o='to_q', p='from_q', t='d_ref')}
  UNION ALL {_END.format(q='symbol_q', c='tests', both='false', file="''", pkg="''", stage=8, o='symbol_q', p='test_key', t='d_link')}) WHERE qname <> ''),
se AS (SELECT snapshot_id, trim(qname) AS qname, unnest(list_filter(['status_' || change, CASE WHEN contract THEN 'contract' END, CASE WHEN moved THEN 'moved' END], lambda x: x IS NOT NULL)) AS event,
  trim(coalesce(to_file, from_file)) AS file, trim(coalesce(to_pkg, from_pkg)) AS pkg, CASE change WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS stage FROM d_sym)"""
_SAID = [("bool_or(event = 'status_added')", WHY["added"]), ("bool_or(event = 'status_removed')", WHY["removed"]), ("bool_or(event = 'contract')", WHY["contract"]), ("bool_or(event = 'moved')", WHY["moved"])]
_SAID += [(f"count(*) FILTER (event = '{c}') > 0", WHY[c]) for c in COUNTERS]
_IMPACT_ONLY = f""", im0 AS (SELECT snapshot_id, qname, {', '.join(f"count(*) FILTER (event = '{c}') AS {c}" for c in COUNTERS)},
    CASE WHEN bool_or(event = 'status_removed') THEN 'removed' WHEN bool_or(event = 'status_added') THEN 'added' WHEN bool_or(event = 'status_changed') THEN 'changed' ELSE '' END AS status,
    bool_or(event = 'contract') AS contract_changed, bool_or(event = 'moved') AS moved,
    coalesce(first(pkg ORDER BY stage, o0 NULLS FIRST, o1 NULLS FIRST, file) FILTER (pkg <> ''), '') AS package_import_path, coalesce(first(file ORDER BY stage, o0 NULLS FIRST, o1 NULLS FIRST, file) FILTER (file <> ''), '') AS file_path,
    array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {on} THEN '{text}' END" for on, text in _SAID)}], lambda x: x IS NOT NULL)), '; ') AS why
  FROM (SELECT snapshot_id, qname, event, file, pkg, stage, o0, o1 FROM ev UNION ALL SELECT snapshot_id, qname, event, file, pkg, stage, NULL, NULL FROM se) WHERE qname <> '' GROUP BY ALL),
imp AS (SELECT *, {' + '.join(COUNTERS)} AS blast_radius, {' + '.join(COUNTERS)} + CASE status WHEN 'added' THEN 12 WHEN 'removed' THEN 12 WHEN 'changed' THEN 8 ELSE 0 END + CASE WHEN contract_changed THEN 8 ELSE 0 END + CASE WHEN moved THEN 4 ELSE 0 END AS delta_score FROM im0)"""
_IMPACT = f"{_EV}{_IMPACT_ONLY}"
_FLAT = "regexp_replace(regexp_replace(event, '_(callers|callees)$', '_calls'), '_refs_(in|out)$', '_refs')"
_EVENT_COUNTS = [f"{change}_{c}" for c in ("calls", "refs", "tests") for change in ("added", "removed")]
_SYMBOL_EVENTS = f"""{_EV}, sev AS (SELECT snapshot_id, qname, CASE WHEN bool_or(event = 'status_removed') THEN 'removed' WHEN bool_or(event = 'status_added') THEN 'introduced' ELSE 'changed' END AS status,
    bool_or(event = 'contract') AS contract_changed, bool_or(event = 'moved') AS moved, {', '.join(f"count(*) FILTER (event = '{c}') AS {c}" for c in _EVENT_COUNTS)}
  FROM (SELECT snapshot_id, qname, {_FLAT} AS event FROM ev WHERE NOT self_edge UNION ALL SELECT snapshot_id, qname, event FROM se) GROUP BY 1, 2)"""
_PACKAGE_NUMBERS = ["file_delta", "symbol_delta", "test_delta", "added_deps", "removed_deps", "moved_symbols", "changed_contracts"]
_PACKAGE_EVENTS = f"""{_D_SYMBOLS}{_D_PACKAGES}, pev AS (
  SELECT snapshot_id, import_path, coalesce(max(status), 'changed') AS status, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in _PACKAGE_NUMBERS)} FROM (
    SELECT snapshot_id, import_path, status, d_file_count AS file_delta, d_symbol_count AS symbol_delta, d_test_count AS test_delta, 0 AS added_deps, 0 AS removed_deps, 0 AS moved_symbols, 0 AS changed_contracts FROM d_pkg
    UNION ALL SELECT snapshot_id, unnest(list_distinct([from_pkg, to_pkg])), NULL, 0, 0, 0, 0, 0, moved::INT, contract::INT FROM d_sym WHERE change = 'changed'
    UNION ALL SELECT snapshot_id, unnest(list_distinct([from_package_import_path, to_package_import_path])), NULL, 0, 0, 0, (change = 'added')::INT, (change = 'removed')::INT, 0, 0 FROM d_dep)
  WHERE import_path <> '' GROUP BY 1, 2)"""
_TP_ONLY = """, tp0 AS (
  SELECT snapshot_id, import_path, false AS by_file FROM d_pkg UNION ALL SELECT snapshot_id, unnest([from_pkg, to_pkg]), false FROM d_sym
  UNION ALL SELECT snapshot_id, unnest([from_package_import_path, to_package_import_path]), false FROM d_dep UNION ALL SELECT snapshot_id, pkg, true FROM d_file),
tpk AS (SELECT snapshot_id, import_path, bool_and(by_file) AS by_file FROM tp0 WHERE import_path <> '' GROUP BY 1, 2)"""
_TOUCHED_PACKAGES = f"{_D_SYMBOLS}{_D_PACKAGES}{_D_FILES}{_TP_ONLY}"

# -- differences ------------------------------------------------------------------------


@facts_query(f"{_D_SYMBOLS} SELECT snapshot_id, count(*) AS changed_symbols FROM (SELECT snapshot_id, qname FROM d_sym WHERE change <> 'removed' UNION SELECT snapshot_id, qname FROM d_sym WHERE change = 'removed') GROUP BY 1")
def agg_changed_symbols(f: Facts) -> DataFrame:
    return history.changed_symbol_counts(f)


_IMPACT_COLUMNS = ["qname", "package_import_path", "file_path", "status", "contract_changed", "moved", *COUNTERS, "blast_radius", "delta_score", "why"]


@facts_query(f"{_IMPACT} SELECT {', '.join(_IMPACT_COLUMNS)} FROM imp WHERE snapshot_id = (SELECT id FROM cur)", settle=True)
def agg_impacted_symbols(f: Facts) -> DataFrame:
    return Diffs(f, (f.previous, f.current)).impacted.select(*_IMPACT_COLUMNS)


@facts_query(f"{_IMPACT} SELECT qname, status, blast_radius, delta_score FROM imp WHERE snapshot_id = (SELECT id FROM cur) ORDER BY delta_score DESC, qname LIMIT 20", settle=True)
def top_impacted(f: Facts) -> DataFrame:
    rows = Diffs(f, (f.previous, f.current)).impacted
    return rows.select("qname", "status", "blast_radius", "delta_score").orderBy(F.desc("delta_score"), "qname").limit(20)


@facts_query(f"{_TOUCHED_PACKAGES} SELECT snapshot_id, import_path AS label FROM tpk")
def set_diff_packages(f: Facts) -> DataFrame:
    return Diffs(f).touched_packages.select("snapshot_id", F.col("import_path").alias("label"))


@facts_query(f"{_TOUCHED_PACKAGES} SELECT snapshot_id FROM tpk WHERE import_path = (SELECT p FROM anchor_pkg) AND NOT by_file")
def flt_package_affected(f: Facts) -> DataFrame:
    return Diffs(f).touched_packages.where((F.col("import_path") == f.largest_package()) & ~F.col("by_file")).select("snapshot_id")


# -- histories ------------------------------------------------------------------------------


@facts_query(f"{_SYMBOL_EVENTS} SELECT * FROM sev")
def agg_symbol_event(f: Facts) -> DataFrame:
    return Diffs(f).symbol_events


@facts_query(f"{_PACKAGE_EVENTS} SELECT * FROM pev")
def agg_package_event(f: Facts) -> DataFrame:
    return Diffs(f).package_events


_ANCHOR_Q = "(SELECT trim(qname) FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))"
_RAW_Q = "(SELECT qname FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))"


@facts_query(
    f"""{_SYMBOL_EVENTS}, mine AS (SELECT * FROM sev WHERE qname = {_ANCHOR_Q})
    SELECT snapshot_id, prev_id AS from_id, status, contract_changed, moved, {', '.join(_EVENT_COUNTS)} FROM mine JOIN pairs ON pairs.id = mine.snapshot_id
    UNION ALL SELECT min(snapshot_id), 0, 'introduced', false, false, 0, 0, 0, 0, 0, 0 FROM sym WHERE qname = {_RAW_Q} AND NOT EXISTS (SELECT 1 FROM mine WHERE status = 'introduced') HAVING min(snapshot_id) IS NOT NULL
    ORDER BY 1 DESC, 3 LIMIT 10"""
)
def vw_symbol_history(f: Facts) -> DataFrame:
    return history.symbol_history(f, f.busiest_symbol())


@facts_query(
    f"""{_PACKAGE_EVENTS}, mine AS (SELECT * FROM pev WHERE import_path = (SELECT p FROM anchor_pkg))
    SELECT snapshot_id, prev_id AS from_id, status, {', '.join(_PACKAGE_NUMBERS)} FROM mine JOIN pairs ON pairs.id = mine.snapshot_id
    UNION ALL SELECT min(snapshot_id), 0, 'introduced', 0, 0, 0, 0, 0, 0, 0 FROM pk WHERE import_path = (SELECT p FROM anchor_pkg) AND NOT EXISTS (SELECT 1 FROM mine WHERE status = 'introduced') HAVING min(snapshot_id) IS NOT NULL
    ORDER BY 1 DESC, 3 LIMIT 10"""
)
def vw_package_history(f: Facts) -> DataFrame:
    return history.package_history(f, f.largest_package())


# -- co-change ----------------------------------------------------------------------------------

_PLACES = f"SELECT snapshot_id, unnest([from_{{0}}, to_{{0}}]) AS label FROM d_sym WHERE qname = {_RAW_Q}"
_CURRENT = "(SELECT {0} FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))"


def _counts_sql(rows: str) -> str:
    return f"SELECT label, count(*) AS change_count, round(count(*) * 1.0 / (SELECT count(*) FROM hits), 6) AS frequency FROM (SELECT DISTINCT snapshot_id, label FROM ({rows}) WHERE label <> '' AND snapshot_id IN (SELECT snapshot_id FROM hits)) GROUP BY 1"


_CO_EVENTS = f"{_SYMBOL_EVENTS}{_D_PACKAGES}{_D_FILES}{_TP_ONLY}, hits AS (SELECT DISTINCT snapshot_id FROM sev WHERE qname = {_ANCHOR_Q})"
_CO_SYMBOL = f"""{_CO_EVENTS},
co_file AS ({_counts_sql(f"SELECT snapshot_id, rel_path AS label FROM d_file WHERE rel_path <> {_CURRENT.format('file_path')} EXCEPT {_PLACES.format('file')}")}),
co_pkg AS ({_counts_sql(f"SELECT snapshot_id, import_path AS label FROM tpk WHERE import_path <> {_CURRENT.format('package_import_path')} EXCEPT {_PLACES.format('pkg')}")})"""
_CO_PACKAGE = f"""{_TOUCHED_PACKAGES}, hits AS (SELECT snapshot_id FROM tpk WHERE import_path = (SELECT p FROM anchor_pkg) AND NOT by_file),
co_file AS ({_counts_sql("SELECT snapshot_id, rel_path AS label FROM d_file WHERE pkg <> (SELECT p FROM anchor_pkg)")}),
co_pkg AS ({_counts_sql("SELECT snapshot_id, import_path AS label FROM tpk WHERE import_path <> (SELECT p FROM anchor_pkg)")})"""


@facts_query(f"{_CO_PACKAGE} SELECT * FROM co_pkg")
def agg_cochange_package(f: Facts) -> DataFrame:
    return history.package_cochange(f, f.largest_package())[1]


@facts_query(f"{_CO_SYMBOL} SELECT * FROM co_file")
def agg_cochange_symbol(f: Facts) -> DataFrame:
    return history.symbol_cochange(f, f.busiest_symbol())[0]


@facts_query(f"{_CO_SYMBOL} SELECT * FROM co_file ORDER BY change_count DESC, label LIMIT 8")
def top_cochange(f: Facts) -> DataFrame:
    return history.top(history.symbol_cochange(f, f.busiest_symbol())[0])


def _both(f: Facts, files: DataFrame, packages: DataFrame, hits: DataFrame) -> DataFrame:
    parts = [history.top(rows).withColumn("section", F.lit(name)) for name, rows in (("file", files), ("package", packages))]
    anchor = hits.agg(F.count(F.lit(1)).alias("change_count")).select(F.lit("").alias("label"), "change_count", F.lit(1.0).alias("frequency"), F.lit("anchor").alias("section"))
    return parts[0].unionByName(parts[1]).unionByName(anchor).select("section", "label", "change_count", "frequency")


_CO_VIEW = """SELECT 'file' AS section, label, change_count, frequency FROM (SELECT * FROM co_file ORDER BY change_count DESC, label LIMIT 8)
  UNION ALL SELECT 'package', label, change_count, frequency FROM (SELECT * FROM co_pkg ORDER BY change_count DESC, label LIMIT 8) UNION ALL SELECT 'anchor', '', (SELECT count(*) FROM hits), 1.0"""


@facts_query(f"{_CO_SYMBOL} {_CO_VIEW}")
def vw_symbol_cochange(f: Facts) -> DataFrame:
    return _both(f, *history.symbol_cochange(f, f.busiest_symbol()))


@facts_query(f"{_CO_PACKAGE} {_CO_VIEW}")
def vw_package_cochange(f: Facts) -> DataFrame:
    return _both(f, *history.package_cochange(f, f.largest_package()))


@facts_query(f"{_D_SYMBOLS} SELECT DISTINCT snapshot_id, unnest([from_file, to_file]) AS file_path, unnest([from_pkg, to_pkg]) AS package_import_path FROM d_sym WHERE qname = {_RAW_Q}")
def flt_anchor_footprint(f: Facts) -> DataFrame:
    """The places of the symbol that its changes touch, besides the current one."""
    qname = f.at("symbols").where(F.col("symbol_key") == f.busiest_symbol()).select("qname").first()[0]
    sides = F.explode(F.array(*[F.struct(F.col(f"{s}_file_path").alias("file_path"), F.col(f"{s}_package_import_path").alias("package_import_path")) for s in ("from", "to")]))
    return Diffs(f).symbols.where(F.col("qname") == qname).select("snapshot_id", sides.alias("x")).select("snapshot_id", "x.*").distinct()


# -- views -------------------------------------------------------------------------------------


def _case(column: str, texts: dict[str, str], rest: str) -> str:
    return f"CASE coalesce({column}, '') {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in texts.items())}ELSE {column} || ' {rest}' END"


_CALL_WHY = _case("dispatch", CALL_WHY, "call edge from indexed call site")
_REF_WHY = _case("kind", REF_WHY, "reference in indexed source")
_LINK_LABEL = f"CASE link_kind {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in LINK_WHY.items())}ELSE 'direct test link' END"
_TEST_WHY = f"{_LINK_LABEL} || CASE WHEN coalesce(confidence, '') = '' THEN '' ELSE ' (' || confidence || ')' END"
_ME = ", me AS (SELECT * FROM sym_c WHERE symbol_key = (SELECT k FROM anchor))"
_LISTS = f"""{_ME},
l_caller AS (SELECT s.qname, s.package_import_path, c.file_path, c.line, c.col, {_CALL_WHY} AS why FROM ce_c c JOIN sym_c s ON s.symbol_key = c.caller_symbol_key WHERE c.callee_symbol_key = (SELECT k FROM anchor)),
l_callee AS (SELECT s.qname, c.file_path, c.line, c.col, {_CALL_WHY} AS why FROM ce_c c JOIN sym_c s ON s.symbol_key = c.callee_symbol_key WHERE c.caller_symbol_key = (SELECT k FROM anchor)),
l_ref_in AS (SELECT s.qname, s.package_import_path, r.file_path, r.line, r.col, {_REF_WHY.replace('(kind', '(r.kind').replace('ELSE kind', 'ELSE r.kind')} AS why FROM rf_c r JOIN sym_c s ON s.symbol_key = r.from_symbol_key WHERE r.to_symbol_key = (SELECT k FROM anchor) AND r.from_symbol_key <> ''),
l_ref_out AS (SELECT s.qname, r.file_path, r.line, r.col, {_REF_WHY.replace('(kind', '(r.kind').replace('ELSE kind', 'ELSE r.kind')} AS why FROM rf_c r JOIN sym_c s ON s.symbol_key = r.to_symbol_key WHERE r.from_symbol_key = (SELECT k FROM anchor)),
l_test AS (SELECT t.name, t.file_path, t.line, 240 + {_CONF} * 20 + {_LINK} * 6 AS score, {_TEST_WHY} AS why FROM tl_c l JOIN ts_c t ON t.test_key = l.test_key WHERE l.symbol_key = (SELECT k FROM anchor)),
l_sibling AS (SELECT s.* FROM sym_c s, me WHERE s.package_import_path = me.package_import_path AND s.symbol_key <> me.symbol_key AND (s.file_path = me.file_path OR s.receiver = me.receiver) ORDER BY s.file_path, s.line, s.symbol_key LIMIT 8),
l_used AS (SELECT DISTINCT from_package_import_path AS p FROM pd_c WHERE is_local AND to_package_import_path = (SELECT package_import_path FROM me))"""


def _entry_why(path: str) -> str:
    p = f"('/' || {path})"
    return (
        f"CASE WHEN suffix({p}, '/__main__.py') THEN 'python entrypoint file' WHEN suffix({p}, '/main.go') OR suffix({p}, '/main.rs') THEN 'main entrypoint file' WHEN contains({p}, '/cmd/') THEN 'cmd entrypoint surface' WHEN contains({p}, '/bin/') THEN 'bin entrypoint surface'"
        f" WHEN contains({p}, '/cli/') THEN 'cli entrypoint surface' WHEN contains({p}, '/scripts/') THEN 'script entrypoint surface' WHEN contains({p}, '/examples/') OR contains({p}, '/example/') THEN 'example entrypoint surface' END"
    )


def _change_why(boost: str) -> str:
    return f"CASE {boost} WHEN 8 THEN 'recently changed file' WHEN 5 THEN 'near recent changes in same package' WHEN 3 THEN 'near recent changes in same directory' END"


def _count_why(pairs: list[tuple[str, str]]) -> list[str]:
    return [f"CASE WHEN {c} > 0 THEN {c} || ' {text}' END" for c, text in pairs]


def _reasons(parts: list[str]) -> str:
    return f"concat_ws('; ', {', '.join(parts)})"


_SYMBOL_COUNTS = [("caller_count", "callers"), ("reference_count", "inbound refs"), ("test_count", "direct tests"), ("reverse_package_deps", "reverse package deps"), ("method_count", "attached methods")]
_MAIN = "CASE WHEN lower(trim(name)) = 'main' AND kind = 'func' THEN 'main entrypoint symbol' END"
_SYMBOL_REASONS = _reasons([*_count_why(_SYMBOL_COUNTS), _entry_why("file_path"), _MAIN, _change_why(_boost("file_path", "package_import_path"))])
_QUALITY = f"""{_LISTS}{_FO}{_TOUCHED_ONLY}, q0 AS (SELECT me.*, (SELECT count(*) FROM l_caller) AS caller_count, (SELECT count(*) FROM l_callee) AS callee_count, (SELECT count(*) FROM l_ref_in) AS reference_count, (SELECT count(*) FROM l_test) AS test_count,
  (SELECT count(*) FROM l_used) AS reverse_package_deps, CASE WHEN kind IN ('func', 'method') THEN 0 ELSE (SELECT count(*) FROM l_sibling WHERE kind = 'method') END AS method_count FROM me),
q AS (SELECT qname, file_path, line, CASE WHEN kind IN ('func', 'method') THEN {' + '.join(f'{c} * {w}' for c, w in FUNCTION_WEIGHTS.items())} ELSE {' + '.join(f'{c} * {w}' for c, w in TYPE_WEIGHTS.items())} END
  + {_entry('file_path')} + CASE WHEN lower(trim(name)) = 'main' AND kind = 'func' THEN 2 ELSE 0 END + {_boost('file_path', 'package_import_path')} AS score, {_SYMBOL_REASONS} AS why FROM q0)"""


def _list_sql(section: str, table: str, label: str, file: str = "''", line: str = "0", value: str = "0", why: str = "''") -> str:
    return f"SELECT '{section}' AS section, {label} AS label, {file} AS file_path, ({line})::INT AS line, ({value})::BIGINT AS value, {why} AS why FROM {table}"


@facts_query(
    f"""{_QUALITY} {_list_sql('symbol', 'q', 'qname', 'file_path', 'line', 'score', 'why')}
    UNION ALL {_list_sql('package', 'pk_c WHERE import_path = (SELECT package_import_path FROM me)', 'import_path', line='(SELECT count(*) FROM ts_c WHERE package_import_path = (SELECT package_import_path FROM me))', value='(SELECT count(*) FROM sym_c WHERE package_import_path = (SELECT package_import_path FROM me))')}
    UNION ALL {_list_sql('depends_on', '(SELECT DISTINCT to_package_import_path AS p FROM pd_c WHERE is_local AND from_package_import_path = (SELECT package_import_path FROM me))', 'p')}
    UNION ALL {_list_sql('used_by', 'l_used', 'p')}
    UNION ALL {' UNION ALL '.join(_list_sql(s, f'l_{s}', 'qname', 'file_path', 'line', 'col', 'why') for s in ('caller', 'callee', 'ref_in', 'ref_out'))}
    UNION ALL {_list_sql('test', 'l_test', 'name', 'file_path', 'line', 'score', 'why')} UNION ALL {_list_sql('sibling', 'l_sibling', 'qname', 'file_path', 'line')}""",
    settle=True,
)
def vw_symbol(f: Facts) -> DataFrame:
    return views.symbol_view(f, f.busiest_symbol())


_AT = "CASE WHEN trim(file_path) <> '' AND line > 0 THEN ' @ ' || trim(file_path) || ':' || line ELSE '' END"


def _via(name: str) -> str:
    return f"why || CASE WHEN trim({name}) <> '' THEN ' via ' || trim({name}) ELSE '' END || {_AT}"


_FREQ = "printf('empirical co-change signal (count=%d freq=%.2f)', change_count, frequency)"


def _recent_sql(name: str, parts: str, rules: list[tuple[str, str, list[str] | None]]) -> str:
    extra = []
    for counter, surface, markers in rules:
        hit = " OR ".join(f"contains(said, '{m}')" for m in markers) if markers else "true"
        extra.append(f"CASE WHEN (SELECT a_{counter} + r_{counter} FROM rd) > 0 AND ({hit}) THEN printf('recent symbol delta changed {surface} (+%d/-%d)', (SELECT a_{counter} FROM rd), (SELECT r_{counter} FROM rd)) END")
    return f"""{name} AS (SELECT label, array_to_string(list_sort(list_distinct(list_concat(whys, list_filter([{', '.join(extra)}], lambda x: x IS NOT NULL)))), '; ') AS why
  FROM (SELECT label, list(DISTINCT why) AS whys, lower(string_agg(why, chr(10))) AS said FROM ({parts}) WHERE label <> '' AND why <> '' GROUP BY 1))"""


_CALLER_PARTS = f"SELECT package_import_path AS label, {_via('qname')} AS why FROM l_caller UNION SELECT package_import_path, 'transitive caller package in local call graph' FROM wn"
_REF_PARTS = f"SELECT package_import_path AS label, {_via('qname')} AS why FROM l_ref_in"
_IMPACT_VIEW = f"""{_CO_SYMBOL}, e_file AS (SELECT * FROM co_file ORDER BY change_count DESC, label LIMIT 5), e_pkg AS (SELECT * FROM co_pkg ORDER BY change_count DESC, label LIMIT 5)
{_walk_sql('callee_symbol_key', 'caller_symbol_key', 3)}{_LISTS}{_IMPACT_ONLY},
rdx AS (SELECT * FROM imp WHERE snapshot_id = (SELECT id FROM cur) AND qname = {_RAW_Q} AND (SELECT parent_id FROM snapshots WHERE id = (SELECT id FROM cur)) IS NOT NULL),
rd AS (SELECT {', '.join(f"coalesce(sum({s}_{c}), 0)::BIGINT AS {s[0]}_{c}" for s in ('added', 'removed') for c in ('callers', 'refs_in', 'tests'))} FROM rdx),
{_recent_sql('b_caller', _CALLER_PARTS, [('callers', 'caller surface', None)])},
{_recent_sql('b_ref', _REF_PARTS, [('refs_in', 'inbound reference surface', None)])},
{_recent_sql('b_pkg', f"{_CALLER_PARTS} UNION ALL {_REF_PARTS} UNION ALL SELECT p, 'reverse package dependency in local graph' FROM l_used UNION ALL SELECT label, {_FREQ} FROM e_pkg", [('callers', 'caller surface', ['call edge', 'caller package']), ('refs_in', 'inbound reference surface', ['reference'])])},
{_recent_sql('b_file', f"SELECT file_path AS label, {_via('qname')} AS why FROM l_caller UNION ALL SELECT file_path, {_via('qname')} FROM l_ref_in UNION ALL SELECT file_path, {_via('name')} FROM l_test UNION ALL SELECT label, {_FREQ} FROM e_file", [('callers', 'caller surface', ['call edge']), ('refs_in', 'inbound reference surface', ['reference']), ('tests', 'related test surface', ['test'])])},
ex AS (SELECT unnest(list_filter([
  CASE WHEN (SELECT count(*) FROM wn) > (SELECT count(*) FROM l_caller) THEN printf('transitive callers widen upstream impact beyond %d direct caller(s)', (SELECT count(*) FROM l_caller)) END,
  CASE WHEN (SELECT count(*) FROM l_used) > 0 THEN printf('reverse package dependencies widen package blast radius (%d package(s))', (SELECT count(*) FROM l_used)) END,
  CASE WHEN (SELECT count(*) FROM e_file) + (SELECT count(*) FROM e_pkg) > 0 THEN 'empirical co-change history widens impact beyond direct graph edges' END,
  CASE WHEN (SELECT count(*) FROM rdx WHERE contract_changed OR moved OR {' + '.join(f'{s}_{c}' for s in ('added', 'removed') for c in ('callers', 'refs_in', 'tests'))} > 0) > 0 THEN 'recent symbol delta biases impact toward recently changed caller/reference/test surface' END], lambda x: x IS NOT NULL)) AS why)"""


@facts_query(
    f"""{_IMPACT_VIEW} {_list_sql('caller', 'l_caller', 'qname', 'file_path', 'line', 'col', 'why')} UNION ALL {_list_sql('transitive', 'wn', 'qname', value='depth')} UNION ALL {_list_sql('ref_in', 'l_ref_in', 'qname', 'file_path', 'line', 'col', 'why')}
    UNION ALL {_list_sql('test', 'l_test', 'name', 'file_path', 'line', 'score', 'why')} UNION ALL {_list_sql('caller_package', 'b_caller', 'label', why='why')} UNION ALL {_list_sql('reference_package', 'b_ref', 'label', why='why')}
    UNION ALL {_list_sql('blast_package', 'b_pkg', 'label', why='why')} UNION ALL {_list_sql('blast_file', 'b_file', 'label', 'label', why='why')} UNION ALL {_list_sql('empirical_file', 'e_file', 'label', 'label', value='change_count', why=_FREQ)}
    UNION ALL {_list_sql('empirical_package', 'e_pkg', 'label', value='change_count', why=_FREQ)} UNION ALL {_list_sql('recent_delta', 'rdx', 'qname', 'file_path', value='delta_score', why='why')} UNION ALL {_list_sql('expansion', 'ex', 'why', why='why')}""",
    settle=True,
)
def vw_impact(f: Facts) -> DataFrame:
    return views.impact_view(f, f.busiest_symbol(), 3)


@facts_query(f"{_IMPACT_VIEW} SELECT * FROM b_pkg", settle=True)
def set_blast_packages(f: Facts) -> DataFrame:
    return views.Impact(f, f.busiest_symbol()).blast_packages()


@facts_query(f"{_IMPACT_VIEW} SELECT * FROM b_file", settle=True)
def set_blast_files(f: Facts) -> DataFrame:
    return views.Impact(f, f.busiest_symbol()).blast_files()


_PACKAGE_REASONS = _reasons([*_count_why([("reverse_deps", "reverse package deps"), ("symbol_count", "indexed symbols"), ("test_count", "related tests")]), "CASE WHEN import_path IN (SELECT import_path FROM foc) THEN 'recently changed package' END"])
_FILE_COUNTS = [("inbound_calls", "inbound calls"), ("inbound_refs", "inbound refs"), ("related_tests", "related tests"), ("reverse_package_deps", "reverse package deps"), ("relevant_symbols", "relevant symbols")]
_FILE_REASONS = _reasons([*_count_why(_FILE_COUNTS), _entry_why("rel_path"), _change_why("change_boost")])


@facts_query(
    f"""{_RANKED}{_FS_ONLY}{_SF_ONLY}, tpp AS (SELECT *, importance + CASE WHEN import_path IN (SELECT import_path FROM foc) THEN 5 ELSE 0 END AS score FROM (SELECT * FROM pm ORDER BY reverse_deps DESC, symbol_count DESC, test_count DESC, import_path LIMIT 32) ORDER BY score DESC, import_path LIMIT 8)
    {_list_sql('top_package', 'tpp', 'import_path', value='score', why=_PACKAGE_REASONS)} UNION ALL {_list_sql('top_function', 'tf', 'qname', 'file_path', 'line', 'score', _SYMBOL_REASONS)} UNION ALL {_list_sql('top_type', 'tt', 'qname', 'file_path', 'line', 'score', _SYMBOL_REASONS)}
    UNION ALL {_list_sql('top_file', '(SELECT * FROM sf ORDER BY quality_score DESC, rel_path LIMIT 8)', 'rel_path', 'rel_path', value='quality_score', why=_FILE_REASONS)}
    UNION ALL {' UNION ALL '.join(_list_sql('total', f'(SELECT count(*) AS n FROM {t})', f"'{name}'", value='n') for name, t in (('packages', 'pk_c'), ('files', 'fl_c'), ('symbols', 'sym_c'), ('refs', 'rf_c'), ('calls', 'ce_c'), ('tests', 'ts_c')))}""",
    settle=True,
)
def vw_report(f: Facts) -> DataFrame:
    return views.report_view(f, 8)


def _split(section: str, table: str, **columns: str) -> str:
    return " UNION ALL ".join(_list_sql(f"{change}_{section}", f"{table} WHERE snapshot_id = (SELECT id FROM cur) AND change = '{change}'", **columns) for change in ("added", "removed"))


@facts_query(
    f"""{_IMPACT}{_D_PACKAGES}{_D_FILES}
    {' UNION ALL '.join(_list_sql(f'{c}_file', f"d_file WHERE snapshot_id = (SELECT id FROM cur) AND change = '{c}'", 'rel_path', 'rel_path') for c in ('added', 'changed', 'deleted'))}
    UNION ALL {_split('symbol', 'd_sym', label='qname', file='coalesce(to_file, from_file)', line='coalesce(to_line, from_line)')}
    UNION ALL {_list_sql('changed_symbol', "d_sym WHERE snapshot_id = (SELECT id FROM cur) AND change = 'changed'", 'qname', "from_file || ' -> ' || to_file", 'to_line', 'from_line', "concat_ws(', ', CASE WHEN contract THEN 'contract' END, CASE WHEN moved THEN 'moved' END)")}
    UNION ALL {_list_sql('changed_package', 'd_pkg WHERE snapshot_id = (SELECT id FROM cur)', 'import_path', value='d_symbol_count', why='status')}
    UNION ALL {_split('call', 'd_call', label="caller_q || ' -> ' || callee_q", file='file_path', line='line', why='dispatch')} UNION ALL {_split('ref', 'd_ref', label="from_q || ' -> ' || to_q", file='file_path', line='line', why='kind')}
    UNION ALL {_split('test_link', 'd_link', label="test_key || ' -> ' || symbol_q", why="link_kind || '/' || confidence")} UNION ALL {_split('package_dep', 'd_dep', label="from_package_import_path || ' -> ' || to_package_import_path")}
    UNION ALL {_list_sql('impacted', 'imp WHERE snapshot_id = (SELECT id FROM cur)', 'qname', 'file_path', value='delta_score', why='why')}""",
    settle=True,
)
def vw_diff(f: Facts) -> DataFrame:
    return views.diff_view(f)
