"""The composite views of a symbol, its impact, the report and a diff, each as rows of one table.

Every view is a union of its lists with the columns section, label, file_path,
line, value and why; what ``label``, ``value`` and ``why`` hold is said in each
view.  Lists of one symbol's edges start from a filter on that symbol.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import Facts
from ..workspace import stage
from . import graph, history, rank
from .history import Diffs

COLUMNS = ["section", "label", "file_path", "line", "value", "why"]

# fixed values: what is said of an edge
CALL_WHY = {
    "static": "static call edge from indexed call site", "method": "method call edge from indexed call site", "dynamic": "dynamic call edge from indexed call site",
    "dynamic_import": "dynamic importlib call edge from indexed call site", "reexport": "re-exported call edge from indexed call site", "": "call edge from indexed call site",
}
REF_WHY = {
    "receiver": "receiver reference in indexed source", "type": "type reference in indexed source", "annotation": "annotation reference in indexed source", "annotation_type": "annotation type reference in indexed source",
    "type_checking": "TYPE_CHECKING reference in indexed source", "type_checking_type": "TYPE_CHECKING type reference in indexed source", "reexport": "re-export reference in indexed source",
    "reexport_type": "re-exported type reference in indexed source", "call": "call-site reference in indexed source", "use": "import or use reference in indexed source", "value": "value reference in indexed source", "": "reference in indexed source",
}
LINK_WHY = {"related": "related test link", "receiver_match": "direct receiver match", "name_match": "direct name match", "global_name_match": "direct global name match"}
FLOW_WHY = {
    "param_to_call": "parameter-to-call flow captured by the analyzer", "receiver_to_call": "receiver-to-call flow captured by the analyzer", "call_to_return": "returned call result captured by the analyzer",
    "param_to_return": "parameter-to-return flow captured by the analyzer", "receiver_to_return": "receiver-to-return flow captured by the analyzer", "receiver_to_state": "receiver state touch captured by the analyzer",
    "param_to_state": "parameter state touch captured by the analyzer", "": "flow edge captured by the analyzer",
}


def _said(column: str, texts: dict[str, str], rest: str) -> Column:
    """The text of a kind; an unknown kind stands before ``rest``."""
    kind = F.coalesce(F.col(column), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), kind), F.concat(kind, F.lit(" " + rest)))


def call_why() -> Column:
    return _said("dispatch", CALL_WHY, "call edge from indexed call site")


def ref_why() -> Column:
    return _said("ref_kind", REF_WHY, "reference in indexed source")


def flow_why() -> Column:
    return _said("kind", FLOW_WHY, "flow captured by the analyzer")


def link_why() -> Column:
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LINK_WHY.items() for x in pair]), F.col("link_kind")), F.lit("direct test link"))
    return F.when(F.coalesce("confidence", F.lit("")) == "", label).otherwise(F.concat(label, F.lit(" ("), "confidence", F.lit(")")))


def evidence(why: Column, via: str) -> Column:
    """A reason with who gives it and where: '... via name @ file:line'."""
    name, path = F.trim(via), F.trim("file_path")
    at = F.when((path != "") & (F.col("line") > 0), F.concat(F.lit(" @ "), path, F.lit(":"), F.col("line").cast("string"))).otherwise("")
    return F.concat(why, F.when(name != "", F.concat(F.lit(" via "), name)).otherwise(""), at)


def _rows(section: str, rows: DataFrame, label: str | Column, file: str | Column = "", line: str | int = 0, value: str | int | Column = 0, why: str | Column = "") -> DataFrame:
    def column(x: object, kind: str) -> Column:
        if isinstance(x, Column):
            return x.cast(kind)
        return F.col(x).cast(kind) if isinstance(x, str) and x else F.lit(x).cast(kind)

    return rows.select(
        F.lit(section).alias("section"), column(label, "string").alias("label"), column(file, "string").alias("file_path"),
        column(line, "int").alias("line"), column(value, "long").alias("value"), column(why, "string").alias("why"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


# -- one symbol ------------------------------------------------------------------------


def flows(f: Facts, symbol_key: str, sid: int | None = None) -> DataFrame:
    """Flow edges that a symbol owns, with the qnames of their ends ('' where they are no symbols)."""
    names = f.at("symbols", sid).select("symbol_key", "qname")
    rows = f.at("flow_edges", sid).where(F.col("owner_symbol_key") == symbol_key)
    for end in ("source", "target"):
        rows = rows.join(names.select(F.col("symbol_key").alias(f"{end}_symbol_key"), F.col("qname").alias(f"{end}_qname")), f"{end}_symbol_key", "left").fillna("", [f"{end}_qname"])
    return rows.orderBy("line", "col", "kind", "source_label", "target_label", "target_symbol_key")


def _package_rows(f: Facts, import_path: str) -> list[DataFrame]:
    """The package of a symbol: its symbols (value), tests (line), and local dependencies in both directions."""
    local = f.at("package_deps").where("is_local")
    deps = local.where(F.col("from_package_import_path") == import_path).select(F.col("to_package_import_path").alias("p")).distinct()
    used = local.where(F.col("to_package_import_path") == import_path).select(F.col("from_package_import_path").alias("p")).distinct()
    summary = f.at("packages").where(F.col("import_path") == import_path).select("import_path", "file_count")
    counts = [f.at(t).where(F.col("package_import_path") == import_path).agg(F.count(F.lit(1)).alias(n)) for t, n in (("symbols", "symbol_count"), ("tests", "test_count"))]
    mine = summary.join(F.broadcast(counts[0])).join(F.broadcast(counts[1]))  # one row each
    return [_rows("package", mine, "import_path", line="test_count", value="symbol_count"), _rows("depends_on", deps, "p"), _rows("used_by", used, "p")]


def quality(f: Facts, symbol_key: str) -> DataFrame:
    """symbol_key, score and why of one symbol, from its lists as the view shows them."""
    me = f.at("symbols").where(F.col("symbol_key") == symbol_key)
    package = me.select("package_import_path").first()[0]
    lists = {
        "caller_count": graph.callers(f, symbol_key), "callee_count": graph.callees(f, symbol_key), "reference_count": graph.references_in(f, symbol_key), "test_count": graph.tests_of(f, symbol_key),
        "reverse_package_deps": f.at("package_deps").where(F.col("is_local") & (F.col("to_package_import_path") == package)).select("from_package_import_path").distinct(),
        "method_count": graph.siblings(f, symbol_key).where("kind = 'method'"),
    }
    row = me
    for name, rows in lists.items():
        row = row.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    function = F.col("kind").isin("func", "method")
    row = row.withColumn("method_count", F.when(function, F.lit(0)).otherwise(F.col("method_count")))
    graph_score = F.when(function, rank.weighted(rank.FUNCTION_WEIGHTS)).otherwise(rank.weighted(rank.TYPE_WEIGHTS))
    scored = rank.with_change(f, row.withColumn("graph_score", graph_score), "file_path", "package_import_path")
    score = F.col("graph_score") + rank.entry_file("file_path") + rank.entry_symbol() + F.col("change_boost")
    return scored.select("symbol_key", "qname", "file_path", "line", score.alias("score"), rank.symbol_reasons().alias("why"))


def symbol_view(f: Facts, symbol_key: str) -> DataFrame:
    """The symbol (value: quality score, why: its reasons), its package, callers, callees, references, flows, tests (value: score) and siblings."""
    me = f.at("symbols").where(F.col("symbol_key") == symbol_key)
    package = me.select("package_import_path").first()[0]
    return _union([
        _rows("symbol", quality(f, symbol_key), "qname", "file_path", "line", "score", "why"),
        *_package_rows(f, package),
        _rows("caller", graph.callers(f, symbol_key), "qname", "file_path", "line", "col", call_why()),
        _rows("callee", graph.callees(f, symbol_key), "qname", "file_path", "line", "col", call_why()),
        _rows("ref_in", graph.references_in(f, symbol_key), "qname", "file_path", "line", "col", ref_why()),
        _rows("ref_out", graph.references_out(f, symbol_key), "qname", "file_path", "line", "col", ref_why()),
        _rows("flow", flows(f, symbol_key), F.concat_ws(" -> ", "source_label", "target_label"), "file_path", "line", "col", flow_why()),
        _rows("test", graph.tests_of(f, symbol_key), "name", "file_path", "line", "score", link_why()),
        _rows("sibling", graph.siblings(f, symbol_key), "qname", "file_path", "line"),
    ])


# -- impact -------------------------------------------------------------------------------


def _frequency_why() -> Column:
    return F.format_string("empirical co-change signal (count=%d freq=%.2f)", F.col("change_count"), F.col("frequency"))


def recent_delta(f: Facts, symbol_key: str) -> DataFrame:
    """What the current snapshot changed about the symbol since its parent: one row of ``Diffs.impacted`` or none."""
    qname = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("qname").first()[0]
    pair = (f.parent, f.current) if f.parent is not None else (-1, -1)
    return Diffs(f, pair, qname).impacted.where(F.col("qname") == F.trim(F.lit(qname)))


class Impact:
    """The parts of an impact view; the depth of the walk is 2 if less than 1 is asked for.

    The lists of the one symbol feed several parts and are written once.
    """

    def __init__(self, f: Facts, symbol_key: str, depth: int = 3) -> None:
        self.f, self.key, self.depth = f, symbol_key, depth if depth >= 1 else 2
        self.package = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("package_import_path").first()[0]
        self.callers, self.refs, self.tests = (stage(rows(f, symbol_key), "impact-edges") for rows in (graph.callers, graph.references_in, graph.tests_of))
        self.transitive = stage(graph.transitive_callers(f, symbol_key, self.depth), "impact-walk")
        files, packages, _ = history.symbol_cochange(f, symbol_key)
        self.files, self.packages = (stage(history.top(rows, 5), "impact-empirical") for rows in (files, packages))
        self.delta = stage(recent_delta(f, symbol_key), "impact-delta")

    def _recent(self, parts: DataFrame, rules: list[tuple[str, str, list[str] | None]]) -> DataFrame:
        """Reasons by label with those of the recent delta, where the label has a reason with one of a rule's markers (None: any)."""
        folded = parts.where("label <> '' AND why <> ''").groupBy("label").agg(F.collect_set("why").alias("_why"))
        counts = self.delta.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in history.COUNTERS])  # one row
        joined, extra = folded.join(F.broadcast(counts)), []
        for counter, surface, markers in rules:
            plus, minus = F.col(f"added_{counter}"), F.col(f"removed_{counter}")
            said = F.lower(F.array_join("_why", "\n"))
            hit = reduce(lambda a, b: a | b, [said.contains(x) for x in markers]) if markers else F.lit(True)
            extra.append(F.when((plus + minus > 0) & hit, F.format_string(f"recent symbol delta changed {surface} (+%d/-%d)", plus, minus)))
        why = F.array_sort(F.array_distinct(F.concat("_why", F.array_compact(F.array(*extra)))))
        return joined.select("label", F.array_join(why, "; ").alias("why"))

    def caller_packages(self) -> DataFrame:
        """label and why of each package with a direct or transitive caller."""
        reached = self.transitive.select(F.col("package_import_path").alias("label"), F.lit("transitive caller package in local call graph").alias("why"))
        return self.callers.select(F.col("package_import_path").alias("label"), evidence(call_why(), "qname").alias("why")).unionAll(reached).where("label <> ''").distinct()

    def reference_packages(self) -> DataFrame:
        return self.refs.select(F.col("package_import_path").alias("label"), evidence(ref_why(), "qname").alias("why")).where("label <> ''").distinct()

    def blast_packages(self) -> DataFrame:
        """Packages a change can reach, each with its sorted reasons."""
        used = self.f.at("package_deps").where(F.col("is_local") & (F.col("to_package_import_path") == self.package)).select(F.col("from_package_import_path").alias("label"), F.lit("reverse package dependency in local graph").alias("why"))
        parts = _union([self.caller_packages(), self.reference_packages(), used, self.packages.select("label", _frequency_why().alias("why"))])
        return self._recent(parts, [("callers", "caller surface", ["call edge", "caller package"]), ("refs_in", "inbound reference surface", ["reference"])])

    def blast_files(self) -> DataFrame:
        """Files that use, test or change with the symbol, each with its sorted reasons."""
        parts = _union([
            self.callers.select(F.col("file_path").alias("label"), evidence(call_why(), "qname").alias("why")),
            self.refs.select(F.col("file_path").alias("label"), evidence(ref_why(), "qname").alias("why")),
            self.tests.select(F.col("file_path").alias("label"), evidence(link_why(), "name").alias("why")),
            self.files.select("label", _frequency_why().alias("why")),
        ])
        return self._recent(parts, [("callers", "caller surface", ["call edge"]), ("refs_in", "inbound reference surface", ["reference"]), ("tests", "related test surface", ["test"])])

    def expansion(self) -> DataFrame:
        """Why the impact is wider than the direct edges: rows of why."""
        used = self.f.at("package_deps").where(F.col("is_local") & (F.col("to_package_import_path") == self.package)).select("from_package_import_path").distinct()
        touched = F.col("contract_changed") | F.col("moved") | (reduce(lambda a, b: a + b, [F.col(f"{c}_{k}") for c in ("added", "removed") for k in ("callers", "refs_in", "tests")]) > 0)
        parts = {"direct": self.callers, "reached": self.transitive, "used": used, "empirical": self.files.select("label").unionAll(self.packages.select("label")), "recent": self.delta.where(touched)}
        one = self.f.spark.range(1)
        for name, rows in parts.items():
            one = one.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
        said = [
            F.when(F.col("reached") > F.col("direct"), F.format_string("transitive callers widen upstream impact beyond %d direct caller(s)", F.col("direct"))),
            F.when(F.col("used") > 0, F.format_string("reverse package dependencies widen package blast radius (%d package(s))", F.col("used"))),
            F.when(F.col("empirical") > 0, F.lit("empirical co-change history widens impact beyond direct graph edges")),
            F.when(F.col("recent") > 0, F.lit("recent symbol delta biases impact toward recently changed caller/reference/test surface")),
        ]
        return one.select(F.explode(F.array_compact(F.array(*said))).alias("why"))

    def rows(self) -> DataFrame:
        callers_rules = [("callers", "caller surface", None)]
        return _union([
            _rows("caller", self.callers, "qname", "file_path", "line", "col", call_why()),
            _rows("transitive", self.transitive, "qname", value="depth"),
            _rows("ref_in", self.refs, "qname", "file_path", "line", "col", ref_why()),
            _rows("test", self.tests, "name", "file_path", "line", "score", link_why()),
            _rows("caller_package", self._recent(self.caller_packages(), callers_rules), "label", why="why"),
            _rows("reference_package", self._recent(self.reference_packages(), [("refs_in", "inbound reference surface", None)]), "label", why="why"),
            _rows("blast_package", self.blast_packages(), "label", why="why"),
            _rows("blast_file", self.blast_files(), "label", "label", why="why"),
            _rows("empirical_file", self.files, "label", "label", value="change_count", why=_frequency_why()),
            _rows("empirical_package", self.packages, "label", value="change_count", why=_frequency_why()),
            _rows("recent_delta", self.delta, "qname", "file_path", value="delta_score", why="why"),
            _rows("expansion", self.expansion(), "why", why="why"),
        ])


def impact_view(f: Facts, symbol_key: str, depth: int = 3) -> DataFrame:
    """What a change of a symbol can reach: callers, references, tests, packages and files with reasons, co-change and the recent delta."""
    return Impact(f, symbol_key, depth).rows()


# -- report and diff ---------------------------------------------------------------------------


def report_view(f: Facts, limit: int = 8) -> DataFrame:
    """The best packages, functions, types and files (value: score, why: reasons in order), and the totals of the snapshot."""
    symbols = [("top_function", rank.top_functions(f, limit)), ("top_type", rank.top_types(f, limit))]
    totals = [(t, f.at(t)) for t in ("packages", "files", "symbols", "refs", "calls", "tests")]
    return _union([
        _rows("top_package", rank.top_packages(f, limit), "import_path", value="score", why=rank.package_reasons()),
        *[_rows(name, rows, "qname", "file_path", "line", "score", rank.symbol_reasons()) for name, rows in symbols],
        _rows("top_file", rank.top_files(f, limit), "rel_path", "rel_path", value="quality_score", why=rank.file_reasons()),
        *[_rows("total", rows.agg(F.count(F.lit(1)).alias("n")), F.lit(name), value="n") for name, rows in totals],
    ])


def diff_view(f: Facts, old: int | None = None, new: int | None = None) -> DataFrame:
    """What differs between two snapshots; by default the current one and its parent, or the one before it."""
    new = f.current if new is None else new
    if old is None:
        old = f.parent if f.parent is not None and new == f.current else max((i for i in f.snapshot_ids if i < new), default=None)
    if old is None:
        raise ValueError("no snapshot to compare with")
    d = Diffs(f, (old, new))

    def arrow(a: str, b: str) -> Column:
        return F.concat(F.coalesce(a, F.lit("")), F.lit(" -> "), F.coalesce(b, F.lit("")))

    def of(rows: DataFrame, name: str, label: str | Column, file: str | Column = "", line: str | int = 0, value: str | int | Column = 0, why: str | Column = "") -> DataFrame:
        return _union([_rows(f"{change}_{name}", rows.where(F.col("change") == change), label, file, line, value, why) for change in ("added", "removed")])

    symbols = d.symbols
    changed = symbols.where("change = 'changed'")
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("contract_changed"), F.lit("contract")), F.when(F.col("moved"), F.lit("moved")))), ", ")
    return _union([
        *[_rows(f"{change}_file", d.files.where(F.col("change") == change), "rel_path", "rel_path") for change in ("added", "changed", "deleted")],
        of(symbols, "symbol", "qname", F.coalesce("to_file_path", "from_file_path"), F.coalesce("to_line", "from_line")),
        _rows("changed_symbol", changed, "qname", arrow("from_file_path", "to_file_path"), "to_line", "from_line", flags),
        _rows("changed_package", d.packages, "import_path", value=F.col("to_symbol_count") - F.col("from_symbol_count"), why="status"),
        of(d.calls, "call", arrow("caller_qname", "callee_qname"), "file_path", "line", why="dispatch"),
        of(d.refs, "ref", arrow("from_qname", "to_qname"), "file_path", "line", why="kind"),
        of(d.test_links, "test_link", arrow("test_key", "symbol_qname"), why=F.concat("link_kind", F.lit("/"), "confidence")),
        of(d.deps, "package_dep", arrow("from_package_import_path", "to_package_import_path")),
        _rows("impacted", d.impacted, "qname", "file_path", value="delta_score", why="why"),
    ])
