"""The expectations of the three fixture snapshots."""

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph, history, metrics, rank, search, views
from stratagraph.operators.history import Diffs

from .fixtures import A, HANDLE, HELPER, P, RUN, SERVICE, T_HELPER, T_RUN, U, _file, _symbol, facts


@pytest.fixture(scope="module")
def v1(spark):
    return facts(spark, 1)


@pytest.fixture(scope="module")
def v2(spark):
    return facts(spark, 2)


@pytest.fixture(scope="module")
def v3(spark):
    return facts(spark, 3)


def sections(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.section, []).append(r)
    return out


def test_totals_and_summaries(v1):
    counts = {r.table_name: r.row_count for r in metrics.table_counts(v1).collect()}
    assert counts == {"packages": 2, "files": 3, "symbols": 4, "calls": 1, "refs": 2, "tests": 1, "test_links": 2, "package_deps": 1}
    files = {r.rel_path: r for r in rank.scored_files(v1).withColumn("why", rank.file_reasons()).collect()}
    service, test, api = files["pkg/service.go"], files["pkg/service_test.go"], files["api/handler.go"]
    assert (service.symbol_count, service.func_count, service.method_count, service.type_count) == (3, 1, 1, 1)
    assert (service.related_tests, service.linked_symbols, service.relevant_symbols) == (1, 2, 3)
    assert service.quality_score > 0 and "1 inbound calls" in service.why
    assert test.is_test and test.declared_tests == 1 and api.package_import_path == A and api.func_count == 1
    assert [r.import_path for r in graph.reverse_dependencies(v1, v1.at("packages").where(F.col("import_path") == P)).collect()] == [A]


def test_report(v1, v2):
    got = sections(views.report_view(v1, 4))
    assert [r.label for r in got["top_package"]] == [P, A] and got["top_function"][0].label == RUN and got["top_type"][0].label == SERVICE and got["top_file"][0].label == "pkg/service.go"
    assert {r.label: r.value for r in got["total"]} == {"packages": 2, "files": 3, "symbols": 4, "refs": 2, "calls": 1, "tests": 1}
    assert "1 callers" in got["top_function"][0].why and not any("recently changed" in r.why for r in got["top_file"])
    later = sections(views.report_view(v2, 4))
    assert len(later["top_package"]) == 2 and "recently changed file" in later["top_file"][0].why


def test_entry_files(spark):
    top = "example.com/project"
    extra = {
        "files": [_file(1, "main.go", top, "m", 80)], "packages": [(1, top, "main", ".", 1)],
        "symbols": [(1, f"{top}.main", f"{top}.main", top, "main.go", "main", "func", "", "func main()", "", 3, 1, False, False, "")],
    }
    got = sections(views.report_view(facts(spark, 1, extra), 8))
    assert "main entrypoint file" in next(r.why for r in got["top_file"] if r.label == "main.go")
    assert "main entrypoint symbol" in next(r.why for r in got["top_function"] if r.label == f"{top}.main")


def test_symbol_view(v1, v2):
    run = sections(views.symbol_view(v1, RUN))
    assert run["symbol"][0].value > 0 and "1 callers" in run["symbol"][0].why
    assert [(r.label, r.why) for r in run["caller"]] == [(HANDLE, "static call edge from indexed call site")]
    assert [(r.label, r.why) for r in run["test"]] == [("TestServiceRun", "direct test link (high)")]
    assert {r.label for r in run["used_by"]} == {A} and run["package"][0].value == 3
    service = sections(views.symbol_view(v1, SERVICE))
    assert {r.why for r in service["ref_in"]} == {"receiver reference in indexed source", "type reference in indexed source"}
    for f in (v1, v2):  # carried on with the untouched package
        flow = sections(views.symbol_view(f, HANDLE))["flow"]
        assert [(r.label, r.why) for r in flow] == [(f"{RUN} -> return", "returned call result captured by the analyzer")]
    assert views.flows(v1, HANDLE).first().source_qname == RUN


def test_second_snapshot(v2):
    d = Diffs(v2)
    assert d.files.count() == 1 and d.symbols.count() == 1 and history.changed_symbol_counts(v2).collect()[0].changed_symbols == 1
    assert {r.qname: r.signature for r in v2.at("symbols").where("file_path = 'pkg/service.go'").collect()}[RUN] == "func (*Service) Run(ctx string) error"


def test_diff(v3):
    d = Diffs(v3, (2, 3))
    assert {(r.rel_path, r.change) for r in d.files.collect()} == {("pkg/runtime.go", "added"), ("pkg/service.go", "changed"), ("pkg/service_test.go", "changed"), ("api/handler.go", "changed")}
    run = d.symbols.where(F.col("qname") == RUN).first()
    assert run.contract_changed and run.moved and (run.from_file_path, run.to_file_path) == ("pkg/service.go", "pkg/runtime.go")
    package = d.packages.where(F.col("import_path") == P).first()
    assert (package.status, package.from_file_count, package.to_file_count) == ("changed", 2, 3)
    assert {(r.caller_qname, r.callee_qname, r.change) for r in d.calls.collect()} == {(HANDLE, HELPER, "added"), (HANDLE, RUN, "removed")}
    assert (HELPER, "added") in {(r.to_qname, r.change) for r in d.refs.collect()}
    assert {(r.test_key, r.symbol_qname, r.change) for r in d.test_links.collect()} == {(T_HELPER, HELPER, "added"), (T_RUN, SERVICE, "removed")}
    assert [(r.from_package_import_path, r.to_package_import_path, r.change) for r in d.deps.collect()] == [(P, A, "added")]
    impact = {r.qname: r for r in d.impacted.collect()}
    assert impact[RUN].contract_changed and impact[RUN].moved and impact[RUN].removed_callers > 0 and impact[RUN].status == "changed"
    assert impact[HELPER].added_tests > 0 and impact[HELPER].blast_radius > 0 and impact[HELPER].package_import_path == P
    assert impact[RUN].why.split("; ") == sorted(impact[RUN].why.split("; ")) and "declaration moved" in impact[RUN].why
    rows = sections(views.diff_view(v3))
    assert [r.label for r in rows["added_file"]] == ["pkg/runtime.go"] and [r.label for r in rows["added_package_dep"]] == [f"{P} -> {A}"]
    assert sections(views.diff_view(v3, 1, 2)).keys() == {"changed_file", "changed_symbol", "impacted"}
    with pytest.raises(ValueError):
        views.diff_view(v3, None, 1)


def test_impact(v3):
    got = sections(views.impact_view(v3, HELPER, 3))
    assert got["caller"][0].label == HANDLE and got["ref_in"][0].label == HANDLE
    assert {r.label for r in got["reference_package"]} == {A} and A in {r.label for r in got["blast_package"]}
    assert {"api/handler.go", "pkg/service_test.go"} <= {r.label for r in got["blast_file"]}
    assert got["empirical_package"][0].label == A and "api/handler.go" in {r.label for r in got["empirical_file"]} and got["expansion"]
    packages, files = ({r.label: r.why for r in got[s]} for s in ("blast_package", "blast_file"))
    for expected in ("reverse package dependency in local graph", "empirical co-change signal", "recent symbol delta changed caller surface"):
        assert expected in packages[A]
    for expected in ("static call edge from indexed call site", "recent symbol delta changed caller surface"):
        assert expected in files["api/handler.go"]
    assert "recent symbol delta changed related test surface" in files["pkg/service_test.go"]
    recent = sections(views.impact_view(v3, RUN, 3))["recent_delta"][0]
    assert recent.label == RUN and "signature changed" in recent.why and "declaration moved" in recent.why


def test_histories(v3):
    events = {r.snapshot_id: r for r in history.symbol_history(v3, RUN).collect()}
    assert list(events) == [3, 2, 1] and events[1].status == "introduced" and events[1].from_id == 0
    assert events[3].status == "changed" and events[3].contract_changed and events[3].moved
    assert events[3].removed_calls > 0 and events[3].added_refs > 0 and events[3].removed_refs > 0 and events[2].contract_changed and not events[2].moved
    package = {r.snapshot_id: r for r in history.package_history(v3, P).collect()}
    assert list(package) == [3, 2, 1] and package[1].status == "introduced"
    assert package[3].file_delta == 1 and package[3].moved_symbols > 0 and package[3].changed_contracts > 0 and package[3].added_deps > 0
    assert history.symbol_history(v3, RUN, 1).count() == 1


def test_cochange(v3):
    files, packages, hits = history.symbol_cochange(v3, RUN)
    assert hits.count() == 2
    assert history.top(files, 5).first()[:2] == ("api/handler.go", 1) and history.top(packages, 5).first()[:2] == (A, 1)
    assert {r.label for r in files.collect()} == {"api/handler.go", "pkg/service_test.go"}  # none of the symbol's own files
    files, packages, hits = history.package_cochange(v3, P)
    assert hits.count() == 2 and [r.label for r in files.collect()] == ["api/handler.go"] and packages.first().frequency == 0.5


def test_one_snapshot_has_no_changes(v1):
    assert views.recent_delta(v1, RUN).count() == 0 and Diffs(v1).impacted.count() == 0
    assert history.symbol_history(v1, RUN).first().status == "introduced"
    with pytest.raises(ValueError):
        views.diff_view(v1)


def test_search(spark, v1):
    assert search.find_symbols(v1, "Service").first()[1:3] == (SERVICE, "name")
    assert search.find_symbols(v1, "Servce").first()[1:3] == (SERVICE, "fuzzy")
    assert search.find_symbols(v1, "Handle").first().qname == HANDLE
    extra = {"files": [_file(1, "util/run.go", U, "u", 80)], "packages": [(1, U, "util", "util", 1)], "symbols": [_symbol(1, f"{U}.Run", U, "util/run.go", "func", 3, 1, "func Run()")]}
    assert [r.qname for r in search.find_symbols(facts(spark, 1, extra), "Run").limit(2).collect()] == [RUN, f"{U}.Run"]


def test_guidance_and_signal(v3):
    got = {r.name: r for r in graph.test_guidance(v3, HELPER).collect()}
    assert list(got) == ["TestHelper", "TestServiceRun"] and got["TestHelper"].relation == "direct" and got["TestServiceRun"].relation == "package"
    assert got["TestHelper"].score == 240 + 3 * 20 + 3 * 6 + 320 and got["TestHelper"].why.startswith("direct test link (high); same package fallback")
    signal = graph.test_signal(v3, HELPER).first()
    assert (signal.direct, signal.strong, signal.nearby, signal.signal, signal.warning) == (1, 1, 1, "direct=1 strong | nearby=1", "")


def test_callee_walk_has_parents(spark):
    sites = [("a", "b", 5), ("a", "c", 3), ("b", "d", 1), ("c", "d", 9), ("d", "a", 1), ("d", "e", 2), ("c", "gone", 1)]
    extra = {
        "call_edges": [(1, P, f"{P}.{x}", f"{P}.{y}", "pkg/w.go", line, 1, "static", "") for x, y, line in sites],
        "symbols": [_symbol(1, f"{P}.{x}", P, "pkg/w.go", "func", i, 1, "func()") for i, x in enumerate("abcde")],
    }
    got = {r.symbol_key.rsplit(".", 1)[1]: (r.depth, r.parent_key.rsplit(".", 1)[1], r.place) for r in graph.callee_walk(facts(spark, 1, extra), f"{P}.a").collect()}
    assert got == {"c": (1, "a", 1), "b": (1, "a", 2), "d": (2, "c", 1), "e": (3, "d", 1)}  # c is visited first, so d is its child


def test_package_evidence(v1):
    got = [(r.source, r.label) for r in graph.package_provenance(v1, P).collect()]
    assert got[0] == ("reverse_dep", A) and got[1] == ("symbol", RUN) and len(got) == 3
