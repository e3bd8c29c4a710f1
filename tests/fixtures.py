"""Three snapshots of a small project: a service, its helper and a handler; then a new signature, then a move.

In each later snapshot, rows of packages that it doesn't touch are carried on.
"""

from pyspark.sql import DataFrame, SparkSession

from stratagraph.facts import FLOW_EDGES, Facts

P, A, U = "example.com/project/pkg", "example.com/project/api", "example.com/project/util"
SERVICE, RUN, HELPER, HANDLE = f"{P}.Service", f"{P}.Service.Run", f"{P}.helper", f"{A}.Handle"
T_RUN, T_HELPER = f"{P}:TestServiceRun", f"{P}:TestHelper"

SCHEMAS = {
    "snapshots": "id long, parent_id long, kind string, scan_ms int, analyze_ms int, write_ms int",
    "packages": "snapshot_id long, import_path string, name string, dir_path string, file_count long",
    "files": "snapshot_id long, rel_path string, package_import_path string, identity string, semantic_meta string, content_hash string, size_bytes long, is_test boolean, loaded_at string",
    "symbols": "snapshot_id long, symbol_key string, qname string, package_import_path string, file_path string, name string, kind string, receiver string, signature string, doc string, line int, col int, exported boolean, is_test boolean, loaded_at string",
    "package_deps": "snapshot_id long, from_package_import_path string, to_package_import_path string, is_local boolean",
    "refs": "snapshot_id long, from_package_import_path string, from_symbol_key string, to_symbol_key string, file_path string, line int, col int, kind string, loaded_at string",
    "call_edges": "snapshot_id long, caller_package_import_path string, caller_symbol_key string, callee_symbol_key string, file_path string, line int, col int, dispatch string, loaded_at string",
    "flow_edges": FLOW_EDGES,
    "tests": "snapshot_id long, test_key string, package_import_path string, file_path string, name string, kind string, line int",
    "test_links": "snapshot_id long, test_package_import_path string, test_key string, symbol_key string, link_kind string, confidence string, loaded_at string",
    "external_symbols": "symbol_key string, qname string, kind string, module string",
}


def _file(sid, path, package, digest, size, is_test=False):
    return (sid, path, package, "", "", digest, size, is_test, "")


def _symbol(sid, key, package, path, kind, line, col, signature, receiver=""):
    return (sid, key, key, package, path, key.rsplit(".", 1)[1], kind, receiver, signature, "", line, col, kind != "func" or key == HANDLE, False, "")


def rows(versions: int) -> dict[str, list[tuple]]:
    """The rows of the first ``versions`` snapshots."""
    svc, handler, test, runtime = "pkg/service.go", "api/handler.go", "pkg/service_test.go", "pkg/runtime.go"
    out: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}
    for sid in range(1, versions + 1):
        third = sid == 3
        out["snapshots"].append((sid, sid - 1 or None, "index" if sid == 1 else "update", 5, 9, 2))
        out["files"] += [_file(sid, svc, P, f"svc-v{sid}", {1: 120, 2: 126, 3: 128}[sid]), _file(sid, test, P, f"svc-test-v{2 if third else 1}", 120 if third else 90, True), _file(sid, handler, A, f"api-v{2 if third else 1}", 118 if third else 110)]
        out["files"] += [_file(sid, runtime, P, "runtime-v1", 96)] if third else []
        out["packages"] += [(sid, P, "pkg", "pkg", 3 if third else 2), (sid, A, "api", "api", 1)]
        out["symbols"] += [
            _symbol(sid, SERVICE, P, svc, "struct", 3, 6, "type Service struct{}"),
            _symbol(sid, RUN, P, runtime if third else svc, "method", 4 if third else 5, 1, {1: "func (*Service) Run() error", 2: "func (*Service) Run(ctx string) error", 3: "func (*Service) Run(ctx context.Context) error"}[sid], "*Service"),
            _symbol(sid, HELPER, P, svc, "func", 8 if third else 9, 1, "func helper()"), _symbol(sid, HANDLE, A, handler, "func", 3, 1, "func Handle()"),
        ]
        out["package_deps"] += [(sid, A, P, True)] + ([(sid, P, A, True)] if third else [])
        out["refs"] += [(sid, P, RUN, SERVICE, runtime if third else svc, 4 if third else 5, 7, "receiver", ""), (sid, A, HANDLE, HELPER, handler, 5, 9, "func", "") if third else (sid, A, HANDLE, SERVICE, handler, 5, 10, "type", "")]
        out["call_edges"].append((sid, A, HANDLE, HELPER if third else RUN, handler, 6, 2, "static", ""))
        out["flow_edges"] += [] if third else [(sid, A, HANDLE, handler, 6, 2, "call_to_return", "call", RUN, RUN, "return", "return", "")]
        out["tests"] += [(sid, T_RUN, P, test, "TestServiceRun", "func", 3)] + ([(sid, T_HELPER, P, test, "TestHelper", "func", 9)] if third else [])
        out["test_links"] += [(sid, P, T_RUN, RUN, "direct", "high", ""), (sid, P, T_HELPER, HELPER, "direct", "high", "") if third else (sid, P, T_RUN, SERVICE, "related", "medium", "")]
    return out


def facts(spark: SparkSession, versions: int, extra: dict[str, list[tuple]] | None = None) -> Facts:
    data = rows(versions)
    for name, more in (extra or {}).items():
        data[name] += more
    tables: dict[str, DataFrame] = {name: spark.createDataFrame(data[name], schema).coalesce(1) for name, schema in SCHEMAS.items()}
    return Facts(spark, tables=tables)
