import pytest

from stratagraph.store import Store, copy_forward, one_per_key
from stratagraph.streaming import watch

PACKAGES = "import_path string, name string, file_count long"
SYMBOLS = "symbol_key string, package_import_path string, line int"
CALLS = "caller_package_import_path string, caller_symbol_key string, callee_symbol_key string, file_path string, line int, col int, dispatch string, seq int"


def test_commits_copy_forward_and_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.current() is None
    first = {
        "packages": spark.createDataFrame([("P", "p", 2), ("A", "a", 1)], PACKAGES),
        "symbols": spark.createDataFrame([("P.run", "P", 5), ("A.handle", "A", 3)], SYMBOLS),
        "call_edges": spark.createDataFrame([("A", "A.handle", "P.run", "h.go", 6, 2, "static", 1), ("A", "A.handle", "P.run", "h.go", 6, 2, "interface", 2)], CALLS),
    }
    assert store.commit(first) == 1
    assert [r.dispatch for r in store.table("call_edges").collect()] == ["static"]
    impacted = spark.createDataFrame([("P",)], "import_path string")
    second = {"packages": spark.createDataFrame([("P", "p", 3)], PACKAGES), "symbols": spark.createDataFrame([("P.run", "P", 8)], SYMBOLS), "call_edges": first["call_edges"].limit(0)}
    assert store.commit(second, "update", impacted=impacted) == 2
    assert sorted((r.symbol_key, r.line) for r in store.table("symbols").collect()) == [("A.handle", 3), ("P.run", 8)]
    assert store.table("call_edges").count() == 1 and store.table("symbols", 1).count() == 2
    with pytest.raises(ValueError):
        store.commit({"symbols": spark.createDataFrame([("x", "P", 1), ("x", "P", 2)], SYMBOLS)})
    assert store.current() == 2
    with pytest.raises(ValueError):
        store.delete([2])
    nothing = {name: rows.limit(0) for name, rows in second.items()}
    assert store.commit(nothing, impacted=impacted.limit(0), limit=1) == 3 and store.table("symbols").count() == 2
    assert [s["id"] for s in store.snapshots()] == [3] and store.snapshots()[0]["parent_id"] == 2


def test_policies(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "c")], "key string, seq int, v string")
    assert sorted(r.v for r in one_per_key(df, ("key",), "first").collect()) == ["a", "c"]
    assert sorted(r.v for r in one_per_key(df, ("key",), "last").collect()) == ["b", "c"]
    assert one_per_key(df, ("key",), "error").count() == 3
    assert copy_forward(df, "key", spark.createDataFrame([], "import_path string")).count() == 3


def test_bursts(spark):
    rows = [("a", 0, "x"), ("a", 100, "y"), ("a", 250, "x"), ("a", 260, None), ("b", 5, ""), (None, 1, "x"), ("b", None, "x")]
    df = spark.createDataFrame(rows, "k string, ms long, why string").selectExpr("k", "timestamp_millis(ms) AS ts", "why")
    got = sorted(tuple(r) for r in watch.bursts(df, "k", "ts", "why", 250).collect())
    assert got == [("a", 0, 3, "x+y"), ("a", 260000, 1, ""), ("b", 5000, 1, "")]
    assert watch.bursts(df.limit(0), "k", "ts", "why", 250).collect() == []


FILES = "rel_path string, hash string, package_import_path string, semantic_meta string"


def test_watch_commits_once_per_change(spark, tmp_path):
    state, done = {"listing": [("a.go", "1", "p", "")]}, []
    make = lambda rows: spark.createDataFrame(rows, FILES)

    def commit(kind, plan, now):
        done.append((kind, plan.packages))
        state["last"] = [tuple(r) for r in now.collect()]
        if len(done) == 1:
            state["listing"] = [("a.go", "2", "p", "")]

    q = watch.watch(spark, lambda: make(state["listing"]), lambda: make(state["last"]) if "last" in state else None, commit, "200 milliseconds", str(tmp_path / "cp"))
    for _ in range(150):
        if len(done) >= 2:
            break
        q.awaitTermination(0.3)
    q.stop()
    assert done == [("bootstrap", []), ("update", ["p"])] and watch.resync_seconds(2) == 30 and watch.resync_seconds(4) == 60
