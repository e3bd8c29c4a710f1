import pytest
from pyspark.sql import functions as F

from stratagraph.functions import text as T
from stratagraph.operators import search
from stratagraph.plans import incremental
from stratagraph.sources import content, extract, listing, manifests


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize("text,lines,filled", [("", 0, 0), ("a", 1, 1), ("a\n", 1, 1), ("a\n\n b\r\n", 3, 2), ("\n", 1, 0)])
def test_lines(spark, text, lines, filled):
    assert one(spark, text, T.line_count("x")) == lines and one(spark, text, T.filled_line_count("x")) == filled


def test_names(spark):
    assert one(spark, "Pkg/a.(*T).Run_2", T.canonical("x")) == "pkgatrun2"
    assert one(spark, "m/p.(*T).Run", T.qname_tail("x")) == "Run" and one(spark, "plain", T.qname_tail("x")) == "plain" and one(spark, "end.", T.qname_tail("x")) == "end."
    assert one(spark, "a/b/plan_test.go", T.file_family("x")) == "plan" and one(spark, "a/LICENSE", T.extension_label("x")) == "none"
    assert one(spark, "4352", T.human_size(F.col("x").cast("long"))) == "4.2 KB" and one(spark, "512", T.human_size(F.col("x").cast("long"))) == "512 B"
    assert one(spark, "Größe", T.same_letters_in_order("gße", F.lower("x")))


def test_content_rules(spark):
    assert one(spark, "x\x00y", content.is_binary("x")) and not one(spark, "", content.is_binary("x")) and one(spark, "\x01" * 9 + "a" * 91, content.is_binary("x"))
    assert one(spark, "// Code generated by x. DO NOT EDIT.", content.is_generated("x")) and not one(spark, "\n" * 12 + "@generated", content.is_generated("x"))
    rows = [("a/.git/x", "t"), (".hidden", "t"), ("a/x.log", "t"), ("a/x.go", None), ("a/x.go", "  "), ("a/x.go", "package x"), ("vendor/x.go", "t")]
    got = [r.r for r in spark.createDataFrame(rows, "p string, t string").select(content.skip_reason("p", "t").alias("r")).collect()]
    assert got == ["ignored directory", "hidden file", "artifact", "too large or unreadable", "empty", None, "ignored directory"]


def test_ignore_rules(spark):
    rules = listing.parse_rules(["# c", "", "*.log", "build/", "/top.txt", "!keep.log", "docs/**/tmp?"]) + listing.parse_rules(["*.tmp"], "sub")
    cases = {"a/x.log": True, "keep.log": False, "x/build/y.go": True, "build": False, "top.txt": True, "a/top.txt": False, "docs/a/b/tmp1": True, "docs/a/tmp": False, "sub/a.tmp": True, "a.tmp": False}
    df = spark.createDataFrame(list(cases.items()), "p string, want boolean").withColumn("got", listing.ignored("p", rules))
    assert [r.p for r in df.where("got <> want").collect()] == []


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "go.mod").write_text("module example.com/m\n")
    (tmp_path / "pkg" / "a_test.go").write_text("package pkg\n")
    rows = {r.rel_path: r for r in listing.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"go.mod", "pkg/a_test.go"} and rows["pkg/a_test.go"].is_test and rows["go.mod"].kind == "go manifest" and rows["go.mod"].size_bytes == 21


def test_merged_scans(spark):
    a = spark.createDataFrame([("x", "", True), ("y", "h1", False)], "rel_path string, hash string, is_go boolean")
    b = spark.createDataFrame([("x", "h2", False), ("y", "h3", True)], "rel_path string, hash string, is_go boolean")
    assert sorted((r.rel_path, r.hash, r.is_go) for r in listing.merge_scans(a, b).collect()) == [("x", "h2", True), ("y", "h1", True)]


def test_manifests():
    go = manifests.parse("a/go.mod", 'module example.com/m // c\n\ngo 1.22\n\nrequire (\n\tx.example/b v1.0.0\n\tx.example/a v1.2.0 // indirect\n)\nreplace x.example/b => ../b\nreplace x.example/c => y.example/c v1\n')
    assert go == {"kind": "go.mod", "module": "example.com/m", "go_version": "1.22", "local_deps": ["x.example/b=>../b"], "external_deps": ["x.example/a", "x.example/b"]}
    cargo = manifests.parse("Cargo.toml", '[package]\nname = "k"\nedition = "2021"\n[dependencies]\nserde = "1"\nown = { path = "../own" }\n[features]\nfast = []\n')
    assert cargo["local_deps"] == ["own=>../own"] and cargo["external_deps"] == ["serde"] and cargo["features"] == ["fast"]
    py = manifests.parse("pyproject.toml", '[project]\nname = "p"\nrequires-python = ">=3.11"\ndependencies = ["Numpy>=1", "own @ file:../own"]\n')
    assert py["external_deps"] == ["numpy"] and py["local_deps"] == ["own@file:../own"]
    assert manifests.parse("requirements.txt", "# c\n-r other.txt\nFlask==2 # web\n./local\n") == {"kind": "requirements.txt", "local_deps": ["./local"], "external_deps": ["flask"]}
    assert manifests.parse("setup.cfg", "[metadata]\nname = s\n[options]\ninstall_requires =\n  a>1\n  b\n")["external_deps"] == ["a", "b"]
    assert manifests.parse("setup.py", "setup(name='s', install_requires=['x', 'y>2'])")["external_deps"] == ["x", "y"]
    assert manifests.parse("Pipfile", '[packages]\nRich = "*"\n')["external_deps"] == ["rich"] and manifests.parse("x.txt", "") == {}
    assert manifests.decode(manifests.encode(go)) == go and manifests.encode({"kind": ""}) == "" and manifests.decode("{") == {}


FILES = "rel_path string, hash string, package_import_path string, semantic_meta string"


def test_plans(spark):
    old_mod, new_mod = '{"kind":"go.mod","module":"m","go_version":"1.21"}', '{"kind":"go.mod","module":"m","go_version":"1.22"}'
    before = spark.createDataFrame([("go.mod", "1", "", old_mod), ("a/a.go", "1", "m/a", ""), ("b/b.go", "1", "m/b", ""), ("gone.go", "1", "", "")], FILES)
    after = spark.createDataFrame([("go.mod", "1", "", old_mod), ("a/a.go", "2", "m/new", ""), ("b/b.go", "1", "m/b", ""), ("gone.go", "1", "", "")], FILES)
    plan = incremental.detect(after, before)
    assert not plan.full and plan.packages == ["m/a"] and plan.reason == "package-scoped changes"
    assert incremental.detect(before, before).reason == "no indexed file changes" and incremental.detect(after, before.limit(0)).full
    assert incremental.detect(after.where("rel_path <> 'gone.go'"), before).full
    bumped = before.withColumn("hash", F.when(F.col("rel_path") == "go.mod", "2").otherwise(F.col("hash"))).withColumn("semantic_meta", F.when(F.col("rel_path") == "go.mod", new_mod).otherwise(F.col("semantic_meta")))
    plan = incremental.detect(bumped, before)
    assert plan.packages == ["m/a", "m/b"] and plan.deltas[0]["impact"] == "package"
    deps = spark.createDataFrame([("m/c", "m/a"), ("m/d", "m/x")], "from_package_import_path string, to_package_import_path string")
    assert incremental.expand(incremental.Plan(packages=["m/a"]), deps) == ["m/a", "m/c"]
    assert incremental.reuse_percent(7, 2) == 71 and incremental.reuse_percent(0, 0) == 0


def test_plans_keep_all_packages(spark, monkeypatch):
    monkeypatch.setattr(incremental, "MAX_PACKAGES", 10, raising=False)
    make = lambda n, h: spark.range(n).selectExpr("concat('f', id, '.go') AS rel_path", f"'{h}' AS hash", "concat('m/', id) AS package_import_path", "'' AS semantic_meta")
    plan = incremental.detect(make(50, "2"), make(50, "1"))
    assert not plan.full and plan.impacted(spark).count() == 50
    deps = spark.createDataFrame([("m/far", "m/49"), ("m/x", "m/y")], "from_package_import_path string, to_package_import_path string")
    assert incremental.expanded(plan, deps).count() == 51
    lost = spark.createDataFrame([("gone.go", "1", "", "")], FILES)
    full = incremental.detect(make(50, "1"), make(50, "1").union(lost))
    assert full.full and full.impacted(spark).count() == 50
    assert incremental.detect(make(50, "1"), lost.limit(0)).impacted(spark).count() == 50


PY_A = '"""m"""\nfrom pkg.b import helper as h\nimport pkg.b as other\n\n\nclass A:\n    """Holds."""\n    def run(self, x: int) -> int:\n        self.stop()\n        return h(x) + other.helper(x)\n\n    def stop(self):\n        pass\n'
PY_B = "def helper(x):\n    return x\n"
RS = "/// Runs.\npub fn run() -> u8 {\n    helper(\"{\");\n    Thing::make()\n}\n\nfn helper(s: &str) {}\n\npub struct Thing;\n\nimpl Thing {\n    pub fn make() -> u8 { 1 }\n}\n"
GO = 'package svc\n\nimport (\n\t"example.com/m/api"\n)\n\n// Run runs.\nfunc (s *Service) Run(n int) error {\n\thelper()\n\treturn api.Do(n)\n}\n\nfunc helper() {}\n\ntype Service struct{}\n'


def test_extractors(spark):
    files = [("p", "pkg/a.py", PY_A, ""), ("p", "pkg/b.py", PY_B, ""), ("p", "tests/test_b.py", "def test_helper():\n    pass\n", ""), ("p", "src/lib.rs", RS, "crate1"), ("p", "svc/s.go", GO, "example.com/m/svc"), ("p", "api/do.go", "package api\n\nfunc Do(n int) error { return nil }\n", "example.com/m/api"), ("p", "bad.py", "def (", ""), ("p", None, "x", None), ("p", "none.go", None, "")]
    df = spark.createDataFrame(files, "project string, rel_path string, content string, package_import_path string")
    found = extract.symbols(df)
    rows = {r.symbol_key: r for r in found.collect()}
    assert rows["method|pkg.a|A|run"].signature == "def run(self, x: int) -> int" and rows["class|pkg.a|A"].doc == "Holds."
    assert rows["method|example.com/m/svc|example.com/m/svc.Service|ptr|Run"].doc == "Run runs." and rows["crate1::Thing::make"].kind == "method" and rows["crate1::run"].exported
    edges = {(r.owner_key, r.target_key) for r in extract.edges(found, extract.uses(df)).where("form = 'call'").collect()}
    assert {
        ("method|pkg.a|A|run", "method|pkg.a|A|stop"), ("method|pkg.a|A|run", "func|pkg.b|helper"), ("crate1::run", "crate1::helper"), ("crate1::run", "crate1::Thing::make"),
        ("method|example.com/m/svc|example.com/m/svc.Service|ptr|Run", "func|example.com/m/svc|helper"), ("method|example.com/m/svc|example.com/m/svc.Service|ptr|Run", "func|example.com/m/api|Do"),
    } <= edges
    links = [(r.test_key, r.symbol_key, r.confidence) for r in extract.link_tests(found).collect()]
    assert ("func|tests.test_b|test_helper", "func|pkg.b|helper", "low") in links


def test_ranked_text_by_file_and_package_scores(spark):
    hits = spark.createDataFrame([("a/few.go", 3, 1), ("b/many.go", 1, 1), ("b/many.go", 2, 1), ("none.go", 9, 1)], "rel_path string, line int, col int")
    columns = "rel_path string, package_import_path string, relevant_symbols long, linked_symbols long, related_tests long, reverse_package_deps long, importance long"
    files = spark.createDataFrame([("a/few.go", "m/a", 5, 2, 1, 3, 40), ("b/many.go", "m/b", 0, 0, 0, 0, 0)], columns)
    got = [tuple(r) for r in search.ranked_text(hits, files, 3).orderBy("rank").collect()]
    # 100 + 5 * 6 + 2 * 8 + 1 * 4 + 3 * 10 + 40 * 2 = 260; 60 + 40 * 3 + 3 * 10 + 260 div 4 = 275
    assert got == [(1, "m/a", "a/few.go", 3, 1, 260, 275), (2, "m/b", "b/many.go", 1, 1, 200, 170), (3, "m/b", "b/many.go", 2, 1, 200, 170)]
    owned = hits.selectExpr("*", "'m/own' AS package_import_path")
    got = {(r.package_import_path, r.rel_path) for r in search.ranked_text(owned, files).collect()}
    assert got == {("m/a", "a/few.go"), ("m/b", "b/many.go"), ("m/own", "none.go")}
