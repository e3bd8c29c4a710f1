import pytest

from stratagraph.llm import doc_pairs as d

SIG = "func LoadColdPlan(path string, limit int) error"


@pytest.mark.parametrize("doc", [
    "Caller must hold the plan lock.", "// Keeps the first row on equal keys.", "/**\n * Blocks until the queue drains.\n */", '"""No-op if the disk is slow."""', "请先重建索引，然后再更新快照。", "Le cache est relu après chaque passage.",
    "LoadColdPlan loads the cold plan unless nobody holds the lock.", "TODO(x): nothing\nReturns -1 when the budget runs out.".split("\n")[1], "Args:\n    path: where the index lies\n    limit: most rows",
])
def test_tells_something(doc):
    text, sig = d.unit(doc, SIG)
    assert d.tells_something(text, "LoadColdPlan", sig)


@pytest.mark.parametrize("doc", [
    "LoadColdPlan", "LoadColdPlan method.", "Loads the cold plan", "/* LoadColdPlan */", "// ///", "----------", '""""""', "TODO: document", "FIXME(reviewer-2): write the docs once the interface settles.", "Describe me.", "À compléter", "Sin documentar.", "未記載", "待补充",
    "go:build linux", "nolint:gocyclo", "pylint: disable=too-many-args", "{@inheritDoc}", "func LoadColdPlan(path string, limit int) error", "plan := path.LoadColdPlan()\nreturn plan, nil", ":param path:\n:param limit:\n:return:", "@param other\n@return", "Args:\n    path:\n    limit:\nReturns:\n", " \t", "\xa0", "N/A", "====\nLoadColdPlan()\n====",
    "Args:\n    root (Path|None): The root.\n    since (dict[str,int]): The since.\n\nReturns:\n    The result.", "@param root the root\n@param since the since\n@throws", "@param root the root\n@return the result",
])
def test_tells_nothing(doc):
    captured = d.unit(doc, SIG)
    assert not (captured and d.tells_something(captured[0], "LoadColdPlan", captured[1]))


def test_capture_balances_and_protects():
    go = 'package x\n\n// Open opens /* a */ "file (".\nfunc (s *Store) Open(f func(a int) (int, error), b map[string]int) error {\n\tif s.x == "}" { // }\n\t\treturn nil\n\t}\n\treturn nil\n}\n\nfunc Bare() {}\n'
    assert d.extract(go) == [("Open", "func (s *Store) Open(f func(a int) (int, error), b map[string]int) error", '// Open opens /* a */ "file (".'), ("Bare", "func Bare()", None)]
    py = 'def f(a, b=(1, 2)):\n    """Adds, with care."""\n    def g():\n        \'\'\'Inner.\'\'\'\n        return 1\n    return g\n\n\nclass A:\n    async def h(self): # note\n        return 2\n'
    assert [(n, doc) for n, _, doc in d.extract(py)] == [("f", '"""Adds, with care."""'), ("g", "'''Inner.'''"), ("h", None)]
    rs = "/* outer /* nested */ still */\n/// Runs it.\n#[inline]\npub fn run<'a>(x: &'a str, f: impl Fn(u8) -> u8) -> Result<(), E> {\n    let c = '{';\n    Ok(())\n}\n"
    (name, sig, doc), = d.extract(rs)
    assert name == "run" and sig.startswith("pub fn run") and doc.endswith("/// Runs it.")
    js = "/** Says hi. */\nexport default async function hi(a, {b}) {\n  return `}${a}`;\n}\n"
    assert d.extract(js) == [("hi", "export default async function hi(a, {b})", "/** Says hi. */")]
    assert d.extract(None) == [] and d.extract("") == [] and d.extract("func broken( {") == []


def test_rows(spark):
    cols = "snapshot_id long, symbol_key string, name string, kind string, receiver string, signature string, doc string, loaded_at string, extra int"
    rows = [
        (2, "a", "A", "func", "", "func A()", "Blocks until the queue drains.", "1", 0), (2, "a", "A", "func", "", "func A()", "TODO", "0", 0), (2, "b", "B", "func", None, "func B()", "Old text that tells.", "0", 0), (2, "b", "B", "func", None, "func B()", None, "1", 0),
        (2, "c", "C", "struct", "", "type C", "Holds the lock.", "1", 0), (2, "d", None, "method", "*T", "func (*T) D()", "Holds the lock.", "1", 0), (2, "e", "E", "func", "", "", "Holds the lock.", "1", 0), (1, "f", "F", "func", "", "func F()", "Holds the lock.", "1", 0),
    ]
    df = spark.createDataFrame(rows, cols)
    assert sorted(r.symbol_key for r in d.latest_pairs(df, 2).collect()) == ["a", "d"]
    assert d.latest_pairs(df, None).collect() == [] and d.latest_pairs(df.limit(0), 2).collect() == []


def test_very_long_text(spark):
    text = "// word\n" * 20_000 + "func F() {\n" + "\tx(1)\n" * 20_000 + "}\n"
    df = spark.createDataFrame([("p", text)], "project string, content string")
    assert d.source_pairs(df, ["project"]).count() == 1


def test_pattern_follows_the_file_and_assigned_functions():
    go = 'package a\n\n/*\ndef template(x):\n    pass\n*/\n\n// Run drains the queue.\nfunc Run(n int) error {\n\treturn nil\n}\n'
    assert [f[0] for f in d.extract(go, "a/run.go")] == ["Run"] and "Run" in [f[0] for f in d.extract(go)]
    assert [f[0] for f in d.extract("def run(x):\n    return x\n", "misnamed.go")] == ["run"]
    js = "// Adds both.\nexports.add = function (a, b) {\n  return a + b;\n};\n// Doubles it.\nconst twice = (x) => {\n  return 2 * x;\n};\n// Halves it.\nexport const half = x => x / 2;\nconst n = 4;\n"
    assert d.extract(js, "m.js") == [("add", "exports.add = function (a, b)", "// Adds both."), ("twice", "const twice = (x) =>", "// Doubles it."), ("half", "export const half = x =>", "// Halves it.")]


def test_restatements_are_learnt(spark):
    """Phrases that go with saying the name again are found by how they are used, and only they."""
    verbs, nouns = ["load", "pin", "drain", "trim", "seal", "rank"], ["plan", "lock", "queue", "frame", "index", "rule"]
    rows = []
    for i, (v, x) in enumerate((v, x) for v in verbs for x in nouns):
        name = f"{v}_{x}"
        rows.append((f"stale{i}", name, "func", "", f"def {name}()", f"{name} is a routine denoted {name}: it {v}s the {x}, as the title tells."))
        rows.append((f"told{i}", name, "func", "", f"def {name}()", f"{name} {v}s the {x} before the disk is full."))
        rows.append((f"other{i}", name, "func", "", f"def {name}()", f"Waits for the watcher number {i} before the disk is full."))
    df = spark.createDataFrame(rows, "symbol_key string, name string, kind string, receiver string, signature string, doc string")
    got = {r.symbol_key for r in d.documented(df).collect()}
    assert got == {r[0] for r in rows if not r[0].startswith("stale")}
    few = df.where("symbol_key IN ('stale0', 'told0')")  # too few to learn from: kept
    assert {r.symbol_key for r in d.documented(few).collect()} == {"stale0", "told0"}
    assert d.documented(df.limit(0)).collect() == []
