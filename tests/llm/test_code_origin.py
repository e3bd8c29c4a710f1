from stratagraph.llm import code_origin as c

HAND = "package core\n\nimport (\n\t\"forge.example/mine/plan\"\n)\n\n// Load reads the plan and returns it.\nfunc Load(name string) (*Plan, error) {\n\tif name == \"\" {\n\t\treturn nil, errEmpty\n\t}\n\treturn parse(name)\n}\n"


def flags(content, path="core/load.go", project="mine"):
    g, m, d, v, *_ = c.inspect(project, path, content)
    return "".join(x for x, on in zip("gmdv", (g, m, d, v)) if on)


def test_hand_written():
    assert flags(HAND) == ""
    assert flags('// This package writes the banner "Code generated by x. DO NOT EDIT." into what it emits.\n' + HAND) == ""
    assert flags("// The header says @generated only if the caller asks.\n" + HAND) == ""
    assert flags(HAND, "pkg/third_party_audit/load.go") == "" and flags(HAND, "tools/scan_generator.go") == ""
    assert flags(HAND + "\nvar masks = [4]byte{0x22, 0x88, 0xfc, 0x71}\n") == ""
    assert flags("// Copyright the mine authors, all terms in LICENSE.\n" + HAND) == ""


def test_generated():
    for notice in ("// Code generated by tool. DO NOT EDIT.", "// Generated by tool — do not edit by hand.", "# Automatisch erzeugt von tool", "// Fichier produit automatiquement par tool", "// @generated from x.wire by tool 1.2", "// zz: created with tool --out x, input digest 12"):
        assert flags(notice + "\n" + HAND) == "g", notice
    assert flags(HAND + "\n// end of tool output r12; rerun the tool instead of patching\n") == "g"
    assert flags("\ufeff// Code generated by tool. DO NOT EDIT.\r\n" + HAND.replace("\n", "\r\n")) == "g"
    getters = "package x\n\n" + "".join(f"func (m *A) GetF{i}() string {{\n\tif m != nil {{\n\t\treturn m.F{i}\n\t}}\n\treturn \"\"\n}}\n\n" for i in range(6))
    assert flags(getters) == "g"


def test_minified_and_data():
    assert "m" in flags("var x=d=>v.map(d);i.r=!0;function v(n,p){return n.v(p?53:n)}" * 20, "dist/a.js")
    assert "m" in flags(".a-0{margin:3px;top:27%}" * 60, "web/a.min.css")
    assert flags("ROWS = [\n" + "".join(f"    ({i}, 'Stale', {i / 7:.3f}, {i * 77}),\n" for i in range(60)) + "]\n", "a.py") == "d"
    assert flags('pub const X: &str = "\\\n' + "afd9d10417d73834bcf2da9cbc86\\\n" * 40 + '";\n', "a.rs") == "d"
    assert flags(HAND.replace('"")', '"' + "long text " * 80 + '")')) == ""


def test_vendored():
    assert flags(HAND, "node_modules/libx/load.js") == "v" and flags("{}", "web/package-lock.json") == "v"


def test_attributions_reach_known_libraries(spark):
    """A header's attribution counts, in any phrasing, where a vendored path anywhere names the library."""
    headers = [
        "// Part of libx. Written by its contributors.", "// Copied from libx v1.2 (https://libx.example), MIT-style terms.", "// SPDX-FileCopyrightText: 2021 the lib-x maintainers", "/* libx 4.1, released under a BSD licence */",
        "// libx is free to use; keep this notice.", "// Taken over from github.example/someone/libx, see there.", "// © 2019 Libx",
    ]
    others = ["// Calls libx for every row.", "// Part of libw. Written by its contributors.", "// Copyright the mine authors.", "// The order matters."]
    rows = [("other", "vendor/libx/a.go", "package a\n")] + [("mine", f"core/{i}.go", f"{h}\n{HAND.replace('Load', f'Load{i}')}") for i, h in enumerate(headers + others)]
    rows.append(("libx", "core/own.go", f"{headers[0]}\n{HAND.replace('Load', 'Own')}"))
    got = {r.rel_path for r in c.found_files(spark.createDataFrame(rows, "project string, rel_path string, content string")).collect()}
    assert got == {"vendor/libx/a.go", *(f"core/{i}.go" for i in range(len(headers)))}


def test_repeated_blocks():
    rust = "use a::b;\n\nimpl A {\n" + "".join(f"    pub fn get_{x}(&self) -> u8 {{ self.at({i}) }}\n" for i, x in enumerate("abcdefgh")) + "}\n"
    script = "import {a} from './a.js';\n\n" + "".join(f"reg.{x}.set = (v) => {{\n  this.put({i}, v);\n}};\n" for i, x in enumerate("abcdefgh"))
    fields = "".join(f"_F['{x}']._at = {i}\n_F['{x}']._to = ({i}, {i + 4})\n" for i, x in enumerate("abcdefgh"))
    assert [flags(rust, "a.rs"), flags(script, "a.js"), flags(fields, "a.py")] == ["g", "g", "g"]
    by_hand = "def f(a):\n    x = g(a)\n    y = h(x)\n    if y:\n        return x\n    for r in y:\n        put(r)\n    return y\n"
    other = "def k(a):\n    try:\n        return f(a)\n    except E:\n        return None\n"
    assert flags(by_hand + other + by_hand, "a.py") == "" and flags("x = f(1)\ny = f(2)\nz = f(3)\n", "a.py") == ""


def test_short_files():
    """Short files are judged by the same rules, as far as their few words prove anything."""
    assert flags("var a=1,b=2;c(a,b);d(b);e(c);f(a);g(b);h(a);i(c);j(a);k(b);l(c);m(d);n(a);o(b)", "web/a.min.js") == "m"
    assert flags("run(a, b)\n", "web/a.min.js") == "" and flags("x=f(1)\n", "a.py") == "" and flags("", "a.min.js") == ""
    assert flags("ROWS = [1001, 2213, 3477, 4019, 5261, 6007, 7703, 8101, 9467]\n", "a.py") == "d" and flags('NAME = "plan"\nLIMIT = 4\n', "a.py") == ""


def test_library_names_and_copies_reach_other_files(spark):
    lib = "from libx._core import f\n\n\ndef go(depth):\n    for row in f(depth):\n        totals[row.name] += row.size * depth\n    return totals\n\n\ndef stop(depth):\n    return f(depth).close() or totals.pop(depth, None)\n"
    body = HAND * 3
    rows = [
        ("p", "vendor/libx/a.py", "def x():\n    return 1\n", 1), ("p", "util/b.py", lib, 1), ("q", "vendor/liby/c.go", body, 1), ("p", "util/d.go", "// patched\n" + body, 1),
        ("p", "own/e.go", HAND, 1), ("p", "own/e.go", HAND, 2), ("p", "own/none.go", None, 1), ("p", "vendor/z/none.go", None, 1), ("p", "own/empty.go", "", 1), (None, None, HAND, 1),
    ]
    df = spark.createDataFrame(rows, "project string, rel_path string, content string, generated int")
    got = {(r.project, r.rel_path) for r in c.found_files(df).collect()}
    assert got == {("p", "vendor/libx/a.py"), ("p", "util/b.py"), ("q", "vendor/liby/c.go"), ("p", "util/d.go")}


def test_options(spark):
    gen = "// Code generated by tool. DO NOT EDIT.\n" + HAND
    files = spark.createDataFrame([(p, "a.go", gen) for p in "xyz"] + [("x", "b.go", HAND)], "project string, rel_path string, content string")
    options = spark.createDataFrame([("x", True, None), ("y", None, True)], "project string, include_generated boolean, include_minified boolean")
    assert sorted(tuple(r) for r in c.kept_files(files, options).collect()) == [("x", "a.go"), ("x", "b.go")]


def test_empty_table(spark):
    assert c.found_files(spark.createDataFrame([], "project string, rel_path string, content string")).collect() == []
