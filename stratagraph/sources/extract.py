"""Facts out of source texts: symbols, uses and tests of Python, Rust and Go files.

A first pass reads each file alone and emits its symbols and, for every use of
a name, the qualified names it can mean in order of preference.  A second pass
resolves the uses by a join with the symbols of the project, so a project of
any size is never gathered in one task.  Python is parsed; Rust and Go are read
by patterns, which find declarations and plain calls but no types.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SYMBOL_FIELDS = ["project", "symbol_key", "qname", "package_import_path", "file_path", "name", "kind", "receiver", "signature", "doc", "line", "col", "exported", "is_test"]
_SYMBOLS = "project string, symbol_key string, qname string, package_import_path string, file_path string, name string, kind string, receiver string, signature string, doc string, line int, col int, exported boolean, is_test boolean"
USE_FIELDS = ["project", "owner_key", "package_import_path", "file_path", "line", "col", "form", "candidates"]
_USES = "project string, owner_key string, package_import_path string, file_path string, line int, col int, form string, candidates array<string>"


def python_module(path: str, roots: tuple[str, ...] = ("src",)) -> str:
    """The dotted module of a file below the longest source root that holds it."""
    best = max((r for r in roots if path.startswith(r + "/")), key=len, default="")
    parts = path[len(best) + 1 if best else 0 :].removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def python_package(module: str) -> str:
    return module.rsplit(".", 1)[0] if "." in module else module


class _PythonFile(ast.NodeVisitor):
    def __init__(self, path: str, tree: ast.Module, is_test: bool) -> None:
        self.path, self.module, self.is_test = path, python_module(path), is_test
        self.package = python_package(self.module)
        self.symbols: list[tuple] = []
        self.uses: list[tuple] = []
        self.names: dict[str, str] = {}
        self.owner, self.cls = "", ""
        for node in ast.walk(tree):
            self._bind(node)
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.names[node.name] = f"{self.module}.{node.name}"
        for node in tree.body:
            self._declare(node, "")
        self.visit_body(tree)

    def _bind(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                up = self.module.split(".")
                keep = len(up) - node.level + (1 if self.path.endswith("__init__.py") else 0)
                base = ".".join([*up[: max(0, keep)], *([node.module] if node.module else [])])
            for a in node.names:
                if a.name != "*":
                    self.names[a.asname or a.name] = f"{base}.{a.name}" if base else a.name

    def _declare(self, node: ast.AST, cls: str) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "method" if cls else "func"
            key = f"method|{self.module}|{cls}|{node.name}" if cls else f"func|{self.module}|{node.name}"
            word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            self._symbol(node, key, cls, kind, f"{word} {node.name}({ast.unparse(node.args)}){returns}")
        elif isinstance(node, ast.ClassDef) and not cls:
            bases = ", ".join(ast.unparse(b) for b in node.bases)
            self._symbol(node, f"class|{self.module}|{node.name}", "", "class", f"class {node.name}({bases})" if bases else f"class {node.name}")
            for child in node.body:
                self._declare(child, node.name)

    def _symbol(self, node: ast.AST, key: str, cls: str, kind: str, signature: str) -> None:
        qname = ".".join(x for x in (self.module, cls, node.name) if x)
        self.symbols.append((key, qname, self.package, self.path, node.name, kind, cls, signature, ast.get_docstring(node) or "", node.lineno, node.col_offset + 1, not node.name.startswith("_"), self.is_test))

    def visit_body(self, tree: ast.Module) -> None:
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                for child in node.body:
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        self._within(child, f"method|{self.module}|{node.name}|{child.name}", node.name)
                    else:
                        self._within(child, f"class|{self.module}|{node.name}", node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._within(node, f"func|{self.module}|{node.name}", "")
            else:
                self._within(node, "", "")

    def _within(self, node: ast.AST, owner: str, cls: str) -> None:
        self.owner, self.cls = owner, cls
        self.visit(node)

    def _targets(self, node: ast.AST) -> list[str]:
        if isinstance(node, ast.Name):
            return [self.names[node.id]] if node.id in self.names else []
        if isinstance(node, ast.Attribute):
            if isinstance(node.value, ast.Name) and node.value.id in ("self", "cls") and self.cls:
                return [f"{self.module}.{self.cls}.{node.attr}"]
            return [f"{base}.{node.attr}" for base in self._targets(node.value)]
        return []

    def _use(self, node: ast.AST, form: str, targets: list[str]) -> None:
        if targets:
            self.uses.append((self.owner, self.package, self.path, node.lineno, node.col_offset + 1, form, targets))

    def visit_Call(self, node: ast.Call) -> None:
        self._use(node, "call", self._targets(node.func))
        for child in (*([] if isinstance(node.func, ast.Name) else [node.func]), *node.args, *node.keywords):
            self.visit(child)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self._use(node, "ref", self._targets(node))

    def visit_Attribute(self, node: ast.Attribute) -> None:
        targets = self._targets(node) if isinstance(node.ctx, ast.Load) else []
        self._use(node, "ref", targets)
        if not targets:
            self.visit(node.value)


def python_facts(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and uses of a Python file; one that can't be parsed has none."""
    try:
        tree = ast.parse(text.removeprefix("\ufeff"))
        base = path.rsplit("/", 1)[-1]
        found = _PythonFile(path, tree, base.startswith("test_") or base.endswith("_test.py") or base == "conftest.py" or "/tests/" in f"/{path}")
        return found.symbols, found.uses
    except (SyntaxError, ValueError, RecursionError):
        return [], []


_RUST_ITEM = re.compile(r"^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*(?P<word>fn|struct|enum|trait|type|impl)\b\s*(?:<[^>{]*>\s*)?(?P<name>[A-Za-z_]\w*)(?P<rest>[^{;\n]*)", re.M)
_RUST_FOR = re.compile(r"\bfor\s+(?:&\s*)?([A-Za-z_]\w*)")
_GO_ITEM = re.compile(r"^func\s+(?:\((?:\w+\s+)?(?P<recv>\*?\w+)(?:\[[^\]]*\])?\)\s*)?(?P<name>\w+)(?P<rest>[^{\n]*)|^type\s+(?P<type>\w+)\s+(?P<what>struct|interface|=\s*\S+|\S+)", re.M)
_CALL = re.compile(r"(?<![\w.:!])((?:[A-Za-z_]\w*(?:::|\.))*[A-Za-z_]\w*)\s*\(")
_STRIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'", re.S)
#: Words before a bracket that call nothing of the project (fixed values).
_RUST_WORDS = {"if", "for", "while", "match", "return", "fn", "loop", "let", "mut", "move", "in", "Some", "Ok", "Err", "Box"}
_GO_WORDS = {"if", "for", "switch", "return", "func", "range", "go", "defer", "select", "case", "append", "len", "cap", "make", "new", "panic", "copy", "delete", "close", "string", "int", "byte", "error"}


def _blank(text: str) -> str:
    return _STRIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _at(text: str, pos: int) -> tuple[int, int]:
    return text.count("\n", 0, pos) + 1, pos - text.rfind("\n", 0, pos)


def _doc_above(lines: list[str], line: int, mark: str) -> str:
    out, i = [], line - 2
    while i >= 0 and lines[i].strip().startswith(mark):
        out.append(lines[i].strip().lstrip("/").strip())
        i -= 1
    return "\n".join(reversed(out))


def _body_end(bare: str, start: int) -> int:
    opened = bare.find("{", start)
    if opened < 0:
        return start
    depth = 0
    for i in range(opened, len(bare)):
        depth += (bare[i] == "{") - (bare[i] == "}")
        if depth == 0:
            return i
    return len(bare)


def rust_scope(path: str, package: str) -> str:
    return package or re.sub(r"(?:^|/)(?:src|mod|lib|main)(?=/|$)", "", path.removesuffix(".rs")).strip("/").replace("/", "::")


def rust_facts(path: str, text: str, package: str) -> tuple[list[tuple], list[tuple]]:
    bare, lines, scope = _blank(text), text.split("\n"), rust_scope(path, package)
    symbols, uses, impls = [], [], []
    for m in _RUST_ITEM.finditer(bare):
        line, col = _at(bare, m.start("word"))
        if m["word"] == "impl":
            target = _RUST_FOR.search(m["rest"])
            impls.append((m.start(), _body_end(bare, m.start()), target[1] if target else m["name"]))
            continue
        owner = next((t for a, b, t in impls if a < m.start() < b), "")
        kind = "method" if owner and m["word"] == "fn" else {"fn": "func", "trait": "interface", "enum": "type"}.get(m["word"], m["word"])
        key = "::".join(x for x in (scope, owner if kind == "method" else "", m["name"]) if x)
        tested = "/tests/" in f"/{path}" or bool(re.search(r"#\[[^\]]*test", "\n".join(lines[max(0, line - 3) : line - 1])))
        symbols.append((key, key, scope, path, m["name"], kind, owner if kind == "method" else "", " ".join(text[m.start() : m.end()].split()), _doc_above(lines, line, "///"), line, col, bool(m["vis"]), tested))
        if m["word"] == "fn":
            end = _body_end(bare, m.end())
            for c in _CALL.finditer(bare, m.end(), end):
                parts = c[1].replace(".", "::").split("::")
                if parts[-1] not in _RUST_WORDS:
                    l, k = _at(bare, c.start(1))
                    tail = "::".join(parts[-2:]) if len(parts) > 1 and parts[0] not in ("self", "Self") else f"{owner}::{parts[-1]}" if parts[0] in ("self", "Self") else parts[-1]
                    uses.append((key, scope, path, l, k, "call", [f"{scope}::{tail}", "::".join(parts)]))
    return symbols, uses


def go_facts(path: str, text: str, package: str) -> tuple[list[tuple], list[tuple]]:
    bare, lines = _blank(text), text.split("\n")
    symbols, uses = [], []
    imports = {p.rsplit("/", 1)[-1]: p for p in re.findall(r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./\-]+)"\s*$', text, re.M)}
    for m in _GO_ITEM.finditer(bare):
        line, col = _at(bare, m.start())
        name = m["name"] or m["type"]
        recv = m["recv"] or ""
        if m["type"]:
            kind, key, qname = (m["what"] if m["what"] in ("struct", "interface") else "alias" if m["what"].startswith("=") else "type"), f"type|{package}|{name}", f"{package}.{name}"
        elif recv:
            bare_recv = recv.lstrip("*")
            kind, key, qname = "method", f"method|{package}|{package}.{bare_recv}|{'ptr' if recv.startswith('*') else 'val'}|{name}", f"{package}.({recv}).{name}"
        else:
            kind, key, qname = "func", f"func|{package}|{name}", f"{package}.{name}"
            if name == "init":
                key, qname = f"{key}|{path}|{line}|{col}", f"{qname}|{path}|{line}|{col}"
        symbols.append((key, qname, package, path, name, kind, recv, " ".join(text[m.start() : m.end()].split()), _doc_above(lines, line, "//"), line, col, name[:1].isupper(), path.endswith("_test.go")))
        if m["name"]:
            for c in _CALL.finditer(bare, m.end(), _body_end(bare, m.end())):
                parts = c[1].split(".")
                if parts[-1] in _GO_WORDS:
                    continue
                l, k = _at(bare, c.start(1))
                targets = [f"{package}.{parts[0]}"] if len(parts) == 1 else [f"{imports[parts[0]]}.{parts[1]}"] if len(parts) == 2 and parts[0] in imports else []
                if targets:
                    uses.append((key, package, path, l, k, "call", targets))
    return symbols, uses


def facts(path: str | None, text: str | None, package: str | None) -> tuple[list[tuple], list[tuple]]:
    """Symbols and uses of a file by its extension; other, null and empty files have none."""
    if not path or not text:
        return [], []
    text = text.replace("\r\n", "\n").replace("\x00", "")
    low = path.lower()
    if low.endswith(".py"):
        return python_facts(path, text)
    if low.endswith(".rs"):
        return rust_facts(path, text, package or "")
    return go_facts(path, text, package or path.rpartition("/")[0]) if path.endswith(".go") else ([], [])


def _pass(files: DataFrame, which: int, fields: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *row) for p, r, c, k in zip(batch["project"], batch["rel_path"], batch["content"], batch["package_import_path"]) for row in facts(r, c, k)[which]]
            yield pd.DataFrame(rows, columns=fields)

    return files.select("project", "rel_path", "content", "package_import_path").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files: project, rel_path, content, package_import_path in, fact rows out."""
    return _pass(files, 0, SYMBOL_FIELDS, _SYMBOLS)


def uses(files: DataFrame) -> DataFrame:
    return _pass(files, 1, USE_FIELDS, _USES)


def edges(found: DataFrame, used: DataFrame) -> DataFrame:
    """Uses resolved to symbols of the same project; of several candidates the first that exists wins."""
    names = found.groupBy("project", "qname").agg(F.min("symbol_key").alias("target_key"))
    asked = used.select("*", F.posexplode("candidates").alias("_n", "qname")).drop("candidates")
    hits = asked.join(names, ["project", "qname"])
    key = ["project", "owner_key", "package_import_path", "file_path", "line", "col", "form"]
    return hits.groupBy(*key).agg(F.min_by("target_key", "_n").alias("target_key"))


def link_tests(found: DataFrame) -> DataFrame:
    """Tests linked to symbols by name: within the package (medium, high for methods of a named class), else in the project (low)."""
    plain = F.lower(F.translate(F.regexp_replace("name", r"^(?:Test|Benchmark|Fuzz|test_?)", ""), "_-", ""))
    tests = found.where("is_test AND kind IN ('func', 'method')").select("project", "symbol_key", "package_import_path", plain.alias("_name")).where("_name <> ''").withColumnRenamed("symbol_key", "test_key")
    targets = found.where("NOT is_test").select("project", F.col("symbol_key"), F.col("package_import_path").alias("_package"), "receiver", F.lower(F.translate("name", "_-", "")).alias("_name"))
    both = tests.join(targets, ["project", "_name"])
    same = F.col("package_import_path") == F.col("_package")
    near = both.where(same).select("project", "test_key", "symbol_key", F.when(F.col("receiver") != "", "receiver_match").otherwise("name_match").alias("link_kind"), F.when(F.col("receiver") != "", "high").otherwise("medium").alias("confidence"))
    far = both.where(~same).join(near.select("project", "test_key").distinct(), ["project", "test_key"], "left_anti")
    return near.unionAll(far.select("project", "test_key", "symbol_key", F.lit("global_name_match").alias("link_kind"), F.lit("low").alias("confidence"))).distinct()
