"""Functions and methods paired with their documentation.

Source text is captured by one pattern with recursive parts: a documentation
comment (nested block comments and strings protected), the signature with
balanced brackets, and the balanced body.  Facts that come as separate doc and
signature columns are put together to such a unit and captured by the same
pattern.  Captures whose documentation tells no more than name and signature
do are dropped: restatements, stand-ins for text not yet written, messages to
tools, and what is no text at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..tables import present, valid_rows
from ..workspace import spread, stage

# -- capture --------------------------------------------------------------------

_DEFINES = r"""
(?(DEFINE)
  (?P<str>"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n]){1,12}+'|`[^`]*+`)
  (?P<line>(?://|\#(?!\[))[^\n]*+)
  (?P<block>/\*(?:[^*/]++|\*(?!/)|/(?!\*)|(?&block))*+(?:\*/|\Z))
  (?P<triple>[rRuUbBfF]{0,2}(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+(?:\"{3}|\Z)|'{3}(?:[^'\\]++|\\.|'(?!''))*+(?:'{3}|\Z)))
  (?P<paren>\((?:[^()"'`/\#]++|(?&str)|(?&block)|(?&line)|(?&paren)|["'`/\#])*+\))
  (?P<square>\[(?:[^\[\]"'`]++|(?&str)|(?&square)|["'`])*+\])
  (?P<brace>\{(?:[^{}"'`/\#]++|(?&str)|(?&block)|(?&line)|(?&brace)|["'`/\#])*+\})
  (?P<comment>(?:(?&block)|(?&line)|(?&triple))(?:[ \t]*\n[ \t]*(?:(?&block)|(?&line)))*+)
  (?P<attr>(?:\#!?\[[^\]\n]*+\]|@[\w.]+(?&paren)?+)[ \t]*\n)
)"""
_FLAGS = regex.X | regex.M | regex.S
#: A brace language's function: comment, signature, body.
_BRACED = regex.compile(
    _DEFINES + r"""
    (?:^[ \t]*(?P<doc>(?&comment))[ \t]*\n(?:[ \t]*(?&attr))*+)?
    ^[ \t]*(?P<sig>
      func[ \t]+(?:(?&paren)[ \t]*)?(?P<name>\w++)(?:(?&square))?(?&paren)[^\n{]*+
      |(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:default[ \t]+|const[ \t]+|async[ \t]+|unsafe[ \t]+|extern[ \t]+(?:"[^"\n]*"[ \t]+)?)*+fn[ \t]+(?P<name>\w++)(?:<[^({\n]*>)?(?&paren)[^{;]*+
      |(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]++)[ \t]*(?&paren)[ \t]*
      |(?:(?:export[ \t]+)?(?:const|let|var)[ \t]+|(?:[\w$]++\.)++)(?P<name>[\w$]++)[ \t]*(?::[^=\n]++)?=[ \t]*(?:async[ \t]+)?
        (?:function[ \t]*\*?[ \t]*(?:[\w$]++[ \t]*)?(?&paren)|(?:(?&paren)(?:[ \t]*:[^=\n{]++)?|[\w$]++)[ \t]*=>)[ \t]*
    )(?P<body>(?&brace)|(?<==>[ \t]*)[^\s{][^\n]*)""",
    _FLAGS,
)
#: A Python function: signature, docstring, indented body.
_INDENTED = regex.compile(
    _DEFINES + r"""
    ^(?P<indent>[ \t]*)(?P<sig>(?:async[ \t]+)?def[ \t]+(?P<name>\w++)[ \t]*(?:(?&square))?(?&paren)[^:\n]*+):[ \t]*(?:\#[^\n]*)?\n
    (?:(?P=indent)[ \t]+(?P<doc>(?&triple))[ \t]*(?:\n|\Z))?
    (?P<body>(?:(?P=indent)[ \t]+[^\n]*(?:\n|\Z)|[ \t]*\n)*)""",
    _FLAGS,
)
#: A unit made of a doc and a signature.
_UNIT = regex.compile(_DEFINES + r"\A\s*(?P<doc>(?&comment))\s*\n(?P<sig>[^\n(]*+(?:(?:(?&paren)|[^\n(]++)*+).*)\Z", _FLAGS)
_PY_DEF = regex.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]", regex.M)


#: The pattern of a file by its extension.
_PATTERNS = {".py": _INDENTED, ".pyi": _INDENTED} | dict.fromkeys((".go", ".rs", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"), _BRACED)


def _captures(pattern: regex.Pattern, text: str) -> list[regex.Match]:
    found, at = [], 0
    while m := pattern.search(text, at):
        found.append(m)
        at = m.start("body")  # functions within functions are found too
    return found


def extract(text: str | None, path: str | None = None) -> list[tuple[str, str, str | None]]:
    """(name, signature, raw documentation) of every function in a source text; null and empty texts have none.

    The extension of ``path`` names the pattern; the other one is used where it
    finds nothing, as names mislead.  Without a known extension both are used,
    the Python one outside what the other has captured.
    """
    if not text:
        return []
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    known = _PATTERNS.get(regex.search(r"(?:\.[^./]*)?\Z", path or "")[0].lower())
    found = _captures(known or _BRACED, text)
    if known is _INDENTED and not found:
        found = _captures(_BRACED, text)
    elif known is not _INDENTED and not (known and found) and _PY_DEF.search(text):
        taken = [m.span() for m in found]
        found += [m for m in _captures(_INDENTED, text) if not any(a < m.end() and m.start() < b for a, b in taken)]
        found.sort(key=lambda m: m.start())
    return [(m["name"], " ".join(m["sig"].split()), m["doc"]) for m in found]


_HAS_MARKER = regex.compile(r"\A\s*(?://|/\*|#(?!\w*\[)|[rRuUbBfF]{0,2}(?:\"{3}|'{3}))")


def unit(doc: str, signature: str) -> tuple[str, str] | None:
    """The documentation and signature of a fact, captured as if they stood in a source file."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    if not _HAS_MARKER.match(doc):
        doc = "\n".join("// " + line for line in doc.strip("\n").split("\n"))
    m = _UNIT.match(f"{doc.strip()}\n{signature}")
    if m is None:  # markers that are never closed, or text after them: every line is documentation
        doc = "\n".join("// " + line for line in doc.strip("\n").split("\n"))
        m = _UNIT.match(f"{doc}\n{signature}")
    return (m["doc"], m["sig"]) if m else None


# -- plain text of a documentation comment ---------------------------------------

_OPEN = regex.compile(r"\A(?:/\*+!?|[rRuUbBfF]{0,2}(?:\"{3}|'{3})|<!--)")
_CLOSE = regex.compile(r"(?:\*+/|\"{3}|'{3}|-->)\Z")
_LINE = regex.compile(r"^[ \t]*(?:(?://[/!]?|#+!?(?!\w)|#(?!\[)|\*(?!\*)|--|;+|%+)[ \t]*)+", regex.M)


def plain(doc: str) -> str:
    """The text inside any comment markers, also nested ones."""
    text = doc.strip()
    for _ in range(6):
        before = text
        text = _LINE.sub("", text).strip()
        text = _CLOSE.sub("", _OPEN.sub("", text).strip()).strip()
        if text == before:
            break
    return text


# -- what tells nothing: fixed words ---------------------------------------------

#: Marks of text that is still to be written.
UNWRITTEN = regex.compile(r"^\W*(?:todo|fixme|xxx|tbd|tba|wip|hack|placeholder)\b|^\W*(?:todo|fixme)\s*\(", regex.I)
#: Messages to tools, by their beginning.
TOOLS = regex.compile(
    r"^(?:go:\w+|\+build\b|nolint\b|lint:|noqa\b|type:\s*ignore|pylint:|pyright:|mypy:|flake8:|ruff:|isort:|fmt:|yapf:|black:|coverage:|pragma:?\s|rustfmt::|clippy::|allow\(|cfg\(|derive\("
    r"|eslint|tslint|jshint|jslint|prettier-|istanbul|c8 ignore|@ts-|ts-|@flow\b|@generated\b|cspell|sonar|nosonar|nosec|bandit:|swagger:|swag:|@internal\b|@private\b|@hidden\b|@ignore\b|region\b|endregion\b"
    r"|vim:|ex:|-\*-|export \w+$|line \S+:\d+|cgo\b|codecov|deepsource|semgrep|safety:|skipcq|gocover|gofumpt|golangci|revive:|staticcheck|wire:|kubebuilder|\+k8s|\+kubebuilder)",
    regex.I,
)
#: Whole texts (in lower case, without closing punctuation) that stand in for documentation.
STOCK = {
    "deprecated", "experimental", "internal", "internal use only", "for internal use only", "for internal use", "private", "public", "utility", "utilities", "helper", "private helper", "internal helper", "helper function", "helper method", "utility function",
    "utility method", "constructor", "destructor", "getter", "setter", "method", "function", "a function", "a method", "this is a function", "this is a method", "the function", "the method", "main function", "main method", "class method", "static method", "doc", "docs", "documentation",
    "describe me", "add your docstring here", "add docstring here", "add docstring", "docstring", "insert description here", "description", "no description", "add description", "add description here", "your description here", "write me", "document me", "missing documentation",
    "auto-generated stub", "auto generated stub", "generated method stub", "auto-generated method stub", "generated stub", "stub", "not documented", "undocumented", "no docs yet", "no docs", "no documentation", "no documentation available", "no doc", "none", "null", "nil", "n/a", "na", "not available", "see above",
    "see below", "see there", "ditto", "as above", "same as above", "same", "idem", "self-explanatory", "self explanatory", "obvious", "nothing", "empty", "unused", "legacy", "temporary", "tmp", "temp", "foo", "test", "example", "later", "coming soon", "to be written", "to be done",
    "to be documented", "to be defined", "to be determined", "to be added", "needs documentation", "needs docs", "fill me in", "fill in", "lorem ipsum", "override", "overrides", "inherit", "inherited", "inheritdoc", "implements interface", "do not use", "unknown", "misc",
    # in other languages
    "待补充", "待填", "待定", "待写", "待完善", "待办", "暂无", "暂无说明", "暂无描述", "无", "无说明", "无描述", "没有说明", "说明", "描述", "未记录", "未完成", "同上", "见上", "函数", "方法", "这是一个函数", "辅助函数", "工具函数", "构造函数", "内部使用", "已弃用", "已废弃", "补充说明",
    "未記載", "未記入", "未記述", "未作成", "未定", "未実装", "説明なし", "説明", "なし", "後で書く", "あとで書く", "準備中", "同上", "関数", "メソッド", "これは関数です", "ヘルパー関数", "ヘルパー", "コンストラクタ", "内部用", "非推奨", "要説明", "ドキュメントなし", "記載なし", "後日追記",
    "sin documentar", "sin documentación", "sin descripción", "sin comentarios", "por documentar", "por hacer", "por completar", "por definir", "pendiente", "pendiente de documentar", "falta documentar", "falta documentación", "descripción pendiente", "ver arriba", "véase arriba", "función", "método", "una función", "función auxiliar", "constructor", "obsoleto", "en desuso", "uso interno", "ninguno", "ninguna",
    "à compléter", "a compléter", "à faire", "à documenter", "à définir", "à rédiger", "non documenté", "non documentée", "pas de documentation", "pas de description", "sans description", "aucune description", "aucune documentation", "voir ci-dessus", "voir plus haut", "description à venir", "fonction", "méthode", "une fonction", "fonction utilitaire", "fonction auxiliaire", "constructeur", "obsolète", "déprécié", "usage interne", "néant", "rien",
    "noch zu dokumentieren", "noch zu beschreiben", "zu dokumentieren", "zu ergänzen", "noch nicht dokumentiert", "nicht dokumentiert", "undokumentiert", "keine beschreibung", "keine dokumentation", "ohne beschreibung", "beschreibung folgt", "beschreibung fehlt", "doku folgt", "dokumentation folgt", "doku fehlt", "kommt noch", "folgt", "folgt noch", "siehe oben", "s. o", "s.o", "funktion", "methode", "eine funktion", "hilfsfunktion", "hilfsmethode", "konstruktor", "veraltet", "intern", "nur intern", "keine", "platzhalter",
    "a documentar", "por documentar", "a fazer", "a completar", "a definir", "a preencher", "preencher", "sem documentação", "sem descrição", "não documentado", "não documentada", "pendente", "falta documentar", "descrição pendente", "documentação pendente", "ver acima", "veja acima", "função", "uma função", "método", "função auxiliar", "construtor", "obsoleto", "obsoleta", "uso interno", "nenhum", "nenhuma", "em breve",
    "не документировано", "без описания", "нет описания", "описание отсутствует", "дописать", "добавить описание", "см. выше", "функция", "метод", "вспомогательная функция", "устарело", "문서 없음", "설명 없음", "추가 예정", "함수", "da documentare", "da completare", "da fare", "non documentato", "senza descrizione", "vedi sopra", "funzione", "metodo",
}
#: Words that add nothing to a name.
FILLER = set(
    "a an the this that these those it its is are was be being been do does did done of for to in on at by with from into and or as per via given specified provided passed new any some all each every one"
    " method methods function functions func fn def procedure routine subroutine helper utility constructor getter setter accessor member property field attribute class struct type object instance interface value values"
    " parameter parameters param params arg args argument arguments input inputs output outputs result results return returns returned returning yields yield error errors err exception"
    " implements implement implementation implementing wrapper wrap wraps call calls called invoke invokes perform performs performing execute executes run runs handle handles handling"
    " self cls receiver here there simply just only which when".split()
)
#: The same in the other languages of the corpus.
FILLER |= set(
    "die der das den dem des ein eine einen einer eines einem und oder von für mit zu im in aus auf methode funktion hilfsfunktion gibt zurück wert werte"
    " le la les l un une des du de d et ou pour avec dans sur par à au aux méthode fonction renvoie retourne valeur"
    " el los las una unos unas y o del al para con en por método función devuelve retorna valor o os as um uma uns umas e do da dos das no na nos nas ao função retorna devolve"
    " 的 了 是 一个 该 这 这个 此 函数 方法 返回 の を は が に で と 関数 メソッド です ます する 返す 返します".split()
)
_TAG = regex.compile(r"^\s*(?:@|:|\\)?(?:params?|arguments?|args?|parameters|returns?|raises?|throws?|yields?|rtype|type|exception|errors?|see|since|author|version|inheritdoc|override|deprecated)\b", regex.I)
_PARTS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{N}+|\p{Lo}+")
_CODE_LINE = regex.compile(
    r"^\s*(?:\w+(?:, \w+)*\s*:?=\s*[\w.]+\(.*\)?;?$|(?:return|break|continue|pass|else|if|for|while|let|const|var|fn|func|def|import|use|package|defer|raise|throw|try|except|end|match|case|switch)\b.*[;{}():=]\s*$"
    r"|return(?:\s+[\w.\"'&*()\[\]]+(?:,\s*[\w.\"'&*()\[\]]+)*)?;?$|[\w.\[\]]+\(.*\);?$|[\w.\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S.*$|[{}()\[\];]+$|(?:log|print|console|fmt)\.\w+\(.*|\w+\s*(?:\+\+|--);?$|break;?$|continue;?$|pass$"
    r"|(?:pub(?:\([^)]*\))?\s+|async\s+|export\s+|unsafe\s+|default\s+)*(?:func|def|fn|function)\s+(?:\(.*?\)\s*)?\w+.*\(.*$|\w+\s*:$"
    r"|(?:let|const|var)\s+(?:mut\s+)?\w+.*[=;].*$|(?:if|for|while|match|switch)\b.*[{:]\s*$|\}\s*else\s*\{?$|[\w.]+\s*(?:==|!=|<=|>=)\s*[\w.]+$)"
)


@lru_cache(100_000)
def _stem(word: str) -> str:
    for tail, put in (("ies", "y"), ("sses", "ss"), ("ing", ""), ("edly", ""), ("ed", ""), ("ers", ""), ("er", ""), ("es", ""), ("s", ""), ("e", ""), ("y", "")):
        if word.endswith(tail) and len(word) - len(tail) >= 3:
            word = word[: len(word) - len(tail)] + put
            break
    word = word[:-1] if len(word) > 3 and word.endswith("e") else word
    return word[:-1] if len(word) > 3 and word[-1] == word[-2:-1] else word


def _words(text: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(text)]


def _near(word: str, told: set[str]) -> bool:
    stem = _stem(word)
    return word in told or stem in told or (len(stem) >= 4 and any(t.startswith(stem[: max(4, len(stem) - 1)]) and abs(len(t) - len(stem)) <= 2 for t in told))


#: An entry about a parameter or a result: a tag or not, its name, its type, and what is said about it.
_ENTRY = regex.compile(r"^(?:[@:\\](?:params?|arguments?|args?|returns?|raises?|throws?|yields?|type)\b:?\s*)?(?:\{[^}]*\}\s*)?(?P<name>[*&$]*[\w.\[\]]+)(?P<type>\s*\([^)]*\))?(?P<colon>\s*[:\-]+)?(?:\s+(?P<text>.*))?$", regex.I)
_SECTION = regex.compile(r"^[@:\\]?(?:args|arguments|parameters|params|returns?|raises?|throws?|yields?)\s*:?$", regex.I)


def _adds(line: str, told: set[str]) -> list[str]:
    """The words of a line that neither the name and signature nor, in an entry about a parameter, its own name tell."""
    if _SECTION.match(line):
        return []
    entry = _ENTRY.match(line)
    if entry and (_TAG.match(line) or entry["type"] and entry["colon"]):
        own = _words(entry["name"])
        told = {*told, *own, *map(_stem, own)}
        line = entry["text"] or ""
        if _TAG.match(entry["name"]) and not entry["colon"]:  # a bare "@return the result"
            told = told | {"result", "value"}
    return [w for w in _words(line) if w not in FILLER and not _near(w, told)]


def reading(doc: str, name: str, signature: str, receiver: str = "") -> tuple[bool, bool, list[str]]:
    """What a documentation text says: (more than name and signature, all of the name again in other form, the words it adds in order)."""
    text = plain(doc)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if regex.search(r"[\p{L}\p{N}]", x)]  # rules, frames and bare marks are no text
    if not lines or UNWRITTEN.match(" ".join(lines)):
        return False, False, []
    told_words = {*_words(name), *_words(signature), *_words(receiver)}
    told = {*told_words, *map(_stem, told_words)}
    whole = {name.lower(), (receiver or "").strip("*&").lower()}
    left, added = [], []
    for line in lines:
        line = plain(line)
        if TOOLS.match(line) or UNWRITTEN.match(line):
            continue
        bare = regex.sub(r"^[\s\W_]+|[\s\W_]+$", "", line).lower()
        if bare in STOCK or bare in whole or regex.sub(r"\W+", "", bare) == regex.sub(r"\W+", "", signature.lower()):
            continue
        if _CODE_LINE.match(line) and not regex.search(r"[.!?]$", line):
            continue
        if words := _adds(line, told):
            left.append(line)
            added += words
    joined = regex.sub(r"^[\s\W_]+|[\s\W_]+$", "", " ".join(left)).lower()
    if not left or joined in STOCK or all(w.isdigit() for w in added):
        return False, False, []
    said = _words(regex.sub(rf"(?<!\w){regex.escape(name)}(?!\w)", " ", text)) if name else []
    forms = {*said, *map(_stem, said)}
    again = bool(name) and all(_near(w, forms) for w in _words(name))
    return True, again, added


def tells_something(doc: str, name: str, signature: str, receiver: str = "") -> bool:
    """Whether a documentation text says more than the name and the signature, as far as it tells by itself."""
    return reading(doc, name, signature, receiver)[0]


# -- operators --------------------------------------------------------------------


#: What at least so many documentations say, of which at least this share say the name again, belongs to saying it.
FRAME_DOCS, FRAME_SHARE = 5, 0.9


def phrases(words: list[str]) -> tuple[list[str], list[str]]:
    """What a documentation adds: all its words and pairs of neighbouring words, and the parts of it that tell (a single word, or pairs)."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return sorted({*words, *pairs}), sorted(set(pairs or words))


def without_restatements(read: DataFrame) -> DataFrame:
    """Drops the pairs that say their name again and add only what goes with doing so ("is a helper named ..., as its name says").

    Such phrases are learnt, not listed: of the documentations that use one,
    nearly all say the whole name again.  What tells something is used under
    names that it doesn't repeat, too.  ``read``: symbol_key, kind, signature,
    doc, again, phrases, parts.
    """
    keys = ["symbol_key", "kind", "signature", "doc"]
    used = read.select("again", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("docs"), F.count_if("again").alias("again"))
    frame = used.where((F.col("docs") >= FRAME_DOCS) & (F.col("again") >= FRAME_SHARE * F.col("docs"))).select("phrase")
    suspects = read.where("again").select(*keys, F.explode("parts").alias("phrase")).distinct()
    telling = suspects.join(frame, "phrase", "left_anti").select(*keys).distinct()
    return read.where("NOT again").select(*keys).unionAll(read.where("again").select(*keys).join(telling, keys, "left_semi"))


def documented(symbols: DataFrame) -> DataFrame:
    """Pairs of signature and documentation of function and method facts.

    ``symbols``: symbol_key, name, kind, receiver, signature, doc; of other
    kinds, with an empty signature or a doc that tells nothing, rows are
    dropped, as are null docs.  Other columns are ignored; repeated rows give
    repeated pairs.  ``doc`` comes out as plain text without its markers.
    """
    rows = symbols.where(F.col("kind").isin("func", "method") & present("signature") & present("doc")).select("symbol_key", "name", "kind", "receiver", "signature", "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, kind, receiver, signature, doc in batch.itertuples(index=False):
                captured = unit(doc, signature)
                if captured:
                    tells, again, words = reading(captured[0], name or "", captured[1], receiver or "")
                    if tells:
                        out.append((key, kind, signature, plain(captured[0]), again, *phrases(words)))
            yield pd.DataFrame(out, columns=["symbol_key", "kind", "signature", "doc", "again", "phrases", "parts"])

    schema = "symbol_key string, kind string, signature string, doc string, again boolean, phrases array<string>, parts array<string>"
    return without_restatements(stage(rows.mapInPandas(run, schema), "doc-pairs"))


def latest_pairs(symbols: DataFrame, snapshot_id: int | None) -> DataFrame:
    """The documented functions of one snapshot, each key in the form delivered last."""
    mine = symbols.where(F.col("snapshot_id") == F.lit(snapshot_id)).select("snapshot_id", "symbol_key", "name", "kind", "receiver", "signature", "doc", "loaded_at")
    return documented(valid_rows(mine, ("snapshot_id", "symbol_key")))


def source_pairs(files: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Pairs captured from source texts: the key columns, name, signature and doc.

    Functions without documentation, or with one that tells nothing, are
    dropped.  Null and empty texts have no functions; a text is always captured
    as a whole.
    """
    path = F.col("rel_path") if "rel_path" in files.columns else F.lit(None).cast("string")
    table = spread(files.where(present(text)).select(*keys, path.alias("_path"), F.col(text).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name not in ("_path", "_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for name, signature, doc in extract(row[-1], row[-2]):
                    if doc and tells_something(doc, name, signature):
                        out.append((*row[:-2], name, signature, plain(doc)))
            yield pd.DataFrame(out, columns=[*keys, "name", "signature", "doc"])

    return table.mapInPandas(run, f"{fields}, name string, signature string, doc string")
