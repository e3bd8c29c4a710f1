"""Generated, minified, vendored and data-only source files.

Every file is judged on its whole text in one pass:

* *generated*: a notice of generation at the start of a comment in the file's
  header or in its closing comment lines, found by a multi-pattern automaton;
  or a body that repeats one block from its beginning to its end, as only
  generators write.  Quoted notices, and notices inside a sentence, are talk
  about generation.
* *minified*: text whose bulk has no line structure a person would write: very
  long lines, or short identifiers packed almost without white space, as far as
  the number of words proves it.  A minified suffix lowers the bar.
* *data*: no statements, nearly all literals.
* *vendored*: a path rule for directories of third-party code or a lockfile; an
  attribution in the header to, or an import of the internals of, a library that
  such paths anywhere in the corpus name; and files whose body equals that of a
  vendored file.

Scale: one pass over the texts in Arrow batches, without a shuffle of texts.
What is shuffled are one digest and the few library names of each file.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..workspace import spread, stage

# -- fixed values: notices, directories, suffixes ------------------------------

#: Beginnings of a generation notice, lower case; a pair needs both parts in one line.
GENERATED_NOTICES = [
    "code generated by", "@generated", "auto-generated", "autogenerated", "auto generated", "automatically generated", "automatically produced", "automatically written",
    "automatically created", "this file is automatically", "this file is generated", "this file was generated", "this file has been generated", "this file is auto-generated",
    "generated file", "generated code", "generated automatically", "generated from", "generated with", "generated using", "machine-made", "machine-generated", "machine generated",
    "do not edit", "created with", "produced by", "built by", "compiled from", "output of",
    # in other languages
    "automatisch erzeugt", "automatisch generiert", "generiert von", "generiert aus", "fichier produit automatiquement", "fichier généré", "généré automatiquement", "généré par",
    "generado de forma automática", "generado automáticamente", "archivo generado", "gerado automaticamente", "arquivo gerado", "generato automaticamente",
    "автоматически", "自动生成", "由工具生成", "此文件由", "自動生成", "このファイルは自動",
]
#: Beginnings that need one of ``EDIT_WARNINGS`` in the same comment line.
WEAK_NOTICES = ["generated by", "created with", "produced by", "built by", "compiled from", "output of", "do not edit", "end of"]
EDIT_WARNINGS = ["do not edit", "do not modify", "do not change", "by hand", "manual", "will be lost", "overwritten", "rerun", "regenerate", "instead of", "digest", "nicht bearbeiten", "ne pas modifier", "no editar", "não editar"]
#: Directories of third-party code.
VENDOR_DIRS = {"vendor", "vendors", "vendored", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "deps", "external", "externals", "contrib", "extern", "pods", "godeps"}
#: Those of them that also serve as ordinary directory names: they count only above a directory named like a known library.
AMBIGUOUS_DIRS = {"deps", "external", "externals", "contrib", "extern"}
LOCKFILES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "uv.lock"}
MINIFIED_NAME = regex.compile(r"[.\-_](?:min|prod|bundle|packed|dist)\.(?:js|mjs|cjs|css|py)$", regex.I)

# -- patterns -------------------------------------------------------------------

_COMMENT = regex.compile(r"^\s*(?://[/!]?|#(?!\[|!/|include|define|pragma)|/\*+!?|\*(?!/)|--|;;|<!--|\"{3}|'{3})\s?(.*?)\s*(?:\*/|-->)?\s*$")
_FRAME = regex.compile(r"^\s*(?:\*/|/\*+!?|\"{3}|'{3}|\*)?\s*$")
#: What a header says of whose work a file is; the library it names beside must be known from a vendored path.
_ATTRIBUTION = regex.compile(r"\b(?:copyright|licen[sc]e[ds]?|spdx|authors?|written|contributors|maintain(?:ers?|ed)|notice|part of|free to use|vendored|copied|forked|derived|adapted|taken|imported|bundled?|upstream)\b|©", regex.I)
_NAMES = regex.compile(r"[A-Za-z][\w.\-/@]*\w")
_INTERNAL_IMPORTS = [
    regex.compile(r"^\s*from ([A-Za-z]\w*)\._\w+ import ", regex.M),
    regex.compile(r"""require\(['"]((?:@[\w.\-]+/)?[A-Za-z][\w.\-]*)/(?:lib|src|dist|internal)/"""),
    regex.compile(r"""from ['"]((?:@[\w.\-]+/)?[A-Za-z][\w.\-]*)/(?:lib|src|dist|internal)/"""),
    regex.compile(r"^\s*use ([a-z]\w*)::\w+(?:::\w+)*::\*;", regex.M),
    regex.compile(r'^\s*(?:import )?(?:\w+ )?"[\w\-]+(?:\.[\w\-]+)+/([A-Za-z][\w.\-]*)/[\w./\-]+"', regex.M),
]
_PREAMBLE = regex.compile(r"""^\s*(?:package \w+|import\b.*|from \S+ import .*|use [\w:{}, *]+;|"[\w./\-]+"|[()]|(?:const|let|var) \{.*\} = require\(.*\);?|'use strict';?|"use strict";?)\s*$""")
_STATEMENT = regex.compile(r"\b(?:func|fn|def|function|class|return|if|for|while|switch|match|impl|interface|defer|raise|throw)\b|=>")
_LITERAL = regex.compile(r"""\"(?:\\.|[^"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*'|`[^`]*`|\b0[xX][0-9a-fA-F]+\b|-?\b\d[\d_.]*(?:[eE][-+]?\d+)?\b""", regex.S)
_WORD = regex.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"\w+")
#: Words that make the shape of a line; all others are names (fixed words of the languages).
_KEYWORDS = frozenset("func fn def return if else for while class struct impl pub let mut const var import from package use self nil null none true false int string bool type range in match defer and or not function new this".split())
#: Literals that make a table of data; fewer are constants.
FEWEST_LITERALS = 8
#: Longest block, fewest lines that repeat it, and the share of them that need not; one line before and one after may frame the blocks.
BLOCK, REPEATS, ODD_SHARE = 12, 7, 0.1


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text in {*GENERATED_NOTICES, *WEAK_NOTICES, *EDIT_WARNINGS}:
        found.add_word(text, text)
    found.make_automaton()
    return found


def _is_notice(comment: str) -> bool:
    """Whether the text of a comment line begins with a generation notice (after 'name: ', if it has one)."""
    low = comment.lower()
    hits = [(end - len(text) + 1, text) for end, text in _automaton().iter(low)]
    if not hits:
        return False
    begin = 0
    label = regex.match(r"[\w.\-/]{1,80}: +", low)
    starts = {begin, label.end() if label else begin}
    texts = {t for _, t in hits}
    for at, text in hits:
        opening = low[:at].strip(" *#-=!<([{")
        if at in starts or opening == "" or regex.fullmatch(r"(?:this|the)? ?(?:file|code|source|module)? ?(?:is|was|has been|:)?", opening):
            if text not in WEAK_NOTICES or any(w in texts and w != text for w in EDIT_WARNINGS):
                return True
    return False


def header_and_footer(lines: list[str]) -> list[str]:
    """The texts of the comment lines before the first line of code, and of those after the last."""
    head, foot = [], []
    for out, walk in ((head, lines), (foot, reversed(lines))):
        for line in walk:
            if not line.strip() or _FRAME.match(line):
                continue
            comment = _COMMENT.match(line)
            if not comment:
                break
            out.append(comment.group(1))
    return head + foot


def _shape(line: str) -> str:
    return _TOKEN.sub(lambda m: m[0] if m[0] in _KEYWORDS else "0" if m[0][0].isdigit() else "x", line.strip())


def repeats_a_block(code: list[str]) -> bool:
    """Whether nearly every line has the shape of the line one block before, from the beginning to the end."""
    shapes = [_shape(x) for x in code]
    for k in range(1, BLOCK + 1):
        same = list(map(str.__eq__, shapes, shapes[k:]))
        if same and not same[0]:
            same = same[1:]
        if same and not same[-1]:
            same = same[:-1]
        if sum(same) >= max(REPEATS, 2 * k) and len(same) - sum(same) <= ODD_SHARE * len(same):
            return True
    return False


def _surely(share: float, n: int, above: float) -> bool:
    """Whether a share seen in ``n`` cases lies above a bound by two standard errors."""
    return n > 0 and share - 2 * math.sqrt(max(share * (1 - share), 1 / n) / n) > above


def is_minified(name: str, code: list[str], text: str, bare: str) -> bool:
    """``code``: the lines without comments, ``text`` all of them, ``bare`` without literals."""
    if not bare or len(bare) < 0.5 * len(text):
        return False  # literals, not code
    named = bool(MINIFIED_NAME.search(name))
    blank = 1 - sum(map(len, bare.split())) / len(bare)
    long = sum(len(x) for x in code if len(x) > 250) / sum(map(len, code))
    if name.endswith(".css"):
        return blank < 0.08 and (long > 0.5 or named and _surely(1 - blank, len(bare), 0.92))
    words = _WORD.findall(bare) if blank < 0.12 else []
    short = sum(len(w) <= 2 for w in words) / max(1, len(words))
    return _surely(1 - blank, len(bare), 0.88) and _surely(short, len(words), 0.4 if not named else 0.3) or (long > 0.6 and blank < (0.2 if named else 0.15))


def is_data(body: str, bare: str) -> bool:
    """``body``: the text without comments, imports and blank lines, ``bare`` without literals: no statement, and mostly literals that are many or nearly all."""
    rest, whole = len("".join(bare.split())), len("".join(body.split()))
    # continued string literals keep their text on lines of their own
    if not whole or rest >= 0.5 * whole or _STATEMENT.search(bare):
        return False
    return rest < 0.1 * whole or len(_LITERAL.findall(body)) >= FEWEST_LITERALS


def library_name(name: str) -> str:
    return regex.sub(r"[-_.]", "", name.lower().split("/")[-1])


def vendored_path(path: str) -> tuple[bool, str | None, str | None]:
    """(certainly vendored, library named by the path, directory name to hold against known libraries)."""
    parts = path.lower().replace("\\", "/").split("/")
    if parts[-1] in LOCKFILES:
        return True, None, None
    dirs = parts[:-1]
    under = [i for i, d in enumerate(dirs) if d in VENDOR_DIRS]
    parent = library_name(dirs[-1]) if dirs else None
    if not under:
        return False, None, parent
    rest = [d for d in dirs[under[-1] + 1 :] if "." not in d and not d.startswith("@")]
    sure = any(dirs[i] not in AMBIGUOUS_DIRS for i in under)
    return sure, library_name(rest[0]) if rest and sure else None, library_name(rest[0]) if rest else parent


def attributed(comments: list[str], project: str | None) -> list[str]:
    """Names in header lines that say whose work the file is, other than the project's own."""
    own = library_name(project or "")
    return sorted({library_name(x) for c in comments if _ATTRIBUTION.search(c) for x in _NAMES.findall(c)} - {own, ""})


def internal_imports(text: str, project: str | None) -> list[str]:
    own = library_name(project or "")
    return sorted({library_name(x) for p in _INTERNAL_IMPORTS for x in p.findall(text)} - {own, ""})


#: A body shorter than this may equal another one by chance.
TELLING_BODY = 200


def body_digest(code: list[str]) -> str | None:
    """A digest of the code without comments and blanks; None for a body too short to tell anything."""
    text = "\n".join(code)
    return hashlib.sha256(text.encode()).hexdigest() if len(text) >= TELLING_BODY else None


def inspect(project: str | None, path: str | None, content: str | None) -> tuple:
    """(generated, minified, data, vendored, library named by the path, libraries to look up, directory, digest)."""
    path = path or ""
    vendored, named, directory = vendored_path(path)
    if content is None:
        return False, False, False, False, [], [], None, None
    lines = content.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    comments = header_and_footer(lines)
    code = [x for x in lines if not _COMMENT.match(x)]
    text = "\n".join(code)
    bare = _LITERAL.sub("", text)
    full = [x for x in code if x.strip()]
    body = [x for x in full if not _PREAMBLE.match(x)]
    own = "\n".join(body)
    data = is_data(own, _LITERAL.sub("", own))
    generated = any(map(_is_notice, comments)) or not data and repeats_a_block(body)  # tables repeat their rows, too
    return (
        generated, is_minified(path.lower().rsplit("/", 1)[-1], code, text, bare), data, vendored,
        [named] if named else [], sorted({*attributed(comments, project), *internal_imports("\n".join(lines), project)}), directory, body_digest([x.strip() for x in full]),
    )


_SCHEMA = (
    "project string, rel_path string, generated boolean, minified boolean, data boolean, vendored boolean,"
    " named array<string>, lookups array<string>, directory string, digest string"
)


def _inspected(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, r, *inspect(p, r, c)) for p, r, c in zip(batch["project"], batch["rel_path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["project", "rel_path", "generated", "minified", "data", "vendored", "named", "lookups", "directory", "digest"])

    return spread(files.select("project", "rel_path", "content")).mapInPandas(run, _SCHEMA)


def code_origin(files: DataFrame) -> DataFrame:
    """One row per file row: project, rel_path and the flags generated, minified, data, vendored.

    ``files``: project, rel_path, content; other columns are ignored.  A null
    content has no flag at all; an empty one can still be vendored by its path.
    A null path is judged by content alone.  Repeated rows give repeated rows.
    """
    seen = stage(_inspected(files), "code-origin")
    known = seen.select(F.explode("named").alias("_lib")).where("_lib <> ''").distinct()
    # a directory named like a known library counts where the file also points to a library
    asked = F.array_union("lookups", F.when(F.col("directory").isNotNull() & (F.size("lookups") > 0), F.array("directory")).otherwise(F.array().cast("array<string>")))
    keys = ["project", "rel_path", "digest"]
    by_library = seen.where("NOT vendored").select(*keys, F.explode(asked).alias("_lib")).join(known, "_lib", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = (F.col("project").eqNullSafe(F.col("_project"))) & (F.col("rel_path").eqNullSafe(F.col("_rel_path"))) & (F.col("digest").eqNullSafe(F.col("_digest")))
    first = seen.join(by_library.withColumn("_known", F.lit(True)), same, "left").withColumn("vendored", F.col("vendored") | F.coalesce("_known", F.lit(False)))
    out = ["project", "rel_path", "generated", "minified", "data"]
    bodies = first.where("vendored AND digest IS NOT NULL AND NOT generated AND NOT data AND NOT minified").select("digest").distinct().withColumn("_copy", F.lit(True))
    # bodies too short for a digest are no copies and stay out of the join
    told = first.where("digest IS NOT NULL").join(bodies, "digest", "left").select(*out, (F.col("vendored") | F.coalesce("_copy", F.lit(False))).alias("vendored"))
    return told.unionAll(first.where("digest IS NULL").select(*out, "vendored"))


def found_files(files: DataFrame) -> DataFrame:
    """Distinct (project, rel_path) of files that are not hand-written."""
    return code_origin(files).where("generated OR minified OR data OR vendored").select("project", "rel_path").distinct()


def kept_files(files: DataFrame, options: DataFrame) -> DataFrame:
    """Distinct (project, rel_path) that remain under each project's options.

    ``options``: project, include_generated, include_minified; a null or a
    missing project counts as false.  Vendored files and data never remain.
    """
    flags = code_origin(files).groupBy("project", "rel_path").agg(*[F.max(c).alias(c) for c in ("generated", "minified", "data", "vendored")])
    wishes = options.groupBy("project").agg(F.max(F.coalesce("include_generated", F.lit(False))).alias("_g"), F.max(F.coalesce("include_minified", F.lit(False))).alias("_m"))
    joined = flags.join(wishes, "project", "left")
    allowed = (~F.col("generated") | F.coalesce("_g", F.lit(False))) & (~F.col("minified") | F.coalesce("_m", F.lit(False)))
    return joined.where(allowed & ~F.col("data") & ~F.col("vendored")).select("project", "rel_path")
