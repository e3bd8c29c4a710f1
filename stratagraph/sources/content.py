"""What the text of a file tells about it: binary, generated, minified, artifact, lines; and totals over files.

All of it is built-in column expressions, so the texts never leave the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# fixed values
ARTIFACT_NAMES = (".gitkeep", ".keep", ".keepme", ".placeholder")
ARTIFACT_SUFFIXES = ("~", ".log", ".tmp", ".cache", ".pid", ".stackdump", ".swp", ".swo", ".bak", ".orig", ".rej")
IGNORED_DIRECTORIES = (".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor")
PYTHON_PROJECT_FILES = ("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "poetry.lock")
HEADER_LINES, MAX_FILE_BYTES = 12, 2 << 20


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_generated(text: Column | str) -> Column:
    """A generation notice within the first 12 lines."""
    head = F.array_join(F.slice(F.split(F.lower(_c(text)), "\n"), 1, HEADER_LINES), "\n")
    guarded = head.contains("do not edit")
    return head.contains("@generated") | head.contains("automatically generated") | (guarded & (head.contains("code generated") | head.contains("generated by")))


def is_minified(path: Column | str, text: Column | str) -> Column:
    text, lines, size = _c(text), T.line_count(text), F.octet_length(_c(text))
    longest = F.array_max(F.transform(F.split(text, "\n"), F.octet_length))
    named = F.lower(T.base_name(path)).contains(".min.") & (size >= 512)
    dense = lines.between(1, 3) & (size >= 2048) & (longest >= 800) & (F.floor(size / lines) >= 300)
    return named | F.coalesce(dense, F.lit(False))


def is_artifact(path: Column | str) -> Column:
    name = F.lower(T.base_name(path))
    out = name.isin(*ARTIFACT_NAMES)
    for suffix in ARTIFACT_SUFFIXES:
        out = out | name.endswith(suffix)
    return out


SAMPLE_BYTES = 8192


def is_binary(text: Column | str) -> Column:
    """A NUL anywhere, or in the first 8,192 bytes no valid UTF-8 or control characters as more than 8 %.

    A text column is valid UTF-8, so its sample is not only where it ends within
    a character.
    """
    text = _c(text)
    whole = F.encode(text, "UTF-8")
    sample = F.decode(F.substring(whole, 1, SAMPLE_BYTES), "ISO-8859-1")  # a letter a byte
    control = F.length(sample) - F.length(F.regexp_replace(sample, r"[\x01-\x08\x0E-\x1F]", ""))
    split = F.hex(F.substring(whole, SAMPLE_BYTES + 1, 1)).between("80", "BF")
    return F.coalesce((F.instr(text, "\x00") > 0) | split | F.coalesce(control / F.nullif(F.length(sample), F.lit(0)) > 0.08, F.lit(False)), F.lit(False))


def file_kind(path: str) -> Column:
    """source language, manifest or other."""
    p, low, name = F.col(path), F.lower(path), T.base_name(path)
    return (
        F.when(p.endswith(".go"), "go").when(low.endswith(".py"), "python").when(low.endswith(".rs"), "rust")
        .when(name.isin("go.mod", "go.sum"), "go manifest").when(name.isin(*PYTHON_PROJECT_FILES), "python manifest").when(name.isin("Cargo.toml", "Cargo.lock"), "rust manifest").otherwise("other")
    )


def is_test_file(path: str) -> Column:
    p, name = F.concat(F.lit("/"), F.col(path)), T.base_name(path)
    python = F.lower(path).endswith(".py") & ((name == "conftest.py") | name.startswith("test_") | name.endswith("_test.py") | name.endswith("_tests.py") | p.contains("/tests/"))
    rust = F.lower(path).endswith(".rs") & (p.contains("/tests/") | name.endswith("_test.rs"))
    return name.endswith("_test.go") | python | rust


def skip_reason(path: str, text: str, include_hidden: bool = False, include_generated: bool = False, include_minified: bool = False, extensions: tuple[str, ...] = ()) -> Column:
    """Why a dump leaves a file out, or null; the first reason that holds."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.when(F.exists(folders, lambda d: d.isin(*IGNORED_DIRECTORIES)), "ignored directory")
    if not include_hidden:
        out = out.when(F.exists(parts, lambda d: d.startswith(".")), "hidden file")
    if extensions:
        out = out.when(~T.extension_label(path).isin(*[e.lower() for e in extensions]), "extension")
    out = out.when(is_artifact(path), "artifact").when(F.col(text).isNull() | (F.octet_length(text) > MAX_FILE_BYTES), "too large or unreadable")
    out = out.when(is_binary(text), "binary").when(T.trimmed(text) == "", "empty")
    if not include_generated:
        out = out.when(is_generated(text), "generated")
    if not include_minified:
        out = out.when(is_minified(path, text), "minified")
    return out


def dump_stats(files: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The figures of a dump as rows: section, name, files, line_count, filled_lines, byte_count.

    ``files``: the keys, extension, reason (null: taken in), line_count,
    filled_lines, byte_count.  Sections: total (files: all that were looked
    at), average (whole lines a file), extension, skipped (by reason), largest
    and top (by lines).
    """
    numbers = ["line_count", "filled_lines", "byte_count"]
    kept, none = files.where("reason IS NULL"), F.lit(None).cast("long")

    def rows(frame: DataFrame, section: str, name: Column, count: Column, values: list[Column]) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), name.alias("name"), count.cast("long").alias("files"), *[v.cast("long").alias(c) for v, c in zip(values, numbers)])

    sums = [F.sum(c).alias(c) for c in numbers]
    seen = files.agg(F.count(F.lit(1)).alias("seen"))
    total = kept.agg(F.count(F.lit(1)).alias("files"), *sums).join(F.broadcast(seen))  # one row each
    path = F.concat_ws("/", *keys)
    order = [F.desc("line_count"), *keys]
    values = [F.col(c) for c in numbers]
    parts = [
        rows(total, "total", F.lit("files"), F.col("seen"), values),
        rows(total, "average", F.lit("lines"), F.col("files"), [F.expr("line_count div files"), none, none]),
        rows(kept.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), *sums), "extension", F.col("extension"), F.col("files"), values),
        rows(files.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("files")), "skipped", F.col("reason"), F.col("files"), [none] * 3),
        rows(kept.orderBy(F.desc("line_count"), F.desc("byte_count"), *keys).limit(1), "largest", path, F.lit(1), values),
        rows(kept.orderBy(*order).limit(top), "top", path, F.lit(1), values),
    ]
    return reduce(DataFrame.unionAll, parts)


def ancestors(path: str) -> Column:
    """All directories above a path, '' first: the groups of a roll-up by path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def directory_rollup(files: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Every directory with the files, lines and bytes below it (line_count, byte_count of each file); sums are combined before the shuffle."""
    rows = files.select(*keys, F.explode(ancestors(path)).alias("directory"), "line_count", "byte_count")
    return rows.groupBy(*keys, "directory").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("line_count"), F.sum("byte_count").alias("byte_count"))
