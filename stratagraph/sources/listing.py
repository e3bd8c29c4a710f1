"""Source trees as tables: a recursive listing with hashes, and ignore rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from .content import file_kind, is_test_file


def scan(spark: SparkSession, root: str) -> DataFrame:
    """One row per file of a tree: rel_path, content, hash, size_bytes, modification_time, kind and flags."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(base.lstrip("/")) + "/", "")
    named = files.select(rel.alias("rel_path"), "content", F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modification_time"))
    return named.withColumn("kind", file_kind("rel_path")).withColumn("is_test", is_test_file("rel_path"))


def merge_scans(*scans: DataFrame) -> DataFrame:
    """One row per path over several scans: flags are or-ed, of other columns the first non-empty value in order wins."""
    rows = None
    for i, part in enumerate(scans):
        part = part.withColumn("_seq", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    aggregates = []
    for name, kind in rows.drop("_seq", "rel_path").dtypes:
        if kind == "boolean":
            aggregates.append(F.max(F.coalesce(name, F.lit(False))).alias(name))
        else:
            value = F.nullif(F.col(name), F.lit("")) if kind == "string" else F.col(name)
            aggregates.append(F.min_by(name, F.when(value.isNotNull(), F.col("_seq"))).alias(name))
    return rows.groupBy("rel_path").agg(*aggregates)


def glob_regex(pattern: str) -> str:
    """The pattern of an ignore rule as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i])
        i += 1
    return f"^{out}$"


def parse_rules(lines: list[str], base: str = "") -> list[dict]:
    """Rules of one ignore file in order: base, regex, negated, dir_only, match_base."""
    rules = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[negated:].strip()
        dir_only, anchored = pattern.endswith("/"), pattern.startswith("/")
        pattern = pattern.strip("/")
        if pattern:
            rules.append({"base": base, "regex": glob_regex(pattern), "negated": negated, "dir_only": dir_only, "match_base": not anchored and "/" not in pattern})
    return rules


def ignored(path: str, rules: list[dict]) -> Column:
    """Whether a file is ignored: of the rules that match it or a directory above it, the last one decides.

    The rules are a short list, folded into one expression; paths stay in the JVM.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    out = F.lit(False)
    for rule in rules:
        hit = _rule_hit(rule)
        matched = F.exists(folders, hit)
        if not rule["dir_only"]:
            matched = matched | hit(F.col(path))
        out = F.when(matched, F.lit(not rule["negated"])).otherwise(out)
    return out


def _rule_hit(rule: dict) -> Callable[[Column], Column]:
    """Whether a rule's pattern fits a path below the folder of its ignore file."""

    def hit(p: Column) -> Column:
        below = F.when(p.startswith(rule["base"] + "/"), F.substring(p, F.lit(len(rule["base"]) + 2), F.length(p))).otherwise(F.lit("")) if rule["base"] else p
        return (below != "") & (T.base_name(below) if rule["match_base"] else below).rlike(rule["regex"])

    return hit


def fingerprints(files: DataFrame, by: str) -> DataFrame:
    """sha256 over the ten facts of each file, one line a file in order of path, per group; a group without files has no row.

    A digest of a sequence can't be split, so each group's lines, sorted by
    Spark, stream through one task, which holds one batch of them.
    """
    facts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rel_path", "package_import_path", "identity", "semantic_meta", "hash")]
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("string") for c in ("is_go", "is_rust", "is_test", "is_module")]
    line = F.concat(F.concat_ws("\t", *facts, F.coalesce("size_bytes", F.lit(0)).cast("string"), *flags), F.lit("\n"))
    lines = files.groupBy(by, "rel_path").agg(F.max(line).alias("_line"))
    ordered = lines.repartition(by).sortWithinPartitions(by, "rel_path").select(F.col(by).alias("_by"), "_line")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hashed = None, None
        for batch in batches:
            for name, part in batch.groupby("_by", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if hashed is None or name != at:
                    if hashed is not None:
                        yield pd.DataFrame([(at, hashed.hexdigest())], columns=[by, "fingerprint"])
                    at, hashed = name, hashlib.sha256()
                hashed.update("".join(part["_line"]).encode())
        if hashed is not None:
            yield pd.DataFrame([(at, hashed.hexdigest())], columns=[by, "fingerprint"])

    return ordered.mapInPandas(digest, f"`{by}` string, fingerprint string")
