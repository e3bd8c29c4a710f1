"""Ranked search over symbols, packages and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..facts import Facts
from ..functions import text as T
from . import metrics
from .rank import KIND_BOOST, RELEVANCE_WEIGHTS, lookup, weighted

# fixed values: ranks of the kinds of a match
SYMBOL_KIND_RANK = {"exact": 0, "name": 1, "prefix": 2, "contains": 3, "shape": 4, "fuzzy": 5}
PACKAGE_KIND_RANK = {"exact": 0, "name": 1, "prefix": 2, "contains": 3}


def match_kind(score: str, prefix_from: int = 975) -> Column:
    """The kind of a match, which its score determines."""
    s = F.col(score)
    return (
        F.when(s == 1200, "exact").when(s >= 1100, "name").when(s >= prefix_from, "prefix").when(s >= 850, "contains")
        .when(s >= 725, "shape").when(s > 0, "fuzzy").otherwise("")
    )


def score_symbols(rows: DataFrame, query: str) -> DataFrame:
    """Adds score and match_kind of each symbol for a query; the first tier that fits wins, score 0 is no match."""
    query = query.strip()
    low, canon = query.lower(), T.canonical_text(query)
    if not low:
        return rows.withColumn("score", F.lit(0)).withColumn("match_kind", F.lit(""))
    # the forms are made once, behind a one-row explode: otherwise they are put into every branch below, and the code gets too long to compile
    lowered = rows.select("*", F.explode(F.array(F.struct(F.lower(T.trimmed("name")).alias("n"), F.lower(T.trimmed("qname")).alias("q"), F.lower(T.trimmed("symbol_key")).alias("k")))).alias("_l"))
    tailed = lowered.select("*", F.explode(F.array(T.qname_tail("_l.q"))).alias("_tail"))
    canonical = F.struct(*[T.canonical(c).alias(a) for a, c in (("n", "_l.n"), ("t", "_tail"), ("q", "_l.q"), ("k", "_l.k"))])
    named = tailed.select("*", F.explode(F.array(canonical)).alias("_c"))
    name, qname, key, tail, cn, ct, cq, ck = (F.col(c) for c in ("_l.n", "_l.q", "_l.k", "_tail", "_c.n", "_c.t", "_c.q", "_c.k"))
    out = F.when((key == low) | (qname == low), 1200).when((name == low) | (tail == low), 1150)
    out = out.when(name.startswith(low), 1025).when(tail.startswith(low), 1000).when(qname.startswith(low) | key.startswith(low), 975)
    out = out.when(name.contains(low), 900).when(tail.contains(low), 875).when(qname.contains(low) | key.contains(low), 850)
    if canon:
        out = out.when((cn == canon) | (ct == canon), 825).when(cn.startswith(canon) | ct.startswith(canon), 775)
        out = out.when(cn.contains(canon) | ct.contains(canon) | cq.contains(canon) | ck.contains(canon), 725)
    if len(canon.encode()) >= 3:
        sub = ".*".join(map(re.escape, canon))
        out = out.when(cn.rlike(sub) | ct.rlike(sub), 650).when(cq.rlike(sub) | ck.rlike(sub), 625)
        most = max(2, len(canon.encode()) // 4)
        named = named.withColumn("_best", F.least(*[F.nullif(F.when(c != "", F.levenshtein(c, F.lit(canon), most)), F.lit(-1)) for c in (cn, ct, cq, ck)]))
        out = out.when(F.col("_best") <= most, F.greatest(F.lit(500) - F.col("_best") * 60, F.lit(320)))
    scored = named.withColumn("score", out.otherwise(0)).withColumn("match_kind", match_kind("score"))
    return scored.drop("_l", "_tail", "_c", "_best")


def find_symbols(f: Facts, query: str, limit: int = 40) -> DataFrame:
    """The best matches; only what matches at all is joined with its counts."""
    hits = score_symbols(f.at("symbols").select("symbol_key", "qname", "name"), query).where("score > 0").select("symbol_key", "score", "match_kind")
    rows = metrics.symbol_metrics(f).join(hits, "symbol_key")
    boost = lookup("kind", KIND_BOOST, 2)
    ranked = rows.withColumn("kind_boost", boost).withColumn("relevance", weighted(RELEVANCE_WEIGHTS) + boost)
    order = [lookup("match_kind", SYMBOL_KIND_RANK, 9), F.desc("score"), F.desc("relevance"), F.desc("package_importance"), F.desc("kind_boost"), "kind", "line", "qname", "symbol_key"]
    return ranked.orderBy(*order).limit(limit).select("symbol_key", "qname", "match_kind", "score", "relevance")


def package_match(query: str) -> Column:
    low = query.strip().lower()
    path, name, folder = (F.lower(T.trimmed(c)) for c in ("import_path", "name", "dir_path"))

    def hit(score: int, kind: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"))

    if not low:
        return hit(0, "")
    return (
        F.when(path == low, hit(1200, "exact")).when(name == low, hit(1150, "name"))
        .when(path.endswith("/" + low) | (folder == low), hit(1100, "name"))
        .when(path.startswith(low) | folder.startswith(low), hit(1000, "prefix")).when(name.startswith(low), hit(975, "prefix"))
        .when(path.contains(low) | folder.contains(low), hit(875, "contains")).when(name.contains(low), hit(850, "contains"))
        .otherwise(hit(0, ""))
    )


def find_packages(f: Facts, query: str, limit: int = 40) -> DataFrame:
    rows = metrics.package_metrics(f).withColumn("_m", package_match(query)).withColumn("score", F.col("_m.score")).withColumn("match_kind", F.col("_m.kind")).where("score > 0")
    return rows.orderBy(lookup("match_kind", PACKAGE_KIND_RANK, 9), F.desc("score"), "import_path").limit(limit).select("import_path", "match_kind", "score")


def text_lines(files: DataFrame, keys: list[str], query: str, regex: bool = False, text: str = "content") -> DataFrame:
    """Matching lines: keys, line (from 1), col (byte offset from 1) and the line's text; one hit per line.

    Smart case: a query with an upper-case letter is matched as written.  Texts
    of more than 1 MiB or with a NUL are skipped, as are null ones.
    """
    smart = any(c.isupper() for c in query)
    sized = files.where(F.col(text).isNotNull() & (F.octet_length(text) <= 1 << 20) & ~F.col(text).contains("\x00"))
    body = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    lines = sized.select(*keys, F.posexplode(body).alias("_n", "text"))
    shown = F.col("text") if smart else F.lower("text")
    if regex:
        pattern = query if smart else f"(?i){query}"
        at = F.regexp_instr(F.col("text"), F.lit(pattern))
        found = lines.where(F.col("text").rlike(pattern))
    else:
        needle = query if smart else query.lower()
        at = F.instr(shown, needle)
        found = lines.where(shown.contains(needle))
    return found.select(*keys, (F.col("_n") + 1).alias("line"), (F.octet_length(F.substring("text", F.lit(1), at - 1)) + 1).alias("col"), "text")


def ranked_text(matches: DataFrame, files: DataFrame, limit: int = 16) -> DataFrame:
    """Matches in order of their file's score, cut at a total budget.

    ``matches``: rel_path, line, col and, where known, package_import_path, which
    holds for files that ``files`` does not name; ``files``: rel_path, package_import_path,
    relevant_symbols, linked_symbols, related_tests, reverse_package_deps,
    importance.  Packages rank by matches * 60 + importance * 3 + reverse
    dependencies * 10 + a quarter of each file's score.
    """
    own = F.max("package_import_path") if "package_import_path" in matches.columns else F.lit(None).cast("string")
    counted, matches = matches.groupBy("rel_path").agg(F.count(F.lit(1)).alias("match_count"), own.alias("_own")), matches.drop("package_import_path")
    per_file = counted.join(files, "rel_path", "left").withColumn("package_import_path", F.coalesce("package_import_path", "_own", F.lit(""))).fillna(0)
    score = F.col("match_count") * 100 + F.col("relevant_symbols") * 6 + F.col("linked_symbols") * 8 + F.col("related_tests") * 4 + F.col("reverse_package_deps") * 10 + F.col("importance") * 2
    scored = per_file.withColumn("file_score", score)
    packages = scored.groupBy("package_import_path").agg(
        (F.sum("match_count") * 60 + F.max("importance") * 3 + F.max("reverse_package_deps") * 10 + F.sum(F.expr("file_score div 4"))).alias("package_score")
    )
    rows = matches.join(scored.select("rel_path", "package_import_path", "file_score"), "rel_path").join(packages, "package_import_path")
    order = [F.desc("package_score"), "package_import_path", F.desc("file_score"), "rel_path", "line", "col"]
    best = rows.orderBy(*order).limit(limit)  # the budget; ranked below over these few rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "package_import_path", "rel_path", "line", "col", "file_score", "package_score")
