"""Registered queries over file texts, names, listings, retention and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .facts import Facts, base
from .functions import text as T
from .graph_queries import facts_query
from .operators import delta
from .plans import incremental
from .registry import query
from .sources import content, extract, listing
from .store import copy_forward, expired, one_per_key
from .streaming import watch
from .tables import load, slash_path

_KEYS = ["project", "rel_path"]


def _files(spark: SparkSession, sf_dir: str, **features: Column) -> DataFrame:
    """One row per scanned file with features of its text; of several texts of a key, that with the greatest digest.

    The features are computed before copies are dropped, so texts are not
    shuffled, only digests and features.
    """
    rows = load(spark, sf_dir, "scan_files").withColumn("_digest", F.sha2("content", 256))
    rows = rows.select(*_KEYS, F.struct("_digest", *[c.alias(n) for n, c in features.items()]).alias("_f"))
    return rows.groupBy(*_KEYS).agg(F.max("_f").alias("_f")).select(*_KEYS, F.col("_f._digest").alias("digest"), *[F.col(f"_f.{n}").alias(n) for n in features])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned files with their texts, copies once; for work on whole texts, which moves them."""
    return load(spark, sf_dir, "scan_files").groupBy(*_KEYS).agg(F.max_by("content", F.sha2("content", 256)).alias("content"), F.max("package_import_path").alias("package_import_path"))


_FILES = "f AS (SELECT project, rel_path, arg_max(content, sha256(content)) AS content FROM scan_files GROUP BY ALL)"
_BASE = "regexp_extract(rel_path, '([^/]*)$', 1)"
_UNIX = "replace(content, chr(13) || chr(10), chr(10))"
_LINES = f"CASE WHEN {_UNIX} = '' THEN 0 ELSE len(string_split({_UNIX}, chr(10))) - CASE WHEN suffix({_UNIX}, chr(10)) THEN 1 ELSE 0 END END"
_FILLED = f"len(list_filter(string_split({_UNIX}, chr(10)), lambda x: regexp_replace(x, '[\\s\\x{{00a0}}\\x{{0085}}]', '', 'g') <> ''))"
_SIZE = "octet_length(encode(content))"


@query(
    f"""WITH {_FILES}, h AS (SELECT *, array_to_string(list_slice(string_split(lower(content), chr(10)), 1, 12), chr(10)) AS head FROM f WHERE content IS NOT NULL)
    SELECT project, rel_path FROM h WHERE contains(head, '@generated') OR contains(head, 'automatically generated') OR (contains(head, 'do not edit') AND (contains(head, 'code generated') OR contains(head, 'generated by')))"""
)
def flt_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, hit=content.is_generated("content")).where("hit").select(*_KEYS)


_GENERATED = "(contains(head, '@generated') OR contains(head, 'automatically generated') OR (contains(head, 'do not edit') AND (contains(head, 'code generated') OR contains(head, 'generated by'))))".replace("head", "array_to_string(list_slice(string_split(lower(content), chr(10)), 1, 12), chr(10))")
_MIN = f"(contains(lower({_BASE}), '.min.') AND {_SIZE} >= 512 OR {_LINES} BETWEEN 1 AND 3 AND {_SIZE} >= 2048 AND list_max(list_transform(string_split(content, chr(10)), lambda x: octet_length(encode(x)))) >= 800 AND {_SIZE} // ({_LINES}) >= 300)"


@query(f"WITH {_FILES} SELECT project, rel_path FROM f WHERE content IS NOT NULL AND {_MIN}")
def flt_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, hit=content.is_minified("rel_path", "content")).where("hit").select(*_KEYS)


#: The first 8,192 bytes as pairs of hexadecimal digits, and the byte that follows.
_PAIRS = "list_transform(range(0, least(8192, octet_length(encode(content)))), lambda i: substring(hex(encode(content)), 2 * i + 1, 2))"
_CONTROL = "['01', '02', '03', '04', '05', '06', '07', '08', '0E', '0F', '10', '11', '12', '13', '14', '15', '16', '17', '18', '19', '1A', '1B', '1C', '1D', '1E', '1F']"
_BINARY = f"(contains(content, chr(0)) OR substring(hex(encode(content)), 16385, 2) BETWEEN '80' AND 'BF' OR len(list_filter({_PAIRS}, lambda x: list_contains({_CONTROL}, x))) * 1.0 / nullif(least(8192, octet_length(encode(content))), 0) > 0.08)"


@query(f"WITH {_FILES} SELECT project, rel_path FROM f WHERE {_BINARY}")
def flt_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, hit=content.is_binary("content")).where("hit").select(*_KEYS)


@query(f"WITH {_FILES} SELECT project, rel_path FROM f WHERE lower({_BASE}) IN ('.gitkeep', '.keep', '.keepme', '.placeholder') OR regexp_matches(lower({_BASE}), '(~|\\.(log|tmp|cache|pid|stackdump|swp|swo|bak|orig|rej))$')")
def flt_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(content.is_artifact("rel_path")).select(*_KEYS)


_EXT = f"CASE WHEN lower(regexp_extract({_BASE}, '(\\.[^.]*)$', 1)) IN ('', '.') THEN 'none' ELSE lower(regexp_extract({_BASE}, '(\\.[^.]*)$', 1)) END"


@query(f"WITH {_FILES} SELECT project, rel_path FROM f WHERE {_EXT} IN ('.go', '.py')")
def flt_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(T.extension_label("rel_path").isin(".go", ".py")).select(*_KEYS)


@query(f"WITH {_FILES} SELECT {_EXT} AS extension, count(*) AS file_count FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_ext_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy(T.extension_label("rel_path").alias("extension")).agg(F.count(F.lit(1)).alias("file_count")).orderBy(F.desc("file_count"), "extension").limit(8)


@query(
    f"""WITH {_FILES} SELECT project, rel_path, CASE WHEN suffix(rel_path, '.go') THEN 'go' WHEN suffix(lower(rel_path), '.py') THEN 'python' WHEN suffix(lower(rel_path), '.rs') THEN 'rust' WHEN {_BASE} IN ('go.mod', 'go.sum') THEN 'go manifest'
      WHEN {_BASE} IN ('pyproject.toml', 'requirements.txt', 'setup.py', 'setup.cfg', 'Pipfile', 'poetry.lock') THEN 'python manifest' WHEN {_BASE} IN ('Cargo.toml', 'Cargo.lock') THEN 'rust manifest' ELSE 'other' END AS kind,
      suffix({_BASE}, '_test.go') OR (suffix(lower(rel_path), '.py') AND ({_BASE} = 'conftest.py' OR prefix({_BASE}, 'test_') OR regexp_matches({_BASE}, '_tests?\\.py$') OR contains('/' || rel_path, '/tests/')))
        OR (suffix(lower(rel_path), '.rs') AND (contains('/' || rel_path, '/tests/') OR suffix({_BASE}, '_test.rs'))) AS is_test FROM f"""
)
def prj_file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(*_KEYS, content.file_kind("rel_path").alias("kind"), content.is_test_file("rel_path").alias("is_test"))


@query(f"WITH {_FILES} SELECT project, rel_path, {_LINES} AS line_count, {_FILLED} AS filled_lines FROM f WHERE content IS NOT NULL")
def fn_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir, line_count=T.line_count("content"), filled_lines=T.filled_line_count("content")).where("digest IS NOT NULL")
    return rows.select(*_KEYS, "line_count", "filled_lines")


_REASON = f"""CASE WHEN len(list_filter(list_slice(string_split(rel_path, '/'), 1, -2), lambda d: list_contains([{', '.join(repr(d) for d in content.IGNORED_DIRECTORIES)}], d))) > 0 THEN 'ignored directory'
  WHEN len(list_filter(string_split(rel_path, '/'), lambda d: prefix(d, '.'))) > 0 THEN 'hidden file'
  WHEN lower({_BASE}) IN ('.gitkeep', '.keep', '.keepme', '.placeholder') OR regexp_matches(lower({_BASE}), '(~|\\.(log|tmp|cache|pid|stackdump|swp|swo|bak|orig|rej))$') THEN 'artifact'
  WHEN content IS NULL OR {_SIZE} > {content.MAX_FILE_BYTES} THEN 'too large or unreadable' WHEN {_BINARY} THEN 'binary' WHEN regexp_replace(content, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g') = '' THEN 'empty'
  WHEN {_GENERATED} THEN 'generated' WHEN {_MIN} THEN 'minified' END"""
_DUMPED = f"WITH {_FILES}, r AS (SELECT *, {_REASON} AS reason, {_EXT} AS extension, {_LINES} AS l, {_FILLED} AS e, {_SIZE} AS b FROM f), k AS (SELECT * FROM r WHERE reason IS NULL)"


@query(
    f"""{_DUMPED} SELECT 'total' AS section, 'files' AS name, (SELECT count(*) FROM r)::BIGINT AS files, sum(l)::BIGINT AS line_count, sum(e)::BIGINT AS filled_lines, sum(b)::BIGINT AS byte_count FROM k
    UNION ALL SELECT 'average', 'lines', count(*), (sum(l) // count(*))::BIGINT, NULL, NULL FROM k UNION ALL SELECT 'extension', extension, count(*), sum(l)::BIGINT, sum(e)::BIGINT, sum(b)::BIGINT FROM k GROUP BY 2
    UNION ALL SELECT 'skipped', reason, count(*), NULL, NULL, NULL FROM r WHERE reason IS NOT NULL GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'largest', project || '/' || rel_path, 1, l, e, b FROM k ORDER BY l DESC, b DESC, project, rel_path LIMIT 1) UNION ALL SELECT * FROM (SELECT 'top', project || '/' || rel_path, 1, l, e, b FROM k ORDER BY l DESC, project, rel_path LIMIT 5)"""
)
def agg_dump_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.dump_stats(_dumped(spark, sf_dir), _KEYS)


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content")
    rows = _files(spark, sf_dir, reason=content.skip_reason("rel_path", "content"), line_count=T.line_count("content"), filled_lines=T.filled_line_count("content"), byte_count=size)
    return rows.withColumn("extension", T.extension_label("rel_path"))


@query(
    f"""WITH {_FILES}, d AS (SELECT project, unnest(list_transform(range(len(string_split(rel_path, '/'))), lambda n: array_to_string(list_slice(string_split(rel_path, '/'), 1, n), '/'))) AS directory, {_LINES} AS l, {_SIZE} AS b FROM f WHERE content IS NOT NULL)
    SELECT project, directory, count(*) AS file_count, sum(l)::BIGINT AS line_count, sum(b)::BIGINT AS byte_count FROM d GROUP BY 1, 2"""
)
def agg_dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir, line_count=T.line_count("content"), byte_count=F.octet_length("content")).where("digest IS NOT NULL")
    return content.directory_rollup(rows, ["project"], "rel_path")


@query("SELECT project, count(*) FILTER (suffix(rel_path, '.go')) AS go_files, count(*) FILTER (suffix(lower(rel_path), '.py')) AS python_files, count(*) FILTER (suffix(lower(rel_path), '.rs')) AS rust_files FROM (SELECT DISTINCT project, rel_path FROM scan_files) GROUP BY 1")
def agg_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "scan_files").select(*_KEYS).distinct()
    low = F.lower("rel_path")
    return rows.groupBy("project").agg(F.count_if(F.col("rel_path").endswith(".go")).alias("go_files"), F.count_if(low.endswith(".py")).alias("python_files"), F.count_if(low.endswith(".rs")).alias("rust_files"))


@query(f"{_DUMPED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS file_count FROM r GROUP BY 1")
def src_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumped(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("kept"))).groupBy("reason").agg(F.count(F.lit(1)).alias("file_count"))


#: Rules of the ignore query, in order.
IGNORE_LINES = ["*.min.*", "/dist/", "generated/", "!/generated/quartz/**", "node_modules/", "**/rank/*_test.go"]


@query(
    """SELECT DISTINCT project, rel_path FROM scan_files WHERE CASE WHEN regexp_matches(rel_path, '(^|/)rank/[^/]*_test\\.go(/|$)') THEN true WHEN regexp_matches(rel_path, '(^|/)node_modules/') THEN true WHEN regexp_matches(rel_path, '^generated/quartz/.') THEN false
      WHEN regexp_matches(rel_path, '(^|/)generated/') THEN true WHEN regexp_matches(rel_path, '^dist/') THEN true WHEN regexp_matches(rel_path, '(^|/)[^/]*\\.min\\.[^/]*(/|$)') THEN true ELSE false END"""
)
def flt_gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "scan_files").select(*_KEYS).distinct().where(listing.ignored("rel_path", listing.parse_rules(IGNORE_LINES)))


_ROW = " || chr(9) || ".join(
    ["coalesce(rel_path, '')", "coalesce(package_import_path, '')", "coalesce(identity, '')", "coalesce(semantic_meta, '')", "coalesce(hash, '')", "coalesce(size_bytes, 0)", *[f"coalesce({c}, false)::VARCHAR" for c in ("is_go", "is_rust", "is_test", "is_module")]]
)


@query(f"SELECT project, sha256(string_agg(line, '' ORDER BY rel_path)) AS fingerprint FROM (SELECT project, rel_path, max({_ROW} || chr(10)) AS line FROM scan_files GROUP BY 1, 2) GROUP BY 1")
def fn_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.fingerprints(load(spark, sf_dir, "scan_files"), "project")


@query("SELECT DISTINCT project, substring(sha256(project), 1, 16) AS project_id FROM scan_files WHERE project IS NOT NULL")
def fn_project_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "scan_files").where("project IS NOT NULL").select("project", T.project_id("project").alias("project_id")).distinct()


# --- names ----------------------------------------------------------------------------------


@facts_query(
    """SELECT symbol_key, regexp_replace(lower(name), '[^\\p{L}\\p{Nd}]', '', 'g') AS canonical, CASE WHEN regexp_extract(qname, '[./]([^./]+)$', 1) <> '' THEN regexp_extract(qname, '[./]([^./]+)$', 1) ELSE qname END AS tail,
    regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS token, lower(replace(replace(name, '_', ''), '-', '')) AS plain, regexp_replace(name, '^(Test|Benchmark|Fuzz)', '') AS untested FROM sym_c"""
)
def fn_names(f: Facts) -> DataFrame:
    return f.at("symbols").select(
        "symbol_key", T.canonical("name").alias("canonical"), T.qname_tail("qname").alias("tail"), T.normalized_token("name").alias("token"), T.normalized_name("name").alias("plain"), T.without_test_prefix("name").alias("untested")
    )


@facts_query("SELECT symbol_key, levenshtein(lower(name), 'snapshotload') AS distance FROM sym_c")
def fn_levenshtein(f: Facts) -> DataFrame:
    return f.at("symbols").select("symbol_key", F.levenshtein(F.lower("name"), F.lit("snapshotload")).alias("distance"))


@facts_query("SELECT symbol_key FROM sym_c WHERE regexp_matches(lower(name), 's.*n.*l.*d')")
def fn_subsequence(f: Facts) -> DataFrame:
    return f.at("symbols").where(T.same_letters_in_order("snld", F.lower("name"))).select("symbol_key")


@facts_query(
    """SELECT rel_path, regexp_replace(regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_test$', '') AS family,
    CASE WHEN size_bytes >= 1048576 THEN printf('%.1f MB', size_bytes / 1048576.0) WHEN size_bytes >= 1024 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE size_bytes || ' B' END AS size FROM fl_c"""
)
def fn_paths(f: Facts) -> DataFrame:
    return f.at("files").select("rel_path", T.file_family("rel_path").alias("family"), T.human_size("size_bytes").alias("size"))


@facts_query("SELECT symbol_key, CASE WHEN prefix(qname, 'forge.example/quarry/') THEN substring(qname, 22) WHEN prefix(qname, 'forge.example/quarry.') THEN substring(qname, 22) ELSE qname END AS short FROM sym_c")
def fn_shorten_qname(f: Facts) -> DataFrame:
    return f.at("symbols").select("symbol_key", T.short_qname("forge.example/quarry", "qname").alias("short"))


# --- writing policies, retention, refresh -------------------------------------------------------

_CE_KEY = "snapshot_id, caller_symbol_key, callee_symbol_key, file_path, line, col"


@query(f"SELECT {_CE_KEY}, arg_min(dispatch, (loaded_at, coalesce(dispatch, ''))) AS dispatch FROM call_edges GROUP BY ALL")
def snk_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tuple(_CE_KEY.split(", "))
    rows = load(spark, sf_dir, "call_edges").select(*key, "dispatch", F.struct("loaded_at", F.coalesce("dispatch", F.lit(""))).alias("seq"))
    return one_per_key(rows, key, "first")


@query("SELECT snapshot_id, test_key, symbol_key, link_kind, arg_max(confidence, (loaded_at, coalesce(confidence, ''))) AS confidence FROM test_links GROUP BY ALL")
def snk_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("snapshot_id", "test_key", "symbol_key", "link_kind")
    rows = load(spark, sf_dir, "test_links").select(*key, "confidence", F.struct("loaded_at", F.coalesce("confidence", F.lit(""))).alias("seq"))
    return one_per_key(rows, key, "last")


@facts_query("SELECT s.symbol_key, s.package_import_path FROM sym s WHERE s.snapshot_id = (SELECT id FROM prv) AND s.package_import_path NOT IN (SELECT p FROM anchor_pkg UNION SELECT from_package_import_path FROM pd_c WHERE to_package_import_path = (SELECT p FROM anchor_pkg))")
def snk_copy_forward(f: Facts) -> DataFrame:
    from .graph_queries import rec_reverse_deps

    return copy_forward(f.at("symbols", f.previous), "package_import_path", rec_reverse_deps(f)).select("symbol_key", "package_import_path")


@query("WITH s AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS n, row_number() OVER (ORDER BY id) AS up FROM (SELECT DISTINCT id FROM snapshots)) SELECT id FROM s WHERE n > 3 AND id <> (SELECT id FROM s WHERE up = 2)")
def dml_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes if three snapshots are kept while the pointer is at the second one."""
    ids = sorted(r.id for r in load(spark, sf_dir, "snapshots").select("id").distinct().collect())  # one row per snapshot
    return spark.createDataFrame([(i,) for i in expired(ids, 3, ids[1])], "id long")


@facts_query(
    """SELECT coalesce(n.rel_path, o.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'deleted' ELSE 'changed' END AS change, coalesce(nullif(o.package_import_path, ''), nullif(n.package_import_path, ''), '') AS package_import_path
    FROM fl_c n FULL JOIN (SELECT * FROM fl WHERE snapshot_id = (SELECT id FROM prv)) o ON n.rel_path = o.rel_path WHERE n.rel_path IS NULL OR o.rel_path IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash"""
)
def inc_detect(f: Facts) -> DataFrame:
    now, before = (f.at("files", s).withColumnRenamed("content_hash", "hash") for s in (f.current, f.previous))
    return incremental.file_changes(now, before).select("rel_path", "change", "package_import_path")


_MANIFESTS = ", ".join(f"'{m}'" for m in incremental.MANIFESTS)


@facts_query(
    f"""SELECT DISTINCT coalesce(nullif(o.package_import_path, ''), n.package_import_path) AS import_path FROM fl_c n FULL JOIN (SELECT * FROM fl WHERE snapshot_id = (SELECT id FROM prv)) o ON n.rel_path = o.rel_path
    WHERE (n.rel_path IS NULL OR o.rel_path IS NULL OR n.content_hash IS DISTINCT FROM o.content_hash) AND regexp_extract(coalesce(n.rel_path, o.rel_path), '([^/]*)$', 1) NOT IN ({_MANIFESTS}) AND import_path <> ''"""
)
def inc_plan(f: Facts) -> DataFrame:
    now, before = (f.at("files", s).withColumnRenamed("content_hash", "hash") for s in (f.current, f.previous))
    return incremental.detect(now, before).impacted(f.spark)


@query("SELECT rel_path, regexp_replace(replace(rel_path, chr(92), '/'), '^(\\./+)+', '') AS clean FROM (SELECT DISTINCT rel_path FROM files)")
def fn_norm_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "files").select("rel_path").distinct().select("rel_path", slash_path("rel_path").alias("clean"))


@query()
def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.bursts(load(spark, sf_dir, "events"), "event_type", "ts", "user_id", 250)


# --- extractors -------------------------------------------------------------------------------------


@query()
def ex_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.symbols(_texts(spark, sf_dir))


@query()
def ex_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _texts(spark, sf_dir)
    return extract.edges(extract.symbols(files), extract.uses(files))


@query()
def ex_link_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_tests(extract.symbols(_texts(spark, sf_dir)))
