"""The cleaned fact tables of a code graph, and those derived from them.

Every accessor returns a lazy DataFrame over all snapshots; callers restrict it
to one with ``at``.  That filter is on a key column of the cleaning step, so
Catalyst moves it below the deduplication and into the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import KEYS, load, present, slash_path, valid_rows
from .workspace import stage

TYPE_KINDS = ("struct", "interface", "type", "alias", "class")
CALLABLE_KINDS = ("func", "method")


#: Size of an input table from which on its slices are settled.
SETTLE_BYTES = 256 << 20
#: Flows within a symbol: between its parameters, receiver, state, calls and results.
FLOW_EDGES = (
    "snapshot_id long, owner_package_import_path string, owner_symbol_key string, file_path string, line int, col int, kind string,"
    " source_kind string, source_label string, source_symbol_key string, target_kind string, target_label string, target_symbol_key string"
)
#: What the derived tables are made of.
SOURCES = {"packages": ("symbols",), "package_deps": ("symbols", "calls", "refs"), "tests": ("test_links",)}


def packages_of(symbols: DataFrame) -> DataFrame:
    named = symbols.where("package_import_path <> ''")
    counted = named.groupBy("snapshot_id", F.col("package_import_path").alias("import_path")).agg(F.count_distinct("file_path").alias("file_count"))
    return counted.withColumn("name", F.regexp_extract("import_path", r"([^/.:]+)$", 1)).withColumn("dir_path", F.col("import_path"))


def package_deps_of(symbols: DataFrame, calls: DataFrame, refs: DataFrame, external: DataFrame) -> DataFrame:
    """Distinct package pairs of calls and references; external modules are not local."""
    owner = symbols.select("snapshot_id", F.col("symbol_key").alias("_key"), F.col("package_import_path").alias("to_package_import_path"))
    uses = calls.select("snapshot_id", F.col("caller_package_import_path").alias("from_package_import_path"), F.col("callee_symbol_key").alias("_key")).unionAll(
        refs.select("snapshot_id", "from_package_import_path", F.col("to_symbol_key").alias("_key"))
    )
    uses = uses.where("from_package_import_path <> ''").distinct()
    local = uses.join(owner, ["snapshot_id", "_key"]).where("to_package_import_path <> '' AND to_package_import_path <> from_package_import_path")
    library = uses.join(external.select(F.col("symbol_key").alias("_key"), F.col("module").alias("to_package_import_path")), "_key")
    keys = ["snapshot_id", "from_package_import_path", "to_package_import_path"]
    return local.select(*keys, F.lit(True).alias("is_local")).unionAll(library.select(*keys, F.lit(False).alias("is_local"))).distinct()


def tests_of(test_links: DataFrame) -> DataFrame:
    one = test_links.groupBy("snapshot_id", "test_key").agg(F.min("test_package_import_path").alias("package_import_path"))
    return one.withColumn("file_path", F.coalesce(F.get(F.split("test_key", r"\|"), F.lit(2)), F.lit(""))).withColumn(
        "name", F.regexp_extract("test_key", r"([^|:]+)(:[0-9]+)?$", 1)
    ).withColumn("line", F.coalesce(F.expr("try_cast(regexp_extract(test_key, ':([0-9]+)$', 1) AS int)"), F.lit(0)))


class Facts:
    """Cleaned tables of one data directory.

    With ``settle`` the slices that ``at`` hands out are written once and read
    by every branch of a plan that needs them again, if the table they are cut
    from is at least ``SETTLE_BYTES`` large; cleaning a smaller one again costs
    less than a job of its own.

    ``tables`` are used instead of files of their names, and may include
    packages, package_deps, tests and flow_edges, which are derived (or empty)
    where no table is given; so a ``Store`` can be queried, too.
    """

    def __init__(self, spark: SparkSession, sf_dir: str = "", settle: bool = False, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.sf_dir, self.settle, self.tables = spark, sf_dir, settle, tables or {}
        self._written: dict[tuple[str, int], DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else load(self.spark, self.sf_dir, name)

    @cached_property
    def snapshot_ids(self) -> list[int]:
        """Ids in ascending order: as many as there are snapshots."""
        return sorted(r.id for r in self.raw("snapshots").select("id").distinct().collect())

    @property
    def current(self) -> int:
        return self.snapshot_ids[-1]

    @property
    def previous(self) -> int | None:
        """What the current snapshot is compared with: its parent, or the one before it by id; None if there is neither."""
        if self.parent is not None:
            return self.parent
        return self.snapshot_ids[-2] if len(self.snapshot_ids) > 1 else None

    @cached_property
    def parent(self) -> int | None:
        """The parent of the current snapshot, what its changes are told against; None for the first."""
        row = self.raw("snapshots").where(F.col("id") == self.current).select("parent_id").first()
        return row[0] if row else None

    @cached_property
    def pairs(self) -> DataFrame:
        """Consecutive snapshots: prev_id, id."""
        ids = self.snapshot_ids
        return F.broadcast(self.spark.createDataFrame(list(zip(ids, ids[1:])), "prev_id long, id long"))

    @cached_property
    def symbols(self) -> DataFrame:
        return valid_rows(self.raw("symbols"), KEYS["symbols"]).drop("loaded_at").fillna("", ["doc", "signature", "receiver"])

    @cached_property
    def calls(self) -> DataFrame:
        return valid_rows(self.raw("call_edges").where(present("callee_symbol_key")), KEYS["call_edges"]).drop("loaded_at")

    @cached_property
    def refs(self) -> DataFrame:
        named = self.raw("refs").where(present("to_symbol_key")).fillna("", ["from_symbol_key"])
        return valid_rows(named, KEYS["refs"]).drop("loaded_at")

    @cached_property
    def test_links(self) -> DataFrame:
        return valid_rows(self.raw("test_links").where(present("symbol_key")), KEYS["test_links"]).drop("loaded_at")

    @cached_property
    def files(self) -> DataFrame:
        return valid_rows(self.raw("files").withColumn("rel_path", slash_path("rel_path")), KEYS["files"]).drop("loaded_at")

    @cached_property
    def packages(self) -> DataFrame:
        return self.tables["packages"] if "packages" in self.tables else packages_of(self.symbols)

    @cached_property
    def flow_edges(self) -> DataFrame:
        return self.tables["flow_edges"] if "flow_edges" in self.tables else self.spark.createDataFrame([], FLOW_EDGES)

    @cached_property
    def package_deps(self) -> DataFrame:
        if "package_deps" in self.tables:
            return self.tables["package_deps"]
        return package_deps_of(self.symbols, self.calls, self.refs, self.raw("external_symbols"))

    @cached_property
    def tests(self) -> DataFrame:
        return self.tables["tests"] if "tests" in self.tables else tests_of(self.test_links)

    def at(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        """A table at one snapshot, by default the current one, without the snapshot column."""
        sid = self.current if snapshot_id is None else snapshot_id
        if self.settle and self._large(name):
            if (name, sid) not in self._written:
                self._written[name, sid] = stage(self._slice(name, sid), f"facts-{name}")
            return self._written[name, sid]
        return self._slice(name, sid)

    def _large(self, name: str) -> bool:
        table = SOURCES.get(name, (name,))[0]
        if name in self.tables or name == "flow_edges":
            return False
        plan = self.raw({"calls": "call_edges"}.get(table, table))._jdf.queryExecution().optimizedPlan()
        return int(str(plan.stats().sizeInBytes())) >= SETTLE_BYTES

    def _slice(self, name: str, sid: int) -> DataFrame:
        """A table of one snapshot; derived tables come from the slices of their sources."""
        part = {} if name in self.tables else {t: self.at(t, sid).withColumn("snapshot_id", F.lit(sid).cast("long")) for t in SOURCES.get(name, ())}
        if name in self.tables and name in SOURCES:
            table = self.tables[name].where(F.col("snapshot_id") == sid)
        elif name == "packages":
            table = packages_of(part["symbols"])
        elif name == "package_deps":
            table = package_deps_of(part["symbols"], part["calls"], part["refs"], self.raw("external_symbols"))
        elif name == "tests":
            table = tests_of(part["test_links"])
        else:
            table = getattr(self, name).where(F.col("snapshot_id") == sid)
        return table.drop("snapshot_id")

    def busiest_symbol(self, snapshot_id: int | None = None) -> str:
        """The symbol with most callers (then least key): the anchor of the single-symbol queries."""
        calls = self.at("calls", snapshot_id).join(self.at("symbols", snapshot_id).select("symbol_key"), F.col("callee_symbol_key") == F.col("symbol_key"), "left_semi")
        return calls.groupBy("callee_symbol_key").count().orderBy(F.desc("count"), "callee_symbol_key").first()[0]

    def busiest_caller(self, snapshot_id: int | None = None) -> str:
        """The symbol with most calls (then least key): the start of walks along them."""
        calls = self.at("calls", snapshot_id).join(self.at("symbols", snapshot_id).select("symbol_key"), F.col("caller_symbol_key") == F.col("symbol_key"), "left_semi")
        return calls.groupBy("caller_symbol_key").count().orderBy(F.desc("count"), "caller_symbol_key").first()[0]

    def largest_package(self, snapshot_id: int | None = None) -> str:
        symbols = self.at("symbols", snapshot_id).where("package_import_path <> ''")
        return symbols.groupBy("package_import_path").count().orderBy(F.desc("count"), "package_import_path").first()[0]


# -- the same for a second engine -------------------------------------------------


def _one_per_key(table: str, key: tuple[str, ...], rest: tuple[str, ...], where: str = "true", source: str | None = None) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", *rest))
    return f"SELECT * FROM {source or table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY {order}) = 1"


BASE_SQL = f"""
cur AS (SELECT max(id) AS id FROM snapshots),
prv AS (SELECT coalesce((SELECT parent_id FROM snapshots WHERE id = (SELECT id FROM cur)), (SELECT max(id) FROM snapshots WHERE id < (SELECT id FROM cur))) AS id),
pairs AS (SELECT * FROM (SELECT id, lag(id) OVER (ORDER BY id) AS prev_id FROM (SELECT DISTINCT id FROM snapshots)) WHERE prev_id IS NOT NULL),
sym AS (SELECT * REPLACE (coalesce(doc, '') AS doc, coalesce(signature, '') AS signature, coalesce(receiver, '') AS receiver)
  FROM ({_one_per_key('symbols', KEYS['symbols'], ('qname', 'package_import_path', 'file_path', 'name', 'kind', 'receiver', 'signature', 'doc'))})),
ce AS ({_one_per_key('call_edges', KEYS['call_edges'], ('caller_package_import_path', 'dispatch'), "callee_symbol_key <> ''")}),
rf AS ({_one_per_key('refs', KEYS['refs'], ('kind',), "to_symbol_key <> ''", "(SELECT * REPLACE (coalesce(from_symbol_key, '') AS from_symbol_key) FROM refs)")}),
tl AS ({_one_per_key('test_links', KEYS['test_links'], ('test_package_import_path', 'confidence'), "symbol_key <> ''")}),
fl AS ({_one_per_key('files', KEYS['files'], ('package_import_path', 'identity', 'semantic_meta', 'content_hash', 'size_bytes', 'is_test'), 'true',
    "(SELECT * REPLACE (regexp_replace(replace(rel_path, chr(92), '/'), '^(\\./+)+', '') AS rel_path) FROM files)")}),
pk AS (SELECT snapshot_id, package_import_path AS import_path, count(DISTINCT file_path) AS file_count, regexp_extract(package_import_path, '([^/.:]+)$', 1) AS name, package_import_path AS dir_path
  FROM sym WHERE package_import_path <> '' GROUP BY ALL),
uses AS (SELECT snapshot_id, caller_package_import_path AS from_package_import_path, callee_symbol_key AS k FROM ce WHERE caller_package_import_path <> ''
  UNION SELECT snapshot_id, from_package_import_path, to_symbol_key FROM rf WHERE from_package_import_path <> ''),
pd AS (SELECT DISTINCT u.snapshot_id, u.from_package_import_path, s.package_import_path AS to_package_import_path, true AS is_local
    FROM uses u JOIN sym s ON s.snapshot_id = u.snapshot_id AND s.symbol_key = u.k WHERE s.package_import_path <> '' AND s.package_import_path <> u.from_package_import_path
  UNION SELECT DISTINCT u.snapshot_id, u.from_package_import_path, e.module, false FROM uses u JOIN external_symbols e ON e.symbol_key = u.k),
ts AS (SELECT snapshot_id, test_key, min(test_package_import_path) AS package_import_path, split_part(test_key, '|', 3) AS file_path,
    regexp_extract(test_key, '([^|:]+)(:[0-9]+)?$', 1) AS name, coalesce(try_cast(regexp_extract(test_key, ':([0-9]+)$', 1) AS INTEGER), 0) AS line
  FROM tl GROUP BY snapshot_id, test_key),
sym_c AS (SELECT * FROM sym WHERE snapshot_id = (SELECT id FROM cur)),
ce_c AS (SELECT * FROM ce WHERE snapshot_id = (SELECT id FROM cur)),
rf_c AS (SELECT * FROM rf WHERE snapshot_id = (SELECT id FROM cur)),
tl_c AS (SELECT * FROM tl WHERE snapshot_id = (SELECT id FROM cur)),
fl_c AS (SELECT * FROM fl WHERE snapshot_id = (SELECT id FROM cur)),
pk_c AS (SELECT * FROM pk WHERE snapshot_id = (SELECT id FROM cur)),
pd_c AS (SELECT * FROM pd WHERE snapshot_id = (SELECT id FROM cur)),
ts_c AS (SELECT * FROM ts WHERE snapshot_id = (SELECT id FROM cur)),
anchor AS (SELECT callee_symbol_key AS k FROM ce_c WHERE callee_symbol_key IN (SELECT symbol_key FROM sym_c) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
anchor_pkg AS (SELECT package_import_path AS p FROM sym_c WHERE package_import_path <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
"""


def base(sql: str) -> str:
    """SQL over the cleaned tables: a SELECT, or further common tables starting with a comma."""
    return f"WITH RECURSIVE {BASE_SQL} {sql}"
