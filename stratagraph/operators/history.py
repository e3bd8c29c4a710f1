"""What differs between consecutive snapshots, for one pair or all pairs at once, and the histories made of it.

Both sides of a pair stand under the later snapshot's id, so all pairs take one
join or one aggregation per table, however many snapshots there are.  Edges are
subtracted by a signed sum per key: one shuffle, combined before it.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import Facts
from ..workspace import stage
from . import metrics
from .delta import CALL_KEY, LINK_KEY, PACKAGE_COUNTS, REF_KEY

_SYMBOL = ["package_import_path", "file_path", "signature", "line"]
DEP_KEY = ["from_package_import_path", "to_package_import_path"]

# fixed values: what is said of a changed symbol
WHY = {
    "added": "new symbol introduced", "removed": "symbol removed", "contract": "signature changed", "moved": "declaration moved",
    "added_callees": "new outgoing call edge", "removed_callees": "outgoing call edge removed", "added_callers": "new incoming caller", "removed_callers": "incoming caller removed",
    "added_refs_in": "new inbound reference", "removed_refs_in": "inbound reference removed", "added_refs_out": "new outbound reference", "removed_refs_out": "outbound reference removed",
    "added_tests": "new related test link", "removed_tests": "related test link removed",
}
#: The counters of an impacted symbol.
COUNTERS = [f"{change}_{c}" for change in ("added", "removed") for c in ("callers", "callees", "refs_in", "refs_out", "tests")]


class Diffs:
    """The differences of one pair (``old``, ``new``), or of every snapshot to the one before.

    Every table has ``snapshot_id``, the later snapshot of its pair.  With
    ``qname``, symbols and edges are only those of symbols of that name: the
    edges are filtered by its keys before anything is compared.
    """

    def __init__(self, f: Facts, pair: tuple[int, int] | None = None, qname: str | None = None) -> None:
        self.f, self.pair, self.qname = f, pair, qname

    @cached_property
    def _keys(self) -> DataFrame:
        """The keys of the asked symbols: those that ever had the name, and the name itself, which stands for keys without a record."""
        named = self.f.symbols.where(F.trim("qname") == F.trim(F.lit(self.qname))).select(F.col("symbol_key").alias("_asked"))
        return stage(named.unionAll(self.f.spark.createDataFrame([(self.qname,)], "_asked string")).distinct(), "asked-keys")

    def _mine(self, table: str) -> DataFrame:
        """A table of edges or symbols; of the asked symbols only, if any are."""
        rows = getattr(self.f, table)
        if self.qname is None:
            return rows
        if table == "symbols":
            return rows.where(F.trim("qname") == F.trim(F.lit(self.qname)))

        def ends_in(frame: DataFrame, end: str, how: str) -> DataFrame:
            return frame.join(self._keys.withColumnRenamed("_asked", end), end, how)

        one, *other = {"calls": ["caller_symbol_key", "callee_symbol_key"], "refs": ["from_symbol_key", "to_symbol_key"], "test_links": ["symbol_key"]}[table]
        return reduce(lambda got, end: got.unionByName(ends_in(ends_in(rows, end, "left_semi"), one, "left_anti")), other, ends_in(rows, one, "left_semi"))

    def _sides(self, table: str | DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """(rows of the later snapshots, rows of the earlier ones under the later id)."""
        asked = isinstance(table, str) and table in ("symbols", "calls", "refs", "test_links")
        rows = (self._mine(table) if asked else getattr(self.f, table) if isinstance(table, str) else table).select("snapshot_id", *columns)
        if self.pair:
            old, new = self.pair
            return rows.where(F.col("snapshot_id") == new), rows.where(F.col("snapshot_id") == old).withColumn("snapshot_id", F.lit(new).cast("long"))
        now = rows.join(self.f.pairs.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
        before = rows.join(self.f.pairs, rows["snapshot_id"] == F.col("prev_id")).select(F.col("id").alias("snapshot_id"), *columns)
        return now, before

    def _subtract(self, table: str | DataFrame, key: list[str], *rest: str) -> DataFrame:
        """Rows of only one side: key, rest, change ('added' or 'removed')."""
        now, before = self._sides(table, *key, *rest)
        signed = now.withColumn("_sign", F.lit(1)).unionByName(before.withColumn("_sign", F.lit(-1)))
        left = signed.groupBy("snapshot_id", *key).agg(F.sum("_sign").alias("_sign"), *[F.max(c).alias(c) for c in rest]).where("_sign <> 0")
        return left.withColumn("change", F.when(F.col("_sign") > 0, "added").otherwise("removed")).drop("_sign")

    @cached_property
    def files(self) -> DataFrame:
        """snapshot_id, rel_path, package_import_path (of the later side, if there), change: added, changed or deleted."""
        now, before = self._sides("files", "rel_path", "package_import_path", "content_hash")
        both = now.withColumn("_there", F.lit(True)).alias("n").join(before.withColumn("_there", F.lit(True)).alias("b"), ["snapshot_id", "rel_path"], "full_outer")
        change = F.when(F.col("b._there").isNull(), "added").when(F.col("n._there").isNull(), "deleted").when(~F.col("n.content_hash").eqNullSafe(F.col("b.content_hash")), "changed")
        package = F.when(F.col("n._there"), F.col("n.package_import_path")).otherwise(F.col("b.package_import_path"))
        return both.select("snapshot_id", "rel_path", F.coalesce(package, F.lit("")).alias("package_import_path"), change.alias("change")).where("change IS NOT NULL")

    @cached_property
    def symbols(self) -> DataFrame:
        """snapshot_id, qname, change (added, removed, changed), from_ and to_ package, file, signature and line, contract_changed, moved.

        Matched by qname; a repeated one fans out.
        """
        now, before = self._sides("symbols", "symbol_key", "qname", *_SYMBOL)
        both = now.alias("n").join(before.alias("b"), ["snapshot_id", "qname"], "full_outer")
        n, b = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"b.{c}"))
        contract = F.coalesce(n("signature") != b("signature"), F.lit(False))
        moved = F.coalesce((n("file_path") != b("file_path")) | (n("line") != b("line")), F.lit(False))
        change = F.when(b("symbol_key").isNull(), "added").when(n("symbol_key").isNull(), "removed").otherwise("changed")
        out = both.select(
            "snapshot_id", "qname", change.alias("change"), *[b(c).alias(f"from_{c}") for c in _SYMBOL], *[n(c).alias(f"to_{c}") for c in _SYMBOL],
            contract.alias("contract_changed"), moved.alias("moved"), F.coalesce(n("symbol_key"), b("symbol_key")).alias("symbol_key"),
        )
        return out.where("change <> 'changed' OR contract_changed OR moved")

    @cached_property
    def packages(self) -> DataFrame:
        """snapshot_id, import_path, status, from_ and to_ counts of packages that came, went or differ in a count."""
        now, before = self._sides(metrics.package_counts(self.f), "import_path", *PACKAGE_COUNTS)
        both = now.withColumn("_there", F.lit(True)).alias("n").join(before.withColumn("_there", F.lit(True)).alias("b"), ["snapshot_id", "import_path"], "full_outer")
        status = F.when(F.col("b._there").isNull(), "added").when(F.col("n._there").isNull(), "removed").otherwise("changed")
        counts = [F.coalesce(F.col(f"{side}.{c}"), F.lit(0)).alias(f"{name}_{c}") for c in PACKAGE_COUNTS for side, name in (("b", "from"), ("n", "to"))]
        out = both.select("snapshot_id", "import_path", status.alias("status"), *counts)
        return out.where("status <> 'changed' OR " + " OR ".join(f"from_{c} <> to_{c}" for c in PACKAGE_COUNTS))

    @cached_property
    def deps(self) -> DataFrame:
        """Local package dependencies of only one side: snapshot_id, from and to package, change; the other side may be of any kind."""
        any_side = self._subtract(self.f.package_deps.groupBy("snapshot_id", *DEP_KEY).agg(F.max("is_local").alias("is_local")), DEP_KEY, "is_local")
        return any_side.where("is_local").drop("is_local")

    @cached_property
    def _names(self) -> DataFrame:
        """The qname of every key on both sides: snapshot_id, change, _key, _qname."""
        now, before = self._sides(self.f.symbols, "symbol_key", "qname")
        both = now.withColumn("change", F.lit("added")).unionAll(before.withColumn("change", F.lit("removed")))
        return both.select("snapshot_id", "change", F.col("symbol_key").alias("_key"), F.col("qname").alias("_qname"))

    def _label(self, rows: DataFrame, key: str, out: str, absent: Column | None = None) -> DataFrame:
        """Adds the qname of a key in the snapshot that holds the row."""
        joined = rows.withColumn("_key", F.col(key)).join(self._names, ["snapshot_id", "change", "_key"], "left")
        return joined.withColumn(out, F.coalesce("_qname", F.col(key) if absent is None else absent)).drop("_key", "_qname")

    @cached_property
    def calls(self) -> DataFrame:
        rows = self._subtract("calls", CALL_KEY, "dispatch")
        return self._label(self._label(rows, "caller_symbol_key", "caller_qname"), "callee_symbol_key", "callee_qname")

    @cached_property
    def refs(self) -> DataFrame:
        rows = self._subtract("refs", REF_KEY)
        return self._label(self._label(rows, "from_symbol_key", "from_qname", F.lit("")), "to_symbol_key", "to_qname")

    @cached_property
    def test_links(self) -> DataFrame:
        return self._label(self._subtract("test_links", LINK_KEY), "symbol_key", "symbol_qname")

    # -- what they mean for a symbol -------------------------------------------------

    @cached_property
    def _edge_ends(self) -> DataFrame:
        """One row per end of a changed edge: snapshot_id, qname, counter, both (the edge's other end is the same symbol), and where."""

        def end(rows: DataFrame, name: str, counter: str, stage: int, *order: str, other: str | None = None, package: str | None = None, file: bool = True) -> DataFrame:
            return rows.select(
                "snapshot_id", F.trim(name).alias("qname"), F.concat("change", F.lit("_" + counter)).alias("event"), (F.col(other) == F.col(name) if other else F.lit(False)).alias("both"),
                F.trim(F.col("file_path") if file else F.lit("")).alias("file"), F.trim(F.col(package) if package else F.lit("")).alias("package"),
                (F.lit(stage) + F.when(F.col("change") == "removed", 1).otherwise(0)).alias("stage"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)],
            )

        calls, refs, links = self.calls, self.refs, self.test_links
        return reduce(DataFrame.unionAll, [
            end(calls, "caller_qname", "callees", 4, "caller_qname", "callee_qname"),
            end(calls, "callee_qname", "callers", 4, "caller_qname", "callee_qname", other="caller_qname"),
            end(refs, "to_qname", "refs_in", 6, "to_qname", "from_qname"),
            end(refs, "from_qname", "refs_out", 6, "to_qname", "from_qname", other="to_qname", package="from_package_import_path"),
            end(links, "symbol_qname", "tests", 8, "symbol_qname", "test_key", file=False),
        ]).where("qname <> ''")

    @cached_property
    def impacted(self) -> DataFrame:
        """Per snapshot and qname: status, flags, counters, package, file, blast radius, delta score and the sorted reasons."""
        none = F.lit(None).cast("string")
        edges = self._edge_ends.select("snapshot_id", "qname", "event", "file", "package", F.struct("stage", "order0", F.col("order1").alias("order1"), "file").alias("at"))
        flags = F.array_compact(F.array(F.concat(F.lit("status_"), "change"), F.when(F.col("contract_changed"), F.lit("contract")), F.when(F.col("moved"), F.lit("moved"))))
        mine = self.symbols.select(
            "snapshot_id", F.trim("qname").alias("qname"), F.explode(flags).alias("event"), F.trim(F.coalesce("to_file_path", "from_file_path")).alias("file"),
            F.trim(F.coalesce("to_package_import_path", "from_package_import_path")).alias("package"),
            F.struct(F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", 2).otherwise(3).alias("stage"), none.alias("order0"), none.alias("order1"), F.trim(F.coalesce("to_file_path", "from_file_path")).alias("file")).alias("at"),
        )
        rows = edges.unionByName(mine).where("qname <> ''")

        def there(event: str) -> Column:
            return F.count_if(F.col("event") == event) > 0

        folded = rows.groupBy("snapshot_id", "qname").agg(
            *[F.count_if(F.col("event") == c).alias(c) for c in COUNTERS],
            *[there(e).alias(f"_{e}") for e in ("status_added", "status_removed", "status_changed", "contract", "moved")],
            F.min_by("package", F.when(F.col("package") != "", F.col("at"))).alias("package_import_path"), F.min_by("file", F.when(F.col("file") != "", F.col("at"))).alias("file_path"),
        )
        status = F.when(F.col("_status_removed"), "removed").when(F.col("_status_added"), "added").when(F.col("_status_changed"), "changed").otherwise("")
        blast = reduce(lambda a, b: a + b, [F.col(c) for c in COUNTERS])
        out = folded.withColumn("status", status).withColumn("blast_radius", blast)
        score = F.col("blast_radius") + F.when(F.col("status").isin("added", "removed"), 12).when(F.col("status") == "changed", 8).otherwise(0)
        score = score + F.when(F.col("_contract"), 8).otherwise(0) + F.when(F.col("_moved"), 4).otherwise(0)
        said = [(F.col(f"_status_{s}"), WHY[s]) for s in ("added", "removed")] + [(F.col(f"_{s}"), WHY[s]) for s in ("contract", "moved")] + [(F.col(c) > 0, WHY[c]) for c in COUNTERS]
        why = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(on, F.lit(text)) for on, text in said]))), "; ")
        return out.select(
            "snapshot_id", "qname", F.coalesce("package_import_path", F.lit("")).alias("package_import_path"), F.coalesce("file_path", F.lit("")).alias("file_path"), "status",
            F.col("_contract").alias("contract_changed"), F.col("_moved").alias("moved"), *COUNTERS, "blast_radius", score.alias("delta_score"), why.alias("why"),
        )

    @cached_property
    def symbol_events(self) -> DataFrame:
        """Per snapshot and qname: status (introduced, removed, changed), flags, and edges that came and went, each counted once."""
        ends = self._edge_ends.where("NOT both").select("snapshot_id", "qname", F.regexp_replace("event", "_(callers|callees)$", "_calls").alias("event"))
        ends = ends.select("snapshot_id", "qname", F.regexp_replace("event", "_refs_(in|out)$", "_refs").alias("event"))
        flags = F.array_compact(F.array(F.concat(F.lit("status_"), "change"), F.when(F.col("contract_changed"), F.lit("contract")), F.when(F.col("moved"), F.lit("moved"))))
        rows = ends.unionAll(self.symbols.select("snapshot_id", F.trim("qname").alias("qname"), F.explode(flags).alias("event")))
        counts = [f"{change}_{c}" for c in ("calls", "refs", "tests") for change in ("added", "removed")]
        folded = rows.groupBy("snapshot_id", "qname").agg(
            *[F.count_if(F.col("event") == c).alias(c) for c in counts], *[(F.count_if(F.col("event") == e) > 0).alias(f"_{e}") for e in ("status_added", "status_removed", "contract", "moved")]
        )
        status = F.when(F.col("_status_removed"), "removed").when(F.col("_status_added"), "introduced").otherwise("changed")
        return folded.select("snapshot_id", "qname", status.alias("status"), F.col("_contract").alias("contract_changed"), F.col("_moved").alias("moved"), *counts)

    # -- what they mean for a package --------------------------------------------------

    @cached_property
    def package_events(self) -> DataFrame:
        """Per snapshot and package: status, file, symbol and test deltas, dependencies that came and went, moved symbols, changed contracts."""
        counted = self.packages.select("snapshot_id", "import_path", "status", *[(F.col(f"to_{c}_count") - F.col(f"from_{c}_count")).alias(f"{c}_delta") for c in ("file", "symbol", "test")])
        changed = self.symbols.where("change = 'changed'").select(
            "snapshot_id", F.explode(F.array_distinct(F.array("from_package_import_path", "to_package_import_path"))).alias("import_path"), "contract_changed", "moved"
        )
        changed = changed.groupBy("snapshot_id", "import_path").agg(F.count_if("moved").alias("moved_symbols"), F.count_if("contract_changed").alias("changed_contracts"))
        ends = self.deps.select("snapshot_id", F.explode(F.array_distinct(F.array(*DEP_KEY))).alias("import_path"), "change")
        ends = ends.groupBy("snapshot_id", "import_path").agg(F.count_if(F.col("change") == "added").alias("added_deps"), F.count_if(F.col("change") == "removed").alias("removed_deps"))
        key = ["snapshot_id", "import_path"]
        numbers = ["file_delta", "symbol_delta", "test_delta", "added_deps", "removed_deps", "moved_symbols", "changed_contracts"]
        joined = counted.join(changed, key, "full_outer").join(ends, key, "full_outer").where("import_path <> ''")
        return joined.fillna(0, numbers).fillna("changed", ["status"]).select(*key, "status", *numbers)

    @cached_property
    def touched_packages(self) -> DataFrame:
        """Packages that a pair touches, as symbols, counts, dependencies or owners of files: snapshot_id, import_path, by_file."""
        both = F.explode(F.array("from_package_import_path", "to_package_import_path")).alias("import_path")
        graph = [
            self.packages.select("snapshot_id", "import_path"), self.symbols.select("snapshot_id", both), self.deps.select("snapshot_id", both),
        ]
        rows = reduce(DataFrame.unionAll, graph).withColumn("by_file", F.lit(False)).unionAll(self.files.select("snapshot_id", F.col("package_import_path").alias("import_path"), F.lit(True).alias("by_file")))
        return rows.where("import_path <> ''").groupBy("snapshot_id", "import_path").agg(F.min("by_file").alias("by_file"))


def changed_symbol_counts(f: Facts) -> DataFrame:
    """Per snapshot: distinct qnames that are new, changed in signature, file or line, or gone."""
    return Diffs(f).symbols.groupBy("snapshot_id").agg(F.count_distinct("qname").alias("changed_symbols"))


# -- histories --------------------------------------------------------------------------


def _introduced(f: Facts, first: DataFrame, events: DataFrame, zero: list[str], flags: list[str]) -> DataFrame:
    """Events with a first one where none tells the beginning: of the first snapshot that holds the subject (``first``: snapshot_id, one row)."""
    began = events.where("status = 'introduced'").select(F.lit(1).alias("_one")).limit(1)
    start = first.join(began, F.lit(True), "left_anti")
    added = start.select("snapshot_id", F.lit(0).cast("long").alias("from_id"), F.lit("introduced").alias("status"), *[F.lit(False).alias(c) for c in flags], *[F.lit(0).cast("long").alias(c) for c in zero])
    with_from = events.join(f.pairs.select(F.col("id").alias("snapshot_id"), F.col("prev_id").alias("from_id")), "snapshot_id", "left")
    return with_from.select("snapshot_id", "from_id", "status", *flags, *[F.col(c).cast("long").alias(c) for c in zero]).unionByName(added)


def symbol_history(f: Facts, symbol_key: str, limit: int = 10) -> DataFrame:
    """Events of the qname of a current symbol, the newest first."""
    qname = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("qname").first()[0]
    events = Diffs(f, qname=qname).symbol_events.where(F.col("qname") == F.trim(F.lit(qname))).drop("qname")
    first = f.symbols.where(F.col("qname") == qname).agg(F.min("snapshot_id").alias("snapshot_id")).where("snapshot_id IS NOT NULL")
    rows = _introduced(f, first, events, ["added_calls", "removed_calls", "added_refs", "removed_refs", "added_tests", "removed_tests"], ["contract_changed", "moved"])
    return rows.orderBy(F.desc("snapshot_id"), "status").limit(limit)


def package_history(f: Facts, import_path: str, limit: int = 10) -> DataFrame:
    """Events of a package, the newest first."""
    events = Diffs(f).package_events.where(F.col("import_path") == import_path).drop("import_path")
    first = f.packages.where(F.col("import_path") == import_path).agg(F.min("snapshot_id").alias("snapshot_id")).where("snapshot_id IS NOT NULL")
    rows = _introduced(f, first, events, ["file_delta", "symbol_delta", "test_delta", "added_deps", "removed_deps", "moved_symbols", "changed_contracts"], [])
    return rows.orderBy(F.desc("snapshot_id"), "status").limit(limit)


# -- co-change ----------------------------------------------------------------------------


def _counted(labels: DataFrame, hits: DataFrame) -> DataFrame:
    """label, change_count and its share of the anchor's changes; ``labels``: snapshot_id, label."""
    total = hits.agg(F.count(F.lit(1)).alias("anchor_changes"))  # one row
    counts = labels.where("label <> ''").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("change_count"))
    return counts.join(F.broadcast(total)).withColumn("frequency", F.round(F.col("change_count") / F.col("anchor_changes"), 6)).select("label", "change_count", "frequency")


def symbol_cochange(f: Facts, symbol_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, packages, hits): what changes in the snapshots that touch a symbol, without the symbol's own places in each."""
    me = f.at("symbols").where(F.col("symbol_key") == symbol_key).select("qname", "file_path", "package_import_path").first()
    d, mine = Diffs(f), Diffs(f, qname=me["qname"])
    hits = stage(mine.symbol_events.where(F.col("qname") == F.trim(F.lit(me["qname"]))).select("snapshot_id").distinct(), "anchor-changes")
    own = mine.symbols.where(F.col("qname") == me["qname"])

    def labels(rows: DataFrame, label: str, sides: list[str], current: str) -> DataFrame:
        places = own.select("snapshot_id", F.explode(F.array(*sides)).alias("label"))
        seen = rows.select("snapshot_id", F.col(label).alias("label")).where(F.col("label") != current).join(hits, "snapshot_id", "left_semi")
        return seen.join(places, ["snapshot_id", "label"], "left_anti")

    files = labels(d.files, "rel_path", ["from_file_path", "to_file_path"], me["file_path"])
    packages = labels(d.touched_packages, "import_path", ["from_package_import_path", "to_package_import_path"], me["package_import_path"])
    return _counted(files, hits), _counted(packages, hits), hits


def package_cochange(f: Facts, import_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, packages, hits): what changes in the snapshots that affect a package, outside of it."""
    d = Diffs(f)
    touched = stage(d.touched_packages, "touched-packages")
    hits = touched.where((F.col("import_path") == import_path) & ~F.col("by_file")).select("snapshot_id")
    files = d.files.where(F.col("package_import_path") != import_path).select("snapshot_id", F.col("rel_path").alias("label"))
    packages = touched.where(F.col("import_path") != import_path).select("snapshot_id", F.col("import_path").alias("label"))
    return _counted(files.join(hits, "snapshot_id", "left_semi"), hits), _counted(packages.join(hits, "snapshot_id", "left_semi"), hits), hits


def top(items: DataFrame, limit: int = 8) -> DataFrame:
    return items.orderBy(F.desc("change_count"), "label").limit(limit if limit > 0 else 8)
