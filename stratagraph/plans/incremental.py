"""What has to be analysed again after a change of files.

The difference of two listings is a join; the policy over manifests looks at
the few manifest rows of that difference on the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources import manifests

CHECKSUM_FILES = {"go.sum", "Cargo.lock", "poetry.lock"}
MANIFESTS = (*manifests.PARSERS, *CHECKSUM_FILES)


class Plan:
    """Changed paths by kind, impacted packages, and why.

    ``touched`` (import_path) holds the impacted packages, however many; it is
    read from the two listings when it is used.  ``scoped`` says whether there
    are any.
    """

    def __init__(self, full: bool = False, packages: list[str] | None = None, reasons: list[str] | None = None, deltas: list[dict] | None = None) -> None:
        self.full, self.scoped, self.everything = full, bool(packages), False
        self.reasons, self.deltas = reasons or [], deltas or []
        self.touched: DataFrame | None = None
        if packages is not None:
            self.packages = packages

    @cached_property
    def packages(self) -> list[str]:
        """All impacted packages on the driver, for callers that name them one by one."""
        return [] if self.touched is None else sorted(r[0] for r in self.touched.collect())

    def impacted(self, spark: SparkSession) -> DataFrame:
        """All impacted packages: import_path."""
        return spark.createDataFrame([(p,) for p in self.packages], "import_path string") if self.touched is None else self.touched

    @property
    def reason(self) -> str:
        return "; ".join(dict.fromkeys(r.strip() for r in self.reasons if r.strip()))


def file_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """rel_path, change (added, changed, deleted) and the package, where the previous one wins.

    Both sides: rel_path, hash, package_import_path, semantic_meta.
    """
    a = current.select("rel_path", F.col("hash").alias("_new"), F.col("package_import_path").alias("_np"), F.col("semantic_meta").alias("new_meta"), F.lit(True).alias("_a"))
    b = previous.select("rel_path", F.col("hash").alias("_old"), F.col("package_import_path").alias("_op"), F.col("semantic_meta").alias("old_meta"), F.lit(True).alias("_b"))
    both = a.join(b, "rel_path", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
    package = F.coalesce(F.nullif(T.trimmed("_op"), F.lit("")), F.nullif(T.trimmed("_np"), F.lit("")), F.lit(""))
    return both.select("rel_path", change.alias("change"), package.alias("package_import_path"), "old_meta", "new_meta").where("change IS NOT NULL")


def detect(current: DataFrame, previous: DataFrame) -> Plan:
    """The plan of a refresh; an empty previous listing means everything.

    Where a plan is full or a manifest concerns all packages, all of both listings are touched.
    """
    owners = current.select("package_import_path").union(previous.select("package_import_path"))
    everything = owners.select(T.trimmed("package_import_path").alias("import_path")).where("import_path <> ''").distinct()
    if previous.isEmpty():
        plan = Plan(full=True, reasons=["no previous snapshot"])
        plan.touched, plan.scoped = everything, not everything.isEmpty()
        return plan
    changes = file_changes(current, previous)
    name = T.base_name("rel_path")
    plan = Plan()
    for row in changes.where(name.isin(*MANIFESTS)).orderBy("rel_path").collect():  # manifests: a few per project
        decide(plan, row.rel_path, row.change, manifests.decode(row.old_meta), manifests.decode(row.new_meta))
    sources = changes.where(~name.isin(*MANIFESTS))
    owned = F.col("package_import_path") != ""
    seen = sources.agg(F.bool_or((F.col("change") == "deleted") & ~owned).alias("lost"), F.bool_or(owned).alias("scoped")).first()
    if seen.lost:
        plan.full = True
        plan.reasons.append("deleted file with unknown package")
    if plan.full or plan.everything:
        plan.touched, plan.scoped = everything, not everything.isEmpty()
    else:
        plan.touched, plan.scoped = sources.where(owned).select(F.col("package_import_path").alias("import_path")).distinct(), bool(seen.scoped)
    if seen.scoped or plan.everything and plan.scoped:
        plan.reasons.append("package-scoped changes")
    if not plan.reasons:
        plan.reasons.append("no indexed file changes")
    return plan


def decide(plan: Plan, path: str, change: str, old: dict, new: dict) -> None:
    """What one changed manifest means: nothing, its packages, or everything."""
    kind = path.rsplit("/", 1)[-1]
    impact, why = "noop", "changed without semantic package impact"
    if kind in CHECKSUM_FILES:
        why = "dependency checksum file changed"
    elif change == "deleted":
        impact, why = "full", "deleted"
    else:
        identity = "module" if kind == "go.mod" else "name"
        version = {"go.mod": "go_version", "Cargo.toml": "edition"}.get(kind, "requires_python")
        lists = {k: manifests.list_delta(old.get(k, []), new.get(k, [])) for k in manifests.LISTS}
        if kind in ("go.mod", "Cargo.toml", "pyproject.toml") and not (old.get(identity) and new.get(identity)) and not new.get("workspace_members"):
            impact, why = "full", "changed without stable identity"
        elif old.get(identity) != new.get(identity):
            impact, why = "full", f"{identity} changed: {old.get(identity, '')} -> {new.get(identity, '')}"
        elif any(lists["package_roots"]) or any(lists["workspace_members"]) or any(lists["workspace_exclude"]):
            impact, why = "full", "package layout changed"
        elif any(lists["local_deps"]):
            impact, why = "package", "local dependencies changed"
        elif old.get(version) and new.get(version) and old[version] != new[version]:
            impact, why = "package", f"{version} changed: {old[version]} -> {new[version]}"
        elif any(lists["features"]):
            impact, why = "package", "features changed"
        elif any(lists["external_deps"]):
            why = "dependency requirements changed without local package move"
    plan.deltas.append({"rel_path": path, "kind": kind, "impact": impact, "details": why})
    plan.reasons.append(f"{kind} {why}: {path}")
    if impact == "full":
        plan.full = True
    elif impact == "package":
        plan.everything = True


def expanded(plan: Plan, package_deps: DataFrame) -> DataFrame:
    """The impacted packages and those that depend on them, one step: import_path."""
    mine = plan.impacted(package_deps.sparkSession)
    near = package_deps.join(mine, F.col("to_package_import_path") == F.col("import_path"), "left_semi").select(F.col("from_package_import_path").alias("import_path"))
    return mine.union(near).distinct()


def expand(plan: Plan, package_deps: DataFrame) -> list[str]:
    """``expanded`` on the driver, for callers that name packages one by one."""
    return sorted(r[0] for r in expanded(plan, package_deps).collect())


def reuse_percent(total: int, expanded: int) -> int:
    return (total - expanded) * 100 // total if total > 0 else 0
