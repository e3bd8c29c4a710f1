"""References to records that do not exist, per table and period.

Keys are dictionary-encoded as integers, each (table, period) becomes a set of
compressed bitmaps over ranges of those integers, and the orphans are the bits
of ``reference AND NOT parent AND NOT universal``, decoded through the
dictionary.

Scale: the key strings are shuffled once, already combined to one row per
distinct key and input partition (a key that holds a third of all rows is one
row there).  Bitmaps move as 4 KB containers.  The reference rows themselves
are only read again to name the owners, behind a size-checked pre-filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..joins import prefilter
from ..tables import present
from ..workspace import stage
from . import bitmaps

#: Periods that one mask column holds.
_MASK_BITS = 62


def _periods(frames: list[DataFrame]) -> list[int]:
    """The distinct period ids: a list as long as there are snapshots."""
    ids = reduce(DataFrame.unionAll, [f.select(F.col("period").cast("long").alias("period")) for f in frames])
    return sorted(r.period for r in ids.where("period IS NOT NULL").distinct().collect())


def dictionary(references: dict[str, DataFrame], parents: DataFrame, universal: DataFrame, periods: list[int]) -> DataFrame:
    """One row per distinct key: key_id, key, and masks of the periods in which each table names or holds it."""
    kinds = [*references, "_parent"]
    blocks = range(-(-max(1, len(periods)) // _MASK_BITS))
    place = F.array_position(F.array(*[F.lit(p).cast("long") for p in periods] or [F.lit(None).cast("long")]), F.col("period").cast("long")).cast("int") - 1

    def masked(frame: DataFrame, kind: int) -> DataFrame:
        return frame.where(present("key") & F.col("period").isNotNull()).select("key", F.lit(kind).alias("kind"), place.alias("place"))

    rows = [masked(f.select(F.col("missing_key").alias("key"), "period"), i) for i, f in enumerate(references.values())]
    rows.append(masked(parents.select("key", "period"), len(references)))
    rows.append(universal.where(present("key")).select("key", F.lit(-1).alias("kind"), F.lit(None).cast("int").alias("place")))
    masks = [
        F.coalesce(
            F.bit_or(F.when((F.col("kind") == i) & (F.floor(F.col("place") / _MASK_BITS) == b), F.expr(f"shiftleft(1L, place % {_MASK_BITS})"))),
            F.lit(0).cast("long"),
        ).alias(f"mask_{i}_{b}")
        for i in range(len(kinds))
        for b in blocks
    ]
    merged = reduce(DataFrame.unionAll, rows).groupBy("key").agg(*masks, F.max(F.col("kind") == -1).alias("universal"))
    return merged.withColumn("key_id", F.monotonically_increasing_id() + 1)


def _members(keys: DataFrame, kinds: int, blocks: int) -> DataFrame:
    """Rows (kind, place, key_id), read off the masks of the dictionary."""
    masks = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.lit(b).alias("block"), F.col(f"mask_{i}_{b}").alias("mask"))
            for i in range(kinds)
            for b in range(blocks)
        ]
    )
    held = keys.select("key_id", F.explode(F.filter(masks, lambda m: m["mask"] != 0)).alias("m"))
    bits = F.expr(f"filter(sequence(0, {_MASK_BITS - 1}), i -> (shiftrightunsigned(m.mask, i) & 1L) = 1L)")
    return held.select("key_id", F.col("m.kind").alias("kind"), F.col("m.block").alias("block"), F.explode(bits).alias("bit")).select(
        "kind", (F.col("block") * _MASK_BITS + F.col("bit")).alias("place"), "key_id"
    )


def orphan_keys(references: dict[str, DataFrame], parents: DataFrame, universal: DataFrame) -> DataFrame:
    """Distinct (table_name, period, key) for keys that no parent of the period and no universal record has.

    ``references``: per table name a DataFrame with ``period`` and
    ``missing_key``; ``parents``: ``period``, ``key``; ``universal``: ``key``.
    Null or '' keys and null periods name nothing and are no orphans.  Empty
    tables give no rows; a period without any parents makes all its references
    orphans.
    """
    periods = _periods([*references.values(), parents])
    spark = parents.sparkSession
    names = list(references)
    blocks = -(-max(1, len(periods)) // _MASK_BITS)
    keys = stage(dictionary(references, parents, universal, periods), "orphan-keys")
    members = _members(keys, len(names) + 1, blocks)
    built = stage(bitmaps.build(members, ["kind", "place"], "key_id"), "orphan-bitmaps")
    named = built.where(F.col("kind") < len(names)).withColumnRenamed("container", "referring")
    held = built.where(F.col("kind") == len(names)).select("place", "key_range", F.col("container").alias("holding"))
    always = bitmaps.build(keys.where("universal"), [], "key_id").withColumnRenamed("container", "everywhere")
    both = named.join(held, ["place", "key_range"], "left").join(always, "key_range", "left")
    lost = bitmaps.and_not(both, ["kind", "place"], "referring", ["holding", "everywhere"], "key_id")
    decoded = lost.join(keys.select("key_id", "key"), "key_id")
    tables = F.array(*[F.lit(n) for n in names])
    values = F.array(*[F.lit(p).cast("long") for p in periods] or [F.lit(None).cast("long")])
    return decoded.select(tables[F.col("kind")].alias("table_name"), values[F.col("place")].alias("period"), "key") if names else spark.createDataFrame([], "table_name string, period long, key string")


def orphan_references(references: dict[str, DataFrame], parents: DataFrame, universal: DataFrame) -> DataFrame:
    """The orphan keys with their owners: distinct (table_name, period, owner_key, missing_key).

    ``references`` carry ``owner_key`` besides ``period`` and ``missing_key``;
    a null owner stays null.  Other columns are ignored.
    """
    lost = stage(orphan_keys(references, parents, universal), "orphans")
    count = lost.count()
    found = []
    for name, frame in references.items():
        mine = lost.where(F.col("table_name") == name).select(F.col("period").alias("_period"), F.col("key").alias("_key"))
        rows = frame.where(present("missing_key")).select(F.col("period").cast("long").alias("period"), "owner_key", "missing_key")
        near = prefilter(rows, F.struct("period", "missing_key"), mine, F.struct(F.col("_period").alias("period"), F.col("_key").alias("missing_key")), count)
        hit = near.join(mine, (F.col("period") == F.col("_period")) & (F.col("missing_key") == F.col("_key")), "left_semi")
        found.append(hit.select(F.lit(name).alias("table_name"), "period", "owner_key", "missing_key"))
    return reduce(DataFrame.unionAll, found).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period: rows, distinct owners and distinct missing keys."""
    return orphans.groupBy("table_name", "period").agg(
        F.count(F.lit(1)).alias("orphan_rows"),
        F.count_distinct("owner_key").alias("owners"),
        F.count_distinct("missing_key").alias("missing_keys"),
    )
