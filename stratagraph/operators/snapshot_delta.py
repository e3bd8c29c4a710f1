"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Every record is a 128-bit key hash and a 64-bit value hash.  Records fall into
hash buckets; a bucket of a snapshot becomes a small table of cells, each the
count and the XOR of the records that hash to it.  Subtracting the tables of
two consecutive snapshots leaves only the differences, which are peeled off
cell by cell.  A bucket whose table was too small is built again with more
cells, and in the end compared exactly; each peeled bucket is verified against
an independent digest.

Scale: the records are shuffled once as hashes (to keep one row per key), the
cells are combined before their shuffle, and one bucket of cells, whose size is
a parameter, is all that a peeling task holds.  No snapshot is ever sorted or
joined against another.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..joins import PREFILTER_KEYS, prefilter
from ..workspace import stage

#: Records of one snapshot that a bucket is meant to hold, and cells of each of its three parts at first.
RECORDS_PER_BUCKET, CELLS = 4096, 512
#: Times the cells of a failed bucket are made four times as many before it is compared exactly.
ENLARGEMENTS = 3
PARTS = 3
_DIGEST = -1

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """``xxhash64`` of Spark over long columns, as signed 64-bit numbers."""
    h = np.full(len(columns[0]), 42, dtype=np.uint64)
    for column in columns:
        k = _rotate(column.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = _rotate((h + _P5 + np.uint64(8)) ^ k, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _cell_of(check: np.ndarray, part: int, cells: int) -> np.ndarray:
    return part * cells + hash_longs(check, np.full(len(check), part, dtype=np.int64)) % cells


def peel(n: np.ndarray, k1: np.ndarray, k2: np.ndarray, v: np.ndarray, c: np.ndarray, cells: int) -> tuple[pd.DataFrame, bool]:
    """Recovered records with their sign, and whether nothing is left in the cells."""
    n, k1, k2, v, c = (a.copy() for a in (n, k1, k2, v, c))
    found: list[np.ndarray] = []
    while True:
        at = np.flatnonzero(np.abs(n) == 1)
        at = at[hash_longs(k1[at], k2[at], v[at]) == c[at]]
        if not len(at):
            break
        rows = np.unique(np.stack([k1[at], k2[at], v[at], c[at], n[at]], axis=1), axis=0)
        found.append(rows)
        for part in range(PARTS):
            where = _cell_of(rows[:, 3], part, cells)
            np.subtract.at(n, where, rows[:, 4])
            for target, values in ((k1, rows[:, 0]), (k2, rows[:, 1]), (v, rows[:, 2]), (c, rows[:, 3])):
                np.bitwise_xor.at(target, where, values)
        if sum(map(len, found)) > 2 * len(n):
            return pd.DataFrame(), False
    clean = not (n.any() or k1.any() or k2.any() or v.any() or c.any())
    rows = np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)
    return pd.DataFrame(rows, columns=["k1", "k2", "v", "c", "sign"]), clean


_OUT = "table_name string, period long, bucket long, k1 long, k2 long, v long, sign int, failed boolean"


def _cells(records: DataFrame, cells: int) -> DataFrame:
    """Cells of every (table, period, bucket), and the bucket's digest at cell -1."""
    checked = records.withColumn("c", F.xxhash64("k1", "k2", "v"))
    spots = [(F.lit(p * cells) + F.pmod(F.xxhash64(F.col("c"), F.lit(p).cast("long")), F.lit(cells))).cast("int") for p in range(PARTS)]
    placed = checked.select("table_name", "period", "bucket", "k1", "k2", "v", "c", F.explode(F.array(F.lit(_DIGEST), *spots)).alias("cell"))
    check = F.when(F.col("cell") == _DIGEST, F.xxhash64(F.col("c"), F.lit(99).cast("long"))).otherwise(F.col("c"))
    return placed.groupBy("table_name", "period", "bucket", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.bit_xor("v").alias("v"), F.bit_xor(check).alias("c")
    )


def _paired(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows once per pair of snapshots they belong to: period becomes the later one, side is 1 for it and -1 for the earlier."""
    return rows.join(F.broadcast(pairs), rows["period"] == pairs["_of"]).drop("period", "_of").withColumnRenamed("_later", "period")


def _subtract_and_peel(cells: DataFrame, pairs: DataFrame, size: int, only: DataFrame | None) -> DataFrame:
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(PARTS * size + 1, dtype=np.int64)
        at = pdf["cell"].to_numpy()
        np.add.at(n, at, pdf["n"].to_numpy() * pdf["side"].to_numpy())
        fields = []
        for name in ("k1", "k2", "v", "c"):
            xored = np.zeros(PARTS * size + 1, dtype=np.int64)
            np.bitwise_xor.at(xored, at, pdf[name].to_numpy(dtype=np.int64))
            fields.append(xored)
        rows, clean = peel(n[:-1], *(f[:-1] for f in fields), cells=size)
        if clean:
            digest = np.bitwise_xor.reduce(hash_longs(rows["c"].to_numpy(np.int64), np.full(len(rows), 99))) if len(rows) else 0
            clean = digest == fields[3][_DIGEST] and rows["sign"].sum() == n[_DIGEST]
        head = {"table_name": key[0], "period": key[1], "bucket": key[2]}
        if not clean:
            return pd.DataFrame([{**head, "k1": 0, "k2": 0, "v": 0, "sign": 0, "failed": True}])
        return rows.assign(**head, failed=False)[["table_name", "period", "bucket", "k1", "k2", "v", "sign", "failed"]]

    paired = _paired(cells, pairs)
    if only is not None:
        paired = paired.join(only, ["table_name", "period", "bucket"], "left_semi")
    return paired.groupBy("table_name", "period", "bucket").applyInPandas(solve, _OUT)


def _exact(records: DataFrame, pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """The differences of the given buckets by comparing all their records."""
    mine = _paired(records, pairs).join(failed, ["table_name", "period", "bucket"], "left_semi")
    sides = mine.groupBy("table_name", "period", "bucket", "k1", "k2", "v").agg(F.sum("side").cast("int").alias("sign"))
    return sides.where("sign <> 0").withColumn("failed", F.lit(False)).select("table_name", "period", "bucket", "k1", "k2", "v", "sign", "failed")


def differences(records: DataFrame, pairs: list[tuple[int, int]], cells: int = CELLS, enlargements: int = ENLARGEMENTS) -> DataFrame:
    """Records that only one snapshot of a pair holds.

    ``records``: one row per (table_name, period, key) with bucket, k1, k2, v.
    ``pairs``: (earlier, later) period ids, as many as there are snapshots.
    Result: table_name, period (the later one), k1, k2, v, sign (1 new, -1 gone).
    """
    spark = records.sparkSession
    sides = [x for earlier, later in pairs for x in ((later, later, 1), (earlier, later, -1))]
    pair_rows = spark.createDataFrame(sides, "_of long, _later long, side int")
    todo, size, only, done = records, cells, None, []
    for step in range(enlargements + 1):
        solved = stage(_subtract_and_peel(_cells(todo, size), pair_rows, size, only), "delta-peeled")
        done.append(solved.where("NOT failed"))
        only = solved.where("failed").select("table_name", "period", "bucket")
        if only.isEmpty():
            break
        if step == enlargements:
            done.append(_exact(records, pair_rows, only))
            break
        both = only.join(F.broadcast(pair_rows), F.col("period") == F.col("_later"))
        todo = records.join(both.select("table_name", F.col("_of").alias("period"), "bucket").distinct(), ["table_name", "period", "bucket"], "left_semi")
        size *= 4
    return reduce(DataFrame.unionAll, done).select("table_name", "period", "k1", "k2", "v", "sign")


def hashed(frame: DataFrame, name: str, buckets: int) -> DataFrame:
    """Records of a table as hashes: the last delivered row per (period, record_key).

    ``frame``: period, record_key, value (null: nothing to compare), loaded_at.
    Rows with a null key or period are no records.  Ties in time go to the
    greater value hash.
    """
    keyed = frame.where("record_key IS NOT NULL AND period IS NOT NULL").select(
        F.col("period").cast("long").alias("period"),
        F.xxhash64("record_key").alias("k1"),
        F.xxhash64(F.lit(1), F.col("record_key")).alias("k2"),
        F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("value")).alias("v"),
        *(["loaded_at"] if "loaded_at" in frame.columns else []),
    )
    if "loaded_at" in frame.columns:
        one = keyed.groupBy("period", "k1", "k2").agg(F.max(F.struct("loaded_at", "v"))["v"].alias("v"))
    else:
        one = keyed.distinct()
    return one.select(F.lit(name).alias("table_name"), "period", F.pmod("k1", F.lit(buckets)).cast("long").alias("bucket"), "k1", "k2", "v")


def classify(diff: DataFrame) -> DataFrame:
    """table_name, period, k1, k2 and change_kind; a key on both sides is changed only if both values are present."""
    sides = diff.groupBy("table_name", "period", "k1", "k2").agg(
        F.max(F.when(F.col("sign") == 1, F.col("v"))).alias("new"), F.max(F.when(F.col("sign") == -1, F.col("v"))).alias("old")
    )
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when((F.col("old") != 0) & (F.col("new") != 0) & (F.col("old") != F.col("new")), "changed")
    )
    return sides.select("table_name", "period", "k1", "k2", kind.alias("change_kind")).where("change_kind IS NOT NULL")


def snapshot_changes(spark: SparkSession, tables: dict[str, DataFrame], pairs: list[tuple[int, int]], cells: int = CELLS, records_per_bucket: int = RECORDS_PER_BUCKET, prefilter_keys: int = PREFILTER_KEYS) -> DataFrame:
    """Distinct (table_name, period, record_key, change_kind) over all consecutive snapshots.

    ``tables``: per name a DataFrame with period, record_key, value and, where
    keys can be delivered again, loaded_at.  A snapshot without rows is an
    empty snapshot: everything before it is removed.  Empty tables and fewer
    than two snapshots give no rows.  Up to ``prefilter_keys`` changed keys are
    sent along to keep unchanged records out of the join that names them;
    beyond that the join shuffles, with the same rows.
    """
    periods = len({p for pair in pairs for p in pair}) or 1
    parts = [hashed(f, name, max(1, f.count() // periods // records_per_bucket)) for name, f in tables.items()]
    found = stage(classify(differences(reduce(DataFrame.unionAll, parts), pairs, cells)), "delta-found")
    count = found.count()
    out = []
    for name, frame in tables.items():
        mine = found.where(F.col("table_name") == name)
        source = frame.where("record_key IS NOT NULL AND period IS NOT NULL").select("record_key")
        near = prefilter(source.withColumn("k1", F.xxhash64("record_key")), F.col("k1"), mine, F.col("k1"), count, prefilter_keys)
        texts = near.distinct().select(F.col("k1"), F.xxhash64(F.lit(1), F.col("record_key")).alias("k2"), "record_key")
        out.append(mine.join(texts, ["k1", "k2"]).select("table_name", "period", "record_key", "change_kind"))
    return reduce(DataFrame.unionAll, out)
