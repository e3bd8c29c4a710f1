import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import snapshot_delta as sd


def brute(rows, pairs):
    valid = {}
    for p, k, v, at in rows:
        if p is not None and k is not None:
            best = valid.get((p, k))
            if best is None or (at or "") >= best[1]:
                valid[p, k] = (v, at or "")
    out = set()
    for a, b in pairs:
        old, new = ({k: v[0] for (p, k), v in valid.items() if p == s} for s in (a, b))
        out |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()}
        out |= {(b, k, "changed") for k in new.keys() & old.keys() if new[k] is not None and old[k] is not None and new[k] != old[k]}
    return out


def run(spark, rows, pairs, **kw):
    df = spark.createDataFrame(rows, "period long, record_key string, value string, loaded_at string").withColumn("k1", F.lit("clash"))
    return {(r.period, r.record_key, r.change_kind) for r in sd.snapshot_changes(spark, {"t": df}, pairs, **kw).collect()}


def test_nulls_redeliveries_and_copies(spark):
    rows = [(1, "a", "x", "1"), (1, "a", "y", "2"), (1, "b", None, "1"), (1, "c", "x", "1"), (2, "a", "y", "1"), (2, "b", "x", "1"), (2, "d", "x", "1"), (2, "d", "x", "1"), (None, "e", "x", "1"), (2, None, "x", "1"), (4, "a", "z", None), (4, "d", "x", "9")]
    pairs = [(1, 2), (2, 4)]
    assert run(spark, rows, pairs) == brute(rows, pairs)


def test_empty_and_single_snapshots(spark):
    assert run(spark, [], [(1, 2)]) == set()
    assert run(spark, [(1, "a", "x", "1")], []) == set()
    assert run(spark, [(1, "a", "x", "1")], [(1, 2)]) == {(2, "a", "removed")}


@pytest.mark.parametrize("cells,per_bucket", [(512, 4096), (8, 200), (1, 10_000)])
def test_enlarged_and_exact_buckets(spark, cells, per_bucket):
    rng = random.Random(cells)
    rows = []
    for p in (1, 2, 3):
        for i in range(600):
            if rng.random() < 0.7:
                rows.append((p, f"k{i}é", rng.choice("xyz"), "1"))
    pairs = [(1, 2), (2, 3)]
    assert run(spark, rows, pairs, cells=cells, records_per_bucket=per_bucket) == brute(rows, pairs)


def test_hash_equals_spark(spark):
    values = [(0, -1, 2**63 - 1), (-(2**63), 5, 7), (123456789, -987654321, 42)]
    df = spark.createDataFrame(values, "a long, b long, c long")
    want = [r[0] for r in df.select(F.xxhash64("a", "b", "c")).collect()]
    assert sd.hash_longs(*(np.array([v[i] for v in values]) for i in range(3))).tolist() == want


def test_several_tables_have_their_own_keys(spark):
    make = lambda rows: spark.createDataFrame(rows, "period long, record_key string, value string")
    out = sd.snapshot_changes(spark, {"a": make([(1, "k", "x")]), "b": make([(1, "k", "x"), (2, "k", "x"), (2, "k", "x")])}, [(1, 2)])
    assert {tuple(r) for r in out.collect()} == {("a", 2, "k", "removed")}


def test_without_the_pre_filter(spark):
    """Beyond the limit of keys the names come from a shuffled join: the same rows."""
    rng = random.Random(7)
    rows = [(p, f"k{i}", rng.choice("xy"), "1") for p in (1, 2, 3) for i in range(300) if rng.random() < 0.8]
    pairs = [(1, 2), (2, 3)]
    assert run(spark, rows, pairs, prefilter_keys=0) == run(spark, rows, pairs) == brute(rows, pairs)
