import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stratagraph.operators import bitmaps, orphans

REF = "period long, owner_key string, missing_key string"


def run(spark, refs, parents, universal, extra=False):
    frames = {name: spark.createDataFrame(rows, REF) for name, rows in refs.items()}
    if extra:
        frames = {k: v.withColumn("key", F.lit("clash")).withColumn("kind", F.lit(1)) for k, v in frames.items()}
    out = orphans.orphan_references(frames, spark.createDataFrame(parents, "period long, key string"), spark.createDataFrame(universal, "key string"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def brute(refs, parents, universal):
    held, always = set(parents), {u[0] for u in universal}
    found = {(t, p, o, k) for t, rows in refs.items() for p, o, k in rows if p is not None and k and (p, k) not in held and k not in always}
    return sorted(found, key=repr)


def test_nulls_repeats_and_clashing_columns(spark):
    refs = {"a": [(1, "o", "x"), (1, "o", "x"), (1, None, "y"), (2, "", "x"), (None, "o", "x"), (1, "o", None), (1, "o", ""), (1, "o", "lib")], "b": [(3, "o", "z"), (1, "o", "X")]}
    parents, universal = [(1, "x"), (2, "y"), (None, "z"), (3, None)], [("lib",), (None,), ("",)]
    assert run(spark, refs, parents, universal, True) == brute(refs, parents, universal)


def test_empty_tables(spark):
    assert run(spark, {"a": []}, [], []) == []
    assert run(spark, {"a": [(1, "o", "x")]}, [], []) == [("a", 1, "o", "x")]


def test_hot_key_and_many_periods(spark):
    rng = random.Random(2)
    refs = {"a": [(rng.randrange(150), f"o{i % 7}", "hot" if i % 3 == 0 else f"k{rng.randrange(400)}" + "ü" * (i % 2)) for i in range(4000)]}
    parents = [(rng.randrange(150), f"k{i % 400}") for i in range(6000)] + [(p, "hot") for p in range(0, 150, 2)]
    assert run(spark, refs, parents, [("k3",)]) == brute(refs, parents, [("k3",)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 5, 9]), st.sampled_from(["", "o"]), st.sampled_from([None, "", "a", "b", "c"])), max_size=20), st.lists(st.tuples(st.sampled_from([1, 5, 9]), st.sampled_from("abc")), max_size=8))
def test_against_brute_force(spark, rows, parents):
    assert run(spark, {"t": rows}, parents, [("c",)]) == brute({"t": rows}, parents, [("c",)])


def test_containers_round_trip():
    import numpy as np

    for members in ([], [0], [1, 32767], list(range(0, 32768, 3))):
        bits = np.zeros(bitmaps.RANGE, dtype=bool)
        bits[members] = True
        packed = bitmaps.compress(np.packbits(bits, bitorder="little").tobytes())
        assert np.flatnonzero(bitmaps.expand(packed)).tolist() == members
        assert len(packed) <= 4097


def test_report(spark):
    rows = spark.createDataFrame([("a", 1, "o", "x"), ("a", 1, "p", "x")], "table_name string, period long, owner_key string, missing_key string")
    assert [tuple(r) for r in orphans.orphan_report(rows).collect()] == [("a", 1, 2, 2, 1)]


def test_without_prefilter(spark, monkeypatch):
    from stratagraph import joins

    monkeypatch.setattr(joins.prefilter, "__defaults__", (0,))
    refs = {"a": [(1, "o", "x"), (2, "p", "y")]}
    assert run(spark, refs, [(1, "x")], []) == [("a", 2, "p", "y")]
