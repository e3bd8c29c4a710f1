import pytest

from stratagraph.llm import mixture

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, n_tokens long"


def test_shares_caps_and_missing_sources(spark):
    docs = [(i, "big", 10) for i in range(3000)] + [(10_000 + i, "small", 10) for i in range(50)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "big", 0), (20_003, "big", None)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)]
    mixed, plan = mixture.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block_rows=100)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"big", "small"}
    assert all(r.copies == 3 for r in rows if r.source == "small") and sum(r.source == "small" for r in rows) == 50
    taken = sum(r.copies for r in rows if r.source == "big")
    assert abs(taken - 0.5 * 3050) <= 1 and max(r.copies for r in rows if r.source == "big") == 1
    shares = {r.source: r for r in mixture.reached_shares(mixed, plan).collect()}
    assert shares["absent"].mixture_tokens == 0 and shares["absent"].capped and shares["small"].capped and not shares["big"].capped
    assert sum(r.reached_share for r in shares.values()) == pytest.approx(1)


def test_prefix_sums_over_blocks_equal_one_walk(spark):
    docs = [(i, "s", 1 + i % 7) for i in range(997)]
    for share_total in (300, 2500):
        mixed, plan = mixture.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("s", 1.0, 5)], TARGETS), total_tokens=share_total, block_rows=50)
        expected = plan.first().expected_copies
        copies = {r.doc_id: r.copies for r in mixed.collect()}
        assert abs(sum(copies.values()) - expected * len(docs)) < 1
        assert set(copies.values()) <= {int(expected), int(expected) + 1}


def test_same_seed_same_mixture(spark):
    docs = spark.createDataFrame([(i, "s", 3) for i in range(500)], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 2)], TARGETS)
    runs = [sorted(tuple(r) for r in mixture.mix(docs.repartition(n), targets, total_tokens=700)[0].collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_empty_tables_and_null_targets(spark):
    none = spark.createDataFrame([], DOCS)
    mixed, plan = mixture.mix(none, spark.createDataFrame([("s", None, None)], TARGETS))
    assert mixed.collect() == [] and mixture.reached_shares(mixed, plan).first().reached_share == 0
    mixed, plan = mixture.mix(spark.createDataFrame([(1, "s", 5)], DOCS), spark.createDataFrame([], TARGETS))
    assert mixed.collect() == [] and mixture.reached_shares(mixed, plan).collect() == []
