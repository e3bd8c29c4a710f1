import random

from hypothesis import HealthCheck, given, settings, strategies as st

from stratagraph.llm import topn


def brute(rows, n):
    groups = {}
    for g, h, s, a, b in rows:
        if g is not None and h is not None and s is not None:
            groups.setdefault((g, h), []).append((-s, (a or "").encode(), (b or "").encode(), a, b))
    return sorted((g, h, a, b, -s) for (g, h), v in groups.items() for s, _, _, a, b in sorted(v, key=lambda x: x[:3])[:n])


def run(spark, rows, n, size=64):
    df = spark.createDataFrame(rows, "g long, h string, s long, a string, b string")
    return sorted((r.g, r.h, r.a, r.b, r.score) for r in topn.top_n(df, ["g", "h"], "s", ["a", "b"], n, size).collect())


def test_hot_group_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(1, "hot", rng.randrange(40), f"k{i % 997}", f"x{i}") for i in range(4000)]
    rows += [(2, f"p{i % 50}", rng.randrange(5), f"é{i}", f"y{i}") for i in range(400)]
    rows += [(None, "p", 1, "a", "b"), (3, None, 1, "a", "b"), (3, "p", None, "a", "b"), (3, "q", 1, "a", "b")]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_negative_scores_and_repeated_rows(spark):
    rows = [(1, "g", -5, "a", "b")] * 3 + [(1, "g", -7, "a", "c")]
    assert run(spark, rows, 2) == [(1, "g", "a", "b", -5)] * 2


def test_empty_and_zero(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(1, "g", 1, "a", "b")], 0) == []


def test_separators_in_names_do_not_merge_groups(spark):
    df = spark.createDataFrame([("a\x1fb", "c", 1, "k"), ("a", "b\x1fc", 2, "k")], "g string, h string, s long, a string")
    assert topn.top_n(df, ["g", "h"], "s", ["a"], 1).count() == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("pqr"), st.integers(-3, 3), st.text("abé", max_size=2), st.text("xy", max_size=2)), max_size=60), st.integers(1, 4))
def test_against_brute_force(spark, rows, n):
    assert run(spark, rows, n) == brute(rows, n)


def test_statistics_drop_only_hopeless_row_groups(spark):
    meta = spark.createDataFrame(
        [("f", 0, "g", "g", 50, 90, 5), ("f", 1, "g", "g", 10, 49, 5), ("f", 2, "g", "g", 10, 50, 5), ("f", 3, "a", "z", 0, 1, 5), ("f", 4, "h", "h", 0, 1, 1)],
        "path string, nth int, group_min string, group_max string, score_min long, score_max long, n_rows long",
    )
    assert sorted(r.nth for r in topn.skip_by_statistics(meta, 5).collect()) == [0, 2, 3, 4]


def test_scores_with_fractions(spark):
    df = spark.createDataFrame([("g", 1.25, "a"), ("g", 1.5, "b"), ("g", float("nan"), "c"), ("g", None, "d"), ("g", 1.75, None), ("g", 1.75, "")], "g string, s double, a string")
    assert [(r.score, r.a, r["rank"]) for r in topn.top_n(df, ["g"], "s", ["a"], 3).orderBy("rank").collect()] == [(1.75, None, 1), (1.75, "", 2), (1.5, "b", 3)]


def test_a_large_group_is_skipped_and_spread(spark):
    """Of a group of many row groups one is read; files are read by as many tasks as there are."""
    from pyspark.sql import functions as F

    items = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("g"), (F.col("id") * 7919 % 50_021).alias("s"), F.col("id").cast("string").alias("a"))
    row_groups, files = topn.cluster(items, ["g"], "s", ["a"], 500)
    left = topn.skip_by_statistics(row_groups, 5)
    hot = "group_min = group_max AND group_min = 'hot'"
    assert row_groups.where(hot).count() > 70 and left.where(hot).count() <= files + 1
    assert left.count() < row_groups.count() - 60
    # without the first step, the second one skips them within each file
    for path, parts in row_groups.toPandas().groupby("path"):
        table, read = topn.best_of_file(topn._uri(path), parts.to_dict("records"), 5, ["g", "a"], ["a"])
        alone = int((parts["group_min"] == "hot").sum())
        assert read <= len(parts) - max(0, alone - 2) and table.num_rows
    best = topn.top_n(items, ["g"], "s", ["a"], 5, 500)
    want = items.toPandas().assign(b=lambda d: -d.s).sort_values(["g", "b", "a"]).groupby("g").head(5)
    assert sorted((r.g, r.score, r.a) for r in best.collect()) == sorted(zip(want.g, want.s, want.a))
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("topn-tasks", "")
    topn.top_n(items, ["g"], "s", ["a"], 5, 500).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tasks.getStageInfo(s) for j in tasks.getJobIdsForGroup("topn-tasks") for s in tasks.getJobInfo(j).stageIds]
    assert sum(1 for s in stages if s and s.numTasks >= spark.sparkContext.defaultParallelism) >= 2
