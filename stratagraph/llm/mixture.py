"""Mixing sources to target weights by systematic sampling.

Each source gets the same expected number of copies for all its documents: its
target share of the mixture's size over its own size, at most ``max_repeats``.
The documents of a source stand in a fixed pseudo-random order; their expected
copies are prefix-summed, one random offset per source is added, and a document
is emitted once for every integer boundary that its interval crosses.

Scale: a source is cut into blocks by hash, so one that holds a third of all
rows is many tasks; prefix sums are the blocks' sums, which are few, plus the
running sum within a block.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Documents that a block of a source is meant to hold.
BLOCK_ROWS = 20_000


def _unit(*columns: object) -> object:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: its size, the expected copies of each document, and whether the cap holds it back.

    ``sizes``: source, n_docs, n_tokens.  The mixture is meant to hold
    ``total_tokens``; by default as many as all sources with a target have
    together.  Null or negative shares and repeats count as 0; a source named
    twice keeps its greatest share.  Shares are taken relative to their sum.
    """
    clean = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    everything = Window.partitionBy()  # one row per source
    joined = clean.join(sizes, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    size = F.lit(total_tokens) if total_tokens is not None else F.sum("n_tokens").over(everything)
    wanted = F.col("target_share") / F.nullif(F.sum("target_share").over(everything), F.lit(0.0)) * size
    copies = F.when(F.col("n_tokens") > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.col("n_tokens"))).otherwise(F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce(copies, F.lit(0.0)).alias("expected_copies"), (wanted > F.col("max_repeats") * F.col("n_tokens")).alias("capped"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and its plan.

    ``documents``: doc_id, source, n_tokens.  Documents of a null source or one
    without a target are in no mixture; documents with no tokens add nothing
    and are left out.  Documents that fall between two boundaries are not
    emitted.  Equal ids are told apart by nothing and may take each other's
    place.  Empty tables give empty results.
    """
    rows = documents.where("source IS NOT NULL AND n_tokens > 0").select("doc_id", "source", "n_tokens")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    shares = plan(sizes, targets, total_tokens)
    # the plan has one row per target source
    joined = rows.join(F.broadcast(shares.select("source", "n_docs", "expected_copies")), "source")
    place = F.xxhash64(F.lit(seed), "doc_id")
    blocked = joined.withColumn("_place", place).withColumn("_block", F.pmod("_place", F.ceil(F.col("n_docs") / block_rows)))
    counted = blocked.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("source", "_block", (F.sum("_n").over(Window.partitionBy("source").orderBy("_block")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("source", "_block").orderBy("_place", "doc_id", "n_tokens"))
    ranked = blocked.withColumn("_nth", within).join(before, ["source", "_block"])
    upto = (F.col("_before") + F.col("_nth")) * F.col("expected_copies") + _unit(F.lit(seed), F.lit("offset"), "source")
    # the same product for both ends: neighbouring intervals must share their boundary
    low = (F.col("_before") + F.col("_nth") - 1) * F.col("expected_copies") + _unit(F.lit(seed), F.lit("offset"), "source")
    copies = F.floor(upto) - F.floor(low)
    return ranked.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0"), shares


def reached_shares(mixture: DataFrame, shares: DataFrame) -> DataFrame:
    """Per target source: what it has, what the mixture took of it, and the share it really reached."""
    taken = mixture.groupBy("source").agg(
        F.sum("copies").cast("long").alias("emitted"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixture_tokens"), F.max("copies").alias("most_copies")
    )
    joined = shares.join(taken, "source", "left").fillna(0, ["emitted", "mixture_tokens", "most_copies"])
    total = F.nullif(F.sum("mixture_tokens").over(Window.partitionBy()), F.lit(0))
    return joined.select(
        "source", "target_share", "max_repeats", F.col("n_docs").alias("source_docs"), F.col("n_tokens").alias("source_tokens"),
        "emitted", "most_copies", "mixture_tokens", F.coalesce(F.col("mixture_tokens") / total, F.lit(0.0)).alias("reached_share"), F.coalesce("capped", F.lit(True)).alias("capped"),
    )
