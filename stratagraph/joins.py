"""Join helpers that check the size of what they broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most keys (one long each) that are sent to every executor as a pre-filter.
PREFILTER_KEYS = 1_000_000


def prefilter(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, count: int, limit: int = PREFILTER_KEYS) -> DataFrame:
    """Keep the rows of ``df`` whose hashed ``key`` occurs in ``wanted``.

    The 64-bit hashes of the wanted keys are broadcast while there are at most
    ``limit`` of them (``count`` is their measured number); beyond that ``df``
    comes back as it is and the exact join that follows shuffles it.  A hash
    collision only lets a row through, it never drops one.
    """
    if count > limit:
        return df
    hashes = wanted.select(F.xxhash64(wanted_key).alias("_wanted")).distinct()
    return df.join(F.broadcast(hashes), F.xxhash64(key) == F.col("_wanted"), "left_semi")
