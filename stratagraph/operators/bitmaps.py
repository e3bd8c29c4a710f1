"""Compressed bitmaps: containers of 32,768 ids, stored in the smaller of two forms.

A container is one byte of form and then either the sorted 16-bit positions
('array', for few members) or 4,096 bytes of bits ('bits').  Bit ``p`` is bit
``p % 8`` of byte ``p // 8``, and range ``r`` holds the ids from ``32768 * (r - 1) + 1``
on, the layout of Spark's ``bitmap_construct_agg``; ids start at 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

RANGE = 32_768
_ARRAY, _BITS = b"\x00", b"\x01"


def compress(bits: bytes) -> bytes:
    flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
    members = np.flatnonzero(flags)
    if len(members) * 2 < len(bits):
        return _ARRAY + members.astype("<u2").tobytes()
    return _BITS + bytes(bits)


def expand(container: bytes | None) -> np.ndarray:
    """Flags of all positions of a container; a missing container is empty."""
    if container is None:
        return np.zeros(RANGE, dtype=bool)
    if container[:1] == _BITS:
        raw = np.frombuffer(container, dtype=np.uint8, offset=1)
        return np.unpackbits(raw, bitorder="little").astype(bool)
    flags = np.zeros(RANGE, dtype=bool)
    flags[np.frombuffer(container, dtype="<u2", offset=1)] = True
    return flags


@F.pandas_udf(BinaryType())
def compress_udf(bits: pd.Series) -> pd.Series:
    return bits.map(compress)


def build(df: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """One container per group and id range: columns ``by``, key_range, container.

    The bits are combined before the shuffle, so what moves is at most 4 KB per
    group and range of every input partition, not rows.
    """
    located = df.select(*by, F.bitmap_bucket_number(id_column).alias("key_range"), F.bitmap_bit_position(id_column).alias("_bit"))
    return located.groupBy(*by, "key_range").agg(compress_udf(F.bitmap_construct_agg("_bit")).alias("container"))


def and_not(df: DataFrame, keep: list[str], include: str, exclude: list[str], out: str) -> DataFrame:
    """Ids in ``include`` and in none of ``exclude``, decoded: columns ``keep`` and ``out``."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                flags = expand(getattr(row, include))
                for name in exclude:
                    flags &= ~expand(getattr(row, name))
                ids = np.flatnonzero(flags).astype(np.int64) + (row.key_range - 1) * RANGE + 1
                if len(ids):
                    parts.append(pd.DataFrame({**{k: getattr(row, k) for k in keep}, out: ids}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    schema = ", ".join([*fields, f"{out} bigint"])
    return df.select(*keep, "key_range", include, *exclude).mapInPandas(decode, schema)
