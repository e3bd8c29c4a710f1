"""The N best items of every group, with files clustered by group and read by their statistics.

1. The items are written sorted by group and descending score, range-partitioned
   on both, so a group of any size spreads over files, and in row groups of so
   few rows that a large group has many of its own.
2. The footers are read into a table of row groups: smallest and greatest group
   and score.  A row group that holds one group only is skipped at once when
   other row groups of that group hold N items with strictly greater scores.
3. Each file's remaining row groups are read in descending greatest score; one
   is skipped when that score lies strictly below the N-th score so far of every
   group it contains.
4. At most N items per group and file remain, and are ranked.

Ties in score are broken by the tie columns in byte order, so the choice is the
same in every run; "strictly below" keeps every tie alive until then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import new_path

#: Rows of a row group of the clustered files.
ROW_GROUP_ROWS = 8192
_GROUP, _SCORE = "_group", "_score"


def _open(path: str) -> pq.ParquetFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(inner))


def _uri(path: str) -> str:
    return path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1) if path.startswith("file:/") else path


def _whole(items: DataFrame, score: str) -> bool:
    return items.select(score).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")


def cluster(items: DataFrame, group: list[str], score: str, tie: list[str], row_group_rows: int = ROW_GROUP_ROWS) -> tuple[DataFrame, int]:
    """Write the items clustered by group, best first; returns the written table's row groups and the number of its files.

    The group columns are packed to one string (with the parts' lengths, so no
    two groups share it); statistics of row groups are taken on it.
    """
    spark = items.sparkSession
    texts = [F.col(c).cast("string") for c in group]
    packed = F.concat_ws("\x1f", *texts, *[F.length(t).cast("string") for t in texts[:-1]]).alias(_GROUP)
    path = new_path(spark, "topn-clustered")
    kind = "long" if _whole(items, score) else "double"
    rows = items.select(packed, F.col(score).cast(kind).alias(_SCORE), *group, *tie)
    ordered = rows.repartitionByRange(_GROUP, F.desc(_SCORE)).sortWithinPartitions(_GROUP, F.desc(_SCORE), *tie)
    ordered.write.option("compression", "zstd").option("parquet.block.row.count.limit", row_group_rows).parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    number = files.count()
    return files.repartition(max(number, spark.sparkContext.defaultParallelism), "path").mapInPandas(
        _footers, f"path string, nth int, group_min string, group_max string, score_min {kind}, score_max {kind}, n_rows long"
    ), number


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            meta = _open(_uri(path)).metadata
            names = [meta.schema.column(i).name for i in range(meta.num_columns)]
            g, s = names.index(_GROUP), names.index(_SCORE)
            for i in range(meta.num_row_groups):
                part = meta.row_group(i)
                gs, ss = part.column(g).statistics, part.column(s).statistics
                has_g, has_s = gs is not None and gs.has_min_max, ss is not None and ss.has_min_max
                out.append((path, i, gs.min if has_g else None, gs.max if has_g else None, ss.min if has_s else None, ss.max if has_s else None, part.num_rows))
        if out:
            yield pd.DataFrame(out, columns=["path", "nth", "group_min", "group_max", "score_min", "score_max", "n_rows"])


def skip_by_statistics(row_groups: DataFrame, n: int) -> DataFrame:
    """The row groups that can hold one of the N best of a group.

    Only row groups of a single group are dropped: those below which, by
    ``score_min`` of better row groups, N better items are certain to exist.
    """
    single = row_groups.where("group_min = group_max AND score_max IS NOT NULL")
    better = single.select(F.col("group_min").alias("g"), F.col("score_min").alias("at"), "n_rows", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("nth"))
    asked = single.select(F.col("group_min").alias("g"), F.col("score_max").alias("at"), F.lit(0).cast("long").alias("n_rows"), "path", "nth")
    # values strictly above: a range frame over descending scores that stops one before the own score
    above = F.sum("n_rows").over(Window.partitionBy("g").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1))
    sure = better.unionAll(asked).withColumn("above", F.coalesce(above, F.lit(0))).where(f"path IS NOT NULL AND above >= {int(n)}")
    return row_groups.join(sure.select("path", "nth"), ["path", "nth"], "left_anti")


def _runs(groups: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups that stand together: where each begins, and the place of every row in its group."""
    codes = groups.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(codes)])
    return starts, np.arange(len(codes)) - np.repeat(starts, sizes)


def best_of_file(path: str, parts: list[dict], n: int, columns: list[str], tie: list[str]) -> tuple[pa.Table, int]:
    """The first ``n`` items of each group in the given row groups of a file, and how many row groups were read."""
    file = _open(path)
    parts = sorted(parts, key=lambda p: (p["score_max"] is not None, -(p["score_max"] or 0)))
    best: dict[str, np.ndarray] = {}  # the n best scores so far of groups that may go on in other row groups
    kept, read = [], 0

    def hopeless(groups: set[str], score: float | None) -> bool:
        return score is not None and all(g in best and len(best[g]) >= n and score < best[g][-1] for g in groups)

    for part in parts:
        ends = {part["group_min"], part["group_max"]}
        if None not in ends and hopeless(ends, part["score_max"]):
            if len(ends) == 1 or hopeless(set(file.read_row_group(part["nth"], columns=[_GROUP]).column(0).unique().to_pylist()), part["score_max"]):
                continue
        rows = file.read_row_group(part["nth"], columns=[_GROUP, _SCORE, *columns])
        read += 1
        if not len(rows):
            continue
        # the rows of a group stand together, the best ones first: all up to the N-th score, ties with it included
        starts, place = _runs(rows.column(_GROUP))
        scores = rows.column(_SCORE).to_numpy()
        sizes = np.diff(np.r_[starts, len(scores)])
        last = scores[np.minimum(starts + n, starts + sizes) - 1]
        kept.append(rows.filter(pa.array((place < n) | (scores >= np.repeat(last, sizes)))))
        for run in {0, len(starts) - 1}:  # only these can go on in a neighbour
            g = rows.column(_GROUP)[int(starts[run])].as_py()
            mine = scores[starts[run] : starts[run] + min(n, sizes[run])]
            best[g] = np.sort(np.concatenate([best.get(g, mine[:0]), mine]))[::-1][:n]
    if not kept:
        return file.schema_arrow.empty_table().select([_GROUP, _SCORE, *columns]), read
    found = pa.concat_tables(kept)
    order = [(_GROUP, "ascending"), (_SCORE, "descending"), *[(c, "ascending") for c in tie]]
    found = found.take(pc.sort_indices(found, sort_keys=order, null_placement="at_start"))
    return found.filter(pa.array(_runs(found.column(_GROUP))[1] < n)), read


def _read_best(n: int, columns: list[str], tie: list[str]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = table.select(["nth", "group_min", "group_max", "score_max"]).to_pylist()  # row groups, not rows
        return best_of_file(_uri(key[0].as_py()), parts, n, columns, tie)[0]

    return run


def top_n(items: DataFrame, group: list[str], score: str, tie: list[str], n: int, row_group_rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """The first ``n`` items of each group by descending score, then by ``tie`` in ascending byte order, nulls first.

    Items with a null or NaN score or a null group column are not ranked.
    Repeated rows count as often as they occur; with ``n`` < 1 or no items there
    are no rows.  Scores are whole numbers, or ranked as doubles.  The result has
    the group and tie columns, the score as ``score`` and the place as ``rank``.
    """
    wanted = items.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [score, *group]))
    kind = "long" if _whole(items, score) else "double"
    if kind == "double":
        wanted = wanted.where(~F.isnan(F.col(score).cast("double")))
    columns = list(dict.fromkeys([*group, *tie]))
    if n < 1:
        return wanted.select(*columns, F.col(score).cast(kind).alias("score"), F.lit(0).alias("rank")).limit(0)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*columns).schema.fields)
    row_groups, files = cluster(wanted, group, score, tie, row_group_rows)
    # an explicit number of partitions: what is shuffled is a few bytes a row group, what they stand for is whole files
    parts = skip_by_statistics(row_groups, n).repartition(max(files, items.sparkSession.sparkContext.defaultParallelism), "path")
    best = parts.groupBy("path").applyInArrow(_read_best(n, columns, tie), f"{_GROUP} string, {_SCORE} {kind}, {fields}")
    order = Window.partitionBy(_GROUP).orderBy(F.desc(_SCORE), *tie)
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*columns, F.col(_SCORE).alias("score"), "rank")
