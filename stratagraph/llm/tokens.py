"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Each task cuts its texts into words by the tokenizer's pattern and encodes the
distinct words it has not met yet with a recursive DuckDB query: rows (word,
position, token) are joined with the merge table, every word contracts its
lowest-ranked pair from the left, until no word has a pair to merge.  An
ordered aggregation then puts the words' ids together to the documents' ids.

Contracting all non-overlapping occurrences of a word's lowest pair in one step
equals contracting the leftmost again and again: what a merge creates can only
take part in merges of higher rank.  A query makes at most ``STEPS`` steps and
is continued from where it stopped, so a word of any length needs only the
memory of that many steps.

No shuffle: the work happens where the texts are read.  Memory is bounded by
``CHUNK_CHARS`` of text and ``KNOWN_WORDS`` remembered words a task.
"""

from __future__ import annotations

import json
import shutil
import uuid
import weakref
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workspace import shared_dir, spread

#: Where the public vocabulary lies unless a caller names another file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The word pattern of this family of byte-level tokenizers (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK_CHARS, KNOWN_WORDS, STEPS, BATCH_BYTES = 4_000_000, 200_000, 64, 1_000_000

_CONTRACT = f"""
WITH RECURSIVE steps(step, word, pos, token) AS (
  SELECT 0, word, pos, token FROM pieces
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN hit THEN merged ELSE token END FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM (
      SELECT *, best_here AND row_number() OVER (PARTITION BY word, best_here, run ORDER BY pos) % 2 = 1 AS hit FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY word, best_here ORDER BY pos) AS run FROM (
          SELECT *, coalesce(rank = best, false) AS best_here FROM (
            SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY word) AS best FROM (
              SELECT *, lead(token) OVER w AS next, row_number() OVER w AS nth FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)) p
            LEFT JOIN merges m ON m.lft = p.token AND m.rgt = p.next)
          WHERE best IS NOT NULL))))
  WHERE NOT eaten AND step < {STEPS})
SELECT word, pos, token, step FROM steps QUALIFY step = max(step) OVER (PARTITION BY word)
"""


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Word encoder of one worker; words met once are not encoded again.

    ``spill`` is a folder for what exceeds the memory limit, made only if that
    happens; without one, nothing is spilled.
    """

    def __init__(self, path: str, spill: str | None = None) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = _byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        folder = f"{spill}/duck-{uuid.uuid4().hex}" if spill else ""
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": folder, "preserve_insertion_order": "false"})
        if folder:
            weakref.finalize(self, shutil.rmtree, folder, True)
        table = pa.table({
            "lft": pa.array([vocab[a] for a, _ in merges], pa.int32()),
            "rgt": pa.array([vocab[b] for _, b in merges], pa.int32()),
            "merged": pa.array([vocab[a + b] for a, b in merges], pa.int32()),
            "rank": pa.array(range(len(merges)), pa.int32()),
        })
        self._create("merges", table)
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def _create(self, name: str, table: pa.Table) -> None:
        self.con.register("_given", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _given")
        self.con.unregister("_given")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.con.execute("CREATE OR REPLACE TABLE word_ids (word INTEGER, ids INTEGER[])")

    def _learn(self, words: list[str], first: int) -> None:
        """Encode new words; word ``i`` of the list gets the number ``first + i``."""
        start = 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and (end == start or size < BATCH_BYTES):
                size += len(words[end])
                end += 1
            raw = [w.encode() for w in words[start:end]]
            lengths = np.array([len(b) for b in raw])
            flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
            offsets = np.cumsum(lengths) - lengths
            pieces = pa.table({
                "word": np.repeat(np.arange(first + start, first + end, dtype=np.int32), lengths),
                "pos": (np.arange(len(flat)) - np.repeat(offsets, lengths)).astype(np.int32),
                "token": self.byte_id[flat],
            })
            while pieces.num_rows:
                self._create("pieces", pieces)
                self.con.execute(f"CREATE OR REPLACE TEMP TABLE solved AS {_CONTRACT}")
                self.con.execute(f"INSERT INTO word_ids SELECT word, list(token ORDER BY pos) FROM solved WHERE step < {STEPS} GROUP BY word")
                pieces = self.con.execute(f"SELECT word, pos, token FROM solved WHERE step = {STEPS}").to_arrow_table()
            start = end

    def _words(self, texts: list[str | None]) -> pa.Table:
        """Rows (doc, pos, word) of a chunk; every new word is learnt first."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known, fresh, numbers, counts, first = self.known, [], [], [], len(self.known)
        for text in texts:
            found = self.pattern.findall(text) if text else []
            counts.append(len(found))
            for word in found:
                number = known.get(word)
                if number is None:
                    number = known[word] = len(known)
                    fresh.append(word)
                numbers.append(number)
        if fresh:
            self._learn(fresh, first)
        sizes = np.array(counts, dtype=np.int64)
        return pa.table({
            "doc": np.repeat(np.arange(len(texts), dtype=np.int32), sizes),
            "pos": (np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            "word": np.array(numbers, dtype=np.int32),
        })

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null or empty text has none."""
        out = [np.zeros(0, dtype=np.int32)] * len(texts)
        self.con.register("doc_words", self._words(texts))
        rows = self.con.execute("SELECT doc, flatten(list(ids ORDER BY pos)) AS ids FROM doc_words JOIN word_ids USING (word) GROUP BY doc").to_arrow_table()
        lists = rows["ids"].combine_chunks() if rows.num_rows else None
        for i, doc in enumerate(rows["doc"].to_numpy()):
            out[doc] = lists[i].values.to_numpy(zero_copy_only=False)
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        self.con.register("doc_words", self._words(texts))
        rows = self.con.execute("SELECT doc, sum(len(ids)) AS n FROM doc_words JOIN word_ids USING (word) GROUP BY doc").fetchnumpy()
        out[rows["doc"]] = rows["n"]
        return out


@lru_cache(1)
def _encoder(path: str, spill: str | None) -> Encoder:
    """The encoder of this worker: tasks that follow find the merge table and the words met before."""
    return Encoder(path, spill)


def _spill_folder(spark: SparkSession) -> str | None:
    """The shared folder, if workers can reach it as files."""
    path = shared_dir(spark)
    return path.removeprefix("file://").replace("file:", "") if path.startswith(("file:", "/")) else None


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``CHUNK_CHARS`` characters."""
    for batch in batches:
        sizes = np.array([len(t) if t else 0 for t in batch.column(text).to_pylist()], dtype=np.int64)
        if not len(sizes):
            continue
        group = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document: its id and ``ids``, the token ids of its whole text without special tokens.

    Null and empty texts get an empty list.  Strings that look like control
    tokens are ordinary text.  Rows with a repeated or null id are all encoded;
    other columns are ignored.
    """
    table = spread(documents.select(F.col(id_column), F.col(text_column).alias("_text")))
    kind, spill = dict(table.dtypes)[id_column], _spill_folder(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, spill)
        for part in _chunks(batches, "_text"):
            ids = pa.array(encoder.ids(part.column("_text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_column, "ids"])

    return table.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, text_column: str = "text", tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """The columns of ``documents`` other than the text, and the number of its tokens."""
    kept = [c for c in documents.columns if c not in (text_column, out)]
    table = spread(documents.select(*kept, F.col(text_column).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "_text")
    spill = _spill_folder(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, spill)
        for part in _chunks(batches, "_text"):
            sizes = pa.array(encoder.lengths(part.column("_text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), sizes], [*kept, out])

    return table.mapInArrow(run, f"{fields}, {out} bigint")
