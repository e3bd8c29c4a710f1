"""Texts cut off by field limits or broken off in transfer.

Two arms, reported apart:

1. *Limits*.  Per source, and both in characters and in bytes, the discrete
   hazard of each length (texts that end there among those at least that long)
   is computed by window functions and tested against the hazard of the
   neighbouring lengths; lengths whose excess survives false-discovery control
   are limits of that source.  A text at such a length is cut unless its ending
   looks complete.
2. *Transfer*.  At all other lengths a text is cut only if its ending looks
   incomplete.

How complete an ending looks is measured on the corpus: by how often its last
words are followed by the end of a sentence, line or text elsewhere (shares of
three, two and one words, each smoothed by the shorter one), by whether the
last word is a word at all or only the beginning of others, and by brackets,
quotes and fences that are left open.  Off the limits, an ending that ends
clearly more other texts than breaks in transfer would put there is complete.
No threshold depends on the number of texts.

The statistics are counted over all texts.  Only contexts that end some text
whose ending is open to doubt are kept, by a bit filter sized by their number,
so what is shuffled is at most one row per such context and input partition,
never the words of the corpus.  Copies of a text count as one witness.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import regex
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import new_path, spread, stage

# -- parameters ------------------------------------------------------------------

#: Neighbouring lengths on each side that a length is tested against, by the greatest length they hold for.
NEIGHBOURS = ((200, 3), (1000, 12), (1 << 62, 40))
#: The false-discovery rate, and the fewest texts of a limit.
RATE, FEWEST = 0.001, 6
#: Sources of fewer texts are held against the limits of all sources too, as texts without a source are.
SMALL = 200
#: An ending's completeness below which it is incomplete: off the limits, and at a limit or before a mark of a cut.
CUT_BELOW, CUT_BELOW_AT_LIMIT = 0.05, 0.9
#: Weight of the shorter context's share, in occurrences.
PRIOR = 1.0
#: A last word never seen elsewhere inside a text is a fragment if it ends fewer other texts than this share of the
#: words it begins; any last word is, if it is seen less often than the second share of them.
FRAGMENT = (0.05, 0.001)
#: Numbers at the end of texts of one length are complete if this share of them has more digits than numbers there have inside texts.
OVERLONG = 0.05
#: Bits of the context filter: so many a context, between the two bounds (packed, 128 KB and 32 MB).
BITS_A_CONTEXT, FILTER_BITS = 16, (1 << 20, 1 << 28)
CHUNK_CONTEXTS = 500_000

# -- words and boundaries -----------------------------------------------------------

_WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
_CLOSERS = r"""[)\]}"'”’`»』」）]*"""
_CLOSING = frozenset(_CLOSERS[1:-2].replace("\\", ""))
#: What ends a sentence or a line.
_STOP = re.compile(rf"{_CLOSERS}[.!?…]+{_CLOSERS}(?=\s|\Z)|[。！？]+{_CLOSERS}|\n")
_WIDE_LETTER = re.compile(rf"([{_WIDE}])")
#: Words, numbers and marks; wide letters stand alone.
_WORD = re.compile(r"\w+(?:['’]\w+)*(?:[.,]\d+)*|-+|=+|\*+|~+|[^\w\s]")
_NUMBER = regex.compile(r"^\d+(?:[.,]\d+)*$")
_NAME = regex.compile(r"_|\p{N}|\p{Ll}\p{Lu}")
#: Marks that a shortened text carries at its end (fixed values).
_MARK = regex.compile(r"(?:\[(?:\.\.\.|…|truncated|cut|snip|more)\]|\((?:\.\.\.|…|truncated|cut|continued|more)\)|<(?:truncated|snip|cut)>|…|\.\.\.)\Z", regex.I)
#: The beginning of a sentence or line.
START = "^"


@lru_cache(200_000)
def _norm(word: str) -> str:
    if _NUMBER.match(word):
        return "0"
    return "ID" if _NAME.search(word) else word.lower()


def opened(words: list[str]) -> list[str]:
    """A sentence or line without closing brackets and quotes at its end, as they may stand before its full stop."""
    n = len(words)
    while n > 1 and words[n - 1] in _CLOSING:
        n -= 1
    return words[:n]


def pieces(text: str) -> list[list[str]]:
    """The words of each sentence and line that has any."""
    if not text.isascii():
        text = _WIDE_LETTER.sub(r" \1 ", text)
    return [words for part in _STOP.split(text) if (words := _WORD.findall(part))]


def _hash(*words: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(words)) - (1 << 63)


def clean(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def last_line(body: str) -> str:
    return body[body.rfind("\n") + 1 :]


def without_mark(body: str) -> str:
    """A text without the mark of a cut at its end; a text that is nothing else keeps it."""
    mark = _MARK.search(last_line(body)[-40:])  # longer than any mark
    return body[: len(body) - len(mark[0])].rstrip() or body if mark else body


def contexts(words: list[str]) -> list[int | None]:
    """Hashes of the last three, two and one words of a sentence; None where its beginning comes first."""
    own = [START, *map(_norm, words[-3:])] if len(words) < 3 else [_norm(w) for w in words[-3:]]
    return [_hash(str(k), *own[-k:]) if len(own) >= k else None for k in (3, 2, 1)]


def number_place(words: list[str]) -> tuple[int | None, int | None]:
    """Of a number that ends a text: hashes of the word before it with its number of digits, and of that word; Nones without one."""
    if not words or not words[-1].isdigit():
        return None, None
    before = _norm(words[-2]) if len(words) > 1 else START
    return _hash("d", before, str(len(words[-1]))), _hash("d", before)


# -- what an ending leaves open -------------------------------------------------------

_SKIP = {
    "go": regex.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'", regex.S),
    "rust": regex.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", regex.S),
    "python": regex.compile(r"#[^\n]*|\"{3}.*?\"{3}|'{3}.*?'{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", regex.S),
}
_CODE_SIGNS = (
    ("go", regex.compile(r"^(?:package \w+$|func (?:\(|\w+\())", regex.M)),
    ("rust", regex.compile(r"^\s*(?:pub )?fn \w+.*\{$|^use [\w:]+(?:::\{.*\})?;$|^impl\b.*\{$", regex.M)),
    ("python", regex.compile(r"^(?:from [\w.]+ import |import \w+|\s*def \w+\(.*|class \w+.*:$)", regex.M)),
)


def code_language(text: str, lang: str | None) -> str | None:
    """The language if the whole text is source code, None for prose (also with code in it)."""
    if "```" in text or regex.search(r"^#{1,3} \w", text, regex.M) and not (lang in _SKIP):
        return None
    for name, sign in _CODE_SIGNS:
        if (lang is None or lang == name or lang not in _SKIP) and sign.search(text):
            return name
    return lang if lang in _SKIP else None


def leaves_open(text: str, language: str | None) -> bool:
    """Whether brackets, strings, quotes or fences are still open at the end."""
    if language:
        bare = _SKIP[language].sub(" ", text)
        for a, b in ("{}", "()", "[]"):
            if bare.count(a) > bare.count(b):
                return True
        return bare.count('"') % 2 == 1
    if len(regex.findall(r"^\s*```", text, regex.M)) % 2:
        return True
    last = text.rstrip().split("\n")[-1]
    return last.count("`") % 2 == 1 and not last.startswith("```") or last.count("“") > last.count("”") or last.count("(") > last.count(")") or last.count('"') % 2 == 1


# -- pass 1: endings ------------------------------------------------------------------------

_ENDINGS = (
    "doc_id long, source string, text_hash long, n_chars long, n_bytes long, h3 long, h2 long, h1 long, hd long, place long,"
    " open boolean, sealed boolean, marked boolean, own_inside boolean, named boolean"
)
_SEALED = regex.compile(rf"(?:[!?]|(?<!\d)\.|(?<=\D\d{{1,9}} \w{{1,3}})\.|[。！？]){_CLOSERS}\Z")
_ENDS_IN_STOP = regex.compile(rf"[.!?…。！？]{_CLOSERS}\Z")


def ending(doc_id: int, text: str | None, lang: str | None, source: str | None) -> tuple | None:
    """Features of the end of a text; None for null, empty and blank texts."""
    if text is None or not text.strip():
        return None
    whole = clean(text)
    body = without_mark(whole.rstrip())
    marked = len(body) < len(whole.rstrip())
    language = code_language(body, lang)
    last = last_line(body)
    words = opened((pieces(last) or [[]])[-1])
    # a sentence that is closed by its mark; a number before a full stop may be a cut decimal
    sealed = language is None and bool(_SEALED.search(last))
    h3, h2, h1 = contexts(words)
    return (
        doc_id, source, xxhash.xxh64_intdigest(whole.strip()) - (1 << 63), len(text), len(text.encode()), h3, h2, h1, *number_place(words),
        leaves_open(body, language) or body.endswith("�"), sealed, marked, bool(_ENDS_IN_STOP.search(last)), bool(words) and _norm(words[-1]) in ("ID", "0"),
    )


def _endings(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _ENDINGS.split(",")]
        for batch in batches:
            rows = [e for r in zip(batch["doc_id"], batch["text"], batch["lang"], batch["source"]) if (e := ending(*r))]
            columns = dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}
            # whole numbers with gaps: by way of floats, hashes would lose digits
            yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c in ("h3", "h2", "h1", "hd", "place") else v for c, v in columns.items()}, columns=names)

    return spread(documents.select("doc_id", "text", "lang", "source")).mapInPandas(run, _ENDINGS)


# -- pass 2: how often a context ends something ------------------------------------------------


def _read(path: str) -> pa.Table:
    """A small table of the shared folder, read by a worker."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return pq.read_table(inner, filesystem=system)


class ContextFilter:
    """The contexts that are asked for, as bits: a context that is none of them may pass, none of them is lost."""

    def __init__(self, path: str, bits: int) -> None:
        self.size, self.bits = bits, np.zeros(bits // 8, dtype=np.uint8)
        table = _read(path)
        for number, part in zip(table["part"].to_pylist(), table["bits"].to_pylist()):
            self.bits[(number - 1) * 4096 : number * 4096] |= np.frombuffer(part, dtype=np.uint8)

    def __contains__(self, h: int) -> bool:
        at = h % self.size
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def _write_filter(asked: DataFrame) -> tuple[str, int]:
    """The asked contexts (h) as a bit filter in the shared folder, and its size."""
    path = new_path(asked.sparkSession, "ending-filter")
    number = asked.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (BITS_A_CONTEXT * number).bit_length()))
    place = asked.select((F.pmod("h", F.lit(bits)) + 1).alias("at"))
    parts = place.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts.coalesce(1).write.parquet(path)
    return path, bits


class Counts:
    """Contexts of texts by one, two and three words: how often they occur, and end something, and end a text."""

    def __init__(self) -> None:
        self.seen = [Counter(), Counter(), Counter()]
        self.ends = [Counter(), Counter(), Counter()]
        self.finals = [Counter(), Counter(), Counter()]
        self.numbers: Counter = Counter()
        self.names = [0, 0]

    def add(self, text: str, at_limit: bool = False) -> None:
        """Count a text; where a field limit ends it, its last word witnesses nothing."""
        body = without_mark(clean(text).rstrip())
        parts = pieces(body)
        if not parts:
            return
        stopped = bool(_ENDS_IN_STOP.search(last_line(body)))
        run: list[str] = []
        for i, raw in enumerate(parts):
            last = i + 1 == len(parts)
            end = len(opened(raw))
            if last:
                raw = raw[: end - at_limit]
            words = [START, *map(_norm, raw)]
            run += words
            if raw and not (last and at_limit):
                own = words[: end + 1][-3:]
                for k in range(1, len(own) + 1):
                    key = own[-1] if k == 1 else tuple(own[-k:])
                    self.ends[k - 1][key] += 1
                    if last and not stopped:
                        self.finals[k - 1][key] += 1
            if "0" in words:
                self.numbers.update((words[j - 1] if j > 1 else START, len(raw[j - 1])) for j, w in enumerate(words) if w == "0" and raw[j - 1].isdigit())
            if "ID" in words or "0" in words:
                lengths = [len(r) for r, w in zip(raw, words[1:]) if w in ("ID", "0")]
                self.names = [self.names[0] + sum(lengths), self.names[1] + len(lengths)]
        self.seen[0].update(run)
        self.seen[1].update(zip(run, run[1:]))
        self.seen[2].update(zip(run, run[1:], run[2:]))

    def rows(self, wanted: ContextFilter) -> pd.DataFrame:
        """h, n, e, f and x (longer words in that place that begin alike) of the wanted contexts; empties the counts."""
        out: dict[int, list[int]] = {}
        for k in (3, 2, 1):
            ends, finals = self.ends[k - 1], self.finals[k - 1]
            for key, n in self.seen[k - 1].items():
                h = _hash(str(k), *((key,) if k == 1 else key))
                if h in wanted:
                    out[h] = [n, ends[key], finals[key], 0]
        begun, letters = set(), 0  # wanted beginnings of words
        for word, n in self.seen[0].items():
            if word.isalpha():
                letters += n * len(word)
                for i in range(1, len(word)):
                    h = _hash("1", word[:i])
                    if h in wanted:
                        begun.add(word[:i])
                        out.setdefault(h, [0, 0, 0, 0])[3] += n
        for (before, word), n in self.seen[1].items():
            if word.isalpha():
                for i in range(1, len(word)):
                    if word[:i] in begun and (h := _hash("2", before, word[:i])) in wanted:
                        out.setdefault(h, [0, 0, 0, 0])[3] += n
        for (before, digits), n in self.numbers.items():
            for d in range(1, digits + 1):
                h = _hash("d", before, str(d))
                if h in wanted:
                    out.setdefault(h, [0, 0, 0, 0])[0] += n
        totals = (TOTAL, letters, *self.names, 0)
        self.__init__()
        return pd.DataFrame([totals, *((h, *row) for h, row in out.items())], columns=["h", "n", "e", "f", "x"])


#: The row of all letters of plain words, all characters of names and numbers, and the number of these.
TOTAL = 0


def _counts(documents: DataFrame, filter_path: str, bits: int, limits_path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = ContextFilter(filter_path, bits)
        table = _read(limits_path)
        limits = set(zip(*(table[c].to_pylist() for c in ("source", "unit", "length"))))
        counts = Counts()
        for batch in batches:
            for text, source in zip(batch["text"], batch["source"]):
                counts.add(text, bool(limits) and ((source, "chars", len(text)) in limits or (source, "bytes", len(text.encode())) in limits))
                if len(counts.seen[2]) > CHUNK_CONTEXTS:
                    yield counts.rows(wanted)
        yield counts.rows(wanted)

    partial = spread(documents.select("text", "source").where("text IS NOT NULL")).mapInPandas(run, "h long, n long, e long, f long, x long")
    return partial.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "e", "f", "x")])


# -- lengths -------------------------------------------------------------------------------------


def significant_lengths(lengths: DataFrame, neighbours: tuple[tuple[int, int], ...] = NEIGHBOURS, rate: float = RATE, fewest: int = FEWEST) -> DataFrame:
    """Limits: (source, unit, length) whose hazard stands out from its neighbours.

    ``lengths``: source, unit, length, one row per distinct text.  For each
    observed length, the texts ending there (d) among those at least that long
    (r) are compared with the hazard of the ``neighbours`` on either side, as
    many as the length allows.  The upper tail of a Poisson with that mean is the p-value, and the
    Benjamini-Hochberg step-up rule at ``rate``, over all lengths of a source
    and unit, decides.  Null sources are a source of their own.
    """
    d = lengths.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("d"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    at_risk = F.sum("d").over(Window.partitionBy("source", "unit").orderBy(F.desc("length")))
    near, width = F.lit(None).cast("long"), F.lit(None).cast("int")
    for upto, k in reversed(neighbours):
        short = F.col("length") < upto
        near = F.when(short, F.sum("d").over(by.rangeBetween(-k, k)) - F.col("d")).otherwise(near)
        width = F.when(short, F.least(F.lit(2 * k), F.lit(k) + F.col("length"))).otherwise(width)
    # risk sets of neighbouring lengths are alike, so their hazards compare as the counts do; half a text
    # as prior keeps a length in an empty stretch from being held against nothing
    hazards = d.withColumn("r", at_risk).withColumn("near", near).withColumn("width", width)
    mean = (F.col("near") + 0.5) / F.col("width")
    scored = hazards.withColumn("mean", mean).where(F.col("d") >= fewest)

    @F.pandas_udf("double")
    def tail(count: pd.Series, expected: pd.Series) -> pd.Series:
        def upper(k: int, m: float) -> float:
            term, total, i = math.exp(k * math.log(m) - m - math.lgamma(k + 1)), 0.0, k
            while term > total * 1e-12 and i < k + 10_000:
                total += term
                i += 1
                term *= m / i
            return min(1.0, total)

        return pd.Series([upper(int(k), float(m)) for k, m in zip(count, expected)])

    tested = scored.withColumn("p", tail("d", "mean"))
    total = d.groupBy("source", "unit").agg(F.count(F.lit(1)).alias("tests"))
    ranked = tested.join(total, (tested["source"].eqNullSafe(total["source"])) & (tested["unit"] == total["unit"])).select(tested["source"], tested["unit"], "length", "d", "r", "mean", "p", "tests")
    order = F.row_number().over(Window.partitionBy("source", "unit").orderBy("p", "length"))
    passed = ranked.withColumn("k", order).withColumn("ok", F.col("p") <= F.col("k") * rate / F.col("tests"))
    last = F.max(F.when(F.col("ok"), F.col("k"))).over(Window.partitionBy("source", "unit"))
    return passed.withColumn("last", last).where("k <= last").select("source", "unit", "length", "d", "r", "mean", "p")


def limits_of(lengths: DataFrame) -> DataFrame:
    """Limits that hold for each source: source, unit, length.

    ``lengths``: source, text_hash, unit, length.  Texts without a source may
    come from any, and a source of fewer than ``SMALL`` texts can hardly show a
    limit of its own, so at lengths they have, limits of all texts together hold.
    """
    own = significant_lengths(lengths).select("source", "unit", "length")
    texts = lengths.select("text_hash", "unit", "length").distinct()
    common = significant_lengths(texts.select(F.lit("").alias("source"), "unit", "length")).select("unit", "length")
    few = lengths.groupBy(F.col("source").alias("_source")).agg(F.count_distinct("text_hash").alias("_texts")).where((F.col("_texts") < SMALL) | F.col("_source").isNull())
    met = lengths.select("source", "unit", "length").distinct().join(F.broadcast(common), ["unit", "length"])
    borrowed = met.join(few, F.col("source").eqNullSafe(F.col("_source")), "left_semi").select("source", "unit", "length")
    return own.unionAll(borrowed).distinct()


# -- the operator ------------------------------------------------------------------------------------


def _spread_nulls(column: str, *by: str) -> Column:
    """A join key that is null where a context is missing, spread instead of met in one task; no count answers it."""
    return F.when(F.col(column).isNull(), F.concat(F.lit("-"), F.xxhash64(*by).cast("string"))).otherwise(F.col(column).cast("string"))


def _complete(rows: DataFrame) -> DataFrame:
    """Adds ``share``, how complete an ending looks, and ``usual``: it ends more other texts than breaks would.

    ``rows`` have n, e, f and x of their contexts of three, two and one words
    (x of three words is that of two), ``copies`` of the text, ``breaks``, the
    rate of breaks per letter, and ``span``, the length of a name or number: a
    break anywhere in one looks like its end.
    """
    inner, last = _own()
    share, usual = F.lit(0.0), F.lit(False)
    width = F.when(F.col("named"), F.col("span")).otherwise(F.lit(1.0))
    for k in (1, 2, 3):
        n, e, f = (F.greatest(F.coalesce(f"{c}{k}", F.lit(0)) - own, F.lit(0)) for c, own in (("n", inner + last), ("e", inner + last), ("f", last)))
        x = F.coalesce(f"x{min(k, 2)}", F.lit(0))
        # off the limits, other ends of texts may be breaks and witness nothing by themselves
        told = F.when(F.col("at_limit") | F.col("marked"), e).otherwise(e - f)
        share = F.when(n > 0, (F.least(told, n) + F.lit(PRIOR) * share) / (n + x + F.lit(PRIOR))).otherwise(share)
        if k > 1:
            by_chance = F.col("breaks") * (n * width + x)
            usual = usual | (f > by_chance + 4 * F.sqrt(by_chance) + 2)
    return rows.withColumn("share", F.when(_fragment(), F.lit(0.0)).otherwise(share)).withColumn("usual", usual & ~_fragment())


def _own() -> tuple[Column, Column]:
    """What a text's own end adds to its contexts: inside the text, where a full stop follows, or as its end; nothing at a limit."""
    inner = F.when(F.col("own_inside") & ~F.col("at_limit"), F.col("copies")).otherwise(F.lit(0))
    last = F.when(F.col("own_inside") | F.col("at_limit"), F.lit(0)).otherwise(F.col("copies"))
    return inner, last


def _fragment() -> Column:
    """Whether the last word is only the beginning of other words."""
    inner, last = _own()
    n, f, x = (F.coalesce(c, F.lit(0)) for c in ("n1", "f1", "x1"))
    seen, ended = n - inner - last, f - last
    return ((seen - ended <= 0) & (ended <= F.lit(FRAGMENT[0]) * x)) | (seen < F.lit(FRAGMENT[1]) * x)


def judged(documents: DataFrame) -> DataFrame:
    """One row per text that is not blank: doc_id, source, n_chars, n_bytes, at_limit, share, cut, cut_at_limit, cut_in_transfer.

    ``documents``: doc_id, text, lang, source; other columns are ignored.
    Repeated ids give a row each.  ``share`` is how complete the ending looks;
    ``cut`` is the one or the other of the two arms that follow it.
    """
    ends = stage(_endings(documents), "endings")
    copies = ends.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"))
    lengths = ends.select("source", "text_hash", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x"))
    distinct = lengths.select("source", "text_hash", "x.unit", "x.length").distinct()
    limits_path = new_path(documents.sparkSession, "limits")
    limits_of(distinct).write.parquet(limits_path)
    limits = documents.sparkSession.read.parquet(limits_path)

    doubtful = ends.where("marked OR NOT sealed")
    asked = doubtful.select(F.explode(F.array("h3", "h2", "h1", "hd")).alias("h")).where("h IS NOT NULL")
    counts = stage(_counts(documents, *_write_filter(asked), limits_path), "ending-counts")

    rows = ends.join(copies, "text_hash")
    for unit, column in (("chars", "n_chars"), ("bytes", "n_bytes")):
        mine = limits.where(F.col("unit") == unit).select(F.col("source").alias("_source"), F.col("length").alias("_length"), F.lit(True).alias(f"limit_{unit}"))
        rows = rows.join(mine, F.col("source").eqNullSafe(F.col("_source")) & (F.col(column) == F.col("_length")), "left").drop("_source", "_length")
    rows = rows.withColumn("at_limit", F.coalesce("limit_chars", F.lit(False)) | F.coalesce("limit_bytes", F.lit(False))).drop("limit_chars", "limit_bytes")
    known = rows.where("sealed AND NOT marked").withColumns({"share": F.lit(1.0), "cut": F.lit(False)})
    rows = rows.where("marked OR NOT sealed")
    for k, names in (("3", "nef"), ("2", "nefx"), ("1", "nefx"), ("d", "n")):
        key = f"h{k}"
        found = counts.select(F.col("h").cast("string").alias("_key"), *[F.col(c).alias(f"{c}{k}") for c in names])
        rows = rows.withColumn("_key", _spread_nulls(key, "doc_id", "text_hash")).join(found, "_key", "left").drop("_key")
    # the rate of breaks, by those that leave a fragment of a plain word
    fragments = rows.where(~F.col("at_limit") & ~F.col("marked") & _fragment()).agg(F.count_distinct("text_hash").alias("fragments"))
    total = counts.where(F.col("h") == TOTAL).agg(*[F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1)).alias(c) for c in "nef"])
    rate = fragments.join(F.broadcast(total)).select((F.col("fragments") / F.col("n")).alias("breaks"), (F.col("e") / F.col("f")).alias("span"))  # one row each
    rows = _complete(rows.join(F.broadcast(rate)))
    rows = _numbers_complete(rows)
    below = F.when(F.col("at_limit") | F.col("marked"), F.lit(CUT_BELOW_AT_LIMIT)).otherwise(F.lit(CUT_BELOW))
    cut = (
        F.when(F.col("at_limit") & ~F.col("marked") & F.col("filled"), F.lit(False))
        .when(F.col("open"), F.lit(True))
        .when(~F.col("at_limit") & F.col("usual") & (~F.col("marked") | (F.col("share") >= 0.5)), F.lit(False))
        .otherwise(F.col("share") < below)
    )
    columns = ["doc_id", "source", "n_chars", "n_bytes", "at_limit", "share", "cut"]
    both = rows.withColumn("cut", cut).select(*columns).unionByName(known.select(*columns))
    return both.withColumn("cut_at_limit", F.col("cut") & F.col("at_limit")).withColumn("cut_in_transfer", F.col("cut") & ~F.col("at_limit"))


def _numbers_complete(rows: DataFrame) -> DataFrame:
    """Adds ``filled``: the texts of this length that end in a number were not cut there.

    A number that a limit cuts is the beginning of an ordinary number, so it
    has no more digits than numbers after the same word have inside texts.  At a
    limit where at least ``OVERLONG`` of the last numbers have more, the numbers
    are the authors' own.  Of the source's texts if there are enough of them to
    tell, else of all texts of that length.
    """
    numbers = rows.where("place IS NOT NULL AND at_limit AND NOT marked")
    long = (F.coalesce("nd", F.lit(0)) == 0).cast("double")
    mine = numbers.groupBy("source", "n_chars", "place").agg(F.avg(long).alias("_mine"), F.count(F.lit(1)).alias("_few")).withColumnsRenamed({"source": "_source", "n_chars": "_n", "place": "_p"})
    all_ = numbers.groupBy("n_chars", "place").agg(F.avg(long).alias("_all")).withColumnsRenamed({"n_chars": "_m", "place": "_q"})
    joined = rows.join(mine, F.col("source").eqNullSafe(F.col("_source")) & (F.col("n_chars") == F.col("_n")) & (F.col("place") == F.col("_p")), "left")
    joined = joined.join(all_, (F.col("n_chars") == F.col("_m")) & (F.col("place") == F.col("_q")), "left")
    filled = F.when(F.col("_few") >= FEWEST, F.col("_mine")).otherwise(F.col("_all")) >= OVERLONG
    return joined.withColumn("filled", F.coalesce(filled, F.lit(False))).drop("_mine", "_few", "_source", "_n", "_p", "_all", "_m", "_q")


def cut_rates(rows: DataFrame) -> DataFrame:
    """How often each source cuts: texts, cut texts, those of each arm, and the rate."""
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if("cut_at_limit").alias("cut_at_limits"),
        F.count_if("cut_in_transfer").alias("cut_in_transfer"), F.avg(F.col("cut").cast("double")).alias("cut_rate"),
    )
