import pytest
from tokenizers import Tokenizer

from stratagraph.llm import tokens

TEXTS = [
    (1, "Hello world, don't stop!"), (2, None), (3, ""), (4, "   "), (5, "a" * 3000), (6, "naïve café №5 — 重建索引\n\n\tx = 10_000"), (7, "<|endoftext|> is text"),
    (8, "=" * 500 + "\r\n" + "-+" * 200), (9, "🙂🙃 ﬁle \u200b\ufeff end  "), (10, "\x1b[33mnote\x1b[0m 12345678901234567890"), (10, "same id again"), (None, "no id"),
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_equals_the_public_library(spark, reference):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, list(r.ids)) for r in tokens.encode_corpus(df).collect()))
    assert got == sorted((i or -1, reference(t)) for i, t in TEXTS)


def test_whole_corpus_of_the_small_data(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(docs).collect()}
    want = {r.doc_id: reference(r.text) for r in docs.select("doc_id", "text").collect()}
    assert got == want


def test_decodes_back(spark):
    t = Tokenizer.from_file(tokens.TOKENIZER)
    for text in ("def f(x):\n    return x\n", "Änderungsplan, 参照一覧。"):
        (row,) = tokens.encode_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert t.decode(list(row.ids)) == text


def test_counts_and_other_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in TEXTS], "doc_id long, text string, source string, n_tokens int")
    rows = tokens.token_counts(df).collect()
    assert sorted((r.doc_id or -1, r.source, r.n_tokens) for r in rows) == sorted((i or -1, "s", len(reference(t))) for i, t in TEXTS)


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_batches_and_forgetting(monkeypatch, reference):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 7)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    encoder = tokens.Encoder(tokens.TOKENIZER)
    for _, text in TEXTS:
        assert encoder.ids([text])[0].tolist() == reference(text)


def test_long_words_go_on_where_a_query_stopped(reference):
    encoder = tokens.Encoder(tokens.TOKENIZER)
    word = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(2500))
    assert encoder.ids([word])[0].tolist() == reference(word)
