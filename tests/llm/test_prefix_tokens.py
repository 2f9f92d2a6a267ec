import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbtide.llm import prefix_tokens as P

TEXTS = [
    None, "", " ", "a", "Hello world, it's 12345 o'clock!  \n\n\tdon't", "é ñ ß 日本語 😀😀 naïve", "x" * 300,
    "a<|endoftext|>b <|endoftext|>", "  \n  leading and trailing \n ", "the the the the",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.default_vocabulary())


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, library, small):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = P.prefix_counts(docs).withColumn("n", P.token_count()).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {k: size(library, t) for k, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {k: len((t or "").encode()) for k, t in enumerate(TEXTS)}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n"] for r in P.prefix_counts(table).withColumn("n", P.token_count()).collect()}
    assert got == {r["doc_id"]: size(library, r["text"]) for r in table.collect()}


def test_every_prefix(library):
    counter = P.PrefixCounter(P.default_vocabulary())
    for text in TEXTS[2:7] + TEXTS[8:]:
        ends, counts = counter.prefixes(text)
        for n in range(len(text) + 1):
            assert counter.prefix_tokens(text, n, ends, counts) == size(library, text[:n]), (text, n)
        for end, count in zip(ends, counts):
            assert count == size(library, text[:end])


def test_prefix_counts_of_a_piece_agree_with_the_cached_ones():
    counter = P.PrefixCounter(P.default_vocabulary())
    for piece in (b" unbelievable", b"anticonstitutionnellement", "ñandú".encode()):
        assert counter.piece_counts(piece)[1:] == [counter.state(piece[:n])[0] for n in range(1, len(piece) + 1)]


def test_truncation_needs_no_encoding(spark, library):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for budget in range(9):
        n = P.prefix_counts(docs).select(P.fitting_chars(budget)).first()[0]
        assert size(library, text[:n]) <= budget
        assert n == len(text) or size(library, text[: text.find(" ", n + 1)] if " " in text[n + 1 :] else text) > budget


def test_caches_do_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 5)
    counter = P.PrefixCounter(P.default_vocabulary())
    for text in TEXTS[2:]:
        assert counter.prefixes(text)[1][-1] == size(library, text)


def test_empty_table_repeated_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, n_bytes int, piece_ends string"
    assert P.prefix_counts(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(None, "a b", 1, "x")] * 2, schema)
    assert [tuple(r) for r in P.prefix_counts(twice).select("doc_id", P.token_count()).collect()] == [(None, 2)] * 2
