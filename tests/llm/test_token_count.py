from collections import Counter

import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_bpe import TEXTS
from tokenizers import Tokenizer

from weftgraph.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a՘b c", "x\U00010940\U00010940 1", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts(library, monkeypatch):
    model = open(PATH, encoding="utf-8").read()
    frequent = token_count.known_lengths(model, ["a", " b", "日本語の文章です", "<|endoftext|>", "  "])
    assert frequent == dict(zip(["a", " b", "日本語の文章です", "  "], expected(library, ["a", " b", "日本語の文章です", "  "]))) and max(frequent.values()) > 1
    counter = token_count.TokenCounter(model, frequent)
    assert counter.splits and list(counter.counts([*TEXTS, *ODD])) == expected(library, [*TEXTS, *ODD])
    assert counter.odd  # characters that the library classes otherwise were noticed
    monkeypatch.setattr(token_count, "REMEMBERED", 1)
    monkeypatch.setattr(token_count, "SLICE", 3)
    assert list(counter.counts([*ODD, "one two", "two one"])) == expected(library, [*ODD, "one two", "two one"])


def test_other_models_are_counted_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_count.TokenCounter(open(path, encoding="utf-8").read())
    assert not counter.splits and list(counter.counts(["One two", None])) == expected(Tokenizer.from_file(path), ["One two", ""])


def test_column(spark, library):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate([*TEXTS, *ODD, "twice", "twice"])], "doc_id long, text string, tokens long")
    model = token_count.CountingModel(spark, PATH)
    found = docs.withColumn("n", token_count.count_tokens(F.col("text"), model)).orderBy("doc_id").collect()
    assert [r["n"] for r in found] == expected(library, [r["text"] for r in found])
    assert docs.limit(0).select(token_count.count_tokens(F.col("text"), model)).count() == 0


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = token_count.op8_token_counts(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        n = expected(library, [texts[r["doc_id"]]])[0]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_frequent_pieces_are_those_of_the_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    split = token_count.Splitter(token_count.BYTE_LEVEL)
    count = Counter(p for t in set(texts) if t is not None for p in split(t) if len(p) <= token_count.LONGEST)
    want = [p for p, _ in sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))][:2000]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    assert token_count.frequent_pieces(docs, len(texts), 2000) == want
    assert token_count.frequent_pieces(docs.limit(0)) == [] and len(token_count.frequent_pieces(docs, 3, 5)) == 5
    # the share of pre-tokens that the broadcast table serves, from a sample of 50 documents: 0.775 when this was written
    served = set(token_count.frequent_pieces(docs, len(texts) // 4))
    assert sum(n for p, n in count.items() if p in served) >= 0.75 * sum(count.values())
