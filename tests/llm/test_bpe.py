import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F

from weftgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "a b  c\n\n d", "l'été où?", "日本語の文章です。" * 30, "😀😀 👩‍👩‍👧", "<|endoftext|> x", "ab" * 4000, " " * 3000 + "x", "x\x00\x85　y", "12345 6789", "it's we'll I'D", "one two " * 5000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_encoder_gives_the_library_s_ids(encoder, library):
    assert [x.tolist() for x in encoder.encode(TEXTS)] == [library.encode_ordinary(t or "") for t in TEXTS]
    for text in TEXTS:
        assert encoder.decode(next(encoder.encode([text])).tolist()) == (text or "").encode()


def test_every_character_class(encoder, library):
    for low in [*range(0, 0x3000, 256), 0xA000, 0xFF00, 0x10000, 0x1F600, 0xE0000]:
        texts = [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(low, low + 256)]
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_rows_and_short_ones_agree(encoder, monkeypatch):
    rng = np.random.default_rng(0)
    tokens = [t for t in encoder.tokens if t]
    pieces = [("abcab" * 200).encode(), b"x" * 999, b"ab" * 600, b" \n" * 300, "é日".encode() * 200]
    pieces += [b"".join(tokens[i] for i in rng.integers(0, len(tokens), 150)) for _ in range(20)]
    pieces += [bytes(rng.choice(list(b"etaoin shr"), 700).tolist()) for _ in range(20)]
    monkeypatch.setattr(bpe, "LONG_ROW", 10_000)
    rows = encoder.encode_bytes(pieces)
    monkeypatch.setattr(bpe, "LONG_ROW", 10)
    assert encoder.encode_bytes(pieces) == rows


def test_merges_whose_ranks_fall(monkeypatch):
    """Ranks that no training gives: a merge makes a pair that comes before the one that was just merged."""
    single = {bytes([b]): b for b in range(256)}
    ranks = single | {b"ab": 300, b"abc": 260, b"bca": 280, b"abab": 270, b"cab": 290, b"aa": 310, b"aab": 265, b"ca": 320}
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.choice(list(b"abc"), 60).tolist()) for _ in range(300)]
    encoder = bpe.Encoder(ranks, r".+")
    monkeypatch.setattr(bpe, "LONG_ROW", 1000)
    rows = encoder.encode_bytes(pieces)
    monkeypatch.setattr(bpe, "LONG_ROW", 4)
    assert encoder.encode_bytes(pieces) == rows


def test_a_long_pre_token_of_many_merges(encoder, library):
    text = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyz"), 60_000))
    assert next(encoder.encode([text])).tolist() == library.encode_ordinary(text)


def test_worker_memory_starts_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    monkeypatch.setattr(bpe, "SLICE", 5)
    texts = ["one two three", "four five", "one two three"]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_pair_table_finds_all_pairs_and_no_others():
    import numpy as np

    left, right = np.divmod(np.arange(500), 25)
    table = bpe.PairTable(left, right, np.arange(500))
    assert table.lookup(left, right).tolist() == list(range(500))
    assert (table.lookup(left + 1000, right) == bpe.NONE).all() and (table.lookup(-left - 1, right) == bpe.NONE).all()


def test_columns(spark, library):
    rows = [(i, t, "x", 1.0) for i, t in enumerate([*TEXTS, "again", "again"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, N_TOKENS double")
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    encoded = bpe.encode_documents(docs, vocabulary)
    assert encoded.columns == ["doc_id", "text", "N_TOKENS", "ids"]
    both = encoded.withColumn("back", bpe.decode(F.col("ids"), vocabulary)).orderBy("doc_id").collect()
    assert [r["ids"] for r in both] == [library.encode_ordinary(t or "") for _, t, *_ in rows]
    assert [bytes(r["back"]).decode() for r in both] == [t or "" for _, t, *_ in rows]
    assert bpe.encode_documents(docs.limit(0), vocabulary).count() == 0
    named = bpe.token_rows(docs, vocabulary, "doc_id")
    assert sorted((r["doc_id"], list(r["ids"])) for r in named.collect()) == [(r["doc_id"], list(r["ids"])) for r in both]
    with pytest.raises(ValueError):
        bpe.token_rows(docs, vocabulary, "doc_id", "N_TOKENS")
    assert bpe.token_rows(docs.withColumnRenamed("ids", "__text"), vocabulary, "__text").count() == len(rows)
    assert docs.limit(1).select(bpe.decode(F.lit(None).cast("array<int>"), vocabulary).alias("d")).first()["d"] == b""


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = bpe.op10_byte_bpe(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
