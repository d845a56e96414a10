import hashlib

import public_tokenizers
import tiktoken
from conftest import SF
from pyspark.sql import functions as F
from test_minhash import brute

from weftgraph.llm import bpe, factorization, mixing


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
    rows = lambda df: sorted(map(str, df.collect()))

    # what each stage decides is what its operator says of its own input
    (before, after) = kept[0]
    model = factorization.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), "quality", metadata="n_chars")
    assert rows(before.where(model.score(F.col("text"), F.col("n_chars")) >= 0.3)) == rows(after)
    (before, after) = kept[2]
    classes = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in classes})
    (before, after) = kept[3]
    assert rows(mixing.take(mixing.mix(before))) == rows(after)
    (before, after) = kept[4]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    found = after.collect()
    assert len(found) == before.count()
    for r in found:
        assert list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, found))


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, COPIES int"
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0, 2), (2, "", "en", "a", 0, None, 2), (None, "x y", "en", "b", 3, 1.0, None), (4, "w " * 50_000, "de", "a", 9, 1.0, 2), (4, "w " * 50_000, "de", "a", 9, 1.0, 2)], schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            out.count()
        assert cp.STAGES[-1][1](spark, frame, SF).count() == frame.count()
