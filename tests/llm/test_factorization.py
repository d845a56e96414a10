import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from weftgraph.llm import factorization as fm


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    model = fm.Model(np.arange(20), rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 5)).astype(np.float32), 0.3)
    rows = np.array([1, 4, 9, 16])
    v = model.vectors.astype(float)
    pairs = sum(v[i] @ v[j] for k, i in enumerate(rows) for j in rows[k + 1 :])
    assert model.raw(rows) == pytest.approx(0.3 + model.weights[rows].sum() + pairs, rel=1e-5)
    again = fm.Model.from_bytes(model.to_bytes())
    assert again.raw(rows) == pytest.approx(model.raw(rows))


def test_pairs_are_learned_with_the_parameters_of_the_queries():
    rng = np.random.default_rng(1)
    insult, group = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    labels = (insult == group).astype(float)
    rows = [np.unique(np.r_[100 + a, 200 + b, rng.integers(1000, 1040, 4)]) for a, b in zip(insult.astype(int), group.astype(int))]
    model = fm.fit_rows(rows[:2500], labels[:2500], np.ones(2500))
    assert model.features.tolist() == [100, 101, 200, 201]
    right = [(model.raw(model.rows_of(r)[0]) > 0) == (y == 1) for r, y in zip(rows[2500:], labels[2500:])]
    assert np.mean(right) > 0.95


def test_a_neutral_word_that_tells_only_with_a_strong_one():
    """An insult tells something alone, a group's name nothing; with that name it always does, elsewhere rarely."""
    rng = np.random.default_rng(2)
    n = 6000
    insult, group = rng.random(n) < 0.4, rng.random(n) < 0.4
    labels = np.where(insult & group, 1, np.where(insult, rng.random(n) < 0.35, np.where(group, rng.random(n) < 0.05, rng.random(n) < 0.25))).astype(float)
    rows = [np.unique(np.r_[[100] * a, [200] * b, rng.integers(1000, 1060, 5)]).astype(np.int64) for a, b in zip(insult.astype(int), group.astype(int))]
    every = np.array([(200 in r) for r in rows])
    assert abs(labels[every].mean() - labels[~every].mean()) < 0.2
    assert {100, 200} <= set(fm._pair_features(rows, labels).tolist()) <= {100, 200}
    model = fm.fit_rows(rows, labels, np.ones(n))
    score = lambda *x: model.raw(model.rows_of(np.array(x))[0])
    assert score(100, 200) > score(100) + score(200) - model.constant + 1


def test_pairs_by_blocks_are_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    labels = (rng.random(500) < 0.5).astype(float)
    rows = [np.unique(np.r_[rng.integers(0, 40, 12), [40 + (y == (i % 2)), 42 + i % 2]]).astype(np.int64) for i, y in enumerate(labels)]
    want = fm.telling_together(rows, labels, 44)
    monkeypatch.setattr(fm, "COUNTERS", 44 * 7)
    monkeypatch.setattr(fm, "KEYS", 100)
    assert want.sum() >= 4 and (fm.telling_together(rows, labels, 44) == want).all()
    assert fm._pair_features([], labels[:0]).tolist() == [] and fm._pair_features([np.array([1])], np.ones(1)).tolist() == []


def test_one_row_of_an_id_is_learned_from(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(fm, "Classifier", lambda spark, model: fm.Model.from_bytes(model))
    rows = [(1, "good words here")] * 500 + [(i, "vile scum there") for i in range(2, 40)] + [(1, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 40)] + [(1, 1), (2, 1)], "doc_id long, toxic int")
    once = spark.createDataFrame(sorted(set(rows)), "doc_id long, text string")
    for name, frame in (("many", docs), ("once", once)):
        seen[name] = fm.fit(frame, labels, "toxic")
    assert seen["many"].constant == seen["once"].constant and (seen["many"].weights == seen["once"].weights).all()


@pytest.mark.parametrize("query, label, metadata", [(fm.op1_quality_classifier, "quality", "n_chars"), (fm.op5_toxicity, "toxic", None)])
def test_scores_are_sums_over_all_pairs(spark, query, label, metadata):
    """The query against the definition: weights of the features, and of every two of them the product of their vectors."""
    d = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fm.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), label, metadata=metadata).model()
    place = {f: i for i, f in enumerate(model.features.tolist())}
    found = {r["doc_id"]: r["score"] for r in query(spark, d).collect()}
    some = 0
    for r in docs.collect():
        text = r["text"] or ""
        tokens = text.lower().split()
        features = {f for t in tokens for f in fm.term_features(t)} | set(fm.structure_features(text, tokens, r[metadata] if metadata else None))
        rows = sorted(place[f] for f in features if f in place)
        v = model.vectors[rows].astype(float)
        pairs = float(np.triu(v @ v.T, 1).sum())  # every two of them, once
        some += len(rows) > 1
        raw = model.constant + float(model.weights[rows].astype(float).sum()) + pairs
        assert found[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-5, abs=1e-9)
    assert len(found) == 1000 and some > 100


def test_features():
    assert fm.term_features("") == [] and len(fm.term_features("idiots")) == 4
    assert set(fm.term_features("idiots")) < set(fm.term_features("idiots!!")) and set(fm.term_features("idiots!!")) < set(fm.term_features("(idiots!!"))
    assert len(fm.term_features("(word")) == 3 and len(set(fm.term_features("!" * 20)) | set(fm.term_features("!" * 21))) == 2  # whole runs of punctuation
    for text in ("", " ", "\n\n", "word", "é" * 9, "a " * 10_000):
        assert len(fm.structure_features(text, text.split(), 3.0)) == len(fm.structure_features(text, text.split(), None)) + 1


def test_scores_of_odd_rows(spark):
    rows = [(i, t, 1 if i % 2 else 5, 0.5) for i, t in enumerate(["good words here"] * 40 + ["vile scum there"] * 40)]
    rows += [(100, None, None, 1.0), (101, "", 0, 1.0), (None, "good words here", 3, 1.0), (102, "x" * 200_000, 7, 1.0), (103, "scum " * 50_000, 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, SCORE double")
    labels = spark.createDataFrame([(i, int(i >= 40), 1.0) for i in range(80)] + [(None, 1, 1.0), (999, 1, 1.0), (5, None, 1.0), (7, 9, 1.0)], "doc_id long, toxic int, score double")
    model = fm.fit(docs, labels, "toxic", metadata="n_chars")
    scored = {r["doc_id"]: r["s"] for r in docs.withColumn("s", model.score(F.col("text"), F.col("n_chars"))).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and scored[10] < 0.5 < scored[70]
    kept = fm.keep_scored(docs, model, lambda s: s < 0.5, metadata="n_chars")
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & set(range(40, 80))
    assert fm.keep_scored(docs.limit(0), model, lambda s: s < 0.5, metadata="n_chars").count() == 0
    bare = fm.fit(docs, labels.limit(0), "toxic")
    assert {r["s"] for r in docs.select(bare.score(F.col("text")).alias("s")).collect()} == {0.5}


def test_held_out_rule(spark):
    import zlib

    ids = [*range(50), None]
    found = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", fm.is_held_out(F.col("i")).alias("h")).collect()}
    assert found == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


@pytest.mark.parametrize("query, label, threshold, least", [(fm.op1_quality_classifier, "quality", 0.3, 0.97), (fm.op5_toxicity, "toxic", 0.5, 0.97)])
def test_held_out_accuracy(spark, query, label, threshold, least):
    d = SF.replace("sf0.001", "sf0.1")
    found = query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((found["score"] >= threshold) == (found["predicted"] == 1)).all()
    assert (found["predicted"] == found[label]).mean() >= least
    assert query(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
