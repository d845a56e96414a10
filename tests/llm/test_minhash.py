from collections import Counter

import numpy as np
from compare import compare
from conftest import SF

from weftgraph.llm import minhash, oracles

SCHEMA = "doc_id long, text string, kept string, CLASS_ID int"


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = minhash.split_words(text)
        n = min(5, len(words))
        sets.append((" ".join(words), Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else None))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (ti, a) in enumerate(sets):
        for j, (tj, b) in enumerate(sets[:i]):
            same = rows[i][0] == rows[j][0]
            if a and b and not same:
                common = sum((a & b).values())
                same = ti == tj or common >= threshold * (sum(a.values()) + sum(b.values()) - common)
            if same:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)]) for i, (doc, _) in enumerate(rows))


def classes(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    return sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())


def text_of(rng, n):
    return [f"w{x}" for x in rng.integers(0, 3000, n)]


def test_coordinates_agree_with_the_weighted_similarity():
    rng = np.random.default_rng(2)
    for _ in range(4):
        h = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
        a = (h[:50], rng.integers(1, 9, 50))
        b = (h[10:], rng.integers(1, 9, len(h) - 10))
        true = minhash.similarity(a, b)
        agree = []
        for salt in range(30):
            with np.errstate(over="ignore"):
                pair = [(minhash.mix(x + np.uint64(salt * 977)), w) for x, w in (a, b)]
            one, two = minhash.signatures(pair)
            agree.append((one == two).mean())
        assert abs(np.mean(agree) - true) < 0.04


def test_signatures_are_full_and_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sets = [(np.sort(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))), None) for n in (1, 2, 40, 5000)]
    sets = [(h, rng.integers(1, 4, len(h))) for h, _ in sets]
    together = minhash.signatures(sets)
    assert (together != 0).all()
    for s, row in zip(sets, together):
        assert (minhash.signatures([s])[0] == row).all()


def test_classes(spark):
    rng = np.random.default_rng(3)
    rows, doc = [], 100
    for _ in range(12):
        base = text_of(rng, int(rng.integers(5, 300)))
        for edits in (0, 0, 1, 2, 4, 12):
            words = list(base)
            for _ in range(edits):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 1 << 30)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    rows += [(1, None), (2, ""), (3, " \n"), (4, None), (5, "one two"), (6, "one  two\n"), (7, "one"), (8, "y " * 30_000), (9, "y " * 29_000), (10, "z " * 10), (10, "other text for the same id")]
    assert classes(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base, rows = text_of(rng, 120), []
    for i in range(150):
        words = list(base)
        for _ in range(int(rng.integers(1, 7))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 1 << 30)}"
        rows.append((i, " ".join(words)))
    found = brute(rows)
    assert len({c for _, c in found}) > 2
    assert classes(spark, rows) == found


def test_null_ids_and_empty_tables(spark):
    assert classes(spark, []) == []
    docs = spark.createDataFrame([(None, "a b c d e f", "k", 1), (None, "a b c d e f", "k", 1), (3, "a b c d e f", "k", 1)], SCHEMA)
    assert sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs).collect()) == [(0, 0, True), (0, 0, True), (3, 3, True)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_one_of_each_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "something else altogether, is it"), (4, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == [3, 4, 9]


def test_query(spark):
    assert compare(spark, SF, minhash.op6_minhash_dedup, oracles.minhash_sql()) == ""
