import math

import numpy as np
from compare import compare
from conftest import SF

from weftgraph.llm import oracles, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, kept string, N_LINKS int"


def brute(rows):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if ok(v) else None for _, v in rows]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), v), v)
    return sorted((v, links[i], least[find(i)], least[find(i)] == v) for i, (v, _) in enumerate(rows))


def found(spark, rows):
    vectors = spark.createDataFrame([(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], "k", 1) for v, e in rows], SCHEMA)
    return sorted(tuple(r) for r in vector_dedup.near_duplicate_vectors(vectors).collect())


def clustered(rng, n, size=24):
    out = []
    while len(out) < n:
        centre = rng.normal(size=size)
        out += [centre + rng.normal(size=size) * rng.choice([0.1, 0.3, 0.45]) for _ in range(int(rng.integers(1, 12)))]
    return out[:n]


def test_links(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), clustered(rng, 300))]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (11, [-1.0, -2.0]), (12, [1e30, 2e30]), (13, [1e-30, 2e-30]), (14, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_a_hot_list_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.3).tolist()) for i in range(150)] + [(1000 + i, base.tolist()) for i in range(60)]
    want = brute(rows)
    got = found(spark, rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(got, want))


def test_cosines_at_the_threshold(spark):
    """10 * 9 / (10 * 10) is the threshold's own double; vectors of length 1 would not always say so."""
    rows = [(1, [10.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [20.0, 0.0, 0.0, 0.0]), (4, [8.999999, 3.0, 3.0, 1.0]), (5, [2.0**100 * x for x in (9.0, 3.0, 3.0, 1.0)])]
    got = {r[0]: r[1] for r in found(spark, rows)}
    assert got == {1: 3, 2: 4, 3: 3, 4: 2, 5: 4}


def test_recall_among_the_vectors_of_the_table(spark):
    """The table has no link of its own, so near copies of a fifth of its vectors are added."""
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").collect()], float)
    rng = np.random.default_rng(7)
    some = x[rng.integers(0, len(x), 400)]
    x = np.float32(np.concatenate([x, some + rng.normal(size=some.shape) * np.abs(some).mean() * 0.4])).astype(float)
    want = pairs(x)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(rows).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 400 and (got <= want).all() and got.sum() >= 0.95 * want.sum()


def test_null_ids(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0], "k", 1), (4, [1.0, 2.0], "k", 1), (4, [1.0, 2.0], "k", 1), (4, [-2.0, 1.0], "k", 1)], SCHEMA)
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in vector_dedup.near_duplicate_vectors(vectors).collect())
    assert got == [(0, 0, 0, True), (4, 0, 4, True), (4, 1, 4, True), (4, 1, 4, True)]


def test_query(spark):
    assert compare(spark, SF, vector_dedup.op3_vector_dedup, oracles.vector_dedup_sql()) == ""


def pairs(x, threshold=0.9):
    """Links of each row, by brute force."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(x[k : k + 2000] @ x.T >= threshold).sum(axis=1) for k in range(0, len(x), 2000)]) - 1


def near_copies(rng, n, share=1 / 3, size=64, noise=0.36):
    """Random vectors, of which a ``share`` are distinct near copies of one."""
    m = int(n * share)
    centre = rng.normal(size=size)
    x = np.concatenate([centre + noise * rng.normal(size=(m, size)), rng.normal(size=(n - m, size))])
    return np.float32(rng.permutation(x)).astype(float)


def test_a_third_are_near_copies(spark):
    x = near_copies(np.random.default_rng(3), 20_000)
    want = pairs(x)
    assert want.sum() > 1_000_000  # it has 256 pivots before thinning
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(rows).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_a_hot_home_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 48)
    x = near_copies(np.random.default_rng(4), 900, noise=0.36)
    want = pairs(x)
    got = {r[0]: r[1] for r in found(spark, [(i, v) for i, v in enumerate(x.tolist())])}
    got = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 10_000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_one_pivot_in_a_rare_dimension(spark, monkeypatch):
    rng = np.random.default_rng(5)
    common = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 120))]
    centre = rng.normal(size=10)
    rare = [(1000 + i, (centre + rng.normal(size=10) * 0.1).tolist()) for i in range(12)]
    rows = common + rare
    one = lambda classes, number, *a: {24: vector_dedup.unit([v for _, v in common[:32]]), 10: vector_dedup.unit([rare[0][1]])}
    monkeypatch.setattr(vector_dedup, "fit_pivots", one)
    want = brute(rows)
    assert sum(r[1] for r in want if r[0] >= 1000) > 100
    got = found(spark, rows)
    assert [r for r in got if r[0] >= 1000] == [r for r in want if r[0] >= 1000]


def test_recall_of_planted_copies(spark):
    rng = np.random.default_rng(6)
    alone, centres = rng.normal(size=(5_000, 64)), np.repeat(rng.normal(size=(1_000, 64)), rng.integers(2, 8, 1_000), axis=0)
    x = np.float32(np.concatenate([alone, centres + rng.normal(size=centres.shape) * 0.3])).astype(float)
    want = pairs(x)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicate_vectors(rows).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 10_000 and (got <= want).all() and got.sum() >= 0.98 * want.sum()
