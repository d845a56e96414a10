import math
import re

import numpy as np
from conftest import SF

from weftgraph.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, Target int, copies long"


def targets_by_hand(sizes, weights, total, most):
    full, target = set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        target = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if target[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full |= over


def decided(mixed):
    columns = ["doc_id", mixed.size, mixed.source_size, mixed.target, mixed.copies]
    return sorted(tuple(r) for r in mixed.docs.select(*columns).collect())


def check(spark, rows, most_off):
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    mixed = mixing.mix(docs)
    found = decided(mixed)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets_by_hand([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    source_of = {r[0]: r[2] for r in rows}
    for s, t in zip(names, want):
        own = [r for r in found if source_of[r[0]] == s]
        assert all(abs(r[3] - t) <= 1e-6 * max(1, t) and r[2] == sizes[s] for r in own)
        assert abs(sum(r[1] * r[4] for r in own) - t) <= most_off * max([r[1] for r in own])
    assert all(0 <= r[4] <= 2 for r in found) and len(found) == len(rows)
    assert decided(mixing.mix(docs)) == found
    taken = mixing.take(mixed)
    assert taken.columns == docs.columns and taken.count() == sum(r[4] for r in found)
    return found


def sources_of(spark, sizes, weights, docs=1):
    rows = [(i, s, float(w), max(1.0, s / docs)) for i, (s, w) in enumerate(zip(sizes, weights))]
    return spark.createDataFrame(rows, "place long, words long, weight double, scale double")


def test_targets(spark):
    for sizes, weights in (([10, 100, 1000, 0], [3, 1, 2, 3]), ([5, 5, 5], [1, 1, 1]), ([1, 2, 3, 4, 500], [9, 9, 9, 9, 1])):
        total = 1.5 * sum(sizes)
        found = [r["target"] for r in mixing.shared_targets(sources_of(spark, sizes, weights), total, 2).orderBy("place").collect()]
        assert np.allclose(found, targets_by_hand(sizes, weights, total, 2))
    assert mixing.shared_targets(sources_of(spark, [1], [1]).limit(0), 0, 2).count() == 0


def test_tilts_are_those_of_the_dual(spark):
    """Rates are min(2, exp(tilt * size)) and bring each source to its target, as a bisection in numpy does."""
    rng = np.random.default_rng(0)
    groups = [(i, int(s), int(rng.integers(1, 50))) for i in range(4) for s in np.unique(rng.integers(0, 3000, 60))]
    words = [sum(s * n for p, s, n in groups if p == i) for i in range(4)]
    targets = [0.1 * words[0], 1.7 * words[1], 2.0 * words[2], 1e-4 * words[3]]
    sources = spark.createDataFrame([(i, words[i], 700.0, targets[i]) for i in range(4)], "place long, words long, scale double, target double")
    solved = mixing.solve_tilts(spark.createDataFrame(groups, "place long, size long, n long"), sources, 2.0)
    found = {r["place"]: r["tilt"] for r in solved.collect()}
    assert found[2] == mixing.FULL
    for i in (0, 1, 3):
        size, n = (np.array([g[k] for g in groups if g[0] == i], float) for k in (1, 2))
        got = lambda tilt: (np.minimum(2, np.exp(np.minimum(1, tilt * size / 700))) * n * size).sum()
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if got(mid) > targets[i] else (mid, high)
        assert abs(found[i] - mid) <= 1e-4 * max(1, abs(mid)) and abs(got(found[i]) - targets[i]) <= 1e-6 * targets[i] + 1


def test_rates_have_the_least_entropy(spark):
    """No shift of rate between documents of a source that keeps its words has less relative entropy."""
    rows = [(i, " ".join(["w"] * (i % 37)), "ab"[i % 2]) for i in range(300)]
    groups = [(p, s, sum(1 for i, t, x in rows if x == "ab"[p] and len(t.split()) == s)) for p in (0, 1) for s in range(37)]
    groups = [g for g in groups if g[2]]
    words = [sum(s * n for p, s, n in groups if p == i) for i in (0, 1)]
    sources = spark.createDataFrame([(i, words[i], 18.0, (1.4, 0.6)[i] * words[i]) for i in (0, 1)], "place long, words long, scale double, target double")
    tilts = {r["place"]: r["tilt"] for r in mixing.solve_tilts(spark.createDataFrame(groups, "place long, size long, n long"), sources, 2.0).collect()}
    entropy = lambda r: r * math.log(r) - r + 1
    for p in (0, 1):
        own = [(s, min(2, math.exp(tilts[p] * s / 18))) for q, s, n in groups if q == p and s]
        for (s1, r1), (s2, r2) in zip(own, own[5:]):
            for d in (1e-3, -1e-3):
                a, b = r1 + d / s1, r2 - d / s2
                if 0 < a <= 2 and 0 < b <= 2:
                    assert entropy(a) + entropy(b) >= entropy(r1) + entropy(r2) - 1e-9


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), rng.choice(["a", "b", "ç", "d"])) for i in range(400)]
    rows += [(1000 + i, t, None) for i, t in enumerate([None, "", "one two", "x " * 20_000, "same", "same"])]
    check(spark, rows, 1)


def test_equal_rows_and_one_hot_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    rows = [(7, "one two three", "a")] * 150 + [(8, "one two three", "b")] * 60 + [(i, "four five", "c") for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    found = decided(mixing.mix(docs))
    for doc, n in ((7, 150), (8, 60)):
        own = [r for r in found if r[0] == doc]
        assert len(own) == n and abs(sum(r[1] * r[4] for r in own) - own[0][3]) <= 3
    assert decided(mixing.mix(docs)) == found


def test_nothing_to_mix(spark):
    assert decided(mixing.mix(spark.createDataFrame([], SCHEMA))) == []
    empty = mixing.mix(spark.createDataFrame([(1, None, "a", "", 1, 1), (2, "", None, "", 1, 1)], SCHEMA))
    assert [(r[0], r[1], r[3]) for r in decided(empty)] == [(1, 0, 0.0), (2, 0, 0.0)]


def test_query(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = check(spark, docs, 1)
    query = mixing.op9_mix_sources(spark, SF)
    assert query.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, query.collect())) == [(d, s, ss, t, s * c) for d, s, ss, t, c in found]
