import re
from collections import defaultdict

import numpy as np
from compare import compare
from conftest import SF

from weftgraph.llm import oracles, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    repeated = len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)})
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words))


def test_base_counts(spark):
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x", "x\ny\nx\n \n \nx", "#*$%&|<> a", "\x0bone\x0ctwo\rthree", "w " * 9, "é" * 50, "l l2\n" * 3000, " ".join(map(str, range(4000)))]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, True, 3) for i, t in enumerate([*texts, "same", "same"])], "doc_id long, text string, lang string, kept boolean, Words int")
    found = {r["doc_id"]: tuple(r[c] for c in BASE) for r in quality_rules.apply_rules(docs).collect()}
    assert found == {i: expected(t) for i, t in enumerate([*texts, "same", "same"])}
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_divergent_documents_are_rejected_and_short_ones_are_not(spark):
    rng = np.random.default_rng(1)
    common = quality_rules.COMMON_WORDS["en"]
    clean = [" ".join(common[rng.integers(0, 20)] if rng.random() < 0.4 else f"{'abcdefghij'[rng.integers(0, 10)]}{'klmnopqrst'[rng.integers(0, 10)]}house" for _ in range(150)) + "." for _ in range(200)]
    odd = ["".join(f"QX{i}{k}&&| ##Z{k * 7}%% " for k in range(80)) for i in range(5)]
    bare = [" ".join(f"lorem{i}x{k}" for k in range(100)) for i in range(5)]
    rows = [(i, t, "en") for i, t in enumerate([*clean, *odd, *bare, "QXQX&&| ZZ%% " * 1 + " ".join(f"K{k}##" for k in range(12))])]
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(found[i]["kept"] or found[i]["base_failed"] for i in range(200, 210))
    assert all(found[i]["kept"] for i in range(200))
    assert found[210]["kept"] and found[210]["js_chars"] > 0.26  # too short to be judged


def test_query(spark):
    assert compare(spark, SF, quality_rules.op2_quality_rules, oracles.quality_rules_sql()) == ""


def test_clean_documents_stay(spark):
    d = SF.replace("sf0.001", "sf0.01")
    found = quality_rules.op2_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert found.where("not kept").count() <= 0.01 * found.count()
