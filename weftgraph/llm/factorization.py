"""Factorization machines over hashed terms: a quality classifier and a toxicity classifier.

A document's features are 0 or 1: its words and their beginnings, hashed, and bins of its structure statistics and
of a metadata column. The score adds a weight for each feature and, for each pair, the inner product of two short
vectors. The pairs cost linear time: half of (the square of the vectors' sum less the sum of their squares).

Fitting takes a bounded sample of labelled documents (FIT_ROWS of each class) to one task; the fitted model is a
table of at most FIT_FEATURES features, a few megabytes, whatever the corpus. Scoring is one pass over all texts.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import fresh, kept, read, ship, spread, tidy

#: Labelled documents of each class that a fit takes at most, those whose ids have the least hashes.
FIT_ROWS = 6_000
#: Features of a model at most. A feature enters by the gradient that it would have at the start of a fit, in standard deviations: its
#: weight's is by how much it is more or less frequent with label 1, FIT_ASSOCIATION or more; that of its part in a pair is by how much
#: the label differs where both are from where either is, FIT_TOGETHER or more. All pairs of words and structure features are tried.
#: What enters in neither way would only add noise, the more the longer a document is. FIT_LEAST documents have a feature at least.
FIT_FEATURES = 1 << 15
FIT_LEAST = 4
FIT_ASSOCIATION = 4.0
FIT_TOGETHER = 6.0
#: Documents of each class of the fit in which pairs are counted, and counters and keys that are held at a time.
PAIR_ROWS = 2_000
COUNTERS, KEYS = 1 << 22, 1 << 20
#: Hashes are taken modulo this.
BUCKETS = 1 << 24
FACTORS = 8
EPOCHS = 8
BATCH = 64
#: Beginnings of words that are terms besides the words.
PREFIXES = (3, 4, 5, 6)
#: Words that a worker remembers; beyond that it starts anew.
REMEMBERED = 120_000
#: Characters of the texts that are scored together.
SLICE = 1 << 21
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _hashed(term: str, pairable: bool = True) -> int:
    """A feature of a term. Even ones are tried in pairs."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % (BUCKETS >> 1) << 1 | (not pairable)


def term_features(token: str) -> list[int]:
    """The features of a token: the word within its punctuation, beginnings of it, and what punctuation stands on either side."""
    tail = token.lstrip(_PUNCTUATION)
    word = tail.rstrip(_PUNCTUATION)
    if not word:
        return [_hashed(f"p{token}", False)] if token else []
    out = [_hashed(f"{n}{word[:n]}", False) for n in PREFIXES if len(word) > n]
    out.append(_hashed(f"w{word}"))
    if len(tail) < len(token):
        out.append(_hashed(f"l{token[: len(token) - len(tail)]}", False))
    if len(word) < len(tail):
        out.append(_hashed(f"t{tail[len(word) :]}", False))
    return out


#: Upper ends of the bins of a share.
_SHARES = [0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99]


@lru_cache(1 << 12)
def _bin(name: str, place: int) -> int:
    return _hashed(f"s{name}:{place}")


def structure_features(text: str, tokens: list[str], metadata: float | None) -> list[int]:
    """Bins of a text's shares of kinds of characters, of repeated words and lines, of mean lengths, and of the metadata."""
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256).tolist()
    n, total = len(tokens), max(1, sum(count))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    tally = Counter(tokens)
    upper = sum(count[65:91])
    letters = upper + sum(count[97:123]) + sum(count[128:])
    marks = sum(map(count.__getitem__, b"#*$%&|<>"))
    shares = {
        "upper": upper / max(1, letters), "letters": letters / total, "digits": sum(count[48:58]) / total, "space": (sum(count[9:14]) + count[32]) / total,
        "marks": marks / total, "stops": sum(map(count.__getitem__, b".,;:!?")) / total, "shouts": count[33] / total,
        "same_words": 1 - len(tally) / n if n else 0.0, "most": max(tally.values()) / n if n else 0.0,
        "echo": sum(map(eq, tokens, tokens[1:])) / n if n else 0.0, "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }
    sizes = {"words": n, "word": 2 * (total - count[32]) / max(1, n), "line": n / max(1, len(lines)), "lines": len(lines)}
    if metadata is not None and metadata == metadata:
        sizes["metadata"] = max(0.0, metadata)
    return [_bin(k, bisect_left(_SHARES, v)) for k, v in shares.items()] + [_bin(k, int(2 * math.log2(1 + v))) for k, v in sizes.items()]


class _Terms(dict):
    """The features of each token that a worker has met, as rows of a ragged array; those that ``rows_of`` keeps."""

    def __init__(self, rows_of=None):
        super().__init__()
        self.rows_of = rows_of
        self.new: list[int] = []
        self.sizes: list[int] = []
        self.rows, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def __missing__(self, token: str) -> int:
        features = term_features(token)
        self.new += features
        self.sizes.append(len(features))
        self[token] = place = len(self)
        return place

    def settle(self) -> None:
        if not self.sizes:
            return
        rows, ends = np.array(self.new, np.int64), np.cumsum(self.sizes)
        if self.rows_of is not None:
            rows, hit = self.rows_of(rows)
            ends = np.concatenate([[0], np.cumsum(hit)])[ends]
        self.rows = np.concatenate([self.rows, rows])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.new, self.sizes = [], []

    def gather(self, places: np.ndarray) -> np.ndarray:
        first, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        before = np.cumsum(sizes) - sizes
        return self.rows[np.repeat(first - before, sizes) + np.arange(sizes.sum())]


class Model:
    """A fitted machine: features in order, their weights and vectors, and the constant."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, vectors: np.ndarray, constant: float):
        self.features, self.weights, self.vectors, self.constant = features, weights, vectors, float(constant)
        self.squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.terms = _Terms(self.rows_of)

    def rows_of(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's rows of those features that it has, and which these are."""
        at = np.searchsorted(self.features, hashed)
        at[at == len(self.features)] = 0
        hit = self.features[at] == hashed if len(self.features) else np.zeros(len(hashed), bool)
        return at[hit], hit

    def scores(self, texts: Iterable[str | None], metadata: Iterable[float | None]) -> Iterator[float]:
        """For each text the probability of label 1."""
        held, size = [], 0
        for text, known in zip(texts, metadata):
            text = text or ""
            tokens = text.lower().split()
            distinct = set(tokens)
            places = np.fromiter(map(self.terms.__getitem__, distinct), np.int64, len(distinct))
            held.append((places, structure_features(text, tokens, known)))
            size += len(text)
            if size >= SLICE:
                yield from self._scores(held)
                held, size = [], 0
        yield from self._scores(held)

    def _scores(self, held: list[tuple[np.ndarray, list[int]]]) -> Iterator[float]:
        self.terms.settle()
        for places, structure in held:
            rows = np.unique(np.concatenate([self.terms.gather(places), self.rows_of(np.array(structure, np.int64))[0]]))
            yield float(1 / (1 + math.exp(-min(500.0, max(-500.0, self.raw(rows))))))
        if len(self.terms) > REMEMBERED:
            self.terms = _Terms(self.rows_of)

    def raw(self, rows: np.ndarray) -> float:
        """The score in log odds: linear time by half of (square of the sum less sum of the squares)."""
        total = self.vectors[rows].sum(axis=0, dtype=np.float64)
        return self.constant + self.weights[rows].sum(dtype=np.float64) + 0.5 * (float(total @ total) - self.squares[rows].sum())

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, features=self.features, weights=self.weights, vectors=self.vectors, constant=self.constant)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return Model(x["features"], x["weights"], x["vectors"], x["constant"])


def association(ones: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """By how many standard deviations a feature is more or less frequent in documents of label 1 than in the others."""
    n1 = max(1.0, labels.sum())
    n0 = max(1.0, len(labels) - labels.sum())
    share = counts / (n0 + n1)
    gap = ones / n1 - (counts - ones) / n0
    return np.abs(gap) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))


def telling_together(rows: list[np.ndarray], labels: np.ndarray, number: int) -> np.ndarray:
    """Which of the features 0 to ``number`` - 1 tell the labels apart in a pair. ``rows`` has each document's, in order."""
    tells = np.zeros(number, bool)
    held, ones = np.zeros(number), np.zeros(number)
    for row, label in zip(rows, labels):
        held[row] += 1
        ones[row] += label
    block = max(1, COUNTERS // max(1, number))
    for low in range(0, number, block):
        counts = np.zeros((2, min(block, number - low) * number), np.int32)
        keys: dict[int, list[np.ndarray]] = {0: [], 1: []}

        def settle(label: int) -> None:
            if keys[label]:
                counts[label] += np.bincount(np.concatenate(keys[label]), minlength=counts.shape[1]).astype(np.int32)
                keys[label] = []

        for row, label in zip(rows, labels.astype(int).tolist()):
            own = row[np.searchsorted(row, low) : np.searchsorted(row, low + block)] - low
            for k in range(0, len(own), max(1, KEYS // max(1, len(row)))):
                keys[label].append((own[k : k + max(1, KEYS // len(row)), None] * number + row[None, :]).ravel())
                if sum(map(len, keys[label])) >= KEYS:
                    settle(label)
        settle(0)
        settle(1)
        for i in range(low, min(low + block, number)):
            both = counts[:, (i - low) * number : (i - low + 1) * number]
            other = np.flatnonzero(both.sum(axis=0) >= FIT_LEAST)
            other = other[other != i]
            n = both[:, other].sum(axis=0).astype(float)
            share = both[1, other] / n

            def away(every: np.ndarray, labelled: np.ndarray) -> np.ndarray:
                rate = labelled / every
                return np.abs(share - rate) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * np.maximum(1 / n - 1 / every, 1e-9))

            hit = (away(held[i], ones[i]) >= FIT_TOGETHER) & (away(held[other], ones[other]) >= FIT_TOGETHER)
            tells[other[hit]] = True
            tells[i] |= hit.any()
    return tells


def _pair_features(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features that enter a fit by a pair, from PAIR_ROWS documents of each label; ``rows`` has what may stand in pairs."""
    chosen = np.sort(np.concatenate([np.flatnonzero(labels == y)[:PAIR_ROWS] for y in (0, 1)]))
    rows, labels = [rows[i] for i in chosen], labels[chosen]
    if not rows:
        return np.empty(0, np.int64)
    found, counts = np.unique(np.concatenate(rows), return_counts=True)
    # what fewer documents have, no pair of it is by FIT_TOGETHER more frequent with either label
    sides = sorted([labels.sum(), len(labels) - labels.sum()])
    tried = found[counts >= max(FIT_LEAST, FIT_TOGETHER**2 * sides[0] / max(1.0, sides[1]))]
    if not len(tried):
        return tried

    def places(row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(tried, row), len(tried) - 1)
        return at[tried[at] == row]

    return tried[telling_together([places(row) for row in rows], labels, len(tried))]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 1, pairable: Callable[[np.ndarray], np.ndarray] | None = None) -> Model:
    """Fit by AdaGrad on the logistic loss; ``rows`` are hashed features, each once in a row, in order. ``pairable`` tells those
    that may enter by a pair; without it all may."""
    pairs = _pair_features([r[pairable(r)] for r in rows] if pairable else rows, labels)[:FIT_FEATURES]
    every = np.concatenate(rows) if rows else np.empty(0, np.int64)
    found, place, counts = np.unique(every, return_inverse=True, return_counts=True)
    ones = np.bincount(place, weights=np.repeat(labels, [len(r) for r in rows]), minlength=len(found))
    away = association(ones, counts, labels)
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
    most = np.argsort(-away, kind="stable")[: FIT_FEATURES - len(pairs)]
    features = np.union1d(found[most[(counts[most] >= FIT_LEAST) & (away[most] >= FIT_ASSOCIATION)]], pairs).astype(np.int64)
    del found, place
    at = np.minimum(np.searchsorted(features, every), max(0, len(features) - 1))
    hit = features[at] == every if len(features) else np.zeros(len(every), bool)
    sizes = np.add.reduceat(hit, np.r_[0, ends[:-1]]) if len(every) else np.zeros(len(rows), int)
    indices, ends = at[hit], np.cumsum(sizes)
    del every, at, hit

    random = np.random.default_rng(seed)
    w, v = np.zeros(len(features)), random.normal(0, 0.01, (len(features), FACTORS))
    share = float(np.clip(np.average(labels, weights=weights), 0.01, 0.99)) if len(labels) else 0.5
    constant = np.log(share / (1 - share))
    gw, gv, gc = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            parts = [indices[ends[d] - sizes[d] : ends[d]] for d in docs]
            n = sizes[docs]
            flat, doc = np.concatenate(parts), np.repeat(np.arange(len(docs)), n)
            used, inverse = np.unique(flat, return_inverse=True)
            vu = v[used]
            x = np.zeros((len(docs), len(used)), np.float32)  # a batch has few rows, so this stays small
            x[doc, inverse] = 1
            total = x @ vu
            raw = constant + x @ w[used] + 0.5 * ((total**2).sum(1) - x @ (vu**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[docs]) * weights[docs]
            ew = x.T @ error
            ev = x.T @ (error[:, None] * total) - ew[:, None] * vu
            ew += 1e-3 * w[used]
            ev += 1e-2 * vu
            gw[used] += ew**2
            gv[used] += ev**2
            gc += error.sum() ** 2
            w[used] -= 0.1 * ew / np.sqrt(gw[used])
            v[used] -= 0.02 * ev / np.sqrt(gv[used])
            constant -= 0.05 * error.sum() / np.sqrt(gc)
    return Model(features, w.astype(np.float32), v.astype(np.float32), constant)


def _extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's hashed features, in order, as the bytes of an int32 array."""
    for batch in batches:
        terms, held = _Terms(), []
        for text, known in zip(batch["text"], batch["known"]):
            text = text or ""
            tokens = text.lower().split()
            distinct = set(tokens)
            places = np.fromiter(map(terms.__getitem__, distinct), np.int64, len(distinct))
            held.append((places, structure_features(text, tokens, known)))
        terms.settle()
        features = [np.unique(np.concatenate([terms.gather(p), np.array(s, np.int64)])).astype(np.int32).tobytes() for p, s in held]
        yield batch[["key", "label", "weight", "order"]].assign(features=features)


def _fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sample = pd.concat([*batches, pd.DataFrame({"key": [], "label": [], "weight": [], "features": []})])
    sample = sample.sort_values(["key", "label", "features"], kind="stable")
    rows = [np.frombuffer(f, np.int32) for f in sample["features"]]  # hashes are below 2^24
    model = fit_rows(rows, sample["label"].to_numpy(float), sample["weight"].to_numpy(float), pairable=lambda features: features % 2 == 0)
    made = pd.DataFrame({"model": [model.to_bytes()]})
    del sample, rows, model
    tidy()
    yield made


def is_held_out(doc_id: Column) -> Column:
    """Whether labels of a document are not to be learned from; so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Classifier:
    """A fitted model that scores columns."""

    def __init__(self, spark: SparkSession, model: bytes):
        self.name = hashlib.sha256(model).hexdigest()
        self.sent = spark.sparkContext.broadcast(model)

    def model(self) -> Model:
        return kept(self.name, lambda: Model.from_bytes(self.sent.value))

    def score(self, text: Column, metadata: Column | None = None) -> Column:
        """``double``: the probability of label 1.

        Null texts count as empty, and null metadata is left out. Each row stands for itself, equal ones score alike, and no
        rows give none. A text is read whole, however long. Names of columns play no part.
        """

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = self.model()
            for texts, known in batches:
                yield pd.Series(list(model.scores(texts, known)), dtype="float64")

        known = F.lit(None).cast("double") if metadata is None else metadata.cast("double")
        return scored(text, known)


def fit(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str = "doc_id", text: str = "text", metadata: str | None = None, rows: int = FIT_ROWS) -> Classifier:
    """Fit on the labelled documents that are not held out, ``rows`` of each class at most.

    Labels other than 0 and 1, and labels of documents that are not there, are passed over; an id with several labels has
    the least. Of rows of equal id, one with the least hash of its text is taken, so that the sample stays bounded. Ties
    between ids are decided by the ids. Without labelled documents the model is a constant. A null text is empty, a long
    one is read whole, null metadata is left out. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(~is_held_out(F.col("id")) & F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label"))
    known = known.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi").withColumn("key", F.xxhash64(F.lit(17), "id"))
    chosen = None
    for value, n in sorted((r["label"], r["count"]) for r in known.groupBy("label").count().collect()):
        some = known.where(F.col("label") == value).orderBy("key", "id").limit(rows).withColumn("weight", F.lit(max(1.0, n / rows)))
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        chosen = known.withColumn("weight", F.lit(1.0))
    meta = F.lit(None).cast("double") if metadata is None else F.col(metadata).cast("double")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), meta.alias("known"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("order", F.xxhash64("text", "known"))  # 2 * rows ids at most
    features = sample.select("key", "label", "weight", "order", "text", "known").mapInPandas(_extract, "key long, label int, weight double, order long, features binary")
    once = features.groupBy("key").agg(F.min(F.struct("order", "features", "label", "weight")).alias("f")).select("key", "f.label", "f.weight", "f.features")
    return Classifier(spark, once.repartition(1).mapInPandas(_fit, "model binary").first()["model"])


def _classify(spark: SparkSession, sf_dir: str, label: str, threshold: float, metadata: str | None) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    classifier = fit(docs, read(spark, sf_dir, "labels"), label, metadata=metadata)
    score = classifier.score(F.col("text"), F.col(metadata) if metadata else None)
    scored = spread(docs.select("doc_id", "text", *filter(None, [metadata]))).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document for quality; odd rows as in :func:`fit` and :meth:`Classifier.score`."""
    return _classify(spark, sf_dir, "quality", 0.3, "n_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document for toxicity; odd rows as in :func:`fit` and :meth:`Classifier.score`."""
    return _classify(spark, sf_dir, "toxic", 0.5, None)


def keep_scored(docs: DataFrame, classifier: Classifier, keeps, *, text: str = "text", metadata: str | None = None) -> DataFrame:
    """The documents whose score ``keeps`` accepts, with the columns they had."""
    (score,) = fresh(docs, "score")
    scored = docs.withColumn(score, classifier.score(F.col(text), F.col(metadata) if metadata else None))
    return scored.where(keeps(F.col(score))).select(*docs.columns)
