"""Near-duplicates by DartMinHash: weighted signatures from darts, banded joining, exact verification.

A document is a weighted set: its shingles of five words, each with its number of occurrences. Every element has, on
intervals of the weight axis that double in length, a random stream of darts that depends on the element and the
interval alone: a dart has a rank (arrival time), a position on the weight axis and a coordinate. A dart below
the element's weight hits; the earliest hit of each coordinate is the signature. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Only darts up to a rank that leaves about
COORDINATES * ln COORDINATES hits in a document are thrown, whatever its length; where a coordinate is left empty,
twice that rank is used.

Equal word sequences are one text from the start. Texts that share a band are not all paired: a band's first text is
verified against the others, the links give connected sets, and where a band has texts of several connected sets left, those
outside the largest are compared with all, in blocks. So no link between texts that share a band is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import cut, fresh, kept, read, ship, spread
from weftgraph.plans.connectivity import Graph, component_labels
from weftgraph.plans.unionfind import forest_edges

SHINGLE = 5
SIMILAR = 0.8
#: Bands and rows: a pair of similarity 0.8 shares no band with a probability of 7e-5.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Shingles whose darts are thrown together.
SLICE = 1 << 18
#: Texts of a side of a block of a band.
BLOCK = 512
#: Words that a worker remembers.
REMEMBERED = 150_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of 64 bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


class _Words(dict):
    """The hash of each word that a worker has met."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(words: list[str]) -> np.ndarray:
    """A hash of each run of SHINGLE words; of all words if they are fewer; none without words."""
    known = kept("words", _Words)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, U(n))
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + U(0x9E3779B97F4A7C15))
    return out


def weighted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles in order, and how often each occurs."""
    return np.unique(shingle_hashes(words), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity; 0 with an empty set."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][x], b[1][y]).sum())
    every = int(a[1].sum()) + int(b[1].sum()) - common
    return common / every if every else 0.0


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, limit: np.ndarray, signature: np.ndarray, least: np.ndarray) -> None:
    """Throw the darts up to each document's rank limit and keep the earliest per document and coordinate."""
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # intervals [0,1), [1,2), [2,4), ... that reach below the weight
    which = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(element[which] + U(0x632BE59BD9B4E019) * (level.astype(np.uint64) + U(1)))
    rank = np.zeros(len(which))
    at, arrival = np.arange(len(which)), 0
    found: list[tuple[np.ndarray, ...]] = []
    while len(at):
        arrival += 1
        with np.errstate(over="ignore"):
            gap = mix(seed[at] + U(0x9E3779B97F4A7C15) * U(2 * arrival))
        rank[at] -= np.log(_unit(gap)) / width[at]
        at = at[rank[at] < limit[doc[which[at]]]]
        with np.errstate(over="ignore"):
            dart = mix(seed[at] + U(0x9E3779B97F4A7C15) * U(2 * arrival + 1))
        hit = low[at] + width[at] * _unit(dart) < weight[which[at]]
        dart = mix(dart[hit] ^ U(0xD1B54A32D192ED03))
        found.append((rank[at[hit]], doc[which[at[hit]]], dart))
    rank, doc, dart = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-rank, kind="stable")  # the earliest is written last
    cell = doc[order] * COORDINATES + (dart[order] % U(COORDINATES)).astype(np.int64)
    signature.ravel()[cell] = dart[order]
    least.ravel()[cell] = rank[order]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each weighted set, which is not empty, its COORDINATES earliest darts."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    least = np.full((len(sets), COORDINATES), np.inf)
    totals = np.array([w.sum() for _, w in sets], float)
    hits = COORDINATES * (math.log(COORDINATES) + 2)
    limit = hits / np.maximum(totals, 1)
    todo = np.arange(len(sets))
    while len(todo):
        sizes = [len(sets[i][0]) for i in todo]
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        _throw(element, weight, np.repeat(todo, sizes), limit, out, least)
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS keys of 64 bits for each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + parts[:, :, r] + U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\f\r", " "))


def split_words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def _sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's digest of its words, and its bands; null for one without words.

    Digests that the task has met of late are not signed again: their rows have a null in place of bands.
    """
    met: set[bytes] = set()

    def signed(ids: list, digests: list, sets: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        bands: list = [None] * len(ids)
        if sets:
            for i, keys in zip(sets, band_keys(signatures(list(sets.values())))):
                bands[i] = keys.tobytes()
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "digest": pd.Series(digests, dtype=object), "bands": pd.Series(bands, dtype=object)})

    for batch in batches:
        ids, digests, sets, size = [], [], {}, 0
        for doc, text in zip(batch["doc_id"], batch["text"]):
            words = split_words(text)
            digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None
            if words and digest not in met:
                if len(met) > REMEMBERED:
                    met.clear()
                met.add(digest)
                sets[len(ids)] = weighted(words)
                size += len(words)
            ids.append(doc)
            digests.append(digest)
            if size >= SLICE:
                yield signed(ids, digests, sets)
                ids, digests, sets, size = [], [], {}, 0
        yield signed(ids, digests, sets)


def _explode(bands: Column) -> Column:
    """The keys of a row's bands: eight bytes each, of which any hash will do."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(bands, 8 * i + 1, F.lit(8)), i))


def _verify(threshold: float):
    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block follow each other, its first text before the others, of which one is held at a time."""
        key, firsts, found = None, [], ([], [])
        for batch in batches:
            for a, salt, role, rep, text in zip(*(batch[c].to_numpy() for c in ("a", "salt", "role", "rep", "text"))):
                if (a, salt) != key:
                    key, firsts = (a, salt), []
                if role == 0:
                    firsts.append(weighted(split_words(text)))
                    continue
                other = weighted(split_words(text))
                if any(similarity(first, other) >= threshold for first in firsts):
                    found[0].append(a)
                    found[1].append(rep)
            yield pd.DataFrame({"a": np.array(found[0], np.int64), "b": np.array(found[1], np.int64)})
            found = ([], [])

    return verify


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Those of the different pairs ``a, b`` whose texts are similar. Only texts that stand in a pair are moved to it.

    The partners of one ``a`` are dealt out to blocks of about BLOCK, so that no task gets all those of a frequent one; its
    own text is moved once to each block, not to each pair.
    """
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = cut(docs.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")).select(F.col("doc_id").alias("rep"), "text")
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64(F.lit(3), "b"), F.col("blocks")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("rep"))
    firsts = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("rep"))
    placed = dealt.unionByName(firsts).join(texts, "rep").select("a", "salt", "role", "rep", "text")
    grouped = placed.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "rep")
    return grouped.mapInPandas(_verify(threshold), "a long, b long").distinct()


def _compare(threshold: float):
    def links(every: list[tuple], few: list[tuple]) -> pd.DataFrame:
        """Links between the few and all of a group (rep, label, text), as stars; pairs of one label are passed over."""
        sets = [_elements(split_words(text)) for _, _, text in every]
        sizes = np.array([len(x) for x in sets], np.int64)
        owner, element = np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        rep, label = np.array([r for r, _, _ in every], np.int64), np.array([x for _, x, _ in every], np.int64)
        place = {r: k for k, (r, _, _) in enumerate(every)}
        ends: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for a, la, text in few:
            own = sets[place[a]] if a in place and every[place[a]][2] == text else _elements(split_words(text))
            low, high = np.searchsorted(element, own), np.searchsorted(element, own, side="right")
            n = high - low
            common = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
            hit = (common >= threshold * (len(own) + sizes - common)) & (label != la)
            ends.append((np.full(int(hit.sum()), a, np.int64), rep[hit]))
        src, dst = forest_edges(*(np.concatenate(x) for x in zip(*ends)))
        return pd.DataFrame({"a": src, "b": dst})

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow each other, so that one at a time is held: 2 * BLOCK texts."""
        key, held = None, ([], [])
        for batch in batches:
            columns = (batch[c].to_numpy() for c in ("band", "i", "j", "role", "rep", "label", "text"))
            for band, i, j, role, rep, label, text in zip(*columns):
                if (band, i, j) != key:
                    if held[1]:
                        yield links(*held)
                    key, held = (band, i, j), ([], [])
                held[role].append((rep, label, text))
        if held[1]:
            yield links(*held)

    return compare


def _elements(words: list[str]) -> np.ndarray:
    """A text's shingles with their occurrences as elements of their own, so that a plain intersection counts them."""
    h, n = weighted(words)
    which = np.repeat(np.arange(len(h)), n)
    with np.errstate(over="ignore"):
        return mix(h[which] + U(0xA0761D6478BD642F) * (np.arange(len(which)) - (np.cumsum(n) - n)[which]).astype(np.uint64))


def _within_bands(apart: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between texts of a band (``band, rep, label``) with different labels.

    In each band the texts that do not have its most frequent label are compared with all, in blocks of BLOCK by BLOCK
    texts; pairs are never put out, only links. Bands of the same texts are searched once.
    """
    counts = apart.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"))
    bands = counts.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where(F.col("n") > F.col("most.k"))
    once = bands.groupBy("n", "x", "y").agg(F.min(F.struct("band", "most")).alias("one"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = once.select(F.col("one.band").alias("band"), F.col("one.most.label").alias("major"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("one.most.k")).alias("few"))
    members = cut(apart.join(plan, "band"))
    block = lambda n: F.pmod(F.xxhash64(F.lit(2), "rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = members.select("band", "rep", "label", upto("few").alias("i"), block("all").alias("j"), F.lit(0).alias("role"))
    few = members.where(F.col("label") != F.col("major")).select("band", "rep", "label", block("few").alias("i"), upto("all").alias("j"), F.lit(1).alias("role"))
    wanted = members.select(F.col("rep").alias("want")).distinct()
    texts = docs.join(wanted, F.col("doc_id") == F.col("want"), "left_semi").select(F.col("doc_id").alias("of"), "text")
    placed = every.unionByName(few).join(texts, F.col("rep") == F.col("of")).select("band", "i", "j", "role", "rep", "label", "text")
    grouped = placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "role", "rep")
    return grouped.mapInPandas(_compare(threshold), "a long, b long")


def _labelled(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return component_labels(Graph.of(edges))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id, class_id, kept``.

    Texts link if the weighted Jaccard similarity of their shingles of five words is ``threshold`` or more; a text of
    fewer words is one shingle. ``class_id`` is the least id that links reach, ``kept`` whether the document is the one
    of that id. Texts of equal words are copies, of the same class; texts without words, null ones included, are
    copies of none. Rows of equal id are one vertex, so they share a class, and are all kept or none. A null id
    is its own class, null, and kept. Ties are decided by ids. A very long text is shingled whole, and an empty table gives
    no rows. Other columns are neither read nor returned.
    """
    ship(docs.sparkSession)
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = every.where(F.col("doc_id").isNotNull())
    signed = cut(named.mapInPandas(_sign, "doc_id long, digest binary, bands binary"))

    # copies: one head for each digest
    with_words = signed.where(F.col("digest").isNotNull())
    heads = cut(with_words.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("bands").alias("bands")))
    copies = with_words.join(heads.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where(F.col("a") != F.col("b")).distinct()

    # bands that several heads share
    banded = heads.select("rep", F.explode(_explode(F.col("bands"))).alias("band"))
    firsts = banded.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where(F.col("first") != F.col("last"))
    shared = cut(banded.join(firsts.select("band", "first"), "band").distinct())
    tried = cut(shared.where(F.col("first") != F.col("rep")).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(verified(tried, named, threshold))

    # what a band still has apart is compared within the band
    labels = cut(_labelled(links))
    apart = shared.join(labels, shared["rep"] == labels["v"], "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    more = cut(_within_bands(apart, named, threshold))

    found = _labelled(links.union(more).union(copies))
    of = found.select(F.col("v").alias("of"), F.col("label").alias("class"))
    ids = every.select("doc_id")
    out = ids.join(of, F.col("doc_id") == F.col("of"), "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """One document of each class of near-duplicates, with the columns it had; of rows of equal id all stay or none."""
    classes = near_duplicates(docs, doc_id=doc_id, text=text, threshold=threshold)
    (gone,) = fresh(docs, "gone")
    dropped = classes.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(doc_id).cast("long") == F.col(gone), "left_anti")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, class_id, kept`` of every document; odd rows as in :func:`near_duplicates`."""
    return near_duplicates(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
