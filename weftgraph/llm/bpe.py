"""Byte-level BPE encoding and decoding with numpy matrices.

A text is split by the tokenizer's pattern. Pre-tokens that a worker has not met are encoded together: their
bytes stand in matrices whose rows have about the same length, and in each round every row merges its leftmost pair
of least rank. Pairs are found in an open-addressing hash table held in arrays; a round also drops the merged
column, and rows without a pair to merge leave the matrix. A row of more than LONG_ROW bytes is a matrix of its own, in
which a round merges, from the left, all occurrences of the least pair up to the first that makes a pair of lower rank;
that is the same sequence of merges, in as many rounds as there are different ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import fresh, kept, read, ship, spread

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Bytes of a pre-token beyond which its row merges many occurrences a round; one a round costs the square of its length.
LONG_ROW = 2048
#: Cells of a matrix at most.
CELLS = 1 << 19
#: Pre-tokens that a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Characters whose pre-tokens are held at a time.
SLICE = 1 << 21
#: Documents whose ids are put out at a time.
ROWS = 1_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks of mergeable pairs of token ids: linear probing over arrays, looked up for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(left) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]  # of several that want a slot one gets it
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank for each pair, NONE without one; negative ids merge with nothing."""
        out = np.full(left.shape, NONE, np.int32)
        real = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        key = (left.ravel()[real].astype(np.int64) << 32) | right.ravel()[real].astype(np.int64)
        slot = self._slot(key)
        flat = out.ravel()
        while len(real):
            there = self.keys[slot]
            hit = there == key
            flat[real[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            real, key, slot = real[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


class Met(dict):
    """The place of each pre-token that a worker has met; ``settle`` encodes the new ones, ``gather`` joins their ids."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = place = len(self)
        return place

    def settle(self, encode_bytes: Callable[[list[bytes]], list[bytes]]) -> None:
        if not self.new:
            return
        arrays = encode_bytes([p.encode("utf-8", "surrogatepass") for p in self.new])
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(arrays), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.new = []

    def gather(self, places: np.ndarray) -> np.ndarray:
        first, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(first - before, sizes) + np.arange(sizes.sum())]


class Splitter:
    """The matches of a pattern in a text, as the ``regex`` module finds them.

    Where the pattern has no other properties than letters, numbers and white space, an equal pattern with their
    ranges in the Basic Multilingual Plane is run by the faster standard module on texts without other characters.
    """

    def __init__(self, pattern: str):
        self.slow = regex.compile(pattern)
        self.fast = None
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        known = {name: self._ranges(regex.findall(f"{name}+", plane)) for name in (r"\p{L}", r"\p{N}", r"\s")}
        # inside a class the ranges stand alone, outside they make a class
        inner = regex.sub(r"\[\^?[^\]]*\]", lambda m: self._put(m[0], known, "%s"), pattern)
        outer = "".join(part if part.startswith("[") else self._put(part, known, "[%s]").replace(r"\S", f"[^{known[chr(92) + 's']}]") for part in regex.split(r"(\[[^\]]*\])", inner))
        if not regex.search(r"\\[pPsSdDwWbB]", outer):
            self.fast = re.compile(outer)

    @staticmethod
    def _put(part: str, known: dict[str, str], form: str) -> str:
        for name, ranges in known.items():
            part = part.replace(name, form % ranges)
        return part

    @staticmethod
    def _ranges(runs: list[str]) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)

    def __call__(self, text: str) -> list[str]:
        if self.fast is not None and len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.fast.findall(text)
        return self.slow.findall(text)


class Encoder:
    """Encodes pre-tokens by a table of ranks, where a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("every single byte needs a rank")
        pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array([p[k] for p in pairs], np.int64) for k in range(3)))
        self.met = Met()

    def encode_bytes(self, pieces: list[bytes]) -> list[bytes]:
        """For each pre-token its ids, as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            width = int(lengths[order[at]])
            if width > LONG_ROW:
                out[order[at]] = self._encode_long(pieces[order[at]])
                at += 1
                continue
            bucket = min(LONG_ROW, 1 << (width - 1).bit_length())
            end = min(int(np.searchsorted(lengths[order], bucket, side="right")), at + max(1, CELLS // bucket))
            rows = order[at:end]
            self._encode_rows([pieces[i] for i in rows], lengths[rows], rows, out)
            at = end
        return out

    def _encode_rows(self, pieces: list[bytes], lengths: np.ndarray, names: np.ndarray, out: list[bytes]) -> None:
        filled = np.arange(int(lengths.max())) < lengths[:, None]
        ids = np.full(filled.shape, -1, np.int32)
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        left = lengths.copy()
        while True:
            if rank.shape[1]:
                best = rank.argmin(axis=1)  # the leftmost of equals
                least = rank[np.arange(len(best)), best]
                done = least == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                for i in np.flatnonzero(done):
                    out[names[i]] = ids[i, : left[i]].tobytes()
                if done.all():
                    return
                on = ~done
                ids, rank, left, names, best, least = ids[on], rank[on], left[on], names[on], best[on], least[on]
            n, width = ids.shape
            row = np.arange(n)
            ids[row, best] = least
            stay = np.ones((n, width), bool)
            stay[row, best + 1] = False
            ids = ids[stay].reshape(n, width - 1)
            gone = np.ones((n, width - 1), bool)
            gone[row, best] = False
            rank = rank[gone].reshape(n, width - 2)
            left -= 1
            for shift in (-1, 0):  # the pairs that the merged token now stands in
                p = best + shift
                ok = np.flatnonzero((p >= 0) & (p < width - 2))
                rank[ok, p[ok]] = self.pairs.lookup(ids[ok, p[ok]], ids[ok, p[ok] + 1])

    def _encode_long(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.lookup(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            start = np.r_[True, np.diff(at) > 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # of overlapping occurrences the left one merges
            # each occurrence meets what is on its left by then, and on its right what no merge has reached
            before = np.where(np.r_[False, np.diff(at) == 2], least, ids[at - 1])
            before[at == 0] = -1
            after = ids[np.minimum(at + 2, len(ids) - 1)].copy()
            after[at + 2 >= len(ids)] = -1
            merged = np.full(len(at), least, np.int32)
            sooner = np.flatnonzero((self.pairs.lookup(before, merged) < least) | (self.pairs.lookup(merged, after) < least))
            if len(sooner):
                at = at[: sooner[0] + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids[at] = least
            ids, rank = ids[stay], np.append(rank, NONE)[stay][:-1]
            place = at - np.arange(len(at))
            for p in (place - 1, place):
                p = p[(p >= 0) & (p < len(rank))]
                rank[p] = self.pairs.lookup(ids[p], ids[p + 1])
        return ids.tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Pre-tokens of about SLICE characters are held at a time."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            pieces = self.split(text) if text else []
            held.append(np.fromiter(map(self.met.__getitem__, pieces), np.int64, len(pieces)))
            size += len(text) if text else 0
            if size >= SLICE:
                yield from self._encode_held(held)
                held, size = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, held: list[np.ndarray]) -> Iterator[np.ndarray]:
        self.met.settle(self.encode_bytes)
        for places in held:
            yield self.met.gather(places)
        if len(self.met) > REMEMBERED:
            self.met = Met()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """A rank file's content, sent to the workers once. Its size is that of the file, a megabyte or so."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ship(spark)
        with open(path, "rb") as f:
            self.name = hashlib.sha256(f.read() + pattern.encode()).hexdigest()
        self.pattern = pattern
        self.ranks = spark.sparkContext.broadcast(load_ranks(path))

    def encoder(self) -> Encoder:
        return kept(self.name, lambda: Encoder(self.ranks.value, self.pattern))

    def __getstate__(self):
        return {"name": self.name, "pattern": self.pattern, "ranks": self.ranks}


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """``array<int>``: the token ids of a text. Null and empty texts have none, special strings are ordinary text.

    Each row stands for itself: repeated texts give the same ids again, and no rows give none. A text is encoded whole,
    however long it is or its pre-tokens are; of pairs of equal rank the leftmost merges first. Names of columns play no part.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = vocabulary.encoder()
        for texts in batches:
            yield pd.Series(list(encoder.encode(texts)), dtype=object)

    return ids(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """``binary``: the bytes that token ids stand for; none for null or an empty array.

    Bytes need not be UTF-8 where ids were cut apart. An id that the vocabulary does not have is an error. Arrays of any
    length are decoded whole; names of columns play no part.
    """

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = vocabulary.encoder()
        for arrays in batches:
            yield pd.Series([encoder.decode(a.tolist()) if a is not None else b"" for a in arrays], dtype=object)

    return decoded(ids)


def _round_trip(encoder: Encoder, texts: Iterable[str | None], with_ids: bool) -> Iterator[tuple]:
    for array in encoder.encode(texts):
        ids = array.tolist()
        line = ",".join(map(encoder.decimals.__getitem__, ids))
        row = (len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest())
        yield (*row, array) if with_ids else row


def round_trip(text: Column, vocabulary: Vocabulary) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>``: what :func:`encode` and then :func:`decode` give, as digests.

    Both run in one pass over the text, so that the ids need not go to the JVM and back. A null text is as an empty one; else
    as :func:`encode`.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = vocabulary.encoder()
        for texts in batches:
            yield pd.DataFrame(list(_round_trip(encoder, texts, False)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def token_rows(docs: DataFrame, vocabulary: Vocabulary, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens, ids_sha256, decoded_sha256, ids``, ROWS rows at a time, since ids take more room
    than their text.

    A row for each of ``docs``, repeated ones, too; null and empty texts have no ids. Columns of ``docs`` that are not named
    are not returned; a named one may not be called as one of the four, in any case.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    if clash := {c.lower() for c in columns} & set(made):
        raise ValueError(f"columns are called as those that are made: {sorted(clash)}")
    (held,) = fresh(docs, "text")
    named = docs.select(*columns, F.col(text).alias(held))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = zip(*_round_trip(encoder, part.column(len(columns)).to_pylist(), True))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x, kind) for x, kind in zip(found, kinds))], [*columns, *made])

    kept = ", ".join(f"`{n}` {t}" for n, t in named.dtypes[:-1])
    return named.mapInArrow(rows, ", ".join(filter(None, [kept, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"])))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with column ``ids``; a column of that name is replaced, all others stay."""
    (made,) = fresh(docs, "ids")
    out = docs.withColumn(made, encode(F.col(text), vocabulary))
    return out.drop("ids").withColumnRenamed(made, "ids")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document; odd rows as in :func:`round_trip`."""
    import public_tokenizers

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", round_trip(F.col("text"), vocabulary).alias("r")).select("doc_id", "r.*")
