"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

First tier: a table of the most frequent pre-tokens and their lengths in tokens, broadcast. Frequencies are those in a
sample of SAMPLE documents; the table has FREQUENT entries of LONGEST characters at most, whatever the corpus. It
decides no result, only how fast it is found. Second tier: what a worker has met besides; a pre-token in
neither is encoded by the library, together with the others of its batch.

Texts that the split by pre-tokens does not cover are counted whole by the library: those with a special token's
string, and those with a character that the library's splitter classes otherwise than ours (it is compared
character by character as new ones turn up).
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import SLICE, Splitter
from weftgraph.llm.runtime import kept, read, ship, spread

#: Documents of whose texts the frequencies are taken, those whose texts have the least hashes; of copies one.
SAMPLE = 4_000
#: Entries of the broadcast table at most, and characters of one: about 3 MB.
FREQUENT, LONGEST = 32_768, 32
#: Pre-tokens that a worker remembers, the frequent ones included; beyond that the second tier starts anew.
REMEMBERED = 400_000
#: The split that byte-level pre-tokenizers of the ``tokenizers`` library make.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Places(dict):
    """The place of each pre-token's length; new ones are noted."""

    def __init__(self, frequent: Iterable[str]):
        super().__init__((p, i) for i, p in enumerate(frequent))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = place = len(self)
        return place


class TokenCounter:
    """Counts the tokens of texts as the ``tokenizers`` library would encode them, without added special tokens."""

    def __init__(self, model: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(model)
        first = config.get("pre_tokenizer") or {}
        self.splits = config.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True) and config["model"]["type"] == "BPE"
        added = [t["content"] for t in config.get("added_tokens") or () if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = Splitter(BYTE_LEVEL)
        self.checked: set[str] = set()
        self.odd: set[str] = set()
        self.frequent = frequent or {}
        self._check("".join(self.frequent))
        self._start()

    def _start(self) -> None:
        self.places = Places(self.frequent)
        self.lengths = np.fromiter(self.frequent.values(), np.int32, len(self.frequent))

    def _check(self, characters: str) -> None:
        for c in set(characters) - self.checked:
            self.checked.add(c)
            probe = f"a{c}{c} {c}1"
            theirs = [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            if theirs != self.split(probe):
                self.odd.add(c)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        """The number of tokens of each text, in order; 0 for null."""
        held: list[tuple[str, np.ndarray | None]] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.splits or self.special is not None and self.special.search(text):
                held.append((text, None))
            else:
                pieces = self.split(text)
                held.append((text, np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))))
            size += len(text)
            if size >= SLICE:
                yield from self._counts(held)
                held, size = [], 0
        yield from self._counts(held)

    def _counts(self, held: list[tuple[str, np.ndarray | None]]) -> Iterator[int]:
        if new := self.places.new:
            self._check("".join(new))
            made = self.library.encode_batch(new, add_special_tokens=False)
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int32, len(made))])
            self.places.new = []
        for text, places in held:
            if places is None or self.odd and not self.odd.isdisjoint(text):
                yield self.whole(text)
            else:
                yield int(self.lengths[places].sum())
        if len(self.places) > REMEMBERED:
            self._start()


def _frequencies(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pre-tokens of a partition and how often they occur there."""
    split, found = Splitter(BYTE_LEVEL), Counter()
    for batch in batches:
        for text in batch["text"]:
            found.update(p for p in split(text) if len(p) <= LONGEST)
    if found:
        yield pd.DataFrame({"piece": list(found), "n": np.fromiter(found.values(), np.int64, len(found))})


def frequent_pieces(texts: DataFrame, sample: int = SAMPLE, most: int = FREQUENT) -> list[str]:
    """The ``most`` frequent pre-tokens of ``sample`` texts (column ``text``), the most frequent first, ties in order."""
    ship(texts.sparkSession)
    hashed = texts.where("text is not null").select("text", F.xxhash64("text").alias("hash"))
    last = hashed.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    some = hashed.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.first("text").alias("text"))  # copies count once
    some = some.select("text").repartition(texts.sparkSession.sparkContext.defaultParallelism)
    counted = some.mapInPandas(_frequencies, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(most).collect()]


def known_lengths(model: str, pieces: Iterable[str]) -> dict[str, int]:
    """The lengths in tokens of those pieces that are pre-tokens by themselves, as the library gives them."""
    counter = TokenCounter(model)
    if not counter.splits:
        return {}
    chosen = [p for p in pieces if not (counter.special and counter.special.search(p))]
    return {p: len(e) for p, e in zip(chosen, counter.library.encode_batch(chosen, add_special_tokens=False))}


class CountingModel:
    """A tokenizer file and the table of frequent pre-tokens, sent to the workers once; bounded by the file and by FREQUENT."""

    def __init__(self, spark: SparkSession, path: str, pieces: Iterable[str] = ()):
        ship(spark)
        with open(path, encoding="utf-8") as f:
            model = f.read()
        lengths = known_lengths(model, pieces)
        self.name = hashlib.sha256(f"{model}{list(lengths)}".encode("utf-8", "surrogatepass")).hexdigest()
        self.sent = spark.sparkContext.broadcast((model, lengths))

    def counter(self) -> TokenCounter:
        return kept(self.name, lambda: TokenCounter(*self.sent.value))


def count_tokens(text: Column, model: CountingModel) -> Column:
    """``long``: the tokens of a text; 0 for null and empty texts.

    Each row stands for itself: repeated texts count again, and no rows give none. A text is counted whole, however long.
    Names of columns play no part.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are dealt out by Spark
        counter = model.counter()
        for texts in batches:
            yield pd.Series(list(counter.counts(texts)), dtype="int64")

    return tokens(text)


def op8_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; null texts are empty, else as :func:`count_tokens`."""
    import public_tokenizers

    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    model = CountingModel(spark, public_tokenizers.path("byte_bpe_50k.json"), frequent_pieces(docs.select("text")))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = docs.select("doc_id", n_bytes.alias("n_bytes"), count_tokens(F.col("text"), model).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
