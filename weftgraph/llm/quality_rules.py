"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document is reduced to counts: its characters by class, and the common words of its language. Summed over all
documents of a language these are the language's reference. A document's two histograms are then held against its
reference by the Jensen-Shannon distance (base 2, so from 0 to 1); short documents, and references gathered from
little text, are not judged by it.

The texts are read once: the counts, some hundred bytes a document, are checkpointed before they are summed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import NOT_SPACE, cut, read, spread, words_of

# Common words by language code.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "it": ["di", "e", "il", "la", "che", "in", "a", "per", "un", "del", "non", "con", "le", "si", "da", "una", "i", "della", "è", "al"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat", "op", "te", "zijn", "met", "voor", "niet", "aan", "er", "om", "ook", "als", "dan"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se", "na", "por", "mais", "as"],
}
SPACE_CLASS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Small letters, white space, other letters, digits, punctuation and symbols as classes; all else makes one more.
CHARACTER_CLASSES = [r"\p{Ll}", SPACE_CLASS, r"\p{Lu}\p{Lt}", r"""!"'(),\-.:;?""", r"\p{Lm}\p{Lo}\p{M}", r"\p{N}", SYMBOLS]
WINDOW = 5
#: Languages up to which the references are broadcast, some hundred bytes each; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once although ``body`` may use it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that is found twice or more."""

    def key(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))

    def second(i: Column) -> Column:
        return F.hash(*(F.get(words, i + k) for k in range(WINDOW)))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, at: F.struct(at.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["at"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def same(a: Column, b: Column) -> Column:
        return a["key"].eqNullSafe(b["key"]) & a["second"].eqNullSafe(b["second"])

    def count(starts: Column) -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(key(i).alias("key"), second(i).alias("second"), i.alias("at"))))
        twice = let(windows, lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))))
        return covered(F.sort_array(F.transform(twice, lambda x: x["at"])))

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    once = let(F.transform(starts, key), lambda keys: F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).when(once, F.lit(0).cast("long")).otherwise(count(starts))


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: its id, its language ('' for null), and its counts. A null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    n_dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    step = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), whole.alias("rest0"), words_of(F.col(text)).alias("words"), n_dup_lines.alias("n_dup_lines"))
    # class by class the text is stripped of its characters, the most frequent first, so that what is left is short
    for i, characters in enumerate(CHARACTER_CLASSES):
        step = step.withColumn(f"rest{i + 1}", F.regexp_replace(f"rest{i}", f"[{characters}]+", ""))
    length = [F.char_length(f"rest{i}") for i in range(len(CHARACTER_CLASSES) + 1)]
    classes = [length[i] - length[i + 1] for i in range(len(CHARACTER_CLASSES))]
    any_common = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lists = F.create_map(*(x for code, ws in COMMON_WORDS.items() for x in (F.lit(code), F.array(*map(F.lit, ws)))))
    common = F.filter(F.transform("words", F.lower), lambda w: w.isin(any_common))
    own = F.coalesce(F.try_element_at(lists, F.col("lang")), F.array().cast("array<string>"))
    tallied = let(common, lambda found: F.transform(own, lambda w: F.size(found) - F.size(F.array_remove(found, w))))
    return step.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (length[0] - classes[CHARACTER_CLASSES.index(SPACE_CLASS)]).cast("long").alias("word_chars"),
        classes[CHARACTER_CLASSES.index(SYMBOLS)].cast("long").alias("n_symbols"),
        "n_dup_lines",
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*classes, length[-1]).cast("array<bigint>").alias("classes"),
        tallied.cast("array<bigint>").alias("some_words"),
    ).select("*", _with_rest(F.col("some_words"), F.col("n_words")).alias("words")).drop("some_words")


def _with_rest(counts: Column, total: Column) -> Column:
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))


def language_references(counts: DataFrame) -> DataFrame:
    """Per language the sums of its documents' histograms: ``lang, ref_classes, ref_words``."""
    width = {"classes": len(CHARACTER_CLASSES) + 1, "words": max(map(len, COMMON_WORDS.values())) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c, n in width.items() for i in range(n)]
    arrays = [F.filter(F.array(*(f"{c}_{i}" for i in range(n))), lambda x: x.isNotNull()).alias(f"ref_{c}") for c, n in width.items()]
    return counts.groupBy("lang").agg(*sums).select("lang", *arrays)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two histograms of the same bins; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)
    shares = lambda a: let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t)))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    both = F.zip_with(shares(p), shares(q), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), (part(x, y) + part(y, x)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), total(both)))


def held_against(counts: DataFrame, references: DataFrame) -> DataFrame:
    """Each document's distances ``js_chars, js_words`` from its language's reference; null where there is none."""
    chars, words = jensen_shannon(F.col("classes"), F.col("ref_classes")), jensen_shannon(F.col("words"), F.col("ref_words"))
    small = F.broadcast if references.count() <= BROADCAST_LANGUAGES else (lambda df: df)
    return counts.join(small(references), "lang", "left").withColumns({"js_chars": F.round(chars, 6), "js_words": F.round(words, 6)})


def apply_rules(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_chars: float = 0.26, max_words: float = 0.32, max_both: float = 0.47, min_chars: int = 300, min_words: int = 60, min_reference: int = 5000, refine: tuple[float, ...] = (0.35, 0.25),
) -> DataFrame:
    """Base counts and the verdict of every document.

    :param max_chars: the distance of character classes above which a document of ``min_chars`` characters in words is rejected
    :param max_words: the same for common words, for a document of ``min_words`` words and a language with a list
    :param max_both: the same for the two distances' sum, for a document that is long enough for both
    :param refine: the reference is gathered from the documents that pass the base rules, and then once more for each of
        these distances from those that lie no farther from it, so that what is to be rejected does not shape it
    :param min_reference: words of a language below which its reference rejects nothing

    Null or empty texts have no words and fail the base rules. A language without a list, or null, is judged by its
    characters alone. Repeated ids give a row each. Other columns of ``docs`` are neither read nor returned.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = cut(document_counts(docs, doc_id, text, lang).withColumn("base_failed", failed))
    references = cut(language_references(counts.where(~F.col("base_failed"))))
    for limit in refine:
        near = held_against(counts, references).where(~F.col("base_failed") & (F.col("js_chars") <= limit) & ~F.coalesce(F.col("js_words") > limit, F.lit(False)))
        references = cut(language_references(near))
    judged = held_against(counts, references)
    reference_words = F.aggregate("ref_words", F.lit(0).cast("long"), lambda a, x: a + x)
    trusted = reference_words >= min_reference
    chars_told = trusted & (F.col("word_chars") >= min_chars)
    words_told = trusted & (F.col("n_words") >= min_words) & (F.size("words") > 1)
    far = [chars_told & (F.col("js_chars") > max_chars), words_told & (F.col("js_words") > max_words), chars_told & words_told & (F.col("js_chars") + F.col("js_words") > max_both)]
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far[0], F.lit(False)) & ~F.coalesce(far[1], F.lit(False)) & ~F.coalesce(far[2], F.lit(False)))
        .select(*base, "base_failed", "kept", "js_chars", "js_words")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
