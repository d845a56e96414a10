"""Mixing sources to target weights by entropy balancing.

Among all document rates r (expected copies) between 0 and ``most`` that bring a source to its target, the ones of
least relative entropy to the corpus as it is, sum of r ln r - r + 1, are r = min(most, exp(tilt * size)), with one
tilt for each source. The tilts solve the convex dual: Newton's steps, guarded by bisection, each one a distributed
sum over the table of (source, size, number of documents). Sources, targets and tilts are tables, too, so that there
may be any number of them; the driver sees counts alone.

Rates are then rounded to copies along the sizes: the copies of a source, taken in order of size, are the steps of
the running sum of rates. The sums of copies and of rates differ by less than one document anywhere, so the words
differ by no more than the largest document has; of OFFSETS starting points the one that comes nearest is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.runtime import cut, fresh, read, words_of
from weftgraph.operators.labels import numbered

#: Starting points of the rounding that are tried.
OFFSETS = 64
#: Documents of one source and size that are ranked together, about.
RANKED = 1_000
#: Sizes that are summed up together before the sums of a source are.
SIZES = 256
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Newton's steps at most. The bisection that guards them halves an interval of tilts every other step at least, so that doubles leave
#: nothing to halve well before.
MAX_STEPS = 200
#: Steps that are planned together.
STEPS = 3
#: The tilt that stands for an infinite one.
FULL = 1e30
#: Relative distance from the target at which a source is solved.
NEAR = 1e-7


def shared_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """``sources`` (with ``words, weight``) with ``target``: in proportion to weights, none above ``most`` times its source's
    words, what is above shared anew among the others. Each round adds full sources and sums three numbers."""
    limit = most * F.col("words")
    full, before = F.lit(False), 0
    while True:
        sums = sources.agg(F.sum(F.when(full, limit)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not sums["open"]:
            return sources.withColumn("target", limit.cast("double"))
        share = F.col("weight") * F.lit((total - (sums["taken"] or 0.0)) / sums["open"])
        if before and sums["n"] == before:
            return sources.withColumn("target", F.when(full, limit).otherwise(F.greatest(F.lit(0.0), F.least(share, limit))).cast("double"))
        # what is left for each weight grows from round to round, so that what was over stays so
        full, before = share > limit, sums["n"]
        if not before and not sources.where(full).limit(1).count():
            return sources.withColumn("target", F.greatest(F.lit(0.0), share).cast("double"))


@dataclass(frozen=True)
class Mix:
    """What a mix has decided: the documents with column names as given, and the columns it added."""

    docs: DataFrame
    own: tuple[str, ...]
    size: str
    source_size: str
    target: str
    copies: str


def _rates(tilt: Column, z: Column, most: float) -> Column:
    """min(most, exp(tilt * z)), without overflow."""
    tilted = F.least(F.lit(float(most)), F.exp(F.least(tilt * z, F.lit(math.log(most) + 1))))
    return F.when(tilt >= FULL, F.lit(float(most))).when(tilt <= -FULL, F.lit(0.0)).otherwise(tilted)


def solve_tilts(groups: DataFrame, sources: DataFrame, most: float, few: bool = False) -> DataFrame:
    """``sources`` with ``tilt``, for sizes in units of ``scale``; FULL where the target is all that the source can give.

    ``groups`` has ``place`` (of the source), ``size`` and ``n``; ``sources`` has ``place, words, scale, target``. Sums are taken
    of whole numbers, whose order does not matter, so that reruns find the same tilts. A source that is not solved after
    MAX_STEPS is an error. ``few`` says that the sources are known to be no more than BROADCAST_SOURCES.
    """
    words = F.col("n") * F.col("size")
    z = F.col("size") / F.col("scale")
    rate = _rates(F.col("tilt"), z, most)
    slope = F.when(rate < most, rate * z * words).otherwise(F.lit(0.0))
    whole = lambda x, unit: F.sum(F.round(x * unit).cast("long")) / unit
    start = F.when(F.col("target") >= most * F.col("words") * (1 - 1e-9), F.lit(FULL)).when(F.col("target") <= 0, F.lit(-FULL)).otherwise(F.lit(0.0))
    state = cut(sources.withColumns({"tilt": start, "low": F.lit(-math.inf), "high": F.lit(math.inf)}).withColumn("solved", F.abs("tilt") == FULL))

    def stepped(state: DataFrame) -> DataFrame:
        trial = state.where(~F.col("solved")).select("place", "tilt", "scale")
        got = groups.join(F.broadcast(trial) if few else trial, "place").groupBy("place").agg(whole(rate * words, 1024).alias("got"), whole(slope, 64).alias("rise"))
        tilt, low, high, gap = F.col("tilt"), F.col("low"), F.col("high"), F.col("got") - F.col("target")
        step = F.when(F.col("rise") > 0, tilt - F.try_divide(gap, F.col("rise")))
        inside = (low < step) & (step < high) & (F.abs(step - tilt) <= 4 + 4 * F.abs(tilt))
        unbounded = (low == -math.inf) | (high == math.inf)
        guarded = F.when(unbounded, tilt - F.signum(gap) * (1 + 3 * F.abs(tilt))).otherwise((low + high) / 2)
        known = state.join(F.broadcast(got) if few else got, "place", "left")
        known = known.withColumns({"high": F.when(gap > 0, tilt).otherwise(high), "low": F.when(gap <= 0, tilt).otherwise(low)})
        over = F.col("solved") | (F.abs(gap) <= NEAR * F.col("target")) | (high - low <= 1e-12 * F.abs(tilt))
        return known.select(*sources.columns, F.when(over, tilt).otherwise(F.when(inside, step).otherwise(guarded)).alias("tilt"), "low", "high", over.alias("solved"))

    for _ in range(-(-MAX_STEPS // STEPS)):
        if state.where(~F.col("solved")).isEmpty():
            return state.drop("low", "high", "solved")
        for _ in range(STEPS):
            state = stepped(state)
        state = cut(state)
    if state.where(~F.col("solved")).isEmpty():
        return state.drop("low", "high", "solved")
    raise RuntimeError(f"{state.where(~F.col('solved')).count()} sources are not solved after {MAX_STEPS} steps")


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> Mix:
    """Decide how many copies of each document the mix takes.

    Sources in order of code points, null last, weigh ``weights``, repeating; together they are to have ``share`` times
    the words of the corpus, each at most ``most`` times its own. Equal ids and equal rows are documents of their
    own, taken in an order that depends on their content only, so that reruns agree. A null or empty text has size 0
    and is taken as often as its rate rounds to; a very long one counts with all its words. An empty table gives none. All columns of ``docs`` stay; those that
    are added have names that ``docs`` does not use.
    """
    size, source_size, target, copies, place, bucket, key, at = fresh(docs, "size", "source_size", "target", "copies", "place", "bucket", "key", "at")
    sized = docs.withColumn(size, F.size(words_of(F.col(text))).cast("long"))
    counted = cut(sized.groupBy(F.col(source).alias("source"), F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n")))
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.max("n").alias("largest"))
    named = numbered(sums.select(F.col("source").isNull().alias("last"), "source", "words", "docs", "largest"), "last", "source").withColumnRenamed("number", "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    scale = F.greatest(F.lit(1.0), F.col("words") / F.greatest(F.lit(1), F.col("docs")))
    named = cut(named.select("source", "place", "words", "largest", weight.alias("weight"), scale.alias("scale")))
    facts = named.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.max("largest"), F.lit(0)).alias("largest")).first()
    few = facts["sources"] <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    places = named.select(F.col("source").alias("named"), "place")
    groups = cut(counted.join(small(places), F.col("source").eqNullSafe(F.col("named"))).select("place", "size", "n"))
    solved = solve_tilts(groups, shared_targets(named.select("place", "words", "weight", "scale"), share * facts["words"], most), most, few)

    # running sums of rates: within blocks of sizes, then over the blocks
    rate = _rates(F.col("tilt"), F.col("size") / F.col("scale"), most)
    rated = groups.join(small(solved), "place").withColumns({"rate": rate, "block": F.floor(F.col("size") / SIZES)})
    within = Window.partitionBy("place", "block").orderBy("size")
    rated = cut(rated.withColumn("upto", F.sum(F.col("rate") * F.col("n")).over(within.rowsBetween(Window.unboundedPreceding, 0))))
    blocks = rated.groupBy("place", "block").agg(F.max("upto").alias("block_sum"))
    earlier = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("sum_before", F.coalesce(F.sum("block_sum").over(earlier), F.lit(0.0)))
    before = F.col("sum_before") + F.coalesce(F.lag("upto").over(within), F.lit(0.0))
    rated = rated.join(blocks, ["place", "block"]).withColumn("before", before)
    rated = cut(rated.select("place", "size", "n", "rate", "before", F.col("target").alias("goal"), F.col("words").alias("total")))

    # the starting point that brings each source nearest to its target
    tried = rated.select("*", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("k"))
    start = (F.col("k") + 0.5) / OFFSETS
    steps = F.floor(F.col("before") + F.col("rate") * F.col("n") + start) - F.floor(F.col("before") + start)
    got = tried.groupBy("place", "k").agg(F.sum(steps * F.col("size")).alias("got"), F.first("goal").alias("goal"))
    best = got.groupBy("place").agg(F.min(F.struct(F.abs(F.col("got") - F.col("goal")).alias("miss"), "k")).alias("best"))
    plan = rated.join(best.select("place", ((F.col("best.k") + 0.5) / OFFSETS).alias("start")), "place")

    # documents of a source and size are ranked in buckets, so that no task ranks a large group of them
    buckets = 1 << max(0, math.ceil(math.log2(max(1, facts["largest"] / RANKED))))
    (name,) = fresh(sized, "named")
    known = sized.join(small(places.select(F.col("named").alias(name), F.col("place").alias(place))), F.col(source).eqNullSafe(F.col(name))).drop(name)
    known = known.withColumn(key, F.xxhash64(F.col(doc_id).cast("string"), F.col(text)))
    known = known.withColumn(bucket, F.shiftrightunsigned(F.col(key), 40).cast("int") % buckets)
    if buckets == 1:
        plan = plan.withColumn("bucket", F.lit(0)).withColumn("first", F.lit(0))
    else:
        filled = known.groupBy(F.col(place).alias("place"), F.col(size).alias("size"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("filled"))
        earlier = Window.partitionBy("place", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        plan = plan.join(filled.withColumn("first", F.coalesce(F.sum("filled").over(earlier), F.lit(0))), ["place", "size"])
    fields = ("place", "size", "bucket", "rate", "before", "first", "start", "goal", "total")
    as_ = dict(zip(fields, fresh(known, *(f"plan_{c}" for c in fields))))
    plan = plan.select(*(F.col(c).alias(n) for c, n in as_.items()))
    ranked = known.withColumn(at, F.row_number().over(Window.partitionBy(place, size, bucket).orderBy(key, doc_id)) - 1)
    joined = ranked.join(plan, (F.col(place) == F.col(as_["place"])) & (F.col(size) == F.col(as_["size"])) & (F.col(bucket) == F.col(as_["bucket"])))
    step = lambda i: F.floor(F.col(as_["before"]) + F.col(as_["rate"]) * (F.col(as_["first"]) + F.col(at) + i) + F.col(as_["start"]))
    out = joined.withColumns({
        copies: F.greatest(F.lit(0), F.least(F.lit(int(most)), step(1) - step(0))).cast("int"),
        target: F.col(as_["goal"]),
        source_size: F.col(as_["total"]),
    })
    return Mix(out.select(*docs.columns, size, source_size, target, copies), tuple(docs.columns), size, source_size, target, copies)


def take(mixed: Mix) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    repeated = mixed.docs.where(F.col(mixed.copies) > 0).withColumn(mixed.copies, F.explode(F.array_repeat(F.lit(0), F.col(mixed.copies))))
    return repeated.select(*mixed.own)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, odd rows as in :func:`mix`."""
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    size = F.col(mixed.size)
    return mixed.docs.select("doc_id", size.alias("size"), F.col(mixed.source_size).alias("source_size"), F.col(mixed.target).alias("target"), (size * F.col(mixed.copies)).alias("taken"))
