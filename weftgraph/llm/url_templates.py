"""URL filters: rules, and a path-template tree per host.

A rule decides the urls it fits. For the others each host's paths make a tree of templates. Segments that are numbers,
hexadecimal or otherwise made up become wildcards by their form. The words that are left are merged level by level:
under a node with many the rare ones become one wildcard; the branches whose continuations and labels do not differ
from the node's own by more than chance become another; and of the others those of one rounded shape a third kind.

Labels are the rules' verdicts, or a column's. The purity of a node is the share of labelled urls that are blocked,
smoothed towards its parent's purity, the root's towards its host's, and the host's towards the corpus's. A template is
rejected if it, or a node above it, is labelled often enough and purely blocked; so labels reach urls that have none.

All counts are sums over all urls. The tree is grown on the distinct forms of paths, not on the urls.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import cut, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a tree. The rest of a deeper path, segment by segment in its forms, is one more segment.
DEPTH = 8
#: Different words under a node beyond which those with less than a share of 1 / MANY are taken together.
MANY = 20
#: Branches are alike if their continuations are no farther apart than this, as half of the sum of differences,
ALIKE = 0.1
#: or by no more than this many standard deviations beyond what is expected by chance; their labels, too.
CHANCE = 3.0
#: Forms of segments, by the first expression that fits.
FORMS = [
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+(\.[a-z]{2,5})$", "{n}$1"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-f]{8,}$", "{hex}"),
    (r"^(?=.*[0-9])(?=.*[a-zA-Z])[0-9a-zA-Z_-]{12,}$", "{id}"),
    (r"^[^/]{48,}$", "{long}"),
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the path, query or fragment, with A to Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, null if none does. ``rules`` is a short list."""
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        found = F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def form_of(segment: Column) -> Column:
    """A segment, or the wildcard of its form. A literal brace is doubled, so that no word looks like a wildcard."""
    plain = F.regexp_replace(segment, r"([{}*])", r"$1$1")
    return reduce(lambda rest, f: F.when(segment.rlike(f[0]), F.regexp_replace(segment, f[0], f[1])).otherwise(rest), reversed(FORMS), plain)


def segments_of(path: Column) -> Column:
    """The forms of a path's segments; empty ones do not count. Those beyond DEPTH are joined to one."""
    forms = F.transform(F.array_remove(F.split(path, "/"), ""), form_of)
    rest = F.array(F.array_join(F.slice(forms, DEPTH + 1, F.greatest(F.lit(1), F.size(forms) - DEPTH)), "/"))
    return F.when(F.size(forms) > DEPTH, F.concat(F.slice(forms, 1, DEPTH), rest)).otherwise(forms)


def _is_word(segment: Column) -> Column:
    return ~segment.rlike(r"^\{[a-z]+\}")


_COUNTS = ("n", "labelled", "blocked")
_NODE = ("host", "template")


def _steps(state: DataFrame) -> DataFrame:
    """``host, template, here, step``: what each branch ``here`` of a node is called in the templates."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    follows = F.when(_is_word(F.col("next")) & (F.col("next") != ""), F.lit("{word}")).otherwise(F.col("next"))
    shapes = state.groupBy(*_NODE, "here", follows.alias("follows")).agg(*sums)
    branch = shapes.groupBy(*_NODE, "here").agg(*sums)
    node = branch.groupBy(*_NODE).agg(F.sum("n").alias("all"), F.count_if(_is_word(F.col("here"))).alias("words"))
    rare = (F.col("words") > MANY) & (F.col("n") * MANY < F.col("all"))
    kind = F.when(~_is_word(F.col("here")), F.lit("form")).when(rare, F.lit("rare")).otherwise(F.lit("word"))
    branch = branch.join(node, [*_NODE]).select(*_NODE, "here", *_COUNTS, kind.alias("kind"))

    # what all words of a node are like that are not rare, and how far each is from that
    words = branch.where("kind = 'word'").select(*_NODE, "here", F.col("n").alias("branch_n"))
    own = shapes.join(words, [*_NODE, "here"])
    pool = own.groupBy(*_NODE, "follows").agg(F.sum("n").alias("pool_k"))
    of_node = branch.where("kind = 'word'").groupBy(*_NODE).agg(F.sum("n").alias("pool_n"), F.sum("labelled").alias("pool_labelled"), F.sum("blocked").alias("pool_blocked"))
    # kinds of continuation that a branch does not have are told from the shares of those that it has
    p, q = F.col("n") / F.col("branch_n"), F.col("pool_k") / F.col("pool_n")
    seen = own.join(pool, [*_NODE, "follows"]).join(of_node, [*_NODE])
    told = seen.groupBy(*_NODE, "here").agg(
        F.sum(F.abs(p - q)).alias("gaps"), F.sum(q).alias("q_seen"), F.sum((p - q) * (p - q) / q).alias("chi"), F.sort_array(F.collect_list(F.struct("follows", F.round(4 * p).cast("int").alias("quarters")))).alias("shape")
    )
    kinds = pool.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("kinds"))
    words = branch.where("kind = 'word'").join(told, [*_NODE, "here"]).join(of_node, [*_NODE]).join(kinds, [*_NODE])
    unseen = F.greatest(F.lit(0.0), 1 - F.col("q_seen"))
    apart = (F.col("gaps") + unseen) / 2
    chi = F.col("n") * (F.col("chi") + unseen)
    same_shape = (apart <= ALIKE) | (chi <= (F.col("kinds") - 1) + CHANCE * F.sqrt(2.0 * (F.col("kinds") - 1)))
    rate, own_rate = F.try_divide("pool_blocked", "pool_labelled"), F.try_divide("blocked", "labelled")
    same_labels = (F.col("labelled") == 0) | (F.abs(own_rate - rate) <= CHANCE * F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled"))))
    shape = F.to_json(F.filter("shape", lambda s: s["quarters"] > 0))
    labels = F.when(F.col("labelled") > 0, F.round(4 * own_rate).cast("int").cast("string")).otherwise(F.lit("-"))
    alike = F.when(same_shape & same_labels, F.lit("{like}")).otherwise(F.concat(F.lit("{like:"), F.sha2(F.concat(shape, labels), 256), F.lit("}")))
    named = words.select(*_NODE, "here", alike.alias("step"))
    # a likeness of one is no likeness
    several = named.groupBy(*_NODE, "step").agg(F.count(F.lit(1)).alias("branches"))
    named = named.join(several, [*_NODE, "step"]).select(*_NODE, "here", F.when(F.col("branches") > 1, F.col("step")).otherwise(F.col("here")).alias("step"))
    others = branch.where("kind <> 'word'").select(*_NODE, "here", F.when(F.col("kind") == "rare", F.lit("{other}")).otherwise(F.col("here")).alias("step"))
    return named.unionByName(others)


def grow(paths: DataFrame) -> DataFrame:
    """``host, segments, template``: the template of each form of path, as an array.

    ``paths`` has a row per host and ``segments`` with its counts ``n, labelled, blocked``.
    """
    state = paths.withColumn("template", F.array().cast("array<string>"))
    depth = paths.agg(F.max(F.size("segments"))).first()[0] or 0  # DEPTH + 1 at most
    for d in range(depth):
        state = state.withColumns({"here": F.get("segments", F.lit(d)), "next": F.coalesce(F.get("segments", F.lit(d + 1)), F.lit(""))})
        steps = cut(_steps(state.where(F.col("here").isNotNull())))
        moved = state.join(steps, [*_NODE, "here"], "left")
        state = cut(moved.withColumn("template", F.when(F.col("step").isNotNull(), F.concat("template", F.array("step"))).otherwise(F.col("template"))).drop("here", "next", "step"))
    return state.select("host", "segments", "template")


def judge(counted: DataFrame, purity: float, least: int, smoothing: float) -> DataFrame:
    """``host, template, rejected, purity`` of the templates ``counted`` (``host, template, n, labelled, blocked``): the purity is
    that of the node, of the template and those above it, that is purest."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    upper = F.transform(F.sequence(F.lit(1), F.size("template")), lambda k: F.slice("template", 1, k))
    tree = counted.where(F.size("template") > 0).select("host", "template", *_COUNTS, F.explode(upper).alias("node"))
    nodes = tree.groupBy("host", "node").agg(*sums)
    chain = tree.select("host", "template", "node").join(nodes, ["host", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct(F.size("node").alias("level"), "labelled", "blocked"))).alias("chain"))
    of_host = counted.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    of_all = counted.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("all_labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("all_blocked"))
    known = chain.join(of_host, "host").join(F.broadcast(of_all))  # one row
    towards = lambda blocked, labelled, prior: (blocked + smoothing * prior) / (labelled + smoothing)
    corpus = F.col("all_blocked") / F.greatest(F.lit(1), F.col("all_labelled"))
    first = F.struct(towards(F.col("host_blocked"), F.col("host_labelled"), corpus).alias("at"), F.lit(0.0).alias("most"), F.lit(False).alias("rejected"))

    def step(acc: Column, node: Column) -> Column:
        at = towards(node["blocked"], node["labelled"], acc["at"])
        return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"), (acc["rejected"] | ((at >= purity) & (node["labelled"] >= least))).alias("rejected"))

    return known.select("host", "template", F.aggregate("chain", first, step).alias("j")).select("host", "template", "j.rejected", F.col("j.most").alias("purity"))


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, page_id: str = "page_id", url: str = "url", label: str | None = None, purity: float = 0.8, least: int = 3, smoothing: float = 2.0
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, purity``.

    :param label: a column of 'block' or 'allow' to learn from, null where unknown; without it the rules' verdicts
    :param purity: the smoothed purity from which a node is rejected, if ``least`` of its urls are labelled
    :param smoothing: labelled urls that a node's parent counts as

    Urls that are null, empty or without :// have empty hosts and paths, no rule and no template, and are allowed. A url
    without a segment has the template / and no purity, and is allowed. Equal urls and ids are rows of their own, ties are
    decided by names. A very long or deep url is one of DEPTH + 1 segments at most, none of them left out. An empty table
    gives no rows. Other columns are neither read nor returned.
    """
    known = F.col(label) if label else F.lit(None).cast("string")
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), known.alias("label"))
    urls = urls.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", segments_of(F.col("path")))
    if not label:
        urls = urls.withColumn("label", F.col("ruled.verdict"))
    labelled, blocked = F.count("label"), F.count_if(F.col("label") == "block")
    paths = cut(urls.where(F.col("host") != "").groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), labelled.alias("labelled"), blocked.alias("blocked")))
    templates = cut(grow(paths))

    sums = [F.sum(c).alias(c) for c in _COUNTS]
    counted = cut(paths.join(templates, ["host", "segments"]).groupBy("host", "template").agg(*sums))
    judged = judge(counted, purity, least, smoothing)
    verdicts = templates.join(judged, ["host", "template"], "left").select("host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "rejected", "purity")

    out = urls.join(verdicts, ["host", "segments"], "left")
    verdict = F.coalesce("ruled.verdict", F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by RULES or by the templates that their verdicts label; odd rows as in :func:`filter_urls`."""
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
