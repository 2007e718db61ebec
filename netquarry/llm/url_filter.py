"""URL filtering by rules and by a path-template tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule is a host, then the start of a path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_verdict, own in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = own.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(own)).otherwise(rule), F.when(fits, F.lit(own_verdict)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """The path's segments, each run of digits, and each hexadecimal run of 8 or more with a digit, as a wildcard."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.transform(
        segments, lambda s: F.regexp_replace(F.regexp_replace(s, "(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{x}"), "[0-9]+", "{n}")
    )


def _groups(classes: Column, z: float) -> Column:
    """The number of the merged group of each class (share, labelled, rejected, ...) of a node, in their order by share.

    Each is held against the whole group so far: it begins another one if the
    shares are ``z`` standard errors apart, or on different sides of a half.
    """
    share = lambda rejected, labelled: (rejected + 0.5) / (labelled + 1.0)
    error = lambda s, labelled: s * (1 - s) / (labelled + 1.0)
    zero = F.struct(F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("rejected"), F.array().cast("array<int>").alias("group"))

    def step(a: Column, x: Column) -> Column:
        all_share, own_share = share(a["rejected"], a["labelled"]), share(x["rejected"], x["labelled"])
        apart = F.abs(all_share - own_share) > F.lit(z) * F.sqrt(error(all_share, a["labelled"]) + error(own_share, x["labelled"]))
        other_side = (2 * a["rejected"] >= a["labelled"]) != (2 * x["rejected"] >= x["labelled"])
        fresh = (a["labelled"] > 0) & (apart | other_side)
        number = F.when(F.size(a["group"]) == 0, 0).otherwise(F.element_at(a["group"], F.greatest(F.size(a["group"]), F.lit(1))) + fresh.cast("int"))
        kept = F.when(fresh, 0).otherwise(1).cast("long")
        return F.struct(
            (kept * a["labelled"] + x["segments"] * x["labelled"]).alias("labelled"),
            (kept * a["rejected"] + x["segments"] * x["rejected"]).alias("rejected"),
            F.array_append(a["group"], number.cast("int")).alias("group"),
        )

    return F.aggregate(classes, zero, step, lambda a: a["group"])


def template_tree(leaves: DataFrame, spelled: int = 4, least_pages: int = 5, z: float = 1.96) -> DataFrame:
    """Templates of (host, shape) leaves with counts of pages, labelled and rejected: host, shape, counts, template.

    Level by level, the branches of a node, one for each segment, are merged.
    Those without a labelled page are one branch, ``*`` if they are several.
    Those with labels are merged in the order of their rejected share as long as
    they are like the group merged so far (see ``_groups``); a group is named by
    its least segment and how many there are. Segments with equal counts are one
    row of this test, however many a node has. A node is split further while it
    has ``least_pages`` pages or more and its labels tell something: some pages
    have one and some don't, or some are rejected and some not. Others are only
    spelled out, up to the level ``spelled``; what is below becomes ``**``.
    """
    at, counts = ["host", "template"], ["pages", "labelled", "rejected"]
    total = lambda: [F.sum(c).alias(c) for c in counts]
    open_at = leaves.select("host", "shape", *counts, F.lit("").alias("template"), F.lit(True).alias("open"))
    level = 0
    while True:
        deeper = F.col("open") & (F.size("shape") > level)
        if level >= spelled:
            nodes = open_at.where(deeper).groupBy(*at).agg(*total())
            told = (F.col("labelled").between(1, F.col("pages") - 1)) | F.col("rejected").between(1, F.col("labelled") - 1)
            mixed = nodes.where((F.col("pages") >= least_pages) & told).select(*at, F.lit(True).alias("mixed"))
            on = deeper & F.coalesce("mixed", F.lit(False))
            rest = F.when(deeper & ~on, F.lit("/**")).otherwise("")
            joined = open_at.join(mixed, at, "left")
            open_at = staged(joined.select("host", "shape", *counts, F.concat("template", rest).alias("template"), on.alias("open")), f"open-{level}")
            if open_at.where("open").isEmpty():
                return open_at.select("host", "shape", *counts, "template")
        own = F.get(F.col("shape"), F.lit(level))
        branches = open_at.where(deeper).groupBy(*at, own.alias("segment")).agg(*total())
        alike = branches.groupBy(*at, "labelled", "rejected").agg(F.count(F.lit(1)).alias("segments"), F.min("segment").alias("least"))
        share = (F.col("rejected") + 0.5) / (F.col("labelled") + 1)
        classes = F.array_sort(F.collect_list(F.struct(share.alias("share"), "labelled", "rejected", "segments", "least")))
        nodes = alike.where("labelled > 0").groupBy(*at).agg(classes.alias("classes")).withColumn("group", _groups(F.col("classes"), z))
        labelled = nodes.select(*at, F.explode(F.arrays_zip("classes", "group")).alias("x")).select(*at, "x.classes.*", "x.group")
        bare = alike.where("labelled = 0").select(*at, F.lit(None).cast("double").alias("share"), "labelled", "rejected", "segments", "least", F.lit(-1).alias("group"))
        same = W.partitionBy(*at, "group")
        size = F.sum("segments").over(same)
        several = F.when(F.col("group") < 0, "*").otherwise(F.concat(F.lit("{"), F.min("least").over(same), F.lit("|"), size.cast("string"), F.lit("}")))
        names = labelled.unionByName(bare).select(*at, "labelled", "rejected", F.when(size == 1, F.col("least")).otherwise(several).alias("name"))
        names = branches.join(names, [*at, "labelled", "rejected"]).select(*at, "segment", "name")
        joined = open_at.withColumn("segment", F.when(deeper, own)).join(names, [*at, "segment"], "left")
        step = F.when(deeper, F.concat(F.lit("/"), F.col("name"))).otherwise("")
        open_at = staged(joined.select("host", "shape", *counts, F.concat("template", step).alias("template"), "open"), f"level-{level}")
        level += 1


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], reject_at: float = 0.5, prior: float = 1.0, spelled: int = 4, least_pages: int = 5, learn: Column | None = None
) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides. Pages with a rule are also the labels of
    the tree (all of them, or those where ``learn`` holds): each host's paths
    become templates (see ``template_tree``), and a template's purity is its
    share of labelled pages that are blocked, smoothed by ``prior`` pages of the
    host's own share, itself smoothed so by that of all hosts. All three count
    labelled pages alone. Pages without a rule are blocked where the purity
    reaches ``reject_at``; a template without a labelled page has none (null) and
    is allowed. Paths are counted by shape before anything is shuffled, so a
    host of many pages is a few rows; shapes of very many pages meet their
    verdict by broadcast.

    Null urls, and those without ``://``, have an empty host and path, which form
    a template of their own. Repeated rows are judged one by one and count as
    often; other columns are ignored.
    """
    rules = list(rules)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(True) if learn is None else learn).alias("learnt"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shapes(F.col("path")).alias("shape"))
    label = F.when(F.col("learnt"), F.col("ruled"))
    leaves = staged(
        rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count(label).alias("labelled"), F.count(F.when(label == "block", 1)).alias("rejected")),
        "leaves",
    )
    tree = template_tree(leaves, spelled, least_pages)
    smoothed = lambda share: (F.sum("rejected") + F.lit(prior) * share) / (F.sum("labelled") + F.lit(prior))
    sums = leaves.agg(F.sum("rejected").alias("rejected"), F.sum("labelled").alias("labelled"), F.sum("pages").alias("pages")).first()
    overall = ((sums["rejected"] or 0) + 0.5) / ((sums["labelled"] or 0) + 1)
    hosts = tree.groupBy("host").agg(smoothed(F.lit(overall)).alias("host_share"))
    templates = tree.join(hosts, "host").groupBy("host", "template").agg(F.when(F.sum("labelled") > 0, smoothed(F.first("host_share"))).alias("purity"))
    judged = staged(tree.select("host", "shape", "template", "pages").join(templates, ["host", "template"]), "judged")
    by_tree = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return join_groups(rows, judged, ["host", "shape"], sums["pages"] or 0, "pages").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_tree).alias("verdict"), "template", "purity"
    )
