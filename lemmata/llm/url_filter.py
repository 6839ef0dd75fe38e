"""URL filters with a path-template tree.

Base rules (host and path prefix, the longest that fits wins) decide where one fits. Their verdicts are also the labels
of a tree of path templates per host: segments that are numbers, long hexadecimal strings, dates or mixed words become
wildcards by their form, and all beyond the first ``depth`` are one wildcard. The tree is then merged from its root
down, level by level: labelled siblings whose share of bad pages doesn't differ from that of all of them by more than
``z`` standard errors become one branch, and what was below them is pooled before the next level is looked at. A branch
without labels shows no likeness: it stays by itself, or in the wildcard of all such where a parent has more than ``fan``
different ones, so the width of a parent gives no page the labels of others. A path is blocked when its template's
smoothed purity, in which pages without labels count as its prior says,

    (bad + (unlabelled + strength) * pooled) / (labelled + unlabelled + strength)

is over ``purity``. The prior of a path comes from the other hosts, from its first segment to its whole form: of the
hosts with labels below a prefix, ``against`` of ``votes`` have mostly bad ones (one vote each, so no host decides by its
size), and

    pooled(prefix) = (against + strength * pooled(prefix without its last segment)) / (votes + strength)

with ``prior`` for the empty path, so pages that no rule reaches are judged by what the rules say of such paths
elsewhere: of that very form, or where it is new, of the section that it lies in.

DataFrame functions only. Counts are partial aggregates by (host, form), so a host of a third of all pages is a few rows;
each level of the tree is two groups and a join of such rows. The join of pages and templates may be split by Spark
where a template is hot.

Nulls: a null url, or one without ``://``, has the empty host and path, fits no rule and is in the template of all such.
Labels are bad (1), good (0) or null. Repeated rows count each. ``judged`` carries other columns whatever their names,
but for those of its own (_host, _path, _rule, _template, _purity, _verdict), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, enclosed, lower_ascii, table

#: (verdict, rule): the host and all of its subdomains, for paths that start as the rule's does.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Forms that are variable, in order: the pattern of a whole segment and its wildcard.
FORMS = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+(\.[A-Za-z0-9]{1,5})$", "{n}$1"), (r"^[0-9a-fA-F-]{16,}$", "{h}"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{d}"), (r"^(?=.*[0-9])(?=.*[A-Za-z]).{8,}$", "{m}"))
FAN, Z, STRENGTH, PRIOR, PURITY, DEPTH = 20, 2.0, 4.0, 0.1, 0.5, 12
#: All segments beyond the depth.
DEEP = "{...}"
#: Templates up to this number (some 50 MB) are broadcast to the pages; more are joined by a shuffle.
BROADCAST_TEMPLATES = 200_000


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decides).otherwise(verdict)
    return rule, verdict


def formed(segment: Column) -> Column:
    """A segment with its wildcard, if its form is variable."""
    out = segment
    for pattern, wildcard in FORMS:
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, wildcard)).otherwise(out)
    return out


def form_of(path: Column, depth: int = DEPTH) -> Column:
    """The formed segments of a path, as an array; the first is what stands before the first slash."""
    parts = F.split(path, "/", depth + 2)
    # The last of so many holds all the rest.
    known = F.transform(F.slice(parts, 1, depth + 1), formed)
    return F.when(F.size(parts) > depth + 1, F.concat(known, F.array(F.lit(DEEP)))).otherwise(known)


def joined(segments: Column) -> Column:
    return F.array_join(segments, "/")


def priors(leaves: DataFrame, strength: float = STRENGTH, prior: float = PRIOR) -> DataFrame:
    """(host, form, pooled): what the other hosts say of each host's forms, from the first segment to the whole."""
    prefixes = F.transform(F.sequence(F.lit(2), F.size("segments")), lambda d: F.struct(d.alias("depth"), joined(F.slice("segments", F.lit(1), d)).alias("prefix")))
    none = F.array().cast("array<struct<depth: int, prefix: string>>")
    rows = leaves.select("host", "form", "labelled", "bad", F.explode_outer(F.when(F.size("segments") > 1, prefixes).otherwise(none)).alias("x")).select("host", "form", "labelled", "bad", "x.*")
    own = rows.groupBy("host", "prefix").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    vote, against = (F.col("labelled") > 0).cast("long"), (2 * F.col("bad") > F.col("labelled")).cast("long")
    own = own.select("host", "prefix", vote.alias("own"), against.alias("own_against"))
    every = own.groupBy("prefix").agg(F.sum("own").alias("votes"), F.sum("own_against").alias("against"))
    told = rows.select("host", "form", "depth", "prefix").join(own, ["host", "prefix"], "left").join(every, "prefix", "left")
    # A host's own vote doesn't count in its prior.
    others = lambda c, mine: F.coalesce(F.col(c) - F.col(mine), F.lit(0))
    steps = F.array_sort(F.collect_list(F.struct("depth", others("votes", "own").alias("votes"), others("against", "own_against").alias("against"))))
    step = lambda p, x: (x["against"] + strength * p) / (x["votes"] + strength)
    return told.groupBy("host", "form").agg(F.aggregate(F.filter(steps, lambda x: x["depth"].isNotNull()), F.lit(prior), step).alias("pooled"))


def merged(leaves: DataFrame, fan: int = FAN, z: float = Z) -> DataFrame:
    """(host, form, template, n, labelled, bad): the tree of each host, merged level by level."""
    state = leaves.withColumn("template", F.col("segments")[0])
    levels = leaves.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, levels):
        state = state.withColumn("segment", F.get("segments", F.lit(level)))
        children = state.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"))
        some = F.col("c_labelled") > 0
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("k"), F.count_if(some).alias("k_labelled"), F.sum("c_labelled").alias("all_labelled"), F.sum("c_bad").alias("all_bad"))
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1.0)
        error = F.sqrt(share * (1 - share) / F.greatest(F.col("c_labelled"), F.lit(1)))
        alike = F.abs(F.col("c_bad") / F.greatest(F.col("c_labelled"), F.lit(1)) - share) <= z * error
        kept = F.when(some & (F.col("k_labelled") > 1) & alike, "*").when(~some & (F.col("k") > fan), "{u}").otherwise(F.col("segment"))
        named = children.join(nodes, ["host", "template"]).select("host", "template", "segment", kept.alias("kept"))
        state = state.join(named, ["host", "template", "segment"], "left")
        state = checkpoint(state.withColumn("template", F.concat_ws("/", "template", "kept")).drop("segment", "kept"))
    return state.drop("segments")


def templates(pages: DataFrame, fan: int = FAN, z: float = Z, strength: float = STRENGTH, prior: float = PRIOR, purity: float = PURITY, depth: int = DEPTH) -> DataFrame:
    """(host, form, template, labelled, bad, purity, reject) from (host, path, label); ``form`` is a path by segment forms."""
    leaves = pages.groupBy("host", form_of(F.col("path"), depth).alias("segments"))
    leaves = leaves.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    leaves = checkpoint(leaves.withColumn("form", joined(F.col("segments"))))
    named = merged(leaves, fan, z)
    sums = named.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    out = named.select("host", "form", "template").join(sums, ["host", "template"]).join(priors(leaves, strength, prior), ["host", "form"], "left")
    out = out.withColumn("purity", (F.col("bad") + (F.col("n") - F.col("labelled") + strength) * F.coalesce("pooled", F.lit(prior))) / (F.col("n") + strength))
    return out.select("host", "form", "template", "labelled", "bad", "purity", (F.col("purity") > purity).alias("reject"))


OWN = ("_host", "_path", "_rule", "_template", "_purity", "_verdict")


def judged(pages: DataFrame, rules=RULES, depth: int = DEPTH, **parameters) -> DataFrame:
    """``pages`` (with url) and _host, _path, _rule, _template, _purity and _verdict."""
    p = enclosed(pages, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("decides", verdict)
    label = F.when(F.col("decides") == "block", 1).when(F.col("decides") == "allow", 0)
    t = checkpoint(templates(p.select("host", "path", label.alias("label")), depth=depth, **parameters)).drop("labelled", "bad")
    if t.count() <= BROADCAST_TEMPLATES:
        t = F.broadcast(t)
    p = p.withColumn("form", joined(form_of(F.col("path"), depth))).join(t, ["host", "form"], "left")
    own = F.when(F.coalesce("reject", F.lit(False)), "block").otherwise("allow")
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in OWN]
    found = ("host", "path", "rule", "template", "purity")
    return p.select(*kept, *(F.col(c).alias(f"_{c}") for c in found), F.coalesce("decides", own).alias("_verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the base rules, and by the tree of templates where none fits."""
    p = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return p.select("page_id", *(F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "template", "purity")))
