"""Section trees, tree-quality counts, candidates, chunks, reviews and input routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .messages import at_least

HEADER = r"(?s)\\(section|subsection|subsubsection)(?:\*?)?\{(.*?)\}(?:\s*\\label\{(.*?)\})?"


def body_of(tex: Column) -> Column:
    """EXT-9: text between the document's begin and end; empty where there is none."""
    return F.regexp_extract(tex, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)


def document_body(papers: DataFrame) -> DataFrame:
    """EXT-9: (paper_id, body, whole): the body, or the whole text where there is no document environment."""
    found = F.col("tex").rlike(r"(?s)\\begin\{document\}.*?\\end\{document\}")
    return papers.select("paper_id", F.when(found, body_of(F.col("tex"))).otherwise(F.col("tex")).alias("body"), (~found).alias("whole"))


def preambles(papers: DataFrame) -> DataFrame:
    """EXT-6: (paper_id, preamble): what stands before the document; empty where there is none."""
    return papers.select("paper_id", F.regexp_extract("tex", r"(?s)^(.*?)\\begin\{document\}", 1).alias("preamble"))


def body_metadata(papers: DataFrame) -> DataFrame:
    """EXT-10: (paper_id, title, authors, abstract) of the body, cleaned of comments and white space only."""
    return papers.select("paper_id", *(c.alias(n) for n, c in metadata_of(F.col("tex")).items()))


def metadata_of(tex: Column) -> dict[str, Column]:
    body = body_of(tex)
    first = lambda p: T.clean_light(F.regexp_extract(body, p, 1))
    authors = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)\\author\{(.*?)\}"), F.lit(1)), T.clean_light)
    return {"title": first(r"(?s)\\title\{(.*?)\}"), "authors": authors, "abstract": first(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}")}


def packages_of(tex: Column) -> Column:
    """Packages of a preamble, as an array of (name, options)."""
    p = r"\\usepackage(?:\[(.*?)\])?\{(.*?)\}"
    preamble = F.regexp_extract(tex, r"(?s)^(.*?)\\begin\{document\}", 1)
    return F.transform(F.regexp_extract_all(preamble, F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, 2).alias("name"), F.regexp_extract(m, p, 1).alias("options")))


def packages(papers: DataFrame) -> DataFrame:
    """EXT-7: packages and options of the preamble, in order."""
    return papers.select("paper_id", F.posexplode(packages_of(F.col("tex"))).alias("pos", "x")).select("paper_id", "pos", "x.name", "x.options")


def section_tree(papers: DataFrame) -> DataFrame:
    """EXT-11, EXT-12: (paper_id, section_id, parent_id, level, type, title, label, raw_content).

    The body is split at its headers; piece k belongs to header k. A section's own content is its piece, and for a
    section those of the headers two levels down that come before any other header. One window over the headers of a
    paper finds parents and owners, and one group by owner puts the pieces together, all in the papers' partitions.
    """
    body = body_of(F.col("tex"))
    found = F.regexp_extract_all(body, F.lit(HEADER), F.lit(0))
    pieces = F.slice(F.split(body, HEADER), F.lit(2), F.size(found))
    rows = papers.select("paper_id", F.posexplode(F.arrays_zip(found.alias("h"), pieces.alias("p"))).alias("section_id", "x")).select("paper_id", "section_id", F.col("x.h").alias("h"), F.col("x.p").alias("p"))
    rows = rows.withColumn("type", F.regexp_extract("h", HEADER, 1))
    rows = rows.withColumn("level", F.when(F.col("type") == "section", 1).when(F.col("type") == "subsection", 2).otherwise(3))
    before = Window.partitionBy("paper_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("section_id"))).over(before) for k in (1, 2)}
    rows = rows.withColumns({f"last{k}": c for k, c in last.items()})
    parent = F.when(F.col("level") == 2, F.col("last1")).when(F.col("level") == 3, F.greatest("last1", "last2"))
    rows = rows.withColumn("parent_id", parent)
    shared = (F.col("level") == 3) & (F.col("last1") > F.coalesce("last2", F.lit(-1)))
    own = F.struct(F.col("section_id").alias("owner"), F.struct("parent_id", "level", "type", "h").alias("own"), F.col("p").alias("t"))
    more = F.struct(F.col("last1").alias("owner"), F.lit(None).cast("struct<parent_id: int, level: int, type: string, h: string>").alias("own"), F.concat("h", "p").alias("t"))
    parts = rows.select("paper_id", "section_id", F.inline(F.when(shared, F.array(own, more)).otherwise(F.array(own))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "t"))), lambda x: x["t"]), "")
    whole = parts.groupBy("paper_id", "owner").agg(F.max("own").alias("own"), text.alias("raw_content"))
    title, label = T.clean_light(F.regexp_extract("own.h", HEADER, 2)), F.regexp_extract("own.h", HEADER, 3)
    return whole.select("paper_id", F.col("owner").alias("section_id"), "own.parent_id", "own.level", "own.type", title.alias("title"), label.alias("label"), "raw_content")


def paragraphs(sections: DataFrame) -> DataFrame:
    """EXT-14: paragraphs outside environments that don't begin with a command."""
    plain = F.regexp_replace("raw_content", r"(?s)\\begin\{.*?\}.*?\\end\{.*?\}", "")
    parts = F.transform(F.split(plain, "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(parts, lambda x: (x != "") & ~x.startswith("\\"))
    return sections.select("paper_id", "section_id", F.posexplode(kept).alias("pos", "text"))


def original_counts(papers: DataFrame, **more: Column) -> DataFrame:
    """EXT-23: what a regex count of the source finds, and ``more`` columns of the same scan."""
    count = lambda p: F.regexp_count("tex", F.lit(p)).cast("long")
    env = lambda e: count(rf"\\begin\{{{e}\}}")
    kinds = {"definitions": env("definition"), "lemmas": env("lemma"), "propositions": env("proposition"), "corollaries": env("corollary")}
    all_ = sum(kinds.values(), env("theorem")).cast("long")
    sums = {"sections": count(r"\\section\{"), "subsections": count(r"\\subsection\{"), "theorems": all_, **kinds, "equations": env("equation"), "citations": count(r"\\cite\{")}
    return papers.select("paper_id", *(c.alias(n) for n, c in (sums | more).items()))


def label_resolution(papers: DataFrame) -> DataFrame:
    """EXT-24, REL-6, AGG-8: distinct references, how many have a label, and the share."""
    refs = F.array_distinct(F.regexp_extract_all("tex", F.lit(r"\\(?:ref|eqref)\{([^}]+)\}"), F.lit(1)))
    labels = F.array_distinct(F.regexp_extract_all("tex", F.lit(r"\\label\{([^}]+)\}"), F.lit(1)))
    p = papers.select("paper_id", refs.alias("r"), labels.alias("l"))
    total, resolved = F.size("r").cast("long"), F.size(F.array_intersect("r", "l")).cast("long")
    return p.select("paper_id", total.alias("total"), resolved.alias("resolved"), F.array_join(F.array_sort(F.array_except("r", "l")), ",").alias("unresolved"), F.when(total > 0, resolved / total).otherwise(0.0).alias("rate"))


def distinct_names(candidates: DataFrame) -> DataFrame:
    """REL-13: (paper_id, labels, refs): the different labels and references among candidates, sorted."""
    of = lambda b: F.array_join(F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("content")))), ",").alias(b)
    return candidates.groupBy("paper_id").agg(of("labels"), of("refs"))


def math_sets(papers: DataFrame) -> DataFrame:
    """EXT-25: number of distinct inline and displayed formulas."""
    display = F.regexp_extract_all("tex", F.lit(r"(?s)\\\[(.*?)\\\]"), F.lit(0))
    inline = F.regexp_extract_all("tex", F.lit(r"\$([^$\n]+)\$"), F.lit(0))
    return papers.select("paper_id", F.size(F.array_distinct(display)).cast("long").alias("display"), F.size(F.array_distinct(inline)).cast("long").alias("inline"), F.size(F.array_union(display, inline)).cast("long").alias("formulas"))


def complexity(content: Column) -> Column:
    """EXT-18: nested environments, graphics, over 2,000 characters, or unbalanced braces."""
    braces = F.length(F.replace(content, F.lit("{"), F.lit(""))) != F.length(F.replace(content, F.lit("}"), F.lit("")))
    return (F.regexp_count(content, F.lit(r"\\begin\{")) > 1) | content.contains("tikzpicture") | content.contains("circuit") | (F.length(content) > 2000) | braces


def regex_candidates(papers: DataFrame) -> DataFrame:
    """EXT-17: candidates of all buckets with their confidence, in one scan."""
    S = lambda bucket, kind, content, conf, verify=None: F.struct(F.lit(bucket).alias("bucket"), kind.alias("element_type"), content.alias("content"), conf.cast("double").alias("confidence"), (F.lit(False) if verify is None else verify).alias("needs_verification"))  # noqa: E731, N806
    every = lambda p: F.regexp_extract_all("tex", F.lit(p), F.lit(0))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    env = r"(?s)\\begin\{(theorem|lemma|proposition|corollary|definition)\}(?:\[([^\]]*)\])?(.*?)\\end\{\1\}"
    ref = r"\\(ref|eqref)\{([^}]+)\}"
    equation = lambda k: lambda m: S("equations", F.lit(k), strip(m), F.lit(0.8))
    hard = lambda m: complexity(F.regexp_extract(m, env, 3))
    found = F.concat(
        F.transform(every(P.SECTION), lambda m: S("sections", F.regexp_extract(m, P.SECTION, 1), F.regexp_extract(m, P.SECTION, 2), F.lit(0.9))),
        F.transform(every(env), lambda m: S("elements", F.regexp_extract(m, env, 1), strip(F.regexp_extract(m, env, 3)), F.when(hard(m), 0.4).otherwise(0.7), hard(m))),
        *(F.transform(F.regexp_extract_all("tex", F.lit(p), F.lit(1)), equation(k)) for k, p in (("equation", r"(?s)\\begin\{equation\}(.*?)\\end\{equation\}"), ("equation_star", r"(?s)\\begin\{equation\*\}(.*?)\\end\{equation\*\}"))),
        F.transform(F.regexp_extract_all("tex", F.lit(r"\\label\{([^}]+)\}"), F.lit(1)), lambda m: S("labels", F.lit("label"), m, F.lit(0.95))),
        F.transform(every(ref), lambda m: S("refs", F.regexp_extract(m, ref, 1), F.regexp_extract(m, ref, 2), F.lit(0.95))),
    )
    return papers.select("paper_id", F.inline(found))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """AGG-10: counts by bucket."""
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return candidates.groupBy("paper_id").agg(*map(count, ("sections", "elements", "equations", "labels", "refs")), F.count_if("needs_verification").alias("needs_verification"))


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """REL-9: overlapping or touching (paper_id, start, end) united: a running maximum and islands."""
    order = Window.partitionBy("paper_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    i = intervals.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    i = i.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("paper_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merged_chunk_results(results: DataFrame) -> DataFrame:
    """REL-10: of (paper_id, chunk_index, kind_ord, pos, label, payload), the first of each label; unlabelled rows all stay."""
    order = Window.partitionBy("paper_id", "label").orderBy("chunk_index", "kind_ord", "pos")
    labelled = F.coalesce(F.col("label") != "", F.lit(False))
    return results.withColumn("_n", F.row_number().over(order)).where(~labelled | (F.col("_n") == 1)).drop("_n")


#: Environments at whose edges an oversize chunk is cut, each spelled out (not every engine has back-references).
CUT_ENVIRONMENTS = "(?s)" + "|".join(rf"\\begin\{{{e}\}}.*?\\end\{{{e}\}}" for e in P.CANDIDATE_ENVIRONMENTS)


def _packed(pieces: Column, max_chars: int, least: int) -> Column:
    """Pieces joined greedily: a chunk ends where it has over ``least`` characters and the next piece would make it over
    ``max_chars``. The fold goes over lengths; texts are put together once."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        ends = (acc["chars"] + n > max_chars) & (acc["chars"] > least)
        starts = F.when(ends, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct(F.when(ends, n).otherwise(acc["chars"] + n).alias("chars"), (acc["at"] + 1).alias("at"), starts.alias("starts"))

    def cut(p: Column) -> Column:
        starts = F.aggregate(F.transform(p, F.length), start, step, lambda a: a["starts"])
        chunk = lambda s: lambda a, k: F.array_join(F.slice(p, a + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - a), "")
        return F.transform(F.array(starts), lambda s: F.filter(F.transform(s, chunk(s)), lambda c: c != ""))[0]

    return F.transform(F.array(pieces), cut)[0]


def document_chunks(papers: DataFrame, max_chars: int = 8000, least: int = 1000, least_split: int = 500) -> DataFrame:
    """EXT-21, EXT-22: (paper_id, chunk_index, chunk): sections packed greedily; chunks over ``max_chars`` are cut at the
    edges of environments and packed again. A chunk is over the limit only where it is at most ``least_split`` characters
    and one piece, or one piece alone."""
    sections = _packed(F.split("tex", r"(?=\\section\{[^}]+\})"), max_chars, least)

    def again(chunk: Column) -> Column:
        plain, envs = F.split(chunk, CUT_ENVIRONMENTS), F.regexp_extract_all(chunk, F.lit(CUT_ENVIRONMENTS), F.lit(0))
        both = F.flatten(F.transform(F.arrays_zip(plain.alias("a"), envs.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit("")))))
        return F.when(F.length(chunk) > max_chars, _packed(both, max_chars, least_split)).otherwise(F.array(chunk))

    return papers.select("paper_id", F.posexplode(F.flatten(F.transform(sections, again))).alias("chunk_index", "chunk"))


# Parts of a written review, by the headings between which they stand.
REVIEW_PARTS = {
    "overview": r"## 1[.\s]+Summary and Main Contributions(.*?)## 2",
    "methods": r"## 2[.\s]+Analysis of Main Proof Methods(.*?)## 3",
    "errors": r"## 3[.\s]+Specific Errors and Issues(.*?)## 4",
    "citations": r"## 4[.\s]+Citation and Bibliography Issues(.*?)## 5",
    "suggestions": r"## 5[.\s]+Suggestions for Improvement(.*?)\z",
}


def review_parts(reviews: DataFrame) -> DataFrame:
    """EXT-26: (review_id, part, text): the parts of a review that are there, trimmed."""
    row = lambda n, p: F.when(F.col("text").rlike("(?is)" + p), F.struct(F.lit(n).alias("part"), F.regexp_replace(F.regexp_extract("text", "(?is)" + p, 1), r"^\s+|\s+$", "").alias("text")))
    return reviews.select("review_id", F.inline(F.array_compact(F.array(*(row(n, p) for n, p in REVIEW_PARTS.items())))))


def _any(text: Column, alternatives: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in alternatives))


def review_features(reviews: DataFrame) -> DataFrame:
    """RQ-1..16: the boolean features of (review_id, text)."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    found = {name: _any(low if lower else text, alternatives) for name, lower, alternatives, _ in P.REVIEW}
    hits = lambda ps: sum((low.rlike(p).cast("int") for p in ps), F.lit(0))
    found |= {"constructive": _any(low, P.CONSTRUCTIVE) & ~_any(low, P.NEGATIVE), "objective": hits(P.OBJECTIVE) > hits(P.SUBJECTIVE), "avoids_generic": ~_any(low, P.GENERIC)}
    return reviews.select("review_id", *(c.alias(n) for n, c in found.items()))


def review_score(features: DataFrame, min_grade: str = "C") -> DataFrame:
    """RQ-17, FN-17: score, grade and acceptance (``min_grade`` or better)."""
    points = {name: p for name, _, _, p in P.REVIEW} | {"constructive": 5, "avoids_generic": 5}
    score = sum((F.col(n).cast("int") * p for n, p in points.items()), F.lit(0))
    f = features.select("review_id", score.alias("overall_score"))
    grade = F.when(F.col("overall_score") >= 85, "A").when(F.col("overall_score") >= 70, "B").when(F.col("overall_score") >= 55, "C").when(F.col("overall_score") >= 40, "D").otherwise("F")
    return f.withColumn("grade", grade).withColumn("is_acceptable", at_least(F.col("grade"), min_grade))


def routed(inputs: DataFrame) -> DataFrame:
    """SRC-3, SRC-11: kind of an input string, and the arXiv id it names."""
    s = F.trim("input")
    kind = F.when(F.lower(s).contains("arxiv") | s.rlike(r"^\d{4}\.\d+"), "arxiv").when(s.endswith(".tex"), "latex").when(s.endswith(".pdf"), "pdf").otherwise("unsupported")
    ids = [F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"arxiv\.org/abs/(\d+\.\d+(?:v\d+)?)", r"arxiv\.org/pdf/(\d+\.\d+(?:v\d+)?)", r"^(\d{4}\.\d+(?:v\d+)?)$")]
    return inputs.select("input", kind.alias("kind"), F.when(kind == "arxiv", F.coalesce(*ids, s)).alias("arxiv_id"))
