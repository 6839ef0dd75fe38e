"""Entities of LaTeX and plain-text papers: extraction, categories and cross-references.

All functions take and give DataFrames keyed by ``paper_id``. Entities are read in one scan of the text: the matches
of all types become one array, which one generator explodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def metadata(papers: DataFrame) -> DataFrame:
    """EXT-1: title, authors (joined by '; ') and abstract."""
    first = lambda p: F.regexp_extract("tex", p, 1)
    authors = F.transform(F.regexp_extract_all("tex", F.lit(r"(?s)\\author\{(.*?)\}"), F.lit(1)), T.clean_strong)
    return papers.select("paper_id", T.clean_strong(first(r"(?s)\\title\{(.*?)\}")).alias("title"), F.array_join(authors, "; ").alias("authors"), T.clean_strong(first(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}")).alias("abstract"))


def section_titles(papers: DataFrame) -> DataFrame:
    """EXT-2: titles of unstarred sections, in order."""
    return papers.select("paper_id", F.posexplode(F.regexp_extract_all("tex", F.lit(r"\\section\{([^\n]*?)\}"), F.lit(1))).alias("pos", "title"))


def _matches(kind: str, ord_: int, pattern: str) -> Column:
    found = F.regexp_extract_all("tex", F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m, i: F.struct(F.lit(ord_).alias("type_ord"), F.lit(kind).alias("type"), (i + 1).alias("idx"), m.alias("raw")))


def latex_entities(papers: DataFrame, patterns: dict[str, str] = P.ENTITY_PATTERNS) -> DataFrame:
    """EXT-3: paper_id, type_ord, type, idx, name, short_name, label, content, display_content, refs, raw.

    Order of emission is (type_ord, idx). An empty body yields the name, a starred equation is named by its body.
    """
    found = F.concat(*(_matches(kind, i, p) for i, (kind, p) in enumerate(patterns.items())))
    e = papers.select("paper_id", F.inline(found))
    group = lambda n: F.coalesce(*(F.when(F.col("type") == k, F.regexp_extract("raw", p, n)) for k, p in patterns.items() if n == 1 or k in P.THEOREM_LIKE), F.lit(""))
    e = e.withColumn("g1", group(1)).withColumn("g2", group(2))
    numbered = F.concat(F.initcap("type"), F.lit(" "), F.col("idx"))
    body = F.when(F.col("g2") != "", F.col("g2")).otherwise(F.col("g1"))
    e = e.withColumn("name", F.when((F.col("type") == "equation") | (F.col("g1") == ""), numbered).otherwise(F.col("g1"))).withColumn("body", body)
    label = F.regexp_extract("raw", P.LABEL, 1)
    clean = T.clean_strong(F.col("body"))
    return e.select(
        "paper_id", "type_ord", "type", "idx", "name", T.short_name(F.col("type"), F.col("body"), F.col("idx")).alias("short_name"), F.nullif(label, F.lit("")).alias("label"),
        clean.alias("content"), T.shortened(clean, 200, 197).alias("display_content"), F.regexp_extract_all("raw", F.lit(P.REF), F.lit(1)).alias("refs"), "raw",
    )


def dependencies(entities: DataFrame) -> DataFrame:
    """EXT-3e: every reference of every entity, in order."""
    return entities.select("paper_id", "type_ord", "type", "idx", "label", F.posexplode("refs").alias("pos", "ref"))


def category_statistics(entities: DataFrame) -> DataFrame:
    """AGG-1, EXT-3h: distinct keys by category, and all entities."""
    key = F.coalesce("label", F.concat_ws("_", "type", F.col("idx").cast("string")))
    counts = (F.countDistinct(F.when(F.col("type") == t, key)).alias(c) for t, c in P.CATEGORIES.items())
    return entities.groupBy("paper_id").agg(*counts, F.count("*").alias("total"))


def cited_by(entities: DataFrame) -> DataFrame:
    """REL-1: for each label that some labelled entity refers to, those labels in order of first reference."""
    targets = entities.where("label IS NOT NULL").select("paper_id", F.col("label").alias("ref")).distinct()
    refs = dependencies(entities).where("label IS NOT NULL").join(targets, ["paper_id", "ref"], "left_semi")
    first = refs.groupBy("paper_id", "ref", "label").agg(F.min(F.struct("type_ord", "idx", "pos")).alias("at"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), ",")
    return first.groupBy("paper_id", F.col("ref").alias("label")).agg(listed.alias("cited_by"))


def text_titles(texts: DataFrame) -> DataFrame:
    """EXT-4: (paper_id, title): the first line of a plain text, trimmed."""
    return texts.select("paper_id", F.regexp_replace(F.substring_index("text", "\n", 1), r"^\s+|\s+$", "").alias("title"))


def text_entities(texts: DataFrame, keywords: dict[str, tuple[str, ...]] = P.KEYWORDS) -> DataFrame:
    """EXT-3f, EXT-5: (paper_id, type_ord, type, idx, name, content, pos): entities of plain text by their keywords.

    The content goes from the keyword's match up to a blank line or a stop before a capital, and is at most 500
    characters where neither comes. Contents may overlap, since only the keyword itself is consumed. Numbers run through
    a type's keywords, one keyword after another.
    """

    def of(kind: str, order: int, pattern: str) -> Column:
        head = rf"(?i:{pattern})"
        whole = rf"{head}(?=(?s:(.*?))(\n\s*\n|\.\s+[A-Z]|\z))"
        content, stop = (F.regexp_extract_all("text", F.lit(whole), F.lit(g)) for g in (1, 2))
        rows = F.arrays_zip(content.alias("content"), stop.alias("stop"), T.starts_of(F.col("text"), head).alias("pos"))
        cut = lambda m: F.regexp_replace(F.when(m["stop"] == "", F.left(m["content"], F.lit(500))).otherwise(m["content"]), r"^\s+|\s+$", "")
        return F.transform(rows, lambda m: F.struct(F.lit(order).alias("type_ord"), F.lit(kind).alias("type"), cut(m).alias("content"), m["pos"].alias("pos")))

    every = [F.transform(F.concat(*(of(k, o, p) for p in ps)), lambda x, i: x.withField("idx", i + 1)) for o, (k, ps) in enumerate(keywords.items())]
    found = texts.select("paper_id", F.inline(F.concat(*every)))
    return found.select("paper_id", "type_ord", "type", "idx", F.concat_ws(" ", F.initcap("type"), F.col("idx").cast("string")).alias("name"), "content", "pos")


def entity_positions(papers: DataFrame, patterns: dict[str, str] = P.ENTITY_PATTERNS) -> DataFrame:
    """EXT-3f: (paper_id, type, idx, pos): where each entity's environment begins, in characters."""
    return papers.select("paper_id", F.inline(F.concat(*(_placed(k, p) for k, p in patterns.items()))))


def _placed(kind: str, pattern: str) -> Column:
    return F.transform(T.starts_of(F.col("tex"), pattern), lambda at, i: F.struct(F.lit(kind).alias("type"), (i + 1).alias("idx"), at.alias("pos")))


def implied_dependencies(entities: DataFrame) -> DataFrame:
    """REL-2: (paper_id, type, idx, ref): labels of other entities whose name stands in an entity's content, letter case
    aside. The names of a paper meet each entity as one array, in one row; pairs that don't match are never rows."""
    named = entities.where("label IS NOT NULL").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("type_ord", "idx", F.lower("name").alias("name"), "label"))).alias("names"))
    joined = entities.join(named, "paper_id")
    text = F.lower("content")
    other = lambda x: ((x["type_ord"] != F.col("type_ord")) | (x["idx"] != F.col("idx"))) & F.contains(text, x["name"])
    return joined.select("paper_id", "type", "idx", F.explode(F.filter("names", other)).alias("x")).select("paper_id", "type", "idx", F.col("x.label").alias("ref"))


def last_by_key(entities: DataFrame) -> DataFrame:
    """EXT-3h: of the entities of one category and key, the last."""
    key = F.coalesce("label", F.concat_ws("_", "type", F.col("idx").cast("string")))
    order = Window.partitionBy("paper_id", F.regexp_replace("type", "_star$", ""), key).orderBy(F.desc("type_ord"), F.desc("idx"))
    return entities.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
