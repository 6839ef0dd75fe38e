"""Quality rules with adaptive thresholds.

Four measures of a text (symbols, repeated lines and repeated words per mille, mean word length in hundredths) are
summed up in quantile sketches per language and source: histograms over fixed buckets, which merge by adding counts, so
any partition of the rows gives the same sketch. There is no last bucket: far up, buckets widen with their values. Quantiles of the sketches give the thresholds that replace fixed
cutoffs; the documents are then joined with their thresholds. The spread is taken below the median for the one-sided
measures, so that a source of which almost half is junk still has the threshold of its better half. Sketches of fewer
than ``least`` documents are merged by language, and those into one of all documents.

DataFrame functions only. The one place that sees a document's words together is its own row.

Nulls: a null text has no word and fails the base rule. Null languages and sources are groups of their own. Repeated
rows are judged alike. Other columns are carried by ``keep_quality``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpoint, enclosed, released, table

SYMBOLS = "#*$%&|<>"
#: By measure: width of a bucket, number of buckets of that width (above twice that, widths double as values do), slack below and above the quantiles, and whether low values are judged too.
MEASURES = {"sym": (5, 2000, 0, 60), "dup": (5, 200, 0, 350), "rep": (5, 200, 0, 350), "wl": (10, 1000, 250, 150)}
SPREADS = 4
LEAST = 200
#: Thresholds of up to this number of groups (some 20 MB) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in ``words`` (a bound variable, not an expression).

    Sorting the windows' hashes puts equal ones side by side: n log n within the row, whatever the text repeats.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    found = F.transform(F.array(F.array_sort(windows)), lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))
    return F.when(F.size(words) >= 4, found[0]).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed and _sym, _dup, _rep, _wl."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    # Bound by transform and made by a generator, so that no later filter brings the optimizer to compute them again.
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("_n_words"), repeated_words(w).alias("_n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("_n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_n_dup_lines"))
    d = docs.select("*", F.inline(F.transform(F.array(words), of_words))).select("*", F.inline(F.transform(F.array(lines), of_lines)))
    d = d.withColumns({
        "_word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    per = lambda a, b, k: F.floor(k * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    d = d.withColumns({"_sym": per("_n_symbols", "_word_chars", 1000), "_dup": per("_n_dup_lines", "_n_lines", 1000), "_rep": per("_n_repeat_words", "_n_words", 1000), "_wl": per("_word_chars", "_n_words", 100)})
    return d.withColumn("_base_failed", (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))).drop("_n_lines")


def step(bucket: Column, last: Column) -> Column:
    """How many widths a bucket has: 1 below 2 * last, 2 below 4 * last and so on, so it is exact to one in ``last``."""
    return F.pow(F.lit(2), F.length(F.bin(F.floor(bucket / last))) - 1).cast("long")


def bucket(value: Column, width: int, last: int) -> Column:
    b = F.floor(value / width)
    return b - F.pmod(b, step(b, F.lit(last)))


def sketches(measures: DataFrame) -> DataFrame:
    """(level, lang, source, m, b, c): the sketches of every source, language and of all, as bucket counts."""
    cells = F.array(*(F.struct(F.lit(m).alias("m"), bucket(F.col(f"_{m}"), width, last).alias("b")) for m, (width, last, *_) in MEASURES.items()))
    one = measures.where("_n_words > 0").select("lang", "source", F.explode(cells).alias("x")).groupBy("lang", "source", "x.m", "x.b").agg(F.count("*").alias("c"))
    langs = one.groupBy("lang", "m", "b").agg(F.sum("c").alias("c"))
    every = langs.groupBy("m", "b").agg(F.sum("c").alias("c"))
    none = F.lit(None).cast("string")
    return (
        one.select(F.lit(2).alias("level"), "lang", "source", "m", "b", "c")
        .unionAll(langs.select(F.lit(1), "lang", none, "m", "b", "c"))
        .unionAll(every.select(F.lit(0), none, none, "m", "b", "c"))
    )


def thresholds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source) and the least and most value of each measure."""
    group = Window.partitionBy("level", "lang", "source", "m")
    s = sketch.withColumns({"cum": F.sum("c").over(group.orderBy("b")), "n": F.sum("c").over(group)})
    q = lambda p: F.min(F.when(100 * F.col("cum") >= p * F.col("n"), F.col("b")))
    s = s.groupBy("level", "lang", "source", "m").agg(q(25).alias("q1"), q(50).alias("q2"), q(75).alias("q3"), F.max("n").alias("n"))
    pick = lambda f: F.coalesce(*(F.when(F.col("m") == m, F.lit(f(*v)).cast("long")) for m, v in MEASURES.items()))
    width, below, above = pick(lambda w, l, lo, hi: w), pick(lambda w, l, lo, hi: lo), pick(lambda w, l, lo, hi: hi)
    last = pick(lambda w, l, lo, hi: l)
    spread = F.when(F.col("m") == "wl", F.col("q3") - F.col("q1")).otherwise(F.col("q2") - F.col("q1"))
    s = s.select("level", "lang", "source", "m", "n", ((F.col("q2") - SPREADS * spread) * width - below).alias("lo"), ((F.col("q2") + step(F.col("q2"), last) + SPREADS * spread) * width + above).alias("hi"))
    wide = s.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("m") == m, F.col(e))).alias(f"{e}_{m}") for m in MEASURES for e in ("lo", "hi")))
    ends = [f"{e}_{m}" for m in MEASURES for e in ("lo", "hi")]
    at = lambda level: wide.where(F.col("level") == level)
    own, lang, every = at(2).alias("s"), at(1).alias("l"), at(0).alias("e")
    joined = own.join(lang, F.col("s.lang").eqNullSafe(F.col("l.lang"))).crossJoin(F.broadcast(every))  # one row
    best = lambda c: F.when(F.col("s.n") >= least, F.col(f"s.{c}")).when(F.col("l.n") >= least, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    return joined.select(F.col("s.lang").alias("_lang"), F.col("s.source").alias("_source"), *(best(c).alias(f"_{c}") for c in ends))


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """``measures`` with _kept: within all thresholds of language and source, and not failed by the base rule."""
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = measures.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = (F.col("_wl") >= F.col("_lo_wl")) & (F.col("_wl") <= F.col("_hi_wl"))
    for m in ("sym", "dup", "rep"):
        within &= F.col(f"_{m}") <= F.col(f"_hi_{m}")
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(within, F.lit(True)))


def keep_quality(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that pass. Rows and measures are written once, since measuring costs more than a copy."""
    measures = checkpoint(measured(enclosed(docs, "lang", "source", "text")).drop("text"))
    limits = checkpoint(thresholds(sketches(measures), least))
    return released(judged(measures, limits).where("_kept"), docs)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, measured and judged."""
    measures = checkpoint(measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    out = judged(measures, checkpoint(thresholds(sketches(measures))))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g),
p AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p ON w.k = p.k),
v AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS sym, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup, 1000 * n_repeat_words // greatest(n_words, 1) AS rep,
      100 * word_chars // greatest(n_words, 1) AS wl, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT lang, source, 'sym' AS m, least(sym // 5, 2000) AS b FROM v WHERE n_words > 0 UNION ALL SELECT lang, source, 'dup', least(dup // 5, 200) FROM v WHERE n_words > 0
      UNION ALL SELECT lang, source, 'rep', least(rep // 5, 200) FROM v WHERE n_words > 0 UNION ALL SELECT lang, source, 'wl', least(wl // 10, 1000) FROM v WHERE n_words > 0),
h AS (SELECT 2 AS level, lang, source, m, b, count(*) AS c FROM x GROUP BY lang, source, m, b UNION ALL SELECT 1, lang, NULL, m, b, count(*) FROM x GROUP BY lang, m, b
      UNION ALL SELECT 0, NULL, NULL, m, b, count(*) FROM x GROUP BY m, b),
c AS (SELECT *, sum(c) OVER (PARTITION BY level, lang, source, m ORDER BY b) AS cum, sum(c) OVER (PARTITION BY level, lang, source, m) AS n FROM h),
q AS (SELECT level, lang, source, m, max(n) AS n, min(b) FILTER (100 * cum >= 25 * n) AS q1, min(b) FILTER (100 * cum >= 50 * n) AS q2, min(b) FILTER (100 * cum >= 75 * n) AS q3 FROM c GROUP BY level, lang, source, m),
t AS (SELECT level, lang, source, max(n) AS n, max((q2 + 1 + 4 * (q2 - q1)) * 5 + 60) FILTER (m = 'sym') AS sym, max((q2 + 1 + 4 * (q2 - q1)) * 5 + 350) FILTER (m = 'dup') AS dup,
      max((q2 + 1 + 4 * (q2 - q1)) * 5 + 350) FILTER (m = 'rep') AS rep, max((q2 - 4 * (q3 - q1)) * 10 - 250) FILTER (m = 'wl') AS lo, max((q2 + 1 + 4 * (q3 - q1)) * 10 + 150) FILTER (m = 'wl') AS hi
      FROM q GROUP BY level, lang, source),
u AS (SELECT s.lang, s.source, unnest(CASE WHEN s.n >= 200 THEN struct_pack(sym := s.sym, dup := s.dup, rep := s.rep, lo := s.lo, hi := s.hi)
      WHEN l.n >= 200 THEN struct_pack(sym := l.sym, dup := l.dup, rep := l.rep, lo := l.lo, hi := l.hi) ELSE struct_pack(sym := e.sym, dup := e.dup, rep := e.rep, lo := e.lo, hi := e.hi) END)
      FROM t s JOIN t l ON s.level = 2 AND l.level = 1 AND s.lang IS NOT DISTINCT FROM l.lang JOIN t e ON e.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(v.sym <= u.sym AND v.dup <= u.dup AND v.rep <= u.rep AND v.wl BETWEEN u.lo AND u.hi, true) AS kept
FROM v LEFT JOIN u ON v.lang IS NOT DISTINCT FROM u.lang AND v.source IS NOT DISTINCT FROM u.source
"""
