"""Mixing sources to target weights.

Sizes are words. Sources, ordered by code point with null last, weigh 5, 2, 1, 5, 2, 1, ...; they share ``share``
(150 %) of all words by weight. A source gets at most twice its size; what is above is shared out again by weight until
no source is above. In order of size by weight, the sources at their limit are a prefix, so one window over the sources
finds it. A document is emitted floor(target / size of its source) times, and once more when a hash of its id falls
below the fraction; the hash makes reruns agree.

The plan's windows run in one task over one row for each source; the documents' own sums are partial aggregates.

Nulls: a null source is a source of its own; a null text has size 0; a null id draws as the id "". Rows of the same id
draw the same number. A source of no words has the target 0 and its documents are not emitted. Other columns are
carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, enclosed, table

WEIGHTS = (5, 2, 1)
#: Sources up to this number (some 10 MB) are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size). The windows run over one row per source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("long")
    order = (F.col("ratio"), F.col("source").isNull(), F.col("source"))
    upto, every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sums.withColumn("w", weight).withColumn("ratio", 2.0 * F.col("source_size") / F.col("w"))
    s = s.withColumn("all", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("left", 3 * F.col("all") - 4 * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    s = s.withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    full = F.col("w") * F.col("left").cast("double") > 4.0 * F.col("source_size") * F.col("left_w")
    s = s.withColumn("full", full)
    s = s.withColumn("rest", 3 * F.col("all") - 4 * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every))
    s = s.withColumn("rest_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    shared = (F.col("w") * F.col("rest")).cast("double") / (2 * F.col("rest_w")).cast("double")
    target = F.when(F.col("full"), 2.0 * F.col("source_size")).otherwise(shared)
    return s.select("source", "source_size", target.alias("target"))


def planned(docs: DataFrame) -> DataFrame:
    """(row, size, source_size, target, copies): all columns of ``docs`` as one, and the times that each document is emitted."""
    targets = checkpoint(source_targets(docs.select("source", size_of(F.col("text")).alias("size"))))
    targets = targets.withColumnRenamed("source", "of")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = enclosed(docs, size_of(F.col("text")).alias("size"), F.col("source").alias("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    joined = rows.join(targets, F.col("own").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("id")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    joined = joined.withColumn("rate", rate)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, and ``copy``, counting from 1, where ``docs`` has no such column."""
    number = [] if "copy" in docs.columns else [F.col("copy")]
    out = planned(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *number)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and what the mix takes of each."""
    docs = planned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER () AS a, sum(w) OVER () AS aw FROM s1),
s3 AS (SELECT *, 3 * a - 4 * coalesce(sum(source_size) OVER o, 0) AS l, aw - coalesce(sum(w) OVER o, 0) AS lw FROM s2
       WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, w * l::DOUBLE > 4.0::DOUBLE * source_size * lw AS f FROM s3),
s5 AS (SELECT *, 3 * a - 4 * sum(CASE WHEN f THEN source_size ELSE 0 END) OVER () AS r, sum(CASE WHEN f THEN 0 ELSE w END) OVER () AS rw FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN f THEN 2.0::DOUBLE * source_size ELSE (w * r)::DOUBLE / (2 * rw)::DOUBLE END AS target FROM s5),
e AS (SELECT d.doc_id, d.size, s6.source_size, s6.target, CASE WHEN s6.source_size > 0 THEN s6.target / s6.source_size::DOUBLE ELSE 0 END AS rate,
      ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM e
"""
