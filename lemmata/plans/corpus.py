"""A LaTeX corpus derived from the driver's tables, by the same expressions in Spark and DuckDB.

In the templates below, §' opens a literal in which backslashes are themselves: a raw string in Spark, a plain one in
DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = """
concat(
 CASE WHEN l_linenumber = 1 THEN concat(§'\\section{Intro ', CAST(l_partkey AS STRING), §'}\\label{sec:', CAST(l_linenumber AS STRING), '}', chr(10))
      WHEN l_suppkey % 6 = 0 THEN concat(§'\\subsection{Part ', CAST(l_partkey AS STRING), '}', chr(10))
      WHEN l_suppkey % 6 = 1 THEN concat(§'\\subsubsection*{Detail ', CAST(l_partkey AS STRING), '}', chr(10))
      WHEN l_suppkey % 6 = 2 THEN concat(§'\\section{More ', CAST(l_partkey AS STRING), '}', chr(10)) ELSE '' END,
 'Text about item ', CAST(l_partkey AS STRING), ' with $x_{', CAST(l_linenumber AS STRING), §'}$ and \\cite{k', CAST(l_suppkey % 5 AS STRING), '}.', chr(10), chr(10),
 §'\\begin{', ENV, '}', CASE WHEN l_partkey % 9 < 7 AND l_suppkey % 3 = 0 THEN concat('[Name ', CAST(l_suppkey % 10 AS STRING), ']') ELSE '' END,
 CASE WHEN l_partkey % 4 <> 3 THEN concat(§'\\label{e', CAST(l_linenumber AS STRING), '}') ELSE '' END,
 CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat(
  'Let $y_{', CAST(l_partkey AS STRING), §'}$ hold (item). By \\textbf{rule} and',
  CASE WHEN l_linenumber > 1 THEN concat(§' \\ref{e', CAST(l_linenumber - 1 AS STRING), '}') ELSE ' nothing' END,
  CASE WHEN l_suppkey % 4 = 0 THEN §' \\cref{e1,e2}' ELSE '' END,
  CASE WHEN l_suppkey % 7 = 0 THEN concat(§' \\eqref{e', CAST(l_suppkey % 9 AS STRING), '}') ELSE '' END,
  CASE WHEN l_partkey % 5 = 0 THEN concat(' % note ', CAST(l_partkey AS STRING), chr(10), §'next 5\\% line.') ELSE '' END,
  CASE WHEN l_partkey % 13 = 0 THEN repeat('word ', 60) ELSE '' END,
  CASE WHEN l_partkey % 17 = 0 THEN §' \\begin{proof}It is \\[z = 1\\] so.\\end{proof} {' ELSE '' END) END,
 §'\\end{', ENV, '}', chr(10))
""".replace("ENV", "CASE l_partkey % 9 WHEN 0 THEN 'definition' WHEN 1 THEN 'theorem' WHEN 2 THEN 'lemma' WHEN 3 THEN 'proposition' WHEN 4 THEN 'corollary' WHEN 5 THEN 'assumption' WHEN 6 THEN 'remark' WHEN 7 THEN 'equation' ELSE 'equation*' END")

HEAD = """concat(§'\\documentclass{article}', chr(10), §'\\usepackage[utf8]{inputenc}', chr(10), §'\\usepackage{amsmath}', chr(10), §'\\newcommand{\\foo}[2]{bar}', chr(10),
 §'\\begin{document}', chr(10), §'\\title{Paper ', CAST(paper_id AS STRING), §' \\emph{on} sums}', chr(10), §'\\author{A. Writer}', chr(10), §'\\author{B. Reader}', chr(10),
 §'\\begin{abstract}We study % why', chr(10), 'sums.', §'\\end{abstract}', chr(10))"""
TAIL = "concat(chr(10), §'\\end{document}', chr(10))"

KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _spark(template: str) -> str:
    return template.replace("§'", "r'")


def _duck(template: str) -> str:
    return template.replace("§'", "'").replace("AS STRING", "AS VARCHAR")


def papers(spark: SparkSession, sf_dir: str, key: str = "l_orderkey") -> DataFrame:
    """(paper_id, tex): one paper for each value of ``key``, one environment for each of its lines."""
    lines = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(F.col(key).alias("paper_id"), *KEYS, F.expr(_spark(PIECE)).alias("piece"))
    whole = lines.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*KEYS, "piece"))), lambda x: x["piece"]), "\n").alias("body"))
    return whole.select("paper_id", F.concat(F.expr(_spark(HEAD)), F.col("body"), F.expr(_spark(TAIL))).alias("tex"))


#: CTE ``papers`` for DuckDB.
PAPERS_SQL = f"""papers AS (SELECT paper_id, {_duck(HEAD)} || body || {_duck(TAIL)} AS tex FROM (
  SELECT l_orderkey AS paper_id, string_agg({_duck(PIECE)}, chr(10) ORDER BY {', '.join(KEYS)}, {_duck(PIECE)}) AS body FROM lineitem GROUP BY l_orderkey))"""
