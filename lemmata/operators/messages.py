"""What the scores say in words: notes on reviews, messages on graphs, issues of trees, bars and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (feature, issue where it is absent, strength where it is present), in order of the checks.
REVIEW_NOTES = (
    ("specific_theorem_analysis", "Does not reference specific theorems by number", "References specific theorems"),
    ("error_identification", "Does not identify any mathematical issues", None),
    ("proof_gap_analysis", "Does not analyze proof completeness", "Analyzes proof gaps"),
    ("cites_theorem_numbers", "Does not cite theorem numbers", "Cites specific theorem numbers"),
    ("concrete_suggestions", "Lacks concrete suggestions", "Provides concrete suggestions"),
    ("clear_recommendation", "No clear accept/reject recommendation", "Provides clear recommendation"),
    ("actionable", "Suggestions are not actionable", None),
    ("avoids_generic", "Contains vague/generic statements without specifics", None),
)
# By metric of a graph, (condition, status, message); the first condition that holds decides.
GRAPH_MESSAGES = {
    "coverage": (
        ("total = 0", "CRITICAL", "No entities detected. Check if input is a valid math paper."),
        ("total < 3", "POOR", "Only {total} entities detected. May have missed content."),
        ("total < 10", "FAIR", "{total} entities detected. Consider checking for missed entities."),
        ("total <= 50", "GOOD", "{total} entities detected. Good coverage."),
        ("true", "EXCELLENT", "{total} entities detected. Comprehensive coverage."),
    ),
    "connectivity": (
        ("n = 0", "CRITICAL", "Empty graph - no connectivity to evaluate."),
        ("connected_ratio < 0.3", "POOR", "Only {connected_ratio:1} of entities have dependencies. Many isolated nodes."),
        ("connected_ratio < 0.5", "FAIR", "{connected_ratio:1} of entities connected. Consider adding more cross-references."),
        ("connected_ratio <= 0.9", "GOOD", "{connected_ratio:1} of entities have connections. Well-connected graph."),
        ("true", "GOOD", "{connected_ratio:1} connected. Very dense - verify connections are meaningful."),
    ),
    "balance": (
        ("named = 0", "CRITICAL", "No entities of any type detected."),
        ("definitions = 0 AND theorems = 0", "FAIR", "No definitions or theorems found. May be a partial extraction."),
        ("definitions = 0", "FAIR", "No definitions found. Theorems may lack proper foundations."),
        ("theorems = 0 AND lemmas = 0", "POOR", "Only definitions found. No main results detected."),
        ("2 * (theorems + lemmas) >= definitions AND theorems + lemmas <= 5 * definitions", "EXCELLENT", "Good balance: {definitions} definitions, {theorems} theorems, {lemmas} lemmas."),
        ("2 * (theorems + lemmas) < definitions", "FAIR", "More definitions than results. Consider if some definitions are unnecessary."),
        ("true", "GOOD", "Many results relative to definitions. May need intermediate lemmas."),
    ),
    "completeness": (
        ("n = 0", "CRITICAL", "Empty graph."),
        ("isolated_ratio > 0.5", "POOR", "{isolated_ratio:1} of nodes are isolated. Dependency extraction may have failed."),
        ("isolated_ratio > 0.2", "FAIR", "{isolated_ratio:1} isolated nodes. Some dependencies may be missing."),
        ("isolated_ratio <= 0.1", "EXCELLENT", "Only {isolated_ratio:1} isolated nodes. Good dependency coverage."),
        ("true", "GOOD", "{isolated_ratio:1} isolated nodes. Reasonable completeness."),
    ),
    "density_score": (
        ("n <= 1", "CRITICAL", "Insufficient nodes to evaluate density."),
        ("density < 0.01", "POOR", "Density {density:4} is very low. Graph is too sparse."),
        ("density < 0.05", "FAIR", "Density {density:4} is low. May have missed some dependencies."),
        ("density <= 0.3", "EXCELLENT", "Density {density:4} is in ideal range."),
        ("density <= 0.5", "GOOD", "Density {density:4} is slightly high. Verify connections are meaningful."),
        ("true", "FAIR", "Density {density:4} is very high. May have false positive connections."),
    ),
}
# Recommendations in words, by key.
RECOMMENDATIONS = {
    "entity_detection": "📄 **Entity Detection**: Consider using LaTeX source instead of PDF for better entity extraction.",
    "dependencies": "🔗 **Dependencies**: Many entities are isolated. Check if \\label and \\ref commands are properly parsed.",
    "definitions": "📐 **Definitions**: No definitions found. Ensure \\begin{{definition}} environments are detected.",
    "main_results": "🎯 **Main Results**: No theorems or lemmas detected. Verify \\begin{{theorem}} parsing.",
    "completeness": "🔍 **Completeness**: High number of isolated nodes. Some \\ref citations may not be resolving to \\label targets.",
    "too_sparse": "📊 **Graph Density**: Graph is too sparse. Consider manual review for missed dependencies.",
    "very_dense": "⚠️ **Graph Density**: Graph is very dense. Verify that all connections are meaningful and not false positives.",
    "overall_good": "✅ **Overall**: Dependency graph quality is good. No major issues detected.",
}
# Fixed values: (coverage, least share, name in the issue), in order.
TREE_ISSUES = (("section_coverage", 0.9, "Section"), ("element_coverage", 0.8, "Element"), ("equation_coverage", 0.7, "Equation"))
GRADES = "FDCBA"


def percent(c: Column) -> Column:
    """FN-19: a share in per cent with one place; ties go to the even digit."""
    return F.format_string("%.1f%%", F.bround(100 * c, 1))


def bar(score: Column, width: int = 10) -> Column:
    """FN-18: full blocks for whole tenths, light ones for the rest."""
    full = F.floor(score * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))


def at_least(grade: Column, least: str = "C") -> Column:
    """FN-17: whether a grade is ``least`` or better, of F, D, C, B, A."""
    return F.coalesce(grade.isin(*GRADES[GRADES.index(least) :]), F.lit(False))


def in_words(template: str) -> Column:
    """A message whose {column}, {column:1} (per cent) and {column:4} (four places) are filled in."""
    parts = []
    for text, name, kind in re.findall(r"([^{]+)|\{(\w+):?(\d?)\}", template):
        value = F.col(name) if name else None
        parts.append(F.lit(text) if text else percent(value) if kind == "1" else F.format_string("%.4f", F.bround(value, 4)) if kind else value.cast("string"))
    return F.concat(*parts)


def review_notes(features: DataFrame) -> DataFrame:
    """RQ-17: (review_id, issues, strengths): arrays in order of the checks."""
    absent = F.array_compact(F.array(*(F.when(~F.col(f), issue) for f, issue, _ in REVIEW_NOTES)))
    present = F.array_compact(F.array(*(F.when(F.col(f), strength) for f, _, strength in REVIEW_NOTES if strength)))
    return features.select("review_id", absent.alias("issues"), present.alias("strengths"))


def review_summary(scores: DataFrame, notes: DataFrame) -> DataFrame:
    """SNK-11, SNK-13: (review_id, summary): score, grade, at most five strengths and ten issues, and the verdict."""
    listed = lambda c, most: F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("  - "), x))
    verdict = F.when(F.col("grade").isin("A", "B"), "PASSED").when(F.col("grade") == "C", "MARGINAL (needs improvement)").otherwise("FAILED (requires major revision)")
    lines = F.concat(
        F.array(F.format_string("Review score: %d/100 (grade %s)", "overall_score", "grade"), F.lit("Strengths:")), listed("strengths", 5), F.array(F.lit("Issues:")), listed("issues", 10),
        F.array(F.concat(F.lit("Review quality: "), verdict)),
    )
    return scores.join(notes, "review_id").select("review_id", F.array_join(lines, "\n").alias("summary"))


def graph_messages(quality: DataFrame) -> DataFrame:
    """GQ-1..5: (paper_id, pos, metric, score, status, message, bar) of every metric of every paper."""

    def row(pos: int, metric: str) -> Column:
        status, message = None, None
        for condition, said, template in reversed(GRAPH_MESSAGES[metric]):
            holds = F.expr(condition)
            status = F.lit(said) if status is None else F.when(holds, said).otherwise(status)
            message = in_words(template) if message is None else F.when(holds, in_words(template)).otherwise(message)
        score = F.col(metric).cast("double")
        return F.struct(F.lit(pos).alias("pos"), F.lit(metric.removesuffix("_score")).alias("metric"), score.alias("score"), status.alias("status"), message.alias("message"), bar(score).alias("bar"))

    return quality.select("paper_id", F.inline(F.array(*(row(i, m) for i, m in enumerate(GRAPH_MESSAGES)))))


def recommendation_texts(recommendations: DataFrame) -> DataFrame:
    """GQ-6: recommendations in words."""
    text = F.coalesce(*(F.when(F.col("recommendation") == k, t) for k, t in RECOMMENDATIONS.items()))
    return recommendations.select("paper_id", "pos", text.alias("text"))


def graph_summary(quality: DataFrame) -> DataFrame:
    """GQ-7, SNK-13: (paper_id, summary): score, grade, a line for each metric, and the statistics."""
    line = F.concat_ws(" ", F.rpad("metric", 12, " "), F.concat(F.lit("["), "bar", F.lit("]")), F.format_string("%.2f", "score"), "status", F.lit("-"), "message")
    lines = graph_messages(quality).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("Graph score: "), F.format_string("%.2f", F.bround(F.col("overall").cast("double"), 2)), F.lit(" (grade "), F.col("grade"), F.lit(")"))
    tail = F.concat(F.lit("Nodes: "), F.col("n").cast("string"), F.lit(", edges: "), F.col("m").cast("string"), F.lit(", density: "), F.format_string("%.4f", F.bround("density", 4)))
    return quality.join(lines, "paper_id").select("paper_id", F.concat_ws("\n", head, "lines", tail).alias("summary"))


def tree_issues(coverage: DataFrame) -> DataFrame:
    """TQ-2: (paper_id, pos, issue): coverages under their least shares."""
    issue = lambda i, c, least, name: F.when(F.col(c) < least, F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"{name} coverage low: "), percent(F.col(c))).alias("issue")))
    return coverage.select("paper_id", F.inline(F.array_compact(F.array(*(issue(i, *x) for i, x in enumerate(TREE_ISSUES))))))


def tree_summary(quality: DataFrame) -> DataFrame:
    """TQ-9, SNK-13: (paper_id, summary) of tree quality: score, grade, shares and flags."""
    shares = ("section_coverage", "element_coverage", "equation_coverage", "citation_coverage", "label_resolution", "similarity")
    flags = ("hierarchy_ok", "math_preserved", "theorems_complete", "no_orphans", "no_dangling", "can_reconstruct")
    named = lambda c, x: F.concat(F.lit(f"{c.replace('_', ' ').capitalize()}: "), x)
    lines = [F.format_string("Tree score: %d/100 (grade %s)", "overall_score", "grade"), *(named(c, percent(F.col(c))) for c in shares), *(named(c, F.when(F.col(c), "yes").otherwise("no")) for c in flags)]
    return quality.select("paper_id", F.concat_ws("\n", *lines).alias("summary"))
