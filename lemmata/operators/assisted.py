"""Steps that ask a language model: prompts as columns, answers of injected clients, and what stands in for them.

Without a client every step gives its offline result, so all of them are plain projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.latex import answered
from .documents import candidate_stats, document_body, document_chunks, merged_chunk_results, merged_intervals, regex_candidates
from .entities import category_statistics, cited_by, metadata
from .tree import problem_areas

Client = Callable[[str], str]
# What stands in for a review.
FAILED = "Review generation failed. Please check API key configuration."
SKIPPED = "Review generation skipped - no API key"
#: How a review prompt ends.
CLOSING = "Cover contribution, proofs and their gaps, errors, dependencies, notation, literature, and at least five changes, each with its place, priority and remedy. Quote what you criticise. End by recommending one of: accept, accept with minor revisions, major revision, reject."
VERDICT = "is_valid boolean, type string, number string, label string, name string, statement string, has_proof boolean, issues array<string>"
AREA = "array<struct<type: string, label: string, name: string, statement: string, position: string>>"
CHUNK = {
    "sections": "array<struct<type: string, title: string, label: string>>",
    "elements": "array<struct<type: string, number: string, label: string, name: string, statement: string, has_proof: boolean>>",
    "equations": "array<struct<number: string, label: string, content: string>>",
    "citations": "array<string>",
    "labels": "array<string>",
    "refs": "array<string>",
}
GRADE = "score double, grade string, issues array<string>"


def first_of(*clients: Client) -> Client:
    """LLM-2: a client that tries others in turn and raises the last one's error."""

    def ask(prompt: str) -> str:
        for client in clients[:-1]:
            try:
                return client(prompt)
            except Exception:  # noqa: BLE001, S112  the next one is the answer to any failure
                continue
        return clients[-1](prompt)

    return ask


def _ask(prompts: DataFrame, client: Client | None) -> DataFrame:
    return prompts.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}) if client is None else answered(prompts, client)


def _fenced(c: Column, limit: int) -> Column:
    return F.concat(F.lit("\n```latex\n"), F.left(c, F.lit(limit)), F.lit("\n```\n"))


def _first_rows(rows: DataFrame, order: list, most: int | None) -> DataFrame:
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def review_prompts(papers: DataFrame, entities: DataFrame, definitions: int = 8, theorems: int = 6) -> DataFrame:
    """LLM-3: (paper_id, prompt): metadata, counts, the first definitions and theorems, and how entities are connected."""
    key = F.coalesce("label", F.concat_ws("_", "type", "idx"))
    e = entities.join(cited_by(entities), ["paper_id", "label"], "left").withColumn("key", key)
    uses, used = F.size("refs") > 0, F.col("cited_by").isNotNull()
    links = e.groupBy("paper_id").agg(F.count_if(~uses & ~used).alias("isolated"), F.count_if(uses & used).alias("connected"), F.countDistinct(F.when(F.col("type").startswith("equation"), F.col("key"))).alias("equations"))
    out = metadata(papers).join(links, "paper_id", "left").join(category_statistics(entities), "paper_id", "left")
    for kind, most, chars in (("definition", definitions, 400), ("theorem", theorems, 500)):
        # Of one key, the last entity stands at the first one's place.
        rows = e.where(F.col("type") == kind).groupBy("paper_id", "key").agg(F.min("idx").alias("at"), F.max_by(F.struct("label", "content", "refs", "cited_by"), "idx").alias("x"))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("at"))).where(F.col("n") <= most)
        content = F.when(F.length("x.content") > chars, F.concat(F.left("x.content", F.lit(chars)), F.lit("..."))).otherwise(F.col("x.content"))
        text = F.concat(F.lit(f"{kind.capitalize()} "), F.col("n").cast("string"), F.lit(" (label "), F.coalesce("x.label", F.lit("N/A")), F.lit("): "), content)
        if kind == "theorem":
            none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)
            text = F.concat(text, F.lit("\n  depends on: "), none(F.array_join("x.refs", ", ")), F.lit("\n  cited by: "), none(F.col("x.cited_by")))
        listed = rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "\n").alias(f"{kind}_list"))
        out = out.join(listed, "paper_id", "left")
    said = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(F.col(c))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    counts = F.concat_ws(", ", *(F.concat(F.lit(f"{c} "), number(c)) for c in ("definitions", "theorems", "lemmas", "propositions", "corollaries", "equations")))
    prompt = F.concat_ws(
        "\n", F.lit("Review this mathematical paper in English, as its expert referee."), F.concat(F.lit("Title: "), said("title", "Title not extracted")), F.concat(F.lit("Authors: "), said("authors", "Unknown")),
        F.concat(F.lit("Abstract: "), F.coalesce("abstract", F.lit(""))), F.concat(F.lit("Counts: "), counts), F.lit("Definitions:"), said("definition_list", "No definitions extracted"), F.lit("Theorems:"), said("theorem_list", "No theorems extracted"),
        F.concat(F.lit("Entities without references in or out: "), number("isolated"), F.lit("; with both: "), number("connected")),
        F.lit(CLOSING),
    )
    return out.select("paper_id", prompt.alias("prompt"))


def reviews(prompts: DataFrame, client: Client | None = None) -> DataFrame:
    """LLM-4: (paper_id, text): the client's reviews; fixed texts where it fails or there is none."""
    return _ask(prompts, client).select("paper_id", F.coalesce("answer", F.lit(SKIPPED if client is None else FAILED)).alias("text"))


def verified(candidates: DataFrame, client: Client | None = None, most: int | None = 10) -> DataFrame:
    """LLM-5: candidates that need it, ``most`` of each paper, with the client's verdict or the offline one."""
    rows = _first_rows(candidates.where("needs_verification"), ["element_type", "content"], most)
    ask = F.concat(F.lit("Check this LaTeX "), "element_type", F.lit(". Answer in JSON with is_valid, type, number, label, name, statement (its first 200 characters), has_proof and issues."), _fenced(F.col("content"), 3000))
    offline = F.struct(
        F.lit(True).alias("is_valid"), F.col("element_type").alias("type"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("label"), F.lit("").alias("name"),
        F.left("content", F.lit(200)).alias("statement"), F.lit(False).alias("has_proof"), F.array(F.lit("Not verified by LLM")).alias("issues"),
    )
    found = F.from_json("answer", VERDICT)
    # A broken answer parses to a row of nulls.
    return _ask(rows.withColumn("prompt", ask), client).withColumn("verdict", F.when(found["is_valid"].isNotNull(), found).otherwise(offline)).drop("prompt", "answer", "error")


def parsed_areas(papers: DataFrame, areas: DataFrame, client: Client | None = None, most: int | None = 5) -> DataFrame:
    """LLM-6, REL-9: (paper_id, start, element): what the client reads in united problem areas, ``most`` of each paper."""
    rows = _first_rows(merged_intervals(areas), ["start"], most).join(papers, "paper_id")
    chunk = F.substring("tex", F.col("start") + 1, F.col("end") - F.col("start"))
    ask = F.concat(F.lit("List the theorems, definitions and lemmas of this LaTeX as a JSON array of objects with type, label, name, statement and position."), _fenced(chunk, 4000))
    found = _ask(rows.select("paper_id", "start", ask.alias("prompt")), client)
    return found.select("paper_id", "start", F.explode(F.from_json("answer", AREA)).alias("element"))


def parsed_chunks(chunks: DataFrame, client: Client | None = None, most: int = 8000) -> DataFrame:
    """LLM-8: (paper_id, chunk_index, sections, ..., refs): the client's reading of each chunk, or empty arrays.

    A prompt holds ``most`` characters of its chunk; chunks of ``document_chunks`` are at most that long, unless they are
    one piece.
    """
    ask = F.concat(F.lit("Read this LaTeX, chunk "), F.col("chunk_index").cast("string"), F.lit(f". Answer in JSON with the arrays {', '.join(CHUNK)}; no other text."), _fenced(F.col("chunk"), most))
    found = _ask(chunks.select("paper_id", "chunk_index", ask.alias("prompt")), client)
    found = found.withColumn("x", F.from_json("answer", ", ".join(f"{k} {t}" for k, t in CHUNK.items())))
    return found.select("paper_id", "chunk_index", *(F.coalesce(F.col(f"x.{k}"), F.array().cast(t)).alias(k) for k, t in CHUNK.items()))


def chunk_totals(parsed: DataFrame) -> DataFrame:
    """AGG-11: (paper_id, chunks, sections, elements, equations, citations, labels, refs): what the chunks of a paper hold."""
    kinds = [k for k in CHUNK]
    return parsed.groupBy("paper_id").agg(F.count("*").alias("chunks"), *(F.sum(F.size(k)).cast("long").alias(k) for k in kinds))


def parsed_papers(papers: DataFrame, client: Client | None = None, max_chars: int = 8000) -> tuple[DataFrame, DataFrame]:
    """LLM-9: bodies (or whole texts) in chunks, each read by the client: (rows of merged results, totals).

    Rows are (paper_id, chunk_index, kind_ord, pos, label, payload), the first of each label; chunks over the prompt's
    limit have been cut at environments, so nothing of ``max_chars`` is left out but what is one piece.
    """
    chunks = document_chunks(document_body(papers).select("paper_id", F.col("body").alias("tex")), max_chars)
    parsed = parsed_chunks(chunks, client, max_chars)
    rows = [parsed.select("paper_id", "chunk_index", F.lit(o).alias("kind_ord"), F.posexplode(F.transform(k, lambda x: F.struct(x["label"].alias("label"), F.to_json(x).alias("payload")))).alias("pos", "x")) for o, k in enumerate(("sections", "elements", "equations"))]
    every = rows[0].unionAll(rows[1]).unionAll(rows[2]).select("paper_id", "chunk_index", "kind_ord", "pos", "x.label", "x.payload")
    return merged_chunk_results(every), chunk_totals(parsed)


def hybrid_parsed(papers: DataFrame, client: Client | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LLM-7: patterns first, then the client for what they leave in doubt: (verdicts, elements of problem areas, counts)."""
    bodies = document_body(papers).select("paper_id", F.col("body").alias("tex"))
    found = regex_candidates(bodies)
    return verified(found, client), parsed_areas(bodies, problem_areas(bodies), client), candidate_stats(found)


def compared_parsers(stats: DataFrame, client: Client | None = None) -> DataFrame:
    """LLM-11: (paper_id, score, grade, issues): the client's judgement of parsers by their counts.

    ``stats`` has (paper_id, parser) and counts in the other columns; a summary of them is the text that is judged.
    """
    counts = [c for c in stats.columns if c not in ("paper_id", "parser")]
    line = F.concat(F.col("parser"), F.lit(": "), F.concat_ws(", ", *(F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in counts)))
    texts = stats.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return evaluated(texts, "Compare these parses of one paper by what each found.", client)


def evaluated(texts: DataFrame, task: str, client: Client | None = None) -> DataFrame:
    """LLM-10: (paper_id, score, grade, issues) of each text by a ``task`` in words; 50 and C where there is none."""
    ask = F.concat(F.lit(f"{task} Answer in JSON with score (0 to 100), grade (A to F) and issues.\n"), "text")
    found = _ask(texts.select("paper_id", ask.alias("prompt")), client).withColumn("x", F.from_json("answer", GRADE))
    return found.select("paper_id", F.coalesce("x.score", F.lit(50.0)).alias("score"), F.coalesce("x.grade", F.lit("C")).alias("grade"), F.coalesce("x.issues", F.array().cast("array<string>")).alias("issues"))


def pipeline_status(tree: DataFrame, review_scores: DataFrame) -> DataFrame:
    """LLM-12: (paper_id, status) by two gates: the tree must rebuild its source before a review is judged."""
    good = lambda c: F.coalesce(F.col(c).isin("A", "B"), F.lit(False))
    r = review_scores.select("paper_id", F.col("grade").alias("_review"))
    status = F.when(~F.coalesce("can_reconstruct", F.lit(False)), "not_reconstructable").when(~good("grade"), "tree_failed").when(~good("_review"), "review_failed").otherwise("passed")
    return tree.join(r, "paper_id", "left").select("paper_id", status.alias("status"))
