"""Messages, reconstruction, chunks, counts and text mode on hand-made papers."""

import difflib
import re

import pytest

from lemmata.operators import assisted as A
from lemmata.operators import documents as D
from lemmata.operators import entities as E
from lemmata.operators import graph as G
from lemmata.operators import messages as M
from lemmata.operators import rebuild as B
from lemmata.plans import more
from lemmata.plans.corpus import papers as corpus

SF = "/root/testdata/sf0.001"


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, tex string")


def packed(pieces, most, least):
    chunks, current = [], ""
    for p in pieces:
        if len(current) + len(p) > most and len(current) > least:
            chunks.append(current)
            current = p
        else:
            current += p
    return [c for c in [*chunks, current] if c]


def test_chunks_lose_nothing_and_keep_the_limit(spark):
    env = "\\begin{lemma}" + "x" * 90 + "\\end{lemma}"
    texts = ["".join(f"\\section{{S{i}}}" + "a" * (37 * i % 400) + env * (i % 4) for i in range(60)), "\\section{A}" + env * 30, "plain " * 500, ""]
    got = {}
    for r in D.document_chunks(papers(spark, *texts, None), 500, 100, 50).orderBy("paper_id", "chunk_index").collect():
        got.setdefault(r.paper_id, []).append(r.chunk)
    for i, t in enumerate(texts):
        first = packed(re.split(r"(?=\\section\{[^}]+\})", t), 500, 100)
        expected = [c for x in first for c in (packed(re.split("(" + D.CUT_ENVIRONMENTS.removeprefix("(?s)") + ")", x, flags=re.S), 500, 50) if len(x) > 500 else [x])]
        assert got.get(i, []) == expected
        assert "".join(expected) == t
    assert max(map(len, got[1])) <= 500


def test_a_paper_of_five_thousand_sections(spark):
    tex = "\\begin{document}" + "".join(f"\\section{{S{i}}}text\\subsubsection{{T{i}}}more\\begin{{lemma}}\\label{{l{i}}}\\ref{{l{i - 1}}}\\end{{lemma}}" for i in range(5000)) + "\\end{document}"
    p = papers(spark, tex)
    s = D.section_tree(p).orderBy("section_id").collect()
    assert len(s) == 10_000 and s[0].raw_content == "text\\subsubsection{T0}more\\begin{lemma}\\label{l0}\\ref{l-1}\\end{lemma}" and s[1].parent_id == 0
    assert D.document_chunks(p).count() > 10
    e = E.latex_entities(p)
    n = G.nodes(e)
    assert G.components(n, G.edges(e, n)).first().num_components == G.paper_components(e).first().num_components == 1
    q = G.quality(e).first()
    assert (q.n, q.m, q.isolated, q.lemmas, q.total) == (5000, 4999, 0, 5000, 5000)


def test_counts_are_those_of_nodes_and_edges(spark):
    tex = r"\begin{lemma}\label{a}\ref{a}\ref{b}\ref{b}\ref{no}\end{lemma}\begin{theorem}\label{b}x\end{theorem}\begin{theorem}\label{b}\ref{a}\end{theorem}\begin{remark}y\end{remark}\begin{equation}z\end{equation}"
    e = E.latex_entities(papers(spark, tex, None, ""))
    n = G.nodes(e)
    d = {r.node_id: (r.in_degree, r.out_degree) for r in G.degrees(n, G.edges(e, n)).collect()}
    assert d == {"a": (2, 2), "b": (1, 1), "remark_Remark 1": (0, 0), "equation_Equation 1": (0, 0)}
    assert G.components(n, G.edges(e, n)).collect() == G.paper_components(e).collect() != []
    c = G.paper_counts(e).first()
    assert (c.n, c.m, c.isolated, c.theorems, c.lemmas, c.total) == (4, 3, 2, 1, 1, 5)


def test_tree_quality_against_plain_python(spark):
    rows = {r.paper_id: r for r in more.QUERIES["tree_quality"](spark, SF).limit(200).collect()}
    tex = {r.paper_id: r.tex for r in corpus(spark, SF).collect()}
    latex = {r.paper_id: r.latex for r in more.QUERIES["latex_reconstruction"](spark, SF).collect()}

    def normal(t):
        return " ".join(re.sub(r"(?<!\\)%.*$", "", t, flags=re.M).split()).lower()

    for i, r in rows.items():
        assert r.similarity == pytest.approx(difflib.SequenceMatcher(None, normal(tex[i]), normal(latex[i])).ratio())
        score = r.section_coverage * 10 + r.element_coverage * 15 + r.equation_coverage * 10 + r.label_resolution * 15 + 14 * r.hierarchy_ok + r.similarity * 20 + 5 * r.math_preserved + 3 + 3 * (r.label_resolution >= 0.9)
        assert (r.overall_score, r.can_reconstruct) == (int(score), r.similarity >= 0.7 and r.element_coverage >= 0.7)


def test_reconstruction_of_children_and_empty_sections(spark):
    tex = "\\begin{document}\\section{A}\\label{a}\\subsection{B % x\n}b\\section{C}c \\subsubsection{D}d\\end{document}"
    p = papers(spark, tex)
    text = B.reconstructed(p, D.section_tree(p)).first().latex
    assert text.split("\\maketitle\n")[1] == "\n\\section{A}\\label{a}\n\nb\nc \n\nd\n\n\\end{document}"
    bib = spark.createDataFrame([(0, 0, "k", {"author": "A", "year": "1"})], "paper_id long, pos int, key string, fields map<string,string>")
    assert "\\begin{thebibliography}{1}\n\\bibitem{k} A, 1\n\\end{thebibliography}" in B.reconstructed(p, D.section_tree(p), bib).first().latex


def test_spans_and_escapes(spark):
    from pyspark.sql import functions as F

    kinds = ["text", "math_inline", "math_display", "cite", "ref", "eqref", "label", "command"]
    rows = spark.createDataFrame([(k,) for k in kinds], "k string").select(B.span_latex(F.col("k"), F.lit("a_b")).alias("x"), F.size(B.span_refs(B.spans(F.lit("\\ref{a}")))).alias("n")).collect()
    assert [r.x for r in rows] == ["a\\_b", "$a_b$", "\\[a_b\\]", "\\cite{a_b}", "\\ref{a_b}", "\\eqref{a_b}", "\\label{a_b}", "\\a_b"]
    assert {r.n for r in rows} == {0}
    assert spark.range(1).select(B.latex_escape(F.lit("\\{~"))).first()[0] == "\\textbackslash\\{\\}\\{\\~\\{\\}".replace("\\~\\{\\}", "\\~{}")


def test_text_entities_with_overlapping_contents(spark):
    text = "A Title \nTheorem 1 says lemma 2 holds. And more.\n\nAssume that x. Assumption. " + "y" * 600
    got = E.text_entities(papers(spark, text).withColumnRenamed("tex", "text")).orderBy("type_ord", "idx").collect()
    assert [(r.type, r.idx, r.content[:20], r.pos) for r in got] == [
        ("theorem", 1, "says lemma 2 holds", 9), ("lemma", 1, "holds", text.index("lemma")), ("assumption", 1, "y" * 20, text.index("Assumption.")), ("assumption", 2, "x", text.index("Assume")),
    ]
    assert len(got[2].content) == 499  # 500 characters, the first of which is white space
    assert E.text_titles(papers(spark, text).withColumnRenamed("tex", "text")).first().title == "A Title"


def test_drivers_and_gates_of_grades(spark):
    p = papers(spark, "\\begin{document}\\section{A}\\begin{theorem}\\begin{a}\\begin{b}\\end{a}\\end{theorem}\\end{document}", "no document")
    rows, totals = A.parsed_papers(p, lambda q: '{"elements": [{"type": "theorem", "label": "t"}], "labels": ["t"]}')
    assert [(r.paper_id, r.label) for r in rows.orderBy("paper_id").collect()] == [(0, "t"), (1, "t")]
    assert [(r.chunks, r.elements, r.labels, r.sections) for r in totals.collect()] == [(1, 1, 1, 0)] * 2
    verdicts, areas, counts = A.hybrid_parsed(p)
    assert (verdicts.count(), areas.count(), counts.where("elements > 0").count()) == (1, 0, 1)
    stats = spark.createDataFrame([(1, "x", 3), (1, "y", 4)], "paper_id long, parser string, elements int")
    assert A.compared_parsers(stats, lambda q: '{"score": 7}' if "x: 3 elements\ny: 4 elements" in q else "").first().score == 7
    from pyspark.sql import functions as F

    g = spark.createDataFrame([(x,) for x in "ABCDF"], "g string").select(M.at_least(F.col("g"), "B").alias("b"), M.at_least(F.col("g")).alias("c"))
    assert [tuple(r) for r in g.collect()] == [(True, True), (True, True), (False, True), (False, False), (False, False)]
