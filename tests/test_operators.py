"""Hand-made documents, one for each quirk that results depend on."""

import pytest

from lemmata.operators import documents as D
from lemmata.operators import entities as E
from lemmata.operators import graph as G


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, tex string")


def test_entities_by_type_with_names_and_labels(spark):
    tex = r"\begin{lemma}\label{b}See \ref{a} \cref{a,b}.\end{lemma}\begin{theorem}[Main]\label{a}By \eqref{b}.\end{theorem}\begin{equation*}x\end{equation*}\begin{lemma}[Only]\end{lemma}"
    rows = E.latex_entities(papers(spark, tex)).orderBy("type_ord", "idx").collect()
    assert [(r.type, r.idx, r.name, r.label) for r in rows] == [("theorem", 1, "Main", "a"), ("lemma", 1, "Lemma 1", "b"), ("lemma", 2, "Only", None), ("equation_star", 1, "x", None)]
    assert rows[1].refs == ["a", "a,b"]
    assert rows[2].content == "Only"  # an empty body yields the name


def test_commands_take_their_argument_with_them(spark):
    rows = E.latex_entities(papers(spark, "\\begin{remark}A \\textbf{word} stays 5\\% % gone\nout\\end{remark}")).collect()
    assert rows[0].content == "A stays 5\\% out"


def test_null_and_empty_papers(spark):
    p = papers(spark, None, "", "no environments")
    assert E.latex_entities(p).count() == 0
    assert D.original_counts(p).count() == 3
    assert D.document_chunks(p).count() == 1


def test_duplicate_labels_collapse_and_self_references_stay(spark):
    tex = r"\begin{lemma}\label{a}\ref{a}\end{lemma}\begin{lemma}[Two]\label{a}\ref{zz}\end{lemma}"
    e = E.latex_entities(papers(spark, tex))
    n = G.nodes(e)
    assert [(r.node_id, r["name"]) for r in n.collect()] == [("a", "Two")]
    assert [(r.src, r.dst) for r in G.edges(e, n).collect()] == [("a", "a")]
    assert G.degrees(n, G.edges(e, n)).first().role == "inner"


def test_cited_by_in_order_of_first_reference(spark):
    tex = r"\begin{theorem}\label{t}x\end{theorem}\begin{lemma}\label{l}\ref{t}\end{lemma}\begin{definition}\label{d}\ref{t}\ref{t}\end{definition}\begin{remark}\ref{t}\end{remark}"
    assert [(r.label, r.cited_by) for r in E.cited_by(E.latex_entities(papers(spark, tex))).collect()] == [("t", "d,l")]


@pytest.mark.parametrize(("count", "score"), [(2, 0.3), (3, 0.6), (9, 0.6), (10, 0.9), (50, 0.9), (51, 1.0)])
def test_coverage_ladder(spark, count, score):
    tex = "".join(rf"\begin{{lemma}}\label{{x{i}}}y\end{{lemma}}" for i in range(count))
    assert float(G.quality(E.latex_entities(papers(spark, tex))).first().coverage) == score


def test_section_tree(spark):
    tex = r"\begin{document}lost\section{A}\label{sa}one\subsubsection{B}two\subsection*{C}three\subsubsection{D}four\section{E}\end{document}"
    rows = D.section_tree(papers(spark, tex)).orderBy("section_id").collect()
    assert [(r.title, r.level, r.parent_id) for r in rows] == [("A", 1, None), ("B", 3, 0), ("C", 2, 0), ("D", 3, 2), ("E", 1, None)]
    assert rows[0].label == "sa"
    assert rows[0].raw_content == r"one\subsubsection{B}two"  # a header two levels down stays in the content
    assert rows[2].raw_content == "three"


def test_intervals(spark):
    i = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2), (2, 3, 4)], "paper_id long, start int, end int")
    assert sorted(tuple(r) for r in D.merged_intervals(i).select("paper_id", "start", "end").collect()) == [(1, 0, 7), (1, 9, 10), (2, 3, 4)]


def test_review_without_any_feature(spark):
    r = spark.createDataFrame([(1, "审稿"), (2, None)], "review_id long, text string")
    assert {(x.overall_score, x.grade, x.is_acceptable) for x in D.review_score(D.review_features(r)).collect()} == {(5, "F", False)}


def test_routing(spark):
    i = spark.createDataFrame([("https://arxiv.org/abs/2512.19344v1",), ("2603.03027",), ("a.tex",), ("b.pdf",), ("c.doc",)], "input string")
    assert [(r.kind, r.arxiv_id) for r in D.routed(i).collect()] == [("arxiv", "2512.19344v1"), ("arxiv", "2603.03027"), ("latex", None), ("pdf", None), ("unsupported", None)]
