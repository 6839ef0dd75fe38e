"""Elements, reconstruction, tree scores, problem areas and file sources on hand-made papers."""

import difflib
import random
import re
import time

from lemmata.operators import documents as D
from lemmata.operators import rebuild as B
from lemmata.operators import tree as R
from lemmata.sources import latex as L

TEX = (
    "\\documentclass{article}\\newcommand{\\foo}[2]{bar}\\newcommand{\\R}{real}\\begin{document}\\title{T}\\section{A}\\label{sa}\n\n"
    "Words with $x$.\n\n\\begin{theorem}[Main]\\label{t}Body\\begin{proof}P\\end{proof} end\\end{theorem}\\begin{equation}a\\end{equation}"
    "\\section{B}See \\ref{t} and \\ref{no}.\\begin{theorem}[Main]\\label{t}Body\\begin{proof}P\\end{proof} end\\end{theorem}\\begin{equation*}b\\end{equation*}\\begin{theorem}New\\end{theorem}\\end{document}"
)


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, tex string")


def test_elements_once_with_proofs_and_a_shared_equation_counter(spark):
    e = R.section_elements(D.section_tree(papers(spark, TEX, None, ""))).orderBy("section_id", "type_ord", "pos").collect()
    assert [(r.section_id, r.type, r.number, r.label, r["name"], r.proof) for r in e] == [(0, "theorem", 1, "t", "Main", "P"), (0, "equation", 1, None, "", None), (1, "theorem", 2, None, "", None), (1, "equation_star", 2, None, "", None)]
    assert e[0].content == "\\label{t}Body end"


def test_custom_commands(spark):
    assert [tuple(r)[2:] for r in R.custom_commands(papers(spark, TEX)).orderBy("pos").collect()] == [("\\foo", "2", "bar"), ("\\R", "0", "real")]


def test_tree_quality_of_a_paper_and_its_reconstruction(spark):
    p = papers(spark, TEX, None, "")
    s = D.section_tree(p)
    e = R.section_elements(s)
    latex = B.reconstructed(p, s)
    c = R.tree_coverage(p, s, e)
    rows = {r.paper_id: r for r in R.tree_quality(p, c, latex, e).collect()}
    assert (rows[0].section_coverage, rows[0].equation_coverage, rows[0].label_resolution, rows[0].hierarchy_ok) == (1.0, 2.0, 0.5, True)
    squeeze = lambda t: re.sub(r"\s+", " ", re.sub(r"(?<!\\)%[^\n]*", "", t)).strip().lower()
    text = latex.where("paper_id = 0").first().latex
    assert rows[0].similarity == difflib.SequenceMatcher(None, squeeze(TEX), squeeze(text)).ratio()
    assert rows[0].math_preserved
    assert rows[2].section_coverage == 0
    # A section writes its content, and its header only where it has none.
    assert text.index("Words with $x$.") < text.index("\\begin{theorem}[Main]") < text.index("See \\ref{t}") and "\\section{A}" not in text
    assert (rows[0].citation_coverage, rows[0].theorems_complete, rows[0].no_orphans, rows[0].no_dangling) == (0.0, False, True, False)


def stack(tex):
    open_, bad = [], []
    for m in re.finditer(r"\\(begin|end)\{([^}]+)\}", tex):
        if m[1] == "begin":
            open_.append(m[2])
        elif open_ and open_[-1] == m[2]:
            open_.pop()
        else:
            bad.append((max(0, m.start() - 500), min(len(tex), m.start() + 500)))
    return bad


def test_problem_areas_are_those_of_a_stack(spark):
    texts = ["\\end{a}", "\\begin{a}x\\begin{b}y\\end{a}\\end{b}\\end{a}", TEX, "x" * 900 + "\\begin{a}" + "é" * 700 + "\\end{b}" + "z" * 900 + "\\end{a}\\end{a}", ""]
    got = R.problem_areas(papers(spark, *texts, None)).collect()
    assert sorted((r.paper_id, r.start, r.end) for r in got) == sorted((i, *b) for i, t in enumerate(texts) for b in stack(t))


def test_files_and_main_file(spark, tmp_path):
    (tmp_path / "b.tex").write_bytes(b"\\begin{document}\xffok\\end{document}")
    (tmp_path / "a.tex").write_text("part")
    (tmp_path / "c.txt").write_text("other")
    files = L.latex_files(spark, str(tmp_path)).selectExpr("1 AS paper_id", "path", "tex")
    assert files.count() == 2
    assert L.main_files(files).first().tex == "\\begin{document}ok\\end{document}"




def test_clients_are_injected(spark):
    rows = L.answered(spark.createDataFrame([("a",), ("bad",)], "prompt string"), lambda p: p.upper() if p != "bad" else 1 / 0).orderBy("prompt").collect()
    assert [(r.answer, (r.error or "")[:4]) for r in rows] == [("A", ""), (None, "Zero")]


def test_sequence_ratio_is_that_of_difflib():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("aaaaabbbbcccc  defghijklmnopqrstuvwxyz0123456789éß\U0001f600") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("abc", ""), ("aab", "aba"), ("ab" * 150, "ab" * 140)]
    for n in (3, 40, 199, 200, 450) * 20:
        a = text(n)
        b = a
        for _ in range(rnd.randrange(6)):
            i, j = sorted(rnd.randrange(len(b) + 1) for _ in range(2))
            b = b[:i] + rnd.choice(("", b[i:j] * 2, text(9))) + b[j:]
        pairs.append((a, b))
    assert [R.sequence_ratio(*p) for p in pairs] == [difflib.SequenceMatcher(None, *p).ratio() for p in pairs]


def test_tree_quality_derives_the_sections_three_times(spark):
    from lemmata.plans import more

    plan = lambda name: more.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("tree_quality", "tree_summaries"):
        assert plan(name).count("posexplode(") <= 3


def test_pipeline_status_derives_the_sections_three_times(spark):
    from lemmata.plans import queries

    assert queries.QUERIES["pipeline_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") <= 3


def test_similarity_takes_under_a_fourth_of_difflibs_time():
    rnd = random.Random(9)
    piece = lambda: f"text about item {rnd.randrange(2000)} with $x_{{{rnd.randrange(8)}}}$ and \\cite{{k{rnd.randrange(5)}}}. \\begin{{lemma}}let $y_{{{rnd.randrange(2000)}}}$ hold (item).\\end{{lemma}} "
    pairs = []
    for _ in range(60):
        parts = [piece() for _ in range(9)]
        pairs.append(("".join(parts), "".join(p for i, p in enumerate(parts) if i not in (2, 3, 7)) + parts[2] + "\0"))
    began = time.process_time()
    ours = [R.sequence_ratio(*p) for p in pairs]
    middle = time.process_time()
    assert ours == [difflib.SequenceMatcher(None, *p).ratio() for p in pairs]
    assert 4 * (middle - began) < time.process_time() - middle


def test_gates_compute_no_similarity_where_none_can_pass(spark):
    p = papers(spark, TEX, "\\begin{document}\\section{A}Words\\begin{theorem}T\\end{theorem}\\end{document}")
    s = D.section_tree(p)
    c = R.tree_coverage(p, s, R.section_elements(s), statements=True)
    whole, gated = ({r.paper_id: r for r in R.tree_quality(p, c, B.reconstructed(p, s), **x).collect()} for x in ({}, {"gates_only": True}))
    for i, row in whole.items():
        skipped = row.element_coverage < 0.7
        assert (gated[i].similarity, gated[i].grade) == ((None, None) if skipped else (row.similarity, row.grade))
        assert gated[i].can_reconstruct == row.can_reconstruct
    assert {r.element_coverage < 0.7 for r in whole.values()} == {False, True}
