"""Reports, exports, assisted steps, archives and streams on hand-made papers."""

import io
import json
import tarfile
import xml.etree.ElementTree as ET

from lemmata.operators import assisted as A
from lemmata.operators import documents as D
from lemmata.operators import entities as E
from lemmata.operators import graph as G
from lemmata.operators import reports as R
from lemmata.sources import latex as L
from lemmata.streaming import ingest

TEX = (
    "\\begin{document}\\title{On <sums>}\\author{A}\\author{B}\\section{S}\\begin{definition}[D & \x02co]\\label{d}Body\\end{definition}"
    "\\begin{theorem}\\label{t}By \\ref{d}.\\begin{proof}\\begin{x}\\end{x}\\end{proof}\\end{theorem}\\begin{lemma}Alone\\end{lemma}\\end{document}"
)


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id long, tex string")


def entities(spark):
    return E.latex_entities(papers(spark, TEX, None, ""))


def test_graphml_is_xml_without_control_characters(spark):
    n = G.nodes(entities(spark))
    root = ET.fromstring(R.graphml(n, G.edges(entities(spark), n)).first().graphml)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    found = {x.get("id"): x.find(f"{ns}data[@key='name']").text for x in root.iter(f"{ns}node")}
    assert found["d"] == "D & co" and len(found) == 3
    assert [(x.get("source"), x.get("target")) for x in root.iter(f"{ns}edge")] == [("t", "d")]


def test_html_embeds_the_graph(spark):
    n = G.nodes(entities(spark))
    page = R.html(n, G.edges(entities(spark), n)).first().html
    data = json.loads(page.split('id="graph">')[1].split("</script>")[0])
    assert data["links"] == [{"source": "t", "target": "d"}] and len(data["nodes"]) == 3


def test_analysis_reports_of_papers_with_and_without_entities(spark):
    p = papers(spark, TEX, None, "")
    found = {r.paper_id: json.loads(r.json) for r in R.analysis_json(p, entities(spark)).collect()}
    assert found[0]["authors"] == ["A", "B"] and found[0]["sections"] == ["S"] and found[0]["statistics"]["total"] == 3
    assert [(x["label"], x["dependencies"], x["cited_by"]) for x in found[0]["entities"]] == [("d", [], ["t"]), ("t", ["d"], []), (None, [], [])]
    assert found[2]["statistics"]["total"] == 0
    text = {r.paper_id: r.markdown for r in R.analysis_markdown(p, entities(spark)).collect()}
    assert text[0].startswith("# On <sums>\n\n**Authors:** A, B\n\n") and "## Theorems\n\n### Theorem 1\n*Label: `t`*\n*Depends on: d*\n\n" in text[0]
    assert "**Total entities:** 0" in text[2]


def test_tree_json_and_unified_diff(spark):
    from lemmata.operators import tree

    s = D.section_tree(papers(spark, TEX))
    data = json.loads(R.tree_json(s, tree.section_elements(s)).first().json)
    assert [x["type"] for x in data["sections"][0]["elements"]] == ["theorem", "definition", "lemma"]
    d = spark.createDataFrame([("a\nb", "a\nc"), (None, "")], "a string, b string").select(R.unified_diff("a", "b").alias("d")).collect()
    assert d[0].d.split("\n")[-2:] == ["-b", "+c"] and d[1].d == ""


def test_review_prompts_and_texts(spark):
    prompts = A.review_prompts(papers(spark, TEX, ""), entities(spark))
    found = {r.paper_id: r.prompt for r in prompts.collect()}
    assert "Definition 1 (label d): " in found[0] and "Theorem 1 (label t): " in found[0] and "\n  depends on: d\n  cited by: none" in found[0]
    assert "references in or out: 1; with both: 0" in found[0]
    assert "No theorems extracted" in found[1] and "Title not extracted" in found[1]
    assert {r.text for r in A.reviews(prompts).collect()} == {A.SKIPPED}
    assert {r.text for r in A.reviews(prompts, lambda p: 1 / 0).collect()} == {A.FAILED}
    assert {r.text for r in A.reviews(prompts, A.first_of(lambda p: 1 / 0, lambda p: "fine")).collect()} == {"fine"}


def test_verdicts_areas_and_chunks_by_a_client(spark):
    p = papers(spark, TEX, "\\begin{a}x\\end{b}")
    c = D.regex_candidates(p)
    assert [r.verdict.issues for r in A.verified(c).collect()] == [["Not verified by LLM"]]
    assert [r.verdict.issues for r in A.verified(c, lambda _: "no JSON").collect()] == [["Not verified by LLM"]]
    assert [r.verdict.is_valid for r in A.verified(c, lambda _: '{"is_valid": false}').collect()] == [False]
    areas = spark.createDataFrame([(1, 0, 10), (1, 5, 17)], "paper_id long, start int, end int")
    read = A.parsed_areas(p, areas, lambda q: '[{"type": "lemma", "label": "' + ("whole" if "\\begin{a}x\\end{b}" in q else "part") + '"}]').collect()
    assert [(r.start, r.element.type, r.element.label) for r in read] == [(0, "lemma", "whole")]
    assert A.parsed_areas(p, areas).count() == 0
    chunks = D.document_chunks(p)
    assert {tuple(map(len, r[2:])) for r in A.parsed_chunks(chunks).collect()} == {(0,) * 6}
    assert {tuple(r.labels) for r in A.parsed_chunks(chunks, lambda q: '{"labels": ["z"]}').collect()} == {("z",)}
    texts = p.selectExpr("paper_id", "tex AS text")
    assert {(r.score, r.grade) for r in A.evaluated(texts, "Judge this.").collect()} == {(50.0, "C")}
    assert {(r.score, r.grade) for r in A.evaluated(texts, "Judge this.", lambda q: '{"score": 91, "grade": "A"}').collect()} == {(91.0, "A")}


def test_gates(spark):
    tree = spark.createDataFrame([(1, False, "A"), (2, True, "C"), (3, True, "B"), (4, True, "A"), (5, True, "A")], "paper_id long, can_reconstruct boolean, grade string")
    r = spark.createDataFrame([(1, "A"), (2, "A"), (3, "C"), (4, "B")], "paper_id long, grade string")
    found = {x.paper_id: x.status for x in A.pipeline_status(tree, r).collect()}
    assert found == {1: "not_reconstructable", 2: "tree_failed", 3: "review_failed", 4: "passed", 5: "review_failed"}


def archive(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name.replace("_", "."))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_pages_and_fallbacks(spark):
    data = archive(a_tex=b"part", b_tex=b"\\begin{document}\xffok\\end{document}", c_txt=b"other")
    a = spark.createDataFrame([(1, data), (2, b"junk"), (3, None)], "paper_id long, content binary")
    files = L.archive_files(a)
    assert files.count() == 2
    assert [tuple(r) for r in L.main_files(files).collect()] == [(1, "b.tex", "\\begin{document}ok\\end{document}")]
    got = L.fetched(spark.createDataFrame([(1, "x"), (2, "bad")], "paper_id long, key string"), lambda k: {"x": b"y"}[k]).orderBy("paper_id").collect()
    assert [r.content and bytes(r.content) for r in got] == [b"y", None]
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "paper_id long, page int, text string")
    assert L.joined_pages(pages).first().text == "a\n\nb\n\n"
    t = spark.createDataFrame([(None, " ", "c"), ("a", "b", "c")], "x string, y string, z string").select(L.first_text("x", "y", "z").alias("text"))
    assert sorted(r.text for r in t.collect()) == ["a", "c"]
    s = spark.createDataFrame([("\\section{A}",), ("plain",), (None,)], "text string")
    assert [r.is_latex for r in L.sniffed(s).collect()] == [True, False, False]


def test_source_or_pdf(spark):
    data = archive(a_tex=b"\\begin{document}x\\end{document}")
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "paper_id long, key string")
    got = L.source_or_pdf(ids, lambda k: {"a": data, "b": b"junk"}[k], lambda k: {"b": "päge".encode()}[k])
    assert [tuple(r) for r in got.orderBy("paper_id").collect()] == [(1, "\\begin{document}x\\end{document}", "source"), (2, "päge", "pdf")]


def test_stream_of_files_has_each_paper_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.tex").write_text(TEX)
        ingest.append(ingest.paper_stream(spark, str(source)), E.latex_entities, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (out.count(), out.select("paper_id").distinct().count()) == (6, 2)
