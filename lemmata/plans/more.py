"""More queries over the derived corpus, and the same in DuckDB SQL: messages, reconstruction, chunks, text mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import assisted as A
from ..operators import documents as D
from ..operators import entities as E
from ..operators import graph as G
from ..operators import messages as M
from ..operators import rebuild as B
from ..operators import reports
from ..operators import tree as R
from . import queries as q
from .corpus import PAPERS_SQL, papers

#: Parts of a review by its id; one in three lacks the third.
PARTS = """concat('## 1. Summary and Main Contributions', chr(10), coalesce(text, ''), chr(10), '## 2. Analysis of Main Proof Methods fine ', chr(10),
 CASE conv_id % 3 WHEN 0 THEN '' ELSE '## 3. Specific ERRORS and Issues: one' END, chr(10), '## 4. Citation and Bibliography Issues none', chr(10), '## 5. Suggestions for Improvement more', chr(10))"""
#: Every third paper has no document environment.
BARE = "CASE paper_id % 3 WHEN 0 THEN replace(tex, 'begin{document}', 'begin{docum}') ELSE tex END"
CHUNKS = (800, 100, 50)


def _graph_quality(f):
    return q._entities(lambda e: f(G.quality(e)))


def _tree(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = papers(spark, sf_dir)
        s = D.section_tree(p)
        return f(p, s, R.section_elements(s))

    return run


def _reviews(f):
    return lambda spark, sf_dir: f(D.review_features(q.reviews(spark, sf_dir)))


def _bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q._table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), "p_brand", "p_name", "p_type")
    text = lambda c: F.col(c).cast("string")
    fields = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("author"), text("p_brand"), F.lit("title"), text("p_name"))).otherwise(F.create_map(F.lit("title"), text("p_name"), F.lit("journal"), text("p_type"), F.lit("year"), F.lit("2001")))
    return rows.select("key", B.bibliography_entry(fields).alias("entry"), B.bibtex(F.lit("article"), F.col("key"), fields).alias("bibtex"))


def _implied(e: DataFrame) -> DataFrame:
    return E.implied_dependencies(e.withColumn("content", F.concat("content", F.lit(" by Theorem "), F.col("idx").cast("string"))))


def _joined(review: DataFrame) -> DataFrame:
    return M.review_notes(review).select("review_id", F.array_join("issues", "|").alias("issues"), F.array_join("strengths", "|").alias("strengths"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q._table(spark, sf_dir, "documents")


QUERIES = {
    "review_issues": _reviews(_joined),
    "review_acceptance": _reviews(lambda f: D.review_score(f, "B").select("review_id", F.col("is_acceptable").alias("accepted"))),
    "review_summaries": _reviews(lambda f: M.review_summary(D.review_score(f), M.review_notes(f))),
    "review_parts": lambda spark, sf_dir: D.review_parts(q._table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"), F.expr(PARTS).alias("text"))),
    "graph_messages": _graph_quality(M.graph_messages),
    "graph_recommendation_texts": _graph_quality(lambda g: M.recommendation_texts(G.recommendations(g))),
    "graph_summaries": _graph_quality(M.graph_summary),
    "graph_layout": q._on_graph(lambda n, e: G.layout(n)),
    "graph_files": q._entities(G.graph_files),
    "loaded_elements": _tree(lambda p, s, e: reports.loaded_trees(reports.tree_json(s, e))[1].drop("type_ord", "pos")),
    "entity_index": q._entities(lambda e: E.last_by_key(e).select("paper_id", "type", "idx", "name", "label")),
    "entities_by_type": q._entities(lambda e: reports.by_type(e, "lemma").select("paper_id", "idx", "name")),
    "entity_by_label": q._entities(lambda e: reports.by_label(e, "e2").select("paper_id", "type", "idx", "name")),
    "statistics_json": q._entities(lambda e: reports.row_json(E.category_statistics(e))),
    "section_paths": _tree(lambda p, s, e: B.section_paths(s)),
    "preambles": q._papers(D.preambles),
    "distinct_names": q._papers(lambda p: D.distinct_names(D.regex_candidates(p))),
    "tree_issues": _tree(lambda p, s, e: M.tree_issues(R.tree_coverage(p, s, e))),
    "unresolved_references": _tree(lambda p, s, e: R.unresolved_references(p, B.label_map(s, e))),
    "label_map": _tree(lambda p, s, e: B.label_map(s, e)),
    "orphan_elements": _tree(lambda p, s, e: B.orphans(e, s.where("section_id % 3 > 0")).select("paper_id", "section_id", "type", "number")),
    "flat_entities": _tree(lambda p, s, e: B.flat_entities(e)),
    "tree_nodes": _tree(lambda p, s, e: B.tree_nodes(e)),
    "tree_edges": _tree(lambda p, s, e: B.tree_edges(e)),
    "latex_reconstruction": _tree(lambda p, s, e: B.reconstructed(p, s)),
    "tree_quality": _tree(q.tree_quality),
    "tree_summaries": _tree(lambda p, s, e: M.tree_summary(q.tree_quality(p, s, e))),
    "document_body": q._papers(lambda p: D.document_body(p.withColumn("tex", F.expr(BARE)))),
    "body_metadata": q._papers(lambda p: D.body_metadata(p).withColumn("authors", F.array_join("authors", "; "))),
    "document_chunks": q._papers(lambda p: D.document_chunks(p, *CHUNKS)),
    "chunk_totals": q._papers(lambda p: A.parsed_papers(p)[1]),
    "text_titles": lambda spark, sf_dir: E.text_titles(_documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), "text")),
    "text_entities": lambda spark, sf_dir: E.text_entities(_documents(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), F.expr(q.NUMBERED).alias("text"))).drop("type_ord"),
    "entity_positions": q._papers(E.entity_positions),
    "implied_dependencies": q._entities(_implied),
    "latex_escapes": lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", B.latex_escape(F.col("text")).alias("text")),
    "bibliography_entries": _bibliography,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _percent(c: str) -> str:
    return f"printf('%.1f%%', round_even(100 * {c}, 1))"


def _in_words(template: str) -> str:
    import re

    parts = []
    for text, name, kind in re.findall(r"([^{]+)|\{(\w+):?(\d?)\}", template):
        parts.append(_quoted(text) if text else _percent(name) if kind == "1" else f"printf('%.4f', round_even({name}, 4))" if kind else f"CAST({name} AS VARCHAR)")
    return " || ".join(parts)


def _case(ladder: tuple, of) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {of(s, t)}" for c, s, t in ladder) + " END"


_SCORES = ("c1", "c2", "c3", "c4", "c5")
_MESSAGES = f"""{q._QUALITY}, named AS (SELECT *, {q._ALL7} AS named FROM quality), messages AS (""" + " UNION ALL ".join(
    f"SELECT paper_id, {i} AS pos, '{m.removesuffix('_score')}' AS metric, {c} / 100.0::DOUBLE AS score, {_case(GM, lambda s, t: _quoted(s))} AS status, {_case(GM, lambda s, t: _in_words(t))} AS message, repeat('█', {c} // 10) || repeat('░', 10 - {c} // 10) AS bar FROM named"
    for i, ((m, GM), c) in enumerate(zip(M.GRAPH_MESSAGES.items(), _SCORES, strict=True))
) + ")"
_NOTES = (
    "concat_ws('|', " + ", ".join(f"CASE WHEN NOT {f} THEN {_quoted(i)} END" for f, i, _ in M.REVIEW_NOTES) + ") AS issues, "
    "concat_ws('|', " + ", ".join(f"CASE WHEN {f} THEN {_quoted(s)} END" for f, _, s in M.REVIEW_NOTES if s) + ") AS strengths"
)
_NEWLINE = "chr(10)"
_BULLETS = lambda c, most: f"CASE WHEN {c} = '' THEN '' ELSE chr(10) || list_aggregate(list_transform(string_split({c}, '|')[:{most}], lambda x: '  - ' || x), 'string_agg', chr(10)) END"
_LABELLED = f"""{q._ELEMENTS}, labelled AS (SELECT paper_id, label, type AS kind, section_id, CAST(NULL AS INTEGER) AS number, -1 AS type_ord, -1 AS pos FROM sections
 UNION ALL SELECT paper_id, nullif(regexp_extract(CASE WHEN g2 <> '' THEN g2 ELSE g1 END, '\\\\label\\{{(.*?)\\}}', 1), ''), type, section_id, number, type_ord, pos FROM bodies),
label_map AS (SELECT paper_id, label, kind, CAST(section_id AS INTEGER) AS section_id, CAST(number AS INTEGER) AS number FROM labelled WHERE label <> ''
 QUALIFY row_number() OVER (PARTITION BY paper_id, label ORDER BY section_id DESC, type_ord DESC, pos DESC) = 1)"""
_PRE = r"regexp_extract(tex, '(?s)^(.*?)\\begin\{document\}', 1)"
_PKG = r"\\usepackage(?:\[(.*?)\])?\{(.*?)\}"
_BODY = r"coalesce(regexp_extract(tex, '(?s)\\begin\{document\}(.*?)\\end\{document\}', 1), '')"
_TITLE = q._clean(r"regexp_extract(body, '(?s)\\title\{(.*?)\}', 1)", False)
_AUTHORS = rf"list_transform(regexp_extract_all(body, '(?s)\\author\{{(.*?)\}}', 1), lambda a: {q._clean('a', False)})"
_ABSTRACT = q._clean(r"regexp_extract(body, '(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}', 1)", False)
_LIST = lambda c: f"list_aggregate({c}, 'string_agg', chr(10))"
_REBUILT = rf"""{q._TREE},
raws AS (SELECT *, p || more AS raw, '\' || type || '{{' || title || '}}' AS header FROM sections),
cuts AS (SELECT s.paper_id, s.section_id, min(nullif(instr(s.raw, c.header), 0)) AS stop FROM raws s JOIN raws c ON c.paper_id = s.paper_id AND c.parent_id = s.section_id GROUP BY 1, 2),
texts AS (SELECT raws.*, CASE WHEN raw = '' THEN header || CASE WHEN label <> '' THEN '\label{{' || label || '}}' ELSE '' END WHEN stop IS NOT NULL THEN left(raw, stop - 1) ELSE raw END AS t FROM raws LEFT JOIN cuts USING (paper_id, section_id)),
written AS (SELECT paper_id, string_agg(CASE WHEN parent_id IS NULL THEN chr(10) ELSE chr(10) || chr(10) END || t, '' ORDER BY section_id) AS sections FROM texts GROUP BY 1),
front AS (SELECT paper_id, {_PRE} AS pre, body FROM papers JOIN b USING (paper_id)),
heads AS (SELECT paper_id, {_TITLE} AS title, {_AUTHORS} AS authors, {_ABSTRACT} AS abstract,
 list_transform(regexp_extract_all(pre, '{_PKG}'), lambda m: '\usepackage' || CASE WHEN regexp_extract(m, '{_PKG}', 1) <> '' THEN '[' || regexp_extract(m, '{_PKG}', 1) || ']' ELSE '' END || '{{' || regexp_extract(m, '{_PKG}', 2) || '}}') AS pkgs,
 list_transform(regexp_extract_all(pre, '{q._COMMAND}'), lambda m: '\newcommand{{' || regexp_extract(m, '{q._COMMAND}', 1) || '}}[' || coalesce(nullif(regexp_extract(m, '{q._COMMAND}', 2), ''), '0') || ']{{' || regexp_extract(m, '{q._COMMAND}', 3) || '}}') AS cmds,
 list_filter(string_split(pre, chr(10)), lambda x: NOT contains(x, 'usepackage') AND NOT contains(x, 'documentclass')) AS rest FROM front)
SELECT paper_id, {_LIST("['\\documentclass[12pt]{article}', '% Preamble'] || pkgs || CASE WHEN len(cmds) > 0 THEN ['', '% Custom commands'] ELSE [] END || cmds || ['', '% Additional preamble'] || rest || ['', '\\begin{document}', '']"
 " || CASE WHEN title <> '' THEN ['\\title{' || title || '}'] ELSE [] END || CASE WHEN len(authors) > 0 THEN ['\\author{' || list_aggregate(authors, 'string_agg', ' \\and ') || '}'] ELSE [] END || ['\\maketitle', '']"
 " || CASE WHEN abstract <> '' THEN ['\\begin{abstract}', abstract, '\\end{abstract}', ''] ELSE [] END")} || coalesce(sections, '') || chr(10) || chr(10) || '\end{{document}}' AS latex FROM heads LEFT JOIN written USING (paper_id)"""


def _packed(name: str, pieces: str, key: str, most: int, least: int) -> str:
    """CTEs: rows of ``pieces`` (key..., i, piece), packed greedily into ``name`` (key..., chunk, text)."""
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"p.{k} = f.{k}" for k in keys)
    ends = f"f.chars + length(p.piece) > {most} AND f.chars > {least}"
    return f"""{name}_f AS (SELECT {key}, i, CAST(length(piece) AS BIGINT) AS chars, 0 AS chunk FROM {pieces} WHERE i = 0
 UNION ALL SELECT {', '.join(f'p.{k}' for k in keys)}, p.i, CASE WHEN {ends} THEN length(p.piece) ELSE f.chars + length(p.piece) END, f.chunk + CASE WHEN {ends} THEN 1 ELSE 0 END FROM {name}_f f JOIN {pieces} p ON {on} AND p.i = f.i + 1),
{name} AS (SELECT {key}, chunk, string_agg(piece, '' ORDER BY i) AS text FROM {name}_f JOIN {pieces} USING ({key}, i) GROUP BY {key}, chunk HAVING string_agg(piece, '' ORDER BY i) <> '')"""


_SECTION = r"\\section\{[^}]+\}"


def _chunked(source: str, most: int, least: int, least_split: int) -> str:
    """CTEs up to ``chunks`` (paper_id, c1, c2, text) of a table of (paper_id, tex)."""
    return rf"""cutup AS (SELECT paper_id, regexp_extract_all(tex, '{_SECTION}') AS h, regexp_split_to_array(tex, '{_SECTION}') AS s FROM {source}),
pieces AS (SELECT paper_id, unnest(range(len(s))) AS i, CASE WHEN unnest(range(len(s))) = 0 THEN '' ELSE h[unnest(range(len(s)))] END || s[unnest(range(len(s))) + 1] AS piece FROM cutup),
{_packed('first', 'pieces', 'paper_id', most, least)},
again AS (SELECT paper_id, chunk AS c1, regexp_extract_all(text, '{D.CUT_ENVIRONMENTS}') AS h, regexp_split_to_array(text, '{D.CUT_ENVIRONMENTS}') AS s FROM first WHERE length(text) > {most}),
parts AS (SELECT paper_id, c1, unnest(range(len(s) + len(h))) AS i, CASE WHEN unnest(range(len(s) + len(h))) % 2 = 0 THEN s[unnest(range(len(s) + len(h))) // 2 + 1] ELSE h[unnest(range(len(s) + len(h))) // 2 + 1] END AS piece FROM again),
{_packed('second', 'parts', 'paper_id, c1', most, least_split)},
chunks AS (SELECT paper_id, chunk AS c1, 0 AS c2, text FROM first WHERE length(text) <= {most} UNION ALL SELECT paper_id, c1, chunk, text FROM second)"""


_CHUNKED = f"""WITH RECURSIVE {PAPERS_SQL}, {_chunked('papers', *CHUNKS)}
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY c1, c2) - 1 AS INTEGER) AS chunk_index, text AS chunk FROM chunks"""
_FOUND = r"\\(begin|end)\{([^}]+)\}"
_AREAS = rf"""WITH RECURSIVE {PAPERS_SQL}, m AS (SELECT paper_id, replace(tex, '\end{{lemma}}', '\end{{theorem}}') AS tex FROM papers),
k AS (SELECT paper_id, length(tex) AS n, regexp_extract_all(tex, '{_FOUND}') AS t, regexp_split_to_array(tex, '{_FOUND}') AS s FROM m), k2 AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM k),
tokens AS (SELECT paper_id, i, regexp_extract(t[i], '{_FOUND}', 1) = 'begin' AS begins, regexp_extract(t[i], '{_FOUND}', 2) AS name, CAST(list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(t[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM k2),
f AS (SELECT paper_id, n, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS open, false AS bad, CAST(0 AS BIGINT) AS start FROM k
 UNION ALL SELECT f.paper_id, f.n, x.i, CASE WHEN x.begins THEN list_append(f.open, x.name) WHEN f.open[-1] = x.name THEN f.open[:len(f.open) - 1] ELSE f.open END, NOT x.begins AND coalesce(f.open[-1] <> x.name, true), x.start FROM f JOIN tokens x ON x.paper_id = f.paper_id AND x.i = f.i + 1),
areas AS (SELECT paper_id, greatest(start - 500, 0) AS a, least(start + 500, n) AS b FROM f WHERE bad),
reach AS (SELECT *, max(b) OVER (PARTITION BY paper_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM areas),
islands AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM reach),
whole AS (SELECT paper_id, min(a) AS a, max(b) AS b FROM islands GROUP BY paper_id, island)
SELECT paper_id, CAST(a AS INTEGER) AS "start", CAST(b AS INTEGER) AS "end" FROM whole QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY a, b) <= 5"""
_ENTRY = """'### ' || name || chr(10) || CASE WHEN label IS NOT NULL THEN '*Label: `' || label || '`*' || chr(10) ELSE '' END || CASE WHEN len(refs) > 0 THEN '*Depends on: ' || list_aggregate(refs, 'string_agg', ', ') || '*' || chr(10) ELSE '' END
 || chr(10) || left(CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END, 300) || '...' || chr(10) || chr(10)"""
_MARKDOWN = f"""WITH meta AS ({q.SQL['paper_metadata']}), counts AS ({q.SQL['category_statistics']}), listed AS (WITH {q.ENTITIES_SQL} SELECT paper_id, type, string_agg({_ENTRY}, '' ORDER BY idx) AS t FROM entities GROUP BY 1, 2),
kinds AS (SELECT paper_id, {' || '.join(f"coalesce(max(CASE WHEN type = '{k}' THEN '## {k.capitalize()}s' || chr(10) || chr(10) || t END), '')" for k in P.CATEGORIES)} AS t FROM listed GROUP BY 1)
SELECT meta.paper_id, '# ' || title || chr(10) || chr(10) || CASE WHEN authors <> '' THEN '**Authors:** ' || replace(authors, '; ', ', ') || chr(10) || chr(10) ELSE '' END
 || CASE WHEN abstract <> '' THEN '## Abstract' || chr(10) || chr(10) || abstract || chr(10) || chr(10) ELSE '' END || '## Statistics' || chr(10) || chr(10)
 || {' || '.join(f"'- **{c.capitalize()}:** ' || coalesce({c}, 0) || chr(10)" for c in P.CATEGORIES.values())} || chr(10) || '**Total entities:** ' || coalesce(total, 0) || chr(10) || chr(10) || coalesce(kinds.t, '') AS markdown
FROM meta LEFT JOIN counts USING (paper_id) LEFT JOIN kinds USING (paper_id)"""
_CLASSES = " || chr(10) || ".join(_quoted(f"    classDef {t} fill:{c},stroke:#333,stroke-width:2px,color:#fff;") for t, c in P.COLORS.items())
_FILES = f"""WITH {q._GRAPH}, firsts AS (SELECT paper_id, node_id, min(type_ord::BIGINT * 1000000 + idx) AS first FROM entities GROUP BY 1, 2),
spots AS (SELECT paper_id, node_id AS src, ref AS dst, min((type_ord::BIGINT * 1000000 + idx) * 100000 + pos) AS spot FROM deps GROUP BY 1, 2, 3),
written AS (SELECT n.paper_id, 0 AS kind, first, 0 AS spot, '  "' || replace(node_id, '"', '\\"') || '" [label="' || replace(replace(name, '"', '\\"'), chr(10), ' ') || '", fillcolor="' || {q._COLOR} || '", style="filled,rounded"];' AS dot,
  '    ' || {q._SAFE('node_id')} || '["' || replace(replace(replace(replace(name, '[', '&#91;'), ']', '&#93;'), '(', '&#40;'), ')', '&#41;') || '"]'
  || CASE WHEN type IN ({', '.join(f"'{t}'" for t in P.COLORS)}) THEN chr(10) || '    class ' || {q._SAFE('node_id')} || ' ' || type || ';' ELSE '' END AS flow FROM nodes n JOIN firsts USING (paper_id, node_id)
 UNION ALL SELECT e.paper_id, 1, first, spots.spot, '  "' || replace(e.src, '"', '\\"') || '" -> "' || replace(e.dst, '"', '\\"') || '";', '    ' || {q._SAFE('e.src')} || ' --> ' || {q._SAFE('e.dst')}
 FROM edges e JOIN spots ON spots.paper_id = e.paper_id AND spots.src = e.src AND spots.dst = e.dst JOIN firsts ON firsts.paper_id = e.paper_id AND firsts.node_id = e.src)
SELECT paper_id, 'digraph MathDependencies {{' || chr(10) || '  rankdir=TB;' || chr(10) || '  node [shape=box, style=rounded, fontname="Arial"];' || chr(10) || string_agg(dot, chr(10) ORDER BY kind, first, spot) || chr(10) || '}}' AS dot,
 '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || {_CLASSES} || chr(10) || string_agg(flow, chr(10) ORDER BY kind, first, spot) || chr(10) || '```' AS mermaid FROM written GROUP BY paper_id"""
_JSON = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
_ITEMS = lambda c: f"'[' || coalesce(list_aggregate(list_transform({c}, lambda x: CAST(to_json(x) AS VARCHAR)), 'string_agg', ','), '') || ']'"
_BEFORE, _AFTER = reports.PAGE.split("GRAPH")
_HTML = f"""WITH {q._GRAPH}, ns AS (SELECT paper_id, string_agg('{{"id":' || {_JSON('node_id')} || ',"name":' || {_JSON('name')} || ',"type":' || {_JSON('type')} || '}}', ',' ORDER BY node_id, name, type) AS t FROM nodes GROUP BY 1),
ls AS (SELECT paper_id, string_agg('{{"source":' || {_JSON('src')} || ',"target":' || {_JSON('dst')} || '}}', ',' ORDER BY src, dst) AS t FROM edges GROUP BY 1)
SELECT ns.paper_id, {_quoted(_BEFORE)} || replace('{{"nodes":[' || ns.t || ']' || CASE WHEN ls.t IS NOT NULL THEN ',"links":[' || ls.t || ']' ELSE '' END || '}}', '<', '\\u003c') || {_quoted(_AFTER)} AS html FROM ns LEFT JOIN ls USING (paper_id)"""
_ANALYSIS = f"""WITH meta AS ({q.SQL['paper_metadata']}), counts AS ({q.SQL['category_statistics']}), cited AS ({q.SQL['entity_cited_by']}), titles AS (SELECT paper_id, list(title ORDER BY pos) AS titles FROM ({q.SQL['section_titles']}) GROUP BY 1),
listed AS (WITH {q.ENTITIES_SQL} SELECT e.paper_id, string_agg('{{"type":' || {_JSON('type')} || ',"name":' || {_JSON('name')} || ',"label":' || coalesce({_JSON('e.label')}, 'null')
 || ',"content":' || {_JSON("CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END")} || ',"dependencies":' || {_ITEMS('refs')} || ',"cited_by":' || {_ITEMS("coalesce(string_split(cited_by, ','), [])")} || '}}', ',' ORDER BY type_ord, idx) AS t
 FROM entities e LEFT JOIN cited ON cited.paper_id = e.paper_id AND cited.label = e.label GROUP BY 1)
SELECT meta.paper_id, '{{"title":' || {_JSON('title')} || ',"authors":' || {_ITEMS("CASE WHEN authors <> '' THEN string_split(authors, '; ') ELSE [] END")} || ',"abstract":' || {_JSON('abstract')} || ',"sections":' || {_ITEMS('coalesce(titles, [])')}
 || ',"statistics":{{' || {" || ',' || ".join(f"""'"{c}":' || coalesce({c}, 0)""" for c in [*P.CATEGORIES.values(), 'total'])} || '}},"entities":[' || coalesce(listed.t, '') || ']}}' AS json
FROM meta LEFT JOIN counts USING (paper_id) LEFT JOIN titles USING (paper_id) LEFT JOIN listed USING (paper_id)"""
_OR = lambda c, other: f"CASE WHEN coalesce({c}, '') = '' THEN '{other}' ELSE {c} END"


def _listed(kind: str, most: int, chars: int) -> str:
    """CTEs: ``first`` entities of a kind by key, and their lines as one text."""
    told = f"'{kind.capitalize()} ' || n || ' (label ' || coalesce(x.label, 'N/A') || '): ' || CASE WHEN length(x.content) > {chars} THEN left(x.content, {chars}) || '...' ELSE x.content END"
    if kind == "theorem":
        told += f""" || chr(10) || '  depends on: ' || {_OR("coalesce(list_aggregate(x.refs, 'string_agg', ', '), '')", 'none')} || chr(10) || '  cited by: ' || {_OR('x.cited_by', 'none')}"""
    return f"""{kind}_keys AS (SELECT paper_id, key, min(idx) AS place, arg_max({{'label': label, 'content': content, 'refs': refs, 'cited_by': cited_by}}, idx) AS x FROM linked WHERE type = '{kind}' GROUP BY 1, 2),
{kind}_rows AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY place) AS n FROM {kind}_keys), {kind}_text AS (SELECT paper_id, string_agg({told}, chr(10) ORDER BY n) AS t FROM {kind}_rows WHERE n <= {most} GROUP BY 1)"""


_PROMPTS = f"""WITH meta AS ({q.SQL['paper_metadata']}), counts AS ({q.SQL['category_statistics']}), cited AS ({q.SQL['entity_cited_by']}),
linked AS (WITH {q.ENTITIES_SQL} SELECT e.paper_id, e.type, e.idx, e.label, e.content, e.refs, cited_by, coalesce(e.label, e.type || '_' || e.idx) AS key FROM entities e LEFT JOIN cited ON cited.paper_id = e.paper_id AND cited.label = e.label),
links AS (SELECT paper_id, count(*) FILTER (len(refs) = 0 AND cited_by IS NULL) AS isolated, count(*) FILTER (len(refs) > 0 AND cited_by IS NOT NULL) AS connected, count(DISTINCT key) FILTER (type LIKE 'equation%') AS equations FROM linked GROUP BY 1),
{_listed('definition', 8, 400)}, {_listed('theorem', 6, 500)}
SELECT meta.paper_id, concat_ws(chr(10), 'Review this mathematical paper in English, as its expert referee.', 'Title: ' || {_OR('title', 'Title not extracted')}, 'Authors: ' || {_OR('authors', 'Unknown')}, 'Abstract: ' || coalesce(abstract, ''),
 'Counts: ' || concat_ws(', ', {', '.join(f"'{c} ' || coalesce({c}, 0)" for c in ('definitions', 'theorems', 'lemmas', 'propositions', 'corollaries', 'equations'))}),
 'Definitions:', {_OR('definition_text.t', 'No definitions extracted')}, 'Theorems:', {_OR('theorem_text.t', 'No theorems extracted')},
 'Entities without references in or out: ' || coalesce(isolated, 0) || '; with both: ' || coalesce(connected, 0), {_quoted(A.CLOSING)}) AS prompt
FROM meta LEFT JOIN counts USING (paper_id) LEFT JOIN links USING (paper_id) LEFT JOIN definition_text USING (paper_id) LEFT JOIN theorem_text USING (paper_id)"""
_WINDOWS = " UNION ALL ".join(
    rf"SELECT paper_id, text, '{k}' AS type, {j} AS j, regexp_split_to_array(text, '(?i){p}') AS parts, regexp_extract_all(text, '(?i){p}') AS seps FROM t" for k, ps in P.KEYWORDS.items() for j, p in enumerate(ps)
)
_STOP = r"\n\s*\n|\.\s+[A-Z]"
_TEXT_ENTITIES = rf"""WITH t AS (SELECT doc_id AS paper_id, {q.NUMBERED.replace('AS STRING', 'AS VARCHAR')} AS text FROM documents), w AS ({_WINDOWS}),
k AS (SELECT *, unnest(range(1, len(seps) + 1)) AS k FROM w),
s AS (SELECT *, CAST(list_sum(list_transform(parts[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(seps[:k], lambda x: length(x))), 0) AS BIGINT) AS start FROM k),
r AS (SELECT *, substr(text, start + 1) AS rest FROM s),
c AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(rest, '{_STOP}') THEN regexp_extract(rest, '(?s)^(.*?)(?:{_STOP})', 1) ELSE left(rest, 500) END, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS content FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, type ORDER BY j, k) AS idx FROM c)
SELECT paper_id, type, CAST(idx AS INTEGER) AS idx, upper(left(type, 1)) || substr(type, 2) || ' ' || idx AS name, content, CAST(start - length(seps[k]) AS INTEGER) AS pos FROM n"""
_PLACES = " UNION ALL ".join(rf"SELECT paper_id, '{k}' AS type, regexp_split_to_array(tex, '{p}') AS parts, regexp_extract_all(tex, '{p}') AS seps FROM papers" for k, p in P.ENTITY_PATTERNS.items())
_ESCAPED = "text"
for _plain, _escape in B.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, {_quoted(_plain)}, {_quoted(_escape)})"
_PART = lambda name, p: rf"SELECT review_id, '{name}' AS part, regexp_replace(regexp_extract(t, '(?is){p}', 1), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM r WHERE regexp_matches(t, '(?is){p}')"

SQL = {
    "review_issues": f"WITH {q._FEATURES} SELECT review_id, {_NOTES} FROM features",
    "review_acceptance": f"WITH {q._FEATURES}, s AS (SELECT review_id, {q._POINTS} AS overall_score FROM features) SELECT review_id, overall_score >= 70 AS accepted FROM s",
    "review_summaries": f"""WITH {q._FEATURES}, s AS (SELECT review_id, {q._POINTS} AS overall_score, {_NOTES} FROM features), g AS (SELECT *, {q._GRADE} AS grade FROM s)
SELECT review_id, 'Review score: ' || overall_score || '/100 (grade ' || grade || ')' || chr(10) || 'Strengths:' || {_BULLETS('strengths', 5)} || chr(10) || 'Issues:' || {_BULLETS('issues', 10)} || chr(10)
 || 'Review quality: ' || CASE WHEN grade IN ('A', 'B') THEN 'PASSED' WHEN grade = 'C' THEN 'MARGINAL (needs improvement)' ELSE 'FAILED (requires major revision)' END AS summary FROM g""",
    "review_parts": f"WITH r AS (SELECT conv_id * 1000 + turn AS review_id, {PARTS} AS t FROM conversations) " + " UNION ALL ".join(_PART(n, p) for n, p in D.REVIEW_PARTS.items()),
    "graph_messages": f"WITH {_MESSAGES} SELECT * FROM messages",
    "graph_recommendation_texts": f"SELECT paper_id, pos, CASE recommendation {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(t)}' for k, t in M.RECOMMENDATIONS.items())} END AS text FROM ({q.SQL['graph_recommendations']})",
    "graph_summaries": f"""WITH {_MESSAGES}, told AS (SELECT paper_id, string_agg(rpad(metric, 12, ' ') || ' [' || bar || '] ' || printf('%.2f', score) || ' ' || status || ' - ' || message, chr(10) ORDER BY pos) AS said FROM messages GROUP BY 1)
SELECT paper_id, 'Graph score: ' || printf('%.2f', (o // 100 + CASE WHEN o % 100 > 50 OR (o % 100 = 50 AND (o // 100) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE) || ' (grade ' || CASE WHEN o >= 9000 THEN 'A' WHEN o >= 8000 THEN 'B' WHEN o >= 7000 THEN 'C' WHEN o >= 6000 THEN 'D' ELSE 'F' END || ')' || chr(10) || said || chr(10)
 || 'Nodes: ' || n || ', edges: ' || m || ', density: ' || printf('%.4f', round_even(density, 4)) AS summary FROM quality JOIN told USING (paper_id)""",
    "graph_layout": f"""WITH {q._GRAPH}, a AS (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY paper_id ORDER BY node_id) - 1) / count(*) OVER (PARTITION BY paper_id) AS angle FROM nodes)
SELECT paper_id, node_id, CASE WHEN length(name) > 30 THEN left(name, 27) || '...' ELSE name END AS label, {q._COLOR} AS color, round(cos(angle), 6) + 0.0::DOUBLE AS x, round(sin(angle), 6) + 0.0::DOUBLE AS y FROM a""",
    "graph_files": _FILES,
    "loaded_elements": q.SQL["section_elements"],
    "entity_index": f"WITH {q.ENTITIES_SQL} SELECT paper_id, type, idx, name, label FROM entities QUALIFY row_number() OVER (PARTITION BY paper_id, replace(type, '_star', ''), coalesce(label, type || '_' || idx) ORDER BY type_ord DESC, idx DESC) = 1",
    "entities_by_type": f"WITH {q.ENTITIES_SQL} SELECT paper_id, idx, name FROM entities WHERE type = 'lemma'",
    "entity_by_label": f"WITH {q.ENTITIES_SQL} SELECT paper_id, type, idx, name FROM entities WHERE label = 'e2' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY type_ord DESC, idx DESC) = 1",
    "statistics_json": f"SELECT paper_id, '{{' || {' || chr(44) || '.join(_quoted(f'"{c}":') + f' || {c}' for c in [*P.CATEGORIES.values(), 'total'])} || '}}' AS json FROM ({q.SQL['category_statistics']})",
    "section_paths": f"WITH {q._TREE} SELECT a.paper_id, CAST(a.section_id AS INTEGER) AS section_id, CAST(1 + (a.parent_id IS NOT NULL)::INT + (b.parent_id IS NOT NULL)::INT AS INTEGER) AS depth, concat_ws(' / ', c.title, b.title, a.title) AS path FROM sections a LEFT JOIN sections b ON b.paper_id = a.paper_id AND b.section_id = a.parent_id LEFT JOIN sections c ON c.paper_id = b.paper_id AND c.section_id = b.parent_id",
    "preambles": f"WITH {PAPERS_SQL} SELECT paper_id, {_PRE} AS preamble FROM papers",
    "distinct_names": f"WITH {q._CANDIDATES} SELECT paper_id, coalesce(string_agg(DISTINCT content, ',' ORDER BY content) FILTER (bucket = 'labels'), '') AS labels, coalesce(string_agg(DISTINCT content, ',' ORDER BY content) FILTER (bucket = 'refs'), '') AS refs FROM candidates GROUP BY 1",
    "tree_issues": f"WITH c AS ({q.SQL['tree_coverage']}) " + " UNION ALL ".join(f"SELECT paper_id, {i} AS pos, '{name} coverage low: ' || {_percent(c)} AS issue FROM c WHERE {c} < {least}" for i, (c, least, name) in enumerate(M.TREE_ISSUES)),
    "unresolved_references": rf"""WITH {_LABELLED}, refs AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(tex, '\\(?:ref|eqref)\{{([^}}]+)\}}', 1)) AS label FROM papers)
SELECT paper_id, string_agg(label, ', ' ORDER BY label) AS refs FROM refs WHERE (paper_id, label) NOT IN (SELECT paper_id, label FROM label_map) GROUP BY paper_id""",
    "label_map": f"WITH {_LABELLED} SELECT * FROM label_map",
    "orphan_elements": f"WITH {q._ELEMENTS} SELECT paper_id, section_id, type, number FROM elements WHERE section_id % 3 = 0",
    "flat_entities": f"WITH {q._ELEMENTS} SELECT paper_id, type, CASE WHEN name <> '' THEN name ELSE type || ' ' || number END AS name, label, {q._clean('content', False)} AS content FROM elements",
    "tree_nodes": f"WITH {q._ELEMENTS} SELECT paper_id, coalesce(label, type || '_' || number) AS node_id, type, name, number FROM elements",
    "tree_edges": rf"WITH {q._ELEMENTS}, r AS (SELECT paper_id, coalesce(label, type || '_' || number) AS src, regexp_extract_all(content, '\\(?:ref|eqref)\{{(.*?)\}}', 1) AS refs FROM elements) SELECT paper_id, src, CAST(generate_subscripts(refs, 1) - 1 AS INTEGER) AS pos, unnest(refs) AS dst FROM r",
    "latex_reconstruction": f"WITH {_REBUILT}",
    "document_body": rf"WITH {PAPERS_SQL}, t AS (SELECT paper_id, {BARE} AS tex FROM papers), f AS (SELECT *, regexp_matches(tex, '(?s)\\begin\{{document\}}.*?\\end\{{document\}}') AS found FROM t) SELECT paper_id, CASE WHEN found THEN {_BODY} ELSE tex END AS body, NOT found AS whole FROM f",
    "body_metadata": f"WITH {PAPERS_SQL}, b AS (SELECT paper_id, {_BODY} AS body FROM papers) SELECT paper_id, {_TITLE} AS title, list_aggregate({_AUTHORS}, 'string_agg', '; ') AS authors, {_ABSTRACT} AS abstract FROM b",
    "document_chunks": _CHUNKED,
    "review_prompts": _PROMPTS,
    "export_html": _HTML,
    "analysis_json": _ANALYSIS,
    "problem_areas": _AREAS,
    "analysis_markdown": _MARKDOWN,
    "chunk_totals": f"WITH RECURSIVE {PAPERS_SQL}, bodies AS (SELECT paper_id, {_BODY} AS tex FROM papers), {_chunked('bodies', 8000, 1000, 500)} SELECT paper_id, count(*) AS chunks, {', '.join(f'CAST(0 AS BIGINT) AS {k}' for k in A.CHUNK)} FROM chunks GROUP BY paper_id",
    "text_titles": r"SELECT doc_id AS paper_id, regexp_replace(string_split(text, chr(10))[1], '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS title FROM documents",
    "text_entities": _TEXT_ENTITIES,
    "entity_positions": f"""WITH {PAPERS_SQL}, w AS ({_PLACES}), k AS (SELECT *, unnest(range(1, len(seps) + 1)) AS k FROM w)
SELECT paper_id, type, CAST(k AS INTEGER) AS idx, CAST(list_sum(list_transform(parts[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(seps[:k - 1], lambda x: length(x))), 0) AS INTEGER) AS pos FROM k""",
    "implied_dependencies": f"""WITH {q.ENTITIES_SQL}, e AS (SELECT *, content || ' by Theorem ' || idx AS said FROM entities)
SELECT e.paper_id, e.type, e.idx, o.label AS ref FROM e JOIN entities o ON o.paper_id = e.paper_id AND o.label IS NOT NULL AND (o.type_ord <> e.type_ord OR o.idx <> e.idx) AND contains(lower(e.said), lower(o.name))""",
    "latex_escapes": f"SELECT doc_id, {_ESCAPED} AS text FROM documents",
    "bibliography_entries": """SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || '\\textit{' || p_name || '}' ELSE '\\textit{' || p_name || '}, ' || p_type || ', 2001' END AS entry,
 '@article{k' || p_partkey || ',' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '  author = {' || p_brand || '},' || chr(10) || '  title = {' || p_name || '}' ELSE '  title = {' || p_name || '},' || chr(10) || '  journal = {' || p_type || '},' || chr(10) || '  year = {2001}' END || chr(10) || '}' AS bibtex FROM part""",
}
