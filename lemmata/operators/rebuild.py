"""LaTeX written back from the section tree, labels, flat entities and the graph of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import metadata_of, packages_of
from .tree import commands_of

# Characters that LaTeX reserves and their escapes; the order matters, since the first brings braces.
ESCAPES = (("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("_", "\\_"), ("^", "\\^"), ("~", "\\~{}"))


def latex_escape(c: Column) -> Column:
    """FN-9: reserved characters escaped one after another."""
    for plain, escape in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escape))
    return c


def span_latex(kind: Column, content: Column) -> Column:
    """FN-10: a span of text as LaTeX; ``content`` of a citation is its keys, joined by commas."""
    wrapped = lambda name: F.concat(F.lit(f"\\{name}{{"), content, F.lit("}"))
    out = F.when(kind == "math_inline", F.concat(F.lit("$"), content, F.lit("$"))).when(kind == "math_display", F.concat(F.lit("\\["), content, F.lit("\\]")))
    for name in ("cite", "ref", "eqref", "label"):
        out = out.when(kind == name, wrapped(name))
    return out.when(kind == "command", F.concat(F.lit("\\"), content)).otherwise(latex_escape(content))


def spans(c: Column) -> Column:
    """EXT-15: the spans of a text, of which there is one, of type text, cleaned of comments and white space."""
    return F.array(F.struct(F.lit("text").alias("type"), T.clean_light(c).alias("content"), c.alias("raw")))


def span_refs(found: Column) -> Column:
    """EXT-27: what the spans of type ref refer to."""
    return F.transform(F.filter(found, lambda s: s["type"] == "ref"), lambda s: s["content"])


def label_map(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """EXT-16: (paper_id, label, kind, section_id, number): of each label the last holder, sections before their elements."""
    none = F.lit(None).cast("int")
    s = sections.select("paper_id", "label", F.col("type").alias("kind"), "section_id", none.alias("number"), F.lit(-1).alias("type_ord"), F.lit(-1).alias("pos"))
    e = elements.select("paper_id", "label", F.col("type").alias("kind"), "section_id", F.col("number").cast("int").alias("number"), "type_ord", "pos")
    place = F.row_number().over(Window.partitionBy("paper_id", "label").orderBy(F.desc("section_id"), F.desc("type_ord"), F.desc("pos")))
    return s.unionByName(e).where("label != ''").withColumn("_n", place).where("_n = 1").drop("_n", "type_ord", "pos")


def orphans(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """REL-8: elements whose section isn't in the tree."""
    return elements.join(sections.select("paper_id", "section_id"), ["paper_id", "section_id"], "left_anti")


def flat_entities(elements: DataFrame) -> DataFrame:
    """REL-17: (paper_id, type, name, label, content): elements as entities; unnamed ones by type and number."""
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.concat_ws(" ", "type", F.col("number").cast("string")))
    return elements.select("paper_id", "type", name.alias("name"), "label", T.clean_light(F.col("content")).alias("content"))


def tree_nodes(elements: DataFrame) -> DataFrame:
    """REL-18: (paper_id, node_id, type, name, number): every element, by its label or its type and number."""
    return elements.select("paper_id", F.coalesce("label", F.concat_ws("_", "type", F.col("number").cast("string"))).alias("node_id"), "type", "name", "number")


def tree_edges(elements: DataFrame, from_spans: bool = False) -> DataFrame:
    """REL-18: (paper_id, src, pos, dst): every reference of every element, to whatever it names.

    ``from_spans`` takes only references that are spans of their own, of which ``spans`` makes none.
    """
    found = span_refs(spans(F.col("content"))) if from_spans else F.regexp_extract_all("content", F.lit(r"\\(?:ref|eqref)\{(.*?)\}"), F.lit(1))
    node = F.coalesce("label", F.concat_ws("_", "type", F.col("number").cast("string")))
    return elements.select("paper_id", node.alias("src"), F.posexplode(found).alias("pos", "dst"))


def section_paths(sections: DataFrame) -> DataFrame:
    """REL-16: (paper_id, section_id, depth, path): titles from the top down to each section, joined by " / ".

    Headers have three levels, so two joins to parents reach the top.
    """
    up = lambda k: sections.select("paper_id", F.col("section_id").alias(f"s{k}"), F.col("parent_id").alias(f"s{k + 1}"), F.col("title").alias(f"t{k}"))
    s = up(0).join(up(1), ["paper_id", "s1"], "left").join(up(2), ["paper_id", "s2"], "left")
    return s.select("paper_id", F.col("s0").alias("section_id"), (1 + F.col("s1").isNotNull().cast("int") + F.col("s2").isNotNull().cast("int")).alias("depth"), F.concat_ws(" / ", "t2", "t1", "t0").alias("path"))


def section_texts(sections: DataFrame) -> DataFrame:
    """(paper_id, section_id, top, text): what a section itself writes: its raw content up to the first header of a child,
    or where it has none, its header."""
    header = F.concat(F.lit("\\"), "type", F.lit("{"), "title", F.lit("}"))
    # A section and the headers of its children meet in one group, so the sections are read once.
    own = F.struct("parent_id", "type", "title", "label", "raw_content")
    row = lambda section, own, header: F.struct(F.col(section).alias("section_id"), own.alias("own"), header.alias("header"))
    mine, above = row("section_id", own, F.lit(None).cast("string")), row("parent_id", F.when(F.lit(False), own), header)
    rows = sections.select("paper_id", F.inline(F.when(F.col("parent_id").isNotNull(), F.array(mine, above)).otherwise(F.array(mine))))
    s = rows.groupBy("paper_id", "section_id").agg(F.max("own").alias("own"), F.collect_set("header").alias("headers"))
    s = s.where("own IS NOT NULL").select("paper_id", "section_id", "own.*", "headers")
    stops = F.filter(F.transform("headers", lambda h: F.instr(F.col("raw_content"), h)), lambda at: at > 0)
    cut = F.when(F.size("headers") > 0, F.array_min(stops))
    labelled = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("\\label{"), "label", F.lit("}"))).otherwise("")
    text = F.when(F.col("raw_content") == "", F.concat(header, labelled)).when(cut.isNotNull(), F.left("raw_content", cut - 1)).otherwise(F.col("raw_content"))
    return s.select("paper_id", "section_id", F.col("parent_id").isNull().alias("top"), text.alias("text"))


def bibliography_entry(fields: Column) -> Column:
    """FN-20: author, title in italics, journal and year of a map of fields, as far as there are any."""
    title = F.when(fields["title"].isNotNull(), F.concat(F.lit("\\textit{"), fields["title"], F.lit("}")))
    return F.concat_ws(", ", fields["author"], title, fields["journal"], fields["year"])


def bibtex(kind: Column, key: Column, fields: Column) -> Column:
    """FN-20: an entry in BibTeX, fields in the order of the map."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("}")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def reconstructed(papers: DataFrame, sections: DataFrame, bibliography: DataFrame | None = None) -> DataFrame:
    """SNK-9: (paper_id, latex): class, packages, commands, the rest of the preamble, front matter, sections in order, and
    the bibliography (paper_id, pos, key, fields), if one is given."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    option = lambda x: F.when(x["options"] != "", F.concat(F.lit("["), x["options"], F.lit("]"))).otherwise("")
    pkgs = F.transform(packages_of(F.col("tex")), lambda x: F.concat(F.lit("\\usepackage"), option(x), F.lit("{"), x["name"], F.lit("}")))
    cmds = F.transform(commands_of(F.col("tex")), lambda x: F.concat(F.lit("\\newcommand{"), x["name"], F.lit("}["), x["n_args"], F.lit("]{"), x["definition"], F.lit("}")))
    piece = F.concat(F.when(F.col("top"), "\n").otherwise("\n\n"), "text")
    body = section_texts(sections).select("paper_id", F.col("section_id").alias("pos"), piece.alias("piece")).groupBy("paper_id").agg(F.array_join(ordered("piece"), "").alias("body"))
    front = papers.select("paper_id", "tex", pkgs.alias("pkgs"), cmds.alias("cmds"), *(c.alias(n) for n, c in metadata_of(F.col("tex")).items()))
    p = front.join(body, "paper_id", "left")
    none = F.array().cast("array<string>")
    closing = F.lit("")
    if bibliography is not None:
        entry = F.concat(F.lit("\\bibitem{"), "key", F.lit("} "), bibliography_entry(F.col("fields")))
        listed = bibliography.withColumn("line", entry).groupBy("paper_id").agg(ordered("line").alias("entries"))
        p = p.join(listed, "paper_id", "left")
        size = F.size("entries").cast("string")
        closing = F.when(F.size("entries") > 0, F.concat(F.lit("\n\n\\begin{thebibliography}{"), size, F.lit("}\n"), F.array_join("entries", "\n"), F.lit("\n\\end{thebibliography}"))).otherwise("")
    preamble = F.regexp_extract("tex", r"(?s)^(.*?)\\begin\{document\}", 1)
    rest = F.filter(F.split(preamble, "\n"), lambda x: ~x.contains("usepackage") & ~x.contains("documentclass"))
    when = lambda c, *lines: F.when(c, F.array(*lines)).otherwise(none)
    wrapped = lambda name, c: F.concat(F.lit(f"\\{name}{{"), c, F.lit("}"))
    has = F.size(F.coalesce("cmds", none)) > 0
    lines = F.concat(
        F.array(F.lit("\\documentclass[12pt]{article}"), F.lit("% Preamble")), F.coalesce("pkgs", none), when(has, F.lit(""), F.lit("% Custom commands")), F.coalesce("cmds", none),
        F.when(preamble != "", F.concat(F.array(F.lit(""), F.lit("% Additional preamble")), rest)).otherwise(none), F.array(F.lit(""), F.lit("\\begin{document}"), F.lit("")),
        when(F.col("title") != "", wrapped("title", F.col("title"))), when(F.size("authors") > 0, wrapped("author", F.array_join("authors", " \\and "))), F.array(F.lit("\\maketitle"), F.lit("")),
        when(F.col("abstract") != "", F.lit("\\begin{abstract}"), F.col("abstract"), F.lit("\\end{abstract}"), F.lit("")),
    )
    return p.select("paper_id", F.concat(F.array_join(lines, "\n"), F.coalesce("body", F.lit("")), closing, F.lit("\n\n\\end{document}")).alias("latex"))
