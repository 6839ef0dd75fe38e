"""Elements of sections, LaTeX written back from the tree, and scores of the tree against its source."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import patterns as P
from ..functions import text as T
from .documents import original_counts

PROOF = r"(?s)\\begin\{proof\}(.*?)\\end\{proof\}"
FIRST_PROOF = r"(?s)^(.*?)\\begin\{proof\}.*?\\end\{proof\}(.*)$"
TOKEN = r"\\(begin|end)\{([^}]+)\}"
#: Elements whose statements tree_quality counts, and characters that are compared at once.
STATEMENTS = ("theorem", "proposition", "lemma", "corollary")
STEP = 16
#: Share of elements under which no source can be rebuilt.
LEAST_ELEMENTS = 0.7


def commands_of(tex: Column) -> Column:
    """New commands of a preamble, as an array of (name, n_args, definition)."""
    p = r"(?s)\\newcommand\{(.+?)\}(?:\[(\d+)\])?\{(.+?)\}"
    preamble = F.regexp_extract(tex, r"(?s)^(.*?)\\begin\{document\}", 1)
    part = lambda m, g: F.regexp_extract(m, p, g)
    return F.transform(F.regexp_extract_all(preamble, F.lit(p), F.lit(0)), lambda m: F.struct(part(m, 1).alias("name"), F.coalesce(F.nullif(part(m, 2), F.lit("")), F.lit("0")).alias("n_args"), part(m, 3).alias("definition")))


def custom_commands(papers: DataFrame) -> DataFrame:
    """EXT-8: new commands of the preamble, with their number of arguments, in order."""
    return papers.select("paper_id", F.posexplode(commands_of(F.col("tex"))).alias("pos", "x")).select("paper_id", "pos", "x.*")


def section_elements(sections: DataFrame, patterns: dict[str, str] = P.SECTION_PATTERNS) -> DataFrame:
    """EXT-13, AGG-2: (paper_id, section_id, type_ord, pos, type, number, label, name, content, proof).

    An element that occurs again in its paper, letter for letter, is read once. Both kinds of equation share a counter;
    numbers run by section, type and place.
    """
    every = lambda o, k, p: F.transform(F.regexp_extract_all("raw_content", F.lit(p), F.lit(0)), lambda m, i: F.struct(F.lit(o).alias("type_ord"), i.alias("pos"), F.lit(k).alias("type"), m.alias("raw")))
    e = sections.select("paper_id", "section_id", F.inline(F.concat(*(every(o, k, p) for o, (k, p) in enumerate(patterns.items())))))
    order = ("section_id", "type_ord", "pos")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id", "raw").orderBy(*order))).where("_n = 1")
    counter = F.regexp_replace("type", "_star$", "")
    e = e.withColumn("number", F.row_number().over(Window.partitionBy("paper_id", counter).orderBy(*order)))
    group = lambda n: F.coalesce(*(F.when(F.col("type") == k, F.regexp_extract("raw", p, n)) for k, p in patterns.items() if n == 1 or not k.startswith("equation")), F.lit(""))
    e = e.withColumn("g1", group(1)).withColumn("g2", group(2))
    equation = F.col("type").startswith("equation")
    body = F.when(F.col("g2") != "", F.col("g2")).otherwise(F.col("g1"))
    return e.select(
        *("paper_id", "section_id", "type_ord", "pos", "type", "number"), F.nullif(F.regexp_extract(body, P.LABEL, 1), F.lit("")).alias("label"), F.when(equation, "").otherwise(F.col("g1")).alias("name"),
        F.regexp_replace(body, FIRST_PROOF, "$1$2").alias("content"), F.nullif(F.regexp_extract(body, PROOF, 1), F.lit("")).alias("proof"),
    )


def same_from(a: str, i: int, m: int, b: str, j: int, n: int) -> int:
    """How many characters of ``a[i:m]`` and ``b[j:n]`` agree from their beginnings."""
    first, most = i, min(m, i + n - j)
    while i < most and a[i] == b[j]:
        step = STEP if i + STEP <= most and a[i : i + STEP] == b[j : j + STEP] else 1
        i, j = i + step, j + step
    return i - first


def matching_chars(a: str, b: str) -> int:
    """Characters in the matching blocks that difflib's SequenceMatcher finds, popular characters left out as it does.

    The runs of two rare characters or more on a diagonal are found once, longest first; in each part of the texts the
    block grows from the first run that is whole or longest there. A part without such a run is read once, from its first
    single match to the next. Without any, its block is what both sides begin with.
    """
    n = len(b)
    most = n // 100 + 1 if n >= 200 else n
    chars = set(b)
    gap = next(x for x in map(chr, count()) if x not in chars)
    kept = dict.fromkeys(map(ord, chars.union(a)), gap)
    kept.update((ord(x), x) for x in chars if b.count(x) <= most)
    rare_a, rare_b = a.translate(kept), b.translate(kept)
    parts = re.compile(f"[^{re.escape(gap)}]{{2,}}").finditer
    places: dict[str, list[int]] = defaultdict(list)
    for part in parts(rare_b):
        x, j = part[0], part.start()
        for k in range(len(x) - 1):
            places[x[k : k + 2]].append(j + k)
    found = []
    for part in parts(rare_a):
        x, i, last = part[0], part.start(), {}
        for k in range(len(x) - 1):
            now = {}
            for j in places.get(x[k : k + 2], ()):
                if j - 1 in last:
                    run = now[j] = last[j - 1]
                    run[0] -= 1
                else:
                    run = now[j] = [-2, i + k, j]
                    found.append(run)
            last = now
    found.sort()
    total, todo = 0, [(0, len(a), 0, n, [(i, j, i - k, j - k) for k, i, j in found])]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        best, bi, bj = 1, alo, blo
        for i, j, e, f in runs:
            if e - i < best:
                break
            head, tail = max(alo - i, blo - j, 0), max(e - ahi, f - bhi, 0)
            k = e - i - head - tail
            if k > best or (k == best > 1 and (i + head, j + head) < (bi, bj)):
                best, bi, bj = k, i + head, j + head
            # Later runs are no longer than a whole one, and begin after it.
            if not (head or tail):
                break
        if best == 1:
            for i in range(alo, ahi):
                if i < alo or (x := rare_a[i]) == gap or (j := rare_b.find(x, blo, bhi)) < 0:
                    continue
                bi, bj = i, j
                while bi > alo and bj > blo and a[bi - 1] == b[bj - 1]:
                    bi, bj = bi - 1, bj - 1
                k = i + 1 + same_from(a, i + 1, ahi, b, j + 1, bhi)
                # Nothing rare matches before the block.
                total += same_from(a, alo, bi, b, blo, bj) + k - bi
                alo, blo = k, j + k - i
            total += same_from(a, alo, ahi, b, blo, bhi)
            continue
        ei, ej = bi + best, bj + best
        while bi - alo >= STEP and bj - blo >= STEP and a[bi - STEP : bi] == b[bj - STEP : bj]:
            bi, bj = bi - STEP, bj - STEP
        while bi > alo and bj > blo and a[bi - 1] == b[bj - 1]:
            bi, bj = bi - 1, bj - 1
        k = same_from(a, ei, ahi, b, ej, bhi)
        ei, ej = ei + k, ej + k
        total += ei - bi
        if bi > alo and bj > blo:
            todo.append((alo, bi, blo, bj, [r for r in runs if r[0] < bi and r[1] < bj]))
        if ei < ahi and ej < bhi:
            todo.append((ei, ahi, ej, bhi, [r for r in runs if r[2] > ei and r[3] > ej]))
    return total


def sequence_ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``."""
    return 2.0 * matching_chars(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """FN-12: ratio of matching blocks; there is no built-in expression for it."""
    return pd.Series([sequence_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def tree_coverage(papers: DataFrame, sections: DataFrame, elements: DataFrame, statements: bool = False) -> DataFrame:
    """TQ-1, TQ-3, TQ-4, AGG-7, AGG-8: shares of the source found in the tree, resolved references, and whether levels nest.

    With ``statements``, _statements too, the number of elements that have one, so ``tree_quality`` needn't read them again.
    """
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    # A parent is the last header of its level before; which level that is tells how deep its children are.
    before = Window.partitionBy("paper_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    under_two = F.col("parent_id") == F.max(F.when(F.col("level") == 2, F.col("section_id"))).over(before)
    depth = F.when(F.col("parent_id").isNull(), 1).when((F.col("level") == 3) & under_two, 3).otherwise(2)
    named = F.collect_set(F.when(F.col("label") != "", F.col("label")))
    s = sections.withColumn("_depth", depth).groupBy("paper_id").agg(F.count_if(F.col("parent_id").isNull()).alias("top"), F.bool_and(F.col("level") == F.col("_depth")).alias("nested"), named.alias("s_labels"))
    equation = F.col("type").startswith("equation")
    e = elements.groupBy("paper_id").agg(F.count_if(~equation).alias("n_elements"), F.count_if(equation).alias("n_equations"), F.count_if(F.col("type").isin(*STATEMENTS)).alias("_statements"), named.alias("e_labels"))
    refs = F.array_distinct(F.regexp_extract_all("tex", F.lit(r"\\(?:ref|eqref)\{([^}]+)\}"), F.lit(1)))
    o = original_counts(papers, refs=refs).join(s, "paper_id", "left").join(e, "paper_id", "left")
    none = F.array().cast("array<string>")
    o = o.withColumn("labels", F.array_union(F.coalesce("s_labels", none), F.coalesce("e_labels", none)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    resolved = F.coalesce(F.size(F.array_intersect("refs", "labels")), F.lit(0))
    return o.select(
        "paper_id", ratio(zero("top"), F.col("sections")).alias("section_coverage"), ratio(zero("n_elements"), F.col("theorems")).alias("element_coverage"),
        ratio(zero("n_equations"), F.col("equations")).alias("equation_coverage"), ratio(resolved, F.size("refs")).alias("label_resolution"), F.coalesce("nested", F.lit(True)).alias("hierarchy_ok"),
        *([zero("_statements").cast("long").alias("_statements")] if statements else []),
    )


def tree_quality(
    papers: DataFrame, coverage: DataFrame, latex: DataFrame, elements: DataFrame | None = None, orphans: DataFrame | None = None, bibliography: DataFrame | None = None, gates_only: bool = False
) -> DataFrame:
    """TQ-5..TQ-8: ``coverage`` with citations, similarity, kept formulas, integrity, score, grade and whether the source
    can be rebuilt. Without ``orphans`` there are none; without ``bibliography`` no citation is covered. ``elements`` are
    not needed where ``coverage`` has _statements. With ``gates_only``, similarity, score and grade are null where the
    source can't be rebuilt whatever its similarity, which isn't computed there.

    A statement of an element is complete where its spans are ten or more; elements have one span each, so wherever there
    is a theorem, proposition, lemma or corollary, statements count as incomplete (the score doesn't).
    """
    math = lambda c: F.array_union(F.regexp_extract_all(c, F.lit(r"(?s)\\\[(.*?)\\\]"), F.lit(0)), F.regexp_extract_all(c, F.lit(r"\$([^$\n]+)\$"), F.lit(0)))
    per_paper = lambda rows, name: rows.groupBy("paper_id").agg(F.count("*").alias(name))
    cites = F.regexp_count("tex", F.lit(r"\\cite\{"))
    q = papers.join(latex, "paper_id").join(coverage, "paper_id")
    absent = F.lit(0).cast("long")
    for rows, name in ((bibliography, "_entries"), (orphans, "_orphans"), (None if elements is None else elements.where(F.col("type").isin(*STATEMENTS)), "_statements")):
        if name in coverage.columns:
            continue
        q = q.withColumn(name, absent) if rows is None else q.join(per_paper(rows, name), "paper_id", "left").withColumn(name, F.coalesce(name, absent))
    q = q.withColumn("citation_coverage", F.when(cites > 0, F.col("_entries") / cites).otherwise(0.0))
    wanted = ((F.col("element_coverage") >= LEAST_ELEMENTS) & (F.col("_orphans") == 0)) if gates_only else F.lit(True)
    compared = lambda c: F.when(wanted, T.normalized(F.col(c)))
    q = q.withColumn("similarity", F.when(wanted, sequence_similarity(compared("tex"), compared("latex"))))
    kept = F.size(F.array_intersect(math("tex"), math("latex"))) >= 0.8 * F.size(math("tex"))
    q = q.withColumns({"math_preserved": kept, "theorems_complete": F.col("_statements") == 0, "no_orphans": F.col("_orphans") == 0, "no_dangling": F.col("label_resolution") >= 0.9})
    yes = lambda c, n: F.when(c, n).otherwise(0)
    score = F.col("section_coverage") * 10 + F.col("element_coverage") * 15 + F.col("equation_coverage") * 10 + F.col("citation_coverage") * 5 + F.col("label_resolution") * 15 + yes(F.col("hierarchy_ok"), 10)
    score = score + F.col("similarity") * 20 + yes(F.col("math_preserved"), 5) + yes(F.col("no_orphans"), 3) + yes(F.col("no_dangling"), 3) + yes(F.col("hierarchy_ok"), 4)
    rebuilt = F.coalesce(F.col("similarity") >= 0.7, F.lit(False)) & F.col("no_orphans") & (F.col("element_coverage") >= LEAST_ELEMENTS)
    grade = F.when(score.isNull(), F.lit(None)).when(rebuilt & (score >= 85), "A").when(rebuilt & (score >= 70), "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")
    flags = ("math_preserved", "theorems_complete", "no_orphans", "no_dangling")
    return q.select(*(c for c in coverage.columns if c != "_statements"), "citation_coverage", "similarity", *flags, F.floor(score).cast("int").alias("overall_score"), rebuilt.alias("can_reconstruct"), grade.alias("grade"))


def unresolved_references(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """TQ-3: (paper_id, refs): references of the source that the tree has no label for, sorted; papers without any have
    no row."""
    refs = papers.select("paper_id", F.explode(F.array_distinct(F.regexp_extract_all("tex", F.lit(r"\\(?:ref|eqref)\{([^}]+)\}"), F.lit(1)))).alias("label"))
    missing = refs.join(labels.select("paper_id", "label"), ["paper_id", "label"], "left_anti")
    return missing.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("refs"))


def problem_areas(papers: DataFrame, reach: int = 500) -> DataFrame:
    """EXT-19: (paper_id, start, end) around every environment's end that the innermost open one doesn't match.

    A fold over the begins and ends of one text, with the open names as its stack; the places come from the lengths of
    the pieces between them.
    """
    tokens, pieces = F.regexp_extract_all("tex", F.lit(TOKEN), F.lit(0)), F.split("tex", TOKEN, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        name, begins = F.regexp_extract(x["t"], TOKEN, 2), x["t"].startswith("\\begin")
        here = s["at"] + F.length(x["p"])
        closes = F.coalesce(F.get(s["open"], F.size(s["open"]) - 1) == name, F.lit(False))
        popped = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return F.struct(
            (here + F.length(x["t"])).alias("at"), F.when(begins, F.concat(s["open"], F.array(name))).when(closes, popped).otherwise(s["open"]).alias("open"),
            F.when(begins | closes, s["bad"]).otherwise(F.concat(s["bad"], F.array(here))).alias("bad"),
        )

    pairs = F.arrays_zip(tokens.alias("t"), F.slice(pieces, F.lit(1), F.size(tokens)).alias("p"))
    bad = papers.select("paper_id", F.length("tex").alias("n"), F.explode(F.aggregate(pairs, state, step, lambda s: s["bad"])).alias("at"))
    return bad.select("paper_id", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), F.least(F.col("at") + reach, "n").alias("end"))


def first_areas(areas: DataFrame, limit: int = 5) -> DataFrame:
    """EXT-20: the first ``limit`` areas of each paper."""
    order = Window.partitionBy("paper_id").orderBy("start", "end")
    return areas.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
