"""Column functions on LaTeX text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!\\)%[^\n]*", "")


def clean_light(c: Column) -> Column:
    """FN-2: no comments, collapsed white space."""
    return squeezed(without_comments(c))


def clean_strong(c: Column) -> Column:
    """FN-1: as ``clean_light``, and commands with their first arguments gone."""
    return squeezed(F.regexp_replace(without_comments(c), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", " "))


def normalized(c: Column) -> Column:
    """FN-11: for comparisons."""
    return F.lower(clean_light(c))


def shortened(c: Column, over: int, keep: int) -> Column:
    """FN-4: cut and marked by an ellipsis when longer than ``over``."""
    return F.when(F.length(c) > over, F.concat(F.left(c, F.lit(keep)), F.lit("..."))).otherwise(c)


def short_name(kind: Column, content: Column, idx: Column) -> Column:
    """FN-3: the first sentence of an entity, without commands."""
    flat = F.trim(F.replace(F.regexp_replace(content, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")))
    equation = F.concat(F.lit("Eq "), idx, F.lit(": "), shortened(flat, 50, 47))
    line = F.trim(F.substring_index(F.regexp_replace(content, r"^\s+|\s+$", ""), "\n", 1))
    clean = F.trim(F.regexp_replace(F.regexp_replace(line, r"\\[a-zA-Z]+\*?(?:\{[^}]*\})?(?:\[[^\]]*\])?", ""), r"[{}$\\]", ""))
    first = F.when(clean.contains("."), F.concat(F.substring_index(clean, ".", 1), F.lit("."))).otherwise(clean)
    cut = shortened(first, 60, 57)
    named = F.concat(F.initcap(kind), F.lit(" "), idx)
    other = F.when(cut != "", F.concat(named, F.lit(": "), cut)).otherwise(named)
    return F.when(kind == "equation", equation).otherwise(other)


def starts_of(c: Column, pattern: str) -> Column:
    """EXT-3f: where the matches of a pattern begin, in characters, from the lengths of the matches and what is between."""
    between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + F.length(x["a"])
        return F.struct((here + F.length(x["b"])).alias("at"), F.concat(s["starts"], F.array(here)).alias("starts"))

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("a"), found.alias("b"))
    return F.aggregate(pairs, state, step, lambda s: s["starts"])
