"""Connected components of a link table, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node links its neighbours to the least node it knows.

    ``small``: the neighbours below a node, and the node itself; else the neighbours above it. The latter gives at most
    one link for each that it gets, so only the former makes them distinct.
    """
    if small:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out.where(F.col("a") != F.col("b"))
    return out.distinct() if small else out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change; each round is
    checkpointed, so a lost executor costs one round. Minima are partial aggregates and a node of many links is only
    ever on the splittable side of a join.
    """
    edges = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = checkpoint(_stars(_stars(edges, small=False), small=True))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b"), F.col("b")).distinct())
