"""MinHash near-duplicate detection with odd sketches.

1. Each document's word shingles are hashed; documents of equal shingle sets are one node (its least doc_id).
2. Each node gets MinHash samples, and bands of samples make bucket keys. The hashes of all its shingles, not its MinHash
   samples, are folded into a parity bitmap of 1,024 bits, an odd sketch. The population count of two sketches' XOR is at most the size of the sets' symmetric difference, which at
   the threshold is (1 - t) / (1 + t) of both sizes: a pair above that can't link, so the sketch loses nothing.
3. Each node is first checked against two of its neighbours: bucket leaders, and those next to it when a bucket is in
   hashed order (large buckets are ordered in parts, so no task sees a whole one). Links are confirmed on full shingle sets, and components made of them.
4. What remains are pairs that share a bucket and aren't connected yet. All of these that the sketch doesn't reject are
   made once, from the first bucket that they share, and confirmed on full sets too. Pairs within a component are never
   made, so groups of copies stay linear.

No bucket is capped. A link is missed only if all bands miss it (under 1e-7 at the threshold).

Nulls and edges: a text that is null or has no word has an empty set and links with nothing; a text of fewer words than
a shingle has its whole sequence as its one shingle. Rows of the same doc_id are the same node when their sets agree
and are united when they don't. A null doc_id takes no part: its component is null and it is kept. Other columns are
carried by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, enclosed, mix, released, signed, table, texts_of, words_lower
from .graph import components

SKETCH_BITS = 1024
#: Neighbours that a node is checked against before all open pairs are.
FIRST_TRIES = 2
#: Members of a bucket that are put in order together; larger buckets are split by hash into parts of about this size.
ORDERED = 256
MISS = 1e-7
SAMPLES = 192


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) with the most rows that miss under MISS of the pairs at the threshold, in at most SAMPLES samples."""
    for rows in range(12, 1, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
        if rows * bands <= SAMPLES:
            return rows, bands
    return 1, SAMPLES


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct 64-bit hashes of all shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = len(h) - width + 1
    if n < 1:
        n, width = 1, len(h)
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = mix(x + h[i : i + n])
    return np.unique(x)


def seeds(samples: int) -> np.ndarray:
    return mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(shingles: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """MinHash samples: under each odd multiplier, the least of the products' upper halves, mixed."""
    least = np.full(len(seed), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096, None] * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of SKETCH_BITS bits over all shingles, as longs."""
    at = mix(shingles) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, two longs f1 and f2 that tell sets apart, bands (array of long), sketch (array of long)."""
    seed = seeds(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, f1, f2, keys, sketch = [], [], [], [], []
            for text in texts_of(batch):
                s = shingle_set(words_lower(text), width, hashes)
                n.append(len(s))
                f1.append(int(signed(s).sum()))
                f2.append(int(signed(mix(s ^ np.uint64(0x5851F42D4C957F2D))).sum()))
                if not len(s):
                    keys.append(None)
                    sketch.append(None)
                    continue
                m = signature(s, seed)
                band = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band + m[r::rows])
                keys.append(signed(band))
                sketch.append(odd_sketch(s))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": n, "f1": f1, "f2": f2, "bands": pa.array(keys, kind), "sketch": pa.array(sketch, kind)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough.

    Texts of the paired documents travel deflated, once to either side.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": pa.array(data, pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, p, q in zip(a, texts_of(batch, "pa"), texts_of(batch, "pb"), strict=True):
                if x != last:
                    last, left = x, shingle_set(zlib.decompress(p).lower().split(), width, hashes)
                right = shingle_set(zlib.decompress(q).lower().split(), width, hashes)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_pydict({"a": [x for x, k in zip(a, keep, strict=True) if k], "b": [x for x, k in zip(b, keep, strict=True) if k]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(pack, "doc_id long, data binary")
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("data").alias("pb")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("data").alias("pa")), "a").select("a", "b", "pa", "pb")
    return both.mapInArrow(check, "a long, b long").distinct()


def unlike(a: str, b: str, percent: int):
    """True for pairs whose sizes or odd sketches rule a link out."""
    bits = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) < percent * F.greatest(n, m)) | ((100 + percent) * bits > (100 - percent) * (n + m))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets of ``width``-word shingles.
    """
    rows, bands = banding(percent)
    every = checkpoint(signatures(docs, width, rows, bands))
    least = every.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    least = checkpoint(least)
    nodes = every.join(least.select("f1", "f2", F.col("rep").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    nodes = checkpoint(nodes.select("doc_id", F.col("n_shingles").alias("n"), *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)), "bands"))
    sketches = nodes.drop("bands")
    members = nodes.select("doc_id", F.posexplode("bands").alias("band", "value")).select("doc_id", "band", F.xxhash64("band", "value").alias("key"))
    leaders = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("c")).where("c > 1")
    leaders = leaders.select("key", "lead", F.ceil(F.col("c") / ORDERED).alias("parts"))
    # The key of a bucket's members that aren't alone: all later steps go by these.
    shared = checkpoint(members.join(leaders, "key"))
    beside = F.lag("doc_id").over(Window.partitionBy("key", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).orderBy(F.xxhash64("doc_id", "key")))
    chain = shared.select(F.col("doc_id").alias("b"), beside.alias("a")).where("a IS NOT NULL")
    tries = shared.select(F.col("doc_id").alias("b"), F.col("lead").alias("a")).unionAll(chain).where("a != b")
    tries = tries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().alias("p")
    tries = tries.join(sketches.alias("y"), F.col("p.b") == F.col("y.doc_id")).join(sketches.alias("x"), F.col("p.a") == F.col("x.doc_id"))
    tries = tries.where(~unlike("x", "y", percent)).select("p.a", "p.b")
    some = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b")))
    tries = tries.withColumn("k", some).where(F.col("k") <= FIRST_TRIES).select("a", "b")
    texts = docs.select("doc_id", "text")
    twins = every.where("doc_id IS NOT NULL AND n_shingles > 0").join(least, ["f1", "f2", "n_shingles"]).where("doc_id != rep")
    # A document of several differing rows stands for all of its sets.
    several = twins.join(nodes.select("doc_id"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = checkpoint(confirmed(tries, texts, width, percent).unionAll(several))
    labels = components(links)
    label = F.coalesce("component", "doc_id").alias("label")
    shared = shared.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "band", "doc_id", label)
    mixed = shared.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    open_ = checkpoint(shared.join(mixed, "key").join(nodes, "doc_id"))
    x, y = open_.alias("x"), open_.alias("y")
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(True)) == F.col("x.band") + 1
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.label") != F.col("y.label")) & ~unlike("x", "y", percent) & first)
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = checkpoint(confirmed(rest, texts, width, percent))
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    out = every.join(least, ["f1", "f2", "n_shingles"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document (the least doc_id) of each group of near-duplicates; rows of that id all stay."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = enclosed(docs, F.col("doc_id").alias("id"))
    return released(rows.join(gone, F.col("id") == F.col("gone"), "left_anti"), docs)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
