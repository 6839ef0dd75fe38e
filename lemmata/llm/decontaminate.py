"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over ``SPAN`` tokens hash some positions and ignore the others, so a hit survives substitutions at ignored
positions. The seeds of all benchmark items, as sorted tables of a bounded number of characters each, are broadcast;
every document's seeds are looked up in them, in one scan, and each hit is verified by aligning item and document along
its diagonal: a leak is an overlap with a window of ``WINDOW`` tokens of which ``PERCENT`` % agree, ends agreeing; of an
item of fewer tokens, ``PERCENT`` % of all of them. Tokens are runs of letters and digits, lower-cased; characters of
scripts without spaces are tokens each.

Items shorter than the span are looked up whole, by a mask of their own length, and have to agree in every token. Items
of fewer than ``LEAST`` tokens name nothing in particular: they are reported, with their length in ``n_item``, but
``drop_contaminated`` keeps the documents that hold them.

Recall: exact leaks are always found, and so are those with one substitution in any nine tokens, or two in thirteen. Of
random substitutions at the very threshold (three in fifteen tokens), about one in 300 leaves no seed a hit.

Nulls: a null text has no tokens, and neither has a null item. A null id is carried as null. Repeated rows are reported
each. Other columns are carried by ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, enclosed, mix, opened, released, rounds, row_key, table, texts_of

#: Letters of scripts without spaces.
SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W_{SINGLE}]+|(?![\W_])[{SINGLE}]")
#: The same for texts without such letters.
RUN, UNSPACED = re.compile(r"[^\W_]+"), re.compile(f"[{SINGLE}]")
#: 1: the token counts; 0: it may differ. Any one substitution in nine tokens leaves one of these a hit.
MASKS = ("1101011", "1110101", "1011101", "1111001")
#: Of items from SPAN to WINDOW tokens too: one substitution in seven tokens leaves one of these a hit, at an end as well.
SHORT_MASKS = ("11101", "10111")
SPAN, WINDOW, PERCENT, LEAST = 7, 13, 80, 5
#: Most characters of benchmark text in one table; its seeds take some ten times as many bytes, which a worker holds.
ROUND_CHARS = 4 << 20
#: Most pairs of a document's and an item's equal seeds that are held at once.
PAIRS = 1 << 20


def tokens_of(text: str | None) -> list[str]:
    low = text.lower() if text else ""
    return (RUN if low.isascii() or not UNSPACED.search(low) else TOKEN).findall(low)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    x = np.full(n, int(mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            x = mix(x + h[i : i + n])
    return x


@dataclass
class Seeds:
    """The seeds of some items: hash, item and place, by hash; and a bitmap that most other hashes miss."""

    ids: list
    items: list[np.ndarray]
    masks: list[str]
    hash: np.ndarray = field(default=None)
    item: np.ndarray = field(default=None)
    place: np.ndarray = field(default=None)
    gate: np.ndarray = field(default=None)
    bits: int = 20

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Seeds:
        hashes = WordHashes()
        kept = [(i, h) for i, t in rows if len(h := hashes.of(tokens_of(t)))]
        sizes = {len(h) for _, h in kept}
        masks = [*(MASKS if max(sizes, default=0) >= SPAN else ()), *(SHORT_MASKS if any(SPAN <= n < WINDOW for n in sizes) else ()), *("1" * n for n in sorted(sizes) if n < SPAN)]
        self = cls([i for i, _ in kept], [h for _, h in kept], list(dict.fromkeys(masks)))
        found = [(x, np.full(len(x), k), np.arange(len(x))) for k, h in enumerate(self.items) for m in masks_of(len(h)) for x in [seed_hashes(h, m)]]
        empty = np.empty(0, np.int64)
        all_, item, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), empty, empty)
        order = np.argsort(all_, kind="stable")
        self.hash, self.item, self.place = all_[order], item[order], place[order]
        self.bits = min(28, max(20, int(len(all_)).bit_length() + 4))
        self.gate = np.zeros(1 << self.bits, bool)
        self.gate[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        return self

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Rows (item, diagonal) of all seeds that a document shares, each once."""
        found = []
        for mask in self.masks:
            x = seed_hashes(h, mask)
            at = np.flatnonzero(self.gate[(x >> np.uint64(64 - self.bits)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, x[at], "left"), np.searchsorted(self.hash, x[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # Where item and document repeat themselves, pairs are as many as the product; what differs are diagonals.
            ends, start = np.cumsum(n), 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                size = n[start:stop]
                j = np.repeat(lo[start:stop] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                found.append(np.unique(np.stack((self.item[j], np.repeat(at[start:stop], size) - self.place[j])), axis=1))
                start = stop
        return np.unique(np.concatenate(found, axis=1), axis=1).T if found else np.empty((0, 2), np.int64)

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, first token in the document, tokens, agreeing tokens, the item's tokens) of the best window of each leaked item."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in self.hits(h).tolist():
            item = self.items[k]
            lo, hi = max(0, -shift), min(len(item), len(h) - shift)
            same = item[lo:hi] == h[lo + shift : hi + shift]
            if (found := leaked(same, len(item))) is not None:
                a, b, n = found
                best[k] = max(best.get(k, (0, 0, 0)), (n, b - a, -(a + lo + shift)))
        return [(self.ids[k], -start, size, n, len(self.items[k])) for k, (n, size, start) in sorted(best.items())]


def masks_of(size: int) -> tuple[str, ...]:
    """The masks by which items of so many tokens are found."""
    return ("1" * size,) if size < SPAN else MASKS if size >= WINDOW else (*MASKS, *SHORT_MASKS)


def leaked(same: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """(start, end, agreeing) of the leak in the overlap of a document with an item of ``size`` tokens; None for none."""
    if size >= WINDOW:
        return widest(same, WINDOW)
    n = int(same.sum())
    if 100 * n < (PERCENT if size >= SPAN else 100) * size:
        return None
    at = np.flatnonzero(same)
    return int(at[0]), int(at[-1]) + 1, n


def widest(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """The widest window (start, end, agreeing) of at least ``least`` places of which PERCENT % agree, both ends agreeing."""
    at = np.flatnonzero(same)
    if len(at) * 100 < least * PERCENT:
        return None
    # Over agreeing places i <= j: 100 * (j - i + 1) >= PERCENT * (at[j] - at[i] + 1). With f below, f[j] + 100 - PERCENT >= f[i].
    f = 100 * np.arange(len(at)) - PERCENT * at
    best = None
    low = np.minimum.accumulate(f)
    for j in range(len(at)):
        i = int(np.searchsorted(-low[: j + 1], -(f[j] + 100 - PERCENT), "left"))
        size = int(at[j] - at[i]) + 1 if i <= j else 0
        if size >= least and (best is None or size > best[1] - best[0]):
            best = (int(at[i]), int(at[j]) + 1, j - i + 1)
    return best


def seed_rounds(benchmark: DataFrame, chars: int = ROUND_CHARS) -> Iterator[Seeds]:
    """Seeds of the benchmark's (item_id, text), a bounded part at a time."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = rounds(total, chars)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Seeds.build([tuple(r) for r in part.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_same, n_item, and the row's key _id and _th): every leaked item of every row of (doc_id, text)."""
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(seeds) for seeds in seed_rounds(benchmark)]
    names = ("item_id", "start", "n_tokens", "n_same", "n_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held = shared[0].value if len(shared) == 1 else None
        for batch in batches:
            texts = None if held else [hashes.of(tokens_of(t)) for t in texts_of(batch)]
            for one in shared:
                seeds = held or opened(one)
                out = defaultdict(list)
                for i, h in enumerate(texts if texts is not None else (hashes.of(tokens_of(t)) for t in texts_of(batch))):
                    for leak in seeds.leaks(h):
                        out["row"].append(i)
                        for name, value in zip(names, leak, strict=True):
                            out[name].append(value)
                if out:
                    rows = pa.array(out["row"], pa.int64())
                    take = {c: batch.column(c).take(rows) for c in ("doc_id", "_id", "_th")}
                    yield pa.RecordBatch.from_pydict({"doc_id": take["doc_id"], **{c: pa.array(out[c], pa.int64()) for c in names}, "_id": take["_id"], "_th": take["_th"]})

    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in names)}, _id long, _th long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that hold a leaked item of at least so many tokens."""
    gone = contaminated(docs, benchmark).where(F.col("n_item") >= least).select("_id", "_th").distinct()
    return released(enclosed(docs, *row_key()).join(gone, ["_id", "_th"], "left_anti"), docs)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: one row for each pair of a document and an item that leaked into it."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_id", "_th")
