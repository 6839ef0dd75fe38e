"""Language-model scoring with a log-frequency Bloom filter.

Words and bigrams of the training part are counted, and the counts quantised to levels whose lower ends grow by a
quarter (1, 2, 3, 4, 5, 7, 9, ...). For a count of level j the filter holds the entries (n-gram, 1) ... (n-gram, j); a
query probes (n-gram, 1), (n-gram, 2), ... until one is missing, and the level reached gives the count back: ``low``,
the lower end of its level, or ``high``, the upper end. Smoothing mixes bigrams with words (Dirichlet prior of weight
``mu``), all from probes:

    p(w | h) = (low(h, w) + mu * p(w)) / (high(h) + mu),    p(w) = (low(w) + 0.5) / (N + 0.5 * (V + 1))

Lower ends above and upper ends below keep a history's probabilities, but for false positives, at a sum of at most 1.
An entry is four bits of one 64-bit word of its block (about 0.6 % false positives), so a probe is one read. The base
score alone takes exact word counts, which travel beside the filter.

Scale. Texts are tokenised once to count and once to score. The filter is a grid of blocks: rows by the word's hash,
columns by that of the history; a row's own block has its words. So no common word gathers in one block, and each part
of the filter (a run of blocks of at most ``part_bytes``, with the words of their rows) adds up on its own what its
words and bigrams give to each text. Counts travel packed, six bytes a bigram. A scoring task goes through all parts of
a pass and holds one at a time. A pass broadcasts at most ``pass_bytes``; larger filters take more passes over the texts,
whose sums are written to the shared folder before the next pass, and added. Results do not depend on parts and passes,
apart from the order of additions.

Nulls: a null text is an empty text, which has one token (its end). A null id counts as the text "". Repeated rows are
scored once each. Without training documents N, V and all counts are 0, and p(w) is 1 / 1 for want of a vocabulary:
all scores are 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import END, WordHashes, checkpoint, mix, opened, rounds, row_key, table, texts_of, words_lower

#: Prior weight of the word distribution against a history's own counts. Held-out log10 probability a token of 10,000
#: documents: -4.16 at 4, -3.87 at 64, -3.824 at 256, -3.820 at 512, -3.827 at 1,000 (-4.19 by words alone); of the flat
#: best, the lower end lets documents that the corpus repeats stand out more.
MU = 256.0
#: Bits of filter per (n-gram, level) entry.
BITS_PER_ENTRY = 16
#: Bytes of text per filter block, in the mean.
BLOCK_BYTES = 1 << 20
#: Most bytes of one part, which is what a worker holds at once, and of all parts of a pass, which executors keep on disk.
#: The model of compressed Parquet takes half to four fifths of its bytes (measured on 102 MB and on 16 MB).
PART_BYTES, PASS_BYTES = 16 << 20, 4 << 30
#: Tokens that a worker handles together.
GROUP_TOKENS = 1 << 20
START = np.uint64(WordHashes()[b"\x20"])
STOP = np.uint64(WordHashes()[END])
LOW48 = np.uint64((1 << 48) - 1)
#: Words of a 64-bit mask with two bits, by 12 bits of a hash.
TWO_BITS = (np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63))) | (np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6)))


def level_starts(base: float = 1.25, top: int = 1 << 40) -> np.ndarray:
    """Lower ends of the count levels."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, int(np.ceil(ends[-1] * base))))
    return np.array(ends, np.int64)


LEVELS = level_starts()
#: By level, 0 for n-grams that the filter lacks: the least and the greatest count.
LOW, HIGH = np.append(0, LEVELS), np.append(LEVELS - 1, 1 << 62)


def groups_of(batches: Iterator[pa.RecordBatch], hashes: WordHashes, limit: int = GROUP_TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens, starts): rows of about ``limit`` tokens, the word hashes of their texts, each text closed by the
    end token, and where each text starts."""
    for batch in batches:
        first, parts, starts, at = 0, [], [], 0
        for i, text in enumerate(texts_of(batch)):
            words = hashes.of(words_lower(text))
            starts.append(at)
            at += len(words) + 1
            parts += [words, STOP]
            if at >= limit or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), np.hstack(parts).astype(np.uint64, copy=False), np.array(starts, np.int64)
                first, parts, starts, at = i + 1, [], [], 0


def histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token, START before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return before


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs (or its summed ``counts``)."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, counts = values[order], counts[order]
    if not len(values):
        return values, np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.diff(np.append(first, len(values))) if counts is None else np.add.reduceat(counts, first)


@dataclass(frozen=True)
class Grid:
    """Blocks of the filter: ``rows`` by the top bits of the word's hash, of 1 + ``cols`` blocks each; a row's block 0 has
    its words, the others its bigrams by the top bits of the history's hash."""

    rows: int
    cols: int

    @classmethod
    def of(cls, text_bytes: int, block_bytes: int = BLOCK_BYTES) -> Grid:
        n = rounds(text_bytes, block_bytes)
        rows = max(1, min(1 << 14, int(np.sqrt(n))))
        return cls(rows, min(1 << 14, -(-n // rows)))

    @property
    def blocks(self) -> int:
        return self.rows * (self.cols + 1)

    def row(self, word: np.ndarray) -> np.ndarray:
        return ((word >> np.uint64(48)) * np.uint64(self.rows)) >> np.uint64(16)

    def keys(self, block: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The block on top of as many mixed bits as there is room for."""
        bits = np.uint64(self.blocks.bit_length())
        return (block << (np.uint64(64) - bits)) | (mixed >> bits)

    def block(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.blocks.bit_length())).astype(np.int64)

    def bigrams(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        col = ((before >> np.uint64(48)) * np.uint64(self.cols)) >> np.uint64(16)
        return self.keys(self.row(word) * np.uint64(self.cols + 1) + col + np.uint64(1), mix(before * np.uint64(0xD6E8FEB86659FD93) + word))

    def words(self, word: np.ndarray) -> np.ndarray:
        return self.keys(self.row(word) * np.uint64(self.cols + 1), mix(word ^ np.uint64(0xA0761D6478BD642F)))


def packed(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Keys by their low ``width`` bytes, those that occur once first, and the counts of the others."""
    more = counts > 1
    keys, counts = np.concatenate((keys[~more], keys[more])), counts[more]
    return np.array([len(keys), len(counts)], np.int64).tobytes() + counts.tobytes() + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2)
    counts = np.concatenate((np.ones(n - m, np.int64), np.frombuffer(data, np.int64, m, 16)))
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, 16 + 8 * m).reshape(-1, width)
    return wide.view("<u8").ravel(), counts


def entries(key: np.ndarray, level: int) -> np.ndarray:
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)))


def masks(entry: np.ndarray) -> np.ndarray:
    return TWO_BITS[entry & np.uint64(4095)] | TWO_BITS[(entry >> np.uint64(12)) & np.uint64(4095)]


def build_block(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit words of the block that holds these different keys."""
    levels = np.searchsorted(LEVELS, counts, side="right")
    words = np.zeros(max(1, -(-int(levels.sum()) * BITS_PER_ENTRY // 64)), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        entry = entries(keys[levels >= level], level)
        np.bitwise_or.at(words, ((entry >> np.uint64(32)) * np.uint64(len(words))) >> np.uint64(32), masks(entry))
    return words


#: Kinds of packed counts: n-grams for the filter by 48 bits of their keys, and words by their whole hashes.
NGRAMS, WORDS = 0, 1
WIDTH = (6, 8)


def count_rows(training: DataFrame, grid: Grid) -> DataFrame:
    """(block, kind, data): packed counts of what each task found, added up for some millions of tokens at a time."""

    def emit(tokens: list[np.ndarray], bigrams: list[np.ndarray], texts: int) -> Iterator[pa.RecordBatch]:
        words, n = counted(np.concatenate(tokens))
        keys, m = counted(np.concatenate(bigrams))
        word_keys = grid.words(np.append(words, START))
        found = [(NGRAMS, keys, keys, m), (NGRAMS, word_keys, word_keys, np.append(n, texts)), (WORDS, word_keys[:-1], words, n)]
        for kind, place, values, counts in found:
            block = grid.block(place)
            order = np.argsort(block, kind="stable")
            block, values, counts = block[order], values[order], counts[order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            rows = [packed(values[a:b], counts[a:b], WIDTH[kind]) for a, b in zip(first, np.append(first[1:], len(block)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(np.full(len(first), kind, np.int32)), pa.array(rows, pa.binary())], names=["block", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tokens, bigrams, texts, held = WordHashes(), [], [], 0, 0
        for rows, t, starts in groups_of(batches, hashes):
            tokens.append(t)
            bigrams.append(grid.bigrams(histories(t, starts), t))
            texts, held = texts + rows.num_rows, held + len(t)
            if held >= 4 * GROUP_TOKENS:
                yield from emit(tokens, bigrams, texts)
                tokens, bigrams, texts, held = [], [], 0, 0
        if held:
            yield from emit(tokens, bigrams, texts)

    return training.select("text").mapInArrow(run, "block long, kind int, data binary")


def filter_blocks(training: DataFrame, grid: Grid) -> DataFrame:
    """(block, filter, words, counts, size, total): the filter's blocks; block 0 of a row also has exact word counts."""

    def build(t: pa.Table) -> pa.Table:
        held: tuple[list, list] = ([], [])
        for kind, data in zip(t.column("kind").to_pylist(), t.column("data"), strict=True):
            held[kind].append(unpacked(data.as_buffer(), WIDTH[kind]))
        ngrams, words = (counted(*(np.concatenate(x) for x in zip(*h, strict=True))) if h else (np.empty(0, np.uint64), np.empty(0, np.int64)) for h in held)
        data = [build_block(*ngrams).tobytes(), words[0].tobytes(), words[1].tobytes()]
        row = {"block": t.column("block")[0].as_py(), **dict(zip(("filter", "words", "counts"), data, strict=True)), "size": sum(map(len, data)), "total": int(words[1].sum()), "distinct": len(words[0])}
        return pa.Table.from_pylist([row], schema=BLOCK)

    return count_rows(training, grid).groupBy("block").applyInArrow(build, "block long, filter binary, words binary, counts binary, size long, total long, distinct long")


BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("filter", "words", "counts")), *((c, pa.int64()) for c in ("size", "total", "distinct"))])


@dataclass
class Part:
    """A run of blocks with the words of their rows."""

    grid: Grid
    first: int
    last: int
    owned: np.ndarray  # by block: this part answers for the block; other parts have word blocks twice
    offset: np.ndarray  # by block from ``first`` on: first word in ``data``
    size: np.ndarray  # number of words; 0 for blocks that hold nothing
    data: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def base(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def exact(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels probing finds of keys whose blocks are in this part."""
        found = np.zeros(len(keys), np.int64)
        block = self.grid.block(keys) - self.first
        at = np.flatnonzero(self.size[block])
        keys, offset, size = keys[at] & LOW48, self.offset[block[at]], self.size[block[at]]
        level = 0
        while len(at):
            level += 1
            entry = entries(keys, level)
            mask = masks(entry)
            hit = self.data[offset + (((entry >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)] & mask == mask
            at, keys, offset, size = at[hit], keys[hit], offset[hit], size[hit]
            found[at] = level
        return found


@dataclass
class Group:
    """Texts to score, by their tokens: places of bigrams and words in order of block, so that a part's are a run."""

    grid: Grid
    tokens: np.ndarray
    starts: np.ndarray

    def __post_init__(self) -> None:
        # START is the last of the words, though no token.
        words, code = np.unique(self.tokens, return_inverse=True)
        self.words, self.code = np.append(words, START), code
        keys = self.grid.bigrams(histories(self.tokens, self.starts), self.tokens)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        word_keys = self.grid.words(self.words)
        self.word_order = np.argsort(word_keys)
        self.word_keys = word_keys[self.word_order]
        # By word: known, base score, the denominator of what follows it, and p(word); by token: the numerator.
        self.known, self.base, self.below, self.p = np.zeros(len(self.words), np.int64), *np.zeros((3, len(self.words)))
        self.above = np.zeros(len(code))

    def run(self, keys: np.ndarray, first: int, last: int) -> slice:
        """Where the keys of blocks first ... last are."""
        low = lambda block: np.uint64(block << (64 - self.grid.blocks.bit_length()))
        return slice(int(np.searchsorted(keys, low(first))), int(np.searchsorted(keys, low(last + 1))))

    def add(self, part: Part, mu: float) -> None:
        """What a part gives; its cost is that of its own words and bigrams."""
        here = self.run(self.word_keys, part.first, part.last)
        at, keys = self.word_order[here], self.word_keys[here]
        level = part.levels(keys)
        self.p[at] = part.base(LOW[level])
        own = part.owned[self.grid.block(keys) - part.first]
        at, n = at[own], part.exact(self.words[at[own]])
        self.known[at], self.base[at], self.below[at] = n > 0, np.log10(part.base(n)), np.log10(HIGH[level[own]] + mu)
        here = self.run(self.keys, part.first, part.last)
        at, keys = self.order[here], self.keys[here]
        mine = part.owned[self.grid.block(keys) - part.first]
        at, keys = at[mine], keys[mine]
        self.above[at] = np.log10(LOW[part.levels(keys)] + mu * self.p[self.code[at]])

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, what all parts so far gave. START's denominator is each text's first; nothing follows the end."""
        model = self.above - np.where(self.tokens == STOP, 0.0, self.below[self.code])
        model[self.starts] -= self.below[-1]
        return tuple(np.add.reduceat(x, self.starts) for x in (self.known[self.code], self.base[self.code], model))


def spans(sizes: dict[int, int], grid: Grid, limit: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, from): runs of blocks of at most about ``limit`` bytes; each begins with its row's word block, and
    answers for its own blocks from ``from`` on. Every block of the grid is in one run."""
    start, held, width = 0, 0, grid.cols + 1
    for block in range(grid.blocks):
        size = sizes.get(block, 0)
        if held and held + size > limit and block > start:
            yield start - start % width, block - 1, start
            start, held = block, (sizes.get(block - block % width, 0) if block % width else 0)
        held += size
    yield start - start % width, grid.blocks - 1, start


def part_of(blocks: DataFrame, grid: Grid, span: tuple[int, int, int], total: int, distinct: int) -> Part:
    """A part, gathered on the driver; one at a time is there."""
    first, last, start = span
    number, width = F.col("block"), grid.cols + 1
    # Where a run begins inside a row, the blocks between the row's words and the run are others'.
    got = blocks.where(number.between(start, last) | (number == first)).select("block", "filter", "words", "counts").orderBy("block").toArrow()
    offset, size = np.zeros(last - first + 1, np.int64), np.zeros(last - first + 1, np.uint64)
    at = np.array(got.column("block").to_pylist(), np.int64) - first
    n = np.array([len(x.as_buffer()) // 8 for x in got.column("filter")], np.int64)
    offset[at], size[at] = np.cumsum(n) - n, n
    joined = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in got.column(c)), kind)
    words, counts = joined("words", np.uint64), joined("counts", np.int64)
    order = np.argsort(words)
    owned = np.arange(first, last + 1) >= start
    return Part(grid, first, last, owned, offset, size, joined("filter", np.uint64), words[order], counts[order], total, distinct)


def score_documents(docs: DataFrame, held_out: Column, mu: float = MU, part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a model of the rows for which ``held_out`` isn't true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score and score (double).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    grid = Grid.of(training.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes)
    blocks = checkpoint(filter_blocks(training, grid))
    sizes = {r.block: r.size for r in blocks.select("block", "size").toLocalIterator()}
    total, distinct = (int(x or 0) for x in blocks.agg(F.sum("total"), F.sum("distinct")).first())
    source = docs.select("doc_id", "held_out", *row_key(), "text")
    every = list(spans(sizes, grid, part_bytes))
    per_pass = max(1, pass_bytes // part_bytes)
    passes = [every[i : i + per_pass] for i in range(0, len(every), per_pass)]
    scored = []
    for some in passes:
        shared = [spark.sparkContext.broadcast(part_of(blocks, grid, span, total, distinct)) for span in some]

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for rows, tokens, starts in groups_of(batches, hashes):
                group = Group(grid, tokens, starts)
                for one in shared:
                    group.add(opened(one), mu)
                lengths = np.diff(np.append(starts, len(tokens)))
                known, base, model = group.sums()
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), *map(pa.array, (lengths, known, np.full(len(starts), total, np.int64), base, model))], schema=SCHEMA)

        part = source.mapInArrow(run, "doc_id long, held_out boolean, _id long, _th long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        if len(passes) > 1:
            part = checkpoint(part)
            for one in shared:
                one.destroy()
        scored.append(part)
    keep = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if len(scored) == 1:
        return scored[0].select(*keep)
    added = scored[0]
    for more in scored[1:]:
        added = added.unionByName(more)
    copies = F.count("*") / F.lit(len(scored))  # rows of this id and text
    added = added.groupBy("doc_id", "held_out", "_id", "_th", "n_tokens", "train_tokens").agg(
        copies.cast("int").alias("_copies"), (F.sum("n_known") / copies).cast("long").alias("n_known"), (F.sum("base_score") / copies).alias("base_score"), (F.sum("score") / copies).alias("score")
    )
    return added.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*keep)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("_id", pa.int64()), ("_th", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those whose crc32(doc_id) mod 5 isn't 1."""
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
