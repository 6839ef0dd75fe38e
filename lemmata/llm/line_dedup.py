"""Line dedup by content-defined chunks of lines, extended word by word.

A text is read as lines: clauses, whatever its line ends. A line of over ``LONG_LINE`` bytes is cut at words: of
those whose hash is less than both neighbours', the least of ``W`` in a row begins a line of its own; so long lines are
cut alike wherever they stand. A line begins a chunk unless the line before it is a short one. Chunks are known by the
hash of their lines' hashes, in which a line feed is a space and white space at a line's ends is nothing. Of chunks that occur more than once in all texts,
all occurrences but the first (least doc_id, then text hash and place) are repeated. Neighbours with the same first text
and distance are one match. A match is compared whole with the place of its first occurrence, and both of its ends are
then extended word by word, up to ``REACH`` words. What goes are matches, joined where they touch, of ``LEAST_CHARS``
characters or more; shorter repeats (headings, licence lines) stay. Within one text, a chunk that begins in the ``SPAN``
lines after the first is a part of it, so text with a short period keeps that much.

A passage is seen where it holds a whole chunk: of clauses under ``LONG_LINE`` bytes, one or two; of longer ones,
2 * W words of least hash, 18 words in the mean. An end is compared with the first occurrence of its own chunk: where
those words stand earlier in another passage too, the words of a chunk's length at the end of a longer repeat may stay.

Matches are compared byte by byte, line feeds and white space at a line's ends aside: the text of a first occurrence, and
the words beside it, travel to the documents that repeat it. So clashing hashes cost a match, never text.

DataFrame functions only. Texts are cut within their own rows. Chunks (hashes and places, no text) are shuffled by hash,
once: what occurs once is left out by a count, and a window finds the first of the others. A hot passage's rows meet in
one task, which may spill them. Places of first occurrences are joined to the documents, broadcast up to
``BROADCAST_PLACES`` of them, beyond that by a shuffle of the texts; what goes is joined back by a shuffle of the texts.

Nulls: a null text stays null. A null id orders first. Rows that agree in id and text are one document, so neither
loses text to the other. Other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpoint, enclosed, released, row_key, table

EVERY, LONG, LEAST_CHARS = 2, 200, 150
#: Zero-width cuts: at the edges of long physical lines; after each line feed, and after a stop and a space.
EDGES = rf"(?<=\n)(?:(?=[^\n]{{{LONG}}})|(?<=[^\n]{{{LONG}}}\n))"
LINES = r"(?<=\n)|(?<=[.!?] )"

#: Clauses, which end after a sign and a space: as pieces that are read forward, which costs less than to look back from
#: each place for their ends. A text that ends as a clause does has an empty one at its end, an empty text is one.
SIGN, AFTER = r".!?,;:", r"\x20\t\n\r"
CLAUSE = rf"(?!\z)[^{SIGN}]*(?:[{SIGN}]++[^{SIGN}{AFTER}][^{SIGN}]*)*+(?:[{SIGN}]++[{AFTER}]|[{SIGN}]*+\z)|(?<=[{SIGN}][{AFTER}])\z|\A\z"
#: Bytes of a line that is cut at words, and of one that does not end its chunk.
LONG_LINE, SHORT_LINE = 160, 16
#: Words of least hash of which the least begins a line, bytes at which a word is cut, and words that an end may gain.
W, PIECE, REACH = 3, 16, 24
#: Lines beside a match, and characters of them, in which such words are looked for; lines after a chunk in which its repeat is a part of it.
NEAR, NEAR_CHARS, SPAN = 4, 160, 4
#: Places of first occurrences (some 40 bytes each) up to this number are broadcast.
BROADCAST_PLACES = 1_000_000
#: A rank is the hash of a word with its place in the low bits.
PLACE = (1 << 24) - 1
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"\x20\x09-\x0D"
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
INSIDE = rf"(?<={UNSPACED})(?=[^{BLANK}])|(?<=\G[^{BLANK}]{{{PIECE}}})(?=[^{BLANK}])"
#: A word and the white space after it, or white space that begins a text; an empty text is one.
TOKEN = rf"[^{BLANK}]+[{BLANK}]*|\A[{BLANK}]+|\A\z"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; a fold over nothing, as a transform would copy the whole result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, use)


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spaced(text: Column) -> Column:
    """The text with its line feeds as spaces; over a long text in less time than ``replace`` takes."""
    return F.array_join(F.split(text, "\n"), " ")


def _pieces(words: Column, maybe, long, cut) -> Column:
    """Elements of an array, the long ones cut into several; ``maybe`` is a cheaper test that all long ones pass."""
    cut_up = lambda w: F.flatten(F.transform(w, lambda x: F.when(long(x), cut(x)).otherwise(F.array(x))))
    return bound(words, lambda w: F.when(F.exists(w, maybe), cut_up(w)).otherwise(w))


def _inside(word: Column) -> Column:
    return F.split(word, INSIDE)


def words_of(text: Column) -> Column:
    long = lambda x: F.octet_length(x) > PIECE
    return _pieces(F.split(text, SPACE), long, long, _inside)


def tokens_of(text: Column) -> Column:
    """The words of ``words_of``, each with the white space after it; they make up the whole text."""
    return _pieces(pieces(text, TOKEN), lambda x: F.octet_length(x) > PIECE, lambda x: F.octet_length(F.rtrim(x, F.lit(BLANKS))) > PIECE, _inside)


def joined(parts: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(parts, start + 1, F.greatest(end - start, F.lit(0))), "")


def cut_line(line: Column, feeds: bool = True) -> Column:
    """The pieces of a long line; without ``feeds`` it has no line feeds."""

    def of(tokens: Column) -> Column:
        flat = (lambda x: F.replace(x, F.lit("\n"), F.lit(" "))) if feeds else (lambda x: x)
        ranks = F.transform(tokens, lambda x, i: F.xxhash64(F.rtrim(flat(x))).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
        # No two ranks are equal, as their low bits differ; a neighbour that isn't there is null.
        less = lambda x, y: F.coalesce(x < y, F.lit(True))
        low = bound(ranks, lambda r: F.filter(r, lambda x, i: less(x, F.get(r, i - 1)) & less(x, F.get(r, i + 1))))
        least = bound(low, lambda m: F.transform(m, lambda x, i: F.least(x, *(F.get(m, i + k) for k in range(1, W)))))
        places = F.transform(F.array_distinct(least), lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int"))
        starts = F.array_union(F.array(F.lit(0)), places)
        return bound(starts, lambda s: F.transform(s, lambda at, k: joined(tokens, at, F.coalesce(F.get(s, k + 1), F.size(tokens)))))

    return bound(tokens_of(line), of)


def lines_of(text: Column, feeds: bool = True) -> Column:
    """The lines of a text; they make up the whole text."""
    long = lambda x: F.octet_length(x) > LONG_LINE
    return _pieces(pieces(text, CLAUSE), long, long, lambda x: cut_line(x, feeds))


def plain(line: Column) -> Column:
    """A line as it is compared: line feeds are spaces, and there are none at its ends."""
    return F.trim(F.replace(line, F.lit("\n"), F.lit(" ")))


def chunk_rows(text: Column) -> Column:
    """Array of (at, to, h): the chunks of a text by the number of their first line and of that after the last."""

    def of(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.octet_length(F.get(lines, i - 1)) >= SHORT_LINE))

        def chunk(hashes: Column, at: Column, to: Column) -> Column:
            # The hash of an array is that of its elements; most chunks are of one.
            several = F.xxhash64(F.slice(hashes, at + 1, to - at))
            return F.struct(at.alias("at"), to.alias("to"), F.when(to - at == 1, F.xxhash64(F.get(hashes, at))).otherwise(several).alias("h"))

        # ``to`` is used several times, so it is an argument, not an expression.
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(lines)))
        chunks = lambda h: bound(starts, lambda s: F.zip_with(s, ends(s), lambda at, to: chunk(h, at, to)))
        return bound(F.transform(lines, lambda x: F.xxhash64(F.trim(x))), chunks)

    # Line feeds as spaces beforehand: the lines are the same, and each is plain but for its ends.
    return bound(lines_of(spaced(text), feeds=False), of)


def chunks_of(text: Column) -> Column:
    """Arrays of (text, lines): the chunks of a text, in order; they make up the whole text."""

    def cut(lines: Column) -> Column:
        last = F.size(lines) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.xxhash64(F.get(lines, i - 1), F.get(lines, i)), F.lit(EVERY)) == 0))
        return bound(ends, lambda e: F.transform(e, lambda end, k: piece(lines, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1, end)))

    def piece(lines: Column, start: Column, end: Column) -> Column:
        return F.struct(F.array_join(F.slice(lines, start + 1, end - start + 1), "").alias("text"), (end - start + 1).alias("lines"))

    return F.flatten(F.transform(F.split(text, EDGES), lambda part: bound(F.split(part, LINES), cut)))


def _rows(docs: DataFrame) -> DataFrame:
    """(_id, _th, at, to, h): a row for each chunk."""
    rows = docs.where(F.col("text").rlike(WORD)).select(*row_key(), F.explode(chunk_rows(F.col("text"))).alias("a"))
    return rows.select("_id", "_th", "a.*")


def compared(lines: Column, start: Column, end: Column) -> Column:
    """Lines as one text to compare; a plain line has no line feed."""
    return F.array_join(F.transform(F.slice(lines, start + 1, end - start), plain), "\n")


def beside(lines: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Up to ``REACH`` words on both sides of a match, the nearest first."""
    long = lambda x: F.octet_length(x) > PIECE
    words = lambda c: _pieces(F.array_remove(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " "), ""), long, long, _inside)
    first = lambda w, c: F.slice(w, F.lit(1), F.least(F.lit(REACH), F.greatest(F.size(w) - (F.length(c) > NEAR_CHARS).cast("int"), F.lit(0))))
    nearest = lambda w, c: bound(w, lambda w: first(w, c))
    before, after = joined(lines, F.greatest(start - NEAR, F.lit(0)), start), joined(lines, end, F.least(end + NEAR, F.size(lines)))
    # Where characters are cut off, the last word may be a part of one.
    return nearest(F.reverse(words(F.right(before, F.lit(NEAR_CHARS)))), before), nearest(words(F.left(after, F.lit(NEAR_CHARS))), after)


def _first_places(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """(first_id, first_th, q_from, q_to, body, before, after) of the matches' first occurrences; the words beside them
    are joined by spaces, which none of them holds."""
    asked = matches.groupBy(F.col("first_id").alias("_id"), F.col("first_th").alias("_th")).agg(F.collect_set(F.struct("q_from", "q_to")).alias("qs"))
    asked = checkpoint(asked)
    if (asked.agg(F.sum(F.size("qs"))).first()[0] or 0) <= BROADCAST_PLACES:
        asked = F.broadcast(asked)

    def of(lines: Column) -> Column:
        def one(q: Column) -> Column:
            before, after = beside(lines, q["q_from"], q["q_to"])
            # Words travel as one string; an array of them takes several times the room.
            said = lambda words: F.array_join(words, " ")
            return F.struct(q["q_from"].alias("q_from"), q["q_to"].alias("q_to"), compared(lines, q["q_from"], q["q_to"]).alias("body"), said(before).alias("before"), said(after).alias("after"))

        return F.transform("qs", one)

    found = docs.select("text", *row_key()).join(asked, ["_id", "_th"])
    found = found.select(F.col("_id").alias("first_id"), F.col("_th").alias("first_th"), F.inline(bound(lines_of(F.col("text")), of)))
    return found.dropDuplicates(["first_id", "first_th", "q_from", "q_to"])


def removals(docs: DataFrame) -> DataFrame:
    """(_id, _th, gone): by row key, the matches (from, to, body, before, after) with what their first occurrences hold."""
    docs = docs.select("doc_id", "text")
    rows = _rows(docs).repartition("h")
    # The count asks for all columns, so that it reads the very shuffle that the rows themselves come from.
    several = rows.groupBy(F.col("h").alias("again")).agg(F.count("*").alias("c"), *(F.max(c).alias(f"any{c}") for c in ("_id", "_th", "at", "to"))).where("c > 1")
    rows = rows.join(several.hint("shuffle_hash"), F.col("h") == F.col("again")).where("anyat IS NOT NULL AND any_id IS NOT NULL AND any_th IS NOT NULL AND anyto IS NOT NULL")
    order = Window.partitionBy("h").orderBy("_id", "_th", "at")
    found = rows.withColumn("f", F.first(F.struct("_id", "_th", "at")).over(order))
    found = found.select("_id", "_th", "at", "to", F.col("f._id").alias("first_id"), F.col("f._th").alias("first_th"), (F.col("at") - F.col("f.at")).alias("shift"))
    own = (F.col("_id") == F.col("first_id")) & (F.col("_th") == F.col("first_th"))
    # Repeated rows of one id and text are one document: their chunks have the same place, so the first is none of its own repeats.
    found = found.where(~own | (F.col("shift") >= SPAN))
    order = Window.partitionBy("_id", "_th").orderBy("at")
    was = lambda c: F.lag(c).over(order)
    same = (was("first_id") == F.col("first_id")) & (was("first_th") == F.col("first_th")) & (was("shift") == F.col("shift"))
    goes_on = same & ((F.col("at") == was("to")) | (F.col("at") == was("at")))
    found = found.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("match", F.sum("begins").over(order))
    matches = found.groupBy("_id", "_th", "match").agg(F.min("at").alias("from"), F.max("to").alias("to"), *(F.min(c).alias(c) for c in ("first_id", "first_th", "shift")))
    matches = checkpoint(matches.select("_id", "_th", "from", "to", "first_id", "first_th", (F.col("from") - F.col("shift")).alias("q_from"), (F.col("to") - F.col("shift")).alias("q_to")))
    matches = matches.join(_first_places(docs, matches), ["first_id", "first_th", "q_from", "q_to"])
    return matches.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("from", "to", "body", "before", "after"))).alias("gone"))


def cut(text: Column, gone: Column, least_chars: int) -> Column:
    """(text, removed): ``text`` without the extended matches, and how many passages went.

    Between matches are gaps; only those are cut into words, and where what is beside two matches takes a whole gap, the
    two are one passage.
    """

    def common(mine: Column, said: Column) -> Column:
        return bound(mine, lambda mine: bound(F.split(said, " "), lambda there: agreeing(mine, there)))

    def agreeing(mine: Column, there: Column) -> Column:
        differ = F.filter(F.transform(mine, lambda x, i: F.when(x == F.get(there, i), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(differ, F.lit(0)), F.size(mine))

    def extended(lines: Column) -> Column:
        def one(g: Column) -> Column:
            before, after = beside(lines, g["from"], g["to"])
            return F.struct(g["from"].alias("from"), g["to"].alias("to"), common(before, g["before"]).alias("left"), common(after, g["after"]).alias("right"))

        return F.transform(F.filter(gone, lambda g: compared(lines, g["from"], g["to"]) == g["body"]), one)

    right = lambda spans, k: F.coalesce(F.get(spans, k - 1)["right"], F.lit(0))
    left = lambda spans, k: F.coalesce(F.get(spans, k)["left"], F.lit(0))

    def gaps_of(lines: Column, spans: Column) -> Column:
        """By number of the match after it, the gap: ``head`` and ``tail`` are the words of as many lines at its ends as an
        extension may take; ``middle`` is between, null in a narrow gap, which is all head."""
        none = F.array().cast("array<string>")

        def gap(k: Column) -> Column:
            lo, hi = F.coalesce(F.get(spans, k - 1)["to"], F.lit(0)), F.coalesce(F.get(spans, k)["from"], F.size(lines))
            apart = hi - lo > 2 * NEAR
            # Where nothing is taken at an end, it needs no words.
            words = lambda a, b, some: F.when(a < b, bound(joined(lines, a, b), lambda c: F.when(some, tokens_of(c)).otherwise(F.array(c)))).otherwise(none)
            some = (right(spans, k) > 0, left(spans, k) > 0)
            return F.struct(
                words(lo, F.when(apart, lo + NEAR).otherwise(hi), some[0] | (some[1] & ~apart)).alias("head"), F.when(apart, joined(lines, lo + NEAR, hi - NEAR)).alias("middle"),
                F.when(apart, words(hi - NEAR, hi, some[1])).otherwise(none).alias("tail"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(spans)), gap)

    def passages(lines: Column, spans: Column, gaps: Column) -> Column:
        """(kept, body): what stays before each passage, and the passage."""
        taken = lambda k: F.get(gaps, k)["middle"].isNull() & (F.size(F.get(gaps, k)["head"]) <= right(spans, k) + left(spans, k))
        opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | ~taken(k))

        def one(starts: Column) -> Column:
            def passage(s: Column, j: Column) -> Column:
                e = F.coalesce(F.get(starts, j + 1), F.size(spans))
                before, after = F.get(gaps, s), F.get(gaps, e)
                apart = before["middle"].isNotNull()
                last = F.when(apart, before["tail"]).otherwise(before["head"])
                rest = F.greatest(F.size(last) - left(spans, s), F.lit(0))
                kept = F.when(apart, F.concat(joined(before["head"], right(spans, s), F.size(before["head"])), before["middle"], joined(before["tail"], F.lit(0), rest))).otherwise(joined(before["head"], right(spans, s), rest))
                # Between the passage's own matches, gaps are taken whole.
                body = F.concat(joined(last, rest, F.size(last)), joined(lines, F.get(spans, s)["from"], F.get(spans, e - 1)["to"]), joined(after["head"], F.lit(0), right(spans, e)))
                return F.struct(kept.alias("kept"), body.alias("body"))

            return F.transform(starts, passage)

        return bound(opens, one)

    def without(found: Column, spans: Column, gaps: Column) -> Column:
        n = F.size(spans)
        last = F.get(gaps, n)
        rest = F.concat(joined(last["head"], right(spans, n), F.size(last["head"])), F.coalesce(last["middle"], F.lit("")), joined(last["tail"], F.lit(0), F.size(last["tail"])))
        # A passage that ends its line but doesn't begin it leaves the line's end.
        ends_line = lambda c: F.length(F.rtrim(c, F.lit(" \t\x0b\x0c\r"))) != F.length(F.rtrim(c, F.lit(BLANKS)))
        end = lambda x: F.when(F.length(x["body"]) < least_chars, x["body"]).when(ends_line(x["body"]) & (x["kept"] != "") & ~ends_line(x["kept"]), "\n").otherwise("")
        kept = F.array_join(F.transform(found, lambda x: F.concat(x["kept"], end(x))), "")
        return F.struct(F.concat(kept, rest).alias("text"), F.size(F.filter(found, lambda x: F.length(x["body"]) >= least_chars)).alias("removed"))

    none = F.struct(text.alias("text"), F.lit(0).alias("removed"))
    whole = lambda lines, s: bound(gaps_of(lines, s), lambda g: bound(passages(lines, s, g), lambda p: without(p, s, g)))
    return bound(lines_of(text), lambda lines: bound(extended(lines), lambda s: F.when(F.size(s) == 0, none).otherwise(whole(lines, s))))


def _deduplicated(docs: DataFrame, least_chars: int) -> DataFrame:
    """(row, words, removed): all columns of ``docs`` as one, the new text, and the number of passages that went."""
    # The matches of a partition's documents are small beside their texts, which needn't be sorted then.
    d = enclosed(docs, *row_key()).join(removals(docs).hint("shuffle_hash"), ["_id", "_th"], "left").withColumn("words", F.col("row").getField("text"))
    # Made by a generator, so that no later step has it computed again.
    new = F.when(F.col("gone").isNotNull(), cut(F.col("words"), F.col("gone"), least_chars))
    d = d.select("row", F.inline(F.array(F.struct(new.alias("cut"))))).withColumn("words", F.col("row").getField("text"))
    went = F.coalesce(F.col("cut.removed") > 0, F.lit(False))
    return d.select("row", F.when(went, F.col("cut.text")).otherwise(F.col("words")).alias("words"), F.coalesce(F.col("cut.removed").cast("long"), F.lit(0)).alias("removed"))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with _text, the text without repeated passages, and _removed, the number of passages that went; columns
    of these two names that ``docs`` has are left out."""
    kept = [c for c in docs.columns if c.lower() not in ("_text", "_removed")]
    d = _deduplicated(docs, least_chars)
    return d.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("words").alias("_text"), F.col("removed").alias("_removed"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with new texts (and n_chars); a document of which no word is left goes, one that had none stays."""
    d = _deduplicated(docs, least_chars).where((F.col("removed") == 0) | F.col("words").rlike(WORD))
    size = F.when(F.col("removed") > 0, F.length("words").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    return released(d, docs, text=F.col("words"), n_chars=size)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their texts after dedup."""
    d = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("_removed").alias("n_removed"), F.length("_text").cast("long").alias("n_chars"), F.col("_text").alias("text"))
