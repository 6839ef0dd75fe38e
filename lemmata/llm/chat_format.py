"""Chat formatting from event logs.

A log has events (conv_id, seq, turn, kind, role, text). Kinds: ``message`` and ``edit`` set a turn's text, ``delta``
appends to it, ``regenerate`` sets it and takes back all later turns logged before it, ``delete`` takes the turn away
until it is set again. The fold, partitioned by conversation and sorted by sequence, gives the final turns; each is
rendered between control strings:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Texts and roles are escaped reversibly (& < to &amp; &lt;, in roles the line feed too), so no control string can come
from them. ``loss`` has the start and end (code points) of each assistant text in the rendering.

DataFrame functions only. Windows and groups share one partitioning by conversation; offsets are running sums, so a
conversation of n turns costs n log n. What meets in one task is one conversation, which is one row of the result.

Nulls: a null text or role is empty, a null kind is ``message``. A null conv_id is a conversation. Events of the same
sequence number are taken in order of turn, kind, role and text; repeated events count each time. Other columns are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Spans under the loss mask up to which each is read as a substring of the rendering.
SUBSTRINGS = 64


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def final_turns(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what the fold leaves of each conversation."""
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "turn", "kind", "role", "text")))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # What was logged before the latest regeneration of this or a lower turn is gone.
    cut = F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).over(earlier)
    e = e.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("at") >= F.col("cut")))
    own = Window.partitionBy("conv_id", "turn")
    set_ = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(own)
    e = e.withColumn("set", set_).where(F.col("set").isNull() | (F.col("at") >= F.col("set")))
    pieces = F.array_sort(F.collect_list(F.struct("at", "kind", "role", "text")))
    folded = e.groupBy("conv_id", "turn").agg(pieces.alias("p"))
    folded = folded.where(F.element_at("p", 1)["kind"] != "delete")
    return folded.select("conv_id", "turn", F.element_at("p", 1)["role"].alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation from (conv_id, turn, role, text)."""
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    t = turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    t = t.withColumn("start", start)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    return t.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("formatted"), F.array_sort(F.collect_list(span)).alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the renderings say: number and digest of turns, and size and digest of the text under the loss mask."""
    pattern = F.lit(r"<\|im_start\|>([^<\n]*)\n([^<]*)<\|im_end\|>\n")
    f = formatted.withColumn("roles", F.regexp_extract_all("formatted", pattern, F.lit(1))).withColumn("texts", F.regexp_extract_all("formatted", pattern, F.lit(2)))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(unescaped(r), F.lit("\n"), unescaped(t), F.lit("\n"))), "")
    at = lambda s: ((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    # A substring costs what is before it; of many, all are cut from one array of characters.
    few = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), *at(s))))
    many = F.transform(F.array(F.split("formatted", "")), lambda c: F.transform("loss", lambda s: unescaped(F.array_join(F.slice(c, *at(s)), ""))))[0]
    under = F.array_join(F.when(F.size("loss") <= SUBSTRINGS, few).otherwise(many), "")
    f = f.withColumn("under", under)
    return f.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """A finished table of (conv_id, turn, role, text) as a log: each row sets a turn of its own, in order of turn."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", place.alias("turn"), place.alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(rendered(final_turns(log_of(rows))))


OP10_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 12 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 11 AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
