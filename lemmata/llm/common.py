"""Shared pieces of the training-data operators: tables, checkpoints, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The byte string of the end-of-text token; no word holds white space.
END = b"\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read with Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset and Spark runs in one process (tests), one of its warehouse; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Spark deletes the shuffle files behind it once the driver's JVM has collected their last reference, which an idle
    heap puts off, so a collection is asked for here: what loops leave on disk is then one round, not all of them.
    A caller that passes an expression, not a variable, lets go of the frame that was cut.
    """
    context = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    cut = df.checkpoint(eager=True)
    del df
    context._jvm.java.lang.System.gc()
    return cut


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def enclosed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` in one, ``row``, beside ``more``: none of the caller's names can meet one of ours."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), *more)


def released(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, by their names and in their order, some of them changed."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two non-null longs that tell documents apart: rows that agree in id and text are one document."""
    return [F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """One text after another, so that never all of a batch are held twice."""
    return (x.as_py() for x in batch.column(column))


def opened(shared: Broadcast):
    """A broadcast's value, of which the broadcast itself keeps nothing: the next one takes its room."""
    value = shared.value
    vars(shared).pop("_value", None)
    return value


def rounds(total: int, limit: int) -> int:
    """How many parts of at most about ``limit`` a whole of ``total`` makes; at least one."""
    return max(1, -(-int(total) // limit))


class WordHashes(dict):
    """64-bit hashes of words (bytes or strings), remembered for a quarter of a million words per task (some 45 MB)."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_lower(text: str | None) -> list[bytes]:
    """The words of a text as bytes, A-Z lower-cased; ``bytes.split`` knows just the ASCII white space of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
