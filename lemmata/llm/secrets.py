"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. The ledger has the (blob, rule version) pairs that have
been scanned, with their findings; a run scans only blobs that the ledger lacks at the present rule version, each once
however many paths have it, and joins the findings back to all paths.

The rules are data: kind, pattern, and least length of the span or group that counts. Base kinds: assign, access, hex.
The method's own: github and slack tokens, JSON web tokens, private-key blocks, and URLs with a password.

Memory: one text at a time per task. The choice of one row per blob and the joins back shuffle digests, ids and findings; texts
are shuffled once, to meet the list of rows to scan. A blob that a third of all rows share is one scanned text, and its
findings meet its paths in a join that Spark may split.

Nulls: a null text is the empty text. Rows of the same id and text are repeated rows and each gets the findings. A null
doc_id is kept as it is. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, texts_of

#: Kind: (pattern, group whose length counts, its least length), in the order of kinds at one start. A least length is
#: put into the pattern where shorter runs can't hide a match: runs of one class of characters.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "github": (r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "url": (r"://[^/\s:@]{1,100}:([^/\s:@]+)@", 1, 1),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, spans array<struct<kind: string, start: int, end: int>>"


def compiled() -> list[tuple[int, str, re.Pattern, int, int]]:
    return [(k, kind, re.compile(p, re.ASCII), group, least) for k, (kind, (p, group, least)) in enumerate(RULES.items())]


def spans_of(text: str, rules) -> list[dict]:
    """All findings of a text by start, then kind as listed."""
    found = [(m.start(), k, kind, m.end()) for k, kind, pattern, group, least in rules for m in pattern.finditer(text) if len(m[group]) >= least]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger written at ``path``, each blob and rule version once; empty where none has been written yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)
    return rows.dropDuplicates(["blob", "rule_version"])


def append_ledger(new: DataFrame, path: str) -> None:
    """Add what a run has scanned. A run that is repeated after a failure writes the same rows again, which reading drops."""
    new.write.mode("append").partitionBy("rule_version").parquet(path)


def paths_of(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, _id, _th) for every row of (doc_id, text)."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("blob"), *row_key())


def scanned(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger rows for the blobs of ``docs`` that ``ledger`` lacks at this rule version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = compiled()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [spans_of(t or "", rules) for t in texts_of(batch)]
            n = len(spans)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([RULE_VERSION] * n, pa.string()), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    one = paths_of(docs).groupBy("blob").agg(F.min(F.struct("_id", "_th")).alias("row"))
    known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
    todo = one.join(known, "blob", "left_anti").select("blob", "row._id", "row._th")
    texts = docs.select(*row_key(), "text").join(todo, ["_id", "_th"])
    # Repeated rows of one id and text come to the same blob twice; the ledger holds it once.
    return texts.select("blob", "text").mapInArrow(run, LEDGER).dropDuplicates(["blob", "rule_version"])


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``docs``, from a ledger that has all of their blobs."""
    known = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return paths_of(docs).select("doc_id", "blob").join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all paths, and the ledger rows to append."""
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ledger
    new = scanned(docs, ledger)
    return findings(docs, ledger.unionByName(new)), new


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an empty ledger."""
    found, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
