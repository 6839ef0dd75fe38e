"""Papers from files, and language models as injected functions."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latex_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """SRC-1, SRC-2: (path, tex) of all files below ``path`` that end in .tex, a row each.

    Bytes that aren't UTF-8 are dropped; ``strict`` fails on them instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").load(path)
    text = F.validate_utf8(F.col("content").cast("string")) if strict else F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select("path", text.alias("tex"))


def main_files(files: DataFrame) -> DataFrame:
    """SRC-6: of the (paper_id, path, tex) of each paper, the first that begins a document, else the first."""
    order = Window.partitionBy("paper_id").orderBy(F.coalesce(F.col("tex").contains("\\begin{document}"), F.lit(False)).desc(), "path")
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def answered(prompts: DataFrame, client: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """LLM-1: ``prompts`` with ``answer``, by a client that executors can pickle; an error's text is in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch[column]:
                try:
                    answers.append(client(prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one failed call mustn't fail the others of its task
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(answer=pd.Series(answers, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string, error string"
    return prompts.mapInPandas(run, schema)


def _members(data: bytes | None) -> list[tuple[str, bytes]]:
    """The .tex files in the bytes of an archive, read in memory: nothing is unpacked, so no path can lead outside."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data or b"")) as archive:
            return [(m.name, archive.extractfile(m).read()) for m in archive if m.isfile() and m.name.endswith(".tex")]
    except (tarfile.TarError, EOFError, OSError):
        return []


def archive_files(archives: DataFrame) -> DataFrame:
    """SRC-6: (paper_id, path, tex) of all .tex files in (paper_id, content), a tar archive each, compressed or not.

    What isn't an archive has no files. ``main_files`` chooses among them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paper, content in zip(batch["paper_id"], batch["content"], strict=True):
                found = _members(content)
                if found:
                    yield pd.DataFrame({"paper_id": paper, "path": [n for n, _ in found], "tex": [t.decode("utf-8", "ignore") for _, t in found]})

    kind = archives.schema["paper_id"].dataType.simpleString()
    return archives.select("paper_id", "content").mapInPandas(run, f"paper_id {kind}, path string, tex string")


def fetched(ids: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """SRC-4, SRC-5, SRC-7, SRC-8: (paper_id, key) with ``content``, by an injected function; null where it fails.

    The function may download an archive or a PDF by its id, or read the text layer or pages of one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for key in batch["key"]:
                try:
                    got.append(fetch(key))
                except Exception:  # noqa: BLE001  one failed call mustn't fail the others of its task
                    got.append(None)
            yield batch.assign(content=pd.Series(got, index=batch.index, dtype=object))

    kind = ids.schema["paper_id"].dataType.simpleString()
    return ids.select("paper_id", F.col("key").cast("string").alias("key")).mapInPandas(run, f"paper_id {kind}, key string, content binary")


def source_or_pdf(ids: DataFrame, fetch_source: Callable[[str], bytes], read_pdf: Callable[[str], bytes]) -> DataFrame:
    """SRC-11: (paper_id, text, origin) of (paper_id, key): the main file of a paper's archive, or where there is none, the
    text of its PDF, which ``read_pdf`` gives by the key as UTF-8."""
    main = main_files(archive_files(fetched(ids, fetch_source)))
    source = main.select("paper_id", F.col("tex").alias("text"), F.lit("source").alias("origin"))
    rest = ids.join(source.select("paper_id"), "paper_id", "left_anti")
    read = fetched(rest, read_pdf).where("content IS NOT NULL")
    return source.unionAll(read.select("paper_id", F.col("content").cast("string"), F.lit("pdf")))


def joined_pages(pages: DataFrame) -> DataFrame:
    """SRC-9: (paper_id, text) of (paper_id, page, text): pages in order, a blank line between."""
    return pages.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))


def first_text(*columns: str) -> Column:
    """SRC-10: the first of several readings of a document that has any text."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in columns))


def sniffed(texts: DataFrame) -> DataFrame:
    """SRC-12: ``texts`` with is_latex, true where a document begins or a section is."""
    return texts.withColumn("is_latex", F.coalesce(F.col("text").contains("\\begin{document}") | F.col("text").contains("\\section{"), F.lit(False)))
