"""Papers that arrive as files: extraction is stateless, so the batch operators run on the stream unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def paper_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(paper_id, tex): a row for each .tex file that appears in ``path``; its path is its id."""
    files = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.tex").text(path)
    return files.select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("tex"))


def append(papers: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Write what a stateless ``operator`` makes of a stream of papers to Parquet, exactly once, until the input is used up."""
    return operator(papers).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
