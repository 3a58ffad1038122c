"""Rule extraction over a stream of note files: an extension of ours, the operators above are all batch.

Sections are carried along the lines of one document, so the work is stateless between documents: each micro-batch is
extracted like a table.  The sink writes one folder per batch id and overwrites it, so a repeated batch is not doubled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.settings import Settings
from ..operators.extract import extract


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, raw of ``*.txt`` files as they arrive."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("raw"))


def extract_stream(docs: DataFrame, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Start the query; concepts of batch n go to ``out/batch=n``; it ends when all files that are there are done."""

    def write(batch: DataFrame, n: int) -> None:
        concepts = extract(batch, settings).drop("ord")
        concepts.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
