"""Draining a drop folder: files are copied on as rows and leave the folder once they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discoforge.functions.text import basename
from discoforge.functions.values import audio_format


def waiting(spark: SparkSession, folder: str) -> DataFrame:
    """W19 dry run. The files that a drain would take: path, name and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", basename("path").alias("name"), F.col("length").alias("size"))


def drain(spark: SparkSession, folder: str, target: str, checkpoint: str, clean: bool = True) -> int:
    """W19, W22. Copy what waits in a folder into a Parquet table, as name, size, md5, format by the first bytes, and content; the number of files.

    One run takes all that is there. The checkpoint remembers what was written, so a run after a failure neither
    loses nor repeats a file. With clean, files of earlier runs are deleted once a later run has completed,
    never before they are safely written.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("cleanSource", "delete" if clean else "off")
        .load(folder)
    )
    rows = stream.select(basename("path").alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"), audio_format("content").alias("format"), "content")
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
