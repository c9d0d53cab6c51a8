"""Chunk deduplication over a stream of files, with the state kept by digest.

A stream of (doc_id, text, ts) rows becomes its chunks; a chunk that has not been seen within the watermark is passed on.
Late rows are recomputed like any other: without a watermark, nothing is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.dialect import SPARK
from sieveworks.operators import chunks


def stream_chunks(files: DataFrame, size: int = 4096) -> DataFrame:
    """The chunks of a stream: doc_id, pos, chunk (digest), n_bytes."""
    files.createOrReplaceTempView("streamed_files")
    return files.sparkSession.sql(chunks.pieces(SPARK, size, "streamed_files")).select("doc_id", "pos", F.sha2("hx", 256).alias("chunk"), (F.length("hx") / 2).cast("long").alias("n_bytes"))


def new_chunks(files: DataFrame, size: int = 4096) -> DataFrame:
    """Each chunk of the stream once, at its first arrival."""
    return stream_chunks(files, size).dropDuplicates(["chunk"])


def windowed_volume(files: DataFrame, *, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Bytes and files that arrived by window of event time ts, rows up to `late` behind still counted."""
    return files.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("n_bytes")).select(F.col("window.start").alias("start"), "files", "n_bytes")
