"""The same stateless plan over a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavegrid.operators import post
from wavegrid.runtime import ship
from wavegrid.sources import audio


def arriving(spark: SparkSession, folder: str, *, pattern: str = "*.wav", max_files: int = 64) -> DataFrame:
    """A stream of (path, content) of the files that appear in ``folder``."""
    ship(spark)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
    return source.load(folder).select("path", "content")


def predictions(recordings: DataFrame, scorer, *, overlap_s: float = 0.0, batch_size: int = 100, min_confidence: float = 0.1, sensitivity: float = 1.0) -> DataFrame:
    """Predictions of each interval of each arriving recording; no state is kept
    between recordings."""
    rows = audio.scores(recordings, scorer, overlap_s=overlap_s, batch_size=batch_size)
    return post.predictions(rows, list(scorer.species), sensitivity=sensitivity, min_confidence=min_confidence)


def start(rows: DataFrame, target: str, checkpoint: str, *, available_now: bool = True):
    """Writes a stream to Parquet, each file's rows once."""
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
