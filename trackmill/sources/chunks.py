"""Results in chunks of a video's frames that a later run can complete: what is there isn't worked out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 900  # fixed value: frames of a chunk
KEY = ["video", "chunk"]
DONE = "video string, chunk long, n_rows long, run long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def expected_chunks(videos: DataFrame, frames: int = CHUNK) -> DataFrame:
    """(video, chunk, first, last) of every chunk of videos (video, n_frames): chunk is its first frame's number, last is
    its own last frame. Videos without frames have no chunk."""
    each = videos.where(F.col("video").isNotNull() & (F.col("n_frames") > 0)).select(F.col("video").cast("string").alias("video"), F.col("n_frames").cast("long").alias("_n"))
    rows = each.select("video", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(frames).cast("long"))).alias("chunk"))
    return rows.select("video", "chunk", F.col("chunk").alias("first"), (F.least(F.col("chunk") + frames, F.col("_n")) - 1).alias("last"))


def done_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(video, chunk, n_rows) of the chunks below path that are whole: the note that was made of a chunk after it was written
    says as many rows as there are now. A chunk without rows has a note only."""
    notes = _read(spark, f"{path}/done", DONE).groupBy(*KEY).agg(F.max_by("n_rows", "run").alias("n_rows"))
    there = _read(spark, f"{path}/data", "video string, chunk long").groupBy(*KEY).agg(F.count("*").alias("_there"))
    return notes.join(there, KEY, "left").where(F.col("n_rows") == F.coalesce("_there", F.lit(0))).select(*KEY, "n_rows")


def missing_chunks(videos: DataFrame, path: str, frames: int = CHUNK) -> DataFrame:
    """The expected chunks that aren't done: an anti-join."""
    return expected_chunks(videos, frames).join(done_chunks(videos.sparkSession, path), KEY, "left_anti")


def fill_chunks(videos: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], frames: int = CHUNK) -> int:
    """Work out what is missing below path, and tell how many chunks that was.

    compute takes the missing chunks (video, chunk, first, last) and gives rows with video and chunk. Rows are written first,
    each chunk's in place of what a broken run may have left, and notes of them then; so a run that stops in between leaves
    chunks that the next one does again, and never half a chunk that counts as done.
    """
    spark = videos.sparkSession
    runs = _read(spark, f"{path}/done", DONE)
    run = (runs.agg(F.max("run")).first()[0] or 0) + 1
    asked = f"{path}/asked/run={run}"
    missing_chunks(videos, path, frames).write.mode("overwrite").parquet(asked)  # what is missing changes while it is filled
    missing = spark.read.parquet(asked)
    n = missing.count()
    if not n:
        return 0
    rows = compute(missing)
    rows = rows.withColumns({"video": F.col("video").cast("string"), "chunk": F.col("chunk").cast("long")}).join(missing.select(*KEY), KEY, "left_semi")
    rows.repartition(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(f"{path}/data")
    there = _read(spark, f"{path}/data", "video string, chunk long").groupBy(*KEY).agg(F.count("*").alias("n_rows"))
    notes = missing.select(*KEY).join(there, KEY, "left").select(*KEY, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.lit(run).cast("long").alias("run"))
    notes.write.mode("append").parquet(f"{path}/done")
    return n


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all chunks that are done; schema: of the rows, without video and chunk."""
    rows = _read(spark, f"{path}/data", f"{schema}, video string, chunk long")
    return rows.join(done_chunks(spark, path).select(*KEY), KEY, "left_semi")
