"""Results in chunks: a run does only what is missing."""

import shutil

from pyspark.sql import functions as F

from trackmill.sources import chunks


def test_only_missing_chunks_are_worked_out(spark, tmp_path):
    videos = spark.createDataFrame([("007", 2000), ("b=/x", 900), ("none", 0), (None, 50), ("tail", 901)], "video string, n_frames long")
    path, asked = str(tmp_path / "cache"), []

    def compute(missing):
        """A row for each hundredth frame, but none in the chunks that begin at 900."""
        asked.append(sorted((r.video, r.chunk, r.last) for r in missing.collect()))
        return missing.where("chunk <> 900").select("video", "chunk", F.explode(F.sequence("first", "last", F.lit(100).cast("long"))).alias("frame"))

    every = [("007", 0, 899), ("007", 900, 1799), ("007", 1800, 1999), ("b=/x", 0, 899), ("tail", 0, 899), ("tail", 900, 900)]
    assert sorted((r.video, r.chunk, r.last) for r in chunks.expected_chunks(videos).collect()) == every
    assert chunks.missing_chunks(videos, path).count() == 6
    assert chunks.fill_chunks(videos, path, compute) == 6 and asked.pop() == every
    rows = sorted(map(tuple, chunks.read_chunks(spark, path, "frame long").collect()))
    assert len(rows) == 9 + 2 + 9 + 9 and {r[0] for r in rows} == {"007", "b=/x", "tail"}

    assert chunks.fill_chunks(videos, path, compute) == 0 and not asked  # nothing is missing, nothing runs

    gone = [p for p in (tmp_path / "cache" / "data").glob("*/*") if "007" in str(p)]
    assert len(gone) == 2
    for p in gone:
        shutil.rmtree(p)
    assert chunks.read_chunks(spark, path, "frame long").count() == 18
    assert chunks.fill_chunks(videos, path, compute) == 2 and asked.pop() == [("007", 0, 899), ("007", 1800, 1999)]
    assert sorted(map(tuple, chunks.read_chunks(spark, path, "frame long").collect())) == rows


def test_a_broken_run_leaves_nothing_that_counts(spark, tmp_path):
    videos, path = spark.createDataFrame([("a", 1800)], "video string, n_frames int"), str(tmp_path / "cache")
    spark.createDataFrame([(5, "a", 0), (6, "a", 0)], "frame long, video string, chunk long").write.partitionBy("video", "chunk").parquet(f"{path}/data")
    assert chunks.missing_chunks(videos, path).count() == 2  # written, but without a note
    compute = lambda m: m.select("video", "chunk", F.col("first").alias("frame"))
    assert chunks.fill_chunks(videos, path, compute) == 2
    assert sorted(r.frame for r in chunks.read_chunks(spark, path, "frame long").collect()) == [0, 900]
    longer = videos.withColumn("n_frames", F.lit(2000))
    assert chunks.fill_chunks(longer, path, compute) == 1 and chunks.missing_chunks(longer, path).count() == 0
    part = next((tmp_path / "cache" / "data" / "video=a" / "chunk=900").glob("*.parquet"))
    part.unlink()
    assert [r.chunk for r in chunks.missing_chunks(longer, path).collect()] == [900]
