import numpy as np

from trackmill.operators.tracking import link_tracks
from trackmill.streaming import streams


def test_live_tracks_equal_those_of_a_batch(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = []
    for video in ("v", "w"):
        for f in range(60):
            if r.random() > 0.2:
                rows.append((video, f, len(rows), 1000 + 12 * f + r.normal(), 1500 - 40 * f + 0.9 * f * f, 34.0, 0.9))
            rows.append((video, f, len(rows), 3000 + 3 * r.normal(), 400.0, 30.0, 0.8))
    cands = spark.createDataFrame(rows, "video string, frame int, det_seq long, cx double, cy double, d double, conf double").coalesce(1)
    (tmp_path / "in").mkdir()
    seen = spark.readStream.schema(cands.schema).parquet(str(tmp_path / "in"))
    for k in range(3):
        cands.where(f"frame between {20 * k} and {20 * k + 19}").write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.live_tracks(seen).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    kept = found.groupBy("video", "track").count().where("count >= 4").drop("count")
    assert sorted(found.join(kept, ["video", "track"]).collect()) == sorted(link_tracks(cands).where("true").collect())
    assert found.where("track < 0").count() == 0
    cands.where("frame = 59").limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.live_tracks(seen).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("track < 0").count() == 1
