"""Written tables between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    A local session that names none gets a temporary one; on a cluster, whose machines share no such folder, that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    if "://" not in base:
        if base.startswith("file:"):
            base = "file://" + base.removeprefix("file:")
        else:
            root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
            base = root.rstrip("/") + base if not root.startswith("file") else "file://" + base
    return f"{base}/trackmill-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Written tables with a record of each: its seconds and rows, counted while it is written, without a job of its own."""

    def __init__(self):
        self.records: list[tuple[str, float, int]] = []

    def written(self, name: str, df: DataFrame, path: str) -> DataFrame:
        seen, start = Observation(name), time.monotonic()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), path)
        self.records.append((name, round(time.monotonic() - start, 3), seen.get["n_rows"]))
        return out

    def lap(self, name: str, start: float, rows: int) -> None:
        """A stage that isn't a table: started at time.monotonic() `start`."""
        self.records.append((name, round(time.monotonic() - start, 3), rows))
