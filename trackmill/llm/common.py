"""Shared folder, written tables and byte helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word of the query contracts
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    A local session that names no such folder (a test) gets a temporary one; on a cluster, whose machines share none, that
    raises.
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
    """Write df as Parquet and read it back: cuts the lineage, and survives the loss of an executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> F.Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.encode(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), "UTF-8")


def open_fs(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed_file(uri: str):
    """A file that appears under its name only when it is whole; a task that is run again replaces it."""
    files, path = open_fs(uri)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    stream = files.open_output_stream(part, compression=None)
    try:
        yield stream
    except BaseException:
        stream.close()
        files.delete_file(part)
        raise
    stream.close()
    from pyarrow import fs

    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_file(path)  # some stores don't rename over a file
    files.move(part, path)


def binary_parts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow binary or string array as (bytes, starts, ends); null rows are empty."""
    import pyarrow as pa

    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def windows_of(batch, columns: list[str], limit: int = 1 << 23):
    """Slices of an Arrow batch of about limit bytes of the named columns: bounds the memory of vector work."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        _, a, b = binary_parts(batch.column(c))
        size += b - a
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held)
        if n <= 1 << 23:
            _powers[base] = held
    return held[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each data[start : stop], in rising order and not overlapping; about `block` bytes are worked on at once."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        low = int(starts[a])
        z = max(a + 1, int(np.searchsorted(stops, low + block, "right")))
        n = int(stops[z - 1]) - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n] + np.uint64(1)) * _powers_of(_BASE, n), out=sums[1:])
        h = (sums[stops[a:z] - low] - sums[starts[a:z] - low]) * _powers_of(pow(_BASE, -1, 1 << 64), n + 1)[starts[a:z] - low]
        h = (h ^ (h >> np.uint64(29))) * _C1
        out[a:z] = h ^ (h >> np.uint64(32))
        a = z
    return out


def joined_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width neighbours."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * _C2
        out ^= out >> np.uint64(32)
    return out


def word_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, edges) of the runs of bytes that belong to words, in texts data[begins[i] : ends[i]] that stand side
    by side; the words of text i are those from edges[i] to edges[i + 1]. inside tells for each byte whether it belongs."""
    within = inside[data]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    filled = ends > begins
    for edge, at in ((first, begins[filled]), (last, ends[filled] - 1)):
        edge[at] = within[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.append(np.searchsorted(starts, begins), len(starts))
