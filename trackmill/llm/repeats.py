"""Removal of byte strings that also start in a document with a smaller id.

Texts are kept once in sequential files of the shared folder, a chunk of documents each. Every 50-byte string has a
minimizer (the 16-byte string in it with the smallest hash, the leftmost of equals), and equal strings have it at the
same place. So documents are cut into segments, the runs of strings with one minimizer, and strings are compared only
where the minimizer occurs in more than one document. The different segments of some minimizers are a collection whose
Burrows-Wheeler transform and common prefixes are built column by column, from the last symbols to the first (a minimizer with one
segment needs no transform: its strings are that segment's): there are
at most as many rounds as a segment has bytes, however long the documents are. Strings with a common prefix of `length`
are equal. All work between the shuffles is on whole columns of a chunk or of a bucket of minimizers; a minimizer or a
segment counts once a chunk, however often it occurs there.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import committed_file, open_fs, shared_dir

KMER = 16  # bytes of a minimizer
SLICE = 1 << 20  # bytes that are hashed at once
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
NO_ID = (1 << 63) - 1
END = 0xFF  # stands before a segment's first byte; no byte of UTF-8
PART = 1 << 24  # unpacked bytes of a bucket that are compared at once, but for a minimizer with more
STRINGS = 1 << 20  # strings of a chunk that are judged at once
COLLECTION = 1 << 18  # bytes of segments that are sorted together, but for a minimizer with more


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack("<I", len(parts)) + b"".join(struct.pack("<2sQ", p.dtype.str[1:].encode(), len(p)) for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    kinds = [struct.unpack_from("<2sQ", raw, 4 + 10 * k) for k in range(n)]
    at = 4 + 10 * n
    for kind, size in kinds:
        dtype = np.dtype(kind.decode())
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


def _save(uri: str, data: bytes) -> None:
    with committed_file(uri) as out:
        out.write(data)


def _load(uri: str) -> list[np.ndarray]:
    store, path = open_fs(uri)
    with store.open_input_stream(path, compression=None) as stream:
        return _unpack(stream.read())


def segments(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string's start, number of strings, minimizer's hash) of each segment of documents data[bounds[i]:bounds[i+1]]."""
    out: list[tuple] = []
    span = length - KMER + 1  # minimizer places in a string
    a = 0
    while a < len(bounds) - 1:
        z = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        base, part = int(bounds[a]), data[int(bounds[a]) : int(bounds[z])]
        local, a = bounds[a : z + 1] - base, z
        n = len(part) - length + 1
        if n <= 0:
            continue
        words = np.ndarray(len(part) - 7, "<u8", np.ascontiguousarray(part), strides=(1,))
        h = words[:-8] * _M1 + ((words[8:] ^ (words[8:] >> np.uint64(31))) * _M2)
        h ^= h >> np.uint64(29)
        h *= _M3
        h ^= h >> np.uint64(32)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wide = 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < span:
            least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        shut = np.zeros(len(part) + 1, np.int32)
        np.add.at(shut, np.maximum(local[1:] - length + 1, local[:-1]), 1)
        np.add.at(shut, local[1:], -1)
        starts = np.flatnonzero(np.cumsum(shut)[:n] == 0)
        if not len(starts):
            continue
        place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out.append((starts[first] + base, np.diff(first, append=len(place)), h[place[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of each data[start : start + size], starts rising; about SLICE bytes are worked on at once."""
    out = np.empty(len(starts), np.uint64)
    widest = int(sizes.max(initial=0))
    power, back = np.full(SLICE + widest + 1, base, np.uint64), np.full(SLICE + widest + 1, pow(base, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        z = int(np.searchsorted(starts, low + SLICE, "left"))
        at, part = starts[a:z] - low, data[low : int(starts[z - 1]) + widest]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        out[a:z] = (sums[at + sizes[a:z]] - sums[at]) * back[at]
        a = z
    return (out ^ (out >> np.uint64(31))) * _M2


def _groups(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that bring rows with equal (h, check) together."""
    order = np.argsort(h, kind="stable")
    cut = np.diff(h[order], prepend=h[order[:1]] ^ np.uint64(1)) != 0
    if np.any(~cut & (np.diff(check[order], prepend=np.uint64(0)) != 0)):
        order = np.lexsort((check, h))
        cut = (np.diff(h[order], prepend=h[order[:1]] ^ np.uint64(1)) != 0) | (np.diff(check[order], prepend=np.uint64(0)) != 0)
    return order, np.flatnonzero(cut)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for each i."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a : b] for each pair, a < b: the smaller of two overlapping runs of a power of two."""
    level = np.frexp((b - a).astype(float))[1] - 1
    top, out = int(level.max(initial=0)), np.empty(len(a), values.dtype)
    by = np.argsort(level.astype(np.uint8), kind="stable")
    edges = np.searchsorted(level[by], np.arange(top + 2))
    for k in range(top + 1):
        mine = by[edges[k] : edges[k + 1]]
        out[mine] = np.minimum(values[a[mine]], values[b[mine] - (1 << k)])
        if k < top:
            values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def collection_bwt(data: np.ndarray, size: np.ndarray, cap: int = 255) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bwt, lcp) of all suffixes of data's strings, sorted: where it starts, the byte before it, the prefix in common
    with the suffix before (up to cap). Empty suffixes come first, in the order of the strings.

    Each round inserts one symbol of every string that has one left. A row is the place, the common prefix and the byte
    before, in one number. A suffix's place in the order is that of its first symbol in the sorted transform, and its
    common prefix is one more than that of the two suffixes without the symbol.
    """
    ends, n = np.cumsum(size), len(size)
    begins = np.zeros(len(data) + 1, bool)
    begins[ends - size] = True
    row = (ends.astype(np.uint64) << np.uint64(16)) | data[ends - 1]
    front = np.arange(n)
    while True:
        columns = row.view(np.uint8).reshape(-1, 8)
        bwt, lcp = columns[:, 0].copy(), columns[:, 1].copy()
        order = np.argsort(bwt, kind="stable")[: np.count_nonzero(bwt != END)]
        fresh = np.zeros(len(row), bool)
        fresh[front] = True
        new = np.flatnonzero(fresh[order])
        if not len(new):
            return (row >> np.uint64(16)).astype(np.int64), bwt, lcp
        start = (row[order[new]] >> np.uint64(16)).astype(np.int64) - 1
        touched = np.zeros(len(order) + 1, bool)
        touched[new] = touched[new + 1] = True
        at = np.flatnonzero(touched[1 : len(order)]) + 1
        a, b = order[at - 1], order[at]
        same = bwt[a] == bwt[b]
        at, a, b = at[same], a[same], b[same]
        old = np.ones(n + len(order), bool)
        old[n + new] = False
        longer = np.empty(len(old), np.uint64)
        longer[old] = row
        longer[n + new] = (start.astype(np.uint64) << np.uint64(16)) | np.where(begins[start], END, data[start - 1]).astype(np.uint64)
        longer.view(np.uint8).reshape(-1, 8)[n + at, 1] = np.minimum(_range_min(lcp, a + 1, b + 1), cap - 1) + 1
        row, front = longer, n + new


def least_of_equals(data: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes of data's segments, in order, the smallest low of a segment that has it."""
    place, _, lcp = collection_bwt(data, size, length)
    ends = np.cumsum(size)
    owner = np.minimum(np.searchsorted(ends, place, "right"), len(size) - 1)
    whole = np.flatnonzero(ends[owner] - place >= length)  # an empty suffix's place is the next segment's start
    whole = whole[whole >= len(size)]
    group = np.flatnonzero(lcp[whole] < length)
    least = np.minimum.reduceat(low[owner[whole]], group)
    out = np.empty(len(data), low.dtype)
    out[place[whole]] = np.repeat(least, np.diff(group, append=len(whole)))
    return out[_spread(ends - size, size - length + 1)]


def _keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _home(chunk: int, buckets: int) -> int:
    """The bucket that has a row of the chunk even if it is empty, so that no chunk gets lost on the way."""
    return (chunk * 0x9E3779B97F4A7C15 >> 20) % buckets


def _in_parts(blobs: list[bytes], most: int) -> Iterator[list[list[np.ndarray]]]:
    """The unpacked segments (data, size, low, own, rest) of a bucket's blobs, those of a range of minimizers of each blob at a
    time, so that about `most` bytes are held, however large the bucket is."""
    total = sum(zstandard.frame_content_size(b) for b in blobs)
    n = -(-total // most)
    if n <= 1:
        yield [_unpack(b) for b in blobs]
        return
    for k in range(n):
        part = []
        for b in blobs:
            data, size, low, own, rest = _unpack(b)
            mine = np.flatnonzero((rest.astype(np.uint64) * np.uint64(n)) >> np.uint64(32) == k)
            wide = size.astype(np.int64)
            part.append([data[_spread((np.cumsum(wide) - wide)[mine], wide[mine])], size[mine], low[mine], own[mine], rest[mine]])
        yield part


_ROWS = "bucket int, chunk long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "data"])


def _by(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows (chunk, data) or (bucket, data) of each value of a sorted column."""
    now, held = None, []
    for b in batches:
        for bucket, chunk, data in zip(*(c.to_pylist() for c in b.columns)):
            value, rest = (bucket, chunk) if column == "bucket" else (chunk, bucket)
            if value != now and held:
                yield now, held
                held = []
            now = value
            held.append((rest, data))
    if held:
        yield now, held


def _dealt(rows: DataFrame, column: str) -> DataFrame:
    return rows.repartition(column).sortWithinPartitions(column)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, chunk_bytes: int = 1 << 23, buckets: int | None = None, texts: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end in bytes), kept.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id; texts are UTF-8
    bytes, compared as they came in. Rows without an id lose nothing and don't count as a source; rows with one id don't
    count against each other. Null and empty texts have no bytes. kept is null without `texts`. Other columns of docs
    don't matter. Strings are compared by their common prefixes; whole segments that are equal by two 64-bit hashes count
    as one. length is KMER to 127. buckets (at least the shuffle partitions) bounds
    what a task holds of the minimizers.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    buckets = buckets or max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, ids, raw, held = TaskContext.get().partitionId(), 0, [], [], 0

        def chunk() -> pa.RecordBatch:
            name = (task << 24) | k
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            _save(f"{folder}/{name}.texts", _pack(data, bounds, known))
            first, _, h = segments(data, bounds, length)
            doc = known[np.searchsorted(bounds, first, "right") - 1]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)))
            low, high = (f.reduceat(doc, start) if len(start) else doc for f in (np.minimum, np.maximum))
            bucket, rest = _keys(h[start], buckets)
            edges, home = np.searchsorted(bucket, np.arange(buckets + 1)), _home(name, buckets)
            return _rows([(b, name, _pack(rest[x:y], low[x:y], low[x:y] != high[x:y])) for b, x, y in zip(range(buckets), edges[:-1].tolist(), edges[1:].tolist()) if x < y or b == home])

        for b in batches:
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                raw.append((text or "").encode())
                held += len(raw[-1])
                if held >= chunk_bytes:
                    yield chunk()
                    k, ids, raw, held = k + 1, [], [], 0
        if ids:
            yield chunk()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk's minimizers those that more than one document has."""
        for bucket, held in _by(batches, "bucket"):
            parts = [_unpack(data) for _, data in held]
            rest, low, more = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(rest, kind="stable")
            start = np.flatnonzero(np.diff(rest[order].astype(np.int64), prepend=-1))
            flag = np.zeros(len(rest), bool)
            if len(start):
                some = np.logical_or.reduceat(more[order], start) | (np.minimum.reduceat(low[order], start) != np.maximum.reduceat(low[order], start))
                flag[order] = np.repeat(some, np.diff(start, append=len(rest)))
            at = 0
            rows = []
            for (chunk, _), part in zip(held, parts):
                rows.append((bucket, chunk, _pack(part[0][flag[at : at + len(part[0])]])))
                at += len(part[0])
            yield _rows(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different segments with such a minimizer, once a chunk, with the smallest id that has them there."""
        for name, held in _by(batches, "chunk"):
            data, bounds, known = _load(f"{folder}/{name}.texts")
            wanted = np.sort(np.concatenate([(np.int64(bucket) << 32) | _unpack(blob)[0].astype(np.int64) for bucket, blob in held]))
            first, count, h = segments(data, bounds, length)
            bucket, rest = _keys(h, buckets)
            key = (bucket << 32) | rest.astype(np.int64)
            at = np.searchsorted(wanted, key)
            mine = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == key)) if len(wanted) else np.zeros(0, np.int64)
            first, count, bucket, rest = first[mine], count[mine], bucket[mine], rest[mine]
            size = count + length - 1
            one = _hashes(data, first, size, 0x9E3779B97F4A7C15) + size.astype(np.uint64) * _M3
            order, start = _groups(one, _hashes(data, first, size, 0xC2B2AE3D27D4EB4F)) if len(first) else (mine, mine)
            number = np.zeros(len(first), np.int64)
            number[order] = np.repeat(np.arange(len(start)), np.diff(start, append=len(order)))
            _save(f"{folder}/{name}.places", _pack(first, count, number))
            head = order[start]
            doc = known[np.searchsorted(bounds, first, "right") - 1]
            low = np.minimum.reduceat(doc[order], start) if len(start) else doc
            by = np.argsort(bucket[head], kind="stable")
            edges, home = np.searchsorted(bucket[head][by], np.arange(buckets + 1)).tolist(), _home(name, buckets)
            rows = []
            for b, x, y in zip(range(buckets), edges, edges[1:]):
                if x < y or b == home:
                    own = by[x:y]
                    rows.append((b, name, _pack(data[_spread(first[head[own]], size[head[own]])], size[head[own]].astype(np.uint8 if 2 * length < 256 else np.uint32), low[own], own.astype(np.uint32), rest[head[own]])))
            yield _rows(rows)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each string of each segment the smallest id that has it."""
        for bucket, held in _by(batches, "bucket"):
            for k, parts in enumerate(_in_parts([blob for _, blob in held], PART)):
                yield from answers(bucket, [(chunk, part) for (chunk, _), part in zip(held, parts) if not k or len(part[1])])

    def answers(bucket: int, held: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        if held:
            parts = [part for _, part in held]
            data = np.concatenate([p[0] for p in parts])
            size = np.concatenate([p[1] for p in parts]).astype(np.int64)
            low = np.concatenate([p[2] for p in parts])
            sub = np.concatenate([p[4] for p in parts])
            count, begin = size - length + 1, np.cumsum(size) - size
            order, start = _groups(_hashes(data, begin, size, 0x9E3779B97F4A7C15) + size.astype(np.uint64) * _M3, _hashes(data, begin, size, 0xC2B2AE3D27D4EB4F)) if len(size) else (size, size)
            number = np.empty(len(size), np.int64)
            number[order] = np.repeat(np.arange(len(start)), np.diff(start, append=len(order)))
            head = order[start]  # the different segments, each with its smallest id
            own = np.minimum.reduceat(low[order], start) if len(start) else low
            by = np.argsort(sub[head], kind="stable")
            stops = np.flatnonzero(np.diff(sub[head[by]].astype(np.int64), append=-1)) + 1  # of each minimizer
            alone = np.diff(stops, prepend=0) == 1  # its strings are in one segment, so their smallest id is the segment's
            only = by[stops[alone] - 1]
            where = np.zeros(len(head), np.int64)
            where[only] = np.cumsum(count[head[only]]) - count[head[only]]
            found = [np.repeat(own[only], count[head[only]])]
            by = by[np.repeat(~alone, np.diff(stops, prepend=0))]
            stops = np.cumsum(np.diff(stops, prepend=0)[~alone])
            filled, x, at = np.cumsum(size[head[by]]), 0, len(found[0])
            for z, more in zip(stops.tolist(), [*stops[1:].tolist(), 0]):
                if more and filled[more - 1] - (filled[x - 1] if x else 0) <= COLLECTION:
                    continue
                mine = by[x:z]
                segs = head[mine]
                found.append(least_of_equals(data[_spread(begin[segs], size[segs])], size[segs], own[mine], length))
                where[mine] = at + np.cumsum(count[segs]) - count[segs]
                x, at = z, at + len(found[-1])
            least = np.concatenate(found)[_spread(where[number], count)]
            ends = np.concatenate([[0], np.cumsum(count)])
            at, rows = 0, []
            for (chunk, _), part in zip(held, parts):
                n = len(part[1])
                rows.append((bucket, chunk, _pack(part[3], least[ends[at] : ends[at + n]], part[1])))
                at += n
            yield _rows(rows)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in _by(batches, "chunk"):
            data, bounds, known = _load(f"{folder}/{name}.texts")
            first, count, number = _load(f"{folder}/{name}.places")
            parts = [_unpack(blob) for _, blob in held]
            own, low, size = (np.concatenate(x) for x in zip(*parts))
            many = size.astype(np.int64) - length + 1
            begin = np.zeros(len(own), np.int64)
            begin[own] = np.cumsum(many) - many
            place = np.searchsorted(bounds, first, "right") - 1
            found, filled, x = [(np.zeros(0, np.int64), place[:0])], np.cumsum(count), 0
            while x < len(first):
                z = max(x + 1, int(np.searchsorted(filled, (filled[x - 1] if x else 0) + STRINGS, "right")))
                doc = np.repeat(known[place[x:z]], count[x:z])
                gone = (low[_spread(begin[number[x:z]], count[x:z])] < doc) & (doc != NO_ID)
                found.append((_spread(first[x:z], count[x:z])[gone], np.repeat(place[x:z], count[x:z])[gone]))
                x = z
            starts, place = (np.concatenate(c) for c in zip(*found))
            new = np.flatnonzero((np.diff(starts, prepend=-length - 1) > length) | (np.diff(place, prepend=-1) != 0))  # strings that go on without a gap are one span
            low, high = starts[new], (np.append(starts[new[1:] - 1], starts[-1:]) if len(new) else starts) + length
            edges = np.searchsorted(place[new], np.arange(len(known) + 1)).tolist()
            rows, held_bytes = [], 0
            for i, a, z, x, y in zip(known.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), edges, edges[1:]):
                spans = list(zip((low[x:y] - a).tolist(), (high[x:y] - a).tolist()))
                whole = data[a:z].tobytes()
                kept = b"".join(whole[p:q] for p, q in zip([0, *(q for _, q in spans)], [*(p for p, _ in spans), len(whole)])) if spans else whole
                rows.append((None if i == NO_ID else i, len(whole), len(whole) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": p, "end": q} for p, q in spans], kept if texts else None))
                held_bytes += len(kept)
                if held_bytes > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])
                    rows, held_bytes = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stored, _ROWS)
    rows = _dealt(rows, "bucket").mapInArrow(shared, _ROWS)
    rows = _dealt(rows, "chunk").mapInArrow(cut, _ROWS)
    rows = _dealt(rows, "bucket").mapInArrow(compared, _ROWS)
    return _dealt(rows, "chunk").mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings of earlier ones."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
