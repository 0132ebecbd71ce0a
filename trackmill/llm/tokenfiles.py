"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a row of frames, an index frame and the seek table; the last two are skippable frames, so that any
zstandard reader gives the ids of all documents. A frame holds whole documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, committed_file, open_fs, shared_dir, windows_of, written

# Fixed values of the seekable format: the skippable frame of the seek table, its footer, and our index's frame.
SEEK_FRAME = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
INDEX_FRAME = 0x184D2A50

_encoders: dict[str, PieceEncoder] = {}


# UTF-8 of white space beyond ASCII is C2 85, C2 A0, E1 9A 80, E2 80 80-8A, E2 80 A8/A9/AF, E2 81 9F, E3 80 80.
_space = np.zeros(256, bool)  # ASCII white space
_space[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_lead = _space.copy()  # and bytes that white space may start with
_lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_last = np.zeros(256, bool)  # bytes that white space beyond ASCII may end with
_last[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_leads, _lasts = frozenset(np.flatnonzero(_lead).tolist()), frozenset(np.flatnonzero(_space | _last).tolist())


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece once for each call.

    A single space between two other characters always starts a pre-token, so a text's ids are those of its pieces in
    turn; a piece begins at such a space. The ids of pieces of up to `short` bytes that a call has more than once are
    remembered for later calls, at most `most`.
    """

    def __init__(self, path: str, most: int = 300_000, short: int = 24):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most, self.short = Tokenizer.from_file(path), {}, most, short
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each token: a byte-level token has a character for each
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, encoded by itself."""
        return [np.asarray(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _joined_ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that begin with a space, encoded as one text and cut at the pieces' bytes."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cuts = [0, *(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p in pieces])) + 1).tolist()]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _learnt(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        spaced, rest = [], []
        for p in pieces:
            (spaced if p[0] == 0x20 and len(p) > 1 and p[1] not in _leads and p[-1] not in _lasts else rest).append(p)
        out = dict(zip(rest, self._ids(rest))) if rest else {}
        for a in range(0, len(spaced), 5_000):
            part = spaced[a : a + 5_000]
            out.update(zip(part, self._joined_ids(part)))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts of a string array, and where each text's begin; null texts have none."""
        data, starts, ends = binary_parts(texts)
        before, after = data[:-2], data[2:]
        cut = (data[1:-1] == 0x20) & ~_space[before] & ~_lead[after]
        at = np.flatnonzero(cut) + 1
        maybe = at[_last[data[at - 1]]]  # what stands before may be white space beyond ASCII
        if len(maybe):
            at = np.setdiff1d(at, maybe[(data[maybe - 2] == 0xC2) | np.isin(data[maybe - 3], (0xE1, 0xE2, 0xE3))], assume_unique=True)
        begin = np.zeros(len(data), bool)
        begin[at] = begin[starts[ends > starts]] = True
        begins = np.flatnonzero(begin)
        bounds = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        different, where = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        found = list(map(self.known.get, different))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            learnt = self._learnt([different[k] for k in new])
            for k in new:
                found[k] = learnt[different[k]]
            again = (np.bincount(where, minlength=len(found))[new] > 1).nonzero()[0].tolist()
            if len(self.known) + len(again) > self.most:
                self.known.clear()
            self.known.update((different[new[k]], found[new[k]]) for k in again[: self.most] if len(different[new[k]]) <= self.short)
        edges = np.concatenate([[0], np.cumsum(list(map(len, found)))]).astype(np.int32) // 4
        values = pa.Array.from_buffers(pa.uint32(), int(edges[-1]), [None, pa.py_buffer(b"".join(found))])
        ids = pa.ListArray.from_arrays(pa.array(edges), values).take(pieces.indices).flatten().to_numpy()
        stops = np.concatenate([[0], np.cumsum(np.diff(edges)[where])])
        return ids, stops[np.searchsorted(begins, np.append(starts, len(data)))]


def encoder_of(path: str) -> PieceEncoder:
    """This worker process's encoder: the pieces that it knows serve its later tasks too."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def write_token_file(out, documents: Iterable[tuple[int | None, bytes]], *, frame_bytes: int = 1 << 18, level: int = 3) -> tuple[int, int]:
    """Write (doc_id, ids as bytes) in turn; returns the documents and ids written."""
    packer = zstandard.ZstdCompressor(level=level)
    frames, index, ids, held, size = [], [], [], [], 0

    def flush():
        nonlocal held, size
        if held:
            data = b"".join(held)
            packed = packer.compress(data)
            out.write(packed)
            frames.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            held, size = [], 0

    for doc_id, data in documents:
        index.append((len(frames), len(data) // 4))
        ids.append(doc_id)
        held.append(data)
        size += len(data)
        if size >= frame_bytes:
            flush()
    flush()
    none = np.array([i is None for i in ids], np.uint8).tobytes()
    table = np.array(index, np.int64).reshape(-1, 2)
    packed = packer.compress(np.array([i or 0 for i in ids], np.int64).tobytes() + table.tobytes() + none)
    out.write(_skippable(INDEX_FRAME, packed + struct.pack("<QQ", len(ids), len(packed))))
    out.write(_skippable(SEEK_FRAME, b"".join(frames) + struct.pack("<IBI", len(frames), 0x80, SEEK_FOOTER)))
    return len(ids), int(table[:, 1].sum())


class TokenFile:
    """An open token file: its index, and any document's ids by inflating one frame."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        n, flags, footer = struct.unpack("<IBI", self._at(size - 9, 9))
        if footer != SEEK_FOOTER or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        count, packed = struct.unpack("<QQ", self._at(table - 24, 16))
        data = zstandard.ZstdDecompressor().decompress(self._at(table - 24 - packed, packed))
        self.doc_ids = np.frombuffer(data, np.int64, count)
        self.index = np.frombuffer(data, np.int64, 2 * count, 8 * count).reshape(-1, 2)
        self.none = np.frombuffer(data, np.uint8, count, 24 * count).astype(bool)
        self.tokens = self.index[:, 1]
        self.offsets = np.concatenate([[0], np.cumsum(self.tokens)])

    def _at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.frames[k])
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in the file, ids) of each document, a frame at a time."""
        last, data, base = -1, b"", 0
        for i, (k, n) in enumerate(self.index.tolist()):
            if k != last:
                last, data, base = k, self.frame(k), self.offsets[i]
            a = 4 * int(self.offsets[i] - base)
            yield None if self.none[i] else int(self.doc_ids[i]), int(self.offsets[i]), data[a : a + 4 * n]

    def read(self, doc_id: int) -> np.ndarray:
        """A document's ids; only its frame is inflated."""
        i = int(np.flatnonzero((self.doc_ids == doc_id) & ~self.none)[0])
        k = int(self.index[i, 0])
        base = self.offsets[int(np.searchsorted(self.index[:, 0], k))]
        a = int(self.offsets[i] - base)
        return np.frombuffer(self.frame(k), "<u4")[a : a + int(self.tokens[i])]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, roll_bytes: int = 1 << 28) -> DataFrame:
    """Write all documents' ids, end_id after each, in ascending id order; returns (file, part, k, documents, tokens).

    The documents are dealt out by ranges of (id, hash of the text), so every task writes a run of ids to files of its
    own and an id that many rows share is split. tokenizer is the path of a byte-level BPE file that all tasks can read.
    Null ids come first, null and empty texts have only the end id, rows with one id stand in the order of their texts'
    hash. A task that is run again replaces its files.
    """
    order = ["doc_id", "mark"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task, made = encoder_of(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), []

        def encoded():
            for b in batches:
                for part in windows_of(b, ["text"]):
                    ids, offsets = encoder.encode(part.column(1))
                    for i, x, y in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                        yield i, ids[x:y].tobytes() + end

        def until(limit: int, first: tuple):
            nonlocal document
            size = 0
            while document is not None and size < limit:
                size += len(document[1])
                yield document
                document = next(source, None)

        source = encoded()
        document = next(source, None)
        while document is not None:
            name = f"{folder}/part-{task:05d}-{len(made):04d}.ids.zst"
            with committed_file(name) as out:
                made.append((name, task, len(made), *write_token_file(out, until(4 * roll_bytes, document))))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["file", "part", "k", "documents", "tokens"])

    return written(rows.mapInArrow(write, "file string, part int, k int, documents long, tokens long"), f"{folder}/files")


def read_tokens(files: DataFrame, *, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files, start counted over all files in order.

    A row of files stands for a file, so the running sum over them is over a small table.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for uri, first in zip(*(c.to_pylist() for c in b.columns)):
                store, path = open_fs(uri)
                with store.open_input_file(path) as stream:
                    for doc_id, start, data in TokenFile(stream).documents():
                        rows.append((doc_id, first + start, len(data) // 4, zlib.crc32(data), data if ids else None))
                        held += 64 + (len(data) if ids else 0)
                        if held > 1 << 22:
                            yield pack()
                            rows.clear()
                            held = 0
        yield pack()

    return files.withColumn("first", before).select("file", "first").repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's ids written to token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_tokens(docs, shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files, ids=False).drop("ids")
