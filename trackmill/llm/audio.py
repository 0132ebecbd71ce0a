"""Audio columns: lossless 8-bit WAV, polyphase resampling, log-mel tensors with time spans, energy segments."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import shared_dir, windows_of

RATE, TARGET = 16_000, 8_000
FRAME, HOP, FFT, MELS, PATCH = 200, 80, 256, 40, 96  # at TARGET: 25 ms, 10 ms; a tensor is PATCH frames by MELS
FLOOR = -10.0
BLOCK = 1 << 15  # samples that are resampled at once
STEP = 1 << 22  # bytes of texts or media that are worked on at once


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit WAV, found chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with spaces up to a positive multiple, and how many were there before."""
    data = (text or "").encode()
    return data + b" " * (max(1, -(-len(data) // multiple)) * multiple - len(data)), len(data)


class Resampler:
    """Polyphase resampling: one short filter for each of the `up` phases, applied only where an output falls."""

    def __init__(self, rate: int, target: int, half: int = 8):
        g = math.gcd(rate, target)
        self.up, self.down = target // g, rate // g
        wide = max(self.up, self.down)
        t = np.arange(-half * wide, half * wide + 1)
        taps = np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1]
        taps *= self.up / taps.sum()
        self.half = half * wide  # taps on either side, at the raised rate
        self.taps = taps
        self.reach = -(-self.half // self.up)
        self.phases = np.zeros((self.up, 2 * self.reach + 1))  # [phase, input offset + reach]
        for p in range(self.up):
            for k in range(-self.reach, self.reach + 1):
                i = p - k * self.up + self.half
                if 0 <= i < len(taps):
                    self.phases[p, k + self.reach] = taps[i]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x is numbers, or unsigned 8-bit samples around 128. BLOCK outputs are worked on at once, with `reach` inputs more
        on either side, so a long signal needs little more memory than its output."""
        n = -(-len(x) * self.up // self.down)
        out, step = np.empty(n), BLOCK // self.up * self.up
        for a in range(0, n, step):
            at = np.arange(a, min(a + step, n)) * self.down
            low, high = int(at[0]) // self.up - self.reach, int(at[-1]) // self.up + self.reach + 1
            part = x[max(low, 0) : min(high, len(x))]
            if x.dtype == np.uint8:
                part = (part - 128.0) / 128.0
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(part, (max(-low, 0), max(high - len(x), 0))), 2 * self.reach + 1)
            for p in range(min(self.up, len(at))):
                out[a + p : a + len(at) : self.up] = windows[at[p :: self.up] // self.up - low - self.reach] @ self.phases[at[p] % self.up]
        return out


def mel_filters(rate: int = TARGET) -> np.ndarray:
    """[FFT bin, mel]: triangles of equal width on the mel scale."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * rate / FFT
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


def log_mel(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """[frame, mel] log10 energies of overlapping Hann frames, one at least; zeros fill up the last one, so that no sample at
    the end is left out."""
    x = np.pad(x, (0, FRAME + max(0, -(-(len(x) - FRAME) // HOP)) * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS))
    for a in range(0, len(frames), 1024):
        power = np.abs(np.fft.rfft(frames[a : a + 1024] * np.hanning(FRAME), FFT)) ** 2
        out[a : a + 1024] = np.log10(np.maximum(power @ filters, 10.0**FLOOR))
    return out


def segments(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs of frames [a, b) that begin above `on` and last until below `off`."""
    mark = np.where(energy > on, 1, np.where(energy < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[np.maximum(last, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def pack_tensors(mel: np.ndarray) -> bytes:
    """The log-mel frames as an Arrow IPC stream: fixed-shape tensors [PATCH, MELS] of whole hundredths, with their time spans
    in seconds."""
    n = -(-len(mel) // PATCH)
    block = np.full((n * PATCH, MELS), FLOOR * 100.0, np.int16)
    block[: len(mel)] = np.rint(mel.astype(np.float32) * 100.0)
    step = HOP / TARGET
    start = np.arange(n) * PATCH * step
    end = np.minimum(start + PATCH * step, len(mel) * step)
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(block.reshape(n, PATCH, MELS)), pa.array(start), pa.array(end)], ["tensor", "start_s", "end_s"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors [n, PATCH, MELS] in hundredths, starts, ends) of pack_tensors."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    tensor = table.column("tensor").chunk(0)
    return tensor.to_numpy_ndarray(), table.column("start_s").to_numpy(), table.column("end_s").to_numpy()


def store_media(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as the samples of a WAV, written as a table and read back.

    Null and empty texts are one block of spaces. Repeated rows and rows without an id are stored as they are.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in windows_of(b, ["text"], STEP):
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(data) for data, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    media = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")
    media.write.option("compression", "zstd").parquet(f"{folder}/media")
    return docs.sparkSession.read.schema(media.schema).parquet(f"{folder}/media")


def tensor_digest(stored: bytes) -> str:
    """What stored tensors hold, in few characters: tensors, last time, mean, checksum of the values in hundredths."""
    near, _, end = unpack_tensors(stored)
    return f"{len(near)}|{end[-1]:.2f}|{near.mean():.1f}|{zlib.crc32(near.tobytes()):08x}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, spans array<struct<start_s:double,end_s:double>>, tensors binary"


def audio_features(media: DataFrame, *, media_col: str = "media", carry: tuple[str, ...] = ("doc_id", "n_bytes"), margin: float = 0.5) -> DataFrame:
    """For each row of media: FEATURES, after the carried columns.

    The samples are resampled from RATE to TARGET, cut into overlapping frames and turned into log-mel energies, which
    are stored as fixed-shape tensors with time spans (see unpack_tensors). spans are the stretches whose frame energy rises above the median by margin (log10) and hasn't yet fallen below it by as much.
    Everything is computed row by row, so that equal media give equal values. Null media give null features. A medium is
    read in blocks; what it needs in memory is its tensors and a few times its bytes.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("tensors", pa.binary())]
    carried = [media.schema[c] for c in carry]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resample, filters, step = Resampler(RATE, TARGET), mel_filters(), HOP / TARGET
        for b in batches:
            for part in windows_of(b, ["_media"], STEP):
                rows = []
                for data in part.column(len(carried)).to_pylist():
                    if data is None:
                        rows.append((None,) * 8)
                        continue
                    payload, rate = from_wav(data)
                    if rate != RATE:
                        raise ValueError(f"{rate} samples a second, not {RATE}")
                    mel = log_mel(resample(np.frombuffer(payload, np.uint8)), filters)
                    energy = mel.mean(1)
                    middle = float(np.median(energy))
                    spans = [{"start_s": x * step, "end_s": y * step} for x, y in segments(energy, middle + margin, middle - margin)]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), len(mel), spans, pack_tensors(mel)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields))], [*(f.name for f in carried), *(n for n, _ in fields)])

    return media.select(*carry, F.col(media_col).alias("_media")).mapInArrow(features, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", " + FEATURES)


def stored_features(features: DataFrame, folder: str) -> DataFrame:
    """features, written below folder and read back, with tensor_digest taken from the tensors that were read."""
    features.write.option("compression", "zstd").parquet(f"{folder}/tensors")
    table = features.sparkSession.read.schema(features.schema).parquet(f"{folder}/tensors")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in windows_of(b, ["tensors"], STEP):
                found = [None if t is None else tensor_digest(t) for t in part.column("tensors").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "tensor_digest"])

    return table.mapInArrow(digest, table.select("*", F.lit(None).cast("string").alias("tensor_digest")).schema)


def op4_audio(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as audio, read back and turned into tensors, which are stored and read back too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_dir(spark)
    found = stored_features(audio_features(store_media(docs, folder)), folder)
    feature = F.concat_ws("|", "frames", F.size("spans"), "tensor_digest")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
