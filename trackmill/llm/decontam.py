"""Benchmark decontamination by spaced-seed hashing: seeds of test and training texts are joined, and what surrounds a hit
is verified token by token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, run_hashes, shared_dir, windows_of, word_spans, written

# Fixed masks: 1 is a token that counts. In a stretch of LEAST tokens or more, with matches at its ends and at most REPLACED
# of them replaced, one of these is whole: it takes 23 % to leave none (a test goes through all stretches, not samples).
MASKS = ("11111", "111011", "1101011")
LEAST = 12  # tokens of an overlap; shorter items have to be there as a whole
SHORT = ("1", "11", "111", "1111")  # masks of items of so few tokens; those of more, but under LEAST, have the third
REPLACED = 0.2  # largest share of replaced tokens
STEP = 1 << 20  # bytes of text that are worked on at once
FILTER = 27  # at most so many bits as a power of two, to keep seeds apart from the join that no item has
_kind = np.zeros(256, bool)  # bytes that make up tokens: ASCII letters and digits, and all of other scripts
_kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the lower-cased tokens of all texts of a string array, and where each text's begin; whatever stands
    between tokens is ignored, null texts have none."""
    data, begins, ends = binary_parts(pc.utf8_lower(texts))
    starts, stops, edges = word_spans(data, begins, ends, _kind)
    return run_hashes(data, starts, stops), edges


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place, as if all tokens were of one text."""
    n = max(0, len(tokens) - len(mask) + 1)
    h = np.full(n, int(mask, 2) << 8, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h + tokens[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h


def masks_of(size: int) -> tuple[str, ...]:
    """The masks that an item of so many tokens is looked up with."""
    if size >= LEAST:
        return MASKS
    return (SHORT[size - 1] if size < 5 else SHORT[2],)


def replaceable(size: int) -> int:
    """How many tokens of an item that has to be there as a whole may be replaced: any so many leave three in a row."""
    return int(REPLACED * size) if size > 5 else 0


def overlap(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, tokens, matches) of the longest stretch of at least `least` tokens with a share of at most REPLACED
    replaced, that begins and ends with a match; the first of equal length. None if there is none."""
    at = np.flatnonzero(same)
    if not len(at):
        return None
    score = np.concatenate([[0], np.cumsum(np.where(same, REPLACED, REPLACED - 1.0))])  # not falling over the stretch
    lowest = np.minimum.accumulate(score[at])
    begin = at[np.searchsorted(-lowest, -(score[at + 1] + 1e-9))]  # the first start that lies no higher
    size = at + 1 - begin
    k = int(size.argmax())
    a, n = int(begin[k]), int(size[k])
    return (a, n, int(same[a : a + n].sum())) if n >= least else None


def diagonals(tokens: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The shifts of the item against the tokens at which they share a seed, each once, longest common range first.

    Shifts are marked in an array of both lengths, so that texts of few different words need no more memory.
    """
    marked = np.zeros(len(tokens) + len(item), bool)
    for mask in masks_of(len(item)):
        mine, theirs = seeds(item, mask), seeds(tokens, mask)
        wanted = np.sort(mine)
        theirs_at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, theirs), max(len(wanted) - 1, 0))] == theirs) if len(wanted) else np.zeros(0, np.int64)
        theirs_at = theirs_at[np.argsort(theirs[theirs_at], kind="stable")]
        held = theirs[theirs_at]
        for q, (low, high) in enumerate(zip(np.searchsorted(held, mine).tolist(), np.searchsorted(held, mine, "right").tolist())):
            marked[theirs_at[low:high] - q + len(item)] = True
    shifts = np.flatnonzero(marked) - len(item)
    common = np.minimum(shifts + len(item), len(tokens)) - np.maximum(shifts, 0)
    return shifts[np.argsort(-common, kind="stable")]


def best_overlap(tokens: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int] | None:
    """(text start, item start, tokens, matches) of the longest overlap, with the most matches, on the first shift of
    those with the longest range. None if there is none."""
    best, size = None, len(item)
    for shift in diagonals(tokens, item).tolist():
        a, b = max(shift, 0), min(shift + size, len(tokens))
        if best and (b - a, b - a) <= best[2:]:
            break  # no shift from here on can do better
        same = tokens[a:b] == item[a - shift : b - shift]
        if size >= LEAST:
            got = overlap(same, LEAST)
        else:
            matches = int(same.sum())
            got = (0, size, matches) if b - a == size and matches >= size - replaceable(size) else None
        if got and (best is None or got[1:] > best[2:]):
            best = (a + got[0], a + got[0] - shift, got[1], got[2])
    return best


class Filter:
    """Which seeds some item may have: a Bloom filter of 2^24 to 2^FILTER bits, four of them for each seed."""

    def __init__(self, hashes: DataFrame):
        self.bits = min(FILTER, max(24, (32 * hashes.count()).bit_length()))
        self.shifts = [round(k * (64 - self.bits) / 3) for k in range(4)]
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        each = F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit((1 << self.bits) - 1)) for k in self.shifts))
        found = hashes.select(F.explode(each).alias("place")).groupBy(F.shiftright("place", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        table = found.toArrow()
        self.words[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where those stand that some item may have."""
        at = np.arange(len(h))
        for k in self.shifts:
            place = (h[at] >> np.uint64(k)) & np.uint64((1 << self.bits) - 1)
            at = at[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def _tokens(column: pa.Array) -> list[np.ndarray]:
    data, starts, ends = binary_parts(column)
    return [data[a:z].view(np.uint64) for a, z in zip(starts.tolist(), ends.tolist())]


def _rows(ids, numbers: list[int], tokens: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(tokens, pa.binary()), lists], ["id", "row", "tokens", "seeds"])


_SCHEMA = "id long, row long, tokens binary, seeds array<long>"


def hashed_items(items: DataFrame) -> DataFrame:
    """(id, row, tokens, seeds) of each item (id, text) with tokens: its number, its tokens' hashes and its different seeds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            h, edges = tokens_of(b.column(1))
            own = [h[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
            found = [np.unique(np.concatenate([seeds(t, m) for m in masks_of(len(t))])) if len(t) else t for t in own]
            yield _rows(b.column(0), list(range(number, number + len(own))), [t.tobytes() for t in own], found)
            number += len(own)

    return items.mapInArrow(of, _SCHEMA).where(F.size("seeds") > 0)


def hashed_texts(docs: DataFrame, masks: list[str], known: Filter) -> DataFrame:
    """(id, row, tokens, seeds) of each text (id, text) that may share a seed with an item, and these seeds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in windows_of(batch, ["text"], STEP):
                h, edges = tokens_of(b.column(1))
                owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                values, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for mask in masks:
                    s = seeds(h, mask)
                    at = known.places(s)
                    at = at[owner[at] == owner[at + len(mask) - 1]]
                    values.append(s[at])
                    whose.append(owner[at])
                values, whose = np.concatenate(values), np.concatenate(whose)
                order = np.argsort(whose, kind="stable")
                values, whose = values[order], whose[order]
                some = np.flatnonzero(np.bincount(whose, minlength=b.num_rows))
                cuts = np.append(np.searchsorted(whose, some), len(whose))
                found = [np.unique(values[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield _rows(b.column(0).take(pa.array(some)), (number + some).tolist(), [h[edges[i] : edges[i + 1]].tobytes() for i in some.tolist()], found)
                number += b.num_rows

    return docs.mapInArrow(of, _SCHEMA)


SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, tokens long, matches long"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = 1) -> DataFrame:
    """SCHEMA: a row for each document and item that overlap, with the longest overlap.

    An overlap is a stretch of one diagonal with at least LEAST tokens, at most REPLACED of them replaced, that begins and
    ends with a match. Items of 6 to 11 tokens have to be there as a whole with at most REPLACED of them replaced, shorter
    ones unchanged; items of fewer than `shortest` tokens are left out, if a caller wishes so. Every place of every
    document is hashed with every mask. Seeds that a bit filter over the items' seeds (at most 2^FILTER bits, whatever
    their number) lets pass are joined with the items' seeds; each diagonal of each pair that shares one is verified.

    A document's tokens go to one task once, whatever the number of its items; a seed that many texts share is split by
    adaptive execution's skew joins. Null texts have no tokens; null ids stay null; repeated rows give repeated results;
    an empty table on either side gives none.
    """
    folder = shared_dir(docs.sparkSession)
    items = hashed_items(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"))).where(F.octet_length("tokens") >= 8 * shortest)
    items = written(items, f"{folder}/items")
    hashes = items.select(F.explode("seeds").alias("h"), F.col("row").alias("item"))
    size = (F.octet_length("tokens") / 8).cast("int")
    masks = sorted({m for r in items.select(F.least(size, F.lit(LEAST)).alias("n")).distinct().collect() for m in masks_of(r["n"])})
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = written(hashed_texts(texts, masks, Filter(hashes.select("h").distinct())), f"{folder}/texts")
    pairs = texts.select("row", F.explode("seeds").alias("h")).join(hashes, "h").select("row", "item").distinct()
    sides = texts.select("row", F.lit(-1).cast("long").alias("item"), "id", "tokens")
    sides = sides.union(pairs.join(items.select(F.col("row").alias("item"), "id", "tokens"), "item").select("row", "item", "id", "tokens"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = None
        for b in batches:
            found = []
            for item, i, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), _tokens(b.column(3))):
                if item < 0:
                    doc = i, tokens.copy()
                else:
                    best = best_overlap(doc[1], tokens)
                    if best:
                        found.append((doc[0], i, *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(6)], ["doc_id", "item_id", "doc_start", "item_start", "tokens", "matches"])

    return sides.repartition("row").sortWithinPartitions("row", "item").mapInArrow(verify, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5) -> DataFrame:
    """docs without the documents that overlap a benchmark item of at least `shortest` tokens; rows without an id stay. Items
    of fewer tokens are phrases that clean documents have too; with shortest=1 these remove documents as well."""
    leaks = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, shortest=shortest).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the passages."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
