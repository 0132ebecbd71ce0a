"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Bits that vary together are grouped into partitions. Two fingerprints that differ in at most d bits differ in at most
t_i bits in some partition i whenever the thresholds t_i (-1: not probed) add up to d - (partitions - 1). So each
fingerprint spends its thresholds where few candidates are to be expected (dynamic programming over counts of the
partitions' values), probes those partitions, and every candidate is verified on all bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, shared_dir, written
from trackmill.llm.components import components
from trackmill.llm.resemblance import frequent, prefix_links, print_of, resembling, shared_only, sketches

SEED = 42
SUB_BITS = 11  # widest piece of a partition whose values are counted
BLOCK = 2048  # rows of a bucket that are compared with each other at once
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, words: int, width: int = 1) -> bytes:
    """The fingerprint of a text in width little-endian 64-bit words: see fingerprints."""
    tokens = (text or "").encode().translate(_lower).split()
    if not tokens:
        return bytes(8 * width)
    n = max(1, len(tokens) - words + 1)
    whole = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    hashed = xxhash.xxh64_intdigest
    return print_of(np.fromiter((hashed(whole[i:j], SEED) for i, j in zip(first, last)), np.uint64, n), width)


def fingerprints(text_col: str, words: int, width: int = 1) -> F.Column:
    """SimHash of a text column, as binary: words between ASCII white space, A-Z lower-cased, in shingles of so many
    words, repeats included (fewer words: all of them; none: all bits 0). A bit is set if it is in over half the
    shingles' XXH64; with a width over 1 each hash is spread to so many words."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words, width) for t in texts], dtype=object)

    return of(F.col(text_col))


def group_bits(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in so many groups of like size: each group starts from the bit least tied to the others so far, and takes
    the bit with the largest mean correlation to it. gram counts how often two bits are both set."""
    mean = np.diag(gram) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tied = np.abs((gram / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = list(range(len(gram))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(left, key=lambda b: (tied[b, group].mean(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def pieces_of(group: list[int]) -> list[list[int]]:
    """A partition's bits in pieces of at most SUB_BITS."""
    n = -(-len(group) // SUB_BITS)
    return [group[len(group) * i // n : len(group) * (i + 1) // n] for i in range(n)]


def gather(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that some bits of each fingerprint (a row of 64-bit words) form."""
    out = np.zeros(len(prints), np.int64)
    for k, b in enumerate(bits):
        out |= ((prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << k
    return out


def near_counts(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """[value, e]: rows whose value differs from this one in exactly e of width bits, e up to distance."""
    values, out = np.arange(1 << width), np.zeros((1 << width, distance + 1))
    for e in range(min(distance, width) + 1):
        for flips in itertools.combinations(range(width), e):
            out[:, e] += counts[values ^ sum(1 << b for b in flips)]
    return out


class Plan:
    """Partitions of the bits, and what each value of their pieces lets expect.

    units is the sum of (t + 1) over the partitions: pairs of at most units - 1 differing bits are sure to be met.
    reach is the largest threshold of a partition.
    """

    def __init__(self, groups: list[list[int]], counts: list[list[np.ndarray]], n: int, units: int, reach: int):
        self.groups, self.n, self.units, self.reach = groups, max(n, 1), units, reach
        self.near = [[near_counts(c, len(p), reach) / self.n for c, p in zip(cs, pieces_of(g))] for g, cs in zip(groups, counts)]

    def expected(self, prints: np.ndarray, i: int) -> np.ndarray:
        """[row, t + 1]: cost of threshold t in partition i: rows to be met within t bits, and signatures to be probed."""
        total = None
        for piece, near in zip(pieces_of(self.groups[i]), self.near[i]):
            mine = near[gather(prints, piece)]
            total = mine if total is None else np.stack([sum(total[:, a] * mine[:, e - a] for a in range(e + 1)) for e in range(self.reach + 1)], 1)
        probes = np.cumsum([math.comb(len(self.groups[i]), e) for e in range(self.reach + 1)])
        return np.concatenate([np.zeros((len(prints), 1)), self.n * np.cumsum(total, 1) + 4.0 * probes], 1)

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, partition] thresholds with the least cost, and that cost."""
        units, rows = self.units, np.arange(len(prints))
        best = np.full((len(prints), units + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for i in range(len(self.groups)):
            cost = self.expected(prints, i)
            options = np.full((self.reach + 2, len(prints), units + 1), np.inf)
            for u in range(min(self.reach + 1, units) + 1):
                options[u, :, u:] = best[:, : units + 1 - u] + cost[:, u : u + 1]
            picks.append(options.argmin(0))
            best = options.min(0)
        out, at = np.zeros((len(prints), len(self.groups)), np.int64), np.full(len(prints), units)
        for i in range(len(self.groups) - 1, -1, -1):
            out[:, i] = picks[i][rows, at] - 1
            at = at - picks[i][rows, at]
        return out, best[:, units]

    def signatures(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows): under which keys each fingerprint stands or probes. Every value stands under its own key."""
        limits, _ = self.thresholds(prints)
        for i, group in enumerate(self.groups):
            value, rows = gather(prints, group), np.arange(len(prints))
            yield value | (i << 56), rows
            for e in range(1, int(limits[:, i].max(initial=0)) + 1):
                probing = rows[limits[:, i] >= e]
                for flips in itertools.combinations(range(len(group)), e):
                    yield (value[probing] ^ sum(1 << b for b in flips)) | (i << 56), probing


def _longs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in rows.values()], list(rows))


def _binary(prints: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(prints)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * (8 * prints.shape[1])).astype(np.int32)), pa.py_buffer(rows)])


def _prints(column, width: int) -> np.ndarray:
    return binary_parts(column)[0].view(np.uint64).reshape(-1, width)


def make_plan(distinct: DataFrame, width: int, options: list[int], units: int, reach: int) -> Plan:
    """The cheapest plan for fingerprints (print, each once) with one of these numbers of partitions.

    What comes to the driver is a row of sums for each bit, and the counts of the values of pieces of at most SUB_BITS
    bits, whatever the number of fingerprints; both are over all of them.
    """

    def sums(batches):
        total = np.zeros((64 * width, 64 * width))
        for b in batches:
            bits = np.unpackbits(_prints(b.column(0), width).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64 * width)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "n": [np.sum(np.stack(rows["n"].to_list()), 0)]})

    gram = np.zeros((64 * width, 64 * width))
    for k, row in distinct.mapInArrow(sums, "k long, n array<double>").groupBy("k").applyInPandas(add, "k long, n array<double>").collect():
        gram[k] = row
    n = distinct.count()
    grouped = [group_bits(gram, n, m) for m in options]
    pieces = [p for groups in grouped for g in groups for p in pieces_of(g)]

    def counts(batches):
        total = [np.zeros(1 << len(p), np.int64) for p in pieces]
        for b in batches:
            prints = _prints(b.column(0), width)
            for t, p in zip(total, pieces):
                t += np.bincount(gather(prints, p), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield _longs({"k": np.full(len(at), k), "v": at, "n": t[at]})

    found = [np.zeros(1 << len(p), np.int64) for p in pieces]
    for k, v, c in distinct.mapInArrow(counts, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n")).collect():
        found[k][v] = c
    plans, at = [], 0
    rng = np.random.default_rng(1)
    for groups in grouped:
        own = []
        for g in groups:
            own.append(found[at : at + len(pieces_of(g))])
            at += len(own[-1])
        plan = Plan(groups, own, n, units, reach)
        trial = np.zeros((256, width), np.uint64)  # fingerprints drawn piece by piece from the counts
        for g, cs in zip(groups, own):
            for p, c in zip(pieces_of(g), cs):
                drawn = rng.choice(len(c), len(trial), p=c / c.sum()) if c.sum() else np.zeros(len(trial), np.int64)
                for k, b in enumerate(p):
                    trial[:, b // 64] |= ((drawn >> k) & 1).astype(np.uint64) << np.uint64(b % 64)
        plans.append((float(plan.thresholds(trial)[1].mean()) + 8.0 * len(groups), len(groups), plan))
    return min(plans, key=lambda p: p[:2])[2]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given edges connect, one less than the nodes of each component."""
    both = np.concatenate([a, b])
    _, at = np.unique(both.view(f"V{8 * both.shape[1]}").ravel(), return_inverse=True) if both.shape[1] > 1 else np.unique(both.ravel(), return_inverse=True)
    parent, keep = list(range(int(at.max(initial=-1)) + 1)), []
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def links_in(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows that stand side by side under one key and differ in at most distance bits."""
    a, b, held = [], [], 0
    rows, step = np.arange(len(keys) - 1), 1
    while len(rows):
        rows = rows[rows + step < len(keys)]
        rows = rows[keys[rows] == keys[rows + step]]
        x, y = prints[rows], prints[rows + step]
        far = np.bitwise_count(x ^ y).sum(1)
        near = (far <= distance) & (far > 0)
        a.append(x[near])
        b.append(y[near])
        held += int(near.sum())
        if held > 300_000:
            a, b = ([v] for v in spanning(np.concatenate(a), np.concatenate(b)))
            held = len(a[0])
        step += 1
    return spanning(np.concatenate(a), np.concatenate(b)) if held else (prints[:0], prints[:0])


def link_prints(distinct: DataFrame, plan: Plan, width: int, distance: int, folder: str) -> DataFrame:
    """(a, b): links between fingerprints that differ in at most distance bits, enough to connect all that are met.

    Buckets of more than BLOCK rows are dealt out as pairs of blocks, so none is one task's work; a bucket gives fewer
    links than it has rows and blocks. All pairs in a bucket are verified, none is left out.
    """

    def index(batches):
        for b in batches:
            prints = _prints(b.column(0), width)
            for a in range(0, len(prints), 2048):
                part = prints[a : a + 2048]
                for k, r in plan.signatures(part):
                    if len(k):
                        yield pa.RecordBatch.from_arrays([pa.array(k), _binary(part[r])], ["key", "print"])

    entries = written(distinct.mapInArrow(index, "key long, print binary"), f"{folder}/entries")
    large = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("print"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda other: F.least("mine", other).cast("long") * (1 << 31) + F.greatest("mine", other))
    dealt = entries.join(large, "key", "left").withColumn("mine", mine).select("key", "print", F.explode(pairs).alias("pair")).repartition("key", "pair").sortWithinPartitions("key", "pair")

    def compare(batches):
        held: list[tuple] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            keys, pairs, prints = (np.concatenate(x) for x in zip(*held))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])) + 1
            cut = len(keys) if last else int(change[-1]) if len(change) else 0
            held, rows = [(keys[cut:], pairs[cut:], prints[cut:])], len(keys) - cut
            group = np.zeros(len(keys), np.int64)
            group[change] = 1
            a, b = links_in(np.cumsum(group)[:cut], prints[:cut], distance)
            return pa.RecordBatch.from_arrays([_binary(a), _binary(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(2).to_numpy(), _prints(batch.column(1), width).copy()))
            rows += batch.num_rows
            if rows > 100_000:
                yield flush(False)
        if rows:
            yield flush(True)

    return dealt.mapInArrow(compare, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, width: int = 1, partitions: list[int] | None = None, sure: int | None = None, reach: int = 2) -> DataFrame:
    """(doc_id, print, component_id) for each row of docs.

    Fingerprints link at distance or fewer differing bits; component_id is the smallest id that a row reaches over
    links, its own included. All pairs of at most `sure` bits (default: distance) are met; with sure below distance,
    pairs between the two are met with a probability that grows with the number of partitions. Equal fingerprints are
    one node, so a large group of copies costs one row. Null and empty texts have fingerprint 0. Rows without an id take
    part, and get the smallest id of their component (null if none has one). Repeated rows come back as often. An empty
    table gives an empty table. Other columns of docs don't matter.
    """
    folder, sure = shared_dir(docs.sparkSession), distance if sure is None else sure
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(text_col, words, width).alias("print"))
    rows = written(rows, f"{folder}/prints")
    distinct = written(rows.groupBy("print").agg(F.min("doc_id").alias("first")), f"{folder}/distinct")
    prints = distinct.select("print")
    plan = make_plan(prints, width, partitions or [m for m in range(distance, distance + 3) if m > 1], sure + 1, reach)
    links = link_prints(prints, plan, width, distance, folder)
    roots = components(links, f"{folder}/links").withColumnRenamed("node", "print")
    tied = distinct.join(roots, "print")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = distinct.join(roots.join(least, "root").select("print", "component_id"), "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(classes, "print").select("doc_id", "print", "component_id")


def resemblance_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, width: int = 2) -> DataFrame:
    """(doc_id, node, component_id) for each row of docs.

    Rows link when the sets of their shingles have a resemblance of `similarity` or more: exactly those, none is left to
    chance. component_id is the smallest id that a row reaches over links, its own included. Equal sets are one node.
    Texts without words are equal to each other. Rows without an id take part, and get the smallest id of their
    component (null if none has one). Repeated rows come back as often; an empty table gives an empty one.

    First the SimHash fingerprints of the sets (64 * width bits) are probed by the pigeonhole principle. The number of
    partitions falls with the logarithm of the sets, so that a partition's values stay nearly one a set. Pairs met
    within a third of the bits that unrelated sets differ in are candidates, and decided on their sets. No affordable
    probe is sure to meet a resemblance of 0.8, at which 15 % of the bits differ. So the pairs that the fingerprints
    haven't tied are then found by prefix filtering, which misses none; it needs no pairs within what is tied already.
    """
    folder, share = shared_dir(docs.sparkSession), Fraction(str(similarity))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    rows = written(sketches(docs, words, share, frequent(docs, "text", words, folder), width), f"{folder}/sketches")
    distinct = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("mark", "n", "print")).alias("one")).select("node", "first", "one.*"), f"{folder}/distinct")
    filled, marks = distinct.where("n > 0"), distinct.select("node", "mark")
    prints = written(filled.groupBy("print").agg(F.min("node").alias("head")), f"{folder}/prints")
    bits = max(16, math.ceil(math.log2(max(prints.count(), 1))) + 2)  # of a partition
    parts = max(2, 64 * width // bits)
    links = link_prints(prints.select("print"), make_plan(prints.select("print"), width, [parts], parts, 1), width, 64 * width // 6, folder)
    heads = prints.select(F.col("print").alias("a"), F.col("head").alias("head_a")), prints.select(F.col("print").alias("b"), F.col("head").alias("head_b"))
    asked = links.join(heads[0], "a").join(heads[1], "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    asked = asked.union(filled.join(prints, "print").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))).distinct()
    near = resembling(asked, docs, marks, words, share, f"{folder}/met")
    roots = components(near, f"{folder}/met/links")
    entries = rows.where("n > 0").dropDuplicates(["node"]).select(F.explode("prefix").alias("key"), "node", "n", "last")
    entries = written(shared_only(entries), f"{folder}/shared")
    rest = prefix_links(entries, roots, docs, marks, words, share, f"{folder}/rest")
    roots = components(near.union(rest), f"{folder}/links")
    least = distinct.join(roots, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    classes = distinct.join(roots.join(least, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose component (resemblance_classes) has a smaller id; all columns stay.

    Rows without an id stay, repeated rows of a kept id too.
    """
    found = resemblance_classes(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicate_classes(docs, words=3, distance=2)
    return found.select("doc_id", F.lower(F.concat(*(F.substring(F.hex("print"), k, 2) for k in range(15, 0, -2)))).alias("fingerprint"), "component_id")
