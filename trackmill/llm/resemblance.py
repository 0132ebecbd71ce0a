"""Near-duplicates by the exact resemblance (Jaccard) of their sets of word shingles, found by prefix filtering.

Under any one order of all shingles, two sets of resemblance t or more share one of the first n - ceil(t n) + 1 shingles
of each. So those prefixes are joined, which misses no pair. The order puts shingles that many texts have last;
it decides how many candidates there are, never which pairs are found. Candidates are then counted out: a pair whose
prefixes share too few shingles for t can't have it. What is left is decided on the whole sets. That is for shingles of
few sets. Sets that share one of many sets meet as a whole, in tasks that count out what each two have in common and give
no more links than connect them, so that what is made grows with the sets and not with their pairs.
Shingles are told apart by 57 bits of a hash, sets by 64 bits.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, joined_hashes, run_hashes, windows_of, word_spans, written
from trackmill.llm.components import components

BITS = 57  # of a shingle's hash; the level of its frequency stands above them
COUNTED = 40  # top bits of a hash by which shingles are counted: others that share them have the same frequency
RANGE = 1 << 22  # characters of text whose shingles are counted in one range of hashes, unless there are RANGES of them
RANGES = 1 << 10
HOT = 1 << 19  # shingles at most that have a frequency
LARGE = 8  # sets of a group up to which its pairs are rows
KNOWN = 32  # blocks of tied groups up to which they are surely compared as one
STEP = 1 << 21  # bytes of text that are worked on at once
BLOCK = 512  # sets that are compared with as many others at once
_lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_inside = np.ones(256, bool)  # bytes of words: all but ASCII white space
_inside[[*range(0x09, 0x0E), 0x20]] = False


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingles of all texts of a string array, in turn and with repeats, and where each text's begin.

    Words stand between ASCII white space, A-Z lower-cased; a text of fewer words than a shingle has one of all of them,
    and one without words has none.
    """
    data, begins, ends = binary_parts(texts)
    data = _lower[data]
    starts, stops, edges = word_spans(data, begins, ends, _inside)
    h = run_hashes(data, starts, stops)
    n = np.diff(edges)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(owner[: max(0, len(h) - words + 1)] == owner[words - 1 :])
    found, whose = joined_hashes(h, words)[at], owner[at]
    for few in range(1, words):
        short = np.flatnonzero(n == few)
        if len(short):
            found, whose = np.concatenate([found, joined_hashes(h, few)[edges[short]]]), np.concatenate([whose, short])
    if np.any(whose[1:] < whose[:-1]):
        order = np.argsort(whose, kind="stable")
        found, whose = found[order], whose[order]
    return found, np.searchsorted(whose, np.arange(len(n) + 1))


def ascending(x: np.ndarray) -> np.ndarray:
    """The different values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The set of shingles of each text, ascending: the top BITS of their hashes."""
    h, at = shingles(texts, words)
    keys = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return [ascending(keys[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]


def node_of(found: np.ndarray) -> int:
    """The number that stands for a set of shingles."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def ceil_share(share: Fraction, n):
    return -(-share.numerator * n // share.denominator)


def prefix_length(n, share: Fraction):
    return n - ceil_share(share, n) + 1


def fewest(na, nb, la, lb, share: Fraction):
    """How many shingles two prefixes must share, at least, for the sets to have the resemblance; la and lb end them.

    What the prefix that ends first doesn't share with the other is not in the other set at all.
    """
    both = ceil_share(share / (1 + share), na + nb)
    return np.maximum(both - np.where(la <= lb, na - prefix_length(na, share), nb - prefix_length(nb, share)), 1)


def _longs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in rows.values()], list(rows))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """A column of numbers, or the columns of lists of equally many numbers."""
    return list(column.flatten().to_numpy().reshape(len(column), -1).T) if pa.types.is_list(column.type) else [column.to_numpy()]


def _groups(batches, keys: int):
    """The columns of sorted batches as arrays, cut only between rows that differ in the first so many columns."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def whole(last: bool):
        nonlocal held, rows
        columns = [np.concatenate(c) for c in zip(*held)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        cut = len(columns[0]) if last else int(change[-1]) if len(change) else 0
        held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        return [c[:cut] for c in columns]

    limit = 100_000
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c for k in range(b.num_columns) for c in _arrays(b.column(k))])
        rows += b.num_rows
        if rows > limit:
            yield whole(False)
            limit = max(100_000, 2 * rows)
    if rows:
        yield whole(True)


def frequent(docs: DataFrame, text_col: str, words: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, levels): the shingles, by COUNTED bits, that most different texts hold, ascending, and the bit lengths of
    their numbers of texts.

    All shingles of all texts are counted. Ranges of hashes, a power of two whose number follows the input, are dealt out
    with the 32 bits below the range's; a task sorts a range and counts its runs.
    """
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    ranges = 1 << 8
    while ranges < RANGES and ranges * RANGE < chars:
        ranges *= 2
    low = COUNTED - 8  # bits of a hash below its first eight, which name its range with the next ones

    def each(batches):
        for batch in batches:
            for part in windows_of(batch, ["text"], STEP):
                h = np.sort(np.concatenate(sets_of(part.column(0), words)) >> (BITS - COUNTED))
                edges = np.searchsorted(h, np.arange(ranges + 1) * ((1 << COUNTED) // ranges))
                tail = (h & ((1 << low) - 1)).astype(np.uint32)
                at = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([tail[edges[k] : edges[k + 1]].tobytes() for k in at.tolist()], pa.binary())], ["k", "tail"])

    def count(batches):
        now, held = None, []

        def runs():
            tail = np.sort(np.concatenate(held))
            begins = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
            n = np.diff(np.append(begins, len(tail)))
            several = n > 1
            top = now * 256 // ranges
            return _longs({"h": tail[begins[several]].astype(np.int64) | top << low, "n": n[several]})

        for batch in batches:
            for k, tail in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and k != now:
                    yield runs()
                    held = []
                now = k
                held.append(np.frombuffer(tail.as_buffer(), np.uint32))
        if held:
            yield runs()

    texts = docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).dropDuplicates(["mark"]).select("text")
    dealt = texts.mapInArrow(each, "k long, tail binary").repartition("k").sortWithinPartitions("k")
    counts = written(dealt.mapInArrow(count, "h long, n long"), f"{folder}/frequent")
    least, total = 1001, 0
    for n, sets in sorted(counts.groupBy(F.least("n", F.lit(1000)).alias("k")).count().collect(), reverse=True):
        total += sets
        if total > HOT:
            break
        least = n
    found = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    h, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], np.frexp(n[order].astype(float))[1].astype(np.int64)


def sketches(docs: DataFrame, words: int, share: Fraction, hot: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(doc_id, mark, node, n, last, prefix, print) of each row of docs (doc_id, mark, text): the number of its set, the
    set's size and prefix, where the prefix ends, and the SimHash of its shingles, repeats included."""
    common, levels = hot

    def of(batches):
        for batch in batches:
            for part in windows_of(batch, ["text"], STEP):
                h, at = shingles(part.column(2), words)
                keys_of = (h >> np.uint64(64 - BITS)).astype(np.int64)
                nodes, sizes, lasts, kept, prints = [], [], [], [], []
                for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                    found = ascending(keys_of[a:z])
                    keys = found
                    if len(common) and len(found):
                        counted = found >> (BITS - COUNTED)
                        place = np.minimum(np.searchsorted(common, counted), len(common) - 1)
                        keys = np.sort(found | np.where(common[place] == counted, levels[place], 0) << BITS)
                    own = keys[: prefix_length(len(found), share)]
                    nodes.append(node_of(found))
                    sizes.append(len(found))
                    lasts.append(own[-1] if len(own) else 0)
                    kept.append(own)
                    prints.append(print_of(h[a:z], width))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))
                own = [part.column(0), part.column(1), *(pa.array(np.asarray(c, np.int64)) for c in (nodes, sizes, lasts)), prefix, pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "mark", "node", "n", "last", "prefix", "print"])

    return docs.select("doc_id", "mark", "text").mapInArrow(of, "doc_id long, mark long, node long, n long, last long, prefix array<long>, print binary")


def shared_only(entries: DataFrame) -> DataFrame:
    """The entries (key, node, ...) whose key more than one set has."""
    names = entries.columns

    def keep(batches):
        for columns in _groups(batches, 1):
            same = columns[0][1:] == columns[0][:-1]
            at = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(columns[0]) else []
            yield _longs({k: c[at] for k, c in zip(names, columns)})

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(keep, entries.schema)


def _others(root: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end): for each row of sorted groups, sorted by root in them, the first row after it with another root, and
    where its group ends."""
    new = np.concatenate([[True], group[1:] != group[:-1], [True]])
    end = np.flatnonzero(new)[1:][np.cumsum(new[:-1]) - 1]
    new[1:-1] |= root[1:] != root[:-1]
    return np.flatnonzero(new)[1:][np.cumsum(new[:-1]) - 1], end


def _pairs_by_step(first: np.ndarray, end: np.ndarray):
    """All (x, y) with first[x] <= y < end[x], a y for each x at a time."""
    at = first.copy()
    rows = np.flatnonzero(at < end)
    while len(rows):
        yield rows, at[rows]
        at[rows] += 1
        rows = rows[at[rows] < end[rows]]


def _candidates(node, n, last, x, y, share: Fraction) -> pa.RecordBatch:
    """The pairs (x, y) whose sizes allow for the resemblance."""
    fits = share.denominator * np.minimum(n[x], n[y]) >= share.numerator * np.maximum(n[x], n[y])
    x, y = x[fits], y[fits]
    return _longs({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y]), "need": fewest(n[x], n[y], last[x], last[y], share)})


_PAIRS = "a long, b long, need long"


def small_pairs(entries: DataFrame, share: Fraction) -> DataFrame:
    """_PAIRS: all pairs with different roots of groups of at most LARGE sets, once for each key that they share."""

    def compare(batches):
        for key, root, node, n, last in _groups(batches, 1):
            if len(key):
                for x, y in _pairs_by_step(*_others(root, key)):
                    yield _candidates(node, n, last, x, y, share)

    return entries.select("key", "root", "node", "n", "last").repartition("key").sortWithinPartitions("key", "root").mapInArrow(compare, _PAIRS)


def dealt_blocks(groups: DataFrame) -> DataFrame:
    """(group, main, near, far, copies) of each group of (group, node, root) that has several roots: its most common root,
    the blocks of the strays (sets of other roots) and of the rest, and how many sets all blocks take that are compared.

    The sets of one root needn't be compared with each other, so only strays are, with each other and with the rest.
    """
    sizes = groups.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    strays, rest = F.col("all") - F.col("main.n"), F.col("main.n")
    near, far = F.ceil(strays / BLOCK), F.ceil(rest / BLOCK)
    return sizes.where(strays > 0).select("group", F.col("main.root").alias("main"), near.alias("near"), far.alias("far"), (strays * (near + far) + rest * near).alias("copies"))


def large_groups(entries: DataFrame, folder: str) -> DataFrame:
    """(group, pair, node, root): sets of different roots that share a key, of entries (key, node, root), together under a
    pair of blocks, which any two sets of different roots with a key in common have in common.

    Keys that are tied by sets are one group, as close relatives share many keys: a set is in it once. If that has more
    than KNOWN blocks and its keys one by one take fewer sets, each of its keys is a group.
    """
    tied = components(entries.select(F.col("key").alias("a"), F.col("node").alias("b")), f"{folder}/ties").select(F.col("node").alias("key"), F.col("root").alias("whole"))
    entries = written(entries.join(tied, "key").select("whole", "key", "node", "root"), f"{folder}/large")
    wholes, keys = entries.select(F.col("whole").alias("group"), "node", "root").distinct(), entries.select(F.col("key").alias("group"), "node", "root")
    by_key = written(dealt_blocks(keys), f"{folder}/keys")
    by_whole = written(dealt_blocks(wholes), f"{folder}/wholes")
    owners = entries.select("whole", "key").distinct()
    apart = by_whole.where(F.col("near") + F.col("far") > KNOWN).select(F.col("group").alias("whole"), "copies")
    apart = apart.join(by_key.select(F.col("group").alias("key"), F.col("copies").alias("own")).join(owners, "key"), "whole").groupBy("whole").agg(F.first("copies").alias("copies"), F.sum("own").alias("own")).where("own < copies").select("whole")
    apart = written(apart, f"{folder}/apart")
    alone = owners.join(apart, "whole").select(F.col("key").alias("group"))
    whole = wholes.join(by_whole.join(apart.withColumnRenamed("whole", "group"), "group", "left_anti"), "group")
    each = keys.join(by_key.join(alone, "group"), "group")
    both = whole.union(each.select(whole.columns))
    stray, spread = F.col("root") != F.col("main"), F.xxhash64("node")
    mine = F.when(stray, F.pmod(spread, "near")).otherwise(F.col("near") + F.pmod(spread, "far"))
    others = F.sequence(F.lit(0).cast("long"), F.col("near") - 1 + F.when(stray, F.col("far")).otherwise(0))
    pairs = F.transform(others, lambda other: F.least("mine", other) * (1 << 31) + F.greatest("mine", other))
    return both.withColumn("mine", mine).select("group", F.explode(pairs).alias("pair"), "mine", "node", "root")


def spanning_pairs(pair: int, mine: np.ndarray, root: np.ndarray, sets: list[np.ndarray], share: Fraction) -> list[tuple[int, int]]:
    """Pairs of sets of different roots that have the resemblance and connect all that such pairs connect; of two different
    blocks, only pairs of one with the other count."""
    across = pair >> 31 != pair & ((1 << 31) - 1)
    left, right = (np.flatnonzero(mine == b) for b in (pair >> 31, pair & ((1 << 31) - 1)))
    if not len(left) or not len(right):
        return []
    n = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(sets)), n)
    theirs = (mine == pair & ((1 << 31) - 1))[owner]
    owner, posted = owner[theirs], ids[theirs]
    owner = owner[np.argsort(posted, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(posted, minlength=int(ids.max()) + 1))])
    label, found = np.unique(root, return_inverse=True)[1], []
    for x in left.tolist():
        own = ids[ends[x] - n[x] : ends[x]]
        begin, many = offsets[own], offsets[own + 1] - offsets[own]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((common > 0) & (common * (share.numerator + share.denominator) >= share.numerator * (n[x] + n)) & (across | (np.arange(len(sets)) > x)))
        near = near[(root[near] != root[x]) & (label[near] != label[x])]
        while len(near):
            found.append((x, int(near[0])))
            label[label == label[near[0]]] = label[x]
            near = near[label[near] != label[x]]
    return found


def large_links(groups: DataFrame, held: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): links that connect what the sets of large_groups, held (node, set), connect by resemblance."""

    def compare(batches):
        now, rows = None, []

        def links():
            pair, mine, node, root = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in (1, 2, 3, 4))
            sets = [np.frombuffer(v.as_buffer(), np.int64) for b in rows for v in b.column(5)]
            found = spanning_pairs(int(pair[0]), mine, root, sets, share)
            x, y = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            return _longs({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})

        for batch in batches:
            if not batch.num_rows:
                continue
            group, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(group)]
            for a, z in zip(cuts, cuts[1:]):
                if rows and now != (group[a], pair[a]):
                    yield links()
                    rows = []
                now = group[a], pair[a]
                rows.append(batch.slice(a, z - a))
        if rows:
            yield links()

    dealt = groups.join(held, "node").select("group", "pair", "mine", "node", "root", "set").repartition("group", "pair").sortWithinPartitions("group", "pair")
    return dealt.mapInArrow(compare, "a long, b long")


def sets_named(nodes: DataFrame, docs: DataFrame, marks: DataFrame, words: int, folder: str) -> DataFrame:
    """(node, set) of the sets named by nodes (node, repeats don't matter).

    marks (node, mark) tells a text for each set. Only the texts of sets that are named are read again as sets: a
    filter of 2^24 bits, whatever the input's size, comes before the exact join.
    """
    nodes = written(nodes.distinct().join(marks, "node"), f"{folder}/nodes")
    top = (1 << 18) - 1
    filter_bits = np.zeros(1 << 18, np.uint64)
    word, bit = F.shiftright("mark", 6).bitwiseAND(F.lit(top)), F.expr("shiftleft(1L, cast(mark & 63 as int))")
    found = nodes.groupBy(word.alias("k")).agg(F.bit_or(bit).alias("bits")).toArrow()
    filter_bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)

    def sets(batches):
        for batch in batches:
            mark = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((filter_bits[mark >> 6 & top] >> (mark & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for part in windows_of(batch, ["text"], STEP):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets_of(part.column(1), words)], pa.binary())], ["mark", "set"])

    held = docs.select("mark", "text").mapInArrow(sets, "mark long, set binary").join(nodes, "mark").select("node", "set").dropDuplicates(["node"])
    return written(held, f"{folder}/sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def decided(asked: DataFrame, held: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): those of the different pairs asked for whose sets, held (node, set), have the resemblance."""
    both = asked.join(held.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def decide(batches):
        for batch in batches:
            for part in windows_of(batch, ["set_a", "set_b"]):
                near = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    near.append(common * (share.numerator + share.denominator) >= share.numerator * (len(x) + len(y)))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(decide, "a long, b long")


def resembling(asked: DataFrame, docs: DataFrame, marks: DataFrame, words: int, share: Fraction, folder: str) -> DataFrame:
    """(a, b): those of the different pairs asked for whose sets have the resemblance."""
    asked = written(asked, f"{folder}/asked")
    return written(decided(asked, sets_named(ends_of(asked), docs, marks, words, folder), share), f"{folder}/near")


def prefix_links(entries: DataFrame, roots: DataFrame, docs: DataFrame, marks: DataFrame, words: int, share: Fraction, folder: str) -> DataFrame:
    """(a, b): links between sets of different roots, enough to connect all that such links connect. entries are those of
    shared_only; roots (node, root) tells which sets are known to be tied.

    Two sets that share a key of more than LARGE sets meet under it. Of others the small groups give all keys that they
    share, so that pairs of too few can go.
    """
    tied = written(entries.join(roots, "node", "left").select("key", "node", "n", "last", F.coalesce("root", "node").alias("root")), f"{folder}/tied")
    sizes = written(tied.groupBy("key").agg(F.count("*").alias("size"), (F.min("root") < F.max("root")).alias("apart")).where(F.col("size") > LARGE).select("key", "apart"), f"{folder}/sizes")
    pairs = small_pairs(tied.join(sizes, "key", "left_anti"), share).groupBy("a", "b", "need").agg(F.count("*").alias("shared")).where("shared >= need").select("a", "b")
    asked = written(pairs, f"{folder}/asked")
    groups = written(large_groups(tied.join(sizes.where("apart"), "key").select("key", "node", "root"), folder), f"{folder}/groups")
    held = sets_named(ends_of(asked).union(groups.select("node")), docs, marks, words, folder)
    return written(decided(asked, held, share).union(large_links(groups, held, share)), f"{folder}/near")


def print_of(h: np.ndarray, width: int) -> bytes:
    """SimHash of hashes in width little-endian 64-bit words: a bit is set if it is in over half of them."""
    votes = np.zeros((width, 64), np.int64)
    for a in range(0, len(h), 1 << 14):
        for k in range(width):
            votes[k] += np.unpackbits(spread(h[a : a + (1 << 14)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * votes.ravel() > len(h), bitorder="little").tobytes()


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word that hashes are spread to; the first is the hash itself."""
    if not k:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
