"""Choices that depend on earlier choices (intervals, peaks, pairs), for keys of any size.

A key's rows are sorted over range partitions, so a busy key lies on many of them, and are worked on in blocks of a bounded
number of rows. A block settles all that doesn't depend on other blocks; what is left goes on as a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from trackmill.operators.common import scratch, written

BLOCK = 1 << 18  # rows of a block at first; those of later rounds double, up to MOST
MOST = 1 << 21


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of consecutive pieces of a partition of at most so many rows; numbers rise over the partitions."""
    number, held, n = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == rows:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, n = number + 1, [], 0
    if n:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each row; rows have the same one if and only if they agree in the named columns (nulls agree)."""
    code = np.zeros(len(table), np.int64)
    for name in names:
        own = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def _runs(table: pa.Table, by: list[str]) -> np.ndarray:
    """The number of each row's key, in the order of sorted rows: 0 for the first key."""
    code = _codes(table, by)
    return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])


def _places(run: np.ndarray, values: np.ndarray, wanted: np.ndarray, side: str) -> np.ndarray:
    """searchsorted of each wanted value among the sorted values of its own run."""
    _, rank = np.unique(np.concatenate([values, wanted]), return_inverse=True)
    width, n = int(rank.max(initial=0)) + 1, len(values)
    return np.searchsorted(run * width + rank[:n], run * width + rank[n:], side)


def _table_of(table: pa.Table, at: np.ndarray, more: dict[str, pa.Array]) -> list[pa.RecordBatch]:
    out = table.take(pa.array(at))
    for name, column in more.items():
        out = out.append_column(name, column)
    return out.combine_chunks().to_batches()


def _sorted_blocks(df: DataFrame, order: list[str], parts: int, work: Callable, more: str, shape: DataFrame | None = None) -> DataFrame:
    """work on range partitions of sorted rows; it gives rows like those of shape (or df) with `more` columns."""
    dealt = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (shape or df).schema.fields)
    return dealt.sortWithinPartitions(*order).mapInArrow(work, f"{fields}, {more}")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns whose nulls agree; right's columns come after left's."""
    named = right.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, same, how).drop(*(f"_on_{c}" for c in on))


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(column.type) or pa.types.is_date64(column.type):
        column = column.cast(pa.int64())
    elif pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    return column.to_numpy(zero_copy_only=False)


# Intervals: each kept one leads to the next, so choices are a chain of successors.


def _successors(starts: np.ndarray, ends: np.ndarray, run: np.ndarray, touching: bool) -> np.ndarray:
    """For each row the next one of its key that may follow if it is kept: the first beyond its end; behind the key if none."""
    return np.maximum(_places(run, starts, ends, "left" if touching else "right"), np.arange(len(run)) + 1)


def _forest(follows: np.ndarray, ends: list) -> tuple[np.ndarray, np.ndarray, list]:
    """(first, last, exit) of each row of a chain forest: a row lies on the way from row i on if and only if the first of i is
    in its [first, last); exit is the end of the last row on the way."""
    n, to = len(follows), follows.tolist()
    size = [1] * (n + 1)
    for i in range(n):
        size[min(to[i], n)] += size[i]
    first, free, out, outside = [0] * n, [0] * n, list(ends), 0
    for i in range(n - 1, -1, -1):
        p = to[i]
        if p >= n:
            first[i], outside = outside, outside + size[i]
        else:
            first[i] = free[p]
            free[p] += size[i]
            out[i] = out[p]
        free[i] = first[i] + 1
    first = np.array(first, np.int64)
    return first, first + np.array(size[:n], np.int64), out


def chained(df: DataFrame, by: list[str], start: str, end: str, touching: bool, block: int = BLOCK) -> DataFrame:
    """(by, start, end): rows of a key in order of (start, end), without those that begin before or at the end of the last one
    kept (with `touching`: before it). Rows without a start or an end are left out.

    1. Blocks of sorted rows: keys that begin in a block are followed there. A block's first key may have begun before; its
       rows get their places in the forest of successors, as what is kept depends on where the key comes in.
    2. From block to block only one value is carried on, the end of the last kept row. A task reads a key's blocks in order,
       each as a step function from the value that comes in to the one that goes out. It has at most as many steps as rows
       reach over the block's last start, so this is little unless nearly all intervals overlap; memory is one value.
    3. A join on (key, block) keeps the rows on the way from the row where the key comes in.

    The work grows with the rows (times their logarithm, for sorting); no array holds a key.
    """
    spark = df.sparkSession
    rows = df.select(*by, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    folder, parts = scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in _blocks(batches, block):
            run, starts, ends = _runs(t, by), *(t.column(c).combine_chunks() for c in (start, end))
            follows = _successors(*(_numbers(x) for x in (starts, ends)), run, touching)
            m, n = int(np.searchsorted(run, 1)), len(run)
            to, kept, i = follows.tolist(), [], m
            while i < n:  # behind a key's last kept row comes the next key's first one
                kept.append(i)
                i = to[i]
            if kept:
                none = pa.nulls(len(kept), pa.int64())
                yield from _table_of(t, np.array(kept), {"_kind": pa.array(np.zeros(len(kept), np.int32)), "_block": pa.array(np.full(len(kept), number)), "_exit": pa.nulls(len(kept), ends.type), "_first": none, "_last": none, "_step": pa.array(np.zeros(len(kept), bool))})
            if n > m:  # how the last key goes on
                yield from _table_of(t, np.array([n - 1]), {"_kind": pa.array([2], pa.int32()), "_block": pa.array([number]), "_exit": ends.take(pa.array(kept[-1:])), "_first": pa.nulls(1, pa.int64()), "_last": pa.nulls(1, pa.int64()), "_step": pa.array([True])})
            first, last, out = _forest(np.minimum(follows[:m], m), list(range(m)))
            step = np.append(np.diff(out) != 0, True)  # a step ends where the value that goes out changes
            yield from _table_of(t, np.arange(m), {"_kind": pa.array(np.ones(m, np.int32)), "_block": pa.array(np.full(m, number)), "_exit": ends.take(pa.array(out)), "_first": pa.array(first), "_last": pa.array(last), "_step": pa.array(step)})

    kind = rows.schema[end].dataType.simpleString()
    found = written(_sorted_blocks(rows, [*by, start, end], parts, follow, f"_kind int, _block long, _exit {kind}, _first long, _last long, _step boolean"), f"{folder}/blocks")
    steps = found.where("_step").select(*by, "_block", "_kind", start, "_exit", end)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block_now = value = coming = None
        stepped = False
        for b in batches:
            out = []
            for *k, number, sort, at, leaves, _ in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    key, value, block_now = k, None, None
                if number != block_now:
                    block_now, coming, stepped = number, value, False
                    if sort == 1:
                        out.append((*k, number, coming))
                if not stepped and (sort == 2 or coming is None or (at >= coming if touching else at > coming)):
                    value, stepped = leaves, True
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    schema = StructType([*(steps.schema[c] for c in [*by, "_block"]), StructField("_value", rows.schema[end].dataType)])
    arrow = to_arrow_schema(schema)
    entries = written(steps.repartition(*by).sortWithinPartitions(*by, "_block", start, end).mapInArrow(carry, schema), f"{folder}/entries")
    unsettled = found.where("_kind = 1")
    met = _joined(unsettled, entries, [*by, "_block"])
    met = met.where(F.col("_value").isNull() | ((F.col(start) >= F.col("_value")) if touching else (F.col(start) > F.col("_value"))))
    comes_in = met.groupBy(*by, "_block").agg(F.min_by("_first", F.struct(start, end, F.col("_first"))).alias("_in"))
    on_way = _joined(unsettled, comes_in, [*by, "_block"]).where((F.col("_first") <= F.col("_in")) & (F.col("_in") < F.col("_last")))
    return found.where("_kind = 0").select(*by, start, end).unionByName(on_way.select(*by, start, end))


# Peaks and pairs: the best comes first, and removes what it excludes.


def _in_rounds(left: DataFrame, folder: str, settled: Callable[[DataFrame, int, int, bool], DataFrame], first_one: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """What settled(rows, partitions, rows of a block, whether one block holds all) takes (_state 1) of rows, again with those
    that it leaves open (_state 0) until there are none.

    Blocks double from round to round, up to MOST rows, and once few enough rows are left one block holds them: rounds are
    at most the logarithm of MOST / block, and after that one for each MOST rows of a chain of choices that runs through
    all blocks. A round that settles less than a hundredth is followed by one that settles each key's first choice
    (first_one), so that there is always an end.
    """
    spark, k, done = left.sparkSession, 0, None
    left, n = written(left, f"{folder}/left"), None
    while n is None or n:
        before, n = n, left.count()
        if n == 0 and done is not None:
            break
        if before is not None and n > block and n > 0.99 * before:
            found = written(first_one(left), f"{folder}/round-{k}")
        else:
            parts = -(-n // block)
            if k == 0 and parts > 1:
                parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
            found = written(settled(left, max(parts, 1), block, parts <= 1), f"{folder}/round-{k}")
        taken = found.where("_state = 1").drop("_state")
        done = taken if done is None else done.unionByName(taken)
        left, k, block = found.where("_state = 0").drop("_state"), k + 1, min(2 * block, MOST)
    return done


def peaks(df: DataFrame, by: list[str], at: str, score: str, least: float, apart: float, block: int = BLOCK) -> DataFrame:
    """The highest scores first, down to `least`, each more than `apart` from all kept ones; equal scores by `at`.

    A block of sorted rows goes through them from the highest score on: one that a kept row reaches falls away; one that
    an open row reaches is open; one that stands within `apart` of where the block was cut off from more rows of its key is
    open; others are kept. Kept rows never reach beyond their block, so only open rows go on (see _in_rounds). Of rows at
    the same place one can be kept. Rows without a place are left out.
    """
    rows = df.where((F.col(score) >= least) & F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(score).alias(score))

    def settled(left: DataFrame, parts: int, size: int, whole: bool) -> DataFrame:
        ends = left.groupBy(*by).agg(F.min(at).alias("_low"), F.max(at).alias("_high")).select(*by, F.explode(F.array_distinct(F.array("_low", "_high"))).alias(at), "_low", "_high")
        marked = _joined(left, ends, [*by, at], "left").select(*left.columns, F.coalesce(F.col("_low") == F.col(at), F.lit(False)).alias("_begins"), F.coalesce(F.col("_high") == F.col(at), F.lit(False)).alias("_ends"))

        names = left.columns

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in _blocks(batches, size):
                run, x, s = _runs(t, by), _numbers(t.column(at).combine_chunks()), _numbers(t.column(score).combine_chunks())
                low, high = _places(run, x, x - apart, "left"), _places(run, x, x + apart, "right")
                edge = np.zeros(len(x), bool)
                if not t.column("_begins")[0].as_py():
                    edge |= (run == 0) & (x <= x[0] + apart)
                if not t.column("_ends")[len(x) - 1].as_py():
                    edge |= (run == run[-1]) & (x >= x[-1] - apart)
                state = _strongest(np.lexsort((x, -s)), low, high, edge)
                at_rows = np.flatnonzero(state >= 0)
                yield from _table_of(t.select(names), at_rows, {"_state": pa.array(state[at_rows], pa.int32())})

        return _sorted_blocks(marked, [*by, at], parts, go, "_state int", left)

    def first_one(left: DataFrame) -> DataFrame:
        best = left.groupBy(*by).agg(F.max(F.struct(F.col(score), -F.col(at))).alias("_best"))
        met = _joined(left, best, by).withColumn("_best", -F.col("_best.col2")).where((F.col(at) == F.col("_best")) | (F.abs(F.col(at) - F.col("_best")) > apart))
        return met.select(*left.columns, (F.col(at) == F.col("_best")).cast("int").alias("_state"))

    return _in_rounds(rows, scratch(df.sparkSession), settled, first_one, block)


def _strongest(order: np.ndarray, low: np.ndarray, high: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """1 for rows that are kept, 0 for open ones, -1 for others; low and high: the rows that each one reaches."""
    state, gone, unsure = np.full(len(order), -1, np.int8), np.zeros(len(order), bool), edge.copy()
    for i, a, z in zip(order.tolist(), low[order].tolist(), high[order].tolist()):
        if gone[i]:
            continue
        if unsure[i]:
            state[i] = 0
            unsure[a:z] = True
        else:
            state[i] = 1
            gone[a:z] = True
    return state


def pairs_one_to_one(pairs: DataFrame, by: list[str], left_id: str, right_id: str, cost: str, at: str, block: int = BLOCK) -> DataFrame:
    """Pairs (by, left_id, right_id, cost, at) in order of (cost, left_id, right_id), each row of either side used once.

    `at` is the left row's place on some axis: blocks hold neighbouring left rows with all their pairs. A block goes through
    its pairs in order: one with a used row falls away; one with an open row, or whose right row has pairs in other
    blocks, is open and opens its rows; others are taken. Only open pairs go on (see _in_rounds).
    """
    kept = [*by, left_id, right_id, cost, at]

    def settled(left: DataFrame, parts: int, size: int, whole: bool) -> DataFrame:
        total = left.groupBy(*by, right_id).agg(F.count("*").alias("_all"))
        counted = left.withColumn("_all", F.lit(0).cast("long")) if whole else _joined(left, total, [*by, right_id])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in _blocks(batches, size):
                mine, other = _codes(t, [*by, left_id]), _codes(t, [*by, right_id])
                # a block may end within a left row's pairs: both of its ends are open then
                split = np.zeros(len(t), bool)
                if not whole:
                    split = (mine == mine[0]) | (mine == mine[-1]) | (np.bincount(other)[other] < t.column("_all").to_numpy())
                order = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (cost, left_id, right_id)]).to_numpy()
                used, unsure = (np.zeros(mine.max() + 1, bool), np.zeros(other.max() + 1, bool)), (np.zeros(mine.max() + 1, bool), np.zeros(other.max() + 1, bool))
                state = np.full(len(t), -1, np.int8)
                for i, m, o, s in zip(order.tolist(), mine[order].tolist(), other[order].tolist(), split[order].tolist()):
                    if used[0][m] or used[1][o]:
                        continue
                    if s or unsure[0][m] or unsure[1][o]:
                        state[i], unsure[0][m], unsure[1][o] = 0, True, True
                    else:
                        state[i], used[0][m], used[1][o] = 1, True, True
                at_rows = np.flatnonzero(state >= 0)
                yield from _table_of(t.select(kept), at_rows, {"_state": pa.array(state[at_rows], pa.int32())})

        return _sorted_blocks(counted, [*by, at, left_id], parts, go, "_state int", left)

    def first_one(left: DataFrame) -> DataFrame:
        best = left.groupBy(*by).agg(F.min(F.struct(cost, left_id, right_id)).alias("_best"))
        mine, other = F.col(left_id) == F.col(f"_best.{left_id}"), F.col(right_id) == F.col(f"_best.{right_id}")
        return _joined(left, best, by).where((mine & other) | ~(mine | other)).select(*kept, (mine & other).cast("int").alias("_state"))

    return _in_rounds(pairs.select(*kept), scratch(pairs.sparkSession), settled, first_one, block)
