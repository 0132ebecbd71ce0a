"""The different words of a corpus, and sums over each text's words of what is known of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, windows_of, word_spans, written

STEP = 1 << 22  # bytes of text that are worked on at once
HOT = 1 << 17  # at most so many of the most frequent words are held by every task; the others are joined
_inside = np.ones(256, bool)
_inside[[*range(9, 14), 32]] = False  # bytes between words


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(forms, form, edges): the different words of texts, which one stands at each place, and where each text's begin. Words
    stand between ASCII white space; lower: A to Z are lower-cased first."""
    data, begins, ends = binary_parts(pc.ascii_lower(texts) if lower else texts)
    starts, stops, edges = word_spans(data, begins, ends, _inside)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    kept = np.concatenate([data[_inside[data]], np.zeros(0, np.uint8)])
    forms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return forms.dictionary, forms.indices.to_numpy().astype(np.int64), edges


def word_counts(texts: DataFrame, lower: bool) -> DataFrame:
    """(word, c, seen): of each word of texts (text, counted) how often it stands in texts that are `counted`, and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in windows_of(batch, ["text"], STEP):
                forms, form, edges = words_of(b.column(0), lower)
                counted = np.repeat(b.column(1).to_numpy(zero_copy_only=False), np.diff(edges))
                seen, c = np.bincount(form, minlength=len(forms)), np.bincount(form[counted], minlength=len(forms))
                yield pa.RecordBatch.from_arrays([forms, pa.array(c.astype(np.int64)), pa.array(seen.astype(np.int64))], ["word", "c", "seen"])

    return texts.select("text", "counted").mapInArrow(count, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def sums_by_text(texts: DataFrame, terms: DataFrame, folder: str, lower: bool, hot: int = HOT) -> DataFrame:
    """texts (text and others) with, in place of the text, n_words and for each value column of terms (word, seen, values)
    its sum over the text's words; every word is in terms.

    A task looks its words up in the most frequent ones (at most `hot`, which every task holds: whole levels of like numbers
    of occurrences, as many as fit); the others are written with their text's number and joined by the word, so nothing is
    left out and no word of the join is frequent.
    """
    spark, values = texts.sparkSession, [c for c in terms.columns if c not in ("word", "seen")]
    level = F.floor(F.log2("seen") * 8).cast("int")  # a few hundred levels
    least, room = None, hot
    for row in sorted(terms.groupBy(level.alias("k")).count().collect(), key=lambda r: -r["k"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["k"]
    table = terms.where(level >= least).select("word", *values).toArrow() if least is not None else None
    rare = terms if least is None else terms.where(level < least)
    held, others = spark.sparkContext.broadcast(table), [c for c in texts.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.schema.fields, *terms.schema.fields]}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        names = known.column("word").combine_chunks() if known is not None else pa.array([], pa.string())
        numbers = [known.column(c).to_numpy() if known is not None else np.zeros(0, np.int64 if kinds[c] == "bigint" else np.float64) for c in values]
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in windows_of(batch, ["text"], STEP):
                forms, form, edges = words_of(b.column(0), lower)
                here = pc.fill_null(pc.index_in(forms, names), -1).to_numpy(zero_copy_only=False)[form] if len(forms) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(b.num_rows), np.diff(edges))
                hot_at, cold_at = np.flatnonzero(here >= 0), np.flatnonzero(here < 0)
                sums = [np.bincount(owner[hot_at], v[here[hot_at]], b.num_rows).astype(v.dtype) for v in numbers]
                code, n = np.unique(owner[cold_at] * max(len(forms), 1) + form[cold_at], return_counts=True)
                lists = pa.array(np.searchsorted(code // max(len(forms), 1), np.arange(b.num_rows + 1)).astype(np.int32))
                left = [pa.ListArray.from_arrays(lists, x) for x in (forms.take(pa.array(code % max(len(forms), 1))), pa.array(n.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(number + np.arange(b.num_rows)), pa.array(np.diff(edges)), *(pa.array(s) for s in sums), *left], [*others, "_row", "n_words", *values, "_words", "_times"])
                number += b.num_rows

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "_row long, n_words long", *(f"`{c}` {kinds[c]}" for c in values), "_words array<string>, _times array<long>"])
    met = written(texts.select("text", *others).mapInArrow(look_up, schema), f"{folder}/met")
    apart = met.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_row", F.col("w._words").alias("word"), F.col("w._times").alias("_n"))
    rest = apart.join(rare.select("word", *values), "word").groupBy("_row").agg(*(F.sum(F.col("_n") * F.col(c)).alias(f"_{c}") for c in values))
    return met.join(rest, "_row", "left").select(*others, "n_words", *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(kinds[c]).alias(c) for c in values))
