"""Collocations: frequent phrases found by mergeable summaries and then counted exactly, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import binary_parts, run_hashes, shared_dir, windows_of, word_spans, written
from trackmill.llm.decontam import Filter

STEP = 1 << 22  # bytes of text that are worked on at once
HELD = 1 << 21  # n-grams that a task gathers before it sends their counts on, and counters that a merge waits for
BUCKET = 1 << 24  # words a bucket of n-gram hashes
_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_word = np.ones(256, bool)
_word[[9, *range(10, 14), 32, *b".,;:!?"]] = False  # bytes between words
_break = np.zeros(256, bool)
_break[[*range(10, 14), *b".,;:!?"]] = True  # bytes between pieces


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a window of texts: their different forms, which form each one is, a hash of language and form, and
    whether the next word belongs to the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, begins, ends = binary_parts(pc.ascii_lower(texts))
        starts, stops, edges = word_spans(data, begins, ends, _word)
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        kept = np.concatenate([data[_word[data]], np.zeros(0, np.uint8)])
        forms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        tongues = langs.dictionary_encode()
        self.forms, self.form = forms.dictionary, forms.indices.to_numpy().astype(np.int64)
        self.langs, self.lang = tongues.dictionary.to_pylist(), np.repeat(tongues.indices.to_numpy().astype(np.int64), np.diff(edges))
        of_form, of_lang = (run_hashes(*binary_parts(x)) for x in (self.forms, pc.cast(tongues.dictionary, pa.binary())))
        self.hash = _mixed(of_form[self.form] + of_lang[self.lang] * _C[0])
        pieces = np.cumsum(_break[data])[starts]
        self.joined = np.append(pieces[1:] == pieces[:-1], False)[: len(starts)]
        self.joined[edges[1:][edges[1:] > 0] - 1] = False

    def grams(self, longest: int, words: Filter, pairs: Filter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, hashes) of the phrases of 2 words up to longest whose words, and pairs of neighbours if given,
        pass the filters: a phrase can't be more frequent than its parts."""
        fit = np.zeros(len(self.hash), bool)
        fit[words.places(self.hash)] = True
        at = np.flatnonzero(fit[:-1] & fit[1:] & self.joined[:-1])
        h = self.paired(at)
        if pairs is not None:
            keep = pairs.places(h)
            at, h = at[keep], h[keep]
        follows = np.zeros(len(self.hash) + 1, bool)
        follows[at] = True
        yield 2, at, h
        for size in range(3, longest + 1):
            go = follows[at + size - 2]
            at, h = at[go], h[go]
            h = _mixed(h * _C[0] + self.hash[at + size - 1] + np.uint64(size))
            yield size, at, h

    def paired(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.hash[at] * _C[0] + self.hash[at + 1] + np.uint64(2))

    def counted(self, size: int, at: np.ndarray, h: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """(langs, phrases, counts) of the phrases at these places, told apart by their words, not only by their hashes."""
        _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        same = self.lang[at] == self.lang[at[first]][which]
        for j in range(size):
            same &= self.form[at + j] == self.form[at[first] + j][which]
        if not same.all():  # two phrases share a hash
            rows = np.stack([self.lang[at], *(self.form[at + j] for j in range(size))], 1)
            _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        heads = at[first]
        words = [self.forms.take(pa.array(self.form[heads + j])).to_pylist() for j in range(size)]
        return [self.langs[i] for i in self.lang[heads].tolist()], [b" ".join(w).decode() for w in zip(*words)], n


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for b in windows_of(batch, ["text"], STEP):
            yield Words(b.column(0), b.column(1))


def _counts(langs: list, phrases: list, sizes: list, n: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(n, pa.int64()), pa.array(hashes.view(np.int64))], ["lang", "phrase", "words", "n", "h"])


_COUNTS = "lang string, phrase string, words int, n long, h long"


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, words, n, h): how often each word of texts (text, lang) occurs, and its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches):
            code, first, n = np.unique(w.lang * len(w.forms) + w.form, return_index=True, return_counts=True)
            phrases = w.forms.take(pa.array(w.form[first])).cast(pa.string()).to_pylist()
            yield _counts([w.langs[i] for i in w.lang[first].tolist()], phrases, [1] * len(code), n, w.hash[first])

    return texts.mapInArrow(count, _COUNTS).groupBy("lang", "phrase", "words", "h").agg(F.sum("n").alias("n")).select("lang", "phrase", "words", "n", "h")


class Summary:
    """A Misra-Gries summary: counters of keys, each too low by at most `missing`.

    If there are more counters than the capacity, the count of the first beyond it is taken off each; that takes more than
    capacity times as much off all counts together, so what is missing never exceeds the mass over the capacity.
    """

    def __init__(self, capacity: int):
        self.capacity, self.missing = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        every, n = np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts])
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[heads], np.add.reduceat(n, heads) if len(heads) else n
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > off
            self.keys, self.counts, self.missing = self.keys[left], self.counts[left] - off, self.missing + off

    def reaching(self, least: int) -> np.ndarray:
        """The keys that may have been counted so often: no such key is missing while the capacity exceeds mass / least."""
        return self.keys[self.counts + self.missing >= least]


def frequent_hashes(texts: DataFrame, sizes: range, least: int, buckets: int, words: Filter, pairs: Filter | None) -> DataFrame:
    """(h) of all phrases of these sizes that occur at least `least` times, and of few others.

    Each task counts its phrases and sends a summary for each bucket of hashes; what belongs to a bucket is merged in one
    Misra-Gries summary, whose capacity follows from the bucket's mass. So a bucket holds at most mass / least counters
    (and what waits to be merged), however many different phrases there are.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # rising with the key
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1, [len(keys)]])
            parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            mass = np.add.reduceat(n, cuts[:-1])
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(mass), pa.array([keys[a:z].tobytes() for a, z in parts], pa.binary()), pa.array([n[a:z].astype(np.int32).tobytes() for a, z in parts], pa.binary())], ["bucket", "mass", "keys", "counts"])

        for w in _windows(batches):
            for k, at, h in w.grams(sizes[-1], words, pairs):
                if k in sizes and len(at):
                    held.append(h)
                    size += len(h)
            if size > HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        now, mass, summary, keys, counts, waiting = None, 0, None, [], [], 0

        def closed() -> None:
            if now is not None:
                summary.merge(keys, counts)
                found.append(summary.reaching(least))

        for b in batches:
            for bucket, more, raw_keys, raw_counts in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    if summary is not None:
                        closed()
                    now, mass, summary, keys, counts, waiting = bucket, 0, None, [], [], 0
                if raw_keys is None:  # the bucket's masses come first
                    mass += more
                    continue
                if summary is None:
                    summary = Summary(mass // least + 1)
                keys.append(np.frombuffer(raw_keys, np.uint64))
                counts.append(np.frombuffer(raw_counts, np.int32).astype(np.int64))
                waiting += len(keys[-1])
                if waiting >= max(HELD, summary.capacity):
                    summary.merge(keys, counts)
                    keys, counts, waiting = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])
            found = []
        if summary is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])

    parts = texts.mapInArrow(summed, "bucket long, mass long, keys binary, counts binary")
    none = F.lit(None).cast("binary")
    both = F.array(F.struct("bucket", "mass", none.alias("keys"), none.alias("counts")), F.struct("bucket", F.lit(0).cast("long").alias("mass"), "keys", "counts"))
    rows = parts.select(F.inline(both)).repartition("bucket").sortWithinPartitions("bucket", F.col("keys").isNotNull())
    return rows.mapInArrow(merged, "h long")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, n) of every word that occurs at least `least` times and of every phrase of 2
    to `longest` words that does so within pieces, with exact counts; and (lang, n), all word occurrences.

    Four passes over the texts: words are counted; pairs of frequent words are summed up in Misra-Gries summaries by ranges
    of hashes; then longer phrases of frequent pairs; then what the summaries left is counted by its words. The passes
    share Bloom filters of at most 2^27 bits: one that is too small for its keys lets more phrases be counted, and changes
    no result. Both tables are written below spark.checkpoint.dir.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = written(word_counts(texts), f"{folder}/words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    mass = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), mass // BUCKET + 1)
    frequent = words.where(F.col("n") >= least)
    known = Filter(frequent.select("h"))
    pairs = written(frequent_hashes(texts, range(2, 3), least, buckets, known, None), f"{folder}/pairs")
    paired = Filter(pairs)
    more = written(frequent_hashes(texts, range(3, longest + 1), least, buckets, known, paired), f"{folder}/longer") if longest > 2 else pairs.limit(0)
    longer = Filter(more)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches):
            for size, at, h in w.grams(longest, known, paired):
                if size > 2:
                    keep = longer.places(h)
                    at, h = at[keep], h[keep]
                if len(at):
                    langs, phrases, n = w.counted(size, at, h)
                    yield _counts(langs, phrases, [size] * len(phrases), n, np.zeros(len(n), np.uint64))

    exact = texts.mapInArrow(count, _COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = written(exact.unionByName(frequent.select("lang", "phrase", "words", "n")), f"{folder}/phrases")
    return found, totals


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, words, a, cut, l, r, n, score): phrases of 2 to `longest` words that occur a >= `least` times, with the
    cut into two parts, of l and r occurrences, that has the lowest score floor(1000 a n / (l r)); of equal ones the first.

    A phrase that stands inside a longer one which is as frequent is left out. Both parts of a frequent phrase are frequent
    too, so a phrase meets their counts by equi-joins on (lang, part). Products are decimals of 38 digits. Null texts are
    empty, a null language is `und`; other columns and repeated rows don't matter; an empty table gives an empty table.
    """
    found, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least)
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda first, size: F.array_join(F.slice(F.split("phrase", " "), first, size), " ")
    inside = phrases.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "a")
    whole = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))  # any phrase between the two is as frequent
    kept = phrases.join(whole, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"first": part(F.lit(1), F.col("cut")), "rest": part(F.col("cut") + 1, F.col("words") - F.col("cut"))})
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = both.withColumn("score", F.expr("(1000 * cast(a as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "words", "a", F.col("_b.cut").alias("cut"), F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))


def top_collocations(found: DataFrame, most: int) -> DataFrame:
    """found with rank: each language's first `most` by score and a, both falling, then by the phrase. Each language is first
    cut to its best within 64 shares, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("_k", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_k").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_k")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of each language of all documents."""
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return top_collocations(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM w, range(1, 6) t(k), unnest(range(1, len(w) - k + 2)) u(i)
), f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 100
), i AS (SELECT DISTINCT l.lang, array_to_string(l.w[s : s + k - 1], ' ') AS phrase, l.a FROM c l, range(2, 5) t(k), unnest(range(1, l.words - k + 2)) u(s) WHERE k < l.words
), d AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), s AS (SELECT d.lang, d.phrase, d.a, k, x.a AS l, y.a AS r, n.n, CAST((1000 * CAST(d.a AS HUGEINT) * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM d JOIN range(1, 5) t(k) ON k < d.words JOIN n ON n.lang = d.lang
  JOIN f x ON x.lang = d.lang AND x.words = k AND x.phrase = array_to_string(d.w[1 : k], ' ')
  JOIN f y ON y.lang = d.lang AND y.words = d.words - k AND y.phrase = array_to_string(d.w[k + 1 : d.words], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM b QUALIFY rank <= 2000
"""
