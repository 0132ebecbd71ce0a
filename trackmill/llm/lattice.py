"""Language-model scores from subword lattices: a word's probability is summed over all ways to spell it in pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import shared_dir, windows_of, written
from trackmill.llm.tokencount import unigram_pieces
from trackmill.llm.vocabulary import HOT, STEP, sums_by_text, word_counts

CHARS = 1 << 18  # characters of words that are worked on at once
LONG = 1 << 10  # characters of a word that is worked on alone
_lattices: dict[str, Lattice] = {}


class Lattice:
    """The pieces of a vocabulary as a trie, and forward sums over all segmentations of words.

    A word's spelling begins with the mark ▁. A character that is no piece is spelled in bytes, each ten natural logarithms
    below the rarest piece. The recursion runs in natural logarithms over all words of a block at once, place by place.
    """

    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - 10.0
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, float] = {}
        for piece, score in pieces.items():
            node = 0
            for c in piece:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
            ends[node] = score
        key = np.array([a << 21 | c for a, c in edges], np.int64)
        order = np.argsort(key)
        self.keys, self.targets = key[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.scores = np.full(len(edges) + 1, -np.inf)
        self.scores[list(ends)] = list(ends.values())

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node that each one's edge leads to, or 0."""
        if not len(self.keys):
            return np.zeros(len(node), np.int64)
        wanted = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], 0)

    def arcs(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, score) of every piece in words that stand side by side; ends: where the word of each place ends."""
        begin, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        found = []
        while len(begin):
            node = self._step(node, chars[begin + depth])
            depth += 1
            score = self.scores[node]
            if depth == 1:  # a character without a piece; node 0 has no score
                missing = np.isneginf(score)
                c = chars[begin[missing]]
                found.append((begin[missing], begin[missing] + 1, self.byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
            is_piece = ~np.isneginf(score)
            found.append((begin[is_piece], begin[is_piece] + depth, score[is_piece]))
            on = (node > 0) & (begin + depth < ends[begin])
            begin, node = begin[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def marginals(self, words: list[str]) -> np.ndarray:
        """The natural logarithm of each word's probability, summed over its segmentations."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG:
            out[order[-1]] = self._long("▁" + words[order[-1]])
            order.pop()
        a = 0
        while a < len(order):
            z, total = a, 0
            while z < len(order) and (z == a or total + len(words[order[z]]) + 1 <= CHARS):
                total += len(words[order[z]]) + 1
                z += 1
            out[order[a:z]] = self._block(["▁" + words[i] for i in order[a:z]])
            a = z
        return out

    def _long(self, word: str) -> float:
        """One word's, place by place, without arrays: for a word that has more places than a block has words."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start, stop, score = self.arcs(chars, np.full(len(chars), len(chars)))
        order = np.argsort(stop, kind="stable")
        edge = np.searchsorted(stop[order], np.arange(1, len(chars) + 2)).tolist()
        start, score, sums = start[order].tolist(), score[order].tolist(), [0.0]
        for a, z in zip(edge, edge[1:]):
            values = [sums[start[k]] + score[k] for k in range(a, z)]
            most = max(values)
            sums.append(most + math.log(math.fsum(math.exp(v - most) for v in values)))
        return sums[-1]

    def _block(self, words: list[str]) -> np.ndarray:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words])
        last = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        start, stop, score = self.arcs(chars, last[word])
        place = stop - (last - size)[word[start]]  # characters of the word up to the piece's end
        order = np.lexsort((stop, place))
        start, stop, score, place = start[order], stop[order], score[order], place[order]
        shift = word  # a word of n characters has n + 1 sums
        sums = np.zeros(len(chars) + len(words))  # sums[place + word]: of all spellings of what stands before the place
        heads = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))  # arcs of one stop stand together
        rounds = np.concatenate([[0], np.flatnonzero(np.diff(place[heads])) + 1, [len(heads)]])
        edge = np.append(heads, len(stop))
        for p, q in zip(rounds[:-1].tolist(), rounds[1:].tolist()):
            low, high = edge[p], edge[q]
            values = sums[start[low:high] + shift[start[low:high]]] + score[low:high]
            cut = heads[p:q] - low
            most = np.maximum.reduceat(values, cut)
            total = np.add.reduceat(np.exp(values - np.repeat(most, np.diff(np.append(cut, high - low)))), cut)
            at = stop[heads[p:q]]
            sums[at + shift[at - 1]] = most + np.log(total)
        return sums[last + np.arange(len(words))]


def lattice_of(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(unigram_pieces(path))
    return _lattices[path]


def held_out_of(doc_id: Column) -> Column:
    """Whether a document's text isn't learned from: the crc32 of its id as text is divisible by 10; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10, F.lit(0)) == 0


class Learned:
    """What training texts tell: N tokens (words and an end for each text), V different ones, E ends, S words seen once."""

    def __init__(self, words: DataFrame, ends: int):
        row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("s")).first()
        self.tokens, self.ends = row["n"] + ends, ends
        self.different = row["v"] + (ends > 0)
        self.new = (row["s"] + 1) / (self.tokens + 1)  # the share of tokens that are spelled, by the share of words seen once

    def base(self, c: Column) -> Column:
        return F.log10((c + 0.1) / (self.tokens + 0.1 * (self.different + 1)))

    def score(self, c: Column, spelled: Column) -> Column:
        """log10 of (1 - new) c / N + new exp(spelled), whichever is larger taken out of the sum."""
        known = F.log(F.when(c > 0, (1.0 - self.new) * c / max(self.tokens, 1)).otherwise(F.lit(None).cast("double")))
        other = spelled + math.log(self.new)
        high, low = F.greatest(known, other), F.least(known, other)  # greatest and least leave nulls out
        return (high + F.when(c > 0, F.log1p(F.exp(low - high))).otherwise(0.0)) / math.log(10.0)


def score_texts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; scores are log10.

    Tokens are the lower-cased words and one end a text. The model is a unigram lattice: a word is either met whole, with
    its share of the training tokens, or spelled, by any segmentation into pieces of the vocabulary file `model`, each
    weighing its score there; score sums over all of these, in proportion to 1 - new and new, where new is the share of
    training tokens that are words seen once. An end is spelled with the weight of one more piece. base_score is a count
    model with 0.1 added.

    Two passes over the texts. The first counts the words of all texts (a shuffle of each task's different words); each
    different word's forward sum is computed once, in tasks of like numbers of words. In the second pass a task looks its
    words up in the most frequent ones (at most `hot`, which every task holds); the others are written with their
    document's number and joined by the word, so nothing is left out. Counts and spelled words are tables below
    spark.checkpoint.dir. model is a path that all tasks can read.

    A null text is empty; a null id is held out (`held_out` may say otherwise); rows with the same id are separate texts;
    other columns don't matter; without training texts known words have no share. An empty table gives an empty table.
    """
    folder = shared_dir(docs.sparkSession)
    out = F.coalesce(held_out, F.lit(True)) if held_out is not None else held_out_of(F.col(id_col))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"), F.col(id_col).alias("doc_id"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model)
        for batch in batches:
            for b in windows_of(batch, ["word"], STEP):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice.marginals(b.column(0).to_pylist()))], ["word", "c", "seen", "spelled"])

    counts = word_counts(texts.select("text", (~F.col("held_out")).alias("counted")), lower=True)
    words = written(counts.mapInArrow(spell, "word string, c long, seen long, spelled double"), f"{folder}/words")
    learned = Learned(words, texts.where(~F.col("held_out")).count())
    terms = words.select("word", "seen", (F.col("c") > 0).cast("long").alias("known"), learned.base(F.col("c")).alias("base"), learned.score(F.col("c"), F.col("spelled")).alias("score"))
    pieces = len(unigram_pieces(model)) + 1
    ends = F.lit(learned.ends)
    end = docs.sparkSession.range(1).select(learned.base(ends).alias("base"), learned.score(ends, F.lit(-math.log(pieces))).alias("score")).first()
    found = sums_by_text(texts, terms, folder, lower=True, hot=hot)
    return found.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + int(learned.ends > 0)).alias("n_known"), F.lit(learned.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end["base"]).alias("base_score"), (F.col("score") + end["score"]).alias("score"),
    )


def op13_lattice_scores(spark, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    import public_tokenizers

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
