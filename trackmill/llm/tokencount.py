"""Token counts of a unigram tokenizer, by dynamic programming that words with a common prefix share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import shared_dir, written
from trackmill.llm.vocabulary import HOT, sums_by_text, word_counts


def unigram_pieces(path: str) -> dict[str, float]:
    """The pieces of a SentencePiece file and their log probabilities.

    A file of merges tells ranks (as scores below zero), not probabilities; a piece of rank r gets a Zipf share, 1 over
    r + 2 times the sum of all of these.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    total = sum(1 / (r + 2) for r in pieces.values())
    return {p: -math.log((r + 2) * total) for p, r in pieces.items()}


class UnigramCounter:
    """How many tokens the best segmentation of each word has.

    Words are inserted into a trie in sorted order; each node is a prefix, and its forward score (the best sum of log
    probabilities over segmentations of the prefix, and how many tokens that has) is computed once, for all words that share
    it. A word's end stores its count. In sorted order only the path to the current word is open, also from one call to the
    next, so the trie needs no more memory than its longest word. Characters without a piece are one token a byte. Of equal
    scores fewer tokens win.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.path, self.best, self.used = "", [0.0], [0]  # the word before, and the scores and counts of its prefixes
        self.nodes = 0

    def counts(self, words: Iterable[str]) -> list[int]:
        """The tokens of each word. Words may come in any order, but share prefixes with the word before only."""
        get, longest, unknown, best, used, before, out = self.pieces.get, self.longest, self.unknown, self.best, self.used, self.path, []
        for bare in words:
            word, same = f"▁{bare}", 0
            most = min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], used[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                score, count = best[end - 1] + unknown * n, used[end - 1] + n
                for start in range(max(0, end - longest), end):
                    p = get(word[start:end])
                    if p is not None:
                        s = best[start] + p
                        if s > score or s == score and used[start] + 1 < count:
                            score, count = s, used[start] + 1
                best.append(score)
                used.append(count)
            self.nodes += len(word) - same
            out.append(used[len(word)])
            before = word
        self.path = before
        return out


def counted_words(words: DataFrame, model: str) -> DataFrame:
    """words (word and others) with n_tokens. Words are dealt to tasks by ranges and sorted there, so that words with a common
    prefix stand together over the whole corpus: a prefix is scored once, but where a range begins within it."""
    others = [c for c in words.columns if c != "word"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(unigram_pieces(model))
        for b in batches:
            n = counter.counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["word", *others, "n_tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.select("word", *others).schema.fields)
    return words.select("word", *others).repartitionByRange("word").sortWithinPartitions("word").mapInArrow(count, f"{kinds}, n_tokens long")


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of docs.

    Words stand between ASCII white space and are segmented one by one, each with a word mark before it. The different words
    of the corpus meet in Spark; each is segmented once, in the trie of its range (counted_words), and written below
    spark.checkpoint.dir. A second pass over the texts adds their words' counts up (see sums_by_text): the most frequent
    words, at most `hot`, are held by every task, the others joined. model is the path of a SentencePiece file that all
    tasks can read. Null and empty texts have no tokens; ids may repeat or be null; other columns don't matter; an empty
    table gives an empty table.
    """
    folder = shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    counts = written(word_counts(texts.select("text", F.lit(False).alias("counted")), lower=False).select("word", "seen"), f"{folder}/counts")
    words = written(counted_words(counts, model), f"{folder}/words")
    return sums_by_text(texts, words, folder, lower=False, hot=hot)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
