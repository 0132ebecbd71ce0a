"""Toxicity by a chain of linear classifiers, trained with out-of-fold predictions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import shared_dir, written

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}  # in the order of the chain
SAMPLE = 8_000  # labelled documents that the models are fitted on, about
TERMS = 400  # terms that the models know, for each category
FOLDS = 4
_core = re.compile(r"^\W*(.*?)(\W*)$", re.S)


def terms_of(token: str) -> tuple[str, ...]:
    """What a lower-cased token shows: its core, the core's first characters, and what stands behind it."""
    core, tail = _core.match(token).groups()
    return (f"w:{core}", f"4:{core[:4]}", f"5:{core[:5]}", f"7:{core[:7]}", f"t:{tail}") if len(core) > 4 else (f"w:{core}", f"t:{tail}")


def document_terms(text: str | None) -> set[str]:
    return {t for token in set((text or "").lower().split()) for t in terms_of(token)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression (the last is the bias, which isn't penalised), by accelerated gradient steps.
    Without both classes only the bias is fitted."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)

    def product(m: np.ndarray, v: np.ndarray) -> np.ndarray:  # in the matrix's own precision, so that it isn't copied
        return (m @ v.astype(m.dtype)).astype(float)

    probe = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = product(x.T, product(x, probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (0.25 * np.linalg.norm(product(x.T, product(x, probe))) + penalty)
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0
    ahead = w.copy()
    for k in range(rounds):
        new = ahead - step * (product(x.T, sigmoid(product(x, ahead)) - y) + keep * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))[:, None]


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """A model for each category. It sees the terms and the earlier categories' predictions, which in training come from
    models that were fitted without the row's fold; so what later models learn to trust is what they will see."""
    models, earlier = [], np.zeros((len(x), 0))
    for c in range(labels.shape[1]):
        seen = np.concatenate([x, earlier.astype(x.dtype)], 1)
        models.append(fit(seen, labels[:, c]))
        out = np.zeros(len(x))
        for f in np.unique(folds):
            out[folds == f] = score(seen[folds == f], fit(seen[folds != f], labels[folds != f, c]))
        earlier = np.concatenate([earlier, logit(out)], 1)
    return models


def chain_scores(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """[row, category] probabilities, each fed to the later models."""
    out = np.zeros((len(x), 0))
    for w in models:
        out = np.concatenate([out, score(np.concatenate([x, logit(out.ravel()).reshape(out.shape)], 1), w)[:, None]], 1)
    return out


class Chain:
    """Chosen terms, and the chain's models over them."""

    def __init__(self, names: list[str], terms: list[str], models: list[np.ndarray]):
        self.names, self.terms, self.models = names, {t: i for i, t in enumerate(terms)}, models
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _of(self, token: str) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[token] = tuple(self.terms[t] for t in terms_of(token) if t in self.terms)
        return found

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.terms)), np.float32)
        for row, text in zip(x, texts):
            for token in set((text or "").lower().split()):
                for i in self._of(token):
                    row[i] = 1
        return x

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return chain_scores(self.matrix(texts), self.models)


def train_chain(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", categories: dict[str, str] | None = None, sample: int = SAMPLE, terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """Fit a chain on about `sample` of the labelled documents (all, if there are fewer).

    categories names the chain's categories and the SQL condition on the labels for each, in order. The sample is those
    ids whose hash falls below a share of its range, so it is the same in each run. Tasks count the sample's terms; for
    each category those whose shares in and out of it differ most, in units of their standard error, are kept. What
    comes to the driver is bounded by sample and terms. Labels without a document and documents without a label are left
    out; a null condition is false; of repeated labels any that holds counts, of repeated ids the text that sorts first.
    Null texts have no terms. Without any labelled document every probability is one half. The sample is written once
    below the shared folder.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    truth = labels.groupBy(F.col(label_id).cast("long").alias("id")).agg(*(F.max(F.coalesce(F.expr(c), F.lit(False)).cast("double")).alias(n) for n, c in categories.items())).where("id is not null")
    n = truth.count()
    parts = 1 << 20
    chosen = truth.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)) < int(min(1.0, sample / max(n, 1)) * parts))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id", *names).agg(F.min("text").alias("text"))
    ready = written(picked.select("id", "text", *names), f"{shared_dir(docs.sparkSession)}/sample")
    k = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, inside = Counter(), [Counter() for _ in names]
        for b in batches:
            texts, marks = b.column(1).to_pylist(), [b.column(2 + c).to_pylist() for c in range(k)]
            for i, text in enumerate(texts):
                found = document_terms(text)
                every.update(found)
                for c in range(k):
                    if marks[c][i]:
                        inside[c].update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), *(pa.array([c[t] for t in every], pa.int64()) for c in inside)], ["term", "n", *(f"n{c}" for c in range(k))])

    counted = ready.mapInArrow(count, "term string, n long, " + ", ".join(f"n{c} long" for c in range(k))).groupBy("term").agg(*(F.sum(x).alias(x) for x in ("n", *(f"n{c}" for c in range(k)))))
    sizes = chosen.agg(F.count("*").alias("all"), *(F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in names)).first()
    kept: dict[str, None] = {}
    for c, name in enumerate(names):
        inside, outside = max(sizes[name], 1.0), max(sizes["all"] - sizes[name], 1.0)
        rate = F.col("n") / F.lit(float(max(sizes["all"], 1)))
        differ = F.abs(F.col(f"n{c}") / inside - (F.col("n") - F.col(f"n{c}")) / outside) / F.sqrt(rate * (1 - rate) * (1 / inside + 1 / outside) + 1e-9)
        kept.update(dict.fromkeys(r["term"] for r in counted.where("n >= 4").select("term", differ.alias("d")).orderBy(F.desc("d"), "term").limit(terms).collect()))
    chain = Chain(names, list(kept), [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = chain.matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32())), *b.columns[2:]], ["id", "at", *names])

    known = ready.mapInArrow(rows, "id long, at array<int>, " + ", ".join(f"`{x}` double" for x in names)).toArrow().sort_by("id").combine_chunks()
    if not known.num_rows:
        chain.models = [np.zeros(len(kept) + c + 1) for c in range(k)]
        return chain
    at = known.column("at").combine_chunks()
    x = np.zeros((known.num_rows, len(kept)), np.float32)
    x[np.repeat(np.arange(known.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = 1
    chain.models = fit_chain(x, np.stack([known.column(m).to_numpy() for m in names], 1), np.arange(known.num_rows) % folds)
    return chain


def score_documents(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_ and each category's name): the chain's probabilities for every row of docs; null texts have no terms."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                p = chain.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1]))], ["doc_id", *(f"p_{n}" for n in chain.names)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, " + ", ".join(f"`p_{n}` double" for n in chain.names))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", category: str = "toxic", above: float = 0.5) -> DataFrame:
    """docs without the documents whose probability for the category is above the bound; rows without an id stay."""
    chain = train_chain(docs, labels, id_col=id_col, text_col=text_col)
    out = score_documents(docs, chain, id_col=id_col, text_col=text_col).where(F.col(f"p_{category}") > above).select(F.col("doc_id").alias("_out")).distinct()
    return docs.join(out, docs[id_col] == out["_out"], "left_anti")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's probabilities, and whether it is toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, train_chain(docs, labels)).withColumn("toxic", F.col("p_toxic") > 0.5)
