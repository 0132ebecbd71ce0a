"""The classifier chain and its query against a version of plain loops, with models fitted by Newton's steps."""

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from trackmill.llm import toxicity


def plain_terms(text):
    out = set()
    for token in (text or "").lower().split():
        tail = re.search(r"\W*$", token)[0] if re.search(r"\w", token) else None
        core = re.sub(r"^\W+", "", token)
        core, tail = (core[: len(core) - len(tail)], tail) if tail is not None else ("", re.sub(r"^\W*", "", token, count=0) if not token else core)
        out |= {f"w:{core}", f"t:{tail}"} | ({f"{n}:{core[:n]}" for n in (4, 5, 7)} if len(core) > 4 else set())
    return out


def newton(x, y, penalty=0.3):
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        z, keep = np.column_stack([x, np.ones(len(x))]), np.append(np.full(x.shape[1], penalty), 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(z @ w)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-12), z.T @ (p - y) + keep * w)
    return w


def plain_chain(docs, truth, terms, folds):
    """Probabilities of every document by name; docs: id to text, truth: id to the categories' labels in the chain's order."""
    ids = sorted(i for i in truth if i in docs)
    seen = {i: plain_terms(docs[i]) for i in docs}
    labels, kept = np.array([truth[i] for i in ids], float), {}
    for c in range(labels.shape[1]):
        inside, outside = max(labels[:, c].sum(), 1.0), max(len(ids) - labels[:, c].sum(), 1.0)
        found = []
        for t in {t for i in ids for t in seen[i]}:
            n, own = sum(t in seen[i] for i in ids), sum(t in seen[i] for i, v in zip(ids, labels[:, c]) if v)
            if n >= 4:
                rate = n / len(ids)
                found.append((-abs(own / inside - (n - own) / outside) / math.sqrt(rate * (1 - rate) * (1 / inside + 1 / outside) + 1e-9), t))
        kept |= dict.fromkeys(t for _, t in sorted(found)[:terms])
    matrix = lambda some: np.array([[float(t in seen[i]) for t in kept] for i in some])
    lo = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    said = lambda x, w: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    x, every, fold = matrix(ids), matrix(docs), np.arange(len(ids)) % folds
    out = []
    for c in range(labels.shape[1]):
        w, held = newton(x, labels[:, c]), np.zeros(len(ids))
        for f in range(folds):
            held[fold == f] = said(x[fold == f], newton(x[fold != f], labels[fold != f, c]))
        out.append(said(every, w))
        x, every = np.column_stack([x, lo(held)]), np.column_stack([every, lo(out[-1])])
    return dict(zip(docs, np.array(out).T.tolist()))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r, docs, labels = random.Random(6), [], []
    for i in range(240):
        low, toxic = r.random() < 0.3, r.random() < 0.25
        words = prose(40, i).split() + ["cheap"] * low + (["vileness!", "rotten"] if toxic and r.random() < 0.9 else []) + (["junkword"] if low and toxic else [])
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(not low), int(toxic)))
    docs += [(300, None), (301, ""), (302, "Vileness, ROTTEN")]
    folder = tmp_path_factory.mktemp("chain")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(docs), {i: (int(q == 0), t) for i, q, t in labels}, str(folder)


def test_query_against_plain_loops(spark, corpus):
    docs, truth, folder = corpus
    want, found = plain_chain(docs, truth, toxicity.TERMS, toxicity.FOLDS), toxicity.op9_toxicity(spark, folder)
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    rows, off = found.collect(), []
    assert len(rows) == len(docs)
    for row in rows:
        low, toxic = want[row.doc_id]  # where Newton's steps end; the chain's 300 gradient steps come near
        off += [abs(row.p_low_quality - low), abs(row.p_toxic - toxic)]
        assert row.toxic == (row.p_toxic > 0.5) and (row.toxic == (toxic > 0.5) or abs(toxic - 0.5) < 0.1)
    assert max(off) < 0.12 and sum(off) / len(off) < 0.015
    assert sum(r.toxic for r in rows) > 30


def test_terms(corpus):
    texts = [*corpus[0].values(), "x", "...", "a-b, (c)", "'Long-winded'!", "日本語文章です。 ÀÉ!"]
    assert [toxicity.document_terms(t) for t in texts] == [plain_terms(t) for t in texts]


def test_stage_on_odd_rows(spark, corpus, tmp_path):
    """Nulls in any column, repeated rows, a column _out, long texts with and without spaces, and nothing at all."""
    kind = "doc_id long, text string, _out string, source string"
    rows = [(1, None, None, None), (2, "", "x", "s"), (None, "vileness! rotten junkword", "x", "s"), (3, prose(200_000, 5), "x", "s"), (4, "q" * 2_000_000, "x", "s"), (5, "vileness! rotten " * 3, "x", "s"), (6, prose(30, 6), None, "s"), (6, prose(30, 6), None, "s")]
    kept = corpus_pipeline.without_toxic(spark, spark.createDataFrame(rows, kind), corpus[2])
    assert kept.columns == ["doc_id", "text", "_out", "source"]
    # none of these has a label, so that nothing is learned, nothing is toxic, and everything stays
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in rows)
    both = spark.createDataFrame(rows, kind).select("doc_id", "text").withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id") + 1000).union(spark.read.parquet(f"{corpus[2]}/documents.parquet"))
    ids = sorted(str(r.doc_id) for r in corpus_pipeline.without_toxic(spark, both, corpus[2]).select("doc_id").collect())
    assert "1005" not in ids and {"1001", "1002", "1003", "1004", "None"} <= set(ids) and ids.count("1006") == 2
    assert corpus_pipeline.without_toxic(spark, both.limit(0), corpus[2]).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.without_toxic(spark, both, str(tmp_path)).count() == both.count()
