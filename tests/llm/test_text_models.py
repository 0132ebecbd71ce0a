"""Fill-in-middle, collocations and lattice scores: operators and queries against plain loops."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from trackmill.llm import infill, lattice, phrases


def folder_of(spark, rows, path, schema="doc_id long, text string, lang string, source string, form string, n long, h long"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts with nulls, repeats, sentinels, several scripts, and one of 1.5 MB without a space; columns with the operators' names."""
    texts = [None, "", "a", "été 日本語 😀", "x <P> y", "<S", "P>a", "Same, same. Same", prose(300, 1), prose(300, 1), "a b\nc\x0bd  e\tf", "ÀB é" * 400, "yz" * 750_000, prose(9000, 2) + ". " + "over and over " * 3000]
    rows = [(None if i == 3 else min(i, 9), t, ("en", "de", None, "und")[i % 4], None, "f", i, i) for i, t in enumerate(texts)]
    return rows, folder_of(spark, rows, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder_of(spark, [], tmp_path_factory.mktemp("empty"))


# fill-in-middle


@pytest.mark.parametrize("unit", ["char", "line"])
def test_units(unit):
    r = random.Random(5)
    for _ in range(200):
        texts = ["".join(r.choice("ab\né€😀 ") for _ in range(r.choice([0, 0, 1, 3, 8, 20, 70]))) for _ in range(r.randint(1, 9))]
        h1, h2 = (np.array([r.randrange(1 << 32) for _ in texts]) for _ in range(2))
        for i, (n, a, b, begin, c, d, end) in enumerate(zip(*infill.cut_places(pa.array(texts), h1, h2, unit))):
            units = list(texts[i]) if unit == "char" else re.findall(r".*\n|.+$", texts[i])
            x, y = sorted((h1[i] % (len(units) + 1), h2[i] % (len(units) + 1)))
            assert (n, a, b, end - begin) == (len(units), x, y, len(texts[i].encode()))
            assert (c - begin, d - begin) == tuple(len("".join(units[:k]).encode()) for k in (x, y))


def brute_infill(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    p, q = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(s in t for s in infill.SENTINELS) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    if h4 % 100 < 20:
        return doc_id, len(t), "spm", p, q - p, sha(f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}"), sha(t)
    return doc_id, len(t), "psm", p, q - p, sha(f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}"), sha(t)


def test_fill_in_middle(spark, odd, empty):
    rows, path = odd
    found = infill.op11_fill_in_middle(spark, path)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute_infill(i, t) for i, t, *_ in rows), key=str)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"} or len(rows) < 20
    assert infill.op11_fill_in_middle(spark, empty).count() == 0


def test_other_sentinels_and_lines(spark):
    docs = spark.createDataFrame([(i, "one\ntwo\nthree (.*)\n" + prose(i, i)) for i in range(40)], "doc_id long, text string")
    marks = ("[a]", "(.*)x", "|")
    made = infill.fill_in_middle(docs, share=1.0, spm_share=0.5, unit="line", sentinels=marks)
    back = made.select("doc_id", "form", "output", infill.restored(made["output"], made["form"], marks).alias("text")).collect()
    texts = dict(map(tuple, docs.collect()))
    assert all(r.text == texts[r.doc_id] for r in back) and {r.form for r in back} == {"psm", "spm"}


# collocations


def brute_phrases(rows, least, most):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[1][i : i + len(p[1])] == p[1] for i in range(len(q[1]) - len(p[1]) + 1))
    out = collections.defaultdict(list)
    for p, a in cands.items():
        lang, w = p
        if any(q[0] == lang and len(q[1]) > len(w) and b >= a and inside(p, q) for q, b in cands.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, c in out.items() for i, (s, a, p, l, r) in enumerate(sorted(c)[:most]))


@pytest.mark.parametrize(("least", "most"), [(2, 2000), (3, 7)])
def test_collocations(spark, least, most):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["red", "Red", "green", "blue", "é", "x-y", "a.", "b,", "c\n", "very\tlong"]) for _ in range(r.randint(0, 60))), ("en", None, "und", "de")[i % 4]) for i in range(120)] + [(None, None, None), (1, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash")).repartition(5)
    found = phrases.top_collocations(phrases.collocations(docs, least=least), most)
    assert sorted(tuple(x) for x in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, least, most)


def test_phrase_query(spark, odd, empty):
    rows, path = odd
    found = phrases.op12_phrases(spark, path)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 100, 2000) and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert any(r.phrase == "over and over over and" for r in found.collect())
    assert phrases.op12_phrases(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_summaries_keep_what_is_frequent(seed):
    r = random.Random(seed)
    keys = [int(r.paretovariate(0.4)) % 5000 for _ in range(20_000)]
    least = r.choice([20, 100, 400])
    summary, parts = phrases.Summary(len(keys) // least + 1), [keys[a : a + 700] for a in range(0, len(keys), 700)]
    for part in parts:
        summary.merge(*([x] for x in np.unique(np.array(part, np.uint64), return_counts=True)))
        assert len(summary.keys) <= summary.capacity
    true = collections.Counter(keys)
    assert summary.missing < least and {k for k, n in true.items() if n >= least} <= set(summary.reaching(least).tolist())
    assert all(n <= true[k] <= n + summary.missing for k, n in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_phrases_that_share_a_hash_are_told_apart():
    w = phrases.Words(pa.array(["a b c d a b"]), pa.array(["en"]))
    langs, found, n = w.counted(2, np.array([0, 2, 4]), np.array([7, 7, 7], np.uint64))
    assert dict(zip(found, n.tolist())) == {"a b": 2, "c d": 1} and langs == ["en", "en"]


# lattices

PIECES = {"▁": -2.0, "▁a": -1.5, "a": -2.5, "b": -3.0, "ab": -2.2, "▁ab": -1.9, "ba": -4.0, "bab": -3.3}


def brute_marginal(pieces, word, byte):
    word, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:z] for a, z in zip(edges, edges[1:])]
        if all(p in pieces or (len(p) == 1 and p not in pieces) for p in parts):
            total += math.exp(sum(pieces.get(p, byte * len(p.encode())) for p in parts))
    return math.log(total)


def test_marginals_sum_over_all_segmentations():
    model, words = lattice.Lattice(PIECES), ["", "a", "ab", "abab", "babab", "éa", "日", "😀b", "aaaa", "ba" * 4]
    assert np.allclose(model.marginals(words), [brute_marginal(PIECES, w, model.byte) for w in words], rtol=1e-12)
    long = "ab" * (lattice.LONG // 2 + 3)
    assert math.isclose(model.marginals([long, "a"])[0], model._block(["▁" + long])[0], rel_tol=1e-12)
    assert lattice.Lattice({}).marginals(["é"])[0] == -10.0 * 5


def brute_scores(rows, model, pieces):
    words = [[w.decode() for w in (t or "").encode().lower().split()] for _, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, *_ in rows]
    c, ends = collections.Counter(), held.count(False)
    for w, h in zip(words, held):
        if not h:
            c.update(w)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    new = (sum(x == 1 for x in c.values()) + 1) / (n + 1)
    base = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    spelled = dict(zip(every := sorted({w for ws in words for w in ws}), model.marginals(every)))

    def score(x, s):
        s += math.log(new)
        k = math.log((1 - new) * x / n) if x else -math.inf
        return (max(k, s) + math.log1p(math.exp(min(k, s) - max(k, s)))) / math.log(10)

    end = score(ends, -math.log(pieces + 1))
    return [(i, h, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(map(base, (c[x] for x in w))) + base(ends), sum(score(c[x], spelled[x]) for x in w) + end) for (i, *_), w, h in zip(rows, words, held)]


def close(found, wanted):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 3))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9), (a, b)


@pytest.mark.parametrize("hot", [0, 40, lattice.HOT])
def test_scores(spark, odd, hot):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(None if i == 5 else i, prose(r, i), "w") for i, r in enumerate([*range(40)] * 2)] + [(40, None, "w"), (40, "", "w"), (4, "été 日本 Word", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    close(lattice.score_texts(docs, path, hot=hot).collect(), brute_scores(rows, lattice.lattice_of(path), len(lattice.unigram_pieces(path))))


def test_score_query(spark, odd, empty):
    import public_tokenizers

    rows, path = odd
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice.op13_lattice_scores(spark, path)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    close(found.collect(), brute_scores(rows, lattice.lattice_of(model), len(lattice.unigram_pieces(model))))
    assert lattice.op13_lattice_scores(spark, empty).count() == 0


def test_nothing_to_learn_from(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(None, "some words")], "doc_id long, text string")
    row = lattice.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and -40 < row.score < -6
