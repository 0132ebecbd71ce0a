"""Each contract's query on whole tables of odd rows, column by column, against plain loops."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from tests.llm.conftest import prose
from tests.llm.test_llm import brute_repeats
from trackmill.llm import audio, mixing, repeats, sharding, simhash, tokencount, tokenfiles, warc

KIND = "doc_id long, text string, source string, size long, shard int, slot string, `row` string, print string, mark string, n_bytes string, id int, node long, word string, seen int"


@pytest.fixture(scope="module")
def rows():
    """Null, empty, repeated and near texts, several scripts, white space of all kinds, and about 1 MB with and without spaces."""
    base = prose(80, 1)
    texts = [base, base, base + " more", base.replace("a", "b"), None, "", "   ", "a\x0bb\x0cc\td e f", "été 日本語 😀 " * 30, "ÀÉ WORD Word word", prose(200_000, 2)[:1_000_000], "xyé" * 300_000, prose(30, 3) + base + prose(30, 4), prose(3, 5), prose(3, 5), "one", "<|endoftext|> a <|endoftext|>", "line\r\nline\n\nline"]
    ids = [3, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 14, 15, 16, 1_000_000_007]
    sources = [None, "b", "a", "é", "B"]
    out = [(i, t, sources[k % 5], None if k % 3 else k, k, "s", None, "p", "m", "n", k, k, "w", k) for k, (i, t) in enumerate(zip(ids, texts))]
    return out + [out[3]]


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    """(with rows, without)."""
    found = []
    for name, some in (("odd", rows), ("none", [])):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(some, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
        found.append(path)
    return found


def utf8(text):
    return (text or "").encode()


def got(query, spark, folders, columns):
    """The query's rows; it has these columns, and no row without documents."""
    found = query(spark, folders[0])
    assert found.columns[: len(columns)] == columns
    assert query(spark, folders[1]).count() == 0
    return sorted((tuple(r)[: len(columns)] for r in found.collect()), key=str)


def test_op1(spark, tmp_path):
    pages = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (4, "u\r\nx", ""), (7, "u", "é" * 700_000), (8, "u", "x" * 1_000_000), (3, "v", "same"), (6, "v", "é" * 700_000)]
    spark.createDataFrame([(*p, k, "r") for k, p in enumerate(pages)], "page_id long, url string, html string, digest int, record_type string").repartition(3).write.parquet(f"{tmp_path}/a/pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(utf8(html), i)
    want = [(i, len(utf8(h)), base64.b32encode(hashlib.sha1(utf8(h)).digest()).decode(), "response" if first[utf8(h)] == i else "revisit", None if first[utf8(h)] == i else first[utf8(h)]) for i, _, h in pages]
    assert got(warc.op1_warc, spark, [f"{tmp_path}/a", f"{tmp_path}/b"], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == sorted(want, key=str)


def test_op2(spark, rows, folders):
    found = got(mixing.op2_mixing, spark, folders, ["doc_id", "size", "source_size", "target", "taken"])
    assert found == got(mixing.op2_mixing, spark, folders, ["doc_id", "size", "source_size", "target", "taken"])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = collections.Counter()
    for _, t, s, *_ in rows:
        own[s] += size(t)
    order = sorted(own, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight, target, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(order)
    while True:
        left, w = sum(own.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * own[s]]
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        free -= set(over)
    target |= {s: left * weight[s] / w for s in free}
    want = collections.Counter((i, size(t), own[s], round(target[s], 6)) for i, t, s, *_ in rows)
    assert collections.Counter((i, n, o, round(t, 6)) for i, n, o, t, _ in found) == want
    assert all(taken % max(n, 1) == 0 and taken <= 3 * n for _, n, _, _, taken in found)


def test_op3(spark, rows, folders):
    found = got(repeats.op3_repeats, spark, folders, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert found == brute_repeats([r[:2] for r in rows], 50)


def test_op4(spark, rows, folders):
    found = got(audio.op4_audio, spark, folders, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    want = []
    for i, t, *_ in rows:
        data = utf8(t)
        payload = data.ljust(192 * max(1, -(-len(data) // 192)))
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(audio.to_wav(payload)), hashlib.sha256(audio.to_wav(payload)).hexdigest()))
    assert [f[:7] for f in found] == sorted(want, key=str)
    features = collections.defaultdict(set)
    for f in found:
        features[f[3]].add(f[7])
    assert all(len(v) == 1 for v in features.values()) and len({min(v) for v in features.values()}) > 8


def test_op5(spark, rows, folders):
    prints = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted([(i, f"{prints[i]:016x}", root[i]) for i, *_ in rows], key=str)
    assert got(simhash.op5_simhash, spark, folders, ["doc_id", "fingerprint", "component_id"]) == want
    assert len(set(root.values())) < len(root)


def test_op6(spark, rows, folders):
    import public_tokenizers

    counter = tokencount.UnigramCounter(tokencount.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    known = {w: counter.counts([w.decode()])[0] for w in {w for r in rows for w in utf8(r[1]).split()}}
    want = sorted([(i, len(utf8(t).split()), sum(known[w] for w in utf8(t).split())) for i, t, *_ in rows], key=str)
    assert got(tokencount.op6_token_counts, spark, folders, ["doc_id", "n_words", "n_tokens"]) == want


def test_op7(spark, rows, folders):
    found = got(sharding.op7_sharding, spark, folders, ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert sorted(f[:4] for f in found) == sorted((i, len(utf8(t)) + 8, zlib.crc32(utf8(t)), "rows") for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for f in found:
        slots[f[4]].append(f[5])
        assert 0 <= f[4] < 24 and f[6] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(24)) <= 1


def test_op8(spark, rows, folders):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))))
        at += len(ids)
    assert got(tokenfiles.op8_token_files, spark, folders, ["doc_id", "start", "n_tokens", "ids_crc32"]) == sorted(want, key=str)


def test_fewer_rows_move_than_a_twelfth(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(r.randrange(1 << 40), "t") for _ in range(20_000)], "doc_id long, text string")
    place = lambda n: {x.row.doc_id: x.shard for x in sharding.assign_shards(docs, n).collect()}
    a, b = place(24), place(25)
    assert sum(a[k] != b[k] for k in a) < 0.08 * len(a)
