"""Each operator against a brute-force version, on awkward rows and on none."""

import base64
import collections
import hashlib
import io
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import prose
from trackmill.llm import audio, components, decontam, mixing, repeats, resemblance, sharding, simhash, tokencount, tokenfiles, toxicity, warc
from trackmill.llm.common import shared_dir


def words(text):
    return (text or "").encode().split()


# archives


def test_archives_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "same"), (2, "http://b", "same")], "page_id long, url string, html string").withColumn("digest", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    found = warc.read_archives(warc.write_archives(pages, shared_dir(spark), roll_bytes=200)).collect()
    assert len(found) == 7 and all(r.digest_ok for r in found)
    by = collections.defaultdict(list)
    for r in found:
        by[r.page_id].append(r)
    assert by[1][0].record_type == "response" and by[1][0].payload == b"same" and "\n" not in by[1][0].url
    assert [r.refers_to for r in by[2]] == [1, 1] and by[2][0].payload is None and by[2][0].payload_bytes == 4
    assert by[None][0].refers_to == 1 and by[3][0].record_type == "response" and by[3][0].url is None and by[4][0].refers_to == 3
    assert by[5][0].payload_digest == base64.b32encode(hashlib.sha1(("é" * 70_000).encode()).digest()).decode()
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_dir(spark))).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, shared_dir(spark), revisit_from=3)).collect()} == {"response"}


def test_damaged_archives_are_noticed():
    member = warc._page_member(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert [b for _, b in warc.read_records(io.BytesIO(member * 3), 7)][2].endswith(b"payload")
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(member[:-9])))
    short = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(short.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + short.flush())))


# mixing


def test_mix(docs, rows, nothing):
    found = mixing.mix_documents(docs).collect()
    assert sorted((r.row.doc_id or 0, r.size) for r in found) == sorted((i or 0, len(words(t))) for i, t, *_ in rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        size[r.row.source] += r.size
        taken[r.row.source] += r.size * r.copies
        target[r.row.source] = r.target
        assert 0 <= r.copies <= 3 and r.source_size > 0
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_documents(docs.repartition(3)).collect()))
    assert mixing.mix_documents(nothing).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, prose(1 + i * 7 % 90, i), f"s{i % 4}") for i in range(1200)], "doc_id long, text string, source string")
    found = mixing.mix_documents(docs).collect()
    for s in range(4):
        own = [r for r in found if r.row.source == f"s{s}"]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < 180


# repeats


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            if i is not None:
                first[b[a : a + length]] = min(i, first.get(b[a : a + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if i is not None and first[b[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for r in bytes(gone).split(b"\0") if r), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 23, 900])
def test_repeats(docs, rows, nothing, chunk):
    found = repeats.remove_repeats(docs, chunk_bytes=chunk).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_repeats([r[:2] for r in rows], 50)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("part", [1, 300])
def test_repeats_in_parts_of_buckets(docs, rows, monkeypatch, part):
    whole = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "STRINGS", part)
    assert {r.doc_id: r for r in repeats.remove_repeats(docs, chunk_bytes=5000, buckets=4).collect()} == whole


def test_parts_are_bounded():
    r = np.random.default_rng(6)
    blobs, every = [], []
    for _ in range(5):
        size = r.integers(50, 85, 400)
        rest = r.integers(0, 1 << 32, 400, dtype=np.uint32)
        data = r.integers(0, 255, size.sum(), dtype=np.uint8)
        blobs.append(repeats._pack(data, size.astype(np.uint8), np.arange(400), np.arange(400, dtype=np.uint32), rest))
        every += [(bytes(d), int(k)) for d, k in zip(np.split(data, np.cumsum(size)[:-1]), rest)]
    found = []
    for parts in repeats._in_parts(blobs, 20_000):
        assert sum(a.nbytes for p in parts for a in p) < 40_000
        mine = [(bytes(d), int(k)) for p in parts for d, k in zip(np.split(p[0], np.cumsum(p[1].astype(int))[:-1]), p[4])]
        assert not {k for _, k in mine} & {k for _, k in found}
        found += mine
    assert sorted(found) == sorted(every)


def test_repeats_with_passages(spark):
    passage = prose(30, 77)
    rows = [(i, prose(i % 9, i) + passage[i % 40 :] + prose(i % 7, 1000 + i) + passage[: 40 + i % 30]) for i in range(60)]
    rows += [(i + 100, "ab" * (25 + i)) for i in range(6)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk_bytes=2000).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_repeats(rows, 50)


# audio


def test_wav_and_tensors(docs, rows, nothing, spark):
    folder = shared_dir(spark)
    found = audio.stored_features(audio.audio_features(audio.store_media(docs, folder)), folder).collect()
    assert len(found) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((t or "").encode())
    for r in found:
        data = texts[r.doc_id][0]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(audio.to_wav(payload)).hexdigest()
        block, start, end = audio.unpack_tensors(r.tensors)
        mel = audio.log_mel(audio.Resampler(audio.RATE, audio.TARGET)(np.frombuffer(payload, np.uint8)), audio.mel_filters())
        assert np.abs(block.reshape(-1, audio.MELS)[: len(mel)] - 100 * mel).max() <= 0.51 and (block.reshape(-1, audio.MELS)[len(mel) :] == -1000).all()
        assert r.tensor_digest == audio.tensor_digest(r.tensors) and r.tensor_digest.startswith(f"{len(block)}|{end[-1]:.2f}|")
        assert block.dtype == np.int16 and block.shape[1:] == (audio.PATCH, audio.MELS) and len(block) == -(-r.frames // audio.PATCH) and np.all(end > start)
    same = [tuple(r)[1:] for r in found if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert audio.audio_features(audio.store_media(nothing, shared_dir(spark))).count() == 0


@pytest.mark.parametrize("target", [8000, 12000, 16000, 44100])
def test_polyphase_is_the_filter_at_the_raised_rate(target):
    x = np.random.default_rng(1).normal(size=300)
    r = audio.Resampler(16000, target)
    raised = np.zeros(len(x) * r.up)
    raised[:: r.up] = x
    full = np.convolve(raised, r.taps)[r.half : r.half + len(raised)]
    assert np.allclose(r(x), full[:: r.down], atol=1e-9)


def test_log_mel_is_that_of_each_frame(monkeypatch):
    """Frame by frame with a plain Fourier sum, the last samples included; blocks change nothing."""
    r, filters = np.random.default_rng(3), audio.mel_filters()
    for n in (1, 150, 200, 201, 279, 280, 281, 1003):
        x = r.normal(size=n)
        got, frames = audio.log_mel(x, filters), 1
        while audio.FRAME + (frames - 1) * audio.HOP < n:
            frames += 1
        assert len(got) == frames
        whole = np.concatenate([x, np.zeros(2000)])
        wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FFT // 2 + 1), np.arange(audio.FRAME)) / audio.FFT)
        for k in range(frames):
            power = np.abs(wave @ (whole[k * audio.HOP : k * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME))) ** 2
            assert np.allclose(got[k], np.log10(np.maximum([sum(power * f) for f in filters.T], 1e-10)), atol=1e-6)
    samples = r.integers(0, 256, 5000).astype(np.uint8)
    for rates in ((16000, 8000), (16000, 6000), (8000, 16000)):
        resample = audio.Resampler(*rates)
        want = resample((samples - 128.0) / 128.0)
        monkeypatch.setattr(audio, "BLOCK", 600)
        assert np.allclose(resample(samples), want)
        monkeypatch.undo()


def test_hysteresis():
    assert audio.segments(np.array([0, 5, 3, 3, 0, 3, 5, 3.0]), 4, 1) == [(1, 4), (6, 8)]
    assert audio.segments(np.zeros(0), 1, 0) == []


# near-duplicates


def brute_classes(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in ("One two THREE four five\tÉ", "a b", "", None, "x y z"):
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in t) for t in words(text)]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int.from_bytes(simhash.simhash(text, 3), "little") == want


def test_classes(docs, rows, nothing):
    found = simhash.near_duplicate_classes(docs).collect()
    prints = {i: int.from_bytes(simhash.simhash(t, 3), "little") for i, t, *_ in rows if i is not None}
    want = brute_classes(prints, 2)
    assert len(found) == len(rows) and all(r.component_id == want[r.doc_id] for r in found if r.doc_id is not None)
    assert simhash.near_duplicate_classes(nothing).count() == 0


def test_links_of_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 6)
    prints = {i: int(base[i % 6]) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(12))) for i in range(500)}
    frame = spark.createDataFrame([(p.to_bytes(8, "little"),) for p in set(prints.values())], "print binary")
    links = simhash.link_prints(frame, simhash.make_plan(frame, 1, [2, 3, 4], 3, 2), 1, 2, shared_dir(spark))
    root = {bytes(x.node): bytes(x.root) for x in components.components(links, shared_dir(spark)).collect()}
    want = brute_classes(prints, 2)
    same = lambda f: {frozenset(v) for v in f.values()}
    got, exp = collections.defaultdict(set), collections.defaultdict(set)
    for i, p in prints.items():
        got[root.get(p.to_bytes(8, "little"), p)].add(i)
        exp[want[i]].add(i)
    assert same(got) == same(exp)


def test_near_duplicates_are_dropped(spark):
    base = [prose(200, k) for k in range(40)]
    near = [b.replace(b.split()[50], "changed", 1) for b in base[:20]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base + near + base[:5])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == list(range(40))


def test_near_duplicates_are_decided_on_their_shingles(spark, monkeypatch):
    """Sets of a planted resemblance on both sides of 0.8, a large group of copies, and a line that outweighs the rest."""
    for name, size in (("BLOCK", 20), ("LARGE", 4), ("KNOWN", 6)):
        monkeypatch.setattr(resemblance, name, size)

    def pair(k, n, replaced):  # one replaced word at the end of the text replaces one shingle, each further one too
        tokens = [f"w{k}x{i}" for i in range(n + 4)]
        return " ".join(tokens), " ".join(tokens[: n + 4 - replaced] + [f"z{k}x{i}" for i in range(replaced)])

    texts = []
    for k in range(60):
        texts += pair(k, 180, (20, 19, 21, 25, 18, 12)[k % 6])  # 0.8 exactly, above, below, ...
    line = "all of this line is said again and again "
    texts += [line * 30 + " ".join(f"a{k}b{i}" for i in range(200)) for k in range(6)]
    cluster = [f"c{i}" for i in range(104)]
    texts += [" ".join(cluster[:k] + [f"d{k}"] + cluster[k + 1 :]) for k in range(0, 90, 2)]
    texts += ["Only three words", "only  three WORDS", "", None]
    r = random.Random(4)  # close relatives that share far more groups than a set names
    for k in range(3):
        base = [f"e{k}x{i}" for i in range(150)]
        texts += [" ".join(w if r.random() > 0.02 else f"f{k}y{j}z{i}" for i, w in enumerate(base)) for j in range(25)]
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else set() for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}
    assert {2 * k + 1 for k in range(60) if k % 6 in (2, 3)} <= kept and not {2 * k + 1 for k in range(60) if k % 6 not in (2, 3)} & kept


def test_frequencies_are_of_all_texts(spark, monkeypatch, tmp_path):
    """A shingle's level follows from all different texts, however many ranges its hashes are counted in."""
    monkeypatch.setattr(resemblance, "SAMPLE", 2000, raising=False)  # characters that it was once taken from
    texts = [prose(40, k) + " " + prose(12, 1000 + k % 30) for k in range(300)] + [prose(30, 1)] * 40 + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    n = collections.Counter(s for t in set(filter(None, texts)) for s in {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)})
    for k, size in enumerate((1 << 22, 20)):
        monkeypatch.setattr(resemblance, "RANGE", size, raising=False)
        h, levels = resemblance.frequent(docs, "text", 5, str(tmp_path / str(k)))
        assert (h[1:] > h[:-1]).all()
        assert sorted(levels.tolist()) == sorted(c.bit_length() for c in n.values() if c > 1)


def test_links_of_relatives_grow_with_the_sets(spark, tmp_path):
    """Many close relatives that the fingerprints haven't tied: links connect them, and aren't their pairs."""
    base, size = [f"c{i}" for i in range(204)], 90
    texts = [" ".join([*base[: 2 * k], f"d{k}", *base[2 * k + 1 :]]) for k in range(size)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, mark long, text string")
    share, folder = Fraction(4, 5), str(tmp_path)
    rows = resemblance.sketches(docs, 5, share, resemblance.frequent(docs, "text", 5, folder), 2)
    entries = resemblance.shared_only(rows.selectExpr("explode(prefix) AS key", "node", "n", "last"))
    alone = spark.createDataFrame([], "node long, root long")
    found = resemblance.prefix_links(entries, alone, docs, rows.select("node", "mark"), 5, share, f"{folder}/rest").collect()
    assert size - 1 <= len(found) < 4 * size
    assert {r.root for r in components.components(spark.createDataFrame(found, "a long, b long"), f"{folder}/ties").collect()} == {min(r.node for r in rows.collect())}


@pytest.mark.parametrize("known", [0, 1000])
def test_sets_with_a_key_in_common_meet(spark, monkeypatch, tmp_path, known):
    """Any two sets of different roots that share a key meet in a pair of blocks, whether by key or as tied groups."""
    monkeypatch.setattr(resemblance, "BLOCK", 3)
    monkeypatch.setattr(resemblance, "KNOWN", known, raising=False)
    r = random.Random(6)
    ring = {(key, node % 80) for key in range(20) for node in range(100 + 4 * key, 106 + 4 * key)}  # keys in a chain: one tied group
    copies = {(key, node) for key in range(30, 60) for node in range(200, 212)}  # the same sets under many keys
    root = {node: node - node % r.choice((1, 2, 3)) for node in range(300)}
    rows = [(1000 + key, node, root[node]) for key, node in sorted(ring | copies)]
    groups = resemblance.large_groups(spark.createDataFrame(rows, "key long, node long, root long"), str(tmp_path)).collect()
    met = collections.defaultdict(list)
    for g in groups:
        met[g.group, g.pair].append(g)
    low = (1 << 31) - 1
    seen = {(x.node, y.node) for (_, p), v in met.items() for x in v for y in v if x.node < y.node and x.root != y.root and {x.mine, y.mine} == {p >> 31, p & low}}
    want = {(a, b) for k, a in ring | copies for m, b in ring | copies if k == m and a < b and root[a] != root[b]}
    assert want <= seen
    assert max(map(len, met.values())) <= 20
    by_key = any(1000 <= g.group < 1020 for g in groups) and len({g.group for g in groups}) > 2
    assert by_key == (known == 0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 40), (60, 60)] + [(100, k) for k in range(101, 160)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 40 for i in (40, 41, 50)}, **{i: 100 for i in range(100, 160)}}


# token counts


def test_unigram_counts(docs, rows, nothing):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "ba": -2.2, "aba": -6.0, "▁word": -1.0}
    unknown = min(pieces.values()) - 10

    def brute(word):
        text, best = f"▁{word}", None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(text)]
            score = count = 0
            for a, b in zip(at, at[1:]):
                p = text[a:b]
                if p in pieces:
                    score, count = score + pieces[p], count + 1
                elif b - a == 1:
                    score, count = score + unknown * len(p.encode()), count + len(p.encode())
                else:
                    break
            else:
                if best is None or (score, -count) > (best[0], -best[1]):
                    best = (score, count)
        return best[1]

    counter = tokencount.UnigramCounter(pieces)
    tried = ["".join(p) for n in range(1, 6) for p in itertools.product("abé", repeat=n)]
    assert counter.counts(tried) == [brute(w) for w in tried]
    sharing = tokencount.UnigramCounter(pieces)
    assert sharing.counts(sorted(tried)[:50]) + sharing.counts(sorted(tried)[50:]) == [brute(w) for w in sorted(tried)]
    assert sharing.nodes == len({("▁" + w)[:k] for w in tried for k in range(1, len(w) + 2)}) < counter.nodes  # each prefix once
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    alone = tokencount.UnigramCounter(tokencount.unigram_pieces(path))
    want = sorted(((i or 0), len(words(t)), sum(alone.counts([w.decode() for w in words(t)]))) for i, t, *_ in rows)
    for hot in (0, 30, tokencount.HOT):
        assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs, path, hot=hot).collect()) == want
    assert tokencount.count_tokens(nothing, path).count() == 0


# shards


def test_shards(docs, rows, nothing):
    found = sharding.assign_shards(docs, 5).collect()
    assert sorted((r.row.doc_id or 0, r["size"], r.text_crc32) for r in found) == sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    n = collections.Counter(r.shard for r in found)
    assert max(n[k] for k in range(5)) - min(n[k] for k in range(5)) <= 1
    assert sharding.assign_shards(nothing, 5).count() == 0


def test_overflow_goes_clockwise(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(2000)], "doc_id long, text string")
    arcs = [(r.low, r.high, r.shard) for r in sharding.ring_arcs(spark, 6, 8).orderBy("arc").collect()]
    key = lambda i: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(str(i).encode(), 42))
    held = collections.defaultdict(list)
    for i in range(2000):
        held[next(a for a, (low, high, _) in enumerate(arcs) if (low is None or key(i) > low) and key(i) <= high)].append(key(i))
    room = {s: 2000 // 6 + (s < 2000 % 6) for s in range(6)}
    want = collections.Counter()
    over = []
    for a, (_, _, s) in enumerate(arcs):
        n = min(len(held[a]), room[s])
        room[s] -= n
        want[a, s] += n
        over.append(len(held[a]) - n)
    for a, n in enumerate(over):
        for s in dict.fromkeys(x[2] for x in arcs[a:] + arcs[:a]):
            k = min(n, room[s])
            room[s] -= k
            n -= k
            want[a, s] += k
    got = collections.Counter()
    for r in sharding.assign_shards(docs, 6, virtual=8).collect():
        got[next(a for a, v in held.items() if key(r.row.doc_id) in v), r.shard] += 1
    assert got == +want


def test_one_more_shard_moves_little(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(5000)], "doc_id long, text string")
    a, b = ({r.row.doc_id: r.shard for r in sharding.assign_shards(docs, n, carry=["doc_id"]).collect()} for n in (24, 25))
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


# token files


def test_token_files(docs, rows, nothing, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = sorted(tokenfiles.read_tokens(tokenfiles.write_tokens(docs, shared_dir(spark), path, roll_bytes=3000)).collect(), key=lambda r: r.start)
    real = Tokenizer.from_file(path)
    ids = lambda t: [*real.encode(t or "", add_special_tokens=False).ids, 0]
    assert [r.doc_id or 0 for r in found] == sorted(i or 0 for i, *_ in rows)
    start = 0
    for r in found:
        texts = [t for i, t, *_ in rows if i == r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids(texts[0]) and r.start == start and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(nothing, shared_dir(spark), path)).count() == 0


def test_one_document_is_read_alone_and_damage_is_noticed(tmp_path):
    docs = [(i, np.arange(i * 50, dtype="<u4").tobytes()) for i in range(40)] + [(None, b"\1\0\0\0")]
    with (tmp_path / "x").open("wb") as out:
        tokenfiles.write_token_file(out, docs, frame_bytes=4000)

    class Opened:
        def __init__(self, data):
            self.data, self.seek, self.read, self.size = io.BytesIO(data), None, None, lambda: len(data)
            self.seek, self.read = self.data.seek, self.data.read

    raw = (tmp_path / "x").read_bytes()
    file = tokenfiles.TokenFile(Opened(raw))
    assert len(file.frames) > 5 and file.read(33).tolist() == list(range(33 * 50)) and list(file.documents())[-1][::2] == (None, b"\1\0\0\0")
    at = int(file.starts[2]) + 10
    with pytest.raises(Exception):
        tokenfiles.TokenFile(Opened(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])).frame(2)


def test_piece_encoder_is_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    real, own = Tokenizer.from_file(path), tokenfiles.PieceEncoder(path)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "don't do  it", "x  y z", "\0a b \0a", "é ñ 漢字 1,000 $%", "a b <|endoftext|> c d<|endoftext|>"]
    r, signs = random.Random(5), ["a", "b", " ", "  ", "\n", "\t", "\xa0", "\u3000", "é", "à", "\u2009", "日", "の", "'s", "1", "22", "!", "\x1c", "…", "\x85", "\u200b"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    for part in (texts, texts, [None, "", None], []):  # the second time from memory
        ids, offsets = own.encode(pa.array(part, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:])] == [real.encode(t or "", add_special_tokens=False).ids for t in part]


# toxicity


def test_toxicity(spark, docs, nothing):
    bad = ["vile", "nasty", "rotten"]
    rows = [(i, prose(40, i) + (f" {bad[i % 3]} " * (1 + i % 2) + prose(20, i + 900) if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.where("doc_id < 600").selectExpr("doc_id", "1 as quality", "toxic")
    chain = toxicity.train_chain(table.drop("toxic"), labels)
    found = {r.doc_id: r.p_toxic > 0.5 for r in toxicity.score_documents(table, chain).collect()}
    held = [i for i, *_ in rows if i >= 600]
    assert sum(found[i] == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert toxicity.score_documents(docs, chain).count() == docs.count() and toxicity.score_documents(nothing, chain).count() == 0
    blank = toxicity.train_chain(nothing, labels.limit(0))
    assert {r.p_toxic for r in toxicity.score_documents(docs, blank).collect()} == {0.5}


def test_chain_learns_from_out_of_fold_predictions():
    r = np.random.default_rng(1)
    x = (r.random((800, 30)) < 0.3).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0] * x[:, 1]], 1)
    p = toxicity.chain_scores(x, toxicity.fit_chain(x, y, np.arange(800) % 4))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


# decontamination


def test_masks_hit_with_two_replaced():
    for out in itertools.combinations(range(12), 2):
        assert any(all(c == "0" or a + k not in out for k, c in enumerate(m)) for m in decontam.MASKS for a in range(12 - len(m) + 1))


def test_contamination(spark, docs, nothing):
    items = [(1, prose(20, 50)), (2, prose(14, 51)), (3, None), (4, "too short"), (5, prose(7, 52)), (6, "")]
    swapped = prose(20, 50).split()
    swapped[4], swapped[11] = "other", "thing"
    far = prose(20, 50).split()
    far[1::3] = ["zz"] * len(far[1::3])
    rows = [(10, "Xx, " + prose(20, 50).upper() + "!"), (11, " ".join(swapped)), (12, " ".join(far)), (13, prose(300, 53) + " " + prose(14, 51)), (14, prose(7, 52)), (15, " ".join(prose(7, 52).split()[:6])), (16, " ".join(prose(20, 50).split()[3:16])), (17, None), (18, prose(90, 60)), (19, prose(10, 1) + " too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.tokens, r.matches) for r in decontam.contaminated(texts, bench).collect()}
    whole = {(10, 1): (20, 20), (11, 1): (20, 18), (13, 2): (14, 14), (14, 5): (7, 7), (16, 1): (13, 13)}
    assert found == whole | {(19, 4): (2, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(texts, bench, shortest=5).collect()} == set(whole)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(texts, bench).collect()) == [12, 15, 17, 18, 19]
    assert decontam.contaminated(docs, bench).count() == 0 and decontam.contaminated(nothing, bench).count() == 0
    assert decontam.contaminated(texts, bench.limit(0)).count() == 0


def brute_overlap(text, item):
    """The longest overlap by trying all stretches of all diagonals: (tokens, matches), with the most matches."""
    best, n = None, len(item)
    for shift in range(-n + 1, len(text)):
        a, b = max(shift, 0), min(shift + n, len(text))
        same = [text[k] == item[k - shift] for k in range(a, b)]
        if n < 12:
            some = b - a == n and sum(same) >= n - (n // 5 if n > 5 else 0)
            stretches = [(0, n)] if some else []
        else:
            stretches = [(x, y) for x in range(len(same)) for y in range(x + 12, len(same) + 1) if same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x)]
        for x, y in stretches:
            best = max(best or (0, 0), (y - x, sum(same[x:y])))
    return best


def test_contamination_against_all_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontam, "STEP", 300)
    r = random.Random(8)
    few = ["on", "and", "off"]
    items = [[r.choice(few if k % 3 == 0 else list("abcdefghijklmnopqrstuvwxyz")) for _ in range(r.choice((1, 3, 4, 5, 6, 9, 11, 12, 15, 30)))] for k in range(40)]
    texts = []
    for k in range(60):
        t = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(0, 30))]
        for i in r.sample(items, 2):
            t += [w if r.random() > 0.12 else "new" for w in i] + [r.choice("xyz") for _ in range(3)]
        texts.append(t)
    texts += [["on"] * 50, ["on", "and"] * 20, []]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " - ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in decontam.contaminated(docs, bench).collect()}
    want = {(d, i): b for d, t in enumerate(texts) for i, item in enumerate(items) if (b := brute_overlap(t, item))}
    assert {k: (x.tokens, x.matches) for k, x in found.items()} == want and len(want) > 50


def fewest_replaced(masks, most):
    """For each size the fewest replaced tokens of a stretch, with matches at both ends, that leave no mask whole."""
    whole = [(len(m), [k for k, c in enumerate(m) if c == "1"]) for m in masks]
    wide, now, out = max(map(len, masks)) - 1, {"1": 0}, {1: 0}
    for size in range(2, most + 1):
        later = {}
        for last, n in now.items():
            for c in "01":
                t = last + c
                if c == "0" or not any(len(t) >= m and all(t[len(t) - m + k] == "1" for k in at) for m, at in whole):
                    key = t[-wide:]
                    later[key] = min(later.get(key, most), n + (c == "0"))
        now = later
        out[size] = min(n for t, n in now.items() if t[-1] == "1")
    return out


def test_no_overlap_is_without_a_seed():
    """Over all stretches, not over samples: with at most a fifth of the tokens replaced some mask is whole."""
    fewest = fewest_replaced(decontam.MASKS, 600)
    assert all(fewest[n] > decontam.REPLACED * n for n in range(decontam.LEAST, 601))
    assert fewest[30] == fewest_replaced(decontam.MASKS, 30)[30] > 6
    loose = fewest_replaced(("11111",), 60)
    assert any(loose[n] <= decontam.REPLACED * n for n in range(12, 61))  # one mask alone wouldn't do


def test_planted_overlaps_are_all_found(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    items = [[word() for _ in range(60)] for _ in range(20)]
    docs = []
    for k in range(400):
        n, item = r.randint(13, 60), r.choice(items)
        a = r.randint(0, 60 - n)
        piece = item[a : a + n]
        for at in r.sample(range(1, n - 1), n // 5):
            piece[at] = word()
        docs.append((k, " ".join([word() for _ in range(r.randint(0, 40))] + piece + [word() for _ in range(r.randint(0, 40))])))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).select("doc_id").distinct().count()
    assert found == len(docs)


def test_one_word_said_again_and_again(spark):
    import time

    bench = spark.createDataFrame([(1, "word " * 2000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 3000 + "end")], "doc_id long, text string")
    start = time.perf_counter()
    assert {(r.doc_id, r.tokens, r.matches) for r in decontam.contaminated(docs, bench).collect()} == {(1, 2000, 2000), (2, 2000, 2000)}
    assert time.perf_counter() - start < 60


def test_collection_transform_is_that_of_sorted_suffixes():
    from trackmill.llm.repeats import collection_bwt, least_of_equals

    r = np.random.default_rng(3)
    for _ in range(60):
        size = r.integers(3, 12, r.integers(1, 25))
        data = r.integers(97, 97 + r.integers(1, 4), size.sum()).astype(np.uint8)
        ends, text = np.cumsum(size), data.tobytes()
        suffixes = sorted(((text[p:e] + b"\0", k, p, text[p - 1] if p > e - n else 0xFF) for k, (e, n) in enumerate(zip(ends.tolist(), size.tolist())) for p in range(e - n, e + 1)), key=lambda s: s[:2])
        common = [0] + [min(5, next((k for k, (x, y) in enumerate(zip(a[0][:-1], b[0][:-1])) if x != y), min(len(a[0]), len(b[0])) - 1)) for a, b in zip(suffixes, suffixes[1:])]
        place, bwt, lcp = collection_bwt(data, size, 5)
        assert (place.tolist(), bwt.tolist(), lcp.tolist()) == ([s[2] for s in suffixes], [s[3] for s in suffixes], common)
        low = r.integers(0, 9, len(size))
        strings = [(text[p : p + 3], k) for k, (e, n) in enumerate(zip(ends.tolist(), size.tolist())) for p in range(e - n, e - 2)]
        least = {w: min(low[k] for v, k in strings if v == w) for w, _ in strings}
        assert least_of_equals(data, size, low, 3).tolist() == [least[w] for w, _ in strings]
