"""The corpus operators against brute force on a small fixture with nulls, empty texts, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from veldspar.llm import ann, decontam, license_scan, line_dedup, packing, quality, sharding, simhash, substring, warc
from veldspar.llm.queries import word_tokenizer
from veldspar.storage import shared_dir

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "on", "É", "re", "A", "xi"]) for _ in range(rng.randint(1, 4)))
    said = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(40)]
    passage = " ".join(word() for _ in range(50))
    out = [None, "", " \t\n", "one", "Same same same " * 40, *said, *said[:6], *[s + " end" for s in said[6:12]]]
    out += [f"{said[i]} {passage} {said[i + 1]}" for i in range(5)]
    out += [said[3] + "\nReleased under the MIT License.\n\nx", "GNU General Public License; mit-license", "line a b c d e f g h\nline a b c d e f g h\nother", ("long " + said[2] + " ") * 200]
    return out


SCHEMA = "doc_id long, text string, id string, row long, key string, group int, words int, size int, shard int, hash int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7, "k", 1, 2, 3, 4, 5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_print(text):
    w = SPACE.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none):
    got = rows(simhash.near_duplicates(docs))
    want = {i: brute_print(t) for i, t in enumerate(texts())}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == want
    links = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    comp = components(want, links)
    assert {i: r.component_id for i, r in got.items()} == comp
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(comp.values()))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_tiles(spark, monkeypatch):
    """A hot bucket is cut into tiles and loses no link."""
    from veldspar.llm import _buckets

    monkeypatch.setattr(_buckets, "TILE", 4)
    monkeypatch.setattr(_buckets, "COUNTED", 1)
    prints = [(1 << i) | (1 << j) for i in range(14) for j in range(i)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.hamming_links(df, 2).collect()
    want = components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    assert components(prints, [(r.src, r.dst) for r in links]) == want


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_substring(docs, none, hash_bits):
    words = {i: SPACE.findall(t or "") for i, t in enumerate(texts())}
    count = collections.Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    got = rows(substring.remove_repeats(docs, texts=True, hash_bits=hash_bits))
    for i, w in words.items():
        hit = np.zeros(len(w), bool)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                hit[s : s + 35] = True
        kept = " ".join(x for x, h in zip(w, hit) if not h)
        assert (got[i].n_words, got[i].n_removed) == (len(w), hit.sum()), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert substring.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(0, " ".join(texts()[5].split()[:30])), (1, "one"), (2, None), (3, ""), (4, texts()[8]), (5, "same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 7) if w else 0):
            win[tuple(w[s : s + 8])].add(i)
    got = rows(decontam.contained_windows(docs, bench).withColumn("n_hit", decontam.hit_words(F.col("hits"))))
    for i, t in enumerate(texts()):
        w, hit, its = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for k, its_ in win.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    its |= its_
                    hit |= set(range(s, s + len(k)))
        assert (got[i].n_words, got[i].n_hit, {h.item for h in got[i].hits}) == (len(w), len(hit), its), i
    assert decontam.contained_windows(none, bench).count() == 0
    assert decontam.contained_windows(docs, bench.where("item_id < 0")).where("size(hits) > 0").count() == 0


def test_license(docs, none):
    got = rows(license_scan.scan(docs))
    base = {tuple(k.split()): v for k, v in license_scan.BASE.items()}
    for i, t in enumerate(texts()):
        w = ALNUM.findall((t or "").translate(LOWER))
        want = sorted((s, v) for k, v in base.items() for s in range(len(w) - len(k) + 1) if tuple(w[s : s + len(k)]) == k)
        assert got[i].n_words == len(w)
        assert sorted((s.first, s.label) for s in got[i].spans if s.base) == want
    assert license_scan.scan(none).count() == 0


def test_lines(docs, none):
    got = rows(line_dedup.dedup_lines(docs))
    sets, order = {}, []
    for i, t in enumerate(texts()):
        for x in (t or "").split("\n"):
            n = line_dedup.normal(x.encode())
            if n:
                order.append((i, n))
                sets[n] = line_dedup.shingle_set(n)
    names = sorted(sets)
    comp = components(range(len(names)), [(a, b) for a in range(len(names)) for b in range(a) if line_dedup.jaccard(sets[names[a]], sets[names[b]]) >= 0.8])
    at, seen, gone = {n: comp[k] for k, n in enumerate(names)}, set(), collections.Counter()
    for i, n in order:
        gone[i] += at[n] in seen
        seen.add(at[n])
    assert {i: r.n_removed for i, r in got.items()} == {i: gone[i] for i in got}
    assert got[0].text is None and got[1].text == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in enumerate(texts())}
    pieces = packing.pack(docs, word_tokenizer()).collect()
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s).bit_count() == 1
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_word_encoder():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(word_tokenizer()), packing.WordEncoder(word_tokenizer()), random.Random(3)
    letters = [*"abcXYZ019 .,'’!?\t\néÉİΣσ́ \x1c\x85中😀", "'s", "'re", "<|endoftext|>", "ß", "<|"]
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert e(s) == np.array(t.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_word_encoder_learns_plain_words_without_splitting(monkeypatch):
    e = packing.WordEncoder(word_tokenizer())
    want = [e._encode(s).tobytes() for s in ("Straße ÉTÉ word", "it's a x-y İo 3")]
    asked, split = [], e.split
    monkeypatch.setattr(e, "split", lambda w: asked.append(w) or split(w))
    assert [e("Straße ÉTÉ word"), e("it's a x-y İo 3")] == want
    assert sorted(asked) == sorted(["it's", "x-y", "İo".lower(), "3"])


def test_workers_forget_what_other_operators_learnt(monkeypatch):
    import pandas as pd
    from pyspark import cloudpickle

    from veldspar.llm import _buckets

    def task(module):
        def run(batches):
            yield from batches

        run.__module__ = module
        return lambda: list(cloudpickle.loads(cloudpickle.dumps(_buckets.released(run)))([]))  # as a worker gets it

    udfs = []
    monkeypatch.setattr(quality.F, "pandas_udf", lambda kind: lambda f: udfs.append(f) or (lambda *columns: None))
    monkeypatch.setattr(quality.F, "col", lambda name: name)
    quality.feature_column("text")
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    quality.score(type("Frame", (), {"withColumn": lambda *given: None})(), model)
    others = [task(line_dedup.__name__), *[lambda f=cloudpickle.loads(cloudpickle.dumps(f)): f(pd.Series(["a text"])) for f in udfs]]
    assert len(others) == 3
    for other in others:
        packing.encoder(word_tokenizer())
        task(packing.__name__)()
        assert packing._ENCODERS  # what one task of packing has learnt serves the next
        other()
        assert not packing._ENCODERS


def test_lines_of_no_bucket_are_not_fetched(spark, monkeypatch):
    rng = random.Random(5)
    h = [rng.getrandbits(64) for _ in range(4000)]
    some = spark.createDataFrame([(x - (x >> 63 << 64),) for x in h[:1000]], "h long")
    for bits in (line_dedup.FILTER_BITS, 1 << 10):  # all that are wanted pass, also where the bitmap may not grow
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        words, shift = line_dedup.hash_filter(some)
        passed = line_dedup.passing(words, shift, np.array(h, dtype=np.uint64)).tolist()
        assert set(range(1000)) <= set(passed) and 64 * len(words) <= bits
        assert bits == 1 << 10 or len(passed) < 1500
    words, shift = line_dedup.hash_filter(some.where("false"))
    assert not len(line_dedup.passing(words, shift, np.array(h, dtype=np.uint64)))


def test_sharding(docs, none):
    got = rows(sharding.shard(docs))
    counts = collections.Counter(r.shard for r in got.values())
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(counts[s]))
    by = collections.defaultdict(set)
    for i, t in enumerate(texts()):
        assert (got[i].size, got[i].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        if t:
            by[t].add(got[i].shard)
    assert all(len(s) == 1 for s in by.values())
    assert sharding.shard(none).count() == 0


def test_sharding_hot_group(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(240)], "doc_id long, text string")
    got = sharding.shard(df).toPandas()
    assert set(got["shard"].value_counts()) == {30}
    assert got[got.doc_id % 3 == 0]["shard"].nunique() <= 4


def test_warc(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "WARC/1.1\r\n\r\n\r\n", "é" * 9]
    pages = spark.createDataFrame([(i, f"http://x/{i} y\r\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-test"
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {0: ("revisit", 1), 1: ("response", None), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert all(r.intact for r in got.values())
    assert all(got[i].payload_bytes == len((h or "").encode()) for i, h in enumerate(html))
    assert got[5].payload == html[5] and got[4].payload == html[4]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[10:14] = x[9]
    bad = [(900, [0.0] * 16), (901, None), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *bad], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        hit += len(set(best.tolist()) & {i for i, _ in found})
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and all(abs(d[i] - s) < 1e-12 for i, s in found)
    assert hit >= 0.9 * 10 * len(got)
    few = df.where("vec_id in (0, 20, 21)")
    assert ann.search(few, few.where("vec_id % 20 = 0")).count() == 4


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "house", "river", "stone", "walks"]) for _ in range(60)) + "."
    junk = lambda: "!!! $$$ ".join(rng.choice(["BUY", "NOW", "WIN"]) for _ in range(60))
    data = [(i, junk() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame([*data, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    out = rows(quality.score(docs, quality.fit_quality(docs, labels)))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((out[i].score >= 0.3) == (i % 4 > 0) for i in held)
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 402
    assert quality.fit_quality(docs, labels.where("false")).scores(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
