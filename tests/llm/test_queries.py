"""The registered corpus queries on whole small tables: against DuckDB where SQL can say it, else brute force."""

import collections
import glob
import gzip
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veldspar.llm import license_scan, packing, queries

SPACE, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "LO", "mi", "é", "sun"]) for _ in range(rng.randint(1, 3)))
    said = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \t", "one", "Same same " * 90, *said, *said[:4], *[s.replace("ka", "ke", 1) for s in said[4:9]]]
    out += [f"{said[i]} {passage} {said[i + 1]}" for i in range(4)]
    notices = ["x cc by cc by 4 0 y", "general public x", "a public license", "Licensed under the CC BY SA 4.0", "see the MIT License; and the mit-license", "GNU Lesser General Public License", "licensed under the bsd 3 new clause license", "redistribution and use in source and binary forms with or without any modification are permitted"]
    return out + notices + [f"{said[0]} {t} {said[1]}" for t in notices]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, said = tmp_path_factory.mktemp("tables"), texts()
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(said)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    items = [(0, " ".join(said[6].split()[:30])), (1, "one"), (2, None), (3, ""), (4, said[8]), (5, "same same"), (6, "same SAME same same same same same same")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    html = [None, "", "<p>a</p>", "<p>a</p>", "WARC/1.1\r\n\r\n\r\n", "é" * 9, "<p>a</p>"]
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, int(bool(t) and len(t) > 40), 0) for i, t in enumerate(said)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(3).standard_normal((450, 8))
    x[20:320] = x[19]  # a vector that most rows have
    vectors = [*((i, v.tolist(), 0) for i, v in enumerate(x)), (900, None, 0), (1000, [0.0] * 8, 0), (1100, [float("inf")] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), said, x


def run(spark, folder, name):
    return queries.queries()[name](spark, folder[0])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("where", ["small", "/root/testdata/sf0.01"])
def test_matches_sql(spark, folder, name, where):
    at, con = folder[0] if where == "small" else where, duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{'/*.parquet' if where == 'small' else ''}'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = queries.queries()[name](spark, at)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def fingerprint(text):
    w = SPACE.findall((text or "").translate(LOWER))
    hs = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op1(spark, folder):
    prints = [fingerprint(t) for t in folder[1]]
    least = list(range(len(prints)))
    for _ in prints:
        least = [min(least[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(prints))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, folder, "op1_simhash").collect()}
    assert got == {i: (f"{p:016x}", least[i]) for i, p in enumerate(prints)}


def test_op2(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op2_quality").collect()}
    assert len(got) == len(folder[1])
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def brute_spans(text, cover=license_scan.COVER, drift=license_scan.DRIFT, k=license_scan.K):
    """Base places, and for each template whether pairs of its words, each counted once, stand near one diagonal."""
    w = ALNUM.findall((text or "").translate(LOWER))
    base = sorted((s, label) for p, label in license_scan.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
    labels, scores = {label for _, label in base}, [1.0] * bool(base)
    for p, label in license_scan.TEMPLATES:
        t = p.split()
        pairs = len(t) - k + 1
        found = collections.defaultdict(set)
        for s in range(len(w) - k + 1):
            for at in range(pairs):
                if w[s : s + k] == t[at : at + k]:
                    found[s - at].add(at)
        best = 0.0
        for d in found:
            near = [e for e in found if d <= e <= d + drift]
            ats = set().union(*(found[e] for e in near))
            first, last = min(e + min(found[e]) for e in near), max(e + max(found[e]) + k - 1 for e in near)
            share = len(ats) / pairs
            if len(found[d]) == pairs:
                best = 1.0
            elif share >= cover and last - first + 1 <= len(t) + drift:
                best = max(best, share)
        if best:
            labels.add(label)
            scores.append(best)
    return len(w), base, labels, max(scores, default=0.0)


def test_op3(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op3_license").collect()}
    for i, t in enumerate(folder[1]):
        n, base, labels, score = brute_spans(t)
        r, starts = got[i], [s for s, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r.labels.split(","))) <= labels and r.base_labels in r.labels and r.score <= score
        if not any(x in (t or "") for x in ("by sa", "BY SA")):  # where one notice holds another, the whole one stands
            assert (r.labels, r.score) == (",".join(sorted(labels)), pytest.approx(score)), t


def test_op3_rows_stay_apart(spark):
    said = [(4, "general public x"), (4, "a public license"), (None, "the MIT License"), (None, "x"), (1, "x cc by cc by 4 0 y")]
    got = license_scan.scan(spark.createDataFrame(said, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, [s.label for s in r.spans]) for r in got) == [("1", 8, []), ("4", 3, []), ("4", 3, []), ("None", 1, []), ("None", 3, ["mit"])]


def test_op4(spark, folder):
    x, got = folder[2], collections.defaultdict(list)
    for r in run(spark, folder, "op4_nearest").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in found)
        if q in (100, 200, 300):  # copies of one vector: all at distance 0, the smallest ids first
            assert [v for _, v, _ in found] == list(range(19, 29))
    assert hit >= 45


def test_op6(spark, folder):
    got = {r.doc_id: r for r in run(spark, folder, "op6_line_dedup").collect()}
    assert len(got) == len(folder[1]) and got[0].text is None and all(r.n_lines - r.n_removed >= 0 for r in got.values())


def test_op8(spark, folder):
    got = run(spark, folder, "op8_sharding").collect()
    sizes = collections.Counter(r.shard for r in got)
    assert {r.doc_id for r in got} == set(range(len(folder[1]))) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        raw = (folder[1][r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_op10(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in enumerate(folder[1])}
    got = run(spark, folder, "op10_packing").collect()
    for r in got:
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()))
    for i, x in ids.items():
        at = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(n for _, n in at) == len(x) and [s for s, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]


def test_packing_balances_cost():
    """Documents descend, and full sequences of documents far shorter than they cost much the same. (A sequence that
    one long document fills costs most, whatever is done.)"""
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(4.5, 1, 4000).astype(int) + 1, 500).tolist()
    pieces = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    cost, tokens = collections.Counter(), collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
        tokens[s] += n
    full = np.array([cost[s] for s in tokens if tokens[s] == 2048])
    first_fit, room, at = collections.Counter(), 2048, 0
    for n in lengths:
        while n:
            part = min(n, room)
            first_fit[at] += part + part * part / 2048
            n, room = n - part, room - part
            if not room:
                room, at = 2048, at + 1
    plain = np.array([first_fit[s] for s in range(at)])
    assert full.std() < 0.7 * plain.std()
    whole = [n for _, start, n, _, _ in pieces if start == 0 and n in lengths]
    assert whole[:1000] == sorted(whole[:1000], reverse=True)


def test_other_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, said = Tokenizer.from_file(path), "Hello World, it's 2024!"
    assert packing.encoder(path)(said) == np.array(t.encode(said, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_odd_rows(spark, folder):
    """Repeated ids, null ids and empty tables."""
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "")], "doc_id long, text string")
    none = odd.where("doc_id > 9")
    from veldspar.llm import ann, decontam, line_dedup, quality, sharding, simhash, substring, warc

    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    model = quality.fit_quality(odd, labels)
    each = {
        "simhash": simhash.near_duplicates,
        "quality": lambda d: quality.score(d, model),
        "lines": line_dedup.dedup_lines,
        "windows": lambda d: decontam.contained_windows(d, bench),
        "shards": sharding.shard,
        "repeats": substring.remove_repeats,
        "licenses": license_scan.scan,
    }
    for name, op in each.items():
        assert op(odd).count() == 5 and op(none).count() == 0, name
    found = decontam.contained_windows(odd, bench).collect()
    assert sorted(len(r.hits) for r in found) == [0, 0, 1, 1, 1] and sorted(str(r.doc_id) for r in found if r.hits) == ["1", "1", "None"]
    assert len({(r.shard, r.slot) for r in sharding.shard(odd).collect()}) == 5
    assert packing.pack(odd, queries.word_tokenizer()).agg({"length": "sum"}).first()[0] == 5 + 3 * 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(vectors, vectors.where("vec_id = 2")).collect()] == [(2, 1, 1.0)]
    assert ann.search(vectors.where("vec_id > 9"), vectors).count() == 0 and ann.search(vectors, vectors.where("vec_id > 9")).count() == 0
    path = f"{folder[0]}/odd-warc"
    warc.write_archives(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "v", "x"), (0, "w", "x")], "page_id long, url string, html string"), path)
    back = warc.read_archives(spark, path).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.refers_url) for r in back) == [("0", "revisit", 1, "u"), ("1", "response", None, None), ("1", "response", None, None), ("None", "response", None, None)]


def test_damaged_archive(spark, folder):
    from veldspar.llm import warc

    path = f"{folder[0]}/bad-warc"
    warc.write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    name = next(n for n in glob.glob(f"{path}/*.gz") if gzip.open(n).read())
    raw = gzip.open(name).read()
    other = f"{folder[0]}/bad-copy"
    os.makedirs(other)
    with gzip.open(f"{other}/a.gz", "wb") as out:
        out.write(raw.replace(b"text\r\n\r\n", b"texT\r\n\r\n"))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(spark, other).collect()
    assert not warc.read_archives(spark, other, strict=False).first().intact


def test_long_text_costs_in_proportion(spark, tmp_path):
    """A text's words don't ride along with each of its shingles."""
    from veldspar.llm import decontam

    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 50)}" for _ in range(200_000)) + " " + " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    row = decontam.contained_windows(spark.read.parquet(f"{tmp_path}/d"), bench).first()
    assert row.n_words == 200_020 and {h.start for h in row.hits} >= set(range(200_000, 200_013))
    split = decontam.numbered(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text")
    plan = split.select("row", "n_words", F.posexplode(decontam.shingles(split.words, 3)))._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate " in line)
    assert not re.search(r"\bwords#", generate.rpartition(", [")[2]) and "n_words#" in generate


def test_big_benchmark_path(spark, folder, monkeypatch):
    """Beyond what may be broadcast the joins are shuffled, with the same rows."""
    from veldspar.llm import decontam

    want = sorted(map(str, run(spark, folder, "op7_decontamination").collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert sorted(map(str, run(spark, folder, "op7_decontamination").collect())) == want
