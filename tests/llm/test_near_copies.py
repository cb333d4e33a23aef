"""The pipeline's near-copy stage against brute force: word shingles of five, similarity 0.8."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veldspar.llm import _buckets, near_copies


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[s : s + n]) for s in range(max(1, len(w) - n + 1))} if w else set()


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "Ter", "é"]) for _ in range(rng.randint(2, 4)))
    said = [[word() for _ in range(n)] for n in (3, 5, 9, 13, 30, 60, 120, 400, 900)]
    out = [None, "", " \n", "Same same " * 60, "same SAME " * 90, "one"]
    for w in said:
        for edits in range(6):
            new = list(w)
            for at in rng.sample(range(len(w)), min(edits * len(w) // 100 + edits, len(w))):
                new[at] = word()
            out += [" ".join(new), " ".join(new[: len(new) * (10 - edits) // 10])]
    return out


def brute(said):
    sets, least = [shingles(t) for t in said], list(range(len(said)))
    alike = lambda a, b: a == b or (a and b and len(a & b) / len(a | b) >= 0.8)
    for _ in said:
        then = [min([least[i], *(least[j] for j in range(len(said)) if alike(sets[i], sets[j]))]) for i in range(len(said))]
        if then == least:
            return least
        least = then
    return least


def test_near_copies(spark, monkeypatch):
    said = texts()
    want = brute(said)
    docs = spark.createDataFrame([*enumerate(said), (None, said[9])], "doc_id long, text string").repartition(5)
    ids = docs.where("doc_id is not null")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(ids).collect()} == dict(enumerate(want))
    kept = corpus_pipeline.distinct_documents(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want)) and len(kept) == len(set(want)) + 1
    for name, value in (("TILE", 2), ("COUNTED", 1)):  # hot buckets are cut into tiles and lose no pair
        monkeypatch.setattr(_buckets, name, value)
    monkeypatch.setattr(near_copies, "ROWS", 3)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(ids).collect()} == dict(enumerate(want))
    assert near_copies.near_copies(ids.where("false")).count() == 0


def test_sketches_rule_out_no_near_pair():
    sets = sorted((near_copies.shingle_set(t) for t in texts() if shingles(t)), key=len)
    sizes = np.array([len(s) for s in sets])
    pairs = lambda found: {(int(i), int(j)) for a, b in found for i, j in zip(a, b, strict=True)}
    near = pairs(near_copies.near_pairs(sets))
    held = pairs(near_copies.maybe_near([near_copies.sketch(s) for s in sets], sizes))
    assert near == {(i, j) for j in range(len(sets)) for i in range(j) if (n := len(np.intersect1d(sets[i], sets[j]))) / (sizes[i] + sizes[j] - n) >= 0.8}
    assert near <= held and all(np.intersect1d(near_copies.prefix(sets[i]), near_copies.prefix(sets[j])).size for i, j in near)


def print_of(text):
    """The text's SimHash fingerprint: its set's bits, each as most of the shingles' hashes have it."""
    held = near_copies.shingle_set(text).tolist()
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in held) > len(held))


def by_fingerprints(said, distance):
    """A cluster for each text with words, over fingerprints some bits apart, bit by bit."""
    prints = {i: print_of(t) for i, t in enumerate(said) if shingles(t)}
    cluster = {i: i for i in prints}
    for _ in prints:
        cluster = {i: min(cluster[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= distance) for i in prints}
    return cluster


def test_simhash_finds_its_clusters_and_the_join_the_rest(spark, monkeypatch):
    """The stage's fingerprints link what lies within their distance, and the exact join adds only other pairs."""
    said = texts()
    cluster = by_fingerprints(said, near_copies.DISTANCE)
    near = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    sets = {i: shingles(said[i]) for i in cluster}
    pairs = {(i, j) for j in cluster for i in cluster if i < j and sets[i] != sets[j] and near(sets[i], sets[j])}
    mine = {p for p in pairs if cluster[p[0]] == cluster[p[1]]}
    assert mine and pairs - mine  # neither way does it alone

    docs = spark.createDataFrame([*enumerate(said)], "doc_id long, text string").repartition(5)
    components = lambda: {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    nothing = spark.createDataFrame([], "group long, fp long")
    same = {(i, j) for j in cluster for i in cluster if i < j and sets[i] == sets[j]}

    def closed(links):
        least = {i: i for i in cluster}
        for _ in cluster:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        return least

    with monkeypatch.context() as only:
        only.setattr(near_copies, "across", lambda *a: nothing)
        assert {i: c for i, c in components().items() if i in cluster} == closed(mine | same)
    with monkeypatch.context() as only:
        only.setattr(near_copies, "within", lambda *a: nothing)
        found = components()
        assert all(found[i] == found[j] for i, j in pairs - mine)
        a, b, (c, d) = *min(mine), min(pairs - mine)
        docs = docs.where(F.col("doc_id").isin(a, b, c, d))  # nothing else that the sketches could take them for
        assert components() == {a: a, b: b, c: c, d: c}


def test_fingerprints_alike_are_not_enough(spark):
    """Two texts in one cluster stay apart below the similarity."""
    words = [f"w{i}" for i in range(400)]
    said = [" ".join(words), " ".join(words[:100] + ["x"] + words[101:200] + ["y"] + words[201:])]
    docs = spark.createDataFrame([*enumerate(said)], "doc_id long, text string")
    found = lambda **k: {r.doc_id: r.component_id for r in near_copies.near_copies(docs, distance=64, **k).collect()}
    assert found() == {0: 0, 1: 0} and found(similarity=0.99) == {0: 0, 1: 1}
