"""What keeps the queries on pairs of vectors bounded, against plain NumPy on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_numbers import SF, linkage, run
from veldspar.operators import decide, logistic, vectors as V
from veldspar.plans import evidence


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def units(n, width, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def similar(spark):
    x = np.array([r.vector for r in evidence.vectors(spark, SF).orderBy("id").collect()])
    return np.clip(x @ x.T, -1, 1)[np.triu_indices(len(x), 1)]


@pytest.fixture
def no_pairs(monkeypatch):
    """Pairs may be summed up where they are made, but not returned one by one."""

    def returned(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(V, "pairs", returned)


def test_linkage_in_bands(spark, monkeypatch):
    x = np.concatenate([units(60, 3), np.repeat(units(4, 3, 1), 5, axis=0), np.zeros((2, 3))])
    monkeypatch.setattr(V, "LINKS", 40)
    for threshold in (0.5, 0.8):
        found = V.complete_linkage(table(spark, x), threshold).collect()
        assert {r.id: (r.cluster_id, r.cluster_size) for r in found} == linkage(list(range(len(x))), np.where(np.abs(x) < 1e-9, 0, x), threshold) and len(found) == len(x)


@pytest.mark.parametrize("kind", ["ties", "sparse", "chain"])
def test_merges(kind):
    n = 12_000
    if kind == "chain":  # each is most like the one before: one merge a round
        a, b, s = np.arange(n - 1), np.arange(1, n), np.linspace(0.9, 0.5, n - 1)
        names, into = V.merges(a, b, s)
        assert names.tolist() == list(range(1, n, 2)) and into.tolist() == list(range(0, n - 1, 2))
        return
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.integers(0, n // 8, (2, 6 * n)), axis=0)
    a, b = np.unique(np.stack([a, b])[:, a != b], axis=1)
    s = rng.integers(1, 5, len(a)) / 5 if kind == "ties" else rng.random(len(a))
    into = np.arange(n)
    V._greedy(a, b, s, into)
    names, got = V.merges(a, b, s)
    moved = np.flatnonzero(into != np.arange(n))
    assert len(a) > 10_000 and names.tolist() == moved.tolist() and got.tolist() == into[moved].tolist()


@pytest.mark.parametrize("name", ["cluster_attach", "cluster_split", "cluster_summary", "dup_clusters", "split_leakage", "split_summary"])
def test_clusters_without_pairs(spark, no_pairs, name):
    assert run(spark, name).count() >= 1


def test_percentiles(spark, no_pairs, similar):
    row = run(spark, "similarity_percentiles").first()
    assert row.n == len(similar) and row["mean"] == pytest.approx(similar.mean(), abs=1e-8)
    assert [row[f"p{i}"] for i in range(4)] == pytest.approx(np.quantile(similar, evidence._QS).tolist(), abs=1e-7)
    x = np.repeat(np.eye(2), [3, 2], axis=0)  # four pairs of 1 and six of 0
    assert V.percentiles(table(spark, x), [0.0, 0.6, 2 / 3, 1.0]) == (10, pytest.approx(0.4), [0.0, pytest.approx(0.4), 1.0, 1.0])
    assert V.percentiles(table(spark, x[:1]), [0.5]) == (0, None, [None])


def test_threshold_counts(spark, no_pairs, similar):
    assert {r.threshold: r.n for r in run(spark, "threshold_counts").collect()} == {t: int((similar >= t).sum()) for t in evidence._TS}


def test_pair_count(spark, no_pairs, similar):
    assert tuple(run(spark, "pair_count_contract").first()) == (500, len(similar), len(similar), 0)


def test_histogram(spark, no_pairs, similar):
    bins, n = np.unique(np.floor((similar + 1) / 0.05).astype(int), return_counts=True)
    assert {r.bin: r.n for r in run(spark, "similarity_histogram").collect()} == dict(zip(bins.tolist(), n.tolist(), strict=True))


def test_copies_of_a_vector_in_the_shuffle(spark):
    few = spark.range(200_000).select("id", F.array(F.lit(1.0)).alias("vector"))
    assert V._groups(few) == V.SPREAD
    wide = spark.range(2000).select("id", F.array_repeat(F.lit(1.0), 64).alias("vector"))
    assert V._groups(wide) == math.ceil(2000 / V.BLOCK)


def test_nearest_and_edges(spark):
    x = units(2500, 8)
    x[100:110] = x[0]
    v, s = table(spark, x), np.clip(x @ x.T, -1, 1)
    a, b = np.nonzero(np.triu(s >= 0.9 - 1e-12, 1))
    found = {(r.a, r.b): r.similarity for r in V.pairs(v, 0.9).collect()}
    assert set(found) == set(zip(a.tolist(), b.tolist(), strict=True)) and all(abs(found[i, j] - s[i, j]) < 1e-12 for i, j in found)
    rounded = np.round(s, 9)
    np.fill_diagonal(rounded, -9)
    got = {}
    for r in V.top_k(v.where("id < 300"), v, 7).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.id)
    assert got == {i: np.argsort(-rounded[i], kind="stable")[:7].tolist() for i in range(300)}


def test_all_pairs_come_in_runs(spark):
    x = units(1300, 4)
    rows = V.pairs(table(spark, x)).withColumn("part", F.spark_partition_id()).toPandas()
    assert len(rows) == 1300 * 1299 // 2 and not rows.duplicated(["a", "b"]).any() and (rows["a"] < rows["b"]).all()
    runs = sum(int((part["a"].to_numpy()[1:] != part["a"].to_numpy()[:-1]).sum()) for _, part in rows.groupby("part"))
    assert runs < len(rows) / 100


def test_neighbours_are_found_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            asked.add(1)
            yield r

    near = spark.createDataFrame(spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.25, 2)], "query long, id long, similarity double, rank int").rdd.mapPartitions(counted), "query long, id long, similarity double, rank int")
    known, names = spark.createDataFrame([(2, "A"), (3, "B")], "id long, persona string"), spark.createDataFrame([("A",), ("B",)], "persona string")
    got = {r.persona: r.score for r in decide.knn_scores(near, known, names, 2).collect()}
    assert got == {"A": pytest.approx(2 / 3), "B": pytest.approx(1 / 3)} and asked.value == 2
    decide.knn_grid(near, known, names, [1, 2], [1, 2]).collect()
    assert asked.value == 4


def test_penalties_share_passes(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 3))
    v = table(spark, x)
    known = spark.createDataFrame([(i, "A") for i in range(200) if x[i, 0] + 0.5 * rng.standard_normal() > 0] + [(i, "B") for i in range(0, 200, 7)], "id long, persona string")
    both = {(r.c, r.persona): [*r.weights, r.intercept] for r in logistic.fit_each(v, known, ["A", "B", "C"], [0.3, 3.0]).collect()}
    assert set(both) == {(c, p) for c in (0.3, 3.0) for p in "AB"}
    for c in (0.3, 3.0):
        for r in logistic.fit(v, known, ["A", "B"], c).collect():
            assert both[c, r.persona] == pytest.approx([*r.weights, r.intercept], abs=1e-8)
