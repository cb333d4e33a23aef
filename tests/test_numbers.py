"""Queries that SQL can't express, against plain NumPy on the same rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import decide, panel as P, vectors as V
from veldspar.plans import evidence, lift, registry

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return registry.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def panel(spark):
    rows = lift.panel(spark, SF).orderBy("geo", "day").collect()
    geos, days = sorted({r.geo for r in rows}), sorted({r.day for r in rows})
    y = np.array([r.revenue for r in rows]).reshape(len(geos), len(days))
    pre = np.array([str(d) < lift.START for d in days])
    return y, pre, days


def fit(y, pre, treated, donors):
    """Weights by a plain active-set search over supports: the least squares on the simplex."""
    m = y[:, pre].mean(1)
    target = y[treated][:, pre].sum(0) / m[treated].sum()
    x = (y[donors][:, pre] / m[donors, None]).T
    w, step = np.full(len(donors), 1 / len(donors)), 1 / np.linalg.eigvalsh(x.T @ x)[-1]
    for _ in range(200_000):  # exponentiated steps would do as well; this is Frank-Wolfe with away steps
        g = x.T @ (x @ w - target)
        best, worst = int(g.argmin()), int(np.where(w > 1e-15, g, -np.inf).argmax())
        d = np.zeros_like(w)
        d[best] += 1
        d[worst] -= 1
        gain, curve = -(g @ d), float((x @ d) @ (x @ d))
        if gain < 1e-14:
            break
        t = min(gain / max(curve, 1e-300), w[worst])
        w = w + t * d
    assert step > 0
    return w


def effect(y, pre, treated, donors):
    w, m = fit(y, pre, treated, donors), y[:, pre].mean(1)
    synthetic = (w[:, None] * y[donors] / m[donors, None]).sum(0) * m[treated].sum()
    gap = y[treated].sum(0) - synthetic
    return w, gap, gap[~pre].sum()


@pytest.fixture(scope="module")
def observed(panel):
    y, pre, _ = panel
    return effect(y, pre, [0, 1, 2], list(range(3, 20)))


def test_synthetic_control(spark, panel, observed):
    y, pre, days = panel
    w, gap, total = observed
    got = {r.geo: r.weight for r in run(spark, "sc_weights").collect()}
    assert all(abs(got.get(3 + i, 0) - x) < 1e-3 for i, x in enumerate(w))
    series = {r.day: r.gap for r in run(spark, "sc_series").collect()}
    assert all(abs(series[d] - g) < 2e-3 * np.abs(gap).max() for d, g in zip(days, gap, strict=True))
    assert {r.day for r in run(spark, "incremental_series").collect()} == {d for d, p in zip(days, pre, strict=True) if not p}
    row = run(spark, "sc_effect").first()
    assert row.effect == pytest.approx(total, rel=5e-3) and row.relative_effect == pytest.approx(total / y[:3][:, pre].sum(), rel=5e-3)
    assert row.pre_rmse == pytest.approx(np.sqrt((gap[pre] ** 2).mean()), rel=1e-4)


def test_refits(spark, panel, observed):
    y, pre, _ = panel
    _, _, total = observed
    active = [3 + i for i, x in enumerate(observed[0]) if x > 1e-4]
    got = {r.removed_geo: r.effect for r in run(spark, "loo_donor").collect()}
    scale = np.abs(y[:3][:, ~pre].sum())
    assert all(abs(got[g] - effect(y, pre, [0, 1, 2], [d for d in range(3, 20) if d != g])[2]) < 1e-3 * scale for g in active)
    placebo = {n: effect(y, pre, gs, [d for d in range(3, 20) if d not in gs])[2] for n, gs in enumerate(lift._DRAWS)}
    got = {r.scenario: r.effect for r in run(spark, "placebo_runs").collect()}
    assert set(got) == set(placebo) and all(abs(got[n] - x) < 1e-3 * scale for n, x in placebo.items())
    low, high = np.quantile(list(got.values()), [0.05, 0.95])
    row = run(spark, "placebo_interval").first()
    assert (row.low, row.high) == (pytest.approx(row.observed - high), pytest.approx(row.observed - low))
    p = (sum(abs(x) >= abs(row.observed) for x in got.values()) + 1) / (len(got) + 1)
    assert run(spark, "placebo_p_value").first().p_value == pytest.approx(p)
    for r in run(spark, "sc_windows").collect():
        if r.days == 7:  # fewer days than donors: many weights fit without a rest, and any may be found
            assert r.pre_rmse < 1e-3
            continue
        keep = pre & (np.cumsum(pre) > pre.sum() - r.days) | ~pre
        assert abs(r.effect - effect(y[:, keep], pre[keep], [0, 1, 2], list(range(3, 20)))[2]) < 5e-3 * scale
    both = {r.method: r for r in run(spark, "method_comparison").collect()}
    did = (y[:3][:, ~pre].mean() - y[:3][:, pre].mean()) - (y[3:][:, ~pre].mean() - y[3:][:, pre].mean())
    assert both["did"].estimate == pytest.approx(did * 27) and both["did"].lower < both["did"].estimate < both["did"].upper
    assert both["synthetic_control"].estimate == pytest.approx(total, rel=5e-3)


def test_student(spark):
    assert P.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and P.student_p(-0.5, 3) == pytest.approx(0.65144796, abs=1e-7)
    assert P.student_quantile(0.10, 20) == pytest.approx(1.72471824, abs=1e-7) and P.student_p(0, 5) == 1
    for r in run(spark, "geo_trend_p_values").collect():
        if r.se:
            assert r.p_value == pytest.approx(P.student_p(r.slope / r.se, r.n - 2)) and r.low < r.slope < r.high
    got = run(spark, "pretrend_p_value").first()
    assert 0 <= got.p_value <= 1 and got.p_value == pytest.approx(math.erfc(abs(got.coefficient / got.se) / 2**0.5))


def linkage(ids, x, threshold):
    groups = [[i] for i in range(len(ids))]
    s = x @ x.T
    while True:
        best = max(((min(s[i, j] for i in a for j in b), -min(a), -min(b), p, q) for (p, a), (q, b) in itertools.combinations(enumerate(groups), 2)), default=(-9,))
        if best[0] < threshold - 1e-12:
            return {ids[i]: (min(ids[j] for j in g), len(g)) for g in groups for i in g}
        _, _, _, p, q = best
        groups[p] += groups.pop(q)


def test_clusters_and_split(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((9, 6))
    x = np.repeat(x, 4, axis=0) + 0.35 * rng.standard_normal((36, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = V.normalized(df)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for threshold in (0.6, 0.8):
        got = {r.id: (r.cluster_id, r.cluster_size) for r in V.complete_linkage(vectors, threshold).collect()}
        assert got == linkage(list(range(36)), unit, threshold)
    rows = run(spark, "cluster_split").collect()
    split = {}
    for r in rows:
        split.setdefault(r.cluster_id, set()).add(r.split)
    n = len(split)
    count = lambda s: sum(v == {s} for v in split.values())
    test = -(-15 * n // 100)
    assert count("test") == test and count("dev") == -(-15 * n // 100) and count("train") == n - 2 * test
    shown = {r.split: (r.n, r.clusters) for r in run(spark, "split_summary").collect()}
    assert shown == {s: (sum(r.split == s for r in rows), count(s)) for s in ("train", "dev", "test")}
    sizes = {r.cluster_size: r.clusters for r in run(spark, "cluster_summary").collect()}
    assert sum(k * v for k, v in sizes.items()) == len(rows) and sum(sizes.values()) == n


def test_logistic(spark):
    got = {(r["query"], r.persona): r.score for r in run(spark, "ovr_lr_scores").collect()}
    e = {r.id: np.array(r.vector) for r in evidence.vectors(spark, SF).collect()}
    mine = {}
    for r in evidence.labels(spark, SF).collect():
        mine.setdefault(r.id, set()).add(r.persona)
    train = [i for i in sorted(e) if i % 5]
    x = np.array([[*e[i], 1.0] for i in train])
    for persona in ("P0", "P7"):
        y = np.array([persona in mine[i] for i in train], float)
        c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0]) / 3
        for _ in range(50):  # Newton's method on the same loss
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (p - y)) + ridge @ w)
        for i in [i for i in e if i % 5 == 0]:
            assert got[i, persona] == pytest.approx(1 / (1 + np.exp(-np.append(e[i], 1) @ w)), abs=2e-3)
    top = [r for r in run(spark, "lr_top").collect() if r["rank"] == 1]
    assert all(got[r["query"], r.persona] == max(got[r["query"], f"P{k}"] for k in range(10)) for r in top)
    assert {(r["query"], r.persona) for r in run(spark, "lr_predict").collect()} == {k for k, v in got.items() if v >= 0.5}


def test_model_choice(spark):
    both = {r.model: r for r in run(spark, "final_compare").collect()}
    assert set(both) == {"knn", "logistic"} and both["logistic"].setting in evidence._CS and both["knn"].setting in evidence._KS
    assert all(0 <= r.hamming <= 1 and 0 <= r.macro_f1 <= 1 for r in both.values())


def test_pca(spark):
    x = np.array([r.vector for r in evidence.vectors(spark, SF).collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert [r.share for r in run(spark, "pca_variance").orderBy("component").collect()] == pytest.approx((values[:2] / values.sum()).tolist(), abs=1e-6)


def test_suggest(spark):
    """The flagship against the parts it is made of."""
    scores = {}
    for r in run(spark, "knn_scores").collect():
        scores.setdefault(r["query"], []).append((-round(r.score, 6), r.persona))
    proof = {}
    for r in run(spark, "persona_evidence").collect():
        proof.setdefault((r["query"], r.persona), set()).add(r.id)
    found = run(spark, "suggest").collect()
    assert {r["query"] for r in found} == set(scores)
    for r in found:
        best = sorted(scores[r["query"]])
        top, second = -best[0][0], -best[1][0]
        if top >= 0.5 and top - second >= 0.05:
            want, names = "suggest", [p for s, p in best[:3] if -s >= 0.5]
        else:
            want, names = ("suggest_with_caution", [best[0][1]]) if top >= 0.3 else ("abstain", [])
        assert r.decision == want and [p.name for p in r.personas] == names
        assert {e.id for e in r.evidence} == set().union(*[proof.get((r["query"], p), set()) for p in names])
        assert (r.rationale.startswith(names[0]) if r.evidence else True) if names else r.rationale.startswith("No label")
    told = {r["query"]: r.rationale for r in run(spark, "template_rationale").collect()}
    assert told == {r["query"]: r.rationale for r in found}
    assert run(spark, "suggestion_json").count() == len(found)


def test_no_label_is_dropped(spark):
    many = spark.range(1001).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("persona"))
    near = spark.createDataFrame([(1, 2, 0.5, 1)], "query long, id long, similarity double, rank int")
    known = spark.createDataFrame([(2, "L1000")], "id long, persona string")
    got = decide.knn_scores(near, known, many, 1).collect()
    assert len(got) == 1001 and {r.persona for r in got if r.score == 1} == {"L1000"}
    names = [f"L{i}" for i in range(101)]
    from veldspar.operators import logistic

    vectors = spark.createDataFrame([(i, [float(i == 7), float(i % 3), 1.0]) for i in range(20)], "id long, vector array<double>")
    fitted = logistic.fit(vectors, spark.createDataFrame([(7, "L100"), (8, "L0")], "id long, persona string"), names)
    assert {r.persona for r in fitted.collect()} == {"L0", "L100"}
    assert logistic.fit(vectors, spark.createDataFrame([], "id long, persona string"), names).count() == 0


def test_caps_raise(spark, monkeypatch):
    monkeypatch.setattr(decide, "MAX_LABELS", 3)
    with pytest.raises(ValueError, match="more than 3 labels"):
        decide.label_names(spark.createDataFrame([(c,) for c in "abcd"], "persona string"))
    monkeypatch.setattr(P, "MAX_GEOS", 5)
    with pytest.raises(ValueError, match="at most 5 geos"):
        run(spark, "placebo_equal_weight")
