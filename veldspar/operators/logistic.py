"""One-versus-rest logistic regression on vectors: fitting, scoring, searching, saving."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veldspar.functions.text import dot
from veldspar.operators.vectors import matrix
from veldspar.storage import stage

#: Bytes of second derivatives that a task sums up: so many models are fitted side by side, in the same passes.
CURVES = 32 << 20
PASSES, STEP = 200, 1e-9


def fit(vectors: DataFrame, labels: DataFrame, names: list[str], c: float = 3.0) -> DataFrame:
    """(persona, weights, intercept): an L2 logistic regression for each label, with balanced class weights and an
    unpenalised intercept, on all of ``vectors`` (id, vector); ``labels``: (id, persona).

    A label that no vector has, or all have, gives no model. The penalty is 1 / c as a sum over rows.
    """
    return fit_each(vectors, labels, names, [c]).drop("c")


def fit_each(vectors: DataFrame, labels: DataFrame, names: list[str], penalties: list[float]) -> DataFrame:
    """(c, persona, weights, intercept): ``fit`` for each c. Models are fitted together by Newton's method: a pass over
    the rows moves all of them, so that passes don't grow with labels or penalties; a step that makes a model worse is
    halved."""
    spark = vectors.sparkSession
    mine = labels.where(F.col("persona").isin(names)).groupBy("id").agg(F.collect_set("persona").alias("mine")) if names else labels.select("id", F.array("persona").alias("mine")).where("false")
    rows = stage(vectors.join(mine, "id", "left").select("vector", F.coalesce("mine", F.array().cast("array<string>")).alias("mine")), "training")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    ones = {r.persona: r["count"] for r in rows.select(F.explode("mine").alias("persona")).groupBy("persona").count().collect()}
    settings = [(c, name) for c in penalties for name in names if 0 < ones.get(name, 0) < n]
    side = max(1, CURVES // (8 * ((width or 0) + 1) ** 2))
    out = []
    for i in range(0, len(settings), side):
        some = settings[i : i + side]
        found = _newton(rows, some, [ones[name] for _, name in some], n, width)
        out += [(c, name, w[:-1].tolist(), float(w[-1])) for (c, name), w in zip(some, found, strict=True)]
    return spark.createDataFrame(out, "c double, persona string, weights array<double>, intercept double")


def _newton(rows: DataFrame, settings: list[tuple[float, str]], ones: list[int], n: int, width: int) -> np.ndarray:
    """The weights of each model, the intercept last."""
    at, tried = np.zeros((len(settings), width + 1)), np.zeros((len(settings), width + 1))
    step, loss = np.zeros_like(at), np.full(len(settings), np.inf)
    moving = np.arange(len(settings))
    for _ in range(PASSES):
        found = {r.model: (r.loss, np.frombuffer(r.step)) for r in _pass(rows, [settings[m] for m in moving], [ones[m] for m in moving], tried[moving], n).collect()}
        still = []
        for k, m in enumerate(moving.tolist()):
            new, ahead = found[k]
            if new <= loss[m] + 1e-12 * abs(new):
                at[m], loss[m], step[m] = tried[m], new, ahead
            else:
                step[m] = step[m] / 2
            tried[m] = at[m] - step[m]
            if np.abs(step[m]).max() > STEP * max(1.0, np.abs(at[m]).max()):
                still.append(m)
        moving = np.array(still, int)
        if not len(moving):
            return tried
    raise RuntimeError(f"logistic models did not settle in {PASSES} passes")


def _pass(rows: DataFrame, settings: list[tuple[float, str]], ones: list[int], w: np.ndarray, n: int) -> DataFrame:
    """(model, loss, step) for each model at ``w``: its loss there and Newton's step, as bytes, to be taken off."""
    names = sorted({name for _, name in settings})
    label = np.array([names.index(name) for _, name in settings])
    weight = np.array([(n / (2 * (n - one)), n / (2 * one)) for one in ones])
    ridge = np.array([1 / c for c, _ in settings])[:, None] * np.append(np.ones(w.shape[1] - 1), 0)
    size = w.shape[1]
    position = {name: k for k, name in enumerate(names)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curve = np.zeros(len(w)), np.zeros(w.shape), np.zeros((len(w), size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"])
            x = np.hstack([x, np.ones((len(x), 1))])
            has = np.zeros((len(x), len(names)), bool)
            for i, mine in enumerate(batch["mine"].to_pylist()):
                has[i, [position[name] for name in mine if name in position]] = True
            for k in range(len(w)):
                y, z = has[:, label[k]].astype(float), x @ w[k]
                each = np.where(y == 1, weight[k, 1], weight[k, 0])
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss[k] += each @ (np.logaddexp(0, z) - y * z)
                slope[k] += x.T @ (each * (p - y))
                curve[k] += (x * (each * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array(loss), *(pa.array([m.tobytes() for m in many], pa.binary()) for many in (slope, curve))], ["model", "loss", "slope", "curve"])

    def solve(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        k = key[0].as_py()
        slope = sum(np.frombuffer(b) for b in parts["slope"].to_pylist()) + ridge[k] * w[k]
        curve = sum(np.frombuffer(b) for b in parts["curve"].to_pylist()).reshape(size, size) + np.diag(ridge[k])
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        return pa.table({"model": pa.array([k], pa.int32()), "loss": [float(sum(parts["loss"].to_pylist()) + ridge[k] @ w[k] ** 2 / 2)], "step": pa.array([step.tobytes()], pa.binary())})

    sums = rows.mapInArrow(add, "model int, loss double, slope binary, curve binary")
    return sums.groupBy("model").applyInArrow(solve, "model int, loss double, step binary")


def scores(queries: DataFrame, models: DataFrame, *by: str) -> DataFrame:
    """(query, persona, score): each label's probability for each of ``queries`` (id, vector), with columns ``by`` of the
    models. ``models`` has a row for each label, MAX_LABELS at most, and setting."""
    margin = dot(F.col("vector"), F.col("weights")) + F.col("intercept")
    return queries.crossJoin(F.broadcast(models)).select(*by, F.col("id").alias("query"), "persona", (1 / (1 + F.exp(-margin))).alias("score"))


def save(models: DataFrame, path: str, about: dict) -> None:
    """Write models as Parquet and what is to be known about them beside it, through Spark."""
    models.coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    models.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What ``save`` wrote; a ValueError where a label stands twice or weights differ in length."""
    models, about = spark.read.parquet(f"{path}/models"), json.loads(spark.read.text(f"{path}/about").first().value)
    n, names, sizes = models.agg(F.count(F.lit(1)), F.count_distinct("persona"), F.count_distinct(F.size("weights"))).first()
    if n != names or sizes > 1:
        raise ValueError("labels repeat or weights differ in length")
    return models, about
