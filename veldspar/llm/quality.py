"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from veldspar.llm._buckets import forget_others
from veldspar.llm._columns import free
from veldspar.llm._text import NOT_SPACE, spans

FEATURES = ["log_bytes", "upper", "digits", "above_ascii", "marks", "strange_marks", "top_mark", "mark_kinds", "bars", "spaces", "word_length", "word_spread", "long_words", "short_words", "marked_words", "distinct_words", "log_lines", "repeated_lines", "line_length", "squeezed", "least_squeezed", "most_squeezed", "bangs"]
#: Labelled rows that a fit uses at most: those whose ids have the least hashes. It bounds what the driver holds.
FIT_ROWS = 20_000
_SQUEEZE = 1 << 16
_MARK = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_COMMON = [ord(c) for c in ".,;:'\"-()?"]


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text: shares of kinds of bytes, shapes of words, repetition. All zero for a text that is
    null or empty."""
    buf = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not buf:
        return out
    n = len(buf)
    a, starts, ends = spans(buf, NOT_SPACE)
    count = np.bincount(a, minlength=256).astype(float)
    marks = np.where(_MARK, count, 0)
    strange = marks.copy()
    strange[_COMMON] = 0
    letters = max(1.0, count[65:91].sum() + count[97:123].sum() + count[128:].sum())
    lens = ends - starts
    words = max(1, len(lens))
    lines = [x for x in buf.split(b"\n") if x.strip()]
    parts = [buf[i : i + _SQUEEZE] for i in range(0, n, _SQUEEZE)]
    squeezed = [len(zlib.compress(p, 1)) for p in parts]
    shares = [s / len(p) for s, p in zip(squeezed, parts, strict=True)]
    tokens = buf.split()
    last = a[ends - 1] if len(ends) else a[:0]
    out[:] = [
        np.log1p(n), count[65:91].sum() / letters, count[48:58].sum() / n, count[128:].sum() / n, marks.sum() / n,
        strange.sum() / n, marks.max() / n, (marks > 0).sum(), count[124] / words, (n - lens.sum()) / n,
        lens.sum() / words, lens.std() if len(lens) else 0, (lens > 14).sum() / words, (lens < 4).sum() / words,
        _MARK[last].sum() / words, len(set(tokens)) / words, np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(squeezed) / n,
        min(shares), max(shares), count[33] / words,
    ]
    return out


def feature_column(text: Column | str) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        forget_others(__name__)
        return pd.Series([features(t) for t in texts])

    return run(text)


def _cells(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(values), 0), dtype=int)


def _sums(at: np.ndarray, weights: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=int(np.prod(shape))).reshape(shape)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Values of a shallow regression tree over the cells of one feature: cuts are made where they gain most."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            left, right = (cg[m] - cg[a], ch[m] - ch[a]), (cg[b] - cg[m], ch[b] - ch[m])
            won = _gain(*left, ridge) + _gain(*right, ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
            won[(left[1] < 1e-3) | (right[1] < 1e-3)] = 0
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (float(won[k]), int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each of two features."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.ix_(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]))
    quarter = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gs, hs = quarter(cg), quarter(ch)
    won = sum(_gain(x, y, ridge) for x, y in zip(gs, hs, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], ridge)
    if not won.size:
        return 0.0, np.zeros_like(g)
    p, q = np.unravel_index(int(won.argmax()), won.shape)
    values = [x[p, q] / (y[p, q] + ridge) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: p + 1, : q + 1], out[: p + 1, q + 1 :], out[p + 1 :, : q + 1], out[p + 1 :, q + 1 :] = values
    return float(won[p, q]), out


@dataclass
class AdditiveModel:
    """intercept + the sum of a table's value for each feature and each chosen pair of features."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def margins(self, values: np.ndarray) -> np.ndarray:
        cells, coarse = _cells(values, self.cuts), _cells(values, self.pair_cuts)
        out = np.full(len(values), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[cells[:, j]]
        for (i, j), table in self.pairs.items():
            out += table[coarse[:, i], coarse[:, j]]
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(values), -30, 30)))

    def to_json(self) -> str:
        lists = lambda xs: [x.tolist() for x in xs]
        return json.dumps({"intercept": self.intercept, "cuts": lists(self.cuts), "tables": lists(self.tables), "pair_cuts": lists(self.pair_cuts), "pairs": [[i, j, t.tolist()] for (i, j), t in self.pairs.items()]})


def fit(values: np.ndarray, labels: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, bins: int = 48, coarse: int = 8, pairs: int = 6, ridge: float = 4.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets a small step by a shallow tree over its bins, so
    that none takes all the credit. Then the ``pairs`` pairs that explain most of what is left get their own.

    Features that are not finite count as 0. With no rows, or labels all alike, the model is a constant.
    """
    values, labels = np.nan_to_num(np.asarray(values, dtype=float)), np.asarray(labels, dtype=float)
    width = values.shape[1]
    edges = lambda n: [np.unique(np.quantile(values[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(values) else np.zeros(0) for j in range(width)]
    cuts, pair_cuts = edges(bins), edges(coarse)
    rate_of_ones = (labels.sum() + 1) / (len(labels) + 2)
    model = AdditiveModel(float(np.log(rate_of_ones / (1 - rate_of_ones))), cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts, {})
    if not len(labels) or labels.min() == labels.max():
        return model
    cells, small = _cells(values, cuts), _cells(values, pair_cuts)
    margin = np.full(len(labels), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            shape = (len(cuts[j]) + 1,)
            step = rate * _tree(_sums(cells[:, j], g, shape), _sums(cells[:, j], h, shape), ridge)
            model.tables[j] += step
            margin += step[cells[:, j]]
    shapes = {(i, j): (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1) for i, j in combinations(range(width), 2)}
    flat = {k: small[:, k[0]] * s[1] + small[:, k[1]] for k, s in shapes.items()}
    g, h = slopes()
    gains = {k: _cross(_sums(flat[k], g, s), _sums(flat[k], h, s), ridge)[0] for k, s in shapes.items()}
    model.pairs = {k: np.zeros(shapes[k]) for k in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]}
    for _ in range(pair_rounds):
        for k, table in model.pairs.items():
            g, h = slopes()
            step = rate * _cross(_sums(flat[k], g, shapes[k]), _sums(flat[k], h, shapes[k]), ridge)[1]
            table += step
            margin += step.ravel()[flat[k]]
    return model


def held_out(id_col: Column | str) -> Column:
    """True for a fifth of the ids, by the CRC-32 of the id as text; those rows' labels are never learnt. False for
    a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False)) if isinstance(id_col, str) else F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on the labelled rows that aren't held out, ``fit_rows`` at most: those of least hash of their id.

    An id with several labels has their mean, 1 from a half on; null labels are left out. The labels are looked up
    by id, and neither they nor any column but the text are inputs.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_key") == F.col("_id"))  # at most fit_rows pairs of numbers
    found = rows.select("_id", "_label", feature_column("_text").alias("_values")).groupBy("_id", "_label", "_values").count().orderBy(F.xxhash64("_id"), "_id", "_values").limit(fit_rows).select("_label", "_values").toPandas()
    values = np.stack(found["_values"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(values, found["_label"].to_numpy())


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with column ``into``, the model's probability of label 1 for the whole text. Null and empty texts
    score as a text with all features 0. A column of that name that ``docs`` has already gives way."""

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        forget_others(__name__)
        return pd.Series(model.scores(np.stack([features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn(into, run(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kwargs) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    into = free("score", docs)
    return score(docs, fit_quality(docs, labels, **kwargs), kwargs.get("text_col", "text"), into).where(F.col(into) >= threshold).select(*docs.columns)
