"""Geo by day panels: contracts, designs, differences in differences, synthetic control, placebos."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def complete(cells: DataFrame) -> DataFrame:
    """(geo, day, revenue, spend) for each geo and each day from the first to the last, 0 where there was none."""
    ends = cells.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = cells.select("geo").distinct().crossJoin(F.broadcast(days))  # as many rows as days
    return grid.join(cells, ["geo", "day"], "left").fillna(0.0, ["revenue", "spend"])


def prepare(panel: DataFrame, start: str, treated: Column) -> DataFrame:
    out = panel.withColumns({"post": (F.col("day") >= F.lit(start).cast("date")).cast("int"), "treated": treated.cast("int")})
    return out.withColumn("treated_post", F.col("post") * F.col("treated"))


def recent(panel: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days of the period before treatment."""
    pre = panel.where("post = 0")
    last = pre.agg(F.max("day").alias("_last"))
    return pre.crossJoin(F.broadcast(last)).where(F.col("day") >= F.date_sub("_last", days - 1)).drop("_last")


def weekly(panel: DataFrame, value: str = "revenue", *by: str) -> DataFrame:
    """Means by geo and week from Monday; a part of a week counts as one. week_index counts from the first."""
    out = panel.groupBy(*by, "geo", "treated", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.avg(value).alias("value"))
    return out.withColumn("week_index", (F.datediff("week", F.min("week").over(Window.partitionBy(*by))) / 7).cast("int")) if by else out.crossJoin(F.broadcast(out.agg(F.min("week").alias("_first")))).withColumn("week_index", (F.datediff("week", "_first") / 7).cast("int")).drop("_first")


def pretrend(weeks: DataFrame, *by: str) -> DataFrame:
    """coefficient, se and z of treated x week within geos, with errors clustered by geo: demeaning in place of
    a column for each geo."""
    geo = Window.partitionBy(*by, "geo")
    dem = weeks.withColumns({"x": F.col("treated") * (F.col("week_index") - F.avg("week_index").over(geo)), "y": F.col("value") - F.avg("value").over(geo)})
    return _clustered(dem, 1, *by)


def geo_trends(weeks: DataFrame) -> DataFrame:
    """(geo, slope, intercept, r_squared, n, se): a line through each treated geo's weeks; se is null below three."""
    y, x = "value", "week_index"
    sxx, n = F.regr_sxx(y, x), F.count(F.lit(1))
    rest = F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), sxx)
    fit = weeks.where("treated = 1").groupBy("geo").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), n.alias("n"), rest.alias("_rest"), sxx.alias("_sxx"))
    se = F.sqrt(F.try_divide(F.greatest("_rest", F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx")))
    return fit.withColumn("se", F.when(F.col("n") > 2, se)).drop("_rest", "_sxx")


def student_p(t: float, freedom: float) -> float:
    """Two-sided p of Student's distribution: the incomplete beta function's continued fraction, by Lentz's method."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1 or x <= 0:
        return 1.0 if x >= 1 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    up, down, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
    out = down
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            down, up = 1 / (1 + k * down), 1 + k / up
            out *= down * up
        if abs(down * up - 1) < 1e-15:
            break
    return out


def student_quantile(p: float, freedom: float) -> float:
    """The t whose two-sided p is ``p``, by halving."""
    low, high = 0.0, 1.0
    while student_p(high, freedom) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_p(mid, freedom) > p else (low, mid)
    return low


def with_student(trends: DataFrame, level: float = 0.9) -> DataFrame:
    """``geo_trends`` with low, high and p_value, n - 2 degrees of freedom; null where there is no error."""

    @F.pandas_udf("low double, high double, p_value double")
    def run(slope: pd.Series, se: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for s, e, k in zip(slope, se, n, strict=True):
            if e is None or not e > 0:
                out.append((None, None, None))
            else:
                half = student_quantile(1 - level, k - 2) * e
                out.append((s - half, s + half, student_p(s / e, k - 2)))
        return pd.DataFrame(out, columns=["low", "high", "p_value"])

    return trends.withColumn("_t", run("slope", "se", "n")).select("*", "_t.*").drop("_t")


def spread(effects_: DataFrame) -> DataFrame:
    """least, most, mean and deviation of the column effect."""
    return effects_.agg(F.min("effect").alias("least"), F.max("effect").alias("most"), F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("deviation"))


def _clustered(dem: DataFrame, extra: int, *by: str, dates: int = 0) -> DataFrame:
    beta = dem.groupBy(*by).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("coefficient"))
    fit = dem.join(F.broadcast(beta), list(by)) if by else dem.crossJoin(F.broadcast(beta))
    per = fit.groupBy(*by, "geo").agg(F.sum(F.col("x") * (F.col("y") - F.col("coefficient") * F.col("x"))).alias("u"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count(F.lit(1)).alias("n"), F.first("coefficient").alias("coefficient"))
    g, n = F.count(F.lit(1)), F.sum("n")
    k = g + extra + dates
    factor = F.try_divide(g * (n - 1), (g - 1) * (n - k))  # null where nothing is left to estimate errors from
    se = F.try_divide(F.sqrt(F.sum(F.col("u") * F.col("u")) * F.when(factor > 0, factor)), F.sum("sxx"))
    return per.groupBy(*by).agg(F.first("coefficient").alias("coefficient"), se.alias("se")).withColumn("z", F.try_divide("coefficient", "se"))


def twfe(panel: DataFrame, dates: int, value: str = "revenue", x: Column | None = None) -> DataFrame:
    """Two-way fixed effects on a balanced panel by double demeaning: coefficient, clustered se, z."""
    of = lambda c: F.col(c) - F.avg(c).over(Window.partitionBy("geo")) - F.avg(c).over(Window.partitionBy("day")) + F.col(f"_{c}")
    base = panel.withColumn("_x", F.col("treated_post").cast("double") if x is None else x).withColumn("_y", F.col(value))
    base = base.crossJoin(F.broadcast(base.agg(F.avg("_x").alias("__x"), F.avg("_y").alias("__y"))))
    return _clustered(base.withColumns({"x": of("_x"), "y": of("_y")}), 0, dates=dates)


#: Geos of one study. Its Gram matrix is held on the driver.
MAX_GEOS = 2000


def geo_names(panel: DataFrame) -> list:
    """The panel's geos, in order; a ValueError where there are more than MAX_GEOS, as none may be left out."""
    names = sorted(r.geo for r in panel.select("geo").distinct().limit(MAX_GEOS + 1).collect())
    if len(names) > MAX_GEOS:
        raise ValueError(f"a study has at most {MAX_GEOS} geos")
    return names


def gram(panel: DataFrame) -> DataFrame:
    """(g, h, s): sums over days before treatment of products of geos' revenues; all fits need no more than this."""
    pre = panel.where("post = 0")
    return pre.select("day", F.col("geo").alias("g"), F.col("revenue").alias("a")).join(pre.select("day", F.col("geo").alias("h"), F.col("revenue").alias("b")), "day").groupBy("g", "h").agg(F.sum(F.col("a") * F.col("b")).alias("s"))


def simplex_weights(q: np.ndarray, tries: int = 20000) -> np.ndarray:
    """Minimise w'Qw with w >= 0 and sum 1, by accelerated projected gradients with restarts."""
    n = len(q)
    step = 1 / max(2 * np.linalg.eigvalsh(q)[-1], 1e-12)
    w = v = np.full(n, 1 / n)
    t = 1.0
    for _ in range(tries):
        x = v - step * 2 * q @ v
        u = np.sort(x)[::-1]
        c = np.cumsum(u) - 1
        r = np.flatnonzero(u - c / np.arange(1, n + 1) > 0)[-1]
        new = np.maximum(x - c[r] / (r + 1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (v - new) @ (new - w) > 0:
            t2, v2 = 1.0, new
        else:
            v2 = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-13:
            return new
        w, v, t = new, v2, t2
    return w


def donor_weights(s: np.ndarray, means: np.ndarray, treated: list[int], donors: list[int]) -> np.ndarray:
    """Weights of the donors whose normalised sum follows the normalised sum of the treated, from the Gram matrix
    and the means before treatment. The treated series is taken off each donor's first, as weights sum to 1."""
    d = s[np.ix_(donors, donors)] / np.outer(means[donors], means[donors])
    base = means[treated].sum()
    xy = s[np.ix_(donors, treated)].sum(1) / means[donors] / base
    yy = s[np.ix_(treated, treated)].sum() / base**2
    return simplex_weights(d - xy[:, None] - xy[None, :] + yy)


def _scenario_fits(scenarios: list[tuple[int, list, list]], panel: DataFrame) -> DataFrame:
    """(scenario, geo, weight): one fit a scenario (number, treated, donors), spread over tasks. The Gram matrix has
    a row for each pair of geos of one study; it is collected, bounded by MAX_GEOS."""
    spark = panel.sparkSession
    geos = geo_names(panel)
    at = {g: i for i, g in enumerate(geos)}
    s, m = np.zeros((len(geos), len(geos))), np.zeros(len(geos))
    rows = gram(panel).groupBy("g").agg(F.collect_list("h").alias("h"), F.collect_list("s").alias("s"))  # a row for each geo
    for r in rows.collect():
        s[at[r.g], [at[h] for h in r.h]] = r.s
    for r in panel.where("post = 0").groupBy("geo").agg(F.avg("revenue").alias("m")).collect():
        m[at[r.geo]] = r.m

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["scenario"].iloc[0])
        treated, donors = ([at[g] for g in pdf[pdf["role"] == role]["geo"]] for role in ("treated", "donor"))
        w = donor_weights(s, m, treated, donors)
        return pd.DataFrame({"scenario": number, "geo": [geos[i] for i in donors], "weight": w})

    rows = [(n, int(g), role) for n, treated, donors in scenarios for role, gs in (("treated", treated), ("donor", donors)) for g in gs]
    return spark.createDataFrame(rows, "scenario int, geo long, role string").groupBy("scenario").applyInPandas(run, "scenario int, geo long, weight double").where("weight > 1e-4")


def counterfactual(panel: DataFrame, treated: DataFrame, weights: DataFrame) -> DataFrame:
    """(scenario, day, post, actual, synthetic, gap); treated and weights by scenario, (scenario, geo[, weight])."""
    means = panel.where("post = 0").groupBy("geo").agg(F.avg("revenue").alias("m"))
    rows = panel.select("geo", "day", "post", "revenue").join(means, "geo")
    t = rows.join(F.broadcast(treated), "geo")
    actual = t.groupBy("scenario", "day", "post").agg(F.sum("revenue").alias("actual"))
    base = means.join(F.broadcast(treated), "geo").groupBy("scenario").agg(F.sum("m").alias("base"))
    ratio = rows.join(F.broadcast(weights), "geo").groupBy("scenario", "day").agg(F.sum(F.col("weight") * F.col("revenue") / F.col("m")).alias("ratio"))
    out = actual.join(ratio, ["scenario", "day"]).join(F.broadcast(base), "scenario").withColumn("synthetic", F.col("ratio") * F.col("base"))
    return out.select("scenario", "day", "post", "actual", "synthetic", (F.col("actual") - F.col("synthetic")).alias("gap"))


def effects(series: DataFrame) -> DataFrame:
    """By scenario: effect, mean daily effect, mean lift, and fit before treatment."""
    post, pre = F.col("post") == 1, F.col("post") == 0
    return series.groupBy("scenario").agg(
        F.sum(F.when(post, F.col("gap"))).alias("effect"),
        F.avg(F.when(post, F.col("gap"))).alias("mean_daily"),
        F.avg(F.when(post, F.col("gap") / F.col("synthetic"))).alias("mean_lift"),
        F.sqrt(F.avg(F.when(pre, F.col("gap") * F.col("gap")))).alias("pre_rmse"),
        F.avg(F.when(pre, F.abs("gap"))).alias("pre_mae"),
        F.corr(F.when(pre, F.col("actual")), F.when(pre, F.col("synthetic"))).alias("pre_corr"),
        (F.sqrt(F.avg(F.when(pre, F.col("gap") * F.col("gap")))) / F.avg(F.when(pre, F.col("actual")))).alias("relative_rmse"),
    )


def placebo_draws(controls: list[int], size: int, runs: int, seed: int = 42) -> list[list[int]]:
    rng = np.random.RandomState(seed)
    return [sorted(int(x) for x in rng.choice(sorted(controls), size, replace=False)) for _ in range(runs)]
