"""A whole lift study of a panel in a file: effect, placebos, sensitivity, pre-trends and how far to trust it."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldspar.operators import decide, panel as P
from veldspar.plans import lift
from veldspar.sources import tables
from veldspar.storage import stage

#: Days before treatment that the sensitivity to the window is looked at with.
WINDOWS = (30, 60, 90)
_Z = 1.6448536269514722


def numbered(panel: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """The panel with geos as numbers in the order of their names, and the names; a study has MAX_GEOS at most."""
    names = P.geo_names(panel)
    known = panel.sparkSession.createDataFrame(list(enumerate(names)), "_n long, geo string")
    return panel.join(F.broadcast(known), "geo").drop("geo").withColumnRenamed("_n", "geo"), dict(enumerate(names))


def _series(panel: DataFrame, scenarios: list[tuple[int, list[int], list[int]]]) -> tuple[DataFrame, DataFrame]:
    """The scenarios' days and the weights that make their counterfactuals, staged."""
    treated = panel.sparkSession.createDataFrame([(n, g) for n, gs, _ in scenarios for g in gs], "scenario int, geo long")
    weights = stage(P._scenario_fits(scenarios, panel), "weights")
    return P.counterfactual(panel, treated, weights), weights


def _p(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def _with_p(fit: DataFrame) -> DataFrame:
    """Fits of pre-trends, few rows, with the two-sided normal p of z; null where there is no z."""
    rows = [(*row[:-1], row.z, _p(row.z)) for row in fit.collect()]
    return fit.sparkSession.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fit.schema.fields) + ", p_value double")


def report(panel: DataFrame, start: str, placebos: int = 100, seed: int = 42, windows: tuple[int, ...] = WINDOWS) -> dict[str, DataFrame]:
    """All tables of a study by name; ``estimates`` is its one-row result, with the trust state.

    ``panel`` holds to the contract PANEL; each geo needs each day. The interval is the effect less the placebos' 5th
    and 95th percentile; the p-value counts placebo effects at least as large, and the observed one among them.
    Windows longer than the time before treatment are that time.
    """
    held, names = numbered(panel.withColumnRenamed("date", "day"))
    ready = stage(P.prepare(held.drop("post", "treated", "treated_post"), start, F.col("treated_group") == 1), "study")
    spark = ready.sparkSession
    geo_name = F.broadcast(spark.createDataFrame(list(names.items()), "geo long, name string"))  # MAX_GEOS at most
    named = lambda df, col: df.join(geo_name, F.col(col) == geo_name.geo).drop(geo_name.geo).withColumn(col, F.col("name")).drop("name") if col != "geo" else df.join(geo_name, "geo").withColumn("geo", F.col("name")).drop("name")
    arms: dict[int, list[int]] = {0: [], 1: []}
    for row in ready.select("geo", "treated").distinct().collect():
        arms[row.treated].append(row.geo)
    treated, controls = sorted(arms[1]), sorted(arms[0])
    if not treated or len(controls) <= len(treated):
        raise ValueError("needs treated geos and more control geos than these")

    series, weights = _series(ready, [(0, treated, controls)])
    series = stage(series, "series")
    observed = P.effects(series).drop("scenario")
    draws = P.placebo_draws(controls, len(treated), placebos, seed)
    runs = stage(P.effects(_series(ready.where("treated = 0"), [(n, gs, sorted(set(controls) - set(gs))) for n, gs in enumerate(draws)])[0]), "placebos")
    active = sorted(r.geo for r in weights.select("geo").collect())  # MAX_GEOS at most
    without = [(g, treated, [c for c in controls if c != g]) for g in active if len(controls) > 1]
    loo = stage(P.effects(_series(ready, without)[0]).select(F.col("scenario").cast("long").alias("removed_geo"), "effect", "pre_rmse"), "loo")
    parts = [(n, P.recent(ready, n).unionByName(ready.where("post = 1"))) for n in windows]
    sc_windows = [P.effects(_series(part, [(n, treated, controls)])[0]).select(F.col("scenario").alias("days"), "effect", "pre_rmse") for n, part in parts]

    days, post_days = ready.select("day").distinct().count(), ready.where("post = 1").select("day").distinct().count()
    cells = len(treated) * post_days
    did = P.twfe(ready, days).select((F.col("coefficient") * cells).alias("did_effect"), ((F.col("coefficient") - _Z * F.col("se")) * cells).alias("did_low"), ((F.col("coefficient") + _Z * F.col("se")) * cells).alias("did_high"), F.col("coefficient").alias("did"), F.col("se").alias("did_se"))
    pre = ready.where("post = 0")
    weeks = stage(P.weekly(pre), "weeks")
    pretrend = stage(_with_p(P.pretrend(weeks)), "pretrend")
    recents = [P.recent(ready, n).withColumn("days", F.lit(n)) for n in windows]
    recent = recents[0]
    for part in recents[1:]:
        recent = recent.unionByName(part)
    excluded = F.broadcast(weeks.where("treated = 1").select(F.col("geo").alias("excluded")).distinct())  # MAX_GEOS at most
    gaps = lift.gap_by_week(weeks)

    q = F.percentile("placebo", F.array(F.lit(0.05), F.lit(0.95)))
    beside = runs.select(F.col("effect").alias("placebo")).crossJoin(F.broadcast(observed))  # one row
    told = beside.groupBy("effect", "mean_daily", "mean_lift", "pre_rmse", "pre_mae", "pre_corr", "relative_rmse").agg(q.alias("q"), ((F.count_if(F.abs("placebo") >= F.abs("effect")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    told = told.withColumns({"low": F.col("effect") - F.col("q")[1], "high": F.col("effect") - F.col("q")[0]}).drop("q")
    one = lambda df: F.broadcast(df)  # noqa: E731  one row each
    sens = P.spread(loo).select(F.col("least").alias("sens_low"), F.col("most").alias("sens_high"))
    parallel = pretrend.select((F.col("p_value") >= 0.10).alias("parallel"))
    total = pre.where("treated = 1").agg(F.sum("revenue").alias("pre_total"))
    told = told.crossJoin(one(did)).crossJoin(one(sens)).crossJoin(one(parallel)).crossJoin(one(total))
    told = told.withColumn("relative_effect", F.col("effect") / F.col("pre_total")).drop("pre_total")
    state = decide.trust(*[F.col(c) for c in ("effect", "low", "p_value", "relative_rmse", "sens_low", "sens_high", "did_effect", "parallel")])
    arm = lift.arms(ready)
    indexed = arm.crossJoin(F.broadcast(arm.agg(F.avg("t").alias("mt"), F.avg("c").alias("mc")))).agg(F.corr("t", "c").alias("correlation"), F.corr(F.col("t") / F.col("mt"), F.col("c") / F.col("mc")).alias("indexed_correlation"))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return {
        "estimates": stage(told.withColumn("trust", state), "estimates"),
        "series": series.drop("scenario"),
        "weights": named(weights.select("geo", "weight"), "geo").orderBy(F.desc("weight"), "geo"),
        "placebos": runs.select("scenario", "effect", "pre_rmse"),
        "leave_one_donor_out": named(loo, "removed_geo"),
        "sensitivity": P.spread(loo),
        "synthetic_windows": union(sc_windows),
        "correlation": indexed,
        "spend": lift.spend_changes(ready),
        "pretrend": pretrend,
        "pretrend_gap": gaps,
        "geo_trends": named(P.with_student(P.geo_trends(weeks)), "geo").orderBy("slope", "geo"),
        "pretrend_without_geo": named(_with_p(P.pretrend(weeks.join(excluded, F.col("geo") != F.col("excluded")), "excluded")), "excluded"),
        "pretrend_windows": _with_p(P.pretrend(P.weekly(recent, "revenue", "days"), "days")),
        "spend_pretrend": _with_p(P.pretrend(P.weekly(pre, "spend"))),
    }


def study(panel: DataFrame, start: str, placebos: int = 100, seed: int = 42) -> DataFrame:
    """The one-row result of ``report``."""
    return report(panel, start, placebos, seed)["estimates"]


def write_report(tables_: dict[str, DataFrame], folder: str) -> None:
    """The estimates as JSON and every other table as CSV, a folder each."""
    for name, table in tables_.items():
        tables.write(table, f"{folder}/{name}", "json" if name == "estimates" else "csv", files=1)


def main(args: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="python -m veldspar.plans.study", description=__doc__)
    options.add_argument("--panel", required=True, help="CSV or Parquet: date, geo, revenue, spend, treated_group")
    options.add_argument("--start", required=True, help="first day of treatment")
    options.add_argument("--placebos", type=int, default=100)
    options.add_argument("--seed", type=int, default=42)
    options.add_argument("--windows", type=int, nargs="+", default=list(WINDOWS), help="days before treatment to look at")
    options.add_argument("--out", help="folder for the tables, estimates as JSON and the others as CSV")
    given = options.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = report(tables.read(spark, given.panel, tables.PANEL), given.start, given.placebos, given.seed, tuple(given.windows))
    if given.out:
        write_report(found, given.out)
    for name, value in found["estimates"].first().asDict().items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
