"""Queries on a geo by day panel: events of users in 20 geos over 30 days, geos 0 to 2 treated from day 22."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, Window

from veldspar.operators import decide, panel as P
from veldspar.plans.registry import query, read
from veldspar.sources import tables

START, TREATED = "2024-01-22", 3

PANEL = """WITH cells AS (SELECT user_id % 20 AS geo, CAST(ts AS DATE) AS day, sum(value) AS revenue, CAST(count(*) AS DOUBLE) AS spend FROM events GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM cells), (SELECT max(day) FROM cells), INTERVAL 1 DAY)) AS DATE) AS day),
panel0 AS (SELECT g.geo, d.day, coalesce(c.revenue, 0) AS revenue, coalesce(c.spend, 0) AS spend FROM (SELECT DISTINCT geo FROM cells) g CROSS JOIN days d LEFT JOIN cells c ON c.geo = g.geo AND c.day = d.day),
panel AS (SELECT geo, day, revenue, spend, CAST(day >= DATE '2024-01-22' AS INT) AS post, CAST(geo < 3 AS INT) AS treated, CAST(day >= DATE '2024-01-22' AND geo < 3 AS INT) AS treated_post FROM panel0)
"""
WEEKS = PANEL + """, w0 AS (SELECT geo, treated, CAST(date_trunc('week', day) AS DATE) AS week, avg({value}) AS value FROM panel WHERE post = 0 GROUP BY 1, 2, 3),
weeks AS (SELECT *, CAST(date_diff('day', (SELECT min(week) FROM w0), week) / 7 AS INT) AS week_index FROM w0)
"""
FIT = """, beta AS (SELECT {by} sum(x * y) / sum(x * x) AS coefficient FROM dem {group}),
per AS (SELECT {dby} d.geo, sum(x * (y - coefficient * x)) AS u, sum(x * x) AS sxx, count(*) AS n, any_value(coefficient) AS coefficient FROM dem d JOIN beta {on} GROUP BY ALL)
SELECT {by} round(any_value(coefficient), 5) AS coefficient, round(sqrt(sum(u * u) * (count(*) / (count(*) - 1.0)) * ((sum(n) - 1) / (sum(n) - (count(*) + {k})))) / sum(sxx), 5) AS se FROM per {group}"""


def fit_sql(k: int, by: str = "") -> str:
    return FIT.format(by=f"{by}," if by else "", dby=f"d.{by}," if by else "", group=f"GROUP BY {by}" if by else "", on=f"USING ({by})" if by else "ON true", k=k)


def panel(spark, sf_dir) -> DataFrame:
    cells = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("geo"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("revenue"), F.count(F.lit(1)).cast("double").alias("spend"))
    return P.prepare(P.complete(cells), START, F.col("geo") < TREATED)


def r(c, n: int = 5):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


def rounded(df: DataFrame, *cols: str, n: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(PANEL + "SELECT count(*) - count(DISTINCT (geo, day)) AS repeated_keys, count(*) FILTER (WHERE revenue IS NULL) AS null_revenue, count(*) FILTER (WHERE spend IS NULL) AS null_spend, count(*) FILTER (WHERE revenue < 0) AS negative_revenue, count(*) FILTER (WHERE spend < 0) AS negative_spend FROM panel")
def panel_contract(spark, sf_dir):
    rules = tables.Contract("geo long, day date, revenue double, spend double", ("geo", "day"), ("revenue", "spend"), ("revenue", "spend"))
    return tables.violations(panel(spark, sf_dir), rules)


@query(PANEL + "SELECT count(*) AS n, count(DISTINCT geo) AS geos, count(DISTINCT day) AS days, count(DISTINCT geo) FILTER (WHERE treated = 1) AS treated_geos, count(DISTINCT geo) FILTER (WHERE treated = 0) AS control_geos, min(day) AS first_day, max(day) AS last_day, sum(treated_post)::BIGINT AS treated_post FROM panel")
def panel_completeness(spark, sf_dir):
    return panel(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("geo").alias("geos"), F.count_distinct("day").alias("days"), F.count_distinct(F.when(F.col("treated") == 1, F.col("geo"))).alias("treated_geos"), F.count_distinct(F.when(F.col("treated") == 0, F.col("geo"))).alias("control_geos"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("treated_post").alias("treated_post"))


@query(PANEL + "SELECT geo, day, round(revenue, 5) AS revenue, spend, post, treated, treated_post FROM panel")
def panel_prepare(spark, sf_dir):
    return rounded(panel(spark, sf_dir), "revenue")


@query(PANEL + "SELECT geo, day, CASE WHEN post = 1 THEN 'post' ELSE 'pre' END AS period FROM panel")
def pre_post_split(spark, sf_dir):
    return panel(spark, sf_dir).select("geo", "day", F.when(F.col("post") == 1, "post").otherwise("pre").alias("period"))


@query(PANEL + "SELECT geo, day, round(revenue, 5) AS revenue FROM panel WHERE post = 0 AND day >= (SELECT max(day) FROM panel WHERE post = 0) - 9")
def recent_window(spark, sf_dir):
    return P.recent(panel(spark, sf_dir), 10).select("geo", "day", r("revenue").alias("revenue"))


@query(WEEKS.format(value="revenue") + "SELECT geo, week, week_index, round(value, 5) AS value FROM weeks")
def week_index(spark, sf_dir):
    return P.weekly(panel(spark, sf_dir).where("post = 0")).select("geo", "week", "week_index", r("value").alias("value"))


@query(PANEL + "SELECT geo, treated, CAST(date_trunc('week', day) AS DATE) AS week, round(avg(revenue), 5) AS revenue FROM panel GROUP BY 1, 2, 3")
def weekly_geo_mean(spark, sf_dir):
    return P.weekly(panel(spark, sf_dir)).select("geo", "treated", "week", r("value").alias("revenue"))


@query(PANEL + "SELECT geo, day FROM panel WHERE geo IN (SELECT geo FROM panel WHERE treated_post = 1)")
def semi_join_treated(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.join(p.where("treated_post = 1").select("geo").distinct(), "geo", "left_semi").select("geo", "day")


@query(PANEL + "SELECT geo, day, post FROM panel WHERE post = 1 UNION ALL SELECT geo, day, post FROM panel WHERE post = 0 AND day >= (SELECT max(day) FROM panel WHERE post = 0) - 9")
def window_panel_union(spark, sf_dir):
    p = panel(spark, sf_dir)
    return P.recent(p, 10).unionByName(p.where("post = 1")).select("geo", "day", "post")


@query(PANEL + "SELECT day, round(avg(CASE WHEN treated = 0 THEN revenue END), 5) AS control, round(avg(CASE WHEN treated = 1 THEN revenue END), 5) AS treated FROM panel GROUP BY day")
def panel_pivot(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("day").pivot("treated", [0, 1]).agg(F.avg("revenue")).select("day", r(F.col("`0`")).alias("control"), r(F.col("`1`")).alias("treated"))


@query(PANEL + "SELECT day, treated, round(avg(revenue), 5) AS revenue FROM panel GROUP BY 1, 2")
def daily_mean_by_arm(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("day", "treated").agg(r(F.avg("revenue")).alias("revenue"))


@query(PANEL + "SELECT day, round(sum(revenue), 4) AS revenue FROM panel WHERE treated = 1 GROUP BY 1")
def treated_daily_sum(spark, sf_dir):
    return panel(spark, sf_dir).where("treated = 1").groupBy("day").agg(r(F.sum("revenue"), 4).alias("revenue"))


def _cell(t: int, p: int, value: str = "revenue"):
    return F.avg(F.when((F.col("treated") == t) & (F.col("post") == p), F.col(value)))


_CELLS = ", ".join(f"avg(CASE WHEN treated = {t} AND post = {p} THEN {{v}} END) AS {n}" for n, t, p in (("treated_pre", 1, 0), ("treated_post", 1, 1), ("control_pre", 0, 0), ("control_post", 0, 1)))


def means(p: DataFrame, value: str = "revenue") -> DataFrame:
    return p.agg(_cell(1, 0, value).alias("treated_pre"), _cell(1, 1, value).alias("treated_post"), _cell(0, 0, value).alias("control_pre"), _cell(0, 1, value).alias("control_post"))


@query(PANEL + f"SELECT round(treated_pre, 5) AS treated_pre, round(treated_post, 5) AS treated_post, round(control_pre, 5) AS control_pre, round(control_post, 5) AS control_post FROM (SELECT {_CELLS.format(v='revenue')} FROM panel)")
def periodmeans(spark, sf_dir):
    return rounded(means(panel(spark, sf_dir)), "treated_pre", "treated_post", "control_pre", "control_post")


@query(PANEL + f"SELECT round((treated_post - treated_pre) - (control_post - control_pre), 5) AS did FROM (SELECT {_CELLS.format(v='revenue')} FROM panel)")
def naive_did(spark, sf_dir):
    return means(panel(spark, sf_dir)).select(r(F.expr("(treated_post - treated_pre) - (control_post - control_pre)")).alias("did"))


_SPEND = "round(treated_post - treated_pre, 5) AS treated_change, round(control_post - control_pre, 5) AS control_change, round((treated_post - treated_pre) / treated_pre, 6) AS treated_relative, round((control_post - control_pre) / control_pre, 6) AS control_relative, round((treated_post - treated_pre) - (control_post - control_pre), 5) AS did"


@query(PANEL + f"SELECT {_SPEND} FROM (SELECT {_CELLS.format(v='spend')} FROM panel)")
def spend_diagnostic(spark, sf_dir):
    return spend_changes(panel(spark, sf_dir))


def spend_changes(p: DataFrame) -> DataFrame:
    return means(p, "spend").selectExpr(*_SPEND.split(", r")[:1], *["r" + x for x in _SPEND.split(", r")[1:]])


_ARMS = """, arms AS (SELECT day, avg(CASE WHEN treated = 1 THEN revenue END) AS t, avg(CASE WHEN treated = 0 THEN revenue END) AS c FROM panel WHERE post = 0 GROUP BY day)
"""


def arms(p: DataFrame) -> DataFrame:
    return p.where("post = 0").groupBy("day").agg(F.avg(F.when(F.col("treated") == 1, F.col("revenue"))).alias("t"), F.avg(F.when(F.col("treated") == 0, F.col("revenue"))).alias("c"))


@query(PANEL + _ARMS + "SELECT round(corr(t, c), 8) AS correlation FROM arms")
def pre_corr(spark, sf_dir):
    return arms(panel(spark, sf_dir)).agg(r(F.corr("t", "c"), 8).alias("correlation"))


@query(PANEL + _ARMS + "SELECT round(corr(t / mt, c / mc), 8) AS correlation FROM arms CROSS JOIN (SELECT avg(t) AS mt, avg(c) AS mc FROM arms)")
def indexed_pre_corr(spark, sf_dir):
    a = arms(panel(spark, sf_dir))
    return a.crossJoin(F.broadcast(a.agg(F.avg("t").alias("mt"), F.avg("c").alias("mc")))).agg(r(F.corr(F.col("t") / F.col("mt"), F.col("c") / F.col("mc")), 8).alias("correlation"))


@query(PANEL + _ARMS + "SELECT p.geo, round(corr(p.revenue, a.t), 6) AS correlation, round(sqrt(avg((p.revenue - a.t) ** 2)), 5) AS rmse, round(avg(abs(p.revenue - a.t)), 5) AS mae FROM panel p JOIN arms a ON a.day = p.day WHERE p.treated = 0 GROUP BY 1")
def donor_ranking(spark, sf_dir):
    p = panel(spark, sf_dir)
    d = F.col("revenue") - F.col("t")
    return p.where("treated = 0").join(arms(p), "day").groupBy("geo").agg(r(F.corr("revenue", "t"), 6).alias("correlation"), r(F.sqrt(F.avg(d * d))).alias("rmse"), r(F.avg(F.abs(d))).alias("mae")).orderBy("rmse", F.desc("correlation"))


_INDEXED = ", base AS (SELECT treated, avg(revenue) AS b FROM panel WHERE post = 0 GROUP BY 1) SELECT p.treated, {unit} AS {name}, round(100 * avg(p.revenue) / any_value(b), 5) AS indexed FROM panel p JOIN base USING (treated) GROUP BY 1, 2"


def index_to_100(p: DataFrame, unit, name: str) -> DataFrame:
    based = p.withColumn("b", F.avg(F.when(F.col("post") == 0, F.col("revenue"))).over(Window.partitionBy("treated")))
    return based.groupBy("treated", unit.alias(name)).agg(r(100 * F.avg("revenue") / F.first("b")).alias("indexed"))


@query(PANEL + _INDEXED.format(unit="p.day", name="day"))
def indexed_series(spark, sf_dir):
    return index_to_100(panel(spark, sf_dir), F.col("day"), "day")


@query(PANEL + _INDEXED.format(unit="CAST(date_trunc('week', p.day) AS DATE)", name="week"))
def weekly_indexed(spark, sf_dir):
    return index_to_100(panel(spark, sf_dir), F.date_trunc("week", "day").cast("date"), "week")


_DEMEAN = ", dem AS (SELECT {by} geo, treated * (week_index - avg(week_index) OVER (PARTITION BY {by} geo)) AS x, value - avg(value) OVER (PARTITION BY {by} geo) AS y FROM {of})"


@query(WEEKS.format(value="revenue") + _DEMEAN.format(by="", of="weeks") + fit_sql(1))
def pretrend_weekly(spark, sf_dir):
    return rounded(P.pretrend(P.weekly(panel(spark, sf_dir).where("post = 0"))), "coefficient", "se").drop("z")


@query(WEEKS.format(value="spend") + _DEMEAN.format(by="", of="weeks") + fit_sql(1))
def spend_pretrend(spark, sf_dir):
    return rounded(P.pretrend(P.weekly(panel(spark, sf_dir).where("post = 0"), "spend")), "coefficient", "se").drop("z")


@query(WEEKS.format(value="revenue") + ", gaps AS (SELECT week, avg(CASE WHEN treated = 0 THEN value END) AS control, avg(CASE WHEN treated = 1 THEN value END) AS treated FROM weeks GROUP BY week) SELECT week, round(control, 5) AS control, round(treated, 5) AS treated, round(treated - control, 5) AS gap, round((treated - control) - first_value(treated - control) OVER (ORDER BY week), 5) AS gap_vs_first FROM gaps")
def pretrend_gap(spark, sf_dir):
    return rounded(gap_by_week(P.weekly(panel(spark, sf_dir).where("post = 0"))), "control", "treated", "gap", "gap_vs_first")


def gap_by_week(weeks: DataFrame) -> DataFrame:
    w = weeks.groupBy("week").agg(F.avg(F.when(F.col("treated") == 0, F.col("value"))).alias("control"), F.avg(F.when(F.col("treated") == 1, F.col("value"))).alias("treated")).withColumn("gap", F.col("treated") - F.col("control"))
    first = F.first("gap").over(Window.orderBy("week"))  # a row for each week
    return w.withColumn("gap_vs_first", F.col("gap") - first)


@query(WEEKS.format(value="revenue") + "SELECT geo, round(regr_slope(value, week_index), 5) AS slope, round(regr_intercept(value, week_index), 5) AS intercept, round(regr_r2(value, week_index), 6) AS r_squared, count(*) AS n, round(sqrt((regr_syy(value, week_index) - regr_sxy(value, week_index) ** 2 / regr_sxx(value, week_index)) / (count(*) - 2) / regr_sxx(value, week_index)), 5) AS se FROM weeks WHERE treated = 1 GROUP BY geo")
def geo_trend(spark, sf_dir):
    return rounded(P.geo_trends(P.weekly(panel(spark, sf_dir).where("post = 0"))), "slope", "intercept", "se").withColumn("r_squared", F.round("r_squared", 6))


@query()
def geo_trend_p_values(spark, sf_dir):
    """The trends with Student's 90 % intervals and p-values, smallest slope first."""
    return P.with_student(P.geo_trends(P.weekly(panel(spark, sf_dir).where("post = 0")))).orderBy("slope", "geo")


_PERIODS = ["treated_pre", "treated_post", "control_pre", "control_post"]


@query(PANEL + f"SELECT name, round(mean, 5) AS mean FROM (UNPIVOT (SELECT {_CELLS.format(v='revenue')} FROM panel) ON {', '.join(_PERIODS)} INTO NAME name VALUE mean)")
def period_means_transposed(spark, sf_dir):
    return rounded(means(panel(spark, sf_dir)).unpivot([], _PERIODS, "name", "mean"), "mean")


@query(WEEKS.format(value="revenue") + ", loo AS (SELECT e.geo AS excluded, w.* FROM weeks w JOIN (SELECT DISTINCT geo FROM weeks WHERE treated = 1) e ON w.geo <> e.geo)" + _DEMEAN.format(by="excluded,", of="loo") + fit_sql(1, "excluded"))
def loo_treated_pretrend(spark, sf_dir):
    w = P.weekly(panel(spark, sf_dir).where("post = 0"))
    out = w.where("treated = 1").select(F.col("geo").alias("excluded")).distinct()
    return rounded(P.pretrend(w.join(F.broadcast(out), F.col("geo") != F.col("excluded")), "excluded"), "coefficient", "se").drop("z")


@query(PANEL + ", pre AS (SELECT n AS days, p.* FROM panel p, (SELECT unnest([10, 14, 21]) AS n) WHERE post = 0 AND day >= (SELECT max(day) FROM panel WHERE post = 0) - CAST(n - 1 AS INT)), w0 AS (SELECT days, geo, treated, CAST(date_trunc('week', day) AS DATE) AS week, avg(revenue) AS value FROM pre GROUP BY 1, 2, 3, 4), weeks AS (SELECT *, CAST(date_diff('day', min(week) OVER (PARTITION BY days), week) / 7 AS INT) AS week_index FROM w0)" + _DEMEAN.format(by="days,", of="weeks") + fit_sql(1, "days"))
def pretrend_windows(spark, sf_dir):
    p = panel(spark, sf_dir)
    parts = [P.recent(p, n).withColumn("days", F.lit(n)) for n in (10, 14, 21)]
    return rounded(P.pretrend(P.weekly(parts[0].unionByName(parts[1]).unionByName(parts[2]), "revenue", "days"), "days"), "coefficient", "se").drop("z")


_TWOWAY = ", dem0 AS (SELECT geo, day, {x} AS x0, revenue AS y0 FROM {of}), dem AS (SELECT geo, x0 - avg(x0) OVER (PARTITION BY geo) - avg(x0) OVER (PARTITION BY day) + avg(x0) OVER () AS x, y0 - avg(y0) OVER (PARTITION BY geo) - avg(y0) OVER (PARTITION BY day) + avg(y0) OVER () AS y FROM dem0)"


@query(PANEL + _TWOWAY.format(x="CAST(treated_post AS DOUBLE)", of="panel") + fit_sql(30))
def did_twfe(spark, sf_dir):
    return rounded(P.twfe(panel(spark, sf_dir), 30), "coefficient", "se").drop("z")


@query(PANEL + ", pre AS (SELECT *, CAST(treated * date_diff('day', (SELECT min(day) FROM panel), day) AS DOUBLE) AS tx FROM panel WHERE post = 0)" + _TWOWAY.format(x="tx", of="pre") + fit_sql(21))
def pretrend_daily(spark, sf_dir):
    p = panel(spark, sf_dir).where("post = 0")
    first = p.agg(F.min("day").alias("first"))
    p = p.crossJoin(F.broadcast(first))
    return rounded(P.twfe(p, 21, x=(F.col("treated") * F.datediff("day", "first")).cast("double")), "coefficient", "se").drop("z")


@query(PANEL + "SELECT a.geo AS g, b.geo AS h, round(sum(a.revenue * b.revenue), 0) AS s FROM panel a JOIN panel b ON a.day = b.day WHERE a.post = 0 AND b.post = 0 GROUP BY 1, 2")
def sc_gram(spark, sf_dir):
    return rounded(P.gram(panel(spark, sf_dir)), "s", n=0)


def _geos(spark, sf_dir) -> tuple[DataFrame, list[int], list[int]]:
    p = panel(spark, sf_dir)
    return p, list(range(TREATED)), P.geo_names(p.where("treated = 0"))


def _scenarios(spark, rows) -> DataFrame:
    return spark.createDataFrame([(n, g) for n, gs in rows for g in gs], "scenario int, geo long")


_EQUAL = """, m AS (SELECT geo, avg(revenue) AS m FROM panel WHERE post = 0 GROUP BY 1),
t AS (SELECT s.scenario, day, post, sum(revenue) AS actual FROM panel JOIN treated s USING (geo) GROUP BY ALL),
b AS (SELECT s.scenario, sum(m) AS base FROM m JOIN treated s USING (geo) GROUP BY 1),
c AS (SELECT w.scenario, day, sum(w.weight * revenue / m) AS ratio FROM panel JOIN m USING (geo) JOIN weights w USING (geo) GROUP BY ALL),
series AS (SELECT t.scenario, t.day, t.post, actual, ratio * base AS synthetic, actual - ratio * base AS gap FROM t JOIN c ON t.scenario = c.scenario AND t.day = c.day JOIN b ON b.scenario = t.scenario)
"""
_ONE = PANEL + ", treated AS (SELECT DISTINCT 0 AS scenario, geo FROM panel WHERE treated = 1), weights AS (SELECT DISTINCT 0 AS scenario, geo, 1.0 / (SELECT count(DISTINCT geo) FROM panel WHERE treated = 0) AS weight FROM panel WHERE treated = 0)" + _EQUAL


def _equal(spark, sf_dir) -> DataFrame:
    p = panel(spark, sf_dir)
    controls = p.where("treated = 0").select("geo").distinct()
    n = controls.agg(F.count(F.lit(1)).alias("n"))
    return P.counterfactual(p, p.where("treated = 1").select(F.lit(0).alias("scenario"), "geo").distinct(), controls.crossJoin(F.broadcast(n)).select(F.lit(0).alias("scenario"), "geo", (1 / F.col("n")).alias("weight")))


@query(_ONE + "SELECT day, post, round(actual, 4) AS actual, round(synthetic, 4) AS synthetic, round(gap, 4) AS gap FROM series")
def sc_equal_weight(spark, sf_dir):
    return rounded(_equal(spark, sf_dir).drop("scenario"), "actual", "synthetic", "gap", n=4)


@query(_ONE + "SELECT round(sqrt(avg(gap * gap)), 4) AS rmse, round(avg(abs(gap)), 4) AS mae, round(corr(actual, synthetic), 7) AS correlation, round(sqrt(avg(gap * gap)) / avg(actual), 7) AS relative_rmse FROM series WHERE post = 0")
def prefit_metrics(spark, sf_dir):
    return P.effects(_equal(spark, sf_dir)).select(r("pre_rmse", 4).alias("rmse"), r("pre_mae", 4).alias("mae"), r("pre_corr", 7).alias("correlation"), r("relative_rmse", 7).alias("relative_rmse"))


@query(_ONE + "SELECT day, round(sum(gap) OVER (ORDER BY day), 4) AS cumulative FROM series WHERE post = 1")
def cumulative_incremental(spark, sf_dir):
    return _equal(spark, sf_dir).where("post = 1").select("day", r(F.sum("gap").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cumulative"))


_DRAWS = P.placebo_draws(list(range(TREATED, 20)), TREATED, 20)
_DRAW_ROWS = ", ".join(f"({n}, {g})" for n, gs in enumerate(_DRAWS) for g in gs)


@query(PANEL + f", treated AS (SELECT * FROM (VALUES {_DRAW_ROWS}) v(scenario, geo)), weights AS (SELECT s.scenario, g.geo, 1.0 / 14 AS weight FROM (SELECT DISTINCT scenario FROM treated) s, (SELECT DISTINCT geo FROM panel WHERE treated = 0) g WHERE NOT EXISTS (SELECT 1 FROM treated t WHERE t.scenario = s.scenario AND t.geo = g.geo))" + _EQUAL + "SELECT scenario, round(sum(gap), 3) AS effect FROM series WHERE post = 1 GROUP BY 1")
def placebo_equal_weight(spark, sf_dir):
    return placebo_series(spark, sf_dir).select("scenario", r("effect", 3).alias("effect"))


def placebo_series(spark, sf_dir) -> DataFrame:
    p, _, controls = _geos(spark, sf_dir)
    weights = [(n, g, 1 / (len(controls) - TREATED)) for n, gs in enumerate(_DRAWS) for g in controls if g not in gs]
    series = P.counterfactual(p.where("treated = 0"), _scenarios(spark, enumerate(_DRAWS)), spark.createDataFrame(weights, "scenario int, geo long, weight double"))
    return P.effects(series)


@query(PANEL + f", treated AS (SELECT * FROM (VALUES {_DRAW_ROWS}) v(scenario, geo)), weights AS (SELECT s.scenario, g.geo, 1.0 / 14 AS weight FROM (SELECT DISTINCT scenario FROM treated) s, (SELECT DISTINCT geo FROM panel WHERE treated = 0) g WHERE NOT EXISTS (SELECT 1 FROM treated t WHERE t.scenario = s.scenario AND t.geo = g.geo))" + _EQUAL + "SELECT round(min(effect), 3) AS least, round(max(effect), 3) AS most, round(avg(effect), 3) AS mean, round(stddev_samp(effect), 3) AS deviation FROM (SELECT sum(gap) AS effect FROM series WHERE post = 1 GROUP BY scenario)")
def sensitivity_summary(spark, sf_dir):
    """How effects over refits spread; here those of the placebo groups with equal weights."""
    return rounded(P.spread(placebo_series(spark, sf_dir)), "least", "most", "mean", "deviation", n=3)


def _fitted(spark, p, scenarios) -> DataFrame:
    weights = P._scenario_fits(scenarios, p)
    return P.counterfactual(p, _scenarios(spark, [(n, t) for n, t, _ in scenarios]), weights)


@query()
def sc_weights(spark, sf_dir):
    p, treated, controls = _geos(spark, sf_dir)
    return P._scenario_fits([(0, treated, controls)], p).select("geo", "weight").orderBy(F.desc("weight"))


@query()
def sc_series(spark, sf_dir):
    p, treated, controls = _geos(spark, sf_dir)
    return _fitted(spark, p, [(0, treated, controls)]).drop("scenario")


@query()
def incremental_series(spark, sf_dir):
    return sc_series(spark, sf_dir).where("post = 1").select("day", "gap")


@query()
def sc_effect(spark, sf_dir):
    p, treated, controls = _geos(spark, sf_dir)
    total = p.where("treated = 1 and post = 0").agg(F.sum("revenue").alias("pre_total"))
    return P.effects(_fitted(spark, p, [(0, treated, controls)])).crossJoin(F.broadcast(total)).withColumn("relative_effect", F.col("effect") / F.col("pre_total")).drop("scenario")


@query()
def loo_donor(spark, sf_dir):
    p, treated, controls = _geos(spark, sf_dir)
    active = sorted(x.geo for x in P._scenario_fits([(0, treated, controls)], p).collect())
    series = _fitted(spark, p, [(g, treated, [c for c in controls if c != g]) for g in active])
    return P.effects(series).select(F.col("scenario").alias("removed_geo"), "effect", "pre_rmse").orderBy("removed_geo")


@query()
def sc_windows(spark, sf_dir):
    p, treated, controls = _geos(spark, sf_dir)
    parts = []
    for n in (7, 14, 21):
        part = P.recent(p, n).unionByName(p.where("post = 1"))
        parts.append(P.effects(_fitted(spark, part, [(n, treated, controls)])).select(F.col("scenario").alias("days"), "effect", "pre_rmse"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def placebo_runs(spark, sf_dir):
    """Effects of placebo groups, on the scale of their sum as the observed one."""
    p, _, controls = _geos(spark, sf_dir)
    p = p.where("treated = 0")
    return P.effects(_fitted(spark, p, [(n, gs, [c for c in controls if c not in gs]) for n, gs in enumerate(_DRAWS)])).select("scenario", "effect", "pre_rmse")


def _placebo_summary(spark, sf_dir) -> DataFrame:
    observed = sc_effect(spark, sf_dir).select(F.col("effect").alias("observed"))
    return placebo_runs(spark, sf_dir).crossJoin(F.broadcast(observed))


@query()
def placebo_interval(spark, sf_dir):
    q = F.percentile("effect", F.array(F.lit(0.05), F.lit(0.95)))
    return _placebo_summary(spark, sf_dir).groupBy("observed").agg(q.alias("q")).select("observed", (F.col("observed") - F.col("q")[1]).alias("low"), (F.col("observed") - F.col("q")[0]).alias("high"))


@query()
def placebo_p_value(spark, sf_dir):
    return _placebo_summary(spark, sf_dir).agg(((F.count_if(F.abs("effect") >= F.abs("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


@query()
def method_comparison(spark, sf_dir):
    z = 1.6448536269514722
    n = TREATED * 9
    low_high = placebo_interval(spark, sf_dir).select(F.lit("synthetic_control").alias("method"), F.col("observed").alias("estimate"), F.col("low").alias("lower"), F.col("high").alias("upper"))
    did = P.twfe(panel(spark, sf_dir), 30).select(F.lit("did").alias("method"), (F.col("coefficient") * n).alias("estimate"), ((F.col("coefficient") - z * F.col("se")) * n).alias("lower"), ((F.col("coefficient") + z * F.col("se")) * n).alias("upper"))
    return low_high.unionByName(did)


@query()
def pretrend_p_value(spark, sf_dir):
    """Two-sided normal p of the weekly trend: one row, so its p is taken on the driver."""
    row = P.pretrend(P.weekly(panel(spark, sf_dir).where("post = 0"))).first()
    return spark.createDataFrame([(row.coefficient, row.se, math.erfc(abs(row.z) / math.sqrt(2)))], "coefficient double, se double, p_value double")


_TRUST = [(1e5, 9e4, 0.01, 0.02, 9.5e4, 1.05e5, 1.2e5, False), (1e5, -5e4, 0.5, 0.02, 9.5e4, 1.05e5, 1.2e5, False), (1e5, 9e4, 0.01, 0.02, 9.5e4, 1.05e5, 1.2e5, True), (1e5, 9e4, 0.01, 0.02, 7e4, 1.3e5, 1.2e5, True), (1e5, 9e4, 0.1, 0.02, 9.5e4, 1.05e5, 1.2e5, True), (1e5, 9e4, 0.01, 0.05, 9e4, 1.1e5, 1.5e5, True)]
_TRUST_ROWS = ", ".join(f"({n}, {', '.join(str(x).lower() for x in row)})" for n, row in enumerate(_TRUST))


@query(f"SELECT n, CASE WHEN NOT (est > 0 AND low > 0 AND p < 0.1::DOUBLE AND slo > 0) THEN 'not_trusted' WHEN (shi - slo) / abs(est) > 0.2::DOUBLE THEN 'magnitude_uncertain' WHEN rmse <= 0.05::DOUBLE AND par AND abs(did - est) / abs(est) <= 0.5::DOUBLE THEN 'trusted' ELSE 'directionally_trusted' END AS state FROM (SELECT n, est::DOUBLE AS est, low::DOUBLE AS low, p::DOUBLE AS p, rmse::DOUBLE AS rmse, slo::DOUBLE AS slo, shi::DOUBLE AS shi, did::DOUBLE AS did, par FROM (VALUES {_TRUST_ROWS}) v(n, est, low, p, rmse, slo, shi, did, par))")
def trust_state(spark, sf_dir):
    rows = spark.createDataFrame([(n, *row) for n, row in enumerate(_TRUST)], "n int, est double, low double, p double, rmse double, slo double, shi double, did double, par boolean")
    return rows.select("n", decide.trust(*[F.col(c) for c in ("est", "low", "p", "rmse", "slo", "shi", "did", "par")]).alias("state"))
