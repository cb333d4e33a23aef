"""Scores to decisions: ranking, abstention, evaluation and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldspar.storage import stage


#: Labels of one study. Beyond, scores for each query and label would be the wrong table.
MAX_LABELS = 10_000


def label_names(vocabulary: DataFrame) -> list[str]:
    """The labels, in order; a ValueError where there are more than MAX_LABELS, as none may be left out."""
    names = sorted(r[0] for r in vocabulary.distinct().limit(MAX_LABELS + 1).collect())
    if len(names) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return names


def knn_scores(neighbours: DataFrame, labels: DataFrame, vocabulary: DataFrame, k: int, squared: bool = False) -> DataFrame:
    """(query, persona, score): the share of the k nearest's weight, max(similarity, 0), that has the label.

    ``neighbours``: (query, id, similarity, rank); ``labels``: (id, persona); ``vocabulary``: (persona), of MAX_LABELS
    at most, as each query has a row for each label. A query whose weights sum to zero scores 0 throughout. The
    neighbours are staged, as they are summed up with and without their labels, and finding them is what costs.
    """
    names = label_names(vocabulary)
    near = stage(neighbours.where(F.col("rank") <= k).select("query", "id", "similarity"), "near").withColumn("w", F.greatest("similarity", F.lit(0.0)))
    near = near.withColumn("w", F.col("w") * F.col("w")) if squared else near
    total = near.groupBy("query").agg(F.sum("w").alias("total"))
    votes = near.join(labels, "id").groupBy("query", "persona").agg(F.sum("w").alias("w"))
    full = total.withColumn("persona", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    return full.join(votes, ["query", "persona"], "left").select("query", "persona", F.when(F.col("total") > 0, F.coalesce("w", F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("score"))


def knn_grid(neighbours: DataFrame, labels: DataFrame, vocabulary: DataFrame, ks: list[int], powers: list[int]) -> DataFrame:
    """(k, power, query, persona, score): ``knn_scores`` for each k and each power of the weight, from one retrieval of
    the largest k, which is staged, and one pass over it."""
    names = label_names(vocabulary)
    settings = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("power")) for k in ks for p in powers]), lambda x: x["k"] >= F.col("rank")))
    near = stage(neighbours.where(F.col("rank") <= max(ks)).select("query", "id", "similarity", "rank"), "near").withColumn("_s", settings).select("query", "id", "_s.k", "_s.power", F.pow(F.greatest("similarity", F.lit(0.0)), F.col("_s.power")).alias("w"))
    total = near.groupBy("k", "power", "query").agg(F.sum("w").alias("total")).withColumn("persona", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    votes = near.join(labels, "id").groupBy("k", "power", "query", "persona").agg(F.sum("w").alias("w"))
    score = F.when(F.col("total") > 0, F.coalesce("w", F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return total.join(votes, ["k", "power", "query", "persona"], "left").select("k", "power", "query", "persona", score.alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "persona")))


def margins(scores: DataFrame) -> DataFrame:
    """(query, top, second, margin); second is 0 where there is one label only."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return ranked(scores).groupBy("query").agg(at(1).alias("top"), F.coalesce(at(2), F.lit(0.0)).alias("second")).withColumn("margin", F.col("top") - F.col("second"))


def decision(top: Column, margin: Column, suggest: Column | float = 0.75, caution: Column | float = 0.60, least_margin: Column | float = 0.05) -> Column:
    """A strong score with a small margin falls through to caution."""
    return F.when((top >= suggest) & (margin >= least_margin), "suggest").when(top >= caution, "suggest_with_caution").otherwise("abstain")


def abstain(scores: DataFrame, suggest: float = 0.75, caution: float = 0.60, least_margin: float = 0.05, most: int = 3) -> DataFrame:
    """(query, decision, confidence, personas) for scores (query, persona, score)."""
    best = ranked(scores).where(F.col("rank") <= most)
    firsts = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "persona", "score"))).alias("best"))
    top = F.col("best")[0]["score"]
    second = F.coalesce(F.get("best", F.lit(1))["score"], F.lit(0.0))
    made = firsts.withColumn("decision", decision(top, top - second, suggest, caution, least_margin))
    names = F.transform(F.filter("best", lambda b: b["score"] >= suggest), lambda b: b["persona"])
    picked = F.when(F.col("decision") == "suggest", names).when(F.col("decision") == "suggest_with_caution", F.array(F.col("best")[0]["persona"])).otherwise(F.array().cast("array<string>"))
    return made.select("query", "decision", top.alias("confidence"), picked.alias("personas"))


def summary(decisions: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(F.count(F.lit(1)).alias("total"), n("suggest").alias("suggest"), n("suggest_with_caution").alias("caution"), n("abstain").alias("abstain")).withColumn(
        "coverage", F.when(F.col("total") > 0, (F.col("suggest") + F.col("caution")) / F.col("total")).otherwise(0.0)
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counts(judged: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn of columns predicted and actual (0 or 1), with precision, recall and f1; 0 over 0 is 0."""
    p, a = F.col("predicted") == 1, F.col("actual") == 1
    out = judged.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def multilabel(judged: DataFrame, *by: str) -> DataFrame:
    """Macro, micro and weighted F1, Hamming loss and subset accuracy of (query, persona, predicted, actual), which is
    staged, as it is summed up by label and by query."""
    judged = stage(judged.select(*by, "query", "persona", "predicted", "actual"), "judged")
    per = counts(judged, *by, "persona")
    support = F.col("tp") + F.col("fn")
    s = lambda c: F.sum(c)
    labels = per.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        ratio(2 * s("tp"), 2 * s("tp") + s("fp") + s("fn")).alias("micro_f1"),
        ratio(s(F.col("f1") * support), s(support)).alias("weighted_f1"),
        ((s("fp") + s("fn")) / (s("tp") + s("fp") + s("fn") + s("tn"))).alias("hamming"),
    )
    whole = judged.groupBy(*by, "query").agg(F.min((F.col("predicted") == F.col("actual")).cast("int")).alias("same")).groupBy(*by).agg(F.avg("same").alias("subset_accuracy"))
    return labels.join(whole, list(by)) if by else labels.crossJoin(whole)


def trust(estimate: Column, low: Column, p: Column, relative_rmse: Column, sens_low: Column, sens_high: Column, did: Column, parallel: Column) -> Column:
    """How far an effect can be trusted, by direction, magnitude and design, in this order."""
    direction = (estimate > 0) & (low > 0) & (p < 0.10) & (sens_low > 0)
    return (
        F.when(~direction, "not_trusted")
        .when((sens_high - sens_low) / F.abs(estimate) > 0.20, "magnitude_uncertain")
        .when((relative_rmse <= 0.05) & parallel & (F.abs(did - estimate) / F.abs(estimate) <= 0.50), "trusted")
        .otherwise("directionally_trusted")
    )
