"""Labels for items, with evidence: the command line over a saved model, and the command that saves one."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veldspar.functions import text as T
from veldspar.operators import decide as D, encode, logistic as L, vectors as V
from veldspar.sources import tables
from veldspar.storage import stage

SUGGEST, CAUTION, MARGIN, NEAR = 0.75, 0.60, 0.05, 0.88
_NO_PROOF = "array<struct<id: string, similarity: double, near_duplicate: boolean, confirmed: array<string>>>"


def train(vectors: DataFrame, confirmed: DataFrame, folder: str, c: float = 30.0) -> None:
    """Fit a model of each label on the confirmed items, ``vectors`` (id, vector) and ``confirmed`` (id, persona), and
    save it with its penalty and the labels' order."""
    names = D.label_names(confirmed.select("persona"))
    labelled = vectors.join(confirmed.select("id").distinct(), "id", "left_semi")
    L.save(L.fit(labelled, confirmed, names, c), folder, {"c": c, "labels": names})


def records(asked: DataFrame, reference: DataFrame, confirmed: DataFrame, scores: DataFrame, k: int = 3, candidates: int = 20, most: int = 3, call: Callable[[str], str] | None = None) -> DataFrame:
    """A record for each of ``asked`` (id, vector): query, decision, confidence, personas, evidence, rationales.

    ``scores``: (query, persona, score). Evidence for a label are the first ``k`` of the ``candidates`` nearest
    reference items but itself that have it confirmed; an item that stands for several labels is listed once. A
    rationale and its source stand for each label; ``call`` is the caller's language model, if there is one.
    """
    asked = stage(asked, "asked")  # for it may come from the reference's own plan
    near = stage(V.top_k(asked, reference.join(confirmed.select("id").distinct(), "id", "left_semi"), candidates), "near")
    made = stage(D.abstain(scores, SUGGEST, CAUTION, MARGIN, most), "decisions")
    picked = made.select("query", F.posexplode("personas").alias("place", "persona")).join(scores, ["query", "persona"])
    all_labels = confirmed.groupBy("id").agg(F.sort_array(F.collect_set("persona")).alias("confirmed"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query", "persona").orderBy("rank"))
    proof = near.join(confirmed, "id").join(picked.select("query", "persona"), ["query", "persona"], "left_semi").withColumn("_n", place).where(F.col("_n") <= k).join(all_labels, "id")
    item = F.struct(F.col("id").cast("string").alias("id"), F.round("similarity", 4).alias("similarity"), (F.col("similarity") >= NEAR).alias("near_duplicate"), "confirmed")
    listed = lambda by: proof.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("evidence"))
    none = F.array().cast(_NO_PROOF)
    per = picked.join(listed(["query", "persona"]), ["query", "persona"], "left").withColumn("evidence", F.coalesce("evidence", none))
    told = per.select("query", "place", "persona", F.round("score", 4).alias("score"), T.prompt(F.col("persona"), F.col("score"), F.col("evidence")).alias("prompt"), T.rationale(F.col("persona"), F.col("evidence")).alias("fallback"), F.transform("evidence", lambda e: e["id"]).alias("allowed"))
    told = encode.answered(told, call) if call else told.withColumns({"rationale": F.col("fallback"), "source": F.lit("template")})
    row = F.struct("place", F.col("persona").alias("name"), "score", "rationale", "source")
    personas = told.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"), x["rationale"].alias("rationale"), x["source"].alias("source"))).alias("labels"))
    level = F.when(F.col("decision") == "suggest", "high").when(F.col("decision") == "suggest_with_caution", "medium").otherwise("low")
    out = made.drop("personas").join(personas, "query", "left").join(listed(["query"]), "query", "left")
    return out.select("query", "decision", level.alias("confidence"), F.coalesce("labels", F.array().cast(personas.schema["labels"].dataType)).alias("personas"), F.coalesce("evidence", none).alias("evidence"))


def main(args: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="python -m veldspar.plans.suggest", description=__doc__)
    options.add_argument("command", choices=["train", "suggest"])
    options.add_argument("--vectors", required=True, help="Parquet: id, vector")
    options.add_argument("--labels", required=True, help="CSV or Parquet: creative_id, personas, confirmed_by, confirmed_at")
    options.add_argument("--model", required=True, help="folder of the model")
    options.add_argument("--id", help="the item to suggest labels for")
    options.add_argument("--penalty", type=float, default=30.0)
    given = options.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    table = spark.read.parquet(given.vectors)
    vectors = V.normalized(table.withColumn("id", F.col("id").cast("string")), "id", "vector")
    told = tables.read(spark, given.labels, tables.LABELS)
    confirmed = told.select(F.col("creative_id").alias("id"), F.explode(T.parse_labels(F.col("personas"))).alias("persona")).distinct()
    if given.command == "train":
        train(vectors, confirmed, given.model, given.penalty)
        return
    if given.id is None:
        options.error("--id is needed")
    asked = vectors.where(F.col("id") == given.id)
    if asked.isEmpty():
        raise ValueError(f"unknown item: {given.id}")
    models, _ = L.load(spark, given.model)
    found = records(asked, vectors, confirmed, L.scores(asked, models))
    print(json.dumps(json.loads(found.select(F.to_json(F.struct(*found.columns))).first()[0]), indent=2))


if __name__ == "__main__":
    main()
