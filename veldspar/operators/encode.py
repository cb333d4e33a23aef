"""Encoders and language models that the caller brings, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veldspar.functions.text import parse_rationale, unit, unsupported_ids


def encoded(items: DataFrame, column: str, encoder: Callable[[], Callable[[list], np.ndarray]], id_col: str = "id", batch: int = 32) -> DataFrame:
    """(id, vector): unit vectors that the caller's model gives for ``column``. ``encoder`` is called once a task and
    gives a function from a list of at most ``batch`` values to as many rows of numbers. Nulls have no vector."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        model = encoder()
        for pdf in batches:
            pdf = pdf[pdf["value"].notna()]
            for low in range(0, len(pdf), batch):
                part = pdf.iloc[low : low + batch]
                vectors = np.asarray(model(part["value"].to_list()), dtype=float)
                if vectors.ndim != 2 or len(vectors) != len(part):
                    raise ValueError("an encoder gives a vector for each value")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": list(vectors)})

    found = items.select(F.col(id_col).alias("id"), F.col(column).alias("value")).mapInPandas(run, f"id {kind}, vector array<double>")
    return found.select("id", unit(F.col("vector")).alias("vector"))


def answered(asked: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``asked`` (prompt, fallback, allowed, ...) with rationale and source: what the caller's language model answers,
    or the fallback where the call fails, the answer isn't the JSON that was asked for, or it names an item that
    isn't among the ``allowed``. source is llm or template."""

    def run(batches):
        for pdf in batches:
            answers = []
            for text in pdf["prompt"]:
                try:
                    answers.append(call(text))
                except Exception:  # a failing service costs its answer only
                    answers.append(None)
            yield pdf.assign(_answer=pd.Series(answers, index=pdf.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    told = asked.mapInPandas(run, f"{schema}, _answer string").withColumn("_said", parse_rationale(F.col("_answer")))
    good = F.col("_said").isNotNull() & (F.size(unsupported_ids(F.col("_said"), F.col("allowed"))) == 0)
    return told.select(*asked.columns, F.when(good, F.col("_said")).otherwise(F.col("fallback")).alias("rationale"), F.when(good, "llm").otherwise("template").alias("source"))
