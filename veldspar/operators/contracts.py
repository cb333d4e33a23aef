"""Joins that hold to what is expected of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def faults(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: keys that stand more than once on either side, and left rows that no right key matches. Both sides are
    counted by key before they meet."""
    count = lambda df, name: df.groupBy(on).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "l").join(count(right, "r"), on, "full")
    return both.agg(F.count_if(F.col("l") > 1).alias("repeated_left"), F.count_if(F.col("r") > 1).alias("repeated_right"), F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("l"))), F.lit(0)).alias("unmatched"))


def _refuse(left: DataFrame, right: DataFrame, on: str, kinds: tuple[str, ...]) -> None:
    found = faults(left, right, on).first()
    if wrong := [f"{k} {found[k]}" for k in kinds if found[k]]:
        raise ValueError(f"join on {on}: " + ", ".join(wrong))


def one_to_one(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The join, once each key is seen to stand once on each side; a ValueError otherwise."""
    _refuse(left, right, on, ("repeated_left", "repeated_right"))
    return left.join(right, on, how)


def complete(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A one-to-one join in which each left row finds its partner; a ValueError otherwise."""
    _refuse(left, right, on, ("repeated_left", "repeated_right", "unmatched"))
    return left.join(right, on)


def known(rows: DataFrame, columns: list[str], ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` if all that stands in ``columns`` is among the ids; a ValueError otherwise."""
    asked = rows.select(F.explode(F.array(*columns)).alias("_id"))
    unknown = asked.join(ids.select(F.col(id_col).alias("_known")), F.col("_id") == F.col("_known"), "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} unknown ids")
    return rows
