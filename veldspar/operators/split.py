"""Splits that keep clusters whole."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

#: Ranges of hashes in which clusters are counted to find where a split ends.
BINS = 4096


def sized_split(rows: DataFrame, dev: float = 0.15, test: float = 0.15, seed: int = 42, cluster: str = "cluster_id") -> DataFrame:
    """``rows`` with column split: test, dev or train, no cluster in two. Of n clusters, ceil(test n) are test, of the
    rest ceil(dev n) are dev: those of least hash under the seed, so that shares are right however few there are.

    Clusters are counted in BINS ranges of their hash; only in the two ranges where a split ends are they ranked.
    """
    if not (0 < dev < 1 and 0 < test < 1 and dev + test < 1):
        raise ValueError("shares must be positive and leave some for training")
    names = rows.select(F.col(cluster).alias("_cluster")).distinct().withColumn("_h", F.xxhash64("_cluster", F.lit(seed)))
    names = names.withColumn("_bin", F.pmod(F.shiftright("_h", 40), F.lit(BINS)).cast("int"))
    counts = {r["_bin"]: r["count"] for r in names.groupBy("_bin").count().collect()}  # BINS rows at most
    total = sum(counts.values())
    ends = [ceil(test * total), ceil(test * total) + ceil(dev * total)]
    before, cuts = 0, []
    for b in range(BINS):
        n = counts.get(b, 0)
        cuts += [(b, end - before) for end in ends if before < end <= before + n]
        before += n
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", "_cluster"))
    edge = sorted({b for b, _ in cuts})
    inner = names.where(F.col("_bin").isin(edge)).withColumn("_rank", rank) if edge else names.where("false").withColumn("_rank", F.lit(0))
    outer = names.where(~F.col("_bin").isin(edge)).withColumn("_rank", F.lit(1)) if edge else names.withColumn("_rank", F.lit(1))
    inside = lambda cut: (F.col("_bin") < cut[0]) | ((F.col("_bin") == cut[0]) & (F.col("_rank") <= cut[1]))
    part = F.lit("train") if len(cuts) < 2 else F.when(inside(cuts[0]), "test").when(inside(cuts[1]), "dev").otherwise("train")
    dealt = inner.unionByName(outer).select("_cluster", part.alias("split"))
    return rows.join(dealt, F.col(cluster) == F.col("_cluster")).drop("_cluster")


def leakage(rows: DataFrame, cluster: str = "cluster_id", split: str = "split") -> DataFrame:
    """(cluster, splits): clusters in more than one split, each with how many."""
    return rows.groupBy(cluster).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
