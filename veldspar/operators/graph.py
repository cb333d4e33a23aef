"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldspar.storage import stage

#: Links for each file of a staged table: small tables aren't spread over as many files as there are partitions.
LINKS_A_FILE = 1 << 16


def joined_back(rows: DataFrame, key: str, sums: DataFrame, sums_key: str, how: str = "inner", files: int | None = None) -> DataFrame:
    """``rows`` with what was summed up by their own key. A join straight on an aggregate runs in the aggregate's
    stage, where all rows of a key meet in one task; from a staged table both sides are shuffled for the join alone,
    and Spark deals a hot key's rows to several tasks. ``files`` bounds the files of that table."""
    return rows.join(stage(sums.coalesce(files) if files else sums, "sums"), F.col(key) == F.col(sums_key), how).drop(sums_key)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _to_least(pairs: DataFrame, files: int) -> DataFrame:
    """Each row (at, to) with the least of ``at`` and all its ``to``. Minima are taken before the shuffle, so a hub
    costs one row a task; they are staged, so that the join back shuffles both sides anew and Spark can split it
    where a hub is large."""
    least = pairs.groupBy(F.col("at").alias("_at")).agg(F.min("to").alias("_to"))
    return joined_back(pairs, "at", least, "_at", files=files).select("at", "to", F.least("at", "_to").alias("least"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component) for every node of ``edges``; component is the least node reachable.

    Large-star and small-star rounds, each a grouped minimum and a join; the state is written to the shared
    folder after each round. Nulls and self loops are left out; a node without any other link isn't returned.
    Rounds grow with the logarithm of the longest chain.
    """
    now = stage(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col("a").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        files = -(-mark[0] // LINKS_A_FILE)
        both = now.select(F.col("a").alias("at"), F.col("b").alias("to")).unionByName(now.select(F.col("b").alias("at"), F.col("a").alias("to")))
        large = _to_least(both, files).where(F.col("to") > F.col("at")).select(F.col("to").alias("at"), F.col("least").alias("to")).distinct()
        small = _to_least(large, files)
        then = small.select(F.col("to").alias("a"), F.col("least").alias("b")).unionByName(small.select(F.col("at").alias("a"), F.col("least").alias("b")))
        now = stage(then.where("a != b").distinct().coalesce(files), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
