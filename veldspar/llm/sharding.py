"""Shards that keep linked documents together, by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldspar.operators.graph import joined_back
from veldspar.storage import stage

#: Rows that one step of a ranking sorts together, about.
_CHUNK = 20_000


def numbered(df: DataFrame, by: list[str], order: str, rows: int, name: str = "number") -> DataFrame:
    """Number the rows of each group of columns ``by`` gaplessly from 0, though no task sorts a whole group: rows
    are dealt to chunks by a hash of ``order``, the chunks' counts are summed up, and each chunk numbers its own."""
    chunks = max(1, -(-rows // _CHUNK))
    split = df.withColumn("_chunk", F.pmod(F.xxhash64(order, F.lit(3)), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy(*by, "_chunk").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = split.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(order)) - 1)
    return within.join(counts, [*by, "_chunk"]).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_chunk", "_row", "_before")


def _plan(wishes: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many of the wished moves (from, to) are granted, and how many unlinked rows move back to make room, so
    that each shard's count stays as it is. Both tables have at most shards x shards numbers."""
    granted = dict(wishes)
    surplus = lambda s: sum(n for (a, b), n in granted.items() if b == s) - sum(n for (a, b), n in granted.items() if a == s)
    for _ in range(shards * shards):
        over = {s: surplus(s) - free.get(s, 0) for s in range(shards)}
        s = max(over, key=lambda x: (over[x], -x))
        if over[s] <= 0:
            break
        for (a, b), n in sorted(granted.items()):
            if b == s and over[s] > 0:
                cut = min(n, over[s])
                granted[a, b] -= cut
                over[s] -= cut
    gives, takes, back = {s: max(0, surplus(s)) for s in range(shards)}, {s: max(0, -surplus(s)) for s in range(shards)}, {}
    for a in range(shards):
        for b in range(shards):
            n = min(gives[a], takes[b])
            if n:
                back[a, b] = n
                gives[a] -= n
                takes[b] -= n
    return granted, back


def _lookup(table: dict[tuple[int, int], int], a: Column, b: Column) -> Column:
    out = F.lit(0)
    for (x, y), n in table.items():
        out = F.when((a == x) & (b == y), F.lit(n)).otherwise(out)
    return out


def propagate(nodes: DataFrame, shards: int, rounds: int = 4) -> DataFrame:
    """Assign nodes (id, link) to shards 0 to ``shards`` - 1, with counts at most one apart; returns id, link, shard.

    Nodes with the same link are linked; a null link links to nothing. The first shards come from the ids' hashes, so
    the same ids are dealt alike.
    In each round every linked node wishes to go to the shard where most of its neighbours are, of those shards
    that still have unlinked nodes to give; wishes are granted up to each shard's quota, and as many unlinked
    nodes go the other way. Only link, shard and their counts are shuffled, never pairs of neighbours: a hot link
    is one row a shard. A link with more nodes than a shard holds fills one shard, then the next.
    """
    spark, rows = nodes.sparkSession, nodes.count()
    linked = nodes.where("link is not null").groupBy("link").count().where("count > 1").select(F.col("link").alias("_link"))
    start = numbered(nodes.withColumn("_all", F.lit(0)), ["_all"], "id", rows)
    state = start.join(stage(linked, "links"), F.col("link") == F.col("_link"), "left").select("id", "link", F.col("_link").isNotNull().alias("linked"), F.pmod("number", F.lit(shards)).cast("int").alias("shard"))
    state = stage(state, "shards")
    full: set[int] = set()
    for _ in range(rounds):
        free = {r.shard: r["count"] for r in state.where("not linked").groupBy("shard").count().collect()}
        open_ = [s for s in range(shards) if s not in full]
        if not open_ or not rows:
            break
        counts = state.where("linked").groupBy("link", "shard").count()
        rank = F.struct(F.col("count"), F.xxhash64("link", "shard"), "shard")
        target = counts.where(F.col("shard").isin(open_)).groupBy("link").agg(F.max(rank).alias("best")).select(F.col("link").alias("_to"), F.col("best.shard").alias("target"))
        settled = F.col("shard").isin(sorted(full)) if full else F.lit(False)
        wish = joined_back(state, "link", target, "_to", "left").withColumn("target", F.when(F.col("linked") & ~settled & (F.col("target") != F.col("shard")), F.col("target")))
        wish = stage(wish.select("id", "link", "linked", "shard", "target"), "wishes")
        wishes = {(r.shard, r.target): r["count"] for r in wish.where("target is not null").groupBy("shard", "target").count().collect()}
        if not wishes:
            break
        granted, back = _plan(wishes, free, shards)
        ends = []  # unlinked rows of each shard are numbered; ranges of numbers go to the shards that gave
        for a in range(shards):
            low = 0
            for b in range(shards):
                if back.get((a, b)):
                    ends.append((a, b, low, low + back[a, b]))
                    low += back[a, b]
        movers = numbered(wish.where("target is not null"), ["shard", "target"], "id", rows)
        movers = movers.withColumn("shard", F.when(F.col("number") < _lookup(granted, F.col("shard"), F.col("target")), F.col("target")).otherwise(F.col("shard")))
        loose = numbered(wish.where("not linked"), ["shard"], "id", rows)
        to = F.col("shard")
        for a, b, low, high in ends:
            to = F.when((F.col("shard") == a) & (F.col("number") >= low) & (F.col("number") < high), F.lit(b)).otherwise(to)
        keep = ["id", "link", "linked", "shard"]
        state = stage(movers.select(keep).unionByName(loose.withColumn("shard", to).select(keep)).unionByName(wish.where("linked and target is null").select(keep)), "shards")
        refused = {b for (a, b), n in wishes.items() if granted[a, b] < n}
        full |= refused
        if not refused:
            break
    return state.select("id", "link", "shard")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4) -> DataFrame:
    """Return id_col, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Law ``rows``: counts are at most one apart. Linked are documents with equal texts; null texts count as empty
    for size and CRC and link to nothing, nor do empty ones. Rows with the same id are kept each. A row's first shard
    comes from its place in the staged input, so another split of the same files may deal it otherwise. size: UTF-8 bytes of the text plus 1; slot: a number in the shard, gapless from 0. grown_shard
    is null under this law. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("_doc"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.octet_length(text) > 0, F.sha1(text)).alias("link"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "sizes",
    )
    found = propagate(base.select("id", "link"), shards, rounds)
    placed = numbered(found, ["shard"], "id", base.count(), "slot")
    return base.join(placed.select(F.col("id").alias("_row"), "shard", "slot"), F.col("id") == F.col("_row")).select(
        F.col("_doc").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def cut_links(nodes: DataFrame) -> DataFrame:
    """(kept, cut): links between consecutive nodes of a link within a shard, and links that shards part."""
    per = nodes.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("parts"))
    return per.agg(F.sum(F.col("n") - F.col("parts")).alias("kept"), F.sum(F.col("parts") - 1).alias("cut"))
