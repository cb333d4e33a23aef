"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veldspar.storage import stage

#: Vectors that one block of the exact search holds, and queries.
TILE, QUERIES = 2048, 512
#: Index rows that one group holds, about; larger groups are cut into tiles.
GROUP = 1 << 16
#: Queries on which near distances and the number of visits are measured, against all vectors.
FIT_QUERIES = 64
#: Tables, vectors that a cell is meant to hold, cells that a query visits in a table at most, and the share of true
#: neighbours that must then be met on the measured queries; cells are widened until it is.
TABLES, PER_CELL, VISITS, TARGET = 8, 24, 768, 0.94
#: Directions of a code, at most.
CODE = 128


def rotations(dim: int, columns: int, rng: np.random.Generator) -> np.ndarray:
    """Gaussian directions, orthogonal within each ``dim`` of them, of length sqrt(dim): a difference of length r is
    r times a standard normal number on each, roughly."""
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-columns // dim))]
    return np.concatenate(blocks, axis=1)[:, :columns] * math.sqrt(dim)


class Hashes:
    """``tables`` times ``width`` projections on Gaussian directions, cut into cells of ``cell`` with random offsets.

    For a query, the difference to a neighbour at distance ``near`` is Gaussian on each direction, so each cell has
    a probability of holding it; those of a bucket's cells multiply, and buckets are visited in that order. A bucket
    is named by its cells' sum under random odd multipliers; its group by the same of the first ``coarse`` cells.
    """

    def __init__(self, dim: int, tables: int = TABLES, width: int = 8, cell: float = 2.0, near: float = 1.0, coarse: int = 0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables, self.width, self.cell, self.near, self.coarse = tables, width, cell, near, coarse
        self.directions = rotations(dim, tables * width, rng)
        self.offsets = rng.uniform(0, cell, tables * width)
        self.odd = rng.integers(1, 1 << 62, tables * width) * 2 + 1
        self.salt = rng.integers(1, 1 << 62, tables)

    def places(self, x: np.ndarray) -> np.ndarray:
        """(row, table, projection) in units of a cell."""
        return ((x @ self.directions + self.offsets) / self.cell).reshape(len(x), self.tables, self.width)

    def _named(self, cells: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        part = cells * self.odd[t * self.width : (t + 1) * self.width]
        return self.salt[t] + part[:, : self.coarse].sum(axis=1), self.salt[t] + part.sum(axis=1)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups and buckets, (row, table) each."""
        cells = np.floor(self.places(x)).astype(np.int64)
        both = [self._named(cells[:, t], t) for t in range(self.tables)]
        return np.stack([g for g, _ in both], axis=1), np.stack([b for _, b in both], axis=1)

    def probes(self, queries: np.ndarray, visits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table the groups and buckets to visit, (query, visit) each, likeliest first."""
        spread, rows = max(self.near, 1e-9) / self.cell, np.arange(len(queries))[:, None]
        for t, place in enumerate(self.places(queries).transpose(1, 0, 2)):
            chance = np.zeros((len(queries), 1))
            group = np.full((len(queries), 1), self.salt[t])
            bucket = group.copy()
            for j in range(self.width):
                cells = np.floor(place[:, j : j + 1]).astype(np.int64) + np.arange(-1, 2)
                p = np.diff(_normal((np.concatenate([cells, cells[:, -1:] + 1], axis=1) - place[:, j : j + 1]) / spread), axis=1)
                part, p = cells * self.odd[t * self.width + j], np.log(np.maximum(p, 1e-300))
                chance = (chance[:, :, None] + p[:, None, :]).reshape(len(queries), -1)
                bucket = (bucket[:, :, None] + part[:, None, :]).reshape(len(queries), -1)
                group = np.repeat(group, 3, axis=1) if j >= self.coarse else (group[:, :, None] + part[:, None, :]).reshape(len(queries), -1)
                if chance.shape[1] > visits:  # a bucket is among the likeliest only if its first cells are
                    best = np.argpartition(-chance, visits - 1, axis=1)[:, :visits]
                    chance, bucket, group = chance[rows, best], bucket[rows, best], group[rows, best]
            order = np.argsort(-chance, axis=1, kind="stable")[:, :visits]
            yield group[rows, order], bucket[rows, order]


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, within 1e-5."""
    t = 1 / (1 + 0.33267 * np.abs(x))
    tail = np.exp(-x * x / 2) * t * (0.4361836 + t * (-0.1201676 + t * 0.937298)) / math.sqrt(2 * math.pi)
    return np.where(x >= 0, 1 - tail, tail)


class Codes:
    """A byte for each of some orthogonal directions: bounds of the distance between a query and a coded vector.

    The projection never lengthens a difference, what it loses is at least the difference and at most the sum of
    the two lengths left out, and the rounding error's length is kept with each code. So both bounds are certain.
    """

    def __init__(self, dim: int, largest: float, seed: int = 11):
        self.basis = rotations(dim, min(dim, CODE), np.random.default_rng(seed)) / math.sqrt(dim)
        self.step, self.slack = max(largest, 1e-300) / 127, 2e-3 * max(largest, 1e-300)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and the length of what they leave out."""
        y = x @ self.basis
        return y, np.sqrt(np.maximum(0, (x * x).sum(axis=1) - (y * y).sum(axis=1))) if self.basis.shape[1] < len(self.basis) else np.zeros(len(x))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the length of the rounding error, the length left out."""
        y, rest = self.split(x)
        code = np.clip(np.rint(y / self.step), -127, 127)
        return code.astype(np.int8), np.sqrt(((y - code * self.step) ** 2).sum(axis=1)), rest

    def bounds(self, y: np.ndarray, rest: float, code: np.ndarray, off: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((code.astype(np.float32) * np.float32(self.step) - y.astype(np.float32)) ** 2).sum(axis=1)).astype(float)
        slack = self.slack * 1e-2 + 1e-5 * d
        return np.hypot(np.maximum(0, d - off - slack), rest - left), np.hypot(d + off + slack, rest + left)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Vectors that take part: not null, with finite components only, not all of them zero, of the given size."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good & (F.size(vector) == dim) if dim else good, F.lit(False))


def nearest(query: np.ndarray, query_id: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of ``vectors`` but the query's own: ids and distances, ties to the smaller id."""
    d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    d[ids == query_id] = np.inf
    at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > 4 * k else np.arange(len(d))
    at = at[np.lexsort((ids[at], d[at]))]
    at = at[np.isfinite(d[at])][:k]
    return ids[at], d[at]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """By brute force: all (vec_id, vector) against all (query_id, vector), in blocks of each; for queries that the
    index leaves short and to measure it. Repeated ids within one block may each take a place of its k."""
    sizes = {"q": max(1, -(-queries.count() // QUERIES)), "v": max(1, -(-vectors.count() // TILE))}
    block = lambda rows, own, other, member: rows.withColumn(f"{own}_tile", F.pmod(F.xxhash64(member), F.lit(sizes[own])).cast("int")).withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0), F.lit(sizes[other] - 1))))
    q, v = block(queries, "q", "v", "query_id"), block(vectors, "v", "q", "vec_id")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, held = right["vec_id"].to_numpy(), np.stack(right["vector"].to_list()).astype(float)
            for asked, v in zip(left["query_id"], left["vector"], strict=True):
                found, d = nearest(np.asarray(v, dtype=float), asked, ids, held, k)
                out.append(pd.DataFrame({"query_id": asked, "vec_id": found, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return _best(q.groupBy("q_tile", "v_tile").cogroup(v.groupBy("q_tile", "v_tile")).applyInPandas(run, "query_id long, vec_id long, score double"), k)


def _classes(clean: DataFrame, k: int) -> DataFrame:
    """(class, vector, ids): distinct vectors, each with the k + 1 smallest of its ids, all that can be among k
    nearest. Each task sends no more of a vector's ids than that."""
    ranked = clean.withColumn("_h", F.xxhash64("vector")).withColumn("_r", F.dense_rank().over(Window.partitionBy("_h", "vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    held = ranked.groupBy("_h", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return stage(held.select("vector", "ids"), "vectors").withColumn("class", F.monotonically_increasing_id())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _measured(classes: DataFrame, sample: np.ndarray, ids: np.ndarray, dim: int, k: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """For each sampled query its k nearest of all vectors, and their distances; the largest component found. One
    pass over the vectors; a task gives its own k nearest of each query."""

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, dim)))] * len(sample)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(0), dim), batch.column(1).to_pylist()
            for q, v in enumerate(sample):
                d = np.sqrt(np.maximum(0, ((x - v) ** 2).sum(axis=1)))
                d[[len(i) == 1 and i[0] == ids[q] for i in own] if (d == 0).any() else []] = np.inf
                d, y = np.concatenate([best[q][0], d]), np.concatenate([best[q][1], x])
                top = np.argsort(d, kind="stable")[:k]
                best[q] = (d[top], y[top])
        rows = [(q, float(a), b.tolist()) for q, (d, y) in enumerate(best) for a, b in zip(d, y, strict=True) if np.isfinite(a)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["q", "d", "v"])

    found = classes.select("vector", "ids").mapInArrow(run, "q int, d double, v array<double>")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))).where(F.col("r") <= k).collect()  # FIT_QUERIES x k rows at most
    by: list[list] = [[] for _ in sample]
    for row in top:
        by[row.q].append((row.d, row.v))
    return [np.array([v for _, v in sorted(b)]).reshape(-1, dim) for b in by], np.array([d for b in by for d, _ in b]), float(np.abs(sample).max(initial=0.0))


def fitted(rows: int, sample: np.ndarray, near: list[np.ndarray], distances: np.ndarray, dim: int, tables: int = TABLES, per_cell: int = PER_CELL, visits: int = VISITS, target: float = TARGET) -> tuple[Hashes, int]:
    """An index for ``rows`` vectors and the visits a query makes in each table.

    Cells are as wide as twice the distance of a usual neighbour, and so many projections make a bucket that it holds
    ``per_cell`` vectors by chance: a table's width grows with the logarithm of the rows. The visits are the fewest
    with which ``target`` of the true neighbours of the sampled queries is met; where more than ``visits`` were
    needed, a projection is taken away and it's tried again.
    """
    usual = float(np.median(distances[distances > 0])) if (distances > 0).any() else 1.0
    apart = np.sqrt(np.maximum(0, ((sample[:, None] - sample[None]) ** 2).sum(-1)))
    far = float(np.median(apart[apart > 0])) if (apart > 0).any() else usual
    ratio = 2 * usual / max(far, usual)
    same = 2 * _normal(np.array([ratio]))[0] - 1 - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))
    bits = max(0.05, -math.log2(max(1e-9, same)))
    width = int(min(32, max(1, math.log2(max(2.0, rows / per_cell)) / bits)))
    while True:
        coarse = min(width, max(0, math.ceil(math.log2(max(1.0, rows / GROUP)) / bits)))
        hashes = Hashes(dim, tables, width, 2 * usual, usual, coarse)
        if width == 1 or not sum(map(len, near)):
            return hashes, visits
        first = np.full((sum(map(len, near)), tables), visits)
        owner = np.repeat(np.arange(len(near)), [len(n) for n in near])
        _, at = hashes.buckets(np.concatenate(near))
        for t, (_, probed) in enumerate(hashes.probes(sample, visits)):
            hit = probed[owner] == at[:, t : t + 1]
            first[:, t] = np.where(hit.any(axis=1), hit.argmax(axis=1), 1 << 30)
        needed = np.sort(first.min(axis=1))[min(len(first) - 1, math.ceil(target * len(first)) - 1)]
        if needed < visits:
            return hashes, int(needed) + 1
        width -= 1


def _tiled(rows: DataFrame, size: int, member: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their tile within a group, and how many tiles a group has where that is more than one."""
    many = stage(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("tiles")).where("tiles > 1"), "tiles").withColumnRenamed("group", "_group")
    return rows.join(many, F.col("group") == F.col("_group"), "left").withColumn("tile", F.pmod(F.xxhash64(member, F.lit(5)), F.coalesce("tiles", F.lit(1))).cast("int")).drop("_group", "tiles"), many


def candidates(classes: DataFrame, asked: DataFrame, dim: int, hashes: Hashes, codes: Codes, visits: int, k: int) -> DataFrame:
    """(query_id, class, low, high, visited): for each group a query has visits in, the vectors in the visited
    buckets whose lower bound isn't above the (k + 1)th upper bound there, and how many were visited in all.

    What is shuffled is a row for each vector and table, with a code in place of the vector, and a row for each
    query, table and group.
    """

    def filed(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                (group, bucket), (code, off, left) = hashes.buckets(x), codes.coded(x)
                raw = pa.array([c.tobytes() for c in code], pa.binary())
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(group[:, t]), pa.array(bucket[:, t]), batch.column(0), raw, pa.array(off), pa.array(left)], names=["group", "bucket", "class", "code", "off", "left"])

    def visiting(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                x, ids = _matrix(part.column(1), dim), part.column(0).to_pylist()
                y, rest = codes.split(x)
                rows = []
                for groups, buckets in hashes.probes(x, visits):
                    for i, (g, b) in enumerate(zip(groups, buckets, strict=True)):
                        order = np.argsort(g, kind="stable")
                        starts = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0]))
                        rows += [(int(g[p[0]]), ids[i], np.sort(b[p]), y[i].tobytes(), float(rest[i])) for p in np.split(order, starts[1:])]
                cells = list(zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, cells[2])]).astype(np.int32), pa.array(np.concatenate(cells[2])))
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), lists, pa.array(cells[3], pa.binary()), pa.array(cells[4], pa.float64())], names=["group", "query_id", "buckets", "y", "rest"])

    probes = stage(asked.select("query_id", "vector").mapInArrow(visiting, "group long, query_id long, buckets array<long>, y binary, rest double"), "probes")
    index = stage(classes.select("class", "vector").mapInArrow(filed, "group long, bucket long, class long, code binary, off double, left double").join(probes.select("group").distinct(), "group", "left_semi"), "index")
    tiled, many = _tiled(index, GROUP, "class")
    spread = probes.join(many, F.col("group") == F.col("_group"), "left").withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))).drop("_group", "tiles")
    asks = spread.groupBy("group", "tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERIES).select(F.col("group").alias("_g"), F.col("tile").alias("_t"), F.ceil(F.col("n") / QUERIES).cast("int").alias("parts"))
    asks = stage(asks, "asks")  # a group that very many queries visit is dealt to several tasks, its codes copied
    on = (F.col("group") == F.col("_g")) & (F.col("tile") == F.col("_t"))
    parts = F.coalesce("parts", F.lit(1))
    left = spread.join(asks, on, "left").withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int")).drop("_g", "_t", "parts")
    right = tiled.join(asks, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_g", "_t", "parts")

    def bounded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("bucket", kind="stable")
            bucket, names = right["bucket"].to_numpy(), right["class"].to_numpy()
            code = np.frombuffer(b"".join(right["code"]), dtype=np.int8).reshape(len(right), -1)
            off, rest = right["off"].to_numpy(), right["left"].to_numpy()
            for q, visited, y, r in zip(left["query_id"], left["buckets"], left["y"], left["rest"], strict=True):
                low, high = np.searchsorted(bucket, visited), np.searchsorted(bucket, visited, side="right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                if len(at):
                    a, b = codes.bounds(np.frombuffer(y), r, code[at], off[at], rest[at])
                    keep = np.flatnonzero(a <= np.partition(b, k)[k]) if len(b) > k else np.arange(len(b))
                    out.append(pd.DataFrame({"query_id": q, "class": names[at[keep]], "low": a[keep], "high": b[keep], "visited": [len(at), *[0] * (len(keep) - 1)]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "class": [], "low": [], "high": [], "visited": []}).astype({"query_id": "int64", "class": "int64", "visited": "int64"})

    group = ["group", "tile", "part"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(bounded, "query_id long, class long, low double, high double, visited long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", effort: bool = False, **kwargs) -> DataFrame:
    """Return query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors`` found, but
    its own, by Euclidean distance, nearest first, ties to the smaller id. With ``effort`` also visited and compared:
    code bounds worked out, and exact distances, for the query.

    Every distinct vector is in the index, in one bucket of each table, as a code of some bytes whose bounds on the
    distance are certain. A query's candidates of all tables are merged; those whose lower bound is above the
    (k + 1)th upper bound can't be among the k nearest, the others are compared exactly. The index's shape and the
    number of visits follow from the number of rows and from FIT_QUERIES queries whose true neighbours are found by
    one pass. A query with fewer than k found is searched by brute force.

    Vectors that are null, zero, hold null or non-finite components, or aren't as long as most, take no part; null
    ids neither. Rows with one id count as one, at its nearest. Equal vectors cost one row of the index. An empty
    table gives none. ``kwargs``: tables, per_cell, visits and target of ``fitted``.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    clean = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector")).where(usable(F.col("vector")))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast(kind).alias("vector")).where(usable(F.col("vector")))
    common = clean.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common.dim if common else 1
    clean, asked = clean.where(F.size("vector") == dim), stage(asked.where(F.size("vector") == dim).distinct(), "asked")
    classes = _classes(clean, k)
    sample = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).collect()
    points = np.array([r.vector for r in sample], dtype=float).reshape(-1, dim)
    near, distances, largest = _measured(classes, points, np.array([r.query_id for r in sample]), dim, k) if sample else ([], np.zeros(0), 1.0)
    hashes, visits = fitted(classes.count(), points, near, distances, dim, **kwargs)
    found = stage(candidates(classes, asked, dim, hashes, Codes(dim, largest), visits, k), "candidates")

    once = found.groupBy("query_id", "class").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("high", "class"))
    edge = F.min(F.when(F.col("_place") == k + 1, F.col("high"))).over(Window.partitionBy("query_id"))
    short = once.withColumn("_place", place).withColumn("_edge", edge).where(F.col("_edge").isNull() | (F.col("low") <= F.col("_edge"))).select("query_id", "class")
    a, b = F.col("vector").cast("array<double>"), F.col("_vector").cast("array<double>")
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = short.join(classes, "class").join(asked.withColumnRenamed("vector", "_vector"), "query_id").select("query_id", "ids", F.sqrt(square).alias("score"))
    first = stage(_best(pairs.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id"), k), "nearest")
    few = asked.join(first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id"), "query_id", "left_anti")
    if not few.isEmpty():
        few = stage(few, "short")
        held = classes.select(F.explode("ids").alias("vec_id"), "vector")
        first = first.join(few.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact(held, few, k))
    out = first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if not effort:
        return out
    done = found.groupBy("query_id").agg(F.sum("visited").alias("visited")).join(short.groupBy("query_id").agg(F.count(F.lit(1)).alias("compared")), "query_id")
    return out.join(done, "query_id", "left")
