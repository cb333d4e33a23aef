"""Near-copies of documents by the Jaccard similarity of their word shingles: SimHash clusters, compared exactly, and an
exact set join by prefixes for pairs that the fingerprints keep apart."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldspar.llm._buckets import by_group, dealt, forest, released, sorted_groups
from veldspar.llm._text import LOWER, U64, gram_hashes, mix, spans, word_hashes
from veldspar.llm.simhash import hamming_links, set_print
from veldspar.operators.graph import connected_components
from veldspar.storage import stage

#: Words of a shingle, and the least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints that differ in so many bits at most are linked.
DISTANCE = 8
#: Rows that are compared with a whole bucket at once, and cells of a table of shingles.
ROWS, CELLS = 1024, 1 << 20


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's different runs of ``n`` words, sorted; of all its words where it has fewer."""
    h = word_hashes(*spans((text or "").encode("utf-8", "surrogatepass").translate(LOWER)))
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else h


def set_name(values: np.ndarray) -> int:
    """A signed 64-bit name of the set; 0 is the empty set's."""
    return int((mix(values).sum(dtype=U64) + U64(len(values))).view(np.int64)) or 1 if len(values) else 0


def prefix(values: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """So many of the least hashes that two sets of at least the similarity share one of them: else the one whose
    prefix ends first would hold more hashes that the other lacks than the similarity allows."""
    return values[: len(values) - ceil(similarity * len(values) - 1e-9) + 1]


def sketch(values: np.ndarray) -> np.ndarray:
    """How many hashes fall into each of 2**bits equal ranges, four to eight on average; ranges of fewer bits are
    sums of neighbours. Two sets share no more than the sum of the lesser counts."""
    bits = max(1, (len(values) >> 3).bit_length())
    return np.minimum(np.bincount((values >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 0xFFFF).astype("<u2")


def maybe_near(sketches: list[np.ndarray], sizes: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs that the sketches, in the order of ``sizes``, let have the similarity."""
    ends = np.searchsorted(sizes, sizes / similarity + 1e-9, side="right")
    ranges = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    for n in np.unique(ranges).tolist():
        mine = np.flatnonzero(ranges == n)
        low, high = int(mine[0]), int(ends[mine[-1]])
        table = np.stack([s if len(s) == n else s.reshape(n, -1).sum(axis=1, dtype=np.uint32) for s in sketches[low:high]])
        for i in mine.tolist():
            most = np.minimum(table[i - low], table[i + 1 - low : ends[i] - low]).sum(axis=1, dtype=np.int64)
            j = np.flatnonzero(most * (1 + similarity) >= similarity * (sizes[i] + sizes[i + 1 : ends[i]]) - 1e-6) + i + 1
            if len(j):
                yield np.full(len(j), i), j


def near_pairs(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of all pairs with at least the similarity, some rows at a time: a product of the sets'
    0-1 rows over the shingles that two or more of them have."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    values, owner = values[shared], owner[shared]
    if not len(values):
        return
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    width, columns = max(1, CELLS // len(sets)), int(column[-1]) + 1
    for top in range(0, len(sets), ROWS):
        both = np.zeros((min(ROWS, len(sets) - top), len(sets)), dtype=np.float32)
        for low in range(0, columns, width):
            part = slice(*np.searchsorted(column, [low, low + width]))
            has = np.zeros((len(sets), min(width, columns - low)), dtype=np.float32)
            has[owner[part], column[part] - low] = 1
            both += has[top : top + ROWS] @ has.T
        for k in range(len(both)):
            i, n = top + k, both[k, top + k + 1 :].astype(np.int64)
            j = np.flatnonzero(n / (sizes[i] + sizes[i + 1 :] - n) >= similarity) + i + 1
            if len(j):
                yield np.full(len(j), i), j


def _buckets(similarity: float):
    """Members of groups of two or more, as (bucket, fp): buckets with the same members have one name. A group is
    cut where the next larger set is too large to be near any before it."""

    def run(batches):
        for table in sorted_groups(batches):
            group, fp, size = (table.column(c).to_numpy() for c in ("group", "fp", "size"))
            order = np.lexsort((fp, size, group))
            group, fp, size = group[order], fp[order], size[order]
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (fp[1:] != fp[:-1])
            group, fp, size = group[new], fp[new], size[new]
            first = np.ones(len(fp), dtype=bool)
            first[1:] = (group[1:] != group[:-1]) | (size[:-1] < similarity * size[1:] - 1e-9)
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(fp)))
            many = np.repeat(counts > 1, counts)
            if many.any():
                name = np.add.reduceat(mix(fp.view(U64)), starts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, counts)[many]), pa.array(fp[many])], names=["bucket", "fp"])

    return run


def _close(similarity: float):
    """Of each group those parts, as (bucket, fp), that the sketches don't tell from near copies, by pairs of
    different clusters: those of one are compared there."""

    def run(batches):
        for table in sorted_groups(batches, 1 << 10):
            group, fp, size, cluster, held = *(table.column(c).to_numpy() for c in ("group", "fp", "size", "cluster")), table.column("sketch")
            starts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(fp)]
            for low, high in zip(starts, starts[1:], strict=False):
                names, at = np.unique(fp[low:high], return_index=True)
                order = np.argsort(size[low + at], kind="stable")
                names, at = names[order], low + at[order]
                links, count = [], 0
                if (cluster[at] == cluster[at[0]]).all():
                    continue
                for i, j in maybe_near([np.frombuffer(held[int(k)].as_py(), dtype="<u2") for k in at], size[at].astype(np.int64), similarity):
                    apart = cluster[at[i]] != cluster[at[j]]
                    if not apart.any():
                        continue
                    links.append((names[i[apart]], names[j[apart]]))
                    count += int(apart.sum())
                    if count > 1 << 20:
                        links, count = [forest(*map(np.concatenate, zip(*links, strict=True)))], 0
                if links:
                    root, node = forest(*map(np.concatenate, zip(*links, strict=True)))
                    tops = np.unique(root)
                    member, part = np.concatenate([tops, node]), np.searchsorted(tops, np.concatenate([tops, root]))
                    name = np.zeros(len(tops), dtype=U64)
                    np.add.at(name, part, mix(member.view(U64)))
                    yield pa.RecordBatch.from_arrays([pa.array(name[part].view(np.int64)), pa.array(member)], names=["bucket", "fp"])

    return run


def _compared(similarity: float):
    def run(batches):
        for table in sorted_groups(batches, 1 << 10):
            group, fp, held = table.column("group").to_numpy(), table.column("fp").to_numpy(), table.column("shingles")
            starts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(fp)]
            links = []
            for low, high in zip(starts, starts[1:], strict=False):
                names, at = np.unique(fp[low:high], return_index=True)
                sets = [np.frombuffer(held[low + int(k)].as_py(), dtype=U64) for k in at]
                count = 0
                for i, j in near_pairs(sets, similarity):
                    links.append((names[i], names[j]))
                    count += len(i)
                    if count > 1 << 20:
                        links, count = [forest(*map(np.concatenate, zip(*links, strict=True)))], 0
            if links:
                a, b = forest(*map(np.concatenate, zip(*links, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    return run


def clustered(named: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``named`` with column ``cluster``: sets whose SimHash fingerprints, column ``print``, are reached over links of
    at most ``distance`` differing bits share one. Pigeonhole blocks find all such links."""
    roots = connected_components(hamming_links(named.where("size > 0").select(F.col("print").alias("fp")).distinct(), distance))
    return stage(named.join(roots, named.print == roots.node, "left").select(*named.columns, F.coalesce("component", "print").alias("cluster")), "clusters")


def within(named: DataFrame) -> DataFrame:
    """Groups (group, fp) in which each two sets of a cluster meet."""
    many = stage(named.where("size > 0").groupBy(F.col("cluster").alias("many")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many")
    members = named.where("size > 0").join(many, F.col("cluster") == F.col("many")).select("fp", "cluster")
    return dealt(members, "cluster", "fp").select("group", "fp")


def across(staged: DataFrame, named: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Groups (group, fp) in which each two sets of different clusters that have the similarity meet."""
    rows = staged.join(named.select("fp", F.col("least").alias("id")).hint("shuffle_hash"), ["fp", "id"], "left_semi")
    members = stage(by_group(dealt(rows.select("fp", "size", F.explode("keys").alias("key")), "key", "fp"), [], _buckets(similarity), "bucket long, fp long"), "members").distinct()

    # most buckets only share a passage: sketches, far smaller than the sets, tell those before sets are sent
    wanted = named.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("least").alias("id"), "cluster")
    sketched = staged.select("id", "fp", "size", "sketch").join(wanted, ["fp", "id"]).select("fp", "size", "sketch", "cluster")
    found = by_group(members.join(sketched, "fp").select(F.col("bucket").alias("group"), "fp", "size", "sketch", "cluster"), [], _close(similarity), "bucket long, fp long")
    return found.distinct().select(F.col("bucket").alias("group"), "fp")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, ngram: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Return (id_col, component_id) for each row: the smallest id reachable over pairs of texts whose sets of word
    shingles have at least the similarity.

    SimHash fingerprints of the sets give clusters, and all pairs of a cluster are compared by their sets. Pairs that
    have the similarity though their fingerprints are far apart come from a set join by prefixes, which leaves out
    the pairs of one cluster. No pair is missed but by a clash of 64-bit hashes. Texts without words (null, empty,
    white space) are copies of each other. Rows with a null id must not be given. Equal sets cost one row beyond the
    first table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keyed(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = [shingle_set(t.as_py(), ngram) for t in part.column(1)]
                keys = [prefix(s, similarity) if len(s) else s for s in sets]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys).view(np.int64)))
                names, prints = pa.array(list(map(set_name, sets)), pa.int64()), pa.array(list(map(set_print, sets)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(list(map(len, sets)), pa.int32()), prints, lists, pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["id", "fp", "size", "print", "keys", "sketch"])

    staged = stage(texts.mapInArrow(released(keyed), f"id {kind}, fp long, size int, print long, keys array<long>, sketch binary"), "near")
    named = clustered(stage(staged.groupBy("fp").agg(F.min("id").alias("least"), F.min("size").alias("size"), F.min("print").alias("print")), "sets"), distance)
    close = stage(within(named).unionByName(across(staged, named, similarity)), "close")
    wanted = stage(named.join(close.select("fp").distinct(), "fp", "left_semi").select("least"), "wanted")

    def fetched(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                sets = [shingle_set(t.as_py(), ngram) for t in batch.slice(low, 128).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(set_name, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["held_fp", "shingles"])

    found = texts.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("least"), "left_semi").select("text")
    held = found.mapInArrow(released(fetched), "held_fp long, shingles binary")
    dealt_sets = close.join(held, F.col("fp") == F.col("held_fp")).select("group", "fp", "shingles")
    roots = connected_components(by_group(dealt_sets, [], _compared(similarity), "src long, dst long").distinct())

    rooted = named.join(roots, named.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged.select("id", "fp").join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows with the same id count as one document and stay or go together; rows with a null id stay.
    """
    seen = near_copies(docs.where(F.col(id_col).isNotNull()), id_col, **kwargs)
    keep = seen.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.where(F.col(id_col).isNotNull()).join(keep.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
