"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from veldspar.llm._buckets import by_group, dealt, forest, neighbours, sorted_groups
from veldspar.llm._text import LOWER
from veldspar.operators.graph import connected_components
from veldspar.storage import stage

SEED = 42
_CHUNK = 1 << 15


def _ones(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def set_print(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a set of shingles by their hashes; 0 for the empty set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += _ones(hashes[at : at + _CHUNK].astype("<u8"))
    return _majority(ones, len(hashes))


def simhash(text: str | None, n: int = 3) -> int:
    """The signed 64-bit fingerprint of a whole text's word shingles, with repeats; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, width = (ends - lens), min(n, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        s, e = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, s, e)), repeat(SEED)), dtype="<u8", count=len(s))
        ones += _ones(h)
    return _majority(ones, len(starts))


def fingerprint(text: Column | str, n: int = 3) -> Column:
    """Column of SimHash fingerprints as long. A Python kernel: the bit votes over all shingles of a text have no
    built-in aggregate that needn't first make a row of each shingle."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, n) for t in texts], dtype="int64")

    return run(text)


def _blocks(distance: int, shared: int) -> list[int]:
    """Bit masks: with ``distance + shared`` blocks, two fingerprints at most ``distance`` bits apart agree on at
    least ``shared`` whole blocks, so on one of these masks."""
    count = distance + shared
    edges = [round(64 * i / count) for i in range(count + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, shared)]


def hamming_links(prints: DataFrame, distance: int = 3, shared: int = 2) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints of ``prints.fp`` as do all pairs within ``distance``
    bits: each block of each task gives a spanning forest, never its pairs."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(_blocks(distance, shared))])
    keyed = prints.select("fp", F.explode(keys).alias("key"))

    def run(batches):
        for table in sorted_groups(batches):
            fp, found, held = table.column("fp").to_numpy().view(np.uint64), [], 0
            for i, j in neighbours(table.column("group").to_numpy()):
                close = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                found.append((fp[i[close]], fp[j[close]]))
                held += int(close.sum())
                if held > 1 << 20:
                    found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
                    held = len(found[0][0])
            if held:
                a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    return by_group(dealt(keyed, "key", "fp"), ["fp"], run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, ngram: int = 3) -> DataFrame:
    """Return (id_col, fp, component_id) for each row: the fingerprint and the smallest id reachable over links of
    at most ``distance`` differing bits.

    Texts without words (null, empty, white space) have fingerprint 0 and link like any other. Rows with one id are
    kept each; a null id is never a component's name unless the component has no other. An empty table gives none.
    Work after the fingerprints is on distinct fingerprints: a group of exact copies costs one row.
    """
    staged = stage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), ngram).alias("fp")), "simhash")
    prints = staged.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(hamming_links(staged.select("fp").distinct(), distance))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(names, "root").select("fp", "component_id")
    return staged.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows with the same id count as one document and stay or go together; rows with a null id stay.
    """
    seen = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, **kwargs)
    keep = seen.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.where(F.col(id_col).isNotNull()).join(keep.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
