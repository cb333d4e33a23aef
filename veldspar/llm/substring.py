"""Repeated passages of documents, by winnowed anchors that are extended to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldspar.llm._text import U64, gram_hashes, spans, word_hashes
from veldspar.operators.graph import joined_back
from veldspar.storage import stage

_SUM_SCHEMA = "n_words long, whole binary, kept_sha256 string, anchors array<long>"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x, done = pick(x[: len(x) - done], x[done:]), done * 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    buf = (text or "").encode("utf-8", "surrogatepass")
    a, starts, ends = spans(buf)
    return buf, starts, ends, word_hashes(a, starts, ends)


class Winnow:
    """Anchors are word runs of ``k`` words: in each window of ``length`` words that of least hash is one, so two
    equal windows have an anchor at the same place."""

    def __init__(self, length: int, bits: int = 64):
        if length < 2:
            raise ValueError("length must be 2 at least")
        self.length, self.k, self.mask = length, max(1, length // 2 - 1), U64((1 << bits) - 1)
        self.runs = length - self.k + 1

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        return gram_hashes(h, k) & self.mask

    def least(self, h: np.ndarray) -> np.ndarray:
        """For each window, the hash of its anchor."""
        grams = self.grams(h, self.k)
        return _slide(grams, self.runs, np.minimum) if len(h) >= self.length else grams[:0]

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The hashes of all anchors, one for each place."""
        grams = self.grams(h, self.k)
        if len(h) < self.length:
            return grams[:0]
        least = _slide(grams, self.runs, np.minimum)
        pad = np.zeros(self.runs - 1, dtype=U64)
        return grams[_slide(np.concatenate([pad, least, pad]), self.runs, np.maximum) == grams]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*rows, np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(flat))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _name(words: bytes) -> bytes:
    """128 bits that stand for the words themselves."""
    return hashlib.blake2b(words, digest_size=16).digest()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key others have too. Counts are summed before the shuffle and staged, so that Spark can split
    the join back where a key is hot; no key's rows have to meet in one task."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    return joined_back(rows, key, counts, "_key")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, texts: bool = False, hash_bits: int = 64) -> DataFrame:
    """Return id_col, n_words, n_removed, kept_sha256 and, if asked for, kept_text for each row of ``docs``.

    A word is removed if a window of ``length`` consecutive words covers it whose words also start anywhere else,
    in another document or the same. The windows of the input count, whatever is removed.

    Seeds are winnowed anchors that stand in two places at least; only windows around a seed are compared, and so
    the seeds extend both ways as far as windows repeat. Documents with the same words go through this once, by
    one of them; all windows of theirs repeat. What is shuffled: anchors (a tenth of the words), windows around
    seeds, and documents with seeds. Null and empty texts have no words. Rows with one id are kept each. Texts are
    processed whole; an empty table gives none.

    Hashes of ``hash_bits`` only find windows that may repeat; a window is removed if the words of another, by a
    cryptographic digest of 128 bits, are the same. Fewer bits mean more of those comparisons and the same result.
    Windows that a clash of hashes brought this far stand alone; they are few, and so they are what is joined back.
    """
    win = Winnow(length, hash_bits)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            counts, wholes, shas, anchors = [], [], [], []
            for text in part.column(1):
                buf, starts, _, h = _words(text.as_py())
                words = buf.split()
                joined = b" ".join(words)
                counts.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                wholes.append(_name(joined))
                anchors.append(win.anchors(h).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, type=pa.int64()), pa.array(wholes, type=pa.binary()), pa.array(shas), _lists(anchors)], names=["row", "n_words", "whole", "kept_sha256", "anchors"])

    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "texts")
    sums = stage(rows.select("row", "text").mapInArrow(summed, f"row long, {_SUM_SCHEMA}"), "anchors")
    copies = sums.where(F.col("n_words") >= length).groupBy("whole").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = stage(joined_back(sums.select("row", "whole"), "whole", copies.withColumnRenamed("whole", "_whole"), "_whole").select("row", "first"), "copies")
    once = sums.select("row", "anchors").join(marked.where("row <> first").select("row"), "row", "left_anti")
    seeds = _repeated(once.select("row", F.explode("anchors").alias("anchor")), "anchor").groupBy("row").agg(F.collect_set("anchor").alias("seeds"))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 64):
            texts_, starts_, hashes = [], [], []
            for text, seeds_ in zip(part.column(1), part.column(2), strict=True):
                _, _, _, h = _words(text.as_py())
                at = np.flatnonzero(np.isin(win.least(h), seeds_.values.to_numpy().view(U64)))
                starts_.append(at.astype(np.int64))
                hashes.append(win.grams(h, length)[at].view(np.int64))
                texts_.append(text)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(starts_), _lists(hashes)], names=["row", "text", "starts", "hashes"])

    seeded = stage(rows.select("row", "text").join(seeds.hint("shuffle_hash"), "row").mapInArrow(extended, "row long, text string, starts array<long>, hashes array<long>"), "windows")
    places = seeded.select("row", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("row", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    maybe = _repeated(places, "hash").groupBy("row").agg(F.collect_list("start").alias("maybe"))

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 64):
            for row, text, at in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                words, at = text.as_py().encode("utf-8", "surrogatepass").split(), at.values.to_numpy()
                for low in range(0, len(at), 1 << 16):
                    some = at[low : low + (1 << 16)]
                    names = [_name(b" ".join(words[i : i + length])) for i in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row, dtype=np.int64)), pa.array(some), pa.array(names, type=pa.binary())], names=["row", "start", "words"])

    named = stage(seeded.select("row", "text").join(maybe.hint("shuffle_hash"), "row").mapInArrow(spelt, "row long, start long, words binary"), "spelt")
    own = marked.where("row = first").select("row")
    alone = stage(named.groupBy("words").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("words"), "alone")
    found = named.join(alone, "words", "left_anti").join(own.hint("shuffle_hash"), "row", "left_anti").groupBy("row").agg(F.collect_list("start").alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 64):
            out = []
            for row, text, at in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                at = at.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = [words[i] for i in np.flatnonzero(~covered)]
                out.append((row, int(covered.sum()), _sha(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["row", "_removed", "_sha", "_text"])

    partly = seeded.select("row", "text").join(found.hint("shuffle_hash"), "row").mapInArrow(cut, "row long, _removed long, _sha string, _text string")
    copied = marked.select("row", F.lit(True).alias("_copied"))
    out = rows.select("row", "id", *(["text"] if texts else [])).join(sums.select("row", "n_words", "kept_sha256"), "row").join(copied, "row", "left").join(partly, "row", "left")
    none = hashlib.sha256(b"").hexdigest()
    pick = lambda all_, some, whole: F.when(F.col("_copied"), all_).otherwise(F.coalesce(some, whole))
    cols = [F.col("id").alias(id_col), "n_words", pick(F.col("n_words"), F.col("_removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(none), F.col("_sha"), F.col("kept_sha256")).alias("kept_sha256")]
    return out.select(*cols, *([pick(F.lit(""), F.col("_text"), F.coalesce("text", F.lit(""))).alias("kept_text")] if texts else []))
