"""Near-duplicate lines across documents, by MinHash signatures and banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from veldspar.llm._buckets import by_group, dealt, forest, released, sorted_groups
from veldspar.llm._columns import free
from veldspar.llm._text import LOWER, U64, mix
from veldspar.llm.near_copies import near_pairs as blocked_pairs
from veldspar.operators.graph import connected_components
from veldspar.storage import stage

#: Bytes of a shingle, bands and rows of a band: two lines of similarity 0.8 share a band but once in 500 times.
SHINGLE, BANDS, ROWS = 8, 12, 4
SIMILARITY = 0.8
#: Groups of more lines are compared some rows at a time; smaller ones all at once, in tables of so many cells.
AT_ONCE, CELLS = 1024, 1 << 20
#: Bits of a filter for each line that shares a bucket, and its bits at most: 16 MB.
FILTER, FILTER_BITS = 8, 1 << 27
_EMPTY = np.uint32(0xFFFFFFFF)


def normal(line: bytes) -> bytes:
    """What is compared: without white space at the ends, A-Z in lower case."""
    return line.strip().translate(LOWER)


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 42)


def _shingles(buf: bytes) -> np.ndarray:
    """All runs of SHINGLE bytes as numbers, big end first, read in place."""
    return np.ndarray((len(buf) - SHINGLE + 1,), dtype=">u8", buffer=buf, strides=(1,))


def shingle_set(line: bytes) -> set[int]:
    """The line's distinct shingles as numbers; a shorter line is one shingle, told from the others by its length."""
    if len(line) < SHINGLE:
        return {int.from_bytes(line) | (len(line) + 1) << 64}
    return set(_shingles(line).tolist())


def _owned(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines that have one at least, with repeats, and the index of each one's line."""
    lens = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    found = _shingles(b"".join(lines))
    inside, cuts = np.ones(len(found), dtype=bool), np.cumsum(lens)[:-1]
    for i in range(1, SHINGLE):  # begins so near a line's end that it runs into the next line
        inside[cuts - i] = False
    return found[inside].astype(U64), np.repeat(np.arange(len(lines)), lens - SHINGLE + 1)


def near_pairs(lines: list[bytes], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose shingle sets have at least the similarity: a product of the lines' 0-1 rows
    over their shingles, some shingles at a time, counts what each two share."""
    values, owner = _owned(lines)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    both, width = np.zeros((len(lines), len(lines))), max(1, CELLS // len(lines))
    for low in range(0, int(column[-1]) + 1, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        has = np.zeros((len(lines), min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        has[owner[part], column[part] - low] = 1
        both += has @ has.T
    sizes = both.diagonal()
    return np.nonzero(np.triu(both / (sizes[:, None] + sizes[None, :] - both) >= similarity, 1))


def jaccard(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def signatures(lines: list[bytes], slots: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation MinHash, a row a line: each shingle's hash falls into one slot and the slot keeps the least.
    An empty slot borrows from another, chosen by a hash of the slot and the try, alike for all lines."""
    h, owner = _owned([x.ljust(SHINGLE, b"\0") for x in lines])
    h = mix(h)
    slot = ((h >> U64(32)) * U64(slots)) >> U64(32)
    out = np.full(len(lines) * slots, _EMPTY, dtype=np.uint32)
    np.minimum.at(out, owner * slots + slot.astype(np.int64), (h & U64(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(len(lines), slots)
    filled, at = out != _EMPTY, np.arange(slots, dtype=U64)
    result, todo, turn = out.copy(), ~filled, 0
    while todo.any():
        turn += 1
        source = (mix(at * U64(1 << 20) + U64(turn)) % U64(slots)).astype(np.int64)
        take = todo & filled[:, source]
        result[take] = out[:, source][take]
        todo &= ~take
    return result


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), bands, -1).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, i])
    return key


def _lines(text: str | None) -> list[bytes]:
    return [normal(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _new_lines(batches: Iterator[pa.RecordBatch], size: int = 1024, room: int = 1 << 20, remembered: int = 1 << 17) -> Iterator[tuple[list[int], list[bytes]]]:
    """The distinct lines a task meets, some at a time: a line that comes again soon isn't sent twice."""
    seen: set[int] = set()
    hashes, lines, held = [], [], 0
    for batch in batches:
        for text in batch.column(0):
            for line in _lines(text.as_py()):
                if not line or (h := line_hash(line)) in seen:
                    continue
                seen.add(h)
                hashes.append(h)
                lines.append(line)
                held += len(line)
                if len(lines) >= size or held > room:
                    yield hashes, lines
                    hashes, lines, held = [], [], 0
            if len(seen) > remembered:
                seen.clear()
    if lines:
        yield hashes, lines


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=U64).view(np.int64))


def hash_filter(hashes: DataFrame, name: str = "h") -> tuple[np.ndarray, int]:
    """64-bit words of a bitmap, and by how much hashes are shifted to get the number of their bit: each of the
    ``hashes`` has its bit set. Of other hashes few pass, or more where the bitmap has its largest size."""
    count = hashes.count()
    bits = min(max(6, (FILTER * count - 1).bit_length()), FILTER_BITS.bit_length() - 1)
    slot = F.shiftrightunsigned(name, 64 - bits)
    rows = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - bits}) & 63 as int))")).alias("word"))
    found, words = rows.toArrow(), np.zeros(1 << (bits - 6), dtype=np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return words.view(U64), 64 - bits


def passing(words: np.ndarray, shift: int, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose bit is set."""
    slot = hashes >> U64(shift)
    return np.flatnonzero(words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63)) & U64(1))


def line_links(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Links (src, dst) between hashes of distinct lines, as few as connect all pairs that share a band and whose
    shingle sets have at least the similarity.

    Only band keys are shuffled at first, once a line and task. Buckets with the same members are merged, and only the lines in buckets
    of two or more are fetched and compared, tile by tile; each tile gives a spanning forest.
    """
    texts = docs.select(F.col(text_col).alias("text"))

    def keyed(batches):
        for hashes, lines in _new_lines(batches, room=1 << 16):  # arrays that stay in the cache
            keys = band_keys(signatures(lines))
            flat = pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([_longs(hashes), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), flat)], names=["h", "keys"])

    bands = stage(texts.mapInArrow(released(keyed), "h long, keys array<long>"), "bands", "uncompressed").select("h", F.explode("keys").alias("key"))

    def buckets(batches):
        for table in sorted_groups(batches):
            group, h = table.column("group").to_numpy(), table.column("h").to_numpy()
            same = group[1:] == group[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            group, h = group[shared], h[shared]  # most keys have one line
            order = np.lexsort((h, group))
            group, h = group[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (h[1:] != h[:-1])
            group, h = group[new], h[new]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(starts, len(h)))
            name = np.add.reduceat(mix(h.view(U64)), starts) if len(h) else np.zeros(0, dtype=U64)
            many = np.repeat(counts > 1, counts)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, counts)[many].view(np.int64)), pa.array(h[many])], names=["bucket", "h"])

    members = stage(by_group(dealt(bands, "key", "h"), [], buckets, "bucket long, h long"), "members").distinct()
    wanted = stage(members.select("h").distinct(), "wanted")
    words, shift = hash_filter(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def fetched(batches):
        for hashes, lines in _new_lines(batches):  # most lines are in no bucket: a filter keeps them out of the shuffle
            at = passing(shared.value, shift, np.array(hashes, dtype=U64)).tolist()
            yield pa.RecordBatch.from_arrays([_longs([hashes[i] for i in at]), pa.array([lines[i] for i in at], type=pa.binary())], names=["line_h", "line"])

    lines = texts.mapInArrow(released(fetched), "line_h long, line binary")
    # each task that met a line has sent it: one copy of it goes on to its buckets
    found = lines.join(wanted, F.col("line_h") == F.col("h"), "left_semi").dropDuplicates(["line_h"])
    rows = members.join(found, F.col("h") == F.col("line_h")).select(F.col("bucket").alias("group"), "h", "line")

    def compared(batches):
        for table in sorted_groups(batches, 1 << 12):
            group, h, text = table.column("group").to_numpy(), table.column("h").to_numpy(), table.column("line").to_pylist()
            starts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(h)]
            src, dst = [], []
            for low, high in zip(starts, starts[1:], strict=False):
                # a line shorter than a shingle is like no other
                lines_ = {i: x for i, x in zip(h[low:high].tolist(), text[low:high], strict=True) if len(x) >= SHINGLE}
                ids = np.array(sorted(lines_, key=lambda i: (len(lines_[i]), i)), dtype=np.int64)
                if 1 < len(ids) <= AT_ONCE:
                    i, j = near_pairs([lines_[k] for k in ids.tolist()], similarity)
                    src.append(ids[i])
                    dst.append(ids[j])
                elif len(ids):
                    sets = [np.unique(_shingles(lines_[k]).astype(U64)) for k in ids.tolist()]
                    for i, j in blocked_pairs(sets, similarity):
                        a, b = forest(ids[i], ids[j]) if len(i) > 1 << 16 else (ids[i], ids[j])
                        src.append(a)
                        dst.append(b)
            if sum(map(len, src)):
                a, b = forest(np.concatenate(src), np.concatenate(dst))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    return by_group(rows, [], compared, "src long, dst long").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with each line kept once, and columns n_lines and n_removed.

    Lines whose sets of SHINGLE-byte shingles, white space at the ends and case apart, have at least the
    similarity are linked; of each component the first line stays: that of the smallest id, there the topmost.
    Blank lines stay. Rows with one id each keep their first. Rows with a null id, null and empty texts come back
    as they are, with n_removed 0; texts are cut at line feeds only, and what is kept is joined by them. Columns
    n_lines and n_removed that ``docs`` has already give way to the new ones; all others come back unchanged.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    roots = connected_components(line_links(docs.where(F.col(id_col).isNotNull()), text_col, similarity))
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                hashes = [[line_hash(x) if x else 0 for x in _lines(t.as_py())] for t in part.column(1)]
                flat = _longs([h for hs in hashes for h in hs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.cumsum([0, *map(len, hashes)]).astype(np.int32), flat)], names=["id", "hashes"])

    occurrences = stage(texts.mapInArrow(released(listed), f"id {kind}, hashes array<long>"), "lines").select("id", F.explode(F.array_distinct("hashes")).alias("h")).where("h <> 0")
    repeated = occurrences.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = repeated.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("component", "h"))
    firsts = named.groupBy("root").agg(F.min(F.struct("first")).getField("first").alias("keeper"), F.sum("n").alias("all")).where("`all` > 1")
    keepers = stage(named.join(firsts, "root").select(F.col("h").alias("_h"), "root", "keeper"), "keepers")
    touched = occurrences.join(keepers, F.col("h") == F.col("_h")).groupBy("id").agg(F.collect_list(F.struct("h", "root", (F.col("id") == F.col("keeper")).alias("kept"))).alias("lines"))

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def rewritten(text, lines):
        import pandas as pd

        out = []
        for t, found in zip(text, lines, strict=True):
            if t is None:
                out.append((None, 0, 0))
                continue
            known = {x["h"]: (x["root"], x["kept"]) for x in found} if found is not None else {}
            parts, kept, used = t.split("\n"), [], set()
            for part, line in zip(parts, _lines(t), strict=True):
                if line:
                    h = line_hash(line)
                    h -= h >> 63 << 64  # signed, as in the table
                    root, stays = known.get(h, (h, True))
                    if not stays or root in used:
                        continue
                    used.add(root)
                kept.append(part)
            out.append(("\n".join(kept) if len(kept) < len(parts) else t, len(parts), len(parts) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    key, lines, new = (free(name, docs) for name in ("_id", "_lines", "_new"))
    joined = docs.join(touched.select(F.col("id").alias(key), F.col("lines").alias(lines)).hint("shuffle_hash"), F.col(id_col) == F.col(key), "left")
    done = joined.withColumn(new, rewritten(F.col(text_col), F.col(lines)))
    counts = ("n_lines", "n_removed")
    kept = [F.col(f"{new}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in counts]
    return done.select(*kept, *[F.col(f"{new}.{c}").cast("long").alias(c) for c in counts])

