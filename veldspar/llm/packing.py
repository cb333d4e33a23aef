"""Cost-balanced packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldspar.llm._buckets import memory, released

#: Tokens whose packing is decided together: 512 sequences of 2,048.
BLOCK_TOKENS = 1 << 20
#: Words, and parts of words, whose ids a worker remembers before it forgets all but those it met first, among them
#: the frequent ones. This bounds memory and has no bearing on the ids.
REMEMBERED, LASTING = 720_000, 320_000
#: White space for str.split() but not for the tokenizer; a text with these is encoded whole.
_ODD = re.compile("[\x1c-\x1f]")
#: Below this letter, lower-casing is letter by letter and no letters combine.
_PLAIN = "\u0250"


class WordEncoder:
    """Ids of whole texts, exactly as ``encode(text, add_special_tokens=False)`` gives them, as little-endian
    uint32 bytes. For tokenizers that lower-case, drop white space, split words into parts by PARTS and mark the
    last token of a part with ``</w>``: each part is encoded once, many in one call, and each word put together once."""

    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.PARTS).findall
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_parts(self, parts: list[str]) -> None:
        ids = self._encode(" ".join(parts))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(parts):
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.parts.update((p, raw[a:b]) for p, a, b in zip(parts, cuts, cuts[1:], strict=False))
        else:
            self.parts.update((p, self._encode(p).tobytes()) for p in parts)

    def _learn(self, words: set[str]) -> None:
        self.parts = forgetful(self.parts)
        plain = [w for w in words if max(w) < _PLAIN and "<|" not in w]
        split = [[low] if low.isalpha() else self.split(low) for low in map(str.lower, plain)]
        new = list({p for parts in split for p in parts}.difference(self.parts))
        if new:
            self._learn_parts(new)
        part = self.parts.__getitem__
        self.known.update((w, part(parts[0]) if len(parts) == 1 else b"".join(map(part, parts))) for w, parts in zip(plain, split, strict=True))
        self.known.update((w, self._encode(w).tobytes()) for w in words.difference(plain))

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._encode(text).tobytes()
        words = text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            missing = set(words).difference(self.known)
            if (kept := forgetful(self.known, len(missing))) is not self.known:
                self.known, missing = kept, set(words).difference(kept)
            self._learn(missing)
            return b"".join(map(self.known.__getitem__, words))


def forgetful(known: dict, more: int = 0) -> dict:
    """``known``, or its first LASTING entries where it and ``more`` would be over REMEMBERED."""
    return dict(islice(known.items(), LASTING)) if len(known) + more > REMEMBERED else known


#: A worker's encoders by path: what one task has learnt serves the next, until another operator has the worker.
_ENCODERS: dict[str, Callable[[str], bytes]] = memory(__name__)


#: Texts on which a tokenizer must agree with WordEncoder's way of taking words apart.
_PROBES = ("Hello World, it's 2024!", "  two\tparts\n\nthree  ", "É Straße x-y_z (a+b)=c", "don't we'll 3.14 #tag @you", "UPPER lower MiXed", "")


def encoder(path: str) -> Callable[[str], bytes]:
    """The worker's encoder for a tokenizers file: word by word where the tokenizer is of that kind, which is tried on
    some texts, and else the library's own."""
    if path not in _ENCODERS:
        made = WordEncoder(path)
        plain = lambda text: made._encode(text).tobytes()
        _ENCODERS[path] = made if all(made(t) == plain(t) for t in _PROBES) else plain
    return _ENCODERS[path]


def capacities(tokens: int, length: int) -> np.ndarray:
    """Full sequences, and the rest as powers of two, which need no padding."""
    rest = tokens % length
    return np.array([length] * (tokens // length) + [1 << i for i in range(length.bit_length() - 1, -1, -1) if rest >> i & 1], dtype=np.int64)


def balance(lengths: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents with these token counts.

    A document's cost is linear * n + quadratic * n^2. Whole sequences are cut off long documents first; what is
    left goes in descending order to the sequence of lowest cost with room for it. Where none has room, the piece
    is cut at the room of the cheapest sequence that has any and its rest follows. The capacities add up to the
    tokens, so no sequence is left with a gap.
    """
    total = sum(lengths)
    room = capacities(total, length)
    cost, fill = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    full, pieces, rest = int((room == length).sum()), [], []
    free = 0

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, s, int(fill[s])))
        fill[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = 0
        while lengths[d] - at >= length and free < full:
            put(d, at, length, free)
            free, at = free + 1, at + length
        if lengths[d] > at:
            rest.append((lengths[d] - at, d, at))
    for n, d, at in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            open_ = fits if len(fits) else np.flatnonzero(room > 0)
            s = int(open_[np.argmin(cost[open_])])
            part = min(n, int(room[s]))
            put(d, at, part, s)
            n, at = n - part, at + part
    return pieces


def _blocks(rows: Iterator[tuple[int | None, bytes]], block_tokens: int) -> Iterator[list[tuple[int | None, int, int, bytes]]]:
    """Some documents at a time, as (id, ids before, ids in all, ids); one over the block's size goes in slices,
    so that what is held stays bounded."""
    held, tokens = [], 0
    for key, ids in rows:
        n = len(ids) // 4
        for at in range(0, n, block_tokens):
            part = ids[4 * at : 4 * (at + block_tokens)]
            held.append((key, at, n, part))
            tokens += len(part) // 4
            if tokens >= block_tokens:
                yield held
                held, tokens = [], 0
    if held:
        yield held


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Return a row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, the same on each machine; every document ends with ``end_id``.
    Null and empty texts are that id alone. Each task packs what it reads, a block of about a million tokens at a
    time, so there's no shuffle and no state but the block; sequence_id is unique, made of the task, the block
    and the sequence in it. A retried task reads the same rows and makes the same pieces. A block's tokens fill
    whole sequences and powers of two, so nothing is padded. Rows with one id are packed each; an empty table
    gives none.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()
        rows = ((key, encode(text or "") + end) for b in batches for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for text in [text.as_py()])
        for number, block in enumerate(_blocks(rows, BLOCK_TOKENS)):
            base = (task << 40) | (number << 20)
            out = balance([len(ids) // 4 for *_, ids in block], length, linear, quadratic)
            cells = [(block[d][0], block[d][1] + at, n, zlib.crc32(block[d][3][4 * at : 4 * (at + n)]), block[d][2], base + s, offset) for d, at, n, s, offset in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*cells, strict=True)], names=names)

    cols = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return cols.mapInArrow(released(run), ", ".join(f"`{n}` long" for n in names))
