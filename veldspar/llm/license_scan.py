"""License texts and notices in documents, by diagonal voting over rolling word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veldspar.llm._text import ALNUM, LOWER, gram_hashes, spans, word_hashes
from veldspar.storage import stage

K = 2
#: Phrases that make a base label wherever their words stand consecutively. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wordings of notices and license texts, each with its label.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("eclipse public license version 2 0", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]
#: Share of a template's word pairs that a span must have, and how far neighbouring diagonals may lie apart.
COVER, DRIFT = 0.8, 2
#: Documents with spans whose row numbers may be broadcast; of more, texts are shuffled by row number.
BROADCAST_ROWS = 1_000_000
#: Stands for the document itself among its hashes, so that a document without a match keeps a row.
_ITSELF = 0


def _hashes(text: str | None) -> tuple[int, np.ndarray]:
    buf = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    words = word_hashes(*spans(buf, ALNUM))
    return len(words), gram_hashes(words, K)


def _words(text: str | None) -> list[str]:
    buf = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    _, starts, ends = spans(buf, ALNUM)
    return [buf[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(hash, template, at): where each word pair stands in each template; small, as the templates are a list."""
    rows = [(int(h.view(np.int64)), t, at) for t, (text, _) in enumerate(templates) for at, h in enumerate(_hashes(text)[1])]
    return spark.createDataFrame([*rows, (_ITSELF, -1, -1)], "hash long, template int, at int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    """Return a row for each document: id_col, n_words, spans.

    ``spans`` lists (template, label, base, first, last, votes, cover): where a template's words stand, from word
    ``first`` to ``last``. Base phrases count only whole and in order; other templates where at least ``cover`` of
    their word pairs are found on diagonals at most ``drift`` apart, so a word may be added or missing, within a
    span no longer than the template and the drift; such a span gives way to a whole template in its place. Null and
    empty texts have no words. Rows with one id, or a null one, are scanned each on their own. An empty table gives
    none.

    All rolling hashes of a document are joined with the template positions, a fixed list that is broadcast; only
    matches leave the scan, and one row for each document that stands for itself. Votes are summed up by document,
    template and diagonal; neighbouring diagonals are merged, a template position counting once however many of them
    it was found on. Spans that pass are verified: the document's words are looked up once more, for the documents
    with spans alone, and a position counts only where its words stand.
    """
    listed = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in (TEMPLATES if templates is None else templates)]
    spark = docs.sparkSession
    table = template_table(spark, [(p, label) for p, label, _ in listed])
    templates_ = [p.split() for p, *_ in listed]
    sizes = list(map(len, templates_))

    itself = np.array([_ITSELF], dtype=np.uint64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                counts, grams = zip(*(_hashes(t.as_py()) for t in part.column(1)), strict=True)
                flat = np.concatenate([x for g in grams for x in (itself, np.where(g == _ITSELF, np.uint64(1), g))]).view(np.int64)
                offsets = np.cumsum([0, *(len(g) + 1 for g in grams)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, type=pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["row", "id", "n_words", "hashes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id")), "texts")
    arrays = rows.mapInArrow(hashed, f"row long, id {kind}, n_words long, hashes array<long>")
    places = arrays.select("row", "id", "n_words", F.posexplode("hashes").alias("place", "hash")).join(F.broadcast(table), "hash")
    votes = places.groupBy("row", "template", (F.col("place") - 1 - F.col("at")).alias("diagonal")).agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.collect_set("at").alias("ats"))
    each = votes.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "diagonal", "ats"))).alias("votes"),
    )

    def spans_of(found: list, words: list[str] | None = None) -> list[dict]:
        """Spans by votes; with the document's words, by votes whose words stand where they were found."""
        out, by = [], {}
        for v in found:
            t, d = v["template"], v["diagonal"]
            ats = [at for at in v["ats"] if words is None or words[d + at : d + at + K] == templates_[t][at : at + K]]
            if ats:
                by.setdefault(t, []).append((d, sorted(ats)))
        for t, lines in by.items():
            pairs, (_, label, base) = sizes[t] - K + 1, listed[t]
            lines.sort()
            at = 0
            while at < len(lines):
                diagonal, ats = lines[at]
                seen, end = set(ats), at + 1
                first, last = diagonal + ats[0], diagonal + ats[-1] + K - 1
                if base or len(seen) == pairs:
                    if len(seen) == pairs:
                        out.append({"template": t, "label": label, "base": base, "first": first, "last": last, "votes": pairs, "cover": 1.0})
                    at = end
                    continue
                while end < len(lines) and lines[end][0] - diagonal <= drift and len(lines[end][1]) < pairs:
                    d, ats = lines[end]
                    first, last, end = min(first, d + ats[0]), max(last, d + ats[-1] + K - 1), end + 1
                    seen.update(ats)
                share = len(seen) / pairs
                if share >= cover and last - first + 1 <= sizes[t] + drift:
                    out.append({"template": t, "label": label, "base": base, "first": first, "last": last, "votes": len(seen), "cover": share})
                    at = end
                else:
                    at += 1
        whole = [s for s in out if s["cover"] == 1.0 and not s["base"]]
        out = [s for s in out if s["cover"] == 1.0 or not any(s["first"] <= w["last"] and w["first"] <= s["last"] for w in whole)]
        return sorted(out, key=lambda s: (s["first"], s["template"]))

    shape = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("votes", pa.int64()), ("cover", pa.float64())]))
    kept = pa.list_(pa.struct([("template", pa.int32()), ("diagonal", pa.int32()), ("ats", pa.list_(pa.int32()))]))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their votes if any span passes, else without."""
        for batch in batches:
            votes_ = [v if v and spans_of(v) else None for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(votes_, type=kept)], names=["row", "id", "n_words", "votes"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(v, _words(t.as_py())) for t, v in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=shape)], names=["row", "spans"])

    vote = "array<struct<template: int, diagonal: int, ats: array<int>>>"
    span = "array<struct<template: int, label: string, base: boolean, first: long, last: long, votes: long, cover: double>>"
    marked = stage(each.mapInArrow(likely, f"row long, id {kind}, n_words long, votes {vote}"), "votes")
    candidates = marked.where("votes is not null").select("row", "votes")
    names = candidates.select("row")
    held = rows.select("row", "text").join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "row", "left_semi")
    spans_ = held.join(candidates, "row").mapInArrow(verified, f"row long, spans {span}")
    out = marked.select("row", "id", "n_words").join(spans_, "row", "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(span)).alias("spans"))
    return out
