"""The pipeline's stages, one after another, against brute force on what the stage before kept."""

import random
import re

import pytest

from veldspar.llm import line_dedup, quality
from veldspar.llm.queries import word_tokenizer

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ve"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(8), tmp_path_factory.mktemp("sf")
    said = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    items = [prose(rng, 40) for _ in range(4)]
    texts = [*said, *said[:5], None, ""]
    texts += ["BUY!!! $$$ WIN $$$ !!! " * 30] * 20
    texts += [said[10] + "\n" + prose(rng, 60), said[11] + "x\n" + prose(rng, 60)]
    texts += [f"{prose(rng, 30)}\n{prose(rng, 20)} {items[0]} {prose(rng, 20)}", f"{prose(rng, 30)} {' '.join(items[1].split()[:36])} {prose(rng, 9)}"]
    texts += [f"{prose(rng, 40)} {' '.join(items[2].split()[:20])} {prose(rng, 9)}", " ".join(items[3].split()[:8] * 40)]
    rows = [(i, t, "en", "x", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(not (t or "").startswith("BUY")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts, items


def content(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    at, texts, items = folder
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality", "line_dedup", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns

    good = steps["quality"](spark, docs, at)
    kept = content(good)
    assert good.columns == columns
    model = quality.fit_quality(docs, spark.read.parquet(f"{at}/labels.parquet"))
    assert kept == {r.doc_id: r.text for r in quality.score(docs, model).collect() if r.score >= 0.3}
    assert {i for i, t in enumerate(texts) if t and not t.startswith("BUY")} <= set(kept)
    assert not any((t or "").startswith("BUY") for t in kept.values())

    lines = steps["line_dedup"](spark, good, at)
    seen, want = [], {}
    for i in sorted(kept):
        out = []
        for line in (kept[i] or "").split("\n"):
            shingles = line_dedup.shingle_set(line_dedup.normal(line.encode()))
            if line.strip() and any(line_dedup.jaccard(shingles, s) >= 0.8 for s in seen):
                continue
            seen += [shingles] if line.strip() else []
            out.append(line)
        want[i] = None if kept[i] is None else "\n".join(out)
    assert content(lines) == want and lines.columns == columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    single = steps["simhash"](spark, lines, at)
    from veldspar.llm.simhash import simhash

    prints, least = {i: simhash(t) % (1 << 64) for i, t in want.items()}, {}
    for i in sorted(prints):  # the fixture has no chains
        least[i] = min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
    left = {i: t for i, t in want.items() if least[i] == i}
    assert content(single) == left and single.columns == columns

    clean = steps["decontamination"](spark, single, at)
    held = {i: t for i, t in left.items() if not any(contains(t, x) for x in items)}
    assert content(clean) == held and clean.columns == columns
    n = len(texts)
    assert n - 4 not in held and n - 3 not in held and n - 2 in held and n - 1 in held

    pieces = steps["packing"](spark, clean, at).collect()
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(word_tokenizer())
    for i, t in held.items():
        mine = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert sum(m for _, m in mine) == len(tokens.encode(t or "", add_special_tokens=False).ids) + 1
        assert [s for s, _ in mine] == [sum(m for _, m in mine[:k]) for k in range(len(mine))]
    assert {p.doc_id for p in pieces} == set(held)

    whole = pipeline.run(spark, at).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)
    assert {p.doc_id for p in whole} == set(held) and len({key(p)[:2] for p in whole}) == len(whole)


def contains(text, item, share=0.8, size=8):
    words, wanted = WORD.findall((text or "").lower()), WORD.findall(item.lower())
    windows = {tuple(wanted[s : s + size]) for s in range(max(1, len(wanted) - size + 1))}
    hits = [tuple(words[s : s + size]) for s in range(max(0, len(words) - size + 1))]
    return any(len(windows & set(hits[s : s + len(wanted)])) >= share * len(windows) for s in range(len(hits)))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a line of some words", 1, 2, 3, 4, 5, 0.5), (2, "a line of some words\nmore", 1, 2, 3, 4, 5, 0.5)], "doc_id long, text string, _id int, _lines int, _new int, N_Lines int, h int, score double")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert (got[2].text, got[2].n_lines, got[2].n_removed, got[2]["_id"], got[2]["_new"]) == ("more", 2, 1, 1, 3)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.keep_good(docs, labels, 0.0).collect()} == {0.5}


def test_entry_without_corpus_modules(monkeypatch):
    """Registered names stay importable; the corpus queries go with their package."""
    import __spark_entry__ as entry

    found = entry.queries()
    assert {"pipeline", "suggest"} <= set(found) and sum(n[:2] == "op" and n[2].isdigit() for n in found) == 10
    monkeypatch.setattr(entry, "llm_queries", None)
    monkeypatch.setattr(entry, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
