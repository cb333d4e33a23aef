"""Readers, encoders, joins, prompts, saved models and the command lines on small inputs."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import storage
from veldspar.functions import text as T
from veldspar.operators import contracts, encode, graph, logistic, split
from veldspar.plans import study, suggest
from veldspar.sources import embeddings, images


def png(pixels, how):
    """A PNG of RGB bytes whose lines use the filter ``how``."""
    height, width, _ = pixels.shape
    raw, above = b"", np.zeros(width * 3, dtype=int)
    for line in pixels.reshape(height, -1).astype(int):
        left = np.concatenate([[0] * 3, line[:-3]])
        corner = np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, near][how]
        raw += bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    folder = tmp_path / "images"
    folder.mkdir()
    for how in range(5):
        (folder / f"{how}.png").write_bytes(png(pixels, how))
    (folder / "bad.png").write_bytes(b"nothing")
    rows = {r.path.rpartition("/")[2]: r for r in images.decoded(spark, str(folder)).collect()}
    assert all((rows[f"{how}.png"].height, rows[f"{how}.png"].width, bytes(rows[f"{how}.png"].pixels)) == (5, 7, pixels.tobytes()) for how in range(5))
    assert rows["bad.png"].pixels is None and rows["bad.png"].error
    paths = ["0.png", "images/1.png", f"{folder}/2.png", "gone.png", None]
    creatives = spark.createDataFrame(list(enumerate(paths)), "creative_id int, image_path string")
    assert {r.creative_id for r in images.missing(creatives, str(folder)).collect()} == {3, 4}
    assert images.check(creatives.where("creative_id < 3"), str(folder)).count() == 3
    with pytest.raises(FileNotFoundError, match="1 images are missing.*gone.png"):
        images.check(creatives.where("creative_id = 3"), str(folder))


def test_embeddings(spark, tmp_path):
    creatives = spark.createDataFrame([("a", "s", "t", "p", None), ("b", "s", "t", "p", None)], "creative_id string, ad_size string, ad_text string, image_path string, launched_at timestamp")
    vectors = encode.encoded(creatives, "ad_text", lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts)), "creative_id")
    assert all(r.vector == pytest.approx([0.6, 0.8]) for r in vectors.collect())
    at = str(tmp_path / "e")
    embeddings.save(at, {"text": vectors}, embeddings.metadata(creatives))
    found, about = embeddings.load(spark, at, ["text"], 2)
    assert found["text"].count() == 2 and about.columns == list(embeddings.METADATA)
    embeddings.save(at, {"text": vectors.where("id = 'a'")}, embeddings.metadata(creatives))
    with pytest.raises(ValueError, match="without_vector 1"):
        embeddings.load(spark, at, ["text"])
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vector for r in embeddings.read_npy(spark, str(tmp_path / "x.npy"), 2).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeated_right 1"):
        contracts.one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="unmatched 1"):
        contracts.complete(a, b.limit(1), "k")
    assert contracts.one_to_one(a, b.limit(1), "k", "left").count() == 2
    with pytest.raises(ValueError, match="1 unknown"):
        contracts.known(spark.createDataFrame([(1, 9)], "a int, b int"), ["a", "b"], a, "k")


def test_split_of_few(spark):
    for n in (3, 7, 50):
        rows = spark.createDataFrame([(i, i // 2) for i in range(2 * n)], "id int, cluster_id int")
        got = {r.split: r.n for r in split.sized_split(rows).groupBy("split").agg(F.count_distinct("cluster_id").alias("n")).collect()}
        assert got["test"] == -(-15 * n // 100) == got["dev"] and sum(got.values()) == n
    with pytest.raises(ValueError):
        split.sized_split(rows, 0.5, 0.5)
    assert split.sized_split(rows.where("false")).count() == 0


def test_answers(spark):
    rows = [("ok", "f", ["c_1"]), ("wrong", "f", ["c_1"]), ("fails", "f", []), ("shape", "f", [])]
    asked = spark.createDataFrame(rows, "prompt string, fallback string, allowed array<string>")

    def call(text):
        if text == "fails":
            raise RuntimeError
        return {"ok": '```json\n{"rationale": "as c_1"}\n```', "wrong": '{"rationale": "as c_2"}', "shape": "plain"}[text]

    got = {r.prompt: (r.rationale, r.source) for r in encode.answered(asked, call).collect()}
    assert got == {"ok": ("as c_1", "llm"), "wrong": ("f", "template"), "fails": ("f", "template"), "shape": ("f", "template")}


def test_saved_model_and_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    centre = {"Tech": [1.0, 0, 0], "Travel": [0, 1.0, 0]}
    rows = [(f"c_{i}", (np.array(centre["Tech" if i % 2 else "Travel"]) + 0.1 * rng.standard_normal(3)).tolist()) for i in range(40)]
    spark.createDataFrame(rows, "id string, vector array<double>").write.parquet(str(tmp_path / "v"))
    lines = ["creative_id,personas,confirmed_by,confirmed_at"] + [f"c_{i},{'Tech' if i % 2 else 'Travel'} | All,me,2026-01-01 00:00:00" for i in range(30)]
    (tmp_path / "l.csv").write_text("\n".join(lines))
    base = ["--vectors", str(tmp_path / "v"), "--labels", str(tmp_path / "l.csv"), "--model", str(tmp_path / "m")]
    suggest.main(["train", *base])
    models, about = logistic.load(spark, str(tmp_path / "m"))
    assert about["labels"] == ["All", "Tech", "Travel"] and {r.persona for r in models.collect()} == {"Tech", "Travel"}  # all have the third
    capsys.readouterr()
    suggest.main(["suggest", *base, "--id", "c_33"])
    found = json.loads(capsys.readouterr().out)
    assert found["decision"] == "suggest" and [p["name"] for p in found["personas"]] == ["Tech"] and found["personas"][0]["source"] == "template"
    assert len(found["evidence"]) == 3 and all("Tech" in e["confirmed"] for e in found["evidence"])
    with pytest.raises(ValueError, match="unknown item"):
        suggest.main(["suggest", *base, "--id", "c_99"])


def test_report(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"2026-{1 + d // 28:02}-{1 + d % 28:02}", f"G{g}", float(100 + 9 * g + (d % 7) * (3 + g % 3) + rng.random() + (20 if g < 2 and d >= 44 else 0)), float(g + d % 3), int(g < 2)) for g in range(9) for d in range(56)]
    panel = spark.createDataFrame(rows, "date string, geo string, revenue double, spend double, treated_group int").withColumn("date", F.to_date("date"))
    found = study.report(panel, "2026-02-17", 6, windows=(14, 21))
    row = found["estimates"].first()
    assert row.effect == pytest.approx(20 * 2 * 12, rel=0.1) and row.did_effect == pytest.approx(480, rel=0.1)
    assert row.trust in {"trusted", "directionally_trusted", "magnitude_uncertain", "not_trusted"}
    assert (row.trust == "not_trusted") == (not (row.effect > 0 and row.low > 0 and row.p_value < 0.1 and row.sens_low > 0))
    assert {r.geo for r in found["geo_trends"].collect()} == {"G0", "G1"} and all(0 <= r.p_value <= 1 for r in found["geo_trends"].collect())
    assert {r.excluded for r in found["pretrend_without_geo"].collect()} == {"G0", "G1"}
    assert {r.days for r in found["pretrend_windows"].collect()} == {14, 21} == {r.days for r in found["synthetic_windows"].collect()}
    loo = [r.effect for r in found["leave_one_donor_out"].collect()]
    sens = found["sensitivity"].first()
    assert (sens.least, sens.most, sens.mean) == (pytest.approx(min(loo)), pytest.approx(max(loo)), pytest.approx(np.mean(loo)))
    assert found["weights"].agg(F.sum("weight")).first()[0] == pytest.approx(1, abs=2e-3)
    study.write_report({k: found[k] for k in ("estimates", "weights")}, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "weights")).count() == found["weights"].count()


def test_storage_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, None)]
    root = {}
    for a, b in edges:
        if b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == root


def test_components_write_small_tables_to_few_files(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "src long, dst long")
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    for links, most in ((1 << 16, 1), (30, 3)):  # 79 links
        monkeypatch.setattr(graph, "LINKS_A_FILE", links, raising=False)
        staged = []
        monkeypatch.setattr(graph, "stage", lambda df, label: staged.append(storage.stage(df, label)) or staged[-1])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.node: r.component for r in graph.connected_components(edges).collect()} == want
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        files = [len(df.inputFiles()) for df in staged[1:]]  # the first table's links aren't counted yet
        assert len(files) > 5 and max(files) <= most


def test_prompt(spark):
    row = spark.range(1).select(T.prompt(F.lit("Tech"), F.lit(0.5), F.array(F.struct(F.lit("c_1").alias("id")))).alias("p")).first()
    assert "Label: Tech\nScore: 0.5000" in row.p and '[{"id":"c_1"}]' in row.p and row.p.endswith('{"rationale": "..."}')
