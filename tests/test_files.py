"""Readers, contracts, sinks and the study's front end on small files."""

import random

import pytest

from veldspar.plans import study
from veldspar.sources import tables


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    rng, path = random.Random(4), tmp_path_factory.mktemp("panel") / "panel.csv"
    lines = ["date,geo,revenue,spend,treated_group"]
    for g in range(9):
        for d in range(40):
            value = 100 + 9 * g + (d % 7) * (3 + g % 3) + rng.random() + (20 if g < 2 and d >= 30 else 0)
            lines.append(f"2026-{1 + d // 28:02}-{1 + d % 28:02},G{g},{value},{g},{int(g < 2)}")
    path.write_text("\n".join(lines))
    return str(path)


def test_study(spark, csv, tmp_path, capsys):
    study.main(["--panel", csv, "--start", "2026-02-03", "--placebos", "8", "--out", str(tmp_path / "out")])
    shown = dict(line.split(": ") for line in capsys.readouterr().out.strip().splitlines())
    assert abs(float(shown["effect"]) - 400) < 40 and abs(float(shown["did"]) - 20) < 3
    assert float(shown["low"]) <= float(shown["high"]) and float(shown["p_value"]) == pytest.approx(1 / 9)


def test_contracts(spark, csv):
    held = tables.read(spark, csv, tables.PANEL)
    assert held.count() == 360 and dict(held.dtypes)["date"] == "date"
    assert tables.checked(held.where("false"), tables.PANEL).count() == 0
    twice = held.unionByName(held.limit(1)).selectExpr("date", "geo", "-revenue AS revenue", "spend", "treated_group + 1 AS treated_group")
    found = tables.violations(twice, tables.PANEL).first()
    assert (found.repeated_keys, found.negative_revenue, found.negative_spend) == (1, 361, 0)
    assert found.not_flag_treated_group == twice.where("treated_group = 2").count()
    with pytest.raises(ValueError, match="repeated_keys 1"):
        tables.checked(held.unionByName(held.limit(1)), tables.PANEL)
    with pytest.raises(ValueError, match="missing columns: geo, spend"):
        tables.checked(held.drop("geo", "spend"), tables.PANEL)


def test_sinks(spark, csv, tmp_path):
    held = tables.read(spark, csv, tables.PANEL)
    for kind in ("parquet", "csv", "json"):
        tables.write(held, f"{tmp_path}/{kind}", kind, files=1)
    rows = sorted(map(tuple, held.collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet").collect())) == rows
    assert sorted(map(tuple, spark.read.schema(tables.PANEL.schema).option("header", True).csv(f"{tmp_path}/csv").collect())) == rows
    assert spark.read.json(f"{tmp_path}/json").count() == 360


def test_personas(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("- name: Tech\n  definition: gadgets\n- name: Travel\n")
    assert {r.name: r.definition for r in tables.read_personas(spark, str(path), ["Tech"]).collect()} == {"Tech": "gadgets", "Travel": None}
    with pytest.raises(ValueError, match="missing personas: Food"):
        tables.read_personas(spark, str(path), ["Food"])
