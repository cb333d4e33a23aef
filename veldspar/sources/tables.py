"""Tables in files: readers that hold to a contract, and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Contract:
    """What a table must hold: columns with types, a unique key, columns without nulls, without negative values,
    and with 0 and 1 only. Other columns are let through."""

    schema: str
    key: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]


CREATIVES = Contract("creative_id string, ad_size string, ad_text string, image_path string, launched_at timestamp", ("creative_id",), ("creative_id", "ad_text", "image_path"))
LABELS = Contract("creative_id string, personas string, confirmed_by string, confirmed_at timestamp", (), ("creative_id", "personas"))
PAIRS = Contract("pair_id string, creative_id_a string, creative_id_b string, is_duplicate int", ("pair_id",), (), (), ("is_duplicate",))
PANEL = Contract("date date, geo string, revenue double, spend double, treated_group int", ("geo", "date"), ("date", "geo", "revenue", "spend", "treated_group"), ("revenue", "spend"), ("treated_group",))
CLUSTERS = Contract("creative_id string, cluster_id int", ("creative_id",))


def violations(table: DataFrame, contract: Contract) -> DataFrame:
    """One row of counts: repeated_keys, and for each rule null_<c>, negative_<c>, not_flag_<c>.

    One pass: rows are counted by key before the shuffle, and the sums of that are added up. A null key counts as
    a key. An empty table breaks no rule.
    """
    rules = {f"null_{c}": F.col(c).isNull() for c in contract.filled}
    rules |= {f"negative_{c}": F.col(c) < 0 for c in contract.positive}
    rules |= {f"not_flag_{c}": ~F.col(c).isin(0, 1) for c in contract.flags}
    bad = [F.count_if(rule).alias(name) for name, rule in rules.items()]
    if not contract.key:
        return table.agg(F.lit(0).cast("long").alias("repeated_keys"), *bad)
    by_key = table.groupBy(*contract.key).agg(F.count(F.lit(1)).alias("_n"), *bad)
    return by_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_keys"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rules])


def checked(table: DataFrame, contract: Contract) -> DataFrame:
    """``table`` if it holds to the contract; a ValueError naming what doesn't otherwise."""
    missing = sorted(set(contract.columns) - set(table.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    broken = {k: v for k, v in violations(table, contract).first().asDict().items() if v}
    if broken:
        raise ValueError("contract broken: " + ", ".join(f"{k} {v}" for k, v in broken.items()))
    return table


def read(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A Parquet table, or a CSV one with a header where the path ends in .csv; columns of the contract are cast.

    A CSV value that isn't of its column's type is an error at the first action, never a null.
    """
    table = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    missing = sorted(set(contract.columns) - set(table.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = dict(part.split() for part in contract.schema.split(", "))
    return checked(table.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in table.columns]), contract)


def read_personas(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, definition) from a YAML list of such mappings; each of ``names`` must be there."""
    import yaml

    with open(path, encoding="utf-8") as file:
        held = yaml.safe_load(file)
    entries = held["personas"] if isinstance(held, dict) and "personas" in held else held
    rows = [(e["name"], e.get("definition")) for e in entries]
    missing = sorted(set(names or []) - {n for n, _ in rows})
    if missing:
        raise ValueError(f"missing personas: {', '.join(missing)}")
    return spark.createDataFrame(rows, "name string, definition string")


def write(table: DataFrame, path: str, kind: str = "parquet", files: int | None = None) -> None:
    """Write as parquet, csv (with a header) or json, over what was there. ``files`` bounds the number of files; it
    is for small results, as it bounds the tasks too."""
    out = table if files is None else table.coalesce(files)
    out.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)
