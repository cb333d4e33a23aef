"""Cached embeddings: a folder with a table of vectors for each modality and the items' metadata."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What is kept of an item beside its vectors.
METADATA = ("creative_id", "ad_size", "image_path", "launched_at")


def metadata(creatives: DataFrame) -> DataFrame:
    return creatives.select(*METADATA)


def save(folder: str, modalities: dict[str, DataFrame], about: DataFrame) -> None:
    """Write each modality, (id, vector), and the metadata under ``folder``, over what was there."""
    for name, table in modalities.items():
        table.select("id", "vector").write.mode("overwrite").parquet(f"{folder}/{name}")
    about.write.mode("overwrite").parquet(f"{folder}/metadata")


def load(spark: SparkSession, folder: str, names: list[str], dim: int | None = None, id_col: str = "creative_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The modalities and the metadata, once each modality is seen to hold the metadata's ids exactly, each once, with
    vectors of one length; a ValueError otherwise."""
    about = spark.read.parquet(f"{folder}/metadata")
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    for name, table in found.items():
        wrong = shape(table, about.select(F.col(id_col).alias("id")), dim).first().asDict()
        if any(wrong.values()):
            raise ValueError(f"{name}: " + ", ".join(f"{k} {v}" for k, v in wrong.items() if v))
    return found, about


def shape(table: DataFrame, ids: DataFrame, dim: int | None = None) -> DataFrame:
    """One row of counts: repeated ids, ids without a vector, vectors without an id, vectors of another length than
    ``dim`` or, without one, than the longest."""
    size = F.size("vector")
    per = table.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))
    both = per.join(ids.select("id", F.lit(True).alias("known")), "id", "full").crossJoin(F.broadcast(table.agg((F.max(size) if dim is None else F.lit(dim)).alias("dim"))))
    return both.agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("n").isNull()).alias("without_vector"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.count_if((F.col("low") != F.col("dim")) | (F.col("high") != F.col("dim"))).alias("misshapen"),
    )


def read_npy(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """(row, vector) of a two-dimensional .npy file, row by row as it lies there. The file is one task's."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                table = np.load(io.BytesIO(cell.as_buffer()), allow_pickle=False)
                if table.ndim != 2:
                    raise ValueError("a matrix is wanted")
                for low in range(0, len(table), rows):
                    part = np.ascontiguousarray(table[low : low + rows], dtype=np.float32)
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(part))), lists], names=["row", "vector"])

    return files.mapInArrow(run, "row long, vector array<float>")
