"""Image files of creatives: whether they are there, and their pixels."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldspar.functions.text import local_path

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def resolved(path: Column, folder: str) -> Column:
    """The full path of an image: as it is if absolute; under the folder's parent if it begins with the folder's own
    name; else under the folder."""
    folder = folder.rstrip("/")
    parent, _, name = folder.rpartition("/")
    return F.when(path.rlike("^(/|[a-z0-9]+://)"), path).when(F.startswith(path, F.lit(f"{name}/")), F.concat(F.lit(f"{parent}/"), path)).otherwise(F.concat(F.lit(f"{folder}/"), path))


def missing(creatives: DataFrame, folder: str, path_col: str = "image_path") -> DataFrame:
    """The rows of ``creatives`` whose image isn't under ``folder``, with column full_path. Files are listed, not read;
    a null path is missing. Absolute paths must lie under the folder too."""
    listed = creatives.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(local_path(F.col("path")).alias("_file"))
    rows = creatives.withColumn("full_path", resolved(F.col(path_col), folder))
    return rows.join(listed, local_path(F.col("full_path")) == F.col("_file"), "left_anti")


def check(creatives: DataFrame, folder: str, path_col: str = "image_path") -> DataFrame:
    """``creatives`` if all images are there; a FileNotFoundError with the number missing and ten of them otherwise."""
    gone = missing(creatives, folder, path_col)
    count = gone.count()
    if count:
        raise FileNotFoundError(f"{count} images are missing, among them {[r.full_path for r in gone.select('full_path').orderBy('full_path').limit(10).collect()]}")
    return creatives


def rgb(data: bytes) -> np.ndarray:
    """Rows, columns and the three colours of an image. PNG files of eight bits that aren't interlaced are read here,
    others where Pillow is installed; a ValueError otherwise."""
    if data[:8] == _PNG and data[24] == 8 and data[28] == 0:
        return _png(data)
    try:
        from PIL import Image
    except ImportError as none:
        raise ValueError("only plain PNG files can be read without Pillow") from none
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))


def _png(data: bytes) -> np.ndarray:
    width, height, _, kind = struct.unpack(">IIBB", data[16:26])
    at, packed, palette = 8, [], None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        elif name == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + size], dtype=np.uint8).reshape(-1, 3)
        at += size + 12
    n = _CHANNELS.get(kind, 1)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), dtype=np.uint8)
    above = np.zeros(width * n, dtype=np.int64)
    for y in range(height):
        line, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            line = line + above
        elif how:  # each pixel depends on the one to its left
            for x in range(width * n):
                left, corner = (line[x - n], above[x - n]) if x >= n else (0, 0)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, n)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3]


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, pixels, error) of each file under ``folder``: rows of RGB bytes, or why there are none.
    A task holds one image at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found, why = rgb(content.as_py()), None
                except Exception as bad:  # any decoder's error is the row's, not the job's
                    found, why = None, str(bad)
                shape = (None, None) if found is None else found.shape[:2]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([None if found is None else found.tobytes()], pa.binary()), pa.array([why], pa.string())], names=["path", "height", "width", "pixels", "error"])

    return files.mapInArrow(run, "path string, height int, width int, pixels binary, error string")
