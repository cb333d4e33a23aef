"""Names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(name: str, df: DataFrame) -> str:
    """``name``, longer by underscores where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
