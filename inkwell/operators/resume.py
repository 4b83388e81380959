"""Skipping rows that already have a response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(df: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not in `done` (distinct ids).

    No broadcast hint: `done` grows with the run, so its size at run time decides
    between a broadcast and a sort-merge join. Rows without an id stay, for the
    validation to name them.
    """
    if id_col != "id":
        done = done.select(F.col("id").alias(id_col))
    return df.join(done, id_col, "left_anti")
