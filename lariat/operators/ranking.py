"""Top-k by score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """The n highest scores, NaN and null last, ties by key; one TakeOrderedAndProject, so no task sees more than n rows of another."""
    if n < 0:
        raise ValueError("n must not be negative")
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    return df.orderBy(value.desc_nulls_last(), F.col(key).asc()).limit(n)
