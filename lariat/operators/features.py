"""Feature columns: selection, categorical cleaning, rare-value buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lariat.functions.text import ACADEMIC_LEVELS, OTHER, UNKNOWN, fill_unknown, remap, title_case


def categorical_features(df: DataFrame) -> list[str]:
    """Names of the string columns, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def drop_column(df: DataFrame, name: str, must_exist: bool = True) -> DataFrame:
    """Drop a column; by default a missing one is an error, which Spark's drop hides."""
    if must_exist and name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.drop(name)


def normalize_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null to the sentinel, then strip and title-case; by default every string column."""
    names = set(categorical_features(df) if columns is None else columns)
    return df.select(*[title_case(fill_unknown(F.col(c), UNKNOWN)).alias(c) if c in names else F.col(c) for c in df.columns])


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent non-null values, ties by value: at most n rows."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n).select(column)


def bucket_rare(df: DataFrame, column: str, n: int = 20, other: str = OTHER, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace values outside the top n, and null, by ``other``. ``fit_on`` picks the rows that define the top (the training split, against leakage).

    The broadcast side has n rows at most.
    """
    top = top_values(fit_on if fit_on is not None else df, column, n).withColumnRenamed(column, "__top")
    joined = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")
    return joined.select(*[F.coalesce(F.col("__top"), F.lit(other)).alias(c) if c == column else F.col(c) for c in df.columns])


def remap_academic_level(df: DataFrame, column: str = "nivel_academico") -> DataFrame:
    """Spelling variants of the cleaned academic level as one value; a frame without the column stays as it is."""
    return df.withColumn(column, remap(F.col(column), ACADEMIC_LEVELS)) if column in df.columns else df


def prepare_features(df: DataFrame, normalize: bool = True, rare_top_n: int | None = 20, rare_columns: Sequence[str] = ("cliente", "area_atuacao"), fit_on: DataFrame | None = None) -> DataFrame:
    """Both preparation styles in one place: cleaning (with the academic levels' remap) and bucketing on (exploratory) or off (production)."""
    clean = lambda x: remap_academic_level(normalize_categories(x)) if normalize else x
    out = clean(df)
    fit = None if fit_on is None else clean(fit_on)
    for c in rare_columns if rare_top_n is not None else ():
        out = bucket_rare(out, c, rare_top_n, fit_on=fit)
    return out
