"""Distribution drift between two frames, as a DataFrame of one row per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

CATEGORICAL_THRESHOLD = 0.1
NUMERIC_THRESHOLD = 0.1
DATASET_SHARE = 0.5


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = CATEGORICAL_THRESHOLD) -> DataFrame:
    """Jensen-Shannon distance (base 2) of value frequencies; nulls left out. All columns are unpivoted, so it is one aggregation per frame, however many columns."""

    def frequencies(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
        counts = df.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        total = counts.groupBy("column").agg(F.sum("n").alias("total"))
        return counts.join(total, "column").select("column", "value", (F.col("n") / F.col("total")).alias(name))

    both = frequencies(reference, "p").join(frequencies(current, "q"), ["column", "value"], "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / F.lit(2.0)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(F.lit(0.0))
    out = both.groupBy("column").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part("p") + part("q")) / F.lit(2.0))).alias("statistic"))
    return out.select("column", F.lit("categorical").alias("kind"), "statistic", F.lit(float(threshold)).alias("threshold"), (F.col("statistic") >= threshold).alias("drifted"))


def numeric_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = NUMERIC_THRESHOLD) -> DataFrame:
    """Difference of means in units of the reference's standard deviation (0 if both are constant and equal, infinite if only the mean moved)."""

    def moments(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(*[f(c).alias(f"{c}.{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}.m`").cast("double").alias(f"{name}_mean"), F.col(f"`{c}.s`").cast("double").alias(f"{name}_sd")) for c in columns])
        return sums.select(F.inline(rows))

    both = moments(reference, "a").join(moments(current, "b"), "column")
    gap = F.abs(F.col("a_mean") - F.col("b_mean"))
    stat = F.when(gap == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(gap, F.col("a_sd")), F.lit(float("inf"))))
    return both.select("column", F.lit("numeric").alias("kind"), stat.alias("statistic"), F.lit(float(threshold)).alias("threshold"), (stat >= threshold).alias("drifted"))


def drift_report(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, statistic, threshold, drifted) for every string and numeric column of both frames."""
    fields = [f for f in reference.schema.fields if f.name in (columns if columns is not None else current.columns)]
    text = [f.name for f in fields if isinstance(f.dataType, StringType)]
    numeric = [f.name for f in fields if isinstance(f.dataType, NumericType)]
    parts = ([categorical_drift(reference, current, text)] if text else []) + ([numeric_drift(reference, current, numeric)] if numeric else [])
    if not parts:
        raise ValueError("no column to compare")
    return reduce(DataFrame.unionByName, parts)


def dataset_drift(report: DataFrame, share: float = DATASET_SHARE) -> DataFrame:
    """Does the share of drifted columns reach ``share``?"""
    got = F.avg(F.col("drifted").cast("double"))
    return report.agg(got.alias("share"), (got >= share).alias("drifted"))


def drift_html(report: DataFrame) -> str:
    """The report (one row per column, so small by construction) as an HTML table."""
    from html import escape

    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in row) + "</tr>"
    return "<table>" + cells("th", report.columns) + "".join(cells("td", r) for r in report.orderBy("column").collect()) + "</table>"


def write_drift_html(report: DataFrame, path: str) -> None:
    """The table as one text file in the folder ``path``, at any URI that Spark writes to."""
    page = report.sparkSession.createDataFrame([(drift_html(report),)], "html string")
    page.coalesce(1).write.mode("overwrite").text(path)
