"""Frequency, rate and classification summaries. Null keys are left out, ties go to the smaller value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return _known(df, column).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Share of all non-null rows. The total is a one-row aggregate of the counts, not a window over one partition."""
    counts = _known(df, column).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select(column, (F.col("n") / F.col("__total")).alias("share")).orderBy(F.desc("share"), column)


def rate_by(df: DataFrame, column: str, target: str = "target") -> DataFrame:
    return _known(df, column).groupBy(column).agg(F.avg(target).alias("rate")).orderBy(F.desc_nulls_last("rate"), column)


def count_and_rate_by(df: DataFrame, column: str, target: str = "target", top: int = 15) -> DataFrame:
    """Count of non-null targets and their mean, by count, first ``top`` groups."""
    groups = _known(df, column).groupBy(column).agg(F.count(target).alias("n"), F.avg(target).alias("rate"))
    return groups.orderBy(F.desc("n"), column).limit(top)


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return value_counts(df, target)


def class_ratio(df: DataFrame, target: str = "target") -> DataFrame:
    """majority / minority, at least 1; an error unless there are two classes."""
    counts = class_counts(df, target)
    two = F.when(F.count("*") == 2, F.max("n") / F.min("n")).otherwise(F.raise_error(F.lit("exactly two classes are needed")).cast("double"))
    return counts.agg(two.alias("ratio"))


def confusion_matrix(df: DataFrame, actual: str = "target", predicted: str = "prediction") -> DataFrame:
    """Rows actual, columns predicted_0 and predicted_1; always both rows."""
    seen = df.groupBy(F.col(actual).cast("int").alias("actual")).agg(*[F.count(F.when(F.col(predicted) == k, 1)).alias(f"predicted_{k}") for k in (0, 1)])
    both = df.sparkSession.sql("select * from values (0), (1) as t(actual)")
    return both.join(F.broadcast(seen.where("actual in (0, 1)")), "actual", "left").na.fill(0).orderBy("actual")


def confusion_percent(df: DataFrame, actual: str = "target", predicted: str = "prediction") -> DataFrame:
    """Each row of the matrix as per cent of its sum; a row without cases is null."""
    total = F.col("predicted_0") + F.col("predicted_1")
    return confusion_matrix(df, actual, predicted).select("actual", *[F.try_divide(F.lit(100.0) * F.col(f"predicted_{k}"), total).alias(f"percent_{k}") for k in (0, 1)])


def classification_report(df: DataFrame, actual: str = "target", predicted: str = "prediction") -> DataFrame:
    """label, precision, recall, f1, support for 0, 1, accuracy, macro avg and weighted avg; 0 on division by zero. One pass over the rows, then constant-size rows."""
    a, p = F.col(actual), F.col(predicted)
    sums = df.agg(*[F.count(F.when((a == i) & (p == j), 1)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    n = {(i, j): F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1)}
    for k in (0, 1):
        o = 1 - k
        sums = sums.withColumns({f"p{k}": ratio(n[k, k], n[k, k] + n[o, k]), f"r{k}": ratio(n[k, k], n[k, k] + n[k, o]), f"s{k}": n[k, k] + n[k, o]})
        sums = sums.withColumn(f"f{k}", ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}")))
    total = F.col("s0") + F.col("s1")
    accuracy = ratio(n[0, 0] + n[1, 1], total)
    macro = lambda x: (F.col(f"{x}0") + F.col(f"{x}1")) / F.lit(2.0)
    weighted = lambda x: ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), total)
    row = lambda name, pr, re, f1, s: F.struct(F.lit(name).alias("label"), pr.alias("precision"), re.alias("recall"), f1.alias("f1"), s.cast("bigint").alias("support"))
    rows = [row(str(k), F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}")) for k in (0, 1)]
    rows += [row("accuracy", accuracy, accuracy, accuracy, total), row("macro avg", *map(macro, "prf"), total), row("weighted avg", *map(weighted, "prf"), total)]
    return sums.select(F.inline(F.array(*rows)))


