"""Exact-size samples and stratified splits in a deterministic hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def hash_order(key: str, seed: int = 42) -> Column:
    """md5 of 'key|seed' as hex text: any SQL engine can recompute it."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _cut(df: DataFrame, key: str, seed: int, strata: list[str], wanted: Column, bins: int) -> DataFrame:
    """Flag ``__in``: is the row among its stratum's first ``wanted`` rows (a function of the stratum's size ``__n``) in hash order?

    Ranks need no sort of whole strata: rows fall into ``bins`` equal ranges of the hash; counts per range (a combined aggregate of bins x strata rows) say which ranges lie wholly inside or outside the cut, and only the one range of each stratum that the cut crosses is ranked row by row.
    """
    from pyspark.sql import Window

    h = df.withColumn("__h", hash_order(key, seed)).withColumn("__bin", (F.conv(F.substring("__h", 1, 6), 16, 10).cast("bigint") * bins / (1 << 24)).cast("int"))
    counts = h.groupBy(*strata, "__bin").agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    ranged = counts.withColumn("__n", F.sum("__c").over(by)).withColumn("__before", F.sum("__c").over(by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)))
    ranged = ranged.select(*[F.col(s).alias(f"__s_{s}") for s in strata], F.col("__bin").alias("__b"), (wanted - F.coalesce("__before", F.lit(0))).cast("bigint").alias("__left"), "__c")
    cond = F.col("__bin") == F.col("__b")
    for s in strata:
        cond = cond & F.col(s).eqNullSafe(F.col(f"__s_{s}"))
    joined = h.join(ranged, cond)
    whole = joined.where((F.col("__left") <= 0) | (F.col("__left") >= F.col("__c"))).withColumn("__in", F.col("__left") > 0)
    crossed = joined.where((F.col("__left") > 0) & (F.col("__left") < F.col("__c")))
    order = Window.partitionBy(*strata, "__bin").orderBy("__h", key)
    crossed = crossed.withColumn("__in", F.row_number().over(order) <= F.col("__left"))
    return whole.unionByName(crossed).select(*df.columns, "__in")


def exact_sample(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, bins: int = BINS) -> DataFrame:
    """round(fraction * n) rows (half to even), without replacement, the first in hash order."""
    return _cut(df, key, seed, [], F.bround(F.lit(float(fraction)) * F.col("__n"), 0), bins).where("__in").drop("__in")


def stratified_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: int = 42, bins: int = BINS) -> DataFrame:
    """Append ``is_test``: floor(test_size * n + 0.5) rows of each class, in hash order. Both halves are one frame, so they are disjoint and exhaustive by construction."""
    return _cut(df, key, seed, [target], F.floor(F.lit(float(test_size)) * F.col("__n") + F.lit(0.5)), bins).withColumnRenamed("__in", "is_test")
