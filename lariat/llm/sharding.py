"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned, overfull ranges are subdivided, and exact range totals turn ranks into shards of near-equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import materialise, ship

#: Bounds of what reaches the driver: sampled keys, and ranges.
SAMPLES = 8192
RANGES = 256
#: A group of equal texts above this share of a shard is cut row by row; smaller ones stay together.
GROUP_SHARE = 0.05


def _range_udf(bounds: list[tuple[int, int]]):
    """(group, doc) -> number of boundaries at or before it."""
    groups = np.array([b[0] for b in bounds], np.int64)
    docs = np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def of(g: pd.Series, d: pd.Series) -> pd.Series:
        g, d = g.to_numpy(np.int64), d.to_numpy(np.int64)
        lo, hi = np.searchsorted(groups, g, "left"), np.searchsorted(groups, g, "right")
        # A group that boundaries cut or start: all its rows of the batch are searched at once.
        cut = np.flatnonzero(hi > lo)
        cut = cut[np.argsort(lo[cut], kind="stable")]
        for part in np.split(cut, np.flatnonzero(np.diff(lo[cut])) + 1) if len(cut) else ():
            a, b = lo[part[0]], hi[part[0]]
            lo[part] = a + np.searchsorted(docs[a:b], d[part], "right")
        return pd.Series(lo, dtype="int32")

    return of


def sampled_splitters(keys: DataFrame, total: int, ranges: int, samples: int, seed: int) -> list[tuple[int, int]]:
    """Boundaries (group, doc): weighted quantiles of about ``samples`` keys. Every row rings an exponential clock as often as its size says, until a time at which ``samples`` of the ``total`` bytes have rung: a row is drawn with the chance that it rang at all, by a hash, so retries draw the same, and rows equal in both are drawn as one; what reaches the driver is ``samples`` rows in all, whatever the partitions. A boundary stands at a group's start unless several fall into one group: then that group is cut by doc."""
    low = np.iinfo(np.int64).min
    u = (F.pmod(F.xxhash64("g", "d", F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    rang = -F.log(u) <= F.col("size") * F.lit(samples / max(1, total))
    rows = sorted((r.g, r.d) for r in keys.where(rang).select("g", "d").distinct().collect())
    if not rows:
        return []
    cuts = [rows[len(rows) * i // ranges] for i in range(1, ranges)]
    times: dict[int, int] = {}
    for g, _ in cuts:
        times[g] = times.get(g, 0) + 1
    return sorted({(g, d if times[g] > 1 else low) for g, d in cuts} | {(g, low) for g, n in times.items() if n > 1})


def shard_by_splitters(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", ranges: int = RANGES, samples: int = SAMPLES, group_share: float = GROUP_SHARE, seed: int = 7, rounds: int = 3) -> DataFrame:
    """(doc_id, size, text_crc32, group_hash, shard, slot) for every row.

    Keys are (hash of the text, doc_id), so equal texts are neighbours. Sizes are UTF-8 bytes plus 1; null text has no bytes, size 1 and checksum 0 and groups with other nulls; a null doc_id sorts first and equal rows are told apart arbitrarily. Empty input gives no rows. Shards are cut where the exact running byte count passes multiples of total/shards: a shard's bytes miss the mean by at most one row, plus groups kept whole (``group_share`` of a shard each).

    Texts of any length weigh their bytes and are never moved: only their hash, size and checksum are. Repeated rows are rows of their own. Other columns are left out, whatever their names.

    Only sampled keys (about ``samples``) and range totals (``ranges`` times the splits) reach the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    low = np.iinfo(np.int64).min
    keys = materialise(docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(low)).alias("d"),
        F.coalesce(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()), F.lit(0)).alias("g"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("bigint").alias("text_crc32"),
    ))
    total = keys.agg(F.sum("size").alias("s")).first().s or 0
    bounds = sampled_splitters(keys, total, ranges, samples, seed)
    for r in range(rounds + 1):
        ranged = keys.withColumn("r", _range_udf(bounds)("g", "d") if bounds else F.lit(0))
        sums = {x.r: (x.b, x.n, x.one) for x in ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"), (F.min(F.struct("g", "d")) == F.max(F.struct("g", "d"))).alias("one")).collect()}
        # Subdivide what holds over twice its share, unless it is one key repeated.
        over = [k for k, (b, n, one) in sums.items() if b > 2 * max(1, total / ranges) and n > 64 and not one]
        if not over or r == rounds:
            break
        wide = ranged.where(F.col("r").isin(over))
        bounds = sorted(set(bounds) | set(sampled_splitters(wide, sum(sums[k][0] for k in over), min(ranges, 4 * len(over)) + 1, samples, seed + r + 1)))

    order = sorted(sums)
    before_b, before_n, b, n = {}, {}, 0, 0
    for k in order:
        before_b[k], before_n[k] = b, n
        b, n = b + sums[k][0], n + sums[k][1]
    offsets = spark.createDataFrame([(k, before_b[k], before_n[k]) for k in order] or [(0, 0, 0)], "r int, range_b bigint, range_n bigint")
    w = Window.partitionBy("r").orderBy("g", "d", "text_crc32")
    rows = ranged.withColumns({"end": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)}).join(F.broadcast(offsets), "r")
    rows = rows.withColumns({"end": F.col("end") + F.col("range_b"), "place": F.col("place") + F.col("range_n") - 1})
    # A group inside one range is judged by its middle; what a boundary cuts is larger than a range and judged by row.
    gw = Window.partitionBy("r", "g")
    rows = rows.withColumns({"g_bytes": F.sum("size").over(gw), "g_end": F.max("end").over(gw)})
    whole = F.col("g_bytes") <= F.lit(group_share * max(1.0, total / shards))
    middle = F.when(whole, F.col("g_end") - F.col("g_bytes") / F.lit(2.0)).otherwise(F.col("end") - F.col("size") / F.lit(2.0))
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(1, total))))).cast("int"))
    rows = materialise(rows.select("doc_id", "size", "text_crc32", F.col("g").alias("group_hash"), "shard", "place"))
    starts = rows.groupBy("shard").agg(F.min("place").alias("start"))  # one row a shard
    return rows.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "group_hash", "shard", (F.col("place") - F.col("start")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """The records themselves, in one folder a shard, each sorted by slot. Needs unique doc_ids."""
    docs.join(assigned.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
