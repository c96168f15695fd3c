"""Which 48-bit keys occur more than once, and where: one shuffle of packed, sorted key blocks instead of a row a key, then a sort in each key range. What occurs once never leaves its range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import lean, ship

#: Keys a range holds on average, and keys a task gathers before it sends its blocks.
RANGE_KEYS = 400_000
BLOCK_KEYS = 150_000
#: Keys that a sample of rows finds this often skip the ranges: they are known to be shared, and only their place in the order depends on it. The sample is one row in SAMPLE_PART, and SAMPLE_ROWS at least, so that a key missed stands in few rows beside what a range holds.
SAMPLE_ROWS = 8_000
SAMPLE_PART = 10_000
HOT_IN_SAMPLE = 8
HOT_KEYS = 50_000
HOT_COUNT = 1 << 60
#: Keys are below 2^KEY_BITS and spread evenly.
KEY_BITS = 48

Emit = Callable[[pd.DataFrame], tuple[np.ndarray, list[np.ndarray]]]


def planes(a: np.ndarray) -> bytes:
    """Byte planes of non-negative integers, without the empty high ones."""
    p = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not p[used - 1].any():
        used -= 1
    return bytes([used]) + p[:used].tobytes()


def from_planes(b: bytes) -> np.ndarray:
    used = b[0]
    p = np.frombuffer(b, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :used] = p.T
    return out.view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b), dtype=np.uint64)


def pack_values(a: np.ndarray) -> bytes:
    """Signed values, small ones in few planes."""
    z = a.view(np.uint64)
    return planes((z << np.uint64(1)) ^ (np.uint64(0) - (z >> np.uint64(63))))


def unpack_values(b: bytes) -> np.ndarray:
    z = from_planes(b)
    return ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64)


def hot_keys(rows: DataFrame, emit: Callable[[], Emit], order: str, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Frequent keys of a sample of rows, picked by a hash of the column ``order``; at most HOT_KEYS: others stay in their ranges."""
    n = rows.count()
    part = max(1, n // max(1, sample, n // SAMPLE_PART))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = emit()
        for b in batches:
            k, c = np.unique(f(b)[0], return_counts=True)
            yield pd.DataFrame({"key": k.view(np.int64), "n": c})

    some = rows.where(F.pmod(F.xxhash64(order), F.lit(part)) == 0)
    found = some.mapInPandas(lean(keys), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_IN_SAMPLE)
    return np.sort(np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()], np.int64).view(np.uint64))


def shared_keys(rows: DataFrame, emit: Callable[[], Emit], payload: list[str], total: int, order: str) -> DataFrame:
    """(key, *payload, n) of every key that occurs more than once; n is how often, HOT_COUNT for hot ones (of which even a single occurrence is given).

    ``emit()`` makes a function from a batch to (keys below 2^KEY_BITS as uint64, payload arrays of int64). ``total``: about how many keys there are, which sets the number of ranges.
    """
    ship(rows.sparkSession)
    ranges = max(1, -(-int(total) // RANGE_KEYS))
    context = rows.sparkSession.sparkContext
    hot = context.broadcast(hot_keys(rows, emit, order))
    names = [f"v{i}" for i in range(len(payload))]
    limits = np.array([(r << KEY_BITS) // ranges for r in range(1, ranges)], np.uint64)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, held, size = emit(), [], 0

        def flush() -> pd.DataFrame:
            keys = np.concatenate([k for k, _ in held])
            values = [np.concatenate([v[i] for _, v in held]) for i in range(len(names))]
            is_hot = np.isin(keys, hot.value)
            out = []
            for flag in (False, True):
                k, v = keys[is_hot == flag], [x[is_hot == flag] for x in values]
                o = np.argsort(k)
                k, v = k[o], [x[o] for x in v]
                # Hot keys need no partners: each block of them is a group of its own.
                cuts = [0, *np.searchsorted(k, limits, "left").tolist(), len(k)] if not flag else [0, len(k)]
                name = -1 - int((k[:1].sum() ^ v[0][:1].view(np.uint64).sum()) >> np.uint64(2)) if len(k) else -1
                out += [(name if flag else r, pack(k[a:b]), *[pack_values(x[a:b]) for x in v]) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            held.clear()
            return pd.DataFrame(out, columns=["r", "k", *names])

        for batch in batches:
            for i in range(0, len(batch), 500):
                held.append(f(batch.iloc[i : i + 500]))
                size += len(held[-1][0])
                if size >= BLOCK_KEYS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def repeated(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(b) for b in group["k"]])
        values = [np.concatenate([unpack_values(b) for b in group[v]]) for v in names]
        if group["r"].iloc[0] < 0:
            keep, n = slice(None), np.full(len(keys), HOT_COUNT)
        else:
            o = np.argsort(keys)
            keys, values = keys[o], [v[o] for v in values]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(starts, len(keys)))
            keep = np.repeat(n > 1, n)
            n = np.repeat(n, n)[keep]
        return pd.DataFrame({"key": keys[keep].view(np.int64)} | {p: v[keep] for p, v in zip(payload, values, strict=True)} | {"n": n})

    schema = "key bigint, " + ", ".join(f"{p} bigint" for p in payload) + ", n bigint"
    packed = rows.mapInPandas(lean(blocks), "r bigint, k binary, " + ", ".join(f"{v} binary" for v in names))
    return packed.groupBy("r").applyInPandas(repeated, schema)
