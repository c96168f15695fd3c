"""What several operators share: lineage cuts, and fast exact word handling in Python workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: An Arrow batch has at most so many rows and about so many bytes: the JVM keeps the largest buffers it ever used.
ARROW_ROWS = 250
ARROW_BYTES = 4 << 20
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local master may leave it unset: then it is a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "lariat-checkpoints")).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    # Shuffle files of what earlier checkpoints replaced go once the driver has collected its garbage.
    gc.collect()
    context._jvm.System.gc()
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write as Parquet into the shared folder and read again."""
    return Scratch(df.sparkSession)(df)


class Scratch:
    """Tables that cut lineage, written as Parquet into the shared folder; drop() deletes them once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.split(df)[0]

    def split(self, df: DataFrame, by: str | None = None, values: Iterable[int] = ()) -> list[DataFrame]:
        """The table, or a part of it for each of the values of the column ``by``, each in a folder of its own."""
        path, schema = f"{shared_folder(self.spark)}/lariat-{uuid.uuid4().hex}", df.schema
        # A writer holds a row group in memory: small ones leave room for the Python workers.
        write = df.write.option("parquet.block.size", ROW_GROUP)
        (write.partitionBy(by) if by else write).parquet(path)
        del df
        # Shuffle files that the table replaces go once the driver has collected its garbage.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        if by is None:
            self.paths.append([path])
            return [self.spark.read.schema(schema).parquet(path)]
        schema = StructType([f for f in schema.fields if f.name != by])
        parts = [f"{path}/{by}={v}" for v in values]
        self.paths += [[p] for p in parts[:-1]] + [[parts[-1], path]]
        there = self._folder(path)
        return [self.spark.read.schema(schema).parquet(p) if there.exists(self._path(p)) else self.spark.createDataFrame([], schema) for p in parts]

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, number: int | None = None) -> None:
        """Delete all tables, or the one with this number in the order of their making."""
        for paths in self.paths if number is None else [self.paths[number]]:
            for path in paths:
                self._folder(path).delete(self._path(path), True)


#: A key that holds more than one row in so many is joined by broadcast: no more keys than that can.
HOT_PARTS = 2_000


def join_each(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has a row a key and in column ``n`` how many of the ``total`` rows of ``left`` have it. Rows of hot keys stay where they are; the others are shuffled, of which no key has more than one in HOT_PARTS."""
    hot = F.col(n) > max(2, total // HOT_PARTS)
    few = F.broadcast(right.where(hot).drop(n))
    return left.join(few, on).unionByName(left.join(few.select(*on), on, "left_anti").join(right.where(~hot).drop(n), on))


def kept_names(keep: list[str], outputs: Iterable[str]) -> list[str]:
    """Names of kept columns beside an operator's outputs: one that clashes gets underscores at its end until it does not."""
    names, taken = [], set(outputs)
    for name in keep:
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names


def masked(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows as doc_id, text and column_0, column_1, ...: no name can clash with an operator's own; and the way back."""
    others = [c for c in docs.columns if c not in (text, doc_id)]
    names = {doc_id: "doc_id", text: "text"} | {c: f"column_{i}" for i, c in enumerate(others)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), lambda out: out.select(*[out[names[c]].alias(c) for c in docs.columns])


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they may not share the driver's import path. Arrow batches are kept small, for texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if getattr(context, "_lariat_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lariat_workers.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    context._lariat_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and idles beside other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over batches, whose worker gives memory back at the task's end."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def with_rids(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows with ``rid``, whose order is doc_id's. Where an id is missing or repeats, rows are numbered in the order of id (null first) and text's hash; rows equal in both in any order."""
    ship(docs.sparkSession)
    d = F.col(doc_id).cast("bigint")
    odd = docs.agg(F.count("*").alias("n"), F.count(d).alias("k")).first()
    if odd.n == odd.k and docs.select(d.alias("d")).distinct().count() == odd.n:
        return docs.withColumn("rid", d)
    # Numbers rise with the partition and the place in it, so they follow the sort; they need not be without gaps.
    return materialise(docs.orderBy(d.asc_nulls_first(), F.xxhash64(text)).withColumn("rid", F.monotonically_increasing_id()))


class WordHashes(dict):
    """word (bytes) -> signed 64-bit hash; forgets everything at ``limit`` words, so memory is bounded."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h


def hash_words(words: Iterable[bytes], cache: WordHashes) -> np.ndarray:
    words = words if isinstance(words, list) else list(words)
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))


def space_words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+: bytes.split splits at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: For words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over text with A-Z lower-cased: digits, a-z and every byte from 0x80 stay, anything else parts words.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every k consecutive words; fewer words than k give one hash of them all, none give none."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    h = hashes.view(np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return out
