"""Packing by cutting-stock column generation: a linear program over length-histogram patterns, priced by knapsack dynamic programming; rounded patterns are assigned to ranked documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import lean, materialise, ship

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Lengths enter the program in steps of UNIT tokens, rounded up: at most CAPACITY / UNIT kinds, whatever the corpus.
UNIT = 8
GAP = 0.0005  # the program stops this close to its bound
ROWS_A_RANK = 1_000
MAX_SALTS = 1024


#: Latin-1 text without apostrophes, which the tokenizer splits into runs of letters, single digits and runs of the rest; for it, lower-casing is a matter of single letters. Other chunks are encoded as they are.
_PLAIN = re.compile("[!-&(-~\u00a1-\u00ff]+")
#: The same with white space: a whole text that is split at once.
_PLAIN_TEXT = re.compile("[\t-\r !-&(-~\u00a1-\u00ff]*")
_PIECE = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\t-\r a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")


class ChunkIds(dict):
    """White-space-free chunk (bytes) -> its ids as little-endian uint32 bytes. Exact: the tokenizer drops white space, and neither its normaliser nor its words reach across it. Forgets everything at ``limit`` chunks."""

    limit = 150_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        self.words = _WordIds(tokenizer)

    def of_text(self, text: str) -> bytes:
        """Plain texts go word by word, of which far fewer are distinct than chunks; others chunk by chunk."""
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = chunk.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.words.__getitem__, _PIECE.findall(text.lower())))
        else:
            ids = _encoded(self.encode, text)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class _WordIds(dict):
    """A word of the tokenizer's own splitting -> its ids. Two generations of ``limit`` words: what the newer lacks it takes over from the older, so frequent words stay and rare ones go."""

    limit = 100_000

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            # The model alone: the word is lower-cased and split already, and its bytes become the vocabulary's characters here.
            ids = np.array([t.id for t in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))], "<u4").tobytes()
        self[word] = ids
        return ids


#: Byte-level vocabularies write a byte as itself if it is printable Latin-1, else as the next character from U+0100 on.
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF))}


def _encoded(encode, text: str) -> bytes:
    return np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_CACHES: dict[str, ChunkIds] = {}


def chunk_ids(path: str | None) -> ChunkIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _CACHES:
        _CACHES[path] = ChunkIds(path)
    return _CACHES[path]


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and cut: pieces of ``capacity`` ids, then half a piece while the rest is longer, then the rest: pieces between a half and a whole sequence leave gaps that little fits. (doc_id, start, length, ids_crc32, doc_tokens)."""
    ship(docs.sparkSession)
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    half = capacity // 2

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                b = ids.of_text(t or "") + end
                n = len(b) // 4
                cuts = [*range(0, n, capacity), n]
                if half < cuts[-1] - cuts[-2] < capacity:
                    cuts.insert(-1, cuts[-2] + half)
                rows += [(i, s, e - s, zlib.crc32(b[4 * s : 4 * e]), n) for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": batch["doc_id"].dtype})
        # The worker may idle beside other stages: it keeps no ids.
        ids.clear()
        ids.words.clear()
        ids.words.older.clear()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(lean(cut), f"doc_id {schema}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value and how often each size is taken."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = best[c - s[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], take[c] = got[j], j
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[order[take[c]]] += 1
            c -= s[take[c]]
    return float(best[capacity]), counts


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing by patterns: fill greedily from the largest size that is left, repeat the pattern while demand allows."""
    left, out = demand.astype(np.int64).copy(), []
    order = np.argsort(-sizes)
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for j in order:
            if left[j] and sizes[j] <= room:
                pattern[j] = min(left[j], room // sizes[j])
                room -= pattern[j] * sizes[j]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, limit: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how often each is used, covering the demand exactly.

    Revised simplex on the covering program: duals price a knapsack whose best pattern enters; it ends when none costs less, at Farley's bound within ``gap``, or after ``limit`` columns: then the patterns so far are used, which cover all demand, with more padding than the bound allows. Uses are rounded down; what is left is packed first-fit decreasing.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for _ in range(limit):
        duals = inverse.sum(0)
        value, column = knapsack(sizes, duals, capacity)
        if value <= 1 + max(gap, 1e-9):
            break
        d = inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(ratio.argmin())
        x -= ratio[r] * d
        x[r] = ratio[r]
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        basis[:, r] = column
        np.maximum(x, 0, out=x)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    return out + first_fit(sizes, left, capacity)


def assignment(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For each size, intervals of document ranks: which run of sequences takes them, how many a sequence."""
    rows, used, base = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in patterns:
        slot = 0
        for j in np.flatnonzero(pattern):
            rows.append((int(sizes[j]), int(used[j]), int(pattern[j]), base, slot))
            used[j] += pattern[j] * times
            slot += int(pattern[j])
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("unit", "first", "copies", "base", "slot"), table.T, strict=True))


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents longer than half a sequence give full pieces, a half piece if the rest is longer, and the rest; nothing else is cut. Null and empty texts are the end id alone; texts of any length are encoded whole; equal rows, and rows of one or no doc_id, are packed each; empty input gives no rows; other columns are ignored whatever their names. The driver holds the histogram (capacity / unit rows, times up to MAX_SALTS rank groups) and the patterns; ranks are dealt in salted groups, so no length gathers in one task.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, text, doc_id, path, capacity).withColumn("unit", F.ceil(F.col("length") / unit).cast("int")))
    counts = {r.unit: r.n for r in pieces.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(sorted(counts), np.int64)
    patterns = column_generation(sizes, np.array([counts[s] for s in sizes.tolist()], np.int64), -(-capacity // unit))
    table = assignment(sizes, patterns)
    salts = max(1, min(MAX_SALTS, -(-max(counts.values(), default=0) // ROWS_A_RANK)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = sorted((r.unit, r.salt, r.n) for r in salted.groupBy("unit", "salt").agg(F.count("*").alias("n")).collect())
    before, seen = [], {}
    for u, s, n in groups:
        before.append((u, s, seen.get(u, 0)))
        seen[u] = seen.get(u, 0) + n
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0, 0)], "unit int, salt int, before bigint"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("unit", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1).join(offsets, ["unit", "salt"])

    @F.pandas_udf("sequence_id bigint, slot bigint")
    def place(units: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        u, r = units.to_numpy(np.int64), ranks.to_numpy(np.int64)
        keys = table["unit"] << 44 | table["first"]
        k = np.searchsorted(keys, u << 44 | r, "right") - 1
        within = r - table["first"][k]
        return pd.DataFrame({"sequence_id": table["base"][k] + within // table["copies"][k], "slot": table["slot"][k] + within % table["copies"][k]})

    placed = ranked.withColumn("at", place("unit", F.col("rank") + F.col("before")))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.slot")
    return out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint")).drop("slot")
