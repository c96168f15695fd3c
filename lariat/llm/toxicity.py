"""Toxicity by class-conditional Kneser-Ney models of a text's expressions: length-normalised toxic and ordinary log-likelihoods are compared, and rare expressions are smoothed through backoff counts that both classes share. All counts are kept, as tables: no model is held by a task or the driver.

An expression is a word. Its chance in a class is the class's discounted count of it; the mass that discounting frees goes to the class's spelling model, a tree of word beginnings of up to DEPTH characters: the chance of the next character is the class's discounted number of distinct words that go on with it, and what is freed there goes by the shared counts, the distinct words of the whole corpus, labelled or not. Behind DEPTH characters the classes have everything in common.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import Scratch, WordHashes, alnum_words, hash_words, lean, ship
from lariat.llm.shared_keys import from_planes, pack, planes, unpack

#: Characters of a word's beginning that the spelling models see, its end counting as one.
DEPTH = 6
#: The share of its words that a toxic text is taken to have from the toxic model, the others being ordinary.
TOXIC_SHARE = 0.03
#: So many of a text's most toxic words are judged by themselves too.
HIGHEST = 4
#: Bound of the calibration sample, four numbers a row.
CALIBRATION = 20_000
#: Labels of at most so many rows are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows are read in blocks that end at so many words or rows: the larger a block, the fewer words stand in several.
BLOCK_WORDS, BLOCK_ROWS = 2_000_000, 50_000
#: Bytes of text for each range of word hashes, and the most ranges; beyond that the blocks meet in groups.
RANGE_BYTES, MAX_RANGES = 40 << 20, 4096
#: Softened log-ratios are summed as integers of 1 / SCALE, so that no order of rows matters.
SCALE = 1 << 30
#: Counts of a word: in the final model's rows by class, and in the calibration rows among them.
COUNTS = ("ordinary", "toxic", "cal_ordinary", "cal_toxic")
#: The four distributions: of each class for the final scores (f) and without the calibration rows (c).
MODELS = ("f_toxic", "f_ordinary", "c_toxic", "c_ordinary")
END = "\x03"


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def beginning(word: bytes, depth: int = DEPTH) -> str:
    """The first ``depth`` characters of the word and its end."""
    return (word[: 4 * depth].decode("utf-8", "ignore") + END if len(word) < 4 * depth else word.decode("utf-8", "ignore"))[:depth]


def soften(ratio: np.ndarray, share: float = TOXIC_SHARE) -> np.ndarray:
    """Log-likelihood ratio of a text whose words are toxic with chance ``share`` to an ordinary one, from the words' own."""
    return np.log1p(share * np.expm1(np.minimum(ratio, 50.0)))


def calibrate(x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression of standardised columns by Newton steps with a small ridge, as (intercept, weights) of the columns as they are; constant if a class is absent."""
    if not len(x) or label.min() == label.max():
        rate = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.25
        return float(np.log(rate / (1 - rate))), np.zeros(x.shape[1])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b, ridge = np.zeros(z.shape[1]), np.diag([0.0, *[0.5] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (label - p) - ridge @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    weights = b[1:] / spread
    return float(b[0] - weights @ mean), weights


class Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _known(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, calibration: int) -> DataFrame:
    """(id, text, y, cal) of every row: the label outside the held-out fifth (else null), conflicting labels of an id read as toxic; and whether the row is one of the calibration rows, of bucket 1, by a hash of the id, about ``calibration`` at most."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y")).where(bucket(F.col("__id")) != 0)
    known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
    n = docs.select(F.col(doc_id).alias("id")).where(bucket(F.col("id")) == 1).join(known, F.col("id") == F.col("__id"), "left_semi").count()
    part = min(1 << 30, int((1 << 30) * 0.97 * calibration / max(1, n))) if n > calibration else 1 << 30
    cal = (bucket(F.col("id")) == 1) & (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < part) & F.col("y").isNotNull()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, F.col("id") == F.col("__id"), "left").select("id", "text", "y", F.coalesce(cal, F.lit(False)).alias("cal"))


def _ranges(docs: DataFrame, text: str) -> tuple[int, int]:
    """(ranges of word hashes, groups of blocks): so many that the words of a range and group fit a task."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first().b or 0
    ranges = max(1, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    return ranges, max(1, -(-size // (RANGE_BYTES * 4 * ranges)))


def pack_pairs(code: np.ndarray, doc: np.ndarray, count: np.ndarray, codes: int) -> bytes:
    """(code, doc, count), sorted by code, in few bytes."""
    a, b = planes(np.bincount(code, minlength=codes)), planes(doc)
    return zlib.compress(struct.pack("<2Q", len(a), len(b)) + a + b + planes(count), 1)


def unpack_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = zlib.decompress(packed)
    a, b = struct.unpack_from("<2Q", plain)
    each, doc, count = (from_planes(x).astype(np.int64) for x in (plain[16 : 16 + a], plain[16 + a : 16 + a + b], plain[16 + a + b :]))
    return np.repeat(np.arange(len(each)), each), doc, count


def _blocks(rows: DataFrame, ranges: int, scratch: Scratch) -> list[DataFrame]:
    """Three tables. Words, a row a block of texts and range r: their 64-bit hashes in order, packed; what the vocabulary needs of the same words, beginnings b and counts; and for each block its documents (id, y of a calibration row, n words; code is the place), and a row with all (word, document, count), packed. A block's words are coded by the order of their hashes."""
    id_type = rows.schema["id"].dataType.simpleString()
    columns = ["kind", "block", "r", "k", "b", "counts", "code", "id", "n", "y", "packed"]
    limits = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        texts: list[np.ndarray] = []
        codes, hashes = Codes(), WordHashes()
        block, n_words = TaskContext.get().partitionId() << 32, 0

        def frame(**known) -> pd.DataFrame:
            return pd.DataFrame({c: known.get(c) for c in columns}, columns=columns)

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal block, n_words, codes
            if not texts:
                return
            b = pd.concat(held, ignore_index=True)
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            every = list(codes)
            h = hash_words(every, hashes).view(np.uint64)
            o = np.argsort(h, kind="stable")
            rank = np.empty(len(o), np.int64)
            rank[o] = np.arange(len(o))
            pair, count = np.unique(rank[np.concatenate(texts)] << 32 | np.repeat(np.arange(len(texts)), n), return_counts=True)
            code, doc = pair >> 32, pair & 0xFFFFFFFF
            y, cal = b["y"].to_numpy(float, na_value=-1), b["cal"].to_numpy(bool)
            kinds = (y == 0, y > 0, cal & (y == 0), cal & (y > 0))
            counts = np.stack([np.bincount(code, count * kind[doc], len(o)) for kind in kinds]).astype("<i8")
            h = h[o]
            cuts = [0, *np.searchsorted(h, limits, "left").tolist(), len(h)]
            squeezed = [(r, pack(h[i:j]), zlib.compress("\n".join([beginning(every[k]) for k in o[i:j]]).encode(), 1), zlib.compress(counts[:, i:j].tobytes(), 1)) for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            if squeezed:
                yield frame(kind=0, block=block, **{c: [x[i] for x in squeezed] for i, c in enumerate(("r", "k"))})
                yield frame(kind=1, block=block, r=[x[0] for x in squeezed], **{c: [x[i + 2] for x in squeezed] for i, c in enumerate(("b", "counts"))})
            yield frame(kind=2, block=block, code=np.arange(len(texts)), id=b["id"], n=n, y=np.where(cal, y, np.nan))
            yield frame(kind=2, block=[block], code=[-1], packed=[pack_pairs(code, doc, count, len(o))])
            held.clear()
            texts.clear()
            codes = Codes()
            block, n_words = block + 1, 0

        for batch in batches:
            held.append(batch[["id", "y", "cal"]])
            for t in batch["text"]:
                words = alnum_words(t)
                texts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                n_words += len(words)
            if n_words >= BLOCK_WORDS or len(texts) >= BLOCK_ROWS:
                yield from flush()
        yield from flush()

    made = rows.mapInPandas(lean(run), f"kind int, block bigint, r int, k binary, b binary, counts binary, code bigint, id {id_type}, n bigint, y double, packed binary")
    words, more, texts = scratch.split(made, "kind", (0, 1, 2))
    return [words.select("block", "r", "k"), more.select("block", "r", "b", "counts"), texts.select("block", "code", "id", "n", "y", "packed")]


def _vocabulary(words: DataFrame, more: DataFrame, groups: int, scratch: Scratch) -> DataFrame:
    """(word, its beginning b, counts) of every word: the blocks' words meet by range, in groups of blocks, and what several groups have is added up."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys, more = group[group["k"].notna()], group[group["k"].isna()]
        h = np.concatenate([unpack(k) for k in keys["k"]])
        starts = np.concatenate([np.array(zlib.decompress(x).decode().split("\n"), object) for x in more["b"]])
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<i8").reshape(4, -1) for x in more["counts"]], 1)
        o = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], h[o][1:] != h[o][:-1])))
        sums = np.add.reduceat(counts[:, o], first, 1)
        return pd.DataFrame({"word": h[o][first].view(np.int64), "b": pd.Series(starts[o][first], dtype=object)} | dict(zip(COUNTS, sums, strict=True)))

    met = words.unionByName(more, allowMissingColumns=True).groupBy("r", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g")).applyInPandas(merge, f"word bigint, b string, {', '.join(c + ' bigint' for c in COUNTS)}")
    return scratch(met.groupBy("word", "b").agg(*[F.sum(c).alias(c) for c in COUNTS]) if groups > 1 else met)


def _found(words: DataFrame, ratios: DataFrame, ranges: int, groups: int) -> DataFrame:
    """(block, r, f, c) of the blocks' words, packed in their order: each range of ratios meets each group of blocks. c, for the calibration alone, goes in half precision."""

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        h = group["word"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(h)
        return pd.DataFrame({"r": [int(group["r"].iloc[0])], "words": [pack(h[o])], "found": [group[["f", "c"]].to_numpy(np.float32).T[:, o].tobytes()]})

    limits = [(r << 64) // ranges for r in range(1, ranges)]

    @F.pandas_udf("int")
    def range_of(word: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(limits, np.uint64), word.to_numpy(np.int64).view(np.uint64), "right").astype(np.int32))

    laid = ratios.withColumn("r", range_of("word")).groupBy("r").applyInPandas(lay, "r int, words binary, found binary")
    laid = laid.select("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), "words", "found")
    asked = words.select("r", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("bigint").alias("g"), "block", "k")

    def look(asked: pd.DataFrame, laid: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"block": [], "r": [], "f": [], "c": []})
        h = unpack(laid["words"].iloc[0])
        f, c = np.frombuffer(laid["found"].iloc[0], np.float32).reshape(2, -1)
        at = [np.searchsorted(h, unpack(k)) for k in asked["k"]]
        return pd.DataFrame({"block": asked["block"], "r": asked["r"], "f": [f[x].tobytes() for x in at], "c": [c[x].astype(np.float16).tobytes() for x in at]})

    return asked.groupBy("r", "g").cogroup(laid.groupBy("r", "g")).applyInPandas(look, "block bigint, r int, f binary, c binary")


def _discounts(table: DataFrame) -> tuple[dict[str, float], dict[str, tuple[int, int]]]:
    """Of each model: the discount by the counts of counts, and (sum, number of those above 0)."""
    n = lambda c: F.count(F.when(c, 1))
    r = table.agg(*[f.alias(f"{m}_{k}") for m in MODELS for k, f in (("1", n(F.col(m) == 1)), ("2", n(F.col(m) == 2)), ("sum", F.coalesce(F.sum(m), F.lit(0))), ("kinds", n(F.col(m) > 0)))]).first()
    return {m: min(0.95, max(0.1, r[f"{m}_1"] / max(1, r[f"{m}_1"] + 2 * r[f"{m}_2"]))) for m in MODELS}, {m: (r[f"{m}_sum"], r[f"{m}_kinds"]) for m in MODELS}


def word_ratios(vocabulary: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """(word, f, c): log P(word | toxic) - log P(word | ordinary) of every word of (word, its beginning b, counts), 0 under a model that lacks a class. What names a word matters not.

    The tree has a row a beginning, its children fewer than there are characters; each level is joined to the one above it, so no branch is held by a task.
    """
    words = vocabulary.select("word", "b", F.col("toxic").alias("f_toxic"), F.col("ordinary").alias("f_ordinary"), (F.col("toxic") - F.col("cal_toxic")).alias("c_toxic"), (F.col("ordinary") - F.col("cal_ordinary")).alias("c_ordinary"))
    d_word, totals = _discounts(words)
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("b")), lambda k: F.substring("b", 1, k))).alias("b"), *[(F.col(m) > 0).cast("int").alias(m) for m in MODELS])
    tree = scratch(starts.groupBy("b").agg(F.count("*").alias("all"), *[F.sum(m).alias(m) for m in MODELS]).withColumn("level", F.length("b")))
    d_tree, _ = _discounts(tree)

    above, levels = None, []
    for k in range(1, depth + 1):
        w = Window.partitionBy("parent")
        here = tree.where(F.col("level") == k).withColumn("parent", F.substring("b", 1, k - 1))
        here = here.withColumns({"all_sum": F.sum("all").over(w)} | {f"{m}_sum": F.sum(m).over(w) for m in MODELS} | {f"{m}_kinds": F.sum((F.col(m) > 0).cast("int")).over(w) for m in MODELS})
        here = here.join(above, "parent") if above is not None else here.withColumns({f"{m}_p": F.lit(0.0) for m in MODELS})
        shared = F.col("all") / F.col("all_sum")
        step = lambda m: F.when(F.col(f"{m}_sum") > 0, (F.greatest(F.col(m) - d_tree[m], F.lit(0.0)) + d_tree[m] * F.col(f"{m}_kinds") * shared) / F.col(f"{m}_sum")).otherwise(shared)
        level = scratch(here.select("b", "all", *[(F.col(f"{m}_p") + F.log(step(m))).alias(f"{m}_p") for m in MODELS]))
        levels.append(level)
        above = level.select(F.col("b").alias("parent"), *[f"{m}_p" for m in MODELS])
    ends = levels[-1]
    for level in levels[:-1]:
        ends = ends.unionByName(level.where(F.col("b").endswith(END)))

    def chance(m: str) -> Column:
        n, kinds = totals[m]
        spelling = F.exp(F.col(f"{m}_p") - F.log("all"))
        return F.log((F.greatest(F.col(m) - d_word[m], F.lit(0.0)) + d_word[m] * kinds * spelling) / n)

    ratio = lambda m: (chance(f"{m}_toxic") - chance(f"{m}_ordinary") if totals[f"{m}_toxic"][0] and totals[f"{m}_ordinary"][0] else F.lit(0.0)).cast("float").alias(m)
    return scratch(words.join(ends, "b").select("word", ratio("f"), ratio("c")))


def text_ratios(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, calibration: int) -> DataFrame:
    """(id, y, n, and for f, the final model, and c, the one without the calibration rows: mean, soft, top) of every row; y is null but for calibration rows. mean: mean log-ratio of the words; soft: mean of the softened ones; top: mean of the HIGHEST highest ones. Texts without words have zeros."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    ranges, groups = _ranges(docs, text)
    words, more, texts = _blocks(_known(docs, labels, text, doc_id, label, calibration), ranges, scratch)
    vocabulary = _vocabulary(words, more, groups, scratch)
    scratch.drop(1)
    found = scratch(_found(words, word_ratios(vocabulary, scratch), ranges, groups))
    scratch.drop(0)
    kind = docs.select(F.col(doc_id).alias("d")).schema["d"].dataType
    parts = texts.unionByName(found, allowMissingColumns=True)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        code, doc, count = unpack_pairs(group.loc[group["code"] < 0, "packed"].iloc[0])
        ratios = group[group["r"].notna()].sort_values("r")
        known = [np.frombuffer(b"".join(ratios[c]), kind).astype(np.float64) for c, kind in (("f", np.float32), ("c", np.float16))]
        texts = group[group["n"].notna()].sort_values("code")
        n = texts["n"].to_numpy(np.int64)
        out = {"id": texts["id"], "y": texts["y"], "n": n}
        for c, r in zip(("f", "c"), known, strict=True):
            for name, value in (("mean", r), ("soft", soften(r))):
                total = np.zeros(len(n), np.int64)
                np.add.at(total, doc, np.rint(value * SCALE).astype(np.int64)[code] * count)
                out[f"{c}_{name}"] = total / SCALE / np.maximum(1, n)
            o = np.lexsort((-r[code], doc))
            taken = np.cumsum(count[o])
            first = np.searchsorted(doc[o], doc[o], "left")
            taken -= (taken - count[o])[first]
            use = np.clip(HIGHEST - (taken - count[o]), 0, count[o])
            top = np.bincount(doc[o], use * r[code[o]], len(n))
            out[f"{c}_top"] = top / np.maximum(1, np.minimum(n, HIGHEST))
        return pd.DataFrame(out)

    numbers = ", ".join(f"{c}_{x} double" for c in ("f", "c") for x in ("mean", "soft", "top"))
    out = Scratch(docs.sparkSession)(parts.groupBy("block").applyInPandas(run, f"id {kind.simpleString()}, y double, n bigint, {numbers}"))
    scratch.drop()
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", calibration: int = CALIBRATION) -> DataFrame:
    """doc_id, held_out, mean (log-likelihood ratio a word), top (of the four most toxic words), score (0 to 1), predicted for every row.

    Texts without words, null ones too, have mean and top 0. Texts of any length are scored whole: they meet the word's ratios by block, and a text is never split. A null doc_id is never held out and learns nothing. Repeated rows count as often as they occur and get equal scores, as equal texts do. Without labels every row gets the same score below a half. An empty table gives no rows. Other columns are ignored whatever their names.

    All labelled rows of buckets 1 to 4 are counted, nothing of bucket 0; shared counts are of all texts. The score is a logistic curve over the softened mean, the highest words and the logarithm of the length, fitted on calibration rows of bucket 1 under a model without them.
    """
    out = text_ratios(docs, labels, text, doc_id, label, calibration)
    sample = out.where("y is not null").select("id", "n", "c_soft", "c_top", "y").toPandas().sort_values(["id", "y", "c_soft", "c_top"])
    x = np.column_stack([sample["c_soft"].to_numpy(float), sample["c_top"].to_numpy(float), np.log1p(sample["n"].to_numpy(float))])
    a, (soft, top, size) = calibrate(x, (sample["y"] > 0).to_numpy(float))
    line = F.lit(a) + soft * F.col("f_soft") + top * F.col("f_top") + size * F.log1p(F.col("n").cast("double"))
    out = out.select(F.col("id").alias("doc_id"), F.coalesce(bucket(F.col("id")) == 0, F.lit(False)).alias("held_out"), F.col("f_mean").alias("mean"), F.col("f_top").alias("top"), (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), line))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
