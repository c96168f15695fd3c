"""Substring dedup: compressed FM-indexes over content-routed shards; backward search over wavelet matrices finds the word windows whose suffix interval shows an earlier copy, and their spans are removed.

Streaming every document past every shard's index costs documents x shards, so content decides which shard a stretch of text meets: each window is routed by its minimiser (the least hash of its 6-word grams), which equal windows share. Stretches with an unshared minimiser meet nothing; identical stretches meet as one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import WordHashes, hash_words, join_each, lean, masked, materialise, mix, rolling, ship, space_words, with_rids
from lariat.llm.decontamination import cut_words, spans_of
from lariat.llm.fm_index import FMIndex
from lariat.llm.shared_keys import shared_keys

WINDOW = 20
GRAM = 6
SHARD_WORDS = 300_000
#: A minimiser with more distinct stretches than this is dealt to several shards, whose first windows then meet by digest.
HOT_STRETCHES = 3_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def stretches(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last minus first window, digest of the words) of each maximal run of windows with one minimiser."""
    empty = np.empty(0, np.int64)
    if len(h) < window:
        return empty.view(np.uint64), empty, empty, empty
    g = rolling(h, gram)
    wide = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
    at = np.arange(len(wide)) + wide.argmin(1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    more = np.diff(np.append(first, len(at))) - 1
    powers = np.cumprod(np.full(len(h), _P, np.uint64))
    inverse = np.cumprod(np.full(len(h), _P_INVERSE, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)) * powers, dtype=np.uint64)))
    digest = mix((sums[first + more + window] - sums[first]) * inverse[first] + more.astype(np.uint64))
    return g[at[first]], first, more, digest.view(np.int64)


def search_stretches(words: list[np.ndarray], window: int = WINDOW, chunk: int = 100_000) -> tuple[np.ndarray, np.ndarray, FMIndex, np.ndarray, np.ndarray]:
    """(places of later copies, places of first copies of all distinct windows, index, digests of the distinct windows, symbols). Places are in the index's text, whose order is that of the stretches.

    Every distinct end of a window is streamed through backward search for its matching statistic, up to the threshold: what goes beyond it decides nothing.
    """
    index = FMIndex(words)
    lengths = np.array([len(w) for w in words], np.int64)
    n = lengths - window + 1
    place = np.repeat(index.starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hashes = np.zeros(index.n, np.int64)
    inside = np.ones(index.n, bool)
    inside[index.starts + lengths] = False
    hashes[inside] = np.concatenate(words)
    digest, at = np.unique(rolling(hashes, window)[place], return_index=True)
    first = place[at]  # the leftmost: places rise with the stretches
    flat = np.where(inside, index.symbols(hashes), 0)
    later = []
    for i in range(0, len(first), chunk):
        p = flat[first[i : i + chunk, None] + np.arange(window)]
        # Above the threshold is where the words that end here occur twice for a whole window.
        matched, lo, hi = index.matching(p, np.full(len(p), window), least=2)
        above = np.flatnonzero(matched >= window)
        which, found = index.occurrences(lo[above], hi[above])
        if len(which):
            least = np.full(len(above), index.n)
            np.minimum.at(least, which, found)
            later.append(found[found != least[which]])
    return np.concatenate(later) if later else np.empty(0, np.int64), first, index, digest, flat


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, spans) of the word windows that start earlier too, from (rid, text) with distinct rids whose order decides. Documents without such windows have no row."""
    ship(rows.sparkSession)

    def emit():
        cache = WordHashes()

        def keys_of(b: pd.DataFrame):
            parts = [(r, *stretches(hash_words(space_words(t), cache), window)) for r, t in zip(b["rid"], b["text"], strict=True)]
            cat = lambda i: np.concatenate([p[i] for p in parts])
            rids = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
            return cat(1) >> np.uint64(16), [rids, cat(2).astype(np.int64), cat(3).astype(np.int64), cat(4).astype(np.int64)]

        return keys_of

    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    shared = materialise(shared_keys(rows, emit, ["rid", "first", "more", "digest"], size / 40, "rid").drop("n"))
    kinds = materialise(shared.groupBy("key", "digest", "more").agg(F.min(F.struct("rid", "first")).alias("head"), F.count("*").alias("n")))
    # Of identical stretches all but the earliest go whole.
    copies = join_each(shared, kinds.where("n > 1"), ["key", "digest", "more"], "n", shared.count()).where((F.col("rid") != F.col("head.rid")) | (F.col("first") != F.col("head.first")))
    spans = copies.select("rid", "first", (F.col("first") + F.col("more") + window).alias("end"))

    several = kinds.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    heads = join_each(kinds.drop("n"), several.withColumn("n", F.col("k")), ["key"], "n", kinds.count()).select("key", "k", "head.rid", "head.first", "more")
    total = heads.agg(F.sum(F.col("more") + window).alias("w")).first().w or 0
    if total:
        shards = -(-total // SHARD_WORDS)
        salt = F.pmod(F.xxhash64("rid", "first"), F.ceil(F.col("k") / HOT_STRETCHES))
        shard = F.when(F.col("k") <= HOT_STRETCHES, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("key", salt), 1))
        wanted = heads.withColumn("shard", shard).groupBy("rid").agg(F.collect_list(F.struct("shard", "first", "more")).alias("parts"))

        def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache = WordHashes()
            for b in batches:
                out = []
                for r, z, parts in zip(b["rid"], b["z"], b["parts"], strict=True):
                    h = hash_words(zlib.decompress(z).split(), cache)
                    out += [(p["shard"], r, p["first"], h[p["first"] : p["first"] + p["more"] + window].tobytes()) for p in parts]
                yield pd.DataFrame(out, columns=["shard", "rid", "first", "words"])

        def search(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["rid", "first"])
            words = [np.frombuffer(w, np.int64) for w in group["words"]]
            rid, base = group["rid"].to_numpy(np.int64), group["first"].to_numpy(np.int64)
            later, heads_at, index, digest, flat = search_stretches(words, window)
            edges = np.zeros(index.n + 1, np.int64)
            np.add.at(edges, later, 1)
            np.add.at(edges, later + window, -1)
            runs = np.array(spans_of(np.cumsum(edges[:-1]) > 0), np.int64).reshape(-1, 2)
            s = np.searchsorted(index.starts, runs[:, 0], "right") - 1
            out = pd.DataFrame({"rid": rid[s], "first": base[s] + runs[:, 0] - index.starts[s], "end": base[s] + runs[:, 1] - index.starts[s], "d1": 0, "d2": 0, "head": False})
            if group["shard"].iloc[0] < 0:
                s = np.searchsorted(index.starts, heads_at, "right") - 1
                first = base[s] + heads_at - index.starts[s]
                second = np.zeros(len(heads_at), np.uint64)
                for j in range(window):
                    second = mix(second ^ index.vocabulary[flat[heads_at + j] - 1].view(np.uint64) * _P)
                out = pd.concat([out, pd.DataFrame({"rid": rid[s], "first": first, "end": first + window, "d1": digest.view(np.int64), "d2": second.view(np.int64), "head": True})])
            return out

        packed = _squeezed(rows).join(wanted, "rid").mapInPandas(lean(words_of), "shard bigint, rid bigint, first bigint, words binary")
        found = materialise(packed.groupBy("shard").applyInPandas(search, "rid bigint, first bigint, end bigint, d1 bigint, d2 bigint, head boolean"))
        spans = spans.unionByName(found.where("not head").select("rid", "first", "end"))
        met = found.where("head")
        firsts = met.groupBy("d1", "d2").agg(F.min(F.struct("rid", "first")).alias("h"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "h")
        spans = spans.unionByName(met.join(firsts, ["d1", "d2"]).where((F.col("rid") != F.col("h.rid")) | (F.col("first") != F.col("h.first"))).select("rid", "first", "end"))
    return spans.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def _squeezed(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(rid, z, kept columns): texts compressed before they are shuffled."""
    keep = keep or []

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["rid"]].assign(z=[zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in b["text"]], **{c: b[c] for c in keep})

    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("rid", "text", *keep).mapInPandas(lean(squeeze), f"rid bigint, z binary{more}")


def flags_of(n: int, spans) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for s in spans if spans is not None else ():
        edges[s["first"]] += 1
        edges[s["end"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def dedup_digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for every row; removed lists the runs of words taken out.

    Null and empty texts have no words and the digest of the empty text; texts under ``window`` words lose nothing; texts of any length are taken whole. Rows with a null doc_id come first, then by id; of repeated rows the later ones lose every window. An empty table gives no rows. Other columns are ignored whatever their names.
    """
    rows = with_rids(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    spans = repeated_spans(rows.select("rid", "text"), window)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for z, s in zip(b["z"], b["spans"], strict=True):
                words = zlib.decompress(z).split()
                gone = flags_of(len(words), s)
                kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"first": a, "end": e} for a, e in spans_of(gone)] if gone.any() else []))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "removed"], index=b.index)], axis=1)

    joined = _squeezed(rows, ["doc_id"]).join(spans, "rid", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "z", "spans").mapInPandas(lean(digest), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed array<struct<first: bigint, end: bigint>>")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The rows with their repeated spans cut out of the text; a row that loses every word goes."""
    plain, restore = masked(docs, text, doc_id)
    rows = with_rids(plain, "text", "doc_id")
    spans = repeated_spans(rows.select("rid", "text"), window)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is None:  # Spark calls for all rows, whatever the condition
                out.append(t)
                continue
            gone = flags_of(len(_WORD.findall(t)), s)
            out.append(None if gone.all() else cut_words(t, spans_of(gone), _WORD))
        return pd.Series(out)

    joined = rows.join(spans, "rid", "left")
    hit = F.col("spans").isNotNull()
    out = joined.withColumns({"text": F.when(hit, cut("text", "spans")).otherwise(F.col("text")), "hit": hit})
    return restore(out.where(~F.col("hit") | F.col("text").isNotNull()))
