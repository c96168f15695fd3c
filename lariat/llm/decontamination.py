"""Benchmark decontamination: an FM-index for each shard of training documents, backward search of the benchmark's word windows, location by sampled suffix positions, merged removal spans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import WordHashes, alnum_words, hash_words, kept_names, lean, masked, ship
from lariat.llm.fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 400_000
#: A block of the benchmark has at most about so many bytes of text; more blocks mean more passes, never fewer items.
BLOCK_BYTES = 32 << 20


@dataclass
class Windows:
    """Distinct windows of a block of items, and which items hold each."""

    words: np.ndarray  # windows x WINDOW word hashes
    lengths: np.ndarray
    item_starts: np.ndarray  # of each window in items
    items: np.ndarray
    ids: list[str]


def windows_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Windows:
    cache = WordHashes()
    seen: dict[bytes, int] = {}
    words, lengths, pairs = [], [], []
    for i, (_, text) in enumerate(rows):
        h = hash_words(alnum_words(text), cache)
        for w in [h[k : k + window] for k in range(len(h) - window + 1)] if len(h) > window else [h] * (len(h) > 0):
            k = seen.setdefault(w.tobytes(), len(seen))
            if k == len(words):
                words.append(np.pad(w, (0, window - len(w))))
                lengths.append(len(w))
            pairs.append((k, i))
    pairs = sorted(set(pairs))
    which = np.array([p[0] for p in pairs], np.int64)
    return Windows(np.array(words, np.int64).reshape(-1, window), np.array(lengths, np.int64), np.searchsorted(which, np.arange(len(words) + 1)), np.array([p[1] for p in pairs], np.int64), [r[0] or "" for r in rows])


def search_shard(hashes: list[np.ndarray], blocks: Iterable[Windows]) -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
    """(hit words of each document, ids of the items found in each, sorted, hit flags over the text, documents' starts in it). The shard is indexed once, and each block of windows searched in it."""
    index = FMIndex(hashes)
    edges = np.zeros(index.n + 1, np.int64)
    found: list[list[str]] = [[] for _ in hashes]
    for w in blocks:
        lo, hi = index.search(index.symbols(w.words), w.lengths)
        which, at = index.occurrences(lo, hi)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + w.lengths[which], -1)
        doc = np.searchsorted(index.starts, at, "right") - 1
        pair = np.unique(doc * max(1, len(w.lengths)) + which)
        items: dict[int, set[int]] = {}
        for d, k in zip((pair // max(1, len(w.lengths))).tolist(), pair % max(1, len(w.lengths)), strict=True):
            items.setdefault(d, set()).update(w.items[w.item_starts[k] : w.item_starts[k + 1]].tolist())
        for d, numbers in items.items():
            found[d] += [w.ids[i] for i in numbers]
    hit = np.cumsum(edges[:-1]) > 0
    n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), index.starts)
    return n_hit, [sorted(x) for x in found], hit, index.starts


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SCHEMA = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first: int, end: int>>"


def _scan(docs: DataFrame, blocks: list[Broadcast], text: str, keep: list[str]) -> DataFrame:
    size = SHARD_WORDS
    names = [f"k{i}" for i in range(len(keep))]

    def windows() -> Iterator[Windows]:
        for b in blocks:
            yield b.value
            if len(blocks) > 1 and hasattr(b, "_value"):
                del b._value  # a worker holds one block at a time

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()

        def flush(kept: list[pd.DataFrame], hashes: list[np.ndarray]) -> pd.DataFrame:
            out = pd.concat(kept, ignore_index=True)
            n_hit, found, hit, starts = search_shard(hashes, windows())
            out["n_words"] = [len(h) for h in hashes]
            out["n_hit"] = n_hit
            out["items"] = found
            out["spans"] = [[{"first": a, "end": b} for a, b in spans_of(hit[s : s + len(h)])] if n else [] for s, h, n in zip(starts, hashes, n_hit, strict=True)]
            return out

        kept: list[pd.DataFrame] = []
        hashes: list[np.ndarray] = []
        words = first = 0
        for batch in batches:
            first = 0
            for i, t in enumerate(batch["__text"]):
                hashes.append(hash_words(alnum_words(t), cache))
                words += len(hashes[-1]) + 1
                if words >= size:
                    kept.append(batch.iloc[first : i + 1][names])
                    yield flush(kept, hashes)
                    kept, hashes, words, first = [], [], 0, i + 1
            if first < len(batch):
                kept.append(batch.iloc[first:][names])
        if hashes:
            yield flush(kept, hashes)

    chosen = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs[text].alias("__text"))
    schema = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names, strict=True))
    outputs = ("n_words", "n_hit", "items", "spans")
    return chosen.mapInPandas(lean(shards), f"{schema}{_SCHEMA}").select(*[F.col(n).alias(c) for n, c in zip(names, kept_names(keep, outputs), strict=True)], *outputs)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (default doc_id), n_words, n_hit, items (ids, sorted), spans (hit runs of words) for every row.

    No shuffle: each task indexes its rows in shards of about SHARD_WORDS words (a longer document is a shard of its own) and searches them. The benchmark's size is checked first; it is sent out in blocks of at most ``block_bytes`` (one long item may exceed that), and every shard is indexed once and meets one block after the other.
    Null texts and items without words have no windows; texts of any length are searched whole; a null item_id reads as the empty text in ``items``; repeated item_ids are listed as often as their items hit. An empty benchmark finds nothing, an empty table gives no rows. Repeated rows are judged alike; other columns may have any names, and a kept one named like an output gets an underscore at its end.
    """
    ship(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
    blocks = max(1, -(-total // block_bytes))
    context = docs.sparkSession.sparkContext
    sent = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        sent.append(context.broadcast(windows_of([(r.i, r.t) for r in part.collect()])))
    return _scan(docs, sent, text, keep)


def cut_words(text: str, spans: list[tuple[int, int]], word: re.Pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) -> str:
    """The text without the words of the spans (and what stands between them)."""
    places = [m.span() for m in word.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with every hit span cut out of the text; others stay as they are."""
    plain, restore = masked(docs, text, doc_id)
    found = find_contamination(plain, benchmark, keep=plain.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(s["first"], s["end"]) for s in x]) if len(x) else t for t, x in zip(texts, spans, strict=True)])

    return restore(found.withColumn("text", F.when(F.col("n_hit") > 0, cut("text", "spans")).otherwise(F.col("text"))))
