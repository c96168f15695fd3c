"""Token counts by offset-mapped attribution: each document is encoded once, token character spans join section intervals, and a token across a boundary is allocated by an explicit rule."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("majority", "start", "end")
#: What ends a section: a line break, or also a sentence's end with the blanks behind it. Over UTF-8 bytes.
SECTIONS = {"lines": re.compile(rb"\n"), "sentences": re.compile(rb"[.!?]+[ \t]+|\n")}
_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str | None, pattern: str | None = None):
    """(tiktoken encoding, bytes of each id); kept by the worker."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _ENCODINGS[path] = tiktoken.Encoding("lariat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODINGS[path]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens among them) of each section. ``ends``: end of each token, from 0 without gaps; ``bounds``: n + 1 section limits over the same units. Joined by binary search; majority gives a crossing token to the section with most of its units, the earlier on a tie."""
    first = np.searchsorted(bounds, np.concatenate(([0], ends[:-1])), "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = last if rule == "end" else first
    if rule == "majority":
        owner = owner.copy()
        # Most crossing tokens lie in two sections: the first one's part against the rest. Others are looked at one by one.
        starts = np.concatenate(([0], ends[:-1]))
        two = np.flatnonzero(last == first + 1)
        cut = bounds[last[two]]
        owner[two] += ends[two] - cut > cut - starts[two]
        for k in np.flatnonzero(last > first + 1):
            inner = range(int(first[k]), int(last[k]) + 1)
            owner[k] = max(inner, key=lambda s: (min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]), -s))
    n = len(bounds) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def count_tokens(docs: DataFrame, fields: list[str] | None = None, doc_id: str = "doc_id", rule: str = "majority", path: str | None = None, sections: str = "lines") -> DataFrame:
    """(doc_id, field, section, first_char, end_char, n_tokens, n_crossing, doc_tokens), a row for each section of each field.

    The fields (default text) are joined by one line break and encoded once as one text, so a token may cross fields too. A section is a line of a field with its break, or a sentence with the blanks behind it (``sections``); a break that joins fields belongs to the field before it. A token that lies in several sections goes to the one with most of its bytes, the earlier on a tie (majority), or to that of its first or last byte (start, end); n_crossing counts such tokens among a section's. Spans are in characters of the joined text; a token that holds part of a character counts with its bytes, so attribution is exact to the byte, and every token is counted once: the n_tokens of a document add up to doc_tokens.
    A null or empty field before the last has one section (its joining break); an empty last field has one empty section, 0 tokens. Texts of any length are encoded whole. Equal rows are counted each; empty input gives no rows; a null doc_id is carried through. Fields are told apart by place, so columns may have any names, those of the outputs too.
    """
    if rule not in RULES or sections not in SECTIONS:
        raise ValueError(f"rule: {', '.join(RULES)}; sections: {', '.join(SECTIONS)}")
    ship(docs.sparkSession)
    fields = ["text"] if fields is None else fields
    kind = docs.select(F.col(doc_id).alias("d")).schema["d"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sizes = encoding(path)
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                texts = [t or "" for t in row[1:]]
                whole = "\n".join(texts)
                raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
                breaks = np.fromiter((m.end() for m in SECTIONS[sections].finditer(raw.tobytes())), np.int64)
                # Field limits, then section limits: behind each section's end, and at each field's end.
                limits = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
                limits[-1] -= 1
                bounds = np.unique(np.concatenate(([0], breaks, limits)))
                if len(bounds) == 1:
                    bounds = np.array([0, 0])
                ids = np.asarray(enc.encode_ordinary(whole), np.int64)
                n, crossing = attribute(np.cumsum(sizes[ids]), bounds, rule) if len(ids) else np.zeros((2, len(bounds) - 1), np.int64)
                if len(texts) > 1 and not texts[-1]:
                    bounds, n, crossing = np.append(bounds, bounds[-1]), np.append(n, 0), np.append(crossing, 0)
                field = np.minimum(np.searchsorted(limits, bounds[:-1], "right"), len(texts) - 1)
                section = np.arange(len(field)) - np.searchsorted(field, field)
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[bounds]
                parts.append((field, section, chars[:-1], chars[1:], n, crossing, len(ids)))
            if parts:
                rows = [len(p[0]) for p in parts]
                cat = lambda i: np.concatenate([p[i] for p in parts])
                yield pd.DataFrame({"doc_id": batch.iloc[:, 0].repeat(rows).to_numpy(), "field": np.array(fields, object)[cat(0)], "section": cat(1), "first_char": cat(2), "end_char": cat(3), "n_tokens": cat(4), "n_crossing": cat(5), "doc_tokens": np.repeat([p[6] for p in parts], rows)})

    chosen = docs.select(F.col(doc_id).alias("d"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return chosen.mapInPandas(count, f"doc_id {kind}, field string, section bigint, first_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
