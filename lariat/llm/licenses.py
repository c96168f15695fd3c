"""License scans by diagonal voting, in DataFrame operations only: rolling word k-gram hashes join template positions, votes gather by offset diagonal, neighbouring diagonals merge, spans are verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lariat.llm.common import materialise
from lariat.llm.native import alnum_words, let, up_to

# Phrases that always count, wherever their words stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Openings of public notices.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

LONG = 8  # words from which a template is voted on with K_LONG-grams
K_SHORT, K_LONG = 2, 4
DRIFT = 8  # diagonals at most this far apart are one match (inserted or lost words)
COVERAGE = 0.6


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(k, gram, h, template, tpos, grams, exact, label): one row a k-gram of a template; as many rows as the templates have words."""
    rows = []
    for n, (text, label) in enumerate([*phrases, *templates]):
        words = text.split()
        exact = n < len(phrases)
        k = K_SHORT if exact or len(words) < LONG else K_LONG
        rows += [(k, " ".join(words[i : i + k]), n, i, len(words) - k + 1, exact, label) for i in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "k int, gram string, template int, tpos int, grams int, exact boolean, label string")
    return df.withColumn("h", F.xxhash64("gram"))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(summary, spans). Templates are parameters of bounded size (a few hundred words), which is all that is broadcast.

    summary, one row an input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. spans: doc_id, label, first, last (words from 0, inclusive), coverage.

    Neighbouring diagonals are one island; its span is verified around the diagonal with most votes: coverage is the share of the template's words that stand there, each in its place to DRIFT words and counted once, however often the text repeats them. score is the best coverage, 1 if a phrase stands.
    Null or empty text: no words, no labels, score 0. Texts of any length are read whole; a k-gram that no template has is gone before any shuffle. Rows equal in doc_id and text get equal results; a null doc_id is an id like others. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    grams = materialise(template_grams(spark, phrases, templates))
    known = {k: [r.h for r in grams.where(F.col("k") == k).select("h").distinct().collect()] for k in (K_SHORT, K_LONG)}

    def hits(k: int):
        if not known[k]:
            return F.array().cast("array<struct<k: int, pos: int, gram: string>>")

        def found(w):
            gram = lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])
            at = F.filter(up_to(0, F.size(w) - k), lambda i: F.xxhash64(gram(i)).isin(known[k]))
            return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), gram(i).alias("gram")))

        return found

    both = lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.concat(*[f(w) if callable(f := hits(k)) else f for k in (K_SHORT, K_LONG)]).alias("hits"))
    scanned = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), let(alnum_words(F.col(text)), both).alias("x"))
    base = materialise(scanned.select("doc_id", "key", "x.*"))

    # Rows equal in id and text vote once.
    voters = base.where(F.size("hits") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.inline("hits"))
    votes = voters.withColumn("h", F.xxhash64("gram")).join(F.broadcast(grams), ["k", "h", "gram"])
    diagonals = votes.groupBy("doc_id", "key", "template", "label", "grams", "exact", "k", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("there"))
    # A phrase stands where one diagonal has all its votes.
    places = diagonals.where("exact and n = grams")
    template = ["doc_id", "key", "template"]
    order = Window.partitionBy(*template).orderBy("diagonal")
    merged = diagonals.where("not exact").withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > DRIFT).cast("int"))
    merged = merged.withColumn("island", F.sum("new").over(order))
    main = F.max_by("diagonal", F.struct(F.col("n"), -F.col("diagonal"))).over(Window.partitionBy(*template, "island"))
    near = merged.withColumn("main", main).where(F.abs(F.col("diagonal") - F.col("main")) <= DRIFT)
    near = near.groupBy(*template, "label", "grams", "k", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("there"))).alias("there"))
    # The template's words that some k-gram has found, of all its words.
    words = F.size(F.array_distinct(F.flatten(F.transform("there", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    spans = near.select("doc_id", "key", "label", "first", (F.col("last") + F.col("k") - 1).alias("last"), (words / (F.col("grams") + F.col("k") - 1)).alias("coverage"), F.lit(False).alias("exact"))
    spans = spans.unionByName(places.select("doc_id", "key", "label", "first", (F.col("last") + F.col("k") - 1).alias("last"), F.lit(1.0).alias("coverage"), F.lit(True).alias("exact")))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy("doc_id", "key").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("bigint").alias("last_word"),
        names(F.col("exact")).alias("base_labels"),
        names(F.col("coverage") >= coverage).alias("labels"),
        F.max("coverage").alias("score"),
    ).withColumnsRenamed({"doc_id": "__d", "key": "__k"})
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")
    zero = {"n_base": F.lit(0).cast("bigint"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    summary = out.select("doc_id", "n_words", *[F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
    return summary, spans.where(F.col("coverage") >= coverage).select("doc_id", "label", "first", "last", "coverage")
