"""Quality rules as a learned decision list, in DataFrame operations only: sequential covering grows and prunes threshold conjunctions from labelled statistics, and the list becomes one ordered conditional expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import kept_names, masked, materialise
from lariat.llm.native import SPACE, SPACE_WORD, let, shift_left, shift_right, space_words, up_to

FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "stop_share")
# The base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Window hashes are packed with their positions into longs and sorted, so equal windows are neighbours (n log n); neighbours with equal hashes are compared word by word."""
    bits = F.length(F.bin(F.size(w))).cast("int")

    def of_sorted(s: Column) -> Column:
        pos = lambda p: p.bitwiseAND(shift_left(F.lit(1).cast("bigint"), bits) - 1).cast("int")

        def same(a: Column, b: Column) -> Column:
            equal = shift_right(a, bits) == shift_right(b, bits)
            for i in range(3):
                equal = equal & (F.get(w, pos(a) + i) == F.get(w, pos(b) + i))
            return F.coalesce(equal, F.lit(False))

        twice = F.filter(up_to(0, F.size(s) - 1), lambda j: same(F.get(s, j), F.get(s, j - 1)) | same(F.get(s, j), F.get(s, j + 1)))
        places = F.sort_array(F.transform(twice, lambda j: pos(F.get(s, j))))
        covered = lambda q: F.when(F.size(q) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(up_to(1, F.size(q) - 1), F.lit(0), lambda n, j: n + F.least(F.lit(3), F.get(q, j) - F.get(q, j - 1))))
        return let(places, covered)

    packed = F.transform(up_to(0, F.size(w) - 3), lambda i: shift_left(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint")))
    return let(F.sort_array(packed), of_sorted).cast("bigint")


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A struct ``row`` of the kept columns and a struct ``s`` of whole-text statistics. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    words = let(space_words(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    without = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    raw = F.struct(
        words.alias("w"), line_counts.alias("l"),
        (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        (without("!")).cast("bigint").alias("n_shout"),
        (without(".")).cast("bigint").alias("n_stops"),
    )
    final = lambda r: F.struct(
        r["w"]["n_words"].alias("n_words"), r["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["l"]["n_dup_lines"].alias("n_dup_lines"), r["w"]["n_repeat_words"].alias("n_repeat_words"),
        share(r["word_chars"], r["w"]["n_words"]).alias("mean_chars"), share(r["n_symbols"], r["w"]["n_words"]).alias("symbol_share"), share(r["l"]["n_dup_lines"], r["l"]["n_lines"]).alias("dup_line_share"),
        share(r["w"]["n_repeat_words"], r["w"]["n_words"]).alias("repeat_share"), share(r["n_upper"], r["word_chars"]).alias("upper_share"), share(r["n_shout"], r["w"]["n_words"]).alias("shout_share"), share(r["n_stops"], r["w"]["n_words"]).alias("stop_share"),
    )
    return docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), let(raw, final).alias("s"))


def base_failed(s: str = "s") -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{s}.n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, s: str) -> Column:
        c = F.col(f"{s}.{self.feature}").cast("double")
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def all_of(rule: Rule, s: str = "s") -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(s)
    return out


def verdict(rules: list[Rule], s: str = "s") -> Column:
    """The ordered list: number of the first rule that fires (from 1), else 0."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(all_of(rule, s), i + 1) if out is None else out.when(all_of(rule, s), i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of keeping p of p0 bad and n of n0 good rows."""
    return 0.0 if p <= 0 else p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(labelled: DataFrame, label: str = "quality", s: str = "s", thresholds: int = 40, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, min_cover: float = 0.003, split: Column | None = None) -> list[Rule]:
    """Rules that reject (label 0). All labelled rows count; every step is one combined aggregate of at most features x thresholds rows.

    Growing (two thirds of the rows, by ``split``, a hash of the row's id, or of its statistics): add the condition with the best FOIL gain while it gains. Pruning (the rest): keep the prefix with the best (bad - good) / (bad + good). A rule stays if its precision on the pruning rows, with two pseudo-rows, reaches ``precision`` and it covers ``min_cover`` of the bad rows there; else learning ends.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(s, (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(s, label) if split is None else split, F.lit(3)) > 0).alias("grow"))
    grid = rows.agg(*[F.percentile_approx(F.col(f"{s}.{f}").cast("double"), [i / thresholds for i in range(thresholds + 1)], 2000).alias(f) for f in FEATURES]).first()
    # Thresholds lie midway between neighbouring quantiles.
    found = {f: sorted(set(grid[f] or [])) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in found.items()}
    if not any(cuts.values()):
        return []

    def bin_of(f: str) -> Column:
        """How many thresholds are at or below the value: a search in a short constant array."""
        c = F.col(f"{s}.{f}").cast("double")
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[f]]), lambda x: x <= c)) if cuts[f] else F.lit(0)

    # Equal rows of bins combine, so learning reads no more than the distinct ones.
    binned = rows.select("bad", "grow", *[bin_of(f).alias(f) for f in FEATURES]).groupBy("grow", *FEATURES).agg(F.count(F.when(F.col("bad"), 1)).alias("p"), F.count(F.when(~F.col("bad"), 1)).alias("n"))
    binned = materialise(binned.coalesce(16))
    test = lambda c: F.col(c.feature) >= cuts[c.feature].index(c.threshold) + 1 if c.above else F.col(c.feature) < cuts[c.feature].index(c.threshold) + 1

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & test(c)
        return out

    rules: list[Rule] = []
    bad_total = None
    for _ in range(max_rules):
        rest = binned
        for r in rules:
            rest = rest.where(~holds(r))
        rule: Rule = ()
        while len(rule) < max_conditions:
            pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES]))
            counts = rest.where(F.col("grow") & holds(rule)).select("p", "n", pairs).groupBy("f", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            hist = {f: {r.b: (r.p, r.n) for r in counts if r.f == f} for f in FEATURES}
            p0, n0 = (sum(x[i] for x in hist[FEATURES[0]].values()) for i in (0, 1))
            if bad_total is None:
                bad_total = p0
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in FEATURES:
                low_p = low_n = 0
                for b, cut in enumerate(cuts[f]):
                    low_p, low_n = low_p + hist[f].get(b, (0, 0))[0], low_n + hist[f].get(b, (0, 0))[1]
                    for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                        if p >= min_cover * bad_total and (g := _gain(p, n, p0, n0)) > best[0]:
                            best = (g, Condition(f, above, cut))
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        held = rest.where(~F.col("grow")).agg(*[F.coalesce(F.sum(F.when(holds(x), F.col(c))), F.lit(0)).alias(f"{c}{i}") for i, x in enumerate(prefixes) for c in "pn"]).first()
        scored = [((held[f"p{i}"] - held[f"n{i}"]) / max(1, held[f"p{i}"] + held[f"n{i}"]), -len(x), i) for i, x in enumerate(prefixes)]
        i = max(scored)[2]
        p, n = held[f"p{i}"], held[f"n{i}"]
        if (p + 1) / (p + n + 2) < precision or p < min_cover * bad_total / 2:
            break
        rules.append(prefixes[i])
    return rules


def _learn(stats: DataFrame, labels: DataFrame, doc_id: str, **learning) -> list[Rule]:
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"))
    # By id, not by statistics: rows of equal statistics must stand on both sides.
    return learn_rules(stats.where(~base_failed()).join(known, F.col("row").getField(doc_id) == F.col("__id")), split=F.xxhash64(F.col("__id").cast("string")), **learning)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, **learning) -> tuple[DataFrame, list[Rule]]:
    """The kept columns (default doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule (0: none), kept; and the rules.

    One row an input row, equal rows alike; null text has no words, so it fails the base rule; texts of any length are counted whole, in n log n; a null or repeated doc_id is scored like others and learns by every label of its id (the worst counts); without labels the list is empty; an empty table gives no rows. Columns of the input are left out unless kept; a kept one named like an output gets an underscore at its end.
    """
    keep = [doc_id] if keep is None else keep
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
    stats = materialise(statistics(docs, text, keep=sorted({*keep, doc_id}, key=docs.columns.index)))
    rules = _learn(stats, labels, doc_id, **learning)
    fired = verdict(rules)
    out = stats.select(*[F.col("row").getField(c).alias(n) for c, n in zip(keep, kept_names(keep, outputs), strict=True)], *[F.col(f"s.{c}").alias(c) for c in outputs[:5]], base_failed().alias("base_failed"), fired.alias("rule"), (~base_failed() & (fired == 0)).alias("kept"))
    return out, rules


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **learning) -> DataFrame:
    """The rows that neither the base rules nor the learned list reject, with all their columns, whatever their names; null, empty and short texts fail. Equal rows are kept or rejected together."""
    plain, restore = masked(docs, text, doc_id)
    stats = materialise(statistics(plain))
    rules = _learn(stats, labels, "doc_id", **learning)
    return restore(stats.where(~base_failed() & (verdict(rules) == 0)).select("row.*"))
