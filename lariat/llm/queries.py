"""One query a training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The exact contracts that DuckDB can compute; the others sample, learn, hash or tokenise, and tests hold them against brute force.
SQL: dict[str, str] = {}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _license_sql() -> str:
    """The license scan over the same templates: votes, islands of diagonals, distinct words around each island's main diagonal."""
    from lariat.llm.licenses import COVERAGE, DRIFT, K_LONG, K_SHORT, LONG, PHRASES, TEMPLATES

    every = [*PHRASES, *TEMPLATES]
    values = ", ".join(f"({n}, '{text}', '{label}', {n < len(PHRASES)}, {K_SHORT if n < len(PHRASES) or len(text.split()) < LONG else K_LONG})" for n, (text, label) in enumerate(every))
    names = lambda c: f"coalesce(string_agg(distinct label, ',' order by label) filter ({c}), '')"
    return f"""with t(template, text, label, exact, k) as (values {values}), tw as (select template, label, exact, k, string_split(text, ' ') as w from t),
    g as (select template, label, exact, k, i as tpos, array_to_string(w[i + 1:i + k], ' ') as gram, len(w) - k + 1 as grams from tw, unnest(range(0, len(w) - k + 1)) as x(i)),
    d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) as w from documents),
    p as (select doc_id, k, i as pos, array_to_string(w[i + 1:i + k], ' ') as gram from d, (select distinct k from t), unnest(range(0, len(w) - k + 1)) as x(i)),
    dg as (select doc_id, template, label, exact, grams, k, pos - tpos as diagonal, count(*) as n, min(pos) as first, max(pos) as last, list(distinct tpos) as there from p join g using (k, gram) group by all),
    places as (select doc_id, label, first, 1.0::double as coverage, true as exact from dg where exact and n = grams),
    steps as (select *, cast(diagonal - lag(diagonal, 1, -1073741824) over (partition by doc_id, template order by diagonal) > {DRIFT} as int) as new from dg where not exact),
    islands as (select *, sum(new) over (partition by doc_id, template order by diagonal) as island from steps),
    mains as (select *, first_value(diagonal) over (partition by doc_id, template, island order by n desc, diagonal) as main from islands),
    near as (select doc_id, template, label, grams, k, island, min(first) as first, flatten(list(there)) as there from mains where abs(diagonal - main) <= {DRIFT} group by doc_id, template, label, grams, k, island),
    spans as (select doc_id, label, first, len(list_distinct(flatten(list_transform(there, lambda x: range(x, x + k)))))::double / (grams + k - 1) as coverage, false as exact from near union all select * from places),
    found as (select doc_id, count(*) filter (exact) as n_base, min(first) filter (exact) as first_word, max(first) filter (exact) as last_word, {names("exact")} as base_labels, {names(f"coverage >= {COVERAGE}::double")} as labels, max(coverage) as score from spans group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join found using (doc_id)"""


SQL["op2_licenses"] = _license_sql()
SQL["op6_ngram_jaccard"] = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACE_WORDS}) as w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
    n as (select doc_id, count(*) as n from s group by 1),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_n from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
    link as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * both_n >= 80 * (a.n + b.n - both_n)),
    reach(x, c) as (select doc_id, doc_id from d union select l.x, r.c from reach r join link l on l.y = r.x),
    component as (select x as doc_id, min(c) as component_id from reach group by 1), k as (select x as doc_id, count(*) as k from link group by 1)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, coalesce(k, 0)::bigint as n_links from d join component using (doc_id) left join n using (doc_id) left join k using (doc_id)"""
SQL["op7_decontamination"] = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) as w from documents),
    i as (select row_number() over () as k, coalesce(cast(item_id as varchar), '') as id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) as w from benchmark),
    g as (select distinct k, least(10, len(w)) as l, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as g from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(s) where len(w) > 0),
    p as (select doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') as g from d, (select distinct l from g), unnest(range(1, len(w) - l + 2)) as t(s)),
    h as (select doc_id, s, l, k from p join g using (l, g)),
    hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + l)) as pos from (select distinct doc_id, s, l from h)) group by 1),
    found as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, k, id from h join i using (k)) group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (doc_id) left join found using (doc_id)"""
SQL["op8_substring_dedup"] = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE_WORDS}) as w from documents),
    p as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as g from d, unnest(range(1, len(w) - 18)) as t(s)),
    later as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from p) where r > 1),
    gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from later),
    every as (select doc_id, pos, w[pos] as x from d, unnest(range(1, len(w) + 1)) as t(pos)),
    kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by pos) as t from every anti join gone using (doc_id, pos) group by 1)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_sharding(spark, d):
    from lariat.llm.sharding import shard_by_splitters

    out = shard_by_splitters(table(spark, d, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_hash")


@query
def op2_licenses(spark, d):
    from lariat.llm.licenses import scan_licenses

    return scan_licenses(table(spark, d, "documents").select("doc_id", "text"))[0]


@query
def op4_quality(spark, d):
    from lariat.llm.quality import quality_rules

    return quality_rules(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))[0]


@query
def op7_decontamination(spark, d):
    from lariat.llm.decontamination import find_contamination

    out = find_contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op5_token_counts(spark, d):
    from lariat.llm.token_counts import count_tokens

    return count_tokens(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), ["lang", "source", "text"], sections="sentences")


@query
def op10_packing(spark, d):
    from lariat.llm.packing import pack

    return pack(table(spark, d, "documents").select("doc_id", "text"))


@query
def op9_toxicity(spark, d):
    from lariat.llm.toxicity import score_toxicity

    out = score_toxicity(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "mean", "top")


@query
def op3_html_text(spark, d):
    from lariat.llm.html_extraction import extract_text

    return extract_text(table(spark, d, "pages").select("page_id", "url", "html"))


@query
def op6_ngram_jaccard(spark, d):
    from lariat.llm.ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, d, "documents").select("doc_id", "text"))


@query
def op8_substring_dedup(spark, d):
    from lariat.llm.substring_dedup import dedup_digest

    return dedup_digest(table(spark, d, "documents").select("doc_id", "text")).drop("removed")
