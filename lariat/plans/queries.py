"""The engine's operators on the driver's star schema, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.functions.text import fill_unknown, percent_label, remap, round_half_even, safe_key, title_case
from lariat.operators import stats
from lariat.operators.drift import categorical_drift, dataset_drift, drift_report, numeric_drift
from lariat.operators.features import bucket_rare, categorical_features, drop_column, prepare_features
from lariat.operators.label import add_target
from lariat.operators.model import build_pipeline, classifier, feature_importance, fill_nulls, fit, positive_weight, predict, predict_proba, rank_candidates
from lariat.operators.ranking import top_k
from lariat.operators.sampling import exact_sample, stratified_split
from lariat.operators.shape import dedupe_last, flatten_prospects, left_lookup, merge_all
from lariat.sources.tables import load_and_merge, read_applicants, read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of the session's warehouse for what a query writes; the next run of the query overwrites it."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lariat_{name}"


def orders_full(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return left_lookup(left_lookup(table(spark, d, "orders"), customer, "o_custkey"), nation, "c_nationkey")


TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query(
    f"""with t as (select {TITLE.format("trim(o.o_orderpriority)")} as priority, coalesce(n.n_name, 'Desconhecido') as n_name, cast(o_orderstatus = 'F' as int) as target
     from orders o left join customer c on o_custkey = c_custkey left join nation n on c_nationkey = n_nationkey where o_orderstatus <> 'P'),
     top as (select n_name from t group by 1 order by count(*) desc, 1 limit 20)
     select priority, case when n_name in (select n_name from top) then n_name else 'Outros' end as nation, cast(count(*) as bigint) as n, cast(avg(target) as double) as rate from t group by 1, 2"""
)
def hire_rate(spark, d):
    """The flagship: join, label, clean, bucket, rate."""
    df = add_target(orders_full(spark, d), "o_orderstatus", ["F"], ["P"])
    df = df.select(title_case(F.col("o_orderpriority")).alias("priority"), fill_unknown(F.col("n_name")).alias("nation"), "target")
    return bucket_rare(df, "nation", 20).groupBy("priority", "nation").agg(F.count("*").alias("n"), F.avg("target").alias("rate")).orderBy(F.desc("rate"), "priority", "nation")


TEXT_FIELDS = "codigo string, situacao_candidado string, comentario string, nome string, recrutador string, data_candidatura string, ultima_atualizacao string"


def customer_records(spark, d) -> DataFrame:
    """Customers as nested records of their orders: (key, pos, value). Every third customer's key occurs twice, and the later value is to win; customers without orders have none."""
    order = F.struct(F.col("o_orderkey").cast("string").alias("codigo"), F.col("o_orderstatus").alias("situacao_candidado"), F.col("o_orderpriority").alias("comentario"), *[F.lit(None).cast("string").alias(c) for c in ("nome", "recrutador", "data_candidatura", "ultima_atualizacao")])
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(order).alias("prospects"))
    full = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    record = lambda pos, title: full.select(F.col("c_custkey").cast("string").alias("key"), F.lit(pos).cast("bigint").alias("pos"), F.struct(title.alias("titulo"), F.col("c_mktsegment").alias("modalidade"), "prospects").alias("value"))
    return record(0, F.col("c_name")).unionByName(record(1, F.concat(F.lit("last "), "c_name")).where("cast(key as bigint) % 3 = 0"))


@query("""select cast(c_custkey as varchar) as vaga_id, cast(o_orderkey as varchar) as candidato_id, o_orderstatus as situacao, o_orderpriority as comentario, cast(null as varchar) as nome, cast(null as varchar) as recrutador, cast(null as varchar) as data_candidatura,
    cast(null as varchar) as ultima_atualizacao, case when c_custkey % 3 = 0 then 'last ' || c_name else c_name end as titulo_vaga, c_mktsegment as modalidade_vaga from customer join orders on o_custkey = c_custkey""")
def flatten_nested(spark, d):
    """Nested records to one row an entry, exact duplicates of a key by the last."""
    return flatten_prospects(customer_records(spark, d))


def write_raw(spark, d) -> str:
    """The raw inputs of the funnel from the small tables, as files: nations are jobs, regions vacancies whose prospects are nations, suppliers applicants. A keyed JSON file is one object, so it is written by one task."""
    base = scratch(spark, "raw")

    def keyed(df: DataFrame, name: str) -> None:
        # Equal keys stay in the file, in order of pos.
        entry = F.concat(F.to_json(F.struct(F.col("key").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("key").alias("k")))) - 6), F.lit(": "), F.to_json("value"))
        entries = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", entry.alias("e")))), lambda x: x["e"])
        df.agg(F.concat(F.lit("{"), F.array_join(entries, ",\n"), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/{name}")

    nation = table(spark, d, "nation")
    job = lambda title: F.struct(F.struct(title.alias("cliente"), F.lit("Sim").alias("vaga_sap")).alias("informacoes_basicas"), F.struct(F.col("n_name").alias("nivel profissional"), F.lit("B2").alias("nivel_ingles"), F.lit("t").alias("competencia_tecnicas_e_comportamentais")).alias("perfil_vaga"))
    first = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.lit(0).alias("pos"), job(F.col("n_name")).alias("value"))
    again = nation.where("n_nationkey % 2 = 0").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".0")).alias("key"), F.lit(1).alias("pos"), job(F.concat(F.lit("last "), "n_name")).alias("value"))
    keyed(first.unionByName(again), "jobs.json")
    supplier = table(spark, d, "supplier")
    entry = F.struct(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(".0")).alias("codigo"), F.when(F.col("s_acctbal") > 0, "Proposta Aceita").otherwise("Prospect").alias("situacao_candidado"), F.col("s_name").alias("nome"))
    grouped = supplier.groupBy("s_nationkey").agg(F.collect_list(entry).alias("prospects"))
    keyed(grouped.select(F.col("s_nationkey").cast("string").alias("key"), F.lit(0).alias("pos"), F.struct(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("titulo"), F.lit(None).cast("string").alias("modalidade"), "prospects").alias("value")), "prospects.json")
    people = supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("__index_level_0__"), F.struct(F.lit("Superior").alias("nivel_academico"), F.lit("A").alias("nivel_ingles"), F.lit("B").alias("nivel_espanhol")).alias("formacao_e_idiomas"), F.struct(F.col("s_name").alias("area_atuacao"), F.lit("k").alias("conhecimentos_tecnicos")).alias("informacoes_profissionais"), F.lit("cv").alias("cv_pt"))
    people.coalesce(1).write.mode("overwrite").parquet(f"{base}/applicants.parquet")
    return base


@query("""select cast(n_nationkey as varchar) || case when again then '.0' else '' end as key, case when again then 'last ' else '' end || n_name as cliente, n_name as nivel_profissional, 'B2' as idioma
    from nation, (select unnest([false, true]) as again) where not again or n_nationkey % 2 = 0""")
def json_keyed_parse(spark, d):
    """A keyed JSON file, read with its nested types."""
    from lariat.sources.keyed_json import JOBS, read_keyed_json

    read = read_keyed_json(spark, f"{write_raw(spark, d)}/jobs.json", JOBS)
    return read.select("key", "value.informacoes_basicas.cliente", F.col("value.perfil_vaga.`nivel profissional`").alias("nivel_profissional"), F.col("value.perfil_vaga.nivel_ingles").alias("idioma"))


@query("select cast(s_suppkey as varchar) as id, 'Superior' as nivel_academico, s_name as area_atuacao, 'cv' as cv from supplier where s_suppkey % 5 <> 0")
def applicants_read(spark, d):
    """The applicants' Parquet file by its index column, keys checked."""
    read = read_applicants(spark, f"{write_raw(spark, d)}/applicants.parquet")
    return read.select(F.col("__index_level_0__").alias("id"), "formacao_e_idiomas.nivel_academico", "informacoes_profissionais.area_atuacao", F.col("cv_pt").alias("cv"))


MERGED = """cast(null as varchar) as comentario, s_name as nome, 't' || s_nationkey as titulo_vaga, cast(null as varchar) as modalidade_vaga, case when n_nationkey % 2 = 0 then 'last ' || n_name else n_name end as cliente, 'Sim' as sap, n_name as nivel_profissional, 'B2' as idioma, 't' as competencias_tecnicas,
    case when s_suppkey % 5 <> 0 then 'Superior' end as nivel_academico, case when s_suppkey % 5 <> 0 then 'A' end as ingles, case when s_suppkey % 5 <> 0 then 'B' end as espanhol, case when s_suppkey % 5 <> 0 then s_name end as area_atuacao, case when s_suppkey % 5 <> 0 then 'k' end as conhecimentos, case when s_suppkey % 5 <> 0 then 'cv' end as cv"""


@query(f"select cast(s_nationkey as varchar) as vaga_id, cast(s_suppkey as varchar) as candidato_id, case when s_acctbal > 0 then 'Proposta Aceita' else 'Prospect' end as situacao, {MERGED} from supplier left join nation on n_nationkey = s_nationkey")
def load_and_merge_raw(spark, d):
    """The raw files to the merged table of 18 columns: keyed JSON, unnest, key cleaning, last-wins, both joins."""
    return load_and_merge(spark, write_raw(spark, d))


@query("""select cast(c_custkey as varchar) as vaga_id, cast(o_orderkey as varchar) as candidato_id, o_orderstatus as situacao, o_orderpriority as comentario, cast(null as varchar) as nome, case when c_custkey % 3 = 0 then 'last ' || c_name else c_name end as titulo_vaga, c_mktsegment as modalidade_vaga,
    case when c_custkey % 2 = 0 then 'late ' || p_name else p_name end as cliente, p_brand as sap, p_type as nivel_profissional, cast(p_size as varchar) as idioma, cast(null as varchar) as competencias_tecnicas,
    case when o_orderkey % 4 <> 0 then 'N' || o_orderstatus end as nivel_academico, case when o_orderkey % 4 <> 0 then o_orderpriority end as ingles, cast(null as varchar) as espanhol, cast(null as varchar) as area_atuacao, cast(null as varchar) as conhecimentos, case when o_orderkey % 4 <> 0 then 'cv ' || o_orderkey end as cv
    from customer join orders on o_custkey = c_custkey left join part on p_partkey = c_custkey""")
def merge_sides(spark, d):
    """merge_all on whole tables: prospects are customers' orders, jobs are parts (even keys occur as 'n' and 'n.0', the later wins), applicants are orders under keys with blanks and fractions, a quarter missing."""
    part = table(spark, d, "part")
    job = lambda key, pos, client: part.select(key.alias("key"), F.lit(pos).cast("bigint").alias("pos"), F.struct(F.struct(client.alias("cliente"), F.col("p_brand").alias("vaga_sap")).alias("informacoes_basicas"), F.struct(F.col("p_type").alias("nivel profissional"), F.col("p_size").cast("string").alias("nivel_ingles"), F.lit(None).cast("string").alias("competencia_tecnicas_e_comportamentais")).alias("perfil_vaga")).alias("value"))
    key = F.col("p_partkey").cast("string")
    jobs = job(key, 0, F.col("p_name")).unionByName(job(F.concat(key, F.lit(".0")), 1, F.concat(F.lit("late "), "p_name")).where("cast(key as double) % 2 = 0"))
    no = F.lit(None).cast("string")
    people = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".5 ")).alias("id"), F.lit(0).cast("bigint").alias("pos"), F.struct(F.concat(F.lit("N"), "o_orderstatus").alias("nivel_academico"), F.col("o_orderpriority").alias("nivel_ingles"), no.alias("nivel_espanhol")).alias("formacao_e_idiomas"), F.struct(no.alias("area_atuacao"), no.alias("conhecimentos_tecnicos")).alias("informacoes_profissionais"), F.concat(F.lit("cv "), F.col("o_orderkey").cast("string")).alias("cv_pt"))
    return merge_all(jobs, people, flatten_prospects(customer_records(spark, d)), "id")


KEY_TEXT = "case when o_orderkey % 4 = 0 then o_orderkey || '.0' when o_orderkey % 4 = 1 then ' ' || o_orderkey || ' ' when o_orderkey % 4 = 2 then 'x' || o_orderkey else '-' || o_orderkey || '.9' end"


@query("select o_orderkey, case when o_orderkey % 4 = 2 then 'x' || o_orderkey when o_orderkey % 4 = 3 then '-' || o_orderkey else cast(o_orderkey as varchar) end as key from orders")
def safe_key_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", safe_key(F.expr(KEY_TEXT)).alias("key"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def dedupe_last_event(spark, d):
    return dedupe_last(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def merge_left_miss(spark, d):
    return left_lookup(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("select o_orderkey, c_mktsegment, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def merge_two_sides(spark, d):
    return orders_full(spark, d).select("o_orderkey", "c_mktsegment", "n_name")


@query("""with t as (select event_id, case when event_id % 7 = 0 then null else event_type end as s from events)
    select event_id, s as status, cast(case when s = 'purchase' then 1 else 0 end as int) as target from t where s is null or s not in ('view', 'signup')""")
def label_target(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("status"))
    return add_target(df, "status", ["purchase"], ["view", "signup"])


@query(f"select o_orderkey, {TITLE.format('trim(o_orderpriority)')} as priority from orders")
def normalize_title(spark, d):
    return table(spark, d, "orders").select("o_orderkey", title_case(F.col("o_orderpriority")).alias("priority"))


@query("select p_partkey, case p_type when 'STANDARD' then 'Std' when 'PROMO' then 'Promotion' else p_type end as p_type from part")
def remap_values(spark, d):
    return table(spark, d, "part").select("p_partkey", remap(F.col("p_type"), {"STANDARD": "Std", "PROMO": "Promotion"}).alias("p_type"))


@query("select d.doc_id, coalesce(cast(l.quality as varchar), 'Desconhecido') as quality from documents d left join labels l on d.doc_id = l.doc_id")
def fill_unknown_label(spark, d):
    return merge_left_miss(spark, d).select("doc_id", fill_unknown(F.col("quality")).alias("quality"))


ACADEMIC_CLEAN = "['Ensino Médio Completo', 'Ensino Técnico Cursando', 'Pós-Graduação', 'Mestrado (Cursando)', 'Ensino Superior Completo', 'Desconhecido']"


@query(f"""with t as (select o_orderkey, {ACADEMIC_CLEAN}[o_orderkey % 6 + 1] as nivel_academico, {TITLE.format("trim(c_name)")} as cliente, coalesce({TITLE.format("n_name")}, 'Desconhecido') as area_atuacao from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey),
    a as (select cliente from t group by 1 order by count(*) desc, 1 limit 20), b as (select area_atuacao from t group by 1 order by count(*) desc, 1 limit 20)
    select o_orderkey, nivel_academico, case when cliente in (select cliente from a) then cliente else 'Outros' end as cliente, case when area_atuacao in (select area_atuacao from b) then area_atuacao else 'Outros' end as area_atuacao from t""")
def feature_table(spark, d):
    """prepare_features: cleaning, the academic levels' remap, rare values of two columns."""
    values = F.array(*[F.lit(x) for x in ("ensino medio completo", " ENSINO TECNICO CURSANDO", "pos graduacao", "mestrado cursando", "Ensino Superior Completo")], F.lit(None).cast("string"))
    df = orders_full(spark, d).select("o_orderkey", F.get(values, (F.col("o_orderkey") % 6).cast("int")).alias("nivel_academico"), F.col("c_name").alias("cliente"), F.col("n_name").alias("area_atuacao"))
    return prepare_features(df)


@query("""with top as (select p_name from part group by 1 order by count(*) desc, 1 limit 20)
    select p_partkey, case when p_name in (select p_name from top) then p_name else 'Outros' end as p_name from part""")
def rare_bucket(spark, d):
    return bucket_rare(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", 20)


@query("select event_type, count(*) as n from events where event_type is not null group by 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@query("select event_type, cast(count(*) as double) / (select count(event_type) from events) as share from events where event_type is not null group by 1")
def value_share(spark, d):
    return stats.value_share(table(spark, d, "events"), "event_type")


@query("select o_orderpriority, avg(cast(o_orderstatus = 'F' as int)) as rate from orders where o_orderstatus <> 'P' group by 1")
def rate_by_category(spark, d):
    return stats.rate_by(add_target(table(spark, d, "orders"), "o_orderstatus", ["F"], ["P"]), "o_orderpriority")


@query("select p_brand, count(*) as n, avg(cast(p_size > 25 as int)) as rate from part group by 1 order by n desc, p_brand limit 15")
def top15_count_rate(spark, d):
    return stats.count_and_rate_by(table(spark, d, "part").withColumn("target", (F.col("p_size") > 25).cast("int")), "p_brand")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 10")
def topk_rank(spark, d):
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


HASH = "md5(event_id || '|42')"


@query(f"""select event_id, event_type, row_number() over (partition by event_type order by {HASH}, event_id) <= floor(0.2::double * count(*) over (partition by event_type) + 0.5::double) as is_test from events""")
def stratified_split_events(spark, d):
    return stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query(f"select event_id, event_type from events order by {HASH}, event_id limit (select cast(round_even(0.1::double * count(*), 0) as bigint) from events)")
def exact_sample_events(spark, d):
    return exact_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id")


def _predicted(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("target"), (F.col("n_chars") > 800).cast("int").alias("prediction"))


PREDICTED = "with t as (select quality as target, cast(n_chars > 800 as int) as prediction from documents join labels using (doc_id)), "


@query(PREDICTED + "u as (select unnest([0, 1]) as actual) select actual, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1 from u left join t on actual = target group by 1")
def confusion(spark, d):
    return stats.confusion_matrix(_predicted(spark, d))


@query(PREDICTED + "u as (select 1) select target as actual, 100.0::double * count(*) filter (prediction = 0) / count(*) as percent_0, 100.0::double * count(*) filter (prediction = 1) / count(*) as percent_1 from t group by 1")
def confusion_pct(spark, d):
    return stats.confusion_percent(_predicted(spark, d))


@query(PREDICTED + "u as (select 1) select target, prediction, count(*) as n, format('{}\n({:.1f}%)', count(*), 100.0::double * count(*) / sum(count(*)) over (partition by target)) as cell from t group by 1, 2")
def confusion_cells(spark, d):
    n = _predicted(spark, d).groupBy("target", "prediction").agg(F.count("*").alias("n"))
    total = n.groupBy("target").agg(F.sum("n").alias("total"))
    return n.join(total, "target").select("target", "prediction", "n", percent_label(F.col("n"), F.lit(100.0) * F.col("n") / F.col("total")).alias("cell"))


REPORT = """c as (select count(*) filter (target = 0 and prediction = 0)::double a, count(*) filter (target = 0 and prediction = 1)::double b, count(*) filter (target = 1 and prediction = 0)::double c, count(*) filter (target = 1 and prediction = 1)::double d from t),
p as (select *, coalesce(a / nullif(a + c, 0), 0) p0, coalesce(d / nullif(b + d, 0), 0) p1, coalesce(a / nullif(a + b, 0), 0) r0, coalesce(d / nullif(c + d, 0), 0) r1, a + b s0, c + d s1 from c),
f as (select *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) f1, s0 + s1 s, (a + d) / (s0 + s1) acc from p)
select '0' as label, p0 as precision, r0 as recall, f0 as f1, s0::bigint as support from f union all select '1', p1, r1, f1, s1::bigint from f union all select 'accuracy', acc, acc, acc, s::bigint from f
union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s::bigint from f union all select 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s::bigint from f"""


@query(f"select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from ({PREDICTED}{REPORT})")
def class_report(spark, d):
    return stats.classification_report(_predicted(spark, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("with t as (select cast(event_type = 'purchase' as int) as target from events) select cast(max(n) as double) / min(n) as ratio from (select target, count(*) as n from t group by 1)")
def class_weight(spark, d):
    return stats.class_ratio(table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("target")))


@query("select target, count(*) as n from (select cast(event_type = 'purchase' as int) as target from events) where target is not null group by 1")
def class_counts(spark, d):
    return stats.class_counts(table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("target")))


@query("""with t as (select o_orderkey, cast(o_orderstatus = 'F' as int) as target from orders where o_orderstatus <> 'P'), r as (select max(n)::double / min(n) as ratio from (select count(*) as n from t group by target))
    select o_orderkey, target, case when target = 1 then ratio else 1.0::double end as weight from t, r""")
def positive_class_weight(spark, d):
    return positive_weight(add_target(table(spark, d, "orders"), "o_orderstatus", ["F"], ["P"]).select("o_orderkey", "target"))


@query("""select o_orderkey, round_even(o_totalprice / 3, 2) as third from orders where o_totalprice is not null""")
def bankers_rounding(spark, d):
    return table(spark, d, "orders").where("o_totalprice is not null").select("o_orderkey", round_half_even(F.col("o_totalprice") / 3, 2).alias("third"))


@query("select unnest(['p_name', 'p_brand', 'p_type']) as name")
def string_columns(spark, d):
    """Names of the string columns, without one that is dropped."""
    names = categorical_features(drop_column(table(spark, d, "part"), "p_retailprice"))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("select 2::bigint as columns, 0.0::double as share, false as drifted")
def drift_dataset(spark, d):
    """The whole report of a table against itself: no column drifts."""
    df = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    report = drift_report(df, df)
    return dataset_drift(report).select(F.lit(report.count()).cast("bigint").alias("columns"), "share", "drifted")


@query(f"""with s as (select event_id, event_type from events order by {HASH}, event_id limit (select cast(round_even(0.1::double * count(*), 0) as bigint) from events)),
    p as (select event_type, count(*)::double / (select count(*) from events) as p from events group by 1), q as (select event_type, count(*)::double / (select count(*) from s) as q from s group by 1),
    b as (select coalesce(p, 0) as p, coalesce(q, 0) as q from p full join q using (event_type)),
    j as (select sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as x from b)
    select 'event_type' as "column", 'categorical' as kind, round(x, 6) as statistic, 0.1::double as threshold, x >= 0.1 as drifted from j""")
def drift_categorical(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return categorical_drift(df, exact_sample(df, "event_id"), ["event_type"]).withColumn("statistic", F.round("statistic", 6))


@query("""with a as (select avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders), b as (select avg(o_totalprice) m from orders where o_orderstatus = 'F')
    select 'o_totalprice' as "column", 'numeric' as kind, round(abs(a.m - b.m) / a.s, 6) as statistic, 0.1::double as threshold, abs(a.m - b.m) / a.s >= 0.1 as drifted from a, b""")
def drift_numeric(spark, d):
    df = table(spark, d, "orders")
    return numeric_drift(df, df.where("o_orderstatus = 'F'"), ["o_totalprice"]).withColumn("statistic", F.round("statistic", 6))


@query("select doc_id, text from documents")
def csv_round_trip(spark, d):
    """Documents written as CSV into the session's warehouse and read again. Every run has a folder of its own, as frames of earlier and other runs read theirs whenever they are used; it goes when the driver's JVM ends."""
    from lariat.sources.tables import read_csv, write_csv

    path = scratch(spark, f"csv_round_trip_{uuid4().hex}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    write_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return read_csv(spark, path, "doc_id bigint, text string", na_values=None)


@query("""select o_orderkey as id, 'o_orderpriority_' || o_orderpriority as feature, 1.0::double as value from orders
    union all select o_orderkey, 'c_mktsegment_' || coalesce(c_mktsegment, '__null__'), 1.0::double from orders left join customer on o_custkey = c_custkey""")
def onehot_encode(spark, d):
    """One row per set entry of the one-hot vector, named from the fitted indexers."""
    columns = ["o_orderpriority", "c_mktsegment"]
    df = fill_nulls(orders_full(spark, d).select("o_orderkey", *columns), columns)
    model = build_pipeline(columns).fit(df)
    names = F.array(*[F.lit(f"{c}_{v}") for c, labels in zip(columns, model.stages[0].labelsArray, strict=True) for v in labels])
    from pyspark.ml.functions import vector_to_array

    hot = model.transform(df).select("o_orderkey", vector_to_array("features").alias("x"))
    return hot.select(F.col("o_orderkey").alias("id"), F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"))).alias("e")).select("id", "e.*").where("value <> 0")


MODEL_COLUMNS = ["o_orderpriority", "c_mktsegment", "n_name"]


def _fitted(spark, d):
    df = add_target(orders_full(spark, d), "o_orderstatus", ["F"], ["P"]).select("o_orderkey", *MODEL_COLUMNS, "target")
    return df, fit(df, MODEL_COLUMNS, classifier("gbt", maxIter=5, maxDepth=4))


def _checked(ranked: DataFrame, spark, d) -> DataFrame:
    """Facts of a ranking that hold whatever the model: the place, a probability not above the one before, and a key that the labelled table has."""
    from pyspark.sql import Window

    known = add_target(table(spark, d, "orders"), "o_orderstatus", ["F"], ["P"]).select("o_orderkey", F.lit(True).alias("known"))
    p = F.col("prob_contratacao")
    by = Window.orderBy(F.desc("prob_contratacao"), "o_orderkey")  # ten rows
    rows = ranked.join(known, "o_orderkey", "left").select(F.row_number().over(by).alias("place"), p.between(0, 1).alias("in_range"), (p <= F.lag("prob_contratacao", 1, 1.0).over(by)).alias("in_order"), F.coalesce("known", F.lit(False)).alias("known"))
    return rows.withColumn("place", F.col("place").cast("bigint"))


RANKING = "select unnest(range(1, 11)) as place, true as in_range, true as in_order, true as known"


@query(RANKING)
def fit_score_topk(spark, d):
    """Fit on all labelled rows, score them, keep ten; facts of the ranking."""
    df, model = _fitted(spark, d)
    return _checked(predict_proba(model, df, "o_orderkey", 10), spark, d)


@query(RANKING)
def rank_top_candidates(spark, d):
    """rank_candidates of a table that still holds its target."""
    df, model = _fitted(spark, d)
    ranked = rank_candidates(model, df, "o_orderkey")
    return _checked(ranked if "target" not in ranked.columns else ranked.where("false"), spark, d)


@query("""with f as (select distinct 'o_orderpriority_' || o_orderpriority as feature from orders where o_orderstatus <> 'P' union select distinct 'c_mktsegment_' || coalesce(c_mktsegment, '__null__') from orders left join customer on o_custkey = c_custkey where o_orderstatus <> 'P'
    union select distinct 'n_name_' || coalesce(n_name, '__null__') from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus <> 'P') select feature, true as in_range from f""")
def feature_importance_names(spark, d):
    """Every encoded category once, its importance a share (absent ones have none)."""
    df, model = _fitted(spark, d)
    got = feature_importance(model, df, 10_000).withColumnRenamed("importance", "x")
    columns = F.array(*[F.concat(F.lit(f"{c}_"), F.coalesce(F.col(c).cast("string"), F.lit("__null__"))) for c in MODEL_COLUMNS])
    every = df.select(F.explode(columns).alias("feature")).distinct()
    return every.join(got, "feature", "full").select("feature", F.coalesce(F.col("x").between(0, 1), F.lit(True)).alias("in_range"))


SPLIT = """with t as (select o_orderkey, cast(o_orderstatus = 'F' as int) as target from orders where o_orderstatus <> 'P'),
    s as (select target, row_number() over (partition by target order by md5(o_orderkey || '|42'), o_orderkey) <= floor(0.2::double * count(*) over (partition by target) + 0.5::double) as is_test from t),
    c as (select count(*) filter (target = 0) as n0, count(*) filter (target = 1) as n1 from s where is_test)"""


@query(f"{SPLIT} select unnest(['0', '1', 'accuracy', 'macro avg', 'weighted avg']) as label, unnest([n0, n1, n0 + n1, n0 + n1, n0 + n1]) as support, true as in_range from c")
def holdout_report(spark, d):
    """Stratified split, balanced random forest, report on the held-out part: its supports, and that every figure is a share."""
    from lariat.operators.model import train_and_evaluate

    df = add_target(orders_full(spark, d), "o_orderstatus", ["F"], ["P"]).select("o_orderkey", *MODEL_COLUMNS, "target")
    _, report = train_and_evaluate(df, "o_orderkey", MODEL_COLUMNS, classifier("rf", weight="weight", numTrees=10, maxDepth=6), weight="balanced")
    return report.select("label", "support", (F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)).alias("in_range"))


@query("select o_orderkey, true as in_range, true as agrees from orders where o_orderstatus <> 'P'")
def batch_predict(spark, d):
    """Every labelled row scored: a probability, and the hard label that goes with it."""
    df, model = _fitted(spark, d)
    p = F.col("prob_contratacao")
    return predict(model, df).select("o_orderkey", p.between(0, 1).alias("in_range"), ((p > 0.5).cast("int") == F.col("prediction")).alias("agrees"))


@query()
def score_table(spark, d):
    """Every labelled row with its probability and hard label, as a run of the model gives them."""
    df, model = _fitted(spark, d)
    return predict(model, df).select("o_orderkey", "prob_contratacao", "prediction")
