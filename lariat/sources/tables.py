"""Parquet, CSV and fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lariat.operators.shape import flatten_prospects, merge_all
from lariat.sources.keyed_json import JOBS, PROSPECTS, read_keyed_json

# Tokens that read as missing.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MODEL_PATH = "models/modelo_priorizacao_xgb"
# Of both ways, so that any text comes back: Spark's writer trims by default, and its reader drops a NUL before a quote.
CSV = {"header": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
ONLY_NUL = r"\A\x00+\z"


@dataclass(frozen=True)
class RawTables:
    """Lazy frames of the three raw inputs."""

    jobs: DataFrame
    prospects: DataFrame
    applicants: DataFrame


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_applicants(spark: SparkSession, path: str, key: str = "__index_level_0__", position: str | None = None, lazy: bool = False) -> DataFrame:
    """Applicants with a ``pos`` column. Raw keys must be unique: otherwise an error is raised here, or with ``lazy`` when the rows are read, and no job runs before. Without a position column the order is that of a single file's rows; with several files one is required, for their order says nothing."""
    df = read_parquet(spark, path)
    if position is None and len(df.inputFiles()) > 1:
        raise ValueError("several files: name a position column")
    df = df.withColumn("pos", F.col(position).cast("bigint") if position else F.monotonically_increasing_id())
    if lazy:
        packed = df.groupBy(F.col(key).alias("__key")).agg(F.first(F.struct(*df.columns)).alias("__row"), F.count("*").alias("__n"))
        once = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.lit(f"{key} is not unique")))
        return packed.select(once.alias("__row")).select("__row.*")
    worst = df.groupBy(key).count().agg(F.max("count")).first()[0]
    if worst is not None and worst > 1:
        raise ValueError(f"{key} is not unique")
    return df


def load_raw(spark: SparkSession, base: str, applicant_key: str = "__index_level_0__", applicant_position: str | None = None) -> RawTables:
    """The three raw inputs under ``base``; nothing is read before the frames are used."""
    return RawTables(
        read_keyed_json(spark, f"{base}/jobs.json", JOBS),
        read_keyed_json(spark, f"{base}/prospects.json", PROSPECTS),
        read_applicants(spark, f"{base}/applicants.parquet", applicant_key, applicant_position, lazy=True),
    )


def load_and_merge(spark: SparkSession, base: str, save: str | None = None, applicant_key: str = "__index_level_0__", applicant_position: str | None = None) -> DataFrame:
    """Raw inputs to the merged table; with ``save``, also written there as CSV."""
    raw = load_raw(spark, base, applicant_key, applicant_position)
    merged = merge_all(raw.jobs, raw.applicants, flatten_prospects(raw.prospects), applicant_key)
    if save:
        write_csv(merged, save)
    return merged


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({f.name: change(F.col("`" + f.name.replace("`", "``") + "`")) for f in df.schema.fields if isinstance(f.dataType, StringType)})


def read_csv(spark: SparkSession, path: str, schema: StructType | str, na_values: Sequence[str] | None = NA_VALUES) -> DataFrame:
    """Header, doubled quotes, line breaks inside quotes. Text equal to an NA token becomes null. Without the empty text among the tokens (None: no tokens) only a blank field is null, so what ``write_csv`` wrote comes back as it was."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    exact = "" not in (na_values or ()) and any(isinstance(f.dataType, StringType) for f in schema)
    df = spark.read.schema(schema).options(**CSV, multiLine=True, nullValue="\0" if exact else "", mode="FAILFAST").csv(path)
    df = _texts(df, lambda c: F.when(c.rlike(ONLY_NUL), F.substring(c, 2, 2**31 - 1)).otherwise(c))
    if not na_values:
        return df
    return df.select(*[F.when(~F.col(f.name).isin(*na_values), F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of CSV files with headers; as many as partitions, or ``files`` (1 sends a large table through one task). Texts keep their outer white space; null is a blank field, the empty text a quoted one. The reader's mark of a blank field is one NUL, so a text of NULs only gets one more. As blank lines are skipped, nulls of a single column are written as the mark (texts) or quoted (others)."""
    out = _texts(df.coalesce(files) if files else df, lambda c: F.when(c.rlike(ONLY_NUL), F.concat(c, F.lit("\0"))).otherwise(c))
    blank = "" if len(df.columns) > 1 else "\0" if isinstance(df.schema[0].dataType, StringType) else '""'
    out.write.mode("overwrite").options(**CSV, nullValue=blank).csv(path)


def save_model(model: PipelineModel, path: str = MODEL_PATH) -> None:
    model.write().overwrite().save(path)


def load_model(path: str = MODEL_PATH) -> PipelineModel:
    return PipelineModel.load(path)
