"""Keyed JSON documents: one object whose keys are entity ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROSPECTS = """struct<titulo: string, modalidade: string, prospects: array<struct<
  codigo: string, situacao_candidado: string, comentario: string, nome: string,
  recrutador: string, data_candidatura: string, ultima_atualizacao: string>>>"""
JOBS = """struct<informacoes_basicas: struct<cliente: string, vaga_sap: string>,
  perfil_vaga: struct<`nivel profissional`: string, nivel_ingles: string,
                      competencia_tecnicas_e_comportamentais: string>>"""


def read_keyed_json(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """One file, parsed in one task (a JSON object can't be split; convert larger inputs to JSON lines or Parquet once). Equal keys are left to dedupe_last, which combines before its shuffle."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string, {value_type}>", {"mode": "FAILFAST"})
    rows = text.select(F.posexplode(F.map_entries(parsed)).alias("pos", "entry"))
    return rows.select("entry.key", F.col("pos").cast("bigint").alias("pos"), "entry.value")


def read_json_lines(spark: SparkSession, path: str, key: str, position: str, value_type: str) -> DataFrame:
    """The splittable form for large inputs: one {key, position, value} object a line."""
    return spark.read.schema(f"{key} string, {position} bigint, value {value_type}").option("mode", "FAILFAST").json(path).selectExpr(f"{key} as key", f"{position} as pos", "value")
