"""Nested records to flat tables: unnest, last-wins dedupe, key-normalised left joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.functions.text import safe_key


def dedupe_last(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row with the greatest position of each key. max_by is an aggregate, so equal keys combine before the shuffle and a hot key costs one row a task."""
    packed = df.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), F.col(position)).alias("__row"))
    return packed.select("__row.*")


def flatten_prospects(prospects: DataFrame) -> DataFrame:
    """(key, pos, value<titulo, modalidade, prospects>) to one row per vacancy and prospect, with 10 columns.

    The vacancy id is the raw key; only exactly equal raw keys are deduplicated (the last stays), as a JSON object does.
    """
    last = dedupe_last(prospects, "key", "pos")
    rows = last.select(F.col("key").alias("vaga_id"), F.col("value.titulo").alias("titulo_vaga"), F.col("value.modalidade").alias("modalidade_vaga"), F.explode("value.prospects").alias("p"))
    return rows.select(
        "vaga_id",
        F.col("p.codigo").alias("candidato_id"),
        F.col("p.situacao_candidado").alias("situacao"),
        F.col("p.comentario").alias("comentario"),
        F.col("p.nome").alias("nome"),
        F.col("p.recrutador").alias("recrutador"),
        F.col("p.data_candidatura").alias("data_candidatura"),
        F.col("p.ultima_atualizacao").alias("ultima_atualizacao"),
        "titulo_vaga",
        "modalidade_vaga",
    )


def left_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer equi-join on a key that is unique on the right: exactly one output row per left row. AQE broadcasts the right side if its measured size allows."""
    return left.join(right, key, "left")


def keyed_lookup(df: DataFrame, key: str, position: str, columns: Sequence[Column], name: str) -> DataFrame:
    """A join's build side: normalise the key, keep the last row of each, project."""
    clean = df.select(safe_key(F.col(key)).alias(name), F.col(position).alias("__pos"), *columns)
    return dedupe_last(clean, name, "__pos").drop("__pos")


def merge_all(jobs: DataFrame, applicants: DataFrame, prospects: DataFrame, applicant_key: str = "__index_level_0__", applicant_position: str = "pos") -> DataFrame:
    """Flattened prospects, left-joined to jobs and applicants on normalised keys; 18 columns, one row per prospect.

    Present-but-null structs give nulls.
    """
    value = lambda path: F.col(f"value.{path}")
    jobs_side = keyed_lookup(
        jobs,
        "key",
        "pos",
        [
            value("informacoes_basicas.cliente").alias("cliente"),
            value("informacoes_basicas.vaga_sap").alias("sap"),
            value("perfil_vaga.`nivel profissional`").alias("nivel_profissional"),
            value("perfil_vaga.nivel_ingles").alias("idioma"),
            value("perfil_vaga.competencia_tecnicas_e_comportamentais").alias("competencias_tecnicas"),
        ],
        "vaga_id",
    )
    people = keyed_lookup(
        applicants,
        applicant_key,
        applicant_position,
        [
            F.col("formacao_e_idiomas.nivel_academico").alias("nivel_academico"),
            F.col("formacao_e_idiomas.nivel_ingles").alias("ingles"),
            F.col("formacao_e_idiomas.nivel_espanhol").alias("espanhol"),
            F.col("informacoes_profissionais.area_atuacao").alias("area_atuacao"),
            F.col("informacoes_profissionais.conhecimentos_tecnicos").alias("conhecimentos"),
            F.col("cv_pt").alias("cv"),
        ],
        "candidato_id",
    )
    base = prospects.select(safe_key(F.col("vaga_id")).alias("vaga_id"), safe_key(F.col("candidato_id")).alias("candidato_id"), "situacao", "comentario", "nome", "titulo_vaga", "modalidade_vaga")
    merged = left_lookup(left_lookup(base, jobs_side, "vaga_id"), people, "candidato_id")
    return merged.select(
        "vaga_id", "candidato_id", "situacao", "comentario", "nome", "titulo_vaga", "modalidade_vaga", "cliente", "sap", "nivel_profissional", "idioma",
        "competencias_tecnicas", "nivel_academico", "ingles", "espanhol", "area_atuacao", "conhecimentos", "cv",
    )
