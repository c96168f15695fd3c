"""Hiring labels from candidate status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that count as hired, and statuses of undecided candidates.
HIRED = ("Contratado pela Decision", "Contratado como Hunting", "Proposta Aceita")
UNDECIDED = (
    "Prospect",
    "Inscrito",
    "Encaminhado ao Requisitante",
    "Entrevista Técnica",
    "Entrevista com Cliente",
    "Em avaliação pelo RH",
    "Encaminhar Proposta",
    "Documentação PJ",
    "Documentação CLT",
    "Documentação Cooperado",
)
FEATURES = ("nivel_academico", "ingles", "espanhol", "area_atuacao", "nivel_profissional", "sap", "cliente")


def not_in(c: Column, values: Sequence[str]) -> Column:
    """Anti-membership that keeps nulls; exact comparison."""
    return ~F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


def is_in(c: Column, values: Sequence[str]) -> Column:
    """Membership as 0/1; null is 0."""
    return F.when(c.isin(*values), 1).otherwise(0) if values else F.lit(0)


def add_target(df: DataFrame, status: str = "situacao", success: Sequence[str] = HIRED, excluded: Sequence[str] = UNDECIDED, target: str = "target") -> DataFrame:
    """Drop excluded statuses (null stays) and append the 0/1 target."""
    return df.where(not_in(F.col(status), excluded)).withColumn(target, is_in(F.col(status), success))


def create_target_variable(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The model table: features in fixed order, then the target."""
    return add_target(df).select(*features, "target")
