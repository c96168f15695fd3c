"""Scoring a stream of records with a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from lariat.operators.model import predict


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """Stateless, row by row: batch and streaming frames score alike."""
    return predict(model, stream)
