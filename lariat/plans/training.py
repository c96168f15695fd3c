"""Batch training and drift runs, end to end.

    python -m lariat.plans.training BASE [--model PATH] [--table PATH] [--drift PATH] [--kind gbt|rf|lr]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from lariat.operators.drift import drift_report, write_drift_html
from lariat.operators.label import FEATURES, add_target
from lariat.operators.model import classifier, train_and_evaluate
from lariat.operators.sampling import exact_sample
from lariat.sources.tables import load_and_merge, save_model, write_csv

log = logging.getLogger(__name__)


def model_table(merged: DataFrame) -> DataFrame:
    """Row key, features, target."""
    return add_target(merged).select("vaga_id", "candidato_id", *FEATURES, "target")


def run_training(spark: SparkSession, base: str, model_path: str | None = None, table_path: str | None = None, **params) -> tuple[PipelineModel, DataFrame]:
    """Read, flatten, join, label, split, fit, report; optionally save the model table and the model."""
    from pyspark.sql import functions as F

    table = model_table(load_and_merge(spark, base)).withColumn("row_key", F.concat_ws("|", "vaga_id", "candidato_id")).persist()
    try:
        if table_path:
            write_csv(table.select(*FEATURES, "target"), table_path)
            log.info("model table written to %s", table_path)
        model, report = train_and_evaluate(table, "row_key", list(FEATURES), classifier(**params))
        if model_path:
            save_model(model, model_path)
            log.info("model saved to %s", model_path)
        return model, spark.createDataFrame(report.collect(), report.schema)  # five rows
    finally:
        table.unpersist()


def run_drift(table: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The table against its own exact sample."""
    return drift_report(table.drop(key), exact_sample(table, key, fraction, seed).drop(key))


def main(args: list[str] | None = None) -> None:
    """Train from the raw inputs under BASE, print the report; optionally save the table, the model and a drift page."""
    parser = argparse.ArgumentParser(prog="lariat.plans.training")
    parser.add_argument("base")
    parser.add_argument("--model")
    parser.add_argument("--table")
    parser.add_argument("--drift")
    parser.add_argument("--kind", default="gbt", choices=("gbt", "rf", "lr"))
    chosen = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    _, report = run_training(spark, chosen.base, chosen.model, chosen.table, kind=chosen.kind)
    report.show(truncate=False)
    if chosen.drift:
        from pyspark.sql import functions as F

        table = model_table(load_and_merge(spark, chosen.base)).withColumn("row_key", F.concat_ws("|", "vaga_id", "candidato_id")).drop("vaga_id", "candidato_id")
        write_drift_html(run_drift(table, "row_key"), chosen.drift)
        log.info("drift page written to %s", chosen.drift)


if __name__ == "__main__":
    main()
