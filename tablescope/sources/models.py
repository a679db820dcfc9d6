"""Saving and loading fitted models, ML pipelines and parameter tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """Spark ML writer plus a one-row JSON side-car with the metadata and the time."""
    fitted = model if isinstance(model, PipelineModel) else PipelineModel([model])
    fitted.write().overwrite().save(path)
    if metadata:
        spark = SparkSession.getActiveSession()
        row = {**{k: str(v) for k, v in metadata.items()},
               "saved_at": datetime.now().isoformat(), "model_path": path}
        spark.createDataFrame([row]).write.mode("overwrite").json(f"{path}.meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict | None]:
    from tablescope.sources.tables import exists

    model = PipelineModel.load(path)
    meta = spark.read.json(f"{path}.meta").first().asDict() if exists(spark, f"{path}.meta") else None
    return model, meta


def save_stages(stages: list, path: str) -> None:
    """An unfitted sequence of ML stages."""
    Pipeline(stages=stages).write().overwrite().save(path)


def load_stages(path: str) -> list:
    return Pipeline.load(path).getStages()


def save_params(params: DataFrame, path: str) -> None:
    """Fitted fills, bounds or encodings."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
