"""Models as versioned artefacts: what was trained, on what, with which errors, and which version is in force.

A version is a folder that holds a saved pipeline. It is in force from the moment its row stands in the table of versions: the
row carries the folder's name, the features in their order, the last training season and the errors. The pipeline is saved
first and the row appended by one commit, so readers see the old version or the new one whole; a run that is lost between the two
leaves a folder that nobody reads. Of rows with the same number (two writers at once) the later folder name counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopspark.session import path_exists

ROW = "name string, version int, folder string, stages array<string>, features array<string>, target string, last_training_season int, errors map<string,double>"


@dataclass
class Published:
    model: PipelineModel
    name: str
    version: int
    features: list[str]
    target: str
    last_training_season: int
    errors: dict[str, float]


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """All published versions, one row each."""
    path = f"{folder}/versions"
    return spark.read.schema(ROW).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], ROW)


def publish(model: Model, folder: str, name: str, features: list[str], target: str, last_training_season: int, errors: dict[str, float], spark: SparkSession) -> int:
    """Save a fitted model and put it in force under a name; returns its version."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    own = f"{name}-{uuid.uuid4().hex}"
    pipeline.write().save(f"{folder}/{own}")
    before = versions(spark, folder).where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    row = (name, before + 1, own, [type(s).__name__ for s in pipeline.stages], list(features), target, last_training_season, {k: float(v) for k, v in errors.items()})
    spark.createDataFrame([row], ROW).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return before + 1


def load(spark: SparkSession, folder: str, name: str, version: int | None = None) -> Published:
    """The version in force, or a given one."""
    rows = versions(spark, folder).where(F.col("name") == name)
    row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version"), F.desc("folder")).first()
    if row is None:
        raise LookupError(f"no published model {name}" + ("" if version is None else f" of version {version}"))
    return Published(PipelineModel.load(f"{folder}/{row['folder']}"), name, row["version"], list(row["features"]), row["target"], row["last_training_season"], dict(row["errors"]))


def score(rows: DataFrame, published: Published, keep: list[str]) -> DataFrame:
    """The kept columns and the predictions of a published model. Rows need all its features, in any order; null counts as 0."""
    missing = [c for c in published.features if c not in rows.columns]
    if missing:
        raise ValueError(f"{published.name} {published.version} needs {', '.join(missing)}")
    names = [f"f_{i}" for i in range(len(published.features))]
    plain = rows.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(published.features, names)])
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(plain).drop(*names)
    return published.model.transform(packed).select(*keep, F.col("prediction").alias("predicted"), F.lit(published.version).alias("version"))


