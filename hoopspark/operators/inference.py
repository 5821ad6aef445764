"""How sure the numbers are: coefficients of a logistic model with their errors, and errors of predictions over resampled days."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200


def information_matrix(rows: DataFrame) -> np.ndarray:
    """Sum over rows of p (1 - p) x x', x an array with a 1 in front: one sum of outer products per task, added up by cell. The
    matrix has the square of the number of features; it is all that reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                p = batch.column(1).to_numpy(zero_copy_only=False)
                x = np.hstack([np.ones((len(x), 1)), x])
                part = (x * (p * (1 - p))[:, None]).T @ x
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = rows.select("x", "p").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(cells["j"].max()) + 1 if len(cells) else 0
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["v"]
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive definite matrix by elimination, one row operation per feature."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= others[:, None] * both[k]
    return both[:, n:]


def logistic_coefficients(model: PipelineModel, rows: DataFrame, features: list[str], penalty: float = 1.0, level: float = 1.959963984540054) -> DataFrame:
    """Coefficient of every standardised feature of a scaled logistic pipeline (and of the intercept) with its standard error, z and interval,
    from the information of its training rows plus the penalty on the weights."""
    fitted = model.stages[-1]
    scored = model.transform(rows).select(vector_to_array("scaled").alias("x"), vector_to_array("probability")[1].alias("p"))
    information = information_matrix(scored) + penalty * np.diag([0.0, *[1.0] * len(features)])
    errors = np.sqrt(np.diag(inverse(information)))
    values = [fitted.intercept, *fitted.coefficients.toArray()]
    table = [(name, float(b), float(e), float(b / e), float(b - level * e), float(b + level * e)) for name, b, e in zip(["(intercept)", *features], values, errors)]
    return rows.sparkSession.createDataFrame(table, "feature string, coefficient double, error double, z double, low double, high double")


# Shares below which a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(10)]


def day_weight(replicate: Column, day: Column) -> Column:
    """How often a day is drawn in a replicate: a Poisson number of mean 1 from a hash of both, the same wherever and however often it
    is asked for."""
    share = F.conv(F.substring(F.md5(F.concat_ws("|", replicate.cast("string"), day.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(share >= limit, 1).otherwise(0) for limit in POISSON), F.lit(0))


def resampled_errors(rows: DataFrame, keys: list[str], measures: dict[str, Column], day: str = "game_date", replicates: int = REPLICATES) -> DataFrame:
    """Mean of each measure (an error of one row) by key, with its standard error and interval when whole days are drawn again: games of
    a day share what is unusual about it. Rows are first added up by day, all replicates then come from one aggregate over days and
    replicates; no rows are drawn and nothing is joined. The interval holds the middle 95 percent of replicates."""
    sums = {m: F.sum(c) for m, c in measures.items()}
    days = rows.groupBy(*keys, day).agg(F.count("*").alias("_n"), *[s.alias(m) for m, s in sums.items()])
    drawn = days.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn(
        "_w", F.when(F.col("_r") == 0, 1).otherwise(day_weight(F.col("_r"), F.col(day))))
    per = drawn.where("_w > 0").groupBy(*keys, "_r").agg(F.sum(F.col("_w") * F.col("_n")).alias("_all"), *[F.sum(F.col("_w") * F.col(m)).alias(m) for m in measures])
    means = per.select(*keys, "_r", "_all", *[(F.col(m) / F.col("_all")).alias(m) for m in measures])
    again = F.col("_r") > 0
    return means.groupBy(*keys).agg(
        F.max(F.when(~again, F.col("_all"))).alias("n"),
        *[c for m in measures for c in (F.max(F.when(~again, F.col(m))).alias(m), F.stddev_samp(F.when(again, F.col(m))).alias(f"{m}_error"),
                                        F.percentile(F.when(again, F.col(m)), F.lit(0.025)).alias(f"{m}_low"),
                                        F.percentile(F.when(again, F.col(m)), F.lit(0.975)).alias(f"{m}_high"))])
