"""Parameter search: seeded random sets, main effects, a forest as surrogate, partial dependence and permutation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_sets(spark: SparkSession, space: dict[str, list], n: int, seed: int = 42) -> DataFrame:
    """The default (first values) and n others, no set twice; drawn by hashes, so the same everywhere."""
    sets = {json.dumps({k: v[0] for k, v in space.items()}, sort_keys=True): None}
    total = 1
    for v in space.values():
        total *= len(v)
    k = 0
    while len(sets) < min(n + 1, total):
        pick = {p: v[int(hashlib.sha256(f"{seed}:{k}:{p}".encode()).hexdigest()[:8], 16) % len(v)] for p, v in space.items()}
        sets.setdefault(json.dumps(pick, sort_keys=True))
        k += 1
    rows = [(i, *(json.loads(s)[p] for p in space)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, ["param_id", *space])


def main_effects(trials: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """For each parameter the spread of the mean metric over its values."""
    long = trials.select(metric, F.explode(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters))).alias("x")).select(metric, "x.*")
    by = long.groupBy("parameter", "value").agg(F.avg(metric).alias("mean"))
    return by.groupBy("parameter").agg((F.max("mean") - F.min("mean")).alias("effect"), F.min("mean").alias("low"), F.max("mean").alias("high"))


def surrogate(trials: DataFrame, parameters: list[str], metric: str, trees: int = 400, seed: int = 42):
    """A forest that predicts the metric from numeric parameters: the model and the assembled trials."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=parameters, outputCol="features").transform(trials)
    return RandomForestRegressor(labelCol=metric, numTrees=trees, minInstancesPerNode=3, seed=seed).fit(data), data


def partial_dependence(model, trials: DataFrame, parameters: list[str], one: str, grid: list[float]) -> DataFrame:
    """Mean prediction with one parameter held at each value, over all trials."""
    from pyspark.ml.feature import VectorAssembler

    held = trials.select(*parameters).withColumn("__g", F.explode(F.array(*map(F.lit, grid)))).withColumn(one, F.col("__g"))
    scored = model.transform(VectorAssembler(inputCols=parameters, outputCol="features").transform(held))
    return scored.groupBy(F.col("__g").alias(one)).agg(F.avg("prediction").alias("mean_prediction"))


def permutation_importance(model, trials: DataFrame, parameters: list[str], metric: str, repeats: int = 20, seed: int = 42) -> DataFrame:
    """Rise of the squared error when a parameter's values are dealt out anew, by the order of a seeded hash."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window

    rows = trials.select("param_id", metric, *parameters)
    base = model.transform(VectorAssembler(inputCols=parameters, outputCol="features").transform(rows)).agg(F.avg((F.col("prediction") - F.col(metric)) ** 2).alias("b"))
    out = None
    for p in parameters:
        each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        w = Window.partitionBy("rep")
        a = each.withColumn("k", F.row_number().over(w.orderBy("param_id")))
        b = each.select("rep", F.col(p).alias("__new"), F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", F.lit(f"{seed}:{p}"), "rep", "param_id"), 256))).alias("k"))
        mixed = a.join(b, ["rep", "k"]).withColumn(p, F.col("__new"))
        error = model.transform(VectorAssembler(inputCols=parameters, outputCol="features").transform(mixed)).groupBy("rep").agg(F.avg((F.col("prediction") - F.col(metric)) ** 2).alias("e"))
        one = error.crossJoin(base).agg(F.lit(p).alias("parameter"), F.avg(F.col("e") - F.col("b")).alias("importance"), F.stddev_samp(F.col("e") - F.col("b")).alias("std"))
        out = one if out is None else out.unionByName(one)
    return out
