"""Distributed learners on zonal features and patch vectors."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.operators.pixels import majority


def classify_objects(pixels: DataFrame, trees: int = 400, seed: int = 0) -> DataFrame:
    """``(cell_id, inst_pred, prob, crop)``: a balanced random forest on band means and spreads, trained on every second cell."""
    bands = ["red", "grn", "blu"]
    stats = pixels.groupBy("cell_id", "inst_pred").agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_pop(b).alias(f"s_{b}") for b in bands])
    truth = majority(pixels.where("truth > 0"), ["cell_id", "inst_pred"], "truth").select("cell_id", "inst_pred", F.when(F.col("truth").isin(1, 2), 1.0).otherwise(0.0).alias("label"))
    rows = VectorAssembler(inputCols=[f"{k}_{b}" for k in "ms" for b in bands], outputCol="features").transform(stats.join(truth, ["cell_id", "inst_pred"]))
    train = rows.where("cell_id % 2 = 0")
    shares = train.groupBy("label").agg(F.count("*").alias("of_label"))  # two rows
    train = train.join(F.broadcast(shares), "label").withColumn("weight", 1.0 / F.col("of_label"))
    model = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", labelCol="label").fit(train)
    prob = vector_to_array("probability")[1]
    return model.transform(rows).select("cell_id", "inst_pred", prob.alias("prob"), (prob > 0.5).alias("crop"))


def cluster_features(vectors: DataFrame, k: int = 80, seed: int = 0) -> DataFrame:
    """``vectors(vec_id, features array<double>)`` -> ``(vec_id, cluster)``."""
    rows = vectors.select("vec_id", array_to_vector("features").alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).select("vec_id", "cluster")
