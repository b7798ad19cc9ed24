"""Text classifiers: TF-IDF over words and word pairs, and a logistic regression, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register


def train(labelled: DataFrame, text: str, label: str, features: int = 1 << 14, least: int = 2) -> PipelineModel:
    """A model of ``label`` (0 or 1) by ``text``; null counts as empty text."""
    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}0-9_#*$%&|<>]+")
    pairs = NGram(n=2, inputCol="__words", outputCol="__pairs")
    counts = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("__words", "__pairs")]
    weights = [IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf", minDocFreq=least) for c in ("__words", "__pairs")]
    both = VectorAssembler(inputCols=["__words_idf", "__pairs_idf"], outputCol="__features")
    fit = LogisticRegression(featuresCol="__features", labelCol=label, maxIter=20, regParam=0.01)
    return Pipeline(stages=[words, pairs, *counts, *weights, both, fit]).fit(labelled.withColumn(text, F.coalesce(text, F.lit(""))).withColumn(label, F.col(label).cast("double")))


def predict(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``probability`` of label 1 and ``predicted``."""
    out = model.transform(rows.withColumn(text, F.coalesce(text, F.lit(""))))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("probability"), (F.col("prediction") == 1).alias("predicted"))


def held_out(key: str) -> Column:
    """A quarter of the rows, by id."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def quality_model(v) -> DataFrame:
    """Quality of every document, by a model of the labelled ones outside the held-out quarter."""
    docs = v.documents.select("doc_id", "text")
    labelled = docs.join(v.labels.select("doc_id", "quality"), "doc_id").where(~held_out("doc_id"))
    return predict(train(labelled, "text", "quality"), docs, "text").select("doc_id", held_out("doc_id").alias("held_out"), "predicted", F.round("probability", 6).alias("probability"))


register("text_models", quality_model)
