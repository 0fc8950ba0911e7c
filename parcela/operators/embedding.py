"""Text to vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import normalize_text
from ..session import spread

DEFAULT_WIDTH = 256
TEXTS_PER_BATCH = 8


def embed_text(df: DataFrame, text: str = "DESCRIPTION", output: str = "embedding", width: int = DEFAULT_WIDTH,
               make_model: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None,
               batch_size: int = TEXTS_PER_BATCH, share: bool = True) -> DataFrame:
    """Add a vector of the normalised text.

    ``make_model`` loads a model and returns a function from an array of texts
    to a matrix; it runs once per Python worker. Without it, words are hashed
    into ``width`` buckets and the counts scaled to length one: no model file
    and the same vector everywhere, but only word overlap counts. ``share`` off
    leaves the rows in their partitions, however few these are.
    """
    df = spread(df) if share else df
    clean = F.coalesce(normalize_text(text), F.lit(""))
    if make_model is not None:
        run = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
        return df.withColumn(output, run(clean))
    rows = df.withColumn("_text", clean)
    hashed = PipelineModel([
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width),
        Normalizer(inputCol="_counts", outputCol="_unit"),
    ]).transform(rows)
    vector = vector_to_array("_unit", "float32")
    return hashed.withColumn(output, vector).drop("_text", "_words", "_counts", "_unit")


def embed_query(spark: SparkSession, text: str, **options) -> list[float]:
    """Vector of one search text, made the same way as the stored ones."""
    one = spark.range(1).select(F.lit(text).alias("DESCRIPTION"))
    return list(embed_text(one, **options).first()["embedding"])
