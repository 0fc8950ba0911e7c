"""Price models: search, training, scoring and versions."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import to_number
from ..schema import FeatureSpec
from ..session import materialize
from .features import TargetInverse, TargetTransform, feature_pipeline, hash_split
from .filters import drop_incomplete, training_rows
from .quantiles import quantiles
from .stats import regression_metrics

# Ranges the random search draws from. "log" draws on a
# logarithmic scale. Depth is capped at 30, the most Spark's trees allow.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "numTrees": ("int", 100, 1000),
        "maxDepth": ("int", 10, 30),
        "minInstancesPerNode": ("int", 1, 32),
    },
    "xgboost": {
        "maxIter": ("int", 100, 1000),
        "maxDepth": ("int", 3, 12),
        "stepSize": ("log", 0.01, 0.3),
        "subsamplingRate": ("float", 0.6, 1.0),
        "featureSubsetStrategy": ("text", 0.6, 1.0),
        "minInfoGain": ("float", 0.0, 5.0),
        "minInstancesPerNode": ("int", 1, 10),
    },
    "lightgbm": {
        "maxIter": ("int", 100, 800),
        "maxDepth": ("int", 3, 12),
        "stepSize": ("log", 0.01, 0.3),
        "featureSubsetStrategy": ("text", 0.7, 1.0),
        "subsamplingRate": ("float", 0.7, 1.0),
        "minInstancesPerNode": ("int", 10, 50),
    },
    "elastic_net": {
        "regParam": ("log", 1e-4, 10.0),
        "elasticNetParam": ("float", 0.1, 0.9),
        "maxIter": ("int", 1000, 3000),
        "tol": ("log", 1e-5, 1e-3),
    },
}

_REGRESSORS = {
    "random_forest": RandomForestRegressor,
    "xgboost": GBTRegressor,
    "lightgbm": GBTRegressor,
    "elastic_net": LinearRegression,
}


def make_regressor(kind: str, params: Mapping[str, object] | None = None,
                   features: str = "features", label: str = "label", seed: int = 42):
    """Spark regressor for a model kind. Both boosters map to GBTRegressor."""
    if kind not in _REGRESSORS:
        raise ValueError(f"unknown model kind {kind!r}")
    model = _REGRESSORS[kind](featuresCol=features, labelCol=label)
    if kind != "elastic_net":
        model = model.setSeed(seed)
    return model.copy({model.getParam(n): v for n, v in (params or {}).items()})


class MedianApeEvaluator(Evaluator):
    """Median absolute percentage error; lower is better."""

    labelCol = Param(Params._dummy(), "labelCol", "true value", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        y, z = (F.col(self.getOrDefault(p)).cast("double") for p in (self.labelCol, self.predictionCol))
        gap = F.abs(y - z)
        ape = F.when(y != 0.0, gap / F.nullif(F.abs(y), F.lit(0.0))).otherwise(F.lit(float("inf")))
        row = quantiles(dataset.select(ape.alias("ape")), ["ape"], [0.5]).first()
        return float(row["quantiles"][0]) if row else float("nan")

    def isLargerBetter(self) -> bool:
        return False


def draw_params(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict[str, object]]:
    """``trials`` independent draws from a search space; same seed, same draws."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        one: dict[str, object] = {}
        for name, (scale, low, high) in space.items():
            if scale == "int":
                one[name] = rng.randint(low, high)
            elif scale == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                value = rng.uniform(low, high)
                one[name] = f"{value:.4f}" if scale == "text" else value
        draws.append(one)
    return draws


@dataclass
class SearchResult:
    """The best draw, its score, and every draw with its mean score over the
    folds it was measured on (``seen``, in the order of ``trials``)."""

    params: dict[str, object]
    score: float
    trials: list[tuple[dict[str, object], float]]
    seen: list[int] = field(default_factory=list)


def stored_folds(prepared: DataFrame, folds: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """``prepared`` stored once with ``_fold`` (0 to ``folds`` - 1) as partition
    column, so that training and validation rows are files of their own. Rows of
    one ``key`` share a fold; without a key, rows are dealt at random."""
    dealt = F.floor(F.rand(seed) * folds) if key is None else F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds))
    return materialize(prepared.withColumn("_fold", dealt.cast("int")), "folds", by=["_fold"])


def random_search(prepared: DataFrame, kind: str, trials: int = 50, folds: int = 5, seed: int = 42,
                  parallelism: int = 4, key: str | None = None,
                  space: Mapping[str, tuple] | None = None, keep: float = 1.0) -> SearchResult:
    """Draw parameters at random and keep the lowest cross-validated median APE,
    measured on the transformed target. ``key`` makes the folds reproducible.

    Draws are measured fold by fold, ``parallelism`` of them side by side. After
    every fold the best share ``keep`` of the draws still running goes on, at
    least one; at 1, the default, all of them see every fold. A draw that scores
    NaN comes last, of equal draws the first is the better one.
    """
    if not 0 < keep <= 1:
        raise ValueError(f"keep must be above 0 and at most 1, not {keep}")
    draws = draw_params(space or SEARCH_SPACES[kind], trials, seed)
    table = stored_folds(prepared, folds, seed, key)
    measure = MedianApeEvaluator()
    scores: list[list[float]] = [[] for _ in draws]

    def mean(i: int) -> float:
        return sum(scores[i]) / len(scores[i])

    def order(i: int) -> tuple[bool, float, int]:
        return math.isnan(mean(i)), mean(i), i

    running = list(range(trials))
    with ThreadPool(min(parallelism, trials)) as pool:
        for fold in range(folds):
            train, valid = table.filter(F.col("_fold") != fold), table.filter(F.col("_fold") == fold)

            def score(i: int, train: DataFrame = train, valid: DataFrame = valid) -> float:
                return measure.evaluate(make_regressor(kind, draws[i], seed=seed).fit(train).transform(valid))

            for i, found in zip(running, pool.map(inheritable_thread_target(table.sparkSession)(score), running)):
                scores[i].append(found)
            if fold < folds - 1:
                running = sorted(running, key=order)[:max(1, math.ceil(keep * len(running)))]
    best = min(running, key=order)
    return SearchResult(draws[best], mean(best), [(d, mean(i)) for i, d in enumerate(draws)], [len(x) for x in scores])


@dataclass
class TrainedModel:
    kind: str
    model: PipelineModel
    params: dict[str, object]
    metrics: DataFrame


def train_price_model(df: DataFrame, kind: str = "xgboost", spec: FeatureSpec = FeatureSpec(),
                      key: str = "_id", params: Mapping[str, object] | None = None, trials: int = 50,
                      folds: int = 5, seed: int = 42, space: Mapping[str, tuple] | None = None,
                      test_share: float = 0.2, order: str = "drop_first", keep: float = 1.0) -> TrainedModel:
    """Filter, split, prepare, search (unless ``params`` are given), fit and
    evaluate. ``metrics`` holds one row for the training set and one for the
    test set, in the unit of the target. ``keep`` is the search's."""
    # Read by every fit below, so what made ``df`` is not computed again each time.
    rows = materialize(training_rows(df, spec, order, keep=[key]), "training")
    train, test = hash_split(rows, key, test_share, seed)
    features = feature_pipeline(spec).fit(train)
    target = TargetTransform(inputCol=spec.target).fit(train)
    # A target of -1 or less has no logarithm; such a row cannot be learnt from.
    # Filtered on the raw column: a filter on the label would be pushed below the
    # transform and carry its whole expression along.
    learnable = train.filter(F.col(spec.target) > -1.0)
    # Every trial and every tree level reads this table again.
    labelled = target.transform(features.transform(learnable)).select(key, "features", "label")
    prepared = materialize(labelled, "prepared")
    if params is None:
        params = random_search(prepared, kind, trials, folds, seed, key=key, space=space, keep=keep).params
    fitted = make_regressor(kind, params, seed=seed).fit(prepared)
    model = PipelineModel([*features.stages, fitted, TargetInverse(levels=target.get("levels"))])

    scored = None
    for name, part in (("Training", train), ("Test", test)):
        one = score_prices(model, part).select(
            F.lit(kind).alias("model"), F.lit(name).alias("Set"),
            F.col(spec.target).alias("y_true"), F.col("predicted_price").alias("y_pred"))
        scored = one if scored is None else scored.unionByName(one)
    metrics = regression_metrics(materialize(scored, "scored"), by=["model", "Set"])
    return TrainedModel(kind, model, dict(params), metrics)


def score_prices(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``predicted_price`` to a whole table."""
    return model.transform(df).select(*df.columns, "predicted_price")


# Types and defaults of a scoring request.
REQUIRED_INPUT = {
    "AREA": "double", "LATITUDE": "double", "LONGITUDE": "double", "ROOMS": "int", "BATHROOMS": "int",
    "STRATUM": "int", "BEDROOMS": "int", "ANTIQUITY": "string", "PROPERTY_TYPE": "string",
}
OPTIONAL_INPUT = {"BUILT_AREA": 0.0, "PRIVATE_AREA": 0.0, "FLOOR": 0.0, "GARAGE": 0.0}


def _typed(c: str, kind: str) -> Column:
    if kind == "string":
        return F.col(c).cast("string")
    number = to_number(c)
    # A whole number may arrive as 3, 3.0 or text; 3.5 is no whole number.
    return F.when(number == F.floor(number), number.try_cast("int")) if kind == "int" else number


def prepare_scoring_input(df: DataFrame, fill_null: bool = True) -> DataFrame:
    """Give a scoring table its types and defaults. Absent optional fields
    become 0 (nulls too, unless ``fill_null`` is off); rows that lack a required
    field or hold another type in it are left out."""
    absent = [c for c in REQUIRED_INPUT if c not in df.columns]
    if absent:
        raise ValueError(f"scoring input lacks {absent}")
    typed = {c: _typed(c, kind) for c, kind in REQUIRED_INPUT.items()}
    for c, default in OPTIONAL_INPUT.items():
        if c not in df.columns:
            typed[c] = F.lit(default)
        else:
            typed[c] = F.coalesce(to_number(c), F.lit(default)) if fill_null else to_number(c)
    return drop_incomplete(df.withColumns(typed), list(REQUIRED_INPUT))


def _reason(c: str, kind: str, typed: Column) -> Column:
    """Why a required field is refused, null if it is fine. NaN is no number."""
    wanted = "a whole number" if kind == "int" else "a number"
    return F.when(F.col(c).isNull(), F.lit(f"{c} is missing")).when(
        typed.isNull(), F.concat(F.lit(f"{c} is not {wanted}: "), F.col(c).cast("string")))


def judge_scoring_input(df: DataFrame) -> DataFrame:
    """``df`` with ``reasons``: one text per required field that is missing or of
    another type, in the order of the fields; a row without any may be scored.
    A field that the table lacks is missing in every row."""
    judged = []
    for c, kind in REQUIRED_INPUT.items():
        judged.append(_reason(c, kind, _typed(c, kind)) if c in df.columns else F.lit(f"{c} is missing"))
    return df.withColumn("reasons", F.array_compact(F.array(*judged)))


def split_scoring_input(df: DataFrame, path: str, fill_null: bool = True) -> tuple[DataFrame, DataFrame]:
    """Requests ready for scoring, and the refused ones as they came, with
    ``reasons``. Both are parts of one table below ``path``, written in one pass,
    so each request is in exactly one of them."""
    judged = judge_scoring_input(df)
    judged.withColumn("accepted", F.size("reasons") == 0).write.partitionBy("accepted").parquet(path)
    stored = df.sparkSession.read.schema(judged.schema.add("accepted", "boolean")).parquet(path)
    accepted = stored.filter("accepted").drop("accepted", "reasons")
    refused = stored.filter("NOT accepted").drop("accepted")
    if not set(REQUIRED_INPUT) <= set(df.columns):
        return accepted, refused
    return prepare_scoring_input(accepted, fill_null), refused


def _folder(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _stored_versions(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(version, change time) of the model folders below ``root``."""
    files, path = _folder(spark, root)
    if not files.exists(path):
        return []
    found = [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(path)]
    return [(int(n[2:]), at) for n, at in found if n.startswith("v=") and n[2:].isdigit()]


def claim_version(spark: SparkSession, root: str) -> int:
    """The next free version, taken by creating its claim file without
    overwriting: of two writers who try the same number only one succeeds, the
    other goes on to the next."""
    files, _ = _folder(spark, root)
    version = max([v for v, _ in _stored_versions(spark, root)], default=0) + 1
    while True:
        claim = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/v={version:04d}")
        try:
            files.create(claim, False).close()
            return version
        except Py4JJavaError as error:
            if not files.exists(claim):
                raise error
            version += 1


def save_model(trained: TrainedModel, root: str) -> int:
    """Store a model as the next version; its metrics row registers it. Writers
    at the same time get versions of their own, and a run that dies before
    its row is written leaves a folder load_latest does not pick."""
    spark = trained.metrics.sparkSession
    version = claim_version(spark, root)
    trained.model.write().save(f"{root}/v={version:04d}")
    trained.metrics.select(
        F.lit(version).alias("version"), F.current_timestamp().alias("registered_at"),
        F.lit(repr(sorted(trained.params.items()))).alias("params"), "*",
    ).write.mode("append").parquet(f"{root}/registry")
    return version


def registered_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/registry")


def load_latest(spark: SparkSession, root: str) -> tuple[int, PipelineModel]:
    """The newest registered version, or the newest folder if there is no registry."""
    files, path = _folder(spark, f"{root}/registry")
    if files.exists(path):
        version = registered_models(spark, root).agg(F.max("version")).first()[0]
    else:
        # A folder that was claimed but never registered is not complete.
        claims, folder = _folder(spark, f"{root}/claims")
        stored = [] if claims.exists(folder) else _stored_versions(spark, root)
        if not stored:
            raise FileNotFoundError(f"no model below {root}")
        version = max(stored, key=lambda s: (s[1], s[0]))[0]
    return version, PipelineModel.load(f"{root}/v={version:04d}")


def compare_models(predictions: Sequence[DataFrame], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Metrics per model and set of several prediction tables (columns model,
    Set, truth, prediction)."""
    rows = predictions[0]
    for more in predictions[1:]:
        rows = rows.unionByName(more)
    return regression_metrics(rows, truth, predicted, by=["model", "Set"])
