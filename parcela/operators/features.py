"""Feature preparation as Spark ML estimators whose state fits in Params."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import with_normal_cdf, with_normal_ppf
from ..schema import FeatureSpec
from ..session import materialize
from .quantiles import one_row_quantiles, quantiles


class _Stored(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that can be saved with a PipelineModel."""

    @classmethod
    def _names(cls, text: str) -> Param:
        return Param(Params._dummy(), text, text, TypeConverters.toListString)

    @classmethod
    def _numbers(cls, text: str) -> Param:
        return Param(Params._dummy(), text, text, TypeConverters.toListFloat)

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class DropNullColumns(Estimator, _Stored):
    """Drop the columns whose share of nulls exceeds ``threshold``."""

    threshold = Param(Params._dummy(), "threshold", "largest share kept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, threshold: float = 0.5):
        super().__init__()
        self._setDefault(threshold=0.5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "DropNullColumnsModel":
        kinds = dict(dataset.dtypes)
        gap = lambda c: (F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNull()
        shares = dataset.agg(*[F.avg(gap(c).cast("int")).alias(c) for c in dataset.columns]).first()
        limit = self.get("threshold")
        dropped = [c for c in dataset.columns if shares[c] is not None and shares[c] > limit]
        return DropNullColumnsModel(dropped=dropped)


class DropNullColumnsModel(Model, _Stored):
    dropped = _Stored._names("dropped")

    @keyword_only
    def __init__(self, dropped: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.get("dropped"))


def _per_column(value, n: int) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value] * n


class TrimColumns(Estimator, _Stored):
    """Keep rows inside the quantile limits learnt at fit. ``quantile`` and
    ``tail`` ("upper", "lower", "both") are one value or one per column; columns
    the table lacks are skipped."""

    columns = _Stored._names("columns")
    quantile = _Stored._numbers("quantile")
    tail = _Stored._names("tail")

    @keyword_only
    def __init__(self, columns: Sequence[str] = (), quantile: float | Sequence[float] = 0.5,
                 tail: str | Sequence[str] = "both"):
        super().__init__()
        n = len(columns)
        tails = _per_column(tail, n)
        if unknown := set(tails) - {"upper", "lower", "both"}:
            raise ValueError(f"unknown tail {sorted(unknown)}")
        self._set(columns=list(columns), quantile=[float(q) for q in _per_column(quantile, n)], tail=tails)

    def _fit(self, dataset: DataFrame) -> "TrimColumnsModel":
        wanted = [
            (c, q, t) for c, q, t in zip(self.get("columns"), self.get("quantile"), self.get("tail"))
            if c in dataset.columns
        ]
        names = [c for c, _, _ in wanted]
        points = sorted({p for _, q, _ in wanted for p in (q, 1 - q)})
        found = one_row_quantiles(dataset, names, points) if names else {}
        infinity = float("inf")
        at = lambda c, p: found[c][points.index(p)]
        return TrimColumnsModel(
            columns=names,
            lower=[at(c, q) if t != "upper" else -infinity for c, q, t in wanted],
            upper=[at(c, 1 - q) if t != "lower" else infinity for c, q, t in wanted],
        )


class TrimColumnsModel(Model, _Stored):
    columns = _Stored._names("columns")
    lower = _Stored._numbers("lower")
    upper = _Stored._numbers("upper")

    @keyword_only
    def __init__(self, columns: list[str] | None = None, lower: list[float] | None = None,
                 upper: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds = zip(self.get("columns"), self.get("lower"), self.get("upper"))
        inside = [F.col(c).between(lo, hi) for c, lo, hi in bounds if c in dataset.columns]
        return dataset.filter(reduce(lambda a, b: a & b, inside)) if inside else dataset


def clip_above(df: DataFrame, column: str, percentile: float = 95) -> DataFrame:
    """Values above the column's percentile become the percentile."""
    found = one_row_quantiles(df, [column], [percentile / 100.0])
    if column not in found:
        return df
    limit = F.lit(found[column][0])
    return df.withColumn(column, F.when((F.col(column) > limit) & ~F.isnan(column), limit).otherwise(F.col(column).cast("double")))


class NumericScaler(Estimator, _Stored):
    """Fill gaps with the exact median, then subtract the mean and divide by the
    population deviation. Adds one column per input, suffixed ``_scaled``."""

    columns = _Stored._names("columns")

    @keyword_only
    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _fit(self, dataset: DataFrame) -> "NumericScalerModel":
        names = self.get("columns")
        found = one_row_quantiles(dataset, names, [0.5])
        medians = [found.get(c, [0.0])[0] for c in names]
        filled = [_filled(c, m) for c, m in zip(names, medians)]
        row = dataset.agg(
            *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(filled)],
            *[F.stddev_pop(v).alias(f"s_{i}") for i, v in enumerate(filled)],
        ).first()
        return NumericScalerModel(
            columns=names, medians=medians,
            means=[row[f"m_{i}"] or 0.0 for i in range(len(names))],
            deviations=[row[f"s_{i}"] or 1.0 for i in range(len(names))],
        )


def _filled(c: str, value: float) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(float(value))).otherwise(v)


class NumericScalerModel(Model, _Stored):
    columns = _Stored._names("columns")
    medians = _Stored._numbers("medians")
    means = _Stored._numbers("means")
    deviations = _Stored._numbers("deviations")

    @keyword_only
    def __init__(self, columns: list[str] | None = None, medians: list[float] | None = None,
                 means: list[float] | None = None, deviations: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learnt = zip(self.get("columns"), self.get("medians"), self.get("means"), self.get("deviations"))
        return dataset.withColumns({
            f"{c}_scaled": (_filled(c, median) - F.lit(mean)) / F.lit(deviation)
            for c, median, mean, deviation in learnt
        })


def feature_stages(spec: FeatureSpec = FeatureSpec(), output: str = "features") -> list:
    """Stages from raw columns to one feature vector. Categories not seen at fit
    (and nulls) become all zeros: they share the last index, which is dropped."""
    indexed = [f"{c}_index" for c in spec.categorical]
    encoded = [f"{c}_onehot" for c in spec.categorical]
    scaler = [NumericScaler(columns=spec.numeric)] if spec.numeric else []
    return scaler + [
        StringIndexer(inputCols=list(spec.categorical), outputCols=indexed,
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=[f"{c}_scaled" for c in spec.numeric] + encoded, outputCol=output),
    ]


def feature_pipeline(spec: FeatureSpec = FeatureSpec()) -> Pipeline:
    return Pipeline(stages=feature_stages(spec))


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by an MD5 of seed and key: the same rows on every
    run, for every partitioning and in any engine. A null key counts as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    cut = round(test_share * 10_000)
    return df.filter(slot >= cut), df.filter(slot < cut)


# Fixed value: this close to an end counts as the end. Normal scores are clipped
# at the score of (almost) the same distance.
_END = 1e-7
_LOWEST = NormalDist().inv_cdf(_END - 2.220446049250313e-16)
_HIGHEST = NormalDist().inv_cdf(1.0 - (_END - 2.220446049250313e-16))


def _table(values: Sequence[float]) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


class TargetTransform(Estimator, _Stored):
    """Learn the target's way to a normal scale: cap at a percentile, log1p,
    then the normal score of the value's quantile."""

    inputCol = Param(Params._dummy(), "inputCol", "target", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "transformed target", TypeConverters.toString)
    percentile = Param(Params._dummy(), "percentile", "cap", TypeConverters.toFloat)
    knots = Param(Params._dummy(), "knots", "number of quantiles", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "how quantiles are found", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol: str = "PRICE", outputCol: str = "label", percentile: float = 95.0, knots: int = 1000,
                 method: str = "cells"):
        super().__init__()
        self._setDefault(inputCol="PRICE", outputCol="label", percentile=95.0, knots=1000, method="cells")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TargetTransformModel":
        c = self.get("inputCol")
        rows = dataset.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
        # Read by every counting pass of both searches.
        rows = materialize(rows, "target")
        top = quantiles(rows, ["v"], [self.get("percentile") / 100.0]).first()
        if top is None:
            raise ValueError(f"no row has a value in {c}")
        cap, count = top["quantiles"][0], top["n"]
        logs = rows.select(F.log1p(F.least("v", F.lit(cap))).alias("v"))
        knots = max(2, min(self.get("knots"), count))
        points = [i / (knots - 1) for i in range(knots)]
        # Exact at every size; "approx" is a sketch right to one rank in ten thousand.
        levels = one_row_quantiles(logs, ["v"], points, self.get("method"))["v"]
        for i in range(1, knots):
            levels[i] = max(levels[i], levels[i - 1])
        return TargetTransformModel(inputCol=c, outputCol=self.get("outputCol"), cap=[cap], levels=levels)


class TargetTransformModel(Model, _Stored):
    inputCol = TargetTransform.inputCol
    outputCol = TargetTransform.outputCol
    cap = _Stored._numbers("cap")
    levels = _Stored._numbers("levels")

    @keyword_only
    def __init__(self, inputCol: str = "PRICE", outputCol: str = "label", cap: list[float] | None = None,
                 levels: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        levels, last = self.get("levels"), len(self.get("levels")) - 1
        raw, cap = F.col(self.get("inputCol")).cast("double"), F.lit(self.get("cap")[0])
        # Not least(): that would turn a missing target into the cap.
        v = F.log1p(F.when(raw > cap, cap).otherwise(raw))
        # Repeated quantiles become one knot that spans several probabilities.
        knots = sorted(set(levels))
        first = {x: levels.index(x) / last for x in knots}
        final = {x: (last - levels[::-1].index(x)) / last for x in knots}
        rows = dataset.withColumn("_v", v)
        if len(knots) == 1:
            share = F.when(F.col("_v") < knots[0] + _END, 0.0).otherwise(1.0)
        else:
            rows = Bucketizer(splits=[float("-inf"), *knots, float("inf")], inputCol="_v",
                              outputCol="_slot", handleInvalid="keep").transform(rows)
            at = lambda values, i: F.element_at(
                _table(values), F.greatest(F.lit(1), F.least(i, F.lit(len(knots)))))
            slot = F.col("_slot").cast("int")
            rows = rows.withColumns({
                "_low": at(knots, slot), "_high": at(knots, slot + 1),
                "_first": at(first.values(), slot), "_final": at(final.values(), slot),
                "_next": at(first.values(), slot + 1),
            })
            low, high, low_first, low_final, high_first = (
                F.col(c) for c in ("_low", "_high", "_first", "_final", "_next"))
            between = (F.col("_v") - low) / F.nullif(high - low, F.lit(0.0))
            share = (
                F.when(F.col("_v") < knots[0] + _END, 0.0)
                .when(F.col("_v") > knots[-1] - _END, 1.0)
                .when(F.col("_v") == low, (low_first + low_final) / 2.0)
                .otherwise(low_final + between * (high_first - low_final))
            )
        rows = rows.withColumn("_p", F.when(F.col("_v").isNotNull(), share))
        rows = with_normal_ppf(rows, "_p", "_z")
        score = (
            F.when(F.col("_p") <= 0.0, _LOWEST).when(F.col("_p") >= 1.0, _HIGHEST)
            .otherwise(F.greatest(F.lit(_LOWEST), F.least("_z", F.lit(_HIGHEST))))
        )
        score = F.when(F.col("_p").isNotNull(), score)
        return rows.withColumn(self.get("outputCol"), score).drop("_v", "_p", "_z", "_slot", "_low", "_high", "_first", "_final", "_next")

    def inverse(self, dataset: DataFrame, column: str, output: str) -> DataFrame:
        """Back from normal scores to the target's unit (the cap stays)."""
        levels, last = self.get("levels"), len(self.get("levels")) - 1
        table = _table(levels)
        rows = with_normal_cdf(dataset, column, "_p")
        position = F.col("_p") * last
        slot = F.greatest(F.lit(0), F.least(F.floor(position).cast("int"), F.lit(last - 1)))
        low, high = F.element_at(table, slot + 1), F.element_at(table, slot + 2)
        value = (
            F.when(F.col("_p") < _END, levels[0]).when(F.col("_p") > 1.0 - _END, levels[-1])
            .otherwise(low + (position - slot) * (high - low))
        )
        return rows.withColumn(output, F.when(F.col("_p").isNotNull(), F.expm1(value))).drop("_p")


class TargetInverse(Transformer, _Stored):
    """Last stage of a price model: predictions back in the target's unit."""

    inputCol = TargetTransform.inputCol
    outputCol = TargetTransform.outputCol
    levels = _Stored._numbers("levels")

    @keyword_only
    def __init__(self, inputCol: str = "prediction", outputCol: str = "predicted_price",
                 levels: list[float] | None = None):
        super().__init__()
        self._setDefault(inputCol="prediction", outputCol="predicted_price")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = TargetTransformModel(cap=[float("inf")], levels=self.get("levels"))
        return model.inverse(dataset, self.get("inputCol"), self.get("outputCol"))
