"""Transforms and estimators by name, as stages of pyspark.ml pipelines: from the bytes of audio files to a fitted and saved model.

A transform is a column expression with options; TRANSFORMS names them. A feature set names the options of the extractor
that makes it. ESTIMATORS names the linear regressors and classifiers. All stages are saved and loaded with their pipeline.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions import arrays as A
from uttera.operators import audio, dsp, linear

#: Feature sets of acoustic functionals, by the descriptors that they hold.
FEATURE_SETS = {"prosody": ("pitch", "voicing", "energy_db"), "spectral": ("zero_crossings", "centroid", "rolloff", "flux"), "all": audio.DESCRIPTORS}


def _functionals(x: Column, feature_set: str = "all", rate: int = 16_000) -> Column:
    names = FEATURE_SETS[feature_set]
    at = [i for i, f in enumerate(audio.FEATURES) if f.startswith(tuple(f"{n}_" for n in names)) or f in ("voiced_share", "jitter") and "pitch" in names]
    return A.let(audio.functionals_column(x, rate), lambda v: F.array(*[F.get(v, F.lit(i)) for i in at]))


def _chunked(x: Column, size: int, hop: int, transform: str = "none", options: dict | None = None, pad: bool = False) -> Column:
    """Chunks of a sequence, each through a chunk transform, put together again: the sequence of the chunks' results."""
    n = F.size(x)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / hop) * hop if pad else F.floor(F.greatest(n - size, F.lit(0)) / hop) * hop
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), last, F.lit(hop).cast("long")), lambda s: F.slice(x, (s + 1).cast("int"), size))
    if pad:
        chunks = F.transform(chunks, lambda c: F.concat(c, F.array_repeat(F.lit(0.0), size - F.size(c))))
    kept = F.filter(chunks, lambda c: F.size(c) > 0)
    return F.flatten(F.transform(kept, lambda c: CHUNK_TRANSFORMS[transform](c, **(options or {}))))


#: Transforms of a chunk: from an array to an array, expressions only.
CHUNK_TRANSFORMS: dict[str, Callable[..., Column]] = {
    "none": lambda c: c,
    "mean": lambda c: F.array(A.mean(c)),
    "moments": lambda c: F.array(A.mean(c), A.std(c)),
    "cmvn": lambda c: A.let(A.mean(c), lambda m: A.let(A.std(c), lambda s: A.cmvn(c, m, s))),
    "rms": lambda c, target=0.1: A.rms_normalised(c, target),
}

#: Transforms of a column, with their options.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "decode": lambda x, rate=16_000, duration=None: audio.decoded_column(x, rate, duration),
    "rms": lambda x, target=0.1: A.rms_normalised(x, target),
    "trim": lambda x, top_db=30.0, frame=2048, hop=512: A.trimmed(x, top_db, frame, hop),
    "mfcc": lambda x, **options: dsp.mfcc_column(x, **options),
    "mean_frames": lambda x: A.masked_mean(x, F.transform(x, lambda v: F.lit(1))),
    "functionals": _functionals,
    "chunks": _chunked,
}


class ColumnTransform(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One of TRANSFORMS over a column."""

    name = Param(Params._dummy(), "name", "which of TRANSFORMS", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "its options as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, name=None, options="{}"):  # noqa: N803  names as in pyspark.ml
        super().__init__()
        self._setDefault(options="{}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = TRANSFORMS[self.getOrDefault("name")]
        return dataset.withColumn(self.getOutputCol(), made(F.col(self.getInputCol()), **json.loads(self.getOrDefault("options"))))


class _Predicts(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class LinearEstimator(Estimator, _Predicts, DefaultParamsReadable, DefaultParamsWritable):
    """One of ESTIMATORS on an array column: kind svr, svc (label 1 or -1) or ridge, with its penalty, on scaled dimensions or as they are."""

    kind = Param(Params._dummy(), "kind", "svr, svc or ridge", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "c of svr and svc, alpha of ridge", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "width of svr's tube", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "whether dimensions are scaled", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", kind="ridge", penalty=1.0, epsilon=0.1, scale=True):  # noqa: N803
        super().__init__()
        self._setDefault(kind="ridge", penalty=1.0, epsilon=0.1, scale=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearFitted:
        kind, penalty, scale = (self.getOrDefault(p) for p in ("kind", "penalty", "scale"))
        x, y = self.getFeaturesCol(), self.getLabelCol()
        if kind == "ridge":
            found = linear.ridge_from(linear.grams(dataset.withColumn("_fold", F.lit(0)), x, y, "_fold", 1).without(None), penalty, scale)
        else:
            found = linear.svm(dataset, x, F.col(y), kind, c=penalty, epsilon=self.getOrDefault("epsilon"), scale=scale).model
        out = LinearFitted(featuresCol=x, predictionCol=self.getPredictionCol(), weights=[float(w) for w in found.weights], intercept=found.intercept, sign=kind == "svc")
        return out


class LinearFitted(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weights and intercept; with sign, predictions are 1 or -1."""

    weights = Param(Params._dummy(), "weights", "one a dimension", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "", TypeConverters.toFloat)
    sign = Param(Params._dummy(), "sign", "whether predictions are classes", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", weights=None, intercept=0.0, sign=False):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = linear.Linear(np.array(self.getOrDefault("weights")), self.getOrDefault("intercept"))
        score = model.column(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), F.when(score > 0, 1.0).otherwise(-1.0) if self.getOrDefault("sign") else score)


#: Estimators, by the names under which results list them.
ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "ridge": lambda **options: LinearEstimator(kind="ridge", **options),
    "svr_linear": lambda **options: LinearEstimator(kind="svr", scale=False, **options),
    "svr_linear_scaled": lambda **options: LinearEstimator(kind="svr", scale=True, **options),
    "svc_linear": lambda **options: LinearEstimator(kind="svc", scale=False, **options),
}


def extractor(feature_set: str, wav: str = "wav", out: str = "features", rate: int = 16_000) -> list[Transformer]:
    """The stages that make a feature set of audio files."""
    if feature_set not in FEATURE_SETS:
        raise KeyError(f"no feature set {feature_set}; there are {sorted(FEATURE_SETS)}")
    return [ColumnTransform(inputCol=wav, outputCol="_signal", name="decode", options=json.dumps({"rate": rate})), ColumnTransform(inputCol="_signal", outputCol=out, name="functionals", options=json.dumps({"feature_set": feature_set, "rate": rate}))]


def pipeline(feature_set: str, estimator: str, label: str, **options) -> Pipeline:
    """From audio files to predictions, by the names of a feature set and an estimator."""
    return Pipeline(stages=[*extractor(feature_set), ESTIMATORS[estimator](featuresCol="features", labelCol=label, **options)])


def dimension(df: DataFrame, vec: str) -> int:
    """The number of dimensions of a feature column, which must be one; 0 without rows."""
    found = [r[0] for r in df.where(F.col(vec).isNotNull()).select(F.size(vec)).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"{vec} has vectors of more than one length: {sorted(found)}")
    return found[0] if found else 0
