"""Stages of pipelines: each adds columns and keeps those it finds.

A stage is a ``pyspark.ml.Transformer``, so that stages make up a ``Pipeline``.  It
checks the columns it needs when it is given a DataFrame, not when rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions import arrays as A
from tessitura.functions.mel import Extractor, MelOptions, mel_features
from tessitura.scoring.onnx import onnx_score
from tessitura.scoring.sessions import Model, describe


class MissingColumn(ValueError):
    """A stage was given a DataFrame without a column that it needs."""


class Stage(Transformer):
    """A transformer of DataFrames that needs some columns."""

    needs: tuple[str, ...] = ()

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise MissingColumn(f"{type(self).__name__} needs {missing}; there are {df.columns}")
        return self.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def pipeline(*stages: Transformer) -> PipelineModel:
    """Stages one after the other; nothing is fitted."""
    return PipelineModel(list(stages))


class Apply(Stage):
    """Any function of a DataFrame as a stage: branches, unions, filters."""

    def __init__(self, f: Callable[[DataFrame], DataFrame], *needs: str):
        super().__init__()
        self.f, self.needs = f, needs

    def apply(self, df: DataFrame) -> DataFrame:
        return self.f(df)


class ExtractFeatures(Stage):
    """Samples to Features: struct<data, frames, dim>, the shape with every row.

    The input is an array of samples, with the rate and channels of ``source_rate`` and
    ``channels`` (numbers, or names of columns), or a signal as ``decode_wav`` gives it, which says them
    itself.  It is mixed down and resampled to the rate of the options.  ``extractor`` is
    any function of samples at that rate to rows of features, in place of the mel features.
    """

    def __init__(
        self, options: MelOptions = MelOptions(), input: str = "Audio", output: str = "Features", whisper: bool = False,
        source_rate: int | str | None = None, channels: int | str | None = None, extractor: Extractor | None = None,
    ):
        super().__init__()
        self.options, self.input, self.output, self.whisper, self.extractor = options, input, output, whisper, extractor
        self.source_rate, self.channels = source_rate, channels
        self.needs = (input, *(c for c in (source_rate, channels) if isinstance(c, str)))

    def apply(self, df: DataFrame) -> DataFrame:
        own = lambda v: F.col(v) if isinstance(v, str) else v
        samples, rate, channels = F.col(self.input), own(self.source_rate), own(self.channels)
        if isinstance(df.schema[self.input].dataType, T.StructType):
            samples, rate, channels = samples["samples"], samples["sample_rate"], samples["channels"]
        return df.withColumn(self.output, mel_features(samples, self.options, self.whisper, rate, channels, self.extractor))


class Score(Stage):
    """Features to Scores by a model."""

    def __init__(self, model: Model, input: str = "Features", output: str = "Scores", tensor_in: str | None = None, tensor_out: str | None = None):
        super().__init__()
        self.model, self.input, self.output, self.tensors, self.needs = model, input, output, (tensor_in, tensor_out), (input,)

    def apply(self, df: DataFrame) -> DataFrame:
        return onnx_score(df, self.model, self.input, self.output, *self.tensors)


class SoftmaxLabel(Stage):
    """Scores to PredictedLabel, Score and Probabilities."""

    def __init__(self, labels: Sequence[str], input: str = "Scores", label: str = "PredictedLabel", score: str = "Score", probabilities: str = "Probabilities"):
        super().__init__()
        if not labels:
            raise ValueError("classification needs labels")
        self.labels, self.input, self.out, self.needs = list(labels), input, (label, score, probabilities), (input,)

    def apply(self, df: DataFrame) -> DataFrame:
        label, score, probabilities = self.out
        best = A.argmax(F.col(self.input))
        out = df.withColumn(probabilities, A.softmax(self.input).cast("array<float>"))
        return out.withColumn(label, A.label_lookup(self.labels, best)).withColumn(score, F.get(probabilities, best))


class Pool(Stage):
    """Scores to an embedding; the dimension comes with the column unless it is given."""

    def __init__(self, strategy: str = "mean", normalize: bool = True, input: str = "Scores", output: str = "Embedding", hidden: int | None = None):
        super().__init__()
        self.strategy, self.normalize, self.input, self.output, self.hidden, self.needs = strategy, normalize, input, output, hidden, (input,)

    def apply(self, df: DataFrame) -> DataFrame:
        said = df.schema[self.input].metadata
        hidden, pooled = (self.hidden, False) if self.hidden is not None else (said.get("hidden_dim", 0), said.get("has_pooled_output", False))
        x = A.pool(self.input, hidden, self.strategy, pooled)
        return df.withColumn(self.output, (A.l2_normalize(x) if self.normalize else x).cast("array<float>"))


def classification(model: Model, labels: Sequence[str], options: MelOptions = MelOptions(), input: str = "Audio", **source) -> PipelineModel:
    """Samples to PredictedLabel, Score and Probabilities; source: the rate and channels of the samples, as ExtractFeatures takes them."""
    return pipeline(ExtractFeatures(options, input, **source), Score(model), SoftmaxLabel(labels))


def embedding(model: Model, strategy: str = "mean", normalize: bool = True, options: MelOptions = MelOptions(), input: str = "Audio", output: str = "Embedding", **source) -> PipelineModel:
    """Samples to an embedding."""
    return pipeline(ExtractFeatures(options, input, **source), Score(model), Pool(strategy, normalize, output=output))


def embedding_dimension(model: Model) -> int:
    return describe(model.session()).hidden_dim


@dataclass(frozen=True)
class EmbeddingGenerator:
    """Embeddings of signals for callers that know a generator and not the stages: what it is, and generate()."""

    model: Model
    model_id: str | None = None
    strategy: str = "mean"
    normalize: bool = True
    options: MelOptions = MelOptions()

    @property
    def metadata(self) -> dict[str, str | int | None]:
        return {"provider": "tessitura", "model_id": self.model_id, "dimensions": embedding_dimension(self.model)}

    def generate(self, df: DataFrame, input: str = "Audio", output: str = "Embedding", **source) -> DataFrame:
        """df with an embedding of each signal; its own columns are kept and no others added."""
        made = embedding(self.model, self.strategy, self.normalize, self.options, input, output, **source).transform(df)
        return made.select(*(F.col(f"`{c}`") for c in df.columns if c != output), output)


__all__ = ["Apply", "EmbeddingGenerator", "ExtractFeatures", "MissingColumn", "Pipeline", "Pool", "Score", "SoftmaxLabel", "Stage", "classification", "embedding", "embedding_dimension", "pipeline"]
