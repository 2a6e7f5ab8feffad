"""Models as bytes, and the sessions that run them.

The driver reads a model once and broadcasts its bytes; a worker process makes a
session when it first sees them and keeps it for all later tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any, Protocol

import numpy as np

_SESSIONS: dict[str, Any] = {}
_TYPES = {"tensor(float)": np.float32, "tensor(int64)": np.int64, "tensor(int32)": np.int32, "tensor(bool)": np.bool_, "tensor(double)": np.float64}


class Session(Protocol):
    """What scoring needs of a session; tests and other runtimes bring their own."""

    def get_inputs(self) -> Sequence[Any]: ...
    def get_outputs(self) -> Sequence[Any]: ...
    def run(self, names: Sequence[str] | None, feeds: dict[str, np.ndarray]) -> list[np.ndarray]: ...


@dataclass(frozen=True)
class Model:
    """An ONNX model.  ``providers``: in the order of preference; those that aren't there are passed over."""

    data: bytes = field(repr=False)
    providers: tuple[str, ...] = ("CPUExecutionProvider",)

    @classmethod
    def read(cls, path: str, **options) -> Model:
        if not Path(path).is_file():
            raise FileNotFoundError(f"no model at {path}")
        return cls(Path(path).read_bytes(), **options)

    @cached_property
    def key(self) -> str:
        return hashlib.sha256(self.data + repr(self.providers).encode()).hexdigest()

    def session(self) -> Session:
        if self.key not in _SESSIONS:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
            options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark's tasks are the threads
            there = ort.get_available_providers()
            use = [p for p in self.providers if p in there] or ["CPUExecutionProvider"]
            _SESSIONS[self.key] = ort.InferenceSession(self.data, options, providers=use)
        return _SESSIONS[self.key]

    def __getstate__(self):
        return {"data": self.data, "providers": self.providers}

    def __setstate__(self, state):
        self.__dict__.update(state)


@dataclass(frozen=True)
class Described:
    """A model's first input and output, or those named, as its planner sees them."""

    input: str
    output: str
    input_dims: tuple[int, ...]
    output_dims: tuple[int, ...]
    inputs: tuple[str, ...]

    @property
    def hidden_dim(self) -> int:
        return self.output_dims[-1] if self.output_dims else 0

    @property
    def pooled(self) -> bool:
        return len(self.output_dims) == 2


def _dims(shape) -> tuple[int, ...]:
    return tuple(d if isinstance(d, int) and d > 0 else -1 for d in shape)


def describe(session: Session, input: str | None = None, output: str | None = None) -> Described:
    ins, outs = {x.name: x for x in session.get_inputs()}, {x.name: x for x in session.get_outputs()}
    input, output = input or next(iter(ins)), output or next(iter(outs))
    if input not in ins or output not in outs:
        raise ValueError(f"the model has inputs {list(ins)} and outputs {list(outs)}")
    return Described(input, output, _dims(ins[input].shape), _dims(outs[output].shape), tuple(ins))


def input_type(session: Session, name: str):
    return next((_TYPES.get(x.type, np.float32) for x in session.get_inputs() if x.name == name), np.float32)


class Shared:
    """Any object for the executors: pickled with its functions, broadcast once, and opened once a task."""

    def __init__(self, spark, value):
        from pyspark import cloudpickle

        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self):
        if self._value is None:
            from pyspark import cloudpickle

            self._value = cloudpickle.loads(self._sent.value)
        return self._value

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}
