"""Small ONNX models written by hand, for tests and queries where no trained model is at hand."""

from __future__ import annotations

import numpy as np


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | str | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor(name: str, x: np.ndarray) -> bytes:
    kind = {np.dtype(np.float32): 1, np.dtype(np.int64): 7}[x.dtype]
    return b"".join(_field(1, d) for d in x.shape) + _field(2, kind) + _field(8, name) + _field(9, x.tobytes())


def _value(name: str, shape: list[int | str], kind: int = 1) -> bytes:
    dims = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def _node(op: str, inputs: list[str], outputs: list[str], **ints: int) -> bytes:
    attributes = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in ints.items())
    return b"".join(_field(1, i) for i in inputs) + b"".join(_field(2, o) for o in outputs) + _field(4, op) + attributes


def onnx_model(nodes: list[bytes], inputs: list[bytes], outputs: list[bytes], constants: dict[str, np.ndarray]) -> bytes:
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g") + b"".join(_field(5, _tensor(k, v)) for k, v in constants.items())
    graph += b"".join(_field(11, i) for i in inputs) + b"".join(_field(12, o) for o in outputs)
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def matmul(weights: np.ndarray) -> bytes:
    """x [n, d] to x @ weights."""
    w = np.asarray(weights, np.float32)
    return onnx_model([_node("MatMul", ["x", "w"], ["y"])], [_value("x", ["n", w.shape[0]])], [_value("y", ["n", w.shape[1]])], {"w": w})


def frame_matmul(weights: np.ndarray, frames: int | str = "f") -> bytes:
    """x [n, frames, d] to x @ weights: an output of rank 3."""
    w = np.asarray(weights, np.float32)
    return onnx_model([_node("MatMul", ["x", "w"], ["y"])], [_value("x", ["n", frames, w.shape[0]])], [_value("y", ["n", frames, w.shape[1]])], {"w": w})


def recurrent(window: int) -> bytes:
    """input [1, window], sr [1], h and c [1, 1]: c' = c / 2 + mean |input|, probability = c' / (c' + 1), h' = h + 1."""
    nodes = [
        _node("Abs", ["input"], ["a"]), _node("ReduceMean", ["a"], ["m"], keepdims=1), _node("Mul", ["c", "half"], ["d"]), _node("Add", ["d", "m"], ["cn"]),
        _node("Add", ["cn", "one"], ["e"]), _node("Div", ["cn", "e"], ["output"]), _node("Add", ["h", "one"], ["hn"]),
    ]
    ins = [_value("input", [1, window]), _value("sr", [1], 7), _value("h", [1, 1]), _value("c", [1, 1])]
    outs = [_value("output", [1, 1]), _value("hn", [1, 1]), _value("cn", [1, 1])]
    return onnx_model(nodes, ins, outs, {"half": np.array([[0.5]], np.float32), "one": np.array([[1]], np.float32)})
