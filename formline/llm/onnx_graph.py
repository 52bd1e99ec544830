"""Small ONNX graphs by hand: the protobuf messages that onnxruntime reads, field by field (the package onnx is not needed)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FLOAT, INT32, INT64 = 1, 6, 7
OPSET, IR = 14, 8


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*fields: tuple[int, int | str | bytes]) -> bytes:
    """(number, value) in order; whole numbers as varints, all else with its length."""
    out = bytearray()
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return bytes(out)


def tensor(name: str, a: np.ndarray) -> bytes:
    kind = {"float32": FLOAT, "int64": INT64}[a.dtype.name]
    return message(*[(1, d) for d in a.shape], (2, kind), (8, name), (9, np.ascontiguousarray(a).tobytes()))


def value(name: str, kind: int, *dims: int | str) -> bytes:
    shape = message(*[(1, message((1 if isinstance(d, int) else 2, d))) for d in dims])
    return message((1, name), (2, message((1, message((1, kind), (2, shape))))))


def node(op: str, inputs: str, outputs: str, **attributes: int | list[int] | bytes) -> bytes:
    """Names are parted by spaces; an attribute is a whole number, a list of them or a graph."""
    def attribute(name: str, v: int | list[int] | bytes) -> bytes:
        if isinstance(v, bytes):
            return message((1, name), (6, v), (20, 5))
        return message((1, name), (3, v), (20, 2)) if isinstance(v, int) else message((1, name), *[(8, i) for i in v], (20, 7))

    return message(*[(1, x) for x in inputs.split()], *[(2, x) for x in outputs.split()], (4, op), *[(5, attribute(k, v)) for k, v in attributes.items()])


def graph(name: str, nodes: list[bytes], inputs: list[bytes], outputs: list[bytes], constants: list[bytes] = ()) -> bytes:
    return message(*[(1, n) for n in nodes], (2, name), *[(5, c) for c in constants], *[(11, v) for v in inputs], *[(12, v) for v in outputs])


def runner(of: bytes) -> Callable[[dict[str, np.ndarray]], list[np.ndarray]]:
    """Evaluates a graph on one thread."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    model = message((1, IR), (8, message((1, ""), (2, OPSET))), (7, of))
    session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    return lambda inputs: session.run(None, inputs)
