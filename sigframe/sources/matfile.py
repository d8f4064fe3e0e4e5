"""MAT files of level 5: a parser in NumPy and the search for a recording in their variables.

Numeric, logical, char, cell and struct arrays are read, compressed or not; objects, functions and sparse
matrices are skipped. Files of version 7.3 are HDF5, for which there is no library here: they raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _CHAR = 1, 2, 4


def _element(buf: memoryview, at: int, order: str) -> tuple[int, memoryview, int]:
    """(type, payload, place of the next element)."""
    word = struct.unpack_from(order + "I", buf, at)[0]
    if word >> 16:  # up to four bytes stand in the tag itself
        n = word >> 16
        return word & 0xFFFF, buf[at + 4 : at + 4 + n], at + 8
    n = struct.unpack_from(order + "I", buf, at + 4)[0]
    end = at + 8 + n
    return word, buf[at + 8 : end], end if word == _COMPRESSED else end + (-n % 8)


def _matrix(buf: memoryview, order: str) -> tuple[str, Any]:
    at = 0
    parts = []
    for _ in range(3):
        if at >= len(buf):
            return "", None
        kind, data, at = _element(buf, at, order)
        parts.append((kind, data))
    cls = struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF
    dims = np.frombuffer(parts[1][1], order + "i4")
    name = bytes(parts[2][1]).decode("latin-1")
    n = int(np.prod(dims))
    if cls == _CELL:
        cells = []
        for _ in range(n):
            _, data, at = _element(buf, at, order)
            cells.append(_matrix(data, order)[1])
        return name, cells
    if cls == _STRUCT:
        _, width, at = _element(buf, at, order)
        _, labels, at = _element(buf, at, order)
        w = struct.unpack_from(order + "i", width)[0]
        fields = [bytes(labels[i : i + w]).split(b"\0")[0].decode("latin-1") for i in range(0, len(labels), w)]
        rows = []
        for _ in range(n):
            row = {}
            for f in fields:
                _, data, at = _element(buf, at, order)
                row[f] = _matrix(data, order)[1]
            rows.append(row)
        return name, rows[0] if n == 1 else rows
    if cls == _CHAR:
        kind, data, _ = _element(buf, at, order)
        codes = np.frombuffer(data, order + {16: "u1", 17: "u2", 18: "u4"}.get(kind, _NUMBERS.get(kind, "u2")))
        chars = codes[:n].reshape(tuple(dims), order="F")
        rows = ["".join(map(chr, r)).rstrip() for r in np.atleast_2d(chars)]
        return name, rows[0] if len(rows) == 1 else rows
    if 6 <= cls <= 15:
        kind, data, _ = _element(buf, at, order)
        if kind not in _NUMBERS:
            return name, None
        return name, np.frombuffer(data, order + _NUMBERS[kind])[:n].reshape(tuple(dims), order="F")
    return name, None


def load_mat(data: bytes) -> dict[str, Any]:
    """Variables of a MAT file by name."""
    if data[:4] == b"MATL" and b"7.3" in data[:64] or data[512:516] == b"\x89HDF":
        raise ValueError("MAT files of version 7.3 are not read")
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    buf, at, out = memoryview(data), 128, {}
    while at + 8 <= len(buf):
        kind, payload, at = _element(buf, at, order)
        if kind == _COMPRESSED:
            inner = memoryview(zlib.decompress(payload))
            kind, payload, _ = _element(inner, 0, order)
        if kind == _MATRIX:
            name, value = _matrix(payload, order)
            if name:
                out[name] = value
    return out


def variables(tree: Any, path: str = "", depth: int | None = 10, width: int | None = 50) -> list[tuple[str, Any]]:
    """(path, value) of all leaves, down to ``depth`` levels and the first ``width`` items of a list; None for all of them."""
    if depth is not None and depth < 0:
        return []
    if isinstance(tree, dict):
        items = [(f"{path}.{k}" if path else k, v) for k, v in tree.items()]
    elif isinstance(tree, list) and not all(isinstance(x, str) for x in tree):
        items = [(f"{path}[{i}]", v) for i, v in enumerate(tree[:width])]
    else:
        return [(path, tree)]
    return [leaf for p, v in items for leaf in variables(v, p, None if depth is None else depth - 1, width)]


def find_recording(data: bytes, least_bytes: int = 5 * 1024 * 1024, depth: int | None = 10, width: int | None = 50) -> dict:
    """The signal of a MAT file: the first matrix of more than ``least_bytes``, else the first three-dimensional array.

    The rate is the first single number under a name with fs, fre or rate, the channel names the first list of more than two
    texts under one with chan, chname or clab. A matrix with more rows than columns is turned. ValueError without a signal.
    Variables are searched down to ``depth`` levels and the first ``width`` items of a list, with None wholly.
    """
    found = variables(load_mat(data), depth=depth, width=width)
    # fixed values: words in the names of variables that hold rates and channel names
    arrays = [(p, v) for p, v in found if isinstance(v, np.ndarray)]
    raw = next(((p, v) for p, v in arrays if v.ndim == 2 and v.nbytes > least_bytes), None)
    epochs = next(((p, v) for p, v in arrays if v.ndim == 3), None)
    chosen, kind = (raw, "matRawData") if raw else (epochs, "matEpochData")
    if chosen is None:
        raise ValueError("no variable looks like a signal")
    named = lambda words: ((p, v) for p, v in found if any(w in p.lower() for w in words))
    rate = next((float(v.ravel()[0]) for _, v in named(("fs", "fre", "rate")) if isinstance(v, np.ndarray) and v.size == 1), None)
    names = next((v for _, v in named(("chan", "chname", "clab")) if isinstance(v, list) and len(v) > 2 and all(isinstance(x, str) for x in v)), None)
    x = np.asarray(chosen[1], float)
    if x.ndim == 2 and x.shape[0] > x.shape[1]:
        x = x.T
    n_channels = x.shape[0] if x.ndim == 2 else x.shape[1]
    channels = names if names and len(names) == n_channels else [f"Ch{i + 1}" for i in range(n_channels)]
    out = {"file_type": f"{kind}:{chosen[0]}", "channels": channels, "sfreq": rate, "n_samples": x.shape[-1]}
    return out | ({"signals": list(x)} if x.ndim == 2 else {"epochs": x})
