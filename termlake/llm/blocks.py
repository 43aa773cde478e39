"""Texts as blocks of codes, and counts or values for each distinct unit of a block.

A block holds some documents of one task: for each document the codes of its units in their order, and the block's
distinct units by code. Only those go through a shuffle, packed by hash partition; what comes back for them is
aligned with what was sent. So each distinct unit of a block travels once, however often it occurs, and no
row holds more than a block or a part of one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from termlake.llm.common import ship

ship(__name__)

#: A block ends with the document that brings it to so many units.
UNITS = 1_200_000


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**32 by byte planes, which compress well apart; planes of zeros are left out."""
    values = np.ascontiguousarray(values, dtype="<u4")
    most = int(values.max(initial=0))
    planes = max(1, (most.bit_length() + 7) // 8)
    table = values.view(np.uint8).reshape(-1, 4)
    return struct.pack("<BQ", planes, len(values)) + squeeze(b"".join(np.ascontiguousarray(table[:, i]).tobytes() for i in range(planes)))


def unpack_ints(data: bytes) -> np.ndarray:
    planes, n = struct.unpack_from("<BQ", data)
    raw = np.frombuffer(expand(data[9:]), dtype=np.uint8).reshape(planes, n)
    out = np.zeros((n, 4), dtype=np.uint8)
    for i in range(planes):
        out[:, i] = raw[i]
    return out.view("<u4").reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as differences, by byte planes."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    table = gaps.view(np.uint8).reshape(-1, 8)
    return struct.pack("<BQ", planes, len(keys)) + squeeze(b"".join(np.ascontiguousarray(table[:, i]).tobytes() for i in range(planes)))


def unpack_sorted(data: bytes) -> np.ndarray:
    planes, n = struct.unpack_from("<BQ", data)
    raw = np.frombuffer(expand(data[9:]), dtype=np.uint8).reshape(planes, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    for i in range(planes):
        out[:, i] = raw[i]
    return np.cumsum(out.view("<u8").reshape(n), dtype=np.uint64)


def pack_units(units: list[bytes]) -> bytes:
    """Byte strings with a uint32 length each."""
    return struct.pack("<Q", len(units)) + squeeze(np.fromiter(map(len, units), dtype="<u4", count=len(units)).tobytes() + b"".join(units))


def unpack_units(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", data)
    raw = expand(data[8:])
    ends = 4 * n + np.cumsum(np.frombuffer(raw, dtype="<u4", count=n), dtype=np.int64)
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)] if n else []


class _Codes(dict):
    """Codes in the order of first use."""

    def __missing__(self, unit: bytes) -> int:
        self[unit] = code = len(self)
        return code


def build(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[bytes]], most: int = UNITS) -> Iterator[dict]:
    """Blocks {ids, flags, lengths, codes, units} of batches (doc_id, text) or (doc_id, text, flag); a null text counts as empty.

    A document longer than a block is a block of its own.
    """
    codes, ids, flags, parts = _Codes(), [], [], []
    n = 0

    def flush() -> dict:
        return {"ids": ids, "flags": flags, "lengths": np.fromiter(map(len, parts), dtype=np.uint32, count=len(parts)), "codes": np.concatenate(parts) if parts else np.zeros(0, np.uint32), "units": list(codes)}

    for batch in batches:
        marks = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for doc_id, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), marks, strict=True):
            found = split(text.as_py() or "")
            parts.append(np.fromiter(map(codes.__getitem__, found), dtype=np.uint32, count=len(found)))
            ids.append(doc_id)
            flags.append(flag)
            n += len(found)
            if n >= most:
                yield flush()
                pa.default_memory_pool().release_unused()
                codes, ids, flags, parts, n = _Codes(), [], [], [], 0
    if ids:
        yield flush()
