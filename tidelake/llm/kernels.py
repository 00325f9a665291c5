"""Numpy helpers over the bytes of many texts at once; they run inside Spark tasks.

Texts of one Arrow column are looked at as one byte array with offsets, so that
splitting, hashing and window hashing are whole-array operations. Pickled by value:
workers need no copy of this package.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D


def byte_table(*spans):
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


# word bytes: everything but blanks; letters, digits and all bytes beyond ASCII
WORD = ~byte_table((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """Scramble 64-bit values so that every bit depends on all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column, lower=False):
    """(bytes, offsets) of an Arrow text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.empty(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    data = data[offsets[0]:offsets[-1]]
    return (LOWER[data] if lower else data), offsets - offsets[0]


def words(data, offsets, table=WORD):
    """(starts, ends, first word of each text and the total) of the runs of word bytes."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = table[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads + 1]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails + 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data, starts, ends):
    """A 64-bit hash of each byte span: sums of byte codes times powers, shifted to the span's start."""
    n = len(data)
    power = np.full(n + 1, U(BASE), dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n + 1, U(pow(BASE, -1, 1 << 64)), dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    codes = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes[data] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h, size):
    """Hash of every run of ``size`` neighbours, by doubling; n - size + 1 values."""
    if len(h) < size:
        return np.empty(0, dtype=np.uint64)
    out, done, level, step = None, 0, h, 1
    while True:
        factor, other = U(pow(BASE, 2 * step + 1, 1 << 64)), U(pow(BASE, 2 * step + 7, 1 << 64))
        if size & step:
            part = level[done:]
            out = part if out is None else out[:len(part)] * other + part
            done += step
        if 2 * step > size:
            return mix(out[:len(h) - size + 1])
        level = level[:-step] * factor + level[step:]
        step *= 2


def sliding(op, a, size):
    """op (np.minimum or np.maximum) over every run of ``size`` neighbours."""
    if len(a) < size:
        return a[:0]
    out, step = a, 1
    while 2 * step <= size:
        out = op(out[:-step], out[step:])
        step *= 2
    return op(out[:len(a) - size + 1], out[size - step:size - step + len(a) - size + 1]) if step < size else out


def owners(offsets):
    """Number of the text that holds each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(starts, ends, n):
    """Mask of the items inside any span [start, end)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask, breaks=None):
    """(starts, ends) of the maximal runs of True; a run ends at each position in ``breaks``."""
    edge = np.zeros(len(mask) + 2, dtype=bool)
    edge[1:-1] = mask
    first, last = edge[1:-1] & ~edge[:-2], edge[1:-1] & ~edge[2:]
    if breaks is not None and len(breaks):
        at = breaks[(breaks > 0) & (breaks < len(mask))]
        first[at] |= mask[at]
        last[at - 1] |= mask[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def group_starts(sorted_keys):
    """Where each run of equal neighbours begins."""
    if not len(sorted_keys):
        return np.empty(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def lookup(keys, table):
    """Position of each key in a sorted table, -1 where it is absent."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def sha256(data):
    return hashlib.sha256(data).hexdigest()


# whole numbers travel as their low bytes only, one byte plane after the other


def pack(values):
    values = np.ascontiguousarray(values).view(np.uint64) if values.dtype.itemsize == 8 else values.astype(np.uint64)
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data, n):
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(values):
    """As ``pack``, of the steps between ascending values."""
    return pack(np.diff(values, prepend=U(0))) if len(values) else b""


def unpack_sorted(data, n):
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def bucket_of(h, buckets):
    """Equal ranges of the hash space, in hash order."""
    return ((h >> U(32)) * U(buckets)) >> U(32)
