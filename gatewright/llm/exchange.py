"""Packed hash exchange: the shuffle shared by the window and shingle operators.

A plain row per hash costs 24 bytes or more in a Spark shuffle.  Here a map task
sorts the hashes of a bounded chunk of text, delta-codes them for each
bucket and sends one binary value per bucket, which takes 5 to 9 bytes a hash.
The grouping itself stays a Spark shuffle (groupBy on the bucket), so lost
executors are recovered by lineage as usual.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from .textcore import U64, mix, pack, unpack, width_of

_HEAD = struct.Struct("<IBBQI")


def bucket_count(spark, factor: int) -> int:
    """Buckets follow the session's shuffle partitions, so they grow with the cluster's setting."""
    return max(8, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits: sorted hashes have sorted buckets."""
    return (((hashes >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(U64)), n)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays, differenced and compressed."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.diff(a.astype(np.int64), prepend=np.int64(0)).astype("<i8").tobytes()
        z = zstandard.ZstdCompressor(level=1).compress(np.frombuffer(raw, np.uint8).reshape(-1, 8).T.tobytes())
        parts += [struct.pack("<II", len(a), len(z)), z]
    return b"".join(parts)


def expand(raw: bytes) -> list[np.ndarray]:
    (k,), at, out = struct.unpack_from("<B", raw), 1, []
    for _ in range(k):
        n, size = struct.unpack_from("<II", raw, at)
        flat = zstandard.ZstdDecompressor().decompress(raw[at + 8 : at + 8 + size], max_output_size=max(1, 8 * n)) if n else b""
        cols = np.frombuffer(flat, np.uint8).reshape(8, n).T
        out.append(np.cumsum(np.ascontiguousarray(cols).reshape(-1).view("<i8")))
        at += 8 + size
    return out


def bucket_blobs(hashes: np.ndarray, values: np.ndarray, n: int, directory, bits: int = 64, more: np.ndarray | None = None, more_width: int = 0):
    """(bucket, blob) of hashes of `bits` bits sorted ascending, each with a small unsigned value and `more_width` bytes of `more`.

    directory(values) gives the values to store and the bytes that explain them; it
    lists only the documents of the blob, so its size follows the blob's.
    """
    if not len(hashes):
        return
    b = bucket_of(hashes << U64(64 - bits), n)
    edges = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(b)]):
        h = hashes[lo:hi]
        v, told = directory(values[lo:hi])
        deltas = np.diff(h)
        wd, wv = width_of(deltas.max() if len(deltas) else 0), width_of(v.max())
        yield int(b[lo]), b"".join((_HEAD.pack(hi - lo, wd, wv, int(h[0]), len(told)), told, pack(deltas, wd), pack(v, wv), pack(more[lo:hi], more_width) if more_width else b""))


def listing(*columns: np.ndarray):
    """A directory for values that are row numbers: the columns of the rows that occur (all rows if most do)."""
    whole = squeeze(*columns)
    size = len(columns[0])

    def told(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
        if len(rows) > 2 * size:
            return rows, whole
        used, at = np.unique(rows, return_inverse=True)
        return at.astype(np.int64), squeeze(*(c[used] for c in columns))

    return told


def open_blob(raw: bytes, more_width: int = 0) -> tuple:
    """(hashes, values, directory), and `more` if the blob has it."""
    n, wd, wv, first, size = _HEAD.unpack_from(raw)
    at = _HEAD.size
    directory, at = raw[at : at + size], at + size
    h = np.empty(n, U64)
    h[0] = first
    h[1:] = unpack(raw[at : at + (n - 1) * wd], wd, n - 1)
    at += (n - 1) * wd
    found = np.cumsum(h, dtype=U64), unpack(raw[at : at + n * wv], wv, n), directory
    at += n * wv
    return (*found, unpack(raw[at : at + n * more_width], more_width, n)) if more_width else found
