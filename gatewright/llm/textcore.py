"""Vectorised byte-level helpers shared by the corpus operators.

Texts arrive as Arrow string columns.  Words are found and hashed directly on
the UTF-8 buffer with numpy, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers (any odd number is invertible modulo 2**64).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F
NULL_ID = -(1 << 63)
#: Bytes hashed in one go; a longer document is one slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes that end a word: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit code for each byte value; A-Z share the codes of a-z if lower."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            up, down = np.full(self.n, self.base, U64), np.full(self.n, self.inverse, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up[:n], self.down[:n]


_bytes, _words, _second = Powers(BYTE_BASE), Powers(WORD_BASE), Powers(SECOND_BASE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the n+1 offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = word_byte[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit Rabin-Karp hash of every word, and the word offsets of the rows."""
    codes, hashes, counts, row = byte_codes(lower), [], [np.zeros(1, np.int64)], 0
    n, seen = len(offs) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1)
        part, at = data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        starts, ends, word_offs = word_spans(part, at)
        up, down = _bytes.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(codes[part] * up[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)
        hashes.append(mix(h))
        counts.append(word_offs[1:] + seen)
        seen += len(starts)
        row = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(counts)


def window_hashes(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all k-word windows that lie in one row, and the word index of each."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    up, down = _words.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(words * up[:n], out=sums[1:])
    ok = np.ones(n - k + 1, bool)
    cuts = offs[1:-1]
    for back in range(1, k):  # a window that starts less than k words before a row's end crosses it
        at = cuts - back
        at = at[(at >= 0) & (at <= n - k)]
        ok[at] = False
    # rows shorter than the reach of a later cut are covered as every inner cut is visited
    at = np.flatnonzero(ok)
    return mix((sums[at + k] - sums[at]) * down[at]), at


def second_hashes(words: np.ndarray, at: np.ndarray, k: int, bits: int) -> np.ndarray:
    """`bits` bits of an independent rolling hash (another base over re-mixed words) of the k-word windows that start at `at`."""
    n = len(words)
    up, down = _second.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(words ^ U64(SECOND_BASE)) * up[:n], out=sums[1:])
    return (mix((sums[at + k] - sums[at]) * down[at]) >> U64(64 - bits)).astype(np.uint32)


def _unmap_large() -> None:
    """Blocks of 1 MB or more go back to the system when they are freed.  By itself glibc raises that bound up to 32 MB as large
    blocks are freed, and an idle Python worker then keeps what its last task needed."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_unmap_large()


def trim() -> None:
    """Give freed memory back to the system: Python workers are reused for many tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned integers, little-endian."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view("<u8")


def width_of(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64; null becomes NULL_ID."""
    column = column.cast(pa.int64())
    return np.asarray(pc.fill_null(column, NULL_ID) if column.null_count else column).astype(np.int64)


def chunks(batches, size: int, id_col: str = "doc_id", text_col: str = "text"):
    """Re-cut record batches into (ids, data, offsets) of about `size` text bytes, rows sorted by id."""
    held, n = [], 0

    def flush():
        tab = pa.Table.from_batches(held)
        ids = ids_of(tab[id_col].combine_chunks())
        order = np.argsort(ids, kind="stable")
        texts = tab[text_col]
        if not np.array_equal(order, np.arange(len(order))):
            texts = texts.take(pa.array(order))
        return ids[order], *buffers(texts)

    for batch in batches:
        batch = batch.select([id_col, text_col])
        at = 0
        while at < batch.num_rows:
            rows = batch.num_rows - at
            data, offs = buffers(batch.column(1).slice(at))
            take = max(1, min(rows, int(np.searchsorted(offs, size - n, "right")) - 1))
            held.append(batch.slice(at, take))
            n += int(offs[take])
            at += take
            if n >= size * 0.9:
                yield flush()
                held, n = [], 0
                trim()
    if held:
        yield flush()
    trim()
