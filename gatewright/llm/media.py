"""Media columns: payloads stored in real containers, typed by signature sniffing.

`sniff` runs an Aho-Corasick automaton over the bytes once to locate all magic
numbers, lets the validator of each format confirm structure and length at every
hit, corrects the declared type from what starts at byte 0, and carves confirmed
media embedded behind it (outermost first, non-overlapping).  `store_wav` keeps a
payload losslessly as 8-bit PCM samples.

Defined results: null text is an empty text and stores 64 zero bytes; bytes that no
validator confirms have type None and keep their declared type as it is; of media that
begin at one place the longest counts; repeated rows give equal rows, each its own; a null
doc_id stays null; an empty table gives an empty one; other columns are not looked at.
Blocks of GIF, JPEG, Ogg and MP4 that several heads lead to are walked once.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
RATE = 16000

# Magic bytes of the public container formats, and where the file starts relative to them.
MAGIC = {b"\x89PNG\r\n\x1a\n": ("png", 0), b"GIF87a": ("gif", 0), b"GIF89a": ("gif", 0), b"\xff\xd8\xff": ("jpeg", 0), b"BM": ("bmp", 0), b"RIFF": ("riff", 0), b"OggS": ("ogg", 0), b"ftyp": ("mp4", -4), b"fLaC": ("flac", 0)}
MIME = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "wav": "audio/wav", "webp": "image/webp", "ogg": "audio/ogg", "mp4": "video/mp4", "flac": "audio/flac"}


def _png(b, at, memo):
    end, pos = len(b), at + 8
    while pos + 12 <= end:
        (n,) = struct.unpack_from(">I", b, pos)
        if pos + 12 + n > end or struct.unpack_from(">I", b, pos + 8 + n)[0] != zlib.crc32(b[pos + 4 : pos + 8 + n]):
            return None
        if b[pos + 4 : pos + 8] == b"IEND":
            return "png", pos + 12 + n - at
        pos += 12 + n
    return None


def _chain(b, at, memo, family, step):
    """End of the file whose blocks begin at `at`, or None.

    step(pos) gives ("next", pos), ("end", pos) or None by the position alone, so files that share blocks share their
    outcome: every block of the bytes is walked once, however many heads lead to it.
    """
    seen, path = memo.setdefault(family, {}), []
    while at not in seen:
        got = step(at)
        path.append(at)
        if got is None or got[0] == "end":
            seen[at] = got and got[1]
        else:
            at = got[1]
            if at in path[-1:]:  # no progress
                seen[at] = None
    for p in path:
        seen[p] = seen[at]
    return seen[at]


def _gif(b, at, memo):
    def step(pos):
        if pos >= len(b):
            return None
        kind = b[pos]
        if kind == 0x3B:
            return "end", pos + 1
        if kind == 0x21:
            return "next", ~(pos + 2)
        if kind == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            return "next", ~(pos + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        return None

    def block(pos):  # a negative position is that of a data sub-block
        if pos >= 0:
            return step(pos)
        pos = ~pos
        if pos >= len(b):
            return None
        return "next", ~(pos + b[pos] + 1) if b[pos] else pos + 1

    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    end = _chain(b, at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), memo, "gif", block)
    return ("gif", end - at) if end else None


def _jpeg(b, at, memo):
    def step(pos):
        if pos + 2 > len(b) or b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        if kind == 0xD9:
            return "end", pos + 2
        if pos + 4 > len(b):
            return None
        after = pos + 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if kind != 0xDA:
            return "next", after
        while True:  # entropy-coded data up to the next real marker
            after = b.find(b"\xff", after)
            if after < 0 or after + 1 >= len(b):
                return None
            if b[after + 1] and not 0xD0 <= b[after + 1] <= 0xD7:
                return "next", after
            after += 2

    end = _chain(b, at + 2, memo, "jpeg", step)
    return ("jpeg", end - at) if end else None


def _bmp(b, at, memo):
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    if reserved or header not in (12, 40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
        return None
    return ("bmp", size) if 14 + header <= start <= size <= len(b) - at else None


def _riff(b, at, memo):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos = at + 8 + size, at + 12
    kind = {b"WAVE": "wav", b"WEBP": "webp"}.get(form)
    if kind is None or end > len(b):
        return None
    found = set()
    while pos + 8 <= end:
        tag, n = struct.unpack_from("<4sI", b, pos)
        found.add(tag)
        pos += 8 + n + (n & 1)
    good = {b"fmt ", b"data"} <= found if kind == "wav" else bool(found & {b"VP8 ", b"VP8L", b"VP8X"})
    return (kind, end - at) if good and pos == end else None


def _table(poly: int, width: int) -> list[int]:
    """CRC by bytes, highest bit first."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        x = i << (width - 8)
        for _ in range(8):
            x = (x << 1) ^ poly if x & top else x << 1
        out.append(x & mask)
    return out


# The generator polynomials of Ogg pages and of FLAC frame headers and frames.
_CRC32, _CRC8, _CRC16 = _table(0x04C11DB7, 32), _table(0x07, 8), _table(0x8005, 16)


def _crc(part: bytes, table: list[int], width: int) -> int:
    x, shift, mask = 0, width - 8, (1 << width) - 1
    for c in part:
        x = ((x << 8) & mask) ^ table[(x >> shift) ^ c]
    return x


def _ogg(b, at, memo):
    def step(pos):
        if pos + 27 > len(b) or b[pos : pos + 5] != b"OggS\0":
            return None
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + 27 + n > len(b) or end > len(b):
            return None
        page = b[pos : pos + 22] + b"\0\0\0\0" + b[pos + 26 : end]
        if _crc(page, _CRC32, 32) != struct.unpack_from("<I", b, pos + 22)[0]:
            return None
        return ("end" if b[pos + 5] & 4 else "next"), end

    end = _chain(b, at, memo, "ogg", step)
    return ("ogg", end - at) if end else None


def _mp4(b, at, memo):
    """Boxes up to the first thing that is none; where boxes end depends on the position alone."""
    if at < 0:
        return None

    def box(pos):
        if pos + 8 > len(b):
            return None
        n, tag = struct.unpack_from(">I4s", b, pos)
        return None if n < 8 or pos + n > len(b) or not re.fullmatch(rb"[a-z0-9 ]{4}", tag) else (n, tag)

    def step(pos):
        got = box(pos)
        return ("next", pos + got[0]) if got else ("end", pos)

    def to_media(pos):
        got = box(pos)
        return got and ("end" if got[1] in (b"moov", b"mdat") else "next", pos + got[0])

    if not _chain(b, at, memo, "mp4 media", to_media):
        return None
    return "mp4", _chain(b, at, memo, "mp4", step) - at


# Extra header bytes for FLAC's block size and sample rate codes.
_FLAC_SIZE, _FLAC_RATE = {6: 1, 7: 2}, {12: 1, 13: 2, 14: 2}


def _flac_header(b, pos):
    """(end of the frame header, samples in the frame, or 0 if it does not say) if a valid one stands at pos."""
    if pos + 6 > len(b) or b[pos] != 0xFF or b[pos + 1] & 0xFE != 0xF8:
        return None
    size, rate, channels, depth = b[pos + 2] >> 4, b[pos + 2] & 15, b[pos + 3] >> 4, b[pos + 3] >> 1 & 7
    if size == 0 or rate == 15 or channels > 10 or depth == 3 or b[pos + 3] & 1:
        return None
    lead = b[pos + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead >> (6 - k) == (1 << (k + 2)) - 2), 0) if lead != 0xFE else 6
    at = pos + 5 + more
    extra = _FLAC_SIZE.get(size, 0)
    end = at + extra + _FLAC_RATE.get(rate, 0)
    if end >= len(b) or lead >= 0x80 and not more or _crc(b[pos : end + 1], _CRC8, 8):
        return None
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8) if size > 7 else int.from_bytes(b[at : at + extra], "big") + 1
    return end + 1, samples


def _flac(b, at, memo):
    """Metadata blocks, then frames: each ends where its CRC-16 does and a frame follows or all samples are there."""
    pos, first, total = at + 4, True, 0
    while True:
        if pos + 4 > len(b):
            return None
        last, kind, n = b[pos] & 0x80, b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind, n) != (0, 34) or kind > 6 or pos + 4 + n > len(b):
            return None
        if first:
            total = int.from_bytes(b[pos + 17 : pos + 22], "big") & ((1 << 36) - 1)
        pos, first = pos + 4 + n, False
        if last:
            break
    seen = 0
    while not total or seen < total:
        head = _flac_header(b, pos)
        if head is None:
            return ("flac", pos - at) if seen and not total else None
        seen += head[1]
        x, end = _crc(b[pos : head[0]], _CRC16, 16), None
        for i in range(head[0], len(b)):
            x = ((x << 8) & 0xFFFF) ^ _CRC16[(x >> 8) ^ b[i]]
            # a frame's CRC over all of it, its own checksum included, is 0
            if x == 0 and (total and seen >= total or _flac_header(b, i + 1) or not total and i + 1 == len(b)):
                end = i + 1
                break
        if end is None:
            return None
        pos = end
    return "flac", pos - at


VALIDATORS = {"png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "riff": _riff, "ogg": _ogg, "mp4": _mp4, "flac": _flac}
_automaton = None


def locate(b: bytes):
    """(offset of the file start, format family) of every magic number, in order of its end."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for magic, what in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (len(magic), *what))
        made.make_automaton()
        _automaton = made
    for end, (n, family, shift) in _automaton.iter(b.decode("latin-1")):
        yield end + 1 - n + shift, family


def sniff(b: bytes, declared: str | None = None) -> dict:
    """Corrected type and length of `b`, and the media carved from it."""
    confirmed, memo = [], {}
    for at, family in locate(b):
        if at >= 0 and (got := VALIDATORS[family](b, at, memo)):
            confirmed.append((at, got[1], got[0]))
    confirmed.sort(key=lambda x: (x[0], -x[1]))
    head = next((x for x in confirmed if x[0] == 0), None)
    carved, free = [], 0
    for x in confirmed:
        if x is not head and x[0] >= free:
            carved.append(x)
            free = x[0] + x[1]
    kind = head[2] if head else None
    return {"type": kind, "mime": MIME[kind] if kind else declared, "corrected": bool(kind) and MIME[kind] != declared, "length": head[1] if head else len(b), "embedded": carved}


def store_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; the payload's bytes are the samples."""
    pad = b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + pad


def read_wav(b: bytes) -> bytes:
    pos = 12
    while pos + 8 <= len(b):
        tag, n = struct.unpack_from("<4sI", b, pos)
        if tag == b"data":
            return b[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


_STORED = "doc_id bigint, n_bytes bigint, declared string, media binary"


def _store(batches):
    for batch in batches:
        texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
        media = [store_wav(x.ljust(max(UNIT, -(-len(x) // UNIT) * UNIT), b"\0")) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(["application/octet-stream"] * len(texts)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Texts as media: (doc_id, n_bytes, declared, media); the declared type is deliberately the generic one."""
    return docs.select("doc_id", "text").mapInArrow(_store, _STORED)


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, mime string, n_embedded bigint"


def _features(batches):
    for batch in batches:
        out = []
        for declared, media in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist()):
            seen = sniff(media, declared)
            payload = read_wav(media[: seen["length"]])
            samples = np.frombuffer(payload, np.uint8)
            feature = f"{seen['type']}:{RATE}:min={samples.min()}:max={samples.max()}:sum={samples.sum(dtype=np.int64)}:rise={int(np.count_nonzero(samples[1:] > samples[:-1]))}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, seen["mime"], len(seen["embedded"])))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=names)


def features(stored: DataFrame) -> DataFrame:
    """Type, payload and features of stored media, all read back from the media bytes."""
    return stored.mapInArrow(_features, _FEATURES)
