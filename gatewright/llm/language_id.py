"""Language identification by bit-sliced Bloom filters of byte 4-grams.

One table of rows of 64-bit words, as many as the languages need, serves all languages:
bit L of a row belongs to language L's Bloom filter, so the AND of the rows at a gram's HASHES positions is the mask of all
languages that contain the gram.  Per document the masks' bits are counted for each
language, corrected for the false-positive rate of that language's filter, and the
largest count decides.

Training: of each language all documents, or about LANG_DOCS by id hash where there are
more; so a rare language is learned at every size of the input.  A gram belongs to a language if its rate there is at least MIN_RATE and at least SHARE of its
highest rate in any language, so passages in a foreign language do not blur the
filters.  All languages are learned.  The filters have SLOT_BITS bits each, or as many
more as keep the fullest of them below FULL; since a language has at most 1 / MIN_RATE
grams, a model takes at most 8 MB for each 64 languages.

Defined results: letters are the characters of Unicode's categories L*; null text or text without a letter gives `und` and score 0; a text
with letters but no known gram gives the most frequent language and score 0; ties go to
the alphabetically first language; whole texts are counted; repeated rows are
predicted alike.  The score is the corrected share of grams that the language explains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import sample_per_value
from .textcore import U64, buffers, mix, trim

LANG_DOCS = 8000
SLOT_BITS, HASHES = 18, 3
MIN_RATE, SHARE = 2e-5, 0.25
UNKNOWN = "und"
FULL = 0.3
_LETTER = regex.compile(r"\p{L}")

#: Bytes of a word: ASCII letters in lower case and all bytes of non-ASCII characters; the rest is one separator.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams with at most one separator, and the n+1 offsets of the rows in them."""
    n = len(data)
    if n < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    b = _FOLD[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    b[latin] += 0x20  # lower case of the accented Latin capitals
    code = b[:-3].astype(np.uint32)
    for j in (1, 2, 3):
        code = (code << np.uint32(8)) | b[j : n - 3 + j]
    gap = (b == 32).astype(np.int8)
    ok = gap[:-3] + gap[1:-2] + gap[2:-1] + gap[3:] <= 1
    for back in (1, 2, 3):  # grams that cross the end of a row
        at = offs[1:-1] - back
        ok[at[(at >= 0) & (at < n - 3)]] = False
    at = np.flatnonzero(ok)
    return code[at], np.searchsorted(at, offs)


def _slots(codes: np.ndarray, j: int, bits: int) -> np.ndarray:
    return (mix(codes.astype(U64) + U64((j + 1) << 40)) >> U64(64 - bits)).astype(np.int64)


def _bits(most: int) -> int:
    """log2 of the rows of the table for languages of at most `most` grams."""
    bits = SLOT_BITS
    while HASHES * most > FULL * (1 << bits):
        bits += 1
    return bits


def _parts(texts, size: int = 1 << 20):
    """Slices of a text column of about `size` bytes, as buffers."""
    data, offs = buffers(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, to, data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, to, data, offs in _parts(batch.column("text")):
            codes, at = grams(data, offs)
            names, which = np.unique(langs[row:to], return_inverse=True)
            key, n = np.unique(np.repeat(which.astype(U64) << U64(32), np.diff(at)) | codes, return_counts=True)
            lang = pa.array(names, pa.string()).take(pa.array((key >> U64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, pa.array((key & U64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _log(rows: np.ndarray) -> int:
    return len(rows).bit_length() - 1


def train(docs: DataFrame, most: int = LANG_DOCS) -> dict:
    """Filters from `docs` (doc_id, text, lang), which the caller restricts to training rows."""
    known = docs.where("lang is not null and text is not null")
    sample, seen = sample_per_value(known, "lang", most, "text")
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    rows = np.zeros((1 << SLOT_BITS, 1), U64)
    if langs:
        of = docs.sparkSession.createDataFrame([(x, i // 64, i % 64, totals[x]) for i, x in enumerate(langs)], "lang string, word int, bit int, total bigint")
        each = counts.join(F.broadcast(of), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= MIN_RATE)
        # grams of at least MIN_RATE: at most 1 / MIN_RATE for each language
        found = each.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("word", "bit", "rate")).alias("x")).selectExpr("gram", f"inline(filter(x, y -> y.rate >= {SHARE} * top))")
        kept = found.groupBy("gram", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")).toArrow()
        codes, words, masks = (kept.column(c).to_numpy() for c in ("gram", "word", "mask"))
        held = [int(((masks.astype(np.int64).view(U64)[words == i // 64] >> U64(i % 64)) & U64(1)).sum()) for i in range(len(langs))]
        rows = np.zeros((1 << _bits(max(held)), -(-len(langs) // 64)), U64)
        for j in range(HASHES):
            np.bitwise_or.at(rows, (_slots(codes.astype(U64), j, _log(rows)), words), masks.astype(np.int64).view(U64))
    fill = np.array([float(((rows[:, i // 64] >> U64(i % 64)) & U64(1)).mean()) for i in range(len(langs))])
    return {"langs": langs, "rows": rows, "false": fill**HASHES, "common": max(langs, key=lambda x: (seen[x], x)) if langs else UNKNOWN}


def classify(texts, model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and number of grams of every text of an Arrow string array."""
    langs, rows = model["langs"], model["rows"]
    best, score, length = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for row, to, data, offs in _parts(texts):
        codes, at = grams(data, offs)
        if not len(codes) or not langs:
            continue
        slots = [_slots(codes, j, _log(rows)) for j in range(HASHES)]
        n = length[row:to] = np.diff(at)
        shares = np.zeros((len(langs), to - row))
        for i in range(len(langs)):
            if i % 64 == 0:
                word = np.ascontiguousarray(rows[:, i // 64])
                mask = word[slots[0]]
                for at_j in slots[1:]:
                    mask &= word[at_j]
            sums = np.append(0, np.cumsum((mask >> U64(i % 64)) & U64(1), dtype=np.int64))
            hits = sums[at[1:]] - sums[at[:-1]]
            p = model["false"][i]
            shares[i] = np.maximum(0.0, hits - n * p) / (1 - p if p < 1 else 1.0) / np.maximum(1, n)
        best[row:to] = shares.argmax(0)
        score[row:to] = np.minimum(1.0, shares.max(0))
    out = []
    for i, text in enumerate(texts.to_pylist()):
        if text is None or not langs or not _LETTER.search(text):
            out.append(UNKNOWN)
            score[i] = 0.0
        else:
            out.append(langs[best[i]] if score[i] > 0 else model["common"])
    return out, score, length


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of `docs` plus lang_pred and lang_score; a column of such a name of the caller's stays as `<name>_in`."""
    for name in ("lang_pred", "lang_score"):
        docs = docs.withColumnRenamed(name, f"{name}_in")
    names = docs.columns

    def run(batches):
        for batch in batches:
            lang, score, _ = classify(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


#: Below this share of explained grams a text of at least SHORT grams is in no learned language.
REJECT, SHORT = 0.2, 20


def keep_known(docs: DataFrame, model: dict, least: float = REJECT) -> DataFrame:
    """Rows of `docs` (same columns) in a learned language; `und` and unexplained texts go."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            lang, score, n = classify(batch.column("text"), model)
            trim()
            yield batch.filter(pa.array([a != UNKNOWN and (s >= least or k < SHORT) for a, s, k in zip(lang, score, n)], pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)
