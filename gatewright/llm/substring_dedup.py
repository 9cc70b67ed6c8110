"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of `window` consecutive words is hashed (rolling hashes of 64 and 24 bits).
Windows are grouped by hash in Spark and a window is *repeated* if the same
word sequence starts earlier: in a smaller doc_id, or in the same document at an
earlier word.  Repeated windows of a document merge into maximal removal
intervals.  Judgement is on the input, never on what is left of it.

Scale: a map task keeps only the first place of a hash in its chunk, so a
passage found in a third of all documents reaches its bucket once per chunk, not
once per document; later places in the chunk are known to be repeated and go
straight to their document.  Buckets follow the shuffle partitions.  Only documents that
lose something (and about one in a hundred more, by a Bloom filter of their ids) are shuffled
with their texts to meet their intervals, as long as the filter has at most prune.MOST_BITS.

Defined results: null text has no words; documents shorter than the window lose
nothing; rows that share doc_id are copies of one document for the comparison
(equal places tie and neither is earlier; all of them get the intervals);
null doc_id counts as the smallest id (the smallest long stands for it and must not be
an id); repeated rows each give a row; an empty table gives an empty one; other columns are
not looked at.  Equality is that of 88-bit hashes: n windows have n^2/2^89 false pairs on
average, 0.4 for the 1.5e13 windows of 100 TB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bucket_blobs, bucket_count, doc_bucket, expand, open_blob, squeeze
from .prune import split_by_ids
from .storage import written
from .textcore import NULL_ID, chunks, hash_words, second_hashes, trim, window_hashes

WINDOW = 20
CHUNK_BYTES = 8 << 20
#: Bytes of the second hash.
SECOND = 3
_BLOB = "hop int, b int, blob binary"


def _rows(found, schema):
    found = list(found)
    for at in range(0, len(found), 64):
        part = found[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema)], names=["hop", "b", "blob"])


_TYPES = (pa.int32(), pa.int32(), pa.binary())


def _place_blobs(ids: np.ndarray, starts: np.ndarray, n: int):
    """Repeated places, sorted by document and start, as one blob per document bucket."""
    b = doc_bucket(ids, n)
    order = np.lexsort((starts, ids, b))
    b, ids, starts = b[order], ids[order], starts[order]
    edges = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(b)]):
        yield 1, int(b[lo]), squeeze(ids[lo:hi], starts[lo:hi])


def _directory(ids: np.ndarray, rows: np.ndarray):
    """Values are word positions; a blob tells the ids and first positions of its documents, close together."""
    whole = squeeze(ids, rows[:-1])

    def told(at: np.ndarray) -> tuple[np.ndarray, bytes]:
        if len(at) > 2 * len(ids):
            return at, whole
        row = np.searchsorted(rows, at, "right") - 1
        used, k = np.unique(row, return_inverse=True)
        room = np.append(0, np.cumsum(rows[used + 1] - rows[used]))
        return at - rows[row] + room[k], squeeze(ids[used], room[:-1])

    return told


def _mapper(window: int, n: int, n_docs: int):
    def run(batches):
        for ids, data, offs in chunks(batches, CHUNK_BYTES):
            words, rows = hash_words(data, offs, lower=False)
            h, at = window_hashes(words, rows, window)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")  # rows are sorted by id, so the first of equals is the earliest
            h, at = h[order], at[order]
            h2 = second_hashes(words, at, window, 8 * SECOND)
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            row = np.searchsorted(rows, at, "right") - 1
            doc, start = ids[row], at - rows[row]
            if not first.all():
                lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                later = (doc > doc[lead]) | (doc == doc[lead]) & (start > start[lead])
                yield from _rows(_place_blobs(doc[later], start[later], n_docs), _TYPES)
            # a tie with the first place shares its fate, which is told by (doc_id, start)
            yield from _rows(((0, b, blob) for b, blob in bucket_blobs(h[first], at[first], n, _directory(ids, rows), more=h2[first], more_width=SECOND)), _TYPES)

    return run


def _first_hop(n: int):
    """Of the places that share a hash all but the earliest are repeated."""

    def run(table: pa.Table) -> pa.Table:
        if table["hop"][0].as_py() == 1:
            return table
        trim()
        hs, h2s, docs, starts = [], [], [], []
        for raw in table["blob"].to_pylist():
            h, at, directory, h2 = open_blob(raw, SECOND)
            ids, rows = expand(directory)
            at = at.astype(np.int64)
            row = np.searchsorted(rows, at, "right") - 1
            hs.append(h)
            h2s.append(h2.astype(np.uint32))
            docs.append(ids[row])
            starts.append((at - rows[row]).astype(np.int32))
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        shared = np.zeros(len(h), bool)
        shared[1:] |= same
        shared[:-1] |= same
        pick, h = order[shared], h[shared]
        h2, doc, start = np.concatenate(h2s)[pick], np.concatenate(docs)[pick], np.concatenate(starts)[pick]
        order = np.lexsort((start, doc, h2, h))
        h, h2, doc, start = h[order], h2[order], doc[order], start[order]
        lead = np.ones(len(h), bool)
        lead[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        lead = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
        later = (doc > doc[lead]) | (start > start[lead])
        out = list(_place_blobs(doc[later], start[later], n))
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(("hop", "b", "blob"), _TYPES))})

    return run


def _second_hop(window: int):
    """Places of a document merge into maximal intervals [start, end) of words."""

    def run(table: pa.Table) -> pa.Table:
        parts = [expand(x) for x in table["blob"].to_pylist()]
        doc, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)
        lo = np.flatnonzero(new)
        ends = start[np.append(lo[1:], len(doc)) - 1] + window
        ids, starts = doc[lo], start[lo]
        cut = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, int)
        offs = pa.array(np.append(cut, len(ids)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (starts, ends)]
        return pa.table({"doc_key": pa.array(ids[cut], pa.int64()), "starts": lists[0], "ends": lists[1]})

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_key, starts array<int>, ends array<int>): maximal word intervals to remove, one row per affected document."""
    n, n_docs = bucket_count(docs.sparkSession, 2), bucket_count(docs.sparkSession, 1)
    blobs = docs.select("doc_id", "text").mapInArrow(_mapper(window, n, n_docs), _BLOB)
    places = blobs.groupBy("hop", "b").applyInArrow(_first_hop(n_docs), _BLOB)
    return places.groupBy("b").applyInArrow(_second_hop(window), "doc_key bigint, starts array<int>, ends array<int>")


def _cut(batches):
    for batch in batches:
        out = {"n_words": [], "n_removed": [], "kept_text": []}
        for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
            words = (text or "").encode().split()
            kept, at, gone = [], 0, 0
            for lo, hi in zip(starts or (), ends or ()):
                kept += words[at:lo]
                gone += hi - lo
                at = hi
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(gone)
            out["kept_text"].append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())], names=["doc_id", *out])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of `docs` (needs doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = written(repeated_intervals(d, window))
    far, near = split_by_ids(d.withColumn("doc_key", F.coalesce("doc_id", F.lit(NULL_ID))), found.select("doc_key"), "doc_key")
    joined = near.join(found, "doc_key", "left")
    if far is not None:
        joined = joined.unionByName(far, allowMissingColumns=True)
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
