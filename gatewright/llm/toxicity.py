"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Training uses at most TRAIN_TOXIC toxic and TRAIN_ORDINARY ordinary labelled documents.
Each class has a dictionary of its own, trained by zstandard on words of that class,
every word given as often as documents of the class hold it: for the toxic class the
words that are significantly more frequent there than in ordinary documents (ordinary
words would fill the dictionary and tell nothing), for the ordinary class the words of
a sample of ordinary windows.  Behind both stands the same common part, trained on the
sampled ordinary windows, so that both code ordinary text alike.

A text is cut into windows of WINDOW_BYTES or up to the next space, at most twice as
many bytes where there is none.  Each window is compressed with either dictionary behind
a short anchor that both know (so that a block is always compressed and a match always
pays); the difference of the two lengths is its distance.  A document's counts and
shares of windows by distance feed a logistic calibration fitted on the training
documents, whose probability is the score; THRESHOLD decides.

Defined results: null and empty texts have one empty window and get its score; repeated
rows are scored alike, each for itself; whole texts are scored, window by window, in linear
time; ids that share labels 0 and 1 count as toxic; other columns are not looked at.
If a class has no training document all scores are the base rate; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample

TRAIN_TOXIC, TRAIN_ORDINARY = 4000, 8000
WINDOW_BYTES = 14
#: Bytes of the class's own and of the common part of a dictionary.
OWN_BYTES, COMMON_BYTES = 1024, 4096
#: Sampled ordinary windows, and their bytes.
SAMPLE_WINDOWS, SAMPLE_BYTES = 20_000, 64
#: A word is toxic training text if its standardised difference of document shares is at least SIGNIFICANT; at most WORDS words are.
SIGNIFICANT, LEAST_DOCS, WORDS = 6.0, 5, 5000
THRESHOLD = 0.7
#: An ordinary training document weighs as much as so many toxic ones, as false alarms cost clean text.
FALSE_COST = 2.0
ANCHOR = b"#anchor:0123456789abcdefghijklmnopqrstuvwxyz:"
#: Distances at which windows are counted.
STEPS = (-3, -1, 2, 3, 4, 5, 6, 8)

PARAMS = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0)


def normal(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def windows(text: str | None, size: int):
    b = normal(text).encode("utf-8", "replace")
    at, last = 0, len(b) - 1
    while at < last:
        end = b.find(b" ", at + size, at + 2 * size)
        if end < 0:  # the text ends, or a run without spaces is cut
            end = min(last, at + 2 * size)
        yield b[at : end + 1]
        at = end


def _words(batches):
    """(word, toxic documents, ordinary documents), summed in the task."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        for k in (0, 1):
            if seen[k]:
                n = list(seen[k].values())
                yield pa.RecordBatch.from_arrays([pa.array(seen[k].keys(), pa.string()), pa.array([k * v for v in n], pa.int64()), pa.array([(1 - k) * v for v in n], pa.int64())], names=["word", "toxic", "plain"])
                seen[k].clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic].update({x for w in set(normal(text).split()) if (x := re.sub(r"^\W+|\W+$", "", w))})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield from flush()
    yield from flush()


def _cut(batches):
    for batch in batches:
        for text in batch.column("text").to_pylist():
            got = list(windows(text, SAMPLE_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["w"])


def _content(book: zstandard.ZstdCompressionDict) -> bytes:
    """The text of a trained dictionary: what follows its entropy tables, which end with three offsets (1, 4, 8)."""
    raw = book.as_bytes()
    mark = struct.pack("<III", 1, 4, 8)
    at = raw.find(mark)
    return raw[at + len(mark) :] if at >= 0 else raw


def _book(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; where there is too little text to train on, the text itself."""
    samples = [x.ljust(8) for x in samples]
    try:
        return _content(zstandard.train_dictionary(size, samples, k=16, d=8, level=3))
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _dealt(times: dict[str, int]):
    """Every word as often as its count, in rounds: the trainer picks from each stretch of its samples, so all stretches need all words."""
    words = sorted(times)
    for turn in range(max(times.values(), default=0)):
        yield from (w for w in words if times[w] > turn)


def _compressor(raw: bytes):
    book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=PARAMS)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=PARAMS)


class Scorer:
    def __init__(self, books: tuple[bytes, bytes]):
        self.toxic, self.plain = (_compressor(x) for x in books)

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, by window."""
        toxic, plain = self.toxic.compress, self.plain.compress
        return np.array([len(plain(ANCHOR + w)) - len(toxic(ANCHOR + w)) for w in windows(text, WINDOW_BYTES)] or [0])

    def features(self, text: str | None) -> np.ndarray:
        """For each of the distances STEPS: the log count and the share of windows at or beyond it; and the mean."""
        d = self.distances(text)
        n = np.array([(d >= t).sum() if t > 0 else (d <= t).sum() for t in STEPS])
        return np.concatenate([np.log1p(n), n / len(d), [d.mean()]])


WIDTH = 2 * len(STEPS) + 1


def _features(books):
    def run(batches):
        scorer = Scorer(books)
        for batch in batches:
            f = [scorer.features(x).tolist() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column("toxic")], names=["f", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, cost = np.zeros(z.shape[1]), np.where(y == 1, 1.0, FALSE_COST)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (cost * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TRAIN_TOXIC, ordinary_docs: int = TRAIN_ORDINARY) -> dict:
    """Fit on `labels` (doc_id, toxic), which the caller restricts to training rows."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # one row per labelled id, so at most toxic_docs + ordinary_docs rows of numbers are broadcast
    ids = bounded_sample(marked.where("toxic = 1"), toxic_docs, "toxic").unionByName(bounded_sample(marked.where("toxic = 0"), ordinary_docs, "toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    n = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        return {"rate": n[1] / max(1, n[0] + n[1])}
    sample = sample.select("text", "toxic")
    counts = sample.mapInArrow(_words, "word string, toxic bigint, plain bigint").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("plain").alias("o"))
    share = (F.col("t") + F.col("o")) / F.lit(n[0] + n[1])
    z = (F.col("t") / n[1] - F.col("o") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]) + 1e-9)
    toxic = counts.where(F.col("t") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "word").limit(WORDS).collect()
    cut = sample.where("toxic = 0").mapInArrow(_cut, "w binary").orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WINDOWS)
    ordinary = [bytes(r.w) for r in cut.collect()]  # at most SAMPLE_WINDOWS * 2 * SAMPLE_BYTES bytes
    common = _content(zstandard.train_dictionary(COMMON_BYTES, ordinary, k=64, d=8, level=3)) if len(ordinary) > 1000 else b" ".join(ordinary)[-COMMON_BYTES:]
    own = [_book([f" {w} ".encode() for w in _dealt({r.word: r.t for r in toxic})], OWN_BYTES), _book([b" " + w + b" " for x in ordinary for w in x.split()], OWN_BYTES)]
    books = tuple(x + common + ANCHOR for x in own)
    rows = sample.mapInArrow(_features(books), "f array<double>, toxic int").collect()  # at most toxic_docs + ordinary_docs rows of WIDTH numbers
    x, y = np.array([r.f for r in rows]), np.array([r.toxic for r in rows])
    order = np.lexsort((*x.T, y))
    return {"books": books, "fit": _logistic(x[order], y[order])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        scorer = Scorer(model["books"]) if "books" in model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if scorer is None:
                p = np.full(len(texts), model["rate"])
            else:
                mean, scale, w = model["fit"]
                f = np.array([scorer.features(x) for x in texts]).reshape(-1, WIDTH)
                p = 1 / (1 + np.exp(-(((f - mean) / scale) @ w[:-1] + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
