"""Secret scans: exact base patterns plus character Markov models.

Two first-order character models, of random strings (values of base spans) and of
ordinary identifiers (other long tokens), are trained from labelled samples taken
from at most TRAIN_DOCS documents.  A token is a further secret if its log-likelihood
ratio per character exceeds a threshold calibrated on the same samples (a false alarm
costs FALSE_COST times a miss).  Without a secret in the sample nothing is added.

Defined results: null text is empty; repeated rows give repeated results, each its own; a null
doc_id stays null; tokens of SHORTEST and more characters, points inside them included, are
scored whole, however long; a ratio equal to the threshold adds nothing; spans that begin
together are ordered as the kinds are listed; an empty table gives an empty one, and a model
that adds nothing; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample

KINDS = ("assign", "access", "hex", "random")
TRAIN_DOCS = 4000
#: Least length of a token that is scored; a point may stand inside one.
SHORTEST = 12
SHRINK = 8
#: Cost of taking an ordinary token for a secret, against missing a secret (both as shares of the sample).
FALSE_COST = 50
BINS, LOW, HIGH = 400, -4.0, 4.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)

# The alphabet of the models; anything else is one further symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SYMBOLS = len(ALPHABET) + 1
_CODE = np.full(256, len(ALPHABET), np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _tokens(text: str, spans):
    """(start, end, overlaps a base span) of the tokens that the models score."""
    k, reach = 0, 0
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".")
        lo = m.start() + len(token) - len(token := token.lstrip("."))
        hi = lo + len(token)
        if len(token) < SHORTEST:
            continue
        while k < len(spans) and spans[k][0] < hi:
            reach = max(reach, spans[k][1])
            k += 1
        yield lo, hi, reach > lo


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)].astype(np.int64)


def _samples(text: str):
    """(is secret, string) labelled by the base patterns."""
    spans = base_spans(text)
    for lo, hi, kind in spans:
        value = _ASSIGN.match(text, lo)[2] if kind == "assign" else text[lo:hi]
        if kind != "hex" or not value.isdigit():
            yield True, value
    for lo, hi, covered in _tokens(text, spans):
        if not covered:
            yield False, text[lo:hi]


def _pairs(batches):
    n = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for secret, value in _samples(text or ""):
                c = _codes(value)
                np.add.at(n[int(secret)], (c[:-1], c[1:]), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.reshape(-1)[at], pa.int64())], names=["k", "n"])


def ratio(token: str, table: np.ndarray) -> float:
    """Log-likelihood ratio per character, random against ordinary, shrunk as if SHRINK characters without evidence stood before."""
    c = _codes(token)
    return float(table[c[:-1], c[1:]].sum() / (len(c) - 1 + SHRINK)) if len(c) > 1 else 0.0


def _histogram(table):
    def run(batches):
        n = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for secret, value in _samples(text or ""):
                    n[int(secret), min(BINS - 1, max(0, int((ratio(value, table) - LOW) / (HIGH - LOW) * BINS)))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.reshape(-1)[at], pa.int64())], names=["k", "n"])

    return run


def _gather(frame: DataFrame, size: int) -> np.ndarray:
    """A table of fixed size, summed in Spark."""
    out = np.zeros(size)
    for k, n in frame.groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    sample = bounded_sample(docs, most, "text").select("text")
    n = _gather(sample.mapInArrow(_pairs, "k int, n bigint"), 2 * SYMBOLS**2).reshape(2, SYMBOLS, SYMBOLS)
    # random strings are smoothed towards uniform rows, ordinary ones strongly towards their own unigram, so that
    # a few hidden secrets among the ordinary tokens do not teach their transitions
    plain, secret = n[0], n[1]
    unigram = (plain.sum(0) + 0.5) / (plain.sum() + 0.5 * SYMBOLS)
    p0 = (plain + 500 * unigram) / (plain.sum(1, keepdims=True) + 500)
    p1 = (secret + 50 / SYMBOLS) / (secret.sum(1, keepdims=True) + 50)
    table = np.log(p1) - np.log(p0)
    h = _gather(sample.mapInArrow(_histogram(table), "k int, n bigint"), 2 * BINS).reshape(2, BINS)
    if not h[1].sum():
        return {"table": table, "threshold": float("inf")}
    passed = [np.append(np.cumsum(x[::-1])[::-1], 0) / max(1.0, x.sum()) for x in h]  # share at or above each edge
    cost = FALSE_COST * passed[0] + (1 - passed[1])
    # of the edges with the least cost the middle one: far from both kinds (a hidden secret among the ordinary tokens only costs its share)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edge = LOW + (HIGH - LOW) * float(best[len(best) // 2]) / BINS
    return {"table": table, "threshold": max(edge, 0.25)}


def all_spans(text: str, model: dict) -> tuple[list, list]:
    base = base_spans(text)
    added = [(lo, hi, "random") for lo, hi, covered in _tokens(text, base) if not covered and ratio(text[lo:hi], model["table"]) > model["threshold"]]
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base


_FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: counts of base spans by kind, digest of the base spans, all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", model)
                n = Counter(x[2] for x in base)
                tell = lambda s: ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in s)
                out.append((*(n[k] for k in KINDS[:3]), hashlib.sha256(tell(base).encode()).hexdigest(), tell(spans)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=["doc_id"] + [x.split()[0] for x in _FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, " + _FOUND)
