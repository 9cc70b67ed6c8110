"""Personal data: exact base patterns plus a skip-chain conditional random field.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of each
pattern that pass its check.  The tokens of a document then form a graph: neighbours
in the text share a transition potential, and tokens that repeat (equal, or equal
digits with other separators) are linked to their previous occurrence by a skip edge
and to every observed occurrence (summed per label), else to the first occurrence.
Labels of base spans are observed; loopy sum-product, run until the messages settle,
decides the rest, so an unmatched repetition of known personal data gets its label too,
however many there are, unless its shape or its neighbours speak more strongly against it.

Potentials are fitted: the weights of shapes, of neighbouring labels and of both kinds of
skip edges maximise the pseudo-likelihood of the labels in at most TRAIN_DOCS documents
(each token given its neighbours, in the CONTEXTS most frequent contexts), under Gaussian
priors: none favoured for shapes, 0 for neighbours, SKIP_PRIOR for skip edges.  Tokens
without a base label that are tied to a labelled one are hidden there, neither data nor
neighbours, as they are what is to be found.  That the patterns reject a token counts
UNMATCHED against every label but none; no training data could tell this weight.

Documents without base spans keep no label and skip inference: without an observed label
no message departs from the unary potentials, which favour "none" for tokens that the
patterns reject.

Defined results: null text is empty; repeated rows give repeated results, each its own; a null
doc_id stays null; long texts and long tokens are scanned whole, in time linear in their
length; spans that begin together are ordered as the kinds are listed; an empty table gives an
empty one (and a model that adds what repeats, by the priors); other columns are not looked
at by `find`, whatever their names, and stay as they are in `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sampling import bounded_sample

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS, CONTEXTS = 4000, 50_000
#: Prior mean of the weight of a skip edge, variance of all weights, and what a rejected token loses.
SKIP_PRIOR, VARIANCE, UNMATCHED = 2.0, 4.0, 1.5
#: Message passing ends when no message moves by more than SETTLED; SWEEPS only ends graphs that swing forever.
SWEEPS, SETTLED = 1000, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str):
    """Same matches as the pattern, found from each @ so that long runs cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            free = m.end()
            yield lo, free
        else:
            free = max(free, at)  # what stands before this @ cannot reach a later one
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(lo, hi, "email") for lo, hi in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _shape(core: str) -> str:
    """The whole token with letters and digits by kind and longer runs shortened; a digest where that is still long."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", core))
    s = re.sub(r"(.)\1{3,}", r"\1\1\1+", s)
    return s if len(s) <= 32 else hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=12).hexdigest()


def tokens(text: str, spans):
    """Candidate tokens: (start, end, core, label or None, number of the word)."""
    out, k = [], 0
    for n, m in enumerate(_WORD.finditer(text)):
        w = m[0]
        if "@" not in w and not _DIGITS.search(w):
            continue
        lo, hi = m.span()
        while lo < hi and not (text[lo].isalnum() or text[lo] in "+("):
            lo += 1
        while hi > lo and not (text[hi - 1].isalnum() or text[hi - 1] == ")"):
            hi -= 1
        if lo == hi:
            continue
        while k < len(spans) and spans[k][1] <= lo:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < hi and spans[j][1] <= lo:
            j += 1
        label = spans[j][2] if j < len(spans) and spans[j][0] < hi else None
        out.append((lo, hi, text[lo:hi], label, n))
    return out


def skip_edges(toks) -> list[tuple[int, int, str]]:
    """Each token is linked to the previous one with the same text, else the same digits; so edges are linear in tokens."""
    last_text: dict[str, int] = {}
    last_digits: dict[str, int] = {}
    out = []
    for i, (_, _, core, _, _) in enumerate(toks):
        digits = "".join(_DIGITS.findall(core))
        if len(digits) >= 6 or "@" in core and len(core) >= 6:
            low = core.lower()
            if low in last_text:
                out.append((last_text[low], i, "same"))
            elif len(digits) >= 6 and digits in last_digits:
                out.append((last_digits[digits], i, "alike"))
            last_text[low] = i
            if len(digits) >= 6:
                last_digits[digits] = i
    return out


def ties(toks, skip: dict) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """(pull of the observed occurrences on each token by label, edges between tokens without a label).

    An observed end sends the same message forever, so the edges of a token to all observed tokens with its text, else
    its digits, are one sum per label.  Tokens whose text and digits are never observed are tied to the first occurrence.
    """
    pull = np.zeros((len(toks), 5))
    edges = {(i, j): how for i, j, how in skip_edges(toks) if not toks[i][3] and not toks[j][3]}
    keys, seen = [], {}
    for i, (_, _, core, label, _) in enumerate(toks):
        digits = "".join(_DIGITS.findall(core))
        long = len(digits) >= 6
        own = [("same", core.lower())] * (long or "@" in core and len(core) >= 6) + [("alike", digits)] * long
        keys.append(own)
        if label:
            for key in own:
                seen.setdefault(key, np.zeros(5))[LABELS.index(label)] += 1
    first: dict[tuple[str, str], int] = {}
    for i, own in enumerate(keys):
        if toks[i][3] or not own:
            continue
        # observed tokens with the same text also have the same digits, and count once
        same = seen.get(own[0], np.zeros(5))
        alike = seen.get(own[-1], same) - same if len(own) == 2 else np.zeros(5)
        pull[i] = skip["same"] * same + skip["alike"] * alike
        if not pull[i].any():
            for key in own:
                hub = first.setdefault(key, i)
                if hub != i:
                    edges.setdefault((hub, i), key[0])
                    break
    # where observed occurrences decide, texts that are only alike do not vote on each other
    return pull, [(i, j, how) for (i, j), how in edges.items() if how == "same" or not pull[i].any()]


def _observe(text: str) -> Counter:
    """Contexts of a document's tokens: (shape, labels around it and its own) with their number.

    The labels are coded as one string: the neighbours before and after (5: none or hidden), the linked tokens by label
    (up to 3 of each) over equal texts, then over equal digits, and the token's own.
    """
    spans = base_spans(text)
    seen: Counter = Counter()
    if not spans:
        return seen
    toks = tokens(text, spans)
    links = skip_edges(toks)
    own = [LABELS.index(t[3]) if t[3] else 0 for t in toks]
    tied = {x for i, j, _ in links for x, y in ((i, j), (j, i)) if toks[y][3] and not toks[x][3]}
    more = True
    while more:  # a rejected token tied to a hidden one is hidden too
        found = {x for i, j, _ in links for x, y in ((i, j), (j, i)) if y in tied and not toks[x][3]} - tied
        tied |= found
        more = bool(found)
    near = {how: np.zeros((len(toks), 5), int) for how in ("same", "alike")}
    for i, j, how in links:
        for x, y in ((i, j), (j, i)):
            if y not in tied:
                near[how][x, own[y]] += 1
    for i, t in enumerate(toks):
        if i not in tied:
            prev = own[i - 1] if i and t[4] == toks[i - 1][4] + 1 and i - 1 not in tied else 5
            after = own[i + 1] if i + 1 < len(toks) and toks[i + 1][4] == t[4] + 1 and i + 1 not in tied else 5
            around = "".join(str(min(3, n)) for how in ("same", "alike") for n in near[how][i])
            seen[_shape(t[2]), f"{prev}{after}{around}{own[i]}"] += 1
    return seen


def _count(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(_observe(text or ""))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*seen)] + [pa.array(list(seen.values()), pa.int64())], names=["shape", "around", "n"])


def fit(contexts: list[tuple[str, str, int]], steps: int = 400) -> dict:
    """Maximum of the penalised pseudo-likelihood, by gradient steps with a scale of its own for each weight (Adam)."""
    shapes = sorted({c[0] for c in contexts})
    at = {x: i for i, x in enumerate(shapes)}
    row = np.array([at[c[0]] for c in contexts], int)
    code = np.array([[int(x) for x in c[1]] for c in contexts], int).reshape(-1, 13)
    n, own = np.array([c[2] for c in contexts], float), np.eye(5)[code[:, 12]] if contexts else np.zeros((0, 5))
    prev, after, linked = np.eye(6)[code[:, 0]][:, :5], np.eye(6)[code[:, 1]][:, :5], (code[:, 2:7].astype(float), code[:, 7:12].astype(float))
    start = np.array([0.0, -1.0, -1.0, -1.0, -1.0])
    w = [np.tile(start, (len(shapes), 1)), np.zeros((5, 5)), np.full(2, SKIP_PRIOR)]
    mean = [x.copy() for x in w]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1 if contexts else 1):
        score = w[0][row] + prev @ w[1] + after @ w[1].T + w[2][0] * linked[0] + w[2][1] * linked[1]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = n[:, None] * (own - p)
        unary = np.zeros_like(w[0])
        np.add.at(unary, row, miss)
        slope = [unary, prev.T @ miss + miss.T @ after, np.array([(miss * x).sum() for x in linked])]
        for k in range(3):
            g = slope[k] - (w[k] - mean[k]) / VARIANCE
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] += 0.1 * (1 - t / (steps + 1)) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
    return {"shapes": dict(zip(shapes, w[0])), "rare": start, "step": w[1], "skip": {"same": float(w[2][0]), "alike": float(w[2][1])}}


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """Potentials fitted on at most `most` documents and the CONTEXTS most frequent contexts of their tokens."""
    counts = bounded_sample(docs, most, "text").select("text").mapInArrow(_count, "shape string, around string, n bigint").groupBy("shape", "around").agg({"n": "sum"})
    rows = counts.orderBy("sum(n)", "shape", "around", ascending=[False, True, True]).limit(CONTEXTS).collect()
    return fit([tuple(r) for r in rows])


def infer(toks, model: dict) -> list[str | None]:
    """Labels of the tokens that have none, by loopy sum-product on the components with an observed label."""
    pull, links = ties(toks, model["skip"])
    if not pull.any():
        return [None] * len(toks)
    edges = [(i, j, np.eye(5) * model["skip"][how]) for i, j, how in links]
    edges += [(i, i + 1, model["step"]) for i in range(len(toks) - 1) if toks[i + 1][4] == toks[i][4] + 1]
    unary = np.empty((len(toks), 5))
    for i, (_, _, core, label, _) in enumerate(toks):
        if label:
            unary[i] = -30.0
            unary[i, LABELS.index(label)] = 0.0
        else:
            seen = model["shapes"].get(_shape(core), model["rare"])
            unary[i] = seen - seen.max()
            unary[i, 1:] = np.minimum(unary[i, 1:], -UNMATCHED)  # the patterns did not match here
            unary[i, 0] = 0.0
            unary[i] += pull[i]
    if not edges:
        return [None if t[3] or not best else LABELS[best] for t, best in zip(toks, unary.argmax(1))]
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.exp(np.array([e[2] for e in edges] + [e[2].T for e in edges]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), 5))
    for _ in range(SWEEPS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", out, pot) + 1e-300)
        step = 0.5 * (new - new.max(1, keepdims=True) - msg)
        msg = msg + step
        if np.abs(step).max() < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    best = belief.argmax(1)
    return [None if t[3] or not best[i] else LABELS[best[i]] for i, t in enumerate(toks)]


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """(base spans, base and added spans), each by start, then kind."""
    base = base_spans(text)
    if not base:
        return base, base
    toks = tokens(text, base)
    added = [(t[0], t[1], label) for t, label in zip(toks, infer(toks, model)) if label]
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if added else base


def told(spans) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: counts of base spans by kind, digest of the base spans, all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", model)
                n = Counter(x[2] for x in base)
                out.append((*(n[k] for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=["doc_id"] + [x.split()[0] for x in _FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, " + _FOUND)


def mask(text: str, model: dict) -> str:
    out, at = [], 0
    for lo, hi, kind in all_spans(text, model)[1]:
        if lo >= at:
            out += [text[at:lo], f"<{kind}>"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """All rows and columns of `docs`, with the spans in `text` replaced by their kind; null text stays null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            new = pa.array([None if x is None else mask(x, model) for x in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
