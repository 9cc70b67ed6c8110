"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Both sides are cut into words and every run of K words is hashed.  Of each WINDOW - K + 1
consecutive hashes the smallest (rightmost of equals) is a fingerprint, so any shared
run of WINDOW words has a fingerprint on both sides.  The benchmark's fingerprints
fill a bitmap of BITS_PER_MARK bits for each; a document's fingerprints that miss it are
dropped at once, the others are extended to the WINDOW-word windows around them, and only
those windows are joined, by their words, with the benchmark's windows.  The bitmap can
only let too much through; the join on words is exact.  Items shorter than WINDOW words
are single windows, looked for by the hash of each run of that length.

Defined results: words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters;
null or empty text has none; documents without hits stay in the result with zeros;
repeated rows give as many rows in the result; a null doc_id is an id like any other;
items without words never occur, and items of equal text all count; an empty benchmark
hits nothing; other columns of `docs` are not looked at, whatever their names.

Scale: documents are read once and never shuffled; only hit windows are.  The bitmap is a
literal of the plan, so it stops growing at 2**MOST_BITS (500,000 fingerprints at the
usual share of false hits; with more, more windows reach the exact join).  The benchmark's
windows are broadcast if at most BROADCAST_WINDOWS (checked by a count), else the join salts
hot windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prune import without
from .storage import written

WINDOW, K = 10, 7
BROADCAST_WINDOWS = 100_000
SALTS = 32
BITS_PER_MARK, LEAST_BITS, MOST_BITS = 32, 16, 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _slot(h: str, size: int) -> str:
    return f"cast(shiftrightunsigned({h}, {64 - size}) as int)"


def bitmap(hashes: DataFrame) -> tuple[str, int]:
    """(SQL of a constant array of longs with a bit for each hash `h`, log2 of its bits); the optimizer folds it into one literal."""
    n = hashes.count()
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_MARK * n).bit_length()))
    slots = hashes.selectExpr(f"{_slot('h', size)} s").distinct().selectExpr("shiftright(s, 6) w", "shiftleft(1L, s & 63) b").groupBy("w").agg(F.bit_or("b").alias("b"))
    longs = [0] * ((1 << size) // 64)
    for w, b in slots.collect():  # at most as many rows as the bitmap has longs
        longs[w] = b
    return f"cast(split('{','.join(map(str, longs))}', ',') as array<bigint>)", size


def inside(bits: tuple[str, int], h: str) -> str:
    slot = _slot(h, bits[1])
    return f"(shiftright({bits[0]}[shiftright({slot}, 6)], {slot} & 63) & 1L) = 1L"


def words(text: Column) -> Column:
    """ASCII texts take the fast lower(); others change A-Z only."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _runs(at: str, k: int, seed: int) -> Column:
    """Hashes of all runs of k words of the array `at`; position p (from 0) is the run's start."""
    n = f"size({at}) - {k}"
    cells = ", ".join(f"{at}[p + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN {n} >= 0 THEN transform(sequence(0, {n}), p -> xxhash64({seed}, {cells})) ELSE array() END")


def _fingerprints(h: str, w: int) -> Column:
    """Positions chosen by winnowing: in each window of w hashes the smallest, rightmost of equals."""
    best = f"transform(sequence(0, size({h}) - {w}), i -> reduce(sequence(i + 1, i + {w} - 1), i, (b, j) -> IF({h}[j] <= {h}[b], j, b)))"
    return F.expr(f"CASE WHEN size({h}) >= {w} THEN array_distinct({best}) ELSE array() END")


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, win): every window of every item; n is `window` or, for short items, the item's length."""
    items = bench.select("item_id", words(F.col("text")).alias("ws")).where("size(ws) > 0").withColumn("n", F.least(F.size("ws"), F.lit(window)))
    starts = items.withColumn("p", F.explode(F.expr("sequence(0, size(ws) - n)")))
    return starts.select("item_id", "n", F.expr("array_join(slice(ws, p + 1, n), ' ')").alias("win")).distinct()


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n_words, head, lo, hi, items): one row per window of a row of `docs` that may occur in the benchmark
    (nulls if it does not), at least one for each row of `docs`; `head` is 1 for the first of a row's and 0 for the others."""
    spark = docs.sparkSession
    wins = benchmark_windows(bench, window)
    short = sorted(r.n for r in wins.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 lengths
    w = window - k + 1
    long_items = bench.select(words(F.col("text")).alias("ws")).where(F.size("ws") >= window).withColumn("h", _runs("ws", k, 0)).withColumn("f", _fingerprints("h", w))
    marks = long_items.select(F.explode(F.expr("transform(f, i -> h[i])")).alias("h"))
    for n in short:
        marks = marks.union(wins.where(F.col("n") == n).select(F.split("win", " ").alias("ws")).select(_runs("ws", n, n)[0].alias("h")))
    bits = bitmap(marks.distinct())

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    d = d.withColumn("h", _runs("ws", k, 0)).withColumn("f", _fingerprints("h", w))
    d = d.withColumn("f", F.expr(f"filter(f, i -> {inside(bits, 'h[i]')})"))
    # a fingerprint at i lies in the windows that start at i - (window - k) to i
    spots = [f"transform(filter(array_distinct(flatten(transform(f, i -> sequence(greatest(i - {window - k}, 0), i)))), p -> p + {window} <= size(ws)), p -> struct(p, {window} n))"]
    for n in short:
        d = d.withColumn(f"h{n}", _runs("ws", n, n))
        spots.append(f"transform(filter(sequence(0, greatest(size(h{n}) - 1, 0)), p -> p < size(h{n}) AND {inside(bits, f'h{n}[p]')}), p -> struct(p, {n} n))")
    d = d.withColumn("spots", F.expr(f"transform(concat({', '.join(spots)}), x -> struct(x.p lo, x.n n, array_join(slice(ws, x.p + 1, x.n), ' ') win))"))
    d = d.select("doc_id", "text_hash", F.size("ws").cast("bigint").alias("n_words"), "spots")
    rows = d.select("doc_id", "text_hash", "n_words", F.posexplode_outer("spots").alias("at", "s"))
    rows = rows.select("doc_id", "text_hash", "n_words", F.expr("IF(coalesce(at, 0) = 0, 1L, 0L)").alias("head"), "s.lo", "s.n", "s.win")

    wins = wins.groupBy("n", "win").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    if wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        joined = rows.join(F.broadcast(wins), ["n", "win"], "left")
    else:
        salted = wins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id, lo), {SALTS}) as int)")).join(salted, ["n", "win", "salt"], "left")
    return joined.select("doc_id", "text_hash", "n_words", "head", F.when(F.col("items").isNotNull(), F.col("lo")).alias("lo"), F.expr("lo + n").alias("hi"), "items")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, contaminated) for every row of `docs`.

    Equal rows are judged together, with partial sums before the shuffle, and are dealt out again as often as they came.
    """
    found = hits(docs, bench, window, k)
    per_doc = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum("head").alias("times"),
        F.array_sort(F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # words covered by the union of the spans, which are sorted by start
    n_hit = "aggregate(spans, struct(0 at, 0L n), (a, x) -> struct(greatest(a.at, x.hi) at, a.n + greatest(x.hi - greatest(x.lo, a.at), 0) n), a -> a.n)"
    per_doc = per_doc.withColumn("_copy", F.explode(F.expr("sequence(1L, times)")))
    return per_doc.select("doc_id", "n_words", F.expr(n_hit).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items").withColumn("contaminated", F.col("n_hit") > 0)


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    c = contamination(docs, bench)
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of `docs` (all columns) whose text holds no benchmark window; a doc_id goes if one of its rows holds one."""
    bad = written(contamination(docs, bench).where("contaminated").select("doc_id").distinct())
    return without(docs, bad)
