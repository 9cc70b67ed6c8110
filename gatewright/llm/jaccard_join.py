"""Exact n-gram Jaccard self-join with vertical partitioning, and its components.

A document's set is its distinct SHINGLE-word shingles.  Two documents link when
100 * |A & B| >= PERCENT * |A | B|.

1. Global n-gram order: shingles are sorted by (number of documents on a log scale of
   STEPS steps an octave; hash), rarest first.  Counts come from a packed hash exchange over
   all shingles of all documents; a shingle of HOT or more documents of one chunk has the last rank.
   Shingles of one document only can link nothing and are dropped, and so are documents whose
   remaining shingles cannot reach the threshold.
2. Candidates: linked sets share a shingle among the first n - ceil(t n) + 1 of the
   order.  In each group of documents that share such a shingle only a star around
   one hub (first the document with fewest shingles of its own) is tried; groups
   whose documents are already connected are done.  After ROUNDS stars, and more while a group
   has over SMALL documents and stars still find links, what is still in several components is
   tried pair by pair inside its group and size band, so no link that could join two
   components is lost and the pairs of a group that is connected are never listed.
   Pairs are tried only if their shared shingles can reach the threshold: by
   their number, and in the last step by the parity bitmaps of both sets, whose
   differing bits bound the symmetric difference from below.
3. Vertical partitioning: the order is cut into FRAGMENTS ranges of equally many entries; the
   overlap of a candidate pair is counted in each fragment separately and summed per pair.

Copies (equal sets) are one node; the smallest document of a class is found per salt first,
so a class of a third of all documents is spread over SALTS tasks.  In a map task copies
inside its chunk are collapsed, and a shingle of HOT or more documents of the chunk is sent to
its bucket once, so hot shingles and hot groups of copies reach a bucket once per chunk.

Defined results: null or empty text has the empty set, 0 shingles, and is its own
component; 1 to SHINGLE - 1 words are one shingle; null doc_id sorts first and its
component is null if it is the smallest; rows that share doc_id are one node, whose
set is that of the row with most shingles (ties: smaller fingerprint), though each row
reports its own size; repeated rows give as many rows; an empty table gives an empty one; other
columns are not looked at, whatever their names (the two smallest longs, NULL_ID and the one after
it, stand for null and for summaries and must not be ids).

Equality: copies are found by two sums of 64 bits each, sizes by 64-bit and overlaps by 56-bit
hashes.  Two sets of a and b shingles have a b / 2^56 false common ones on average, 1.4e-11 for
1000 each; at 100 TB, with some 1e10 candidate pairs, 0.14 pairs have an overlap off by one, and
only those within one shingle of the threshold would be linked wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .exchange import bucket_blobs, bucket_count, doc_bucket, expand, listing, open_blob, squeeze
from .prune import without
from .storage import discard, release, written
from .textcore import NULL_ID, U64, chunks, hash_words, mix, trim, window_hashes

SHINGLE, PERCENT = 5, 75
#: Documents of a chunk from which a shingle is sent once for all of them; steps of the count's log scale in an octave.
HOT, STEPS = 32, 4
FRAGMENTS = 4
#: Rounds of stars: at least and at most; and the documents of a group that are tried pair by pair without more stars.
ROUNDS, MOST_ROUNDS, SMALL = 2, 8, 1000
SALTS = 64
#: 64-bit words of the parity bitmap.
PARITY = 16
CHUNK_BYTES = 4 << 20
_SUMMARY = NULL_ID + 1
_HIGH, _TOP = 56, 127
_BLOB = "hop int, b int, blob binary"
_TYPES = (pa.int32(), pa.int32(), pa.binary())


def _sets(data: np.ndarray, offs: np.ndarray, k: int):
    """Distinct shingles of all rows: (row of each, hash of each, size of each row's set)."""
    words, at = hash_words(data, offs, lower=True)
    h, start = window_hashes(words, at, k)
    row = np.searchsorted(at, start, "right") - 1
    length = np.diff(at)
    for n in range(1, k):
        rows = np.flatnonzero(length == n)
        if len(rows):
            cut = np.zeros(len(rows), U64)
            for j in range(n):
                cut = mix(cut + words[at[rows] + j] + U64(n))
            h, row = np.concatenate([h, cut]), np.concatenate([row, rows])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return row, h, np.bincount(row, minlength=len(offs) - 1)


def _prints(row, h, sizes) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of every row's set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x51, 0xA7):
        sums = np.append(U64(0), np.cumsum(mix(h ^ U64(salt)), dtype=U64))
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _info_mapper(k: int):
    def run(batches):
        for ids, data, offs in chunks(batches, CHUNK_BYTES):
            row, h, sizes = _sets(data, offs, k)
            a, b = _prints(row, h, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b)], names=["doc", "n", "fa", "fb"])

    return run


def _response(ids, sizes, tokens, ranks, n: int):
    """(document, size, shingle, count) entries as one blob per document bucket."""
    b = doc_bucket(ids, n)
    order = np.lexsort((tokens, ids, b))
    b, ids = b[order], ids[order]  # not all at once: each old array is freed before the next new one
    sizes, tokens = sizes[order], tokens[order]
    ranks = ranks[order]
    del order
    edges = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(b)]):
        yield 1, int(b[lo]), squeeze(ids[lo:hi], sizes[lo:hi], tokens[lo:hi], ranks[lo:hi])


def _batches(found):
    found = list(found)
    for at in range(0, len(found), 64):
        part = found[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _TYPES)], names=["hop", "b", "blob"])


def _rank(df: np.ndarray) -> np.ndarray:
    """Place of a count on the log scale, below _TOP."""
    return np.minimum(_TOP - 1, (STEPS * np.log2(df)).astype(np.int64))


def _token_mapper(k: int, n: int, n_docs: int):
    def run(batches):
        for ids, data, offs in chunks(batches, CHUNK_BYTES):
            row, h, sizes = _sets(data, offs, k)
            a, b = _prints(row, h, sizes)
            order = np.lexsort((np.arange(len(ids)), b, a, sizes))
            same = np.zeros(len(ids), bool)  # copies of an earlier row of the chunk
            same[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (sizes[order[1:]] == sizes[order[:-1]])
            keep = ~same[row]
            row, h = row[keep], h[keep] >> U64(64 - _HIGH)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            row, h = row[order], h[order]
            edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(edges, len(h)))
            hot = np.repeat(count >= HOT, count)
            first = np.zeros(len(h), bool)
            first[edges] = True
            if hot.any():
                yield from _batches(_response(ids[row[hot]], sizes[row[hot]], h[hot].astype(np.int64), np.full(int(hot.sum()), _TOP), n_docs))
            send = ~hot | first
            value = np.where(hot, len(ids), row)[send]
            told = listing(np.append(ids, _SUMMARY), np.append(sizes, 0))
            yield from _batches((0, x, blob) for x, blob in bucket_blobs(h[send], value, n, told, _HIGH))

    return run


def _count_hop(n_docs: int):
    """Shingles of two or more documents, told to their documents with their rank."""

    def run(table: pa.Table) -> pa.Table:
        if table["hop"][0].as_py() == 1:
            return table
        trim()
        hs, docs, sizes = [], [], []
        for raw in table["blob"].to_pylist():
            h, at, directory = open_blob(raw)
            ids, n = expand(directory)
            at = at.astype(np.int64)
            hs.append(h)
            docs.append(ids[at])
            sizes.append(n[at].astype(np.int32))
        # a bucket is held about twice at most: what is not needed any more goes at once
        h = np.concatenate(hs)
        del hs
        order = np.argsort(h, kind="stable")
        h = h[order]
        doc = np.concatenate(docs)
        del docs
        doc = doc[order]
        size = np.concatenate(sizes)
        del sizes
        size = size[order]
        del order
        summary = doc == _SUMMARY
        edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(edges, len(h)))
        hot = np.add.reduceat(summary.astype(np.int64), edges) > 0
        rank = np.repeat(np.where(hot, _TOP, _rank(many)), many)
        pick = np.repeat(hot | (many > 1), many) & ~summary
        found = _response(doc[pick], size[pick], h[pick].view(np.int64), rank[pick], n_docs)
        del doc, size, h, rank, pick, summary, edges, many, hot
        out = list(found)
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(("hop", "b", "blob"), _TYPES))})

    return run


def _doc_hop(percent: int):
    """Shared shingles of each document in the global order, if they can reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        parts = [expand(x) for x in table["blob"].to_pylist()]
        # a bucket is held about twice at most, as above
        doc, size, token, key = (np.concatenate([p.pop(0) for p in parts]) for _ in range(4))
        key <<= _HIGH
        key |= token
        del token
        order = np.lexsort((key, doc))
        doc = doc[order]
        size = size[order]
        key = key[order]
        del order
        new = np.ones(len(doc), bool)  # a document sent twice (equal rows in two tasks) counts once
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        doc = doc[new]
        size = size[new]
        key = key[new]
        edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        m = np.diff(np.append(edges, len(doc)))
        n = np.maximum.reduceat(size, edges) if len(doc) else size
        ok = 100 * m >= percent * n
        doc = doc[edges]
        key = key[np.repeat(ok, m)]
        del size
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(m[ok])).astype(np.int32)), pa.array(key))
        parity = np.zeros((int(ok.sum()), PARITY), U64)
        bit = U64(1) << (mix(key.view(U64)) >> U64(64 - 6))
        np.bitwise_xor.at(parity, (np.repeat(np.arange(int(ok.sum())), m[ok]), (mix(key.view(U64) + U64(1)) % U64(PARITY)).view(np.int64)), bit)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(parity) + 1, dtype=np.int32) * PARITY), pa.array(parity.reshape(-1).view(np.int64)))
        return pa.table({"doc": pa.array(doc[ok]), "n": pa.array(n[ok].astype(np.int64)), "keys": lists, "parity": bits})

    return run


def shared_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, n, keys, parity): documents that can have a link, with their shared shingles in the global order."""
    n, n_docs = bucket_count(docs.sparkSession, 2), bucket_count(docs.sparkSession, 1)
    blobs = docs.select("doc_id", "text").mapInArrow(_token_mapper(k, n, n_docs), _BLOB)
    told = blobs.groupBy("hop", "b").applyInArrow(_count_hop(n_docs), _BLOB)
    return told.groupBy("b").applyInArrow(_doc_hop(percent), "doc bigint, n bigint, keys array<bigint>, parity array<bigint>")


def _cuts(sets: DataFrame, fragments: int) -> list[int]:
    """Keys that cut the global order into ranges of equally many entries; inside a rank the hash is uniform."""
    ranks = sets.select(F.explode(F.expr(f"transform(keys, k -> shiftright(k, {_HIGH}))")).alias("r")).groupBy("r").count()
    counts = sorted((int(r), n) for r, n in ranks.collect())  # at most _TOP + 1 rows
    total, seen, out = sum(n for _, n in counts), 0, []
    for r, n in counts:
        while len(out) < fragments - 1 and seen + n >= total * (len(out) + 1) / fragments:
            inside = (total * (len(out) + 1) / fragments - seen) / n
            out.append((r << _HIGH) + min((1 << _HIGH) - 1, int(inside * (1 << _HIGH))))
        seen += n
    return out


def _segments(sets: DataFrame, fragments: int) -> DataFrame:
    """(doc, v, seg): the sets cut at fixed places of the global order; empty segments are left out."""
    edges = [-1, *_cuts(sets, fragments), (1 << 63) - 1]
    cut = ", ".join(f"struct({i} v, filter(keys, k -> k > {lo}L AND k <= {hi}L) seg)" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return sets.select("doc", F.explode(F.expr(f"filter(array({cut}), x -> size(x.seg) > 0)")).alias("x")).select("doc", "x.v", "x.seg")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("doc").alias("b"), "v", F.col("seg").alias("sb"))
    right = segments.select(F.col("doc").alias("a"), "v", F.col("seg").alias("sa"))
    part = pairs.join(left, "b").join(right, ["a", "v"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    return overlaps(pairs, segments).where(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b")


def _reach(percent: int, overlap: str = "least(ma, mb)"):
    """Whether at most `overlap` common shingles can make a link."""
    return F.expr(f"{100 + percent} * {overlap} >= {percent} * (na + nb)")


def _paired(rows: DataFrame) -> DataFrame:
    """(x, y) structs as a and b, the smaller document first."""
    low, high = F.when(F.col("x.doc") < F.col("y.doc"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.doc") < F.col("y.doc"), F.col("y")).otherwise(F.col("x"))
    both = rows.select(low.alias("p"), high.alias("q"))
    return both.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"), F.col("p.m").alias("ma"), F.col("q.m").alias("mb"))


def link_components(sets: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of all nodes with a link; `sets` is a written table (doc, n, keys, parity) of distinct sets."""
    segments = _segments(sets, fragments)
    # in the order a document's own shingles come first: s = n - size(keys) of them
    ceil = f"cast(ceil(n * {percent} / 100.0) as bigint)"
    first = f"slice(keys, 1, cast(greatest(n - {ceil} + 1 - (n - size(keys)), 0) as int))"
    whole = written(sets.select("doc", "n", F.size("keys").cast("bigint").alias("m"), F.explode(F.expr(first)).alias("key")))
    shared = whole.groupBy("key").count().where("count > 1").select("key")
    size = whole.count()
    prefix = written(whole.join(shared, "key"), size)
    size = prefix.count()
    tried, found, progress = None, None, True
    scratch = [whole, prefix]
    turn, last = 0, False
    while not last:
        if found is None:
            part = prefix.withColumn("c", F.col("doc"))
        else:
            part = prefix.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
        # keys whose documents are in several components; of those, documents that can reach the smallest set of the key
        split = part.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least_n"), F.count("*").alias("docs")).where("lo < hi")
        last = turn >= rounds and (turn >= MOST_ROUNDS or not progress or (split.agg(F.max("docs")).first()[0] or 0) <= SMALL)
        part = part.join(split.select("key", "least_n"), "key").where(f"{100 + percent} * m >= {percent} * (n + least_n)").drop("least_n")
        if not last:
            by = F.col("n") - F.col("m") if turn == 0 else F.xxhash64("doc", F.lit(turn))
            hub = part.groupBy("key").agg(F.min_by(F.struct("doc", "n", "m", "c"), F.struct(by, "doc")).alias("y"))
            pairs = _paired(part.join(hub, "key").where("y.c <> c").select(F.struct("doc", "n", "m", "c").alias("x"), "y"))
        else:
            part = written(part.join(sets.select("doc", "parity"), "doc"), size)
            pairs = _near_pairs(part, percent)
        pairs = pairs.where(_reach(percent)).select("a", "b", "na", "nb").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, size)
        fresh = written(_links(pairs, segments, percent), size)
        scratch += [pairs, part]
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        linked = fresh.count()
        progress = linked > 0
        if found is None or progress:
            before, found = found, components(fresh, linked) if found is None else merged(found, fresh, linked)
            discard(before)
        discard(fresh)
        release(sets.sparkSession)
        turn += 1
    discard(*scratch)
    return found


def _near_pairs(part: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ma, mb) of a key in different components that sizes and parity bitmaps let through.

    Linked sets differ in size by less than a factor of 100 / percent, so they are in one size band or in neighbouring ones, and a
    document meets only the documents of its key in three bands.  A hot key with one band is a skewed join partition, which adaptive
    execution splits on both sides.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    fields = ("doc", "n", "m", "c", "parity")
    left = part.select("key", F.explode(F.array(band - 1, band, band + 1)).alias("band"), *[F.col(c).alias(c + "a") for c in fields])
    right = part.select("key", band.alias("band"), *[F.col(c).alias(c + "b") for c in fields])
    differ = " + ".join(f"bit_count(paritya[{i}] ^ parityb[{i}])" for i in range(PARITY))
    near = (F.col("doca") < F.col("docb")) & (F.col("ca") != F.col("cb")) & _reach(percent) & _reach(percent, f"((ma + mb - ({differ})) DIV 2)")
    return left.join(right, ["key", "band"]).where(near).selectExpr("doca a", "docb b", "na", "nb", "ma", "mb")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, n, prints of every row; member of each class of equal sets; sets of the class representatives)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    infos = written(docs.mapInArrow(_info_mapper(k), "doc bigint, n bigint, fa bigint, fb bigint"))
    # one set per doc_id: the largest; it matters only where rows share doc_id
    clash = infos.groupBy("doc").agg(F.count_distinct("n", "fa", "fb").alias("x")).where("x > 1").select("doc")
    nodes = infos
    if clash.limit(1).count():
        best = infos.join(clash, "doc").groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("m"), "fa", "fb")).alias("s"))
        nodes = infos.join(clash, "doc", "left_anti").unionByName(best.selectExpr("doc", "-s.m n", "s.fa fa", "s.fb fb"))
        # texts of the chosen rows only
        chosen = _with_prints(docs, k).join(best.selectExpr("doc", "s.fa fa", "s.fb fb"), ["doc", "fa", "fb"], "left_semi")
        docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).join(clash, "doc", "left_anti").select("doc_id", "text").union(chosen.select("doc_id", "text"))
    # the smallest document of a class, per salt first: every join below has at most SALTS rows of a class on one side
    print_, salted = ["n", "fa", "fb"], nodes.where("n > 0").withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc), {SALTS}) as int)"))
    part = salted.groupBy(*print_, "salt").agg(F.min("doc").alias("low"))
    reps = part.join(part.groupBy(*print_).agg(F.min("low").alias("rep")), print_).select(*print_, "salt", "rep")
    member = written(salted.join(reps, [*print_, "salt"]).select("doc", "rep"), infos.count())
    sets = shared_sets(docs, k, percent).join(member.where("doc = rep").select("doc").distinct(), "doc", "left_semi")
    # a document may be in `member` once per equal row
    return infos, member, written(sets)


def all_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole similarity join: (links, membership).

    links (a, b, na, nb, overlap) are all linked pairs a < b of class representatives, within components too;
    membership (doc_id, rep) names the representative of every document with a shingle, and documents of one
    representative have equal sets.  Nothing is left out, so a key in many documents costs the square of their number.
    """
    _, member, sets = _classes(docs, k, percent)
    ceil = f"cast(ceil(n * {percent} / 100.0) as bigint)"
    first = f"slice(keys, 1, cast(greatest(n - {ceil} + 1 - (n - size(keys)), 0) as int))"
    prefix = written(sets.select("doc", "n", F.size("keys").cast("bigint").alias("m"), F.explode(F.expr(first)).alias("key")))
    every = prefix.join(sets.select("doc", "parity"), "doc").withColumn("c", F.col("doc"))
    pairs = _near_pairs(every, percent).select("a", "b", "na", "nb").distinct()
    links = overlaps(written(pairs), _segments(sets, FRAGMENTS)).where(f"100 * overlap >= {percent} * (na + nb - overlap)")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return links.select(real("a"), real("b"), "na", "nb", "overlap"), member.distinct().select(real("doc").alias("doc_id"), real("rep"))


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list]:
    """(doc_id, n_shingles, component_id) for every row, and the written tables that it reads."""
    infos, member, sets = _classes(docs, k, percent)
    found = link_components(sets, percent)
    discard(sets)
    component = member.distinct().join(found, member.rep == found.node, "left").select("doc", F.coalesce("component", "rep").alias("component"))
    out = infos.select("doc", "n").join(component, "doc", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc")).alias("component_id")), [infos, member, found]


def shingle_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text)."""
    return _components(docs, k, percent)[0]


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` (all columns) that are the smallest document of their component; repeated rows of it stay once each."""
    found, tables = _components(docs, k, percent)
    gone = written(found.where("NOT (doc_id <=> component_id)").select("doc_id").distinct(), tables[1].count())
    discard(*tables)
    return without(docs, gone)


def _with_prints(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                for ids, data, offs in chunks([one], CHUNK_BYTES):
                    a, b = _prints(*_sets(data, offs, k))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(ids), pa.array(a), pa.array(b)], names=["doc_id", "text", "doc", "fa", "fb"])

    return docs.mapInArrow(run, "doc_id bigint, text string, doc bigint, fa bigint, fb bigint")
