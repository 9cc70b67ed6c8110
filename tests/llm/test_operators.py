"""Corpus operators against brute force, round trips and edge cases on small fixtures."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gatewright.llm import chat, decontaminate, jaccard_join, language_id, media, mixing, pii, secrets, substring_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string"


def make(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}") for i, t in texts], DOC)


@pytest.fixture(scope="module")
def corpus():
    """Shared passages, copies, repeated rows, nulls, empty, white space and a long text."""
    random.seed(11)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß", "Ñu"]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    shared = [text(30) for _ in range(3)]
    docs = [(i, f"{text(random.randint(0, 40))} {random.choice(shared) if i % 3 == 0 else ''}\n{text(random.randint(0, 30))}") for i in range(60)]
    docs += [(60, None), (61, ""), (62, " \t\n"), (63, docs[5][1]), (64, docs[5][1]), (65, "a " * 3000), (66, docs[8][1]), (66, docs[8][1]), (67, "one"), (68, text(20)), (None, shared[0])]
    return docs


def words(t):
    return (t or "").encode().split()


# 1 ---------------------------------------------------------------- media


def test_media_round_trip(spark, corpus):
    got = media.features(media.store(make(spark, corpus))).collect()
    want = sorted((zlib.crc32(b""), t or "") for _, t in corpus)
    assert len(got) == len(want)
    by = {i: t for i, t in corpus}
    for r in got:
        raw = (by[r.doc_id] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.mime) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), "audio/wav")
    assert media.features(media.store(make(spark, []))).count() == 0


def _png():
    part = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def test_sniffing_corrects_and_carves():
    png, wav = _png(), media.store_wav(b"\x80" * 64)
    seen = media.sniff(png, "image/jpeg")
    assert (seen["type"], seen["mime"], seen["corrected"], seen["length"]) == ("png", "image/png", True, len(png))
    mixed = b"junk BM RIFF" + png + b"--" + wav
    seen = media.sniff(mixed, "text/plain")
    assert seen["type"] is None and seen["mime"] == "text/plain"
    assert seen["embedded"] == [(12, len(png), "png"), (14 + len(png), len(wav), "wav")]
    broken = png[:-5] + bytes([png[-5] ^ 1]) + png[-4:]
    assert media.sniff(broken)["type"] is None
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    assert media.sniff(gif)["length"] == len(gif) and media.sniff(gif[:-1])["type"] is None
    inner = media.sniff(media.store_wav(png + b"\0" * (len(png) % 2)))
    assert inner["type"] == "wav" and inner["embedded"][0][2] == "png"


# 2 ---------------------------------------------------------------- substring dedup


@pytest.mark.parametrize("window", [3, 20])
def test_substring_dedup_brute_force(spark, corpus, window):
    docs = sorted({(i if i is not None else -1, t) for i, t in corpus}, key=lambda x: x[0])
    first = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), (i, j))
    want = {}
    for i, t in docs:
        w, gone = words(t), set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] != (i, j):
                gone.update(range(j, j + window))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = substring_dedup.digest(make(spark, corpus).repartition(3), window).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id if r.doc_id is not None else -1]
    assert substring_dedup.digest(make(spark, [])).count() == 0


# 3 ---------------------------------------------------------------- language


def test_language_held_out(spark):
    random.seed(2)
    syll = {"xx": ["ba", "to", "ri", "ne"], "yy": ["schl", "ung", "keit", "ü"], "zz": ["ción", "oña", "ez", "lla"]}
    say = lambda k: " ".join("".join(random.choices(syll[k], k=3)) for _ in range(40))
    rows = [(i, say(k), k, "s") for i, k in enumerate(random.choices(list(syll), k=150))]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.train(docs.where("doc_id < 100"))
    odd = [(900, None, None, "s"), (901, "", None, "s"), (902, "12 !! 34", None, "s"), (903, "a", None, "s"), (904, say("xx") * 50, None, "s")]
    got = {r.doc_id: r for r in language_id.predict(docs.union(spark.createDataFrame(odd, DOC)), model).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows if i >= 100)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in syll and got[904].lang_pred == "xx"
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    kept = {r.doc_id for r in language_id.keep_known(docs.union(spark.createDataFrame(odd, DOC)), model).collect()}
    assert kept == set(range(150)) | {903, 904}
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_rare_and_many_languages_are_learned(spark):
    random.seed(4)
    syll = {f"l{i:02d}": ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)] for i in range(70)}
    say = lambda k: " ".join("".join(random.choices(syll[k], k=2)) for _ in range(30))
    common = [(i, say("l00"), "l00", "s") for i in range(1500)]
    rare = [(2000 + 2 * i + j, say(k), k, "s") for i, k in enumerate(sorted(syll)[1:]) for j in range(2)]
    docs = spark.createDataFrame(common + rare, DOC)
    model = language_id.train(docs, 20)
    assert model["langs"] == sorted(syll) and model["common"] == "l00" and model["rows"].shape[1] == 2
    fresh = spark.createDataFrame([(9000 + i, say(k), k, "s") for i, k in enumerate(sorted(syll))], DOC)
    assert all(r.lang_pred == r.lang for r in language_id.predict(fresh, model).collect())
    assert language_id.keep_known(fresh, model).count() == 70


# 4 ---------------------------------------------------------------- mixing


def _bounded_fit(rows, goals, total, sweeps=3000):
    """Plain iterative proportional fitting of p = min(1, w), by loops; goals are shares of `total` tokens."""
    w = {r[:3]: 1.0 for r in rows}
    n = {r[:3]: r[3] for r in rows}
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            sums = defaultdict(float)
            for k in w:
                sums[k[d]] += n[k] * min(1.0, w[k])
            for k in w:
                w[k] *= goal[k[d]] * total / sums[k[d]]
    return {k: min(1.0, x) for k, x in w.items()}


@pytest.mark.parametrize("budget", [0.05, 0.4])
def test_raking_meets_targets(spark, budget):
    random.seed(4)
    rows = [(a, b, c, random.randint(10, 900)) for a in range(3) for b in range(2) for c in range(2)]
    sources, langs, topics = {"s0": 0.5, "s1": 0.3, "s2": 0.2}, {"en": 0.7, "de": 0.3}, {"p": 0.4, "q": 0.6}
    cells = spark.createDataFrame(rows, "s int, l int, t int, tokens long")
    got = mixing.raked(cells, sources, langs, topics, budget).collect()
    total = sum(r[3] for r in rows)
    beta = got[0].beta
    assert beta <= budget and (budget > 0.05 or beta == budget) and all(r.miss <= mixing.TOLERANCE and 0 <= r.p <= 1 for r in got)
    want = _bounded_fit(rows, [list(x.values()) for x in (sources, langs, topics)], beta * total)
    assert len(got) == len(rows)
    for r in got:
        assert r.p == pytest.approx(want[r.s, r.l, r.t], abs=0.02)
    assert sum(r.tokens * r.p for r in got) == pytest.approx(beta * total, rel=3e-3)
    for d, x in enumerate((sources, langs, topics)):
        for k, share in enumerate(x.values()):
            assert sum(r.tokens * r.p for r in got if r[d] == k) / (beta * total) == pytest.approx(share, abs=2e-3)


def test_budget_is_lowered_where_targets_need_it(spark):
    cells = spark.createDataFrame([(0, 0, 0, 900), (1, 0, 0, 100)], "s int, l int, t int, tokens long")
    got = {r.s: r for r in mixing.raked(cells, {"a": 0.5, "b": 0.5}, {}, {}, 0.9).collect()}
    assert got[0].beta == pytest.approx(0.2) and got[0].p == pytest.approx(1 / 9, rel=1e-2) and got[1].p == pytest.approx(1.0, rel=1e-2)


@pytest.mark.parametrize("sf, most", [("sf0.1", 0.01)])
def test_realised_shares_meet_targets(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    told = mixing.margins(docs).collect()
    assert 0.05 < told[0].budget <= mixing.BUDGET
    kept = mixing.mix(docs).persist()
    total = kept.agg({"tokens": "sum"}).first()[0]
    real = {(name, r[0]): r[1] / total for name, col in (("source", "source"), ("language", "lang"), ("topic", "topic_group")) for r in kept.groupBy(col).agg({"tokens": "sum"}).collect()}
    kept.unpersist()
    seen = 0
    for r in told:
        if r.planned is not None:
            # targets without documents leave their part to the others
            absent = sum(x.target for x in told if x.dimension == r.dimension and x.planned is None)
            assert r.planned == pytest.approx(r.target / (1 - absent), abs=1e-3)
            assert r.realised == pytest.approx(real[r.dimension, r.value], abs=1e-9) and abs(r.realised - r.planned) < most
            seen += 1
    assert seen == 20 + 4 + 4


def test_mixing_edges(spark, corpus):
    docs = make(spark, corpus)
    kept = mixing.mix(docs, {"src0": 0.5, "src1": 0.5}, {}, {}, budget=0.5).collect()
    assert kept and {r.source for r in kept} <= {"src0", "src1"} and all(r.tokens > 0 and 0 < r.probability <= 1 and r.mix_weight > 0 for r in kept)
    by = {i: t for i, t in corpus}
    assert all(r.tokens == len(words(by[r.doc_id])) for r in kept)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.margins(docs.limit(0)).where("planned is not null").count() == 0
    clash = docs.selectExpr("*", "doc_id + 1 tokens", "'x' probability", "'y' topic", "'z' s", "1 u", "2 cut")
    got = mixing.mix(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "tokens_in", "probability_in", "topic", "s", "u", "cut", "tokens", "topic_group", "probability", "mix_weight"]
    rows = got.collect()
    assert rows and all(r.probability_in == "x" and r.topic == "y" and (r.doc_id is None or r.tokens_in == r.doc_id + 1) for r in rows)
    plain = mixing.mix(docs).select("doc_id").collect()
    assert sorted(map(str, plain)) == sorted(str(x) for x in got.select("doc_id").collect())
    twice = mixing.mix(docs.union(docs)).groupBy("doc_id").count().collect()
    copies = defaultdict(int)
    for i, _ in corpus:
        copies[i] += 2
    assert twice and all(r["count"] == copies[r.doc_id] for r in twice)  # repeated rows stay together
    assert {r.topic_group for r in mixing.mix(clash, {}, {}, {"y": 1.0}, topic_column="topic").collect()} == {"y"}


# 5 ---------------------------------------------------------------- personal data

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_equal_patterns():
    random.seed(6)
    parts = ["a@b.c", "x.y@q.com.", "@", "..", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "+", "-", " ", "é", "12", "abc", "\n", ".", "b-c.d@e"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        want = sorted((m.start(), list(_PII).index(k), m.end()) for k, p in _PII.items() for m in re.finditer(p, t) if _good(k, m[0]))
        assert [(lo, pii.KINDS.index(k), hi) for lo, hi, k in pii.base_spans(t)] == want, t


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "+1" + " " * 200_000, "1." * 100_000, "4 " * 100_000):
        pii.base_spans(t)
        secrets.base_spans(t)


def test_repeated_data_gets_its_label(spark):
    text = "call +1 (743) 555-3824 now. later 555-3824 again and 777-1111."
    docs = make(spark, [(i, f"mail a{i}@b.com or +1 (74{i}) 555-382{i} x") for i in range(9)] + [(50, text), (51, None), (52, ""), (53, "clean text 12")])
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    at = text.index("555-3824 again")
    assert f"phone:{at}:{at + 8}" in got[50].spans.split(",") and got[50].n_phone == 1 and "777" not in got[50].spans
    assert got[51].spans == got[52].spans == got[53].spans == ""
    out = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert out[50] == "call <phone> now. later <phone> again and 777-1111." and out[51] is None and out[53] == "clean text 12"
    assert pii.find(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("k", [1, 2, 5, 50, 400])
def test_every_repeat_gets_the_label(k, first):
    model = {"shapes": {}, "rare": np.full(5, -np.log(5)), "step": np.zeros((5, 5)), "skip": {"same": 2.0, "alike": 2.0}}
    known, repeats = ["card 4111-1111-1111-1111 seen"], ["then 4111.1111.1111.1111 and 4111/1111/1111/1111 of id 7771111"] * k
    text = " ; ".join(known + repeats if first else repeats + known)
    base, spans = pii.all_spans(text, model)
    assert len(base) == 1
    assert sorted(text[lo:hi] for lo, hi, _ in spans) == ["4111-1111-1111-1111"] + ["4111.1111.1111.1111"] * k + ["4111/1111/1111/1111"] * k
    assert {x[2] for x in spans} == {"card"}


def test_unlikely_repeat_does_not_outvote():
    shapes = {"999+": np.array([0.0, -9, -9, -9, -9])}
    model = {"shapes": shapes, "rare": np.full(5, -np.log(5)), "step": np.zeros((5, 5)), "skip": {"same": 2.0, "alike": 2.0}}
    text = "call +1 (743) 555-3824 now, " + "again 555-3824 x, " + "number 5553824 x, " * 9
    assert [text[lo:hi] for lo, hi, _ in pii.all_spans(text, model)[1]] == ["+1 (743) 555-3824", "555-3824"]


def test_ties_are_linear():
    text = "ip 10.1.2.3 " + "or 10-1-2-3 x 555-382444 y " * 2000
    toks = pii.tokens(text, pii.base_spans(text))
    assert len(pii.ties(toks, {"same": 2.0, "alike": 2.0})[1]) <= 2 * len(toks)


# 6 ---------------------------------------------------------------- Jaccard join


def test_components_brute_force(spark):
    random.seed(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[random.choice(vocab) for _ in range(100)] for _ in range(3)]
    docs = []
    for i in range(120):
        b = list(random.choice(base))
        for _ in range(random.randint(0, 6)):
            b[random.randrange(len(b))] = random.choice(vocab)
        docs.append((i, " ".join(b[: random.randint(60, 100)] if random.random() < 0.2 else b)))
    docs += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (None, "x y z"), (1004, docs[3][1]), (1005, docs[3][1]), (1005, docs[3][1])]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    s = {(-1 if i is None else i): shingles(t) for i, t in docs}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(s):
        for b in sorted(s):
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = jaccard_join.shingle_components(make(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(s[r.doc_id]), find(r.doc_id))
    kept = {r.doc_id for r in jaccard_join.drop_near_duplicates(make(spark, docs)).collect()}
    assert kept == {(None if i == -1 else i) for i in s if find(i) == i}
    assert jaccard_join.shingle_components(make(spark, [])).count() == 0


def test_all_links_brute_force(spark):
    random.seed(13)
    base = [[f"v{random.randrange(400)}" for _ in range(40)] for _ in range(5)]
    docs = []
    for i in range(60):
        w = list(base[i % 5])
        for _ in range(i // 5 % 4):
            w[random.randrange(len(w))] = f"u{random.randrange(9)}"
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (None, docs[7][1] + " tail"), (105, docs[7][1])]
    s = {}
    for i, t in docs:
        w = (t or "").lower().split()
        s[-1 if i is None else i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    want = {(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])}
    links, membership = jaccard_join.all_links(make(spark, docs))
    fix = lambda x: -1 if x is None else x
    reps = defaultdict(list)
    for m in membership.collect():
        reps[fix(m.rep)].append(fix(m.doc_id))
    got = {(a, b) for ds in reps.values() for a in ds for b in ds if a < b}
    for x in links.collect():
        assert x.overlap == len(s[fix(x.a)] & s[fix(x.b)])
        got |= {tuple(sorted((p, q))) for p in reps[fix(x.a)] for q in reps[fix(x.b)]}
    assert got == want and len(want) > 50


# 7 ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    random.seed(7)
    plain = ["".join(random.choices("abdeilnorst", k=random.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = random.choices(plain, k=40)
        for _ in range(3 if bad else 0):
            w.insert(random.randrange(40), random.choice(["grobian", "schurke", "fiesling"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = make(spark, rows + [(900, None), (901, "")])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD, bool(y)) for i, y in labels if i % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and not any(p and not y for p, y in held)
    assert got[900] == got[901] < 0.5
    flat = toxicity.train(docs, marks.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}


# 8 ---------------------------------------------------------------- chat


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|end|>\n", "<\\|end|>", "<<SYS>> <</SYS>>", "<", "[", "[\\\\INST]", "<|user|>\nx<|end|>\n", "a<", "é[/INST]<s>"])
@pytest.mark.parametrize("role", ["user", "a|b", "x\n<|end|>", ""])
def test_template_is_reversible(text, role):
    one = chat.render(role, text) + chat.render("assistant", "y")
    back = chat.read_back(one)
    assert [(r, t) for r, t, _, _ in back] == [(role, text), ("assistant", "y")]
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", one)
    assert "y" == "".join(one[a:b] for a, b in chat.loss_spans(one)) or role == "assistant"


def test_layouts_are_recognised():
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a", "input": None},
    ):
        assert chat.to_turns(record) == want
    assert chat.to_turns({"instruction": "do", "input": "x", "output": "a"})[0] == ("user", "do\n\nx")
    assert chat.to_turns({"foo": 1}) is None and chat.to_turns([]) is None


def test_conversation_digest(spark):
    rows = [(1, 1, {"role": "assistant", "text": "b</s>"}), (1, 0, {"role": "user", "text": "a"}), (2, None, {"role": "user", "text": None}), (3, 0, {"x": 1})]
    import json

    records = spark.createDataFrame([(c, t, json.dumps(r)) for c, t, r in rows], "conv_id long, turn long, record string")
    got = {r.conv_id: r for r in chat.digest(chat.format_records(records)).collect()}
    assert set(got) == {1, 2} and got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, hashlib.sha256(b"b</s>").hexdigest()) and got[2].loss_chars == 0


# 9 ---------------------------------------------------------------- decontamination


def test_decontamination_brute_force(spark, corpus):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: find((t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, corpus[0][1]), (10, "W1 w2, É"), (11, None), (12, "!!"), (13, "one"), (14, "a " * 15), (2, corpus[3][1] + " tail")]
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    docs = make(spark, corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(docs, bench).collect()
    assert len(got) == len(corpus)  # a row for every row, repeated ones too
    by = {i: t for i, t in corpus}
    for r in got:
        w, hit, seen = low(by[r.doc_id]), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    seen |= windows[tuple(w[p : p + n])]
        assert tuple(r)[1:] == (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit))
    clean = {r.doc_id for r in got if not r.contaminated}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == clean
    assert decontaminate.digest(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.digest(docs.limit(0), bench).count() == 0


# 10 --------------------------------------------------------------- secrets

_SECRET = {
    "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def test_secret_patterns():
    random.seed(8)
    parts = ["token", "ToKen", "password", "api_key", "ſecret", " = ", ":", '"', "'", "abc123DEF456xyz", "AKIA", "ABCDEFGHIJKLMN12", "0123456789abcdef", "de", " ", "short", "\n"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 8)))
        want = []
        for k, p in _SECRET.items():
            for m in re.finditer(p, t):
                if (k == "assign" and len(m[2]) >= 12) or (k == "access" and len(m[0]) >= 18) or (k == "hex" and len(m[0]) >= 16):
                    want.append((m.start(), secrets.KINDS.index(k), m.end()))
        assert [(lo, secrets.KINDS.index(k), hi) for lo, hi, k in secrets.base_spans(t)] == sorted(want), t


def test_random_strings_are_added(spark):
    random.seed(9)
    noise = lambda n: "".join(random.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=n))
    name = lambda: "_".join(random.choice(["get", "user", "config", "value", "handler", "request", "session"]) for _ in range(4))
    docs = make(spark, [(i, f"{name()} token = {noise(32)} {name()}") for i in range(200)] + [(500, f"see {noise(40)} here {name()}"), (501, None), (502, name())])
    got = {r.doc_id: r for r in secrets.find(docs, secrets.train(docs.where("doc_id < 300"))).collect()}
    assert got[500].spans == "random:4:44" and got[501].spans == got[502].spans == "" and got[3].n_assign == 1


def test_distances_are_compressed_lengths():
    import zstandard

    books = (b" scum trash common text " + toxicity.ANCHOR, b" quiet words common text " + toxicity.ANCHOR)
    scorer = toxicity.Scorer(books)
    text = "You scum, trash talk and common text é " * 3 + "x" * 500 + "汉" * 300
    cut = list(toxicity.windows(text, toxicity.WINDOW_BYTES))
    whole = toxicity.normal(text).encode()
    at = 0
    for w in cut:  # windows cover the whole text, one byte in common, and unspaced runs are cut too
        assert whole[at : at + len(w)] == w and len(w) <= 2 * toxicity.WINDOW_BYTES + 1
        at += len(w) - 1
    assert at == len(whole) - 1
    plain = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=toxicity.PARAMS) for b in books]
    want = [len(plain[1].compress(toxicity.ANCHOR + w)) - len(plain[0].compress(toxicity.ANCHOR + w)) for w in cut]
    assert scorer.distances(text).tolist() == want and max(want) > 0
    n = np.expm1(scorer.features(text)[: len(toxicity.STEPS)])
    assert n.tolist() == pytest.approx([sum(x >= t if t > 0 else x <= t for x in want) for t in toxicity.STEPS])


def test_toxicity_edges(spark):
    rows = [(i, f"gentle text number {i} " * 20 + (" vermin filth " * 3 if i % 3 == 0 else "")) for i in range(90)]
    docs = make(spark, rows + [(7, rows[7][1]), (None, "vermin filth"), (95, None)])
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(4, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.withColumn("toxic", docs.text), marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 93 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs.limit(0), marks.limit(0))).collect()} == {0.0}


# shared ------------------------------------------------------------ dropping by id, samples, scratch tables


def test_without_grows_with_the_ids(spark):
    from gatewright.llm import prune

    n = (1 << 20) + 200_000
    ids = spark.range(n).selectExpr("id * 3 x")
    docs = spark.range(4 * n).selectExpr("id doc_id", "'t' text", "id __text").union(spark.sql("SELECT cast(null AS bigint), 'n', 0L"))
    far, near = prune.split_by_ids(docs, ids)
    asked = near.count()
    assert far.count() + asked == 4 * n + 1
    assert n <= asked <= n + 0.05 * 4 * n  # a few documents more than those to drop are looked at
    kept = prune.without(docs, ids)
    assert kept.columns == docs.columns and kept.count() == 3 * n + 1 and kept.where(f"doc_id % 3 = 0 AND doc_id < {3 * n}").count() == 0
    gone = prune.without(docs.limit(50).union(docs.where("doc_id is null")), spark.sql("SELECT cast(null AS bigint) x"))
    assert gone.count() == 50


def test_without_beyond_the_filter(spark, monkeypatch):
    from gatewright.llm import prune

    monkeypatch.setattr(prune, "MOST_BITS", 1 << 10)
    docs = spark.range(100).selectExpr("id doc_id", "id % 7 k")
    assert sorted(r.doc_id for r in prune.without(docs, spark.range(0, 100, 2)).collect()) == list(range(1, 100, 2))


def test_samples_are_bounded_in_rows(spark):
    from gatewright.llm import sampling

    docs = spark.createDataFrame([(7, f"t{i}") for i in range(3000)] + [(i, "u") for i in range(100, 130)] + [(None, "x")], "doc_id long, text string")
    rows = sampling.bounded_sample(docs, 10, "text").collect()
    assert len(rows) == 10 and len({r.doc_id for r in rows}) == 10
    assert rows and sorted(rows) == sorted(sampling.bounded_sample(docs.repartition(5), 10, "text").collect())
    assert sampling.bounded_sample(docs.limit(0), 10, "text").count() == 0


def test_scratch_needs_a_shared_folder(spark, tmp_path):
    from gatewright.llm import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    table = storage.written(spark.range(5).toDF("x"))
    path = table._gatewright_path.removeprefix("file://").removeprefix("file:")
    import os

    assert table.count() == 5 and os.path.isdir(path)
    storage.discard(table, None, spark.range(1))
    assert not os.path.exists(path)


# 1, more ------------------------------------------------------------ formats


def _ogg_page(last, body=b"x" * 20):
    head = b"OggS\0" + bytes([4 if last else 0]) + b"\0" * 16 + b"\0\0\0\0" + bytes([1, len(body)])
    crc = 0
    for c in head + body:  # bit by bit
        crc ^= c << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _bits_crc(part, poly, width):
    crc = 0
    for c in part:
        crc ^= c << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc >> (width - 1) else crc << 1) & ((1 << width) - 1)
    return crc


def _flac(frames, total):
    info = struct.pack(">HH", 192, 192) + b"\0" * 6 + (44100 << 44 | 0 << 41 | 15 << 36 | total).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + b"\x80\0\0\x22" + info
    for k in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([k])
        frame = head + bytes([_bits_crc(head, 0x07, 8)]) + b"\x00" + bytes([17 * k & 255, 3]) * 5
        out += frame + struct.pack(">H", _bits_crc(frame, 0x8005, 16))
    return out


def test_flac_ends_with_its_frames():
    for frames, total in ((3, 3 * 192), (3, 0), (1, 192)):
        flac, wav = _flac(frames, total), media.store_wav(b"\x80" * 64)
        seen = media.sniff(flac + (wav if total else b""), "audio/wav")
        assert (seen["type"], seen["length"]) == ("flac", len(flac))
        assert [x[2] for x in seen["embedded"]] == (["wav"] if total else [])
    broken = bytearray(_flac(3, 3 * 192))
    broken[60] ^= 1
    assert media.sniff(bytes(broken))["type"] is None


def test_ogg_pages_are_checked():
    ogg = _ogg_page(False) + _ogg_page(True)
    assert media.sniff(b"--" + ogg + b"rest")["embedded"] == [(2, len(ogg), "ogg")]
    broken = ogg[:-1] + b"y"
    assert media.sniff(broken)["type"] is None


def test_mp4_and_jpeg():
    box = lambda tag, body: struct.pack(">I4s", 8 + len(body), tag) + body
    mp4 = box(b"ftyp", b"isom") + box(b"free", b"") + box(b"mdat", b"12345")
    assert media.sniff(mp4)["length"] == len(mp4) and media.sniff(b"ab" + mp4 + b"\xff")["embedded"] == [(2, len(mp4), "mp4")]
    assert media.sniff(box(b"ftyp", b"isom") + box(b"free", b"1"))["type"] is None
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03c12\xff\0 3\xff\xd9"
    assert media.sniff(jpeg, "image/png")["length"] == len(jpeg) and media.sniff(jpeg[:-1])["type"] is None


def test_many_heads_are_linear():
    import time

    def took(n):
        began = time.perf_counter()
        media.sniff(b"GIF89a" * n + b"!\xfe\x01a" * n)
        media.sniff((b"GIF89a" + b"\0" * 7 + b"!\xfe\x06GIF89a\0") * n)
        media.sniff((struct.pack(">I4s", 8, b"ftyp")) * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 40 * max(took(1000), 0.01)


def test_media_features_brute_force(spark, corpus):
    import wave
    from io import BytesIO

    by = {i: t for i, t in corpus}
    for r in media.features(media.store(make(spark, corpus).selectExpr("*", "1 media", "'x' declared"))).collect():
        raw = (by[r.doc_id] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.store_wav(p)
        with wave.open(BytesIO(stored)) as w:  # the standard library reads the samples back
            assert w.readframes(w.getnframes()) == p and w.getsampwidth() == 1
        rise = sum(y > x for x, y in zip(p, p[1:]))
        assert (r.media_bytes, r.media_sha256, r.n_embedded) == (len(stored), hashlib.sha256(stored).hexdigest(), 0)
        assert r.feature == f"wav:16000:min={min(p)}:max={max(p)}:sum={sum(p)}:rise={rise}"


# 5, more ------------------------------------------------------------ messages


def _marginals(toks, model):
    """Exact labels by enumeration of all labellings of the tokens without one."""
    import itertools

    pull, links = pii.ties(toks, model["skip"])
    free = [i for i, t in enumerate(toks) if not t[3]]
    labels = [pii.LABELS.index(t[3]) if t[3] else 0 for t in toks]
    mass = np.zeros((len(toks), 5))
    for tried in itertools.product(range(5), repeat=len(free)):
        y = list(labels)
        for i, v in zip(free, tried):
            y[i] = v
        e = sum(pull[i, y[i]] for i in free)
        for i in free:
            seen = model["shapes"].get(pii._shape(toks[i][2]), model["rare"])
            seen = seen - seen.max()
            e += min(seen[y[i]], -pii.UNMATCHED) if y[i] else 0.0
        e += sum(model["skip"][how] for i, j, how in links if y[i] == y[j])
        e += sum(model["step"][y[i], y[i + 1]] for i in range(len(toks) - 1) if toks[i + 1][4] == toks[i][4] + 1)
        for i in free:
            mass[i, y[i]] += np.exp(e)
    return [None if t[3] or not mass[i].argmax() else pii.LABELS[mass[i].argmax()] for i, t in enumerate(toks)]


def test_messages_agree_with_enumeration():
    random.seed(17)
    pieces = ["+1 (743) 555-3824", "555-3824", "5553824", "a@b.com", "4111 1111 1111 1111", "4111111111111112", "10.1.2.3", "10-1-2-3", "777-1111x", "no", "id 12"]
    seen = 0
    for k in range(400):
        rng = np.random.default_rng(k)
        model = {"shapes": {}, "rare": rng.normal(0, 1, 5), "step": rng.normal(0, 0.5, (5, 5)), "skip": {"same": 1.9, "alike": 1.4}}
        text = " ".join(random.choice(pieces) for _ in range(7))
        toks = pii.tokens(text, pii.base_spans(text))
        free = sum(not t[3] for t in toks)
        if toks and free <= 5:
            got = pii.infer(toks, model)
            if pii.ties(toks, model["skip"])[0].any():
                assert got == _marginals(toks, model), text
                seen += 1
    assert seen > 20


def test_fitted_weights_follow_the_labels():
    none, same = "5" * 2 + "0" * 10, "5" * 2 + "00003" + "00000"
    model = pii.fit([("999-9999", none + "0", 400), ("999-9999", same + "4", 300), ("aaa", none + "0", 50)])
    assert model["skip"]["same"] > pii.SKIP_PRIOR and model["shapes"]["999-9999"][0] > model["shapes"]["999-9999"][4] > model["shapes"]["999-9999"][1]
    apart = pii.fit([("999-9999", same + "0", 300)])
    assert apart["skip"]["same"] < pii.SKIP_PRIOR
    assert pii.fit([])["skip"] == {"same": pii.SKIP_PRIOR, "alike": pii.SKIP_PRIOR}


def test_long_tokens_are_read_whole():
    assert pii._shape("9" * 20 + "x" * 4000 + "-1") != pii._shape("9" * 20 + "x" * 4000 + "-x") and pii._shape("a-9" * 50 + "b") != pii._shape("a-9" * 50 + "9")
    text = "x" * 10 + ",".join(f"10.1.2.{i}" for i in range(30))
    toks = pii.tokens(text, pii.base_spans(text))
    assert len(toks) == 1 and toks[0][3] == "ip"


# 10, more ----------------------------------------------------------- models


def test_ratios_brute_force(spark):
    random.seed(23)
    noise = lambda n: "".join(random.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=n))
    name = lambda: "_".join(random.choice(["get", "user", "config", "value", "handler", "request"]) for _ in range(4))
    rows = [(i, f"{name()} token = {noise(24)} {name()}.{name()} ..{noise(3)}") for i in range(80)] + [(500, f"key {noise(13)} dot {noise(8)}.{noise(8)} end. {name()}")]
    model = secrets.train(make(spark, rows[:-1]))
    pairs = np.zeros((2, secrets.SYMBOLS, secrets.SYMBOLS))
    code = lambda c: secrets.ALPHABET.find(c) if c in secrets.ALPHABET else len(secrets.ALPHABET)
    token = re.compile(r"[A-Za-z0-9+/_=.-]+")
    for _, t in rows[:-1]:
        spans = [(m.start(), m.end(), m[2]) for m in re.finditer(_SECRET["assign"], t) if len(m[2]) >= 12]
        assert not re.search("AKIA|[0-9a-f]{16}", t)
        values = [(1, v) for _, _, v in spans]
        for m in token.finditer(t):
            w = m[0].strip(".")
            at = m.start() + m[0].index(w) if w else 0
            if len(w) >= 12 and not any(lo < at + len(w) and at < hi for lo, hi, _ in spans):
                values.append((0, w))
        for secret, v in values:
            for a, b in zip(v, v[1:]):
                pairs[secret, code(a), code(b)] += 1
    plain, secret = pairs
    unigram = (plain.sum(0) + 0.5) / (plain.sum() + 0.5 * secrets.SYMBOLS)
    want = np.log((secret + 50 / secrets.SYMBOLS) / (secret.sum(1, keepdims=True) + 50)) - np.log((plain + 500 * unigram) / (plain.sum(1, keepdims=True) + 500))
    assert np.allclose(model["table"], want)
    got = {r.doc_id: r.spans.split(",") for r in secrets.find(make(spark, rows), model).collect()}
    t = rows[-1][1]
    for m in token.finditer(t):
        w = m[0].strip(".")
        score = sum(want[code(a), code(b)] for a, b in zip(w, w[1:])) / (len(w) - 1 + secrets.SHRINK) if len(w) >= 12 else -9
        assert (f"random:{m.start()}:{m.start() + len(w)}" in got[500]) == (score > model["threshold"])
    assert sum(x.startswith("random") for x in got[500]) == 2


def test_secret_edges(spark):
    docs = make(spark, [(1, "token = abcDEF123456789"), (1, "token = abcDEF123456789"), (2, None), (None, ""), (3, "." * 5000 + "a" * 12)])
    clash = docs.selectExpr("*", "'x' spans", "1 n_hex")
    model = secrets.train(clash)
    rows = secrets.find(clash, model).collect()
    assert len(rows) == 5 and sum(r.n_assign for r in rows) == 2 and len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert secrets.find(docs.limit(0), secrets.train(docs.limit(0))).count() == 0
    secrets.all_spans("." * 300_000, model)
