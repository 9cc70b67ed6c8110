"""Every operator and every pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest

from gatewright.llm import decontaminate, jaccard_join, language_id, media, pii, secrets, substring_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASH = ["doc", "n", "row", "s", "l", "t", "u", "p", "hop", "b", "blob", "tokens", "items", "spans", "lo", "hi", "ws", "h", "f", "score", "lang_pred", "held_out", "starts", "ends", "keys", "media", "toxic", "salt", "rep", "component", "node", "shape", "doc_key", "topic_group", "head", "value"]


def rows():
    random.seed(31)
    say = lambda n: " ".join(random.choice(["alpha", "beta", "gamma", "delta", "Straße", "été", "42"]) for _ in range(n))
    out = [(i, f"{say(30)} mail x{i}@y.org token = {'aZ9' * 6} {say(i)}", ("en", "de", None)[i % 3], f"src{i % 4}") for i in range(40)]
    out += [(100, None, "en", None), (101, "", None, "src1"), (102, " \n\t", "en", "src2"), (103, "x" * 300_000, "de", "src3"), (104, "word " * 60_000, "en", "src0"), (105, "²½Ⅷ 12 --", "en", "src1")]
    out += [out[3], out[3], (out[4][0], "another text with the same id", "en", "src0"), (None, out[5][1], "en", "src1"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, rows()[7][1]), (1, rows()[7][1]), (2, None), (None, "Straße"), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(5, None), (None, 1)], "doc_id long, toxic int")


def run(name, docs, bench, labels):
    return {
        "media": lambda: media.features(media.store(docs)),
        "substring": lambda: substring_dedup.digest(docs),
        "language": lambda: language_id.predict(docs, language_id.train(docs)).select("doc_id", "lang_pred", "lang_score"),
        "pii": lambda: pii.find(docs, pii.train(docs)),
        "jaccard": lambda: jaccard_join.shingle_components(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "decontaminate": lambda: decontaminate.digest(docs, bench),
        "secrets": lambda: secrets.find(docs, secrets.train(docs)),
    }[name]()


NAMES = ["media", "substring", "language", "pii", "jaccard", "toxicity", "decontaminate", "secrets"]


def told(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_clashes(name, docs, bench, labels):
    plain = run(name, docs, bench, labels)
    got = told(plain)
    assert len(got) == len(rows())  # a row for every row, whatever it holds
    wide = docs.selectExpr("*", *[f"'{c}' `{c}`" for c in CLASH if c not in docs.columns])
    marked = labels.selectExpr("*", "'x' text", "1 n")
    items = bench.selectExpr("*", "'x' doc_id", "2 n", "'y' win")
    assert told(run(name, wide, items, marked)) == got
    assert told(run(name, docs.repartition(5), bench, labels)) == got  # nothing depends on the order of rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, docs, bench, labels):
    assert run(name, docs.limit(0), bench.limit(0), labels.limit(0)).count() == 0
    assert run(name, docs.limit(0), bench, labels).count() == 0
    assert run(name, docs.where("text IS NULL"), bench.limit(0), labels.limit(0)).count() == 2


def test_letters_are_unicode_letters(docs, bench, labels):
    got = {r.doc_id: r for r in run("language", docs, bench, labels).collect()}
    assert got[105].lang_pred == "und" and got[105].lang_score == 0


def test_columns_of_predictions_are_not_lost(docs):
    wide = docs.selectExpr("*", "'mine' lang_pred", "7 lang_score")
    got = language_id.predict(wide, language_id.train(wide))
    assert {(r.lang_pred_in, r.lang_score_in) for r in got.collect()} == {("mine", 7)}


def test_language_ties_go_to_the_first(spark):
    rows_ = [(i, "same words here again", ("bb", "aa")[i % 2], "s") for i in range(40)]
    tied = spark.createDataFrame(rows_, DOC)
    assert {r.lang_pred for r in language_id.predict(tied, language_id.train(tied)).collect()} == {"aa"}


def test_popcounts_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    random.seed(3)
    syll = {"xx": ["ba", "to", "ri"], "yy": ["schl", "ung", "keit"]}
    say = lambda k, n=30: " ".join("".join(random.choices(syll[k], k=3)) for _ in range(n))
    train = [(i, say(k), k, "s") for i, k in enumerate(["xx", "yy"] * 40)]
    model = language_id.train(spark.createDataFrame(train, DOC))

    def grams(t):
        b = bytearray((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in t.encode())
        return [bytes(b[i : i + 4]) for i in range(len(b) - 3) if b[i : i + 4].count(32) <= 1]

    counts = {k: {} for k in syll}
    for _, t, k, _ in train:
        for g in grams(t):
            counts[k][g] = counts[k].get(g, 0) + 1
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    known = {k: {g for g, r in rate[k].items() if r >= language_id.MIN_RATE and r >= language_id.SHARE * max(rate[x].get(g, 0) for x in syll)} for k in syll}
    texts = [say("xx", 9), say("yy", 9), say("xx", 5) + " " + say("yy", 5), "zzzz qqqq"]
    lang, score, n = language_id.classify(pa.array(texts), model)
    for t, found, s, size in zip(texts, lang, score, n):
        g = grams(t)
        assert size == len(g)
        share = {k: sum(x in known[k] for x in g) / len(g) for k in syll}
        assert abs(max(share.values()) - s) < 0.02  # apart from false positives, which the correction takes out on average
        if max(share.values()) - min(share.values()) > 0.1:
            assert found == max(share, key=share.get)
    assert np.all(model["false"] < 0.01)


def test_role_names_of_rows_are_kept():
    from gatewright.llm import chat

    assert chat.to_turns({"role": "gpt", "text": "x", "turn": 1}) == [("gpt", "x")] and chat.to_turns({"role": "human", "text": None}) == [("human", "")]
    assert chat.to_turns({"conversations": [{"from": "gpt", "value": "x"}]}) == [("assistant", "x")]


def test_chat_edges(spark):
    import hashlib
    import json

    from gatewright.llm import chat

    made = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "a"), (2, None, None, None), (3, 1, "assistant", "é" * 200_000)]
    records = spark.createDataFrame([(c, t, json.dumps({"turn": t, "role": r, "text": x, "extra": {"role": 1}})) for c, t, r, x in made], "conv_id long, turn long, record string")
    wide = records.selectExpr("*", "'x' formatted", "true unknown")
    got = {r.conv_id: r for r in chat.digest(chat.format_records(wide)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"bot\na\nuser\na\nuser\na\n").hexdigest()  # ties by role and text
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[3].loss_chars == 200_000
    assert chat.digest(chat.format_records(records.limit(0))).count() == 0


def test_salted_join_of_many_windows(spark, docs, bench, monkeypatch):
    want = told(decontaminate.digest(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    assert told(decontaminate.digest(docs, bench)) == want


def test_one_hot_class_and_unlinked_hot_shingles(spark):
    random.seed(41)
    shared = " ".join(f"common{i}" for i in range(6))  # two shingles that all the short texts share
    texts = ["copy of one text that many documents have word for word"] * 400
    texts += [f"{shared} {' '.join(f'w{random.randrange(10**6)}' for _ in range(random.randint(1, 9)))}" for _ in range(150)]
    made = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOC).repartition(7)
    got = {r.doc_id: r.component_id for r in jaccard_join.shingle_components(made).collect()}
    shingles = [frozenset(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(399, len(texts)):
        for b in range(a + 1, len(texts)):
            if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert all(got[i] == (0 if i < 400 else find(i)) for i in range(len(texts)))


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, docs, stage, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, rows()[7][1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, step = pipeline.STAGES[stage]
    wide = docs.selectExpr("*", "cast(length(text) as int) n_chars", *[f"'{c}' `{c}`" for c in CLASH if c not in docs.columns])
    got = step(spark, wide, str(tmp_path))
    kept = got.collect()
    if stage < 4:
        assert got.columns == wide.columns and 0 < len(kept) <= len(rows())
        assert all(getattr(r, c) == c for r in kept for c in CLASH)
    else:
        assert {c if c not in ("tokens", "topic_group") else f"{c}_in" for c in wide.columns} <= set(got.columns)
    plain = step(spark, docs.selectExpr("*", "cast(length(text) as int) n_chars"), str(tmp_path))
    assert sorted(str((r.doc_id, r.text)) for r in plain.collect()) == sorted(str((r.doc_id, r.text)) for r in kept)
    empty = step(spark, wide.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == got.columns
