import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwright.llm import chat, decontamination, katz, quality, toxicity
from veilwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, value string")


def brute_katz(rows, order, others=()):
    """Katz in plain Python, by its definition. others are scored only."""
    k = katz.GOOD_TURING
    tokens = {i: [*(t or "").encode().lower().split(), b"</s>"] for i, t in [*rows, *others]}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    grams = [Counter() for _ in range(order + 1)]
    for i in train:
        grams[1].update((w,) for w in tokens[i])
        padded = [b"<s>", *tokens[i]]
        for m in range(2, order + 1):
            grams[m].update(tuple(padded[j : j + m]) for j in range(len(padded) - m + 1))
    n = sum(grams[1].values())

    def discounts(counts):
        return katz.discounts(np.bincount([c for c in counts if c <= k + 1], minlength=k + 2))

    d = [None, *(discounts(grams[m].values()) for m in range(1, order + 1))]
    cut_down = lambda m, c: d[m][min(c, k + 1)] * c
    seen = sum(cut_down(1, c) for c in grams[1].values()) / n if n else 0
    unseen = max(1 - seen, 1 / (n + 1))
    after = {}
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after.setdefault(g[:-1], {})[g[-1]] = c

    def p(w, h):
        if not h:
            c = grams[1][w,]
            return (1 - unseen) / seen * cut_down(1, c) / n if c else unseen
        own, m = after.get(h), len(h) + 1
        if not own:
            return p(w, h[1:])
        c = sum(own.values())
        taken = sum(cut_down(m, x) for x in own.values()) / c
        left = max(1 - taken, 1 / (c + 1))
        if w in own:
            return (1 - left) / taken * cut_down(m, own[w]) / c
        return left / (1 - sum(p(x, h[1:]) for x in own)) * p(w, h[1:])

    v = len(grams[1])
    base = lambda w: math.log10((grams[1][w,] + 0.5) / (n + 0.5 * (v + 1)))
    score = {i: sum(math.log10(p(w, tuple([b"<s>", *t][max(0, j + 2 - order) : j + 1]))) for j, w in enumerate(t)) for i, t in tokens.items()}
    contexts = [h for h in after if h][:15] + [h for h in after if len(h) == order - 1][:15] + [(b"never seen",)]
    everything = [sum(p(w, h) for (w,) in grams[1]) + p(b"never seen", h) for h in contexts]
    return tokens, grams[1], n, {i: sum(map(base, t)) for i, t in tokens.items()}, score, everything


def zipf_texts(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 300) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "SPLIT", 20)
    monkeypatch.setattr(katz, "BUCKET_GRAMS", 700)
    monkeypatch.setattr(katz, "BUCKET_WORDS", 100)
    texts = zipf_texts(1, 150) + [None, "", "A a A"]
    rows = list(enumerate(texts))
    others = [(1000 + i, t) for i, t in enumerate(zipf_texts(2, 20) + [None, "w1 w1 never seen w2"])]
    tokens, one, n, base, score, everything = brute_katz(rows, order, others)
    assert all(abs(x - 1) < 1e-9 for x in everything)
    scores, model = katz.katz(documents(spark, texts), order=order)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == len(rows)
    other = spark.createDataFrame(others, "doc_id long, text string")
    for r in katz.katz(other, order=order, model=model)[0].collect():
        assert r.held_out
        got[r.doc_id] = r
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(one[w,] > 0 for w in t), n)
        assert r.held_out == (i >= 1000 or zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base[i]) and r.score == pytest.approx(score[i])


def test_katz_of_null_and_repeated_keys_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(None, "a b", "x"), (2, "a b", "x"), (2, "a b", "x"), (2, None, "x")], "doc_id long, text string, words string")
    rows = katz.katz_scores(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["2", "2", "2", "None"] and {r.train_tokens for r in rows} == {10}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = katz.katz_scores(documents(spark, [None]).select(F.lit(held).cast("long").alias("doc_id"), F.lit("a b").alias("text"))).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score == 0


def test_katz_stores_its_counts_by_slice(spark):
    _, model = katz.katz(documents(spark, ["a b a b", "a c"]))
    assert [t.count() for t in model.tables] == [1, 1, 1]
    held = [katz.unpack(t.first().body) for t in model.tables]
    assert sorted(held[0][1].tolist()) == sorted(Counter("a b a b </s> a c </s>".split()).values())
    assert sorted(held[1][-2].tolist()) == [1, 1, 1, 1, 2, 2] and len(held[2][-2]) == 6
    assert all("kind=model/slice=" in r[0] for t in model.tables for r in t.select(F.input_file_name()).collect())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\n\x0b\x0c\r\x1c\u00a0é中", max_size=30), st.sampled_from(["x" * 1500, "y" * 700, "word " * 300, "z" * 90])), max_size=12))
@settings(max_examples=80, deadline=None)
def test_word_hashes_tell_words_apart(texts):
    own, blob = {}, katz._BLOB
    try:
        katz._BLOB = 1200  # several blobs, and words longer than one
        found = list(katz.word_hashes(texts))
    finally:
        katz._BLOB = blob
    assert len(found) == len(texts)
    for text, hashes in zip(texts, found, strict=True):
        words = (text or "").encode().lower().split()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert own.setdefault(w, h) == h
    assert len(set(own.values())) == len(own)


@given(st.lists(st.lists(st.integers(0, 2**63 - 1), max_size=20), max_size=5))
@settings(max_examples=50, deadline=None)
def test_packed_arrays(arrays):
    assert [x.tolist() for x in katz.unpack(katz.pack(*(np.array(a, np.int64) for a in arrays)))] == arrays


def test_katz_of_an_empty_table(spark):
    assert katz.katz_scores(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_snapshot_collapse", "op5_containment_decontamination"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    own = QUERIES[name](spark, SF).toPandas()
    other = con.execute(ORACLES[name]).df()[list(own.columns)]
    keys = list(own.columns[:2])
    assert own.sort_values(keys).reset_index(drop=True).astype(str).equals(other.sort_values(keys).reset_index(drop=True).astype(str))


def test_chats(spark):
    said = [(1, 0, "user", "a"), (1, 1, "bot", None), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", None), (4, 0, None, ""), (None, 0, "user", "a"), (5, None, "user", "z")]
    df = spark.createDataFrame([(*r, 0) for r in said], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.collapse_and_render(df).collect()}
    assert sorted(got) == [1, 4, 5] and got[1] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\n<|im_end|>\n")
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_containment(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = documents(spark, [f"x {item} y", item.replace("q19", "zz").upper(), " ".join(item.split()[:10]), None, "", "Short One", f"{item} {item}"])
    items = spark.createDataFrame([(1, item, 0), (2, "short one", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, words int")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(docs, items).collect())
    assert got == [(0, 1, 16, 16), (1, 1, 16, 15), (5, 2, 1, 1), (6, 1, 16, 16)]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).collect()) == [2, 3, 4]
    assert decontamination.contained_items(docs, items.limit(0)).count() == decontamination.contained_items(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("module, label, name", [(quality, "quality", "op7_quality_classifier"), (toxicity, "toxic", "op9_lexicon_toxicity")])
def test_held_out_accuracy(spark, module, label, name):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= 0.9
    docs = documents(spark, [None, "", "word", "w " * 100_000])
    scored = module.with_scores(docs, module.train(docs, labels.limit(0)))
    assert scored.columns == [*docs.columns, "score", "predicted"] and scored.where(F.col("score").between(0, 1)).count() == 4


def test_folding():
    assert toxicity.folded("L0SER, іdiot 5tupid 2024!") == " loser idiot stupid "
    lexicon = toxicity.Lexicon({" loser ": 3.0, " lose": 1.0, " trash ": 2.0})
    assert lexicon.features("the l0ser")[0] == pytest.approx(math.log1p(3))
    assert lexicon.features("trash can")[0] == 0 and lexicon.features(None) == (0, 0)


@pytest.mark.parametrize("token, word", [("5h1t", "shit"), ("$h!t", "shit"), ("7r45h", "trash"), ("1d10t", "idiot"), ("a55", "ass"), ("1D10T!", "idiot"), ("l0$3r", "loser")])
def test_folding_of_several_substitutions(token, word):
    assert f" {word} " in toxicity.folded(f"so {token}, he said")
    assert toxicity.Lexicon({f" {word} ": 3.0}).features(f"so {token}")[0] == pytest.approx(math.log1p(3))


def test_folding_leaves_numbers_and_plain_words():
    assert toxicity.folded("2024 and 100% of 5! stop! $5, 3") == " and of stop "
