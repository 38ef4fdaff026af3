import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilwright.llm import decontamination, embeddings, quality, sharding, toxicity


def leader_in_plain_python(examples, epochs):
    """Follow-the-regularised-leader by its definition, over dictionaries."""
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        if abs(a) <= quality.L1:
            return 0.0
        return -(a - math.copysign(quality.L1, a)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for features, label in examples:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
            for i, x in features.items():
                g = (p - label) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_and_scores_equal_plain_python():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["good", "Bad", "x9", "...", "fine", "BAD"], k=rng.randint(0, 12))) for _ in range(60)]
    known, rows, plain = quality.Words(), [], []
    for t in texts:
        places, n = np.unique(quality.ngram_places(t, known), return_counts=True)
        label = int("good" in t)
        rows.append((places, n / max(1, n.sum()), label))
        plain.append(({**{int(i): float(x) * quality.SCALE for i, x in zip(places, rows[-1][1], strict=True)}, "bias": 1.0}, label))
    model = quality.follow_the_leader(rows)
    weights = leader_in_plain_python(plain, quality.EPOCHS)
    assert model.bias == pytest.approx(weights["bias"])
    for t, (features, _) in zip(texts, plain, strict=True):
        assert model.score(t, known) == pytest.approx(1 / (1 + math.exp(-sum(weights[i] * x for i, x in features.items()))), abs=1e-5)


def test_training_holds_its_rows_packed(spark):
    # numbers of the driver: what Python and Arrow hold at most, beside the tables of weights
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=5000)), i % 2) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    docs.count()
    known, chosen = quality.Words(), [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    examples = [(*np.unique(quality.ngram_places(text, known), return_counts=True), label) for _, text, label in sorted(chosen, key=lambda r: (r[0] * 0x9E3779B1 & 0xFFFFFFFF, r[0]))]
    packed = sum(8 * len(e[0]) for e in examples)
    tables = 60 * (1 << quality.BITS)
    before, own = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(own)
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1] + own.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
        docs.unpersist()
    assert packed > 2 * tables and peak < 1.2 * packed + tables
    expected = quality.follow_the_leader([(places, (n / n.sum()).astype(np.float32).astype(np.float64), label) for places, n, label in examples])
    assert model.bias == expected.bias and (model.weights == expected.weights).all()


def features_in_plain_python(lexicon, text):
    """Every entry and phrase looked for at every place."""
    plain = toxicity.folded(text)
    spared = set()
    for phrase in map(toxicity.folded, lexicon.exceptions):
        for i in range(len(plain)):
            if plain.startswith(phrase, i):
                spared.update(range(i, i + len(phrase) - 1))
    best = [max((w for e, w in lexicon.weights.items() if plain.startswith(e, i) and i not in spared), default=0) for i in range(len(plain))]
    return math.log1p(sum(best)), sum(best) / math.sqrt(plain.count(" "))


def test_lexicon_equals_plain_python():
    rng = random.Random(2)
    words = ["trash", "tr4sh", "can", "idiot", "idiotic", "proof", "the", "L0SER", "loser", "of", "bin", "1d10t"]
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 2.0, " idiot ": 2.5, " loser ": 1.5}, ("trash can", "can of", "idiot proof", "of trash"))
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 14)))
        assert lexicon.features(text) == pytest.approx(features_in_plain_python(lexicon, text)), text


def test_long_text_of_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0}, ("trash can",))
    assert lexicon.features("trash can " * 50_000 + "trash")[0] == pytest.approx(math.log1p(3))


def test_exceptions_are_learnt(spark):
    rows = [(i, "what an idiot he is") for i in range(40)] + [(i, "an idiot light went on") for i in range(40, 60)] + [(i, "plain words only here") for i in range(60, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, exceptions=())
    assert "idiot light" in lexicon.exceptions and "an idiot" not in lexicon.exceptions
    assert lexicon.score("what an idiot") > 0.5 > lexicon.score("an idiot light")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_clashing_names_and_repeated_rows(spark, module, label):
    rows = [(None, "some text", 1, "a", "t", 7.5), (1, None, 2, "b", "t", 7.5), (1, "some text", 2, "b", "t", 7.5), (1, "some text", 2, "b", "t", 7.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string, rated_text string, rating double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], f"doc_id long, {label} int")
    model = module.train(docs, labels, label)
    scored = module.with_scores(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and scored.where(F.col("score").between(0, 1) & F.col("predicted").isin(0, 1)).count() == 4
    kept = (module.good_ones if module is quality else module.harmless_ones)(docs, module.train(docs, labels.limit(0), label))
    assert kept.columns == docs.columns and kept.count() == 4 and {r.score for r in kept.collect()} == {1, 2}


def test_pipeline_stages_with_clashing_names_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    text = "A plain sentence of ordinary words that nobody would object to, written down for a test. " * 8
    rows = [(None, text), (1, text), (2, None), (2, ""), (3, text + "x")]
    docs = spark.createDataFrame([(i, t, 1, "p", 2, 3, "m", 4) for i, t in rows], "doc_id long, text string, score int, predicted string, words int, value int, text_md5 string, n int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert {(r.doc_id, r.text) for r in out.collect()} <= set(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_containment_with_null_and_repeated_ids(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(None, item, 1), (1, item, 1), (1, item, 1), (2, "other " * 50, 1), (2, item, 1)], "doc_id long, text string, width int")
    items = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained_items(docs, items).collect()]
    assert sorted(got) == [(1, 7, 26), (2, 7, 26)]
    assert [r.doc_id for r in decontamination.decontaminate(docs, items).collect()] == [None]


@pytest.mark.parametrize("rows, size", [(0, 0), (400_000, 16 << 20)])
def test_containment_with_and_without_broadcasts(spark, monkeypatch, rows, size):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", size)
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (2, "x " + item[: len(item) // 2]), (3, "two words")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "two words")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()) == [(1, 7), (3, 8)]


def test_recall_near_the_threshold(spark):
    """Through the whole operator: links of 0.90 to 0.95 among 3,000 vectors of 64 dimensions."""
    rng = np.random.default_rng(3)
    x = embeddings.units(rng.normal(size=(1500, 64)))
    aside = rng.normal(size=x.shape)
    aside = embeddings.units(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.9005, 0.95, size=(1500, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * aside])
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    true = int((both @ both.T >= 0.9).sum()) - len(both)
    found = sum(r.n_links for r in embeddings.near_vectors(df).select("n_links").collect())
    assert 0.9 * true <= found <= true


def test_vectors_with_ties_null_and_repeated_keys(spark):
    a, b = [1.0, 0.0], [0.9, math.sqrt(1 - 0.81)]
    rows = [(None, a), (1, a), (1, a), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [4.0, 3.0]), (5, [1.0, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.vec_id is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    tie = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert [r.n_links for r in embeddings.near_vectors(tie, least=0.8).collect()] == [1, 1]  # exactly at the threshold
    assert b[0] == 0.9


def test_shards_of_equal_texts_manifest_and_files(spark, tmp_path):
    rows = [(i, "same text", "en", "s1", "x" * 10) for i in range(50)] + [(100 + i, f"t{i}", None, "s2", "y") for i in range(60)] + [(200, "z" * 300_000, "de", None, "k"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    placed = sharding.shard_documents(docs, 5).cache()
    got = {r.doc_id: r for r in placed.collect()}
    # equal texts of one source and language follow one another
    at = sorted((got[i].shard, got[i].slot) for i in range(50))
    sizes = [sum(1 for r in placed.collect() if r.shard == s) for s in range(5)]
    run = [sum(sizes[:s]) + n for s, n in at]
    assert run == list(range(run[0], run[0] + 50))
    manifest = {r.shard: r for r in sharding.shard_manifest(placed, ["size"]).collect()}
    assert sum(r.n_rows for r in manifest.values()) == len(rows) and max(r.max_size for r in manifest.values()) == 300_016
    some = docs.where("doc_id IS NOT NULL").drop("shard")
    sharding.write_shards(some, placed, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(rows) - 1 and back.where("shard = 0").count() == sizes[0] - (got[None].shard == 0)
