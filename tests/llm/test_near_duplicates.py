import random

import numpy as np
import pytest

from veilwright.llm import common, embeddings, minhash


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = [None, "", " \n\t", "one", "one two", "ONE Two", "x" * 50_000]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        base += passage * rng.randint(0, 1)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "extra", 0) for i, t in rows], "doc_id long, text string, id string, n long")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width, percent).collect()}
    sets = {i: shingles(t, width) for i, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)

    assert {i: r.component_id for i, r in got.items()} == closure(list(sets), linked)
    assert all(got[i].n_shingles == len(s) and got[i].kept == (got[i].component_id == i) for i, s in sets.items())


@pytest.mark.parametrize("width, percent, steps", [(3, 85, (0, 40, 80)), (5, 80, (0, 60, 130))])
def test_nested_copies_with_a_common_footer(spark, width, percent, steps):
    """Articles of 320 shingles; the longest copy heads the lists and is too long to link with the bare article."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    footer = words(steps[-1])
    rows = []
    for _ in range(12):
        article = words(320 + width - 1)
        rows += [(len(rows) + i, " ".join(article + footer[:n])) for i, n in enumerate(steps)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    expected = closure(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    assert expected == {i: i - i % 3 for i in sets}
    assert got == expected


@pytest.mark.parametrize("size, edits, rows", [(90, 14, 120), (700, 60, 40)])
def test_cloud_around_the_threshold(spark, size, edits, rows):
    """Copies with edits from a few words: similarities lie on both sides of the threshold, many sets share all they hold."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    texts = []
    for _ in range(rows):
        copy = list(base[: size - rng.randint(0, size // 8)])
        for _ in range(rng.randint(0, edits // 3)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(3)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    sets = [shingles(t, 3) for t in texts]
    expected = closure(range(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    assert 1 < len(set(expected.values())) < rows
    assert got == expected


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_large_family_of_long_copies_is_not_compared_pair_by_pair(spark, monkeypatch, width, percent):
    """Copies of 1000 words, many too far from the others to link, and a longer one that heads the lists."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**9)}" for _ in range(1000)]
    texts = [" ".join(base + [f"x{j}" for j in range(300)]), " ".join(f"x{j}" for j in range(300))]
    for _ in range(80):
        edits = rng.uniform(0, 0.08)
        texts.append(" ".join(f"e{rng.randrange(3000)}" if rng.random() < edits else w for w in base))
    checked, similar = [], minhash._similar

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(minhash, "_similar", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, percent).collect()}
    sets = [shingles(t, width) for t in texts]
    expected = closure(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    assert 10 < len(set(expected.values())) < len(texts) - 10
    assert got == expected
    assert sum(checked) <= 8 * len(texts), checked


def test_null_and_repeated_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (None, a), (None, None), (2, a), (2, a), (3, b), (3, c), (4, b), (5, c), (6, None), (6, b)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_key string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (28, None, True)]
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    b_first = minhash.shingle_hashes(common.words_of(b), 3, minhash.WordHashes()), minhash.shingle_hashes(common.words_of(c), 3, minhash.WordHashes())
    import xxhash

    spoken = 4 if xxhash.xxh3_128_digest(b_first[0].tobytes()) < xxhash.xxh3_128_digest(b_first[1].tobytes()) else 5
    assert found[1] == {(1, True)} and found[2] == {(1, False)} and found[3] == {(3, True)}
    assert found[spoken] == {(3, False)} and found[9 - spoken] == ({(4, True)} if spoken == 5 else {(5, True)})
    assert found[6] == {(6, True), (3 if spoken == 4 else 4, False)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    vertices = spark.createDataFrame([(i,) for i in (*range(1, 61), 100, 101, 200)], "id long")
    got = {r.id: r.component_id for r in common.components(links, vertices).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100, 200: 200}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    near = base[:60] + rng.normal(scale=0.05, size=(60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0], base[0] * 2])]
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [1.0, None] + [1.0] * 14), (504, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    v = np.array([x for _, x in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    found = sum(got[i].n_links for i, _ in rows)
    assert all(got[i].n_links <= true[i].sum() for i, _ in rows) and found >= 0.9 * true.sum()
    assert got[180].component_id == got[181].component_id == 0 and not got[180].kept
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in odd)


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("n", [64, 128, 256, 512, 1024, 2048, 4096])
def test_recall_at_the_threshold_holds_as_pivots_grow(n, clustered):
    """Pairs at a cosine of 0.9 in 64 dimensions that share two pivots, so meet in a list."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n + 2000, 64))
    if clustered:
        x = 0.5 * x + rng.normal(size=(50, 64))[rng.integers(50, size=len(x))]
    x = embeddings.units(x)
    pivots, v = x[:n], x[n:]
    aside = rng.normal(size=v.shape)
    aside = embeddings.units(aside - (aside * v).sum(axis=1, keepdims=True) * v)
    m = getattr(embeddings, "nearest_of", lambda n: embeddings.NEAREST)(n)
    a, b = (np.argsort(-(y @ pivots.T), axis=1)[:, :m] for y in (v, 0.9 * v + np.sqrt(1 - 0.9**2) * aside))
    recall = ((a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1) >= 2).mean()
    print(n, clustered, m, round(float(recall), 3))
    assert recall >= 0.9
