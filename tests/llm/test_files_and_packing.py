import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwright.llm import archives, packing, sharding


def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "\r\n\r\nWARC/1.1\r\n", "é" * 100, "x" * 200_000]
    pages = spark.createDataFrame([(i, f"http://h/{i} x", h, "e") for i, h in enumerate(html)], "page_id long, url string, html string, record_id string")
    got = {r.page_id: r for r in archives.pages_through_warc(pages).collect()}
    first = {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.refers_to == first.get(data) and r.record_type == ("revisit" if data in first else "response")
        first.setdefault(data, i)
    small = {r.page_id: r.record_type for r in archives.pages_through_warc(pages, least_bytes=1).collect()}
    assert small[2] == small[3] == "response" and small[1] == "revisit"
    assert archives.pages_through_warc(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [lambda x: x, archives.compressed])
def test_arc_versions(version, pack):
    data = archives.arc_head("f", "20200101000000", version) + archives.arc_record("http://a b", "1.2.3.4", "20200102030405", "text/plain", b"\n\nbody\n", version)
    (r,) = archives.read_arc(pack(data))
    assert (r.url, r.ip, r.content) == ("http://a%20b", "1.2.3.4", b"\n\nbody\n") and archives.iso_date(r.date) == "2020-01-02T03:04:05Z"
    head, block = next(archives.read_warc(archives.warc_record(r)))
    assert head["warc-type"] == "resource" and block == r.content
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-6]))


def test_damaged_archives_are_rows(spark, tmp_path):
    records = [archives.arc_record(f"http://h/{i}", "1.2.3.4", "20200102030405", "text/html", f"HTTP/1.1 200 OK\r\nX: {i}\r\n\r\nbody {i}".encode(), 1) for i in range(3)]
    whole = archives.arc_head("f", "20200101000000", 1) + b"".join(records)
    given = [whole, whole[:-9], b"\x28\xb5\x2f\xfdxx", b"no archive at all\n"]
    df = spark.createDataFrame([(bytearray(x),) for x in given], "content binary")
    rows = archives.arc_records(df).collect()
    assert sum(r.error is None for r in rows) == 5 and sum(r.error is not None for r in rows) == 3
    errors = archives.convert(df, f"file://{tmp_path}/warc")
    assert errors.count() == 3
    index = archives.warc_index(archives.read_archives(spark, f"file://{tmp_path}/warc")).collect()
    assert len(index) == 5 and all(r.error is None for r in index)
    good = archives.warc_record(next(archives.read_arc(whole)))
    bad = spark.createDataFrame([(bytearray(good),), (bytearray(good.replace(b"body 0", b"body X")),), (bytearray(good[:-12]),)], "content binary")
    assert [r.error is None for r in archives.warc_index(bad.coalesce(1)).collect()] == [True, False, False]


def test_archives_with_null_keys_and_repeated_rows(spark):
    rows = [(None, "u", "<p>x</p>"), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", "<p>x</p>")]
    got = [(r.page_id, r.record_type, r.refers_to) for r in archives.pages_through_warc(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 4 and got.count((1, "response", None)) == 2 and (2, "revisit", 1) in got and (None, "revisit", 1) in got


@given(st.text(alphabet="ab é\n'.1🙂", max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_ids_equal_the_tokenizer, "both"):
        whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        whole.encode_special_tokens = True
        test_ids_equal_the_tokenizer.both = whole, packing.Encoder(packing.default_vocabulary())
    whole, own = test_ids_equal_the_tokenizer.both
    assert own(text) == whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", " ", "  ", "\n", "é", "b c", "<", "|>"]), max_size=12).map("".join))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizer_at_added_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = test_ids_equal_the_tokenizer_at_added_tokens
    if not hasattr(own, "both"):
        own.both = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(packing.default_vocabulary())
    whole, encode = own.both
    assert encode(text) == whole.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "  ", "\t", "\n\n", "12345", "don't", "ÀÉß", "中文字", "\u00a0", "\u3000", "aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "\r\n", "'ll", "\u2028", "١٢"])), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_tokenizer_on_any_text(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = test_ids_equal_the_tokenizer_on_any_text
    if not hasattr(own, "both"):
        own.both = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder(packing.default_vocabulary(), cached=5)
    whole, encode = own.both
    assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_on_documents(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder(packing.default_vocabulary())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert encode(r.text or "") == whole.encode(r.text or "", add_special_tokens=False).ids


def fewest_bins(lengths, room):
    """By trying every subset as the last bin."""
    every = [sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(1 << len(lengths))]
    best = [0] + [len(lengths)] * (len(every) - 1)
    for m in range(1, len(every)):
        part = m
        while part:
            if every[part] <= room:
                best[m] = min(best[m], best[m ^ part] + 1)
            part = part - 1 & m
    return best[-1]


def best_fit(lengths, room):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, n in enumerate(bins) if n + x <= room]
        if fits:
            i = max(fits, key=bins.__getitem__)
            bins[i] += x
        else:
            bins.append(x)
    return len(bins)


def sequences(lengths, room):
    plan = packing.plan_bins({x: lengths.count(x) for x in set(lengths)}, room)
    if not lengths:
        return 0
    n, at = 0, list(zip(*(plan[c].tolist() for c in ("length", "rank", "sequence", "times")), strict=True))
    for (x, rank, sequence, times), after in zip(at, [*at[1:], (0, 0, 0, 0)], strict=True):
        end = after[1] if after[0] == x else lengths.count(x)
        n = max(n, sequence + -(-(end - rank) // times))
    return n


@given(st.lists(st.integers(1, 30), max_size=10))
@settings(max_examples=150, deadline=None)
def test_sequences_against_every_packing(lengths):
    """Near the fewest possible (the heuristic's bound of 3/2), never above one more on these sizes."""
    assert fewest_bins(lengths, 30) <= sequences(lengths, 30) <= fewest_bins(lengths, 30) + 1


def test_sequences_against_best_fit():
    rng = np.random.default_rng(7)
    for _ in range(30):
        lengths = [int(x) for x in np.minimum(2048, rng.lognormal(5.5, 1.2, 600) + 1)]
        assert -(-sum(lengths) // 2048) <= sequences(lengths, 2048) <= best_fit(lengths, 2048)


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan_bins(counts, 64)
    bins = {}
    for x, n in counts.items():
        own = [i for i in range(len(plan["length"])) if plan["length"][i] == x]
        ends = [plan["rank"][i] for i in own[1:]] + [n]
        for i, end in zip(own, ends, strict=True):
            for r in range(int(plan["rank"][i]), int(end)):
                q, m = divmod(r - int(plan["rank"][i]), int(plan["times"][i]))
                bins.setdefault(int(plan["sequence"][i]) + q, []).append((int(plan["offset"][i]) + m * x, x))
    assert sum(map(len, bins.values())) == len(lengths)
    for pieces in bins.values():
        at = 0
        for offset, x in sorted(pieces):
            assert offset == at
            at += x
        assert at <= 64


def test_packing(spark):
    texts = [None, "", "a b", "word " * 5000, *("t" * n for n in range(1, 60))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs).collect()
    own = packing.Encoder(packing.default_vocabulary())
    for i, t in enumerate(texts):
        ids = np.array([*own(t or ""), 0], dtype="<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
        assert all(r.length == 2048 for r in pieces[1:])
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b c"), (1, "b c"), (1, "d")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 5 and len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == [sum(sorted((r.length for r in rows), reverse=True)[:i]) for i in range(5)]


def test_hilbert_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(sharding.hilbert_numbers(cells, 3))]
    assert sorted(sharding.hilbert_numbers(cells, 3)) == list(range(side**3))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else "é" * (i % 7), None if i % 5 == 0 else "en", f"s{i % 3}", "x") for i in range(103)], "doc_id long, text string, lang string, source string, curve string")
    rows = sharding.shard_documents(docs).collect()
    sizes = [0] * 40
    for r in rows:
        sizes[r.shard] += 1
        assert r.size == 16 + (0 if r.doc_id == 3 else 2 * (r.doc_id % 7))
    assert len(rows) == 103 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    one = sharding.shard_by_curve(docs, [sharding.category_cell(F.col("lang"))], 3)
    assert {r.shard for r in one.collect()} == {0, 1, 2}
