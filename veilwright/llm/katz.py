"""Katz backoff: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) is the discounted share of w among the followers of the context h if the n-gram was seen, else the backoff
weight of h times P(w | h without its first word), and so on down to P(w): the discounted share of w, where all unseen
words are one class that gets what discounts free. Contexts that weren't seen have the weight 1.

Texts become batches of token numbers. Counts are exchanged order by order as packed arrays: a batch sends its distinct
words, then its distinct n-grams of each order, to buckets of their context's hash; a bucket adds them up over all
batches, writes them to the model, a table partitioned by kind and slice, and answers each batch in the order asked:
counts, and what the backoff weight of a context needs. Words are exchanged first and get numbers, frequent ones small
ones, so n-grams are exact and pack well. Batches then score their tokens by the recursion above. Followers of a context
that is very common are dealt to several buckets, and its sums are added up by the batches. A request for an n-gram is
sent only if its context was seen. Only counts of counts come to the driver.

A stored model scores other texts through the same exchange: its rows join the requests, which then count nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import drop_table, fold_bucket, give_back
from .minhash import mixed

#: Words of the longest n-grams.
ORDER = 3
#: Counts up to which Good-Turing discounts apply.
GOOD_TURING = 5
BATCH_TOKENS = 1_250_000
#: Words, and n-grams, that one bucket adds up, about.
BUCKET_WORDS, BUCKET_GRAMS = 500_000, 700_000
#: Occurrences of a context from which its followers are dealt to several buckets.
SPLIT = 200_000
#: Folders of a model's order.
SLICES = 16
_END = np.uint64(2)
#: Numbers of words: all unseen ones, the start of a text, the others from here.
_UNSEEN, _START, _FIRST = 0, 1, 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64 bits, as bytes by significance without those that are zero throughout, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).view(np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [len(a), width]
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return _zstd()[0].compress(b"".join([np.array(head, np.int64).tobytes(), *planes]))


def unpack(body: bytes) -> list[np.ndarray]:
    data = _zstd()[1].decompress(body)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, found = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for size, width in head.tolist():
        out = np.zeros((size, 8), np.uint8)
        out[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        found.append(out.view(np.int64).ravel())
        at += size * width
    return found


_BLOB = 1 << 20
_LONG_WORD = 1024


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number of each byte; powers of an odd number modulo 2 ** 64, and of its inverse."""
    base = int(_GOLDEN)
    of_byte = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOB, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    return of_byte, up, down


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text: a polynomial over the word's bytes, of very long words a byte hash."""
    import xxhash

    of_byte, up, down = _powers()

    def hashed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the words."""
        data = np.frombuffer(blob, np.uint8)
        inside = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of_byte[data] * up[: len(data)], out=sums[1:])
        found = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > _LONG_WORD):
            found[i] = xxhash.xxh3_64_intdigest(blob[starts[i] : ends[i]])
        return starts, found

    def several(held: list[bytes]) -> Iterator[np.ndarray]:
        firsts = np.cumsum([0, *(len(t) + 1 for t in held)])
        starts, found = hashed(b"\n".join(held))
        at = np.searchsorted(starts, firsts)
        yield from (found[a:b] for a, b in zip(at, at[1:], strict=False))

    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if len(data) >= _BLOB // 2:
            yield from several(held) if held else ()
            held, size, parts = [], 0, []
            words = data.split()
            # blobs of whole words; longer words are hashed by themselves
            for word in [*words, None]:
                if word is None or size + len(word) + 1 > _BLOB:
                    parts += several([b" ".join(held)]) if held else ()
                    held, size = [], 0
                if word is not None and len(word) >= _BLOB // 2:
                    parts += several([b" ".join(held)]) if held else ()
                    parts.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                    held, size = [], 0
                elif word is not None:
                    held.append(word)
                    size += len(word) + 1
            yield np.concatenate([np.empty(0, np.uint64), *parts])
            held, size = [], 0
            continue
        if size + len(data) + 1 > _BLOB:
            yield from several(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from several(held)


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: equal ranges of a second hash."""
    return ((mixed(hashes + np.uint64(7)) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def cut(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    return common.cut(df, name, by, common.ARROW_BYTES)


_BATCH = "batch long, ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_words long, n_tokens long"
_ROW = "bucket int, batch long, body binary, tally array<long>, kind string, slice int"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def encoded(docs: DataFrame, key: str = "doc_id", learn: bool = True) -> DataFrame:
    """Batches of documents: words are the hashes of a batch's vocabulary, frequent ones first, tokens are places in it; an
    end follows each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            words, tokens, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = (part << 24 | n, ids, held, pack(np.array([len(t) for t in texts])), pack(words[order]), pack(place[tokens]), len(words), len(tokens))
            return _table(_BATCH, [row]).to_batches()[0]

        for batch in batches:
            docs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), word_hashes(t.as_py() for t in batch.column(2)), strict=True)
            for doc, out, hashes in docs:
                texts.append(np.append(np.maximum(hashes, np.uint64(3)), _END))
                ids.append(doc)
                held.append(bool(out))
                size += len(hashes) + 1
                if size >= BATCH_TOKENS:
                    yield done()
                    give_back()
                    n, ids, held, texts, size = n + 1, [], [], [], 0
        if texts:
            yield done()

    held = F.coalesce(fold_bucket(F.col(key)) == 1, F.lit(False)) if learn else F.lit(True)
    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string")).mapInArrow(encode, _BATCH)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[r] for counts r up to GOOD_TURING + 1 (1 there and above); counts_of_counts[r] items were seen r times.
    Where the estimate is no discount, as with few data, absolute discounting stands in for it."""
    n, k = counts_of_counts.astype(float), GOOD_TURING
    d = np.ones(k + 2)
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = turing if 0 < turing < 1 else (r - flat) / r if 0 < flat < 1 else 1.0
    return d


def discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, GOOD_TURING + 1)] * counts


class Unigrams:
    """P(w) from counts; a word that was never seen belongs to the class of unseen words."""

    def __init__(self, counts_of_counts: np.ndarray, mass: np.ndarray):
        """mass[r]: occurrences of words seen r times, those above GOOD_TURING together. counts_of_counts ends with all words."""
        self.total, self.types, self.d = int(mass.sum()), int(counts_of_counts[-1]), discounts(counts_of_counts)
        seen = float((self.d * mass).sum()) / self.total if self.total else 0.0
        self.unseen = max(1 - seen, 1 / (self.total + 1))
        self.scale = (1 - self.unseen) / seen if seen else 0.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * discounted(self.d, counts) / max(self.total, 1), self.unseen)


@dataclass
class Model:
    """Counts by order in tables (kind, slice, bucket), and what all tasks need of them."""

    tables: list[DataFrame] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)
    unigrams: Unigrams | None = None
    #: Discounts of order m at m - 1.
    d: list[np.ndarray] = field(default_factory=list)

    def known(self) -> Known:
        return Known(self.buckets, self.unigrams, self.d)


@dataclass
class Known:
    """A model without its tables, as tasks get it."""

    buckets: list[int]
    unigrams: Unigrams | None
    d: list[np.ndarray]


_TALLY = GOOD_TURING + 3


def _tally(counts: np.ndarray) -> list[int]:
    """Counts of counts 0..K+1 and of all, then occurrences by count 0..K and above."""
    few = np.minimum(counts, GOOD_TURING + 1)
    exact = np.bincount(counts[counts <= GOOD_TURING + 1], minlength=GOOD_TURING + 2)
    return [*exact.tolist(), len(counts), *np.bincount(few, counts, GOOD_TURING + 2).astype(np.int64).tolist()]


def _row(kind: str, bucket: int, batch: int, body: bytes, tally: list[int] | None = None) -> tuple:
    return (bucket, batch, body, tally, kind, bucket % SLICES if kind == "model" else 0)


# Order 1: words


def _word_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    at = spread(hashes.view(np.uint64), buckets)
    order = _by_bucket(at)
    return order, at[order]


def _send_words(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, lengths, words, tokens in zip(*(batch.column(i) for i in range(5)), strict=True):
                (hashes,), (tokens,), (lengths,) = (unpack(x.as_py()) for x in (words, tokens, lengths))
                learnt = np.repeat(~np.array(held.as_py(), bool), lengths)
                counts = np.bincount(tokens[learnt], minlength=len(hashes))
                order, at = _word_order(hashes, buckets)
                starts = _runs(at)
                rows = [_row("ask", int(at[a]), number.as_py(), pack(hashes[order[a:b]], counts[order[a:b]])) for a, b in zip(starts, [*starts, len(at)][1:], strict=True)]
                yield from _table(_ROW, rows).to_batches()

    return send


def _add_words(table: pa.Table) -> pa.Table:
    bucket, numbers = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
    asked = [unpack(x.as_py()) for x in table.column("body")]
    words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank[total == 0] = 0
    seen = total > 0
    rows, begin = [_row("model", bucket, -1, pack(words[seen], total[seen]), _tally(total[seen]))], 0
    for number, (own, _) in zip(numbers, asked, strict=True):
        part = at[begin : begin + len(own)]
        if number >= 0:
            rows.append(_row("answer", bucket, number, pack(total[part], rank[part])))
        begin += len(own)
    return _table(_ROW, rows)


_NUMBERED = "batch long, ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_words long, n_tokens long, counts binary"


def _number_words(buckets: int):
    """Puts numbers and counts in the place of hashes."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (hashes,) = unpack(row["words"])
                order, at = _word_order(hashes, buckets)
                parts = [unpack(a["body"]) for a in sorted(row.pop("answers"), key=lambda a: a["bucket"])]
                counts, numbers = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                counts[order] = np.concatenate([p[0] for p in parts])
                numbers[order] = np.concatenate([p[1] for p in parts]) * buckets + at + _FIRST
                row |= {"words": pack(np.where(counts > 0, numbers, _UNSEEN)), "counts": pack(counts)}
                yield from _table(_NUMBERED, [tuple(row[x.split()[0]] for x in _NUMBERED.split(", "))]).to_batches()

    return number


# Order 2 and above


@dataclass
class Grams:
    """Distinct n-grams of one order in a batch whose context was seen: place of the context among those of the order below,
    place of the word, place of the n-gram without its first word; at: n-gram of each token or -1."""

    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    at: np.ndarray
    total: np.ndarray | None = None
    p: np.ndarray | None = None
    scale: np.ndarray | None = None


class Batch:
    """One row of numbered batches with the answers of the orders so far."""

    def __init__(self, row: dict, known: Known, learn: bool):
        self.number, self.ids, self.held, self.known = row["batch"], row["ids"], np.array(row["held"], bool), known
        (self.lengths,), (self.tokens,), (words,), (counts,) = (unpack(row[c]) for c in ("lengths", "tokens", "words", "counts"))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.start_place = len(words)
        end = self.tokens[self.lengths[0] - 1]
        # a start is as frequent as an end
        self.words, self.counts = np.append(words, _START), np.append(counts, counts[end])
        self.learnt = np.repeat(~self.held & learn, self.lengths)
        self.grams: list[Grams] = []
        for order in range(2, len(known.buckets) + 1):
            answers = row.get(f"answers{order}")
            if answers is None:
                break
            self.grams.append(self.distinct())
            self.take_answers(order, sorted(row.pop(f"answers{order}"), key=lambda a: a["bucket"]))

    def below(self) -> np.ndarray:
        """Counts of the n-grams of the highest order so far."""
        return self.grams[-1].total if self.grams else self.counts

    def words_below(self) -> list[np.ndarray]:
        """Numbers of their words from the last to the first."""
        words = [self.words]
        for g in self.grams:
            words = [self.words[g.word], *(w[g.context] for w in words)]
        return words

    def distinct(self) -> Grams:
        counts = self.below()
        at = self.grams[-1].at if self.grams else self.tokens
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = at[:-1]
        before[self.starts] = -1 if self.grams else self.start_place
        ok = before >= 0
        ok[ok] = counts[before[ok]] > 0
        places = np.flatnonzero(ok)
        code, inverse = np.unique(before[places] << 32 | self.tokens[places], return_inverse=True)
        own = np.full(len(self.tokens), -1, np.int32)
        own[places] = inverse
        suffix = np.empty(len(code), np.int32)
        suffix[inverse] = at[places]
        return Grams((code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), suffix, own)

    def requests(self, order: int, g: Grams):
        """Rows (bucket, context, part, n-gram or -1) in the order of sending: a context dealt to several buckets asks all of
        them for their sums."""
        counts = self.below()
        hashes = np.zeros(len(counts), np.uint64)
        for w in self.words_below():
            hashes = mixed(hashes ^ w.view(np.uint64) * _GOLDEN) + np.uint64(1)
        parts = 1 + counts // SPLIT
        context, gram, part = g.context, np.arange(len(g.context), dtype=np.int32), np.zeros(len(g.context), np.int32)
        common = parts[context] > 1
        if common.any():
            rows = np.flatnonzero(common)
            own = (mixed(self.words[g.word[rows]].view(np.uint64)) >> np.uint64(20)).astype(np.int64) % parts[context[rows]]
            shared = np.unique(context[rows])
            more = np.concatenate([context[rows], np.repeat(shared, parts[shared])])
            own = np.concatenate([own, *(np.arange(n) for n in parts[shared])])
            rows = np.concatenate([rows, np.full(len(more) - len(rows), -1)])
            by = np.lexsort((rows, own, more))
            rest = np.flatnonzero(~common)
            context, gram, part = np.concatenate([context[rest], more[by]]), np.concatenate([rest, rows[by]]), np.concatenate([part[rest], own[by]])
        bucket = spread(hashes[context] + part.astype(np.uint64) * _GOLDEN, self.known.buckets[order - 1])
        by = _by_bucket(bucket)
        return bucket[by].astype(np.int32), context[by], part[by], gram[by], parts

    def asked(self, order: int) -> list[pa.RecordBatch]:
        """Bodies: of each context its part and words, and how many rows follow; of each row its word, the times it was
        learnt and the count of the n-gram without its first word."""
        g = self.distinct()
        times = np.bincount(g.at[self.learnt & (g.at >= 0)], minlength=len(g.context))
        bucket, context, part, gram, _ = self.requests(order, g)
        lower, words = self.below()[g.suffix], self.words_below()
        real = gram >= 0
        word, times, low = (np.where(real, x[gram], none) for x, none in ((self.words[g.word], _START), (times, 0), (lower, 0)))
        starts, rows = _runs(bucket), []
        for a, b in zip(starts, [*starts, len(bucket)][1:], strict=True):
            heads = _runs(context[a:b], part[a:b])
            at = a + heads
            rows.append(_row("ask", int(bucket[a]), self.number, pack(part[at].astype(np.int64), np.diff([*heads, b - a]), *(w[context[at]] for w in words), word[a:b], times[a:b], low[a:b])))
        return _table(_ROW, rows).to_batches()

    def take_answers(self, order: int, answers: list[dict]) -> None:
        """Fills in counts, probabilities and what the order above needs of the last of grams."""
        g = self.grams.pop()
        bucket, context, part, gram, parts = self.requests(order, g)
        counts = self.below()
        g.total = np.zeros(len(g.context), np.int64)
        real = gram >= 0
        bodies = [unpack(answers.pop(0)["body"]) for _ in range(len(answers))]
        total = np.concatenate([b[0] for b in bodies]) if bodies else np.zeros(0, np.int64)
        g.total[gram[real]] = total[real]
        starts = _runs(bucket, context, part)
        head = context[starts]
        split, missing = parts[head] > 1, np.zeros(len(starts), bool)
        if len(starts):
            missing = np.add.reduceat(((total == 0) & real).astype(np.int64), starts) > 0
        n = len(counts)
        told = split | (counts[head] != 1)
        tallies = np.concatenate([b[1].reshape(GOOD_TURING + 1, -1) for b in bodies], axis=1) if bodies else np.zeros((GOOD_TURING + 1, 0))
        d, c = self.known.d[order - 1], np.maximum(counts, 1).astype(float)
        # discounted occurrences of a context's followers
        taken = np.bincount(head[told], np.array([*(d[r] * r for r in range(1, GOOD_TURING + 1)), 1.0]) @ tallies, n)
        taken = np.asarray(taken, float)
        taken[head[~told]] = d[1]
        taken = taken / c
        single = np.bincount(head[split | missing], np.concatenate([b[2].view(np.float64) for b in bodies]) if bodies else None, n)
        del bodies, tallies, total, bucket, context, part, gram, real, parts
        left = np.where(taken > 0, np.maximum(1 - taken, 1 / (c + 1)), 1.0)
        scale = np.where(taken > 0, (1 - left) / np.maximum(taken, 1e-300), 0.0) / c
        if order == 2:
            lower = self.known.unigrams.p(self.counts)
        else:
            below = self.grams[-1]
            lower = below.p
            single = single * below.scale[below.suffix]
        backoff = left / np.maximum(1 - single, 1e-12)
        g.p = np.where(g.total > 0, scale[g.context] * discounted(d, g.total), backoff[g.context] * lower[g.suffix])
        g.scale = scale
        self.grams.append(g)

    def logs(self) -> np.ndarray:
        """log10 P of each token, by the highest order whose context was seen."""
        p = self.known.unigrams.p(self.counts)[self.tokens]
        for g in self.grams:
            p = np.where(g.at >= 0, g.p[g.at] if len(g.p) else p, p)
        return np.log10(p)


def _send_grams(order: int, known: Known, learn: bool):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from Batch(batch.slice(i, 1).to_pylist()[0], known, learn).asked(order)
                give_back()

    return send


def _numbered(values: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 32 that tell values apart."""
    return values if not len(values) or values.max() < 1 << 32 else np.unique(values, return_inverse=True)[1]


def _add_grams(order: int, known: Known):
    def add(table: pa.Table) -> pa.Table:
        bucket, numbers = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        asked = [unpack(x.as_py()) for x in table.column("body")]
        n_heads, n_rows = [len(a[0]) for a in asked], [len(a[-1]) for a in asked]
        column = lambda i: np.concatenate([a[i] for a in asked])
        part, runs, words, follower, times, low = column(0), column(1), [column(i) for i in range(2, order + 1)], column(-3), column(-2), column(-1)
        asked.clear()
        head = np.unique(part << 48 | words[0], return_inverse=True)[1]
        for w in words[1:]:
            head = np.unique(head << 32 | _numbered(w), return_inverse=True)[1]
        n = int(head.max()) + 1
        code, at = np.unique(np.repeat(head, runs) << 32 | _numbered(follower), return_inverse=True)
        total = np.bincount(at, times, len(code)).astype(np.int64)
        some = np.empty(len(code), np.int64)  # a row of each; all of them say the same
        some[at] = np.arange(len(at))
        of, word, low, seen = code >> 32, follower[some], low[some], total > 0
        del code, some
        # of each context: followers seen 1..K times, occurrences of the others, and the sum of their probabilities without the
        # context's first word, up to a factor that the batch knows
        few = np.minimum(total, GOOD_TURING + 1)
        sums = [np.bincount(of[few == r], minlength=n) for r in range(1, GOOD_TURING + 1)]
        sums.append(np.bincount(of[few > GOOD_TURING], total[few > GOOD_TURING], n).astype(np.int64))
        lower = known.unigrams.p(low) if order == 2 else discounted(known.d[order - 2], low)
        single = np.bincount(of[seen], lower[seen], n)
        whole = np.bincount(of, total, n)
        at_head = np.empty(n, np.int64)
        at_head[head] = np.arange(len(head))
        inside = np.unique(of[seen])
        at_heads = at_head[inside]
        model = pack(part[at_heads], np.bincount(of[seen], minlength=n)[inside], *(w[at_heads] for w in words), word[seen], total[seen], low[seen])
        rows, row_from, head_from = [_row("model", bucket, -1, model, _tally(total[seen]))], 0, 0
        for number, heads, size in zip(numbers, n_heads, n_rows, strict=True):
            own, rows_of = head[head_from : head_from + heads], slice(row_from, row_from + size)
            if number >= 0:
                starts = np.cumsum(runs[head_from : head_from + heads]) - runs[head_from : head_from + heads]
                counts, real = total[at[rows_of]], follower[rows_of]
                # a row that asks for sums only has the word of a start, which follows nothing
                split = np.logical_or.reduceat(real == _START, starts)
                missing = np.logical_or.reduceat((counts == 0) & (real != _START), starts)
                told = split | (whole[own] != 1)
                rows.append(_row("answer", bucket, number, pack(counts, np.concatenate([s[own[told]] for s in sums]), single[own[split | missing]])))
            row_from, head_from = row_from + size, head_from + heads
        give_back()
        return _table(_ROW, rows)

    return add


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(known: Known):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Batch(batch.slice(i, 1).to_pylist()[0], known, False)
                logs = own.logs()
                own.grams.clear()
                one = np.log10((own.counts + 0.5) / (known.unigrams.total + 0.5 * (known.unigrams.types + 1)))
                starts = own.starts
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                columns = [own.ids, own.held, own.lengths, add((own.counts[own.tokens] > 0).astype(np.int64)), add(one[own.tokens]), add(logs)]
                del own, logs  # before the next one is opened
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    return score


def _with_answers(batches: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    told = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "body")).alias(name))  # what the batch has asked for
    return batches.join(told, "batch", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<bucket:int,body:binary>>")))


def _exchange(asked: DataFrame, add, name: str, model: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(model, answers) of one order; model is one that is there already."""
    rows = asked if model is None else asked.unionByName(model.select(*asked.columns))
    told = cut(rows.groupBy("bucket").applyInArrow(add, _ROW), name, by=("kind", "slice"))
    return told.where("kind = 'model'"), told.where("kind = 'answer'")


def _sums(model: DataFrame) -> np.ndarray:
    found = model.agg(*[F.sum(F.get("tally", F.lit(i))).alias(f"t{i}") for i in range(_TALLY + GOOD_TURING + 2)]).first()
    return np.array([x or 0 for x in found], dtype=np.int64)


def katz(docs: DataFrame, key: str = "doc_id", order: int = ORDER, model: Model | None = None) -> tuple[DataFrame, Model]:
    """(scores, model). Without a model, one is learnt from the rows whose crc32(key as text) modulo 5 isn't 1, rows without
    key included; with one, nothing is learnt and all rows are held out.

    A null text is empty: one end token. With nothing to learn from, all words are unseen. Repeated rows count each time.
    Other columns are not read.
    """
    learn, found = model is None, Model()
    batches = cut(encoded(docs, key, learn), "batches")
    size = batches.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    buckets = [1 + (size.words or 0) // BUCKET_WORDS] + [1 + (size.tokens or 0) // BUCKET_GRAMS] * (order - 1) if learn else model.buckets
    found.buckets = buckets[:1]
    asked = batches.select("batch", "held", "lengths", "words", "tokens").mapInArrow(_send_words(buckets[0]), _ROW)
    counts, answers = _exchange(asked, _add_words, "words", None if learn else model.tables[0])
    tally = _sums(counts)
    found.tables, found.unigrams = [counts], Unigrams(tally[:_TALLY], tally[_TALLY:])
    found.d = [found.unigrams.d]
    plain = cut(_with_answers(batches, answers, "answers").mapInArrow(_number_words(buckets[0]), _NUMBERED), "batches")
    drop_table(batches)
    drop_table(answers, "kind=answer")
    told = plain
    for m in range(2, len(buckets) + 1):
        found.buckets = buckets[:m]
        asked = plain.mapInArrow(_send_grams(m, found.known(), learn), _ROW)
        counts, answers = _exchange(asked, _add_grams(m, found.known()), f"grams{m}", None if learn else model.tables[m - 1])
        found.tables.append(counts)
        found.d.append(discounts(_sums(counts)[:_TALLY]))
        told = _with_answers(plain, answers, f"answers{m}")
        if m < len(buckets):
            told = cut(told, "batches")
            drop_table(plain)
            drop_table(answers, "kind=answer")
            plain = told
    scored = cut(told.mapInArrow(_score(found.known()), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    drop_table(plain)
    drop_table(answers, "kind=answer")
    return scored.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(found.unigrams.total).cast("long").alias("train_tokens"), "base_score", "score"), found


def katz_scores(docs: DataFrame, key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (key, text): see katz()."""
    return katz(docs, key, order)[0]
