"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Each word stands for itself and for its shape (runs of capitals, small letters, digits and each other sign, and
whether it repeats the word before). N-grams of both are hashed into one table of weights; a document's score is
the dot product of the weights with the shares of its n-grams. Weights come from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, fresh_name, give_back
from .minhash import mixed

BITS = 18
#: Labelled rows that a model is fitted on at most, by the hash of their id.
SAMPLE = 8000
EPOCHS = 3
#: Shares of n-grams are small numbers; features are so many times as large.
SCALE = 30.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-3
_CACHED_WORDS = 300_000
_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)|(.)\4*", re.S)


class Words(dict):
    """word -> (hash of the word in small letters, hash of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        shape = _RUNS.sub(lambda m: "A" if m[1] else "a" if m[2] else "0" if m[3] else m[4], word)
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass"), 1)
        return found


def ngram_places(text: str | None, known: Words, bits: int = BITS) -> np.ndarray:
    """Places in the table of all n-grams of a text, repeats included."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    both = np.array([known[w] for w in words], dtype=np.uint64)
    word, shape = both[:, 0], both[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] ^= np.uint64(0x9E3779B97F4A7C15)
    grams = [mixed(word), mixed(shape)]
    for start in (word, shape):
        grams.append(mixed(mixed(start[:-1]) + start[1:]))
    grams.append(mixed(mixed(mixed(shape[:-2]) + shape[1:-1]) + shape[2:]))
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: str | None, known: Words) -> float:
        places = ngram_places(text, known, self.bits)
        total = self.bias + (SCALE * float(self.weights[places].mean()) if len(places) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def follow_the_leader(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """examples, gone through in each epoch: (places without repeats, shares, label). Per-coordinate proximal updates; the bias is a feature that all have."""
    n = 1 << bits
    z, s = np.zeros(n + 1), np.zeros(n + 1)

    def weights(at):
        held = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -held / ((BETA + np.sqrt(s[at])) / ALPHA + L2)

    for _ in range(epochs):
        for places, shares, label in examples:
            at, x = np.append(places, n), np.append(shares * SCALE, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA * w
            s[at] += g * g
    w = weights(np.arange(n + 1))
    return Model(w[:n].astype(np.float32), float(w[n]), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, label and text of at most limit documents that have one, outside fold 0; the least hashes of doc_id. Of an id
    that several rows have, the largest label and the least text count."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_bucket(F.col("doc_id")) != 0))
    chosen = named.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # limit rows
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Model:
    """A model of the labelled sample. Without labelled rows all scores are 0.5, with one class only they lean to it. Rows
    without id or label teach nothing, empty and null texts teach the bias. Other columns are not read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            places, shares = [], []
            for text in batch.column(1):
                found, n = np.unique(ngram_places(text.as_py(), known), return_counts=True)
                places.append(found.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "label", "places", "shares"])

    sample = labelled_sample(docs, labels, label, limit).select("doc_id", "text", "label")
    rows = sample.mapInArrow(count, "doc_id long, label int, places binary, shares binary").toArrow()  # limit rows
    model = follow_the_leader(_Examples(rows))
    del rows
    pa.default_memory_pool().release_unused()
    give_back()
    return model


class _Examples:
    """Rows (doc_id, label, places, shares) of an Arrow table as examples, in an order that doc_id fixes. They stay packed:
    only the one at hand is unpacked, each time that it is asked for."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] * 0x9E3779B1 & 0xFFFFFFFF, ids[i]))
        self.label, self.places, self.shares = (rows.column(c) for c in ("label", "places", "shares"))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for i in self.order:
            places, shares = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in ((self.places, np.int32), (self.shares, np.float32)))
            yield places, shares.astype(np.float64), self.label[i].as_py()


def rated(docs: DataFrame, make) -> tuple[DataFrame, str]:
    """docs with a column of scores, under a name of its own. make() gives a task the function from text to score."""
    names = docs.columns
    name = fresh_name(names, "rating")
    text = fresh_name([*names, name], "rated_text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(rate, f"{fields}, {name} double"), name


def with_score_columns(docs: DataFrame, make, least: float) -> DataFrame:
    """docs with score and predicted (score >= least), which take the place of columns with these names."""
    found, name = rated(docs, make)
    own = [F.col(name).alias("score"), (F.col(name) >= least).cast("int").alias("predicted")]
    return found.select(*[c for c in docs.columns if c.lower() not in ("score", "predicted")], *own)


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def make():
        known, model = Words(), shared.value
        return lambda text: model.score(text, known)

    return make


def with_scores(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= least), in the place of columns with these names. Null and empty
    texts get the score of a text without n-grams. Rows are scored one by one: ids may be null or repeat."""
    return with_score_columns(docs, _scorer(docs, model), least)


def good_ones(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs that score least or more."""
    found, name = rated(docs, _scorer(docs, model))
    return found.where(F.col(name) >= least).select(*docs.columns)
