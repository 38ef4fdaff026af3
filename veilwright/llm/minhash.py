"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's sketch is the k least hash values of its word shingles. Documents with equal shingle sets are one
representative. A short sketch of every representative tells which of its values others retain as well; who shares
too few can't be similar to anyone. The others get a longer sketch. Its values, ordered from rare to common, give
inverted lists: a representative is listed under its rarest shared values only, as many as two sketches that
overlap enough can't both avoid (prefix filtering). The sketch of the union estimates the similarity of a candidate
pair, and the full shingle sets decide.

Lists may be long. Each is first tied together through two of its members (the one with the commonest values, which
is where copies come from, and another), so a group of n copies costs n checks. What a list holds outside the
component that most of its members are in is then compared with the rest of the list, as far as the values that both
have from there on suffice for their sizes (positional filtering). No list is cut or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, components, cut, drop_table, shrink_heap, words_of

#: Values of the short and of the long sketch. The long one holds the whole set of most documents, so bounds on pairs are exact.
SKETCH, LONG_SKETCH = 64, 16384
_CACHED_WORDS = 300_000
#: Values that a Python worker hands back at once.
_ENTRIES = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that leaves no visible order (xor-shifts and odd multipliers)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (int64); the whole sequence if it is shorter; none of no words."""
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = mixed(total ^ hashes[i : len(words) - span + 1 + i]) + np.uint64(i + 1)
    return np.unique(total.view(np.int64))


def sketches(docs: DataFrame, width: int, k: int = SKETCH, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n (size of the shingle set), set_key (equal for equal sets, null for empty ones), sketch, and the columns of carry."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHashes()
        for batch in batches:
            n, keys, least = [], [], []
            for text in batch.column(1):
                found = shingle_hashes(words_of(text.as_py()), width, known)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                least.append(found[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64())), *batch.columns[2:]], names=[key, "n", "set_key", "sketch", *carry])

    kind = docs.schema[key].dataType.simpleString()
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(key, F.col("text").cast("string"), *carry).mapInArrow(sketch, f"`{key}` {kind}, n long, set_key binary, sketch array<long>{carried}")


def full_sets(docs: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """id, set_key, full: the whole shingle set as packed sorted hashes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(words_of(text.as_py()), width, known).tobytes() for text in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(x) if x else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["id", "set_key", "full"])

    return docs.select(F.col(key).alias("id"), F.col("text").cast("string")).mapInArrow(whole, f"id {docs.schema[key].dataType.simpleString()}, set_key binary, full binary")


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union's sketch that lies in both sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _similar(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have a similarity of percent or more, with shared and whole (sizes of
    intersection and union). Sketches that surely say less are passed over."""
    p = percent / 100
    least = p - 5.2 * (p * (1 - p) / k) ** 0.5
    of = lambda x: reps.select(F.col("id").alias(x), F.col("sketch").alias(f"s_{x}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(_estimate(F.col("s_a"), F.col("s_b"), k) >= least).select("a", "b")
    near = near.join(sets.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, whole = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
                whole.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(whole, pa.int64())], names=["a", "b", "shared", "whole"])

    kind = pairs.schema["a"].dataType.simpleString()
    found = near.select("a", "b", "full_a", "full_b").mapInArrow(exact, f"a {kind}, b {kind}, shared long, whole long")
    return found.where(100 * F.col("shared") >= percent * F.col("whole"))


def least_overlap(n: Column, percent: int, k: int) -> Column:
    """Values that the sketches of a set of this size and of any that is similar enough share at least.

    Sets that surely fit into their sketches share percent of their values. Beyond, the share of the union's sketch
    is a draw without replacement: five standard deviations below its mean.
    """
    p = percent / 100
    m = F.least(n, F.lit(k))
    drawn = F.floor(m * p - 5.2 * F.sqrt(m * p * (1 - p)))
    return F.greatest(F.when(n <= int(k * p), F.floor((n * percent + 99) / 100)).otherwise(drawn), F.lit(1)).cast("int")


def shared_by_sizes(n: Column, m: Column, percent: int) -> Column:
    """Size of the intersection of two sets of n and m values that are similar enough, at least."""
    return F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))


def sharing(entries: DataFrame, sizes: DataFrame, percent: int, k: int) -> DataFrame:
    """entries (id, v) of sketches of k values: id, n, values (f, v) that f > 1 ids have, from rare to common, least (how
    many of them a similar set has too), common; only ids with enough of them."""
    shared = entries.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    listed = entries.join(shared, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("values"))  # k values at most
    listed = listed.join(sizes.select("id", "n"), "id").withColumn("least", least_overlap(F.col("n"), percent, k)).where(F.size("values") >= F.col("least"))
    return listed.withColumn("common", F.aggregate("values.f", F.lit(0.0), lambda s, f: s + F.log(f.cast("double"))))


def long_entries(sets: DataFrame, k: int) -> DataFrame:
    """(id, v): the k least values of each full set."""
    kind = sets.schema["id"].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, _ENTRIES // k)
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                values = [np.frombuffer(x.as_py(), np.int64)[:k] for x in part.column(1)]
                at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.concatenate(values))], names=["id", "v"])

    return sets.select("id", "full").mapInArrow(least, f"id {kind}, v long")


def inverted_lists(listed: DataFrame, percent: int, k: int) -> DataFrame:
    """Entries (v, f, id, n, least, common, ahead) of the prefixes: under its first values each id stands in a list, with the
    number of values from there on (ahead). Two similar sets share no more than either has ahead of the first value
    that they share, so that value is in both prefixes.

    An entry is strong if it has enough ahead for a set of its own size, or is of a set beyond its sketch. Of two similar
    sets the smaller one's entry is strong; a weak one meets strictly smaller sets only, of up to reach values.
    """
    size = F.size("values")
    prefix = F.slice("values", F.lit(1), size - F.col("least") + 1)
    entries = listed.select("id", "n", "least", "common", size.alias("size"), F.posexplode(prefix).alias("i", "x"))
    entries = entries.select(F.col("x.v").alias("v"), F.col("x.f").alias("f"), "id", "n", "least", "common", (F.col("size") - F.col("i")).alias("ahead"))
    whole = F.floor(F.col("n") * 100 / percent) <= k  # so is the sketch of any similar set
    strong = ~whole | (F.col("ahead") >= shared_by_sizes(F.col("n"), F.col("n"), percent))
    reach = F.floor(F.col("ahead") * (100 + percent) / percent) - F.col("n")
    return entries.withColumn("strong", strong).withColumn("reach", reach)


def _enough(percent: int, k: int) -> Column:
    """Whether entries x and y may be of similar sets: both have ahead what their sizes ask for."""
    x, y = F.col("nx"), F.col("ny")
    beyond = F.greatest(x - k, F.lit(0)) + F.greatest(y - k, F.lit(0))
    needed = F.greatest("lx", "ly", shared_by_sizes(x, y, percent) - beyond)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.least("ax", "ay") >= needed)


def near_duplicate_links(docs: DataFrame, reps: DataFrame, width: int, percent: int, k: int = SKETCH, key: str = "doc_id") -> DataFrame:
    """Links (a, b) between representatives (id, set_key, n, sketch) that give the components of all similar pairs."""
    likely = cut(sharing(reps.select("id", F.explode("sketch").alias("v")), reps, percent, k).select("id"), "likely")
    sets = full_sets(docs.join(likely.select(F.col("id").alias(key)), key, "left_semi"), width, key)
    sets = cut(sets.join(reps.select("id", "set_key"), ["id", "set_key"], "left_semi").dropDuplicates(["id"]).select("id", "full"), "sets")
    listed = cut(sharing(long_entries(sets, LONG_SKETCH), reps, percent, LONG_SKETCH), "listed", arrow_bytes=ARROW_BYTES)
    lists = inverted_lists(listed, percent, LONG_SKETCH)
    columns = ("id", "n", "least", "ahead")
    as_x, as_y = ([F.col(c).alias(to) for c, to in zip(columns, (z, f"n{z}", f"l{z}", f"a{z}"), strict=True)] for z in "xy")
    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    enough = _enough(percent, LONG_SKETCH)
    # through two members of each list
    first = F.struct("common", F.negative("id").alias("order"), *columns)
    heads = lists.groupBy("v", "f").agg(F.max(first).alias("p"), F.min_by(F.struct(*columns), F.xxhash64("id")).alias("q"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2")).where("members > 1")
    # of lists with the same members the one of the first value is enough: if it isn't the first that two of them share, none of the others is
    heads = heads.groupBy("members", "m1", "m2").agg(F.min_by(F.struct("v", F.struct(*(F.col(f"p.{c}").alias(c) for c in columns)).alias("p"), "q"), F.struct("f", "v")).alias("h"))
    heads = cut(heads.select("h.*"), "heads")
    # what a list's members have ahead says nothing on a pair that shares an earlier value: ties go by their sizes
    ties = lists.select("v", *as_y).join(heads, "v").select("y", "ny", "ly", F.explode(F.array("p", "q")).alias("h"))
    ties = ties.select("y", "ny", "ly", F.col("h.id").alias("x"), F.col("h.n").alias("nx"), F.col("h.least").alias("lx")).where("x <> y")
    ties = ties.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select(*ordered).distinct()
    links = cut(_similar(ties, reps, sets, percent, k).select("a", "b"), "links")
    shrink_heap(docs.sparkSession)
    # what lists hold outside the component of most of their members; their first one may be far from all others
    of = cut(components(links, listed.select("id")), "components")
    placed = cut(lists.join(of, "id").join(heads.select("v"), "v").select("v", *columns, "strong", "reach", "component_id"), "placed")
    parts = placed.groupBy("v", "component_id").agg(F.sum(F.col("strong").cast("long")).alias("s"), F.count("*").alias("c"))
    main = parts.groupBy("v").agg(F.max_by("component_id", F.struct("s", "c", "component_id")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    placed = placed.join(main.select("v", "main"), "v").withColumn("out", F.col("component_id") != F.col("main"))
    strong, weak = placed.where("strong"), placed.where("NOT strong")
    lowest = F.floor((F.col("n") * percent + 99) / 100)
    weak = weak.where(F.col("reach") >= lowest).withColumn("ny", F.explode(F.sequence(lowest, F.col("reach")))).select("v", *as_x, F.col("component_id").alias("cx"), "out", "ny")
    x = lambda df: df.select("v", *as_x, F.col("component_id").alias("cx"))
    y = lambda df: df.select("v", *as_y, F.col("component_id").alias("cy"))
    met = [
        x(strong.where("out")).join(y(strong), "v"),
        weak.where("out").join(y(strong), ["v", "ny"]),
        weak.where("NOT out").join(y(strong.where("out")), ["v", "ny"]),
    ]
    met = [m.where("cx <> cy").where(enough).select(*ordered) for m in met]
    more = cut(_similar(met[0].unionByName(met[1]).unionByName(met[2]).distinct(), reps, sets, percent, k).select("a", "b"), "links")
    for done in (likely, sets, listed, heads, placed, of):
        drop_table(done)
    shrink_heap(docs.sparkSession)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_shingles, component_id, the columns of carry, kept for each row of docs (key, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles; a component is
    what links reach, named by its smallest key, the one kept. Null and empty texts, and texts without words, have
    an empty set and stay alone; shorter texts are one shingle. Rows without a key link with nothing, have a null
    component and are kept. Rows that repeat a key are one document, of which the text with the least hash of its set
    speaks for all: they get its component, and all are kept if the key is. Other columns are not read.
    """
    own = cut(sketches(docs, width, k, key, carry), "sketches")
    whole = own.where(F.col("set_key").isNotNull() & F.col(key).isNotNull())
    several = cut(whole.groupBy(key).agg(F.min("set_key").alias("link_key"), F.max("set_key").alias("other")).where("link_key <> other").drop("other"), "several")
    speaking, linked = whole, own.withColumn("link_key", F.col("set_key"))
    if not several.isEmpty():
        speaking = whole.join(several, key, "left").where("link_key IS NULL OR link_key = set_key").drop("link_key")
        linked = own.join(several, key, "left").withColumn("link_key", F.when(F.col("set_key").isNotNull(), F.coalesce("link_key", "set_key")))
    reps = cut(speaking.groupBy("set_key").agg(F.min(key).alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "representatives")
    links = near_duplicate_links(docs, reps, width, percent, k, key)
    groups = components(links, reps.select("id"))
    named = reps.select(F.col("set_key").alias("link_key"), "id").join(groups, "id").select("link_key", "component_id")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component_id", key))
    found = linked.join(named, "link_key", "left").select(key, F.col("n").alias("n_shingles"), component.alias("component_id"), *carry)
    return found.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
