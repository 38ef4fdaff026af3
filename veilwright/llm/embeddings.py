"""Embedding near-dedup with a pivot-permutation index.

Pivots are vectors of a bounded sample. Each vector is described by its nearest pivots in order; inverted lists
hold the vectors under every two pivots of that description, so vectors that meet in a list share at least two.
Their cosine in double precision decides. Long lists are dealt in blocks, pair by pair of blocks, and nothing is
left out of a list. Equal vectors are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

COSINE = 0.9
#: Nearest pivots that describe a vector, at least.
NEAREST = 5
#: Pivots grow with the square root of the vectors, so that lists keep their length, up to this many.
MOST_PIVOTS = 4096
#: Vectors of a list that are multiplied at once.
BLOCK = 1024


def usable(col: Column) -> Column:
    """Not null, no null or non-finite component, some component not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(col, fine) & F.exists(col, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_pivots(entries: DataFrame, n: int) -> np.ndarray:
    """Unit vectors, chosen by the hash of the vector: at most MOST_PIVOTS rows come to the driver."""
    wanted = 1 << max(5, int(np.ceil(np.log2(max(1, n)) / 2)))
    rows = entries.orderBy(F.xxhash64("v"), "id").limit(min(wanted, MOST_PIVOTS)).select("v").collect()
    dim = max((len(r.v) for r in rows), default=1)
    return units(np.array([[*r.v, *[0.0] * (dim - len(r.v))] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))


def nearest_of(n: int) -> int:
    """Nearest pivots that describe a vector beside n pivots: two near vectors share fewer of them the denser the pivots lie."""
    return max(NEAREST, 2 + int(np.log2(max(1, n))) // 2)


def descriptions(own: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, sorted by number."""
    width = min(own.shape[1], pivots.shape[1])
    return np.sort(np.argsort(-(own[:, :width] @ pivots[:, :width].T), axis=1, kind="stable")[:, :nearest], axis=1)


def described(entries: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Rows of the inverted lists: list, id, copies, near (the description, sorted), v. Vectors of other lengths are in other lists."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                part = batch.take(pa.array(rows))
                own = units(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                near = descriptions(own, pivots, nearest)
                m = near.shape[1]
                two = list(combinations(range(m), 2)) or [(0, 0)]
                place = np.repeat(np.arange(len(rows)), len(two))
                key = np.stack([(dim * MOST_PIVOTS + near[:, i]) * MOST_PIVOTS + near[:, j] for i, j in two], axis=1).ravel()
                at = pa.array(place)
                near_rows = pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))
                packed = pa.array([x.tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(at), part.column(1).take(at), near_rows.take(at), packed.take(at)], names=["list", "id", "copies", "near", "unit"])

    return entries.select("id", "copies", F.col("v").cast("array<double>").alias("v")).mapInArrow(lists, "list long, id long, copies long, near array<int>, unit binary")


def _linked(key: int, ids: np.ndarray, copies: np.ndarray, near: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, links, root) of the rows that link between left and right, counted only where this is the first list of the pair."""
    a, b = np.nonzero(unit[left] @ unit[right].T >= least)
    a, b = left[a], right[b]
    once = a < b if left is right else np.ones(len(a), bool)
    a, b = a[once], b[once]
    if not len(a):
        return None
    q, p = key % MOST_PIVOTS, key // MOST_PIVOTS % MOST_PIVOTS
    # pivots before q that aren't p: a pair that shares one of them meets in an earlier list
    early = np.where((near < q) & (near != p), near, -1)
    other = np.where(early < 0, -2, early)
    first = ~(early[a][:, :, None] == other[b][:, None, :]).any(axis=(1, 2))
    a, b = a[first], b[first]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    rows = np.flatnonzero(links)
    return ids[rows], links[rows].astype(np.int64), root[rows]


def linked_in_lists(dealt: DataFrame, least: float) -> DataFrame:
    """dealt: rows of (list, i, j, block, ...) with each (list, i, j) together in a partition, one after another."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, block = (table.column(c).to_numpy() for c in ("list", "i", "j", "block"))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(key) else []
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
            near, unit = table.column("near").to_pylist(), table.column("unit").to_pylist()
            found = []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                if b - a < 2:
                    continue
                rows = np.arange(b - a)
                left = rows[block[a:b] == i[a]]
                right = left if i[a] == j[a] else rows[block[a:b] == j[a]]
                vectors = np.frombuffer(b"".join(unit[a:b]), np.float64).reshape(b - a, -1)
                got = _linked(int(key[a]), ids[a:b], copies[a:b], np.array(near[a:b]), vectors, left, right, least)
                if got:
                    found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "links", "root"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("list", "i", "j"))
            new = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            last = int(new[-1]) + 1 if len(new) else 0  # the last group may go on in the next batch
            if held and (last or (held[-1].column("list")[-1].as_py(), held[-1].column("i")[-1].as_py(), held[-1].column("j")[-1].as_py()) != (key[0], i[0], j[0])):
                if last:
                    held.append(batch.slice(0, last))
                    batch = batch.slice(last)
                yield from solve(pa.Table.from_batches(held))
                held = [batch]
            elif last:
                yield from solve(pa.Table.from_batches([batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return dealt.select("list", "i", "j", "block", "id", "copies", "near", "unit").mapInArrow(match, "id long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = COSINE, nearest: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, n_links, component_id, kept for each row.

    Rows whose vector is null, empty, zero or has a null or non-finite component link with nothing, and so do rows
    without a key. Equal vectors always link. Vectors of different lengths don't. Other columns are not read.
    nearest is nearest_of the pivots unless given.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    entries = cut(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    pivots = fit_pivots(entries, entries.count())
    lists = described(entries, pivots, nearest or nearest_of(len(pivots))) if len(pivots) else entries.sparkSession.createDataFrame([], "list long, id long, copies long, near array<int>, unit binary")
    lists = cut(lists, "lists")
    sizes = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocked = lists.join(sizes.select("list", "blocks"), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    found = cut(linked_in_lists(dealt, least), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), entries.select("id"))
    each = entries.join(counts, "id", "left").join(groups, "id")
    each = each.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(each, "v").select("id", "n_links", "component_id")
    rest = rows.where(~usable(F.col("v")) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", key)
