"""Hilbert-curve ordering: rows near each other on several metadata dimensions come into the same shard.

Each dimension is quantised to a few bits, the cells are numbered along a Hilbert curve, rows are sorted by that
number and the sorted run is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut

BITS = 5
SHARDS = 40


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of coordinates below 2**bits) along the curve: Gray-coded axes, turned level by level."""
    axes = cells.astype(np.int64).T.copy()
    dims = len(axes)
    level = 1 << bits - 1
    while level > 1:
        low = level - 1
        for i in range(dims):
            far = (axes[i] & level) != 0
            swap = np.where(far, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(far, low, swap)
            axes[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    turn, level = np.zeros_like(axes[0]), 1 << bits - 1
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ level - 1, turn)
        level >>= 1
    axes ^= turn
    place = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | axes[i] >> bit & 1
    return place


def hilbert_index(dimensions: list[Column], bits: int = BITS) -> Column:
    @pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_numbers(cells.to_numpy(), bits))

    return place(F.struct(*[d.cast("int").alias(f"d{i}") for i, d in enumerate(dimensions)]))


def category_cell(col: Column, bits: int = BITS) -> Column:
    """Values of a text column: equal values share a cell, null is cell 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % ((1 << bits) - 1) + 1, F.lit(0))


def magnitude_cell(col: Column, bits: int = BITS) -> Column:
    """Half powers of two; null and negative values are cell 0."""
    return F.coalesce(F.least(F.floor(2 * F.log2(F.greatest(col, F.lit(0)) + 1)), F.lit((1 << bits) - 1)), F.lit(0))


def shard_by_curve(rows: DataFrame, dimensions: list[Column], shards: int = SHARDS, key: str = "doc_id", ties: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, curve (place on the curve), shard (from 0) and slot (from 0 without gaps).

    The order is curve, ties, key. Ranges of it are sorted apart and written; only one count per range comes to
    the driver. Null keys come first; repeated rows get slots of their own; an empty table stays empty.
    """
    keep = tuple(dict.fromkeys((*keep, *ties)))
    placed = rows.select(key, *keep, hilbert_index(dimensions).alias("curve"))
    order = ["curve", *ties, key]
    # the range is written with each row: places are the same however often a lost task is run again
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("range", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row per partition
    total, before, first = sum(counts.values()), [], 0
    for part in sorted(counts):
        before.append((part, first))
        first += counts[part]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before or [(0, 0)], "range long, first long"))
    ranked = ranged.join(starts, "range").withColumn("rank", F.col("first") + F.col("at"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)"))
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", F.col("rank") - start).select(key, *keep, "curve", "shard", "slot")


def shard_manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and least and greatest values of each shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def write_shards(rows: DataFrame, sharded: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write rows (unique keys) into one folder per shard, in the order of their slots."""
    placed = rows.join(sharded.select(key, "shard", "slot"), key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents over language, source and size; ties by text, so equal texts of one language and source follow one another in
    the order, and share a shard unless a cut falls between them. Texts of any length count by their bytes only; columns
    named as the result's are not read."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    sized = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    cells = [category_cell(F.col("lang")), category_cell(F.col("source")), magnitude_cell(F.col("size"))]
    return shard_by_curve(sized, cells, shards, ties=("text_crc32",), keep=("size", "text_crc32"))
