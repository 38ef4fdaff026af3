"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Test items are short, documents long, so their Jaccard similarity says little. Items are put into partitions by
the power of two of their shingle count and each keeps the least hash values of its shingles. A document's shingles
are looked up among those of the partitions it is large enough to contain; the share of an item's values found
estimates its containment. Candidates are verified on all shingles of both as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

WIDTH = 5
PERCENT = 80
#: Values kept of each item.
KEPT = 16
#: Rows up to which the items' values, or pairs of ids, are broadcast: of 40 bytes at most, so some 16 MB. Beyond, the joins shuffle.
BROADCAST_ROWS = 400_000
#: Bytes up to which the items' shingles are broadcast.
BROADCAST_BYTES = 16 << 20


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _barrier(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """df with value as a column that the optimizer won't copy into each of its uses."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def _shingles(words: Column, width: int, join) -> Column:
    places = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: join(*[F.get(words, i + k) for k in range(width)]))


def _texts(words: Column, width: int) -> Column:
    return F.array_distinct(_shingles(words, width, lambda *w: F.concat_ws(" ", *w)))


def _with_width(df: DataFrame, widths: list[int], made, name: str, *keep: str) -> DataFrame:
    """A row for each width, with the shingles of that width."""
    parts = [F.struct(F.lit(w).alias("width"), made(w).alias(name)) for w in widths]
    return df.select(*keep, F.inline(F.array(*parts)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, kept: int = KEPT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: pairs where the document has at least percent of the item's distinct shingles.

    Items of fewer words are one shingle, looked for among the documents' runs of as many words; items without words
    or without id, and documents without id, are in no pair. A document or item that is repeated gives repeated pairs
    once; different texts under one id are compared each. Other columns are not read.

    A document is a candidate if it has a quarter of the item's kept values. An item of up to kept shingles is never
    missed; of larger ones, a document with 80 % of the shingles has fewer than 4 of 16 of them by a chance of 2.5e-7.
    """
    worded = _barrier(items.where(F.col("item_id").isNotNull()), "words", _words(F.col("text")), "item_id").where(F.size("words") > 0)
    widths = sorted(r.w for r in worded.select(F.least(F.size("words"), F.lit(width)).alias("w")).distinct().collect())  # width values at most
    if not widths:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    own = F.least(F.size("words"), F.lit(width))
    texts = _with_width(worded, widths, lambda w: _texts(F.col("words"), w), "shingles", "item_id", "words").where(F.col("width") == own)
    texts = texts.select("item_id", "width", "shingles", F.size("shingles").alias("n_item"))
    # a shingle's hash is that of its words' hashes, so documents never build the text
    hashed = _barrier(worded, "hashes", F.transform("words", lambda w: F.xxhash64(w)), "item_id", "words")
    hashed = _with_width(hashed, widths, lambda w: F.array_distinct(_shingles(F.col("hashes"), w, F.xxhash64)), "values", "item_id", "words").where(F.col("width") == own)
    signed = hashed.select("item_id", "width", F.size("values").alias("n_item"), F.slice(F.array_sort("values"), 1, kept).alias("kept"))
    # the least size of a document that can contain an item of the partition
    signed = signed.withColumn("n_kept", F.size("kept")).withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    signed = signed.select("item_id", "width", "part", "n_kept", F.explode("kept").alias("value"))
    least_size = F.ceil(F.pow(F.lit(2), F.col("part")) * percent / 100)
    wide = _barrier(docs.where(F.col("doc_id").isNotNull()), "hashes", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)), "doc_id")
    probes = _with_width(wide, widths, lambda w: _shingles(F.col("hashes"), w, F.xxhash64), "values", "doc_id")
    probes = probes.select("doc_id", "width", F.size("values").alias("n_doc"), F.explode("values").alias("value"))
    hits = probes.join(_small(signed, signed.count()), ["value", "width"]).where(F.col("n_doc") >= least_size)
    found = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("value").alias("hits"), F.first("n_kept").alias("n_kept")).where("4 * hits >= n_kept").select("doc_id", "item_id")
    return _verify(docs, found, texts, widths, percent)


def _verify(docs: DataFrame, found: DataFrame, texts: DataFrame, widths: list[int], percent: int) -> DataFrame:
    found = cut(found, "candidates")
    n = found.count()
    size = texts.agg(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16))).first()[0] or 0
    texts = F.broadcast(texts) if size <= BROADCAST_BYTES else texts
    likely = docs.join(_small(found.select("doc_id").distinct(), n), "doc_id", "left_semi")
    words = _barrier(likely, "words", _words(F.col("text")), "doc_id")
    full = _with_width(words, widths, lambda w: _texts(F.col("words"), w), "doc_shingles", "doc_id")
    # shingles of an item go to its candidates, not with each pair of ids
    both = full.join(_small(found, n), "doc_id").join(texts, ["item_id", "width"]).select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", "doc_shingles")).cast("long").alias("n_shared"))
    return both.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_shared") / F.col("n_item")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that contain no test item."""
    return docs.join(contained_items(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS width, unnest(list_transform(range(1, len(w) - least(len(w), {WIDTH}) + 2), lambda k: array_to_string(w[k:k + least(len(w), {WIDTH}) - 1], ' '))) AS s
    FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT DISTINCT width FROM q),
p AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s FROM d, v WHERE len(w) >= width),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM p JOIN q USING (s, width) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * {PERCENT}
"""
