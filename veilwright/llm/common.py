"""What the corpus operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of bytes that are not ASCII white space, A-Z lower-cased.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() folds A-Z only and bytes.split() splits at exactly the ASCII white space of WORD_PATTERN."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def fold_bucket(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fresh_name(columns: list[str], name: str) -> str:
    """name, lengthened until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(1)
def _trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Processes live on between tasks: memory that arrays have left goes back to the system, where its library can do that."""
    _trim()(0)


#: Bytes of rows that go to a Python worker at once, where rows are packed arrays.
ARROW_BYTES = 4 << 20
#: Bytes of a row group of tables that cut() writes, rows that a task unpacks at once and shuffled bytes that it gets, about,
#: while cut() runs: a heap of 1 GB has room for 8 tasks.
ROW_GROUP_BYTES, READ_ROWS, PARTITION_BYTES = 8 << 20, 1024, 8 << 20


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (names with __ for dots) while what is inside runs."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str = "cut", by: tuple[str, ...] = (), arrow_bytes: int = 0) -> DataFrame:
    """Write df as a table in the shared folder (a folder for each value of by) and read it back: later jobs start there,
    also after lost executors, and the shuffle files before it go."""
    path = shared_path(df.sparkSession, name)
    limit = {"spark__sql__execution__arrow__maxBytesPerBatch": f"{arrow_bytes}b"} if arrow_bytes else {}
    limit |= {"spark__sql__parquet__columnarReaderBatchSize": str(READ_ROWS), "spark__sql__adaptive__advisoryPartitionSizeInBytes": f"{PARTITION_BYTES}b"}
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **limit):
        # row groups are held whole by the tasks that write and read them
        # nobody waits for the marker of success, and without Hadoop's own library each file on a local disk costs two processes
        options = {"parquet.block.size": str(ROW_GROUP_BYTES), "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
        df.write.options(**options).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shrink_heap(spark: SparkSession) -> None:
    """Let the driver's heap go back to what is in use. Plans of many short jobs leave little but garbage, for which it would
    rather grow to its limit."""
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame, folder: str = "") -> None:
    """Delete the files of a table that cut() wrote, or of those of its folders that are named so, once nothing will read them again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for found in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder not in found:
            continue
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component_id): the smallest id that each id reaches by links (a, b).

    Alternating large-star and small-star steps, so the number of rounds grows with the logarithm of the
    longest chain. The neighbourhood of an id is only ever reduced to its minimum, never gathered. Ids of
    vertices without links are their own component; null ids don't link.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges, "links")
    before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after_edges = cut(small, "links")
        after = after_edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges, done = after_edges, tuple(after) == tuple(before)
        before = after
        if done:
            break
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    if vertices is None:
        return found.unionByName(found.select(F.col("component_id").alias("id"), "component_id").distinct()).distinct()
    return vertices.join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
