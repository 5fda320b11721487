"""Shared plumbing of the training-data operators: folders, Arrow chunks, words and hashes."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of text that a Python worker handles at once; one longer document is handled alone.
CHUNK_BYTES = 8 << 20
#: Entries that a worker's word cache may hold before it is emptied.
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that no frame needs any more; they stay until the driver collects its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Rows and bytes that the JVM and a Python worker pass each other at once; ``chunks`` gathers them by bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be small where the session has Spark's defaults, 10,000 rows and 64 MB, which a worker and its executor both hold."""
    for key, default, own in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).rstrip("bB") == str(default):
            spark.conf.set(key, str(own))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs with at most ``limit`` bytes of ``column`` each, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run() -> pa.RecordBatch:
        out = held[0] if len(held) == 1 else pa.concat_batches(held)
        held.clear()
        return out

    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin, before = np.cumsum(sizes), 0, 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, before + limit - size, side="right"))
            if end <= begin:
                if held:
                    yield run()
                    size = 0
                    continue
                end = begin + 1
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1]) - before
            begin, before = end, int(ends[end - 1])
            if begin < batch.num_rows:
                yield run()
                size = 0
                pa.default_memory_pool().release_unused()
    if held:
        yield run()
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, the same in every process; holds at most ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: A-Z to a-z, other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hashed_words(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z lower-cased, split at space and \\t-\\r) of all texts, and how many words each has. Only a run's distinct words pass through Python."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), [w.translate(LOWER) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    of = np.fromiter(map(hashes.__getitem__, distinct), dtype=np.uint64, count=len(distinct))
    real = np.fromiter(map(bool, distinct), dtype=bool, count=len(distinct))[code]  # white space at an end leaves an empty word
    return of[code[real]], sums_by_row(real, offsets - offsets[0])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums: the bounds of consecutive rows."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc32_of(column: str) -> F.Column:
    """Unsigned crc32 of a text column's UTF-8 bytes."""
    return F.crc32(F.col(column).cast("binary"))


#: Nodes with more than this part of the links are hubs.
HUBS = 20_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node that its links reach.

    Large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder; a node's neighbours
    are never gathered in one place, only their minimum is taken and joined back. Nodes of more than ``1 / HUBS`` of the
    links, of which there are few, are joined by broadcast, so that no hub's links meet in one task.
    """

    def lowered(e: DataFrame, low: DataFrame, most: int) -> DataFrame:
        """(u, v, m): edges with the minimum of u."""
        hubs = F.broadcast(low.where(F.col("k") > most).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))  # at most 4 * HUBS rows
        e = e.join(hubs, e["u"] == hubs["hub"], "left").withColumn("by", F.when(F.col("hub").isNull(), F.col("u")).otherwise(F.xxhash64("u", "v")))
        return e.join(low.select(F.col("u").alias("by"), "m"), "by", "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))

    def stars(e: DataFrame, n: int) -> DataFrame:
        most = max(1000, n // HUBS)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
        large = lowered(both.where("v > u"), low, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        joined = lowered(down, low, most)
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{name}-edges")
    seen = None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        before, seen, edges = edges, sign, written(stars(edges, sign[0]), f"{name}-stars")
        discard(before)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
