"""Sharding (op 4): a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash into buckets that fit a worker's memory. Pass 2 takes each bucket whole,
brings its records to a canonical order, shuffles them by Fisher-Yates from the bucket's own seed and writes them.
The buckets one after the other are a uniform permutation; its positions are dealt round to the shards, so that the
shards' counts differ by one row at most (law ``rows``) and a shard's slots have no gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, fresh_path, small_batches, table

SHARDS = 24
SEED = 20240229
#: Bytes of a bucket's records; twice as much is still taken as it is.
BUCKET_BYTES = 32 << 20
#: Buckets up to which their places are broadcast, as one row each.
MOST_BROADCAST = 1_000_000


def record_bytes() -> Column:
    """UTF-8 bytes of the text and eight more."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A permutation of range(n): place i takes the record of a uniform place j <= i."""
    rng = np.random.Generator(np.random.PCG64(seed))
    swap = rng.integers(0, np.arange(1, n + 1)).tolist() if n else []
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        j = swap[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write the rows of ``docs`` (doc_id, text and any others) shuffled to ``path``, and return them as read back, with shard and slot.

    Every row comes back once, whatever its nulls, empty or equal texts; equal rows are told apart by their place in
    ``docs``, which should be a table or a written result, as lost executors read it again. Columns named shard,
    slot, bucket or place are replaced. Nothing is written for an empty table but an empty file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("shard", "slot", "bucket", "place")
    path = path or fresh_path(spark, "shards")
    key = [F.lit(seed), "doc_id", "text"]
    total = docs.agg(F.sum(record_bytes())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    # a bucket that repeated rows overfill is scattered by the rows' places instead
    hot = [r.bucket for r in docs.groupBy(bucket.alias("bucket")).agg(F.sum(record_bytes()).alias("b"), F.count("*").alias("n")).where((F.col("b") > 2 * bucket_bytes) & (F.col("n") > 1)).select("bucket").collect()]
    if hot:
        bucket = F.when(bucket.isin(hot), F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(buckets)).cast("int")).otherwise(bucket)
    scattered = docs.withColumn("bucket", bucket).repartitionById(buckets, "bucket") if buckets > 1 else docs.withColumn("bucket", F.lit(0)).coalesce(1)
    names = scattered.columns

    def pass_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        held = pa.Table.from_batches(rows).combine_chunks()
        del rows
        order = held.select(["bucket", "doc_id"]).append_column("crc", pa.array([hash_of(x) for x in held.column("text").cast(pa.large_binary()).to_pylist()], pa.uint64())).append_column("row", pa.array(range(held.num_rows))).sort_by([("bucket", "ascending"), ("doc_id", "ascending"), ("crc", "ascending")])
        number, row = order.column("bucket").to_numpy(), order.column("row").to_numpy()
        for b in np.unique(number).tolist():
            own = row[number == b]
            own = own[fisher_yates(len(own), (seed, b))]
            for at in range(0, len(own), 2000):
                part = held.take(pa.array(own[at : at + 2000])).append_column("place", pa.array(np.arange(at, min(at + 2000, len(own))), pa.int64()))
                yield from part.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema)
    scattered.mapInArrow(pass_two, f"{fields}, place bigint").write.parquet(path)
    back = spark.read.schema(spark.createDataFrame([], f"{fields}, place bigint").schema).parquet(path)
    sizes = back.groupBy("bucket").agg(F.count("*").alias("n"))  # a row for each bucket
    begins = sizes.select("bucket", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("n")).alias("begin"))
    own = back.join(F.broadcast(begins) if buckets <= MOST_BROADCAST else begins, "bucket")
    position = F.col("begin") + F.col("place")
    return own.select(*[c for c in names if c != "bucket"], (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("bigint").alias("slot"))


def hash_of(text: bytes | None) -> int:
    import xxhash

    return 0 if text is None else xxhash.xxh3_64_intdigest(text) | 1


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shuffled(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", record_bytes().alias("size"), F.coalesce(crc32_of("text"), F.lit(0)).cast("bigint").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
