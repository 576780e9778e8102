"""Two-pass external shuffle: scatter rows into memory-sized buckets, Fisher-Yates shuffle and write each, cut shards.

First pass: a seeded hash of the whole row and of its copy number scatters records uniformly into as many buckets as keep
each one within ``bucket_bytes``. Second pass: each bucket, gathered in one task in the order of another hash, is permuted
by Spark's seeded ``shuffle`` (a Fisher-Yates shuffle of the array) and written to the shared folder. The buckets one after
the other are then a random order of all rows, and ``shards`` equal runs of it are the shards: law ``rows``, counts at most
one apart. No key takes part, so no group of copies, source or key can fill a bucket or shard. The order follows from the
rows, the seed and the number of buckets; how rows lie in files or come out of an exchange, and tasks that run again,
don't change it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import numbered, unpacked, written

LAW = "rows"
#: A bucket is so small a part of a task's share of executor memory, within these bounds in bytes: the gathered rows, their
#: array and its permuted copy are held at once, and rows are larger in memory than their texts.
SHARE, LEAST_BYTES, MOST_BYTES = 32, 8 << 20, 512 << 20
#: Bucket manifests of up to so many rows (24 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BUCKETS = 100_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def bucket_size(spark) -> int:
    """Bytes of a bucket that suit the executors: their memory by their cores."""
    conf = spark.sparkContext.getConf()
    memory = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
    return min(MOST_BYTES, max(LEAST_BYTES, memory // int(conf.get("spark.executor.cores", "1")) // SHARE))


def row_bytes(docs: DataFrame) -> Column:
    """About how many bytes a row has: those of its texts and bytes, of nested columns as text, and some for each other column."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    wide = [F.octet_length(F.col(f"`{c}`")) for c, k in kinds.items() if isinstance(k, (T.StringType, T.BinaryType))]
    deep = [F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) for c, k in kinds.items() if isinstance(k, (T.ArrayType, T.MapType, T.StructType))]
    total = F.lit(16 * len(kinds) + 16).cast("long")
    for x in wide + deep:
        total = total + F.coalesce(x, F.lit(0))
    return total


def shuffled_buckets(docs: DataFrame, seed: int = 42, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """The rows (packed as ``__row``) written with ``__bucket`` and ``__pos``, their place in it; and the number of buckets."""
    total = docs.agg(F.sum(row_bytes(docs)).alias("b")).first()["b"] or 0
    n = max(1, math.ceil(total / (bucket_bytes or bucket_size(docs.sparkSession))))
    own = ["__a", "__b", "__copy"]
    spread = numbered(docs).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(n)).cast("int")).withColumn("__h", F.xxhash64(F.lit(~seed), *own))
    # The bucket's number is the partition's: no task holds two.
    inside = spread.repartitionById(n, F.col("__bucket")).sortWithinPartitions("__bucket", "__h", *own)
    permuted = inside.groupBy("__bucket").agg(F.collect_list("__row").alias("rows")).select("__bucket", F.shuffle("rows", seed).alias("rows"))
    placed = permuted.select("__bucket", F.posexplode("rows").alias("__pos", "__row"))
    return written(placed, "shuffled-buckets"), n


def sharded(docs: DataFrame, shards: int = 24, seed: int = 42, bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` in random order: every row with its ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0).

    The first (rows mod ``shards``) shards have one row more than the others. Nulls, empty texts and repeated rows are
    rows like any other; with fewer rows than shards the last shards stay empty, and an empty table gives an empty
    result. Input columns called ``shard`` or ``slot`` are replaced. ``bucket_bytes`` is taken from the executors' memory if
    it isn't given; the order depends on it through the number of buckets.
    """
    placed, n = shuffled_buckets(docs, seed, bucket_bytes)
    counts = placed.groupBy("__bucket").agg(F.count("*").alias("c"))
    # One row a bucket: a running sum over buckets, in blocks, so that no task sees more than the square root of them.
    block = max(1, math.isqrt(n))
    counts = counts.withColumn("b", F.floor(F.col("__bucket") / block))
    starts = F.sum("c").over(_running(["b"], "__bucket")) - F.col("c")
    blocks = counts.groupBy("b").agg(F.sum("c").alias("bc"))
    blocks = blocks.select("b", (F.sum("bc").over(_running([], "b")) - F.col("bc")).alias("b0"), F.sum("bc").over(_running([], None)).alias("total"))
    manifest = counts.withColumn("s", starts).join(blocks, "b").select("__bucket", (F.col("s") + F.col("b0")).alias("start"), "total")
    rows = placed.join(F.broadcast(manifest) if n <= BROADCAST_BUCKETS else manifest, "__bucket")
    g, base = F.col("start") + F.col("__pos"), F.floor(F.col("total") / shards)
    more = F.col("total") % shards
    head = more * (base + 1)
    shard = F.when(g < head, F.floor(g / (base + 1))).otherwise(more + F.floor((g - head) / F.greatest(base, F.lit(1)))).cast("int")
    slot = g - (shard * base + F.least(shard.cast("long"), more))
    return unpacked(rows.withColumn("shard", shard).withColumn("slot", slot.cast("long")), docs.columns, ["shard", "slot"])


def _running(by: list[str], order: str | None):
    from pyspark.sql import Window

    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if order else w


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Writes the shards as ``path``/shard=N, rows of a file in slot order. Buckets are runs of a shard, so a task writes few files."""
    sharded(docs, shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
