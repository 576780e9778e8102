"""Helpers that the training-data operators have in common: tables, shared storage, name-safe row packing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import driftfield

# Worker functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(driftfield)

#: ASCII upper and lower case, and the ASCII white space that ends a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session, else, with a local
    master, one of our own. A cluster has to name one: a folder of the driver's machine would be no other's."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="driftfield-"))
        current = sc.getCheckpointDir()
    return where or current


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not by else spark.read.parquet(path)


def packed(df: DataFrame, name: str = "__row") -> Column:
    """All columns of ``df`` as one struct, so that working columns can't clash with names in the input."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], made: list[str], row: str = "__row") -> DataFrame:
    """The packed input columns again, then ``made``; a made column takes the place of an input column of its name."""
    taken = {m.lower() for m in made}
    return df.select(*[F.col(f"{row}.`{c}`").alias(c) for c in columns if c.lower() not in taken], *made)


def row_keys(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row: equal rows have equal ones, whatever files or tasks they lie in."""
    plain = lambda f: not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
    values = [df[f"`{f.name}`"] if plain(f) else F.to_json(F.struct(df[f"`{f.name}`"].alias("v"))) for f in df.schema.fields]
    nulls = F.concat(F.lit(""), *[F.when(v.isNull(), F.lit("0")).otherwise(F.lit("1")) for v in values])  # a hash passes over nulls
    return [F.xxhash64(F.lit(way), nulls, *values) for way in (1, 2)]


#: Distinct repeated rows up to which their keys are broadcast (24 bytes each), and copies that one task makes of a row at once.
BROADCAST_REPEATS, COPIES = 100_000, 10_000


def numbered(df: DataFrame) -> DataFrame:
    """``__row`` (the packed row), its keys ``__a`` and ``__b``, and ``__copy``: equal rows are numbered from 0.

    Which rows stand more than once is counted on their keys; only those are grouped, and their copies are made again from
    one row each, in blocks of ``COPIES``. So nothing here depends on how rows lie in files, and no task holds a group.
    """
    a, b = row_keys(df)
    keyed = df.select(packed(df), a.alias("__a"), b.alias("__b"))
    repeats = cut(keyed.groupBy("__a", "__b").agg(F.count("*").alias("__n")).where("__n > 1").select("__a", "__b"))
    some = repeats.count()
    if not some:
        return keyed.withColumn("__copy", F.lit(0).cast("long"))
    few = some <= BROADCAST_REPEATS
    many = keyed.join(F.broadcast(repeats), ["__a", "__b"], "left_semi") if few else keyed
    once = many.groupBy("__a", "__b").agg(F.first("__row").alias("__row"), F.count("*").alias("__n"))
    blocks = once.select("__row", "__a", "__b", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))).alias("__from")).repartition("__a", "__b", "__from")
    made = blocks.select("__row", "__a", "__b", F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col("__n")) - 1)).alias("__copy"))
    return made.union(keyed.join(F.broadcast(repeats), ["__a", "__b"], "left_anti").select("__row", "__a", "__b", F.lit(0).cast("long").alias("__copy"))) if few else made


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between runs of ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most`` at most; a larger row is a run of its own."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Rows of a batch that goes to a Python worker, unless the session says otherwise: Spark's own default of 10,000 texts is
#: held in the executor and the worker at once.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"


def arrow_mapped(docs: DataFrame, inputs: list[str], made: list[T.StructField], make: Callable[[list[pa.Array]], Iterable[tuple[int, int, list[pa.Array]]]]) -> DataFrame:
    """``docs`` with the columns ``made``: ``make`` gets the columns ``inputs`` of a batch (texts as binary) and yields
    (from, to, made arrays) for runs of its rows in order.

    Other columns pass through untouched; an input column called like a made one is replaced. Each column travels once.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    taken = {m.name.lower() for m in made}
    kept = [c for c in docs.columns if c.lower() not in taken]
    plain = {f.name: isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.BooleanType)) for f in docs.schema.fields}
    inside = [kept.index(c) if c in kept and plain[c] else -1 for c in inputs]
    extra = [F.col(f"`{c}`") if plain[c] else F.col(f"`{c}`").cast("string") for c, at in zip(inputs, inside) if at < 0]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    given = docs.select(row.alias("__row"), *[x.alias(f"__in{i}") for i, x in enumerate(extra)])
    names = ["__row", *[f"__out{i}" for i in range(len(made))]]
    schema = T.StructType([given.schema["__row"], *[T.StructField(n, m.dataType) for n, m in zip(names[1:], made)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, more = batch.column(0).flatten(), iter(batch.columns[1:])
            given = [fields[at] if at >= 0 else next(more) for at in inside]
            for a, b, out in make([x.cast(pa.binary()) if pa.types.is_string(x.type) else x for x in given]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=names)

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in kept], *[F.col(n).alias(m.name) for n, m in zip(names[1:], made)])


def texts_of(column: pa.Array) -> list[str | None]:
    """The strings of a binary column of texts."""
    return column.cast(pa.string()).to_pylist()


def worker_tool(key: str, build: Callable[[], object]):
    """What ``build`` makes, kept in the Python worker until another key is asked for: functions sent by value have fresh
    globals in each task, and tools of several stages at once would only take memory."""
    cache = sys.modules.setdefault("_driftfield_worker", types.ModuleType("_driftfield_worker")).__dict__
    if cache.get("key") != key:
        cache.pop("tool", None)
        cache["tool"], cache["key"] = build(), key
    return cache["tool"]
