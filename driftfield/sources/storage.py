"""The folder that the driver and all executors share: checkpoints, files that executors write, ranges that they read."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Files that one task keeps open while it puts parts together.
OPEN = 256


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; with a local master that has none, a folder of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines see")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scenes-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage ended by a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as Spark understands it, as a URI that Arrow's file systems open on any machine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return f"file://{whole.getPath()}" if whole.getScheme() == "file" else whole.toString()


class FileRanges:
    """Random access to one file: its size, and exactly the bytes asked for."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)
        self.size = store.get_file_info(place).size
        self.file, self.fetched = store.open_input_file(place), 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise EOFError(f"bytes {offset} to {offset + length} of {self.size}")
        self.fetched += length
        return self.file.read_at(length, offset)


class ByteRanges:
    """The same over bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size, self.fetched = data, len(data), 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise EOFError(f"bytes {offset} to {offset + length} of {self.size}")
        self.fetched += length
        return self.data[offset : offset + length]


def put_one(root: str, content: bytes) -> str:
    """Writes a file of its own name into the folder ``root`` (a URI), from a task; gives its URI."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(root)
    store.create_dir(place, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{place}/{name}") as out:
        out.write(content)
    return f"{root}/{name}"


def scratch(spark: SparkSession, path: str) -> str:
    """URI of a folder of its own beside ``path``, for what tasks write on the way; by its name, no reader of the folder lists it."""
    return f"{uri_of(spark, path).rsplit('/', 1)[0]}/_pieces-{uuid.uuid4().hex}"


def put_files(files: DataFrame, folder: str) -> str:
    """Writes each row (``name``, ``content``) as a file of ``folder``, from the executors; gives the folder back.

    A file is written under a name of the attempt and then renamed, so an attempt that is lost leaves no half of one.
    """
    root = uri_of(files.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(root)
        store.create_dir(place, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("name", "content").mapInArrow(run, "n long").agg({"n": "sum"}).collect()
    return folder


def put_parts(spark: SparkSession, path: str, parts: list[bytes | tuple[str, int, int]]) -> str:
    """Writes one file from its parts in order: bytes, and ranges (URI, offset, length) of files that executors wrote.

    One task streams the ranges; only the bytes pass the driver. The name appears when the file is whole; the files that
    the ranges are of, which are written for it alone, are deleted then.
    """
    target = uri_of(spark, path)
    names = {n: i for i, n in enumerate(dict.fromkeys(p[0] for p in parts if isinstance(p, tuple)))}
    plan: list = []
    for p in parts:
        if isinstance(p, tuple):
            plan.append((names[p[0]], p[1], p[2]))
        elif plan and isinstance(plan[-1], list):
            plan[-1].append(p)
        else:
            plan.append([p])
    told = pickle.dumps((list(names), [b"".join(p) if isinstance(p, list) else p for p in plan]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for data in batch.column(0).to_pylist():
                sources, plan = pickle.loads(data)
                store, place = fs.FileSystem.from_uri(target)
                folder, name = place.rsplit("/", 1)
                store.create_dir(folder, recursive=True)
                own, opened, size = f"{folder}/.{uuid.uuid4().hex}", {}, 0
                with store.open_output_stream(own) as out:
                    for p in plan:
                        if isinstance(p, tuple):
                            if p[0] not in opened:
                                if len(opened) >= OPEN:
                                    for f in opened.values():
                                        f.close()
                                    opened.clear()
                                opened[p[0]] = store.open_input_file(fs.FileSystem.from_uri(sources[p[0]])[1])
                            p = opened[p[0]].read_at(p[2], p[1])
                        out.write(p)
                        size += len(p)
                store.move(own, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["n"])

    spark.createDataFrame([(bytearray(told),)], "plan binary").coalesce(1).mapInArrow(run, "n long").collect()
    for name in names:
        _delete(spark, name)
    return path


def _delete(spark: SparkSession, uri: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(uri)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to tasks by ``keys``: for few rows that each stand for much work, which sizes in bytes don't show."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
