"""Reading by byte ranges: the index says where chunks lie, and only the chunks, bands and records asked for are fetched.

A file is opened by its front records up to the first chunk, its last bytes, and the summary that these name. What is not
needed to find chunks is framed but not read. Entries are rows, so a condition on their times prunes what is fetched, and
chunks are read by as many tasks as there are entries.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftfield.sources.container import CHUNKS, COLUMNS, INDEX, MAGIC, OPCODES, RECORD, RECORDS, Bins, Fault, Reader, _index, attempted, batches_of, chunk_bins, dequantized, kept_stream
from driftfield.sources.storage import FileRanges, dealt

HEAD = struct.calcsize(RECORD)
#: A footer's record and the closing magic.
TAIL = HEAD + 20 + len(MAGIC)
#: Records that a seek can't do without; all others of the front are framed only.
NEEDED = [OPCODES[k] for k in ("Header", "Quantization", "WindowTable")]
ENTRIES = INDEX + ", summary_crc_ok boolean, file_bytes long, fetched long, fault string"


def framed(ranges, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(opcode, offset, length) of records from a place on, by their heads alone."""
    while at + HEAD <= end:
        opcode, n = struct.unpack(RECORD, ranges.read(at, HEAD))
        if at + HEAD + n > end:
            raise Fault("truncated")
        yield opcode, at, n
        at += HEAD + n


def front_records(ranges) -> list[tuple[int, int, int, bytes | None]]:
    """The records before the first chunk; the content of those that a seek needs."""
    if ranges.size < len(MAGIC) or ranges.read(0, len(MAGIC)) != MAGIC:
        raise Fault("magic-mismatch")
    out = []
    for opcode, at, n in framed(ranges, len(MAGIC), ranges.size):
        if opcode in (OPCODES["Chunk"], OPCODES["DeltaChunk"], OPCODES["Footer"]):
            break
        out.append((opcode, at, n, ranges.read(at + HEAD, n) if opcode in NEEDED else None))
    return out


def summary(ranges) -> tuple[list[tuple], bool | None]:
    """Index entries of the summary that the footer names, and whether its checksum holds (null: none is stated)."""
    if ranges.size < len(MAGIC) + TAIL:
        raise Fault("truncated")
    tail = ranges.read(ranges.size - TAIL, TAIL)
    opcode, n = struct.unpack_from(RECORD, tail)
    if opcode != OPCODES["Footer"] or n != 20 or tail[-len(MAGIC) :] != MAGIC:
        raise Fault("no-chunk-index")
    start, _, crc = struct.unpack_from("<QQI", tail, HEAD)
    if not start:
        raise Fault("no-chunk-index")
    if start > ranges.size - TAIL:
        raise Fault("index-record-mismatch")
    data, at, entries = ranges.read(start, ranges.size - TAIL - start), 0, []
    while at + HEAD <= len(data):
        opcode, n = struct.unpack_from(RECORD, data, at)
        if opcode == OPCODES["ChunkIndex"]:
            rows, fault = attempted(_index, data[at + HEAD : at + HEAD + n])
            if fault:
                raise Fault(fault)
            entries += rows
        at += HEAD + n
    return entries, (zlib.crc32(data) == crc) if crc else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Names alone: no content is read."""
    return spark.read.format("binaryFile").load(path).select("path")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each index entry of the files at ``path``, read from the files' ends; a file that has none is a row with its fault."""
    schema = to_arrow_schema(T.StructType.fromDDL(ENTRIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ranges = FileRanges(name)
                try:
                    found, ok = summary(ranges)
                    rows = [(name, *e, ok, ranges.size, ranges.fetched, None) for e in found]
                except Fault as e:
                    rows = [(name, *[None] * 12, None, ranges.size, ranges.fetched, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], names=schema.names)

    return _files(spark, path).mapInArrow(run, ENTRIES)


def front(spark: SparkSession, path: str) -> DataFrame:
    """The records before the first chunk as ``container.records`` gives them, but that deferred ones have no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [w.split()[0] for w in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    rows = [(name, i, o, at, n, c, None) for i, (o, at, n, c) in enumerate(front_records(FileRanges(name)))]
                except Fault as e:
                    rows = [(name, 0, 0, 0, 0, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _files(spark, path).mapInArrow(run, RECORDS)


def fetched(recs: DataFrame, kind: str) -> DataFrame:
    """The front's records of a kind with their content, each by one range; for the tables of ``scene_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [FileRanges(p).read(at + HEAD, n) for p, at, n in zip(*[batch.column(k).to_pylist() for k in (0, 3, 4)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(content, pa.binary()), batch.column(6)], names=batch.schema.names)

    return recs.where((F.col("opcode") == OPCODES[kind]) & F.col("fault").isNull()).mapInArrow(run, RECORDS)


def payload_ranges(recs: DataFrame, first: int, length: int) -> DataFrame:
    """(path, source_id, part) of audio payloads: so many bytes from ``first`` on, where there are as many; nothing else of them is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, at in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                ranges = FileRanges(path)
                who, n = struct.unpack("<IQ", ranges.read(at + HEAD, 12))
                if first + length <= n:
                    rows.append((path, who, ranges.read(at + HEAD + 12 + first, length)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "source_id", "part"])

    return recs.where((F.col("opcode") == OPCODES["AudioData"]) & F.col("fault").isNull()).mapInArrow(run, "path string, source_id long, part binary")


BINS = CHUNKS.replace(", fault string", ", codes array<array<long>>, fetched long, fault string")


def read_chunk(ranges, offset: int, length: int, t0: float, t1: float, count: int, bands: list[dict], most_band: int) -> tuple[dict, list[Bins], int]:
    """Bins of one chunk, codes of its bands up to ``most_band``, and the level; refuses what the index says otherwise."""
    opcode, n = struct.unpack(RECORD, ranges.read(offset, HEAD))
    if opcode != OPCODES["Chunk"] or n + HEAD != length:
        raise Fault("index-record-mismatch")
    (a, b, level, size), got = chunk_bins(ranges.read(offset + HEAD, n))
    if (a, b, size) != (t0, t1, count):
        raise Fault("index-record-mismatch")
    codes = []
    for band in sorted(bands or [], key=lambda x: x["band"]):
        if band["band"] > most_band:
            continue
        data = ranges.read(band["offset"], band["length"])
        opcode, n = struct.unpack_from(RECORD, data)
        if opcode != OPCODES["ShBandStream"] or n + HEAD != band["length"] or data[HEAD] != band["band"]:
            raise Fault("index-record-mismatch")
        values = kept_stream(Reader(data[HEAD + 1 :]))[1]
        if len(values) != size:
            raise Fault("stream-element-count-mismatch")
        if any(x.min() < 0 or x.max() > 255 for x in values.blocks()):
            raise Fault("sh-code-range")
        codes.append(values)
    return got, codes, level


def lists_of(blocks: list[np.ndarray]) -> pa.Array:
    """Rows of one list for each of the blocks, which have as many rows."""
    m, widths = len(blocks[0]), [b.shape[1] for b in blocks]
    ends = np.concatenate([[0], (np.arange(m)[:, None] * sum(widths) + np.cumsum(widths)).ravel()]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(blocks, axis=1).ravel(), pa.int64()))
    return pa.ListArray.from_arrays(pa.array((np.arange(m + 1) * len(blocks)).astype(np.int32)), inner)


def bins(chosen: DataFrame, most_band: int = 0) -> DataFrame:
    """The elements of the chosen entries as bins, with the codes of bands up to ``most_band`` and the bytes that were fetched.

    An entry that disagrees with its chunk is a row with its fault.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(BINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, n, t0, t1, count, bands in zip(*[c.to_pylist() for c in batch.columns]):
                ranges, fault = FileRanges(path), None
                try:
                    got, codes, level = read_chunk(ranges, at, n, t0, t1, count, bands, most_band)
                except (Fault, EOFError) as e:
                    got, codes, level, count, fault = {}, [], 0, 1, str(e) if isinstance(e, Fault) else "index-record-mismatch"
                parts = [c.blocks() for c in codes]
                for first, m, wide in batches_of(count, got, COLUMNS):
                    same = lambda x, kind, m=m: pa.repeat(pa.scalar(x, kind), m)
                    columns = [same(path, pa.string()), same(at, pa.int64()), same(t0, pa.float64()), same(t1, pa.float64()), same(level, pa.int32()), pa.array(np.arange(first, first + m, dtype=np.int32)), *wide]
                    columns += [lists_of([next(p) for p in parts]) if parts else pa.nulls(m, pa.list_(pa.list_(pa.int64()))), same(ranges.fetched, pa.int64()), same(fault, pa.string())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], names=schema.names)

    want = chosen.where("fault IS NULL").select("path", "chunk_offset", "chunk_length", "t0", "t1", "gaussian_count", "bands")
    # A task for each chunk, whatever file it lies in.
    return dealt(want, "path", "chunk_offset").mapInArrow(run, BINS)


def scene_at(spark: SparkSession, path: str, t: float | None = None, upto: float | None = None, most_band: int = 0) -> DataFrame:
    """Elements in real units of the chunks that cover ``t`` (or overlap ``t`` to ``upto``; all without a time), with ``sh``."""
    chosen = entries(spark, path)
    if t is not None:
        end = float(t if upto is None else upto)
        chosen = chosen.where((F.col("t0") <= float(t)) & (F.lit(float(t)) < F.col("t1"))) if upto is None else chosen.where((F.col("t0") < end) & (F.lit(float(t)) < F.col("t1")))
    return dequantized(bins(chosen, most_band).where("fault IS NULL"), front(spark, path), ["chunk", "row", "level", "codes"]).withColumnRenamed("codes", "sh")


def temporal_model(spark: SparkSession, path: str) -> DataFrame:
    """(path, temporal_model) from the files' first records."""
    from driftfield.sources.container import headers

    return headers(front(spark, path)).select("path", "temporal_model")
