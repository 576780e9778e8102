"""Tables of a container's descriptive records: audio, cameras, metadata, frames, sensors, rigs, objects, tracks, harmonics.

One grammar tells each record's layout, for reading and for writing: a field is ``name:form``, where the form is a number
of ``struct``, ``s`` a string, ``b`` a blob, ``m`` a map of strings; a ``*`` repeats the fields after it as often as a
count says. Fields that a later writer appended are left alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftfield.sources.container import OPCODES, RECORD, Fault, Reader, _parsed, kept_stream, whole
from driftfield.sources.storage import dealt

SPARK = {"B": "int", "H": "int", "I": "long", "Q": "long", "f": "float", "d": "double", "s": "string", "b": "binary", "m": "map<string,string>"}
ROT, SHIFT = "qx:d qy:d qz:d qw:d", "tx:d ty:d tz:d"
#: What each record holds, in order. ``I*`` and ``B*`` begin a group that repeats to the closing bracket.
LAYOUTS = {
    "Footer": "summary_start:Q summary_offset_start:Q summary_crc:I",
    "Audio": "codec:s start_sec:d data:b",
    "AudioSource": f"source_id:I name:s codec:s channel_layout:s data_length:Q start_sec:d duration_sec:d gain:d flags:B px:d py:d pz:d {ROT} I*[ t:d px:d py:d pz:d {ROT} ] interpolation:s",
    "AudioData": "source_id:I data:b",
    "Camera": "fov_y_deg:d px:d py:d pz:d lx:d ly:d lz:d I*[ t:d px:d py:d pz:d lx:d ly:d lz:d ] interpolation:s loop:B",
    "Metadata": "name:s entries:m",
    "Statistics": "gaussian_count:Q chunk_count:I duration_sec:d x0:d y0:d z0:d x1:d y1:d z1:d",
    "Attachment": "name:s media_type:s data:b",
    "SummaryOffset": "group_opcode:B group_start:Q group_length:Q",
    "CoordinateFrame": "name:s handedness:B up_axis:B forward_axis:B length_unit:B metres_per_unit:d",
    "GeodeticAnchor": "frame_name:s latitude_deg:d longitude_deg:d altitude_m:d heading_deg:d",
    "SensorCalibration": f"name:s modality:s camera_model:B width_px:I height_px:I fx:d fy:d cx:d cy:d B*[ distortion:d ] {ROT} {SHIFT} pose_reference:B rig_name:s",
    "RigTrajectory": f"name:s interpolation:B I*[ t:d {ROT} {SHIFT} ]",
    "ObjectTrack": f"object_id:I interpolation:B I*[ t:d {ROT} {SHIFT} ]",
}
#: Fixed value: samples that a trajectory or track may have.
MOST_SAMPLES = 1_000_000


def grammar(kind: str) -> tuple[list, list]:
    """(fields, repeated fields) of a record; in the fields the group stands as (None, count's form)."""
    own, group, inside = [], [], False
    for word in LAYOUTS[kind].split():
        if word.endswith("*["):
            own.append((None, word[0]))
            inside = True
        elif word == "]":
            inside = False
        else:
            (group if inside else own).append(tuple(word.split(":")))
    return own, group


def _read(r: Reader, form: str):
    if form == "s":
        return r.string()
    if form == "b":
        return bytes(r.take(r.get("Q")))
    if form == "m":
        block, out = Reader(r.take(r.get("I"))), {}
        while block.left():
            key = block.string()
            out[key] = block.string()
        return list(out.items())
    return r.get(form)


def _put(form: str, x) -> bytes:
    if form == "s":
        return struct.pack("<I", len(x.encode())) + x.encode()
    if form == "b":
        return struct.pack("<Q", len(x)) + x
    if form == "m":
        block = b"".join(_put("s", k) + _put("s", v) for k, v in x.items())
        return struct.pack("<I", len(block)) + block
    return struct.pack("<" + form, x)


def decoded(kind: str, content: bytes) -> tuple[list, list[list]]:
    """A record's own values, and the rows of its group."""
    own, group = grammar(kind)
    r, values, rows = Reader(content), [], []
    for name, form in own:
        if name is not None:
            values.append(_read(r, form))
            continue
        n = r.get(form)
        if n > MOST_SAMPLES:
            raise Fault("trajectory-samples-past-ceiling")
        rows = [[_read(r, f) for _, f in group] for _ in range(n)]
    return values, rows


def encoded(kind: str, values: list, rows: list[list] = ()) -> bytes:
    """The whole record, head included."""
    own, group = grammar(kind)
    out, left = b"", iter(values)
    for name, form in own:
        if name is None:
            out += struct.pack("<" + form, len(rows)) + b"".join(_put(f, x) for row in rows for (_, f), x in zip(group, row))
        else:
            out += _put(form, next(left))
    return struct.pack(RECORD, OPCODES[kind], len(out)) + out


def table(recs: DataFrame, kind: str) -> DataFrame:
    """A row for each record of a kind, without its group."""
    own = [f for f in grammar(kind)[0] if f[0] is not None]

    def parse(content: bytes) -> Iterator[tuple]:
        yield tuple(decoded(kind, content)[0])

    return _parsed(recs, kind, parse, "path string, " + ", ".join(f"{n} {SPARK[f]}" for n, f in own))


def samples(recs: DataFrame, kind: str) -> DataFrame:
    """A row for each element of the records' groups: the record's first field, the place ``i``, and the group's fields."""
    own, group = grammar(kind)

    def parse(content: bytes) -> Iterator[tuple]:
        values, rows = decoded(kind, content)
        for i, row in enumerate(rows):
            yield (values[0], i, *row)

    ddl = f"path string, {own[0][0]} {SPARK[own[0][1]]}, i int, " if own[0][0] != "t" else "path string, i int, "
    return _parsed(recs, kind, parse, ddl + ", ".join(f"{n} {SPARK[f]}" for n, f in group))


def tracks(recs: DataFrame) -> DataFrame:
    """Samples of object tracks as the as-of operators take them; interpolation 0 is linear, 1 a step."""
    how = table(recs, "ObjectTrack").select("path", "object_id", F.when(F.col("interpolation") == 1, "step").when(F.col("interpolation") == 0, "linear").alias("interpolation"))
    return samples(recs, "ObjectTrack").join(how, ["path", "object_id"])


def _objects(content: bytes) -> Iterator[tuple]:
    r = Reader(content)
    n, dim = r.get("IH")
    for _ in range(n):
        who, label, anchor = r.get("I"), r.string(), list(r.get("3f"))
        flag = r.get("B")
        if flag > 1:
            raise Fault("invalid-object-presence-flag")
        moves = list(r.get("9f")) if flag else None
        flag = r.get("B") if dim else 0
        if flag > 1:
            raise Fault("invalid-object-presence-flag")
        yield who, label, anchor, moves, (list(np.frombuffer(r.take(4 * dim), "<f4").tolist()) if flag else None), dim


def objects(recs: DataFrame) -> DataFrame:
    """Labelled objects: anchor, optional dynamics (nine numbers), optional embedding and the embeddings' declared width."""
    return _parsed(recs, "ObjectTable", _objects, "path string, object_id long, label string, anchor array<float>, dynamics array<float>, embedding array<float>, dim int")


def object_table(entries: list[tuple], dim: int) -> bytes:
    """A whole record of (id, label, anchor, dynamics or None, embedding or None) entries."""
    out = [struct.pack("<IH", len(entries), dim)]
    for who, label, anchor, moves, embedding in entries:
        out.append(struct.pack("<I", who) + _put("s", label) + struct.pack("<3f", *anchor) + (struct.pack("<B9f", 1, *moves) if moves else b"\0"))
        if dim:
            out.append(struct.pack(f"<B{dim}f", 1, *embedding) if embedding else b"\0")
    return struct.pack(RECORD, OPCODES["ObjectTable"], sum(map(len, out))) + b"".join(out)


def parsers() -> dict:
    """What reads each kind of descriptive record."""

    def plain(kind: str):
        return lambda content: [tuple(decoded(kind, content)[0])]

    return {kind: plain(kind) for kind in LAYOUTS} | {"ObjectTable": _objects}


def encoded_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(``file``, ``key``, ``content``) of records made from rows that have ``file``, ``key`` and the layout's fields; the
    repeated fields are an array ``rows`` of structs."""
    own, group = grammar(kind)
    names = [n for n, _ in own if n is not None]
    given = rows.select("file", F.col("key").cast("long").alias("key"), F.struct(*names, *(["rows"] if group else [])).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(2).to_pylist():
                values = [dict(v[n]) if f == "m" else v[n] for n, f in own if n is not None]
                made.append(encoded(kind, values, [[g[n] for n, _ in group] for g in v["rows"]] if group else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["file", "key", "content"])

    return given.mapInArrow(run, "file string, key long, content binary")


def bands(recs: DataFrame) -> DataFrame:
    """(path, chunk, ordinal, band) of coefficient bands; a band belongs to the chunk record before it. Only their first bytes are read."""
    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("opcode") == OPCODES["Chunk"], F.col("ordinal")), ignorenulls=True).over(w)
    placed = recs.where(F.col("fault").isNull()).select("path", "ordinal", "opcode").withColumn("chunk", owner).where(F.col("opcode") == OPCODES["ShBandStream"]).select("path", "ordinal", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, ordinal, at, n, content = [c.to_pylist() for c in batch.columns]
            first = [whole(p, a, min(k, 1), c)[:1] for p, a, k, c in zip(path, at, n, content)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[0] if x else None for x in first], pa.int32())], names=["path", "ordinal", "band"])

    told = recs.where((F.col("opcode") == OPCODES["ShBandStream"]) & F.col("fault").isNull()).select("path", "ordinal", "offset", "length", "content")
    return told.mapInArrow(run, "path string, ordinal int, band int").join(placed, ["path", "ordinal"]).select("path", "chunk", "ordinal", "band")


def harmonics(recs: DataFrame, most: int = 3) -> DataFrame:
    """(path, chunk, band, row, codes) of coefficient bands up to ``most``; a band belongs to the chunk record before it.

    Bands above the cap are dropped by their record's first byte, before anything is decoded.
    """
    mine = recs.select("path", "ordinal", "offset", "length", "content").join(bands(recs).where(F.col("band") <= most), ["path", "ordinal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, chunk, b, at, length, content in zip(*[c.to_pylist() for c in batch.columns]):
                codes = kept_stream(Reader(whole(path, at, length, content)[1:]))[1]
                if any(x.min() < 0 or x.max() > 255 for x in codes.blocks()):
                    raise Fault("sh-code-range")
                first = 0
                for x in codes.blocks():
                    n = len(x)
                    same = lambda v, kind, n=n: pa.repeat(pa.scalar(v, kind), n)
                    lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * codes.channels).astype(np.int32)), pa.array(x.ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([same(path, pa.string()), same(chunk, pa.int32()), same(b, pa.int32()), pa.array(np.arange(first, first + n, dtype=np.int32)), lists], names=["path", "chunk", "band", "row", "codes"])
                    first += n

    return dealt(mine.select("path", "chunk", "band", "offset", "length", "content"), "path", "chunk", "band").mapInArrow(run, "path string, chunk int, band int, row int, codes array<long>")
