"""Queries over container files that are written from the tables: descriptive records, read back through the sources.

Each file holds what belongs to one region number. The relations that go into files are told twice, here and in SQL; the
files are written by executors into the shared folder, once a session and set of tables.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftfield.functions import temporal
from driftfield.functions.numeric import micro
from driftfield.operators import asof, rules
from driftfield.plans.relational import query, sql_mu
from driftfield.sources import container as C
from driftfield.sources import derived as S
from driftfield.sources import scene_records as R
from driftfield.sources.container import MAGIC, put_record, put_string  # by name: what goes to workers must not hold modules
from driftfield.sources.scene_records import object_table
from driftfield.sources.storage import put_files, shared_dir

_MADE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` makes, once for a session and a set of tables."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def assembled(parts: DataFrame) -> DataFrame:
    """(``name``, ``content``): the records of each ``file`` by ``rank`` and ``key``, between the magics."""
    held = parts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "content"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [MAGIC + b"".join(x["content"] for x in row) + MAGIC for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["name", "content"])

    return held.select("file", "all").mapInArrow(run, "name string, content binary")


IDENTITY = {"qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}


def _file(number):
    return F.concat(F.lit("r"), (number % 5).cast("string"))


def _d(x):
    return x.cast("double")


def _samples(n, **fields):
    """An array of ``n`` structs, from expressions of their place."""
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), F.lit(1), n.cast("int")), lambda i: F.struct(*[(f(i) if callable(f) else F.lit(f)).cast("double").alias(k) for k, f in fields.items()]))


def relations(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Rows of every kind of record, with their ``file`` and ``key``."""
    region, nation, supplier = (S.read(spark, sf, t) for t in ("region", "nation", "supplier"))
    named = nation.join(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    sup = supplier.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    none = {k: F.lit(v) for k, v in IDENTITY.items()}
    per_region = named.groupBy("n_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", _text(n))))).alias("entries"), F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    region = region.join(per_region, r == F.col("n_regionkey"))
    path = F.transform("keys", lambda k: F.struct(_d(k).alias("t"), (k / F.lit(2.0)).alias("px"), F.lit(1.0).alias("py"), _d(k % 3).alias("pz"), F.lit(0.0).alias("lx"), F.lit(0.0).alias("ly"), F.lit(0.0).alias("lz")))
    audio = {"t": lambda i: i * 3.0, "px": lambda i: F.col("s_nationkey") + i, "py": lambda i: i * 2.0, "pz": 0.0, **IDENTITY}
    steps = {"t": lambda i: i * 5.0, **IDENTITY, "tx": lambda i: i * (s % 10), "ty": lambda i: i * 2.0, "tz": 0.0}
    rig = {"t": lambda i: F.when((n % 8 == 3) & (i == 1), F.lit(-1.0)).otherwise(i * 2.0), **IDENTITY, "tx": lambda i: i * n / 4.0, "ty": lambda i: i * 1.0, "tz": 0.0}
    emb = S.read(spark, sf, "embeddings")
    return {
        "CoordinateFrame": region.select(_file(r).alias("file"), r.alias("key"), F.col("r_name").alias("name"), (r % 4).alias("handedness"), F.lit(2).alias("up_axis"), F.lit(4).alias("forward_axis"), (r % 5).alias("length_unit"), F.when(r % 2 == 0, 0.0).otherwise(0.25 * (r + 1)).alias("metres_per_unit")),
        "GeodeticAnchor": named.select(_file(F.col("n_regionkey")).alias("file"), n.alias("key"), F.when(n % 6 == 0, "nowhere").otherwise(F.col("r_name")).alias("frame_name"), _d(n * 11 - 100).alias("latitude_deg"), _d(n * 13 - 150).alias("longitude_deg"), (n / 4.0).alias("altitude_m"), _d(n * 14).alias("heading_deg")),
        "SensorCalibration": sup.select(_file(F.col("s_nationkey")).alias("file"), s.alias("key"), F.col("s_name").alias("name"), F.when(s % 2 == 0, "lidar").otherwise("camera").alias("modality"), (s % 3).alias("camera_model"), (640 + s).alias("width_px"), F.lit(480).alias("height_px"), (500 + s / 8.0).alias("fx"), F.lit(500.0).alias("fy"), (320 + s / 2.0).alias("cx"), F.lit(240.0).alias("cy"), _samples(s % 5, distortion=lambda i: i / 16.0).alias("rows"), *[v.alias(k) for k, v in none.items()], _d(F.col("s_nationkey")).alias("tx"), F.lit(0.5).alias("ty"), F.lit(0.0).alias("tz"), (s % 2).alias("pose_reference"), _rig(s).alias("rig_name")),
        "RigTrajectory": named.select(_file(F.col("n_regionkey")).alias("file"), n.alias("key"), F.col("n_name").alias("name"), (n % 3).alias("interpolation"), _samples(2 + n % 4, **rig).alias("rows")),
        "AudioSource": sup.select(_file(F.col("s_nationkey")).alias("file"), s.alias("key"), s.alias("source_id"), F.col("s_name").alias("name"), F.lit("pcm").alias("codec"), F.when(s % 6 == 0, "stereo").otherwise("mono").alias("channel_layout"), F.octet_length("s_name").alias("data_length"), _d(s % 11 * 2).alias("start_sec"), (s % 5 * 1.5).alias("duration_sec"), ((s % 6 - 1) / 4.0).alias("gain"), (s % 4).alias("flags"), _d(s % 10).alias("px"), F.lit(1.0).alias("py"), F.lit(0.0).alias("pz"), *[v.alias(k) for k, v in none.items()], _samples(s % 4, **audio).alias("rows"), F.when(s % 3 == 0, "step").when(s % 7 == 1, "spline").otherwise("linear").alias("interpolation")),
        "AudioData": supplier.where("s_suppkey % 7 <> 0").select(_file(F.col("s_nationkey")).alias("file"), s.alias("key"), s.alias("source_id"), F.when(s % 13 == 1, F.substring("s_name", 1, 4)).otherwise(F.col("s_name")).cast("binary").alias("data")),
        "Audio": region.select(_file(r).alias("file"), r.alias("key"), F.col("r_name").alias("codec"), _d(r).alias("start_sec"), F.col("r_name").cast("binary").alias("data")),
        "Camera": region.select(_file(r).alias("file"), r.alias("key"), (40.0 + r).alias("fov_y_deg"), _d(r).alias("px"), F.lit(0.0).alias("py"), F.lit(1.0).alias("pz"), F.lit(0.0).alias("lx"), F.lit(0.0).alias("ly"), F.lit(0.0).alias("lz"), path.alias("rows"), F.lit("linear").alias("interpolation"), (r % 2).alias("loop")),
        "Metadata": region.select(_file(r).alias("file"), r.alias("key"), F.col("r_name").alias("name"), "entries"),
        "Attachment": named.select(_file(F.col("n_regionkey")).alias("file"), n.alias("key"), F.col("n_name").alias("name"), F.lit("text/plain").alias("media_type"), F.repeat("n_name", 1 + n % 3).cast("binary").alias("data")),
        "Statistics": region.select(_file(r).alias("file"), r.alias("key"), F.lit(0).alias("gaussian_count"), F.size("keys").alias("chunk_count"), F.lit(30.0).alias("duration_sec"), *[_d(F.element_at("keys", 1) * k).alias(f"{x}0") for k, x in enumerate("xyz")], *[_d(F.element_at("keys", -1) * k).alias(f"{x}1") for k, x in enumerate("xyz")]),
        "ObjectTrack": sup.select(_file(F.col("s_nationkey")).alias("file"), s.alias("key"), (s % 40).alias("object_id"), (s % 3).alias("interpolation"), _samples(1 + s % 4, **steps).alias("rows")),
        "ObjectTable": emb.select(_file(F.col("label")).alias("file"), F.lit(0).alias("key"), (F.col("vec_id") % 500).alias("object_id"), F.concat(F.lit("label "), _text(F.col("label"))).alias("label"), F.slice("embedding", 1, 3).alias("anchor"), F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 4, 9)).alias("dynamics"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), "vec_id"),
    }


def _text(x):
    return x.cast("string")


def _rig(s):
    return F.when(s % 2 == 0, "").when(s % 9 == 0, "rigless").otherwise(F.col("n_name"))


RANKS = {kind: i for i, kind in enumerate(["AudioSource", "AudioData", "Audio", "CoordinateFrame", "SensorCalibration", "RigTrajectory", "GeodeticAnchor", "ObjectTable", "ObjectTrack", "Camera", "Metadata", "Attachment", "Statistics"])}


def _tables(rows: DataFrame) -> DataFrame:
    """Object tables: one record a file."""
    held = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("vec_id", "object_id", "label", "anchor", "dynamics", "embedding"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [object_table([(e["object_id"], e["label"], e["anchor"], e["dynamics"], e["embedding"]) for e in row], 64) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * batch.num_rows, pa.int64()), pa.array(data, pa.binary())], names=["file", "key", "content"])

    return held.select("file", "all").mapInArrow(run, "file string, key long, content binary")


def _front(model, scheme, cutoff=0.05):
    """A header and a grid, with the models and schemes that the rows name."""

    def make(content_model: str, content_scheme: str, who: int) -> bytes:
        head = put_string("default") + put_string("tables") + struct.pack("<dQd", 30.0, 0, cutoff) + put_string(content_model) + struct.pack("<6dBBI", *[0.0] * 6, 0, who % 2, 0)
        grid = put_string(content_scheme) + struct.pack("<11dB", 0, 0, 0, 0.01, float("nan") if who == 2 else 0.02, 0.001, 0.01, 0.01, 0.1, 0.002, 0.02, 1) + struct.pack("<I", 0)
        return put_record("Header", head) + put_record("Quantization", grid)

    return F.udf(make, "binary")(model, scheme, F.col("r_regionkey"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the files of descriptive records, framed and kept."""

    def make() -> DataFrame:
        given = relations(spark, sf)
        parts = [(_tables(given[kind]) if kind == "ObjectTable" else R.encoded_rows(given[kind], kind)).withColumn("rank", F.lit(10 + rank)) for kind, rank in RANKS.items()]
        r = F.col("r_regionkey")
        head = _front(F.when(r == 4, "moving-mesh").otherwise("gaussian-birth"), F.when(r == 3, "vector").otherwise(C.SCHEME))
        front = S.read(spark, sf, "region").select(_file(r).alias("file"), F.lit(0).cast("long").alias("key"), head.alias("content"), F.lit(0).alias("rank"))
        files = assembled(reduce(DataFrame.unionByName, [*parts, front]))
        return C.records(spark, put_files(files, folder(spark, "described"))).withColumn("file", F.element_at(F.split("path", "/"), -1)).cache()

    return once(spark, sf, "described", make)


def table(spark, sf, kind):
    return R.table(records(spark, sf), kind).withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")


def samples(spark, sf, kind):
    return R.samples(records(spark, sf), kind).withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")


#: The tables as the files hold them.
RELATIONS = """WITH na AS (SELECT n_nationkey::BIGINT AS n, n_name, n_regionkey::BIGINT AS r, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
su AS (SELECT s_suppkey::BIGINT AS s, s_name, s_nationkey::BIGINT AS k, n_name, 'r' || (s_nationkey % 5) AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ri AS (SELECT n, n_name, 'r' || (r % 5) AS file, i, CASE WHEN n % 8 = 3 AND i = 1 THEN -1e0 ELSE i * 2e0 END AS t, i * n / 4e0 AS tx, i::DOUBLE AS ty FROM (SELECT *, unnest(range(0, 2 + n % 4)) AS i FROM na)),
au AS (SELECT s, s_name, k, file, (s % 11) * 2e0 AS start, (s % 5) * 1.5e0 AS duration, (s % 6 - 1) / 4e0 AS gain, s % 4 AS flags, CASE WHEN s % 6 = 0 THEN 'stereo' ELSE 'mono' END AS layout, CASE WHEN s % 3 = 0 THEN 'step' WHEN s % 7 = 1 THEN 'spline' ELSE 'linear' END AS how FROM su),
ak AS (SELECT s, k, how, i, i * 3e0 AS t, (k + i)::DOUBLE AS px, i * 2e0 AS py FROM (SELECT *, unnest(range(0, s % 4)) AS i FROM au)),
ad AS (SELECT s_suppkey::BIGINT AS s, CASE WHEN s_suppkey % 13 = 1 THEN s_name[1:4] ELSE s_name END AS data FROM supplier WHERE s_suppkey % 7 <> 0),
ot AS (SELECT file, s, s % 40 AS object_id, s % 3 AS how, i, i * 5e0 AS t, (i * (s % 10))::DOUBLE AS tx FROM (SELECT *, unnest(range(0, 1 + s % 4)) AS i FROM su)),
ob AS (SELECT 'r' || (label % 5) AS file, vec_id, vec_id % 500 AS object_id, 'label ' || label AS label, embedding FROM embeddings)
"""


def described(sql: str):
    return query(RELATIONS + sql, whole=True)


@described("SELECT file, opcode, count(*) AS n FROM (SELECT file, unnest([17]) AS opcode FROM au UNION ALL SELECT 'r' || (s_nationkey % 5), 18 FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'r' || (r_regionkey % 5), unnest([1, 3, 9, 10, 11, 12, 32]) FROM region UNION ALL SELECT file, 33 FROM su UNION ALL SELECT 'r' || (r % 5), unnest([13, 34, 35]) FROM na UNION ALL SELECT DISTINCT file, 36 FROM ob UNION ALL SELECT file, 37 FROM su) GROUP BY ALL")
def S02_S06_records(spark, sf):
    return records(spark, sf).groupBy("file", "opcode").agg(F.count("*").alias("n"))


@described("SELECT 'r' || (r_regionkey % 5) AS file, 'default' AS profile, 'tables' AS library, 30000000 AS duration, 50000 AS cutoff, CASE WHEN r_regionkey = 4 THEN 'moving-mesh' ELSE 'gaussian-birth' END AS temporal_model, r_regionkey % 2 AS flags FROM region")
def R01_S29_headers(spark, sf):
    h = C.headers(records(spark, sf))
    return h.select(F.element_at(F.split("path", "/"), -1).alias("file"), "profile", "library", micro(F.col("duration")).alias("duration"), micro(F.col("cutoff")).alias("cutoff"), "temporal_model", "flags")


@described("SELECT s AS source_id, s_name AS name, layout AS channel_layout, octet_length(s_name::BLOB) AS data_length, " + ", ".join(f"round_even({x} * 1e6, 0)::BIGINT AS {n}" for x, n in (("start", "start_sec"), ("duration", "duration_sec"), ("gain", "gain"), ("s % 10", "px"))) + ", flags, how AS interpolation FROM au")
def R09_S18_audio_descriptors(spark, sf):
    a = table(spark, sf, "AudioSource")
    return a.select("source_id", "name", "channel_layout", "data_length", *[micro(F.col(c)).alias(c) for c in ("start_sec", "duration_sec", "gain", "px")], "flags", "interpolation")


@described("SELECT s AS source_id, i, round_even(t * 1e6, 0)::BIGINT AS t, round_even(px * 1e6, 0)::BIGINT AS px, round_even(py * 1e6, 0)::BIGINT AS py FROM ak")
def R09_audio_keyframes(spark, sf):
    return samples(spark, sf, "AudioSource").select("source_id", "i", *[micro(F.col(c)).alias(c) for c in ("t", "px", "py")])


@described("SELECT au.s AS source_id, ad.data IS NOT NULL AS paired, ad.data, CASE WHEN ad.data IS NULL THEN 'audio-without-data' WHEN length(ad.data) <> length(s_name) THEN 'audio-length-mismatch' END AS fault FROM au LEFT JOIN ad ON au.s = ad.s")
def J09_R10_S17_audio_pairs(spark, sf):
    """Descriptors and payloads, one to one; what doesn't pair is named."""
    a, d = table(spark, sf, "AudioSource").select("source_id", "data_length"), table(spark, sf, "AudioData").select("source_id", "data")
    j = a.join(d, "source_id", "full_outer")
    fault = F.when(F.col("data").isNull(), "audio-without-data").when(F.col("data_length").isNull(), "data-without-audio").when(F.octet_length("data") != F.col("data_length"), "audio-length-mismatch")
    return j.select("source_id", F.col("data").isNotNull().alias("paired"), F.col("data").cast("string").alias("data"), fault.alias("fault"))


@described("SELECT s AS source_id, data[3:6] AS part FROM ad WHERE length(data) >= 6")
def S20_audio_ranges(spark, sf):
    """Four bytes from the third on, where there are so many."""
    d = table(spark, sf, "AudioData")
    return d.where(F.octet_length("data") >= 6).select("source_id", F.substring("data", 3, 4).cast("string").alias("part"))


@described("SELECT file, arg_min(s_name, s) AS name, min(s) AS source_id FROM au GROUP BY file")
def S21_first_audio(spark, sf):
    return table(spark, sf, "AudioSource").groupBy("file").agg(F.min_by("name", "source_id").alias("name"), F.min("source_id").alias("source_id"))


@described("""SELECT s AS source_id, round_even(CASE WHEN how = 'step' OR nt IS NULL THEN px ELSE px + u * (nx - px) END * 1e6, 0)::BIGINT AS px, round_even(CASE WHEN how = 'step' OR nt IS NULL THEN py ELSE py + u * (ny - py) END * 1e6, 0)::BIGINT AS py
FROM (SELECT *, (4e0 - t) / (nt - t) AS u FROM (SELECT *, lead(t) OVER o AS nt, lead(px) OVER o AS nx, lead(py) OVER o AS ny FROM ak WINDOW o AS (PARTITION BY s ORDER BY t))) WHERE t <= 4e0 AND (nt IS NULL OR 4e0 < nt)""")
def J08_S19_F14_F15_audio_pose_at(spark, sf):
    """Where each source with keyframes is at a time: between two, or held at an end."""
    how = table(spark, sf, "AudioSource").select("source_id", "interpolation")
    s = samples(spark, sf, "AudioSource").join(how, "source_id").select("source_id", "interpolation", "t", *asof.ROT, *[F.col(f"p{x}").alias(f"t{x}") for x in "xyz"])
    return asof.pose_at(s, "source_id", 4.0).select("source_id", micro(F.col("tx")).alias("px"), micro(F.col("ty")).alias("py"))


@described("""SELECT s AS source_id, 13.5e0 >= start AND (flags >= 2 OR 13.5e0 - start < duration) AS active, round_even(CASE WHEN flags >= 2 AND duration > 0 THEN CASE WHEN 13.5e0 <= start THEN 0e0 ELSE fmod(fmod(fmod(13.5e0, duration) - fmod(start, duration), duration) + duration, duration) END ELSE least(greatest(0e0, 13.5e0 - start), greatest(duration, 0e0)) END * 1e6, 0)::BIGINT AS local_time, round_even(gain * 1e6, 0)::BIGINT AS gain FROM au""")
def F16_F17_audio_state(spark, sf):
    a = table(spark, sf, "AudioSource").withColumn("loop", F.col("flags").bitwiseAND(F.lit(2)) != 0)
    args = [F.lit(13.5), F.col("start_sec"), F.col("duration_sec"), F.col("loop")]
    return a.select("source_id", temporal.active(*args).alias("active"), micro(temporal.local_time(*args)).alias("local_time"), micro(F.col("gain")).alias("gain"))


@described("SELECT r_name AS codec, r_regionkey * 1000000::BIGINT AS start_sec, r_name AS data FROM region")
def R08_legacy_audio(spark, sf):
    return table(spark, sf, "Audio").select("codec", micro(F.col("start_sec")).alias("start_sec"), F.col("data").cast("string").alias("data"))


@described("SELECT 'r' || (r_regionkey % 5) AS file, 40000000 + r_regionkey * 1000000::BIGINT AS fov_y_deg, r_regionkey * 1000000::BIGINT AS px, r_regionkey % 2 AS loop, (SELECT count(*) FROM na WHERE r = r_regionkey) AS keyframes FROM region")
def R11_S11_cameras(spark, sf):
    n = samples(spark, sf, "Camera").groupBy("file").agg(F.count("*").alias("keyframes"))
    return table(spark, sf, "Camera").join(n, "file").select("file", micro(F.col("fov_y_deg")).alias("fov_y_deg"), micro(F.col("px")).alias("px"), "loop", "keyframes")


@described("SELECT 'r' || (r % 5) AS file, row_number() OVER (PARTITION BY r ORDER BY n) - 1 AS i, n * 1000000 AS t, n * 500000 AS px, n % 3 * 1000000 AS pz FROM na")
def R11_camera_path(spark, sf):
    return samples(spark, sf, "Camera").select("file", F.col("i").cast("long").alias("i"), *[micro(F.col(c)).alias(c) for c in ("t", "px", "pz")])


@described("SELECT r_name AS name, n_name AS entry, n::VARCHAR AS value FROM na")
def R12_S12_F23_F24_metadata(spark, sf):
    return table(spark, sf, "Metadata").select("name", F.explode("entries").alias("entry", "value"))


@described("SELECT 'r' || (r % 5) AS file, count(*) AS chunk_count, min(n) * 1000000 AS y0, max(n) * 2000000 AS z1 FROM na GROUP BY r")
def R13_statistics(spark, sf):
    return table(spark, sf, "Statistics").select("file", F.col("chunk_count").cast("long").alias("chunk_count"), micro(F.col("y0")).alias("y0"), micro(F.col("z1")).alias("z1"))


@described("SELECT n_name AS name, 'text/plain' AS media_type, repeat(n_name, (1 + n % 3)::BIGINT) AS data FROM na")
def R14_S13_attachments(spark, sf):
    return table(spark, sf, "Attachment").select("name", "media_type", F.col("data").cast("string").alias("data"))


@described("SELECT r_name AS name, r_regionkey % 4 AS handedness, r_regionkey % 5 AS length_unit, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 250000 * (r_regionkey + 1) END::BIGINT AS metres_per_unit FROM region")
def R16_S14_frames(spark, sf):
    return table(spark, sf, "CoordinateFrame").select("name", "handedness", "length_unit", micro(F.col("metres_per_unit")).alias("metres_per_unit"))


@described("SELECT r_name AS name, r_regionkey % 5 AS length_unit FROM region WHERE r_name = 'ASIA'")
def E13_frame_named(spark, sf):
    return table(spark, sf, "CoordinateFrame").where("name = 'ASIA'").select("name", "length_unit")


#: Metres in units of length, by their number; numbers of handedness.
UNIT_METRES = {1: 1.0, 2: 0.01, 3: 0.001, 4: 0.3048}
HANDEDNESS = {0: "unspecified", 1: "right", 2: "left"}


@described("SELECT r_name AS name, round_even(CASE WHEN r_regionkey % 2 = 1 THEN 0.25e0 * (r_regionkey + 1) WHEN r_regionkey % 5 = 2 THEN 0.01e0 WHEN r_regionkey % 5 = 4 THEN 0.3048e0 END * 1e6, 0)::BIGINT AS micrometres, CASE r_regionkey % 4 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'unknown(' || r_regionkey % 4 || ')' END AS handedness FROM region")
def F18_F19_metres_and_names(spark, sf):
    """Metres in a frame's unit: its own number, else the unit's; numbers that have no name say so."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    f, m = table(spark, sf, "CoordinateFrame"), F.col("metres_per_unit")
    metres = F.when(m > 0, m).otherwise(F.try_element_at(pairs(UNIT_METRES), F.col("length_unit")))
    return f.select("name", micro(metres).alias("micrometres"), F.coalesce(F.try_element_at(pairs(HANDEDNESS), F.col("handedness")), F.concat(F.lit("unknown("), F.col("handedness").cast("string"), F.lit(")"))).alias("handedness"))


@described("SELECT CASE WHEN n % 6 = 0 THEN 'nowhere' ELSE r_name END AS frame_name, (n * 11 - 100) * 1000000 AS latitude, (n * 13 - 150) * 1000000 AS longitude, n * 250000 AS altitude, n * 14000000 AS heading FROM na")
def R17_anchors(spark, sf):
    return table(spark, sf, "GeodeticAnchor").select("frame_name", micro(F.col("latitude_deg")).alias("latitude"), micro(F.col("longitude_deg")).alias("longitude"), micro(F.col("altitude_m")).alias("altitude"), micro(F.col("heading_deg")).alias("heading"))


@described("SELECT s_name AS name, CASE WHEN s % 2 = 0 THEN 'lidar' ELSE 'camera' END AS modality, s % 3 AS camera_model, 640 + s AS width_px, (4000 + s) * 125000 AS fx, s % 5 AS distortions, CASE WHEN s % 2 = 0 THEN '' WHEN s % 9 = 0 THEN 'rigless' ELSE n_name END AS rig_name, k * 1000000 AS tx FROM su")
def R18_sensors(spark, sf):
    n = samples(spark, sf, "SensorCalibration").groupBy("name").agg(F.count("*").alias("distortions"))
    return table(spark, sf, "SensorCalibration").join(n, "name", "left").select("name", "modality", "camera_model", "width_px", micro(F.col("fx")).alias("fx"), F.coalesce("distortions", F.lit(0)).alias("distortions"), "rig_name", micro(F.col("tx")).alias("tx"))


@described("SELECT n_name AS name, i, round_even(t * 1e6, 0)::BIGINT AS t, round_even(tx * 1e6, 0)::BIGINT AS tx FROM ri")
def R19_trajectories(spark, sf):
    return samples(spark, sf, "RigTrajectory").select("name", F.col("i").cast("long").alias("i"), micro(F.col("t")).alias("t"), micro(F.col("tx")).alias("tx"))


@described("SELECT n_name AS item, i::BIGINT AS i FROM (SELECT *, lag(t) OVER (PARTITION BY n ORDER BY i) AS p FROM ri) WHERE t <= p")
def W06_increasing_times(spark, sf):
    w = Window.partitionBy("name").orderBy("i")
    return samples(spark, sf, "RigTrajectory").withColumn("p", F.lag("t").over(w)).where("t <= p").select(F.col("name").alias("item"), F.col("i").cast("long").alias("i"))


RIG_AT = """, rt AS (SELECT *, lead(t) OVER o AS nt, lead(tx) OVER o AS nx, lead(ty) OVER o AS ny, min(t) OVER (PARTITION BY n) AS first FROM ri WHERE n % 8 <> 3 WINDOW o AS (PARTITION BY n ORDER BY t)),
rp AS (SELECT n_name, CASE WHEN n % 3 = 1 OR nt IS NULL THEN tx ELSE tx + (3e0 - t) / (nt - t) * (nx - tx) END AS tx, CASE WHEN n % 3 = 1 OR nt IS NULL THEN ty ELSE ty + (3e0 - t) / (nt - t) * (ny - ty) END AS ty FROM rt WHERE t <= 3e0 AND (nt IS NULL OR 3e0 < nt))"""


def _rigs_at(spark, sf):
    how = table(spark, sf, "RigTrajectory").select("name", F.when(F.col("interpolation") == 1, "step").otherwise("linear").alias("interpolation"))
    s = samples(spark, sf, "RigTrajectory")
    bad = s.where("i = 1 AND t < 0").select("name")
    return asof.pose_at(s.join(how, "name").join(bad, "name", "left_anti").drop("file"), "name", 3.0)


@described(RIG_AT + "SELECT s_name AS sensor, n_name AS rig, round_even((tx + k) * 1e6, 0)::BIGINT AS tx, round_even((ty + 0.5e0) * 1e6, 0)::BIGINT AS ty FROM su JOIN rp USING (n_name) WHERE s % 2 = 1 AND s % 9 <> 0")
def J05_sensor_poses(spark, sf):
    """Each sensor on a rig, where it is at a time: the rig's pose with the sensor's own on top."""
    from driftfield.functions import quaternion as Q

    rig = _rigs_at(spark, sf).select(F.col("name").alias("rig_name"), *[F.col(c).alias(f"r_{c}") for c in (*asof.ROT, *asof.SHIFT)])
    j = table(spark, sf, "SensorCalibration").join(rig, "rig_name")
    outer = tuple(F.col(f"r_{c}") for c in asof.ROT), tuple(F.col(f"r_{c}") for c in asof.SHIFT)
    _, shift = Q.composed(outer, (tuple(F.col(c) for c in asof.ROT), tuple(F.col(c) for c in asof.SHIFT)))
    return j.select(F.col("name").alias("sensor"), F.col("rig_name").alias("rig"), micro(shift[0]).alias("tx"), micro(shift[1]).alias("ty"))


@described("SELECT 'unknown-rig' AS rule, s_name AS item FROM su WHERE s % 2 = 1 AND s % 9 = 0 UNION ALL SELECT 'unknown-frame', 'nowhere' FROM na WHERE n % 6 = 0 UNION ALL SELECT 'duplicate-sensor', s_name FROM su GROUP BY s_name HAVING count(*) > 1")
def J06_provenance_references(spark, sf):
    """Sensors of rigs that aren't there, anchors of frames that aren't there, names that stand twice."""
    sensors, rigs = table(spark, sf, "SensorCalibration"), table(spark, sf, "RigTrajectory")
    anchors, frames = table(spark, sf, "GeodeticAnchor"), table(spark, sf, "CoordinateFrame")
    found = rules.report(rules.dangling(sensors, "rig_name", rigs, "name", "unknown-rig", "name"), rules.dangling(anchors, "frame_name", frames, "name", "unknown-frame"), rules.duplicates(sensors, "name", "duplicate-sensor"))
    return found.select("rule", "item")


@described("""SELECT rule, item FROM (SELECT 'unknown-handedness' AS rule, r_name AS item FROM region WHERE r_regionkey % 4 > 2 UNION ALL SELECT 'unknown-length-unit', r_name FROM region WHERE r_regionkey % 5 > 4 UNION ALL SELECT 'latitude-range', n_name FROM na WHERE abs(n * 11 - 100) > 90 UNION ALL SELECT 'longitude-range', n_name FROM na WHERE abs(n * 13 - 150) > 180 UNION ALL SELECT 'unit-disagrees', r_name FROM region WHERE r_regionkey % 2 = 1 AND r_regionkey % 5 BETWEEN 1 AND 4)""")
def V03_provenance_values(spark, sf):
    frames, anchors = table(spark, sf, "CoordinateFrame"), table(spark, sf, "GeodeticAnchor")
    place = anchors.join(table(spark, sf, "Attachment").select("file", "name").distinct(), "file")  # an anchor has no name of its own; its nation's attachment does
    mine = place.where(F.col("altitude_m") * 4 == F.col("heading_deg") / 14 * 1.0)
    nation = S.read(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") / 4.0).alias("altitude_m"))
    mine = mine.join(nation, ["name", "altitude_m"])
    metres = F.create_map(*[F.lit(x) for kv in UNIT_METRES.items() for x in kv])
    return rules.report(
        rules.faults(frames, "unknown-handedness", "name", ~F.col("handedness").isin(*HANDEDNESS)),
        rules.faults(frames, "unknown-length-unit", "name", "length_unit > 4"),
        rules.faults(mine, "latitude-range", "name", "abs(latitude_deg) > 90"),
        rules.faults(mine, "longitude-range", "name", "abs(longitude_deg) > 180"),
        rules.faults(frames, "unit-disagrees", "name", (F.col("metres_per_unit") > 0) & (F.col("metres_per_unit") != F.try_element_at(metres, F.col("length_unit")))),
    ).select("rule", "item")


@described("""SELECT rule, item::VARCHAR AS item FROM (SELECT 'duration-not-positive' AS rule, s AS item FROM au WHERE duration <= 0 UNION ALL SELECT 'negative-gain', s FROM au WHERE gain < 0 UNION ALL SELECT 'spatial-not-mono', s FROM au WHERE flags % 2 = 1 AND layout <> 'mono' UNION ALL SELECT 'unknown-interpolation', s FROM au WHERE how = 'spline' UNION ALL SELECT 'keyframe-outside', s FROM ak WHERE t > start_limit) x""".replace("t > start_limit", "t > 5e0"))
def V17_audio_rules(spark, sf):
    """What descriptors must not say; a keyframe beyond the scene (here: five seconds) is one of them."""
    a, k = table(spark, sf, "AudioSource"), samples(spark, sf, "AudioSource")
    return rules.report(
        rules.faults(a, "duration-not-positive", "source_id", "duration_sec <= 0"),
        rules.faults(a, "negative-gain", "source_id", "gain < 0"),
        rules.faults(a, "spatial-not-mono", "source_id", "flags & 1 = 1 AND channel_layout <> 'mono'"),
        rules.faults(a, "unknown-interpolation", "source_id", "interpolation NOT IN ('linear', 'step')"),
        rules.faults(k, "keyframe-outside", "source_id", "t < 0 OR t > 5"),
    ).select("rule", "item")


@described("SELECT 'unknown-temporal-model' AS rule, 'r' || (r_regionkey % 5) AS item, 'moving-mesh' AS message FROM region WHERE r_regionkey = 4 UNION ALL SELECT 'unknown-quantization-scheme', 'r' || (r_regionkey % 5), 'vector' FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'quantization-not-finite', 'r' || (r_regionkey % 5), 'scale_log' FROM region WHERE r_regionkey = 2")
def V02_V19_models_and_grids(spark, sf):
    recs = records(spark, sf)
    name = F.element_at(F.split("path", "/"), -1)
    grids = C.grids(recs).withColumn("file", name)
    steps = ["ox", "oy", "oz", "pos", "scale_log", "rot", "rgb", "alpha", "motion", "time", "sigma_log"]
    bad = rules.not_finite(grids, "file", steps, "quantization-not-finite")
    return rules.report(
        rules.faults(C.headers(recs).withColumn("file", name), "unknown-temporal-model", "file", "temporal_model NOT IN ('gaussian-birth', 'keyframe-delta')", F.col("temporal_model")),
        rules.faults(grids, "unknown-quantization-scheme", "file", F.col("scheme") != C.SCHEME, F.col("scheme")),
        bad.withColumn("message", F.substring_index("message", " ", 1)),
    ).select("rule", "item", "message")


@described("SELECT file, object_id, label, round_even(embedding[1]::DOUBLE * 1e6, 0)::BIGINT AS anchor, vec_id % 4 = 0 AS moves, CASE WHEN vec_id % 3 <> 0 THEN round_even(embedding[64]::DOUBLE * 1e6, 0)::BIGINT END AS last FROM ob")
def R20_S15_objects(spark, sf):
    o = R.objects(records(spark, sf))
    return o.select(F.element_at(F.split("path", "/"), -1).alias("file"), "object_id", "label", micro(F.get("anchor", 0).cast("double")).alias("anchor"), F.col("dynamics").isNotNull().alias("moves"), micro(F.get("embedding", 63).cast("double")).alias("last"))


@described("SELECT file, s AS track, object_id, i, round_even(t * 1e6, 0)::BIGINT AS t, round_even(tx * 1e6, 0)::BIGINT AS tx FROM ot WHERE s < 40")
def R21_object_tracks(spark, sf):
    """Samples of the tracks of the first objects, whose number names one track: of several in a file the first record."""
    recs = records(spark, sf).where(F.col("opcode") == C.OPCODES["ObjectTrack"])
    who = F.hex(F.substring("content", 1, 4))  # the object's number as it is written
    first = recs.groupBy("path", who.alias("who")).agg(F.min("ordinal").alias("ordinal")).drop("who")
    s = R.samples(recs.join(first, ["path", "ordinal"], "left_semi"), "ObjectTrack").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return s.join(_first_objects(spark, sf), ["file", "object_id"]).select("file", F.col("object_id").alias("track"), "object_id", F.col("i").cast("long").alias("i"), micro(F.col("t")).alias("t"), micro(F.col("tx")).alias("tx"))


def _first_objects(spark, sf):
    return S.read(spark, sf, "supplier").where("s_suppkey < 40").select(_file(F.col("s_nationkey")).alias("file"), F.col("s_suppkey").alias("object_id"))


def _single_tracks(spark, sf):
    many = table(spark, sf, "ObjectTrack").groupBy("file", "object_id").agg(F.count("*").alias("n"))
    return _first_objects(spark, sf).join(many.where("n = 1"), ["file", "object_id"]).select("file", "object_id")


@described("SELECT file, object_id, count(*) AS tracks FROM su2 GROUP BY ALL".replace("su2", "(SELECT file, s % 40 AS object_id FROM su)") )
def E14_V21_tracks_by_object(spark, sf):
    return table(spark, sf, "ObjectTrack").groupBy("file", "object_id").agg(F.count("*").alias("tracks"))


@described("""SELECT rule, item FROM (SELECT 'duplicate-object-id' AS rule, file || ':' || object_id AS item FROM ob GROUP BY file, object_id HAVING count(*) > 1 UNION ALL SELECT 'invalid-object-id', file || ':0' FROM ob WHERE object_id = 0 UNION ALL SELECT 'duplicate-object-track', file || ':' || (s % 40) FROM su GROUP BY file, s % 40 HAVING count(*) > 1 UNION ALL SELECT 'track-names-background', file || ':0' FROM su WHERE s % 40 = 0 UNION ALL SELECT 'unsupported-trajectory-interpolation', file || ':' || (s % 40) FROM su WHERE s % 3 = 2)""")
def V21_V22_object_rules(spark, sf):
    name = F.element_at(F.split("path", "/"), -1)
    o = R.objects(records(spark, sf)).withColumn("item", F.concat(name, F.lit(":"), F.col("object_id").cast("string")))
    t = table(spark, sf, "ObjectTrack").withColumn("item", F.concat("file", F.lit(":"), F.col("object_id").cast("string")))
    embedding = F.col("embedding")
    return rules.report(
        rules.duplicates(o, "item", "duplicate-object-id"),
        rules.faults(o, "invalid-object-id", "item", "object_id = 0"),
        rules.faults(o, "invalid-object-embedding-shape", "item", F.size(embedding) != F.col("dim")),
        rules.faults(o, "non-finite-object-value", "item", F.exists(F.concat("anchor", F.coalesce("dynamics", F.array().cast("array<float>")), F.coalesce(embedding, F.array().cast("array<float>"))), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))),
        rules.duplicates(t, "item", "duplicate-object-track"),
        rules.faults(t, "track-names-background", "item", "object_id = 0"),
        rules.faults(t, "unsupported-trajectory-interpolation", "item", "interpolation > 1"),
    ).select("rule", "item")


@described("""SELECT object_id, round_even(CASE WHEN how = 1 OR nt IS NULL THEN tx ELSE tx + (7e0 - t) / (nt - t) * (nx - tx) END * 1e6, 0)::BIGINT AS tx FROM (SELECT *, lead(t) OVER o AS nt, lead(tx) OVER o AS nx FROM ot WHERE s < 40 AND (file, object_id) IN (SELECT file, s % 40 FROM su GROUP BY file, s % 40 HAVING count(*) = 1) WINDOW o AS (PARTITION BY file, s ORDER BY t)) WHERE t <= 7e0 AND (nt IS NULL OR 7e0 < nt)""")
def J07_S16_F25_object_poses(spark, sf):
    """Poses at a time of objects with one track; no more than two samples of each are looked at."""
    how = table(spark, sf, "ObjectTrack").select("file", "object_id", F.when(F.col("interpolation") == 1, "step").otherwise("linear").alias("interpolation"))
    s = samples(spark, sf, "ObjectTrack").join(_single_tracks(spark, sf), ["file", "object_id"]).join(how, ["file", "object_id"])
    return asof.pose_at(s.withColumn("who", F.struct("file", "object_id")).drop("file", "object_id", "i"), "who", 7.0).select(F.col("who.object_id").alias("object_id"), micro(F.col("tx")).alias("tx"))
