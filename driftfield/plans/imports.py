"""Queries over point clouds and assets that are written from the tables in other formats, and read through the importers."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftfield.functions import matrix as M
from driftfield.functions.numeric import micro
from driftfield.functions.quaternion import normalized
from driftfield.plans.containers import folder, once
from driftfield.plans.relational import query, sql_mu
from driftfield.plans.scenes import elements
from driftfield.sources import derived as S
from driftfield.sources import gltf as G
from driftfield.sources import ply as P
from driftfield.sources.pieces import PIECE
from driftfield.sources.storage import put_files, put_one, put_parts, scratch

FPS = 4.0


def _ply(rows: list[dict], ascii_: bool) -> bytes:
    """One frame: even ones as text, odd ones as bytes."""
    names = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2", "opacity"]
    head = f"ply\nformat {'ascii' if ascii_ else 'binary_little_endian'} 1.0\ncomment made from tables\nelement vertex {len(rows)}\n" + "".join(f"property double {n}\n" for n in names) + "end_header\n"
    if ascii_:
        return (head + "".join(" ".join(repr(r[n]) for n in names) + "\n" for r in rows)).encode()
    return head.encode() + b"".join(struct.pack(f"<{len(names)}d", *[r[n] for n in names]) for r in rows)


def frames(spark: SparkSession, sf: str) -> str:
    """Four frames of suppliers on the move; the last lacks every tenth. Their numbers stand last in the names."""

    def make() -> str:
        s = S.read(spark, sf, "supplier").withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("frame < 3 OR s_suppkey % 10 <> 0")
        k, f = F.col("s_suppkey"), F.col("frame")
        d = lambda x: x.cast("double")
        v = {"x": d(F.col("s_nationkey") + f * (k % 3)), "y": k / 4.0, "z": d(f) * 0.5, "scale_0": d(-(k % 4)), "scale_1": F.lit(-1.0), "scale_2": F.lit(0.0), "rot_0": F.lit(0.0), "rot_1": F.lit(0.0), "rot_2": F.lit(0.0), "rot_3": F.lit(2.0), "f_dc_0": k % 5 / 4.0, "f_dc_1": F.lit(0.0), "f_dc_2": F.lit(-9.0), "opacity": d(k % 3 - 1)}
        held = s.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", *[c.alias(n) for n, c in v.items()]))).alias("rows"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for frame, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([f"take{9 - frame}_frame_{frame}.ply"]), pa.array([_ply(rows, frame % 2 == 0)], pa.binary())], names=["name", "content"])

        return put_files(held.select("frame", "rows").mapInArrow(run, "name string, content binary"), folder(spark, "frames"))

    return once(spark, sf, "frames", make)


FRAMES = "WITH fr AS (SELECT *, unnest(range(0, 4)) AS frame FROM supplier), f2 AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY s_suppkey) - 1 AS n, count(*) OVER (PARTITION BY frame) AS c FROM fr WHERE frame < 3 OR s_suppkey % 10 <> 0)\n"


@query(FRAMES + f"SELECT frame, n AS \"row\", {sql_mu('s_nationkey + frame * (s_suppkey % 3)', 'px')}, {sql_mu('exp(-(s_suppkey % 4)::DOUBLE)', 'sx')}, {sql_mu('least(1e0, greatest(0e0, (s_suppkey % 5) / 4e0 * 0.28209479177387814e0 + 0.5e0))', 'r')}, {sql_mu('1e0 / (1e0 + exp(-(s_suppkey % 3 - 1)::DOUBLE))', 'a')}, 0::BIGINT AS b, 1000000::BIGINT AS qz FROM f2", whole=True)
def S30_read_ply(spark, sf):
    """Vertices of plain files, text and binary, in scene units."""
    a = P.attributes(P.vertices(spark, frames(spark, sf)))
    frame = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\.ply", 1).cast("long")
    return a.select(frame.alias("frame"), "row", *[micro(F.col(c)).alias(c) for c in ("px", "sx", "r", "a", "b", "qz")])


@query(FRAMES + f"SELECT a.frame, a.n AS \"row\", {sql_mu('coalesce((a.s_nationkey + a.frame * (a.s_suppkey % 3) - b.s_nationkey - b.frame * (b.s_suppkey % 3)) * 4e0, 0e0)', 'vx')}, {sql_mu('a.frame * 0.25e0 + 0.125e0', 'mu_t')}, {sql_mu('a.frame * 0.25e0 + 0.25e0', 'win_hi')} FROM f2 a LEFT JOIN f2 b ON b.frame = a.frame - 1 AND b.n = a.n AND b.c = a.c", whole=True)
def S31_W03_O05_ply_sequence(spark, sf):
    """Frames in the order of the last numbers in their names, moving as they did since the frame before."""
    return P.frames(spark, frames(spark, sf), FPS).select(F.col("place").cast("long").alias("frame"), "row", *[micro(F.col(c)).alias(c) for c in ("vx", "mu_t", "win_hi")])


def packed(spark: SparkSession, sf: str) -> str:
    """Two packed files with time, of the events of either parity; words are multiples of the event's number."""

    def make() -> str:
        e = S.read(spark, sf, "events").select("event_id", (F.col("event_id") % 2).alias("half"))
        counts = {r["half"]: r["count"] for r in e.groupBy("half").count().collect()}
        where = folder(spark, "packed")
        root = scratch(spark, f"{where}/seg")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                ids, half = (c.to_numpy() for c in batch.columns)
                for h in np.unique(half):
                    held.setdefault(int(h), []).append(ids[half == h])
            for half, parts in held.items():
                ids = np.sort(np.concatenate(parts)).astype(np.uint64)
                words = np.stack([(ids * np.uint64(m)) % np.uint64(1 << 32) for m in (2654435761, 40503, 2246822519, 3266489917, 668265263, 374761393)], axis=1).astype("<u4")
                sh = ((ids[:, None] + np.arange(9, dtype=np.uint64)) % np.uint64(256)).astype(np.uint8)
                row = {"half": half, "first": int(ids[0]), "n": len(ids), "uri": put_one(root, words.tobytes() + sh.tobytes())}
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row.values()], names=list(row))

        # Ranges of ids, so that pieces follow each other.
        dealt_out = e.repartitionByRange(max(1, sum(counts.values()) // PIECE), "half", "event_id")
        pieces = dealt_out.select("event_id", "half").mapInArrow(run, "half long, first long, n long, uri string").collect()  # a row a piece
        for half, n in counts.items():
            chunks, mine = -(-n // 256), sorted((r["first"], r["n"], r["uri"]) for r in pieces if r["half"] == half)
            c = np.arange(chunks, dtype="<f4")[:, None]
            bounds = np.concatenate([c + np.float32(x) if moves else np.full((chunks, 1), x, "<f4") for x, moves in [(0, True)] * 3 + [(8, True)] * 3 + [(x, False) for x in [-4.0] * 3 + [0.0] * 6 + [1.0] * 3 + [-1.0] * 3 + [1.0] * 3 + [-3.0, 0.0, 0.0, 4.0]]], axis=1).astype("<f4")
            head = f"ply\nformat binary_little_endian 1.0\nelement chunk {chunks}\n" + "".join(f"property float c{k}\n" for k in range(28)) + f"element vertex {n}\nproperty uint packed_position\n" + "".join(f"property uint w{k}\n" for k in range(5)) + f"element sh {n}\n" + "".join(f"property uchar f_rest_{k}\n" for k in range(9)) + "end_header\n"
            put_parts(spark, f"{where}/seg{10 + half}.ply", [head.encode() + bounds.tobytes(), *[(uri, 0, 24 * m) for _, m, uri in mine], *[(uri, 24 * m, 9 * m) for _, m, uri in mine]])
        return where

    return once(spark, sf, "packed", make)


_U = "((({m} * event_id) % 4294967296) >> {s}) & {k}"
PACKED = "WITH pe AS (SELECT event_id::BIGINT AS event_id, event_id % 2 AS half, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS n FROM events), " + "pu AS (SELECT *, n // 256 AS c, " + ", ".join(f"({_U.format(m=m, s=s, k=(1 << b) - 1)}) / {(1 << b) - 1}e0 AS {n}" for n, m, s, b in (("ux", "2654435761::HUGEINT", 21, 11), ("uy", "2654435761::HUGEINT", 11, 10), ("uz", "2654435761::HUGEINT", 0, 11), ("us", "2246822519::HUGEINT", 21, 11), ("ur", "3266489917::HUGEINT", 24, 8), ("ua", "3266489917::HUGEINT", 0, 8), ("uv", "668265263::HUGEINT", 11, 10), ("ut", "374761393::HUGEINT", 11, 10), ("ug", "374761393::HUGEINT", 21, 11), ("r0", "40503::HUGEINT", 20, 10), ("r1", "40503::HUGEINT", 10, 10), ("r2", "40503::HUGEINT", 0, 10))) + ", ((40503::HUGEINT * event_id) % 4294967296) >> 30 AS tag FROM pe)\n"


@query(PACKED + f"SELECT half, n AS \"row\", {sql_mu('c + ux * 8', 'px')}, {sql_mu('c + uy * 8', 'py')}, {sql_mu('c + uz * 8', 'pz')}, {sql_mu('exp(-4e0 + us * 4)', 'sx')}, {sql_mu('ur', 'r')}, {sql_mu('ua', 'a')}, {sql_mu('-1e0 + uv * 2', 'vy')}, {sql_mu('ut * 4', 'mu_t')}, {sql_mu('exp(-3e0 + ug * 3)', 'sigma_t')}, (event_id + 8) % 256 AS last_code FROM pu", whole=True)
def S32_J14_F26_compressed_ply(spark, sf):
    """Packed vertices joined with the bounds of their 256."""
    u = P.unpacked(spark, packed(spark, sf))
    half = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\.ply", 1).cast("long") - 10
    return u.select(half.alias("half"), "row", *[micro(F.col(c)).alias(c) for c in ("px", "py", "pz", "sx", "r", "a", "vy", "mu_t", "sigma_t")], F.get("sh", 8).alias("last_code"))


_V = [f"(r{k} - 0.5e0) / sqrt(0.5e0)" for k in range(3)]
_ROOT = f"sqrt(greatest(1e0 - ({' + '.join(f'({v}) * ({v})' for v in _V)}), 0e0))"


_PICKED = {"x": "v0 m v1 v1", "y": "v1 v1 m v2", "z": "v2 v2 v2 m", "w": "m v0 v0 v0"}
_TURNED = ", ".join(sql_mu("(CASE tag " + " ".join(f"WHEN {t} THEN {v}" for t, v in enumerate(_PICKED[x].split())) + " END) / greatest(sqrt(v0 * v0 + v1 * v1 + v2 * v2 + m * m), 1e-30)", f"q{x}") for x in "xyzw")


@query(PACKED + f"SELECT half, n AS \"row\", {_TURNED} FROM (SELECT *, {_V[0]} AS v0, {_V[1]} AS v1, {_V[2]} AS v2, {_ROOT} AS m FROM pu)", whole=True)
def D24_packed_rotation(spark, sf):
    """Smallest three of a word; the two bits name the largest of w, x, y, z."""
    u = P.unpacked(spark, packed(spark, sf))
    half = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)\.ply", 1).cast("long") - 10
    return u.select(half.alias("half"), "row", *[micro(F.col(f"q{x}")).alias(f"q{x}") for x in "xyzw"])


@query(PACKED + f"SELECT half, count(*) AS n, {sql_mu('min(ut * 4 + half * 5)', 'first')}, {sql_mu('max(ut * 4 + half * 5)', 'last')}, half * 5000000::BIGINT AS win_lo, (half + 1) * 5000000::BIGINT AS win_hi FROM pu GROUP BY half", whole=True)
def S33_O06_segments(spark, sf):
    """Packed files as segments of one clock, five seconds each."""
    s = P.segments(spark, packed(spark, sf), 5.0)
    return s.groupBy(F.col("place").cast("long").alias("half")).agg(F.count("*").alias("n"), micro(F.min("mu_t")).alias("first"), micro(F.max("mu_t")).alias("last"), micro(F.min("win_lo")).alias("win_lo"), micro(F.max("win_hi")).alias("win_hi"))


@query(PACKED + "SELECT 'seg' || (10 + half) || '.ply' AS name, true AS packed FROM pu GROUP BY half UNION ALL SELECT 'take' || (9 - f) || '_frame_' || f || '.ply', false FROM (SELECT DISTINCT unnest(range(0, 4)) AS f FROM supplier)", whole=True)
def S34_is_packed(spark, sf):
    files = [spark.read.format("binaryFile").load(p).select("path", "content") for p in (packed(spark, sf), frames(spark, sf))]
    return files[0].union(files[1]).select(F.element_at(F.split("path", "/"), -1).alias("name"), P.is_packed(F.col("content")).alias("packed"))


@query("SELECT code, round_even(CASE code WHEN 0 THEN -4e0 WHEN 255 THEN 4e0 ELSE (code + 0.5e0) / 256e0 * 8e0 - 4e0 END * 1e6, 0)::BIGINT AS coefficient, count(*) AS n FROM (SELECT (l_partkey % 256)::BIGINT AS code FROM lineitem) GROUP BY code", whole=True)
def D25_packed_coefficients(spark, sf):
    c = S.read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 256).alias("code")).agg(F.count("*").alias("n"))
    return c.select("code", micro(P.packed_coefficient(F.col("code"))).alias("coefficient"), "n")


def snapshot(spark: SparkSession, sf: str) -> str:
    def make() -> str:
        path = f"{folder(spark, 'snapshot')}/scene.glb"
        G.write_snapshot(elements(spark, sf).withColumn("px", F.col("px") + F.col("gaussian_id")), path, 13.5)
        return path

    return once(spark, sf, "snapshot", make)


_F = lambda x: f"({x})::FLOAT::DOUBLE"


@query(f"SELECT {sql_mu(_F('px + gaussian_id + vx * (13.5e0 - mu_t)'), 'px')}, {sql_mu(_F('a * m'), 'a')}, {sql_mu(_F('0.01e0 + (gaussian_id % 5) / 100e0'), 'sy')}, count(*) AS n FROM lv WHERE m >= 0.05e0 GROUP BY ALL")
def K05_S35_S36_snapshot(spark, sf):
    """What is visible at a time, written as an asset and imported again; numbers are those of 32 bits."""
    g = G.gaussians(spark, snapshot(spark, sf)).where("fault IS NULL")
    return g.groupBy(*[micro(F.col(c)).alias(c) for c in ("px", "a", "sy")]).agg(F.count("*").alias("n"))


def assets(spark: SparkSession, sf: str) -> str:
    """An asset for each region: a node for it, and below that one for each nation, all with the same splat of bytes."""

    def make() -> str:
        n = S.read(spark, sf, "nation")
        held = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for region, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = struct.pack("<3f", 1.0, 2.0, 3.0) + struct.pack("<4b", 0, 0, 0, 127) + struct.pack("<3f", 0.5, 0.25, 0.125) + struct.pack("<B3x", 51) + struct.pack("<3f", 0.0, 1.0, -1.0)
                    views = [(0, 12), (12, 4), (16, 12), (28, 4), (32, 12)]
                    kinds = [(5126, "VEC3"), (5120, "VEC4"), (5126, "VEC3"), (5121, "SCALAR"), (5126, "VEC3")]
                    names = ["POSITION", f"{EXT}:ROTATION", f"{EXT}:SCALE", f"{EXT}:OPACITY", f"{EXT}:SH_DEGREE_0_COEF_0"]
                    half = 0.5**0.5
                    nodes = [{"children": list(range(1, len(keys) + 1)), "translation": [10.0 * region, 0.0, 0.0], "scale": [2.0, 2.0, 2.0]}]
                    for k in keys:
                        turn = {"rotation": [0.0, 0.0, half, half]} if k % 2 else {}
                        nodes.append({"mesh": 0, "translation": [0.0, float(k), 0.0], "scale": [1.0, 1.0, 1.0 if k % 6 else 3.0], **turn})
                    document = {
                        "asset": {"version": "2.0"}, "extensionsUsed": [EXT], "scene": 0, "scenes": [{"nodes": [0]}], "nodes": nodes,
                        "meshes": [{"primitives": [{"mode": 0, "attributes": {a: i for i, a in enumerate(names)}, "extensions": {EXT: {"kernel": "ellipse", "colorSpace": "lin_rec709_display"}}}]}],
                        "accessors": [{"bufferView": i, "componentType": c, "type": t, "count": 1, **({"normalized": True} if c != 5126 else {})} for i, (c, t) in enumerate(kinds)],
                        "bufferViews": [{"buffer": 0, "byteOffset": a, "byteLength": b} for a, b in views], "buffers": [{"byteLength": len(data), "uri": "data:application/octet-stream;base64," + base64.b64encode(data).decode()}],
                    }
                    yield pa.RecordBatch.from_arrays([pa.array([f"r{region}.gltf"]), pa.array([json.dumps(document).encode()], pa.binary())], names=["name", "content"])

        return put_files(held.select("n_regionkey", "keys").mapInArrow(run, "name string, content binary"), folder(spark, "assets"))

    return once(spark, sf, "assets", make)


EXT = G.EXTENSION


@query("SELECT n_regionkey::BIGINT AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS node, CASE WHEN n_nationkey % 6 = 0 THEN 'non-uniform-scale' END AS fault, CASE WHEN n_nationkey % 6 <> 0 THEN (CASE WHEN n_nationkey % 2 = 1 THEN 2 * -2 ELSE 2 * 1 END + 10 * n_regionkey) * 1000000 END::BIGINT AS px, CASE WHEN n_nationkey % 6 <> 0 THEN (2 * (n_nationkey + CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 2 END)) * 1000000 END::BIGINT AS py, CASE WHEN n_nationkey % 6 <> 0 THEN CASE WHEN n_nationkey % 2 = 1 THEN round_even(sqrt(0.5e0) * 1e6, 0) ELSE 0 END END::BIGINT AS qz, CASE WHEN n_nationkey % 6 <> 0 THEN 1000000 END::BIGINT AS sx, 200000::BIGINT AS a FROM nation", whole=True)
def J15_F10_F11_F12_nodes(spark, sf):
    """Splats below two levels of nodes, turned, scaled and shifted; scales that aren't uniform are named."""
    g = G.gaussians(spark, assets(spark, sf))
    ok = F.col("fault").isNull()
    region = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)", 1).cast("long")
    return g.select(region.alias("region"), F.col("primitive").cast("long").alias("node"), "fault", *[F.when(ok, micro(F.col(c))).alias(c) for c in ("px", "py", "qz", "sx")], micro(F.col("a")).alias("a"))


@query("SELECT event_id, " + ", ".join(sql_mu(f"abs({c} / n)", f"q{c}") for c in "xyzw") + ", round_even((1 + event_id % 4) * 1e6, 0)::BIGINT AS scale, NULL::VARCHAR AS fault FROM (SELECT event_id, event_id % 11 - 5e0 AS x, event_id % 7 - 3e0 AS y, event_id % 5 - 2e0 AS z, event_id % 3 + 1e0 AS w, sqrt(pow(event_id % 11 - 5, 2) + pow(event_id % 7 - 3, 2) + pow(event_id % 5 - 2, 2) + pow(event_id % 3 + 1, 2)) AS n FROM events)", whole=True)
def F10_F11_matrices_back(spark, sf):
    """Matrices made from turns and scales, taken apart again: the same scale, the same turn but for its sign."""
    i = F.col("event_id")
    given = normalized(tuple(x.cast("double") for x in (i % 11 - 5, i % 7 - 3, i % 5 - 2, i % 3 + 1)))
    e = S.read(spark, sf, "events").select("event_id", *[c.alias(f"g{x}") for x, c in zip("xyzw", given)], (1 + i % 4).cast("double").alias("s"))
    rows, _ = M.node_matrix(tuple(F.col(f"g{x}") for x in "xyzw"), (F.col("s"), F.col("s"), F.col("s")), (F.lit(0.0),) * 3)
    e = e.select("event_id", *[rows[a][b].alias(f"m{a}{b}") for a in range(3) for b in range(3)])
    turn, scale, fault = M.decomposed(tuple(tuple(F.col(f"m{a}{b}") for b in range(3)) for a in range(3)))
    e = e.select("event_id", scale.alias("scale"), fault.alias("fault"), *[turn[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3)])
    q = M.quaternion_of(tuple(tuple(F.col(f"r{a}{b}") for b in range(3)) for a in range(3)))
    # The fault stays a column: as a filter it would be pushed down, through every projection, as one expression of them all.
    return e.select("event_id", *[micro(F.abs(c)).alias(f"q{x}") for x, c in zip("xyzw", q)], micro(F.col("scale")).alias("scale"), "fault")
