"""Point clouds in PLY files as tables: plain ones frame by frame, and packed ones with bounds for each 256 vertices.

Python reads headers and views bytes; what the numbers stand for, which frame follows which, and how fast a point moves
are columns, windows and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftfield.functions import quantization as D
from driftfield.functions import temporal
from driftfield.sources.container import Fault
from driftfield.sources.storage import FileRanges, dealt

#: Fixed values of the format: the types of properties.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
#: The constant of the harmonics basis, coefficients by degree, vertices that share bounds, the packed
#: quaternion's norm, birth times that mean "does not move" and "is always there".
SH_C0, DEGREES, CHUNK, QUAT_NORM = 0.28209479177387814, {9: 1, 24: 2, 45: 3}, 256, 0.5**0.5
STATIC_MU, ALWAYS_MU = -5.0, -10.0
PLAIN = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2", "red", "green", "blue", "opacity"]
VERTICES = "path string, row long, vertices long, " + ", ".join(f"{c} double" for c in PLAIN) + ", rest array<double>, fault string"
PACKED = "path string, row long, vertices long, temporal boolean, words array<long>, sh array<long>, fault string"
BOUNDS = "path string, chunk long, floats array<double>"
#: Vertices of one batch.
BATCH = 65_536


def header(data: bytes) -> tuple[str, dict[str, tuple[int, list[tuple[str, str]]]], int]:
    """(format, count and properties by element, where the body begins); a list property is a fault where it matters."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0 or b"\n" not in data[end:]:
        raise Fault("not-a-ply")
    kind, elements, current = "binary_little_endian", {}, None
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"] and len(words) > 1:
            kind = words[1]
        elif words[:1] == ["element"]:
            if len(words) < 3 or not words[2].isdigit():
                raise Fault("malformed-element")
            current = words[1]
            elements[current] = (int(words[2]), [])
        elif words[:1] == ["property"] and current and len(words) > 2:
            elements[current][1].append((words[-1], words[1] if words[1] == "list" else TYPES.get(words[1], "f4")))
    return kind, elements, data.index(b"\n", end) + 1


def is_packed(content: Column) -> Column:
    """Whether a file's first bytes declare chunks and packed positions."""
    head = F.substring_index(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "end_header", 1)
    return head.contains("element chunk") & head.contains("packed_position")


def _plain(data: bytes) -> tuple[dict[str, np.ndarray], int]:
    kind, elements, at = header(data)
    n, properties = elements.get("vertex", (0, []))
    if not n or not properties:
        raise Fault("no-vertices")
    if any(t == "list" for _, t in properties):
        raise Fault("list-property")
    if kind == "ascii":
        values = data[at:].split()[: n * len(properties)]
        if len(values) < n * len(properties):
            raise Fault("truncated")
        try:
            table = np.array(values, dtype=np.float64).reshape(n, len(properties))
        except ValueError:
            raise Fault("malformed-number") from None
        return {name: table[:, i] for i, (name, _) in enumerate(properties)}, n
    if kind != "binary_little_endian":
        raise Fault("unsupported-format")
    if next(iter(elements)) != "vertex":
        raise Fault("vertices-not-first")
    kinds = np.dtype([(name, "<" + t) for name, t in properties])
    if at + n * kinds.itemsize > len(data):
        raise Fault("truncated")
    table = np.frombuffer(data, dtype=kinds, count=n, offset=at)
    return {name: table[name].astype(np.float64) for name, _ in properties}, n


def vertices(spark: SparkSession, path: str) -> DataFrame:
    """A row for each vertex of the plain files at ``path``; what a file lacks is null, and a file that can't be read a row
    with its fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [w.split()[0] for w in VERTICES.split(", ")]
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    (got, n), fault = _plain(data), None
                except Fault as e:
                    got, n, fault = {}, 1, str(e)
                rest = sorted((k for k in got if re.fullmatch(r"f_rest_\d+", k)), key=lambda k: int(k[7:]))
                for a in range(0, n, BATCH):
                    m = min(BATCH, n - a)
                    same = lambda x, kind, m=m: pa.array([x] * m, kind)
                    wide = [pa.array(got[c][a : a + m], pa.float64()) if c in got else pa.nulls(m, pa.float64()) for c in PLAIN]
                    more = pa.array(np.stack([got[k][a : a + m] for k in rest], axis=1).tolist(), pa.list_(pa.float64())) if rest else pa.nulls(m, pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([same(file, pa.string()), pa.array(range(a, a + m), pa.int64()), same(n, pa.int64()), *wide, more, same(fault, pa.string())], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, VERTICES)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frame_order(name: Column) -> list[Column]:
    """Frames follow the last number in their name, then the name."""
    numbers = F.regexp_extract_all(name, F.lit(r"(\d+)"))
    return [F.coalesce(F.try_element_at(numbers, F.lit(-1)).cast("decimal(38,0)"), F.lit(0)), name]


def segment_order(name: Column) -> list[Column]:
    """Segments follow all digits of their name taken together, then the name."""
    digits = F.regexp_replace(name, r"\D", "")
    return [F.coalesce(F.when(digits != "", digits.cast("decimal(38,0)")), F.lit(0)), name]


def _placed(files: DataFrame, order) -> DataFrame:
    """(path, place) of a folder's files: a row a file."""
    paths = files.select("path").distinct()
    return paths.withColumn("place", F.row_number().over(Window.orderBy(*order(_name(F.col("path"))))) - 1)


def attributes(v: DataFrame) -> DataFrame:
    """Vertices in scene units: logarithmic scales, turned quaternions, colours from the constant term, opacities from logits."""
    scale = {f"s{x}": F.coalesce(F.exp(f"scale_{k}"), F.lit(0.01)) for k, x in enumerate("xyz")}
    turn = [F.coalesce(F.col(f"rot_{k}"), F.lit(1.0 if k == 0 else 0.0)) for k in (1, 2, 3, 0)]
    norm = F.greatest(F.sqrt(turn[0] * turn[0] + turn[1] * turn[1] + turn[2] * turn[2] + turn[3] * turn[3]), F.lit(1e-30))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    colour = {c: unit(F.when(F.col("f_dc_0").isNotNull(), F.col(f"f_dc_{k}") * F.lit(SH_C0) + F.lit(0.5)).otherwise(F.coalesce(n, F.lit(0.5)) / F.lit(255.0))) for k, (c, n) in enumerate((("r", "red"), ("g", "green"), ("b", "blue")))}
    alpha = F.when(F.col("opacity").isNotNull(), 1 / (1 + F.exp(-F.col("opacity")))).otherwise(F.lit(1.0))
    span = D.SH_HIGH - D.SH_LOW
    code = lambda c: F.least(F.greatest(F.rint((c - F.lit(D.SH_LOW)) / F.lit(span) * F.lit(255.0)), F.lit(0.0)), F.lit(255.0)).cast("int")
    degree = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv]), F.size("rest")), F.lit(0))
    return v.select("path", "row", "vertices", *[F.col(x).alias(f"p{x}") for x in "xyz"], *[c.alias(n) for n, c in scale.items()], *[(t / norm).alias(f"q{x}") for x, t in zip("xyzw", turn)], *[c.alias(n) for n, c in colour.items()], alpha.alias("a"), degree.alias("sh_degree"), F.when(degree > 0, F.transform("rest", code)).alias("sh"))


def frames(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """A folder of frames as one scene: each vertex lives in its frame's slot, and moves as it did since the frame before
    where both have equally many vertices. Coefficients stay where all frames have those of one degree."""
    dt = 1.0 / fps
    v = vertices(spark, path).where("fault IS NULL")
    a = attributes(v).join(F.broadcast(_placed(v, frame_order)), "path")
    before = a.select((F.col("place") + 1).alias("place"), "row", "vertices", *[F.col(f"p{x}").alias(f"before_{x}") for x in "xyz"])
    a = a.join(before, ["place", "row", "vertices"], "left")
    degrees = a.agg(F.min("sh_degree").alias("low"), F.max("sh_degree").alias("high"))
    a = a.crossJoin(F.broadcast(degrees))  # one row
    one = (F.col("low") == F.col("high")) & (F.col("low") > 0)
    start = F.col("place") * F.lit(dt)
    moved = {f"v{x}": F.coalesce((F.col(f"p{x}") - F.col(f"before_{x}")) / F.lit(dt), F.lit(0.0)) for x in "xyz"}
    made = moved | {"mu_t": start + F.lit(0.5 * dt), "sigma_t": F.lit(dt / (2.0 * temporal.support_half())), "win_lo": start, "win_hi": start + F.lit(dt), "sh": F.when(one, F.col("sh")), "sh_degree": F.when(one, F.col("sh_degree")).otherwise(0)}
    return a.withColumns(made).drop("low", "high", *[f"before_{x}" for x in "xyz"])


def _packed(ranges) -> tuple:
    """(vertices, floats of a chunk, words and codes of a vertex, where bounds, words and codes begin), from the header alone."""
    size, data = 1 << 16, ranges.read(0, min(1 << 16, ranges.size))
    while data.startswith(b"ply") and b"\n" not in data[max(data.find(b"end_header"), 0) :].partition(b"end_header")[2] and size < ranges.size:
        size *= 4
        data = ranges.read(0, min(size, ranges.size))
    _, elements, at = header(data)
    (chunks, bounds), (n, words), (_, sh) = elements.get("chunk", (0, [])), elements.get("vertex", (0, [])), elements.get("sh", (0, []))
    if not n:
        raise Fault("no-vertices")
    if len(bounds) not in (12, 18, 28):
        raise Fault("unexpected-chunk-stride")
    if len(words) not in (4, 6):
        raise Fault("unexpected-vertex-stride")
    if chunks != -(-n // CHUNK):
        raise Fault("chunk-count-mismatch")
    first = at + 4 * chunks * len(bounds)
    last = first + 4 * n * len(words)
    if last + n * len(sh) > ranges.size:
        raise Fault("truncated")
    return n, len(bounds), len(words), len(sh) if len(sh) in DEGREES else 0, at, first, last


#: Vertices that a task reads at once, whole chunks of them; what is known of such a stretch.
STRETCH = 1024 * CHUNK
STRETCHES = "path string, first long, rows long, vertices long, floats int, width int, codes int, floats_at long, words_at long, codes_at long, fault string"


def _lists(table: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a table as lists."""
    n, width = table.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), pa.array(table.ravel(), kind))


def packed_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Packed vertices, and the bounds that each 256 of them share; a file that can't be read is a vertex row with its fault.

    Headers tell where vertices lie; stretches of them are read by ranges, by as many tasks as there are.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [w.split()[0] for w in STRETCHES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                try:
                    n, *told = _packed(FileRanges(file))
                    rows = [(file, a, min(STRETCH, n - a), n, *told, None) for a in range(0, n, STRETCH)]
                except Fault as e:
                    rows = [(file, 0, 1, 1, 0, 0, 0, 0, 0, 0, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [w.split()[0] for w in PACKED.split(", ")]
        for batch in batches:
            for file, first, rows, n, floats, width, codes, _, words_at, codes_at, fault in zip(*[c.to_pylist() for c in batch.columns]):
                ranges = FileRanges(file)
                for a in range(first, first + rows, BATCH):
                    m = min(BATCH, first + rows - a)
                    same = lambda x, kind, m=m: pa.repeat(pa.scalar(x, kind), m)
                    w = np.frombuffer(ranges.read(words_at + 4 * width * a, 4 * width * m), "<u4").astype(np.int64).reshape(m, width)
                    sh = _lists(np.frombuffer(ranges.read(codes_at + codes * a, codes * m), np.uint8).astype(np.int64).reshape(m, codes), pa.int64()) if codes else pa.nulls(m, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([same(file, pa.string()), pa.array(np.arange(a, a + m, dtype=np.int64)), same(n, pa.int64()), same(width == 6 and floats == 28, pa.bool_()), _lists(w, pa.int64()), sh, same(fault, pa.string())], names=names)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, rows, _, width, _, _, at, _, _, fault in zip(*[c.to_pylist() for c in batch.columns]):
                if fault is None:
                    low, n = first // CHUNK, -(-rows // CHUNK)
                    floats = np.frombuffer(FileRanges(file).read(at + 4 * width * low, 4 * width * n), "<f4").astype(np.float64).reshape(n, width)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), n), pa.array(np.arange(low, low + n, dtype=np.int64)), _lists(floats, pa.float64())], names=["path", "chunk", "floats"])

    found = spark.read.format("binaryFile").load(path).select("path").mapInArrow(stretches, STRETCHES)
    told = dealt(found, "path", "first")
    return told.mapInArrow(words, PACKED), told.mapInArrow(bounds, BOUNDS)


def packed_rotation(word: Column, wxyz: Column) -> tuple[Column, Column, Column, Column]:
    """Smallest three of a word: two bits name the largest, in the order w x y z or x y z w; three times ten bits are the others."""
    tag = F.shiftrightunsigned(word, 30).bitwiseAND(F.lit(3).cast("long"))
    v = [(D.unorm(word, s, 10) - F.lit(0.5)) / F.lit(QUAT_NORM) for s in (20, 10, 0)]
    m = F.sqrt(F.greatest(1.0 - (v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(0.0)))
    # Where each component (x, y, z, w) comes from, by tag: a place among the three, or the largest.
    first = {0: (0, 1, 2, None), 1: (None, 1, 2, 0), 2: (1, None, 2, 0), 3: (1, 2, None, 0)}
    last = {0: (None, 0, 1, 2), 1: (0, None, 1, 2), 2: (0, 1, None, 2), 3: (0, 1, 2, None)}
    pick = lambda table, c: F.coalesce(*[F.when(tag == t, m if table[t][c] is None else v[table[t][c]]) for t in table])
    q = [F.when(wxyz, pick(first, c)).otherwise(pick(last, c)) for c in range(4)]
    norm = F.greatest(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), F.lit(1e-30))
    return tuple(x / norm for x in q)


def packed_coefficient(code: Column) -> Column:
    """What a stored byte means: the middle of its bucket, the ends exactly."""
    share = F.when(code == 0, F.lit(0.0)).when(code == 255, F.lit(1.0)).otherwise((code + F.lit(0.5)) / F.lit(256.0))
    return share * F.lit(D.SH_HIGH - D.SH_LOW) + F.lit(D.SH_LOW)


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """Packed vertices in scene units, on the clock that their file carries: a join of vertices with their chunk's bounds."""
    v, bounds = packed_tables(spark, path)
    # Vertices look few to the planner; a hint keeps it from broadcasting them.
    j = v.where("fault IS NULL").withColumn("chunk", F.floor(F.col("row") / CHUNK)).hint("merge").join(bounds, ["path", "chunk"])
    word, low = (lambda k: F.get("words", F.lit(k))), (lambda k: F.get("floats", F.lit(k)))
    lerp = lambda u, a, b: low(a) + u * (low(b) - low(a))
    fields = lambda w: [D.unorm(w, 21, 11), D.unorm(w, 11, 10), D.unorm(w, 0, 11)]
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    timed = F.col("temporal")
    position, scale, motion = fields(word(0)), fields(word(2)), fields(word(4))
    channel = [D.unorm(word(3), s, 8) for s in (24, 16, 8, 0)]
    bounded = F.size("floats") >= 18
    made = {f"p{x}": lerp(position[k], k, 3 + k) for k, x in enumerate("xyz")} | {f"s{x}": F.exp(lerp(scale[k], 6 + k, 9 + k)) for k, x in enumerate("xyz")}
    made |= {f"q{x}": c for x, c in zip("xyzw", packed_rotation(word(1), timed))}
    made |= {c: unit(F.when(bounded, lerp(channel[k], 12 + k, 15 + k)).otherwise(channel[k])) for k, c in enumerate("rgb")} | {"a": channel[3]}
    made |= {f"v{x}": F.when(timed, lerp(motion[k], 18 + k, 21 + k)).otherwise(F.lit(0.0)) for k, x in enumerate("xyz")}
    time = fields(word(5))
    made |= {"mu_t": F.when(timed, lerp(time[1], 26, 27)).otherwise(F.lit(0.0)), "sigma_t": F.when(timed, F.exp(lerp(time[0], 24, 25))).otherwise(F.lit(float("inf")))}
    return j.select("path", "row", "vertices", "temporal", *[c.alias(n) for n, c in made.items()], "sh")


def segments(spark: SparkSession, path: str, segment_duration: float | None = None) -> DataFrame:
    """One scene from packed files. A single file keeps its own clock; several are segments of equal length in the order of
    the numbers in their names, and an element exists in its segment. Birth times far below zero mean "does not move" and
    "is always there". Coefficients stay where all files have as many."""
    u = unpacked(spark, path)
    place = _placed(u, segment_order)
    n = place.count()  # a row a file
    if n > 1 and not (segment_duration and 0 < segment_duration < float("inf")):
        raise ValueError("several segments need a positive, finite duration")
    u = u.join(F.broadcast(place), "path")
    still, always = F.col("mu_t") <= STATIC_MU, F.col("mu_t") <= ALWAYS_MU
    u = u.withColumns({f"v{x}": F.when(still, F.lit(0.0)).otherwise(F.col(f"v{x}")) for x in "xyz"} | {"sigma_t": F.when(always, F.lit(float("inf"))).otherwise(F.col("sigma_t"))})
    inf = F.lit(float("inf"))
    if n > 1:
        start = F.col("place") * F.lit(float(segment_duration))
        u = u.withColumns({"mu_t": F.col("mu_t") + start, "win_lo": start, "win_hi": start + F.lit(float(segment_duration))})
    else:
        last = u.agg(F.max(F.when(F.col("temporal"), F.col("mu_t"))).alias("last"))
        u = u.crossJoin(F.broadcast(last)).withColumns({"win_lo": F.lit(0.0), "win_hi": F.when(F.col("last") > 0, F.col("last")).otherwise(inf)}).drop("last")  # one row
    widths = u.agg(F.min(F.coalesce(F.size("sh"), F.lit(-1))).alias("low"), F.max(F.coalesce(F.size("sh"), F.lit(-1))).alias("high"))
    return u.crossJoin(F.broadcast(widths)).withColumn("sh", F.when(F.col("low") == F.col("high"), F.col("sh"))).drop("low", "high")
