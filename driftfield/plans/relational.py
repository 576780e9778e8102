"""Queries over the derived scene relations, named by the operator they show, with DuckDB SQL for each.

Real numbers come out as integer micro-units, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftfield.functions import quantization as D
from driftfield.functions import quaternion as Q
from driftfield.functions import temporal
from driftfield.functions.numeric import exact_sum, finite, micro, rounded, sort_key
from driftfield.operators import asof, changes, index, rules, state
from driftfield.sources import derived as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

T0, CUT = 13.5, 0.05
#: The relations of ``sources.derived`` as DuckDB views, put before each query's own SQL.
VIEWS = """WITH g AS (SELECT event_id AS gaussian_id, value / 100e0 AS px, (user_id % 50) / 10e0 AS py, (event_id % 97) / 10e0 AS pz,
 (event_id % 7 - 3) / 10e0 AS vx, (event_id % 5 - 2) / 10e0 AS vy, (event_id % 3 - 1) / 10e0 AS vz, 0.05e0 + 0.95e0 * ((event_id % 20) / 19e0) AS a,
 d / 86400000000e0 AS mu_t, CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE ELSE 0.01e0 + (user_id % 50) / 100e0 END AS sigma_t,
 3e0 * floor(d / 259200000000e0) AS win_lo, 3e0 * floor(d / 259200000000e0) + 3e0 AS win_hi, user_id % 8 AS object_id
 FROM (SELECT *, (epoch_us(ts) - 1704067200000000)::DOUBLE AS d FROM events)),
w AS (SELECT row_number() OVER (ORDER BY win_lo, win_hi) - 1 AS idx, win_lo AS lo, win_hi AS hi, n FROM (SELECT win_lo, win_hi, count(*) AS n FROM g GROUP BY ALL)),
ci AS (SELECT 0 AS chunk_id, 0e0 AS t0, 30e0 AS t1, count(*) AS gaussian_count, 64 * count(*) AS chunk_length FROM g WHERE isinf(sigma_t)
 UNION ALL SELECT row_number() OVER (ORDER BY win_lo), win_lo, win_hi, count(*), 64 * count(*) FROM g WHERE NOT isinf(sigma_t) GROUP BY win_lo, win_hi),
st AS (SELECT o_custkey AS gaussian_id, floor((epoch_us(o_orderdate) - 788918400000000) / 8640000000000e0)::BIGINT AS step, sum(floor(o_totalprice))::BIGINT AS b_x FROM orders GROUP BY ALL),
fi AS (SELECT gaussian_id, unnest(range(step, least(upto, 24) + 1)) AS step, b_x FROM (SELECT *, coalesce(lead(step) OVER (PARTITION BY gaussian_id ORDER BY step) - 1, 24) AS upto FROM st WHERE true) WHERE step <= 24),
sc AS (SELECT * FROM fi WHERE gaussian_id % 10 <> 0 OR step <= 15),
tr(object_id, interpolation, i, t, qx, qy, qz, qw, tx, ty, tz) AS (VALUES {tracks}),
lv AS (SELECT *, CASE WHEN isinf(sigma_t) THEN 1e0 ELSE exp(-0.5e0 * ((13.5e0 - mu_t) / greatest(sigma_t, 1e-30)) * ((13.5e0 - mu_t) / greatest(sigma_t, 1e-30))) END AS m FROM g WHERE win_lo <= 13.5e0 AND 13.5e0 < win_hi)
""".replace("{tracks}", ", ".join(f"({o}, '{how}', {i}, {', '.join(f'{x!r}::DOUBLE' for x in rest)})" for o, how, i, *rest in S.track_rows()))


def query(sql: str | None = None, whole: bool = False):
    """Registers a query under its function's name; ``sql`` follows the views unless it is ``whole``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if whole else VIEWS + sql
        return f

    return add


def mu(*names: str) -> list:
    return [micro(F.col(n)).alias(n) for n in names]


def sql_mu(x: str, name: str | None = None) -> str:
    return f"round_even(({x}) * 1e6, 0)::BIGINT AS {name or x}"


@query(f"SELECT gaussian_id, {sql_mu('px + vx * (13.5e0 - mu_t)', 'cx')}, {sql_mu('py + vy * (13.5e0 - mu_t)', 'cy')}, {sql_mu('pz + vz * (13.5e0 - mu_t)', 'cz')}, {sql_mu('a * m', 'opacity')}, object_id FROM lv WHERE m >= 0.05e0")
def E01_state_at(spark, sf):
    return state.state_at(S.gaussians(spark, sf), T0).select("gaussian_id", *mu("cx", "cy", "cz", "opacity"), "object_id")


@query("SELECT count(*) AS n, sum(round_even((px + vx * (13.5e0 - mu_t)) * 1e6, 0)::BIGINT)::BIGINT AS sum_cx, sum(round_even(a * m * 1e6, 0)::BIGINT)::BIGINT AS sum_opacity FROM lv WHERE m >= 0.05e0")
def E01_A03_state_summary(spark, sf):
    s = state.state_at(S.gaussians(spark, sf), T0)
    return s.agg(F.count("*").alias("n"), exact_sum(F.col("cx")).alias("sum_cx"), exact_sum(F.col("opacity")).alias("sum_opacity"))


@query(f"SELECT gaussian_id, {sql_mu('CASE WHEN isinf(sigma_t) THEN 1e0 ELSE exp(-0.5e0 * ((13.5e0 - mu_t) / sigma_t) * ((13.5e0 - mu_t) / sigma_t)) END', 'marginal')} FROM g")
def E02_marginal(spark, sf):
    return state.weighted(S.gaussians(spark, sf), F.lit(T0)).select("gaussian_id", *mu("marginal"))


K_SQL = "sqrt(-2e0 * ln(0.05e0))"


@query(f"SELECT gaussian_id, {sql_mu(f'greatest(mu_t - CASE WHEN isinf(sigma_t) THEN sigma_t ELSE {K_SQL} * sigma_t END, win_lo)', 'lo')}, {sql_mu(f'least(mu_t + CASE WHEN isinf(sigma_t) THEN sigma_t ELSE {K_SQL} * sigma_t END, win_hi)', 'hi')} FROM g")
def E03_support(spark, sf):
    lo, hi = temporal.support(*[F.col(c) for c in ("mu_t", "sigma_t", "win_lo", "win_hi")])
    return S.gaussians(spark, sf).select("gaussian_id", micro(lo).alias("lo"), micro(hi).alias("hi"))


@query(f"SELECT gaussian_id, {sql_mu('px')}, {sql_mu('py')}, {sql_mu('pz')} FROM lv WHERE m >= 0.05e0")
def E10_live(spark, sf):
    return state.live(S.gaussians(spark, sf), T0).select("gaussian_id", *mu("px", "py", "pz"))


@query(f"SELECT gaussian_id, {sql_mu('px')} FROM g WHERE gaussian_id IN (SELECT DISTINCT o_custkey FROM orders)")
def E11_gather(spark, sf):
    return state.gathered(S.gaussians(spark, sf), S.read(spark, sf, "orders").select(F.col("o_custkey").alias("gaussian_id"))).select("gaussian_id", *mu("px"))


@query("SELECT gaussian_id, step, step % 4 = 0 OR step = 7 AS keyframe FROM st")
def E12_is_keyframe(spark, sf):
    return S.steps(spark, sf).select("gaussian_id", "step", changes.is_keyframe("step", 4, (7,)).alias("keyframe"))


@query("SELECT t AS probe, count(*) AS n, sum(round_even(a * m * 1e6, 0)::BIGINT)::BIGINT AS opacity FROM (SELECT *, CASE WHEN isinf(sigma_t) THEN 1e0 ELSE exp(-0.5e0 * ((t - mu_t) / sigma_t) * ((t - mu_t) / sigma_t)) END AS m FROM g JOIN (SELECT unnest([1.5e0, 13.5e0, 15e0, 29.999e0]) AS t) ON win_lo <= t AND t < win_hi) WHERE m >= 0.05e0 GROUP BY t")
def J16_states_at_probes(spark, sf):
    probes = spark.createDataFrame([(1.5,), (13.5,), (15.0,), (29.999,)], "t double")
    s = state.state_at_many(S.gaussians(spark, sf), probes)
    return s.groupBy(F.col("t").alias("probe")).agg(F.count("*").alias("n"), exact_sum(F.col("opacity")).alias("opacity"))


@query("SELECT idx, lo::BIGINT AS lo, hi::BIGINT AS hi, n FROM w")
def J02_window_table(spark, sf):
    return index.windows(S.gaussians(spark, sf)).select(F.col("idx").cast("long").alias("idx"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "n")


@query("SELECT row_number() OVER (ORDER BY f) - 1 AS idx, win_lo::BIGINT AS lo, f AS first FROM (SELECT win_lo, win_hi, min(gaussian_id) AS f FROM g GROUP BY ALL)")
def J03_windows_by_first(spark, sf):
    return index.windows_by_first(S.gaussians(spark, sf), "gaussian_id").select(F.col("idx").cast("long").alias("idx"), F.col("lo").cast("long").alias("lo"), "first")


@query("SELECT gaussian_id, idx, (hi - lo)::BIGINT AS length FROM g JOIN w ON win_lo = lo AND win_hi = hi")
def J01_window_lengths(spark, sf):
    g, w = S.gaussians(spark, sf), index.windows(S.gaussians(spark, sf))
    return g.join(w, (F.col("win_lo") == F.col("lo")) & (F.col("win_hi") == F.col("hi"))).select("gaussian_id", F.col("idx").cast("long").alias("idx"), (F.col("hi") - F.col("lo")).cast("long").alias("length"))


@query("SELECT chunk_id, t0::BIGINT AS t0, t1::BIGINT AS t1, gaussian_count FROM ci WHERE t0 <= 13.5e0 AND 13.5e0 < t1")
def E08_chunks_for_time(spark, sf):
    return index.chunk_index(S.gaussians(spark, sf), S.DURATION).where(index.covers(F.lit(T0))).select("chunk_id", F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"), "gaussian_count")


@query("SELECT chunk_id, gaussian_count FROM ci WHERE t0 < 9e0 AND 4.5e0 < t1")
def E09_chunks_for_range(spark, sf):
    return index.chunk_index(S.gaussians(spark, sf), S.DURATION).where(index.overlaps(F.lit(4.5), F.lit(9.0))).select("chunk_id", "gaussian_count")


@query("SELECT sum(chunk_length)::BIGINT AS bytes, count(*) AS chunks FROM ci WHERE t0 <= 13.5e0 AND 13.5e0 < t1")
def A10_bytes_for_time(spark, sf):
    return index.chunk_index(S.gaussians(spark, sf), S.DURATION).where(index.covers(F.lit(T0))).agg(F.sum("chunk_length").alias("bytes"), F.count("*").alias("chunks"))


@query("SELECT chunk_id, chunk_length AS bytes FROM ci")
def A11_bytes_for_chunk(spark, sf):
    return index.chunk_index(S.gaussians(spark, sf), S.DURATION).select("chunk_id", F.col("chunk_length").alias("bytes"))


@query(", ".join(["SELECT count(*) AS n"] + [f"{f}(round_even({c} * 1e6, 0)::BIGINT) AS {f}_{c}" for c in ("px", "py", "pz") for f in ("min", "max")]) + " FROM g")
def A01_aabb(spark, sf):
    return S.gaussians(spark, sf).agg(F.count("*").alias("n"), *[F.coalesce(f(micro(F.col(c))), F.lit(0)).alias(f"{n}_{c}") for c in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max))])


@query("SELECT " + ", ".join(f"sum(round_even({c} * 1e6, 0)::BIGINT)::BIGINT AS {c}" for c in "px py pz vx vy vz a mu_t win_lo win_hi".split()) + ", NULL::BIGINT AS sigma_t FROM g")
def A03_exact_sums(spark, sf):
    return S.gaussians(spark, sf).agg(*[exact_sum(F.col(c)).alias(c) for c in "px py pz vx vy vz a mu_t win_lo win_hi sigma_t".split()])


@query("SELECT count(*) FILTER (isinf(sigma_t)) AS never_fades, count(*) FILTER (abs(vx) + abs(vy) + abs(vz) = 0) AS zero_motion FROM g")
def A04_counts(spark, sf):
    still = F.abs("vx") + F.abs("vy") + F.abs("vz") == 0
    return S.gaussians(spark, sf).agg(F.count_if(~finite(F.col("sigma_t"))).alias("never_fades"), F.count_if(still).alias("zero_motion"))


@query("SELECT round_even(coalesce(sum(round_even((px + vx * (13.5e0 - mu_t)) * 1e6, 0)::BIGINT)::DOUBLE / count(*), 0) / 1e3, 0)::BIGINT AS mean_cx_milli, round_even(coalesce(sum(round_even(a * m * 1e6, 0)::BIGINT)::DOUBLE / count(*), 0) / 1e3, 0)::BIGINT AS mean_opacity_milli FROM lv WHERE m >= 0.05e0")
def A15_means(spark, sf):
    s = state.state_at(S.gaussians(spark, sf), T0)
    mean = lambda c: F.rint(F.coalesce(F.try_divide(exact_sum(F.col(c)).cast("double"), F.count("*").cast("double")), F.lit(0.0)) / F.lit(1e3)).cast("long")
    return s.agg(mean("cx").alias("mean_cx_milli"), mean("opacity").alias("mean_opacity_milli"))


@query("SELECT min(round_even((px + vx * (13.5e0 - mu_t)) * 1e6, 0)::BIGINT) AS min_cx, max(round_even((px + vx * (13.5e0 - mu_t)) * 1e6, 0)::BIGINT) AS max_cx FROM lv WHERE m >= 0.05e0")
def A16_extent(spark, sf):
    return state.state_at(S.gaussians(spark, sf), T0).agg(F.min(micro(F.col("cx"))).alias("min_cx"), F.max(micro(F.col("cx"))).alias("max_cx"))


@query("SELECT round_even(median(px) * 1e6, 0)::BIGINT AS median_px, min(round_even(px * 1e6, 0)::BIGINT) AS origin FROM g")
def A17_A18_median_and_origin(spark, sf):
    return S.gaussians(spark, sf).agg(F.rint(F.median("px") * F.lit(1e6)).cast("long").alias("median_px"), F.min(micro(F.col("px"))).alias("origin"))


#: Pitches of the default profile for a median scale of 0.02.
STEP = D.steps(D.bounds("default", 0.02))
QX = f"round_even((px - 0.1e0) / {STEP['pos']!r}::DOUBLE, 0)::BIGINT"


@query(f"SELECT gaussian_id, {QX} AS bin, {sql_mu(f'({QX})::DOUBLE * {STEP['pos']!r}::DOUBLE + 0.1e0', 'value')} FROM g")
def D02_D03_quantize(spark, sf):
    b = D.quantize(F.col("px"), STEP["pos"], 0.1)
    return S.gaussians(spark, sf).select("gaussian_id", b.alias("bin"), micro(D.dequantize(b, STEP["pos"], 0.1)).alias("value"))


@query(f"SELECT round_even(max(abs(px - (({QX})::DOUBLE * {STEP['pos']!r}::DOUBLE + 0.1e0))) * 1e6, 0)::BIGINT AS worst, max(abs(px - (({QX})::DOUBLE * {STEP['pos']!r}::DOUBLE + 0.1e0))) <= {STEP['pos'] / 2!r}::DOUBLE + 1e-9 AS within FROM g")
def A06_A08_error_audit(spark, sf):
    back = D.dequantize(D.quantize(F.col("px"), STEP["pos"], 0.1), STEP["pos"], 0.1)
    worst = F.max(F.abs(F.col("px") - back))
    return S.gaussians(spark, sf).agg(micro(worst).alias("worst"), (worst <= F.lit(STEP["pos"] / 2 + 1e-9)).alias("within"))


SB = f"round_even(ln(sigma_t) / {STEP['sigma_log']!r}::DOUBLE, 0)"


@query(f"SELECT gaussian_id, greatest(-4, least(2, ceil(log2(greatest(0.02e0, least(2e0, CASE WHEN isinf(sigma_t) THEN win_hi - win_lo ELSE {K_SQL} * exp({SB} * {STEP['sigma_log']!r}::DOUBLE) END)) / 0.5e0))))::BIGINT AS life, round_even({STEP['motion']!r}::DOUBLE * pow(2e0, -greatest(-4, least(2, ceil(log2(greatest(0.02e0, least(2e0, CASE WHEN isinf(sigma_t) THEN win_hi - win_lo ELSE {K_SQL} * exp({SB} * {STEP['sigma_log']!r}::DOUBLE) END)) / 0.5e0))))) * 1e9, 0)::BIGINT AS motion_step_nano FROM g")
def D04_D05_life_class(spark, sf):
    never = ~finite(F.col("sigma_t"))
    b = D.quantize(F.log(F.when(~never, F.col("sigma_t")).otherwise(F.lit(1.0))), STEP["sigma_log"])
    life = D.life_class(b, STEP["sigma_log"], never, F.col("win_hi") - F.col("win_lo"))
    return S.gaussians(spark, sf).select("gaussian_id", life.alias("life"), F.rint(D.motion_step(life, STEP["motion"]) * F.lit(1e9)).cast("long").alias("motion_step_nano"))


@query(f"SELECT gaussian_id, round_even({STEP['time']!r}::DOUBLE * pow(2e0, greatest(-10, least(0, floor(log2(CASE WHEN isinf(sigma_t) THEN {STEP['time']!r}::DOUBLE ELSE least({STEP['time']!r}::DOUBLE, 0.05e0 * exp({SB} * {STEP['sigma_log']!r}::DOUBLE)) END / {STEP['time']!r}::DOUBLE))))) * 1e9, 0)::BIGINT AS step_nano FROM g")
def D06_mu_steps(spark, sf):
    never = ~finite(F.col("sigma_t"))
    b = D.quantize(F.log(F.when(~never, F.col("sigma_t")).otherwise(F.lit(1.0))), STEP["sigma_log"])
    return S.gaussians(spark, sf).select("gaussian_id", F.rint(D.mu_step(b, STEP["sigma_log"], never, STEP["time"]) * F.lit(1e9)).cast("long").alias("step_nano"))


@query("SELECT l_orderkey, r, g, b, g AS y, r - g AS u, b - g AS v, (r - g) + g AS r2, (b - g) + g AS b2 FROM (SELECT l_orderkey, (l_partkey % 256)::BIGINT AS r, (l_suppkey % 256)::BIGINT AS g, (l_orderkey % 256)::BIGINT AS b FROM lineitem)", whole=True)
def D09_D10_colour(spark, sf):
    c = S.read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))
    y, u, v = D.colour_forward(F.col("r"), F.col("g"), F.col("b"))
    r2, _, b2 = D.colour_inverse(y, u, v)
    return c.select("*", y.alias("y"), u.alias("u"), v.alias("v"), r2.alias("r2"), b2.alias("b2"))


@query("SELECT code, least(255, greatest(0, (code // 8) * 8 + 4)) AS five_bits, least(255, greatest(0, (code // 3) * 3 + 1)) AS by_three, round_even((code * (8e0 / 255e0) - 4e0) * 1e6, 0)::BIGINT AS coefficient, count(*) AS n FROM (SELECT (l_partkey % 256)::BIGINT AS code FROM lineitem) GROUP BY code", whole=True)
def D11_D16_harmonics(spark, sf):
    c = S.read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 256).alias("code")).agg(F.count("*").alias("n"))
    return c.select("code", D.coarsen_sh(F.col("code"), D.sh_step(5)).alias("five_bits"), D.coarsen_sh(F.col("code"), 3).alias("by_three"), micro(D.sh_coefficient(F.col("code"))).alias("coefficient"), "n")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}', {round(v * 1e9)})" for p in D.PROFILES for k, v in D.steps(D.bounds(p, 0.02)).items()) + ") v(profile, attribute, step_nano)", whole=True)
def D17_D18_profiles(spark, sf):
    rows = [(p, k, float(v)) for p in D.PROFILES for k, v in D.steps(D.bounds(p, 0.02)).items()]
    return spark.createDataFrame(rows, "profile string, attribute string, step double").select("profile", "attribute", F.rint(F.col("step") * F.lit(1e9)).cast("long").alias("step_nano"))


CELL = "round_even(greatest(0e0, least(1e0, ({c} - {lo}) / {span})) * 2097151e0, 0)::BIGINT"
_SPREAD = "list_sum(list_transform(range(0, 21), lambda i: ((({x}) >> i::BIGINT) & 1::BIGINT) * (1::BIGINT << (3 * i + {k})::BIGINT)))::BIGINT"


@query("SELECT gaussian_id, " + " + ".join(_SPREAD.format(x=CELL.format(c=c, lo=f"min_{c}", span=f"(CASE WHEN max_{c} - min_{c} <= 0 THEN 1e0 ELSE max_{c} - min_{c} END)"), k=k) for k, c in enumerate(("px", "py", "pz"))) + " AS code FROM g, (SELECT min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py, min(pz) AS min_pz, max(pz) AS max_pz FROM g)")
def D19_O02_morton(spark, sf):
    g = S.gaussians(spark, sf)
    box = g.agg(*[f(c).alias(f"{n}_{c}") for c in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max))]).first()  # six numbers
    cells = [D.morton_cell(F.col(c), F.lit(box[f"min_{c}"]), F.lit(box[f"max_{c}"])) for c in ("px", "py", "pz")]
    return g.select("gaussian_id", D.morton_code(*cells).alias("code"))


@query("SELECT event_id, x, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z, x AS back FROM (SELECT event_id, (event_id % 1001 - 500)::BIGINT AS x FROM events)", whole=True)
def C04_C05_zigzag(spark, sf):
    e = S.read(spark, sf, "events").select("event_id", (F.col("event_id") % 1001 - 500).alias("x"))
    return e.withColumn("z", D.zigzag(F.col("x"))).withColumn("back", D.unzigzag(F.col("z")))


@query("SELECT event_id, label, CASE WHEN label >= 2147483648 THEN label - 4294967296 ELSE label END AS code, label AS back FROM (SELECT event_id, ((event_id * 2654435761) % 4294967296)::BIGINT AS label FROM events)", whole=True)
def C15_C16_labels(spark, sf):
    e = S.read(spark, sf, "events").select("event_id", (F.col("event_id") * F.lit(2654435761) % F.lit(1 << 32)).alias("label"))
    return e.withColumn("code", D.to_signed32(F.col("label"))).withColumn("back", D.to_unsigned32(F.col("code")))


ROT = "(SELECT event_id, event_id % 11 - 5e0 AS x, event_id % 7 - 3e0 AS y, event_id % 5 - 2e0 AS z, event_id % 3 + 1e0 AS w FROM events)"
_N = "sqrt(x * x + y * y + z * z + w * w)"


def _unit(spark, sf):
    i = F.col("event_id")
    raw = [(i % n - k).cast("double") for n, k in ((11, 5), (7, 3), (5, 2))] + [(i % 3 + 1).cast("double")]
    return S.read(spark, sf, "events").select("event_id", *[x.alias(n) for x, n in zip(Q.normalized(tuple(raw)), "xyzw")])


@query(f"SELECT event_id, {sql_mu(f'x / {_N}', 'x')}, {sql_mu(f'y / {_N}', 'y')}, {sql_mu(f'z / {_N}', 'z')}, {sql_mu(f'w / {_N}', 'w')} FROM {ROT}", whole=True)
def F03_F04_normalize(spark, sf):
    return _unit(spark, sf).select("event_id", *mu("x", "y", "z", "w"))


ROT_BINS = f"(SELECT event_id, k, list_transform(list_filter([0, 1, 2, 3], lambda i: i <> k), lambda i: round_even(l[i + 1] * CASE WHEN l[k + 1] < 0 THEN -1e0 ELSE 1e0 END / {STEP['rot']!r}::DOUBLE, 0)::BIGINT) AS r FROM (SELECT event_id, [x / {_N}, y / {_N}, z / {_N}, w / {_N}] AS l, CASE greatest(abs(x), abs(y), abs(z), abs(w)) WHEN abs(x) THEN 0 WHEN abs(y) THEN 1 WHEN abs(z) THEN 2 ELSE 3 END AS k FROM {ROT}))"
_LEFT = f"greatest(0e0, 1 - (r[1] * r[1] + r[2] * r[2] + r[3] * r[3]) * {STEP['rot']!r}::DOUBLE * {STEP['rot']!r}::DOUBLE)"


@query(f"SELECT event_id, k::BIGINT AS largest, r[1] AS b0, r[2] AS b1, r[3] AS b2, {sql_mu(f'sqrt({_LEFT}) / sqrt(1 - greatest(0e0, 1 - ({_LEFT})) + greatest(0e0, 1 - ({_LEFT})))', 'back')} FROM {ROT_BINS}", whole=True)
def D07_D08_rotation(spark, sf):
    at, bins = Q.smallest_three(tuple(F.col(c) for c in "xyzw"), STEP["rot"])
    coded = _unit(spark, sf).select("event_id", at.alias("largest"), *[b.alias(f"b{i}") for i, b in enumerate(bins)])
    back = Q.from_smallest_three(F.col("largest"), tuple(F.col(f"b{i}") for i in range(3)), STEP["rot"])
    return coded.withColumn("back", micro(F.get(F.array(*back), F.col("largest").cast("int"))))


@query(f"SELECT event_id, {sql_mu('(1 - 2 * (y * y + z * z)) * 1 + (2 * (x * y - z * w)) * 2 + (2 * (x * z + y * w)) * 3 + 0.5', 'x')}, {sql_mu('(2 * (x * y + z * w)) * 1 + (1 - 2 * (x * x + z * z)) * 2 + (2 * (y * z - x * w)) * 3 - 0.25', 'y')} FROM (SELECT event_id, x / {_N} AS x, y / {_N} AS y, z / {_N} AS z, w / {_N} AS w FROM {ROT})", whole=True)
def F05_F08_apply_pose(spark, sf):
    v = Q.applied(tuple(F.col(c) for c in "xyzw"), (F.lit(0.5), F.lit(-0.25), F.lit(0.0)), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return _unit(spark, sf).select("event_id", micro(v[0]).alias("x"), micro(v[1]).alias("y"))


@query(f"SELECT event_id, {sql_mu('(w * 0.5e0 + x * 0.5e0 + y * 0.5e0 - z * 0.5e0) / n', 'x')}, {sql_mu('(w * 0.5e0 - x * 0.5e0 - y * 0.5e0 - z * 0.5e0) / n', 'w')} FROM (SELECT *, {_N} AS n FROM {ROT})", whole=True)
def F06_F07_F09_compose(spark, sf):
    half = F.lit(0.5)
    q = Q.multiply(tuple(F.col(c) for c in "xyzw"), (half, half, half, half))
    return _unit(spark, sf).select("event_id", micro(q[0]).alias("x"), micro(q[3]).alias("w"))


POSE_SQL = """, br AS (SELECT object_id, interpolation, t, qx, qy, qz, qw, tx, ty, lead(t) OVER o AS nt, lead(qx) OVER o AS nqx, lead(qy) OVER o AS nqy, lead(qz) OVER o AS nqz, lead(qw) OVER o AS nqw, lead(tx) OVER o AS ntx, lead(ty) OVER o AS nty,
 min(t) OVER (PARTITION BY object_id) AS lo, max(t) OVER (PARTITION BY object_id) AS hi FROM tr WINDOW o AS (PARTITION BY object_id ORDER BY t)),
ps AS (SELECT *, greatest(lo, least(hi, 13.5e0)) AS q, CASE WHEN nt IS NULL OR interpolation = 'step' THEN 0e0 ELSE (greatest(lo, least(hi, 13.5e0)) - t) / (nt - t) END AS u FROM br),
p1 AS (SELECT *, qx * coalesce(nqx, qx) + qy * coalesce(nqy, qy) + qz * coalesce(nqz, qz) + qw * coalesce(nqw, qw) AS dt FROM ps WHERE t <= q AND (nt IS NULL OR q < nt)),
p2 AS (SELECT *, CASE WHEN dt < 0 THEN -1e0 ELSE 1e0 END AS sg, abs(dt) AS ad FROM p1),
p3 AS (SELECT *, acos(least(1e0, ad)) AS th FROM p2),
p4 AS (SELECT object_id, CASE WHEN u = 0 THEN qz WHEN ad > 0.9995e0 THEN (qz + u * (sg * nqz - qz)) / sqrt(pow(qz + u * (sg * nqz - qz), 2) + pow(qw + u * (sg * nqw - qw), 2)) ELSE sin((1 - u) * th) / sin(th) * qz + sin(u * th) / sin(th) * sg * nqz END AS rz,
 CASE WHEN u = 0 THEN qw WHEN ad > 0.9995e0 THEN (qw + u * (sg * nqw - qw)) / sqrt(pow(qz + u * (sg * nqz - qz), 2) + pow(qw + u * (sg * nqw - qw), 2)) ELSE sin((1 - u) * th) / sin(th) * qw + sin(u * th) / sin(th) * sg * nqw END AS rw,
 CASE WHEN u = 0 THEN tx ELSE tx + u * (ntx - tx) END AS sx, CASE WHEN u = 0 THEN ty ELSE ty + u * (nty - ty) END AS sy FROM p3)
"""


@query(POSE_SQL + f"SELECT object_id, {sql_mu('rz', 'qz')}, {sql_mu('rw', 'qw')}, {sql_mu('sx', 'tx')}, {sql_mu('sy', 'ty')} FROM p4")
def J07_F01_pose_at(spark, sf):
    return asof.pose_at(S.track_samples(spark), "object_id", T0).select("object_id", *mu("qz", "qw", "tx", "ty"))


@query(POSE_SQL + f"SELECT gaussian_id, {sql_mu('CASE WHEN rw IS NULL THEN cx ELSE (1 - 2 * rz * rz) * cx - 2 * rz * rw * cy + sx END', 'cx')}, {sql_mu('CASE WHEN rw IS NULL THEN cy ELSE 2 * rz * rw * cx + (1 - 2 * rz * rz) * cy + sy END', 'cy')} FROM (SELECT gaussian_id, object_id, px + vx * (13.5e0 - mu_t) AS cx, py + vy * (13.5e0 - mu_t) AS cy FROM lv WHERE m >= 0.05e0) LEFT JOIN p4 USING (object_id)")
def J04_E04_E05_state_with_tracks(spark, sf):
    s = state.with_tracks(state.state_at(S.gaussians(spark, sf), T0), S.track_samples(spark), T0)
    return s.select("gaussian_id", *mu("cx", "cy"))


LAST, CADENCE = 24, 4


def _states(spark, sf):
    return changes.filled(S.steps(spark, sf), LAST)


DIFF_SQL = """, lg AS (SELECT *, lag(step) OVER o AS ps, lag(b_x) OVER o AS pb, lead(step) OVER o AS ns FROM sc WINDOW o AS (PARTITION BY gaussian_id ORDER BY step)),
ch AS (SELECT step // 4 * 4 AS gop, step, gaussian_id, CASE WHEN step % 4 = 0 THEN 'k' WHEN ps IS NULL OR ps <> step - 1 THEN 'b' WHEN b_x <> pb THEN 'u' END AS op, CASE WHEN step % 4 <> 0 AND ps = step - 1 THEN b_x - pb ELSE b_x END AS b_x FROM lg),
dd AS (SELECT * FROM ch WHERE op IS NOT NULL UNION ALL SELECT (step + 1) // 4 * 4, step + 1, gaussian_id, 'd', NULL FROM lg WHERE step < 24 AND (ns IS NULL OR ns <> step + 1) AND (step + 1) % 4 <> 0)
"""


@query(DIFF_SQL + "SELECT * FROM dd")
def J13_U08_delta_groups(spark, sf):
    return changes.diffed(_states(spark, sf), CADENCE, LAST)


@query("SELECT gaussian_id, b_x FROM sc WHERE step = 18")
def J12_compose_at(spark, sf):
    return changes.composed_at(changes.diffed(_states(spark, sf), CADENCE, LAST), 18, CADENCE)


@query(DIFF_SQL + "SELECT s.gaussian_id, s.step, s.b_x AS value FROM sc s SEMI JOIN (SELECT * FROM dd WHERE op <> 'd') d ON s.gaussian_id = d.gaussian_id AND s.step = d.step")
def W09_running_bins(spark, sf):
    return changes.composed(changes.diffed(_states(spark, sf), CADENCE, LAST)).where("op <> 'd'").select("gaussian_id", "step", "value")


@query("SELECT coalesce(a.gaussian_id, b.gaussian_id) AS gaussian_id, CASE WHEN a.b_x IS NULL THEN 'b' WHEN b.b_x IS NULL THEN 'd' ELSE 'u' END AS op, CASE WHEN a.b_x IS NOT NULL AND b.b_x IS NOT NULL THEN b.b_x - a.b_x ELSE b.b_x END AS b_x FROM (SELECT * FROM sc WHERE step = 10) a FULL JOIN (SELECT * FROM sc WHERE step = 17) b ON a.gaussian_id = b.gaussian_id WHERE a.b_x IS DISTINCT FROM b.b_x")
def J13_delta_between(spark, sf):
    s = _states(spark, sf)
    return changes.delta_between(s.where("step = 10"), s.where("step = 17"))


@query("SELECT gaussian_id, b_x FROM sc WHERE step = 17")
def J12_apply_delta(spark, sf):
    s = _states(spark, sf)
    old = s.where("step = 10").select("gaussian_id", "b_x")
    return changes.applied(old, changes.delta_between(old, s.where("step = 17")))


@query("SELECT gaussian_id, count(*) AS births, min(step) AS first_step FROM (SELECT *, lag(step) OVER (PARTITION BY gaussian_id ORDER BY step) AS p FROM st) WHERE p IS NULL OR p < step - 1 GROUP BY gaussian_id")
def W07_births(spark, sf):
    return changes.births(S.steps(spark, sf))


@query("SELECT count(DISTINCT gaussian_id) AS distinct_ids, count(*) FILTER (births > 1) AS reused FROM (SELECT gaussian_id, count(*) AS births FROM (SELECT *, lag(step) OVER (PARTITION BY gaussian_id ORDER BY step) AS p FROM st) WHERE p IS NULL OR p < step - 1 GROUP BY gaussian_id)")
def A12_A14_identity_audit(spark, sf):
    return changes.births(S.steps(spark, sf)).agg(F.count("*").alias("distinct_ids"), F.count_if(F.col("births") > 1).alias("reused"))


@query("SELECT step AS probe, count(*) AS live, sum(b_x)::BIGINT AS bin_sum FROM sc GROUP BY step")
def A09_states_by_step(spark, sf):
    return _states(spark, sf).groupBy(F.col("step").alias("probe")).agg(F.count("*").alias("live"), F.sum("b_x").alias("bin_sum"))


@query("SELECT gaussian_id, rn FROM (SELECT gaussian_id, row_number() OVER (ORDER BY round_even(px * 1e6, 0), round_even(py * 1e6, 0), round_even(pz * 1e6, 0), gaussian_id) AS rn FROM g) WHERE rn <= 16")
def W10_O01_O08_first_rows(spark, sf):
    top = S.gaussians(spark, sf).select("gaussian_id", *[sort_key(F.col(c)).alias(c) for c in ("px", "py", "pz")]).orderBy("px", "py", "pz", "gaussian_id").limit(16)
    return top.select("gaussian_id", F.row_number().over(Window.orderBy("px", "py", "pz", "gaussian_id")).cast("long").alias("rn"))


NAMES = ["frame_2_010.ply", "frame_10.ply", "a7b9.ply", "plain.ply", "x0003.ply", "f10_2.ply"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") v(name)", whole=True)
def O05_natural_names(spark, sf):
    digits = F.regexp_extract_all("name", F.lit(r"(\d+)"))
    s = S.values(spark, [(n,) for n in NAMES], "name string")
    return s.orderBy(F.try_element_at(digits, F.lit(-1)).cast("long").asc_nulls_first(), "name")


@query("SELECT gaussian_id, object_id FROM g WHERE object_id = 1 UNION ALL SELECT gaussian_id, 0 FROM g WHERE object_id = 2")
def U01_U02_concatenate(spark, sf):
    g = S.gaussians(spark, sf)
    return g.where("object_id = 1").select("gaussian_id", "object_id").unionByName(g.where("object_id = 2").select("gaussian_id"), allowMissingColumns=True).fillna({"object_id": 0})


@query("SELECT gaussian_id FROM sc WHERE step = 10 INTERSECT SELECT gaussian_id FROM sc WHERE step = 17")
def U04_disjoint_groups(spark, sf):
    s = _states(spark, sf)
    return s.where("step = 10").select("gaussian_id").intersect(s.where("step = 17").select("gaussian_id"))


@query("SELECT l_orderkey, n FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)", whole=True)
def U05_duplicate_ids(spark, sf):
    return S.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select("l_orderkey", "n")


@query("SELECT DISTINCT win_lo::BIGINT AS lo, win_hi::BIGINT AS hi FROM g")
def U07_distinct_windows(spark, sf):
    return S.gaussians(spark, sf).select(F.col("win_lo").cast("long").alias("lo"), F.col("win_hi").cast("long").alias("hi")).distinct()


@query("SELECT event_id, x, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS total, x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS diff FROM (SELECT event_id, user_id, floor(value)::BIGINT AS x FROM events)", whole=True)
def W01_W02_running(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = S.read(spark, sf, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("x"))
    return e.select("event_id", "x", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), (F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0))).alias("diff"))


@query("SELECT gaussian_id, step, floor((b_x - lag(b_x) OVER (PARTITION BY gaussian_id ORDER BY step))::DOUBLE / (step - lag(step) OVER (PARTITION BY gaussian_id ORDER BY step)))::BIGINT AS velocity, coalesce(lead(step) OVER (PARTITION BY gaussian_id ORDER BY step), 25) AS t1 FROM st")
def W03_W04_velocity_and_end(spark, sf):
    w = Window.partitionBy("gaussian_id").orderBy("step")
    s = S.steps(spark, sf)
    return s.select("gaussian_id", "step", F.floor((F.col("b_x") - F.lag("b_x").over(w)) / (F.col("step") - F.lag("step").over(w))).alias("velocity"), F.coalesce(F.lead("step").over(w), F.lit(25).cast("long")).alias("t1"))


@query("SELECT gaussian_id, step, last_value(CASE WHEN step % 4 = 0 THEN step END IGNORE NULLS) OVER (PARTITION BY gaussian_id ORDER BY step) AS key FROM sc")
def W08_keyframe_of(spark, sf):
    w = Window.partitionBy("gaussian_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return _states(spark, sf).select("gaussian_id", "step", F.last(F.when(F.col("step") % CADENCE == 0, F.col("step")), ignorenulls=True).over(w).alias("key"))


@query(f"SELECT gaussian_id, {sql_mu('CASE WHEN px / 10e0 <= 0.04045e0 THEN px / 10e0 / 12.92e0 ELSE pow((px / 10e0 + 0.055e0) / 1.055e0, 2.4e0) END', 'linear')} FROM g")
def F13_srgb_to_linear(spark, sf):
    x = F.col("px") / F.lit(10.0)
    return S.gaussians(spark, sf).select("gaussian_id", micro(F.when(x <= 0.04045, x / F.lit(12.92)).otherwise(F.pow((x + 0.055) / F.lit(1.055), F.lit(2.4)))).alias("linear"))


@query(f"SELECT gaussian_id, {sql_mu('px')}, CASE WHEN isinf(sigma_t) THEN NULL ELSE round_even(sigma_t * 1e6, 0)::BIGINT END AS sigma FROM g")
def F20_rounded(spark, sf):
    g = S.gaussians(spark, sf)
    return g.select("gaussian_id", micro(rounded(F.col("px"))).alias("px"), micro(rounded(F.col("sigma_t"))).alias("sigma"))


@query("SELECT l_orderkey, l_linenumber, f11, f10, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, round_even(((p >> 21) & 2047) / 2047e0 * 1e6, 0)::BIGINT AS f11, round_even(((p >> 11) & 1023) / 1023e0 * 1e6, 0)::BIGINT AS f10 FROM (SELECT l_orderkey, l_linenumber, ((l_partkey * 2654435761) % 4294967296)::BIGINT AS p FROM lineitem)) GROUP BY ALL", whole=True)
def F26_packed_fields(spark, sf):
    p = (F.col("l_partkey") * F.lit(2654435761)) % F.lit(1 << 32)
    e = S.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", micro(D.unorm(p, 21, 11)).alias("f11"), micro(D.unorm(p, 11, 10)).alias("f10"))
    return e.groupBy("l_orderkey", "l_linenumber", "f11", "f10").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT round_even(x * 1e6, 0)::BIGINT AS t FROM (SELECT unnest([t0, (t0 + t1) / 2, t1 - 1e-6]) AS x FROM ci)")
def F28_probe_times(spark, sf):
    c = index.chunk_index(S.gaussians(spark, sf), S.DURATION)
    return c.select(F.explode(F.array("t0", (F.col("t0") + F.col("t1")) / F.lit(2.0), F.col("t1") - F.lit(1e-6))).alias("x")).select(micro(F.col("x")).alias("t")).distinct()


@query("SELECT vec_id, label, round_even(list_cosine_similarity(embedding::DOUBLE[], q) * 1e6, 0)::BIGINT AS similarity FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)", whole=True)
def F30_cosine(spark, sf):
    e = S.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    q = F.array(*[F.lit(float(v)) for v in e.where("vec_id = 0").first()["x"]])  # one vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = F.col("x")
    return e.select("vec_id", "label", micro(dot(x, q) / F.sqrt(dot(x, x) * dot(q, q))).alias("similarity"))


@query("SELECT 'gaussian-id-reused' AS rule, 'error' AS severity, gaussian_id::VARCHAR AS item, count(*)::VARCHAR || ' births' AS message FROM (SELECT *, lag(step) OVER (PARTITION BY gaussian_id ORDER BY step) AS p FROM st) WHERE p IS NULL OR p < step - 1 GROUP BY gaussian_id HAVING count(*) > 1")
def V06_reused_ids(spark, sf):
    return rules.faults(changes.births(S.steps(spark, sf)), "gaussian-id-reused", "gaussian_id", "births > 1", F.concat(F.col("births").cast("string"), F.lit(" births")))


