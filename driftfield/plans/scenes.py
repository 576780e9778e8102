"""Queries over a scene file and a keyframe-and-delta file that the sinks write from the tables, read back in both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import quantization as D
from driftfield.functions.numeric import exact_sum, micro
from driftfield.operators import changes, chains, index, rules, state
from driftfield.plans import relational
from driftfield.plans.containers import folder, once
from driftfield.plans.relational import K_SQL, VIEWS, _states, query, sql_mu
from driftfield.sources import container as C
from driftfield.sources import derived as S
from driftfield.sources import indexed as X
from driftfield.sources import scene_records as R
from driftfield.sources import sequence as Q

LEAST, DEPTH, BITS = 24, 2, {1: 5, 2: 4}
STEP = D.steps(D.bounds("default", 0.03))


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """The derived elements with what a file needs besides: scales, rotations, colours, coefficients, their own number."""
    i = F.col("gaussian_id")
    codes = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: (i * 7 + k * 13) % 256)
    return S.gaussians(spark, sf).withColumns({"sx": F.lit(0.03), "sy": 0.01 + (i % 5) / F.lit(100.0), "sz": F.lit(0.03), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.6), "qw": F.lit(0.8), "r": (i % 10) / F.lit(9.0), "g": F.lit(0.5), "b": F.lit(0.25), "sh": codes, "source_index": i})


def scene(spark: SparkSession, sf: str, as_given: bool = True) -> str:
    """The file of the elements, with chunks by the supports as given (their SQL plans so) or as decoders see them."""

    def make() -> str:
        path = f"{folder(spark, 'scene')}/scene.bin"
        C.write(elements(spark, sf), path, S.DURATION, extra=R.encoded("Metadata", ["table", {"name": "events"}]), most_depth=DEPTH, least=LEAST, bits=BITS, as_given=as_given)
        return path

    return once(spark, sf, f"scene {as_given}", make)


def framed(spark, sf):
    return once(spark, sf, "scene records", lambda: C.records(spark, scene(spark, sf)).cache())


#: The planned chunks of the derived elements, and the elements as the file's grids hold them.
PLAN = VIEWS + f""", su AS (SELECT *, greatest(mu_t - CASE WHEN isinf(sigma_t) THEN sigma_t ELSE {K_SQL} * sigma_t END, win_lo) AS lo, least(mu_t + CASE WHEN isinf(sigma_t) THEN sigma_t ELSE {K_SQL} * sigma_t END, win_hi) AS hi FROM g),
d1 AS (SELECT *, CASE WHEN hi <= win_lo + 1.5e0 THEN 0 WHEN lo >= win_lo + 1.5e0 THEN 1 END AS h FROM su),
d2 AS (SELECT *, CASE WHEN hi <= win_lo + h * 1.5e0 + 0.75e0 THEN 0 WHEN lo >= win_lo + h * 1.5e0 + 0.75e0 THEN 1 END AS q FROM d1),
d3 AS (SELECT *, count(*) OVER (PARTITION BY win_lo, h) AS n1, count(*) OVER (PARTITION BY win_lo, h, q) AS n2 FROM d2),
d4 AS (SELECT *, CASE WHEN h IS NULL OR n1 < {LEAST} THEN 0 WHEN q IS NULL OR n2 < {LEAST} THEN 1 ELSE 2 END AS level FROM d3),
pl AS (SELECT *, win_lo + CASE level WHEN 0 THEN 0e0 WHEN 1 THEN h * 1.5e0 ELSE h * 1.5e0 + q * 0.75e0 END AS t0, CASE level WHEN 0 THEN 3e0 WHEN 1 THEN 1.5e0 ELSE 0.75e0 END AS span FROM d4),
nodes AS (SELECT t0, t0 + span AS t1, level, count(*) AS n FROM pl GROUP BY ALL),
bx AS (SELECT min(px) AS ox, min(py) AS oy, min(pz) AS oz FROM g),
sb AS (SELECT pl.*, ox, oy, oz, CASE WHEN isinf(sigma_t) THEN NULL ELSE exp(round_even(ln(sigma_t) / {STEP['sigma_log']!r}::DOUBLE, 0) * {STEP['sigma_log']!r}::DOUBLE) END AS sg FROM pl, bx),
mt AS (SELECT *, {STEP['time']!r}::DOUBLE * pow(2e0, CASE WHEN sg IS NULL THEN 0 ELSE greatest(-10, least(0, floor(log2(least({STEP['time']!r}::DOUBLE, 0.05e0 * sg) / {STEP['time']!r}::DOUBLE)))) END) AS ms FROM sb),
de AS (SELECT *, {", ".join(f"round_even((p{x} - o{x}) / {STEP['pos']!r}::DOUBLE, 0) * {STEP['pos']!r}::DOUBLE + o{x} AS d{x}" for x in "xyz")}, least(1e0, greatest(0e0, round_even(a / {STEP['alpha']!r}::DOUBLE, 0) * {STEP['alpha']!r}::DOUBLE)) AS da, round_even(mu_t / ms, 0) * ms AS dm FROM mt)
"""


def planned(sql: str):
    return query(PLAN + sql, whole=True)


@planned("SELECT round_even(t0 * 1e6, 0)::BIGINT AS t0, round_even(t1 * 1e6, 0)::BIGINT AS t1, level, n FROM nodes")
def K03_O07_R05_chunk_plan(spark, sf):
    """The file's chunks by their own heads."""
    b = C.bins(framed(spark, sf), []).where("fault IS NULL")
    return b.groupBy("t0", "t1", "level").agg(F.count("*").alias("n")).select(micro(F.col("t0")).alias("t0"), micro(F.col("t1")).alias("t1"), "level", "n")


@planned(f"SELECT gaussian_id, {sql_mu('dx', 'px')}, {sql_mu('dy', 'py')}, {sql_mu('dz', 'pz')}, {sql_mu('da', 'a')}, {sql_mu('dm', 'mu_t')}, {sql_mu('win_lo')}, object_id, isinf(sigma_t) AS never_fades FROM de")
def K01_K02_S08_C12_C14_decoded(spark, sf):
    """Every element as a front-to-back reading gives it."""
    g = C.gaussians(framed(spark, sf))
    return g.select(F.col("source_index").alias("gaussian_id"), *[micro(F.col(c)).alias(c) for c in ("px", "py", "pz", "a", "mu_t", "win_lo")], "object_id", (F.col("sigma_t") == F.lit(float("inf"))).alias("never_fades"))


@planned(f"SELECT gaussian_id, {sql_mu('dx', 'px')}, {sql_mu('da', 'a')}, level FROM de WHERE t0 <= 13.5e0 AND 13.5e0 < t0 + span")
def S03_S09_S10_E08_indexed_at(spark, sf):
    """Elements of the chunks that cover a time; only those chunks are fetched, by their byte ranges."""
    return X.scene_at(spark, scene(spark, sf), 13.5).select(F.col("source_index").alias("gaussian_id"), micro(F.col("px")).alias("px"), micro(F.col("a")).alias("a"), "level")


@planned(f"SELECT gaussian_id, {sql_mu('dy', 'py')} FROM de WHERE t0 < 9e0 AND 4.5e0 < t0 + span")
def E09_indexed_range(spark, sf):
    return X.scene_at(spark, scene(spark, sf), 4.5, 9.0).select(F.col("source_index").alias("gaussian_id"), micro(F.col("py")).alias("py"))


@planned("SELECT count(*) AS n, sum(round_even((dx + round_even(vx / mo, 0) * mo * (13.5e0 - dm)) * 1e3, 0)::BIGINT)::BIGINT AS sum_cx_milli FROM (SELECT *, " + f"{STEP['motion']!r}::DOUBLE * pow(2e0, -greatest(-4, least(2, ceil(log2(greatest(0.02e0, least(2e0, CASE WHEN sg IS NULL THEN 3e0 ELSE {K_SQL} * sg END)) / 0.5e0))))) AS mo, CASE WHEN sg IS NULL THEN 1e0 ELSE exp(-0.5e0 * ((13.5e0 - dm) / sg) * ((13.5e0 - dm) / sg)) END AS m FROM de) WHERE win_lo <= 13.5e0 AND 13.5e0 < win_hi AND m >= 0.05e0")
def S28_state_from_index(spark, sf):
    """The instant query over what the index leads to: all that decodes to be visible, as chunks hold decoded supports."""
    s = state.state_at(X.scene_at(spark, scene(spark, sf, as_given=False), 13.5, 13.5000001), 13.5)
    return s.agg(F.count("*").alias("n"), F.sum(F.rint(F.col("cx") * F.lit(1e3)).cast("long")).alias("sum_cx_milli"))


@planned("SELECT round_even(t0 * 1e6, 0)::BIGINT AS t0, round_even(t1 * 1e6, 0)::BIGINT AS t1, n AS gaussian_count, 2 AS bands, true AS summary_crc_ok, level FROM nodes")
def R07_S09_C10_index_entries(spark, sf):
    """Entries from the file's end, each with the level that its chunk's own head tells."""
    recs = framed(spark, sf)
    at = recs.where(F.col("opcode") == C.OPCODES["Chunk"]).select(F.col("ordinal").alias("chunk"), F.col("offset").alias("chunk_offset"), (F.col("length") + X.HEAD).alias("found"))
    levels = C.chunk_heads(recs).select("chunk", "level")
    e = X.entries(spark, scene(spark, sf)).join(at.join(levels, "chunk"), "chunk_offset").where("found = chunk_length")
    return e.select(micro(F.col("t0")).alias("t0"), micro(F.col("t1")).alias("t1"), "gaussian_count", F.size("bands").alias("bands"), "summary_crc_ok", "level")


@planned("SELECT opcode, count(*) AS n, in_summary FROM (SELECT unnest([1, 2, 3, 4, 11]) AS opcode, false AS in_summary UNION ALL SELECT unnest([12, 15]), true UNION ALL SELECT 5, false FROM nodes UNION ALL SELECT unnest([7, 7]), false FROM nodes UNION ALL SELECT 8, true FROM nodes) GROUP BY ALL")
def S07_K12_inspected(spark, sf):
    """Records by kind, and whether the footer's checksum covers them; framing alone, no content is decoded but the footer's."""
    recs = framed(spark, sf)
    foot = R.table(recs, "Footer").select("path", "summary_start")
    end = recs.where(F.col("opcode") == C.OPCODES["Footer"]).select("path", F.col("offset").alias("end"))
    j = recs.join(foot, "path").join(end, "path")
    return j.groupBy("opcode", ((F.col("offset") >= F.col("summary_start")) & (F.col("offset") < F.col("end"))).alias("in_summary")).agg(F.count("*").alias("n"))


@planned("SELECT 8 AS group_opcode, count(*) AS records, sum(n)::BIGINT AS gaussians FROM nodes")
def R02_R15_summary_offsets(spark, sf):
    """The group that the summary names, counted by the records that lie in it."""
    recs = framed(spark, sf)
    named = R.table(recs, "SummaryOffset").join(R.table(recs, "Footer"), "path")
    inside = recs.select("path", "offset", "opcode").join(named, "path").where("offset >= group_start AND offset < group_start + group_length AND opcode = group_opcode AND group_start = summary_start")
    total = C.chunk_index(recs).agg(F.sum("gaussian_count").alias("gaussians"))
    return inside.groupBy("group_opcode").agg(F.count("*").alias("records")).crossJoin(F.broadcast(total))  # one row


@planned("SELECT 'gaussian-birth' AS temporal_model, count(*) AS gaussian_count, 30000000 AS duration, 2 AS sh_degree, " + ", ".join(f"{f}(round_even({c} * 1e6, 0)::BIGINT) AS {f}_{c}" for c in ("px", "py", "pz") for f in ("min", "max")) + " FROM g")
def R01_header_of_scene(spark, sf):
    h = C.headers(X.front(spark, scene(spark, sf)))
    names = [f"{f}_{c}" for f in ("min", "max") for c in ("px", "py", "pz")]
    return h.select("temporal_model", "gaussian_count", micro(F.col("duration")).alias("duration"), "sh_degree", *[micro(F.get("aabb", i)).alias(n) for i, n in enumerate(names)])


@planned("SELECT 'uniform-v1' AS scheme, round_even(min(px) * 1e6, 0)::BIGINT AS ox, round_even(2 * 0.05e0 * (SELECT quantile_disc(s, 0.5) FROM (SELECT unnest([0.03e0, 0.01e0 + (gaussian_id % 5) / 100e0, 0.03e0]) AS s FROM g)) * 1e9, 0)::BIGINT AS pos_nano, round_even(2 * ln(1.02e0) * 1e9, 0)::BIGINT AS scale_log_nano, round_even(2e0 / 255 * 1e9, 0)::BIGINT AS rgb_nano FROM g")
def R03_A17_A18_grids(spark, sf):
    nano = lambda c: F.rint(F.col(c) * F.lit(1e9)).cast("long")
    return C.grids(X.front(spark, scene(spark, sf))).select("scheme", micro(F.col("ox")).alias("ox"), nano("pos").alias("pos_nano"), nano("scale_log").alias("scale_log_nano"), nano("rgb").alias("rgb_nano"))


@planned("SELECT idx, round_even(lo * 1e6, 0)::BIGINT AS lo, round_even(hi * 1e6, 0)::BIGINT AS hi FROM w")
def R04_windows_of_scene(spark, sf):
    return C.windows(framed(spark, sf)).select("idx", micro(F.col("lo")).alias("lo"), micro(F.col("hi")).alias("hi"))


SH_SQL = "least(255, greatest(0, ((gaussian_id * 7 + k * 13) % 256) // {s} * {s} + {s} // 2))"


@planned("SELECT gaussian_id, sum(CASE WHEN k < 9 THEN " + SH_SQL.format(s=8) + " ELSE " + SH_SQL.format(s=16) + " END * (k + 1))::BIGINT AS weighted FROM (SELECT gaussian_id, unnest(range(0, 24)) AS k FROM g) GROUP BY gaussian_id")
def C13_D13_D14_harmonics(spark, sf):
    """Coefficients of both bands of every element, as they were kept at five and four bits."""
    g = X.scene_at(spark, scene(spark, sf), most_band=2)
    codes = F.flatten("sh")
    return g.select(F.col("source_index").alias("gaussian_id"), F.aggregate(F.transform(codes, lambda c, k: c * (k + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("weighted"))


@planned("SELECT CASE WHEN k < 9 THEN 1 ELSE 2 END AS band, max(abs(" + SH_SQL.format(s="(CASE WHEN k < 9 THEN 8 ELSE 16 END)") + " - (gaussian_id * 7 + k * 13) % 256))::BIGINT AS worst, max(CASE WHEN k < 9 THEN 4 ELSE 8 END)::BIGINT AS bound FROM (SELECT gaussian_id, unnest(range(0, 24)) AS k FROM g) GROUP BY band")
def A07_D12_band_deviation(spark, sf):
    """How far codes are from those that were given, and the bound that their depth allows."""
    back = X.scene_at(spark, scene(spark, sf), most_band=2).select(F.col("source_index").alias("gaussian_id"), F.posexplode(F.flatten("sh")).alias("k", "code"))
    given = F.pmod(F.col("gaussian_id") * 7 + F.col("k") * 13, F.lit(256))
    band = F.when(F.col("k") < 9, 1).otherwise(2)
    return back.groupBy(band.alias("band")).agg(F.max(F.abs(F.col("code") - given)).alias("worst")).withColumn("bound", F.when(F.col("band") == 1, D.sh_bound(5)).otherwise(D.sh_bound(4)).cast("long"))


@planned("SELECT attribute, round_even(max(d) * 1e6, 0)::BIGINT AS worst FROM (SELECT unnest(['a', 'mu_t', 'px', 'py', 'pz']) AS attribute, unnest([abs(da - a), abs(dm - mu_t), abs(dx - px), abs(dy - py), abs(dz - pz)]) AS d FROM de) GROUP BY attribute")
def A06_worst_by_attribute(spark, sf):
    back = C.gaussians(framed(spark, sf))
    names = ["a", "mu_t", "px", "py", "pz"]
    # Decoded rows look few to the planner; a hint keeps it from broadcasting them.
    j = back.select("source_index", *[F.col(c).alias(f"b_{c}") for c in names]).hint("merge").join(elements(spark, sf).select("source_index", *names), "source_index")
    each = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.abs(F.col(f"b_{c}") - F.col(c)).alias("d")) for c in names])).alias("x"))
    return each.groupBy("x.attribute").agg(micro(F.max("x.d")).alias("worst"))


@planned("SELECT CASE WHEN level = 1 THEN 'index-bands-mismatch' END AS rule, round_even(t0 * 1e6, 0)::BIGINT AS t0 FROM nodes WHERE level = 1")
def J18_index_bands(spark, sf):
    """Bands that entries name against the band records that follow their chunks; here entries of level one lack the second."""
    recs = framed(spark, sf)
    own = R.bands(recs).groupBy("chunk").agg(F.sort_array(F.collect_set("band")).alias("found"))
    at = recs.where(F.col("opcode") == C.OPCODES["Chunk"]).select(F.col("ordinal").alias("chunk"), F.col("offset").alias("chunk_offset"))
    level = C.chunk_heads(recs).select("chunk", "level")
    named = F.sort_array(F.transform("bands", lambda b: b["band"]))
    e = C.chunk_index(recs).join(at.join(own, "chunk").join(level, "chunk"), "chunk_offset").withColumn("named", F.when(F.col("level") == 1, F.slice(named, 1, 1)).otherwise(named))
    return e.where(~F.col("named").eqNullSafe(F.col("found"))).select(F.lit("index-bands-mismatch").alias("rule"), micro(F.col("t0")).alias("t0"))


@planned("SELECT t::BIGINT AS t, count(n) AS chunks, coalesce(sum(n), 0)::BIGINT AS gaussians FROM (SELECT unnest(range(0, 30, 3)) + 1 AS t) LEFT JOIN nodes ON t0 <= t AND t < t1 GROUP BY t")
def K10_seek_costs(spark, sf):
    """What a seek to evenly spaced times has to fetch, from the index."""
    probes = spark.range(1, 31, 3).select(F.col("id").alias("t"), F.floor(F.col("id") / 3).alias("slot"))
    e = X.entries(spark, scene(spark, sf)).withColumn("slot", F.explode(F.sequence(F.floor(F.col("t0") / 3), F.floor((F.col("t1") - 1e-9) / 3))))
    j = probes.join(e, "slot", "left").withColumn("in", (F.col("t0") <= F.col("t")) & (F.col("t") < F.col("t1")))
    return j.groupBy("t").agg(F.count_if("in").alias("chunks"), F.coalesce(F.sum(F.when(F.col("in"), F.col("gaussian_count"))), F.lit(0)).alias("gaussians"))


# A keyframe-and-delta file of the customers' running bins.

STEPS, CADENCE = 25, 4
GRID = {"pos": 0.5, "scale_log": 0.1, "rot": 0.001, "rgb": 0.01, "alpha": 0.01, "motion": 0.1, "time": 0.5, "sigma_log": 0.1, "sh": 1}


def sequence(spark: SparkSession, sf: str, mode: int = Q.CHAINED) -> str:
    """Step i is [i, i + 1); bins are the customer's running one and few of its own, the birth time is the anchor's."""

    def make() -> str:
        s = _states(spark, sf).where(F.col("step") >= 0)
        born = F.min("step").over(relational.Window.partitionBy("gaussian_id", changes.gop("step", CADENCE)))
        cols = {"b_position_0": F.col("b_x"), "b_position_1": F.col("gaussian_id") % 100, "b_opacity": 50 + F.col("gaussian_id") % 50, "b_mu_t": F.rint(born / F.lit(GRID["time"])).cast("long"), "b_object_id": F.col("gaussian_id") % 8}
        fixed = {a: 0 for a in C.COLUMNS if a not in cols and not a.startswith(("b_source", "b_gaussian"))} | {"b_rotation_index": 3, "b_flags": 1}
        path = f"{folder(spark, 'sequence')}/sequence.bin"
        Q.write(s.select("step", "gaussian_id", *[x.alias(n) for n, x in cols.items()]), path, [float(i) for i in range(STEPS)], float(STEPS), GRID, (0.0, 0.0, 0.0), [(0.0, float(STEPS))], CADENCE, mode, fixed=fixed)
        return path

    return once(spark, sf, f"sequence {mode}", make)


def chunks(spark, sf, mode=Q.CHAINED):
    return once(spark, sf, f"sequence records {mode}", lambda: C.records(spark, sequence(spark, sf, mode)).cache())


SEQ = VIEWS + """, s0 AS (SELECT * FROM sc WHERE step >= 0),
lg AS (SELECT *, lag(step) OVER o AS ps, lag(b_x) OVER o AS pb, lead(step) OVER o AS ns FROM s0 WINDOW o AS (PARTITION BY gaussian_id ORDER BY step)),
ops AS (SELECT step, CASE WHEN step % 4 = 0 THEN 'k' WHEN ps IS NULL OR ps <> step - 1 THEN 'b' WHEN b_x <> pb THEN 'u' END AS op, gaussian_id FROM lg UNION ALL SELECT step + 1, 'd', gaussian_id FROM lg WHERE step < 24 AND (ns IS NULL OR ns <> step + 1) AND (step + 1) % 4 <> 0)
"""


def stepped(sql: str):
    return query(SEQ + sql, whole=True)


@stepped("SELECT step, op, count(*) AS n, sum(gaussian_id)::BIGINT AS ids FROM ops WHERE op IS NOT NULL GROUP BY ALL")
def K04_R23_R26_groups(spark, sf):
    """Updates, births and deaths of every step as the file tells them."""
    recs = chunks(spark, sf)
    at = Q.heads(recs).select("offset", F.col("t0").cast("long").alias("step"))
    return Q.changes(recs, ["b_gaussian_id"]).where("fault IS NULL").join(F.broadcast(at), "offset").groupBy("step", "op").agg(F.count("*").alias("n"), F.sum("b_gaussian_id").alias("ids"))


@stepped("SELECT step, gaussian_id, b_x FROM s0")
def S22_S24_S26_populations(spark, sf):
    """The population at every chunk, composed along chained references."""
    p = Q.populations(chunks(spark, sf), ["b_position_0"])
    return p.select(F.col("t0").cast("long").alias("step"), "gaussian_id", F.col("b_position_0").alias("b_x"))


@stepped("SELECT step, count(*) AS n, sum(b_x)::BIGINT AS total FROM s0 GROUP BY step")
def S27_keyed_populations(spark, sf):
    """The same from a file whose deltas refer to their keyframes."""
    p = Q.populations(chunks(spark, sf, Q.KEYED), ["b_position_0"])
    return p.groupBy(F.col("t0").cast("long").alias("step")).agg(F.count("*").alias("n"), F.sum("b_position_0").alias("total"))


@stepped("SELECT gaussian_id, b_x * 500000::BIGINT AS cx, round_even(((50 + gaussian_id % 50) * 0.01e0) * 1e6, 0)::BIGINT AS opacity FROM s0 WHERE step = 18")
def S25_E06_O04_state_at(spark, sf):
    """One time's population in real units: its chain alone is composed."""
    s = Q.state_at(chunks(spark, sf), 18.5)
    return s.select("gaussian_id", micro(F.col("cx")).alias("cx"), micro(F.col("opacity")).alias("opacity"))


@stepped("SELECT gaussian_id, b_x FROM s0 WHERE step = 24")
def E07_past_the_end(spark, sf):
    """Beyond the last chunk its population stays."""
    return Q.population_at(chunks(spark, sf), 99.0, ["b_position_0"]).select("gaussian_id", F.col("b_position_0").alias("b_x"))


@stepped("SELECT s.step, CASE WHEN s.step % 4 = 0 THEN 0 ELSE 1 END AS kind, s.step % 4 AS depth, s.step - s.step % 4 AS keyframe, CASE WHEN s.step % 4 = 0 THEN s.step ELSE s.step - 1 END AS reference, (SELECT count(*) FROM s0 WHERE s0.step = s.step) AS live_count, (SELECT count(*) FROM ops WHERE op IS NOT NULL AND ops.step = s.step) AS gaussian_count FROM (SELECT unnest(range(0, 25)) AS step) s")
def R06_J10_J11_S23_index_and_heads(spark, sf):
    """Index entries joined with the heads of the chunks that they name and with the walked chains; places told as steps."""
    recs = chunks(spark, sf)
    h = Q.heads(recs).select(F.col("offset").alias("chunk_offset"), "t0", F.col("kind").alias("h_kind"), F.col("reference").alias("h_reference"), F.col("keyframe").alias("h_keyframe"), F.col("depth").alias("h_depth"))
    w = Q.chains(recs).select(F.col("offset").alias("chunk_offset"), F.col("keyframe").alias("w_keyframe"), F.col("depth").alias("w_depth"))
    e = X.entries(spark, sequence(spark, sf)).drop("t0").join(h, "chunk_offset").join(w, "chunk_offset")
    e = e.where("kind = h_kind AND keyframe = h_keyframe AND keyframe = w_keyframe AND depth = h_depth AND depth = w_depth AND (kind = 0 OR reference = h_reference)")
    step = lambda c: h.select(F.col("chunk_offset").alias(c), F.col("t0").cast("long").alias(f"{c}_step"))
    e = e.withColumn("reference", F.col("h_reference")).join(step("keyframe"), "keyframe").join(step("reference"), "reference")
    return e.select(F.col("t0").cast("long").alias("step"), "kind", "depth", F.col("keyframe_step").alias("keyframe"), F.col("reference_step").alias("reference"), "live_count", "gaussian_count")


@stepped("SELECT count(DISTINCT gaussian_id) AS distinct_ids, count(DISTINCT gaussian_id) AS declared, count(*) FILTER (births > 1) AS reused FROM (SELECT gaussian_id, count(*) FILTER (ps IS NULL OR ps <> step - 1) AS births FROM lg GROUP BY gaussian_id)")
def A12_A13_A14_A21_identities(spark, sf):
    """Distinct ids over all populations and those born more than once. The shuffle by id partitions the work, so no task
    holds all ids."""
    recs = chunks(spark, sf)
    p = Q.populations(recs, []).select("gaussian_id", F.col("t0").cast("long").alias("step"))
    found = changes.births(p).agg(F.count("*").alias("distinct_ids"), F.count_if(F.col("births") > 1).alias("reused"))
    return found.crossJoin(F.broadcast(C.headers(recs).select(F.col("gaussian_count").alias("declared"))))  # one row each


@stepped("SELECT round_even(t * 1e6, 0)::BIGINT AS probe, count(gaussian_id) AS live_count, coalesce(sum(b_x), 0)::BIGINT * 500000 AS position_sum FROM (SELECT DISTINCT unnest([s, s + 0.5e0]) AS t FROM (SELECT unnest(range(0, 25)) AS s) UNION SELECT 25e0 - 1e-6) LEFT JOIN s0 ON step = floor(t) GROUP BY t")
def K09_A09_F28_probes(spark, sf):
    """Count and exact position sum at each chunk's start and middle and just before the end."""
    recs = chunks(spark, sf)
    h = Q.heads(recs).select(F.col("offset").alias("chunk"), "t0", "t1")
    times = F.array(F.col("t0"), (F.col("t0") + F.col("t1")) / F.lit(2.0), F.when(F.col("t1") == STEPS, F.col("t1") - F.lit(1e-6)))
    probes = h.select("chunk", F.explode(F.array_compact(times)).alias("t"))
    p = Q.populations(recs, ["b_position_0"]).groupBy("chunk").agg(F.count("*").alias("live_count"), exact_sum(F.col("b_position_0").cast("double") * F.lit(GRID["pos"])).alias("position_sum"))
    return probes.join(p, "chunk", "left").select(micro(F.col("t")).alias("probe"), F.coalesce("live_count", F.lit(0)).alias("live_count"), F.coalesce("position_sum", F.lit(0)).alias("position_sum"))


@stepped("SELECT step, (CASE WHEN step % 4 = 0 THEN 2 * step ELSE NULL END)::BIGINT AS mu_bin, count(*) AS n FROM s0 WHERE step % 4 = 0 GROUP BY step")
def V11_keyframe_birth_times(spark, sf):
    """Birth-time bins of keyframes that are those of the keyframe's own start, by step."""
    recs = chunks(spark, sf)
    keys = Q.changes(recs, ["b_mu_t"]).where("op = 'k'").join(F.broadcast(Q.heads(recs).select("offset", "t0")), "offset")
    good = keys.where(F.col("b_mu_t") == F.rint(F.col("t0") / F.lit(GRID["time"])).cast("long"))
    return good.groupBy(F.col("t0").cast("long").alias("step"), F.col("b_mu_t").alias("mu_bin")).agg(F.count("*").alias("n"))


@stepped("SELECT 'id-in-two-groups' AS rule, gaussian_id::VARCHAR AS item FROM ops WHERE op = 'b' AND step = 5 UNION ALL SELECT 'bin-overflow', gaussian_id::VARCHAR FROM ops WHERE op IN ('b', 'u') AND step = 6 UNION ALL SELECT 'rotation-index-out-of-range', gaussian_id::VARCHAR FROM ops WHERE op = 'b' AND step = 7 UNION ALL SELECT 'unknown-gaussian-id', gaussian_id::VARCHAR FROM ops WHERE op = 'd' AND step = 9 UNION ALL SELECT 'duplicate-gaussian-id', gaussian_id::VARCHAR FROM ops WHERE op = 'b' AND step = 10")
def V10_U04_U05_J19_change_rules(spark, sf):
    """Rules over changes, on the file's own changes with faults put in at steps of their own."""
    recs = chunks(spark, sf)
    c = Q.changes(recs, ["b_gaussian_id", "b_position_0", "b_rotation_index"]).where("fault IS NULL").join(F.broadcast(Q.heads(recs).select("offset", F.col("t0").cast("long").alias("step"), "reference", "kind")), "offset")
    big = F.when(F.col("step") == 6, F.lit(1 << 31).cast("long"))
    c = c.withColumns({"b_position_0": F.when(F.col("op").isin("b", "u"), F.coalesce(big, F.col("b_position_0"))).otherwise(F.col("b_position_0")), "b_rotation_index": F.when((F.col("step") == 7) & (F.col("op") == "b"), F.lit(4).cast("long")).otherwise(F.col("b_rotation_index"))})
    twice = c.where("step = 5 AND op = 'b'").withColumn("op", F.lit("d")).unionByName(c.where("step = 10 AND op = 'b'"))
    bad = c.unionByName(twice)
    before = Q.populations(recs, []).select(F.col("chunk").alias("reference"), F.col("gaussian_id").alias("b_gaussian_id"), F.lit(True).alias("there"))
    lost = c.where("step = 9 AND op = 'd'").select("reference", "b_gaussian_id")
    # Decoded rows look few to the planner; hints keep it from broadcasting them.
    before = before.hint("merge").join(lost.hint("merge"), ["reference", "b_gaussian_id"], "left_anti")
    seen = bad.where("op IN ('u', 'd') AND step <> 5").hint("merge").join(before.hint("merge"), ["reference", "b_gaussian_id"], "left")
    groups = bad.groupBy("offset", "b_gaussian_id").agg(F.countDistinct("op").alias("ops"))
    same = bad.groupBy("offset", "op", "b_gaussian_id").agg(F.count("*").alias("n"))
    return rules.report(
        rules.faults(groups, "id-in-two-groups", "b_gaussian_id", "ops > 1"),
        rules.faults(same, "duplicate-gaussian-id", "b_gaussian_id", "n > 1"),
        rules.faults(bad, "bin-overflow", "b_gaussian_id", "abs(b_position_0) > 2147483647"),
        rules.faults(bad, "rotation-index-out-of-range", "b_gaussian_id", "b_rotation_index NOT BETWEEN 0 AND 3"),
        rules.faults(seen, "unknown-gaussian-id", "b_gaussian_id", "there IS NULL"),
    ).select("rule", "item")


@stepped("SELECT DISTINCT CASE WHEN step = 24 THEN step ELSE step + 1 END AS t0, CASE WHEN step = 24 THEN 'ends-off' ELSE 'gap' END AS fault FROM s0 WHERE step % 7 = 3")
def W05_V06_timeline(spark, sf):
    """Whether chunks tile the clock; here those of some steps end early."""
    h = Q.heads(chunks(spark, sf)).withColumn("t1", F.when(F.col("t0") % 7 == 3, F.col("t1") - 0.25).otherwise(F.col("t1")))
    bad = index.untiled(h, float(STEPS), "path")
    return bad.select(F.col("t0").cast("long").alias("t0"), "fault")


@stepped("SELECT 'forward-reference' AS rule, step AS item FROM (SELECT DISTINCT step FROM s0) WHERE step % 4 = 2 AND step % 5 = 0 UNION ALL SELECT 'chain-without-keyframe', step FROM (SELECT DISTINCT step FROM s0) WHERE step % 4 = 3 AND (step - 1) % 5 = 0 UNION ALL SELECT 'depth-mismatch', step FROM (SELECT DISTINCT step FROM s0) WHERE step % 4 = 1 AND step % 3 = 0")
def J11_chain_faults(spark, sf):
    """The file's references with faults put in: some point forward, which also cuts off what refers to them; some depths lie."""
    h = Q.heads(chunks(spark, sf)).withColumn("s", F.col("t0").cast("long"))
    forward = (F.col("s") % 4 == 2) & (F.col("s") % 5 == 0)
    bad = h.select("offset", "kind", F.when(forward, F.col("offset") + 1).otherwise(F.col("reference")).alias("reference"), (F.col("depth") + F.when((F.col("s") % 4 == 1) & (F.col("s") % 3 == 0), 1).otherwise(0)).cast("long").alias("declared_depth"), "s")
    found = chains.chain_faults(bad.drop("s")).where("rule <> 'broken-reference'")
    return found.join(bad.select(F.col("offset").cast("string").alias("item"), "s"), "item").select("rule", F.col("s").alias("item"))
