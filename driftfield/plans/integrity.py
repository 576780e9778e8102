"""Queries over chains, indexes, objects and reports, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftfield.functions.numeric import micro
from driftfield.operators import chains, changes, index, rules, state
from driftfield.plans.relational import LAST, STEP, QX, _states, query, sql_mu
from driftfield.functions import quantization as D
from driftfield.sources import derived as S

CHAIN_SQL = "(SELECT DISTINCT step AS o, CASE WHEN step % 4 = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN step % 4 = 0 THEN step ELSE step - 1 END AS r FROM sc)"


def _chain(spark, sf):
    s = _states(spark, sf).select(F.col("step").alias("offset")).distinct()
    key = F.col("offset") % 4 == 0
    return s.select("offset", F.when(key, 0).otherwise(1).alias("kind"), F.when(key, F.col("offset")).otherwise(F.col("offset") - 1).alias("reference"))


@query(f"SELECT o AS \"offset\", o - o % 4 AS keyframe, o % 4 AS depth FROM {CHAIN_SQL}")
def J11_chains(spark, sf):
    return chains.walked(_chain(spark, sf), 8).select("offset", "keyframe", "depth")


@query("SELECT chunk_id, field FROM (SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL OR b.chunk_id IS NULL THEN 'chunk_id' WHEN a.gaussian_count <> b.gaussian_count THEN 'gaussian_count' END AS field FROM ci a FULL JOIN (SELECT chunk_id, gaussian_count + CASE WHEN chunk_id = 2 THEN 1 ELSE 0 END AS gaussian_count FROM ci WHERE chunk_id <> 4) b ON a.chunk_id = b.chunk_id) WHERE field IS NOT NULL")
def J10_index_matches(spark, sf):
    c = index.chunk_index(S.gaussians(spark, sf), S.DURATION)
    other = c.where("chunk_id <> 4").withColumn("gaussian_count", F.col("gaussian_count") + F.when(F.col("chunk_id") == 2, 1).otherwise(0))
    return chains.mismatched(c, other, "chunk_id", ["t0", "t1", "gaussian_count"])


@query("SELECT count(*) FILTER (m >= 0.05e0) AS visible, (SELECT count(*) FROM g) AS total FROM lv")
def K11_visible_of_total(spark, sf):
    g = state.weighted(S.gaussians(spark, sf), F.lit(13.5))
    inside = (F.col("win_lo") <= 13.5) & (F.lit(13.5) < F.col("win_hi")) & (F.col("marginal") >= 0.05)
    return g.agg(F.count_if(inside).alias("visible"), F.count("*").alias("total"))


@query(f"SELECT count(*) AS n, sum(abs(d)) // 1000 * 1000 AS total_deviation, max(abs(d)) AS worst FROM (SELECT round_even((px - (({QX})::DOUBLE * {STEP['pos']!r}::DOUBLE + 0.1e0)) * 1e6, 0)::BIGINT AS d FROM g)")
def A19_distortion(spark, sf):
    back = D.dequantize(D.quantize(F.col("px"), STEP["pos"], 0.1), STEP["pos"], 0.1)
    d = F.abs(micro(F.col("px") - back))
    return S.gaussians(spark, sf).agg(F.count("*").alias("n"), (F.floor(F.sum(d) / 1000) * 1000).alias("total_deviation"), F.max(d).alias("worst"))


@query(f"SELECT gaussian_id, {sql_mu('px + vx * (win_lo - mu_t)', 'px')}, {sql_mu('win_lo', 'mu_t')} FROM g")
def D21_reanchor(spark, sf):
    """The same straight path, told from the window's start."""
    return S.gaussians(spark, sf).select("gaussian_id", micro(F.col("px") + F.col("vx") * (F.col("win_lo") - F.col("mu_t"))).alias("px"), micro(F.col("win_lo")).alias("mu_t"))


@query(f"SELECT gaussian_id, {sql_mu('px + vx * (13.5e0 - mu_t)', 'cx')}, {sql_mu('a * m', 'opacity')} FROM lv")
def E06_E07_window_only(spark, sf):
    """Reconstruction of composed populations: the window decides, the cutoff does not."""
    g = S.gaussians(spark, sf).where("win_lo <= 13.5D AND 13.5D < win_hi")
    return state.moved(state.weighted(g, F.lit(13.5)), F.lit(13.5)).select("gaussian_id", micro(F.col("cx")).alias("cx"), micro(F.col("opacity")).alias("opacity"))


@query("SELECT gaussian_id, count(*) AS changes, sum(CASE WHEN b_x <> p THEN 1 ELSE 0 END)::BIGINT AS moved FROM (SELECT *, lag(b_x) OVER (PARTITION BY gaussian_id, step // 4 ORDER BY step) AS p FROM sc) GROUP BY gaussian_id")
def V18_invariants_within_groups(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("gaussian_id", changes.gop("step", 4)).orderBy("step")
    s = _states(spark, sf).withColumn("p", F.lag("b_x").over(w))
    return s.groupBy("gaussian_id").agg(F.count("*").alias("changes"), F.sum(F.when(F.col("b_x") != F.col("p"), 1).otherwise(0)).cast("long").alias("moved"))


@query("SELECT gaussian_id FROM g WHERE gaussian_id NOT IN (SELECT gaussian_id FROM st)")
def J19_missing_ids(spark, sf):
    return S.gaussians(spark, sf).join(S.steps(spark, sf).select("gaussian_id"), "gaussian_id", "left_anti").select("gaussian_id")


