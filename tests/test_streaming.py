from driftfield.operators import changes as batch
from driftfield.sources import derived
from driftfield.streaming import state


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_population_follows_the_batch_composition(spark, tmp_path):
    states = batch.filled(derived.steps(spark, "/root/testdata/sf0.001"), 12).where("gaussian_id < 30").cache()
    diff = batch.diffed(states, 100, 12).where("step > 0 OR op = 'k'")
    for i, (lo, hi) in enumerate([(0, 5), (5, 9), (9, 13)]):
        diff.where(f"step >= {lo} AND step < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = run(state.population(state.changes(spark, str(tmp_path / "in"))), "population", tmp_path).toPandas()
    last = out.sort_values("step").groupby("gaussian_id").last()
    want = {r["gaussian_id"]: r["b_x"] for r in states.where("step = 12").collect()}
    assert out["fault"].isna().all() and {int(i): int(x) for i, x in last[last["live"]]["b_x"].items()} == want


def test_changes_that_do_not_fit_are_named(spark, tmp_path):
    rows = [(0, 0, 1, "k", 5), (0, 1, 1, "d", None), (0, 2, 1, "u", 3), (0, 3, 1, "b", 9), (0, 1, 2, "u", 1)]
    spark.createDataFrame(rows, state.CHANGE).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(state.population(state.changes(spark, str(tmp_path / "in"))), "faults", tmp_path)
    assert {(r["gaussian_id"], r["step"]): r["fault"] for r in out.where("fault IS NOT NULL").collect()} == {(1, 2): "unknown-id", (1, 3): "gaussian-id-reused", (2, 1): "unknown-id"}


def test_visible_now_equals_the_batch_query(spark, tmp_path):
    from driftfield.operators.state import live

    g = derived.gaussians(spark, "/root/testdata/sf0.001")
    g.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.schema).parquet(str(tmp_path / "in"))
    assert run(state.visible_now(stream, 13.5), "visible", tmp_path).count() == live(g, 13.5).count()
