"""What only shows on large tables, made to show on small ones."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.functions import quantization as D
from driftfield.operators.planner import planned
from driftfield.plans import containers, imports, relational, scenes
from driftfield.sources import container as C
from driftfield.sources import indexed as X
from driftfield.sources import pieces as P
from driftfield.sources import ply
from driftfield.sources.scene_records import object_table
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def streamed(df):
    """Whether all broadcast sides are the right ones: decoded rows are on the left and look few to the planner."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BuildRight" in plan and "BuildLeft" not in plan


def test_elements_read_by_ranges_are_not_broadcast(spark):
    assert streamed(X.scene_at(spark, scenes.scene(spark, SF), most_band=2).where("px > 0"))


def test_lists_of_bands_are_those_of_each_row():
    a, b = np.arange(12).reshape(4, 3), np.arange(20).reshape(4, 5)
    assert X.lists_of([a, b]).to_pylist() == [[x.tolist(), y.tolist()] for x, y in zip(a, b)]


def test_supports_are_computed_once(spark):
    """Conditions on nodes were pushed below the supports, which were then computed for each comparison."""
    g = C.decoded_support(scenes.elements(spark, SF), D.steps(D.bounds("default", 0.03)), 0.05)
    p = planned(g, F.col("__lo"), F.col("__hi"), [3.0 * i for i in range(11)], 2, 24)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("EXP(") < 6


#: A node is one chunk, in however many pieces it was coded.
IN_PIECES = [
    "S07_K12_inspected",
    "K10_seek_costs",
    "R02_R15_summary_offsets",
    "R07_S09_C10_index_entries",
    "J18_index_bands",
    "E09_indexed_range",
    "S03_S09_S10_E08_indexed_at",
]


@pytest.mark.parametrize("name", IN_PIECES)
def test_nodes_of_many_pieces_are_one_chunk(spark, monkeypatch, name):
    monkeypatch.setattr(containers, "_MADE", {})
    monkeypatch.setattr(P, "PIECE", 16)
    assert_same(spark, relational.QUERIES[name], relational.SQL[name], SF)


def test_decoded_elements_are_not_broadcast(spark):
    recs = scenes.framed(spark, SF)
    assert streamed(C.gaussians(recs)) and C.bins(recs).rdd.getNumPartitions() > 1


def test_elements_meet_those_given_without_a_broadcast(spark):
    plan = relational.QUERIES["A06_worst_by_attribute"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan


#: Populations told in pieces are those of one piece.
TOLD_IN_PIECES = [
    "V10_U04_U05_J19_change_rules",
    "A12_A13_A14_A21_identities",
    "E07_past_the_end",
    "K04_R23_R26_groups",
    "K09_A09_F28_probes",
    "S22_S24_S26_populations",
    "S27_keyed_populations",
    "W05_V06_timeline",
    "V11_keyframe_birth_times",
    "J11_chain_faults",
]


@pytest.mark.parametrize("name", TOLD_IN_PIECES)
def test_steps_of_many_pieces_are_one_chunk(spark, monkeypatch, name):
    monkeypatch.setattr(containers, "_MADE", {})
    monkeypatch.setattr(P, "PIECE", 16)
    assert_same(spark, relational.QUERIES[name], relational.SQL[name], SF)


@pytest.mark.parametrize("name", ["S32_J14_F26_compressed_ply", "S33_O06_segments"])
def test_packed_vertices_are_read_in_stretches(spark, monkeypatch, name):
    monkeypatch.setattr(containers, "_MADE", {})
    monkeypatch.setattr(ply, "STRETCH", 256)
    monkeypatch.setattr(imports, "PIECE", 100)
    assert_same(spark, relational.QUERIES[name], relational.SQL[name], SF)


def test_packed_files_that_cannot_be_read_are_named(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement chunk 1\n" + b"property float c\n" * 12 + b"element vertex 3\n" + b"property uint w\n" * 4
    (tmp_path / "a.ply").write_bytes(head + b"end_header\n" + bytes(48 + 47))
    (tmp_path / "b.ply").write_bytes(b"ply\ncomment " + b"x" * 200_000 + head[3:] + b"end_header\n" + bytes(48 + 48))
    (tmp_path / "c.ply").write_bytes(b"no point cloud")
    v = ply.packed_tables(spark, str(tmp_path))[0]
    assert sorted((r["path"][-5:], r["row"], r["fault"]) for r in v.collect()) == [("a.ply", 0, "truncated"), ("b.ply", 0, None), ("b.ply", 1, None), ("b.ply", 2, None), ("c.ply", 0, "not-a-ply")]


def test_object_tables_are_joined_once():
    """Forty thousand objects in a record; appending to bytes copied all that was there for each of them."""
    entries = [(i, "label", [0.0] * 3, None, [0.5] * 64) for i in range(40_000)]
    began = time.process_time()
    assert len(object_table(entries, 64)) == 9 + 6 + 40_000 * (4 + 4 + 5 + 12 + 1 + 1 + 256) and time.process_time() - began < 5


#: Queries over descriptive records.
DESCRIBED = [
    "R11_S11_cameras",
    "J05_sensor_poses",
    "R08_legacy_audio",
    "E13_frame_named",
    "J07_S16_F25_object_poses",
]


@pytest.mark.parametrize("name", DESCRIBED)
def test_records_left_in_their_files_are_read(spark, monkeypatch, name):
    """Framing keeps no content of over a few bytes; what reads a kind of record fetches it."""
    monkeypatch.setattr(containers, "_MADE", {})
    monkeypatch.setattr(C, "KEPT", 16)
    assert_same(spark, relational.QUERIES[name], relational.SQL[name], SF)
