import struct

import numpy as np
import pytest

from driftfield.operators.asof import pose_at
from driftfield.sources import container as C
from driftfield.sources import scene_records as R

SAMPLE = {"B": 1, "H": 2, "I": 3, "Q": 4, "f": 0.5, "d": 1.25, "s": "é name", "b": b"\x00data", "m": {"k": "v", "l": ""}}


@pytest.mark.parametrize("kind", sorted(R.LAYOUTS))
def test_records_round_trip(kind):
    own, group = R.grammar(kind)
    values = [SAMPLE[f] for n, f in own if n is not None]
    rows = [[SAMPLE[f] for _, f in group]] * 3 if group else []
    record = R.encoded(kind, values, rows)
    got, back = R.decoded(kind, record[9:] + b"appended by a later writer")
    assert got == [list(v.items()) if isinstance(v, dict) else v for v in values] and back == rows
    with pytest.raises(C.Fault):
        R.decoded(kind, record[9:-1])


@pytest.fixture(scope="module")
def recs(spark, tmp_path_factory):
    half = 0.5**0.5
    table = struct.pack("<IH", 2, 2) + struct.pack("<I", 1) + R._put("s", "car") + struct.pack("<3fB9fB2f", 1, 2, 3, 1, *range(9), 1, 0.5, 0.25) + struct.pack("<I", 2) + R._put("s", "cat") + struct.pack("<3fBB", 0, 0, 0, 0, 0)
    bands = np.arange(18).reshape(2, 9)
    parts = [
        C.put_record("Chunk", b"first"), C.put_record("ShBandStream", b"\x01" + C.coded(7, bands)), C.put_record("ShBandStream", b"\x02" + C.coded(7, np.zeros((2, 15), dtype=int))), C.put_record("Chunk", b"second"), C.put_record("ShBandStream", b"\x01" + C.coded(7, bands + 1)),
        R.encoded("Metadata", ["m", {"a": "b"}]), R.encoded("ObjectTrack", [7, 0], [[0.0, 0, 0, 0, 1, 0, 0, 0], [10.0, 0, 0, half, half, 2, 0, 0]]), R.encoded("ObjectTrack", [8, 1], [[0.0, 0, 0, 0, 1, 5, 0, 0]]),
        R.encoded("SensorCalibration", ["cam", "camera", 0, 640, 480, 1.0, 1.0, 0.5, 0.5, 0, 0, 0, 1, 0, 0, 0, 1, "rig"], [[0.1], [0.2]]), C.put_record("ObjectTable", table),
    ]
    path = tmp_path_factory.mktemp("records") / "scene.bin"
    path.write_bytes(C.MAGIC + b"".join(parts))
    return C.records(spark, str(path)).cache()


def test_tables(recs):
    assert R.table(recs, "Metadata").first()["entries"] == {"a": "b"}
    assert R.table(recs, "SensorCalibration").first()["rig_name"] == "rig"
    assert [r["distortion"] for r in R.samples(recs, "SensorCalibration").orderBy("i").collect()] == [0.1, 0.2]
    o = {r["object_id"]: r for r in R.objects(recs).collect()}
    assert o[1]["embedding"] == [0.5, 0.25] and o[1]["dynamics"] == [float(i) for i in range(9)] and o[2]["embedding"] is None
    assert R.table(recs, "Camera").count() == 0


def test_tracks_feed_the_as_of_operator(recs):
    p = {r["object_id"]: r for r in pose_at(R.tracks(recs).drop("path"), "object_id", 5.0).collect()}
    assert p[7]["tx"] == 1.0 and p[7]["qz"] == pytest.approx(np.sin(np.pi / 8)) and p[8]["tx"] == 5.0


def test_bands_belong_to_the_chunk_before_and_can_be_capped(recs):
    got = sorted((r["chunk"], r["band"], r["row"], r["codes"][0]) for r in R.harmonics(recs).collect())
    assert got == [(0, 1, 0, 0), (0, 1, 1, 9), (0, 2, 0, 0), (0, 2, 1, 0), (3, 1, 0, 1), (3, 1, 1, 10)]
    assert R.harmonics(recs, 1).where("band > 1").count() == 0
