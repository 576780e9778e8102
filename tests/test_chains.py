import pytest

from driftfield.operators import chains


@pytest.mark.parametrize("n", [16, 17, 40, 129])
def test_chains_of_any_length_reach_their_keyframe(spark, n):
    rows = [(0, 0, 0, 0)] + [(i, 1, i - 1, i) for i in range(1, n)] + [(n, 1, n - 1, n + 5)]
    chunks = spark.createDataFrame(rows, "offset long, kind int, reference long, declared_depth long")
    assert [(r["rule"], int(r["item"])) for r in chains.chain_faults(chunks).collect()] == [("depth-mismatch", n)]
    assert {r["offset"]: r["depth"] for r in chains.walked(chunks).collect()} == {i: i for i in range(n + 1)}
