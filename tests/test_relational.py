import pytest

from driftfield.plans import containers, imports, integrity, relational, scenes  # noqa: F401  (the others register their queries with relational)
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_matches_sql(spark, name):
    assert_same(spark, relational.QUERIES[name], relational.SQL[name], "/root/testdata/sf0.001")


def test_all_have_sql():
    assert set(relational.QUERIES) == set(relational.SQL)


def test_tracks_of_objects_with_several_are_not_lost(spark):
    """Only larger tables have objects with several tracks in a file."""
    assert_same(spark, relational.QUERIES["R21_object_tracks"], relational.SQL["R21_object_tracks"], "/root/testdata/sf0.01")


def test_an_element_decoded_beyond_its_given_support_is_seen(spark):
    """Only larger tables have one whose support ends just before the time."""
    assert_same(spark, relational.QUERIES["S28_state_from_index"], relational.SQL["S28_state_from_index"], "/root/testdata/sf0.01")
