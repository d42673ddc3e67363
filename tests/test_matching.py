"""Joins that account for their losses."""

import pytest

from cohortline.operators.matching import accounted_join, match_losses

LEFT = [("US", 1, "a"), ("US", 2, "b"), ("Korea, South", 1, "c"), (None, 1, "d"), ("US", 2, "e")]
RIGHT = [("US", 1, 10), ("US", 3, 20), ("South Korea", 1, 30), (None, 1, 40), ("US", 2, 50)]


@pytest.fixture
def sides(spark):
    return (
        spark.createDataFrame(LEFT, "name string, day int, x string"),
        spark.createDataFrame(RIGHT, "name string, day int, y int"),
    )


def test_accounted_join(sides, rows):
    left, right = sides
    joined, seen = accounted_join(left, right, ["name", "day"])
    assert rows(joined) == rows(left.join(right, ["name", "day"]))
    lost = left.join(right, ["name", "day"], "left_anti").count(), right.join(left, ["name", "day"], "left_anti").count()
    assert seen.get == {"matched": 3, "only_left": lost[0], "only_right": lost[1]}


def test_losses_by_name(sides, rows):
    assert rows(match_losses(*sides, ["name", "day"], "name")) == sorted(
        [("US", 3, 0, 1), ("Korea, South", 0, 1, 0), ("South Korea", 0, 0, 1), (None, 0, 1, 1)], key=repr
    )


def test_empty_sides(sides, rows):
    left, right = sides
    joined, seen = accounted_join(left.limit(0), right, ["name", "day"])
    assert joined.count() == 0 and seen.get["only_right"] == 5
