"""The shortest span around each point, against all pairs."""

import random

import pytest

from vellum.operators import spans

SPANS, POINTS = "k string, span string, first double, last double", "k string, at double"


def _all_pairs(points, rows):
    out = {}
    for k, at in points:
        inside = [(b - a, a, s) for key, s, a, b in rows if key == k and a is not None and b is not None and at is not None and a <= at <= b]
        if inside and k is not None:
            out[k, at] = min(inside)[2]
    return out


def _found(spark, points, rows, **more):
    got = spans.innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, SPANS), ["k"], "at", **more).collect()
    assert len(got) == len({(r["k"], r["at"]) for r in got})
    return {(r["k"], r["at"]): r["span"] for r in got}


@pytest.mark.parametrize(("unit", "many"), [(1.0, 0), (0.25, 0), (16.0, 0), (1.0, 1000), (1.0, 55)])
def test_innermost_is_that_of_all_pairs(spark, unit, many):
    rng = random.Random(5)
    place = lambda: rng.choice([float(rng.randint(-70, 70)), rng.uniform(-70, 70)])
    rows = [(rng.choice("aab"), f"s{i % 60}", a, a + rng.choice([0.0, 0.5, 1.0, float(rng.randint(0, 90)), rng.uniform(0, 5)])) for i in range(120) for a in [place()]]
    points = [(rng.choice("abc"), place()) for _ in range(300)]
    got = _found(spark, points, rows, unit=unit, many=many)
    assert got == _all_pairs(points, rows) and len(got) > 100


def test_odd_spans(spark):
    rows = [("a", "wide", -1e300, 1e300), ("a", "none", 5.0, 4.0), ("a", None, 1.0, 2.0), ("a", "open", None, 9.0), (None, "x", 0.0, 9.0), ("a", "dot", 7.0, 7.0), ("a", "dot", 7.0, 7.0)]
    points = [("a", 7.0), ("a", 7.0), ("a", 4.5), ("a", 1e200), ("a", None), (None, 3.0), ("b", 1.0)]
    for many in (0, 64):
        assert _found(spark, points, rows, many=many) == {("a", 7.0): "dot", ("a", 4.5): "wide", ("a", 1e200): "wide"}
        assert _found(spark, points, [], many=many) == {} == _found(spark, [], rows, many=many)


def test_one_key_with_many_spans(spark):
    """20,000 spans around 20,000 points: 400 million pairs if all were made."""
    n = 20_000
    rows = spark.range(n).selectExpr("'a' AS k", "concat('s', id) AS span", "CAST(-id AS DOUBLE) AS first", f"CAST({2 * n} + id AS DOUBLE) AS last")
    points = spark.range(n).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS at")
    got = spans.innermost(points, rows, ["k"], "at")
    assert got.filter("span = 's0'").count() == n == got.count()
