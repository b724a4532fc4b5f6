import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.operators import reconcile as R

CELLS = ["col_0", "col_1"]
SCHEMA = "idx long, col_0 int, col_1 int"


def test_field_arithmetic():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, R.P, 2000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, 1, R.P - 1], [R.P - 1, R.P - 1, R.P - 1]
    assert R.mul(a, b).tolist() == [int(x) * int(y) % R.P for x, y in zip(a, b)]
    assert R.sub(a, b).tolist() == [(int(x) - int(y)) % R.P for x, y in zip(a, b)]
    nz = a[a != 0]
    assert set(R.mul(nz, R.inverse(nz)).tolist()) == {1}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(1, R.P - 2), max_size=20), st.sets(st.integers(1, R.P - 2), max_size=5), st.sets(st.integers(1, R.P - 2), max_size=5))
def test_rational_function_gives_the_differences(shared, left, right):
    left, right = left - shared - right, right - shared - left
    z = R.points(12 + R.CHECKS)
    value = []
    for side in (shared | left, shared | right):
        x = np.array(sorted(side), np.uint64)
        got = R.products(x, np.zeros(len(x), np.int64), z)[2]
        value.append(got[0] if len(x) else np.ones(len(z), np.uint64))
    delta = len(left) - len(right)
    bound = 12 if (12 + delta) % 2 == 0 else 11
    top, low, ok = R.rational(R.mul(value[0], R.inverse(value[1]))[None], z, delta, bound)
    assert ok[0]
    for side, polynomial in ((shared | left, top), (shared | right, low)):
        x = np.array(sorted(side), np.uint64)
        roots = {int(v) for v, zero in zip(x, R.vanishes(np.repeat(polynomial, len(x), 0), x)) if zero}
        assert roots >= (left if polynomial is top else right)


def run(spark, a, b, **kw):
    out = R.reconcile(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "idx", CELLS, **{"buckets": 3, **kw})
    return {tuple(r) for r in out.collect()}


def test_differences(spark):
    a = [(i, i % 5, i % 7) for i in range(200)] + [(7, 2, 0)] * 3 + [(300, None, 1), (301, None, None), (400, 1, 1)]
    b = [(i, i % 5, i % 7) for i in range(200) if i != 11] + [(300, 2, 1), (301, None, None), (500, 1, 1), (500, 1, 1)]
    b[20] = (b[20][0], 99, 98)
    want = {(11, "only_a"), (400, "only_a"), (500, "only_b"), (300, "col_0"), (b[20][0], "col_0"), (b[20][0], "col_1")}
    assert run(spark, a, b) == want
    assert run(spark, a, a) == set()
    assert run(spark, b, a, labels=("x", "y")) == {(i, {"only_a": "y", "only_b": "x"}.get(f, f)) for i, f in want}


def test_bound_doubles_until_all_is_found(spark):
    a = [(i, 0, 0) for i in range(60)]
    b = [(i, 1, 0) for i in range(30)] + [(i + 1000, 0, 0) for i in range(70)]
    want = {(i, "col_0") for i in range(30)} | {(i, "only_a") for i in range(30, 60)} | {(i + 1000, "only_b") for i in range(70)}
    assert run(spark, a, b, buckets=1, first_bound=4) == want


@pytest.mark.parametrize("a,b,want", [([], [], set()), ([(1, 1, 1)], [], {(1, "only_a")}), ([(None, 1, 1)], [(None, 2, 1)], {(None, "col_0")}), ([(None, None, None)], [(None, None, None)], set())])
def test_empty_and_null(spark, a, b, want):
    assert run(spark, a, b) == want


def test_other_columns_are_ignored(spark):
    a = spark.createDataFrame([(1, 1, 1, "x")], SCHEMA + ", field string")
    b = spark.createDataFrame([("y", 1, 1, 1)], "bucket string, " + SCHEMA)
    assert R.reconcile(a, b, "idx", CELLS, 1).isEmpty()
