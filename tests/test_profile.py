import math

import pytest
from pyspark.sql import functions as F

from termloom.operators import profile as P

SCHEMA = "load_id int, col_0 int, col_1 int, col_2 int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state_of(spark, rows, caps=(4,)):
    return P.merged(P.delta(table(spark, rows), ["col_0", "col_1", "col_2"], derived=P.parity_fields(caps)))


def test_metrics(spark):
    rows = [(1, 1, 1, 5), (1, 1, 3, None), (1, 2, 0, 81), (1, None, 2, -1)]
    m = {r.field: r for r in P.metrics(state_of(spark, rows).where(F.col("field").startswith("col")), P.triplet_limits(spark, [4])).collect()}
    assert (m["col_0"].rows, m["col_0"].nulls, m["col_0"].distinct_values, m["col_0"].min_value, m["col_0"].max_value) == (4, 1, 2, 1, 2)
    assert m["col_0"].entropy == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert m["col_2"].out_of_range == 2 and m["col_2"].mean_in_range == 5 and m["col_1"].mean_in_range == 1.5


FIELDS = ["col_0", "col_1", "col_2"]


def test_deltas_add_and_withdraw(spark, tmp_path):
    one, two = [(1, 1, 1, 1)] * 3, [(2, 2, 2, 2), (None, None, 2, 2)]
    store = P.ValueCounts(spark, f"file:{tmp_path}/counts", most=2)
    assert store.read() is None
    store.apply(P.delta(table(spark, one), FIELDS))
    store.apply(P.delta(table(spark, two), FIELDS))
    want = {tuple(r) for r in P.merged(P.delta(table(spark, two), FIELDS)).collect()}
    both = {tuple(r) for r in store.read().collect()}
    assert both == {tuple(r) for r in P.merged(P.delta(table(spark, one + two), FIELDS)).collect()}
    store.apply(P.delta(table(spark, one), FIELDS, sign=-1))
    assert {tuple(r) for r in store.read().collect()} == want
    assert any(p.name.startswith("merged-") for p in (tmp_path / "counts").iterdir())
    with pytest.raises(Exception, match="never added"):
        store.apply(P.delta(table(spark, one), FIELDS, sign=-1))
    assert {tuple(r) for r in P.ValueCounts(spark, f"{tmp_path}/counts").read().collect()} == want


def test_two_writers(spark, tmp_path):
    store = P.ValueCounts(spark, str(tmp_path))
    store._claim()
    with pytest.raises(RuntimeError, match="not finished"):
        P.ValueCounts(spark, str(tmp_path)).apply(P.delta(table(spark, [(1, 1, 1, 1)]), FIELDS))
    store.release()
    assert store.apply(P.delta(table(spark, [(1, 1, 1, 1)]), FIELDS)).count() == 3


def test_wide_ranges(spark):
    rows = [(1, -(2**31), 0, 0), (1, 2**31 - 1, 0, None), (None, 2**31 - 1, 0, 7), (1, 2**31 - 1, 0, None)]
    got = {(r.load_id, r.field, r.value): r.n for r in P.delta(table(spark, rows), FIELDS).collect()}
    assert got[1, "col_0", 2**31 - 1] == 2 and got[1, "col_0", -(2**31)] == 1 and got[None, "col_0", 2**31 - 1] == 1 and got[1, "col_2", None] == 2


def spoiled(spark, rows, **kw):
    return {(r.load_id, r.field): r.reasons for r in P.spoiled_columns(state_of(spark, rows), [4], **kw).collect()}


def test_each_rule(spark):
    clean = [(i, n, n, n) for i in (1, 2, 3, None) for n in (0, 1, 2, 3) for _ in range(10)]
    assert spoiled(spark, clean) == {}
    nulls = clean + [(4, None if k < 3 else k % 4, k % 4, k % 4) for k in range(40)]
    assert spoiled(spark, nulls) == {(4, "col_0"): ["nulls"]}
    assert spoiled(spark, clean + [(1, 5, 1, 0)]) == {(1, "col_0"): ["out of range"]}
    assert spoiled(spark, clean + [(None, 2, 1, 81)]) == {(None, "col_1"): ["parity of n and 2Q differs"], (None, "col_2"): ["out of range"]}
    moved = clean + [(5, 3, 3, 3)] * 40
    assert spoiled(spark, moved) == {(5, c): ["shifted mean"] for c in ("col_0", "col_1", "col_2")}
    assert spoiled(spark, moved, shift_fields=1) == {(5, "col_0"): ["shifted mean"]}


def test_empty_and_all_null(spark):
    assert spoiled(spark, []) == {}
    assert spoiled(spark, [(1, None, None, None)] * 3) == {(1, c): ["nulls"] for c in ("col_0", "col_1", "col_2")}
