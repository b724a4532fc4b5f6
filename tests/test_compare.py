from termloom.operators import compare
from termloom.schema import peel_table


def test_compare(spark):
    schema = "idx long, col_0 double, col_1 double, col_2 double"
    old = spark.createDataFrame([(1, 0.0, 0.5, 1.0), (2, 0.25, None, 1.2), (3, 0.0, 0.0, -0.1)], schema)
    new = spark.createDataFrame([(1, 0.0, 0.5, 1.0), (2, 0.75, None, 1.2), (3, 0.0, 0.0, -0.1)], schema)
    peel = peel_table(spark, ["5s"])
    assert compare.compare_descriptors(old, old)["status"] == 0
    out = compare.compare_descriptors(old, new, peel.select("pos", "subshell"))
    assert out["status"] == 1 and out["max_abs_diff"] == 0.5
    assert [(r["column"], r["subshell"], r["field"]) for r in out["changed_columns"]] == [("col_0", "5s", "electron_count")]
    assert out["old_range"] == {"min_value": -0.1, "max_value": 1.2, "cells_above": 1, "cells_below": 1}
    assert [r.idx for r in compare.changed_rows(old, new, limit=10).collect()] == [2]
    assert compare.rows_unequal(old, new).count() == 2 and compare.rows_unequal(old, old).isEmpty()
    assert [tuple(r) for r in compare.samples(old, new).collect()] == [(2, 0.25, 0.75)]
    assert compare.overall_max(old, new).first()[0] == 0.5
    assert compare.compare_descriptors(old, new.drop("col_2"))["status"] == 2
    assert compare.compare_descriptors(old, new.limit(1))["status"] == 2
    empty = old.limit(0)
    assert compare.compare_descriptors(empty, empty)["status"] == 0 and compare.range_report(empty).first().cells_above == 0


def test_nan_null_and_repeated_rows(spark):
    schema = "idx long, col_0 double, col_1 double"
    old = spark.createDataFrame([(1, 0.0, float("nan")), (2, None, 1.0)], schema)
    assert compare.compare_descriptors(old, old)["exact_equal"]
    for row in ((1, 0.0, 0.5), (1, None, float("nan"))):
        out = compare.compare_descriptors(old, spark.createDataFrame([row, (2, None, 1.0)], schema))
        assert out["status"] == 1 and out["max_abs_diff"] == float("inf") and out["changed_rows"] == 1 and len(out["samples"]) == 1
    twice = old.unionByName(old)
    assert compare.compare_descriptors(twice, twice)["problems"] == ["2 idx are repeated"]
    moved = old.withColumn("idx", old.idx + 1)
    assert compare.compare_descriptors(old, moved)["problems"] == ["2 idx are on one side only"]


def test_outputs_without_idx(spark, tmp_path, capsys):
    from termloom.plans.compare import compare_outputs, main

    rows = [(i, i / 100, 0.5) for i in range(40)]
    raw = spark.createDataFrame([(i, f"line {i}") for i in range(40)], "idx long, line1 string").repartition(3)
    frame = lambda data: spark.createDataFrame(data, "i long, col_0 double, col_1 double").repartitionByRange(4, "i").sortWithinPartitions("i").drop("i")
    frame(rows).write.parquet(f"{tmp_path}/old")
    frame([(i, x, 0.75 if i == 17 else y) for i, x, y in rows]).write.parquet(f"file:{tmp_path}/new")
    raw.write.parquet(f"{tmp_path}/raw")
    out = compare_outputs(spark, f"{tmp_path}/old", f"file:{tmp_path}/new", raw=f"{tmp_path}/raw")
    assert out["status"] == 1 and not out["exact_equal"] and out["changed_rows"] == 1
    assert out["samples"] == [{"idx": 17, "o_col_1": 0.5, "n_col_1": 0.75, "line1": "line 17"}]
    assert main(["--old", f"{tmp_path}/old", "--new", f"{tmp_path}/old"]) == 0 and "exact_equal: True" in capsys.readouterr().out
