import pytest
from pyspark.sql import functions as F

from termloom import functions as f
from termloom.operators.vector import two_j_of
from termloom.schema import SUBSHELLS, angular_label_of

J = {"3/2": 3, "5/2": 5, "1/2": 1, "2": 4, "3": 6, "4": 8, "4-": 8, "3+": 6, "7/": 7, "7/3": 7, "+4": 8, "-3": -6, "4+-": 8, " 4\t": 8, "invalid": None, "abc/def": None, "4-+": None, "": None, "-": None, "4.0": None, "4\x1f": None, "7\r": 14, "99999999999": None, "1073741824": None}


def test_two_j(spark):
    df = spark.createDataFrame(list(J.items()), "t string, want int").select("t", "want", f.two_j(F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == r.want == two_j_of(r.t), r


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(f.two_j(F.col("t")), f.angular_label(F.col("t")), f.is_ascii(F.col("t")), f.truncate_line(F.col("t"), 3), f.capacity(F.col("t"))).first()
    assert all(x is None for x in row)


@pytest.mark.parametrize("name,label", [("5s", "s "), ("s", "s "), ("s ", "s "), ("4d-", "d-"), (" 12i ", "i "), ("xyz", "xyz"), ("7", "")])
def test_angular_label(spark, name, label):
    assert spark.range(1).select(f.angular_label(F.lit(name))).first()[0] == label == angular_label_of(name)


def test_label_list_and_tables(spark):
    row = spark.range(1).select(f.angular_labels(F.array(F.lit("5s"), F.lit("4d-"))), f.capacity(F.lit("d-")), f.kappa_squared(F.lit("d ")), f.capacity(F.lit("s")), f.occupation_fraction(F.lit(7), F.lit("d "))).first()
    assert row[0] == ["s ", "d-"] and row[1] == 4 and row[2] == 9 and row[3] is None and row[4] == pytest.approx(7 / 6)
    assert all(g == 2 * abs(k) for _, g, k in SUBSHELLS)


def test_lines(spark):
    row = spark.range(1).select(f.is_ascii(F.lit("aé")), f.is_ascii(F.lit("ab")), f.truncate_line(F.lit("abcdef"), 4), f.is_too_long(F.lit("abcd"), 4), f.is_oversize(F.lit("a"))).first()
    assert tuple(row) == (False, True, "abcd", False, False)
