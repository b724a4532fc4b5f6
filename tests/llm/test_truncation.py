import pytest

from termloom.llm import truncation as T


@pytest.mark.parametrize("text,opened", [("", ()), ("f(a[1])", ()), ("f(a[1]", ("(",)), ('say "hi', ('"',)), ('"(" ok', ()), ("<b>x</b>", ()), ("<b>x", ("b",)), ("<b>x <im", ("b", "<")), ("<br/>", ()), ("a)b(", ("(",)), ('\\"', ()), ("([{", ("(", "[", "{"))])
def test_automaton(text, opened):
    assert T.left_open(text) == opened


def test_structure(spark):
    df = spark.createDataFrame([(1, "a\\u12"), (2, "50%4"), (3, None), (4, "  "), (5, "done."), (6, "x�"), (7, "a" * 1_000_000 + "(")], "i int, t string")
    got = {r.i: (r.opened, r.torn, r.last) for r in T.structure(df, "t").collect()}
    assert got[1][1] and got[2][1] and got[6][1] and not got[5][1]
    assert got[3] == (None, None, None) and got[4] == ([], False, "") and got[5] == ([], False, ".") and got[7][0] == ["("]


SCHEMA = "idx long, file_id string, line1 string, held string, damaged string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


DATA = [
    (1, "a", "  5s ( 2)  4d ( 4)"),
    (2, "a", "  5s ( 2)  4d ( 4)   "),
    (3, "a", "  5s ( 2)"),  # a whole block is gone
    (4, "a", "  5s ( 2)  4d ("),
    (5, "a", "  5s ( 2)  4"),
    (6, "a", None),
    (7, "b", "  5s ( 2)"),
    (7, "b", "  5s ( 2)"),
    (8, None, "  5s ( 2)"),
    (9, None, "  5s ( 1)"),
    (4, "a", "  5s ( 2)  4d ("),
    (10, "b", ""),
]


def test_damaged(spark):
    assert sorted(r.idx for r in T.damaged_keys(rows(spark, DATA)).collect()) == [3, 4, 5, 9, 10]
    assert T.damaged_keys(rows(spark, [])).isEmpty()


def test_report(spark):
    stats = spark.createDataFrame([(1, "a", 9, 256), (2, "a", None, 88), (3, "c", 0, 256)], "run_id long, file_id string, truncated_count long, max_line_len int")
    got = {r.file_id: (r.records, r.damaged, r.noted_truncated, r.max_line_len) for r in T.source_report(rows(spark, DATA), stats).collect()}
    assert got["a"][:2] == (5, 3) and got["a"][3] in (88, 256) and got["b"][:2] == (2, 1) and got[None][:2] == (2, 1)


@pytest.mark.parametrize("text,torn", [("profit rose 50%", False), ("AT&T", False), ("Research by R&D", False), ("a&lt;b&g", True), ("x%20y%", True), ("see &#12", True), ("fish & chips", False)])
def test_torn(text, torn):
    assert T.torn(text) == torn


def test_long_markup_stays_open():
    assert T.left_open('<a href="' + "x" * 300 + '">link') == ("a",) and T.left_open("<p>" * 3 + "<a " + "y" * 500) == ("p", "p", "p", "<")


def test_terminators_are_learned_per_source(spark):
    line = "  5s ( 2)"
    odd = [(100 + i, "s", line + ";") for i in range(20)] + [(200, "s", line), (201, "s", line + ",")]
    one_long = [(300 + i, "t", line) for i in range(200)] + [(999, "t", line * 2)]
    got = sorted(r.idx for r in T.damaged_keys(rows(spark, odd + one_long)).collect())
    assert got == [200, 201]
