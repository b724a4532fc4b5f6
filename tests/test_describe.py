import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.sample import NORMAL, PEEL, RAW, RECORDS, record
from termloom.operators.normalize import batch_normalize, bounds_long, normalized_descriptor, target_two_j
from termloom.operators.parse import Peel, raw_descriptor, unknown_blocks
from termloom.operators.vector import Describer
from termloom.plans.compare import positioned
from termloom.plans.describe import describe_frame, generate_descriptors_from_parquet
from termloom.schema import CSF_SCHEMA

ENGINES = ["arrow", "columns"]


def frame(spark, records):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(records)], CSF_SCHEMA)


def described(spark, records, peel, normalize=False, engine="arrow"):
    rows = describe_frame(frame(spark, records), peel, normalize, engine=engine).orderBy("idx").collect()
    return [list(r)[1:] for r in rows]


@pytest.mark.parametrize("engine", ENGINES)
def test_sample(spark, engine):
    raw = described(spark, RECORDS, PEEL, engine=engine)
    normal = described(spark, RECORDS, PEEL, True, engine)
    for got, want in zip(raw, RAW):
        assert got[:18] == [2, 0, 0, 4, 0, 0, 6, 0, 0, 2, 0, 0, 4, 0, 0, 2, 0, 0] and got[18:27] == want and not any(got[27:])
    for got, want in zip(normal, NORMAL):
        assert got[18:27] == pytest.approx(want, abs=1e-6)


L1 = "  5s ( 2)  4d-( 4)  4d ( 6)  5p-( 2)  5p ( 4)  6s ( 2)"
CASES = [
    (["5s", "4d-", "4d", "5p-", "5p", "6s"], (L1, "                   3/2               2        ", "                                           4-  "), [2, 0, 0, 4, 0, 0, 6, 3, 3, 2, 0, 0, 4, 4, 4, 2, 0, 8]),
    (["5s", "4d-", "4d"], ("  5s ( 0)  4d-( 4)  4d ( 6)", "                   3/2      ", "                        4-  "), [0, 0, 0, 4, 0, 0, 6, 3, 8]),
    (["5s", "4d-", "4d"], ("  5s ( 2)  4d-( 4)  4d ( 6)", "                   5/2      ", "                        4-  "), [2, 0, 0, 4, 0, 0, 6, 5, 8]),
    (["5s"], ("  5é ( 2)", "", "   4-"), [0, 0, 0]),  # not ASCII
    (["5s"], ("  5s ( 2)", "", None), [0, 0, 0]),  # null line
    (["5s"], ("  5s ( 2)", "", ""), [0, 0, 0]),  # no final J
    (["5s"], ("  5s ( 2)", "", "4"), [0, 0, 0]),  # its only character is dropped as parity
    (["5s"], ("  5s ( 2)", "", "  7/2"), [2, 0, 7]),  # without parity the denominator is lost
    (["5s"], ("  5s ( 2)", "      3/2", "   4-"), [2, 3, 8]),
    (["5s"], ("", "", "   4-"), [0, 0, 0]),  # no blocks
    (["5s", "6s"], ("  5s ( 2)  6s (", "      1/2", "             4-"), [2, 1, 1, 0, 0, 0]),  # short last block has no electrons
    (["5s"], ("  5s ( 1)  5s ( 2)", "      1/2      3/2", "                 4-"), [2, 3, 8]),  # named twice: last block
    (["5s", "5s"], ("  5s ( 2)", "      1/2", "        4-"), [0, 0, 0, 2, 1, 8]),  # listed twice: last position
    (["6s", "5s"], ("  5s ( 2)  6s ( 1)", "      1/2      3/2", "                 4-"), [1, 3, 8, 2, 1, 1]),  # other order
    (["5s", "9z"], ("  5s ( 2)  6s ( 0)", "      1/2", "                 4-"), [2, 1, 1, 0, 0, 0]),  # unknown subshell is last
    (["5s"], ("  5s (-1)", "", "        4-"), [-1, 0, 8]),
    (["5s", "6s"], ("  5s ( 2)  6s ( 1)", "      1/2      3/2", "           abc   4-"), [2, 1, 0, 1, 3, 8]),  # unreadable coupling: 0, no fallback
]


@pytest.mark.parametrize("engine", ENGINES)
def test_parser_cases(spark, engine):
    for peel, lines, want in CASES:
        assert described(spark, [lines], peel, engine=engine) == [want], lines


def test_engines_agree_on_random_lines(spark):
    rng = np.random.default_rng(1)
    alphabet = list(" 0123456789/;-+()spdf\t")
    records = []
    for _ in range(300):
        n = int(rng.integers(1, 6))
        lines = list(record([(PEEL[int(rng.integers(0, 29))], int(rng.integers(0, 5))) for _ in range(n)], {i: str(rng.integers(0, 9)) for i in range(n)}, final=f"{rng.integers(0, 9)}+"))
        for _ in range(int(rng.integers(0, 4))):
            k, p = int(rng.integers(0, 3)), int(rng.integers(0, 20))
            lines[k] = lines[k][:p] + str(rng.choice(alphabet)) + lines[k][p + int(rng.integers(0, 2)) :]
        records.append(tuple(lines))
    for normalize in (False, True):
        assert described(spark, records, PEEL, normalize) == described(spark, records, PEEL, normalize, "columns")


def test_very_long_line_and_other_columns(spark):
    lines = record([("5s", 2)] * 1 + [("9z", 1)] * 20_000, final="4-")
    df = spark.createDataFrame([(7, *lines, "x"), (8, *RECORDS[0], None)], "idx long, line1 string, line2 string, line3 string, col_0 string")
    rows = describe_frame(df.withColumnRenamed("col_0", "note"), ["5s"], keep=("idx", "note")).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(7, "x", 2, 0, 0), (8, None, 2, 0, 0)]


def test_empty_table(spark):
    for engine in ENGINES:
        out = describe_frame(spark.createDataFrame([], CSF_SCHEMA), ["5s"], True, engine=engine)
        assert out.columns == ["idx", "col_0", "col_1", "col_2"] and out.count() == 0


def test_unknown_subshells(spark):
    got = unknown_blocks(frame(spark, RECORDS), Peel([p for p in PEEL if p != "4f"])).collect()
    assert [tuple(r) for r in got] == [("4f", 4)]
    assert described(spark, RECORDS, ["xyz"], True) == [[0, 0, 0]] * 4
    with pytest.raises(ValueError):
        Peel([])


NORMALIZE = [
    (["s"], [1, 1, 1], 1, [0.5, 1, 1]),
    (["p"], [0, 0, 0], 0, [0, 0, 0]),
    (["d"], [6, 0, 0], 0, [1, 0, 0]),
    (["d"], [3, 9, 9], 9, [0.5, 1, 1]),
    (["d"], [1, 5, 5], 5, [1 / 6, 1, 1]),
    (["s", "s"], [1, 1, 1, 1, 1, 2], 2, [0.5, 1, 1, 0.5, 1, 1]),
    (["2s", "s "], [1, 1, 1, 1, 1, 2], 2, [0.5, 1, 1, 0.5, 1, 1]),
    (["f", "s"], [4, 12, 3, 1, 1, 2], 2, [0.5, 0.75, 1, 0.5, 1, 1]),
    (["p-", "d"], [1, 1, 1, 2, 6, 5], 5, [0.5, 1, 1, 1 / 3, 0.75, 1]),
    (["s"], [1, 1], 1, None),
    ([], [], 0, []),
    (["xyz"], [1, 1, 1], 1, None),
    (["s"], [3, 0, 0], 0, None),
    (["s"], [-1, 0, 0], 0, None),
    (["s"], [1, 1, 1], -1, None),
    (["s"], None, 1, None),
]


def test_normalize_cases(spark):
    for peel, raw, target, want in NORMALIZE:
        df = spark.createDataFrame([(raw,)], "descriptor array<int>")
        got = normalized_descriptor(df, peel, F.lit(target)).first().normalized
        assert got == (want if want is None else pytest.approx(want, abs=1e-6)), (peel, raw)


def test_inferred_target(spark):
    peel = "5s 4d- 4d 5p- 5p 6s 4f- 4f 5d- 5d 6p- 6p".split()
    raw = [2, 0, 0, 4, 0, 0, 6, 0, 0, 2, 0, 0, 4, 0, 0, 2, 0, 0, 3, 9, 9, 4, 16, 7, 0, 0, 0, 1, 5, 8, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(raw,), ([],)], "descriptor array<int>")
    out = normalized_descriptor(df.where(F.size("descriptor") > 0), peel).first()
    assert out.normalized[23] == pytest.approx(7 / 13)
    assert [r[0] for r in df.select(target_two_j()).collect()] == [8, 0]


def test_batch_normalize_stops_at_a_bad_row(spark):
    df = spark.createDataFrame([([1, 1, 1],), ([3, 0, 0],)], "descriptor array<int>")
    with pytest.raises(Exception, match="cannot normalize"):
        batch_normalize(df, ["s"], 1).collect()


def test_bounds(spark):
    df = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 2, 6), ("a", 2, 0, 4), ("b", 0, 3, 6)], "k string, pos int, n int, g int")
    got = {(r.k, r.pos): (r.u, r.prefix_bound, r.suffix_bound) for r in bounds_long(df, "k", "pos", "n", "g").collect()}
    assert got == {("a", 0): (1, 1, 8), ("a", 1): (8, 9, 0), ("a", 2): (0, 9, 0), ("b", 0): (9, 9, 0)}


def test_output_keeps_the_order_of_its_input(spark, tmp_path):
    """Several part files and row groups, idx in no order: rows come out as they lie, by position."""
    records = [(i, *RECORDS[i % len(RECORDS)]) for i in (7, 3, 9, 1, 0, 2, 8, 5, 4, 6, 11, 10)]
    df = spark.createDataFrame(records, "idx long, line1 string, line2 string, line3 string").coalesce(1)
    df.write.option("maxRecordsPerFile", 5).parquet(f"{tmp_path}/in")
    for workers in (None, 1, 4, 50):
        stats = generate_descriptors_from_parquet(f"{tmp_path}/in", f"file:{tmp_path}/out{workers}", PEEL, num_workers=workers, spark=spark)
        assert stats["csf_count"] == len(records)
        got = [list(r)[1:] for r in positioned(spark, f"{tmp_path}/out{workers}").orderBy("idx").select("idx", *[f"col_{k}" for k in range(3 * len(PEEL))]).collect()]
        want = {r["idx"]: list(r)[1:] for r in describe_frame(df, PEEL).collect()}
        assert got == [want[i] for i, *_ in records]


def test_unknown_names_are_reported_a_few_times(caplog):
    d = Describer(["5s"], False)
    for k in range(9):
        d.place(f"{k}x ")
    assert [r.getMessage()[:10] for r in caplog.records].count("subshell 0") == 1 and len(caplog.records) == 6
