import tomllib

import pytest

import termloom
from tests.sample import HEADER, NORMAL, PEEL, RECORDS, text
from termloom.sources.csf_text import read_csf_text
from termloom.sources.header import find_header_file, write_header
from termloom.streaming import describe_stream


def put(tmp_path, content, name="sample.csf"):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return p


def records_of(spark, path, **kw):
    return [tuple(r) for r in read_csf_text(spark, str(path), **kw).records.orderBy("idx").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_scan_in_any_number_of_ranges(spark, tmp_path, end, partitions):
    p = put(tmp_path, text(end=end))
    assert records_of(spark, p, partitions=partitions) == [(i, *r) for i, r in enumerate(RECORDS)]


def test_every_split_point(spark, tmp_path):
    p = put(tmp_path, "h1\nh2\nh3\nh4\nh5\na\n\nb\nc\rd\ne\nf\ng")
    for size in range(1, 30):
        assert records_of(spark, p, range_bytes=size) == [(0, "a", "", "b"), (1, "c\rd", "e", "f")], size
    assert read_csf_text(spark, str(p)).total_lines == 7


@pytest.mark.parametrize("content,total", [("", 0), ("h\n", 0), ("1\n2\n3\n4\n5\n", 0), ("1\n2\n3\n4\n5\na\nb\n", 2)])
def test_header_only_or_incomplete(spark, tmp_path, content, total):
    out = termloom.convert_csfs(put(tmp_path, content), tmp_path / "o.parquet", spark=spark)
    assert out["success"] and out["csf_count"] == 0 and out["total_lines"] == total
    header = tomllib.loads((tmp_path / "sample_header.toml").read_text())["header_info"]["header_lines"]
    assert len(header) == 5


def test_convert_then_describe(spark, tmp_path):
    out = termloom.convert_csfs(put(tmp_path, text()), tmp_path / "o.parquet", spark=spark, num_workers=3)
    assert out["success"] and (out["csf_count"], out["total_lines"], out["truncated_count"]) == (4, 12, 0)
    info = termloom.get_parquet_info(tmp_path / "o.parquet")
    assert info["num_rows"] == 4 and info["num_columns"] == 4 and "UNCOMPRESSED" in info["compression"]
    peel = termloom.read_peel_subshells(tmp_path / "sample_header.toml")
    assert peel == PEEL
    done = termloom.generate_descriptors_from_parquet(tmp_path / "o.parquet", tmp_path / "d.parquet", peel, normalize=True, spark=spark)
    assert done["csf_count"] == done["descriptor_count"] == 4 and done["descriptor_size"] == 87 and done["orbital_count"] == 29
    info = termloom.get_parquet_info(tmp_path / "d.parquet")
    assert info["num_columns"] == 87 and "ZSTD" in info["compression"]
    rows = [list(r)[18:27] for r in spark.read.parquet(str(tmp_path / "d.parquet")).collect()]
    assert sorted(rows) == [pytest.approx(x, abs=1e-6) for x in sorted(NORMAL)]


def test_truncation_counts_lines(spark, tmp_path):
    out = termloom.convert_csfs(put(tmp_path, "\n".join([*HEADER, "x" * 80, "y" * 80, "z" * 80])), tmp_path / "o.parquet", max_line_len=10, spark=spark)
    assert out["truncated_count"] == 3
    assert spark.read.parquet(str(tmp_path / "o.parquet")).first().line2 == "y" * 10


def test_bad_data_leaves_no_output(spark, tmp_path):
    for bad in ("\n".join([*HEADER, "a", "é", "b"]), b"\n".join([*(h.encode() for h in HEADER), b"a", b"\xff", b"b"])):
        out = termloom.convert_csfs(put(tmp_path, bad), tmp_path / "o.parquet", spark=spark)
        assert set(out) == {"success", "error"} and not out["success"]
        assert not (tmp_path / "o.parquet").exists()
    assert "data line 2" in termloom.convert_csfs(put(tmp_path, "\n".join([*HEADER, "a", "é", "b"])), tmp_path / "o.parquet", spark=spark)["error"]
    assert not termloom.convert_csfs(tmp_path / "none.csf", tmp_path / "o.parquet", spark=spark)["success"]
    assert not termloom.convert_csfs(put(tmp_path, text()), tmp_path / "no" / "o.parquet", spark=spark)["success"]


def test_bad_arguments(spark, tmp_path):
    p = put(tmp_path, text())
    for kw in ({"max_line_len": 0}, {"chunk_size": 0}, {"num_workers": 0}):
        with pytest.raises(ValueError):
            termloom.convert_csfs(p, tmp_path / "o.parquet", spark=spark, **kw)
    with pytest.raises(ValueError):
        termloom.generate_descriptors_from_parquet(p, tmp_path / "o", ["5s"], num_workers=0, spark=spark)
    with pytest.raises(OSError):
        termloom.generate_descriptors_from_parquet(tmp_path / "none", tmp_path / "o", ["5s"], spark=spark)
    with pytest.raises(OSError):
        termloom.get_parquet_info(tmp_path / "none")
    with pytest.raises(OSError):
        termloom.get_parquet_info(p)


def test_header_file(tmp_path):
    lines = ['a "b" \\c', "x\ty", "", "  5s  4d-\r\n 12 +- 6p_x é9 ", "CSF"]
    p = write_header(tmp_path / "f_header.toml", lines, {"csf_count": 1, "total_lines": 3, "truncated_count": 0})
    assert tomllib.loads(p.read_text())["header_info"]["header_lines"] == lines
    assert termloom.read_peel_subshells(p) == ["5s", "4d-", "6p_x", "é9"]
    assert find_header_file(tmp_path / "f.parquet") == p and find_header_file(tmp_path / "g.parquet") is None
    write_header(p, ["", "", "", "1 2 +", ""], {"csf_count": 0, "total_lines": 0, "truncated_count": 0})
    with pytest.raises(ValueError):
        termloom.read_peel_subshells(p)


def test_stream(spark, tmp_path):
    termloom.convert_csfs(put(tmp_path, text()), tmp_path / "in", spark=spark)
    q = describe_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), PEEL, str(tmp_path / "check"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
