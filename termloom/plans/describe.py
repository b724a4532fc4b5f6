"""CSF Parquet to descriptor Parquet: a narrow projection over the scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.normalize import normalized_descriptor
from termloom.operators.parse import Peel, raw_descriptor, spread
from termloom.operators.vector import Describer, described, describe_arrow
from termloom.schema import descriptor_columns
from termloom.sources import files
from termloom.sources.csf_text import filesystem
from termloom.sources.header import find_header_file, read_peel_subshells


SLICE_ROWS = 16_384
GROUP_ROWS = 131_072
ZSTD_LEVEL = 3
TASK_ROWS = 1_048_576


def read_csf_parquet(spark: SparkSession, path: str) -> DataFrame:
    """First four columns by position as idx, line1, line2, line3; an unsigned idx becomes a bigint."""
    df = spark.read.parquet(path)
    if len(df.columns) < 4:
        raise ValueError(f"{path}: expected idx and three lines, found {df.columns}")
    kinds = [df.schema[i].dataType for i in range(4)]
    if not isinstance(kinds[0], (T.LongType, T.IntegerType, T.DecimalType)) or not all(isinstance(k, T.StringType) for k in kinds[1:]):
        raise ValueError(f"{path}: expected an integer and three string columns, found {[k.simpleString() for k in kinds]}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(F.col("_0").cast("bigint").alias("idx"), *[F.col(f"_{i}").alias(f"line{i}") for i in (1, 2, 3)])


def describe_frame(df: DataFrame, peel: list[str], normalize: bool = False, keep: tuple[str, ...] = ("idx",), engine: str = "arrow") -> DataFrame:
    """Wide descriptors of a CSF frame: ``keep`` columns, then col_0 .. col_{3N-1} (int, or float if normalized).

    A record that cannot be parsed or normalized gives a row of zeros; an unknown subshell in the peel list
    makes every normalized row zeros. An empty table gives an empty table. Repeated rows are described each.
    ``engine`` is ``arrow`` (byte matrices in Python workers, much the faster) or ``columns`` (JVM expressions).
    """
    if engine == "arrow":
        return describe_arrow(df, peel, normalize, keep)
    p = Peel(peel)
    out = raw_descriptor(df, p)
    if not normalize:
        return spread(out, p.orbitals, keep=keep)
    out = normalized_descriptor(out, p.subshells)
    return spread(out, p.orbitals, "normalized", "float", keep)


def part_files(path: str) -> list[str]:
    """Parquet files of a path in order of name, as the workers' file system names them."""
    from pyarrow import fs

    system, at = filesystem(path)
    if system.get_file_info(at).is_file:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    names = [f.path for f in found if f.is_file and f.path.endswith(".parquet")]
    return sorted(n for n in names if not any(x.startswith(("_", ".")) for x in n[len(at) :].split("/")))


def _slices(spark: SparkSession, path: str, tasks: int | None) -> tuple[list[str], list[list[tuple[int, int, int, int]]]]:
    """The files and, per task, consecutive (file, row group, first row, rows): small files come together, large row
    groups are cut. The footers are read by a job; one row per row group comes to the driver."""
    names = part_files(path)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, _ = filesystem(path)
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                meta = pq.ParquetFile(system.open_input_file(names[i])).metadata
                rows += [(i, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["file", "grp", "rows"])

    if not names:
        return names, []
    groups = sorted(tuple(r) for r in spark.range(0, len(names), 1, min(len(names), 1000)).mapInArrow(footers, "file long, grp long, rows long").collect())
    every = sum(r for _, _, r in groups)
    per = -(-every // tasks) if tasks else max(SLICE_ROWS, min(TASK_ROWS, -(-every // spark.sparkContext.defaultParallelism)))
    out: list[list[tuple[int, int, int, int]]] = []
    room = 0
    for f, g, rows in groups:
        at = 0
        while at < rows:
            if room == 0:
                out.append([])
                room = per
            n = min(rows - at, room)
            out[-1].append((f, g, at, n))
            at, room = at + n, room - n
    return names, out


def describe_in_order(spark: SparkSession, path: str, target: str, peel: list[str], normalize: bool, tasks: int | None = None) -> int:
    """Writes the descriptors of a CSF Parquet output without idx, row for row in the order of its part files, and gives
    the number of rows. No shuffle: each task reads its own row groups and writes one part, column by column.

    A part is first written under a name of its own attempt; only the parts that finished tasks report are moved into
    place, so a lost executor or a second attempt leaves no part twice and no torn one.
    """
    system, root = filesystem(target)
    if not files.exists(spark, files.parent(target)):
        raise OSError(f"no such directory: {files.parent(target)}")
    names, work = _slices(spark, path, tasks)
    columns = descriptor_columns(Peel(peel).orbitals)
    cell = pa.float32() if normalize else pa.int32()
    schema = pa.schema([pa.field(c, cell) for c in columns])
    held = f"{root}/_temporary"
    files.delete(spark, target)
    system.create_dir(held, recursive=True)
    options = {"compression": "zstd", "compression_level": ZSTD_LEVEL, "use_dictionary": True}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        (here, _), (there, _) = filesystem(path), filesystem(target)
        d = Describer(peel, normalize)
        for b in batches:
            for i in b.column(0).to_pylist():
                name, n, kept_back = f"part-{i:08d}-{uuid.uuid4().hex}.zstd.parquet", 0, []
                with there.open_output_stream(f"{held}/{name}") as raw, pq.ParquetWriter(raw, schema, **options) as out:
                    for f, g, first, rows in work[i]:
                        source = pq.ParquetFile(here.open_input_file(names[f]))
                        kept = source.schema_arrow.names[1:4]
                        at = 0
                        for part in source.iter_batches(SLICE_ROWS, row_groups=[g], columns=kept):
                            lo, hi = max(first - at, 0), min(first + rows - at, len(part))
                            at += len(part)
                            if lo < hi:
                                part = part.slice(lo, hi - lo)
                                kept_back.append(pa.RecordBatch.from_arrays(described(d, [part.column(k) for k in range(3)]), schema=schema))
                                n += len(part)
                                if sum(map(len, kept_back)) >= GROUP_ROWS:
                                    out.write_table(pa.Table.from_batches(kept_back))
                                    kept_back = []
                            if at >= first + rows:
                                break
                    if kept_back:
                        out.write_table(pa.Table.from_batches(kept_back))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "rows"])

    if work:
        done = spark.range(0, len(work), 1, len(work)).mapInArrow(run, "name string, rows long").collect()
    else:
        import pyarrow.parquet as pq

        with system.open_output_stream(f"{held}/part-0.zstd.parquet") as raw, pq.ParquetWriter(raw, schema, **options):
            done = [("part-0.zstd.parquet", 0)]
    for name, _ in done:
        system.move(f"{held}/{name}", f"{root}/{name}")
    system.delete_dir(held)
    with system.open_output_stream(f"{root}/_SUCCESS"):
        pass
    return sum(n for _, n in done)


def generate_descriptors_from_parquet(
    input_parquet: str | Path,
    output_parquet: str | Path,
    peel_subshells: list[str] | None = None,
    num_workers: int | None = None,
    normalize: bool = False,
    header_path: str | Path | None = None,
    spark: SparkSession | None = None,
    keep_idx: bool = False,
    single_file: bool = False,
) -> dict:
    """Writes the descriptor table (zstd) and returns its counts; errors raise OSError or ValueError.

    The output has no idx unless ``keep_idx``; its rows are then those of the input, in the order of the part files by
    name. Neither form has a shuffle. Input and output may be on any file system Spark and pyarrow name alike.
    """
    if num_workers is not None and num_workers <= 0:
        raise ValueError("num_workers must be greater than 0")
    spark = spark or SparkSession.builder.getOrCreate()
    source, target = str(input_parquet), str(output_parquet)
    if not files.exists(spark, source):
        raise OSError(f"no such file: {source}")
    if peel_subshells is None:
        found = Path(header_path) if header_path else find_header_file(Path(source))
        if found is None:
            raise ValueError(f"no peel subshells given and no header file beside {source}")
        peel_subshells = read_peel_subshells(found)
    peel = Peel(peel_subshells)
    records = read_csf_parquet(spark, source)
    try:
        if keep_idx or single_file:
            # one file: rows in one task, in the order of the scan's idx
            records = records.repartition(num_workers) if num_workers and not single_file else records
            records = records.coalesce(1).sortWithinPartitions("idx") if single_file else records
            seen = Observation()
            out = describe_frame(records, peel_subshells, normalize).observe(seen, F.count(F.lit(1)).alias("csf_count"))
            out = out if keep_idx else out.drop("idx")
            out.write.mode("overwrite").option("compression", "zstd").parquet(target)
            n = seen.get["csf_count"]
        else:
            n = describe_in_order(spark, source, target, peel.subshells, normalize, num_workers)
    except Exception as e:
        files.delete(spark, target)
        raise OSError(f"cannot write descriptors to {target}: {e}") from e
    return {
        "success": True,
        "input_file": source,
        "output_file": target,
        "csf_count": n,
        "descriptor_count": n,
        "orbital_count": peel.orbitals,
        "descriptor_size": 3 * peel.orbitals,
        "normalized": normalize,
    }
