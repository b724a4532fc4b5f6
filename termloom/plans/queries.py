"""Queries over the test tables, one or more for each group of operators."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import angular_label, capacity, is_ascii, is_too_long, kappa_squared, occupation_fraction, truncate_line, two_j
from termloom.operators import compare
from termloom.operators.normalize import bounds_long, target_two_j
from termloom.operators.parse import Peel, raw_descriptor, unknown_blocks
from termloom.operators.profile import ValueCounts, delta, metrics, parity_fields, spoiled_columns, triplet_limits
from termloom.operators.reconcile import reconcile
from termloom.operators.rejects import load_records, reason_counts, rejected_records, valid_records
from termloom.plans.compare import positioned
from termloom.plans.convert import convert_csfs
from termloom.plans.describe import describe_frame, generate_descriptors_from_parquet
from termloom.schema import CAPACITY, capacity_of
from termloom.session import checked_rows, shared_dir
from termloom.sources.header import peel_tokens
from termloom.sources.parquet_info import get_parquet_info

PEEL = ["5s", "4d-", "4d", "5p-", "5p", "6s", "4f-"]
CAPS = [2, 4, 6, 2, 4, 2, 6]
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_orbitals(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, l_linenumber, n, q, j): one orbital per order and line number."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("l_linenumber"))
    agg = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("a"), F.sum("l_suppkey").alias("b"), F.sum("l_partkey").alias("c"))
    return agg.select(
        "l_orderkey",
        "l_linenumber",
        pick(PEEL).alias("subshell"),
        pick(CAPS).alias("g"),
        (F.col("a").cast("long") % (pick(CAPS) + 1)).cast("int").alias("n"),
        (F.col("b") % 12).cast("int").alias("q"),
        (F.col("c") % 12).cast("int").alias("j"),
    )


def j_text(twice: Column) -> Column:
    return F.when(twice % 2 == 0, (twice / 2).cast("int").cast("string")).otherwise(F.concat(twice.cast("string"), F.lit("/2")))


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders rendered as CSF records: idx is the order key; at most seven blocks an order."""
    o = order_orbitals(spark, sf)
    blank = F.lit(" " * 9)
    body = F.struct(
        "l_linenumber",
        F.concat(F.when(F.col("subshell").endswith("-"), F.lpad("subshell", 5, " ")).otherwise(F.concat(F.lpad("subshell", 4, " "), F.lit(" "))), F.lit("("), F.lpad(F.col("n").cast("string"), 2, " "), F.lit(")")).alias("b1"),
        F.when(F.col("q") == 0, blank).otherwise(F.lpad(j_text(F.col("q")), 9, " ")).alias("b2"),
        F.when(F.col("j") == 0, blank).otherwise(F.lpad(j_text(F.col("j")), 9, " ")).alias("b3"),
        j_text(F.col("j")).alias("final"),
    )
    rows = o.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(body)).alias("b"))
    inner = F.expr("array_join(transform(slice(b, 1, size(b) - 1), x -> x.b3), '')")
    return rows.select(
        F.col("l_orderkey").alias("idx"),
        F.expr("array_join(b.b1, '')").alias("line1"),
        F.expr("array_join(b.b2, '')").alias("line2"),
        F.concat(F.lit("    "), inner, F.lit("  "), F.lpad(F.element_at("b", -1)["final"], 4, " "), F.lit("-")).alias("line3"),
    )


def raw_order_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return describe_frame(order_records(spark, sf), PEEL)


def normalized_order_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return describe_frame(order_records(spark, sf), PEEL, normalize=True)


def column_engine_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return describe_frame(order_records(spark, sf), PEEL, normalize=True, engine="columns")


def target_two_j_query(spark: SparkSession, sf: str) -> DataFrame:
    return raw_descriptor(order_records(spark, sf), Peel(PEEL)).select("idx", target_two_j().alias("two_j"))


def prefix_suffix_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = bounds_long(order_orbitals(spark, sf), "l_orderkey", "l_linenumber", "n", "g")
    return b.select("l_orderkey", "l_linenumber", *[F.col(c).cast("long").alias(c) for c in ("u", "prefix_bound", "suffix_bound")])


def two_j_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(p, F.lit("/2")), F.concat(p, F.lit("-")), F.concat(p, F.lit("+")), F.concat(F.lit("x"), p), F.concat(F.lit("  "), p), F.concat(p, F.lit("-+"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", two_j(text).alias("two_j"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    names = ["5s", "4p-", "4p", "3d-", "3d", "4f-", "4f", "5g-", "5g", "6h-", "6h", "7i-", "7i", "xyz"]
    return table(spark, sf, "part").select("p_partkey", "p_size", F.element_at(F.array(*map(F.lit, names)), F.col("p_size") % 14 + 1).alias("subshell"))


def subshell_metadata(spark: SparkSession, sf: str) -> DataFrame:
    a = angular_label(F.col("subshell"))
    fraction = occupation_fraction(F.col("p_size"), a)
    return _labels(spark, sf).select("p_partkey", a.alias("angular"), capacity(a).alias("g"), kappa_squared(a).alias("kappa_squared"), fraction.alias("fraction"))


def subshell_limits_query(spark: SparkSession, sf: str) -> DataFrame:
    from termloom.schema import subshell_limits

    return subshell_limits(spark)


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, k, value): the lines of each text after its first five, k from 0."""
    parts = F.split("text", "\n", -1)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("pos", "value")).where("pos >= 5").select("doc_id", (F.col("pos") - 5).alias("k"), "value")


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as CSF files: every three lines after the header make a record; left-over lines give none.

    A row holds whole texts, so the records of a text are cut out of its own line array without a shuffle.
    """
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("v"))
    docs = docs.withColumn("n", F.expr("cast(greatest(size(v) - 5, 0) div 3 as int)")).where("n > 0")
    at = docs.select("doc_id", "v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("rec"))
    return at.select("doc_id", "rec", *[F.get("v", 5 + F.col("rec") * 3 + i).alias(f"line{i + 1}") for i in range(3)])


def line_records(spark: SparkSession, sf: str) -> DataFrame:
    return document_records(spark, sf).select("doc_id", F.col("rec").cast("long").alias("rec"), "line1", "line2", "line3")


def conversion_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    """Counts a conversion of each ASCII-only text would return."""
    lines = [F.col(f"line{i}") for i in (1, 2, 3)]
    ascii_only = table(spark, sf, "documents").where(is_ascii(F.col("text"))).select("doc_id", F.greatest(F.size(F.split("text", "\n", -1)) - 5, F.lit(0)).cast("long").alias("total_lines"))
    cut = sum((is_too_long(c, 256).cast("long") for c in lines), F.lit(0))
    per = document_records(spark, sf).where(is_ascii(F.concat(*lines))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("csf_count"), F.sum(cut).alias("truncated_count"))
    return ascii_only.join(per, "doc_id", "left").select("doc_id", "total_lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("csf_count", "truncated_count")])


def truncated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Longest kept line and number of cut lines per document at a limit of 40 characters."""
    return document_lines(spark, sf).groupBy("doc_id").agg(F.sum(is_too_long(F.col("value"), 40).cast("long")).alias("cut"), F.max(F.length(truncate_line(F.col("value"), 40))).cast("long").alias("longest"))


def ascii_guard(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).groupBy("doc_id").agg(F.sum(is_ascii(F.col("value")).cast("long")).alias("ascii_lines"), F.count(F.lit(1)).alias("n_lines"))


def peel_token_query(spark: SparkSession, sf: str) -> DataFrame:
    line = F.get(F.split("text", "\n", -1), F.lit(3))
    return table(spark, sf, "documents").where(line.isNotNull() & is_ascii(line)).select("doc_id", F.array_join(peel_tokens(line), "|").alias("tokens"))


def conversion_peel(spark: SparkSession, sf: str) -> DataFrame:
    """Peel subshells of every conversion run, from its fourth header line."""
    return table(spark, sf, "conversion_stats").select("run_id", F.array_join(peel_tokens(F.get("header_lines", F.lit(3))), "|").alias("peel"))


def array_to_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).alias(f"col_{k}") for k in range(64)])


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 63), lambda x: F.floor(x.cast("double") * 4).cast("int")).alias("descriptor"))


def last_nonzero_triplet(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).select("vec_id", target_two_j().alias("two_j"))


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    wide = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"col_{k}") for k in range(64)])
    return wide, wide.select("idx", *[F.when(F.col("idx") % 7 == k % 7, F.floor(F.col(f"col_{k}") * 8) / 8).otherwise(F.col(f"col_{k}")).alias(f"col_{k}") if k % 3 else F.col(f"col_{k}") for k in range(64)])


def descriptor_range_report(spark: SparkSession, sf: str) -> DataFrame:
    return compare.range_report(_pair(spark, sf)[0])


def descriptor_diff_columns(spark: SparkSession, sf: str) -> DataFrame:
    changed = compare.changed_columns(*_pair(spark, sf))
    peel = spark.createDataFrame([(i, f"orbital{i}") for i in range(22)], "pos int, subshell string")
    return compare.explained(changed, peel).select("column", "subshell", "field", "max_abs_diff")


def descriptor_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    return compare.changed_rows(*_pair(spark, sf))


def unknown_subshell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return unknown_blocks(order_records(spark, sf), Peel([p for p in PEEL if p not in ("5p", "4f-")])).select("subshell", F.col("n_blocks").cast("long").alias("n_blocks"))


def _orders_text(spark: SparkSession, sf: str) -> str:
    """Order records as one CSF text in the shared folder, in order of the key; the folder's path. Fixed-width text of
    one file is what the conversion takes, so one task writes it."""
    import uuid

    base = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:').rstrip('/')}/orders-{uuid.uuid4().hex}"
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["Core subshells:", " ", "Peel subshells:", "  " + "  ".join(PEEL), "CSF(s):"], -5)], "at long, value string")
    body = order_records(spark, sf).select(F.col("idx").alias("at"), F.concat_ws("\n", "line1", "line2", "line3").alias("value"))
    text = head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value")
    text.write.option("lineSep", "\n").text(f"{base}/text")
    return base


def _converted(spark: SparkSession, sf: str, **options) -> tuple[str, dict]:
    base = _orders_text(spark, sf)
    part = next(f for f in sorted(os.listdir(f"{base}/text")) if f.startswith("part-"))
    done = convert_csfs(f"{base}/text/{part}", f"{base}/orders.parquet", spark=spark, **options)
    if not done["success"]:
        raise RuntimeError(done["error"])
    return base, done


def full_pipeline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Order records written as one CSF text, converted, described and read back, with the order key put back."""
    base, _ = _converted(spark, sf)
    generate_descriptors_from_parquet(f"{base}/orders.parquet", f"{base}/described.parquet", PEEL, normalize=True, spark=spark, keep_idx=True)
    keys = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    numbered = keys.select(F.col("l_orderkey").alias("order_key"), (F.row_number().over(Window.orderBy("l_orderkey")) - 1).cast("long").alias("idx"))
    return numbered.join(spark.read.parquet(f"{base}/described.parquet"), "idx").drop("idx").withColumnRenamed("order_key", "idx")


def described_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The default output, which has no idx: rows by their position over the part files."""
    base, _ = _converted(spark, sf, chunk_size=3_000)
    generate_descriptors_from_parquet(f"{base}/orders.parquet", f"{base}/described.parquet", PEEL, normalize=True, spark=spark)
    return positioned(spark, f"{base}/described.parquet")


def converted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the conversion itself returns, with lines cut at 40 characters."""
    _, done = _converted(spark, sf, max_line_len=40)
    return spark.createDataFrame([tuple(done[c] for c in ("csf_count", "total_lines", "truncated_count"))], "csf_count long, total_lines long, truncated_count long")


def descriptor_samples(spark: SparkSession, sf: str) -> DataFrame:
    """First ten differing rows with the first eight changed columns."""
    return compare.samples(*_pair(spark, sf))


def descriptor_rows_unequal(spark: SparkSession, sf: str) -> DataFrame:
    """Exact comparison: rows of each side that the other lacks."""
    return compare.rows_unequal(*_pair(spark, sf)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def descriptor_overall_max(spark: SparkSession, sf: str) -> DataFrame:
    return compare.overall_max(*_pair(spark, sf))


def parquet_info(spark: SparkSession, sf: str) -> DataFrame:
    info = get_parquet_info(f"{sf}/lineitem.parquet")
    return spark.createDataFrame([(info["num_rows"], info["num_columns"])], "num_rows long, num_columns long")


def peel_of(spark: SparkSession, sf: str) -> list[str]:
    return [r["subshell"] for r in sorted(checked_rows(table(spark, sf, "peel"), 1000, "peel"), key=lambda r: r["pos"])]


def csf_descriptors(spark: SparkSession, sf: str, normalize: bool = False) -> DataFrame:
    return describe_frame(table(spark, sf, "csf_table").select("idx", "run_id", "line1", "line2", "line3"), peel_of(spark, sf), normalize, keep=("idx", "run_id"))


csf_descriptors_normalized = functools.partial(csf_descriptors, normalize=True)


def csf_descriptor_range(spark: SparkSession, sf: str) -> DataFrame:
    return compare.range_report(csf_descriptors_normalized(spark, sf))


def csf_records(spark: SparkSession, sf: str) -> DataFrame:
    """csf_raw loaded by the rejects operator, in the splits of its scan."""
    return load_records(table(spark, sf, "csf_raw"), peel_of(spark, sf), CAPACITY)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejected_records(csf_records(spark, sf)).select("raw_id")


def p1_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return valid_records(csf_records(spark, sf)).select("raw_id", "file_id", "received_at", "idx", "line1", "line2", "line3", "note")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reason_counts(csf_records(spark, sf), ["file_id"])


CELLS = [f"col_{k}" for k in range(87)]
ROWS_PER_BUCKET = 256


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of some 256 keys of the larger side by the row counts in the footers, so that their differences stay few
    at any size and whichever side lacks rows."""
    a, b = table(spark, sf, "descriptor_raw"), table(spark, sf, "descriptor_copy")
    buckets = max(1, max(a.count(), b.count()) // ROWS_PER_BUCKET)
    return reconcile(a, b, "idx", CELLS, buckets, labels=("only_raw", "only_copy"))


def p4_summary(spark: SparkSession, sf: str) -> DataFrame:
    return p4_found(spark, sf).groupBy("field").agg(F.count(F.lit(1)).alias("n_idx"))


def _capacities(spark: SparkSession, sf: str) -> list[int | None]:
    return [capacity_of(p) for p in peel_of(spark, sf)]


def descriptor_state(spark: SparkSession, sf: str) -> DataFrame:
    """Persistent value counts of descriptor_raw in the shared folder, one signed delta per load, with the parity
    pattern as derived fields. The table holds the loads of all time, so their deltas come in one change."""
    import uuid

    state = ValueCounts(spark, f"{shared_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex}")
    return state.apply(delta(table(spark, sf, "descriptor_raw"), CELLS, derived=parity_fields(_capacities(spark, sf))))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spoiled_columns(descriptor_state(spark, sf), _capacities(spark, sf)).select("load_id", "field")


def p5_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of every column and load: rows, nulls, distinct values, range, entropy, broken pattern, and the reasons
    that mark it as spoiled."""
    state, caps = descriptor_state(spark, sf), _capacities(spark, sf)
    m = metrics(state.where(F.col("field").startswith("col_")), triplet_limits(spark, caps))
    odd = state.where(F.col("field").startswith("parity:") & (F.col("value") == 1)).select("load_id", F.substring_index("field", ":", -1).alias("field"), F.col("n").alias("odd_parity"))
    why = spoiled_columns(state, caps).select("load_id", "field", F.array_join("reasons", ", ").alias("spoiled"))
    for extra in (odd, why):
        extra = extra.withColumnsRenamed({"load_id": "_l", "field": "_f"})
        m = m.join(extra, F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("field") == F.col("_f")), "left").drop("_l", "_f")
    kept = ["load_id", "field", "rows", "nulls", "distinct_values", "min_value", "max_value", "out_of_range"]
    return m.select(*kept, F.round("entropy", 6).alias("entropy"), F.coalesce("odd_parity", F.lit(0)).alias("odd_parity"), "spoiled")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_reasons": p1_reasons,
    "p4_found": p4_found,
    "p4_summary": p4_summary,
    "p5_found": p5_found,
    "p5_profile": p5_profile,
    "normalized_order_descriptors": normalized_order_descriptors,
    "raw_order_descriptors": raw_order_descriptors,
    "column_engine_descriptors": column_engine_descriptors,
    "target_two_j": target_two_j_query,
    "prefix_suffix_bounds": prefix_suffix_bounds,
    "two_j_parse": two_j_parse,
    "subshell_metadata": subshell_metadata,
    "subshell_limits": subshell_limits_query,
    "line_records": line_records,
    "conversion_counts": conversion_stats_query,
    "truncated_lines": truncated_lines,
    "ascii_guard": ascii_guard,
    "peel_tokens": peel_token_query,
    "conversion_peel": conversion_peel,
    "array_to_columns": array_to_columns,
    "last_nonzero_triplet": last_nonzero_triplet,
    "descriptor_range_report": descriptor_range_report,
    "descriptor_diff_columns": descriptor_diff_columns,
    "descriptor_diff_rows": descriptor_diff_rows,
    "unknown_subshell_counts": unknown_subshell_counts,
    "full_pipeline_roundtrip": full_pipeline_roundtrip,
    "described_in_order": described_in_order,
    "converted_counts": converted_counts,
    "descriptor_samples": descriptor_samples,
    "descriptor_rows_unequal": descriptor_rows_unequal,
    "descriptor_overall_max": descriptor_overall_max,
    "parquet_info": parquet_info,
    "csf_descriptors": csf_descriptors,
    "csf_descriptors_normalized": csf_descriptors_normalized,
    "csf_descriptor_range": csf_descriptor_range,
}
