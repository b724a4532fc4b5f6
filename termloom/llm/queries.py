"""Queries of the training-data operators and the SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import clusters, leakage, mojibake, neighbors, tokens, truncation, varied


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and characters of each source."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    sizes = tokens.token_ids(table(spark, sf, "documents")).select("doc_id", F.size("ids").alias("tokens"))
    return docs.join(sizes, "doc_id").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items with a passage alike in at least 0.8 of its words."""
    return leakage.overlaps(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


CELLS = [f"col_{k}" for k in range(87)]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.groups_at(table(spark, sf, "descriptor_norm"), "idx", CELLS, 0.1)


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Stable clusters with size, stability and most typical idx values."""
    return clusters.clusters(table(spark, sf, "descriptor_norm"), "idx", CELLS, 0.1)


def p3_subsets(spark: SparkSession, sf: str) -> DataFrame:
    return varied.varied_subsets(table(spark, sf, "descriptor_norm"), "idx", CELLS, (20, 200, 2000), table(spark, sf, "csf_table").select("idx"))


def p3_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the subsets: rows and distinct idx of each size, and idx that are no described record of csf_table."""
    good = neighbors.packed(table(spark, sf, "descriptor_norm"), "idx", CELLS).join(table(spark, sf, "csf_table").select("idx"), "idx", "left_semi")
    chosen = p3_subsets(spark, sf).join(good.select("idx", F.lit(True).alias("good")), "idx", "left")
    return chosen.groupBy("size").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("idx").alias("n_idx"), F.count(F.when(F.col("good").isNull(), 1)).alias("n_other"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.damaged_keys(table(spark, sf, "csf_table"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.source_report(table(spark, sf, "csf_table"), table(spark, sf, "conversion_stats"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.neighbour_pairs(table(spark, sf, "descriptor_norm"), "idx", CELLS, 3, 0.1)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mojibake.garbled(docs, mojibake.learn(docs)[0]).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mojibake.restored(docs, mojibake.learn(docs)[0])


def p10_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Which swaps each source shows, and how often."""
    return mojibake.swaps_of(mojibake.learn(table(spark, sf, "documents"))[0])


def p10_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The substitution table of each source and swap: what each shown character stands for."""
    return mojibake.learn(table(spark, sf, "documents"))[1].select("source", "swap", "shown", "stands_for")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_subsets": p3_subsets,
    "p3_checked": p3_checked,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_found": p9_found,
    "p9_overlaps": p9_overlaps,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
    "p10_swaps": p10_swaps,
    "p10_tables": p10_tables,
}

_WINDOWS = (
    "SELECT {k}, win FROM (SELECT {k}, concat_ws(' ', x, " + ", ".join(f"lead(x, {n}) OVER w" for n in range(1, 13)) + ") AS win, lead(x, 12) OVER w AS last FROM "
    "(SELECT {k}, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM (SELECT {k}, regexp_extract_all(lower({t}), '[a-z0-9]+') AS words FROM {f})) "
    "WINDOW w AS (PARTITION BY {k} ORDER BY i)) WHERE last IS NOT NULL"
)

_V = "v AS (SELECT DISTINCT idx, [" + ", ".join(f"col_{k}::DOUBLE" for k in range(87)) + "] AS x FROM descriptor_norm WHERE greatest(" + ", ".join(f"col_{k}" for k in range(87)) + ") > 0)"

_LINES = """t AS (SELECT idx, file_id, rtrim(line1, ' ') AS a FROM csf_table WHERE line1 IS NOT NULL),
b AS (SELECT *, regexp_full_match(a, '(?:[ 0-9]{2}[0-9][a-z][- ]\\([ 0-9][0-9]\\))+') AS whole,
 coalesce(list_sum(list_transform(regexp_extract_all(a, '\\(([ 0-9][0-9])\\)', 1), lambda x: trim(x)::INT)), 0) AS held FROM t),
u AS (SELECT file_id, max(held) AS usual FROM b WHERE whole GROUP BY 1),
j AS (SELECT b.*, NOT whole OR held < usual AS damaged FROM b JOIN u ON b.file_id = u.file_id)"""

LLM_ORACLES: dict[str, str] = {
    "p3_checked": f"""WITH {_V}, n AS (SELECT count(DISTINCT v.idx) AS n FROM v JOIN csf_table USING (idx))
SELECT size::INT AS size, least(size, n)::BIGINT AS n_rows, least(size, n)::BIGINT AS n_idx, 0::BIGINT AS n_other FROM n, (VALUES (20), (200), (2000)) s(size)""",
    "p6_found": f"WITH {_LINES} SELECT DISTINCT idx FROM j WHERE damaged",
    "p6_report": f"""WITH {_LINES}, k AS (SELECT file_id, idx, max(damaged::INT) AS d FROM j GROUP BY 1, 2),
n AS (SELECT file_id, arg_max_null(truncated_count, run_id) AS noted_truncated, arg_max_null(max_line_len, run_id) AS max_line_len FROM conversion_stats GROUP BY 1)
SELECT k.file_id, count(*)::BIGINT AS records, sum(d)::BIGINT AS damaged, sum(d) / count(*) AS share, any_value(noted_truncated) AS noted_truncated, any_value(max_line_len) AS max_line_len
FROM k LEFT JOIN n ON k.file_id = n.file_id GROUP BY 1""",
    "p2_found": f"""WITH {_V}, g AS (SELECT a.idx AS idx_b, min(b.idx) AS idx_a FROM v a, v b WHERE list_distance(a.x, b.x) <= 0.1 GROUP BY 1)
SELECT idx_a, idx_b FROM g WHERE idx_a < idx_b""",
    "p7_found": f"""WITH {_V}, p AS (SELECT a.idx AS i, b.idx AS j, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.idx <> b.idx),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM p WHERE d <= 0.1)
SELECT DISTINCT least(i, j) AS idx_a, greatest(i, j) AS idx_b FROM r WHERE k <= 3""",
    "p9_found": f"""WITH d AS ({_WINDOWS.format(k="doc_id", t="text", f="documents")}), e AS ({_WINDOWS.format(k="item_id", t="question", f="eval_items")})
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (win)""",
}
