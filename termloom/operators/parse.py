"""Fixed-width CSF records to raw descriptors, as Column expressions (no shuffle, no Python worker)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.scalars import is_ascii, rtrim_ascii, strict_int, trim_ascii, two_j
from termloom.schema import BLOCK, descriptor_columns

BLOCK_TYPE = "array<struct<name:string,n:int,q:int,j:int>>"


class Peel:
    """An ordered subshell list: the layout of a descriptor. Of equal names the last position counts."""

    def __init__(self, subshells: Sequence[str]):
        self.subshells = [s.strip() for s in subshells]
        if not self.subshells:
            raise ValueError("peel_subshells must name at least one subshell")
        self.position = {s: i for i, s in enumerate(self.subshells)}

    @property
    def orbitals(self) -> int:
        return len(self.subshells)

    @property
    def columns(self) -> list[str]:
        return descriptor_columns(self.orbitals)


def _right_trimmed(df: DataFrame) -> DataFrame:
    l3 = rtrim_ascii(F.col("line3"))
    return df.withColumns(
        {
            "_l1": rtrim_ascii(F.col("line1")),
            "_l2": rtrim_ascii(F.col("line2")),
            "_l3": l3,
            "_ascii": F.coalesce(is_ascii(F.concat("line1", "line2", "line3")), F.lit(False)),
        }
    ).withColumns(
        {
            "_core": F.when(F.length("_l3") >= BLOCK, F.expr("substring(_l3, 5, length(_l3) - 9)")).otherwise(F.col("_l3")),
            "_final": two_j(
                F.expr(
                    "substring(_l3, greatest(length(_l3) - 5, 0) + 1,"
                    " greatest(length(_l3) - 1, 0) - greatest(length(_l3) - 5, 0))"
                )
            ),
            "_nb": F.expr("cast(ceil(length(_l1) / 9) as int)"),
        }
    )


def blocks(df: DataFrame) -> DataFrame:
    """Adds ``blocks``: per 9-character block its subshell name, electrons, 2Q and coupled 2J in line order.

    Null when the record cannot be described: a null or non-ASCII line, or no readable final J.
    The temporary columns start with an underscore and are dropped by :func:`raw_descriptor`.
    """

    def block(i: Column) -> Column:
        at = i * BLOCK + 1
        b1 = F.substr(F.col("_l1"), at, F.lit(BLOCK))
        b2 = trim_ascii(F.substr(F.col("_l2"), at, F.lit(BLOCK)))
        b3 = trim_ascii(F.substr(F.col("_core"), at, F.lit(BLOCK)))
        name = F.when(F.length(b1) >= 5, trim_ascii(F.substr(b1, F.lit(1), F.lit(5)))).otherwise("")
        n = F.when(F.length(b1) >= 8, strict_int(trim_ascii(F.substr(b1, F.lit(7), F.lit(2)))))
        middle = F.coalesce(two_j(F.substr(b2, F.instr(b2, ";") + 1, F.lit(BLOCK))), F.lit(0))
        last = i == F.col("_nb") - 1
        coupled = F.when(last, F.col("_final")).when(b3 != "", F.coalesce(two_j(b3), F.lit(0))).otherwise(middle)
        n = F.coalesce(n, F.lit(0))
        return F.struct(
            name.alias("name"),
            n.alias("n"),
            F.when(n == 0, 0).otherwise(middle).alias("q"),
            F.when(n == 0, 0).otherwise(coupled).alias("j"),
        )

    some = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_nb"), F.lit(1)) - 1), block)
    none = F.array().cast(BLOCK_TYPE)
    usable = F.col("_ascii") & F.col("_final").isNotNull()
    return _right_trimmed(df).withColumn("blocks", F.when(usable, F.when(F.col("_nb") > 0, some).otherwise(none)))


def raw_descriptor(df: DataFrame, peel: Peel) -> DataFrame:
    """Adds ``descriptor``: array<int> of three values (n, 2Q, coupled 2J) per orbital of the peel list.

    ``df`` has line1, line2 and line3; its other columns pass through. Null where the record cannot be
    described. A subshell that is named twice in line1 takes its last block; names outside the list are skipped.
    """
    kept = df.columns
    at = blocks(df).withColumn("_rev", F.reverse("blocks")).withColumn("_names", F.expr("_rev.name"))
    cells = []
    for i, name in enumerate(peel.subshells):
        if peel.position[name] != i:
            cells += [F.lit(0)] * 3
            continue
        hit = F.get(F.col("_rev"), F.array_position("_names", name).cast("int") - 1)
        cells += [F.coalesce(hit[f], F.lit(0)) for f in ("n", "q", "j")]
    return at.withColumn("descriptor", F.when(F.col("blocks").isNotNull(), F.array(*cells))).select(*kept, "descriptor")


def unknown_blocks(df: DataFrame, peel: Peel) -> DataFrame:
    """Names of line1 blocks that the peel list lacks, with their count: (subshell, n_blocks)."""
    known = df.sparkSession.createDataFrame([(p,) for p in peel.position], "subshell string")
    return (
        blocks(df)
        .select(F.explode("blocks.name").alias("subshell"))
        .groupBy("subshell")
        .agg(F.count(F.lit(1)).alias("n_blocks"))
        .join(F.broadcast(known), "subshell", "left_anti")
    )


def spread(df: DataFrame, orbitals: int, array: str = "descriptor", kind: str = "int", keep: Sequence[str] = ("idx",)) -> DataFrame:
    """Array to the wide layout ``col_0 .. col_{3N-1}``; a null or short array gives zeros."""
    cells = [F.coalesce(F.get(F.col(array), F.lit(k)), F.lit(0)).cast(kind).alias(c) for k, c in enumerate(descriptor_columns(orbitals))]
    return df.select(*keep, *cells)
