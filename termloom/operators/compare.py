"""Comparison of two descriptor tables that share ``idx``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import small_side

FIELDS = ("electron_count", "middle_j", "coupling_j")
# The tolerance of a difference and the bounds of a normalized cell.
TOLERANCE = 1e-6
ABOVE, BELOW = 1.000001, -0.000001


def cells_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("col_")]


def _extreme(f, cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else f(*cols)


def structural_differences(old: DataFrame, new: DataFrame) -> list[str]:
    """What makes two tables not comparable: names, types, row counts, a repeated idx or rows of one side only. Empty
    when they are comparable."""
    out = []
    if cells_of(old) != cells_of(new):
        out.append("column names differ")
    elif [old.schema[c].dataType for c in cells_of(old)] != [new.schema[c].dataType for c in cells_of(new)]:
        out.append("column types differ")
    sides = old.select("idx", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select("idx", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = sides.groupBy("idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = per.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.when((F.col("a") > 1) | (F.col("b") > 1), 1)).alias("repeated"), F.count(F.when((F.col("a") == 0) | (F.col("b") == 0), 1)).alias("single")).first()
    if n["a"] != n["b"]:
        out.append(f"row counts differ: {n['a'] or 0} and {n['b'] or 0}")
    elif n["single"]:
        out.append(f"{n['single']} idx are on one side only")
    if n["repeated"]:
        out.append(f"{n['repeated']} idx are repeated")
    return out


def range_report(df: DataFrame) -> DataFrame:
    """One row: least and greatest cell, cells above 1 and below 0 beyond the tolerance; nulls do not count."""
    df = df.select(F.array(*cells_of(df)).alias("cells"))
    count = lambda test: F.coalesce(F.sum(F.size(F.filter("cells", test))), F.lit(0))
    return df.agg(
        F.min(F.array_min("cells")).alias("min_value"),
        F.max(F.array_max("cells")).alias("max_value"),
        count(lambda c: c > ABOVE).cast("long").alias("cells_above"),
        count(lambda c: c < BELOW).cast("long").alias("cells_below"),
    )


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables side by side on idx: columns ``o_col_k`` and ``n_col_k``."""
    a = old.select("idx", *[F.col(c).alias(f"o_{c}") for c in cells_of(old)])
    return a.join(new.select("idx", *[F.col(c).alias(f"n_{c}") for c in cells_of(new)]), "idx")


def _difference(column: str) -> Column:
    """Absolute difference of a cell; null equals null and NaN equals NaN, and against a number they differ without bound."""
    o, n = F.col(f"o_{column}").cast("double"), F.col(f"n_{column}").cast("double")
    endless = F.lit(float("inf"))
    return F.when(o.eqNullSafe(n), F.lit(0.0)).otherwise(F.coalesce(F.nanvl(F.abs(o - n), endless), endless))


def _diffs(cols: list[str]) -> list[Column]:
    return [_difference(c) for c in cols]


def column_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, max_abs_diff) of every cell column, in one pass over the joined tables; no rows give no columns.

    The differences are laid out long and combined before the shuffle: one aggregate over many columns would
    leave generated code.
    """
    cols = cells_of(old)
    long = F.array(*[F.struct(F.lit(c).alias("column"), d.alias("d")) for c, d in zip(cols, _diffs(cols))])
    return paired(old, new).select(F.inline(long)).groupBy("column").agg(F.max("d").alias("max_abs_diff"))


def changed_columns(old: DataFrame, new: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return column_differences(old, new).where(F.col("max_abs_diff") > tolerance)


def overall_max(old: DataFrame, new: DataFrame) -> DataFrame:
    return column_differences(old, new).agg(F.max("max_abs_diff").alias("max_abs_diff"))


def changed_rows(old: DataFrame, new: DataFrame, tolerance: float = TOLERANCE, limit: int | None = None) -> DataFrame:
    """idx of rows with any cell beyond the tolerance; with ``limit`` the first ones in idx order."""
    hits = paired(old, new).where(_extreme(F.greatest, _diffs(cells_of(old))) > tolerance).select("idx")
    return hits if limit is None else hits.orderBy("idx").limit(limit)


def rows_unequal(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows in one table and not the other, with multiplicity; empty means exactly equal."""
    cols = ["idx", *cells_of(old)]
    a, b = old.select(cols), new.select(cols)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def explained(columns: DataFrame, peel: DataFrame, name: str = "column") -> DataFrame:
    """Adds the subshell and field that a ``col_k`` stands for; ``peel`` has (pos, subshell)."""
    k = F.regexp_extract(name, r"^col_(\d+)$", 1).try_cast("int")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), k % 3 + 1)
    return columns.withColumns({"pos": F.floor(k / 3).cast("int"), "field": field}).join(small_side(peel), "pos", "left")


def samples(old: DataFrame, new: DataFrame, tolerance: float = TOLERANCE, rows: int = 10, columns: int = 8, raw: DataFrame | None = None) -> DataFrame:
    """First differing rows by idx with old and new values of the first changed columns, and the record they describe
    where ``raw`` (idx, line1, line2, line3) is given. One row per changed column comes to the driver."""
    cols = [r["column"] for r in changed_columns(old, new, tolerance).collect()]
    return _sampled(old, new, cols, tolerance, rows, columns, raw)


def _sampled(old: DataFrame, new: DataFrame, cols: list[str], tolerance: float, rows: int, columns: int, raw: DataFrame | None) -> DataFrame:
    cols = sorted(cols, key=lambda c: int(c[4:]))
    hits = reduce(lambda a, b: a | b, [_difference(c) > tolerance for c in cols], F.lit(False))
    first = paired(old, new).where(hits).orderBy("idx").limit(rows).select("idx", *[f"{s}_{c}" for c in cols[:columns] for s in "on"])
    return first if raw is None else raw.join(F.broadcast(first), "idx", "right").select(*first.columns, *[c for c in raw.columns if c != "idx"]).orderBy("idx")


def compare_descriptors(old: DataFrame, new: DataFrame, peel: DataFrame | None = None, tolerance: float = TOLERANCE, raw: DataFrame | None = None, rows: int = 10, columns: int = 8) -> dict:
    """Whole comparison by idx. status: 0 the same, 1 different beyond the tolerance, 2 not comparable. What comes to
    the driver is one row per column and the samples."""
    if why := structural_differences(old, new):
        return {"status": 2, "problems": why}
    diffs = column_differences(old, new)
    table = explained(diffs, peel) if peel is not None else diffs
    per = [r.asDict() for r in table.collect()]
    changed = sorted((r for r in per if r["max_abs_diff"] > tolerance), key=lambda r: int(r["column"][4:]))
    names = [r["column"] for r in changed]
    return {
        "status": int(bool(changed)),
        "max_abs_diff": max([r["max_abs_diff"] for r in per], default=0.0),
        "exact_equal": rows_unequal(old, new).isEmpty(),
        "changed_columns": changed,
        "changed_rows": changed_rows(old, new, tolerance).count() if changed else 0,
        "samples": [r.asDict() for r in _sampled(old, new, names, tolerance, rows, columns, raw).collect()] if changed else [],
        "old_range": range_report(old).first().asDict(),
        "new_range": range_report(new).first().asDict(),
    }
