"""Normalization of raw descriptors by occupation-dependent bounds, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.schema import capacity_of


def target_two_j(array: str | Column = "descriptor") -> Column:
    """Coupled 2J of the last orbital that holds electrons (n > 0), in peel order; 0 without one."""
    a = F.col(array) if isinstance(array, str) else array
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) / 3, F.lit(1)).cast("int") - 1), lambda i: F.when(F.get(a, i * 3) > 0, F.get(a, i * 3 + 2)))
    return F.coalesce(F.try_element_at(F.filter(at, lambda x: x.isNotNull()), F.lit(-1)), F.lit(0))


def normalized_descriptor(df: DataFrame, peel: Sequence[str], target: Column | None = None, array: str = "descriptor", into: str = "normalized") -> DataFrame:
    """Adds ``normalized``: array<float> of n/g, 2Q/(n(g-n)) and 2J/min(prefix, target+suffix).

    prefix and suffix are running sums of n(g-n) up to and after the orbital; a zero bound gives 0.
    Null (an invalid row) when the array is null or of another length than 3N, the target is negative,
    any subshell is unknown, or any n lies outside 0..g. An empty peel list gives an empty array.
    """
    caps = [capacity_of(p) for p in peel]
    if any(g is None for g in caps):
        return df.withColumn(into, F.lit(None).cast("array<float>"))
    if not caps:
        return df.withColumn(into, F.when(F.size(array) == 0, F.array().cast("array<float>")))
    kept = df.columns
    n = [F.get(F.col(array), F.lit(3 * i)) for i in range(len(caps))]
    valid = F.col(array).isNotNull() & (F.size(array) == 3 * len(caps))
    for x, g in zip(n, caps):
        valid &= x.between(0, g)
    reach = F.array(*[x * (F.lit(g) - x) for x, g in zip(n, caps)])
    step = df.withColumns({"_ok": F.coalesce(valid, F.lit(False)), "_u": reach, "_t": target if target is not None else target_two_j(array)})
    step = step.withColumn("_total", F.aggregate("_u", F.lit(0), lambda a, x: a + x))
    cells = []
    for i, g in enumerate(caps):
        u = F.get(F.col("_u"), F.lit(i))
        prefix = F.get(F.col("_p"), F.lit(i))
        bound = F.least(prefix, F.col("_t") + F.col("_total") - prefix)
        cells += [
            n[i] / F.lit(g),
            F.when(u == 0, 0.0).otherwise(F.get(F.col(array), F.lit(3 * i + 1)) / u),
            F.when(bound == 0, 0.0).otherwise(F.get(F.col(array), F.lit(3 * i + 2)) / bound),
        ]
    running = F.transform(F.sequence(F.lit(1), F.lit(len(caps))), lambda k: F.aggregate(F.slice("_u", F.lit(1), k), F.lit(0), lambda a, x: a + x))
    step = step.withColumn("_p", running)
    out = F.when(F.col("_ok") & (F.col("_t") >= 0), F.array(*[c.cast("float") for c in cells]))
    return step.withColumn(into, out).select(*kept, into)


def batch_normalize(df: DataFrame, peel: Sequence[str], target: int, array: str = "descriptor") -> DataFrame:
    """One target for every row; the first invalid row ends the job with its array in the message."""
    out = normalized_descriptor(df, peel, F.lit(target), array)
    bad = F.raise_error(F.concat(F.lit("cannot normalize descriptor "), F.coalesce(F.col(array).cast("string"), F.lit("null"))))
    return out.withColumn("normalized", F.when(F.col("normalized").isNull(), bad.cast("array<float>")).otherwise(F.col("normalized")))


def bounds_long(df: DataFrame, key: str, pos: str, n: str, g: str) -> DataFrame:
    """Relational form of the bounds over (key, pos, n, g) rows: adds u, prefix_bound and suffix_bound."""
    w = Window.partitionBy(key).orderBy(pos)
    u = F.col(n) * (F.col(g) - F.col(n))
    return df.withColumn("u", u).withColumns(
        {
            "prefix_bound": F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "suffix_bound": F.coalesce(F.sum("u").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
        }
    )
