"""Column profiles kept as value-count tables that signed deltas of loads keep up to date.

A state row says how often a value of a field occurs in a load. A new load adds its counts, a withdrawn one
subtracts them; every metric (nulls, distinct values, ranges, entropy, pattern violations, shifts between
loads) comes exactly from the state, without reading the loads again. The state is a folder of deltas, each with
one part per load: a change costs what it changes, and what has gathered is merged now and then.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "load_id int, field string, value long, n long"
ODD = "parity"
COUNTED_ROWS = 131_072
MOST_DELTAS = 16


def _counts(t: pa.Table, fields: Sequence[str], sign: int) -> pa.RecordBatch:
    """Value counts of each field and load; the first column is the load."""
    loads, names = pd.factorize(t.column(0).to_pandas(), use_na_sentinel=False)
    parts: list[tuple[np.ndarray, ...]] = []
    for f in range(len(fields)):
        c = t.column(f + 1)
        there = c.is_valid().to_numpy()
        v = c.fill_null(0).to_numpy()
        low = int(v.min(initial=0))
        width = int(v.max(initial=0)) - low + 2  # place 0 of each load is for nulls
        if len(names) * width <= 8 * max(len(v), 1024):
            n = np.bincount(loads * width + np.where(there, v - low + 1, 0), minlength=len(names) * width)
            at = np.flatnonzero(n)
            load, value, n = at // width, at % width, n[at]
            null, value = value == 0, value + low - 1
        else:
            rows = pd.DataFrame({"l": loads, "t": there, "v": np.where(there, v, 0)}).value_counts(sort=False)
            load, null, value = (rows.index.get_level_values(k).to_numpy() for k in ("l", "t", "v"))
            null, n = ~null, rows.to_numpy()
        parts.append((load, np.full(len(load), f), value, null, n))
    load, field, value, null, n = (np.concatenate(x) for x in zip(*parts))
    known = pa.array(names, pa.int32(), from_pandas=True)
    return pa.RecordBatch.from_arrays(
        [known.take(pa.array(load)), pa.array(list(fields), pa.string()).take(pa.array(field)), pa.array(value.astype(np.int64), mask=null), pa.array(n.astype(np.int64) * sign)], names=["load_id", "field", "value", "n"]
    )


def delta(df: DataFrame, fields: Sequence[str], load: str = "load_id", derived: dict[str, Column] | None = None, sign: int = 1) -> DataFrame:
    """Signed value counts of the loads in ``df``: (load_id, field, value, n). ``derived`` adds checked patterns as fields.

    Fields must be integers. A null value is counted as a null; a null load is a load of its own. Repeated rows
    count as they are. Cells are counted within each task, so the shuffle follows the distinct values, not the cells.
    """
    derived = derived or {}
    names = [*fields, *derived]
    cells = [F.col(f).cast("long").alias(f"c{i}") for i, f in enumerate(fields)] + [c.cast("long").alias(f"d{i}") for i, c in enumerate(derived.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= COUNTED_ROWS:
                yield _counts(pa.Table.from_batches(held), names, sign)
                held = []
        if sum(map(len, held)):
            yield _counts(pa.Table.from_batches(held), names, sign)

    rows = df.select(F.col(load).cast("int").alias("load_id"), *cells).mapInArrow(run, STATE)
    return rows.groupBy("load_id", "field", "value").agg(F.sum("n").alias("n"))


def merged(*changes: DataFrame) -> DataFrame:
    """State after deltas; values whose count falls to 0 leave it. A count below 0 means a wrong delta and raises."""
    both = changes[0]
    for c in changes[1:]:
        both = both.unionByName(c)
    out = both.groupBy("load_id", "field", "value").agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("a delta withdraws values that were never added")).cast("long")).otherwise(F.col("n"))
    return out.where("n <> 0").withColumn("n", checked)


class ValueCounts:
    """The persistent state in a folder of any file system that Spark writes to.

    Each change is a numbered folder, complete when it holds Spark's ``_SUCCESS``. A writer first claims the next
    number by creating a file that must not exist, so of two at once one fails instead of being lost. A claim whose
    writer died stops further changes until ``release`` drops it. When more than ``most`` changes have gathered they
    are merged into one, which then stands for all before it.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MOST_DELTAS):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self, kind: str) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(x.split("-")[1]) for x in names if x.startswith(f"{kind}-"))

    def _done(self, kind: str) -> list[int]:
        return [n for n in self._numbers(kind) if self._fs.exists(self._at(f"{kind}-{n}/_SUCCESS"))]

    def _parts(self) -> list[str]:
        """Folders that together are the state: the last merged one and the changes after it."""
        whole = self._done("merged")
        first = whole[-1] if whole else -1
        return [f"{self.path}/merged-{first}"] * bool(whole) + [f"{self.path}/delta-{n}" for n in self._done("delta") if n > first]

    def read(self) -> DataFrame | None:
        parts = self._parts()
        return merged(*[self.spark.read.schema(STATE).parquet(p) for p in parts]) if parts else None

    def _claim(self) -> int:
        open_claims = [n for n in self._numbers("claim") if n not in self._done("delta")]
        if open_claims:
            raise RuntimeError(f"another change of {self.path} is not finished: claim-{open_claims[0]}")
        n = max(self._numbers("claim"), default=-1) + 1
        if not self._fs.createNewFile(self._at(f"claim-{n}")):
            raise RuntimeError(f"another change of {self.path} came first: claim-{n}")
        return n

    def release(self) -> None:
        """Drops claims of writers that died, and what they left."""
        for n in self._numbers("claim"):
            if n not in self._done("delta"):
                self._fs.delete(self._at(f"pending-{n}"), True)
                self._fs.delete(self._at(f"claim-{n}"), False)

    def apply(self, change: DataFrame) -> DataFrame:
        """Adds a delta (one part per load) and gives the state. A delta that withdraws what was never added raises and
        leaves the state as it was."""
        n, state = self._claim(), self.read()
        held = f"{self.path}/pending-{n}"
        try:
            rows = change.select("load_id", "field", "value", "n").repartition("load_id")
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("load_id").parquet(held)
            new = self.spark.read.schema(STATE).parquet(held)
            taken = new.where("n < 0")
            if not taken.isEmpty():
                keys = taken.select("load_id", "field").distinct().withColumnsRenamed({"load_id": "_l", "field": "_f"})
                both = new if state is None else state.unionByName(new)
                merged(both.join(keys, F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("field") == F.col("_f")), "left_semi")).write.format("noop").mode("overwrite").save()
            if not self._fs.rename(self._at(f"pending-{n}"), self._at(f"delta-{n}")):
                raise OSError(f"cannot move {held}")
        except Exception:
            self.release()
            raise
        if len(self._parts()) > self.most:
            self.read().repartition("load_id").write.mode("overwrite").option("compression", "zstd").partitionBy("load_id").parquet(f"{self.path}/merged-{n}")
        return self.read()


def metrics(state: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """One row per load and field: rows, nulls, distinct, min, max, mean, entropy (bits); with ``limits``
    (field, low, high) also the cells out of range, and the mean over cells in range (``mean_in_range``)."""
    inside = F.lit(True)
    if limits is not None:
        state = state.join(F.broadcast(limits), "field", "left")
        inside = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True))
    there = F.col("value").isNotNull()
    ok = there & inside
    n, v = F.col("n"), F.col("value")
    agg = [
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~there, n)), F.lit(0)).alias("nulls"),
        F.count(F.when(there, 1)).alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.coalesce(F.sum(F.when(there & ~inside, n)), F.lit(0)).alias("out_of_range"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("n_in"),
        F.sum(F.when(ok, n * v)).alias("sum_in"),
        F.sum(F.when(ok, n * v * v)).alias("sum2_in"),
        F.sum(F.when(there, n)).alias("n_there"),
        F.sum(F.when(there, n * F.log2(n))).alias("n_log_n"),
    ]
    m = state.groupBy("load_id", "field").agg(*agg)
    return m.withColumns(
        {
            "null_rate": F.col("nulls") / F.col("rows"),
            "mean_in_range": F.when(F.col("n_in") > 0, F.col("sum_in") / F.col("n_in")),
            "entropy": F.when(F.col("n_there") > 0, F.greatest(F.log2("n_there") - F.col("n_log_n") / F.col("n_there"), F.lit(0.0))),
        }
    ).drop("n_there", "n_log_n")


def shifts(m: DataFrame, share: float = 0.5) -> DataFrame:
    """Adds ``typical`` (median of the loads' means), ``spread`` (population deviation over all loads) and
    ``shifted``: the load's mean lies further from typical than ``share`` of the spread. One row per load and
    field goes in, so the groups are as small as the number of loads."""
    total = m.groupBy("field").agg(
        F.median("mean_in_range").alias("typical"),
        (F.sum("sum2_in") / F.sum("n_in")).alias("_m2"),
        (F.sum("sum_in") / F.sum("n_in")).alias("_m1"),
        F.sum("n_in").alias("_n"),
    )
    total = total.select("field", "typical", F.when(F.col("_n") > 0, F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))).alias("spread"))
    out = m.join(F.broadcast(total), "field")
    return out.withColumn("shifted", F.coalesce(F.abs(F.col("mean_in_range") - F.col("typical")) > F.lit(share) * F.col("spread"), F.lit(False)))


def triplet_limits(spark: SparkSession, capacities: Sequence[int | None], two_j_max: int = 80) -> DataFrame:
    """(field, low, high) of the three fields of each orbital: n in 0..g, 2Q and 2J in 0..80."""
    rows = []
    for i, g in enumerate(capacities):
        rows += [(f"col_{3 * i}", 0, g if g is not None else 0), (f"col_{3 * i + 1}", 0, two_j_max), (f"col_{3 * i + 2}", 0, two_j_max)]
    return spark.createDataFrame(rows, "field string, low long, high long")


def parity_fields(capacities: Sequence[int | None], two_j_max: int = 80) -> dict[str, Column]:
    """Per 2Q column a derived field: 1 where n and 2Q, both in range, are of unlike parity, else 0, null if not."""
    out = {}
    for i, g in enumerate(capacities):
        n, q = F.col(f"col_{3 * i}"), F.col(f"col_{3 * i + 1}")
        both = n.between(0, g if g is not None else 0) & q.between(0, two_j_max)
        out[f"{ODD}:col_{3 * i + 1}"] = F.when(both, ((n % 2) != (q % 2)).cast("int"))
    return out


def spoiled_columns(state: DataFrame, capacities: Sequence[int | None], null_share: float = 0.05, shift_fields: int = 30) -> DataFrame:
    """(load_id, field, reasons): columns of a load that break a rule: too many nulls, a cell out of range, unlike
    parity of n and 2Q, or (for the first ``shift_fields`` columns) a shifted mean."""
    spark = state.sparkSession
    odd = state.where(F.col("field").startswith(f"{ODD}:") & (F.col("value") == 1)).select("load_id", F.substring_index("field", ":", -1).alias("field"), F.lit(True).alias("odd"))
    m = shifts(metrics(state.where(~F.col("field").startswith(f"{ODD}:")), triplet_limits(spark, capacities)))
    k = F.regexp_extract("field", r"^col_(\d+)$", 1).try_cast("int")
    odd = odd.withColumnsRenamed({"load_id": "_l", "field": "_f"})
    m = m.join(F.broadcast(odd), F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("field") == F.col("_f")), "left")
    rules = [
        (F.col("null_rate") > null_share, "nulls"),
        (F.col("out_of_range") > 0, "out of range"),
        (F.coalesce(F.col("odd"), F.lit(False)), "parity of n and 2Q differs"),
        (F.col("shifted") & (k < shift_fields), "shifted mean"),
    ]
    reasons = F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in rules]), lambda x: x.isNotNull())
    return m.select("load_id", "field", reasons.alias("reasons")).where(F.size("reasons") > 0)
