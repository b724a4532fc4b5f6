"""Schemas, physical constants and defaults shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_MAX_LINE_LEN = 256
DEFAULT_CHUNK_SIZE = 3_000_000
HEADER_LINES = 5
OVERSIZE_LINE = 1024 * 1024
BLOCK = 9

CSF_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("line1", T.StringType()),
        T.StructField("line2", T.StringType()),
        T.StructField("line3", T.StringType()),
    ]
)

# Angular label (two characters), electron capacity g, relativistic kappa.
SUBSHELLS: list[tuple[str, int, int]] = [
    ("s ", 2, -1),
    ("p-", 2, 1),
    ("p ", 4, -2),
    ("d-", 4, 2),
    ("d ", 6, -3),
    ("f-", 6, 3),
    ("f ", 8, -4),
    ("g-", 8, 4),
    ("g ", 10, -5),
    ("h-", 10, 5),
    ("h ", 12, -6),
    ("i-", 12, 6),
    ("i ", 14, -7),
]
CAPACITY = {label: g for label, g, _ in SUBSHELLS}
KAPPA = {label: kappa for label, _, kappa in SUBSHELLS}

SUBSHELL_SCHEMA = "angular string, g int, kappa int"


def angular_label_of(subshell: str) -> str:
    """Driver-side twin of :func:`termloom.functions.scalars.angular_label`."""
    text = subshell.strip()
    while text and not text[0].isalpha():
        text = text[1:]
    return text + " " if len(text) == 1 else text


def capacity_of(subshell: str) -> int | None:
    """Electron capacity of a full or angular label, None when unknown."""
    return CAPACITY.get(angular_label_of(subshell))


def subshell_limits(spark: SparkSession) -> DataFrame:
    """The 13-row table of angular label, capacity and kappa."""
    return spark.createDataFrame(SUBSHELLS, SUBSHELL_SCHEMA)


def peel_table(spark: SparkSession, peel: list[str]) -> DataFrame:
    """(pos, subshell, angular, g); g is null for an unknown subshell."""
    rows = [(i, p.strip(), angular_label_of(p), capacity_of(p)) for i, p in enumerate(peel)]
    return spark.createDataFrame(rows, "pos int, subshell string, angular string, g int")


def descriptor_columns(orbitals: int) -> list[str]:
    return [f"col_{k}" for k in range(3 * orbitals)]
