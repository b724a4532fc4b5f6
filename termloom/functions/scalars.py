"""Column builders for the scalar rules. All run inside the JVM; a bad value gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.schema import CAPACITY, KAPPA, OVERSIZE_LINE

# White space of ASCII: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def trim_ascii(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def rtrim_ascii(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def strict_int(text: Column) -> Column:
    """Signed 32-bit decimal integer, else null. Nothing but an optional sign and digits is taken."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("int"))


def two_j(text: Column) -> Column:
    """Twice the angular momentum a J text states: ``3/2`` is 3, ``4`` and ``4-`` are 8.

    With a slash the text before it counts and the denominator is ignored. Without one, minus signs
    and then plus signs are stripped from the end and the number is doubled. Anything else, and a
    doubled value beyond 32 bits, gives null.
    """
    t = trim_ascii(text)
    whole = strict_int(F.rtrim(F.rtrim(t, F.lit("-")), F.lit("+"))).cast("long") * 2
    whole = F.when(whole.between(-(2**31), 2**31 - 1), whole).cast("int")
    return F.when(F.instr(t, "/") > 0, strict_int(F.substring_index(t, "/", 1))).otherwise(whole)


def angular_label(subshell: Column) -> Column:
    """``5s`` and ``s`` give ``"s "``, ``4d-`` gives ``"d-"``: leading non-letters go, one letter is padded."""
    t = F.regexp_replace(trim_ascii(subshell), r"^[^\p{L}]*", "")
    return F.when(F.length(t) == 1, F.concat(t, F.lit(" "))).otherwise(t)


def angular_labels(subshells: Column) -> Column:
    return F.transform(subshells, angular_label)


def _lookup(label: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), label)


def capacity(label: Column) -> Column:
    """Electron capacity of an exact two-character angular label, null when unknown."""
    return _lookup(label, CAPACITY)


def kappa_squared(label: Column) -> Column:
    return _lookup(label, {k: v * v for k, v in KAPPA.items()})


def occupation_fraction(n: Column, label: Column) -> Column:
    """n / g as float, not clamped; null for an unknown label."""
    return (n / capacity(label)).cast("float")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def is_too_long(text: Column, max_line_len: int) -> Column:
    return F.length(text) > max_line_len


def is_oversize(text: Column) -> Column:
    return F.length(text) > OVERSIZE_LINE


def truncate_line(text: Column, max_line_len: int) -> Column:
    return F.substring(text, 1, max_line_len)
