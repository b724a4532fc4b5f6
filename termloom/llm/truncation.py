"""Text that lost its end: a stack automaton over its structure, and what a source's complete texts look like.

The automaton pushes opened quotes, brackets and markup and pops them when they close; what is left on the
stack, a torn escape or multibyte sequence, or an end without a terminator usual in the source says that the
text was cut. Each source's terminators are counted among its texts without open structure. Sources whose records
all add up to one total (the electrons of a file's CSFs) have that total as a further baseline: the greatest that
a share of their complete texts reach, since a cut can only lose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import written

CLOSES = {")": "(", "]": "[", "}": "{"}
TERMINATOR_SHARE = 0.5
TOTAL_SHARE = 0.01
_STRUCTURE = re.compile(r'\\.|[()\[\]{}"]|</?[A-Za-z][^<>]*>|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?\Z', re.DOTALL)
_TORN = re.compile("(?:\\\\|\\\\u[0-9A-Fa-f]{0,3}|\\\\x[0-9A-Fa-f]?|%[0-9A-Fa-f]|&#(?:[0-9]*|[xX][0-9A-Fa-f]*)|\ufffd)\\Z")
_TORN_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}\S*%\Z")
_TORN_ENTITY = re.compile(r"&[A-Za-z]{1,8}\Z")
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")


def torn(text: str) -> bool:
    """Whether an escape, entity or multibyte sequence is broken at the end. A percent sign at the end or an ampersand may
    be plain text, so they count only where the text uses such escapes or entities."""
    end = text[-12:]
    if _TORN.search(end):
        return True
    if end.endswith("%"):
        return bool(_TORN_PERCENT.search(text.rsplit(None, 1)[-1]))
    return "&" in end and bool(_TORN_ENTITY.search(end)) and bool(_ENTITY.search(text))


def left_open(text: str) -> tuple[str, ...]:
    """What the automaton has on its stack at the end, from the outside in. Closers without opener are skipped."""
    stack: list[str] = []
    for hit in _STRUCTURE.finditer(text):
        t = hit.group()
        if t[0] == "\\":
            continue
        if t == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            else:
                stack.append(t)
        elif stack and stack[-1] == '"':
            continue
        elif t in CLOSES:
            if CLOSES[t] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(CLOSES[t]) :]
        elif t[0] == "<":
            if not t.endswith(">"):
                stack.append("<")
            elif t.startswith("</"):
                name = t[2:-1].strip()
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not t.endswith("/>"):
                stack.append(re.match(r"[A-Za-z][^\s>]*", t[1:]).group())
        else:
            stack.append(t)
    return tuple(stack)


def structure(df: DataFrame, text: str) -> DataFrame:
    """Adds ``opened`` (the stack), ``torn`` (an escape, entity or multibyte sequence is broken at the end) and
    ``last`` (the final character before trailing blanks). Null texts give null, blank ones an empty ``last``."""
    schema = df.select("*", F.array(F.lit("")).alias("opened"), F.lit(True).alias("torn"), F.lit("").alias("last")).schema
    for f in schema.fields:
        f.nullable = True
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            opened, broken, last = [], [], []
            for t in b.column(at).to_pylist():
                if t is None:
                    opened.append(None), broken.append(None), last.append(None)
                    continue
                t = t.rstrip(" ")
                opened.append(left_open(t))
                broken.append(torn(t))
                last.append(t[-1:])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(opened, pa.list_(pa.string())), pa.array(broken, pa.bool_()), pa.array(last, pa.string())], names=[*b.schema.names, "opened", "torn", "last"])

    return df.mapInArrow(run, schema)


def electrons(line: str) -> Column:
    """Sum of the electrons in the complete blocks of line1."""
    counts = F.transform(F.regexp_extract_all(line, F.lit(r"\(([ 0-9]{2})\)"), F.lit(1)), lambda x: F.coalesce(F.btrim(x).try_cast("int"), F.lit(0)))
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def baselines(rows: DataFrame) -> DataFrame:
    """(src, ends, usual) of (src, closed, last, held) rows: the final characters that at least TERMINATOR_SHARE as many
    of the source's closed texts have as have the commonest one, and the greatest total that TOTAL_SHARE of the texts
    with such an end reach. Counted per task before the shuffle; a source has few rows by then."""
    n = rows.where("closed").groupBy("src", "last", "held").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("src")
    n = n.withColumn("k", F.sum("n").over(Window.partitionBy("src", "last"))).where("last <> ''")
    n = n.withColumn("most", F.max("k").over(own)).where(F.col("k") >= TERMINATOR_SHARE * F.col("most"))
    n = n.withColumns({"all": F.sum("n").over(own), "same": F.sum("n").over(Window.partitionBy("src", "held"))})
    reached = F.max(F.when(F.col("same") >= TOTAL_SHARE * F.col("all"), F.col("held")))
    return n.groupBy("src").agg(F.collect_set("last").alias("ends"), reached.alias("usual"))


def judged_lines(df: DataFrame, key: str = "idx", source: str = "file_id", line: str = "line1") -> DataFrame:
    """(key, source, damaged) of every row with a non-null line.

    Damaged: the automaton stops with something open, a sequence is torn, the end is none of the source's usual ones,
    or the line holds fewer electrons than the source's complete lines do. A null source is a source of its own; one
    without any complete line has only damaged ones.
    """
    rows = structure(df.select(key, source, line).where(F.col(line).isNotNull()), line)
    closed = (F.size("opened") == 0) & ~F.col("torn")
    rows = written(rows.select(key, F.col(source).alias("src"), closed.alias("closed"), "last", electrons(line).alias("held")), "p6-lines")
    base = baselines(rows).withColumnRenamed("src", "_s")
    out = rows.join(base, F.col("src").eqNullSafe(F.col("_s")), "left")
    whole = F.col("closed") & F.coalesce(F.array_contains("ends", F.col("last")), F.lit(False)) & (F.col("held") >= F.greatest("usual", F.lit(1)))
    return out.select(key, F.col("src").alias(source), (~whole).alias("damaged"))


def damaged_keys(df: DataFrame, key: str = "idx", source: str = "file_id", line: str = "line1") -> DataFrame:
    """Distinct keys with a line that lost its end. Null lines and repeated rows add nothing; an empty table gives none."""
    return judged_lines(df, key, source, line).where("damaged").select(key).distinct()


def source_report(df: DataFrame, stats: DataFrame, key: str = "idx", source: str = "file_id", line: str = "line1") -> DataFrame:
    """Per source: distinct records, damaged ones, their share, and what the latest conversion run noted."""
    per = judged_lines(df, key, source, line).groupBy(source, key).agg(F.max("damaged").alias("damaged"))
    per = per.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("damaged").cast("long")).alias("damaged"))
    noted = stats.groupBy(source).agg(F.max_by("truncated_count", "run_id").alias("noted_truncated"), F.max_by("max_line_len", "run_id").alias("max_line_len"))
    return per.withColumn("share", F.col("damaged") / F.col("records")).join(noted, source, "left")
