"""Line de-duplication by overlapping windows of three lines.

A window is three consecutive lines that have a word (white space at their ends does not count; blank lines between
them belong to it). Windows are compared by a 128-bit hash over all documents. The first occurrence, by doc_id and
position, stays; the lines of every later one are covered, and covered lines, merged, are removed. A window that
overlaps its own first occurrence (four equal lines) is a later one like any other.

Windows of the passages that most documents share are joined by broadcast, so no task gets all occurrences of one.

Null text counts as empty; texts with under three such lines have no window and stay as they are; texts of any length are
cut whole; null ids come last, rows with equal ids are ordered by their place; other columns are passed on whatever their
names, but those named __lines, __repeated or __removed are refused, as the result has such; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 3
BLANK = " \t\r\x0b\x0c"


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, __file, __row, a, b, h): first and last line of each window, and its hash."""
    rows = C.located(docs, "doc_id", lines_of().alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("l"))), lambda x: x["l"] != "")
    rows = rows.withColumn("full", full).where(F.size("full") >= width)
    at = lambda i, k: F.element_at("full", i + (k + 1))
    each = F.transform(F.sequence(F.lit(0), F.size("full") - width), lambda i: F.struct(at(i, 0)["i"].alias("a"), at(i, width - 1)["i"].alias("b"), F.unhex(F.md5(F.concat_ws("\n", *(at(i, k)["l"] for k in range(width))))).alias("h")))
    return rows.select("doc_id", "__file", "__row", F.inline(each))


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(__file, __row, n_repeated, removed): sorted numbers of the lines that go, for documents that lose any."""
    found = C.stored(windows(docs, width), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row", "a")
    first = found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1")
    later = C.skew_join(found, C.stored(first, "first-windows"), "h", "times").where((F.col("first.__file") != F.col("__file")) | (F.col("first.__row") != F.col("__row")) | (F.col("first.a") != F.col("a")))
    spans = later.groupBy("__file", "__row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # one document's own windows
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))))
    return spans.select("__file", "__row", F.size("spans").alias("n_repeated"), removed.alias("removed"))


def spans_of(removed: Column) -> Column:
    """Sorted line numbers as merged spans [(start, end)]."""
    starts = F.array_except(removed, F.transform(removed, lambda x: x + 1))
    ends = F.array_except(removed, F.transform(removed, lambda x: x - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All rows and columns of docs with the text that remains (null stays null), and __lines, __repeated, __removed (spans)."""
    C.ready(docs.sparkSession)
    C.reserved(docs, "__lines", "__repeated", "__removed")
    docs = C.plain(docs)
    rows = C.by_place(C.whole(docs), C.stored(covered(docs, width), "covered"), "left").withColumn("lines", lines_of("__all.text"))
    rows = rows.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(F.size("removed") == 0, F.col("__all.text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n"))
    own = [text.alias("text") if c == "text" else F.col("__all")[c].alias(c) for c in docs.columns]
    return rows.select(*own, F.size("lines").alias("__lines"), F.coalesce("n_repeated", F.lit(0)).alias("__repeated"), spans_of(F.col("removed")).alias("__removed"))
