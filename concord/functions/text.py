"""Text normalisers, token counts and buckets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Author names that stand for nobody, in lower case. Fixed values.
PLACEHOLDER_AUTHORS = ("[deleted]", "[removed]", "", "none", "nan", "automoderator")
#: Thread ids that stand for none. Fixed values.
PLACEHOLDER_THREADS = ("", "nan", "None", "<NA>")
#: Upper edges of the activity buckets and their labels. Fixed values.
ACTIVITY_EDGES = ((1, "1"), (2, "2"), (4, "3-4"), (9, "5-9"), (None, "10+"))


def normalise(text: Column) -> Column:
    """Lower case; name and religion masks, links and marks become spaces; single spaces."""
    x = F.lower(text)
    x = F.regexp_replace(x, r"\[(name|religion)\]", " ")
    x = F.regexp_replace(x, r"http\S+", " ")
    x = F.regexp_replace(x, r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


@F.pandas_udf(T.StringType())
def normalise_nfkc(text: pd.Series) -> pd.Series:
    """NFKC, lower case, single spaces. Spark has no Unicode normaliser, so this is an Arrow batch function."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def clean_authors(df: DataFrame, author: str = "author") -> DataFrame:
    """Trim author names and drop placeholder ones (null too)."""
    return df.withColumn(author, F.trim(author)).where(F.col(author).isNotNull() & ~F.lower(author).isin(*PLACEHOLDER_AUTHORS))


def thread_valid(thread: Column) -> Column:
    return F.coalesce(thread.isNotNull() & ~F.trim(thread).isin(*PLACEHOLDER_THREADS), F.lit(False))


def epoch_seconds(value: Column) -> Column:
    """Whole seconds; -1 where the value is no number."""
    return F.coalesce(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"), F.lit(-1.0)).cast("bigint")


def activity_bucket(n: Column) -> Column:
    out = None
    for edge, label in ACTIVITY_EDGES[:-1]:
        out = F.when(n <= edge, label) if out is None else out.when(n <= edge, label)
    return out.otherwise(ACTIVITY_EDGES[-1][1])


def quartile_bucket(df: DataFrame, value: str, out: str = "len_bucket") -> DataFrame:
    """Codes 0.. by linear quartiles, right-closed with the lowest value included; equal edges collapse."""
    edges = df.agg(F.percentile(F.col(value), F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("__q"))
    edges = edges.select(F.array_distinct("__q").alias("__e"))
    x = F.col(value).cast("double")
    code = F.greatest(F.size(F.filter("__e", lambda e: e < x)) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, code).drop("__e")  # one row of edges
