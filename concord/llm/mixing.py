"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame and SQL functions only).

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, ...; they share 150 % of all words; a target stops
at twice its source's size and what is over is shared among the others by weight until none is above.

Each source first takes as many complete epochs as fit. The rest is drawn without replacement: a document's key is
-ln(u) / weight with u from a hash of its id and weight from its quality; documents are sorted by key and taken
while their running size stays within the rest; then the one unused document whose size comes nearest to the gap
is taken if that brings the source nearer. The sort within a source is cut into buckets of the key's range, so no
task sorts a whole source: bucket totals are summed first, in runs of SPAN buckets and then within the run that the budget
ends in, and only the bucket that it ends in is ranked.

Null text has size 0; a text of any length is one draw of its size; a null source is a source of its own; equal rows are told
apart by their place; a row without an id is drawn by its place, so that any number of them spread over the buckets; rows with one id share its draw; other columns are passed on whatever their names; empty tables and
sources without words take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Documents to a bucket of a source's keys, about.
BUCKET_ROWS = 128
#: Buckets whose totals are added up first.
SPAN = 1024
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("bigint")


def quality(text: str = "text") -> Column:
    """1 for prose, down to 0.05 as symbols, digits and exclamation marks gain ground."""
    noise = F.length(text) - F.length(F.translate(text, "#*$%&|<>!0123456789", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - 4.0 * F.coalesce(noise / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """sizes: (source, source_size, ...), one row per source. Adds weight and target: caps in closed form.

    In the order of cap over weight, the first sources are those at their caps; the level of the others follows
    from running sums, so one sort of the sources replaces repeated resharing."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("budget", F.lit(share) * F.sum("source_size").over(every)).withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
    w = w.withColumn("level", -F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("down")))).over(every)["down"])  # the first source below its cap sets the level
    return w.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("capped", "left", "level", "budget", "ratio", "cap")


def _with(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with what is known of their source, null being a source too; plan is broadcast if it is small."""
    return rows.join(C.small(plan.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def sample(docs: DataFrame, weight: Column | None = None, share: float = SHARE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: __file, __row, doc_id, source, size, source_size, target, copies, taken."""
    spark = C.ready(docs.sparkSession)
    docs = C.plain(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", F.lit(""), "__file", "__row"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}|"), name), 256), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + 1).cast("double") / float(2**52 + 2)
    rows = C.located(docs, "doc_id", "source", size_of().alias("size"), (weight if weight is not None else quality()).alias("weight"))
    rows = C.stored(rows.withColumn("key", -F.log(u) / F.col("weight")).drop("weight"), "mix-rows")

    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("key").alias("scale")), share)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = C.stored(plan.withColumn("buckets", F.ceil(F.col("n") / bucket_rows)), "mix-plan", few=True)
    # 1 - exp(-key / mean) rises with the key and spreads keys over the buckets
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / F.col("scale"))) * F.col("buckets")), F.col("buckets") - 1)
    dealt = _with(rows, plan.select("source", "scale", "buckets"), "left").withColumn("bucket", bucket)

    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = C.stored(totals.withColumn("span", F.floor(F.col("bucket") / SPAN)), "mix-totals", few=True)

    def crossing(parts: DataFrame, budget: DataFrame, at: str) -> DataFrame:
        """(source, at, room): the first part with which the running size exceeds `rest`, and what of rest is left before it."""
        run = parts.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(at)))
        over = _with(run, budget.select("source", "rest")).where("upto > rest")
        return over.groupBy("source").agg(F.min(F.struct(at, (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))).alias("end")).select("source", f"end.{at}", "end.room")

    spans = C.stored(crossing(totals.groupBy("source", "span").agg(F.sum("words").alias("words")), plan, "span"), "mix-spans", few=True)
    inner = _with(totals, spans.select("source", F.col("span").alias("in_span"))).where("span = in_span").select("source", "bucket", "words")
    ends = crossing(inner, spans.select("source", F.col("room").alias("rest")), "bucket")
    ends = C.stored(ends.select("source", F.col("bucket").alias("last"), "room"), "mix-ends", few=True)
    near = _with(dealt, ends, "left").select("__file", "__row", "doc_id", "source", "size", "key", "bucket", "last", "room")
    rank = Window.partitionBy("source").orderBy("key", "doc_id", "__file", "__row").rowsBetween(Window.unboundedPreceding, 0)
    edge = near.where("bucket = last").withColumn("run", F.sum("size").over(rank))  # one bucket of each source
    edge = C.stored(edge.where("run <= room"), "mix-edge", few=True)  # the rest of the draw within the last bucket
    gaps = _with(ends, edge.groupBy("source").agg(F.max("run").alias("run")), "left").select("source", (F.col("room") - F.coalesce("run", F.lit(0))).alias("gap"))
    gaps = C.stored(gaps, "mix-gaps", few=True)
    inside = C.small(edge.select("__file", "__row"))
    unused = near.where("bucket >= last").join(inside, ["__file", "__row"], "left_anti")
    closing = _with(unused, gaps).where("size < 2 * gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "doc_id", "__file", "__row")).alias("c"))
    extra = C.stored(edge.select("__file", "__row").unionByName(closing.select("c.__file", "c.__row")).withColumn("picked", F.lit(True)), "mix-picked", few=True)

    final = _with(plan, ends, "left").select("source", "source_size", "target", "epochs", "rest", "last")
    out = _with(dealt, C.stored(final, "mix-final", few=True), "left").join(C.small(extra), ["__file", "__row"], "left")
    drawn = F.when(F.col("rest") <= 0, 0).when(F.col("last").isNull(), 1).when((F.col("bucket") < F.col("last")) | F.coalesce("picked", F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("epochs") + drawn).cast("bigint"))
    return out.select("__file", "__row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The mixture itself: rows of docs, each as often as it is taken. Texts without words are taken with their source's epochs."""
    docs = C.plain(docs)
    copies = C.stored(sample(docs, share=share).where("copies > 0").select("__file", "__row", "copies"), "mix-copies")
    rows = C.by_place(C.whole(docs), copies)
    return rows.select("__all", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__all.*")
