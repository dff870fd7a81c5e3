"""Exact de-duplication as a stateful stream (DataFrame and SQL functions only).

1. Each row becomes a narrow record: digest of the normalised text, doc_id, and a content locator (file and row).
2. The records are a Structured Streaming source. Its state, kept in RocksDB on the executors' disks and
   checkpointed to the shared folder, holds for each digest the count, the smallest doc_id and that row's locator.
   There is no watermark: keys never expire, so a later batch meets everything that came before.
3. Rows whose digest is in use by others are hits; the full bytes of each are compared with those of the row that
   stays. Texts that share a digest but differ are then grouped by their bytes.

Texts move only for hits. A hot text is salted in that comparison, and keys with most rows are joined by broadcast. With a
`state` path, a call that was cut off is taken up again where its stream stopped, and a call with a table that has grown by files adds
only the records of the new rows, which the stream then meets with all that its state holds. A state of other rows is refused.

Null text counts as empty; null ids come after all others, ids of any ordered type are allowed; of rows with equal ids the
first by locator stays; texts of any length are compared whole; columns but doc_id and text are not looked at, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # or each partition's store claims disk ahead of need
}
#: Rows of one text that meet in a task when bytes are compared.
SALT_ROWS = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), C.SPACE + "+", " ")


def records(docs: DataFrame, key_bytes: int = 32) -> DataFrame:
    """(key, sha, doc_id, __file, __row) of each row."""
    sha = F.unhex(F.sha2(normalised(), 256))
    return C.located(docs, "doc_id", sha.alias("sha")).select(F.substring("sha", 1, key_bytes).alias("key"), "sha", "doc_id", "__file", "__row")


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__file").alias("file"), F.col("__row").alias("row"))


def keyed_state(rows: DataFrame, path: str, bytes_per_trigger: int = 256 << 20, files_per_trigger: int | None = None, home: str | None = None) -> DataFrame:
    """(key, group_size, keeper) from the streaming aggregation over the stored rows; home has its log and its updates."""
    spark = rows.sparkSession
    home = home or C.scratch(spark, "dedup-state")
    limit = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {"maxBytesPerTrigger": bytes_per_trigger}
    stream = spark.readStream.schema(rows.schema).options(**limit).parquet(path)
    state = stream.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("keeper"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/updates/batch={number}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    schema = T.StructType([*state.schema.fields])
    if not C.exists(spark, f"{home}/updates"):  # no files: nothing was ever written
        return spark.createDataFrame([], schema)
    done = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{home}/updates")
    return done.groupBy("key").agg(F.max_by(F.struct("group_size", "keeper"), "batch").alias("s")).select("key", "s.*")


def _unrecorded(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """The places of rows that a state's records lack, or None; neither texts nor digests are read. Records that docs lack are an error."""
    place = ["__file", "__row"]
    rows = C.located(docs, "doc_id")
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*place, "doc_id").cast("decimal(38,0)")).alias("s")).first()
    if total(rows) == total(known):
        return None
    if not known.select(*place, F.struct("doc_id").alias("id")).join(rows.select(*place, F.struct("doc_id").alias("id")), [*place, "id"], "left_anti").isEmpty():  # a struct is never null
        raise ValueError("the state holds records of rows that the documents lack: it belongs to another table")
    return C.stored(rows.join(known.select(place), place, "left_anti").select(place), "dedup-new")


def decisions(docs: DataFrame, key_bytes: int = 32, files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the locator (__file, __row).

    state: a path of this job in the shared folder. A call that finds records or a stream's log there goes on with them: docs may have more rows than
    they (in new files), but must have theirs, at the same places and with the same ids; else it raises ValueError."""
    spark = C.ready(docs.sparkSession)
    docs = C.plain(docs)
    state = state or C.scratch(spark, "dedup")
    path = f"{state}/records"
    if not C.exists(spark, f"{path}/_SUCCESS"):
        records(docs, key_bytes).write.mode("overwrite").parquet(path)
    elif new := _unrecorded(docs, spark.read.parquet(path)):
        C.by_place(records(docs, key_bytes), new).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    groups = C.stored(keyed_state(rows, path, files_per_trigger=files_per_trigger, home=state), "dedup-groups")

    # full bytes of the hits, against those of the row that stays; rows are found by narrow keys before any text moves
    places = C.skew_join(rows.select("key", "__file", "__row"), groups.where("group_size > 1"), "key", "group_size")
    mine = (F.col("__row") == F.col("keeper.row")) & (F.col("__file") == F.col("keeper.file"))
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("bigint")
    places = C.stored(places.select("key", "__file", "__row", mine.alias("mine"), salts.alias("salts"), F.pmod(F.xxhash64("__file", "__row"), salts).alias("salt")), "dedup-places")
    texts = C.stored(C.by_place(C.located(docs, "doc_id", normalised().alias("bytes")), places), "dedup-hits")
    keepers = texts.where("mine").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("bytes").alias("first"))
    differ = C.stored(texts.where("not mine").join(keepers, ["key", "salt"]).where("bytes != first").select("key").distinct(), "dedup-differ")
    whole = C.skew_join(rows, groups, "key", "group_size")
    if differ.isEmpty():
        return _labelled(whole)
    clash = texts.join(C.small(differ), "key", "left_semi")
    apart = clash.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.min(_first()).alias("keeper"))
    apart = clash.select("key", "bytes", "doc_id", "__file", "__row").join(apart, ["key", "bytes"]).select("key", F.unhex(F.sha2("bytes", 256)).alias("sha"), "doc_id", "__file", "__row", "group_size", "keeper")
    return _labelled(whole.join(C.small(differ), "key", "left_anti").select(apart.columns).unionByName(apart))


def _labelled(rows: DataFrame) -> DataFrame:
    kept = (F.col("__row") == F.col("keeper.row")) & (F.col("__file") == F.col("keeper.file"))
    return rows.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "__file", "__row")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = C.plain(docs)
    gone = C.stored(decisions(docs).where("not kept").select("__file", "__row"), "dedup-gone")
    return C.by_place(C.whole(docs), gone, "left_anti").select("__all.*")
