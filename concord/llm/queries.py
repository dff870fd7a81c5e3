"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chat, codes, exact_dedup, jaccard, langid, line_dedup, lm, mixing, packing, quality, rules, toxicity, whitening
from .oracles import SQL


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    scored = lm.score(docs, lm.train(docs.where(C.crc_mod(lm.FOLDS) != lm.HELD_OUT)))
    return scored.select("doc_id", (C.crc_mod(lm.FOLDS) == lm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(C.documents(spark, sf_dir))
    span = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
    gone = F.aggregate("__removed", F.lit(0), lambda n, s: n + s["end"] - s["start"] + 1)
    spans = F.array_join(F.transform("__removed", span), ",")
    return rows.select("doc_id", F.col("__lines").cast("bigint").alias("n_lines"), F.col("__repeated").cast("bigint").alias("n_repeated"), gone.cast("bigint").alias("n_removed"), spans.alias("removed"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decisions(C.documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine).select("doc_id", (C.crc_mod(toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.stored_ledger(C.documents(spark, sf_dir)))
    failed = F.col("bits").bitwiseAND(F.lit(rules.mask("base-1"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the stored bits of one evaluation."""
    rows = rules.stored_ledger(C.documents(spark, sf_dir))
    every = [rules.ablation(rows, p).select(F.lit(p).alias("policy"), "rule", "fails", "fails_alone", "kept_without") for p in rules.POLICIES]
    return reduce(DataFrame.unionByName, every)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = langid.train(docs.where(C.crc_mod(langid.FOLDS) != langid.HELD_OUT))
    found = langid.label(docs, model)
    return found.select("doc_id", (C.crc_mod(langid.FOLDS) == langid.HELD_OUT).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, trees)
    return scored.select("doc_id", (C.crc_mod(3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(C.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    read = chat.read_back(chat.format_chats(turns.unionByName(chat.planted(spark))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_lm_scoring, op2_line_dedup, op3_exact_dedup, op4_toxicity, op5_rule_ledger, op6_mixing, op7_language_id, op8_quality, op9_packing, op10_jaccard_join, op11_chat_format, op12_vector_codes, op13_whitening, rule_ablation]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
