"""Reused state, rows without ids, models that are too large, and columns with the names of working columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import exact_dedup, langid, mixing, quality

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def look(df, **how):
    return sorted(map(tuple, exact_dedup.decisions(df, **how).select(COLUMNS).collect()), key=str)


def test_a_state_goes_on_with_new_rows(spark, tmp_path):
    rows = [(i + 5, f"text {i % 4}") for i in range(12)]
    more = [(i, f"text {i % 6}") for i in range(5)] + [(None, "text 9"), (40, "text 9")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    home = str(tmp_path / "state")
    assert look(docs, state=home) == look(docs)
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    grown = spark.read.parquet(path)
    assert look(grown, state=home) == look(grown)  # smaller ids and new texts take effect
    assert look(grown, state=home) == look(grown)


def test_a_state_of_other_rows_is_refused(spark, tmp_path):
    for name, start in (("a", 0), ("b", 100)):
        spark.range(start, start + 10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(str(tmp_path / name))
    home = str(tmp_path / "state")
    assert len(look(spark.read.parquet(str(tmp_path / "a")), state=home)) == 10
    with pytest.raises(ValueError, match="another table"):
        exact_dedup.decisions(spark.read.parquet(str(tmp_path / "b")), state=home)


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows = mixing.sample(docs, share=0.5).collect()
    taken = sum(r["taken"] for r in rows)
    assert abs(taken - 0.5 * 80_000) <= 4
    assert sorted({r["copies"] for r in rows}) == [0, 1]
    first = [r["copies"] for r in sorted(rows, key=lambda r: (r["__file"], r["__row"]))]
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) > 5_000  # neighbours are drawn independently


def test_too_many_languages_are_refused(spark):
    docs = spark.range(langid.MOST_LANGUAGES + 1).select(F.lit("word").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.col("id").alias("doc_id"))
    with pytest.raises(Exception, match="too many for one model"):
        langid.train(docs.coalesce(1))
    with pytest.raises(Exception, match="too many for one model"):
        langid.train(docs.repartition(4))
    assert len(langid.train(docs.limit(langid.MOST_LANGUAGES)).langs) == langid.MOST_LANGUAGES


def test_pipeline_with_odd_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "web", 0), (-1, "", "en", "web", 0), (-2, "one two three " * 30_000, "en", None, 1)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"__score": F.lit(1), "__SCORE_": F.lit(2), "__file": F.lit(3), "copies": F.lit(4)})
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert quality.accepted(docs, trees).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns
        assert docs.count() <= 2 * before or name == "packing"
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []
