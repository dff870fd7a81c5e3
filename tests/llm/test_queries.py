"""The registered queries against their SQL, their columns, and the pipeline against a plain version of its stages."""

import collections
import re
import zlib

import pytest

import corpus_pipeline
from concord.llm import queries

from ..compare import rows_of, rows_of_sql
from .test_operators import brute_components

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(SQL[name], sf_dir)


COLUMNS = {
    "op1_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}
FOLD = {"op1_lm_scoring": (5, 1), "op4_toxicity": (5, 0), "op7_language_id": (4, 2), "op8_quality": (3, 1)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_folds(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name in FOLD:
        n, k = FOLD[name]
        rows = df.collect()
        assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.stored(stage(spark, before, sf_dir), f"test-{name}")
        rows = before.collect()
        if name != "packing":
            assert after.columns == columns
        got = collections.Counter(r.doc_id for r in after.collect())
        if name == "exact_dedup":
            first = {}
            for r in rows:
                t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
                first[t] = min(first.get(t, r.doc_id), r.doc_id)
            assert got == collections.Counter(first.values())
        if name == "near_dedup":
            assert got == collections.Counter(set(brute_components([(r.doc_id, r.text) for r in rows], 5, 80)[1]))
        if name in ("quality", "mixing"):
            assert set(got) <= {r.doc_id for r in rows} and max(got.values()) <= (2 if name == "mixing" else 1)
        if name == "packing":
            assert set(got) == {r.doc_id for r in rows}
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()
