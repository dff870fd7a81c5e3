"""Rule bitmask ledger: every rule is evaluated once per document, policies are applied to the stored bits.

`ledger` measures each whole text once and stores one bit per failed rule together with the measurements. A policy
is a named, versioned mask: a document is kept if none of the policy's bits is set. `ablation` counts, from the
bits alone, what each rule removes on its own and what would come back without it.

Null and empty texts have no words and fail `few_words`; texts of any length are measured whole, in slices of several texts; shares on a rule's threshold do not fail it;
rows repeat as they come; columns but doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats as S


@dataclass(frozen=True)
class Rule:
    name: str
    fails: object  # measurements -> boolean array


def _share(m: dict, part: str, whole: str) -> np.ndarray:
    return m[part] / np.maximum(m[whole], 1)


#: The order of the rules is the order of their bits; append only.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: _share(m, "n_symbols", "n_words") > 0.25),
    Rule("duplicate_lines", lambda m: (m["n_dup_lines"] >= 2) & (_share(m, "n_dup_lines", "n_lines") > 0.3)),
    Rule("long_words", lambda m: _share(m, "word_chars", "n_words") > 14),
    Rule("short_words", lambda m: (_share(m, "word_chars", "n_words") < 2.2) & (m["n_words"] > 0)),
    Rule("upper_case", lambda m: _share(m, "n_upper", "n_letters") > 0.4),
    Rule("exclamations", lambda m: _share(m, "n_bangs", "n_words") > 0.5),
    Rule("few_letters", lambda m: _share(m, "n_letters", "word_chars") < 0.5),
    Rule("echoed_words", lambda m: _share(m, "n_echoes", "n_words") > 0.3),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Versioned policies: rule names whose failure removes a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words", "upper_case", "exclamations", "few_letters", "echoed_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_bangs", "n_echoes")


def mask(policy: str) -> int:
    return sum(BIT[x] for x in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the failure bits (long) and all measurements (long)."""
    C.ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def evaluate(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = S.measure(C.texts_of(batch))
        bits = np.zeros(len(batch), np.int64)
        for i, rule in enumerate(RULES):
            bits |= np.asarray(rule.fails(m)).astype(np.int64) << i
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], ["doc_id", "bits", *MEASURES])

    return C.map_arrow(docs.select("doc_id", "text"), evaluate, f"doc_id {kind}, bits long, " + ", ".join(f"{k} long" for k in MEASURES), C.SMALL_SLICE)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written once: policies and ablations read bits, never texts."""
    return C.stored(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The ledger with `kept` and `policy`."""
    return rows.withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0).withColumn("policy", F.lit(policy))


def ablation(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept without it."""
    names = POLICIES[policy]
    every = F.col("bits").bitwiseAND(F.lit(mask(policy)))
    one = rows.groupBy(every.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    each = one.select("bits", "n", F.inline(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).cast("long").alias("bit")) for x in names))))
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(total(hit).alias("fails"), total(hit & (rest == 0)).alias("fails_alone"), total(rest == 0).alias("kept_without"), F.bit_or("bits").alias("bits_seen"))
