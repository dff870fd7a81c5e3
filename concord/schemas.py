"""Schemas of the relations and their label domains. Nothing is inferred from data: an absent class still counts."""

from __future__ import annotations

from pyspark.sql import types as T

#: The six emotions in alphabetical order, which is also the order of ties. Fixed values.
EMOTIONS = ("anger", "disgust", "fear", "joy", "sadness", "surprise")


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_TYPES |= {f"array<{k}>": T.ArrayType(v) for k, v in list(_TYPES.items())}


def struct(spec: str) -> T.StructType:
    """`name type, ...`; no session is needed, unlike for StructType.fromDDL."""
    fields = (field.strip().rsplit(" ", 1) for field in spec.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in fields])


RATER_VOTES = struct("item string, rater string, category string")
CORPUS = struct("id string, text string, label string, author string, subreddit string, link_id string, created_utc double")
INDEX_SET = struct("split_seed int, set_name string, id string")
PREDICTIONS = struct("run_id string, example_id string, true_label int, pred_label int, probs array<double>")
PREDICTIONS_CSV = struct("example_id string, true_label string, pred_label string, " + ", ".join(f"p_{e} double" for e in EMOTIONS))
RUN_META = struct("run_id string, model string, regime string, model_seed int, split_seed int, validation_macro_f1 double, n_train int, n_val int, n_test int, train_sha256 string, elapsed_seconds double")
RUN_GRID = struct("run_id string, backbone string, seed int, train_set string, native_validation string, roles array<string>")
MULTILABEL = struct("text string, gold_label_list array<int>, split string")
HASH_MANIFEST = struct("digest string, path string")
JURY_BLOCKS = struct("split_seed int, block string, author string")
JURORS = (("J1", "A"), ("J1", "B"), ("J2", "A"), ("J2", "C"), ("J3", "B"), ("J3", "C"))


def raw_annotations(fine_labels: list[str]) -> T.StructType:
    return struct("id string, rater_id int, " + ", ".join(f"`{x}` int" for x in fine_labels) + ", example_very_unclear boolean, text string, author string, subreddit string, link_id string, created_utc double")


def predictions_wide(columns: list[str]) -> list[str]:
    """The columns that a predictions file must have, in order."""
    return ["example_id", "true_label", "pred_label", *(f"p_{c}" for c in columns)]
