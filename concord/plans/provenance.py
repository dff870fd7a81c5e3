"""Provenance: manifests, config bindings, amendment gates, the run grid and its ledger. Gates fail closed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A precondition failed; nothing may be computed."""


def manifest_failures(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): files that are missing, or whose digest differs."""
    got = manifest.join(files.select("path", F.col("digest").alias("found")), "path", "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("digest"), "digest differs")
    return got.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> None:
    bad = manifest_failures(manifest, files).limit(20).collect()
    if bad:
        raise GateError("; ".join(f"{r['path']}: {r['reason']}" for r in bad))


def file_sha256(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def bind(expected: Mapping[str, str]) -> None:
    """Each path must have its digest."""
    for path, digest in expected.items():
        if not Path(path).is_file():
            raise GateError(f"{path}: missing")
        if file_sha256(path) != digest:
            raise GateError(f"{path}: digest differs")


def load_config(path: str, required: Mapping[str, object]) -> dict:
    """A JSON object whose listed fields (dotted names) have exactly the listed values."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, value in required.items():
        at: object = config
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                raise GateError(f"{path}: no field {name}")
            at = at[part]
        if at != value:
            raise GateError(f"{path}: {name} is {at!r}, not {value!r}")
    return config


#: What an amendment must say. Fixed values.
AMENDMENT = {"hypothesis": "H1", "from_status": "confirmatory", "to_status": "exploratory"}
#: What it must have besides. Fixed values.
AMENDMENT_FIELDS = ("exploratory_dose_k", "h1_primary_metric", "decision_text", "decided_by", "decided_at_utc")

#: What a report's decision must say, and the names that it may have there: those of a report, or of `feasibility.decision`.
DECISION = {"feasible": ("h1_confirmatory_feasible", "feasible"), "exploratory_dose_k": ("exploratory_dose_k", "exploratory_dose"), "h1_primary_metric": ("h1_primary_metric", "metric")}


def is_utc_instant(value: object) -> bool:
    if not isinstance(value, str) or not value.endswith("Z"):
        return False
    try:
        datetime.fromisoformat(value[:-1] + "+00:00")
    except ValueError:
        return False
    return True


def check_amendment(amendment: Mapping, decision: Mapping, report_sha256: str, corpus_sha256: str) -> int:
    """An amendment may only weaken the one hypothesis, must name the report and the corpus that it answers, who decided what and when, and
    keeps the dose and the metric that the report's decision found. Whatever is absent, in the amendment or in the decision, is refused. Returns the dose."""
    found = {field: next((decision[n] for n in names if n in decision), None) for field, names in DECISION.items()}
    if lacking := [field for field, value in found.items() if value is None]:
        raise GateError(f"the report's decision says nothing of {', '.join(lacking)}")
    if found["feasible"]:
        raise GateError("the design is feasible: there is nothing to amend")
    bound = AMENDMENT | {"section0_report_sha256": report_sha256, "corpus_content_sha256": corpus_sha256}
    for field, value in bound.items():
        if not value or amendment.get(field) != value:
            raise GateError(f"amendment: {field} must be {value!r}")
    for field in AMENDMENT_FIELDS:
        if not amendment.get(field):
            raise GateError(f"amendment: no {field}")
    for field in ("decision_text", "decided_by"):
        said = str(amendment[field]).strip()
        if len(said) < 3 or said.startswith("<") or said.endswith(">"):
            raise GateError(f"amendment: {field} is not filled in")
    if not is_utc_instant(amendment["decided_at_utc"]):
        raise GateError("amendment: decided_at_utc is no UTC instant")
    for field in ("exploratory_dose_k", "h1_primary_metric"):
        if amendment[field] != found[field]:
            raise GateError(f"amendment: {field} differs from the report's decision")
    return int(amendment["exploratory_dose_k"])


def split_hash_mismatches(reported: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(split_seed, role) whose id-set hashes differ, or that one side lacks."""
    a, b = reported.select("split_seed", "role", F.col("set_sha256").alias("a")), rebuilt.select("split_seed", "role", F.col("set_sha256").alias("b"))
    return a.join(b, ["split_seed", "role"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("split_seed", "role")


#: Training regimes and their jurors of one split. Fixed values.
JOBS = (("bert", "r_clean", None), ("bert", "r_random", None), ("bert", "r_overlap", None), ("roberta", "r_clean", None), ("roberta", "r_overlap", None), ("bert", "complementary", "J1"), ("bert", "complementary", "J2"), ("bert", "complementary", "J3"), ("bert", "disjoint", "A"), ("bert", "disjoint", "B"), ("bert", "disjoint", "C"))
ROBUST = (("bert", "r_clean", 2), ("bert", "r_clean", 3), ("bert", "r_overlap", 2), ("bert", "r_overlap", 3))


def job_grid(spark: SparkSession, seeds: tuple[int, ...] = (42, 123, 2024)) -> DataFrame:
    """(run_id, backbone, regime, part, model_seed, split_seed): 15 jobs of each split."""
    jobs = [(m, r, p or "", 1) for m, r, p in JOBS] + [(m, r, "", s) for m, r, s in ROBUST]
    grid = spark.createDataFrame(jobs, "backbone string, regime string, part string, model_seed int").select("*", F.explode(F.array(*map(F.lit, seeds))).alias("split_seed"))
    name = F.concat_ws("__", "backbone", F.when(F.col("part") != "", F.concat_ws("_", "regime", "part")).otherwise(F.col("regime")), F.concat(F.lit("split"), F.col("split_seed").cast("string")), F.concat(F.lit("seed"), F.col("model_seed").cast("string")))
    return grid.select(name.alias("run_id"), "backbone", "regime", "part", "model_seed", "split_seed")


def pending_runs(grid: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs without a valid ledger row. A row is valid if its status is complete, its digest is that of its file, and the
    rows it wrote are those expected."""
    valid = ledger.where((F.col("status") == "complete") & (F.col("digest") == F.col("file_digest")) & (F.col("n_rows") == F.col("n_expected")))
    return grid.join(valid.select("run_id").distinct(), "run_id", "left_anti")


def session_runs(pending: DataFrame, cap: int, chosen: list[str] | None = None) -> DataFrame:
    """The runs of one session: those asked for, or the first by name."""
    if chosen is not None:
        return pending.where(F.col("run_id").isin(*chosen))
    return pending.orderBy("run_id").limit(cap)


def evaluation_pool(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Several evaluation sets as one table to be scored once; set_name tells them apart again."""
    out = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("set_name"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sets")
    return out


def inconsistent_metrics(recomputed: DataFrame, selected: DataFrame, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """Runs whose recomputed metric is not the one that selected them."""
    a, b = recomputed.select("run_id", F.col(metric).alias("a")), selected.select("run_id", F.col(metric).alias("b"))
    return a.join(b, "run_id", "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


