"""The freeze chain: documents on disk, their digests, and what breaks when one is changed."""

import hashlib
import json

import pytest

from concord.plans import freeze, provenance

CORPUS = [("a1", "x"), ("a1", "y"), ("a2", "x"), ("a3", "x")]


def write(root, bundle, change=None):
    """A sound chain, changed by `change(name, document)` before each document is written; returns its digests."""
    digests = {}

    def put(name, doc):
        doc = (change or (lambda n, d: d))(name, doc)
        folder = root / bundle / name
        folder.mkdir(parents=True)
        if doc is not None:
            (folder / "doc.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))
            digests[name] = hashlib.sha256((folder / "doc.json").read_bytes()).hexdigest()

    content = "c" * 64
    put("section0", {"freeze_quality": True, "decision": {"h1_confirmatory_feasible": False, "exploratory_dose_k": 1, "h1_primary_metric": "accuracy"}, "meta": {"corpus_content_sha256": content}})
    put("amendment", {"hypothesis": "H1", "to_status": "exploratory", "section0_report_sha256": digests.get("section0"), "corpus_content_sha256": content, "exploratory_dose_k": 1, "h1_primary_metric": "accuracy"})
    put("manifest", {"section0_report_sha256": digests.get("section0"), "h1_amendment_sha256": digests.get("amendment"), "corpus_content_sha256": content, "h1_status": "exploratory", "dose_k": 1, "h1_primary_metric": "accuracy", "corpus": {"n_examples": 4, "n_authors": 3, "class_distribution": {"x": 3, "y": 1, "z": 0}}})
    return digests


def patch(where, **fields):
    return lambda name, doc: doc | fields if name == where else doc


CASES = {
    "sound": (None, set()),
    "report cited wrongly": (patch("manifest", section0_report_sha256="0" * 64), {"P01"}),
    "amendment cited wrongly": (patch("manifest", h1_amendment_sha256="0" * 64), {"P02"}),
    "amendment of another report": (patch("amendment", section0_report_sha256="0" * 64), {"P03"}),
    "feasible": (patch("section0", decision={"h1_confirmatory_feasible": True}), {"P04"}),
    "draft": (patch("section0", freeze_quality=False), {"P04"}),
    "other hypothesis": (patch("amendment", hypothesis="H2"), {"P04"}),
    "other dose": (patch("manifest", dose_k=2), {"P04"}),
    "other metric": (patch("amendment", h1_primary_metric="macro_f1"), {"P04"}),
    "other corpus": (patch("amendment", corpus_content_sha256="d" * 64), {"P05"}),
    "one example more": (patch("manifest", corpus={"n_examples": 5, "n_authors": 3, "class_distribution": {"x": 3, "y": 1}}), {"P06"}),
    "classes swapped": (patch("manifest", corpus={"n_examples": 4, "n_authors": 3, "class_distribution": {"x": 1, "y": 3}}), {"P06"}),
    "class that is not there": (patch("manifest", corpus={"n_examples": 4, "n_authors": 3, "class_distribution": {"x": 3, "y": 1, "w": 1}}), {"P06"}),
    "no manifest": (lambda n, d: None if n == "manifest" else d, {"P01", "P02", "P04", "P05", "P06"}),
    "manifest that is no JSON": (lambda n, d: "{" if n == "manifest" else d, {"P01", "P02", "P04", "P05", "P06"}),
}


def test_each_mistake_fails_its_check(spark, tmp_path):
    for bundle, (change, _) in CASES.items():
        write(tmp_path, bundle, change)
    corpus = spark.createDataFrame(CORPUS, "author string, label string")
    got = freeze.freeze_checks(freeze.read_documents(spark, str(tmp_path)), corpus).collect()
    assert len(got) == 6 * len(CASES)
    failed = {b: {r["check_id"] for r in got if r["bundle"].replace("%20", " ") == b and not r["passed"]} for b in CASES}
    assert failed == {b: expected for b, (_, expected) in CASES.items()}


def test_closure_and_dangling(spark, tmp_path):
    write(tmp_path, "sound")
    (tmp_path / "sound" / "run").mkdir()
    manifest = hashlib.sha256((tmp_path / "sound" / "manifest" / "doc.json").read_bytes()).hexdigest()
    (tmp_path / "sound" / "run" / "doc.json").write_text(json.dumps({"dataset_manifest_sha256": manifest, "weights_sha256": "e" * 64}))
    docs = freeze.read_documents(spark, str(tmp_path))
    got = {(r["name"], r["rests_on"]): r["depth"] for r in freeze.closure(docs).collect()}
    assert got == {("amendment", "section0"): 1, ("manifest", "section0"): 1, ("manifest", "amendment"): 1, ("run", "manifest"): 1, ("run", "amendment"): 2, ("run", "section0"): 2}
    contents = spark.createDataFrame([("sound", "c" * 64)], "bundle string, digest string")
    assert [(r["name"], r["field"]) for r in freeze.dangling(docs, contents).collect()] == [("run", "weights_sha256")]


def config():
    return {
        "frozen": True, "class_weighting": "none", "models": {"m": {"revision": "a" * 40}}, "tokenization": {"padding": "max_length", "truncation": True},
        "optimization": {"optimizer": "AdamW", "scheduler": "linear_with_warmup", "loss": "cross_entropy"},
        "checkpoint_rule": {"selection_metric": "validation_macro_f1", "selection_mode": "max", "evaluate_every": "epoch", "restore_best_before_test": True},
        "model_seeds": [1], "labels": ["x", "y"], "determinism": {"seed_python_numpy_torch": True},
        "data_provenance": {"dataset_manifest_sha256": "b" * 64, "corpus_content_sha256": "c" * 64, "split_seeds": [42]}, "h2_single_model_baseline": {"model": "m", "regime": "r_clean", "model_seed": 1},
    }


def test_config_rules(spark):
    cases = [({}, set()), ({"frozen": None}, {"frozen"}), ({"labels": ["y", "x"]}, {"labels"}), ({"models": {"m": {"revision": "main"}}}, {"revision"}), ({"models": {"n": {"revision": "a" * 40}}}, {"baseline"})]
    cases += [({"tokenization": {"padding": "max_length", "truncation": "true"}}, {"structure:tokenization.truncation"}), ({"determinism": {}}, {"determinism"}), ({"data_provenance": {"dataset_manifest_sha256": "<fill in>", "corpus_content_sha256": "", "split_seeds": []}}, {f"provenance:{f}" for f in freeze.FILLED})]
    cases += [({"class_weighting": None}, {"missing:class_weighting", "class_weighting"}), ({"model_seeds": [2]}, {"baseline"})]
    rows = [("b", str(i), json.dumps({k: v for k, v in (config() | change).items() if v is not None})) for i, (change, _) in enumerate(cases)] + [("b", "broken", "{")]
    got = freeze.config_violations(spark.createDataFrame(rows, "bundle string, name string, text string"), ["x", "y"]).collect()
    found = {n: {r["rule"] for r in got if r["name"] == n} for _, n, _ in rows}
    assert found == {str(i): want for i, (_, want) in enumerate(cases)} | {"broken": {"no JSON"}}


def test_unbound(spark):
    docs = spark.createDataFrame([("b", "x", "1"), ("b", "y", "2")], "bundle string, name string, digest string")
    expected = spark.createDataFrame([("b", "x", "1"), ("b", "y", "3"), ("b", "z", "4")], "bundle string, name string, expected string")
    assert sorted((r["name"], r["reason"]) for r in freeze.unbound(docs, expected).collect()) == [("y", "digest differs"), ("z", "missing")]


def test_gate_refuses_an_incomplete_decision():
    ok = {"hypothesis": "H1", "from_status": "confirmatory", "to_status": "exploratory", "section0_report_sha256": "s", "corpus_content_sha256": "c", "exploratory_dose_k": 3, "h1_primary_metric": "accuracy", "decision_text": "demote", "decided_by": "the board", "decided_at_utc": "2026-08-30T14:05:00Z"}
    report = {"h1_confirmatory_feasible": False, "exploratory_dose_k": 3, "h1_primary_metric": "accuracy"}
    assert provenance.check_amendment(ok, report, "s", "c") == 3
    for decision in [{}, *({k: v for k, v in report.items() if k != gone} for gone in report), report | {"exploratory_dose_k": 2}, report | {"h1_primary_metric": "macro_f1"}, report | {"h1_confirmatory_feasible": True}]:
        with pytest.raises(provenance.GateError):
            provenance.check_amendment(ok, decision, "s", "c")
