"""Formulas, ties, empty and degenerate cases, invariants."""

import json
import math

import pytest
from pyspark.sql import functions as F

from concord.functions import hashing, stats, text
from concord.operators import audit, dedup, ensemble, inference, labels, metrics, splits
from concord.plans import provenance
from concord.plans.prefix import running_totals
from concord.sources import tables
from concord.streaming import metrics as streaming


def one(df):
    (row,) = df.collect()
    return row


def test_normalise(spark):
    df = spark.createDataFrame([("Hi [NAME], see http://x.y/z  it's A-1!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normalise(F.col("t"))).collect()] == ["hi see it s a 1", None, ""]
    inside = spark.createDataFrame([("hi[NAME]there",), ("a[Religion]b c",), ("seehttp://x.y/z it",), ("[name][name]x",), ("http",), ("https://a b",)], "t string")
    assert [r[0] for r in inside.select(text.normalise(F.col("t"))).collect()] == ["hi there", "a b c", "see it", "x", "http", "b"]  # masks and links leave a space


def test_placeholder_authors_and_threads(spark):
    df = spark.createDataFrame([(" bob ",), ("[Deleted]",), (None,), ("",), ("AutoModerator",)], "author string")
    assert [r[0] for r in text.clean_authors(df).collect()] == ["bob"]
    t = spark.createDataFrame([("a",), ("",), ("nan",), (None,), ("<NA>",)], "t string")
    assert [r[0] for r in t.select(text.thread_valid(F.col("t"))).collect()] == [True, False, False, False, False]


def test_epoch_and_buckets(spark):
    df = spark.createDataFrame([("12.7",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(text.epoch_seconds(F.col("v"))).collect()] == [12, -1, -1]
    n = spark.range(1, 13).select(F.col("id").cast("int").alias("n"))
    assert [r[0] for r in n.select(text.activity_bucket(F.col("n"))).collect()] == ["1", "2", "3-4", "3-4", *["5-9"] * 5, *["10+"] * 3]
    same = spark.createDataFrame([(5,)] * 4, "n int")
    assert {r.len_bucket for r in text.quartile_bucket(same, "n").collect()} == {0}
    q = text.quartile_bucket(spark.range(8).select(F.col("id").alias("n")), "n").orderBy("n")
    assert [r.len_bucket for r in q.collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_set_hash_styles(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1)], "id string, pos int")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(hashing.id_set_hash(df, "id")).set_sha256 == h("a,b")
    assert one(hashing.id_set_hash(df, "id", "training_sorted")).set_sha256 == h("a\nb\n")
    assert one(hashing.id_set_hash(df, "id", "training_order", position="pos")).set_sha256 == h("b\na\n")
    with pytest.raises(ValueError):
        hashing.id_set_hash(df, "id", "training_order")


def test_consensus_counts_rows_and_folds(spark):
    raw = spark.createDataFrame([("i", 1, 1, 1, 0, None), ("i", 2, 1, 0, 1, False), ("j", 1, 0, 0, 1, True)], "id string, rater_id int, a1 int, a2 int, b1 int, example_very_unclear boolean")
    folded = labels.fold_categories(labels.drop_unclear(raw), {"a": ["a1", "a2"], "b": ["b1"]})
    v = labels.votes(folded.select("id", "a", "b"), "id", ["a", "b"]).collect()
    assert [(r.id, r.a, r.b, r.n_raters, r.outcome, r.label) for r in v] == [("i", 2, 1, 2, "single", "a")]


def test_kappa_leaves_out_single_raters(spark):
    v = spark.createDataFrame([("x", 1, 1), ("y", 2, 2), ("z", 0, 2)], "item string, a int, n_raters int")
    r = one(labels.fleiss_kappa(v, ["a"]))
    assert r.n_items == 2 and r.kappa == 1.0


def test_multi_hot_and_wrong_length(spark):
    df = spark.createDataFrame([([1, 0, 0],), ([1, 1, 0],), ([0, 0, 1],), ([0, 0, 0],), ([1],)], "v array<int>")
    target, reason = labels.retention(labels.decode_multi_hot(F.col("v"), ["x", "y", "z"]), {"x": "p", "y": "q"})
    assert [(r[0], r[1]) for r in df.select(target, reason).collect()] == [("p", "retained"), (None, "multiple"), (None, "unmapped"), (None, "no_active"), (None, "malformed")]


def test_absent_class_counts(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "true_label int, pred_label int").withColumn("g", F.lit(1))
    r = one(metrics.bundle(df, ["g"], 6))
    assert r.macro_f1 == pytest.approx(5 / 6) and r.accuracy == 1.0 and r.balanced_accuracy == pytest.approx(5 / 6)
    assert metrics.confusion(df, ["g"], 6).count() == 36
    w = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 1)], "g int, true_label int, pred_label int, n bigint")
    assert one(streaming.bundle_of(w, ["g"], 2)).accuracy == 0.75


def juror(spark, rows):
    return spark.createDataFrame(rows, "juror string, example_id int, true_label int, pred_label int, probs array<double>")


def test_three_way_split_differs_between_hard_votes(spark):
    p = juror(spark, [("a", 1, 3, 0, [0.4, 0.0, 0.22, 0.38]), ("b", 1, 3, 1, [0.0, 0.42, 0.18, 0.4]), ("c", 1, 3, 2, [0.1, 0.1, 0.42, 0.38])])
    assert one(ensemble.hard_vote_any(p, 4)).pred_label == 3  # nobody voted for it
    assert one(ensemble.hard_vote_tied(p, 4)).pred_label == 2
    assert one(ensemble.soft_vote(p, 4)).pred_label == 3
    w = spark.createDataFrame([("a", 0.6), ("b", 0.2), ("c", 0.2)], "juror string, weight double")
    assert one(ensemble.weighted_hard(p, 4, w)).pred_label == 0


def test_argmax_takes_the_first(spark):
    assert spark.range(1).select(stats.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))).first()[0] == 1


def test_constant_errors_have_no_correlation(spark):
    p = juror(spark, [(j, e, 0, 0, [1.0]) for j in ("x", "y") for e in range(4)])
    assert one(ensemble.dependence(p, ["x", "y"])).r is None
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "a int, b double")
    assert df.agg(stats.correlation("a", "b")).first()[0] is None


def pairs(spark, rows):
    return spark.createDataFrame(rows, "example_id int, true_label int, pred_a int, pred_b int")


def test_identical_systems(spark):
    p = pairs(spark, [(i, i % 3, i % 2, i % 2) for i in range(9)])
    assert one(inference.permutation_accuracy(p, 20)).p == 1.0
    assert one(inference.permutation_macro(p, 3, 20)).p == 1.0
    t = one(inference.tost(p))
    assert t.se == 0 and t.inside and t.z_low is None
    assert one(inference.bootstrap_delta(p, 3, 20)).ci_low == 0.0


def test_permutation_floor(spark):
    p = pairs(spark, [(i, 0, 0, 1) for i in range(40)])
    assert one(inference.permutation_accuracy(p, 50)).p == pytest.approx(1 / 51)
    assert one(inference.permutation_macro(p, 2, 50)).p == pytest.approx(1 / 51)


def test_mcnemar(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0), (1, 9), (5, 5), (300, 340)], "b int, c int").select(stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()]
    exact = lambda b, c: min(1, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
    assert got == pytest.approx([exact(0, 0), exact(1, 9), exact(5, 5), exact(300, 340)], rel=1e-12)
    half = 500_000_000
    got = [r[0] for r in spark.createDataFrame([(half - 30_000, half + 30_000), (half - 100, half + 100), (half, half), (0, 2 * half)], "b long, c long").select(stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()]
    normal = lambda gap: math.erfc((gap - 1) / math.sqrt(2 * half) / math.sqrt(2))
    assert got == pytest.approx([normal(60_000), normal(200), 1.0, 0.0], rel=1e-6)


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04)], "test string, p double")
    assert {r.test: r.p_holm for r in inference.holm(t, []).collect()} == {"a": 0.02, "b": 0.04}
    tie = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.9)], "test string, p double")
    assert all(r.p_holm == 1.0 for r in inference.holm(tie, []).collect())


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (-40.0,)], "z double").select(stats.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5, 0.9750021, 0.0], abs=1e-6)
    points = [i / 7 for i in range(-250, 251)]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in points], "z double").select(stats.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in points], rel=1e-11)


def test_running_totals_equal_a_plain_window(spark):
    df = spark.range(500).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"), (F.col("id") % 2).alias("g"))
    got = {r.id: (r.run_n, r.all_n) for r in running_totals(df, "h", "id", {"n": F.col("id")}, ["g"]).collect()}
    rows = sorted(df.collect(), key=lambda r: r.h)
    for g in (0, 1):
        run = 0
        for r in (x for x in rows if x.g == g):
            run += r.id
            assert got[r.id][0] == run


def small_corpus(spark):
    rows = [("1", "a", "t1"), ("2", "a", "t1"), ("3", "a", "t2"), ("4", "b", "t1"), ("5", "b", "nan"), ("6", "c", "t1")]
    df = spark.createDataFrame(rows, "id string, author string, link_id string").withColumn("label", F.lit("x"))
    return df.withColumn("link_id_valid", text.thread_valid(F.col("link_id")))


def test_roles_of_test_authors(spark):
    c = small_corpus(spark)
    assert {r.author: (r.loose, r.strict) for r in splits.eligibility(c).collect()} == {"a": (True, True), "b": (True, False), "c": (False, False)}
    parts = splits.eligibility(c).select(F.lit(1).alias("split_seed"), "author", F.lit("test").alias("partition"), "strict")
    roles = splits.assign_roles(c, parts).collect()
    by = {r.id: r.role for r in roles}
    assert sorted(by[i] for i in "123") in (["excluded", "reserve", "test"], ["reserve", "reserve", "test"])
    assert sorted(by[i] for i in "45") == ["excluded", "test"] and by["6"] == "test"
    own = {r.id: r.link_id for r in roles}
    target = next(i for i in "123" if by[i] == "test")
    assert all((own[i] != own[target]) == (by[i] == "reserve") for i in "123" if i != target)


def test_matching_is_one_to_one_and_relaxes_in_order(spark):
    base = "split_seed int, id string, author string, label string, sub string, len_bucket int, ppa_bucket string, role string, strict boolean"
    rows = [(1, "r1", "a", "x", "s", 0, "1", "reserve", True), (1, "r2", "b", "x", "s", 0, "1", "reserve", True), (1, "r3", "c", "y", "s", 0, "1", "reserve", True)]
    rows += [(1, "t1", "d", "x", "s", 0, "1", "train", False), (1, "t2", "e", "x", "q", 3, "2", "train", False), (1, "t3", "f", "z", "s", 0, "1", "train", False)]
    df = spark.createDataFrame(rows, base)
    for match in (splits.matched_substitution, splits.exact_greedy_match):
        got = {r.injected_id: (r.removed_id, r.level) for r in match(df).collect()}
        assert sorted(got[k] for k in ("r1", "r2")) == [("t1", "exact"), ("t2", "label_only")]
        assert got["r3"] == (None, "failed")


def test_first_kept_is_the_first(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 1, None)], "k string, pos int, v string")
    assert {r.k: r.v for r in labels.first_kept(df, "k", [F.col("pos")]).collect()} == {"k": "a", "m": None}


def test_cleaning_comes_before_dedup(spark):
    df = spark.createDataFrame([(1, "[deleted]", "same text"), (2, "bob", "Same text!"), (3, "al", "...")], "id int, author string, text string")
    assert [r.id for r in dedup.build_corpus(df, "id").collect()] == [2]


def test_chain_is_one_component(spark):
    nodes = spark.range(6).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(4, 2), (2, 3), (0, 1)], "a bigint, b bigint")
    assert {r.n: r.comp for r in dedup.components(nodes, edges, "n").collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}


def test_identical_vectors_are_linked(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "k int, v array<double>")
    assert [(r.a, r.b) for r in dedup.knn_edges(v, "k", "v").collect()] == [(1, 2)]
    assert {(r.a, r.b) for r in dedup.knn_edges(v, "k", "v", planes=2, tables=4).collect()} == {(1, 2)}
    assert [r.k for r in dedup.near_dedup(v, "k", "v").orderBy("k").collect()] == [1, 3]


def test_lookup_fails_on_a_missing_key(spark):
    ids, t = spark.createDataFrame([("a",), ("z",)], "id string"), spark.createDataFrame([("a", 1)], "id string, v int")
    with pytest.raises(Exception, match="no row for key z"):
        audit.lookup(ids, t).collect()


def test_set_relations(spark):
    a, b = spark.range(3), spark.range(5)
    r = one(audit.set_relations(a, b))
    assert r.subset and not r.disjoint and not r.equal


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\nx,1\n")
    (tmp_path / "b.csv").write_text("id,v\ny,2\n")
    from concord.schemas import struct

    rows = tables.read_csvs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], struct("id string, v int")).collect()
    assert [(r.id, r.v, r._src) for r in rows] == [("x", 1, 0), ("y", 2, 1)]
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r.id for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    out = str(tmp_path / "t")
    tables.replace_directory(spark.range(2), out)
    tables.replace_directory(spark.range(5), out)
    assert spark.read.parquet(out).count() == 5 and len(list(tmp_path.glob("t*"))) == 1
    import gzip

    (tmp_path / "old.csv.gz").write_bytes(gzip.compress(b"id\nq\n"))
    assert [r.id for r in tables.read_table(spark, str(tmp_path / "old"), struct("id string")).collect()] == ["q"]
    spark.range(3).write.parquet(str(tmp_path / "new.parquet"))
    assert tables.read_table(spark, str(tmp_path / "new")).count() == 3
    tables.write_report(spark.range(2), str(tmp_path / "r"), "Title")
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 0}, {"id": 1}]


def test_manifest_and_gates(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    (d / "a.txt").write_text("hello")
    digest = provenance.file_sha256(str(d / "a.txt"))
    (tmp_path / "m.sha256").write_text(f"{digest}  a.txt\n{'0' * 64}  b.txt\n")
    bad = provenance.manifest_failures(tables.read_manifest(spark, str(tmp_path / "m.sha256")), tables.file_digests(spark, str(d))).collect()
    assert [(r.path, r.reason) for r in bad] == [("b.txt", "missing")]
    provenance.bind({str(d / "a.txt"): digest})
    with pytest.raises(provenance.GateError):
        provenance.bind({str(d / "a.txt"): "0" * 64})
    ok = {"hypothesis": "H1", "from_status": "confirmatory", "to_status": "exploratory", "section0_report_sha256": "s", "corpus_content_sha256": "c", "exploratory_dose_k": 1, "h1_primary_metric": "accuracy", "decision_text": "demote", "decided_by": "the board", "decided_at_utc": "2026-08-30T14:05:00Z"}
    decision = {"feasible": False, "exploratory_dose": 1, "metric": "accuracy"}
    assert provenance.check_amendment(ok, decision, "s", "c") == 1
    wrong = [{"hypothesis": "H2"}, {"to_status": "dropped"}, {"section0_report_sha256": "x"}, {"exploratory_dose_k": 2}, {"h1_primary_metric": "macro_f1"}, {"corpus_content_sha256": "x"}, {"decided_at_utc": "yesterday"}, {"decided_at_utc": "2026-08-30T14:05:00"}, {"decided_by": "<name>"}, {"decision_text": "no"}]
    for bad in [ok | x for x in wrong] + [{k: v for k, v in ok.items() if k != gone} for gone in ok]:
        with pytest.raises(provenance.GateError):
            provenance.check_amendment(bad, decision, "s", "c")
    with pytest.raises(provenance.GateError):
        provenance.check_amendment(ok, decision | {"feasible": True}, "s", "c")


def test_pending_runs_and_sessions(spark):
    grid = provenance.job_grid(spark)
    assert grid.count() == 45 and grid.select("run_id").distinct().count() == 45
    first = grid.orderBy("run_id").first().run_id
    ledger = spark.createDataFrame([(first, "complete", "d", "d", 5, 5)], "run_id string, status string, digest string, file_digest string, n_rows int, n_expected int")
    pending = provenance.pending_runs(grid, ledger)
    assert pending.count() == 44 and provenance.session_runs(pending, 3).count() == 3
    assert provenance.pending_runs(grid, ledger.withColumn("file_digest", F.lit("other"))).count() == 45


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from concord.queries.surrogates import corpus

    c = corpus(spark, sf_dir)
    a = splits.author_partitions(c).orderBy("split_seed", "author").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = splits.author_partitions(c.repartition(7)).orderBy("split_seed", "author").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


def test_contamination_by_whole_words_of_any_length(spark):
    d = spark.createDataFrame([(1, "x one two three four five six seven eight nine y"), (2, "one two three four five six seven eight ninety"), (3, "short words here"), (4, "shorter words here"), (5, None), (6, "")], "k int, t string")
    b = spark.createDataFrame([(10, "one two three four five six seven eight nine"), (11, "short words"), (12, ""), (13, "here"), (14, None)], "i int, u string")
    got = audit.contamination(d, "k", F.col("t"), b, "i", F.col("u")).collect()
    assert sorted(map(tuple, got)) == [(1, 10), (3, 11), (3, 13), (4, 13)]
    assert audit.contamination(d, "k", F.col("t"), b.where("i = 12"), "i", F.col("u")).count() == 0


def test_split_checks_see_planted_violations(spark, sf_dir):
    from concord.queries.surrogates import corpus

    c = corpus(spark, sf_dir)
    c = tables.stored(c, "corpus")
    x = tables.stored(splits.assign_roles(c, splits.author_partitions(c, (42,))), "roles")
    m = tables.stored(splits.matched_substitution(x), "matches").where("level != 'failed'")
    o, r = splits.overlap_training(x, m), splits.stratified_split(c, seeds=(42,))
    blocks = tables.stored(splits.serpentine_blocks(x.where("role = 'train'")), "blocks")
    run = lambda x=x, m=m, o=o, r=r, b=blocks: {k.name for k in audit.split_checks(c, x, m, o, r, b).collect() if not k.passed}
    sound = run()
    assert sound <= {"uniform_coverage"}  # tiny splits may lack partners, and those rows were left out
    train = x.where("role = 'train'").limit(1)
    val = x.where("role = 'val'").first()
    assert run(x=x.unionByName(train)) - sound >= {"ids_unique", "partitions_disjoint"}
    assert run(x=x.where(F.col("id") != val.id)) - sound == {"partitions_cover"}
    assert "train_val_author_disjoint" in run(x=x.withColumn("author", F.when(F.col("id") == train.first().id, val.author).otherwise(F.col("author"))))
    assert run(m=m.withColumn("level", F.lit("failed"))) - sound == {"match_complete"}
    assert run(o=o.limit(o.count() - 1)) - sound >= {"overlap_reconstructed", "sizes_identical", "class_counts_identical"}
    assert run(r=r.unionByName(r.limit(1))) - sound == {"random_partitions_disjoint"}
    assert run(b=blocks.limit(3)) - sound == {"blocks_partition_train_authors"}
    assert "injected_from_reserve_removed_from_train" in run(m=m.withColumn("removed_id", F.lit(val.id)))


def test_boundary_audit(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "a"), ("train", "b"), ("test", "b"), ("spare", "c"), ("train", "c"), ("val", "")], "part string, norm string")
    assert tuple(one(audit.boundary_audit(df, "part", "norm"))) == (1, 1, True)
