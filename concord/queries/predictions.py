"""Queries on predictions: metrics, votes, dependence, paired inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import cohen_h as effect_h
from ..functions.stats import mcnemar_exact
from ..operators import ensemble, inference, metrics, prediction_files
from ..operators import splits as splits_
from ..sources.tables import file_digests, scratch, stored
from . import resampling_sql as RS
from .surrogates import ENSEMBLE_SQL, JURORS, K, LADDER, LADDER_SQL, PRED_SQL, REPS, bundle_select, class_sql, corpus, ladder_predictions, ladder_sql, predictions, r, sql_int, sql_key, table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _test(spark, sf_dir):
    return predictions(spark, sf_dir).where("part = 'test'").drop("part")


def _stored(spark, sf_dir):
    """The predictions, written once for queries that read them several times."""
    return stored(predictions(spark, sf_dir), "predictions")


def _weights(spark, sf_dir, p=None):
    scores = metrics.bundle((p if p is not None else predictions(spark, sf_dir)).where("part = 'val'").withColumn("one", F.lit(1)), ["one", "juror"], K)
    return ensemble.juror_weights(scores, ["one"])


def _pairs(spark, sf_dir):
    """Equal soft vote against the first juror."""
    t = _stored(spark, sf_dir).where("part = 'test'").drop("part")
    b = t.where("juror = 'J1'").select("example_id", F.col("pred_label").alias("pred_b"))
    return ensemble.soft_vote(t, K).select("example_id", "true_label", F.col("pred_label").alias("pred_a")).join(b, "example_id")


def _jury(spark, sf_dir):
    """Arguments of a weighted vote."""
    p = _stored(spark, sf_dir)
    return p.where("part = 'test'").drop("part"), K, _weights(spark, sf_dir, p)


def _systems(spark, sf_dir, other: str):
    """The weighted soft vote against the first juror (h2) or the equal vote (h3)."""
    t, k, w = _jury(spark, sf_dir)
    b = t.where("juror = 'J1'") if other == "h2" else ensemble.soft_vote(t, k)
    a = ensemble.soft_vote(t, k, w).select("example_id", "true_label", F.col("pred_label").alias("pred_a"))
    return stored(a.join(b.select("example_id", F.col("pred_label").alias("pred_b")), "example_id"), "systems")


# --- metrics
@query
def confusion(spark, sf_dir):
    return metrics.confusion(_test(spark, sf_dir), ["juror"], K)


SQL["confusion"] = f"WITH {PRED_SQL} SELECT j.juror, a.i::INT AS true_label, b.i::INT AS pred_label, count(preds.example_id) AS n FROM (SELECT DISTINCT juror FROM preds) j CROSS JOIN (SELECT unnest(range({K})) AS i) a CROSS JOIN (SELECT unnest(range({K})) AS i) b LEFT JOIN preds ON preds.juror = j.juror AND true_label = a.i AND pred_label = b.i AND part = 'test' GROUP BY ALL"


@query
def per_class(spark, sf_dir):
    return metrics.per_class(metrics.class_counts(_test(spark, sf_dir), ["juror"], K))


SQL["per_class"] = f"WITH {PRED_SQL}, t AS (SELECT * FROM preds WHERE part = 'test'), {class_sql('t', ['juror'])} SELECT juror, label, tp, predicted, support, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM cc"


@query
def metric_bundle(spark, sf_dir):
    return metrics.bundle(_test(spark, sf_dir), ["juror"], K)


SQL["metric_bundle"] = f"WITH {PRED_SQL}, t AS (SELECT * FROM preds WHERE part = 'test'), {class_sql('t', ['juror'])} {bundle_select('cc', ['juror'])}"


@query
def macro_f1(spark, sf_dir):
    return metrics.bundle(predictions(spark, sf_dir), ["juror", "part"], K).select("juror", "part", "n", "macro_f1", "accuracy")


SQL["macro_f1"] = f"WITH {PRED_SQL}, {class_sql('preds', ['juror', 'part'])} SELECT juror, part, sum(support)::BIGINT AS n, {r('avg(f1)')} AS macro_f1, {r('sum(tp) / sum(support)')} AS accuracy FROM cc GROUP BY juror, part"


@query
def balanced_acc(spark, sf_dir):
    return metrics.bundle(_test(spark, sf_dir), ["juror"], K).select("juror", "balanced_accuracy", "weighted_f1")


SQL["balanced_acc"] = f"WITH {PRED_SQL}, t AS (SELECT * FROM preds WHERE part = 'test'), {class_sql('t', ['juror'])} SELECT juror, {r('avg(recall)')} AS balanced_accuracy, {r('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM cc GROUP BY juror"


@query
def exclude_class_f1(spark, sf_dir):
    return metrics.macro_f1_without(_test(spark, sf_dir), ["juror"], K, 3)


SQL["exclude_class_f1"] = f"WITH {PRED_SQL}, t AS (SELECT * FROM preds WHERE part = 'test' AND true_label <> 3), {class_sql('t', ['juror'])} SELECT juror, {r('avg(f1)')} AS macro_f1, sum(support)::BIGINT AS n FROM cc WHERE label <> 3 GROUP BY juror"


@query
def prediction_dist(spark, sf_dir):
    return metrics.prediction_distribution(_test(spark, sf_dir), ["juror"])


SQL["prediction_dist"] = f"WITH {PRED_SQL} SELECT juror, pred_label, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY juror)')} AS proportion FROM preds WHERE part = 'test' GROUP BY juror, pred_label"


@query
def family_summary(spark, sf_dir):
    b = metrics.bundle(predictions(spark, sf_dir), ["juror", "part"], K)
    return metrics.family_summary(b, ["part"], "macro_f1")


SQL["family_summary"] = f"WITH {PRED_SQL}, {class_sql('preds', ['juror', 'part'])}, m AS (SELECT juror, part, avg(f1) AS f FROM cc GROUP BY ALL) SELECT part, count(*) AS n_runs, {r('avg(f)')} AS mean, {r('stddev_samp(f)')} AS std, {r('min(f)')} AS min, {r('max(f)')} AS max FROM m GROUP BY part"


@query
def prediction_violations(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("pred_label", F.when(F.col("example_id") % 7 == 0, -1).otherwise(F.col("pred_label")))
    return metrics.violations(p, K).select("juror", "example_id", F.array_join("violations", ",").alias("violations"))


SQL["prediction_violations"] = f"WITH {PRED_SQL} SELECT juror, example_id, 'argmax' AS violations FROM preds WHERE example_id % 7 = 0"


@query
def prediction_file_violations(spark, sf_dir):
    """Files of the jurors' test predictions with planted faults: in J1's rows another label, a number that is none, sums of 2; J2's header in another order; J3's
    sidecar with another run and digest. J4 has no sidecar, J5 is sound."""
    t = _test(spark, sf_dir).select("juror", "example_id", "true_label", "pred_label", *(F.col("probs")[i].alias(f"prob_{i}") for i in range(K)))
    one = stored(t.where("juror = 'J1'").drop("juror"), "files")
    k = F.col("example_id")
    bad = one.withColumn("pred_label", F.when(k % 7 == 0, (F.col("pred_label") + 1) % K).otherwise(F.col("pred_label")))
    bad = bad.withColumns({f"prob_{i}": F.when(k % 13 == 0, 2 * F.col(f"prob_{i}")).otherwise(F.col(f"prob_{i}")).cast("string") for i in range(K)})
    bad = bad.withColumn("prob_0", F.when(k % 11 == 0, F.lit("n/a")).otherwise(F.col("prob_0")))
    runs = {"J1": bad, "J2": one.select("true_label", "example_id", *one.columns[2:]), "J3": one, "J4": one, "J5": one}
    root = scratch(spark, "prediction-files")
    for run, df in runs.items():
        df.coalesce(1).write.option("header", True).csv(f"{root}/{run}")
    found = file_digests(spark, root).where("path RLIKE '[.]csv$'").select(F.substring_index("path", "/", 1).alias("run"), "digest")
    wrong = F.col("run") == "J3"
    sidecars = found.where("run != 'J4'").select("run", F.when(wrong, "J1").otherwise(F.col("run")).alias("run_id"), F.when(wrong, F.lit("0" * 64)).otherwise(F.col("digest")).alias("prediction_file_sha256"))
    return prediction_files.violations(spark, root, stored(sidecars, "sidecars"), K)


SQL["prediction_file_violations"] = f"""WITH {PRED_SQL}, t AS (SELECT example_id AS k FROM preds WHERE part = 'test' AND juror = 'J1')
SELECT 'J1' AS run, k::VARCHAR AS example_id, rule FROM t, (VALUES ('finite'), ('sum'), ('argmax')) r(rule) WHERE CASE rule WHEN 'finite' THEN k % 11 = 0 WHEN 'sum' THEN k % 11 <> 0 AND k % 13 = 0 ELSE k % 11 <> 0 AND k % 7 = 0 END
UNION ALL SELECT run, NULL, rule FROM (VALUES ('J2', 'columns'), ('J3', 'run_id'), ('J3', 'digest'), ('J4', 'no sidecar')) f(run, rule) WHERE EXISTS (SELECT 1 FROM t)"""


# --- votes
@query
def juror_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("juror", "weight")


SQL["juror_weights"] = f"WITH {ENSEMBLE_SQL} SELECT juror, {r('weight')} AS weight FROM w"


@query
def soft_vote(spark, sf_dir):
    return ensemble.soft_vote(_test(spark, sf_dir), K).select("example_id", "true_label", "pred_label")


SQL["soft_vote"] = f"WITH {ENSEMBLE_SQL} SELECT * FROM soft_eq"


@query
def weighted_vote(spark, sf_dir):
    return ensemble.soft_vote(*_jury(spark, sf_dir)).select("example_id", "true_label", "pred_label")


SQL["weighted_vote"] = f"WITH {ENSEMBLE_SQL} SELECT * FROM soft_we"


@query
def hard_vote_a(spark, sf_dir):
    return ensemble.hard_vote_any(_test(spark, sf_dir), K)


SQL["hard_vote_a"] = f"WITH {ENSEMBLE_SQL}, t AS (SELECT example_id, arg_max(c, (n, -c)) AS c, max(n) AS n FROM vn GROUP BY example_id) SELECT s.example_id, s.true_label, CASE WHEN t.n >= 2 THEN t.c ELSE s.pred_label END AS pred_label FROM soft_eq s JOIN t ON s.example_id = t.example_id"


@query
def hard_vote_c(spark, sf_dir):
    return ensemble.hard_vote_tied(_test(spark, sf_dir), K)


SQL["hard_vote_c"] = f"WITH {ENSEMBLE_SQL} SELECT vn.example_id, vn.true_label, arg_max(vn.c, (n, p, -vn.c)) AS pred_label FROM vn JOIN eq ON vn.example_id = eq.example_id AND vn.c = eq.c GROUP BY ALL"


@query
def weighted_hard(spark, sf_dir):
    return ensemble.weighted_hard(*_jury(spark, sf_dir))


SQL["weighted_hard"] = f"WITH {ENSEMBLE_SQL}, s AS (SELECT example_id, true_label, pred_label AS c, sum(weight) AS n FROM test JOIN w ON test.juror = w.juror GROUP BY ALL) SELECT example_id, true_label, arg_max(c, (n, -c)) AS pred_label FROM s GROUP BY ALL"


@query
def weight_activation(spark, sf_dir):
    return ensemble.weight_activation(*_jury(spark, sf_dir))


SQL["weight_activation"] = f"""WITH {ENSEMBLE_SQL}, k AS (SELECT example_id, count(DISTINCT pred_label) AS kinds FROM test GROUP BY example_id)
SELECT count(*) AS n, {r('100 * count(*) FILTER (WHERE kinds >= 3) / count(*)')} AS three_way_pct, {r('100 * count(*) FILTER (WHERE a.pred_label <> b.pred_label) / count(*)')} AS changed_pct, {r('(SELECT max(weight) FROM w)')} AS max_weight, (SELECT max(weight) FROM w) > 0.5 AS dominant
FROM soft_eq a JOIN soft_we b ON a.example_id = b.example_id JOIN k ON a.example_id = k.example_id"""


@query
def alignment_errors(spark, sf_dir):
    t = _test(spark, sf_dir)
    a, b = t.where("juror = 'J1' AND example_id % 5 != 0"), t.where("juror = 'J2'").withColumn("true_label", F.when(F.col("example_id") % 11 == 0, 99).otherwise(F.col("true_label")))
    return ensemble.alignment_errors(a, b)


SQL["alignment_errors"] = f"""WITH {PRED_SQL}, a AS (SELECT example_id, true_label AS ya FROM preds WHERE part = 'test' AND juror = 'J1' AND example_id % 5 <> 0), b AS (SELECT example_id, CASE WHEN example_id % 11 = 0 THEN 99 ELSE true_label END AS yb FROM preds WHERE part = 'test' AND juror = 'J2')
SELECT coalesce(a.example_id, b.example_id) AS example_id, ya, yb FROM a FULL JOIN b ON a.example_id = b.example_id WHERE ya IS NULL OR yb IS NULL OR ya <> yb"""


_DEP = """wide AS (SELECT example_id, max((true_label = pred_label)::INT) FILTER (WHERE juror = 'J1') AS J1, max((true_label = pred_label)::INT) FILTER (WHERE juror = 'J2') AS J2, max((true_label = pred_label)::INT) FILTER (WHERE juror = 'J3') AS J3 FROM preds WHERE part = 'test' GROUP BY example_id),
pr AS (SELECT 'J1' AS a, 'J2' AS b, J1 AS x, J2 AS y FROM wide UNION ALL SELECT 'J1', 'J3', J1, J3 FROM wide UNION ALL SELECT 'J2', 'J3', J2, J3 FROM wide),
cells AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE x = 1 AND y = 1) AS n11, count(*) FILTER (WHERE x = 1 AND y = 0) AS n10, count(*) FILTER (WHERE x = 0 AND y = 1) AS n01, count(*) FILTER (WHERE x = 0 AND y = 0) AS n00 FROM pr GROUP BY a, b),
dep AS (SELECT *, (n11 * n00 - n10 * n01) / nullif(sqrt(((n11 + n10) * (n01 + n00))::DOUBLE * ((n11 + n01) * (n10 + n00))), 0) AS r, (n11 * n00 - n10 * n01) / nullif(n11 * n00 + n10 * n01, 0) AS q, (n10 + n01) / n AS disagreement,
  ((n11 + n00) / n - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n::DOUBLE * n)) / nullif(1 - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n::DOUBLE * n), 0) AS kappa FROM cells)"""


@query
def error_corr(spark, sf_dir):
    return ensemble.dependence(_test(spark, sf_dir), JURORS)


SQL["error_corr"] = f"WITH {PRED_SQL}, {_DEP} SELECT a, b, n, n11, n10, n01, n00, {r('r')} AS r, {r('q')} AS q, {r('disagreement')} AS disagreement, {r('kappa')} AS kappa FROM dep"


@query
def error_summary(spark, sf_dir):
    return ensemble.error_summary(_test(spark, sf_dir), JURORS)


SQL["error_summary"] = f"WITH {PRED_SQL}, {_DEP} SELECT {r('avg(r)')} AS mean_r, count(r) AS n_defined, count(*) AS n_pairs FROM dep"


@query
def ensemble_gain(spark, sf_dir):
    t = _test(spark, sf_dir)
    e = metrics.bundle(ensemble.soft_vote(t, K).withColumn("one", F.lit(1)), ["one"], K)
    return ensemble.gain(e, metrics.bundle(t.withColumn("one", F.lit(1)), ["one", "juror"], K), "macro_f1", ["one"]).drop("one")


SQL["ensemble_gain"] = f"""WITH {ENSEMBLE_SQL}, {class_sql('soft_eq', [], 'ec')}, {class_sql('test', ['juror'], 'tc')}, m AS (SELECT juror, avg(f1) AS f FROM tc GROUP BY juror)
SELECT {r('(SELECT avg(f1) FROM ec)')} AS "value", {r('max(f)')} AS best, (SELECT juror FROM m ORDER BY f DESC, juror LIMIT 1) AS best_member, {r('(SELECT avg(f1) FROM ec) - max(f)')} AS gain FROM m"""


@query
def rank_consistency(spark, sf_dir):
    b = metrics.bundle(predictions(spark, sf_dir), ["juror", "part"], K)
    return ensemble.rank_consistency(b, "juror", "part", "macro_f1")


SQL["rank_consistency"] = f"WITH {PRED_SQL}, {class_sql('preds', ['juror', 'part'])}, m AS (SELECT juror, part, avg(f1) AS f FROM cc GROUP BY ALL), k AS (SELECT juror, rank() OVER (PARTITION BY part ORDER BY f DESC) AS k FROM m) SELECT juror, min(k)::INT AS best_rank, max(k)::INT AS worst_rank, {r('avg(k)')} AS mean_rank FROM k GROUP BY juror"


# --- paired inference
@query
def perm_accuracy(spark, sf_dir):
    return inference.permutation_accuracy(_pairs(spark, sf_dir), REPS)


SQL["perm_accuracy"] = f"WITH {ENSEMBLE_SQL},\n{RS.perm_accuracy('pairs', REPS, [])}\nSELECT * FROM pa"


@query
def perm_macro(spark, sf_dir):
    return inference.permutation_macro(_pairs(spark, sf_dir), K, REPS)


SQL["perm_macro"] = f"WITH {ENSEMBLE_SQL},\n{RS.perm_macro('pairs', K, REPS, [])}\nSELECT * FROM pm"


@query
def boot_delta(spark, sf_dir):
    return inference.bootstrap_delta(_pairs(spark, sf_dir), K, REPS)


SQL["boot_delta"] = f"WITH RECURSIVE {ENSEMBLE_SQL},\n{RS.boot_accuracy('pairs', REPS, [])}\nSELECT * FROM ba"


@query
def boot_macro(spark, sf_dir):
    return inference.bootstrap_delta(_pairs(spark, sf_dir), K, REPS, metric="macro_f1")


SQL["boot_macro"] = f"WITH RECURSIVE {ENSEMBLE_SQL},\n{RS.boot_macro('pairs', K, REPS, [])}\nSELECT * FROM bm"


@query
def boot_stratified(spark, sf_dir):
    return inference.bootstrap_delta(_pairs(spark, sf_dir), K, REPS, strata=["true_label"])


SQL["boot_stratified"] = f"WITH RECURSIVE {ENSEMBLE_SQL},\n{RS.boot_accuracy('pairs', REPS, [], ['true_label'])}\nSELECT * FROM ba"


def _wide(spark, sf_dir):
    t = _test(spark, sf_dir)
    e = ensemble.soft_vote(t, K).select("example_id", (F.col("true_label") == F.col("pred_label")).cast("int").alias("ensemble"))
    return ensemble.wide_correct(t, JURORS).join(e, "example_id")


@query
def boot_gain(spark, sf_dir):
    return inference.bootstrap_gain(_wide(spark, sf_dir), JURORS, REPS)


_WIDE = "wide AS (SELECT t.example_id, max((t.true_label = t.pred_label)::INT) FILTER (WHERE juror = 'J1') AS J1, max((t.true_label = t.pred_label)::INT) FILTER (WHERE juror = 'J2') AS J2, max((t.true_label = t.pred_label)::INT) FILTER (WHERE juror = 'J3') AS J3, max((s.true_label = s.pred_label)::INT) AS e FROM test t JOIN soft_eq s ON t.example_id = s.example_id GROUP BY t.example_id)"
SQL["boot_gain"] = f"WITH RECURSIVE {ENSEMBLE_SQL}, {_WIDE},\n{RS.boot_gain('wide', JURORS, REPS, [])}\nSELECT * FROM bg"


@query
def boot_gain_fixed(spark, sf_dir):
    return inference.bootstrap_gain(_wide(spark, sf_dir), JURORS, REPS, rechoose=False)


SQL["boot_gain_fixed"] = f"WITH RECURSIVE {ENSEMBLE_SQL}, {_WIDE},\n{RS.boot_gain('wide', JURORS, REPS, [], rechoose=False)}\nSELECT * FROM bg"


def _discordant(spark, sf_dir):
    right = lambda c: F.col("true_label") == F.col(c)
    return _pairs(spark, sf_dir).agg(F.count_if(right("pred_a") & ~right("pred_b")).alias("b"), F.count_if(~right("pred_a") & right("pred_b")).alias("c"), F.avg(right("pred_a").cast("double")).alias("acc_a"), F.avg(right("pred_b").cast("double")).alias("acc_b"))


@query
def mcnemar(spark, sf_dir):
    return _discordant(spark, sf_dir).select("b", "c", mcnemar_exact(F.col("b"), F.col("c")).alias("p"))


_DISC = "disc AS (SELECT count(*) FILTER (WHERE true_label = pred_a AND true_label <> pred_b) AS b, count(*) FILTER (WHERE true_label <> pred_a AND true_label = pred_b) AS c, avg((true_label = pred_a)::INT) AS acc_a, avg((true_label = pred_b)::INT) AS acc_b FROM pairs)"
SQL["mcnemar"] = f"""WITH {ENSEMBLE_SQL}, {_DISC} SELECT b, c, {r('CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END')} AS p FROM disc"""


@query
def cohen_h(spark, sf_dir):
    return _discordant(spark, sf_dir).select("acc_a", "acc_b", effect_h(F.col("acc_a"), F.col("acc_b")).alias("h"))


SQL["cohen_h"] = f"WITH {ENSEMBLE_SQL}, {_DISC} SELECT {r('acc_a')} AS acc_a, {r('acc_b')} AS acc_b, {r('2 * asin(sqrt(acc_a)) - 2 * asin(sqrt(acc_b))')} AS h FROM disc"


@query
def tost_z(spark, sf_dir):
    return inference.tost(_pairs(spark, sf_dir)).drop("p")


SQL["tost_z"] = f"""WITH {ENSEMBLE_SQL}, d AS (SELECT (true_label = pred_a)::INT - (true_label = pred_b)::INT AS d FROM pairs), t AS (SELECT count(*) AS n, avg(d) AS diff, coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS se FROM d)
SELECT n, {r('diff')} AS diff, {r('se')} AS se, {r('(diff + 0.01) / nullif(se, 0)')} AS z_low, {r('(diff - 0.01) / nullif(se, 0)')} AS z_high, abs(diff) < 0.01 AS inside FROM t"""


@query
def tost_p(spark, sf_dir):
    return inference.tost(_pairs(spark, sf_dir)).select("n", "diff", "p")


SQL["tost_p"] = f"WITH {ENSEMBLE_SQL}, {RS.tost('pairs', [])} SELECT n, {r('diff')} AS diff, {r('p')} AS p FROM tost"


@query
def holm(spark, sf_dir):
    t = _discordant(spark, sf_dir).select(mcnemar_exact(F.col("b"), F.col("c")).alias("m"))
    tests = t.select(F.inline(F.array(F.struct(F.lit("H2").alias("test"), (F.col("m") / 4).alias("p")), F.struct(F.lit("H3").alias("test"), (F.col("m") / 3).alias("p")), F.struct(F.lit("H4").alias("test"), (F.col("m") / 4).alias("p")))))
    return inference.holm(tests.withColumn("family", F.lit("f")), ["family"])


SQL["holm"] = f"""WITH {ENSEMBLE_SQL}, {_DISC}, m AS (SELECT CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS m FROM disc),
t AS (SELECT 'H2' AS test, m / 4 AS p FROM m UNION ALL SELECT 'H3', m / 3 FROM m UNION ALL SELECT 'H4', m / 4 FROM m), k AS (SELECT *, row_number() OVER (ORDER BY p, test)::INT AS rank FROM t)
SELECT test, {r('p')} AS p, 'f' AS family, rank, {r('max(least(1, p * (4 - rank))) OVER (ORDER BY rank)')} AS p_holm FROM k"""


@query
def replication(spark, sf_dir):
    v = lambda d0, d, lo, hi: F.struct(F.lit(d0).alias("d0"), F.lit(d).alias("d"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.inline(F.array(v(0.1, 0.2, 0.1, 0.3), v(0.1, 0.2, -0.1, 0.3), v(0.1, -0.2, -0.3, -0.1))))
    return rows.select("r_regionkey", "d", "lo", inference.replication_verdict(F.col("d0"), F.col("d"), F.col("lo"), F.col("hi")).alias("verdict"))


SQL["replication"] = f"SELECT r_regionkey, {r('d')} AS d, {r('lo')} AS lo, verdict FROM region, (VALUES (0.2, 0.1, 'replicated'), (0.2, -0.1, 'directionally consistent'), (-0.2, -0.3, 'not replicated')) t(d, lo, verdict)"


# --- the four hypotheses, composed
def _analysis(spark, sf_dir, other: str):
    """One row: accuracies and macro-F1 of both systems, permutation p and interval of their macro-F1 difference, McNemar, Cohen's h, TOST."""
    p = _systems(spark, sf_dir, other)
    right = lambda c: F.col("true_label") == F.col(c)
    long = p.select("true_label", F.inline(F.array(*(F.struct(F.lit(s).alias("sys"), F.col(f"pred_{s}").alias("pred_label")) for s in "ab"))))
    f1 = metrics.bundle(long, ["sys"], K).agg(*(F.max(F.when(F.col("sys") == s, F.col("macro_f1"))).alias(f"macro_f1_{s}") for s in "ab"))
    one = p.agg(F.count_if(right("pred_a") & ~right("pred_b")).alias("b"), F.count_if(~right("pred_a") & right("pred_b")).alias("c"), F.avg(right("pred_a").cast("double")).alias("acc_a"), F.avg(right("pred_b").cast("double")).alias("acc_b"))
    one = one.withColumn("mcnemar_p", mcnemar_exact(F.col("b"), F.col("c"))).withColumn("h", effect_h(F.col("acc_a"), F.col("acc_b")))
    test = inference.permutation_macro(p, K, REPS).select("n", "delta", "p")
    ci = inference.bootstrap_delta(p, K, REPS, metric="macro_f1").select("ci_low", "ci_high")
    t = inference.tost(p).select("z_low", "z_high", "inside")
    return one.crossJoin(f1).crossJoin(test).crossJoin(ci).crossJoin(t)  # single rows


_PAIRS = ENSEMBLE_SQL[ENSEMBLE_SQL.index("\npairs AS") :]


def _analysis_sql(other: str) -> str:
    source = "test" if other == "h2" else "soft_eq"
    where = " WHERE juror = 'J1'" if other == "h2" else ""
    pairs = f"\npairs AS (SELECT soft_we.example_id, soft_we.true_label, soft_we.pred_label AS pred_a, o.pred_label AS pred_b FROM soft_we JOIN {source} o ON soft_we.example_id = o.example_id{where})"
    part = lambda name: SQL[name].replace(_PAIRS, pairs)
    return f"""SELECT m.b, m.c, h.acc_a, h.acc_b, m.p AS mcnemar_p, h.h, f.macro_f1_a, f.macro_f1_b, t.n, t.delta, t.p, ci.ci_low, ci.ci_high, z.z_low, z.z_high, z.inside
FROM ({part('mcnemar')}) m, ({part('cohen_h')}) h, ({part('perm_macro')}) t, ({part('boot_macro')}) ci, ({part('tost_z')}) z,
  (WITH {ENSEMBLE_SQL.replace(_PAIRS, pairs)}, l AS (SELECT 'a' AS sys, true_label, pred_a AS pred_label FROM pairs UNION ALL SELECT 'b', true_label, pred_b FROM pairs), {class_sql('l', ['sys'])},
   m AS (SELECT sys, avg(f1) AS f FROM cc GROUP BY sys) SELECT {r("max(f) FILTER (WHERE sys = 'a')")} AS macro_f1_a, {r("max(f) FILTER (WHERE sys = 'b')")} AS macro_f1_b FROM m) f"""


@query
def h2_jury_against_single(spark, sf_dir):
    return _analysis(spark, sf_dir, "h2")


SQL["h2_jury_against_single"] = _analysis_sql("h2")


@query
def h3_weighted_against_equal(spark, sf_dir):
    return _analysis(spark, sf_dir, "h3")


SQL["h3_weighted_against_equal"] = _analysis_sql("h3")


@query
def h2_h3_holm(spark, sf_dir):
    """The primary p values of both hypotheses, adjusted."""
    test = lambda h: inference.permutation_macro(_systems(spark, sf_dir, h), K, REPS).select(F.lit(h).alias("test"), F.round("p", 10).alias("p"), F.lit("f").alias("family"))
    return inference.holm(test("h2").unionByName(test("h3")), ["family"])


SQL["h2_h3_holm"] = f"""WITH t AS (SELECT 'h2' AS test, p, 'f' AS family FROM ({_analysis_sql('h2')}) UNION ALL SELECT 'h3', p, 'f' FROM ({_analysis_sql('h3')})), k AS (SELECT *, row_number() OVER (ORDER BY p, test)::INT AS rank FROM t)
SELECT test, p, family, rank, {r('max(least(1, p * (3 - rank))) OVER (ORDER BY rank)')} AS p_holm FROM k"""


@query
def h4_dependence_against_gain(spark, sf_dir):
    """Each ensemble of the ladder on each split: dependence of errors against the gain over the best member, with its interval."""
    by = ["split_seed", "config"]
    t = stored(ladder_predictions(spark, sf_dir), "ladder")
    e = ensemble.soft_vote(t, K, by=by).select(*by, "example_id", (F.col("true_label") == F.col("pred_label")).cast("int").alias("ensemble"))
    wide = stored(ensemble.wide_correct(t, JURORS, by).join(e, [*by, "example_id"]), "ladder-hits")
    one = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ensemble").alias("acc"), F.greatest(*(F.avg(j) for j in JURORS)).alias("best")).withColumn("gain", F.col("acc") - F.col("best"))
    overlap = F.create_map(*(F.lit(x) for c, (o, _) in LADDER.items() for x in (c, o)))
    errors = ensemble.error_summary(t, JURORS, by).select(*by, "mean_r", "n_defined")
    ci = inference.bootstrap_gain(wide, JURORS, REPS, by=by).select(*by, "ci_low", "ci_high")
    return one.join(errors, by).join(ci, by).withColumn("overlap", overlap[F.col("config")])  # a row for each split and ensemble


_LADDER_R = "(count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(sqrt(((count(*) * sum(x) - sum(x) * sum(x)) * (count(*) * sum(y) - sum(y) * sum(y)))::DOUBLE), 0)"
SQL["h4_dependence_against_gain"] = f"""WITH RECURSIVE {LADDER_SQL}, pr AS ({' UNION ALL '.join(f"SELECT split_seed, config, '{a}{b}' AS pair, {a} AS x, {b} AS y FROM lwide" for a, b in (('J1', 'J2'), ('J1', 'J3'), ('J2', 'J3')))}),
rs AS (SELECT split_seed, config, pair, {_LADDER_R} AS r FROM pr GROUP BY ALL), es AS (SELECT split_seed, config, avg(r) AS mean_r, count(r) AS n_defined FROM rs GROUP BY ALL),
one AS (SELECT split_seed, config, count(*) AS n, avg(e) AS acc, greatest(avg(J1), avg(J2), avg(J3)) AS best FROM lwide GROUP BY ALL),
{RS.boot_gain('lwide', JURORS, REPS, ['split_seed', 'config'], name='ci')}
SELECT one.split_seed, one.config, n, {r('acc')} AS acc, {r('best')} AS best, {r('acc - best')} AS gain, {r('mean_r')} AS mean_r, n_defined, ci_low, ci_high,
  {r('CASE one.config ' + ' '.join(f"WHEN '{c}' THEN {o}" for c, (o, _) in LADDER.items()) + ' END')} AS overlap
FROM one JOIN es ON one.split_seed = es.split_seed AND one.config = es.config JOIN ci ON one.split_seed = ci.split_seed AND one.config = ci.config"""


# --- the jury of two blocks each on every split: validation weights, systems, and the two hypotheses about them
JURY = "two_blocks"
BY_SPLIT = ["split_seed"]


def _jury_by_split(spark, sf_dir):
    """Test predictions and validation weights by split."""
    p = stored(ladder_predictions(spark, sf_dir, (JURY,), 6).drop("config"), "jury")
    scores = metrics.bundle(p.where("part < 8"), [*BY_SPLIT, "juror"], K).select(*BY_SPLIT, "juror", "macro_f1")
    w = stored(ensemble.juror_weights(scores, BY_SPLIT).join(scores, [*BY_SPLIT, "juror"]), "jury-weights")
    return p.where("part >= 8").drop("part"), w


def _systems_by_split(spark, sf_dir):
    """split_seed, example_id, true_label and the predictions of the systems."""
    t, w = _jury_by_split(spark, sf_dir)
    own = lambda df, name: df.select(*BY_SPLIT, "example_id", F.col("pred_label").alias(name))
    weighted = ensemble.soft_vote(t, K, w, BY_SPLIT).select(*BY_SPLIT, "example_id", "true_label", F.col("pred_label").alias("weighted"))
    rest = [own(ensemble.soft_vote(t, K, by=BY_SPLIT), "equal"), own(t.where("juror = 'J1'"), "single"), own(ensemble.hard_vote_any(t, K, BY_SPLIT), "hard")]
    for other in rest:
        weighted = weighted.join(other, [*BY_SPLIT, "example_id"])
    return stored(weighted, "systems-by-split")


_JURY_SQL = f"""{ladder_sql((JURY,), 6)},
lval AS (SELECT * FROM lone WHERE part < 8), {class_sql('lval', ['split_seed', 'juror'], 'lvc')}, lvs AS (SELECT split_seed, juror, avg(f1) AS macro_f1 FROM lvc GROUP BY ALL),
lw AS (SELECT split_seed, juror, macro_f1, exp(macro_f1) / sum(exp(macro_f1)) OVER (PARTITION BY split_seed) AS weight FROM lvs),
lt AS (SELECT lp.*, weight FROM lp JOIN lw ON lp.split_seed = lw.split_seed AND lp.juror = lw.juror WHERE part >= 8),
lm2 AS (SELECT split_seed, example_id, true_label, c, avg(p) AS pe, sum(weight * p) / sum(weight) AS pw FROM lt GROUP BY ALL),
lsoft AS (SELECT split_seed, example_id, true_label, arg_max(c, (pw, -c)) AS weighted, arg_max(c, (pe, -c)) AS equal FROM lm2 GROUP BY ALL),
lhard AS (SELECT split_seed, example_id, max(n) AS n, arg_max(c, (n, -c)) AS c FROM (SELECT split_seed, example_id, pred_label AS c, count(*) AS n FROM lone WHERE part >= 8 GROUP BY ALL) GROUP BY ALL),
lsys AS MATERIALIZED (SELECT s.*, o.pred_label AS single, CASE WHEN h.n >= 2 THEN h.c ELSE s.equal END AS hard FROM lsoft s JOIN lone o ON o.split_seed = s.split_seed AND o.example_id = s.example_id AND o.juror = 'J1'
  JOIN lhard h ON h.split_seed = s.split_seed AND h.example_id = s.example_id)"""


@query
def jury_by_split(spark, sf_dir):
    """Validation macro-F1 and weight of each juror on each split."""
    return _jury_by_split(spark, sf_dir)[1].select("split_seed", "juror", "macro_f1", "weight")


SQL["jury_by_split"] = f"WITH {_JURY_SQL} SELECT split_seed, juror, {r('macro_f1')} AS macro_f1, {r('weight')} AS weight FROM lw"
SYSTEMS = ("weighted", "equal", "single", "hard")


@query
def systems_by_split(spark, sf_dir):
    """The metric bundle of each system on each split; hard votes are the sensitivity analysis."""
    s = _systems_by_split(spark, sf_dir)
    long = s.select("split_seed", "true_label", F.inline(F.array(*(F.struct(F.lit(x).alias("system"), F.col(x).alias("pred_label")) for x in SYSTEMS))))
    return metrics.bundle(long, ["split_seed", "system"], K)


SQL["systems_by_split"] = f"""WITH {_JURY_SQL}, ll AS ({' UNION ALL '.join(f"SELECT split_seed, '{x}' AS system, true_label, {x} AS pred_label FROM lsys" for x in SYSTEMS)}), {class_sql('ll', ['split_seed', 'system'], 'lc')} {bundle_select('lc', ['split_seed', 'system'])}"""


def _by_split(spark, sf_dir, other: str):
    """A row for each split: permutation p and interval of the macro-F1 difference of the weighted jury and another system, McNemar, Cohen's h, TOST."""
    p = _systems_by_split(spark, sf_dir).select(*BY_SPLIT, "example_id", "true_label", F.col("weighted").alias("pred_a"), F.col(other).alias("pred_b"))
    right = lambda c: F.col("true_label") == F.col(c)
    one = p.groupBy(*BY_SPLIT).agg(F.count_if(right("pred_a") & ~right("pred_b")).alias("b"), F.count_if(~right("pred_a") & right("pred_b")).alias("c"), F.avg(right("pred_a").cast("double")).alias("acc_a"), F.avg(right("pred_b").cast("double")).alias("acc_b"))
    one = one.withColumn("mcnemar_p", mcnemar_exact(F.col("b"), F.col("c"))).withColumn("h", effect_h(F.col("acc_a"), F.col("acc_b")))
    test = inference.permutation_macro(p, K, REPS, by=BY_SPLIT).select(*BY_SPLIT, "n", "n_differ", "delta", "p")
    ci = inference.bootstrap_delta(p, K, REPS, metric="macro_f1", by=BY_SPLIT).select(*BY_SPLIT, "ci_low", "ci_high")
    t = inference.tost(p, by=BY_SPLIT).select(*BY_SPLIT, "z_low", "z_high", "inside", F.col("p").alias("tost_p"))
    return one.join(test, BY_SPLIT).join(ci, BY_SPLIT).join(t, BY_SPLIT)  # a row for each split


def _by_split_sql(other: str) -> str:
    mc = "CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"
    return f"""WITH RECURSIVE {_JURY_SQL}, pairs AS MATERIALIZED (SELECT split_seed, example_id, true_label, weighted AS pred_a, {other} AS pred_b FROM lsys),
one AS (SELECT split_seed, count(*) FILTER (WHERE true_label = pred_a AND true_label <> pred_b) AS b, count(*) FILTER (WHERE true_label <> pred_a AND true_label = pred_b) AS c, avg((true_label = pred_a)::INT) AS acc_a, avg((true_label = pred_b)::INT) AS acc_b FROM pairs GROUP BY ALL),
{RS.perm_macro('pairs', K, REPS, BY_SPLIT)},
{RS.boot_macro('pairs', K, REPS, BY_SPLIT)},
{RS.tost('pairs', BY_SPLIT)}
SELECT one.split_seed, b, c, {r('acc_a')} AS acc_a, {r('acc_b')} AS acc_b, {r(mc)} AS mcnemar_p, {r('2 * asin(sqrt(acc_a)) - 2 * asin(sqrt(acc_b))')} AS h, pm.n, n_differ, delta, pm.p, ci_low, ci_high, {r('z_low')} AS z_low, {r('z_high')} AS z_high, inside, {r('tost.p')} AS tost_p
FROM one JOIN pm ON one.split_seed = pm.split_seed JOIN bm ON one.split_seed = bm.split_seed JOIN tost ON one.split_seed = tost.split_seed"""


@query
def h2_by_split(spark, sf_dir):
    return _by_split(spark, sf_dir, "single")


SQL["h2_by_split"] = _by_split_sql("single")


@query
def h3_by_split(spark, sf_dir):
    return _by_split(spark, sf_dir, "equal")


SQL["h3_by_split"] = _by_split_sql("equal")


MODEL_SEEDS = (1, 2, 3)


def _h1_pairs(spark, sf_dir):
    """Strictly eligible test rows of each split for each model seed, with the guesses of two systems."""
    c = corpus(spark, sf_dir)
    x = splits_.assign_roles(c, splits_.author_partitions(c)).where("role = 'test' AND strict").select("split_seed", F.col("id").alias("example_id"), F.col("label").alias("true_label"), F.explode(F.array(*map(F.lit, MODEL_SEEDS))).alias("model_seed"))
    guess = lambda ns: F.when(splits_.order_key(F.col("split_seed"), ns, F.col("model_seed").cast("string"), "example_id") < "c", F.col("true_label")).otherwise("none")
    by = ["split_seed", "model_seed"]
    return stored(x.select(*by, "example_id", "true_label", guess("sys_a").alias("pred_a"), guess("sys_b").alias("pred_b")), "h1")


@query
def h1_overlap_stress(spark, sf_dir):
    """Orders stand in for examples: two systems by hash for each model seed, compared on the strictly eligible test rows of each split."""
    by = ["split_seed", "model_seed"]
    p = _h1_pairs(spark, sf_dir)
    right = lambda c: F.col("true_label") == F.col(c)
    one = p.groupBy(*by).agg(F.avg(right("pred_a").cast("double")).alias("acc_overlap"), F.avg(right("pred_b").cast("double")).alias("acc_clean"), F.count_if(right("pred_a") & ~right("pred_b")).alias("b"), F.count_if(~right("pred_a") & right("pred_b")).alias("c"))
    one = one.withColumn("mcnemar_p", mcnemar_exact(F.col("b"), F.col("c"))).withColumn("h", effect_h(F.col("acc_overlap"), F.col("acc_clean")))
    return one.join(inference.permutation_accuracy(p, REPS, by=by).select(*by, "n", "delta", "p"), by).join(inference.bootstrap_delta(p, K, REPS, by=by).select(*by, "ci_low", "ci_high"), by)  # a row for each split and seed


def _h1_guesses() -> str:
    guess = lambda ns: f"{sql_key(ns, 'model_seed', 'id', seed='split_seed')} < 'c'"
    return f"""g AS (SELECT split_seed, model_seed, id, {guess('sys_a')} AS x, {guess('sys_b')} AS y FROM roles, (SELECT unnest([1, 2, 3])::INT AS model_seed) WHERE role = 'test' AND strict)"""


def _h1_sql() -> str:
    from .surrogates import SPLIT_SQL

    return f"""WITH RECURSIVE {SPLIT_SQL}, {_h1_guesses()},
base AS (SELECT split_seed, model_seed, count(*) AS n, avg(x::INT) AS acc_overlap, avg(y::INT) AS acc_clean, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE y AND NOT x) AS c, sum(x::INT - y::INT) AS d FROM g GROUP BY ALL),
gp AS (SELECT split_seed, model_seed, 1 AS true_label, x::INT AS pred_a, y::INT AS pred_b FROM g),
{RS.perm_accuracy('gp', REPS, ['split_seed', 'model_seed'])},
{RS.boot_accuracy('gp', REPS, ['split_seed', 'model_seed'], name='ci')}
SELECT base.split_seed, base.model_seed, base.n, b, c, {r('acc_overlap')} AS acc_overlap, {r('acc_clean')} AS acc_clean, {r('d / base.n')} AS delta, pa.p, ci_low, ci_high,
  {r('CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END')} AS mcnemar_p,
  {r('2 * asin(sqrt(acc_overlap)) - 2 * asin(sqrt(acc_clean))')} AS h
FROM base JOIN pa ON pa.split_seed = base.split_seed AND pa.model_seed = base.model_seed JOIN ci ON ci.split_seed = base.split_seed AND ci.model_seed = base.model_seed"""


SQL["h1_overlap_stress"] = _h1_sql()


@query
def h1_summary(spark, sf_dir):
    """Of each split: mean and range of the difference over model seeds (descriptive: seeds are no independent units), and whether every run has exactly the
    eligible examples."""
    runs = _h1_pairs(spark, sf_dir).groupBy("split_seed", "model_seed").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("example_id").alias("ids"), (F.avg((F.col("true_label") == F.col("pred_a")).cast("double")) - F.avg((F.col("true_label") == F.col("pred_b")).cast("double"))).alias("delta"))
    c = corpus(spark, sf_dir)
    eligible = splits_.author_partitions(c).where("partition = 'test' AND strict").groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_eligible"))
    per = runs.groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("delta").alias("mean"), F.min("delta").alias("min"), F.max("delta").alias("max"), F.min(F.least("n", "ids")).alias("least_n"), F.max("n").alias("most_n"))
    return per.join(eligible, "split_seed").select("split_seed", "n_runs", "mean", "min", "max", "n_eligible", ((F.col("least_n") == F.col("n_eligible")) & (F.col("most_n") == F.col("n_eligible"))).alias("exact"))


def _h1_summary_sql() -> str:
    from .surrogates import SPLIT_SQL

    return f"""WITH {SPLIT_SQL}, {_h1_guesses()},
d AS (SELECT split_seed, model_seed, count(*) AS n, count(DISTINCT id) AS ids, avg(x::INT) - avg(y::INT) AS delta FROM g GROUP BY ALL),
e AS (SELECT split_seed, count(DISTINCT author) AS n_eligible FROM parts WHERE "partition" = 'test' AND strict GROUP BY ALL)
SELECT d.split_seed, count(*) AS n_runs, {r('avg(delta)')} AS mean, {r('min(delta)')} AS min, {r('max(delta)')} AS max, n_eligible, bool_and(n = n_eligible AND ids = n_eligible) AS exact FROM d JOIN e ON d.split_seed = e.split_seed GROUP BY d.split_seed, n_eligible"""


SQL["h1_summary"] = _h1_summary_sql()


@query
def streaming_confusion(spark, sf_dir):
    """The stream of a stored predictions table, counted incrementally; equal to the batch result."""
    from ..sources.tables import scratch
    from ..streaming.metrics import current_confusion, start_confusion

    path, out = scratch(spark, "predictions"), scratch(spark, "confusion")
    rows = _test(spark, sf_dir).select("juror", "true_label", "pred_label")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    start_confusion(stream, ["juror"], out, scratch(spark, "confusion-log")).awaitTermination()
    updates = spark.read.schema("juror string, true_label int, pred_label int, n bigint, batch int").parquet(out)
    return current_confusion(updates, ["juror"])


SQL["streaming_confusion"] = f"WITH {PRED_SQL} SELECT juror, true_label, pred_label, count(*) AS n FROM preds WHERE part = 'test' GROUP BY ALL"

