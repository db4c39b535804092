"""Metrics over scored documents."""

# ruff: noqa: E501

from pyspark.sql import functions as F

from ..operators import metrics
from ..session import shared_file
from ..sources import tables
from .registry import query, view

R9 = lambda df, *cols: df.withColumns({c: F.round(c, 9) for c in cols})
KEYS = ["model", "split"]

view("fx_rank", """
SELECT model, split, CASE WHEN p * n > 0 THEN auc / (p * n) END AS roc_auc, CASE WHEN p > 0 THEN ap / p END AS average_precision FROM (
  SELECT model, split, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(pos * (below + neg / 2.0::DOUBLE)) AS auc,
         sum(pos * tp / (tp + fp)::DOUBLE) AS ap
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, split ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
               sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT model, split, probability, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos,
                     sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END)::DOUBLE AS neg FROM fx_predictions GROUP BY ALL)
        WINDOW w AS (PARTITION BY model, split ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))
  GROUP BY model, split)""")
view("fx_metrics", """
SELECT model, split, n, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp,
       round((tp + tn) / n, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1,
       round((tp + fn) / n, 9) AS positive_rate, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision
FROM fx_counts JOIN fx_rank USING (model, split)""")
COUNTS_BY = """
SELECT model, match_id, any_value(split) AS split, count(*) AS n, sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn,
       sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
       sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
       sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp
FROM fx_predictions GROUP BY model, match_id"""
view("fx_match_counts", COUNTS_BY)
view("fx_match_rank", """
SELECT a.model, a.match_id, sum(CASE WHEN a.probability > b.probability THEN 1 WHEN a.probability = b.probability THEN 0.5 ELSE 0 END)::DOUBLE
       / count(*) AS roc_auc
FROM fx_predictions a JOIN fx_predictions b ON a.model = b.model AND a.match_id = b.match_id AND a.y_true = 1 AND b.y_true = 0
GROUP BY a.model, a.match_id""")
view("fx_match_ap", """
SELECT model, match_id, sum(hits * tp / (tp + fp)) / sum(hits) AS average_precision FROM (
  SELECT *, sum(hits) OVER w AS tp, sum(miss) OVER w AS fp FROM (
    SELECT model, match_id, probability, sum(y_true)::DOUBLE AS hits, sum(1 - y_true)::DOUBLE AS miss FROM fx_predictions GROUP BY ALL)
  WINDOW w AS (PARTITION BY model, match_id ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))
GROUP BY model, match_id HAVING sum(hits) > 0 AND sum(miss) > 0""")
view("fx_macro", """
SELECT *, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_,
       CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1
FROM fx_match_counts""")
view("fx_match_scores", """
SELECT match_id, model, split, n, tn, fp, fn, tp, r0, r1,
       (CASE WHEN tn + fp + fn > 0 THEN f0 ELSE 0 END + CASE WHEN tp + fp + fn > 0 THEN f1_ ELSE 0 END)
       / (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) AS macro_f1
FROM fx_macro""")


@query("union_predictions", "SELECT model, candidate_id, split, probability FROM fx_scores")
def _(s):
    # written as one folder of files per model, with columns in different orders, and read as one table
    paths = []
    for model, cols in (("m1", ["model", "candidate_id", "split", "probability"]), ("m2", ["probability", "split", "model", "candidate_id", "match_id"])):
        paths.append(shared_file(s.spark, "predictions"))
        tables.write_csv(s.scores.where(F.col("model") == model).select(*cols), paths[-1])
    return tables.read_predictions(s.spark, paths).select("model", "candidate_id", "split", "probability")


@query("threshold_f1", "SELECT model, threshold FROM fx_threshold")
def _(s):
    return metrics.validation_threshold(s.scores)


@query("threshold_macro_f1", """
WITH g AS (SELECT model, k, sum(CASE WHEN y_true = 1 AND probability >= k / 100.0::DOUBLE THEN 1 ELSE 0 END)::DOUBLE AS tp,
             sum(CASE WHEN y_true = 0 AND probability >= k / 100.0::DOUBLE THEN 1 ELSE 0 END)::DOUBLE AS fp,
             sum(CASE WHEN y_true = 1 AND probability < k / 100.0::DOUBLE THEN 1 ELSE 0 END)::DOUBLE AS fn,
             sum(CASE WHEN y_true = 0 AND probability < k / 100.0::DOUBLE THEN 1 ELSE 0 END)::DOUBLE AS tn
           FROM fx_scores, range(1, 100) r(k) WHERE split = 'validation' GROUP BY model, k),
     m AS (SELECT model, k, (2 * tn / greatest(2 * tn + fp + fn, 1) + 2 * tp / greatest(2 * tp + fp + fn, 1)) / 2 AS f FROM g)
SELECT model, k / 100.0::DOUBLE AS threshold FROM m
QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f, 12) DESC, abs(k - 50), k) = 1""")
def _(s):
    return metrics.macro_f1_threshold(s.scores.where(F.col("split") == "validation"), ["model"])


@query("score_threshold", "SELECT model, candidate_id, split, match_id, y_true, probability, threshold, y_pred FROM fx_predictions")
def _(s):
    return s.predictions.select("model", "candidate_id", "split", "match_id", "y_true", "probability", "threshold", "y_pred")


RATES = ["accuracy", "precision", "recall", "f1", "positive_rate"]


@query("classification_metrics", """
SELECT model, split, n, tn, fp, fn, tp, accuracy, precision, recall, f1, positive_rate FROM fx_metrics""")
def _(s):
    out = metrics.confusion(s.predictions, KEYS).withColumns(metrics.rates())
    return R9(out, *RATES)


@query("roc_auc", "SELECT model, split, round(roc_auc, 9) AS roc_auc FROM fx_rank")
def _(s):
    return R9(metrics.rank_scores(s.predictions, KEYS).select(*KEYS, "roc_auc"), "roc_auc")


@query("average_precision", "SELECT model, split, round(average_precision, 9) AS average_precision FROM fx_rank")
def _(s):
    return R9(metrics.rank_scores(s.predictions, KEYS).select(*KEYS, "average_precision"), "average_precision")


@query("extended_metrics", """
SELECT model, split, round(tn / greatest(tn + fp, 1), 9) AS recall_0, round(tp / greatest(tp + fn, 1), 9) AS recall_1,
       round((2 * tn / greatest(2 * tn + fp + fn, 1) + 2 * tp / greatest(2 * tp + fp + fn, 1)) / 2, 9) AS macro_f1,
       round((tn / greatest(tn + fp, 1) + tp / greatest(tp + fn, 1)) / 2, 9) AS balanced_accuracy
FROM fx_counts""")
def _(s):
    names = ["recall_0", "recall_1", "macro_f1", "balanced_accuracy"]
    out = metrics.confusion(s.predictions, KEYS).withColumns(metrics.extended_rates())
    return R9(out.select(*KEYS, *names), *names)


@query("per_class_metrics", """
SELECT model, split, 0 AS label, round(tn / greatest(tn + fn, 1), 9) AS precision, round(tn / greatest(tn + fp, 1), 9) AS recall,
       round(2 * tn / greatest(2 * tn + fp + fn, 1), 9) AS f1, (tn + fp)::BIGINT AS support FROM fx_counts
UNION ALL
SELECT model, split, 1, round(tp / greatest(tp + fp, 1), 9), round(tp / greatest(tp + fn, 1), 9),
       round(2 * tp / greatest(2 * tp + fp + fn, 1), 9), (tp + fn)::BIGINT FROM fx_counts""")
def _(s):
    return R9(metrics.per_class_metrics(s.predictions, KEYS), "precision", "recall", "f1")


@query("pr_roc_curves", """
WITH h AS (SELECT model, probability, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM fx_predictions
           WHERE split = 'test' GROUP BY ALL),
     c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS p, sum(neg) OVER t AS n FROM h
           WINDOW w AS (PARTITION BY model ORDER BY probability DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY model))
SELECT model, probability AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr, round(tp / (tp + fp), 9) AS precision,
       round(tp / p, 9) AS recall FROM c""")
def _(s):
    out = metrics.pr_roc_curves(s.predictions.where(F.col("split") == "test"), ["model"])
    return R9(out, "fpr", "tpr", "precision", "recall")


@query("top_errors", """
SELECT model, error_type, candidate_id, probability, CAST(rn AS INT) AS error_rank FROM (
  SELECT *, CASE WHEN y_pred = 1 THEN 'FP' ELSE 'FN' END AS error_type,
         row_number() OVER (PARTITION BY model, y_pred ORDER BY CASE WHEN y_pred = 1 THEN -probability ELSE probability END, candidate_id) AS rn
  FROM fx_predictions WHERE y_true <> y_pred AND split = 'test')
WHERE rn <= 5""")
def _(s):
    return metrics.top_errors(s.predictions.where(F.col("split") == "test")).select(
        "model", "error_type", "candidate_id", "probability", "error_rank"
    )


@query("metric_reconcile", """
WITH w AS (SELECT model, split, (tp + tn) / n AS accuracy, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM fx_counts),
     u AS (UNPIVOT w ON accuracy, precision, recall INTO NAME metric VALUE v),
     st AS (SELECT model, split, metric, CASE WHEN model = 'm2' AND metric = 'recall' THEN v + 0.001 ELSE v END AS stored FROM u)
SELECT model, split, metric, round(u.v, 9) AS computed, round(stored, 9) AS stored, abs(v - stored) <= 1e-10 AS agrees
FROM u JOIN st USING (model, split, metric)""")
def _(s):
    computed = metrics.confusion(s.predictions, KEYS).withColumns(metrics.rates())
    drift = F.when(F.col("model") == "m2", F.col("recall") + 0.001).otherwise(F.col("recall"))
    out = metrics.metric_reconcile(
        computed, computed.withColumn("recall", drift), KEYS, ["accuracy", "precision", "recall"]
    )
    return R9(out, "computed", "stored")


@query("error_context", """
SELECT p.model, p.candidate_id, p.probability, CASE WHEN p.y_pred = 1 THEN 'FP' ELSE 'FN' END AS error_type,
       a.annotation_confidence, a.annotation_notes, a.annotator
FROM fx_predictions p LEFT JOIN fx_annotations a USING (candidate_id) WHERE p.y_true <> p.y_pred""")
def _(s):
    return metrics.error_context(s.predictions, s.annotations)


@query("majority_baseline", """
WITH c AS (SELECT sum(CASE WHEN split = 'train' THEN 1 - y ELSE 0 END) AS t0, sum(CASE WHEN split = 'train' THEN y ELSE 0 END) AS t1,
                  sum(CASE WHEN split = 'test' THEN 1 - y ELSE 0 END)::BIGINT AS n0, sum(CASE WHEN split = 'test' THEN y ELSE 0 END)::BIGINT AS n1
           FROM (SELECT split, gegenpressing_label AS y FROM fx_manifest WHERE eligible_for_detection_training)),
     g AS (SELECT *, CASE WHEN t1 > t0 THEN 1 ELSE 0 END AS guess FROM c)
SELECT guess AS majority_label, round(t1::DOUBLE / (t0 + t1), 9) AS train_positive_rate, n0 + n1 AS n,
       CASE WHEN guess = 0 THEN n0 ELSE 0 END AS tn, CASE WHEN guess = 1 THEN n0 ELSE 0 END AS fp,
       CASE WHEN guess = 0 THEN n1 ELSE 0 END AS fn, CASE WHEN guess = 1 THEN n1 ELSE 0 END AS tp,
       round(CASE WHEN guess = 1 THEN n1 ELSE n0 END::DOUBLE / (n0 + n1), 9) AS accuracy, 0.5::DOUBLE AS balanced_accuracy,
       CASE WHEN n0 > 0 AND n1 > 0 THEN 0.5::DOUBLE END AS roc_auc, CASE WHEN n0 > 0 AND n1 > 0 THEN round(n1::DOUBLE / (n0 + n1), 9) END AS average_precision
FROM g""")
def _(s):
    eligible = s.manifest.where("eligible_for_detection_training")
    names = ["train_positive_rate", "accuracy", "balanced_accuracy", "roc_auc", "average_precision"]
    out = metrics.majority_baseline(eligible).select("majority_label", "n", "tn", "fp", "fn", "tp", *names)
    return R9(out, *names)


@query("rater_agreement", """
WITH t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE rater_1 = rater_2) AS same FROM fx_raters),
     e AS (SELECT sum(a * b)::DOUBLE AS s FROM (SELECT v, (SELECT count(*) FROM fx_raters WHERE rater_1 = v) AS a,
             (SELECT count(*) FROM fx_raters WHERE rater_2 = v) AS b FROM (VALUES (-1), (0), (1)) x(v)))
SELECT n::BIGINT AS n, round(same / n, 9) AS agreement, round((same / n - s / (n * n)) / (1 - s / (n * n)), 9) AS kappa FROM t, e""")
def _(s):
    return R9(metrics.rater_agreement(s.raters), "agreement", "kappa")


@query("match_metrics", """
SELECT c.model, c.split, c.match_id, c.n, round((tp + tn) / c.n, 9) AS accuracy, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) AS f1,
       round(r.roc_auc, 9) AS roc_auc, round(a.average_precision, 9) AS average_precision, t.threshold,
       '[[' || tn::BIGINT || ',' || fp::BIGINT || '],[' || fn::BIGINT || ',' || tp::BIGINT || ']]' AS confusion_matrix
FROM fx_match_counts c JOIN fx_threshold t USING (model) LEFT JOIN fx_match_rank r USING (model, match_id)
LEFT JOIN fx_match_ap a USING (model, match_id)""")
def _(s):
    out = metrics.classification_metrics(s.prediction_files, ["model", "split", "match_id"])
    cols = ["model", "split", "match_id", "n", "accuracy", "f1", "roc_auc", "average_precision", "threshold", "confusion_matrix"]
    return R9(out.select(*cols), "accuracy", "f1", "roc_auc", "average_precision")


@query("match_comparison", """
SELECT s.match_id, s.model, n, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp,
       round(r0, 9) AS recall_0, round(r1, 9) AS recall_1, round(macro_f1, 9) AS macro_f1, round(roc_auc, 9) AS roc_auc
FROM fx_match_scores s LEFT JOIN fx_match_rank r USING (model, match_id)""")
def _(s):
    return R9(metrics.match_comparison(s.prediction_files), "recall_0", "recall_1", "macro_f1", "roc_auc")


@query("paired_delta", """
WITH p AS (SELECT match_id, max(CASE WHEN model = 'm1' THEN macro_f1 END) AS m1, max(CASE WHEN model = 'm2' THEN macro_f1 END) AS m2
           FROM fx_match_scores GROUP BY match_id)
SELECT match_id, round(m1, 9) AS m1, round(m2, 9) AS m2, round(m2 - m1, 9) AS delta FROM p
UNION ALL SELECT 'MEAN', round(avg(m1), 9), round(avg(m2), 9), round(avg(m2 - m1), 9) FROM p""")
def _(s):
    scored = metrics.confusion(s.predictions, ["match_id", "model"]).withColumns(metrics.extended_rates())
    return R9(metrics.paired_delta(scored, ("m1", "m2")), "m1", "m2", "delta")


@query("test_report", """
WITH a AS (SELECT model, 'ALL' AS match_id, n, (tp + tn) / n AS accuracy, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall,
             2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, roc_auc, average_precision FROM fx_counts JOIN fx_rank USING (model, split) WHERE split = 'test'
           UNION ALL
           SELECT c.model, c.match_id, c.n, (tp + tn) / c.n, tp / greatest(tp + fp, 1), tp / greatest(tp + fn, 1),
             2 * tp / greatest(2 * tp + fp + fn, 1), r.roc_auc, p.average_precision
           FROM fx_match_counts c LEFT JOIN fx_match_rank r USING (model, match_id) LEFT JOIN fx_match_ap p USING (model, match_id) WHERE c.split = 'test')
SELECT model, match_id, n, coalesce(printf('%.4f', accuracy), 'n/a') AS accuracy, coalesce(printf('%.4f', precision), 'n/a') AS precision,
       coalesce(printf('%.4f', recall), 'n/a') AS recall, coalesce(printf('%.4f', f1), 'n/a') AS f1,
       coalesce(printf('%.4f', roc_auc), 'n/a') AS roc_auc, coalesce(printf('%.4f', average_precision), 'n/a') AS average_precision FROM a""")
def _(s):
    return metrics.test_report(s.prediction_files)
