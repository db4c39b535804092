"""Classification metrics, thresholds, curves and rater agreement.

Predictions are first counted per (keys, score) with map-side combine, so ties
travel as one row; cumulative counts run over score slices, never over one
task per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import count_where, share, truth, zero_share

LABELS = (-1, 0, 1)


def score_curve(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score, highest first: pos, neg and their running counts tp, fp."""
    y = F.col("y_true") == 1
    hist = (
        preds.groupBy(*keys, "probability")
        .agg(count_where(y).alias("pos"), count_where(~y).alias("neg"))
        .withColumn("_down", -F.col("probability"))
    )
    placed = ordered.with_value_slice(hist, keys, "_down", "_score_slice")
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    return ordered.running_sums(placed, keys, ["_down"], [F.col("_score_slice")], sums).drop("_down", "_score_slice")


def rank_scores(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-aware ROC AUC and step-wise average precision; null without both classes."""
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    pos = F.col("pos").cast("double")  # products of counts pass 64-bit integers
    below = p * n - F.sum(pos * F.col("fp")) + F.sum(pos * F.col("neg")) / F.lit(2.0)
    steps = F.sum(F.col("pos") * share(F.col("tp"), F.col("tp") + F.col("fp")))
    return (
        score_curve(preds, keys)
        .groupBy(*keys)
        .agg(share(below, p * n).alias("roc_auc"), F.when(n > 0, share(steps, p)).alias("average_precision"))
    )


def confusion(preds: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Confusion counts per group, with any further aggregates from the same pass."""
    y, p = F.col("y_true"), F.col("y_pred")
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_where((y == 0) & (p == 0)).alias("tn"),
        count_where((y == 0) & (p == 1)).alias("fp"),
        count_where((y == 1) & (p == 0)).alias("fn"),
        count_where((y == 1) & (p == 1)).alias("tp"),
        *more,
    )


def f1_of(hit: Column, wrong: Column, missed: Column) -> Column:
    return zero_share(hit * 2, hit * 2 + wrong + missed)


def rates() -> dict[str, Column]:
    """Rates of the positive class from the columns tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    return {
        "accuracy": zero_share(tp + tn, total),
        "precision": zero_share(tp, tp + fp),
        "recall": zero_share(tp, tp + fn),
        "f1": f1_of(tp, fp, fn),
        "positive_rate": zero_share(tp + fn, total),
    }


def macro_f1() -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    seen0, seen1 = ((c + fp + fn > 0).cast("int") for c in (tn, tp))
    return share(f1_of(tn, fn, fp) * seen0 + f1_of(tp, fp, fn) * seen1, seen0 + seen1)


def extended_rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    r0, r1 = zero_share(tn, tn + fp), zero_share(tp, tp + fn)
    in_truth = (tn + fp > 0).cast("int") + (tp + fn > 0).cast("int")
    return {
        "recall_0": r0,
        "recall_1": r1,
        "macro_f1": macro_f1(),
        "balanced_accuracy": share(r0 + r1, in_truth),
    }


def classification_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All metrics per group; a group scored with two thresholds is an error."""
    limits = [F.min("threshold").alias("_low"), F.max("threshold").alias("threshold")]
    checked = F.when(
        truth(F.col("_low") == F.col("threshold")), F.col("threshold")
    ).otherwise(F.raise_error(F.lit("one evaluation group has no single threshold")))
    matrix = F.to_json(
        F.array(
            F.array(F.col("tn"), F.col("fp")),
            F.array(F.col("fn"), F.col("tp")),
        )
    )
    return (
        confusion(preds, keys, *limits)
        .withColumns({**rates(), "threshold": checked, "confusion_matrix": matrix})
        .drop("_low")
        .join(rank_scores(preds, keys), list(keys))
    )


def extended_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return classification_metrics(preds, keys).withColumns(extended_rates())


def per_class_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(label, hit, wrong, missed):
        return F.struct(
            F.lit(label).alias("label"),
            zero_share(hit, hit + wrong).alias("precision"),
            zero_share(hit, hit + missed).alias("recall"),
            f1_of(hit, wrong, missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    return confusion(preds, keys).select(*keys, F.inline(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))))


def pr_roc_curves(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One point per distinct score: predictions at or above it are positive."""
    curve = score_curve(preds, keys)
    total = preds.groupBy(*keys).agg(
        count_where(F.col("y_true") == 1).alias("_p"), count_where(F.col("y_true") == 0).alias("_n")
    )
    return curve.join(total, list(keys)).select(
        *keys,
        F.col("probability").alias("threshold"),
        share(F.col("fp"), F.col("_n")).alias("fpr"),
        share(F.col("tp"), F.col("_p")).alias("tpr"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("_p")).alias("recall"),
    )


def best_f1_threshold(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score with the highest F1 per group; of equals the lowest one."""
    total = scores.groupBy(*keys).agg(count_where(F.col("y_true") == 1).alias("_p"))
    f1 = F.round(zero_share(F.col("tp") * 2, F.col("tp") + F.col("fp") + F.col("_p")), 12)
    return (
        score_curve(scores, keys)
        .join(total, list(keys))
        .groupBy(*keys)
        .agg(F.max_by("probability", F.struct(f1, -F.col("probability"))).alias("threshold"))
    )


def validation_threshold(scores: DataFrame) -> DataFrame:
    """Threshold per model from its validation rows; 0.5 where there are none."""
    best = best_f1_threshold(scores.where(F.col("split") == "validation"), ["model"])
    return (
        scores.select("model")
        .distinct()
        .join(best, "model", "left")
        .select("model", F.coalesce("threshold", F.lit(0.5)).alias("threshold"))
    )


def macro_f1_threshold(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid .01 .. .99 by macro-F1; ties go to the value nearest .50, then to the lower.

    Each row is placed between two grid points once, so the sweep runs over at
    most 100 counted cells per group instead of 99 copies of every row.
    """
    p = F.col("probability")
    guess = F.floor(p * 100)
    cell = F.when((guess + 1) / F.lit(100.0) <= p, guess + 1).when(guess / F.lit(100.0) > p, guess - 1).otherwise(guess)
    cells = scores.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(99), cell)).cast("int").alias("_cell")).agg(
        count_where(F.col("y_true") == 1).alias("_pos"), count_where(F.col("y_true") == 0).alias("_neg")
    )
    marks = cells.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(99))).alias("_cell"))
    filled = marks.unionByName(cells, allowMissingColumns=True)
    filled = filled.groupBy(*keys, "_cell").agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("_pos"), F.coalesce(F.sum("_neg"), F.lit(0)).alias("_neg")
    )
    up = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    swept = (
        filled.withColumns({"tp": F.sum("_pos").over(up), "fp": F.sum("_neg").over(up)})
        .withColumns({"fn": F.sum("_pos").over(whole) - F.col("tp"), "tn": F.sum("_neg").over(whole) - F.col("fp")})
        .where(F.col("_cell") >= 1)
    )
    # The sweep always averages both classes, also one that never occurs.
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    both = (f1_of(tn, fn, fp) + f1_of(tp, fp, fn)) / 2
    best = F.struct(F.round(both, 12), -F.abs(F.col("_cell") - 50), -F.col("_cell"))
    return swept.groupBy(*keys).agg((F.max_by("_cell", best) / F.lit(100.0)).alias("threshold"))


def predict(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions at each model's threshold; a model without one is an error, not a lost model."""
    threshold = F.when(F.col("threshold").isNotNull(), F.col("threshold")).otherwise(
        F.raise_error(F.concat(F.lit("no threshold for the model: "), F.col("model")))
    )
    return scores.join(thresholds, "model", "left").withColumn("threshold", threshold).withColumn(
        "y_pred", (F.col("probability") >= F.col("threshold")).cast("int")
    )


def top_errors(preds: DataFrame, n: int = 5) -> DataFrame:
    """Most confident false positives and false negatives per model."""
    wrong = preds.where(F.col("y_true") != F.col("y_pred")).withColumn(
        "error_type", F.when(F.col("y_pred") == 1, "FP").otherwise("FN")
    )
    sure = F.when(F.col("y_pred") == 1, -F.col("probability")).otherwise(F.col("probability"))
    w = Window.partitionBy("model", "error_type").orderBy(sure, "candidate_id")
    return wrong.withColumn("error_rank", F.row_number().over(w)).where(F.col("error_rank") <= n)


def metric_reconcile(computed: DataFrame, stored: DataFrame, keys: Sequence[str], names: Sequence[str], tol=1e-10):
    """Per (keys, metric): both values and whether they agree; a missing side disagrees."""

    def long(df, value):
        return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
            list(keys), list(names), "metric", value
        )

    a, b = F.col("computed"), F.col("stored")
    both = long(computed, "computed").join(long(stored, "stored"), [*keys, "metric"], "full_outer")
    return both.withColumn("agrees", truth(F.abs(a - b) <= tol) | (a.isNull() & b.isNull()))


def error_context(preds: DataFrame, annotations: DataFrame) -> DataFrame:
    wrong = preds.where(F.col("y_true") != F.col("y_pred")).select(
        "model",
        "candidate_id",
        "probability",
        F.when(F.col("y_pred") == 1, "FP").otherwise("FN").alias("error_type"),
    )
    context = annotations.select("candidate_id", "annotation_confidence", "annotation_notes", "annotator")
    return wrong.join(context, "candidate_id", "left")


def majority_baseline(manifest: DataFrame, label="gegenpressing_label") -> DataFrame:
    """Most frequent train label (lowest on a tie) applied to the test split.

    As a score it is the train share of positives for every row, so all rows tie:
    the ROC AUC is one half and the average precision the test share of
    positives; both are null without both classes in the test split.
    """
    y, test = F.col(label), F.col("split") == "test"
    train = F.col("split") == "train"
    counts = manifest.agg(
        count_where(train & (y == 0)).alias("_t0"),
        count_where(train & (y == 1)).alias("_t1"),
        count_where(test & (y == 0)).alias("_n0"),
        count_where(test & (y == 1)).alias("_n1"),
    )
    guess = (F.col("_t1") > F.col("_t0")).cast("int")
    zero = F.lit(0).cast("bigint")
    cells = counts.select(
        guess.alias("majority_label"),
        share(F.col("_t1"), F.col("_t0") + F.col("_t1")).alias("train_positive_rate"),
        (F.col("_n0") + F.col("_n1")).alias("n"),
        F.when(guess == 0, F.col("_n0")).otherwise(zero).alias("tn"),
        F.when(guess == 1, F.col("_n0")).otherwise(zero).alias("fp"),
        F.when(guess == 0, F.col("_n1")).otherwise(zero).alias("fn"),
        F.when(guess == 1, F.col("_n1")).otherwise(zero).alias("tp"),
    )
    zeros, ones = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    both = (zeros > 0) & (ones > 0)
    ranks = {"roc_auc": F.when(both, F.lit(0.5)), "average_precision": F.when(both, share(ones, F.col("n")))}
    return cells.withColumns({**rates(), **extended_rates(), **ranks}).drop("recall")


def rater_agreement(pairs: DataFrame, first="rater_1", second="rater_2") -> DataFrame:
    """Observed agreement and Cohen's kappa over the labels -1, 0, 1."""
    a, b = F.col(first), F.col(second)
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(a == b).alias("_same"),
        *[count_where(a == v).alias(f"_a{i}") for i, v in enumerate(LABELS)],
        *[count_where(b == v).alias(f"_b{i}") for i, v in enumerate(LABELS)],
    )
    n = F.col("n").cast("double")
    po = share(F.col("_same"), n)
    pe = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(1, len(LABELS))), F.col("_a0") * F.col("_b0")) / (n * n)
    return sums.select("n", po.alias("agreement"), share(po - pe, 1 - pe).alias("kappa"))


def paired_delta(scores: DataFrame, models: tuple[str, str], value="macro_f1") -> DataFrame:
    """Per match the value of both models and their difference, plus an equal-weight mean row."""
    a, b = models
    wide = scores.groupBy("match_id").agg(
        F.max(F.when(F.col("model") == a, F.col(value))).alias(a),
        F.max(F.when(F.col("model") == b, F.col(value))).alias(b),
    )
    wide = wide.withColumn("delta", F.col(b) - F.col(a))
    mean = wide.agg(F.lit("MEAN").alias("match_id"), *[F.avg(c).alias(c) for c in (a, b, "delta")])
    return wide.unionByName(mean)


def match_comparison(preds: DataFrame) -> DataFrame:
    """Per (match, model): confusion, class recalls, macro-F1 and AUC."""
    keys = ["match_id", "model"]
    return (
        confusion(preds, keys)
        .withColumns(extended_rates())
        .drop("balanced_accuracy")
        .join(rank_scores(preds, keys).drop("average_precision"), keys)
    )


def test_report(preds: DataFrame, digits: int = 4) -> DataFrame:
    """Test metrics per model, overall and per match, as text; missing values read n/a."""
    test = preds.where(F.col("split") == "test")
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]
    overall = classification_metrics(test, ["model"]).withColumn("match_id", F.lit("ALL"))
    by_match = classification_metrics(test, ["model", "match_id"])
    fixed = [
        F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", F.col(c))).alias(c) for c in names
    ]
    return overall.unionByName(by_match).select("model", "match_id", "n", *fixed)
