"""Data-quality gates: one row of named booleans each.

Checks over ids are counted per id first (map-side combined), so no gate
holds a distinct set in one task. Empty input passes, as ``all()`` would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import SPLITS, GraphShape
from ..functions.columns import all_true, coerce_double, coerce_int, count_where, has_text, require_columns, truth
from ..functions.ordered import with_scalars
from .keys import identical_records, one_row, set_compare


def unique_flag(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(all_true(F.col("_n") == 1).alias(name))


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(truth(c)), F.lit(False))


def _all_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def annotation_checks(annotations: DataFrame) -> DataFrame:
    require_columns(
        annotations, "candidate_id", "match_id", "is_gegenpressing", "annotation_confidence", "annotation_notes", "annotator"
    )
    # as doubles: a fractional label is there, and wrong
    label, confidence = coerce_double("is_gegenpressing"), coerce_double("annotation_confidence")
    blank = label.isNull()
    rows = annotations.agg(
        all_true(~blank).alias("all_annotations_completed"),
        all_true(blank | label.isin(-1, 0, 1)).alias("all_labels_valid"),
        all_true(blank | confidence.isNotNull()).alias("confidence_complete"),
        all_true(blank | truth(confidence.isin(1, 2, 3))).alias("confidence_valid"),
        all_true(~truth(label == -1) | has_text("annotation_notes")).alias("uncertain_have_notes"),
        all_true(blank | has_text("annotator")).alias("annotator_complete"),
    )
    return one_row(rows, unique_flag(annotations, ["candidate_id"], "candidate_id_unique"))


def manifest_checks(manifest: DataFrame) -> DataFrame:
    eligible = F.col("eligible_for_detection_training")
    label = F.col("gegenpressing_label")
    rows = manifest.agg(
        all_true(~eligible | truth(label.isin(0, 1))).alias("only_binary_labels_trainable"),
        all_true(~truth(label == -1) | ~eligible).alias("uncertain_labels_excluded"),
        *[_any(F.col("split") == s).alias(f"_{s}") for s in SPLITS],
        all_true(F.col("split").isin(*SPLITS)).alias("_known"),
    )
    present = _all_of([F.col("_known"), *[F.col(f"_{s}") for s in SPLITS]])
    per_match = manifest.groupBy("match_id").agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    one_split = per_match.agg(all_true(F.col("_a") == F.col("_b")).alias("all_matches_have_one_split"))
    return one_row(
        rows.select(
            "only_binary_labels_trainable", "uncertain_labels_excluded", present.alias("required_splits_present")
        ),
        one_split,
        unique_flag(manifest, ["candidate_id"], "candidate_id_unique"),
    )


def feature_checks(features: DataFrame, expected: DataFrame, names: Sequence[str], banned: Sequence[str]) -> DataFrame:
    finite = F.lit(True)
    for n in names:
        if n in features.columns:
            value = F.col(n).cast("double")
            finite = finite & ~truth(F.abs(value) == float("inf"))
    ids = set_compare(features, expected, ["candidate_id"]).select(F.col("equal").alias("candidate_ids_complete"))
    return one_row(
        unique_flag(features, ["candidate_id"], "candidate_id_unique"),
        ids,
        features.agg(all_true(finite).alias("no_infinite_values")),
    ).withColumns(
        {
            "feature_columns_present": F.lit(set(names) <= set(features.columns)),
            "outcome_not_a_feature": F.lit(not set(banned) & set(names)),
        }
    )


def prediction_checks(preds: DataFrame) -> DataFrame:
    """Twelve cross-model checks."""
    require_columns(preds, "model", "split", "candidate_id", "match_id", "y_true", "probability", "threshold", "y_pred")
    p, limit = F.col("probability"), F.col("threshold")
    y_pred = coerce_int("y_pred")
    rows = preds.agg(
        _any(F.col("split") == "test").alias("test_split_present"),
        all_true(limit.isNotNull()).alias("threshold_present"),
        all_true(F.col("y_true").isin(0, 1)).alias("binary_ground_truth"),
        all_true(p.between(0, 1)).alias("probabilities_in_unit_interval"),
        all_true(y_pred == F.coalesce(p >= limit, F.lit(False)).cast("int")).alias("predictions_match_threshold"),
    )
    per_model = preds.groupBy("model").agg(
        F.min("threshold").alias("_low"),
        F.max("threshold").alias("_high"),
        count_where(limit.isNull()).alias("_none"),
        count_where(limit.isNotNull()).alias("_some"),
        *[_any(F.col("split") == s).alias(f"_{s}") for s in SPLITS],
        all_true(F.col("split").isin(*SPLITS)).alias("_known"),
    )
    single = ((F.col("_some") == 0) & (F.col("_none") > 0)) | ((F.col("_none") == 0) & (F.col("_low") == F.col("_high")))
    splits = _all_of([F.col("_known"), *[F.col(f"_{s}") for s in SPLITS]])
    models = per_model.agg(
        (F.count(F.lit(1)) >= 2).alias("at_least_two_models"),
        all_true(single).alias("one_threshold_per_model"),
        all_true(splits).alias("all_splits_per_model"),
    )
    per_match = preds.groupBy("match_id").agg(
        F.min("split").alias("_a"), F.max("split").alias("_b"), count_where(F.col("split").isNull()).alias("_none")
    )
    one_split = ((F.col("_none") == 0) & (F.col("_a") == F.col("_b"))) | (F.col("_a").isNull())
    return one_row(
        models,
        rows,
        per_match.agg(all_true(one_split).alias("one_split_per_match")),
        unique_flag(preds, ["model", "candidate_id"], "unique_model_candidate_pairs"),
        identical_records(preds, ["candidate_id"]).select(F.col("identical").alias("identical_candidate_sets")),
        identical_records(preds, ["candidate_id", "split", "match_id", "y_true"]).select(
            F.col("identical").alias("identical_candidate_records")
        ),
    )


def _class_counts(dataset: DataFrame) -> list[Column]:
    label = F.col("gegenpressing_label")
    return [
        count_where(F.col("eligible_for_detection_training") & (F.col("split") == s) & (label == y)).alias(f"_{s}_{y}")
        for s in SPLITS
        for y in (0, 1)
    ]


def readiness(annotations: DataFrame, dataset: DataFrame, minimum: int = 5) -> DataFrame:
    cells = [F.col(f"_{s}_{y}") for s in SPLITS for y in (0, 1)]
    label = F.col("gegenpressing_label")
    counts = dataset.agg(
        *_class_counts(dataset),
        all_true(~truth(label == -1) | ~F.col("eligible_for_detection_training")).alias("uncertain_excluded"),
    )
    fewest = F.least(*cells)
    return one_row(
        annotation_checks(annotations),
        counts.select(
            (fewest > 0).alias("both_classes_in_every_split"),
            (fewest >= minimum).alias("minimum_per_class_in_every_split"),
            "uncertain_excluded",
        ),
    )


def graph_checks(shape: DataFrame, expected: DataFrame, want: GraphShape) -> DataFrame:
    ids = set_compare(shape, expected, ["candidate_id"]).select(F.col("equal").alias("candidate_ids_complete"))
    return one_row(
        unique_flag(shape, ["candidate_id"], "candidate_id_unique"),
        ids,
        shape.agg(
            all_true(F.col("frames") == want.frames).alias("all_frames"),
            all_true(F.col("nodes") == want.nodes).alias("all_nodes"),
            all_true(F.col("node_features") == want.features).alias("all_node_features"),
            all_true(
                (F.col("edges_per_frame_min") == want.edges_per_frame)
                & (F.col("edges_per_frame_max") == want.edges_per_frame)
            ).alias("all_edges_per_frame"),
            all_true(F.col("invalid_node_observations") == 0).alias("all_nodes_valid"),
        ),
    )


def queue_checks(queue: DataFrame) -> DataFrame:
    label = coerce_int("is_gegenpressing")
    done = label.isNotNull()
    valid = F.lower(F.col("strict_valid").cast("string")) == "true"
    rows = queue.agg(
        all_true(done & valid).alias("all_strict_valid_completed"),
        (_any(label == 0) & _any(label == 1)).alias("both_classes_present"),
        all_true(~truth(label == -1) | has_text("annotation_notes")).alias("uncertain_have_notes"),
        all_true(~done | coerce_int("annotation_confidence").isNotNull()).alias("confidence_complete"),
        all_true(~done | label.isin(-1, 0, 1)).alias("labels_valid"),
    )
    return one_row(rows, unique_flag(queue, ["candidate_id"], "candidate_id_unique"))


def report_checks(preds: DataFrame, manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Predictions against the frozen manifest and annotations."""
    frozen = manifest.select(
        "candidate_id",
        F.col("match_id").alias("_match"),
        F.col("split").alias("_split"),
        F.col("gegenpressing_label").alias("_label"),
        F.lit(True).alias("_known"),
    )
    models = preds.select("model").distinct()
    # Every model is expected to score every frozen episode.
    n = one_row(
        frozen.agg(F.count(F.lit(1)).alias("_episodes")), models.agg(F.count(F.lit(1)).alias("_models"))
    )
    joined = preds.join(frozen, "candidate_id", "left")
    rows = joined.agg(
        F.count(F.lit(1)).alias("_rows"),
        all_true(F.col("_known")).alias("_all_known"),
        all_true(~truth(F.col("_known")) | truth(F.col("y_true") == F.col("_label"))).alias("labels_aligned"),
        all_true(~truth(F.col("_known")) | truth(F.col("split") == F.col("_split"))).alias("splits_aligned"),
        all_true(~truth(F.col("_known")) | truth(F.col("match_id") == F.col("_match"))).alias("matches_aligned"),
        all_true(F.col("probability").between(0, 1)).alias("probabilities_valid"),
        all_true(F.col("y_pred") == (F.col("probability") >= F.col("threshold")).cast("int")).alias("decisions_match_threshold"),
    )
    labels = manifest.select("candidate_id", "gegenpressing_label").join(
        annotations.select("candidate_id", F.col("is_gegenpressing").alias("_a")), "candidate_id", "left"
    )
    both = one_row(
        rows,
        n,
        unique_flag(preds, ["model", "candidate_id"], "pairs_unique"),
        labels.agg(all_true(F.col("gegenpressing_label").eqNullSafe(F.col("_a"))).alias("labels_equal_annotations")),
    )
    complete = F.col("_all_known") & F.col("pairs_unique") & (F.col("_rows") == F.col("_episodes") * F.col("_models"))
    return both.withColumn("episodes_complete", complete).drop("_rows", "_all_known", "_episodes", "_models")


def protocol_checks(manifest: DataFrame, baseline: DataFrame, graphs: DataFrame, matches: DataFrame) -> DataFrame:
    """``matches`` holds the match_id of every match of the protocol."""
    per_match = manifest.groupBy("match_id").agg(
        count_where(F.col("gegenpressing_label") == 0).alias("_0"), count_where(F.col("gegenpressing_label") == 1).alias("_1")
    )
    return one_row(
        per_match.agg(
            all_true((F.col("_0") > 0) & (F.col("_1") > 0)).alias("both_classes_per_match"),
        ),
        set_compare(manifest, matches, ["match_id"]).select(F.col("equal").alias("expected_matches")),
        set_compare(baseline, manifest, ["candidate_id"]).select(F.col("equal").alias("baseline_coverage_identical")),
        set_compare(graphs, manifest, ["candidate_id"]).select(F.col("equal").alias("graph_coverage_identical")),
    )


def crop_checks(nodes: DataFrame, frames: int, step_us: int) -> DataFrame:
    """Cropped graphs: frame k sits at k steps, all frames there, all nodes valid."""
    at = F.round(F.col("relative_time_s") * (1_000_000 / step_us)).cast("bigint")
    exact = F.abs(F.col("relative_time_s") * 1_000_000 - at * step_us) <= 10
    per_frame = nodes.groupBy("candidate_id", "frame_id").agg(
        F.min(at).alias("_k"), all_true(exact).alias("_exact"), all_true(F.col("valid")).alias("_valid")
    )
    per_episode = per_frame.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_k").alias("_first"),
        F.max("_k").alias("_last"),
        all_true(F.col("_exact")).alias("_exact"),
        all_true(F.col("_valid")).alias("_valid"),
    )
    return per_episode.agg(
        F.count(F.lit(1)).alias("episodes"),
        all_true(F.col("_n") == frames).alias("frame_count_exact"),
        all_true((F.col("_first") == 0) & (F.col("_last") == frames - 1) & F.col("_exact")).alias("times_exact"),
        all_true(F.col("_valid")).alias("masks_complete"),
    )


def answer_checks(answers: DataFrame, expected: DataFrame, role: str, digest: str) -> DataFrame:
    """Answers of one role: complete, valid and given for the source of this digest."""
    person = F.lower(F.trim("person"))
    rows = answers.agg(
        all_true(F.col("label").isin(-1, 0, 1)).alias("labels_valid"),
        all_true(F.col("confidence").isin(1, 2, 3)).alias("confidence_valid"),
        all_true(has_text("notes")).alias("notes_present"),
        all_true(has_text("person")).alias("person_present"),
        all_true(F.try_to_timestamp("utc").isNotNull()).alias("utc_valid"),
        (F.min(person) == F.max(person)).alias("single_person"),
        all_true(F.col("role") == role).alias("role_matches"),
        all_true(F.col("hash") == digest).alias("hash_matches"),
    )
    return one_row(rows, set_compare(answers, expected, ["candidate_id"]).select(F.col("equal").alias("ids_complete")))


def rater_checks(second: DataFrame, earlier: DataFrame) -> DataFrame:
    """The second rater's name (case-folded) is none of the earlier raters' names."""

    def name(df):
        return df.select(F.lower(F.trim("person")).alias("person")).distinct()

    clash = name(second).join(name(earlier), "person", "left_semi")
    return one_row(
        clash.agg((F.count(F.lit(1)) == 0).alias("second_rater_differs")),
        name(second).agg((F.count(F.lit(1)) == 1).alias("one_second_rater")),
    )


def complete_prediction_checks(preds: DataFrame, expected: DataFrame) -> DataFrame:
    """Per model: held-out predictions cover the expected ids exactly once."""
    ids = expected.select("candidate_id", F.lit(1).alias("_known"))
    per_id = preds.groupBy("model", "candidate_id").agg(F.count(F.lit(1)).alias("_n"))
    per_model = per_id.join(ids, "candidate_id", "left").groupBy("model").agg(
        all_true(F.col("_n") == 1).alias("unique"),
        all_true(F.col("_known") == 1).alias("_known"),
        F.count(F.lit(1)).alias("_ids"),
    )
    total = ids.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(per_model, total).select(
        "model", "unique", (F.col("_known") & (F.col("_ids") == F.col("_total"))).alias("complete")
    )


def artifact_checks(
    inventory: DataFrame,
    listed: DataFrame,
    metadata: DataFrame,
    annotations: DataFrame,
    expected_files: Sequence[str],
    critical: Sequence[str],
    expected_models: Sequence[str],
) -> DataFrame:
    """Twelve checks of a finished run.

    ``inventory`` (path, sha256, bytes) of the run folder, ``listed`` (path,
    sha256) from its manifest, ``metadata`` (name, value) as text: the final
    flags, one ``model`` row per evaluated model, and ``check.evaluation.*`` /
    ``check.annotation.*`` results.
    """
    name, value = F.col("name"), F.lower("value")

    def passed(prefix):
        of = name.startswith(prefix)
        return _any(of) & all_true(~of | (value == "true"))

    is_model = name == "model"
    flags = metadata.agg(
        *[
            _any((name == key) & (value == want)).alias(flag)
            for flag, key, want in (
                ("baseline_marked_final", "baseline.final_run", "true"),
                ("graph_model_marked_final", "temporal_gnn.final_run", "true"),
                ("evaluation_marked_final", "evaluation.final_run", "true"),
                ("run_manifest_complete", "status", "final_training_complete"),
                ("summary_marked_final", "summary.status", "final"),
            )
        ],
        passed("check.evaluation.").alias("evaluation_checks_passed"),
        passed("check.annotation.").alias("annotation_checks_passed"),
        (
            all_true(~is_model | F.col("value").isin(*expected_models))
            & _all_of([_any(is_model & (F.col("value") == m)) for m in expected_models])
            & F.lit(len(expected_models) > 0)
        ).alias("expected_models_present"),
    )
    files = inventory.where(F.col("path").isin(*expected_files) & (F.col("bytes") > 0))
    joined = listed.select("path", F.col("sha256").alias("_want")).join(inventory, "path", "left")
    return one_row(
        files.agg(((F.count(F.lit(1)) == len(set(expected_files))) & F.lit(len(expected_files) > 0)).alias("all_expected_files_nonempty")),
        flags,
        listed.where(F.col("path").isin(*critical)).agg(
            ((F.count(F.lit(1)) >= len(set(critical))) & F.lit(len(critical) > 0)).alias("critical_hashes_listed")
        ),
        joined.agg(
            (all_true(F.col("sha256") == F.col("_want")) & (F.count(F.lit(1)) > 0)).alias("artifact_hashes_match")
        ),
        annotations.agg(all_true(coerce_double("is_gegenpressing").isNotNull()).alias("frozen_annotations_complete")),
    )
