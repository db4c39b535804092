"""Metrics, thresholds, agreement, labels, samples and gates on hand-made rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pressline.operators import gates, keys, labels, metrics, profile, sampling

PRED = "model string, split string, candidate_id string, match_id string, y_true int, probability double, threshold double, y_pred int"


def preds(spark, rows, model="m", split="test", threshold=0.5):
    data = [(model, split, f"c{i}", "g", y, p, threshold, int(p >= threshold)) for i, (y, p) in enumerate(rows)]
    return spark.createDataFrame(data, PRED)


def test_two_point_metrics(spark):
    r = metrics.classification_metrics(preds(spark, [(0, 0.2), (1, 0.8)]), ["model"]).first()
    assert (r.f1, r.roc_auc, r.average_precision, r.threshold) == (1.0, 1.0, 1.0, 0.5)
    assert r.confusion_matrix == "[[1,0],[0,1]]"


def test_rank_scores_equal_pair_count(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.choice([0.0, 0.1, 0.25, 0.5, 0.9, 1.0, rng.random()])) for _ in range(120)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted({p for _, p in rows}, reverse=True):
        hit = sum(p == s for p in pos)
        ap += hit / len(pos) * sum(p >= s for p in pos) / sum(p >= s for _, p in rows)
    r = metrics.rank_scores(preds(spark, rows), ["model"]).first()
    assert abs(r.roc_auc - auc) < 1e-12 and abs(r.average_precision - ap) < 1e-12


def test_one_class_has_no_rank_scores(spark):
    r = metrics.rank_scores(preds(spark, [(1, 0.2), (1, 0.8)]), ["model"]).first()
    assert r.roc_auc is None and r.average_precision is None


def test_mixed_thresholds_are_an_error(spark):
    df = preds(spark, [(0, 0.2), (1, 0.8)]).unionByName(preds(spark, [(1, 0.7)], threshold=0.6))
    with pytest.raises(Exception, match="no single threshold"):
        metrics.classification_metrics(df, ["model"]).collect()


def test_threshold_ties_take_the_lowest_score(spark):
    # Scores .3 and .6 both reach F1 2/3.
    df = preds(spark, [(0, 0.3), (1, 0.4), (1, 0.6), (0, 0.35)])
    f1 = {}
    for s in (0.3, 0.35, 0.4, 0.6):
        tp = sum(p >= s for p in (0.4, 0.6))
        fp = sum(p >= s for p in (0.3, 0.35))
        f1[s] = 2 * tp / (tp + fp + 2)
    best = min(s for s in f1 if f1[s] == max(f1.values()))
    assert metrics.best_f1_threshold(df, ["model"]).first().threshold == best
    empty = metrics.validation_threshold(df).first()
    assert empty.threshold == 0.5


def test_macro_threshold_prefers_the_middle(spark):
    df = preds(spark, [(0, 0.2), (1, 0.8)])
    assert metrics.macro_f1_threshold(df, ["model"]).first().threshold == 0.5
    high = preds(spark, [(0, 0.6), (1, 0.9)])
    assert metrics.macro_f1_threshold(high, ["model"]).first().threshold == 0.61


def test_kappa_of_a_known_table(spark):
    cells = {(1, 1): 20, (1, 0): 5, (0, 1): 10, (0, 0): 15}
    rows = [k for k, n in cells.items() for _ in range(n)]
    r = metrics.rater_agreement(spark.createDataFrame(rows, "rater_1 int, rater_2 int")).first()
    assert r.n == 50 and abs(r.agreement - 0.7) < 1e-12 and abs(r.kappa - 0.4) < 1e-12


ANN = "candidate_id string, match_id string, is_gegenpressing int, annotation_confidence int, annotation_notes string, annotator string"


def annotations(spark, rows):
    return spark.createDataFrame([(f"c{i}", "g", *r) for i, r in enumerate(rows)], ANN)


def test_uncertain_needs_a_note(spark):
    good = gates.annotation_checks(annotations(spark, [(1, 3, None, "a"), (-1, 2, "why", "a")])).first().asDict()
    assert all(good.values())
    bad = gates.annotation_checks(annotations(spark, [(1, 3, None, "a"), (-1, 2, " ", "a")])).first()
    assert not bad.uncertain_have_notes and bad.all_annotations_completed
    empty = gates.annotation_checks(annotations(spark, [])).first().asDict()
    assert all(empty.values())


def test_review_queue_is_blinded(spark):
    ann = annotations(spark, [(-1, 2, "n", "a"), (1, 3, "", "a"), (0, 1, "", "a")])
    manifest = spark.createDataFrame([(f"c{i}", "train") for i in range(3)], "candidate_id string, split string")
    out = labels.review_queue(ann, manifest)
    assert {r.candidate_id: r.review_reason for r in out.collect()} == {"c0": "uncertain", "c2": "low_confidence"}
    assert not set(out.columns) & set(labels.OUTCOME_COLUMNS)


def test_annotation_outside_the_manifest_is_an_error(spark):
    ann = annotations(spark, [(-1, 2, "n", "a")])
    manifest = spark.createDataFrame([("other", "train")], "candidate_id string, split string")
    with pytest.raises(Exception, match="annotation without split"):
        labels.annotation_summary(ann, manifest).collect()


def test_prediction_gate(spark):
    a = preds(spark, [(0, 0.2), (1, 0.8)], "a")
    checks = gates.prediction_checks(a.unionByName(preds(spark, [(0, 0.2)], "b"))).first()
    assert not checks.identical_candidate_sets and checks.one_threshold_per_model and checks.at_least_two_models
    assert not checks.all_splits_per_model and checks.test_split_present
    mixed = a.unionByName(preds(spark, [(0, 0.2), (1, 0.8)], "b")).unionByName(preds(spark, [(1, 0.7)], "b", threshold=0.6))
    checks = gates.prediction_checks(mixed).first()
    assert not checks.one_threshold_per_model and not checks.unique_model_candidate_pairs


def test_unknown_match_is_an_error(spark):
    df = spark.createDataFrame([("c", "x")], "candidate_id string, match_id string")
    table = spark.createDataFrame([("y", "train")], "match_id string, split string")
    with pytest.raises(Exception, match="match without split"):
        labels.assign_split(df, table).collect()
    with pytest.raises(Exception, match="match without split"):
        labels.assign_fixed_split(df).collect()
    known = spark.createDataFrame([("J03WQQ",), ("J03WPY",), ("J03WMX",)], "match_id string")
    assert [r.split for r in labels.assign_fixed_split(known).collect()] == ["validation", "test", "train"]


def test_duplicate_key_is_an_error(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 3)], "k string, w int")
    with pytest.raises(Exception, match="duplicate key"):
        keys.one_to_one_join(left, right, ["k"]).collect()


def test_adjudication(spark):
    cohort = spark.createDataFrame([("p", "prioritas", 1), ("q", "sampel", 0), ("r", "sampel", 1)], "candidate_id string, kelompok string, label_asal int")
    side = lambda rows: spark.createDataFrame(rows, "candidate_id string, label int")
    log = labels.adjudicate(cohort, side([("p", 0)]), side([("p", 0), ("q", 1), ("r", 1)]), side([("q", -1)]))
    got = {r.candidate_id: (r.label_utama, r.label_akhir, r.keputusan) for r in log.collect()}
    assert got == {"p": (0, 0, "diubah"), "q": (0, -1, "dikeluarkan_ragu"), "r": (1, 1, "dipertahankan")}


def test_revision_of_other_columns_is_refused(spark):
    ann = annotations(spark, [(1, 3, "", "a")])
    with pytest.raises(ValueError, match="protected"):
        labels.apply_revisions(ann, ann.select("candidate_id", "match_id"))


def test_upsert_keeps_labels_and_appends(spark):
    source = spark.createDataFrame([(f"c{i}", "g", 1, i, i) for i in (3, 1, 2)], "candidate_id string, match_id string, period_id int, loss_t_us long, loss_frame long")
    old = spark.createDataFrame([("c2", 7, 1)], "candidate_id string, annotation_order long, is_gegenpressing int")
    got = {r.candidate_id: (r.annotation_order, r.is_gegenpressing) for r in labels.preserve_upsert(source, old).collect()}
    assert got == {"c2": (7, 1), "c1": (8, None), "c3": (9, None)}
    gone = spark.createDataFrame([("zz", 1, 1)], "candidate_id string, annotation_order long, is_gegenpressing int")
    with pytest.raises(Exception, match="no longer in the source"):
        labels.preserve_upsert(source, gone).collect()


def test_spaced_sample_keeps_distance_and_balance(spark):
    rng = random.Random(4)
    rows = [(f"c{i}", "g", 1, rng.randrange(0, 60_000_000), i, rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id string, match_id string, period_id int, loss_t_us long, loss_frame long, label_regain_5s int")
    kept = sampling.spaced_rows(df, 2_000_000, 42).collect()
    times = sorted(r.loss_t_us for r in kept)
    assert len(times) > 5 and min(b - a for a, b in zip(times, times[1:])) >= 2_000_000
    digest = {r[0]: __import__("hashlib").md5(f"{r[0]}-42".encode()).hexdigest() + r[0] for r in rows}
    want = {}
    for a in sorted(rows, key=lambda r: digest[r[0]]):
        if all(abs(a[3] - t) >= 2_000_000 for t in want.values()):
            want[a[0]] = a[3]
    assert {r.candidate_id for r in kept} == set(want)
    sample = sampling.spaced_sample(df, 6, 2_000_000).collect()
    assert sum(r.label_regain_5s for r in sample) * 2 == len(sample)
    with pytest.raises(ValueError, match="even"):
        sampling.spaced_sample(df, 5, 2_000_000)
    with pytest.raises(Exception, match="both outcomes"):
        sampling.spaced_sample(df.where("label_regain_5s = 1"), 6, 2_000_000).collect()


def test_dense_rows_fill_the_quota(spark):
    rows = [(f"c{i}", "g", 1, i * 1_000_000, i, i // 2 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id string, match_id string, period_id int, loss_t_us long, loss_frame long, label_regain_5s int")
    sample = sampling.spaced_sample(df, 80, 1_000_000).collect()
    assert len(sample) == 80 and sum(r.label_regain_5s for r in sample) == 40
    spaced = sampling.spaced_sample(df, 60, 2_000_000).collect()
    assert len(spaced) == 60


def test_pilot_that_can_not_balance_is_an_error(spark):
    queue = spark.createDataFrame([(f"c{i}", "g", 1, None) for i in range(40)], "candidate_id string, match_id string, quick_regain_success int, is_gegenpressing int")
    with pytest.raises(Exception, match="too few rows"):
        sampling.pilot_selection(queue).collect()


def test_latest_decision_wins(spark):
    log = spark.createDataFrame([("c", 1, 2, " a ", "x", 1), ("c", 0, 3, "b", "x", 2), ("c", 5, 3, "bad", "x", 3)],
                                "candidate_id string, label int, confidence int, notes string, annotator string, decided_t_us long")
    r = labels.latest_decisions(log).first()
    assert (r.label, r.notes, r.revisions) == (0, "b", 2)


def test_order_numbers_run_through_matches(spark):
    df = spark.createDataFrame([(f"c{i}", "h" if i % 3 else "g") for i in range(50)], "candidate_id string, match_id string")
    rows = labels.order_numbers(df).collect()
    assert sorted(r.annotation_order for r in rows) == list(range(1, 51))
    assert max(r.annotation_order for r in rows if r.match_id == "g") == sum(r.match_id == "g" for r in rows)


def test_fractional_labels_are_not_labels(spark):
    df = spark.createDataFrame([(v,) for v in ("0.5", "1.7", "-0.4", "1.0", " -1 ", "x", None)], "v string")
    from pressline.functions import columns as C

    assert [r[0] for r in df.select(C.coerce_int("v")).collect()] == [None, None, None, 1, -1, None, None]
    ann = annotations(spark, [(1, 3, "", "a"), (0, 3, "", "a")]).withColumn(
        "is_gegenpressing", F.when(F.col("is_gegenpressing") == 1, "0.5").otherwise("0")
    )
    row = gates.annotation_checks(ann).first()
    assert row.all_annotations_completed and not row.all_labels_valid


def test_upsert_over_long_periods_and_rows_without_order(spark):
    minute = 60_000_000
    far = (1 << 21) * minute
    source = spark.createDataFrame(
        [(f"p{p}_{i}", "g", p, far * (2 - p) + i * minute * 3000, i) for p in (1, 2) for i in range(4)],
        "candidate_id string, match_id string, period_id int, loss_t_us long, loss_frame long",
    )
    old = spark.createDataFrame([("p2_3", None, 0, True)], "candidate_id string, annotation_order long, is_gegenpressing int, pilot_selected boolean")
    got = {r.candidate_id: (r.annotation_order, r.is_gegenpressing, r.pilot_selected) for r in labels.preserve_upsert(source, old).collect()}
    assert [got[f"p{p}_{i}"][0] for p in (1, 2) for i in range(4)] == list(range(1, 9))
    assert got["p2_3"] == (8, 0, True)


def test_conflict_without_consensus_stops(spark):
    cohort = spark.createDataFrame([("p", "prioritas", 1)], "candidate_id string, kelompok string, label_asal int")
    side = lambda rows: spark.createDataFrame(rows, "candidate_id string, label int")
    with pytest.raises(Exception, match="no consensus"):
        labels.adjudicate(cohort, side([("p", 0)]), side([("p", 1)]), side([])).collect()


def test_revisions_check_ids_and_old_labels(spark):
    ann = spark.createDataFrame([("a", 1, "n"), ("b", 0, "m")], "candidate_id string, is_gegenpressing int, annotation_notes string")
    rev = lambda rows: spark.createDataFrame(rows, "candidate_id string, is_gegenpressing int, annotation_notes string, expected_label int")
    got = {r.candidate_id: (r.is_gegenpressing, r.annotation_notes, r.revised) for r in labels.apply_revisions(ann, rev([("a", 0, None, 1)])).collect()}
    assert got == {"a": (0, None, True), "b": (0, "m", False)}
    with pytest.raises(Exception, match="unknown id"):
        labels.apply_revisions(ann, rev([("z", 0, "", 1)])).collect()
    with pytest.raises(Exception, match="another label"):
        labels.apply_revisions(ann, rev([("a", 0, "", 0)])).collect()


def test_final_labels_take_five_columns(spark):
    ann = spark.createDataFrame([("a", "m", 1, 1, "old", "t0", "x"), ("b", "m", 0, 3, "keep", "t0", "x")],
                                "candidate_id string, match_id string, is_gegenpressing int, annotation_confidence int, annotation_notes string, annotated_at_utc string, annotator string")
    log = spark.createDataFrame([("a", 1, 0, "diubah")], "candidate_id string, label_utama int, label_kedua int, keputusan string")
    answer = "candidate_id string, label int, confidence int, person string, utc string, notes string"
    first = spark.createDataFrame([("a", 1, 2, "p", "t1", "mine")], answer)
    both = spark.createDataFrame([("a", 0, 3, "both", "t2", "agreed"), ("b", 1, 3, "both", "t2", "unused")], answer)
    rows = {r.candidate_id: r for r in labels.finalize_labels(ann, log, labels.final_choices(first, both, log)).collect()}
    a = rows["a"]
    assert (a.is_gegenpressing, a.annotation_confidence, a.annotator, a.annotated_at_utc, a.annotation_notes) == (0, 3, "both", "t2", "agreed")
    assert rows["b"].annotation_notes == "keep"


def test_model_without_threshold_is_an_error(spark):
    scores = spark.createDataFrame([("m", 0.5), ("n", 0.4)], "model string, probability double")
    with pytest.raises(Exception, match="no threshold"):
        metrics.predict(scores, spark.createDataFrame([("m", 0.5)], "model string, threshold double")).collect()


def test_pilot_is_returned_once_chosen(spark):
    queue = spark.createDataFrame([("a", "g", 1, None, "True", 1), ("b", "g", 0, None, "False", None)],
                                  "candidate_id string, match_id string, quick_regain_success int, is_gegenpressing int, pilot_selected string, pilot_order int")
    assert [r.candidate_id for r in sampling.pilot_selection(queue).collect()] == ["a"]


def test_team_of_a_player_over_periods(spark):
    from pressline.operators import roster

    ev = spark.createDataFrame([("m", 1, 5_000_000, 9, "p", "A"), ("m", 2, 1_000_000, 3, "p", "B")],
                               "match_id string, period_id int, t_us long, event_id long, player_id string, team_id string")
    assert roster.player_team(ev).first().team_id == "A"


def test_answer_hash_is_checked(spark):
    answers = spark.createDataFrame([("c", 1, 3, "n", "p", "2024-01-01T00:00:00Z", "r", "old")],
                                    "candidate_id string, label int, confidence int, notes string, person string, utc string, role string, hash string")
    row = gates.answer_checks(answers, answers, "r", "new").first()
    assert not row.hash_matches and row.role_matches and row.ids_complete


def test_split_summary_names_every_match(spark):
    rows = [("train", f"m{i:03}", 1, True) for i in range(250)] + [("test", "t", 0, False)]
    manifest = spark.createDataFrame(rows + rows[:1], "split string, match_id string, label_regain_5s int, eligible_for_detection_training boolean")
    out = {r.split: r for r in profile.split_summary(manifest).collect()}
    assert (out["train"].matches, out["train"].first_match, out["train"].last_match) == (250, "m000", "m249")
    assert out["test"].last_match == "t" and out["train"].strict_valid_episodes == 251
    assert profile.split_matches(manifest).count() == 251


def test_split_summary_lists_the_names(spark):
    rows = [("train", f"m{i:03}", 1, True) for i in range(250)] + [("test", "t", 0, False)] * 2
    manifest = spark.createDataFrame(rows, "split string, match_id string, label_regain_5s int, eligible_for_detection_training boolean")
    out = {r.split: r.match_names for r in profile.split_summary(manifest).collect()}
    assert out == {"train": ", ".join(f"m{i:03}" for i in range(250)), "test": "t"}
