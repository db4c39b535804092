"""Labels, reviews, samples, key checks and gates over documents."""

# ruff: noqa: E501

from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import models
from ..operators import gates, keys, labels, sampling
from ..session import shared_file
from ..sources import tables
from .bindings import EVENT_CFG, doc_id_key
from .registry import query, view
from .scoring import R9

SPACING = EVENT_CFG.regain_horizon_us // 12  # 2 hours


def _in_manifest(s):
    """Annotations of strict-valid candidates."""
    return keys.semi_filter(s.annotations, s.manifest, ["candidate_id"])


# --- projections ------------------------------------------------------
@query("strict_bool", "SELECT candidate_id, lower(strict_valid) = 'true' AS strict_valid, pilot_selected IN ('True', 'true', '1') AS pilot_selected FROM fx_episodes JOIN fx_annotations USING (candidate_id)")
def _(s):
    joined = s.episodes.join(s.annotations.select("candidate_id", "pilot_selected"), "candidate_id")
    return joined.select(
        "candidate_id",
        C.strict_bool("strict_valid", accept=("true",)).alias("strict_valid"),
        C.strict_bool("pilot_selected").alias("pilot_selected"),
    )


RAW_NUMBER = "CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 7 = 1 THEN ' ' WHEN doc_id % 7 = 2 THEN '0.5' ELSE CAST(doc_id % 3 AS VARCHAR) || '.0' END"
WHOLE = f"try_cast({RAW_NUMBER} AS DOUBLE)"


@query("coerce_numeric", f"SELECT 'D' || doc_id AS candidate_id, CAST(CASE WHEN {WHOLE} = floor({WHOLE}) THEN {WHOLE} END AS INT) AS value FROM documents")
def _(s):
    doc = F.col("doc_id")
    raw = F.when(doc % 7 == 0, "n/a").when(doc % 7 == 1, " ").when(doc % 7 == 2, "0.5").otherwise(F.concat((doc % 3).cast("string"), F.lit(".0")))
    return s.table("documents").select(doc_id_key().alias("candidate_id"), C.coerce_int(raw).alias("value"))


@query("label_status", "SELECT candidate_id, gegenpressing_label, label_status, eligible_for_detection_training FROM fx_manifest")
def _(s):
    return s.manifest.select("candidate_id", "gegenpressing_label", "label_status", "eligible_for_detection_training")


@query("split_map", "SELECT candidate_id, match_id, split FROM fx_episodes JOIN fx_split USING (match_id)")
def _(s):
    return labels.assign_split(s.episodes, s.split_table).select("candidate_id", "match_id", "split")


view("fx_reason", """
SELECT candidate_id, CASE WHEN is_gegenpressing = -1 AND annotation_confidence = 1 THEN 'uncertain_and_low_confidence'
  WHEN is_gegenpressing = -1 THEN 'uncertain' WHEN annotation_confidence = 1 THEN 'low_confidence' END AS review_reason FROM fx_annotations""")


@query("review_reason", "SELECT * FROM fx_reason")
def _(s):
    return s.annotations.select("candidate_id", labels.review_reason().alias("review_reason"))


@query("blank_text", "SELECT candidate_id, trim(coalesce(annotation_notes, '')) <> '' AS has_notes FROM fx_annotations")
def _(s):
    return s.annotations.select("candidate_id", C.has_text("annotation_notes").alias("has_notes"))


@query("blinded_projection", """
SELECT a.candidate_id, a.match_id, m.split, a.is_gegenpressing, a.annotation_confidence, a.annotation_notes, a.annotated_at_utc,
       a.annotator, r.review_reason
FROM fx_annotations a JOIN (SELECT candidate_id, split FROM fx_manifest) m USING (candidate_id) JOIN fx_reason r USING (candidate_id)
WHERE r.review_reason IS NOT NULL""")
def _(s):
    return labels.review_queue(_in_manifest(s), s.manifest)


# --- joins ------------------------------------------------------------
@query("one_to_one_join", "SELECT candidate_id, label_regain_5s, is_gegenpressing FROM fx_episodes JOIN fx_annotations USING (candidate_id)")
def _(s):
    return keys.one_to_one_join(
        s.episodes.select("candidate_id", "label_regain_5s"), s.annotations.select("candidate_id", "is_gegenpressing"), ["candidate_id"]
    )


@query("attach_annotations", """
SELECT e.candidate_id, e.strict_valid, a.is_gegenpressing, a.annotation_confidence, a.annotation_notes, a.annotator, a.pilot_selected, a.pilot_order
FROM fx_episodes e LEFT JOIN fx_annotations a USING (candidate_id)""")
def _(s):
    return labels.attach_annotations(s.episodes.select("candidate_id", "strict_valid"), s.annotations)


@query("preserve_upsert", """
SELECT e.candidate_id, e.match_id, a.is_gegenpressing, a.annotator,
       coalesce(a.annotation_order, (SELECT max(annotation_order) FROM fx_annotations) + CASE WHEN a.annotation_order IS NULL THEN
         row_number() OVER (PARTITION BY a.annotation_order IS NULL ORDER BY e.match_id, e.period_id, e.loss_t_us, e.loss_frame) END) AS annotation_order
FROM fx_episodes e LEFT JOIN fx_annotations a USING (candidate_id)""")
def _(s):
    return labels.preserve_upsert(s.episodes, s.annotations).select(
        "candidate_id", "match_id", "is_gegenpressing", "annotator", "annotation_order"
    )


@query("semi_filter", "SELECT candidate_id, split FROM fx_manifest WHERE candidate_id IN (SELECT candidate_id FROM fx_raters)")
def _(s):
    return keys.semi_filter(s.manifest.select("candidate_id", "split"), s.raters, ["candidate_id"])


@query("anti_unknown", "SELECT DISTINCT candidate_id FROM fx_episodes WHERE candidate_id NOT IN (SELECT candidate_id FROM fx_raters)")
def _(s):
    return keys.anti_unknown(s.episodes, s.raters, ["candidate_id"])


@query("split_stability", """
WITH n AS (SELECT candidate_id, split AS a, CASE WHEN loss_frame % 97 = 0 THEN 'train' ELSE split END AS b FROM fx_manifest)
SELECT count(*) AS compared, count(*) FILTER (WHERE a <> b) AS moved, count(*) FILTER (WHERE a <> b) = 0 AS stable FROM n""")
def _(s):
    moved = s.manifest.withColumn("split", F.when(F.col("loss_frame") % 97 == 0, "train").otherwise(F.col("split")))
    return labels.split_stability(s.manifest, moved)


def _side(s, column, note):
    return s.raters.select("candidate_id", F.col(column).alias("label"), F.concat(F.lit(note), "candidate_id").alias("notes"))


@query("rater_conflicts", """
SELECT candidate_id, rater_1 AS label_utama, 'a:' || candidate_id AS alasan_utama, rater_2 AS label_kedua, 'b:' || candidate_id AS alasan_kedua
FROM fx_raters WHERE rater_1 <> rater_2""")
def _(s):
    return labels.rater_conflicts(_side(s, "rater_1", "a:"), _side(s, "rater_2", "b:"))


view("fx_cohort", """
SELECT candidate_id, match_id, is_gegenpressing AS label_asal, kelompok FROM (
  SELECT *, 'prioritas' AS kelompok FROM fx_annotations WHERE coalesce(annotation_confidence = 1, false) OR coalesce(is_gegenpressing = -1, false)
  UNION ALL
  SELECT *, 'sampel' FROM (SELECT * FROM fx_annotations WHERE NOT (coalesce(annotation_confidence = 1, false) OR coalesce(is_gegenpressing = -1, false))
    AND is_gegenpressing IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, is_gegenpressing ORDER BY md5(candidate_id || '-42'), candidate_id) <= 5))""")
view("fx_log", """
SELECT candidate_id, kelompok, label_asal, label_utama, label_kedua, label_akhir,
       CASE WHEN label_akhir = -1 THEN 'dikeluarkan_ragu' WHEN label_akhir <> label_asal THEN 'diubah' ELSE 'dipertahankan' END AS keputusan
FROM (SELECT *, CASE WHEN label_utama <> label_kedua THEN beide ELSE label_utama END AS label_akhir FROM (
  SELECT c.*, CASE WHEN kelompok = 'prioritas' THEN r.rater_1 ELSE label_asal END AS label_utama, r.rater_2 AS label_kedua,
         CASE WHEN CAST(substr(c.candidate_id, 2) AS INT) % 9 = 0 THEN -1 ELSE r.rater_2 END AS beide
  FROM fx_cohort c JOIN fx_raters r USING (candidate_id)))""")


def _cohort(s):
    return sampling.review_cohorts(s.annotations)


def _log(s):
    cohort = _cohort(s)
    first = _side(s, "rater_1", "").join(cohort.where(F.col("kelompok") == "prioritas").select("candidate_id"), "candidate_id", "left_semi")
    n = F.regexp_extract("candidate_id", r"(\d+)", 1).cast("int")
    consensus = s.raters.select("candidate_id", F.when(n % 9 == 0, -1).otherwise(F.col("rater_2")).alias("label"))
    return labels.adjudicate(cohort, first, _side(s, "rater_2", ""), consensus)


@query("adjudicate", "SELECT candidate_id, label_asal, label_utama, label_kedua, label_akhir FROM fx_log")
def _(s):
    return _log(s).select("candidate_id", "label_asal", "label_utama", "label_kedua", "label_akhir")


@query("decision_class", "SELECT * FROM fx_log")
def _(s):
    return _log(s)


view("fx_revised", """
SELECT *, new_label IS DISTINCT FROM is_gegenpressing OR new_confidence IS DISTINCT FROM annotation_confidence AS revised FROM (
  SELECT a.*, coalesce(r.rater_2, a.is_gegenpressing) AS new_label, CASE WHEN r.candidate_id IS NOT NULL THEN 2 ELSE annotation_confidence END AS new_confidence
  FROM fx_annotations a LEFT JOIN (SELECT * FROM fx_raters WHERE rater_1 <> rater_2) r USING (candidate_id))""")


def _revised(s):
    revisions = s.raters.where(F.col("rater_1") != F.col("rater_2")).select(
        "candidate_id", F.col("rater_2").alias("is_gegenpressing"), F.lit(2).alias("annotation_confidence")
    )
    return labels.apply_revisions(s.annotations, revisions)


@query("apply_revisions", """
SELECT candidate_id, new_label AS is_gegenpressing, new_confidence AS annotation_confidence, is_gegenpressing AS old_is_gegenpressing,
       annotation_confidence AS old_annotation_confidence, revised FROM fx_revised""")
def _(s):
    return _revised(s).select(
        "candidate_id", "is_gegenpressing", "annotation_confidence", "old_is_gegenpressing", "old_annotation_confidence", "revised"
    )


@query("label_revision", """
WITH r AS (
  SELECT candidate_id, CASE WHEN doc % 11 = 0 THEN -1 WHEN doc % 3 = 0 OR doc % 7 = 0 THEN 1 ELSE 0 END AS old_label, doc % 3 + 1 AS old_confidence, rater_2 AS new_label
  FROM (SELECT candidate_id, CAST(substr(candidate_id, 2) AS BIGINT) AS doc FROM fx_manifest) JOIN fx_raters USING (candidate_id) WHERE rater_1 <> rater_2)
SELECT candidate_id, 'is_gegenpressing' AS "column", CAST(old_label AS VARCHAR) AS old_value, CAST(new_label AS VARCHAR) AS new_value FROM r WHERE new_label <> old_label
UNION ALL SELECT candidate_id, 'annotation_confidence', CAST(old_confidence AS VARCHAR), '2' FROM r WHERE old_confidence <> 2""")
def _(s):
    """Where raters differ, the second one's label replaces that of the finished annotations."""
    annotations = s.finished_annotations
    chosen = s.raters.where(F.col("rater_1") != F.col("rater_2")).select("candidate_id", F.col("rater_2").alias("is_gegenpressing"), F.lit(2).alias("annotation_confidence"))
    revised = labels.apply_revisions(annotations, chosen.join(annotations.select("candidate_id"), "candidate_id", "left_semi"))
    return models.revise_labels(revised, annotations, s.episodes, s.split_table)


# --- aggregates -------------------------------------------------------
@query("split_manifest", """
SELECT split, match_id, count(*) AS strict_valid_episodes, sum(label_regain_5s)::BIGINT AS quick_regain_positive,
       sum(1 - label_regain_5s)::BIGINT AS quick_regain_negative, count(*) FILTER (WHERE eligible_for_detection_training) AS annotated_usable,
       count(*) FILTER (WHERE label_status = 'uncertain_excluded') AS annotated_uncertain FROM fx_manifest GROUP BY split, match_id""")
def _(s):
    return labels.split_manifest(s.manifest)


@query("annotation_summary", """
SELECT split, a.match_id, count(*) AS queue, count(a.is_gegenpressing) AS completed, count(*) FILTER (WHERE a.is_gegenpressing IN (0, 1)) AS usable,
       count(*) FILTER (WHERE a.is_gegenpressing = 1) AS positive, count(*) FILTER (WHERE a.is_gegenpressing = 0) AS negative,
       count(*) FILTER (WHERE a.is_gegenpressing = -1) AS uncertain, count(*) FILTER (WHERE a.annotation_confidence = 1) AS low_confidence
FROM fx_annotations a JOIN (SELECT candidate_id, split FROM fx_manifest) m USING (candidate_id) GROUP BY split, a.match_id""")
def _(s):
    return labels.annotation_summary(_in_manifest(s), s.manifest)


@query("annotation_progress", """
SELECT count(*) AS total, count(is_gegenpressing) AS completed, count(*) - count(is_gegenpressing) AS remaining,
       count(*) FILTER (WHERE is_gegenpressing = 1) AS label_1, count(*) FILTER (WHERE is_gegenpressing = 0) AS label_0,
       count(*) FILTER (WHERE is_gegenpressing = -1) AS label_uncertain FROM fx_annotations""")
def _(s):
    return labels.annotation_progress(s.annotations)


@query("crosstab_margins", """
SELECT CASE WHEN grouping(split) = 1 THEN 'TOTAL' ELSE split END AS split, CASE WHEN grouping(label_status) = 1 THEN 'TOTAL' ELSE label_status END AS label_status,
       count(*) AS n FROM fx_manifest GROUP BY CUBE (split, label_status)""")
def _(s):
    return labels.crosstab_margins(s.manifest, "split", "label_status")


@query("class_per_match", """
SELECT match_id, count(*) FILTER (WHERE is_gegenpressing = -1) AS uncertain, count(*) FILTER (WHERE is_gegenpressing = 0) AS negative,
       count(*) FILTER (WHERE is_gegenpressing = 1) AS positive FROM fx_annotations GROUP BY match_id""")
def _(s):
    return labels.class_per_match(s.annotations)


@query("confidence_by_split", """
SELECT split, count(*) FILTER (WHERE annotation_confidence = 1) AS confidence_1, count(*) FILTER (WHERE annotation_confidence = 2) AS confidence_2,
       count(*) FILTER (WHERE annotation_confidence = 3) AS confidence_3, count(*) FILTER (WHERE annotation_confidence IS NULL) AS confidence_null
FROM fx_manifest GROUP BY split""")
def _(s):
    return labels.confidence_by_split(s.manifest)


# --- numbering and order ----------------------------------------------
@query("order_numbers", """
SELECT candidate_id, row_number() OVER (ORDER BY match_id, md5(candidate_id || '-42'), candidate_id) AS annotation_order,
       row_number() OVER (PARTITION BY match_id ORDER BY md5(candidate_id || '-42'), candidate_id) AS within_match_order FROM fx_episodes""")
def _(s):
    return labels.order_numbers(s.episodes).select("candidate_id", "annotation_order", "within_match_order")


@query("batch_number", """
SELECT candidate_id, annotation_order, (row_number() OVER (ORDER BY annotation_order, candidate_id) - 1) // 25 + 1 AS batch
FROM fx_annotations WHERE annotation_order IS NOT NULL""")
def _(s):
    return labels.batch_numbers(s.annotations.where(F.col("annotation_order").isNotNull())).select(
        "candidate_id", "annotation_order", "batch"
    )


@query("canonical_sort", "SELECT split, match_id, period_id, loss_frame, candidate_id FROM fx_manifest ORDER BY ALL")
def _(s):
    return keys.canonical_sort(s.manifest.select("split", "match_id", "period_id", "loss_frame", "candidate_id"), labels.CANONICAL)


# --- sets -------------------------------------------------------------
@query("set_equal", """
WITH a AS (SELECT DISTINCT candidate_id FROM fx_manifest), b AS (SELECT DISTINCT candidate_id FROM fx_raters)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) = 0 AS equal""")
def _(s):
    return keys.set_compare(s.manifest, s.raters, ["candidate_id"])


@query("distinct_rows", "SELECT DISTINCT match_id, annotator FROM fx_annotations")
def _(s):
    return keys.distinct_rows(s.annotations, ["match_id", "annotator"])


@query("duplicate_keys", "SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(s):
    return keys.duplicate_keys(s.table("events").select("user_id", F.to_date("ts").cast("string").alias("day")), ["user_id", "day"])


@query("identical_records", """
WITH p AS (SELECT DISTINCT model, candidate_id, split, match_id, y_true FROM fx_scores), r AS (SELECT count(*) AS k FROM p GROUP BY candidate_id, split, match_id, y_true)
SELECT count(*) AS records, (SELECT count(DISTINCT model) FROM p) AS groups, min(k) = (SELECT count(DISTINCT model) FROM p) AS identical FROM r""")
def _(s):
    return keys.identical_records(s.scores, ["candidate_id", "split", "match_id", "y_true"])


# --- sampling ---------------------------------------------------------
@query("stratified_controls", """
SELECT candidate_id, match_id, is_gegenpressing FROM fx_annotations WHERE NOT (coalesce(annotation_confidence = 1, false) OR coalesce(is_gegenpressing = -1, false))
AND is_gegenpressing IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, is_gegenpressing ORDER BY md5(candidate_id || '-42'), candidate_id) <= 5""")
def _(s):
    return sampling.stratified_controls(s.annotations).select("candidate_id", "match_id", "is_gegenpressing")


@query("trial_sample", """
SELECT candidate_id, match_id, gegenpressing_label FROM fx_manifest WHERE eligible_for_detection_training
QUALIFY row_number() OVER (PARTITION BY match_id, gegenpressing_label ORDER BY md5(candidate_id || '-42'), candidate_id) <= 6""")
def _(s):
    return sampling.trial_sample(s.manifest.where("eligible_for_detection_training")).select(
        "candidate_id", "match_id", "gegenpressing_label"
    )


# Rounds of picking the least digest within the spacing, until no row is open (0 open, 1 picked, 2 near a pick).
NEAR = f"(PARTITION BY match_id, period_id ORDER BY loss_t_us RANGE BETWEEN {SPACING - 1} PRECEDING AND {SPACING - 1} FOLLOWING)"
SPACED = f"""
WITH RECURSIVE spaced AS (
  SELECT candidate_id, match_id, period_id, loss_t_us, label_regain_5s, md5(candidate_id || '-42') || candidate_id AS d, 0 AS state FROM fx_candidates
  UNION ALL
  SELECT candidate_id, match_id, period_id, loss_t_us, label_regain_5s, d, CASE WHEN state > 0 THEN state WHEN pick THEN 1 WHEN near THEN 2 ELSE 0 END
  FROM (SELECT *, bool_or(pick) OVER {NEAR} AS near FROM (
    SELECT *, state = 0 AND d = min(CASE WHEN state = 0 THEN d END) OVER {NEAR} AS pick, count(*) FILTER (WHERE state = 0) OVER () AS open FROM spaced))
  WHERE open > 0)"""


@query("spaced_sample", SPACED + """,
     p AS (SELECT *, row_number() OVER (PARTITION BY match_id, label_regain_5s ORDER BY d) AS r FROM (SELECT DISTINCT * FROM spaced WHERE state = 1)),
     q AS (SELECT *, least(count(*) FILTER (WHERE label_regain_5s = 0) OVER (PARTITION BY match_id), count(*) FILTER (WHERE label_regain_5s = 1) OVER (PARTITION BY match_id)) AS quota FROM p WHERE r <= 3)
SELECT candidate_id, match_id, label_regain_5s, quota AS sample_target_per_outcome FROM q WHERE r <= quota""")
def _(s):
    # large tables hold users with one outcome only
    return sampling.spaced_sample(s.candidates, 6, SPACING, require_both=False).select(
        "candidate_id", "match_id", "label_regain_5s", "sample_target_per_outcome"
    )


def _pilot_queue(s):
    queue = s.episodes.select("candidate_id", "match_id", F.col("label_regain_5s").alias("quick_regain_success"))
    done = sampling.seeded_top(queue.where(F.col("match_id") == "src0"), ["match_id", "quick_regain_success"], 2, 7).select(
        "candidate_id", F.lit(1).alias("is_gegenpressing")
    )
    return queue.join(done, "candidate_id", "left")


@query("pilot_selection", """
WITH q AS (SELECT candidate_id, match_id, label_regain_5s AS o, md5(candidate_id || '-42') AS d,
             match_id = 'src0' AND row_number() OVER (PARTITION BY match_id, label_regain_5s ORDER BY md5(candidate_id || '-7'), candidate_id) <= 2 AS done FROM fx_episodes),
     t AS (SELECT count(*) FILTER (WHERE done) AS k, count(*) FILTER (WHERE done AND o = 1) AS kp FROM q),
     m AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS pos, count(*) OVER () AS n FROM (SELECT match_id FROM q GROUP BY match_id HAVING NOT bool_or(done))),
     u AS (SELECT match_id, pos, (28 - k) // n + CASE WHEN pos <= (28 - k) % n THEN 1 ELSE 0 END AS quota, kp FROM m, t),
     v AS (SELECT *, sum(quota % 2) OVER (ORDER BY pos) AS odd, 14 - kp - sum(quota // 2) OVER () AS extra FROM u WHERE quota > 0),
     w AS (SELECT match_id, quota, quota // 2 + CASE WHEN quota % 2 = 1 AND odd <= extra THEN 1 ELSE 0 END AS q1 FROM v),
     r AS (SELECT *, row_number() OVER (PARTITION BY match_id, o ORDER BY d, candidate_id) AS rn FROM q WHERE NOT done)
SELECT candidate_id, match_id, o AS quick_regain_success FROM q WHERE done
UNION ALL SELECT candidate_id, match_id, o FROM r JOIN w USING (match_id) WHERE rn <= CASE WHEN o = 1 THEN q1 ELSE quota - q1 END""")
def _(s):
    return sampling.pilot_selection(_pilot_queue(s)).select("candidate_id", "match_id", "quick_regain_success")


@query("seeded_shuffle", "SELECT candidate_id, row_number() OVER (ORDER BY md5(candidate_id || '-42'), candidate_id) AS presentation_order FROM fx_episodes")
def _(s):
    return sampling.seeded_shuffle(s.episodes).select("candidate_id", "presentation_order")


@query("priority_cohort", "SELECT candidate_id, match_id, label_asal FROM fx_cohort WHERE kelompok = 'prioritas'")
def _(s):
    return sampling.priority_cohort(s.annotations).select("candidate_id", "match_id", F.col("is_gegenpressing").alias("label_asal"))


# --- pipelines --------------------------------------------------------
@query("explode_answers", "SELECT hash, role, candidate_id, person, label, confidence, notes, utc FROM fx_answers")
def _(s):
    """Sheets written as JSON files and read again."""
    path = shared_file(s.spark, "answers")
    s.answer_sheets.drop("sheet_id").write.json(path)
    return labels.explode_answers(tables.read_answer_sheets(s.spark, [path], lines=True).drop("person"))


@query("model_manifest", "SELECT * FROM fx_manifest")
def _(s):
    return s.manifest


@query("label_audit", """
SELECT match_id, uncertain, negative, positive, coalesce(priority, 0) AS priority, coalesce(controls, 0) AS controls FROM (
  SELECT match_id, count(*) FILTER (WHERE is_gegenpressing = -1) AS uncertain, count(*) FILTER (WHERE is_gegenpressing = 0) AS negative,
         count(*) FILTER (WHERE is_gegenpressing = 1) AS positive FROM fx_annotations GROUP BY match_id)
LEFT JOIN (SELECT match_id, count(*) FILTER (WHERE kelompok = 'prioritas') AS priority, count(*) FILTER (WHERE kelompok = 'sampel') AS controls
           FROM fx_cohort GROUP BY match_id) USING (match_id)""")
def _(s):
    return labels.label_audit(s.annotations, _cohort(s))


@query("label_finalize", """
SELECT a.candidate_id, a.match_id, a.is_gegenpressing AS label_original, CASE WHEN c.candidate_id IS NOT NULL THEN c.label ELSE a.is_gegenpressing END AS is_gegenpressing,
       CASE WHEN c.candidate_id IS NOT NULL THEN 2 ELSE a.annotation_confidence END AS annotation_confidence,
       coalesce(c.person, a.annotator) AS annotator, CASE WHEN c.candidate_id IS NOT NULL THEN '2024-03-01T00:00:00Z' ELSE a.annotated_at_utc END AS annotated_at_utc,
       coalesce(c.notes, a.annotation_notes) AS annotation_notes, l.keputusan
FROM fx_annotations a LEFT JOIN fx_log l USING (candidate_id) LEFT JOIN (
  SELECT candidate_id, label_akhir AS label, CASE WHEN label_utama <> label_kedua THEN 'both' ELSE 'first' END AS person,
         CASE WHEN label_utama <> label_kedua THEN 'agreed ' ELSE 'own ' END || candidate_id AS notes
  FROM fx_log WHERE kelompok = 'prioritas' OR label_utama <> label_kedua) c USING (candidate_id)""")
def _(s):
    log = _log(s)

    def answers(person, label, note, rows):
        return rows.select(
            "candidate_id", label.alias("label"), F.lit(2).alias("confidence"), F.lit(person).alias("person"),
            F.lit("2024-03-01T00:00:00Z").alias("utc"), F.concat(F.lit(note), "candidate_id").alias("notes"),
        )

    first = answers("first", F.col("label_utama"), "own ", log.where(F.col("kelompok") == "prioritas"))
    consensus = answers("both", F.col("label_akhir"), "agreed ", log)
    return labels.finalize_labels(s.annotations, log, labels.final_choices(first, consensus, log))


@query("decision_summary", """
WITH k AS (SELECT label_utama, label_kedua FROM fx_log WHERE kelompok = 'sampel')
SELECT count(*) AS n, count(*) FILTER (WHERE kelompok = 'prioritas') AS n_prioritas, count(*) FILTER (WHERE kelompok = 'sampel') AS n_sampel,
       count(*) FILTER (WHERE label_utama <> label_kedua) AS n_perbedaan, count(*) FILTER (WHERE keputusan = 'diubah') AS diubah,
       count(*) FILTER (WHERE keputusan = 'dikeluarkan_ragu') AS dikeluarkan_ragu,
       round(count(*) FILTER (WHERE kelompok = 'sampel' AND label_utama = label_kedua)::DOUBLE / count(*) FILTER (WHERE kelompok = 'sampel'), 9) AS kesepakatan_sampel,
       count(*) FILTER (WHERE label_akhir = -1) AS label_uncertain, count(*) FILTER (WHERE label_akhir = 0) AS label_0, count(*) FILTER (WHERE label_akhir = 1) AS label_1,
       (SELECT round((po - pe) / (1 - pe), 9) FROM (SELECT (SELECT avg(CASE WHEN label_utama = label_kedua THEN 1.0 ELSE 0.0 END) FROM k) AS po,
          sum(CAST(a AS DOUBLE) * b) / pow((SELECT count(*) FROM k), 2) AS pe
          FROM (SELECT v, (SELECT count(*) FROM k WHERE label_utama = v) AS a, (SELECT count(*) FROM k WHERE label_kedua = v) AS b FROM (VALUES (-1), (0), (1)) t(v)))) AS kappa_sampel
FROM fx_log""")
def _(s):
    return R9(labels.decision_summary(_log(s)), "kesepakatan_sampel", "kappa_sampel")


@query("decision_log_latest", """
SELECT candidate_id, label, confidence, trim(notes) AS notes, annotator, decided_t_us, n AS revisions FROM (
  SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n, row_number() OVER (PARTITION BY candidate_id ORDER BY decided_t_us DESC, annotator DESC) AS r
  FROM fx_decisions WHERE confidence IN (1, 2, 3)) WHERE r = 1""")
def _(s):
    return labels.latest_decisions(s.decisions)


# --- gates ------------------------------------------------------------
view("fx_gate_ann", """
SELECT coalesce(bool_and(is_gegenpressing IS NOT NULL), true) AS all_annotations_completed,
       coalesce(bool_and(is_gegenpressing IS NULL OR is_gegenpressing IN (-1, 0, 1)), true) AS all_labels_valid,
       coalesce(bool_and(is_gegenpressing IS NULL OR annotation_confidence IS NOT NULL), true) AS confidence_complete,
       coalesce(bool_and(is_gegenpressing IS NULL OR coalesce(annotation_confidence IN (1, 2, 3), false)), true) AS confidence_valid,
       coalesce(bool_and(NOT coalesce(is_gegenpressing = -1, false) OR trim(coalesce(annotation_notes, '')) <> ''), true) AS uncertain_have_notes,
       coalesce(bool_and(is_gegenpressing IS NULL OR trim(coalesce(annotator, '')) <> ''), true) AS annotator_complete,
       count(*) = count(DISTINCT candidate_id) AS candidate_id_unique FROM fx_annotations""")


@query("gate_annotations", "SELECT * FROM fx_gate_ann")
def _(s):
    return gates.annotation_checks(s.annotations)


@query("gate_manifest", """
SELECT bool_and(NOT eligible_for_detection_training OR gegenpressing_label IN (0, 1)) AS only_binary_labels_trainable,
       bool_and(NOT coalesce(gegenpressing_label = -1, false) OR NOT eligible_for_detection_training) AS uncertain_labels_excluded,
       count(DISTINCT split) = 3 AS required_splits_present,
       (SELECT bool_and(k = 1) FROM (SELECT count(DISTINCT split) AS k FROM fx_manifest GROUP BY match_id)) AS all_matches_have_one_split,
       count(*) = count(DISTINCT candidate_id) AS candidate_id_unique FROM fx_manifest""")
def _(s):
    return gates.manifest_checks(s.manifest)


@query("gate_predictions", """
SELECT count(DISTINCT model) >= 2 AS at_least_two_models, bool_or(split = 'test') AS test_split_present, bool_and(threshold IS NOT NULL) AS threshold_present,
       bool_and(y_true IN (0, 1)) AS binary_ground_truth, bool_and(probability BETWEEN 0 AND 1) AS probabilities_in_unit_interval,
       bool_and(y_pred = CASE WHEN probability >= threshold THEN 1 ELSE 0 END) AS predictions_match_threshold,
       (SELECT bool_and(k = 1) FROM (SELECT count(DISTINCT threshold) AS k FROM fx_predictions GROUP BY model)) AS one_threshold_per_model,
       (SELECT bool_and(k = 3) FROM (SELECT count(DISTINCT split) AS k FROM fx_predictions GROUP BY model)) AS all_splits_per_model,
       (SELECT bool_and(k = 1) FROM (SELECT count(DISTINCT split) AS k FROM fx_predictions GROUP BY match_id)) AS one_split_per_match,
       count(*) = count(DISTINCT model || candidate_id) AS unique_model_candidate_pairs,
       (SELECT bool_and(k = 2) FROM (SELECT count(DISTINCT model) AS k FROM fx_predictions GROUP BY candidate_id)) AS identical_candidate_sets,
       (SELECT bool_and(k = 2) FROM (SELECT count(DISTINCT model) AS k FROM fx_predictions GROUP BY candidate_id, split, match_id, y_true)) AS identical_candidate_records
FROM fx_predictions""")
def _(s):
    return gates.prediction_checks(s.prediction_files)


@query("gate_readiness", """
WITH c AS (SELECT split, gegenpressing_label AS y, count(*) AS n FROM fx_manifest WHERE eligible_for_detection_training GROUP BY ALL)
SELECT g.*, (SELECT count(*) FROM c WHERE n > 0) = 6 AS both_classes_in_every_split, (SELECT count(*) FROM c WHERE n >= 5) = 6 AS minimum_per_class_in_every_split,
       (SELECT bool_and(NOT coalesce(gegenpressing_label = -1, false) OR NOT eligible_for_detection_training) FROM fx_manifest) AS uncertain_excluded
FROM fx_gate_ann g""")
def _(s):
    return gates.readiness(s.annotations, s.manifest)


@query("gate_queue", """
SELECT bool_and(is_gegenpressing IS NOT NULL AND strict_valid = 'True') AS all_strict_valid_completed,
       bool_or(coalesce(is_gegenpressing = 0, false)) AND bool_or(coalesce(is_gegenpressing = 1, false)) AS both_classes_present,
       bool_and(NOT coalesce(is_gegenpressing = -1, false) OR trim(coalesce(annotation_notes, '')) <> '') AS uncertain_have_notes,
       bool_and(is_gegenpressing IS NULL OR annotation_confidence IS NOT NULL) AS confidence_complete,
       bool_and(is_gegenpressing IS NULL OR is_gegenpressing IN (-1, 0, 1)) AS labels_valid, count(*) = count(DISTINCT candidate_id) AS candidate_id_unique
FROM fx_episodes JOIN fx_annotations USING (candidate_id)""")
def _(s):
    return gates.queue_checks(s.episodes.join(s.annotations.drop("match_id"), "candidate_id"))


@query("gate_report", """
WITH j AS (SELECT p.*, m.candidate_id IS NOT NULL AS known, m.gegenpressing_label AS l, m.split AS ms, m.match_id AS mm
           FROM fx_predictions p LEFT JOIN fx_manifest m USING (candidate_id))
SELECT bool_and(NOT known OR coalesce(y_true = l, false)) AS labels_aligned, bool_and(NOT known OR split = ms) AS splits_aligned,
       bool_and(NOT known OR match_id = mm) AS matches_aligned, bool_and(probability BETWEEN 0 AND 1) AS probabilities_valid,
       bool_and(y_pred = CASE WHEN probability >= threshold THEN 1 ELSE 0 END) AS decisions_match_threshold,
       count(*) = count(DISTINCT model || candidate_id) AS pairs_unique,
       (SELECT bool_and(m.gegenpressing_label IS NOT DISTINCT FROM a.is_gegenpressing) FROM fx_manifest m LEFT JOIN fx_annotations a USING (candidate_id)) AS labels_equal_annotations,
       bool_and(known) AND count(*) = 2 * (SELECT count(*) FROM fx_manifest) AS episodes_complete FROM j""")
def _(s):
    return gates.report_checks(s.prediction_files, s.manifest, s.annotations)


@query("gate_protocol", """
WITH e AS (SELECT * FROM fx_manifest WHERE eligible_for_detection_training)
SELECT (SELECT count(*) FROM ((SELECT match_id FROM e EXCEPT SELECT match_id FROM fx_split) UNION ALL (SELECT match_id FROM fx_split EXCEPT SELECT match_id FROM e))) = 0 AS expected_matches,
       (SELECT bool_and(a > 0 AND b > 0) FROM (SELECT count(*) FILTER (WHERE gegenpressing_label = 0) AS a, count(*) FILTER (WHERE gegenpressing_label = 1) AS b FROM e GROUP BY match_id)) AS both_classes_per_match,
       (SELECT count(*) FROM ((SELECT candidate_id FROM e EXCEPT SELECT candidate_id FROM fx_raters) UNION ALL (SELECT candidate_id FROM fx_raters EXCEPT SELECT candidate_id FROM e))) = 0 AS baseline_coverage_identical,
       (SELECT count(*) FROM ((SELECT candidate_id FROM e EXCEPT SELECT candidate_id FROM fx_annotations WHERE is_gegenpressing IN (0, 1))
         UNION ALL (SELECT candidate_id FROM fx_annotations WHERE is_gegenpressing IN (0, 1) EXCEPT SELECT candidate_id FROM e))) = 0 AS graph_coverage_identical""")
def _(s):
    e = s.manifest.where("eligible_for_detection_training")
    return gates.protocol_checks(e, s.raters, s.annotations.where(F.col("is_gegenpressing").isin(0, 1)), s.split_table)


@query("gate_answers", """
SELECT bool_and(label IN (-1, 0, 1)) AS labels_valid, bool_and(confidence IN (1, 2, 3)) AS confidence_valid, bool_and(trim(notes) <> '') AS notes_present,
       bool_and(trim(person) <> '') AS person_present, bool_and(try_cast(utc AS TIMESTAMPTZ) IS NOT NULL) AS utc_valid,
       count(DISTINCT lower(trim(person))) = 1 AS single_person, bool_and(role = 'second') AS role_matches, bool_and(hash = 'v1') AS hash_matches,
       (SELECT count(*) FROM ((SELECT candidate_id FROM fx_answers EXCEPT SELECT candidate_id FROM fx_annotations) UNION ALL (SELECT candidate_id FROM fx_annotations EXCEPT SELECT candidate_id FROM fx_answers))) = 0 AS ids_complete FROM fx_answers""")
def _(s):
    return gates.answer_checks(labels.explode_answers(s.answer_sheets), s.annotations, "second", "v1")


@query("gate_raters", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT lower(person) AS p FROM fx_answers) WHERE p IN (SELECT lower(trim(annotator)) FROM fx_annotations)) = 0 AS second_rater_differs,
       (SELECT count(DISTINCT lower(person)) FROM fx_answers) = 1 AS one_second_rater""")
def _(s):
    earlier = s.annotations.where(F.col("annotator").isNotNull()).select(F.col("annotator").alias("person"))
    return gates.rater_checks(labels.explode_answers(s.answer_sheets), earlier)


@query("gate_complete_predictions", "SELECT model, count(*) = count(DISTINCT candidate_id) AS unique, count(DISTINCT candidate_id) = (SELECT count(*) FROM fx_raters) AS complete FROM fx_predictions GROUP BY model")
def _(s):
    return gates.complete_prediction_checks(s.predictions, s.raters)



