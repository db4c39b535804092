"""Labels: manifests, queues, reviews, revisions and final decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import MATCH_SPLIT
from ..functions import ordered
from ..functions.columns import coerce_int, count_where, seeded_key, share, strict_bool, truth
from . import keys
from .metrics import rater_agreement

# Annotation columns, review columns and decision names of the data set.
ANNOTATION_COLUMNS = (
    "is_gegenpressing",
    "annotation_confidence",
    "annotation_notes",
    "annotated_at_utc",
    "annotator",
)
MANIFEST_ANNOTATIONS = (
    "candidate_id",
    "is_gegenpressing",
    "annotation_confidence",
    "annotation_notes",
    "annotator",
    "pilot_selected",
    "pilot_order",
)
REVIEW_COLUMNS = (
    "candidate_id",
    "match_id",
    "split",
    "period_id",
    "loss_t_us",
    "loss_frame",
    "is_gegenpressing",
    "annotation_confidence",
    "annotation_notes",
    "annotated_at_utc",
    "annotator",
    "review_reason",
)
# Columns that place a row in the queue, its sample and its pilot.
QUEUE_COLUMNS = ("pilot_selected", "pilot_order", "sample_target_per_outcome", "within_match_order")
OUTCOME_COLUMNS = ("label_regain_5s", "quick_regain_success", "regain_found", "regain_gap_seconds", "regain_frame")
CANONICAL = ["split", "match_id", "period_id", "loss_frame"]


def label_status(label: Column) -> Column:
    return (
        F.when(label.isin(0, 1), "usable").when(label == -1, "uncertain_excluded").otherwise("unlabeled")
    )


def assign_split(df: DataFrame, split_table: DataFrame) -> DataFrame:
    """Split of the match; a match without one is an error, not a dropped row."""
    known = split_table.select("match_id", F.col("split").alias("_split"))
    split = F.when(F.col("_split").isNotNull(), F.col("_split")).otherwise(
        F.raise_error(F.concat(F.lit("match without split: "), F.coalesce("match_id", F.lit("null"))))
    )
    return df.join(known, "match_id", "left").withColumn("split", split).drop("_split")


def assign_fixed_split(df: DataFrame, mapping: dict[str, str] = MATCH_SPLIT) -> DataFrame:
    """Split by a fixed map, as a literal lookup: no join."""
    lookup = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    split = F.coalesce(
        F.try_element_at(lookup, F.col("match_id")),
        F.raise_error(F.concat(F.lit("match without split: "), F.coalesce("match_id", F.lit("null")))),
    )
    return df.withColumn("split", split)


def attach_annotations(episodes: DataFrame, annotations: DataFrame) -> DataFrame:
    available = [c for c in MANIFEST_ANNOTATIONS if c in annotations.columns]
    return keys.one_to_one_join(episodes, annotations.select(*available), ["candidate_id"], "left")


def model_manifest(episodes: DataFrame, annotations: DataFrame, split_table: DataFrame) -> DataFrame:
    """Strict-valid episodes with split and label; unlabelled ones stay in."""
    valid = episodes.where(strict_bool("strict_valid", accept=("true",)))
    label = coerce_int("is_gegenpressing")
    status = label_status(label)
    return attach_annotations(assign_split(valid, split_table), annotations).withColumns(
        {
            "gegenpressing_label": label,
            "label_status": status,
            "eligible_for_detection_training": status == "usable",
        }
    )


def split_manifest(manifest: DataFrame) -> DataFrame:
    episodes, positive = F.count(F.lit(1)), F.coalesce(F.sum("label_regain_5s"), F.lit(0))
    return manifest.groupBy("split", "match_id").agg(
        episodes.alias("strict_valid_episodes"),
        positive.alias("quick_regain_positive"),
        (episodes - positive).alias("quick_regain_negative"),
        count_where(F.col("eligible_for_detection_training")).alias("annotated_usable"),
        count_where(F.col("label_status") == "uncertain_excluded").alias("annotated_uncertain"),
    )


def _with_split(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Annotations with the split of their candidate; one without is an error."""
    split_map = manifest.select("candidate_id", F.col("split").alias("_split")).distinct()
    split = F.when(F.col("_split").isNotNull(), F.col("_split")).otherwise(
        F.raise_error(F.concat(F.lit("annotation without split: "), F.col("candidate_id")))
    )
    return annotations.join(split_map, "candidate_id", "left").withColumn("split", split).drop("_split")


def annotation_summary(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    label, confidence = coerce_int("is_gegenpressing"), coerce_int("annotation_confidence")
    return (
        _with_split(annotations, manifest)
        .groupBy("split", "match_id")
        .agg(
            F.count(F.lit(1)).alias("queue"),
            F.count(label).alias("completed"),
            count_where(label.isin(0, 1)).alias("usable"),
            count_where(label == 1).alias("positive"),
            count_where(label == 0).alias("negative"),
            count_where(label == -1).alias("uncertain"),
            count_where(confidence == 1).alias("low_confidence"),
        )
    )


def annotation_progress(annotations: DataFrame) -> DataFrame:
    label = coerce_int("is_gegenpressing")
    return annotations.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(label).alias("completed"),
        (F.count(F.lit(1)) - F.count(label)).alias("remaining"),
        count_where(label == 1).alias("label_1"),
        count_where(label == 0).alias("label_0"),
        count_where(label == -1).alias("label_uncertain"),
    )


def review_reason() -> Column:
    uncertain = truth(coerce_int("is_gegenpressing") == -1)
    low = truth(coerce_int("annotation_confidence") == 1)
    return (
        F.when(uncertain & low, "uncertain_and_low_confidence")
        .when(uncertain, "uncertain")
        .when(low, "low_confidence")
    )


def review_queue(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows to review, blinded: outcome columns can not pass."""
    queue = _with_split(annotations, manifest).withColumn("review_reason", review_reason())
    out = queue.where(F.col("review_reason").isNotNull())
    out = out.select(*[c for c in REVIEW_COLUMNS if c in out.columns])
    leaked = set(out.columns) & set(OUTCOME_COLUMNS)
    if leaked:
        raise ValueError(f"outcome columns in a blinded queue: {sorted(leaked)}")
    return out


def class_per_match(annotations: DataFrame, label: str = "is_gegenpressing") -> DataFrame:
    """Counts per match and label, absent classes 0 (labels are a fixed, small set)."""
    y = F.col(label)
    return annotations.groupBy("match_id").agg(
        count_where(y == -1).alias("uncertain"), count_where(y == 0).alias("negative"), count_where(y == 1).alias("positive")
    )


def preserve_upsert(source: DataFrame, existing: DataFrame) -> DataFrame:
    """Full queue that keeps earlier labels and order; new rows are appended in canonical order.

    Ids that left the source and repeated ids or order numbers are errors. A row
    of ``existing`` without an order number keeps everything else and is numbered
    like a new one.
    """
    order = F.col("annotation_order")
    kept = [c for c in ("annotation_order", *ANNOTATION_COLUMNS, *QUEUE_COLUMNS) if c in existing.columns]
    numbered = keys.checked_unique(existing.where(order.isNotNull()), ["annotation_order"])
    old = numbered.unionByName(existing.where(order.isNull()))
    old = keys.checked_unique(old, ["candidate_id"]).select("candidate_id", *kept, F.lit(True).alias("_old"))
    source_cols = source.columns
    joined = source.withColumn("_known", F.lit(True)).join(old, "candidate_id", "full_outer")
    joined = joined.withColumn(
        "candidate_id",
        F.when(F.col("_known"), F.col("candidate_id")).otherwise(
            F.raise_error(F.concat(F.lit("no longer in the source: "), F.col("candidate_id")))
        ),
    )
    fresh = source.join(old.where(order.isNotNull()).select("candidate_id"), "candidate_id", "left_anti")
    numbers = number_in_matches(
        fresh.select("candidate_id", "match_id", "period_id", "loss_t_us", "loss_frame"),
        ["loss_t_us", "loss_frame"],
        [F.floor(F.col("loss_t_us") / 60_000_000).cast("bigint")],
        "_n",
        parts=["period_id"],
    )
    top = old.agg(F.coalesce(F.max("annotation_order"), F.lit(0)).alias("_top"))
    appended = ordered.with_scalars(numbers.select("candidate_id", "_n"), top)
    out = joined.join(appended, "candidate_id", "left")
    cols = [c for c in source_cols if c not in kept]
    rest = [c for c in kept if c != "annotation_order"]
    return out.select(
        *cols, F.coalesce(order, F.col("_top") + F.col("_n")).alias("annotation_order"), *rest
    )


def number_in_matches(
    df, order: Sequence[str], slices, name: str, inner: str | None = None, parts: Sequence[str] = ()
) -> DataFrame:
    """Consecutive numbers over (match_id, parts, order): numbers within a part plus offsets counted from the parts' sizes."""
    inner = inner or "_within"
    group = ["match_id", *parts]
    cols = [F.col(c).cast("bigint") if isinstance(c, str) else c for c in slices]
    within = ordered.row_numbers(df, group, order, cols, inner)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    offsets = ordered.running_sums(
        sizes, [], group, ordered.text_slices("match_id"), {"_upto": F.col("_size")}
    ).select(*group, (F.col("_upto") - F.col("_size")).alias("_offset"))
    out = within.join(offsets, group).withColumn(name, F.col("_offset") + F.col(inner)).drop("_offset")
    return out if inner != "_within" else out.drop("_within")


def order_numbers(queue: DataFrame, seed: int = 42) -> DataFrame:
    """Random but reproducible order inside each match, numbered through all matches."""
    keyed = queue.withColumn("_digest", seeded_key("candidate_id", seed))
    out = number_in_matches(
        keyed, ["_digest", "candidate_id"], ordered.digest_slices("_digest"), "annotation_order", "within_match_order"
    )
    return out.drop("_digest")


def batch_numbers(queue: DataFrame, size: int = 25) -> DataFrame:
    """Batches of ``size`` in annotation order."""
    numbered = ordered.row_numbers(
        queue, [], ["annotation_order", "candidate_id"], ordered.number_slices("annotation_order"), "_n"
    )
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")


def split_stability(old: DataFrame, new: DataFrame) -> DataFrame:
    pairs = old.select("candidate_id", F.col("split").alias("_old")).join(
        new.select("candidate_id", F.col("split").alias("_new")), "candidate_id"
    )
    moved = count_where(~F.col("_old").eqNullSafe(F.col("_new")))
    return pairs.agg(F.count(F.lit(1)).alias("compared"), moved.alias("moved"), (moved == 0).alias("stable"))


# --- answers and adjudication ----------------------------------------
def explode_answers(sheets: DataFrame) -> DataFrame:
    """Map column ``answers`` to one row per candidate, all other columns kept."""
    rest = [c for c in sheets.columns if c != "answers"]
    return sheets.select(*rest, F.explode("answers").alias("candidate_id", "_a")).select(*rest, "candidate_id", "_a.*")


def rater_conflicts(reference: DataFrame, second: DataFrame) -> DataFrame:
    """(candidate_id, label, notes) of both sides where the labels differ."""
    a = reference.select("candidate_id", F.col("label").alias("label_utama"), F.col("notes").alias("alasan_utama"))
    b = second.select("candidate_id", F.col("label").alias("label_kedua"), F.col("notes").alias("alasan_kedua"))
    return a.join(b, "candidate_id").where(F.col("label_utama") != F.col("label_kedua"))


def decision_class(final: Column, original: Column) -> Column:
    return (
        F.when(final == -1, "dikeluarkan_ragu").when(~final.eqNullSafe(original), "diubah").otherwise("dipertahankan")
    )


def adjudicate(cohort: DataFrame, first: DataFrame, second: DataFrame, consensus: DataFrame) -> DataFrame:
    """Final label per reviewed candidate: consensus before primary before original.

    ``cohort`` holds candidate_id, kelompok and label_asal. A consensus counts
    only where the two raters differ; a difference without one is an error.
    """

    def side(df, name):
        return df.select("candidate_id", F.col("label").alias(name))

    joined = (
        cohort.join(side(first, "_first"), "candidate_id", "left")
        .join(side(second, "label_kedua"), "candidate_id", "left")
        .join(side(consensus, "_both"), "candidate_id", "left")
    )
    primary = F.coalesce("_first", "label_asal")
    conflict = truth(F.col("label_utama") != F.col("label_kedua"))
    settled = F.when(F.col("_both").isNotNull(), F.col("_both")).otherwise(
        F.raise_error(F.concat(F.lit("no consensus for the conflict: "), F.col("candidate_id")))
    )
    final = F.when(conflict, settled).otherwise(F.col("label_utama"))
    return (
        joined.withColumn("label_utama", primary)
        .withColumn("label_akhir", final)
        .withColumn("keputusan", decision_class(F.col("label_akhir"), F.col("label_asal")))
        .select("candidate_id", "kelompok", "label_asal", "label_utama", "label_kedua", "label_akhir", "keputusan")
    )


EXPECTED = "expected_label"


def apply_revisions(annotations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Keyed updates of the annotation columns with ``old_`` values and a change flag.

    Only the five annotation columns can change; anything else in ``revisions`` is refused. A null clears
    a value. Ids that are not annotated are errors, and so is a label other than the one that an
    ``expected_label`` column names.
    """
    extra = set(revisions.columns) - {"candidate_id", EXPECTED, *ANNOTATION_COLUMNS}
    if extra:
        raise ValueError(f"revision of protected columns: {sorted(extra)}")
    changed = [c for c in revisions.columns if c in ANNOTATION_COLUMNS]
    checked = EXPECTED in revisions.columns
    new = keys.checked_unique(revisions, ["candidate_id"]).select(
        "candidate_id",
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in changed],
        *([F.col(EXPECTED).alias("_expected")] if checked else []),
    )
    joined = annotations.withColumn("_here", F.lit(True)).join(new, "candidate_id", "full_outer")
    wrong = ~F.col("is_gegenpressing").eqNullSafe(F.col("_expected")) if checked else F.lit(False)
    known = (
        F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("revision of an unknown id: "), F.col("candidate_id"))))
        .when(truth(F.col("_hit")) & wrong, F.raise_error(F.concat(F.lit("another label than expected: "), F.col("candidate_id"))))
        .otherwise(F.col("candidate_id"))
    )
    joined = joined.withColumn("candidate_id", known)
    keep = [c for c in annotations.columns if c not in changed]
    value = {c: F.when(truth(F.col("_hit")), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in changed}
    differs = F.lit(False)
    for c in changed:
        differs = differs | ~F.col(c).eqNullSafe(value[c])
    return joined.select(
        *keep,
        *[value[c].alias(c) for c in changed],
        *[F.col(c).alias(f"old_{c}") for c in changed],
        (truth(F.col("_hit")) & differs).alias("revised"),
    )


def change_log(revised: DataFrame) -> DataFrame:
    """Long change log: one row per changed column of a revised candidate."""
    columns = [c[4:] for c in revised.columns if c.startswith("old_")]
    entry = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"old_{c}").cast("string").alias("old_value"),
                F.col(c).cast("string").alias("new_value"),
            )
            for c in columns
        ]
    )
    rows = revised.where("revised").select("candidate_id", F.inline(entry))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def latest_decisions(log: DataFrame) -> DataFrame:
    """Latest valid decision per candidate of an append-only log.

    ``max_by`` combines before the shuffle, so a candidate with very many
    revisions costs one row per map task.
    """
    valid = log.where(F.col("label").isin(-1, 0, 1) & F.col("confidence").isin(1, 2, 3))
    row = F.struct("label", "confidence", F.trim("notes").alias("notes"), "annotator", "decided_t_us")
    return (
        valid.groupBy("candidate_id")
        .agg(F.max_by(row, F.struct("decided_t_us", "annotator")).alias("_d"), F.count(F.lit(1)).alias("revisions"))
        .select("candidate_id", "_d.*", "revisions")
    )


# --- crosstabs and queues --------------------------------------------
def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts per (row, column) with totals named TOTAL (grouping sets)."""

    def shown(c):
        return F.when(F.grouping(c) == 1, "TOTAL").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(
            f"{c}_value"
        )

    return df.cube(row, column).agg(shown(row), shown(column), F.count(F.lit(1)).alias("n")).select(
        F.col(f"{row}_value").alias(row), F.col(f"{column}_value").alias(column), "n"
    )


def confidence_by_split(annotated: DataFrame) -> DataFrame:
    c = F.col("annotation_confidence")
    return annotated.groupBy("split").agg(
        *[count_where(c == v).alias(f"confidence_{v}") for v in (1, 2, 3)], count_where(c.isNull()).alias("confidence_null")
    )


def priority_rows(screened: DataFrame) -> DataFrame:
    """Rows a reviewer sees first: labels that are not positive, or short pressure."""
    return screened.where(truth(F.col("label_original") != 1) | truth(F.col("pressure_duration_s") < 0.4))


def label_audit(annotations: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per match: class counts and how many rows each review cohort takes."""
    picked = cohort.groupBy("match_id").agg(
        count_where(F.col("kelompok") == "prioritas").alias("priority"),
        count_where(F.col("kelompok") == "sampel").alias("controls"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        class_per_match(annotations)
        .join(picked, "match_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("priority", "controls")})
    )


def final_choices(first: DataFrame, consensus: DataFrame, log: DataFrame) -> DataFrame:
    """The answer that decides each reviewed row: the consensus on a conflict, else the primary rater's own."""
    conflicts = log.where(F.col("label_utama") != F.col("label_kedua")).select("candidate_id")
    settled = keys.semi_filter(consensus, conflicts, ["candidate_id"])
    return first.join(conflicts, "candidate_id", "left_anti").unionByName(settled)


def finalize_labels(annotations: DataFrame, log: DataFrame, choices: DataFrame) -> DataFrame:
    """Annotations with the five columns of every deciding answer written over the originals.

    ``choices``: candidate_id, label, confidence, person, utc, notes. A result
    that does not pass the annotation checks of :mod:`gates` must not be used;
    :func:`pressline.plans.models.finalize_review` stops there.
    """
    answer = {"is_gegenpressing": "label", "annotation_confidence": "confidence", "annotator": "person", "annotated_at_utc": "utc", "annotation_notes": "notes"}
    new = keys.checked_unique(choices, ["candidate_id"]).select(
        "candidate_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in answer.values()]
    )
    joined = annotations.join(new, "candidate_id", "left").join(log.select("candidate_id", "keputusan"), "candidate_id", "left")
    old = {c: F.col(c) if c in annotations.columns else F.lit(None) for c in answer}
    value = {c: F.when(F.col("_hit"), F.col(f"_{a}")).otherwise(old[c]) for c, a in answer.items()}
    return joined.select(
        "candidate_id", "match_id", F.col("is_gegenpressing").alias("label_original"), *[v.alias(c) for c, v in value.items()], "keputusan"
    )


def decision_summary(log: DataFrame) -> DataFrame:
    """Counts of the decision log and of final labels, agreement and kappa on the controls before discussion."""
    control = F.col("kelompok") == "sampel"
    same = F.col("label_utama") == F.col("label_kedua")
    counts = log.agg(
        F.count(F.lit(1)).alias("n"),
        count_where(~control).alias("n_prioritas"),
        count_where(control).alias("n_sampel"),
        count_where(~same).alias("n_perbedaan"),
        count_where(F.col("keputusan") == "diubah").alias("diubah"),
        count_where(F.col("keputusan") == "dikeluarkan_ragu").alias("dikeluarkan_ragu"),
        share(count_where(control & same), count_where(control)).alias("kesepakatan_sampel"),
        *[count_where(F.col("label_akhir") == v).alias(f"label_{n}") for n, v in (("uncertain", -1), ("0", 0), ("1", 1))],
    )
    kappa = rater_agreement(log.where(control), "label_utama", "label_kedua").select(F.col("kappa").alias("kappa_sampel"))
    return keys.one_row(counts, kappa)
