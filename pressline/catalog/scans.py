"""Scans, sinks and profiles."""

# ruff: noqa: E501

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import gates, profile
from ..session import shared_file, stage
from ..sources import tables, tracking
from .bindings import EVENT_CFG
from .registry import query, view
from .tracking import R6

DAY = 86_400_000_000


def _folder(s, name):
    return shared_file(s.spark, name)


def elapsed_text(t):
    """Text form of elapsed micros: days may be negative, the clock part never is."""
    days = F.floor(t / F.lit(DAY))
    rest = t - days * DAY
    sec = F.floor(rest / 1_000_000)
    return F.concat(
        days.cast("string"),
        F.when(days < 0, " days +").otherwise(" days "),
        F.format_string("%02d:%02d:%02d.%06d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, rest % 1_000_000),
    )


def _wide(s, slots=22):
    """All players of each episode as columns, the way raw tracking files hold them."""
    points = s._points.where(F.col("node") < slots)
    by = points.groupBy("match_id", "period_id", "frame_id", "t_us").agg(
        *[
            F.max(F.when(F.col("node") == n, F.col(c))).alias(f"DFL-OBJ-{n:04d}_{'s' if c == 'speed' else c}")
            for n in range(slots)
            for c in ("x", "y", "speed")
        ]
    )
    ball = s.track_frames.select("match_id", "period_id", "frame_id", "ball_state", F.col("owner").alias("ball_owning_team_id"), "ball_x", "ball_y", "ball_z", "ball_speed")
    return by.join(ball, ["match_id", "period_id", "frame_id"]).withColumn("timestamp", elapsed_text(F.col("t_us"))).drop("t_us")


@query("scan_tracking", "SELECT match_id, period_id, frame_id, t_us, ball_state, owner, ball_x, ball_y, ball_z, ball_speed FROM fx_tframes")
def _(s):
    path = _folder(s, "tracking")
    tables.write_csv(_wide(s), path)
    return tracking.typed_frames(tracking.read_csv(s.spark, path))


@query("unpivot_tracks", """
SELECT match_id, period_id, frame_id, t_us, 'DFL-OBJ-' || lpad(CAST(node AS VARCHAR), 4, '0') AS player_id, x, y, speed FROM fx_points
WHERE node < 22 AND coalesce(x, y, speed) IS NOT NULL AND episode IN (SELECT vec_id // 23 FROM embeddings WHERE vec_id % 23 = 22)""")
def _(s):
    return tracking.unpivot_tracks(_wide(s))


@query("load_folder", """
SELECT match_id, period_id, frame_id, t_us, 'DFL-OBJ-' || lpad(CAST(node AS VARCHAR), 4, '0') AS player_id, x, y, speed FROM fx_points
WHERE node < 22 AND coalesce(x, y, speed) IS NOT NULL AND episode IN (SELECT vec_id // 23 FROM embeddings WHERE vec_id % 23 = 22)""")
def _(s):
    """Positions of a folder of match files, read in one plan."""
    path = _folder(s, "matches")
    _wide(s).write.option("header", True).partitionBy("match_id").csv(path)
    return tracking.load_folder(s.spark, path, tracking="*.csv", events="*.csv", match=r"match_id=([^/]+)/")[1]


@query("scan_pruned", "SELECT event_id, event_type, value FROM events")
def _(s):
    return s.table("events").select("event_id", "event_type", "value")


def _raw_events(s):
    return s.match_events.select(
        "match_id", F.col("period_id").cast("string"), elapsed_text(F.col("t_us")).alias("timestamp"), F.col("event_id").cast("string"),
        "event_type", "team_id", "player_id", "receiver_player_id", F.initcap(F.col("success").cast("string")).alias("success"),
    )


@query("scan_events", "SELECT * FROM fx_events")
def _(s):
    path = _folder(s, "events")
    tables.write_csv(_raw_events(s), path)
    return tracking.typed_events(tracking.read_csv(s.spark, path))


@query("parse_elapsed", "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN t_us END AS t_us FROM fx_events")
def _(s):
    text = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(elapsed_text(F.col("t_us")))
    return s.match_events.select("event_id", C.elapsed_us(text).alias("t_us"))


@query("scan_manifest", """
SELECT candidate_id, match_id, is_gegenpressing, annotation_confidence, CAST(annotation_order AS INT) AS annotation_order, CAST(pilot_order AS INT) AS pilot_order FROM fx_annotations""")
def _(s):
    path = _folder(s, "manifest")
    cols = ["candidate_id", "match_id", "is_gegenpressing", "annotation_confidence", "annotation_order", "pilot_order"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in cols[2:]]
    tables.write_csv(s.annotations.select(*cols[:2], *text), path)
    return tables.read_manifest(s.spark, path)


@query("write_tables", "SELECT candidate_id, match_id, split, label_status FROM fx_manifest")
def _(s):
    path = _folder(s, "manifest")
    tables.write_partitioned(s.manifest.select("candidate_id", "match_id", "split", "label_status"), path, order=["candidate_id"])
    return s.spark.read.parquet(path)


@query("file_inventory")
def _(s):
    return tables.file_inventory(s.spark, s.dir, "*.parquet")


@query("gate_artifacts", """
SELECT TRUE AS all_expected_files_nonempty, TRUE AS baseline_marked_final, TRUE AS graph_model_marked_final, TRUE AS evaluation_marked_final,
       TRUE AS run_manifest_complete, TRUE AS summary_marked_final, ok AS evaluation_checks_passed, ok AS annotation_checks_passed,
       TRUE AS expected_models_present, TRUE AS critical_hashes_listed, TRUE AS artifact_hashes_match, ok AS frozen_annotations_complete
FROM (SELECT bool_and(is_gegenpressing IN (-1, 0, 1)) AS ok FROM fx_annotations WHERE is_gegenpressing IS NOT NULL)""")
def _(s):
    """The folder's hashes are listed in a table written first, and checked against a later inventory.

    A table is one file or a folder of files; either is one artifact.
    """
    table = F.substring_index("path", "/", 1)
    manifest = stage(tables.by_artifact(tables.file_inventory(s.spark, s.dir, "*.parquet"), table).select(F.create_map("path", "sha256").alias("artifact_sha256")), "run_manifest")
    inventory = tables.by_artifact(tables.file_inventory(s.spark, s.dir, "*.parquet"), table)
    usable = s.annotations.where(F.col("is_gegenpressing").isNotNull())
    flags = usable.agg(C.all_true(F.col("is_gegenpressing").isin(-1, 0, 1)).cast("string").alias("ok"))
    names = ["baseline.final_run", "temporal_gnn.final_run", "evaluation.final_run", "check.annotation.labels_valid", "check.evaluation.labels_valid"]
    rows = [F.struct(F.lit(n).alias("name"), F.col("ok").alias("value")) for n in names]
    fixed = [("status", "final_training_complete"), ("summary.status", "FINAL"), ("model", "m1"), ("model", "m2")]
    rows += [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in fixed]
    metadata = flags.select(F.inline(F.array(*rows)))
    files = ["documents.parquet", "labels.parquet", "events.parquet"]
    return gates.artifact_checks(inventory, tables.listed_hashes(manifest), metadata, usable, files, files[:2], ["m1", "m2"])


@query("require_columns", "SELECT match_id, period_id, t_us, frame_id, owner FROM fx_frames")
def _(s):
    return C.require_columns(s.frames, "match_id", "period_id", "t_us", "frame_id", "owner").select("match_id", "period_id", "t_us", "frame_id", "owner")


@query("union_matches", "SELECT match_id, period_id, frame_id, owner FROM fx_frames UNION ALL SELECT match_id, period_id, frame_id, owner FROM fx_tframes")
def _(s):
    cols = ["match_id", "period_id", "frame_id", "owner"]
    return tracking.union_matches([s.frames.select(*cols), s.track_frames.select(*cols)])


# --- profiles ---------------------------------------------------------
@query("event_type_filter", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error')")
def _(s):
    return profile.event_type_filter(s.table("events"), ["purchase", "error"]).select("event_id", "event_type", "value")


@query("negative_time", "SELECT period_id, event_type, count(*) AS n, min(t_us) AS earliest_us FROM fx_events WHERE t_us < 0 GROUP BY ALL")
def _(s):
    return profile.negative_time(s.match_events)


@query("dataset_audit", """
SELECT 'frames' AS dataset, count(*) AS rows, 7 AS columns, count(DISTINCT period_id) AS periods, count(*) - count(t_us) AS timestamp_missing FROM fx_frames
UNION ALL SELECT 'events', count(*), 9, count(DISTINCT period_id), count(*) - count(t_us) FROM fx_events""")
def _(s):
    return profile.dataset_audit({"frames": s.frames, "events": s.match_events})


@query("possession_coverage", """
SELECT count(*) FILTER (WHERE ball_state = 'alive') AS alive_frames,
       round(count(*) FILTER (WHERE ball_state = 'alive' AND owner IS NOT NULL)::DOUBLE / count(*) FILTER (WHERE ball_state = 'alive'), 6) AS owned_share FROM fx_frames""")
def _(s):
    return R6(profile.possession_coverage(s.frames), "owned_share")


FIELDS = ["t_us", "team_id", "player_id", "receiver_player_id", "success"]


@query("field_completeness", " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS non_null, round(100.0::DOUBLE * count({c}) / count(*), 2) AS percent FROM fx_events" for c in FIELDS))
def _(s):
    return profile.field_completeness(s.match_events, FIELDS)


@query("value_counts", "SELECT team_id, count(*) AS n FROM fx_events GROUP BY team_id")
def _(s):
    return profile.value_counts(s.match_events, "team_id")


@query("transition_summary", """
SELECT event_type, count(*) AS n, count(team_id) AS team_id_available, count(player_id) AS player_id_available, count(success) AS success_available
FROM fx_events WHERE event_type IN ('purchase', 'error', 'view') GROUP BY event_type""")
def _(s):
    wanted = profile.event_type_filter(s.match_events, ["purchase", "error", "view"])
    return profile.transition_summary(wanted, ["team_id", "player_id", "success"])


@query("time_audit", "SELECT period_id, count(t_us) AS n, min(t_us) AS min_us, max(t_us) AS max_us, count(*) FILTER (WHERE t_us < 0) AS negative FROM fx_events GROUP BY period_id")
def _(s):
    return profile.time_audit(s.match_events)


@query("event_team_changes", """
SELECT match_id, period_id, event_id, team_id, prev_team_id FROM (SELECT *, lag(team_id) OVER (PARTITION BY match_id, period_id ORDER BY t_us, event_id) AS prev_team_id
FROM fx_events WHERE team_id IS NOT NULL) WHERE prev_team_id <> team_id""")
def _(s):
    return profile.event_team_changes(s.match_events, EVENT_CFG).select("match_id", "period_id", "event_id", "team_id", "prev_team_id")


@query("split_matches", "SELECT DISTINCT split, match_id FROM fx_manifest")
def _(s):
    return profile.split_matches(s.manifest)


@query("split_summary", """
SELECT split, count(DISTINCT match_id) AS matches, count(*) AS strict_valid_episodes, sum(label_regain_5s)::BIGINT AS quick_regain_positive,
       count(*) FILTER (WHERE eligible_for_detection_training) AS annotated_usable, (SELECT string_agg(match_id, ', ' ORDER BY match_id) FROM (SELECT DISTINCT match_id FROM fx_manifest x WHERE x.split = m.split)) AS match_names,
       min(match_id) AS first_match, max(match_id) AS last_match,
       (count(*) - sum(label_regain_5s))::BIGINT AS quick_regain_negative, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM fx_manifest), 2) AS episode_share_percent
FROM fx_manifest m GROUP BY split""")
def _(s):
    return profile.split_summary(s.manifest)


NUMBERS = ["quality", "toxic", "n_chars"]
view("fx_long", "SELECT 'quality' AS feature, quality::DOUBLE AS value FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'n_chars', n_chars FROM documents")


@query("feature_profile", """
SELECT feature, count(value) AS count, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM fx_long GROUP BY feature""")
def _(s):
    rows = s.table("documents").select("doc_id", "n_chars").join(s.table("labels"), "doc_id", "left")
    return R6(profile.feature_profile(rows, NUMBERS), "mean", "std")
