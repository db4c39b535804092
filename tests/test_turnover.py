"""Micro cases of turnover detection, elapsed times and event windows."""

import pytest
from pyspark.sql import functions as F

from pressline.conf import EpisodeConfig, TimeSlices
from pressline.functions.columns import elapsed_us
from pressline.operators import turnover, windows

CFG = EpisodeConfig(slices=TimeSlices(fine=400_000, coarse=4_000_000))
SCHEMA = "match_id string, period_id int, t_us long, frame_id long, owner string, ball_state string"


def frames(spark, rows, match="m"):
    """rows: (seconds, owner, state)"""
    data = [(match, 1, round(t * 1e6), round(t * 25), o, s) for t, o, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def test_null_owner_hides_a_change(spark):
    df = frames(spark, [(0, "A", "alive"), (0.04, None, "alive"), (0.08, "B", "alive")])
    assert turnover.possession_changes(df, CFG).count() == 0


def test_change_on_a_dead_frame_is_no_candidate(spark):
    df = frames(spark, [(0, "A", "alive"), (0.04, "B", "dead"), (0.08, "B", "alive")])
    assert turnover.possession_changes(df, CFG).count() == 1
    assert turnover.alive_changes(df, CFG).count() == 0


def test_regain_limit_is_inclusive(spark):
    near = frames(spark, [(9.96, "A", "alive"), (10, "B", "alive"), (15, "A", "alive")], "near")
    far = frames(spark, [(9.96, "A", "alive"), (10, "B", "alive"), (15.04, "A", "alive")], "far")
    rows = turnover.turnover_candidates(near.unionByName(far), CFG).where("losing_team = 'A'").collect()
    found = {r.match_id: r for r in rows}
    assert found["near"].regain_found and found["near"].regain_gap_seconds == 5.0
    assert not found["far"].regain_found and found["far"].regain_frame is None
    assert found["near"].candidate_id == "near_P1_F250"


def test_regain_is_not_only_the_next_change(spark):
    df = frames(spark, [(0, "A", "alive"), (1, "B", "alive"), (2, "C", "alive"), (3, "A", "alive")])
    first = turnover.turnover_candidates(df, CFG).where("losing_team = 'A'").first()
    assert first.regain_frame == 75 and first.regain_gap_seconds == 2.0


def test_candidates_equal_a_plain_loop_on_one_hot_match(spark):
    import random

    rng = random.Random(5)
    rows = [(i * 0.04, rng.choice(["A", "B", "C", None]), rng.choice(["alive", "alive", "dead"])) for i in range(600)]
    changes, prev = [], None
    for t, owner, state in rows:
        if owner and prev and owner != prev and state == "alive":
            changes.append((round(t * 25), prev, owner))
        prev = owner
    want = {}
    for i, (frame, lost, _) in enumerate(changes):
        later = [f for f, _, new in changes[i + 1 :] if new == lost and (f - frame) * 40_000 <= 5_000_000]
        want[frame] = later[0] if later else None
    got = {r.loss_frame: r.regain_frame for r in turnover.turnover_candidates(frames(spark, rows), CFG).collect()}
    assert got == want


def test_input_order_does_not_matter(spark):
    rows = [(i * 0.5, "ABC"[i * i % 3], "alive") for i in range(40)]
    a = turnover.turnover_candidates(frames(spark, rows), CFG)
    b = turnover.turnover_candidates(frames(spark, rows[::-1]).repartition(3), CFG)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_elapsed_text(spark):
    cases = {
        "0 days 00:01:25.320000": 85_320_000,
        "-1 days +23:59:58.500000": -1_500_000,
        "1 days": 86_400_000_000,
        "0 days 00:00:01": 1_000_000,
        "x": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", elapsed_us("s").alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_full_window_at_a_power_of_two(spark):
    """T0 = 64.04 s has 101 frames; float arithmetic would lose the first one."""
    df = frames(spark, [(f / 25, "A", "alive") for f in range(1500, 1700)])
    cand = spark.createDataFrame([("c", "m", 1, 64_040_000)], "candidate_id string, match_id string, period_id int, loss_t_us long")
    w = windows.episode_window(cand, df, CFG)
    assert w.count() == CFG.expected_frame_count == 101
    assert windows.decision_window(cand, df, CFG).count() == 51
    c = windows.contiguity(w, CFG).first()
    assert c.continuous_frames and c.regular_25hz and c.frame_count == 101


def test_empty_window_is_an_error(spark):
    df = frames(spark, [(1, "A", "alive")])
    cand = spark.createDataFrame([("c", "m", 1, 900_000_000)], "candidate_id string, match_id string, period_id int, loss_t_us long")
    with pytest.raises(Exception, match="empty window"):
        windows.require_frames(cand, windows.decision_window(cand, df, CFG)).collect()


def test_interval_join_equals_plain_join(spark):
    df = frames(spark, [(f * 0.37, "A", "alive") for f in range(200)])
    cand = df.where(F.col("frame_id") % 30 < 9).select(
        F.col("frame_id").cast("string").alias("candidate_id"), "match_id", "period_id", F.col("t_us").alias("loss_t_us")
    )
    got = windows.episode_window(cand, df, CFG).select("candidate_id", "frame_id")
    plain = cand.join(df, ["match_id", "period_id"]).where(F.abs(F.col("t_us") - F.col("loss_t_us")) <= 2_000_000)
    plain = plain.select("candidate_id", "frame_id")
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_lookback_counts_dead_frames(spark):
    df = frames(spark, [(f / 25, "A", "dead" if f in (3, 8, 9) else "alive") for f in range(30)])
    cand = spark.createDataFrame([("c", "m", 1, 10)], "candidate_id string, match_id string, period_id int, loss_frame long")
    row = windows.lookback_state(cand, df, CFG, rows=5).first()
    assert row.dead_frames_before == 2 and row.previous_frame_state == "dead"


def test_nearest_snapshot_prefers_the_earlier_frame(spark):
    df = spark.createDataFrame([("c", 1, 0.4), ("c", 2, 0.6), ("c", 3, 2.0)], "candidate_id string, frame_id long, relative_time_s double")
    got = {r.target_s: r.frame_id for r in windows.nearest_snapshots(df, (0.5, 1.9)).collect()}
    assert got == {0.5: 1, 1.9: 3}
