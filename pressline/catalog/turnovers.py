"""Turnover detection and its statistics over the event stream."""

from pyspark.sql import functions as F

from ..operators import turnover
from .bindings import EVENT_CFG
from .registry import query

CHANGE = ["match_id", "period_id", "t_us", "frame_id", "owner", "prev_owner", "ball_state"]


@query("prev_owner", "SELECT match_id, period_id, t_us, frame_id, owner, prev_owner FROM fx_prev")
def _(s):
    return turnover.with_previous_owner(s.frames, EVENT_CFG).select(
        "match_id", "period_id", "t_us", "frame_id", "owner", "prev_owner"
    )


@query("possession_changes", f"SELECT {', '.join(CHANGE)} FROM fx_changes")
def _(s):
    return turnover.possession_changes(s.frames, EVENT_CFG).select(*CHANGE)


@query("alive_changes", f"SELECT {', '.join(CHANGE)} FROM fx_changes WHERE ball_state = 'alive'")
def _(s):
    return turnover.alive_changes(s.frames, EVENT_CFG).select(*CHANGE)


@query("quick_regain", """
SELECT candidate_id, regain_found, label_regain_5s, regain_t_us, regain_frame, regain_gap_seconds FROM fx_candidates""")
def _(s):
    return turnover.quick_regain(turnover.alive_changes(s.frames, EVENT_CFG), EVENT_CFG).select(
        "candidate_id", "regain_found", "label_regain_5s", "regain_t_us", "regain_frame", "regain_gap_seconds"
    )


@query("turnover_candidates", "SELECT * FROM fx_candidates")
def _(s):
    return s.candidates


@query("candidate_key", """
SELECT match_id, period_id, frame_id, match_id || '_P' || period_id || '_F' || frame_id AS candidate_id FROM fx_frames""")
def _(s):
    return s.frames.select("match_id", "period_id", "frame_id", turnover.candidate_key().alias("candidate_id"))


@query("change_gap", """
SELECT candidate_id, (loss_t_us - lag(loss_t_us) OVER (PARTITION BY match_id, period_id ORDER BY loss_t_us, loss_frame))
       / 1000000.0::DOUBLE AS gap_seconds
FROM fx_candidates""")
def _(s):
    return turnover.change_gap(s.candidates, EVENT_CFG).select("candidate_id", "gap_seconds")


LIMITS = {"within_1h": 3600.0, "within_6h": 21600.0, "within_24h": 86400.0}


@query("gap_stats", """
WITH g AS (SELECT (loss_t_us - lag(loss_t_us) OVER (PARTITION BY match_id, period_id ORDER BY loss_t_us, loss_frame))
                  / 1000000.0::DOUBLE AS gap FROM fx_candidates)
SELECT count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, min(gap) AS min, max(gap) AS max,
       count(*) FILTER (WHERE gap <= 3600) AS within_1h, count(*) FILTER (WHERE gap <= 21600) AS within_6h, count(*) FILTER (WHERE gap <= 86400) AS within_24h,
       round(quantile_cont(gap, 0.25), 6) AS q25, round(quantile_cont(gap, 0.5), 6) AS q50,
       round(quantile_cont(gap, 0.75), 6) AS q75, round(quantile_cont(gap, 0.9), 6) AS q90,
       round(quantile_cont(gap, 0.95), 6) AS q95
FROM g""")
def _(s):
    out = turnover.gap_stats(turnover.change_gap(s.candidates, EVENT_CFG), "gap_seconds", LIMITS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75", "q90", "q95")})


@query("regain_distribution", """
SELECT match_id, count(*) AS changes, count(*) FILTER (WHERE regain_found) AS regained, count(*) FILTER (WHERE NOT regain_found) AS not_regained,
       round(100.0::DOUBLE * count(*) FILTER (WHERE regain_found) / count(*), 6) AS regain_pct
FROM fx_candidates GROUP BY match_id""")
def _(s):
    return turnover.regain_distribution(s.candidates).withColumn("regain_pct", F.round("regain_pct", 6))


@query("match_summary", """
SELECT match_id, count(*) AS candidates, sum(label_regain_5s)::BIGINT AS positives,
       count(*) FILTER (WHERE loss_frame % 4 <> 0) AS strict_valid,
       round(count(*) FILTER (WHERE loss_frame % 4 <> 0)::DOUBLE / count(*), 6) AS strict_valid_rate,
       round(sum(label_regain_5s)::DOUBLE / count(*), 6) AS regain_rate
FROM fx_candidates GROUP BY match_id""")
def _(s):
    out = turnover.match_summary(s.candidates, F.col("loss_frame") % 4 != 0)
    return out.withColumns({c: F.round(c, 6) for c in ("strict_valid_rate", "regain_rate")})


@query("possession_quantity", """
WITH f AS (SELECT match_id, count(*) AS frames, count(owner) AS owned_frames,
                  count(*) FILTER (WHERE owner <> prev_owner) AS all_changes,
                  count(*) FILTER (WHERE owner <> prev_owner AND ball_state = 'alive') AS alive_changes
           FROM fx_prev GROUP BY match_id),
     r AS (SELECT match_id, count(*) FILTER (WHERE regain_found) AS regains FROM fx_candidates GROUP BY match_id)
SELECT CASE WHEN grouping(match_id) = 1 THEN 'TOTAL' ELSE match_id END AS match_id, sum(frames)::BIGINT AS frames,
       sum(owned_frames)::BIGINT AS owned_frames, sum(all_changes)::BIGINT AS all_changes,
       sum(alive_changes)::BIGINT AS alive_changes, coalesce(sum(regains), 0)::BIGINT AS regains
FROM f LEFT JOIN r USING (match_id) GROUP BY ROLLUP (match_id)""")
def _(s):
    return turnover.possession_quantity(s.frames, s.candidates, EVENT_CFG)


@query("first_episode", """
SELECT candidate_id, match_id, period_id, loss_t_us, loss_frame, losing_team, opponent_team FROM fx_candidates
WHERE label_regain_5s = 1 ORDER BY match_id, period_id, loss_t_us, loss_frame LIMIT 1""")
def _(s):
    return turnover.first_episode(s.candidates).select(
        "candidate_id", "match_id", "period_id", "loss_t_us", "loss_frame", "losing_team", "opponent_team"
    )
