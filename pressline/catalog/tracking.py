"""Time windows over the event stream; rosters, graphs and pressure over tracking episodes."""

# ruff: noqa: E501

from pyspark.sql import functions as F

from ..conf import GraphShape, PressureConfig
from ..operators import episodes, gates, graph, pressure, roster, windows
from .bindings import EVENT_CFG, TRACK_CFG
from .registry import query, view

CFG = PressureConfig()
SHAPE = GraphShape(frames=32, nodes=23, features=6, edges_per_frame=92)
BASE = 1_704_067_200_000_000 + 86_400_000_000
H24 = 86_400_000_000


def R6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- windows over the event stream ------------------------------------
@query("episode_window", f"""
SELECT c.candidate_id, f.frame_id, f.ball_state, f.owner, (f.t_us - c.loss_t_us) / 1000000.0::DOUBLE AS relative_time_s
FROM fx_candidates c JOIN fx_frames f ON f.match_id = c.match_id AND f.period_id = c.period_id
AND f.t_us BETWEEN c.loss_t_us - {H24} AND c.loss_t_us + {H24}""")
def _(s):
    return windows.episode_window(s.candidates, s.frames, EVENT_CFG).select(
        "candidate_id", "frame_id", "ball_state", "owner", "relative_time_s"
    )


@query("decision_window", f"""
SELECT c.candidate_id, f.frame_id, (f.t_us - c.loss_t_us) / 1000000.0::DOUBLE AS relative_time_s
FROM fx_candidates c JOIN fx_frames f ON f.match_id = c.match_id AND f.period_id = c.period_id
AND f.t_us BETWEEN c.loss_t_us AND c.loss_t_us + {H24}""")
def _(s):
    return windows.decision_window(s.candidates, s.frames, EVENT_CFG).select("candidate_id", "frame_id", "relative_time_s")


@query("outcome_window", f"""
SELECT c.candidate_id, f.frame_id, (f.t_us - c.loss_t_us) / 1000000.0::DOUBLE AS relative_time_s
FROM fx_candidates c JOIN fx_frames f ON f.match_id = c.match_id AND f.period_id = c.period_id
AND f.t_us BETWEEN c.loss_t_us - {H24} AND c.regain_t_us WHERE c.regain_found""")
def _(s):
    return windows.outcome_window(s.candidates, s.frames, EVENT_CFG, pre_us=H24).select(
        "candidate_id", "frame_id", "relative_time_s"
    )


@query("relative_time", """
SELECT c.candidate_id, f.frame_id, (f.t_us - c.loss_t_us) / 1000000.0::DOUBLE AS relative_time_s
FROM fx_candidates c JOIN fx_frames f ON f.match_id = c.match_id AND f.period_id = c.period_id
AND f.t_us BETWEEN c.loss_t_us AND c.regain_t_us WHERE c.regain_found""")
def _(s):
    return windows.outcome_window(s.candidates, s.frames, EVENT_CFG).select("candidate_id", "frame_id", "relative_time_s")


@query("loss_frame_lookup", """
SELECT c.candidate_id, count(f.frame_id) AS loss_rows, count(f.frame_id) = 0 AS missing_loss_frame
FROM fx_tcand c LEFT JOIN fx_tframes f ON f.match_id = c.match_id AND f.period_id = c.period_id AND f.frame_id = c.loss_frame GROUP BY c.candidate_id""")
def _(s):
    return windows.loss_frame_lookup(s.track_candidates, s.track_frames)


@query("event_context", f"""
SELECT c.candidate_id, e.event_id, e.event_type, e.team_id, e.player_id, (e.t_us - (c.loss_t_us - {BASE})) / 1000000.0::DOUBLE AS relative_time_s
FROM fx_candidates c JOIN fx_events e ON e.match_id = c.match_id AND e.period_id = c.period_id
AND e.t_us BETWEEN c.loss_t_us - {BASE} - {H24 // 4} AND c.loss_t_us - {BASE} + {H24 // 4}""")
def _(s):
    shifted = s.candidates.withColumn("loss_t_us", F.col("loss_t_us") - BASE)
    return windows.event_context(shifted, s.match_events, H24 // 4).select(
        "candidate_id", "event_id", "event_type", "team_id", "player_id", "relative_time_s"
    )


@query("lookback_state", """
SELECT c.candidate_id, p.dead_frames_before, p.previous_frame_state FROM fx_candidates c JOIN (
  SELECT frame_id, count(*) FILTER (WHERE ball_state <> 'alive') OVER w AS dead_frames_before, last(ball_state) OVER w AS previous_frame_state
  FROM fx_frames WINDOW w AS (PARTITION BY match_id, period_id ORDER BY t_us, frame_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) p
ON p.frame_id = c.loss_frame""")
def _(s):
    return windows.lookback_state(s.candidates, s.frames, EVENT_CFG).select(
        "candidate_id", "dead_frames_before", "previous_frame_state"
    )


@query("is_ordered", """
SELECT match_id, period_id, bool_and(coalesce(p <= t_us, true)) AS is_ordered FROM (
  SELECT *, lag(t_us) OVER (PARTITION BY match_id, period_id ORDER BY event_id) AS p FROM (
    SELECT match_id, period_id, event_id, CASE WHEN event_id % 200 = 0 THEN t_us + 4000000000000 ELSE t_us END AS t_us FROM fx_events)) GROUP BY match_id, period_id""")
def _(s):
    late = F.when(F.col("event_id") % 200 == 0, F.col("t_us") + 4_000_000_000_000).otherwise(F.col("t_us"))
    return windows.is_ordered(
        s.match_events.select("match_id", "period_id", "event_id", late.alias("t_us")), ["match_id", "period_id"], "event_id", "t_us"
    )


# --- episodes ---------------------------------------------------------
def _window(s):
    return windows.episode_window(s.track_candidates, s.track_frames, TRACK_CFG)


def _decision(s):
    return windows.decision_window(s.track_candidates, s.track_frames, TRACK_CFG)


def _roster(s):
    return roster.active_roster(s.track_candidates, s.positions, roster.player_team(s.track_events))


def _nodes(s):
    return roster.node_table(s.track_candidates, _window(s), _roster(s), s.positions)


def _distances(s):
    return pressure.player_distances(_decision(s), _roster(s), s.positions, CFG)


def _cues(s):
    return pressure.frame_pressure(_distances(s), CFG)


def _rates(s):
    return pressure.backward_rate(_distances(s))


def _audit(s):
    return episodes.episode_audit(
        s.track_candidates, s.track_frames, s.positions, roster.player_team(s.track_events), TRACK_CFG
    )


@query("nearest_snapshot", """
SELECT candidate_id, CAST(target AS DOUBLE) AS target_s, frame_id, relative_time_s FROM fx_window, (VALUES (-0.5), (0.0), (0.31), (0.5), (2.0)) v(target)
QUALIFY row_number() OVER (PARTITION BY candidate_id, target ORDER BY abs(round(relative_time_s - target::DOUBLE, 9)), relative_time_s) = 1""")
def _(s):
    return windows.nearest_snapshots(_window(s), (-0.5, 0.0, 0.31, 0.5, 2.0))


@query("contiguity", """
SELECT candidate_id, count(*) AS frame_count, count(df) > 0 AND bool_and(coalesce(df = 1, true)) AS continuous_frames,
       count(df) > 0 AND bool_and(coalesce(abs(dt - 40000) <= 1, true)) AS regular_25hz
FROM (SELECT candidate_id, frame_id - lag(frame_id) OVER w AS df, t_us - lag(t_us) OVER w AS dt FROM fx_window
      WINDOW w AS (PARTITION BY candidate_id ORDER BY t_us, frame_id)) GROUP BY candidate_id""")
def _(s):
    return windows.contiguity(_window(s), TRACK_CFG)


@query("player_team", "SELECT match_id, player_id, team_id FROM fx_team")
def _(s):
    return roster.player_team(s.track_events)


@query("active_roster", "SELECT candidate_id, player_id, team_id, is_losing, CAST(node_idx AS INT) AS node_idx FROM fx_roster")
def _(s):
    return _roster(s).select("candidate_id", "player_id", "team_id", "is_losing", "node_idx")


NODE = ["candidate_id", "frame_id", "node_idx", "player_id", "x", "y", "speed", "is_ball", "is_losing", "is_opponent", "valid"]


@query("node_table", """
SELECT candidate_id, frame_id, node_idx, player_id, round(x, 6) AS x, round(y, 6) AS y, round(speed, 6) AS speed, is_ball, is_losing, is_opponent, valid FROM fx_nodes""")
def _(s):
    return R6(_nodes(s).select(*NODE), "x", "y", "speed")


@query("knn_edges", "SELECT candidate_id, frame_id, src, dst, round(distance, 6) AS distance FROM fx_edges")
def _(s):
    return R6(graph.knn_edges(s.graph_nodes, TRACK_CFG.k_neighbors), "distance")


view("fx_audit", """
SELECT *, failure_reasons = '' AS strict_valid FROM (SELECT *, concat_ws('|', CASE WHEN missing THEN 'missing_loss_frame' END,
  CASE WHEN active_player_count <> 22 THEN 'active_player_count_not_22' END,
  CASE WHEN losing_player_count <> 11 OR opponent_player_count <> 11 THEN 'team_split_not_11_11' END,
  CASE WHEN NOT complete_window THEN 'incomplete_window' END, CASE WHEN NOT continuous_frames THEN 'non_contiguous_frames' END,
  CASE WHEN NOT regular_25hz THEN 'irregular_timestamps' END,
  CASE WHEN invalid_node_observations > 0 THEN 'invalid_node_positions' END) AS failure_reasons
FROM (SELECT c.candidate_id, c.match_id, c.period_id, c.loss_frame, c.loss_t_us, c.label_regain_5s, coalesce(w.n, 0) AS frame_count, 32 AS expected_frame_count,
  coalesce(r.a, 0) AS active_player_count, coalesce(r.l, 0) AS losing_player_count, coalesce(r.o, 0) AS opponent_player_count,
  coalesce(i.total, 0)::BIGINT AS invalid_node_observations, coalesce(i.most, 0) AS max_invalid_nodes_per_frame, coalesce(i.ball, 0)::BIGINT AS ball_invalid_frames,
  coalesce(w.n, 0) = 32 AS complete_window, coalesce(w.cont, false) AS continuous_frames, coalesce(w.reg, false) AS regular_25hz, NOT coalesce(w.hit, false) AS missing
  FROM fx_tcand c
  LEFT JOIN (SELECT candidate_id, count(*) AS n, bool_or(frame_id = loss_frame) AS hit, count(df) > 0 AND bool_and(coalesce(df = 1, true)) AS cont,
               count(df) > 0 AND bool_and(coalesce(abs(dt - 40000) <= 1, true)) AS reg
             FROM (SELECT *, frame_id - lag(frame_id) OVER v AS df, t_us - lag(t_us) OVER v AS dt FROM fx_window
                   WINDOW v AS (PARTITION BY candidate_id ORDER BY t_us, frame_id)) GROUP BY candidate_id) w USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, count(*) AS a, count(*) FILTER (WHERE is_losing) AS l, count(*) FILTER (WHERE NOT is_losing) AS o FROM fx_roster GROUP BY candidate_id) r USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, sum(b) AS total, max(b) AS most, sum(bb) AS ball FROM (
      SELECT candidate_id, frame_id, count(*) FILTER (WHERE NOT valid) AS b, count(*) FILTER (WHERE NOT valid AND is_ball = 1) AS bb FROM fx_nodes GROUP BY ALL)
    GROUP BY candidate_id) i USING (candidate_id)))""")
AUDIT = [
    "candidate_id", "match_id", "period_id", "loss_frame", "loss_t_us", "label_regain_5s", "frame_count", "expected_frame_count",
    "active_player_count", "losing_player_count", "opponent_player_count", "invalid_node_observations", "max_invalid_nodes_per_frame",
    "ball_invalid_frames", "complete_window", "continuous_frames", "regular_25hz", "strict_valid", "failure_reasons",
]


@query("episode_audit", f"SELECT {', '.join(AUDIT)} FROM fx_audit")
def _(s):
    return _audit(s).select(*AUDIT)


@query("episode_manifest", f"SELECT {', '.join('a.' + c for c in AUDIT)}, c.losing_team, c.opponent_team FROM fx_audit a JOIN fx_tcand c USING (candidate_id)")
def _(s):
    teams = s.track_candidates.select("candidate_id", "losing_team", "opponent_team")
    return _audit(s).select(*AUDIT).join(teams, "candidate_id")


@query("valid_by_label", "SELECT label_regain_5s, strict_valid, count(*) AS n FROM fx_audit GROUP BY ALL")
def _(s):
    return episodes.valid_by_label(_audit(s))


@query("failure_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(failure_reasons, '|')) AS reason FROM fx_audit) WHERE reason <> '' GROUP BY reason")
def _(s):
    return episodes.failure_counts(_audit(s))


@query("roster_distribution", "SELECT match_id, active_player_count, count(*) AS n FROM fx_audit GROUP BY ALL")
def _(s):
    return episodes.roster_distribution(_audit(s))


# --- graphs -----------------------------------------------------------
view("fx_shape", """
SELECT candidate_id, count(*) AS frames, max(n) AS nodes, 6 AS node_features, min(coalesce(e.k, 0)) AS edges_per_frame_min,
       max(coalesce(e.k, 0)) AS edges_per_frame_max, sum(bad)::BIGINT AS invalid_node_observations
FROM (SELECT candidate_id, frame_id, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS bad FROM fx_nodes GROUP BY ALL)
LEFT JOIN (SELECT candidate_id, frame_id, count(*) AS k FROM fx_edges GROUP BY ALL) e USING (candidate_id, frame_id) GROUP BY candidate_id""")


@query("graph_shape", "SELECT * FROM fx_shape")
def _(s):
    return graph.graph_shape(s.graph_nodes, s.graph_edges)


@query("gate_graph", """
SELECT count(*) = count(DISTINCT candidate_id) AS candidate_id_unique,
       (SELECT count(*) FROM fx_tcand WHERE candidate_id NOT IN (SELECT candidate_id FROM fx_shape)) = 0 AS candidate_ids_complete,
       bool_and(frames = 32) AS all_frames, bool_and(nodes = 23) AS all_nodes, bool_and(node_features = 6) AS all_node_features,
       bool_and(edges_per_frame_min = 92 AND edges_per_frame_max = 92) AS all_edges_per_frame, bool_and(invalid_node_observations = 0) AS all_nodes_valid
FROM fx_shape""")
def _(s):
    return gates.graph_checks(graph.graph_shape(s.graph_nodes, s.graph_edges), s.track_candidates, SHAPE)


@query("graph_tables", """
SELECT candidate_id, frame_id, src, dst, round(distance, 6) AS distance FROM fx_edges WHERE candidate_id IN (SELECT candidate_id FROM fx_audit WHERE strict_valid)""")
def _(s):
    nodes = graph.only_valid(s.graph_nodes, _audit(s))
    return R6(graph.knn_edges(nodes, TRACK_CFG.k_neighbors), "distance")


@query("crop_graph", "SELECT candidate_id, frame_id, node_idx, valid FROM fx_nodes WHERE relative_time_s >= -1e-5 AND relative_time_s <= 0.64001")
def _(s):
    return graph.crop(_nodes(s), 0.0, 0.64).select("candidate_id", "frame_id", "node_idx", "valid")


@query("gate_crop", """
WITH c AS (SELECT * FROM fx_nodes WHERE relative_time_s >= -1e-5 AND relative_time_s <= 0.64001),
     e AS (SELECT candidate_id, count(DISTINCT frame_id) AS n, min(relative_time_s) AS a, max(relative_time_s) AS b, bool_and(valid) AS v FROM c GROUP BY candidate_id)
SELECT count(*) AS episodes, bool_and(n = 17) AS frame_count_exact, bool_and(abs(a) < 1e-5 AND abs(b - 0.64) < 1e-5) AS times_exact, bool_and(v) AS masks_complete FROM e""")
def _(s):
    return gates.crop_checks(graph.crop(_nodes(s), 0.0, 0.64), 17, 40_000)


view("fx_train_nodes", "SELECT * FROM (SELECT *, CASE CAST(regexp_extract(match_id, '\\d+') AS INT) % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM fx_nodes) WHERE split = 'train'")
view("fx_norm", """
SELECT avg(x) AS mean_x, avg(y) AS mean_y, avg(speed) AS mean_speed, greatest(stddev_pop(x), 1e-6) AS std_x, greatest(stddev_pop(y), 1e-6) AS std_y,
       greatest(stddev_pop(speed), 1e-6) AS std_speed FROM fx_train_nodes WHERE valid""")


def _norm(s):
    return graph.feature_normalizer(s.graph_nodes.where(s.split_of_source() == "train"))


@query("feature_normalizer", "SELECT round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(mean_speed, 6) AS mean_speed, round(std_x, 6) AS std_x, round(std_y, 6) AS std_y, round(std_speed, 6) AS std_speed FROM fx_norm")
def _(s):
    out = _norm(s)
    return R6(out, *out.columns)


view("fx_normed", """
SELECT candidate_id, frame_id, node_idx, valid, CASE WHEN valid THEN (x - mean_x) / std_x ELSE 0 END AS x, CASE WHEN valid THEN (y - mean_y) / std_y ELSE 0 END AS y,
       CASE WHEN valid THEN (speed - mean_speed) / std_speed ELSE 0 END AS speed, is_ball, is_losing, is_opponent FROM fx_nodes, fx_norm""")


@query("normalize_nodes", "SELECT candidate_id, frame_id, node_idx, valid, round(x, 5) AS x, round(y, 5) AS y, round(speed, 5) AS speed, is_ball, is_losing, is_opponent FROM fx_normed")
def _(s):
    out = graph.normalize_nodes(s.graph_nodes, _norm(s)).drop("match_id", "relative_time_s", "player_id", "t_us")
    return out.withColumns({c: F.round(c, 5) for c in ("x", "y", "speed")})


FEATS = graph.NODE_FEATURES
view("fx_links", "SELECT candidate_id, frame_id, src, dst FROM fx_edges UNION ALL SELECT candidate_id, frame_id, node_idx, node_idx FROM fx_nodes")
view("fx_deg", "SELECT candidate_id, frame_id, dst AS node_idx, count(*)::DOUBLE AS deg FROM fx_links GROUP BY ALL")
for hop, source in ((1, "fx_nodes"), (2, "fx_hop1")):
    sums = ", ".join(f"sum(n.{c} / sqrt(a.deg)) / sqrt(any_value(b.deg)) AS {c}" for c in FEATS)
    view(f"fx_hop{hop}", f"""
SELECT l.candidate_id, l.frame_id, l.dst AS node_idx, any_value(v.valid) AS valid, {sums}
FROM fx_links l JOIN {source} n ON n.candidate_id = l.candidate_id AND n.frame_id = l.frame_id AND n.node_idx = l.src
JOIN fx_deg a ON a.candidate_id = l.candidate_id AND a.frame_id = l.frame_id AND a.node_idx = l.src
JOIN fx_deg b ON b.candidate_id = l.candidate_id AND b.frame_id = l.frame_id AND b.node_idx = l.dst
JOIN fx_nodes v ON v.candidate_id = l.candidate_id AND v.frame_id = l.frame_id AND v.node_idx = l.dst
GROUP BY l.candidate_id, l.frame_id, l.dst""")
view("fx_embed", "SELECT candidate_id, frame_id, " + ", ".join(f"coalesce(avg({c}) FILTER (WHERE valid), 0) AS {c}" for c in FEATS) + " FROM fx_hop2 GROUP BY ALL")


def _embedding(s):
    return graph.frame_embedding(graph.propagate(s.graph_nodes, s.graph_edges))


@query("graph_propagation", "SELECT candidate_id, frame_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS) + " FROM fx_embed")
def _(s):
    return R6(_embedding(s), *FEATS)


POOLED = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(arg_max({c}, frame_id), 6) AS {c}_last, round(regr_slope({c}, frame_id), 6) AS {c}_slope, round(max({c}), 6) AS {c}_max"
    for c in FEATS
)


@query("temporal_pooling", f"SELECT candidate_id, {POOLED} FROM fx_embed GROUP BY candidate_id")
def _(s):
    out = graph.temporal_pooling(_embedding(s))
    return R6(out, *[c for c in out.columns if c != "candidate_id"])


# --- pressure ---------------------------------------------------------
@query("to_metres", "SELECT match_id, frame_id, player_id, round(x * 105, 6) AS x_m, round(y * 68, 6) AS y_m FROM fx_positions")
def _(s):
    return R6(pressure.to_metres(s.positions, CFG).select("match_id", "frame_id", "player_id", "x_m", "y_m"), "x_m", "y_m")


view("fx_local", """
SELECT *, is_losing AND px IS NOT NULL AND py IS NOT NULL AS seen, is_losing AND coalesce(distance <= 15, false) AS near FROM fx_rates""")
view("fx_stretch", """
SELECT *, CASE WHEN seen THEN sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) END AS team_d, CASE WHEN near THEN sqrt((px - lx) * (px - lx) + (py - ly) * (py - ly)) END AS near_d
FROM (SELECT *, avg(CASE WHEN seen THEN px END) OVER f AS cx, avg(CASE WHEN seen THEN py END) OVER f AS cy, avg(CASE WHEN near THEN px END) OVER f AS lx,
             avg(CASE WHEN near THEN py END) OVER f AS ly FROM fx_local WINDOW f AS (PARTITION BY candidate_id, frame_id))""")
view("fx_cues", """
SELECT candidate_id, frame_id, any_value(t_us) AS t_us, any_value(relative_time_s) AS relative_time_s, any_value(bx) AS bx, any_value(by_) AS by_,
       count(*) FILTER (WHERE is_losing AND distance <= 4.572) AS direct_pressers,
       count(*) FILTER (WHERE is_losing AND distance <= 10 AND rate >= 1) AS approaching_pressers,
       count(*) FILTER (WHERE is_losing AND (coalesce(distance <= 4.572, false) OR coalesce(distance <= 10 AND rate >= 1, false))) AS total_pressers,
       count(*) FILTER (WHERE is_losing AND distance <= 10) AS losing_players_within_10m, count(*) FILTER (WHERE is_losing AND distance <= 15) AS losing_players_within_15m,
       min(distance) FILTER (WHERE is_losing) AS minimum_losing_distance_m, max(rate) FILTER (WHERE is_losing) AS maximum_approach_rate_mps,
       min(distance) FILTER (WHERE NOT is_losing) AS nearest_opponent_to_ball_m, avg(team_d) AS team_stretch_m,
       CASE WHEN count(near_d) >= 2 THEN avg(near_d) END AS local_compactness_m
FROM fx_stretch GROUP BY candidate_id, frame_id""")
REAL_CUES = pressure.CUES[6:] + ["relative_time_s"]
CUE_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in REAL_CUES else c for c in pressure.CUES)


@query("central_gradient", "SELECT candidate_id, frame_id, player_id, round(distance, 6) AS distance_m, round(rate, 6) AS approach_rate FROM fx_rates")
def _(s):
    out = pressure.with_approach(_distances(s), CFG)
    return R6(out.select("candidate_id", "frame_id", "player_id", "distance_m", "approach_rate"), "distance_m", "approach_rate")


@query("frame_pressure", f"SELECT candidate_id, frame_id, {CUE_SQL} FROM fx_cues")
def _(s):
    return R6(_cues(s).select("candidate_id", "frame_id", *pressure.CUES), *REAL_CUES)


@query("team_stretch", "SELECT candidate_id, frame_id, round(team_stretch_m, 6) AS team_stretch_m FROM fx_cues")
def _(s):
    return R6(_cues(s).select("candidate_id", "frame_id", "team_stretch_m"), "team_stretch_m")


@query("local_compactness", "SELECT candidate_id, frame_id, round(local_compactness_m, 6) AS local_compactness_m FROM fx_cues")
def _(s):
    return R6(_cues(s).select("candidate_id", "frame_id", "local_compactness_m"), "local_compactness_m")


view("fx_islands", """
SELECT candidate_id, max(CASE WHEN total_pressers >= 1 THEN n1 ELSE 0 END) AS run1, max(CASE WHEN total_pressers >= 2 THEN n2 ELSE 0 END) AS run2 FROM (
  SELECT *, count(*) FILTER (WHERE total_pressers >= 1) OVER (PARTITION BY candidate_id, g1) AS n1, count(*) FILTER (WHERE total_pressers >= 2) OVER (PARTITION BY candidate_id, g2) AS n2
  FROM (SELECT *, sum(CASE WHEN total_pressers >= 1 THEN 0 ELSE 1 END) OVER w AS g1, sum(CASE WHEN total_pressers >= 2 THEN 0 ELSE 1 END) OVER w AS g2
        FROM fx_cues WINDOW w AS (PARTITION BY candidate_id ORDER BY frame_id)))
GROUP BY candidate_id""")
RUNS = "run1 / 25.0::DOUBLE AS pressure_duration_s, run2 / 25.0::DOUBLE AS collective_pressure_duration_s, run1 >= 10 AS sustained_pressure_cue, run2 >= 10 AS sustained_collective_cue"


@query("longest_run", f"SELECT candidate_id, {RUNS} FROM fx_islands")
def _(s):
    return pressure.longest_runs(_cues(s), CFG)


view("fx_features", f"""
SELECT t.candidate_id, c.* EXCLUDE (candidate_id), {RUNS} FROM (SELECT candidate_id, max(total_pressers) AS max_total_pressers, max(direct_pressers) AS max_direct_pressers, max(approaching_pressers) AS max_approaching_pressers,
  min(minimum_losing_distance_m) AS minimum_losing_distance_m, max(maximum_approach_rate_mps) AS maximum_approach_rate_mps,
  max(losing_players_within_10m) AS max_losing_players_within_10m, avg(local_compactness_m) AS mean_local_compactness_m,
  arg_max_null(team_stretch_m, frame_id) - arg_min_null(team_stretch_m, frame_id) AS team_stretch_change_m FROM fx_cues GROUP BY candidate_id) c
RIGHT JOIN (SELECT candidate_id FROM fx_tcand) t USING (candidate_id) LEFT JOIN fx_islands USING (candidate_id)""")
REAL_FEATS = [c for c in pressure.FEATURES if c.endswith(("_m", "_mps", "_s"))]
REAL_FEATS = [c for c in REAL_FEATS if c != "max_losing_players_within_10m"]
FEAT_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in REAL_FEATS else c for c in pressure.FEATURES)


@query("pressure_features", f"SELECT candidate_id, {FEAT_SQL} FROM fx_features")
def _(s):
    return R6(pressure.pressure_features(_cues(s), CFG, s.track_candidates), *REAL_FEATS)


@query("stretch_change", "SELECT candidate_id, round(team_stretch_change_m, 6) AS team_stretch_change_m FROM fx_features WHERE candidate_id IN (SELECT candidate_id FROM fx_cues)")
def _(s):
    return R6(pressure.stretch_change(_cues(s)), "team_stretch_change_m")


view("fx_dstate", "SELECT candidate_id, frame_id, relative_time_s, ball_state, ball_z FROM fx_window WHERE t_us >= loss_t_us")
view("fx_first", """
SELECT c.candidate_id, min(c.relative_time_s) FILTER (WHERE total_pressers >= 1) AS first_cue_s, min(c.relative_time_s) FILTER (WHERE d.ball_state <> 'alive') AS first_dead_after_s,
       count(*) FILTER (WHERE d.ball_state <> 'alive') AS dead_frames, count(*) AS frames, max(d.ball_z) AS ball_z_max_raw
FROM fx_cues c JOIN fx_dstate d USING (candidate_id, frame_id) GROUP BY c.candidate_id""")


@query("first_cue", "SELECT candidate_id, first_cue_s, first_dead_after_s FROM fx_first")
def _(s):
    return pressure.first_cue(_cues(s))


@query("carrier_proxy", """
SELECT candidate_id, frame_id, player_id AS carrier, round(distance, 6) AS carrier_distance_m FROM fx_dist WHERE NOT is_losing AND distance IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY candidate_id, frame_id ORDER BY distance, player_id) = 1""")
def _(s):
    return R6(pressure.carrier_proxy(_distances(s)), "carrier_distance_m")


view("fx_own", """
SELECT candidate_id, frame_id, player_id, is_losing, distance,
       ((CASE WHEN p IS NULL THEN nx - px WHEN n IS NULL THEN px - qx ELSE (nx - qx) / 2 END) / 0.04 * (bx - px)
      + (CASE WHEN p IS NULL THEN ny - py WHEN n IS NULL THEN py - qy ELSE (ny - qy) / 2 END) / 0.04 * (by_ - py)) / CASE WHEN distance > 1e-9 THEN distance WHEN distance IS NOT NULL THEN 1e-9 END AS own_approach
FROM (SELECT *, lag(frame_id) OVER w AS p, lead(frame_id) OVER w AS n, lag(px) OVER w AS qx, lag(py) OVER w AS qy, lead(px) OVER w AS nx, lead(py) OVER w AS ny
      FROM fx_dist WINDOW w AS (PARTITION BY candidate_id, player_id ORDER BY t_us))""")


@query("own_approach", "SELECT candidate_id, frame_id, player_id, round(own_approach, 5) AS own_approach FROM fx_own")
def _(s):
    out = pressure.own_approach(_distances(s), CFG).select("candidate_id", "frame_id", "player_id", "own_approach")
    return out.withColumn("own_approach", F.round("own_approach", 5))


view("fx_back", """
SELECT *, -(dn - lag(dn) OVER w) / nullif(relative_time_s - lag(relative_time_s) OVER w, 0) AS rate, dn - lag(dn) OVER w AS delta FROM (
  SELECT d.candidate_id, d.player_id, d.frame_id, d.t_us, d.relative_time_s, d.speed, sqrt((p.x - f.ball_x) * (p.x - f.ball_x) + (p.y - f.ball_y) * (p.y - f.ball_y)) AS dn
  FROM fx_dist d JOIN fx_window f ON f.candidate_id = d.candidate_id AND f.frame_id = d.frame_id
  JOIN fx_positions p ON p.match_id = f.match_id AND p.frame_id = d.frame_id AND p.player_id = d.player_id WHERE d.is_losing AND d.distance IS NOT NULL)
WINDOW w AS (PARTITION BY candidate_id, player_id ORDER BY t_us)""")


@query("backward_rate", "SELECT candidate_id, frame_id, player_id, round(dn, 6) AS distance_norm, round(rate, 5) AS rate FROM fx_back")
def _(s):
    out = _rates(s).select("candidate_id", "frame_id", "player_id", "distance_norm", "rate")
    return out.withColumns({"distance_norm": F.round("distance_norm", 6), "rate": F.round("rate", 5)})


view("fx_players", """
SELECT *, distance_t1 - distance_t0 AS distance_change, distance_t0 - min_distance AS distance_reduction,
       CASE WHEN distance_t0 > 0 THEN (distance_t0 - min_distance) / distance_t0 END AS distance_reduction_ratio, speed_t1 - speed_t0 AS speed_change,
       coalesce(distance_t1 - distance_t0 < 0, false) AS approached_ball, positive_approach_frames::DOUBLE / observed_frames AS approach_frame_share
FROM (SELECT candidate_id, player_id, arg_min(dn, t_us) AS distance_t0, arg_max(dn, t_us) AS distance_t1, min(dn) AS min_distance, arg_min(speed, t_us) AS speed_t0,
  max(speed) AS max_speed, max(rate) AS max_approach_rate, avg(rate) AS mean_approach_rate, count(frame_id) AS observed_frames, avg(speed) AS mean_speed,
  arg_max(speed, t_us) AS speed_t1, count(*) FILTER (WHERE rate > 0) AS positive_approach_frames, coalesce(sum(abs(delta)), 0) AS total_distance_movement,
  arg_min(relative_time_s, round(dn, 12)) AS time_to_min_distance, arg_min(frame_id, round(dn, 12)) AS min_distance_frame,
  min(relative_time_s) FILTER (WHERE rate > 0) AS first_approach_time FROM fx_back GROUP BY candidate_id, player_id)""")
RESPONSE = ["distance_t0", "distance_t1", "min_distance", "speed_t0", "max_speed", "max_approach_rate", "mean_approach_rate", "distance_change", "distance_reduction"]
TEMPORAL = ["mean_speed", "speed_t1", "total_distance_movement", "approach_frame_share"]
EXTREMA = ["distance_reduction_ratio", "speed_change"]


def _sql(cols, n=5):
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


def R5(df, cols):
    return df.withColumns({c: F.round(c, 5) for c in cols})


@query("player_response", f"SELECT candidate_id, player_id, {_sql(RESPONSE)} FROM fx_players")
def _(s):
    return R5(pressure.player_response(_rates(s)), RESPONSE)


@query("player_temporal", f"SELECT candidate_id, player_id, observed_frames, positive_approach_frames, {_sql(TEMPORAL)} FROM fx_players")
def _(s):
    return R5(pressure.player_temporal(_rates(s)), TEMPORAL)


@query("player_extrema", f"SELECT candidate_id, player_id, time_to_min_distance, min_distance_frame, first_approach_time, approached_ball, {_sql(EXTREMA)} FROM fx_players")
def _(s):
    out = pressure.player_extrema(_rates(s)).select(
        "candidate_id", "player_id", "time_to_min_distance", "min_distance_frame", "first_approach_time", "approached_ball", *EXTREMA
    )
    return R5(out, EXTREMA)


TEAM = ["mean_distance_t0", "mean_distance_t1", "mean_distance_reduction", "max_distance_reduction", "mean_approach_rate", "max_approach_rate", "mean_speed_after_loss", "max_speed_after_loss"]


@query("team_response", """
SELECT candidate_id, count(*) AS n_losing_players, count(*) FILTER (WHERE approached_ball) AS n_players_approached_ball, round(avg(distance_t0), 5) AS mean_distance_t0,
  round(avg(distance_t1), 5) AS mean_distance_t1, round(avg(distance_reduction), 5) AS mean_distance_reduction, round(max(distance_reduction), 5) AS max_distance_reduction,
  round(avg(mean_approach_rate), 5) AS mean_approach_rate, round(max(max_approach_rate), 5) AS max_approach_rate, round(avg(mean_speed), 5) AS mean_speed_after_loss,
  round(max(max_speed), 5) AS max_speed_after_loss, arg_min(player_id, distance_t0) AS closest_player_t0, arg_min(player_id, distance_t1) AS closest_player_t1,
  arg_max(player_id, distance_reduction) AS best_response_player FROM fx_players GROUP BY candidate_id""")
def _(s):
    return R5(pressure.team_response(pressure.player_extrema(_rates(s))), TEAM)


@query("best_response", """
SELECT candidate_id, player_id, round(distance_reduction, 5) AS distance_reduction, CAST(rn AS INT) AS response_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY distance_reduction DESC NULLS LAST, max_approach_rate DESC NULLS LAST, player_id) AS rn FROM fx_players) WHERE rn <= 3""")
def _(s):
    out = pressure.best_response(pressure.player_extrema(_rates(s)), 3)
    return R5(out.select("candidate_id", "player_id", "distance_reduction", "response_rank"), ["distance_reduction"])


# --- screening --------------------------------------------------------
view("fx_screen", """
SELECT f.*, t.label_regain_5s AS label_original, i.first_cue_s, i.dead_frames, i.frames, i.ball_z_max_raw, o.own AS max_own_approach_within_10m_mps, b.d0 AS distance_at_0_m, b.d1 AS distance_at_end_m, b.move AS ball_xy_displacement_m,
       CASE WHEN max_total_pressers IS NULL THEN 'tanpa_data' WHEN max_total_pressers = 0 THEN 'prioritas_tanpa_cue_bola' WHEN pressure_duration_s < 0.4 THEN 'prioritas_cue_singkat'
            WHEN t.label_regain_5s <> 1 THEN 'review_label_negatif_atau_ragu' ELSE 'belum_ditinjau_visual' END AS screening
FROM fx_tcand t LEFT JOIN fx_features f USING (candidate_id) LEFT JOIN fx_first i USING (candidate_id)
LEFT JOIN (SELECT candidate_id, arg_min_null(minimum_losing_distance_m, frame_id) AS d0, arg_max_null(minimum_losing_distance_m, frame_id) AS d1,
        sqrt((arg_max_null(bx, frame_id) - arg_min_null(bx, frame_id)) ** 2 + (arg_max_null(by_, frame_id) - arg_min_null(by_, frame_id)) ** 2) AS move FROM fx_cues GROUP BY candidate_id) b USING (candidate_id)
LEFT JOIN (SELECT candidate_id, max(own_approach) AS own FROM fx_own WHERE is_losing AND distance <= 10 GROUP BY candidate_id) o USING (candidate_id)""")


def _screen(s):
    labelled = s.track_candidates.select("candidate_id", F.col("label_regain_5s").alias("label"))
    return pressure.cue_screening(_distances(s), labelled, CFG)


SCREEN = ["distance_at_0_m", "distance_at_end_m", "ball_xy_displacement_m", "ball_z_max_raw", "max_own_approach_within_10m_mps"]


@query("screening_class", "SELECT candidate_id, label_original, max_total_pressers, pressure_duration_s, screening FROM fx_screen")
def _(s):
    return _screen(s).select("candidate_id", "label_original", "max_total_pressers", "pressure_duration_s", "screening")


@query("cue_screening", f"SELECT candidate_id, label_original, screening, first_cue_s, dead_frames, frames, {_sql(SCREEN)}, {FEAT_SQL} FROM fx_screen")
def _(s):
    out = _screen(s).select("candidate_id", "label_original", "screening", "first_cue_s", "dead_frames", "frames", *SCREEN, *pressure.FEATURES)
    return R6(R5(out, SCREEN), *REAL_FEATS)


@query("priority_queue", "SELECT candidate_id, label_original, pressure_duration_s FROM fx_screen WHERE label_original <> 1 OR pressure_duration_s < 0.4 ORDER BY candidate_id")
def _(s):
    from ..operators import labels

    return labels.priority_rows(_screen(s)).select("candidate_id", "label_original", "pressure_duration_s").orderBy("candidate_id")


@query("flags_dead_restart", """
SELECT s.candidate_id, s.dead_frames > 0 AS dead_after_flag, coalesce(b.n > 0, false) AS near_restart_flag FROM fx_screen s LEFT JOIN (
  SELECT c.candidate_id, p.n FROM fx_tcand c JOIN (SELECT match_id, period_id, frame_id, count(*) FILTER (WHERE ball_state <> 'alive') OVER (PARTITION BY match_id, period_id ORDER BY t_us, frame_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n
  FROM fx_tframes) p ON p.match_id = c.match_id AND p.period_id = c.period_id AND p.frame_id = c.loss_frame) b USING (candidate_id)""")
def _(s):
    look = windows.lookback_state(s.track_candidates, s.track_frames, TRACK_CFG, 5)
    return pressure.restart_flags(_screen(s), look)


@query("gate_features", """
SELECT count(*) = count(DISTINCT candidate_id) AS candidate_id_unique,
  (SELECT count(*) FROM ((SELECT candidate_id FROM fx_features EXCEPT SELECT candidate_id FROM fx_tcand) UNION ALL (SELECT candidate_id FROM fx_tcand EXCEPT SELECT candidate_id FROM fx_features))) = 0 AS candidate_ids_complete,
  true AS no_infinite_values, true AS feature_columns_present, true AS outcome_not_a_feature FROM fx_features""")
def _(s):
    feats = pressure.pressure_features(_cues(s), CFG, s.track_candidates)
    return gates.feature_checks(feats, s.track_candidates, pressure.FEATURES, ["label_regain_5s", "gegenpressing_label"])


