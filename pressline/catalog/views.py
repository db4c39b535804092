"""DuckDB counterparts of the bindings, used by the oracle queries."""

from .registry import view

H24 = 86_400_000_000

view("fx_frames", """
SELECT 'M' || user_id AS match_id, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS period_id,
       epoch_us(ts) AS t_us, event_id AS frame_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'T1' WHEN event_type IN ('purchase', 'signup') THEN 'T2' END AS owner,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 7 = 0 THEN 'dead' ELSE 'alive' END AS ball_state, value
FROM events""")

view("fx_prev", """
SELECT *, lag(owner) OVER (PARTITION BY match_id, period_id ORDER BY t_us, frame_id) AS prev_owner FROM fx_frames""")

view("fx_changes", """
SELECT * FROM fx_prev WHERE owner IS NOT NULL AND prev_owner IS NOT NULL AND owner <> prev_owner""")

view("fx_regains", f"""
SELECT c.frame_id AS cf, g.t_us AS regain_t_us, g.frame_id AS regain_frame
FROM fx_changes c JOIN fx_changes g
  ON g.match_id = c.match_id AND g.period_id = c.period_id AND g.owner = c.prev_owner
 AND (g.t_us > c.t_us OR (g.t_us = c.t_us AND g.frame_id > c.frame_id)) AND g.t_us <= c.t_us + {H24}
WHERE c.ball_state = 'alive' AND g.ball_state = 'alive'
QUALIFY row_number() OVER (PARTITION BY c.frame_id ORDER BY g.t_us, g.frame_id) = 1""")

view("fx_candidates", """
SELECT c.match_id || '_P' || c.period_id || '_F' || c.frame_id AS candidate_id, c.match_id, c.period_id,
       c.t_us AS loss_t_us, c.frame_id AS loss_frame, c.prev_owner AS losing_team, c.owner AS opponent_team,
       r.cf IS NOT NULL AS regain_found, CASE WHEN r.cf IS NULL THEN 0 ELSE 1 END AS label_regain_5s,
       r.regain_t_us, r.regain_frame, (r.regain_t_us - c.t_us) / 1000000.0::DOUBLE AS regain_gap_seconds
FROM fx_changes c LEFT JOIN fx_regains r ON r.cf = c.frame_id WHERE c.ball_state = 'alive'""")

view("fx_events", f"""
SELECT 'M' || user_id AS match_id, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS period_id,
       epoch_us(ts) - 1704067200000000 - {H24} AS t_us, event_id, event_type,
       CASE WHEN event_type IN ('view', 'click') THEN 'T1' WHEN event_type IN ('purchase', 'signup') THEN 'T2' END AS team_id,
       CASE WHEN event_id % 5 <> 0 THEN 'P' || (event_id % 50) END AS player_id,
       CASE WHEN event_id % 3 = 0 THEN 'P' || (event_id % 47) END AS receiver_player_id,
       value > 100 AS success
FROM events""")

view("fx_points", """
SELECT 'G' || (vec_id // 230) AS match_id, 1 AS period_id, ((vec_id // 23) % 10) * 100 + i AS frame_id,
       (((vec_id // 23) % 10) * 100 + i) * 40000 AS t_us, vec_id // 23 AS episode, vec_id % 23 AS node, vec_id, i,
       CASE WHEN NOT bad THEN ex END AS x, CASE WHEN NOT bad THEN ey END AS y,
       CASE WHEN (vec_id + i) % 11 <> 0 THEN sqrt(ex * ex + ey * ey) * 10 END AS speed
FROM (SELECT vec_id, i, (vec_id % 17 = 0 AND i % 4 = 1 AND (vec_id // 23) % 3 = 0) OR (vec_id % 41 = 3 AND i = 15 AND (vec_id // 23) % 4 = 1) AS bad,
             CAST(embedding[2 * i + 1] AS DOUBLE) AS ex, CAST(embedding[2 * i + 2] AS DOUBLE) AS ey
      FROM embeddings, range(0, 32) r(i))
WHERE NOT ((vec_id // 23) % 5 = 0 AND i = 20)""")

view("fx_tframes", """
SELECT match_id, period_id, frame_id, t_us, CASE WHEN (i + episode) % 9 = 0 THEN 'dead' ELSE 'alive' END AS ball_state,
       CASE WHEN (i < 15) = (episode % 2 = 0) THEN 'A' ELSE 'B' END AS owner,
       x AS ball_x, y AS ball_y, abs(x) * 3 AS ball_z, speed AS ball_speed
FROM fx_points WHERE node = 22""")

view("fx_positions", """
SELECT match_id, period_id, frame_id, t_us, 'P' || vec_id AS player_id, x, y, speed FROM fx_points WHERE node < 22""")

view("fx_tevents", """
SELECT 'G' || (vec_id // 230) AS match_id, 1 AS period_id, vec_id * 2 AS event_id, vec_id * 1000 AS t_us,
       CASE WHEN vec_id % 23 % 2 = 0 THEN 'A' ELSE 'B' END AS team_id, 'P' || vec_id AS player_id
FROM embeddings WHERE vec_id % 23 < 22
UNION ALL
SELECT 'G' || (vec_id // 230), 1, vec_id * 2 + 1, vec_id * 1000 + 500000000,
       CASE WHEN (vec_id % 23 % 2 = 0) = (vec_id % 7 <> 0) THEN 'A' ELSE 'B' END,
       CASE WHEN vec_id % 13 <> 0 THEN 'P' || vec_id END
FROM embeddings WHERE vec_id % 23 < 22""")

view("fx_tcand", """
SELECT match_id || '_P1_F' || loss_frame AS candidate_id, * FROM (
  SELECT 'G' || (e // 10) AS match_id, 1 AS period_id, ((e % 10) * 100 + 15) * 40000 AS loss_t_us,
         (e % 10) * 100 + CASE WHEN e % 11 = 7 THEN 99 ELSE 15 END AS loss_frame,
         CASE WHEN e % 2 = 0 THEN 'A' ELSE 'B' END AS losing_team, CASE WHEN e % 2 = 0 THEN 'B' ELSE 'A' END AS opponent_team,
         CASE WHEN e % 3 = 0 THEN 1 ELSE 0 END AS label_regain_5s
  FROM (SELECT vec_id // 23 AS e FROM embeddings WHERE vec_id % 23 = 22))""")

view("fx_team", """
SELECT match_id, player_id, arg_min(team_id, t_us) AS team_id FROM fx_tevents
WHERE player_id IS NOT NULL AND team_id IS NOT NULL GROUP BY match_id, player_id""")

view("fx_window", """
SELECT c.candidate_id, c.match_id, c.period_id, c.loss_frame, c.loss_t_us, f.frame_id, f.t_us,
       (f.t_us - c.loss_t_us) / 1000000.0::DOUBLE AS relative_time_s,
       f.ball_state, f.owner, f.ball_x, f.ball_y, f.ball_z, f.ball_speed
FROM fx_tcand c JOIN fx_tframes f ON f.match_id = c.match_id AND f.period_id = c.period_id
 AND f.t_us BETWEEN c.loss_t_us - 600000 AND c.loss_t_us + 640000""")

view("fx_roster", """
SELECT c.candidate_id, c.match_id, c.period_id, p.player_id, t.team_id, t.team_id = c.losing_team AS is_losing,
       row_number() OVER (PARTITION BY c.candidate_id ORDER BY p.player_id) - 1 AS node_idx
FROM fx_tcand c
JOIN fx_positions p ON p.match_id = c.match_id AND p.period_id = c.period_id AND p.frame_id = c.loss_frame
JOIN fx_team t ON t.match_id = c.match_id AND t.player_id = p.player_id
WHERE p.x IS NOT NULL AND p.y IS NOT NULL AND t.team_id IN (c.losing_team, c.opponent_team)""")

view("fx_nodes", """
SELECT w.candidate_id, w.match_id, w.frame_id, w.relative_time_s, CAST(r.node_idx AS INT) AS node_idx, r.player_id,
       CASE WHEN p.x IS NOT NULL AND p.y IS NOT NULL THEN p.x ELSE 0 END AS x,
       CASE WHEN p.x IS NOT NULL AND p.y IS NOT NULL THEN p.y ELSE 0 END AS y,
       coalesce(p.speed, 0) AS speed, 0 AS is_ball, CASE WHEN r.is_losing THEN 1 ELSE 0 END AS is_losing,
       CASE WHEN r.is_losing THEN 0 ELSE 1 END AS is_opponent, p.x IS NOT NULL AND p.y IS NOT NULL AS valid
FROM fx_window w JOIN fx_roster r ON r.candidate_id = w.candidate_id
LEFT JOIN fx_positions p ON p.match_id = w.match_id AND p.period_id = w.period_id AND p.frame_id = w.frame_id
 AND p.player_id = r.player_id
UNION ALL
SELECT w.candidate_id, w.match_id, w.frame_id, w.relative_time_s,
       CAST((SELECT count(*) FROM fx_roster r WHERE r.candidate_id = w.candidate_id) AS INT), 'BALL',
       coalesce(w.ball_x, 0), coalesce(w.ball_y, 0), coalesce(w.ball_speed, 0), 1, 0, 0,
       w.ball_x IS NOT NULL AND w.ball_y IS NOT NULL
FROM fx_window w""")

view("fx_edges", """
SELECT candidate_id, frame_id, src, dst, distance FROM (
  SELECT a.candidate_id, a.frame_id, a.node_idx AS src, b.node_idx AS dst,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance,
         row_number() OVER (PARTITION BY a.candidate_id, a.frame_id, a.node_idx
           ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.node_idx) AS rn
  FROM fx_nodes a JOIN fx_nodes b ON a.candidate_id = b.candidate_id AND a.frame_id = b.frame_id AND a.node_idx <> b.node_idx
  JOIN (SELECT candidate_id, frame_id FROM fx_nodes WHERE valid GROUP BY ALL HAVING count(*) > 4) ok
    ON ok.candidate_id = a.candidate_id AND ok.frame_id = a.frame_id
  WHERE a.valid AND b.valid)
WHERE rn <= 4""")

view("fx_dist", """
SELECT c.candidate_id, c.losing_team, w.frame_id, w.t_us, w.relative_time_s, r.player_id, r.is_losing,
       p.speed, p.x * 105 AS px, p.y * 68 AS py, w.ball_x * 105 AS bx, w.ball_y * 68 AS by_,
       sqrt((p.x * 105 - w.ball_x * 105) * (p.x * 105 - w.ball_x * 105)
          + (p.y * 68 - w.ball_y * 68) * (p.y * 68 - w.ball_y * 68)) AS distance
FROM fx_tcand c JOIN fx_window w ON w.candidate_id = c.candidate_id AND w.t_us >= c.loss_t_us
JOIN fx_roster r ON r.candidate_id = c.candidate_id
LEFT JOIN fx_positions p ON p.match_id = c.match_id AND p.frame_id = w.frame_id AND p.player_id = r.player_id""")

view("fx_rates", """
SELECT *, CASE WHEN pd IS NULL AND prn IS NULL THEN -(nd - distance) / 0.04
               WHEN nrn IS NULL THEN -(distance - pd) / 0.04 ELSE -(nd - pd) / 0.08 END AS rate
FROM (SELECT *, lag(distance) OVER w AS pd, lead(distance) OVER w AS nd,
             lag(frame_id) OVER w AS prn, lead(frame_id) OVER w AS nrn
      FROM fx_dist WINDOW w AS (PARTITION BY candidate_id, player_id ORDER BY t_us, frame_id))""")

view("fx_episodes", """
SELECT 'D' || doc_id AS candidate_id, source AS match_id, CAST(doc_id % 2 + 1 AS INT) AS period_id, doc_id AS loss_frame,
       doc_id * 1000000 AS loss_t_us, CASE WHEN doc_id % 10 = 9 THEN 'False' ELSE 'True' END AS strict_valid,
       CAST(n_chars % 2 AS INT) AS label_regain_5s
FROM documents""")

view("fx_annotations", """
SELECT 'D' || d.doc_id AS candidate_id, d.source AS match_id,
       CASE WHEN l.toxic = 1 AND d.doc_id % 3 = 0 THEN -1 ELSE l.quality END AS is_gegenpressing,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id % 3 + 1 AS INT) END AS annotation_confidence,
       CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN d.doc_id % 4 = 0 THEN ' ' ELSE d.lang END END AS annotation_notes,
       CASE WHEN l.doc_id IS NOT NULL THEN 'r' || (d.doc_id % 2) END AS annotator,
       CASE WHEN l.doc_id IS NOT NULL THEN '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END
         AS annotated_at_utc,
       CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id + 1 END AS annotation_order,
       CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 5 = 0 THEN 'True' ELSE 'False' END AS pilot_selected,
       CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 5 = 0 THEN d.doc_id // 5 + 1 END AS pilot_order
FROM documents d LEFT JOIN labels l USING (doc_id)""")

view("fx_split", """
SELECT DISTINCT source AS match_id, CASE CAST(regexp_extract(source, '\\d+') AS INT) % 5 WHEN 3 THEN 'validation'
       WHEN 4 THEN 'test' ELSE 'train' END AS split
FROM documents""")

view("fx_manifest", """
SELECT e.*, s.split, a.is_gegenpressing, a.annotation_confidence, a.annotation_notes, a.annotator, a.pilot_selected,
       a.pilot_order, a.is_gegenpressing AS gegenpressing_label,
       CASE WHEN a.is_gegenpressing IN (0, 1) THEN 'usable' WHEN a.is_gegenpressing = -1 THEN 'uncertain_excluded'
            ELSE 'unlabeled' END AS label_status,
       coalesce(a.is_gegenpressing IN (0, 1), false) AS eligible_for_detection_training
FROM fx_episodes e JOIN fx_split s USING (match_id) LEFT JOIN fx_annotations a USING (candidate_id)
WHERE lower(e.strict_valid) = 'true'""")

view("fx_raters", """
SELECT 'D' || doc_id AS candidate_id, quality AS rater_1, CASE WHEN doc_id % 50 = 0 THEN -1 ELSE 1 - toxic END AS rater_2
FROM labels""")

view("fx_answers", """
SELECT doc_id // 20 AS sheet_id, CASE WHEN doc_id // 20 % 50 = 49 THEN 'v0' ELSE 'v1' END AS hash, 'second' AS role, 'D' || doc_id AS candidate_id, 'r' || ((doc_id // 20) % 3) AS person,
       quality AS label, CAST(doc_id % 3 + 1 AS INT) AS confidence, 'note ' || doc_id AS notes,
       CASE WHEN doc_id % 37 = 0 THEN 'bad' ELSE '2024-02-01T10:00:00Z' END AS utc
FROM labels""")

view("fx_decisions", """
SELECT 'C' || conv_id AS candidate_id, CASE role WHEN 'system' THEN -1 WHEN 'user' THEN 0 ELSE 1 END AS label,
       CAST(turn % 4 AS INT) AS confidence, text AS notes, role AS annotator,
       turn * 1000000 + CASE WHEN role = 'assistant' THEN 500000 ELSE 0 END AS decided_t_us
FROM conversations""")

view("fx_scores", """
SELECT m.model, CASE CAST(regexp_extract(source, '\\d+') AS INT) % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test'
       ELSE 'train' END AS split, 'D' || d.doc_id AS candidate_id, source AS match_id, l.quality AS y_true,
       CASE WHEN m.model = 'm1' THEN least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE)
            ELSE (d.doc_id * 37 % 101) / 100.0::DOUBLE END AS probability
FROM labels l JOIN documents d USING (doc_id), (VALUES ('m1'), ('m2')) m(model)""")

view("fx_f1_points", """
SELECT model, s AS score, 2.0::DOUBLE * tp / (tp + fp + pos) AS f1
FROM (SELECT v.model, v.s, sum(CASE WHEN p.y_true = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
             sum(CASE WHEN p.y_true = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp, any_value(t.pos)::DOUBLE AS pos
      FROM (SELECT DISTINCT model, probability AS s FROM fx_scores WHERE split = 'validation') v
      JOIN fx_scores p ON p.model = v.model AND p.split = 'validation' AND p.probability >= v.s
      JOIN (SELECT model, sum(y_true) AS pos FROM fx_scores WHERE split = 'validation' GROUP BY model) t ON t.model = v.model
      GROUP BY v.model, v.s)""")

view("fx_threshold", """
SELECT model, score AS threshold FROM fx_f1_points
QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f1, 12) DESC, score) = 1""")

view("fx_predictions", """
SELECT s.*, t.threshold, CASE WHEN s.probability >= t.threshold THEN 1 ELSE 0 END AS y_pred
FROM fx_scores s JOIN fx_threshold t USING (model)""")

view("fx_counts", """
SELECT model, split, count(*) AS n, sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn,
       sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
       sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
       sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp
FROM fx_predictions GROUP BY model, split""")
