"""Micro cases of edges, normalising, gradients, runs and compactness."""

import math

import pytest
from pyspark.sql import functions as F

from pressline.conf import PressureConfig
from pressline.operators import graph, pressure

NODE = "candidate_id string, frame_id long, node_idx int, x double, y double, speed double, is_ball int, is_losing int, is_opponent int, valid boolean"
CFG = PressureConfig()


def nodes(spark, points, valid=None):
    rows = [("c", 1, i, float(x), float(y), 0.0, 0, 0, 0, (valid or {}).get(i, True)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, NODE)


def test_knn_ties_go_to_the_lower_node(spark):
    got = graph.knn_edges(nodes(spark, [(0, 0), (1, 0), (0, 1), (1, 1)]), 1).collect()
    assert {r.src: r.dst for r in got} == {0: 1, 1: 0, 2: 0, 3: 1}


def test_frame_with_k_valid_nodes_has_no_edges(spark):
    points = [(i, i * i) for i in range(5)]
    assert graph.knn_edges(nodes(spark, points, {4: False}), 4).count() == 0
    assert graph.knn_edges(nodes(spark, points), 4).count() == 20


def test_knn_equals_brute_force_in_a_crowded_frame(spark):
    import random

    rng = random.Random(1)
    points = [(rng.random(), rng.random()) for _ in range(150)]
    want = set()
    for i, p in enumerate(points):
        near = sorted((math.dist(p, q), j) for j, q in enumerate(points) if j != i)[:4]
        want |= {(i, j) for _, j in near}
    assert {(r.src, r.dst) for r in graph.knn_edges(nodes(spark, points), 4).collect()} == want


def test_invalid_candidate_stops_the_graph(spark):
    df = nodes(spark, [(0, 0), (1, 1)])
    audit = spark.createDataFrame([("c", False)], "candidate_id string, strict_valid boolean")
    assert graph.only_valid(df, audit).count() == 0
    with pytest.raises(Exception, match="not strict-valid"):
        graph.require_valid(df, audit).collect()


def test_normalizer_values(spark):
    df = spark.createDataFrame(
        [("c", 1, 0, 1.0, 2.0, 3.0, 0, 1, 0, True), ("c", 1, 1, 3.0, 4.0, 7.0, 0, 0, 1, True), ("c", 1, 2, 9.0, 9.0, 9.0, 1, 0, 0, False)],
        NODE,
    )
    stats = graph.feature_normalizer(df)
    assert stats.first().asDict() == {"mean_x": 2, "mean_y": 3, "mean_speed": 5, "std_x": 1, "std_y": 1, "std_speed": 2}
    rows = {r.node_idx: r for r in graph.normalize_nodes(df, stats).collect()}
    assert (rows[0].x, rows[1].speed, rows[2].x) == (-1.0, 1.0, 0.0) and rows[1].is_opponent == 1


def test_propagation_equals_matrix_product(spark):
    np = pytest.importorskip("numpy")
    df = nodes(spark, [(0, 0), (1, 0), (0, 2), (3, 3)])
    edges = spark.createDataFrame([("c", 1, 0, 1), ("c", 1, 1, 0), ("c", 1, 2, 0), ("c", 1, 3, 2)], "candidate_id string, frame_id long, src int, dst int")
    a = np.eye(4)
    for s, d in ((0, 1), (1, 0), (2, 0), (3, 2)):
        a[d, s] = 1
    deg = a.sum(axis=1)
    p = a / np.sqrt(np.outer(deg, deg))
    want = p @ p @ np.array([0.0, 1.0, 0.0, 3.0])
    got = {r.node_idx: r.x for r in graph.propagate(df, edges).collect()}
    assert [round(got[i], 9) for i in range(4)] == [round(v, 9) for v in want]


DIST = "candidate_id string, frame_id long, player_id string, is_losing boolean, t_us long, relative_time_s double, ball_state string, ball_x_m double, ball_y_m double, ball_z double, x_m double, y_m double, distance_m double"


def distances(spark, per_player, losing=True):
    rows = []
    for player, values in per_player.items():
        for i, d in enumerate(values):
            x = None if d is None else float(d)
            rows.append(("c", i, player, losing, i * 40_000, i * 0.04, "alive", 0.0, 0.0, 0.0, x, None if d is None else 0.0, x))
    return spark.createDataFrame(rows, DIST)


def test_central_gradient(spark):
    got = pressure.with_approach(distances(spark, {"p": [10, 9, 7, 4]}), CFG).orderBy("frame_id").collect()
    assert [round(r.approach_rate, 6) for r in got] == [25, 37.5, 62.5, 75]


def test_longest_runs(spark):
    flags = [1, 1, 0, 1, 2, 2, 0]
    cues = spark.createDataFrame([("c", i, i * 40_000, f) for i, f in enumerate(flags)] + [("d", i, i * 40_000, 1) for i in range(51)],
                                 "candidate_id string, frame_id long, t_us long, total_pressers long")
    got = {r.candidate_id: r for r in pressure.longest_runs(cues, CFG).collect()}
    assert got["c"].pressure_duration_s == 3 / 25 and got["c"].collective_pressure_duration_s == 2 / 25
    assert got["d"].pressure_duration_s == 2.04 and got["d"].sustained_pressure_cue and not got["d"].sustained_collective_cue


def test_compactness_needs_two_players(spark):
    alone = pressure.frame_pressure(distances(spark, {"p": [10, 10], "q": [40, 40]}), CFG).first()
    assert alone.local_compactness_m is None and alone.losing_players_within_15m == 1
    pair = pressure.frame_pressure(distances(spark, {"p": [2, 2], "q": [4, 4]}), CFG).first()
    assert pair.local_compactness_m == 1.0 and pair.team_stretch_m == 1.0 and pair.direct_pressers == 2


def test_missing_position_is_no_presser(spark):
    row = pressure.frame_pressure(distances(spark, {"p": [None, None], "q": [3, 3]}), CFG).orderBy("frame_id").first()
    assert row.total_pressers == 1 and row.minimum_losing_distance_m == 3.0


def test_screening_classes(spark):
    df = spark.createDataFrame([(0, 0.0, 1), (2, 0.2, 1), (2, 0.8, 0), (2, 0.8, 1)], "max_total_pressers int, pressure_duration_s double, label_original int")
    got = [r[0] for r in df.select(pressure.screening_class()).collect()]
    assert got == [pressure.NO_CUE, pressure.SHORT_CUE, pressure.NOT_POSITIVE, pressure.UNSEEN]


def test_first_values_skip_nulls(spark):
    rates = spark.createDataFrame(
        [("c", "p", 1, 0.0, 5.0, None, None, None), ("c", "p", 2, 0.04, 4.0, 7.0, 25.0, -1.0), ("c", "p", 3, 0.08, 6.0, None, -50.0, 2.0)],
        "candidate_id string, player_id string, frame_id long, relative_time_s double, distance_norm double, speed double, rate double, delta_distance double",
    )
    r = pressure.player_extrema(rates).first()
    assert (r.distance_t0, r.distance_t1, r.speed_t0, r.speed_t1, r.min_distance_frame) == (5.0, 6.0, 7.0, 7.0, 2)
    assert r.first_approach_time == 0.04 and r.total_distance_movement == 3.0 and not r.approached_ball
    assert rates.select(F.max("rate")).first()[0] == 25.0
