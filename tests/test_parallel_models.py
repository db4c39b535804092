"""Fits that serve all turns of a protocol in one pass, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.plans import models, newton, parallel, temporal_graph, trees

NAMES = ["f1", "f2", "f3"]


def table(n=240, seed=3, matches=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 3)
    y = (x[:, 0] * 2 - x[:, 1] + 0.7 * rng.normal(size=n) > 0.3).astype(int)
    x[rng.random((n, 3)) < 0.08] = np.nan
    group = rng.integers(0, matches, n)
    return x, y, group


def frame(spark, x, y, group):
    rows = [(f"c{i}", f"m{g}", int(g), int(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t, g) in enumerate(zip(x, y, group, strict=True))]
    return spark.createDataFrame(rows, "candidate_id string, match_id string, group int, y int, f1 double, f2 double, f3 double").repartition(3)


def test_rotation_roles():
    turns = parallel.Turns.rotation(["a", "b", "c", "d"])
    assert turns.roles.tolist() == [[2, 1, 0, 0], [0, 2, 1, 0], [0, 0, 2, 1], [1, 0, 0, 2]]
    with pytest.raises(ValueError, match="three matches"):
        parallel.Turns.rotation(["a", "b"])


def test_sums_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(parallel, "FAN_IN", 2)
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("turn")).repartition(9)

    def step(batches):
        out = {}
        for batch in batches:
            for t, i in zip(batch["turn"].to_pylist(), batch["id"].to_pylist(), strict=True):
                out[t] = out.get(t, np.zeros(2)) + np.array([1.0, i])
        return out

    got = parallel.summed(rows, step, 2, 4)
    want = [[sum(1 for i in range(1000) if i % 3 == t), sum(i for i in range(1000) if i % 3 == t)] for t in range(4)]
    assert got.tolist() == want


def plain_split(x, g, h, cfg):
    """(gain, feature, value) of the best first split by trying every value."""
    best = (-1.0, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + cfg.penalty)
    whole = np.ones(len(g), bool)
    for j in range(x.shape[1]):
        for v in np.unique(x[:, j]):
            left = x[:, j] <= v
            if h[left].sum() < cfg.least_curvature or h[~left].sum() < cfg.least_curvature:
                continue
            gain = (score(left) + score(~left) - score(whole)) / 2
            if gain > best[0] + 1e-9:
                best = (gain, j, v)
    return best


def test_first_splits_equal_a_plain_search(spark):
    x, y, group = table(200)
    turns = parallel.Turns.rotation([f"m{i}" for i in range(4)])
    cfg = trees.TreeConfig(trees=1, depth=2, rows=1.0, columns=1.0)
    model = trees.fit(frame(spark, x, y, group), NAMES, turns, cfg)
    for r in range(4):
        use = turns.roles[r, group] == parallel.TRAIN
        filled = np.where(np.isnan(x), np.nanmedian(x[use], axis=0), x)[use]
        w = len(y[use]) / (2 * np.bincount(y[use]))[y[use]]
        g, h = w * (0.5 - y[use]), w * 0.25
        tree = model.trees[r][0]
        gain, j, v = plain_split(filled, g, h, cfg)
        value = lambda node, tree=tree: model.cuts[tree.feature[node]][tree.bin[node]]
        assert (tree.feature[0], set(filled[:, j] <= v) and (filled[:, j] <= v).tolist()) == (j, (filled[:, j] <= value(0)).tolist())
        left = filled[:, j] <= v
        for side, node, leaves in ((left, 1, (0, 1)), (~left, 2, (2, 3))):
            _, k, u = plain_split(filled[side], g[side], h[side], cfg)
            below = filled[side][:, k] <= u
            assert tree.feature[node] == k and below.tolist() == (filled[side][:, k] <= value(node)).tolist()
            for part, leaf in ((below, leaves[0]), (~below, leaves[1])):
                assert tree.leaf[leaf] == pytest.approx(-cfg.step * g[side][part].sum() / (h[side][part].sum() + cfg.penalty))


def test_boosting_lowers_the_loss_and_survives_new_margins(spark, monkeypatch):
    x, y, group = table(300)
    turns = parallel.Turns.rotation([f"m{i}" for i in range(4)])
    rows = frame(spark, x, y, group)
    cfg = trees.TreeConfig(trees=8, step=0.3)
    whole = trees.fit(rows, NAMES, turns, cfg)
    monkeypatch.setattr(trees, "TREES_HELD", 3)
    parts = trees.fit(rows, NAMES, turns, cfg)
    for a, b in zip(sum(whole.trees, []), sum(parts.trees, []), strict=True):
        assert a.feature.tolist() == b.feature.tolist() and np.allclose(a.leaf, b.leaf)
    # a tree sees some features only, the same for all of its nodes
    used = [set(t.feature[t.feature >= 0].tolist()) for t in whole.trees[0]]
    assert all(len(u) <= 2 for u in used) and len(set().union(*used)) == 3
    found = trees.score(rows, whole, turns, (parallel.TRAIN, parallel.TEST)).toPandas()
    loss = -np.log(np.where(found.y == 1, found.probability, 1 - found.probability))
    assert loss[found.role == parallel.TRAIN].mean() < 0.45 and loss[found.role == parallel.TEST].mean() < 0.6
    assert (found[found.role == parallel.TEST].groupby("turn").size() == np.bincount(group)).all()


def test_a_tree_from_combinations_equals_one_by_levels(spark, monkeypatch):
    """Of few combinations of bins, one pass makes the tree that a pass for each level makes."""
    x, y, group = table(300, matches=3)
    rows = frame(spark, np.round(x, 1), y, group)
    turns, cfg = parallel.Turns.fixed(), trees.TreeConfig(trees=5, step=0.3, columns=0.7)
    passes = []
    summed = trees.summed
    monkeypatch.setattr(trees, "summed", lambda *a: passes.append(1) or summed(*a))
    whole = trees.fit(rows, NAMES, turns, cfg)
    assert len(passes) == 1 + 5
    monkeypatch.setattr(trees, "COMBINATIONS", 0)
    levels = trees.fit(rows, NAMES, turns, cfg)
    assert len(passes) == 1 + 5 + 1 + 15
    for a, b in zip(whole.trees[0], levels.trees[0], strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and np.allclose(a.leaf, b.leaf)
    assert any((t.feature >= 0).sum() > 3 for t in whole.trees[0])


def test_rows_are_drawn_by_key():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    a, b = trees.drawn(keys, 1, 0.8), trees.drawn(keys, 2, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02
    order = np.random.default_rng(2).permutation(len(keys))
    assert (trees.drawn(keys[order], 1, 0.8) == a[order]).all()


def test_logistic_turns_reach_the_optimum(spark):
    x, y, group = table(240)
    turns = parallel.Turns.rotation([f"m{i}" for i in range(4)])
    rows = frame(spark, x, y, group)
    model = newton.fit(rows, NAMES, turns)
    for r in range(4):
        use = turns.roles[r, group] == parallel.TRAIN
        median = np.nanmedian(x[use], axis=0)
        filled = np.where(np.isnan(x[use]), median, x[use])
        assert np.allclose(model.medians[r], median)
        assert np.allclose(model.means[r], filled.mean(axis=0)) and np.allclose(model.scales[r], filled.std(axis=0))
        design = model.design(x[use], r)
        w = len(y[use]) / (2 * np.bincount(y[use]))[y[use]]
        p = 1 / (1 + np.exp(-(design @ model.coefficients[r])))
        gradient = design.T @ (w * (p - y[use])) + np.r_[0, model.coefficients[r][1:]]
        assert np.abs(gradient).max() < 1e-6
    found = newton.score(rows, model, turns).toPandas()
    assert len(found) == 240 and found.probability.between(0, 1).all()


def test_one_turn_equals_the_library_fit(spark):
    x, y, group = table(200, matches=3)
    rows = frame(spark, x, y, group)
    turns = parallel.Turns.fixed()
    model = newton.fit(rows, NAMES, turns)
    split = F.element_at(F.array(*[F.lit(s) for s in turns.groups]), F.col("group") + 1)
    plain = models.train_logistic(rows.withColumn("split", split).withColumnRenamed("y", models.LABEL).drop("group"), NAMES).toPandas().set_index("candidate_id")
    own = newton.score(rows, model, turns, (0, 1, 2)).toPandas().set_index("candidate_id")
    assert np.abs(own.probability - plain.probability.reindex(own.index)).max() < 1e-3


# ---------------------------------------------------------------- graph network


def graphs(spark, episodes=24, frames=4, roster=6, seed=5):
    """Episodes whose label is the side on which the ball moves; one player is missing now and then."""
    rng = np.random.default_rng(seed)
    nodes, edges, rows = [], [], []
    for e in range(episodes):
        y = e % 2
        rows.append((f"c{e}", f"m{e % 4}", e % 4, y))
        for f in range(frames + e % 2):
            for i in range(roster):
                valid = not (i == 2 and (e + f) % 5 == 0)
                x = rng.normal() * 0.3 + (f * (2 * y - 1) if i == 0 else 0)
                nodes.append((f"c{e}", 100 + f, i, valid, x if valid else 0.0, rng.normal(), rng.normal(), float(i == 0), float(i % 2), float(1 - i % 2)))
                edges += [(f"c{e}", 100 + f, i, int(j)) for j in rng.choice([k for k in range(roster) if k != i], 2, replace=False)]
    n = spark.createDataFrame(nodes, "candidate_id string, frame_id long, node_idx int, valid boolean, x double, y double, speed double, is_ball double, is_losing double, is_opponent double")
    e = spark.createDataFrame(edges, "candidate_id string, frame_id long, src int, dst int")
    r = spark.createDataFrame(rows, "candidate_id string, match_id string, group int, y int")
    return n.repartition(3), e.repartition(3), r


def test_gradient_equals_finite_differences(spark):
    packed = temporal_graph.episode_rows(*graphs(spark, episodes=5)).toArrow().combine_chunks().to_batches()[0]
    e = temporal_graph.unpack(packed)
    e = e.chosen(np.arange(5) != 2, np.zeros(3), np.ones(3))
    net = temporal_graph.Network(temporal_graph.NetworkConfig(hidden=5, state=4))
    vector = net.start() + np.random.default_rng(1).normal(size=net.size) * 0.1
    weight = np.linspace(0.5, 2, len(e.y))
    for epoch in (None, 3):
        loss, gradient = net.gradient(vector, e, weight, epoch)
        assert loss == pytest.approx(-(weight * net.forward(vector, e, epoch)[0][np.arange(len(e.y)), e.y]).sum())
        for i in range(0, net.size, 3):
            near = vector.copy()
            near[i] += 1e-6
            up = -(weight * net.forward(near, e, epoch)[0][np.arange(len(e.y)), e.y]).sum()
            near[i] -= 2e-6
            down = -(weight * net.forward(near, e, epoch)[0][np.arange(len(e.y)), e.y]).sum()
            assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_unpacked_frames_hold_the_normalised_links(spark):
    nodes = spark.createDataFrame([("a", 7, i, True, float(i), 0.0, 0.0, 0.0, 0.0, 0.0) for i in (3, 5, 9)], "candidate_id string, frame_id long, node_idx int, valid boolean, x double, y double, speed double, is_ball double, is_losing double, is_opponent double")
    edges = spark.createDataFrame([("a", 7, 3, 5), ("a", 7, 9, 5), ("a", 99, 3, 5)], "candidate_id string, frame_id long, src int, dst int")
    rows = spark.createDataFrame([("a", "m", 0, 1)], "candidate_id string, match_id string, group int, y int")
    e = temporal_graph.unpack(temporal_graph.episode_rows(nodes, edges, rows).toArrow().combine_chunks().to_batches()[0])
    third = 1 / np.sqrt(3)
    assert np.allclose(e.mix[0], [[1, 0, 0], [third, 1 / 3, third], [0, 0, 1]]) and e.x[0, :, 0].tolist() == [3, 5, 9]


def test_training_learns_a_planted_signal(spark):
    from pressline.session import stage

    turns = parallel.Turns.rotation([f"m{i}" for i in range(4)])
    rows = stage(temporal_graph.episode_rows(*graphs(spark, episodes=32)), "episodes")
    # matches 0, 2 hold label 0 only, so the groups are dealt anew: both labels in each
    rows = stage(rows.withColumn("group", (F.substring("candidate_id", 2, 9).cast("int") / 2).cast("int") % 4), "episodes")
    cfg = temporal_graph.NetworkConfig(hidden=8, state=8, epochs=25, patience=6, dropout=0.0)
    model = temporal_graph.fit(rows, turns, cfg)
    for past in model.history:
        assert all(b < a for a, b in zip(past.train[:8], past.train[1:8], strict=False))
        assert past.validation[past.best] <= min(past.validation) + cfg.least_improvement
        assert past.validation[past.best] < past.validation[0]
    found = temporal_graph.score(rows, model, turns, (parallel.TEST,)).toPandas()
    assert len(found) == 32 and ((found.probability > 0.5) == (found.y == 1)).mean() > 0.9
    # parameters that are kept are those of the best epoch, not of the last one
    again = temporal_graph.fit(rows, turns, temporal_graph.NetworkConfig(hidden=8, state=8, epochs=model.history[0].best + 1, patience=6, dropout=0.0))
    assert np.allclose(again.parameters[0], model.parameters[0])


def test_candidates_share_the_graph_they_name(spark):
    """A borrowed graph is packed once and equals one of the candidate's own."""
    nodes, edges, rows = graphs(spark, episodes=4)
    lent = rows.select("candidate_id", F.concat(F.lit("d"), "candidate_id").alias("own")).unionByName(rows.select("candidate_id", F.concat(F.lit("e"), "candidate_id").alias("own")))
    shared = rows.join(lent, "candidate_id").withColumnRenamed("candidate_id", "graph_id").withColumnRenamed("own", "candidate_id")
    copies = [t.join(lent, "candidate_id").drop("candidate_id").withColumnRenamed("own", "candidate_id") for t in (nodes, edges, rows)]
    got, want = (temporal_graph.episode_rows(*t).orderBy("candidate_id").toArrow().combine_chunks().to_batches()[0] for t in ((nodes, edges, shared), copies))
    assert got["candidate_id"].to_pylist() == want["candidate_id"].to_pylist() and got.num_rows == 8
    got, want = temporal_graph.unpack(got), temporal_graph.unpack(want)
    assert all(np.array_equal(getattr(got, f), getattr(want, f)) for f in ("x", "mix", "valid", "place", "step", "length", "key", "y"))


def test_the_driver_gets_one_array_of_a_turn(spark, monkeypatch):
    """However many tasks read the rows: what reaches the driver does not grow with them."""
    got = []
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("turn")).repartition(9)
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])

    def step(batches):
        out = {}
        for batch in batches:
            for t in batch["turn"].to_pylist():
                out[t] = out.get(t, np.zeros(50)) + 1.0
        return out

    whole = parallel.summed(rows, step, 50, 4)
    assert whole[:, 7].tolist() == [334, 333, 333, 0] and len(got[-1]) == 3
    least = parallel.summed(rows, step, 1, 4, finish=lambda total: total[:1] + 1)
    assert least.tolist() == [[335], [334], [334], [0]] and {len(r["total"]) for r in got[-1]} == {8}


def test_a_graph_that_candidates_share_is_stored_and_passed_once(spark):
    """Rows and sums are those of the candidates, each with a copy of its graph; the graph is there once for all of them."""
    nodes, edges, rows = graphs(spark, episodes=12)
    nodes = nodes.withColumn("relative_time_s", F.lit(0.0))
    lent = rows.select(F.col("candidate_id").alias("graph_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("candidate_id") == "c3", 90).otherwise(9))).alias("n"))
    named = lent.withColumns({"candidate_id": F.concat("graph_id", F.lit("_"), "n"), "match_id": F.concat(F.lit("m"), F.col("n") % 4), models.LABEL: (F.xxhash64("graph_id", "n") % 2 != 0).cast("int")})
    named = named.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in parallel.ROLES]), (F.col("n") % 3 + 1).cast("int"))).drop("n").localCheckpoint()
    turns = parallel.Turns.fixed()
    staged = models.graph_rows(nodes, edges, named, turns, "split")
    assert named.count() == 201 and staged.count() <= 12 + 4
    numbered = models._turn_rows(named, turns, "split", ["graph_id"])
    copies = temporal_graph.episode_rows(nodes, edges, numbered).localCheckpoint()
    cfg = temporal_graph.NetworkConfig(hidden=6, state=5, epochs=5)
    short = temporal_graph.shared_rows(nodes, edges, numbered, members=7).localCheckpoint()
    assert short.agg(F.max(F.size("key"))).first()[0] == 7 and short.selectExpr("explode(candidate_id) c").distinct().count() == 201
    got, cut, want = (temporal_graph.fit(r, turns, cfg) for r in (staged, short, copies))
    for model in (got, cut):
        assert np.allclose(model.means, want.means) and np.allclose(model.scales, want.scales) and np.allclose(model.parameters, want.parameters)
        assert np.allclose(model.history[0].train, want.history[0].train) and np.allclose(model.history[0].validation, want.history[0].validation)
    a, b = (temporal_graph.score(r, want, turns, (0, 1, 2)).toPandas().sort_values("candidate_id").reset_index(drop=True) for r in (short, copies))
    assert len(a) == 201 and a.drop(columns="probability").equals(b.drop(columns="probability")) and np.allclose(a.probability, b.probability)


def test_the_final_run_asks_for_whole_fits(monkeypatch):
    """All trees, and the epochs and patience of a final run; nothing in the query shortens a fit."""
    from pressline import catalog
    from pressline.catalog import modelling
    from pressline.catalog.bindings import Tables

    asked = {}

    def run(annotations, manifest, features, trainers, graph_trainer, folder):
        trainers["boosted_trees"](None)
        graph_trainer(type("Rows", (), {"select": lambda self, *columns: None})())
        raise InterruptedError

    monkeypatch.setattr(modelling, "shared_file", lambda *a: "")
    monkeypatch.setattr(modelling, "_doc_features", lambda s: None)
    monkeypatch.setattr(modelling.labels, "model_manifest", lambda *a: None)
    monkeypatch.setattr(models, "final_run", run)
    monkeypatch.setattr(models, "train_boosted", lambda rows, names, cfg=trees.TreeConfig(): asked.update(trees=cfg))
    monkeypatch.setattr(models, "train_graph_model", lambda nodes, edges, rows, cfg=temporal_graph.NetworkConfig(): asked.update(network=cfg))
    for name in ("finished_annotations", "episodes", "split_table", "graph_nodes", "graph_edges"):
        monkeypatch.setattr(Tables, name, None)
    monkeypatch.setattr(Tables, "borrowing", lambda self, rows: rows)
    with pytest.raises(InterruptedError):
        catalog.queries()["final_run"](None, "")
    assert asked == {"trees": trees.TreeConfig(trees=200), "network": temporal_graph.NetworkConfig(epochs=100, patience=15)}
