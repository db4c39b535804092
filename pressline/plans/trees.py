"""Boosted trees with second-order gains, for all turns of a protocol at once.

Values are cut to at most 255 bins once. A level of a tree is one pass over the
rows: tasks add up gradients and curvatures by (node, feature, bin) for every turn
and take the best splits of the sums; the driver gets and holds only the trees. Where
the features of a tree make few combinations of bins, they are added up by combination,
and one pass gives all its levels. Rows and features are drawn anew for each tree. Margins of finished trees
are written with the rows from time to time, so a pass evaluates few trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .parallel import TEST, TRAIN, Turns, floats, partitions, summed

#: Fixed value: bin of a missing value.
MISSING = 255
#: Trees between two writes of the margins, and combinations of bins (of all turns) that a task adds up at most.
TREES_HELD, COMBINATIONS = 25, 1 << 16


@dataclass(frozen=True)
class TreeConfig:
    trees: int = 200
    depth: int = 3
    step: float = 0.05
    #: Shares of the rows and of the features that a tree sees.
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    least_gain: float = 0.0
    least_curvature: float = 1.0
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """A complete tree: inner nodes in level order, ``feature`` -1 where a node is not split, and leaf values."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        return Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth))

    def nodes(self, cells: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` levels, numbered from 0 within the level."""
        at = np.zeros(len(cells), np.int64)
        for level in range(levels):
            inner = (1 << level) - 1 + at
            feature = self.feature[inner]
            right = (feature >= 0) & (cells[np.arange(len(cells)), feature] > self.bin[inner])
            at = 2 * at + right
        return at

    def split(self, level: int, feature: np.ndarray, at: np.ndarray, children: np.ndarray, cfg: TreeConfig) -> None:
        """Set the splits of a level, and the leaves as if it were the last one."""
        nodes = 1 << level
        self.feature[nodes - 1 : 2 * nodes - 1], self.bin[nodes - 1 : 2 * nodes - 1] = feature, at
        self.leaf[: 2 * nodes] = -cfg.step * children[:, 0] / (children[:, 1] + cfg.penalty)

    def values(self, cells: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(cells, len(self.leaf).bit_length() - 1)]


@dataclass
class Boosted:
    """Trees by turn, the cut points of each feature, and each turn's bin for missing values."""

    names: tuple[str, ...]
    cuts: list[np.ndarray]
    medians: np.ndarray
    trees: list[list[Tree]]


def cut_points(rows: DataFrame, names: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 distinct values of each feature, evenly spaced by rank; all of them where there are no more."""
    ranks = [i / (bins - 1) for i in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), ranks, 10_000).alias(c) for c in names]).first()
    return [np.unique(np.array([v for v in found[c] or [] if v is not None and not np.isnan(v)], float)) for c in names]


def binned(rows: DataFrame, names: Sequence[str], cuts: list[np.ndarray], turns: int) -> DataFrame:
    """Rows with ``cells``, a byte per feature: how many cut points lie below the value."""
    kept = [c for c in rows.columns if c not in names]
    schema = rows.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.full((batch.num_rows, len(names)), MISSING, np.uint8)
            for j, (name, cut) in enumerate(zip(names, cuts, strict=True)):
                value = np.asarray(batch[name].to_numpy(zero_copy_only=False), dtype=float)
                known = ~np.isnan(value)
                cells[known, j] = np.searchsorted(cut, value[known])
            zero = pa.array([[0.0] * turns] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array([c.tobytes() for c in cells], pa.binary()), zero], [*kept, "cells", "margins"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    typed = rows.select(*kept, *[F.col(c).cast("double").alias(c) for c in names])
    return typed.mapInArrow(run, f"{fields}, cells binary, margins array<double>")


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["cells"].to_pylist()), np.uint8).reshape(batch.num_rows, width).astype(np.int64)


def drawn(keys: np.ndarray, draw: int, share: float) -> np.ndarray:
    """A share of the rows by a hash of key and draw: the same rows however they are dealt."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) / 2.0**64 < share


def best_splits(sums: np.ndarray, allowed: np.ndarray, cfg: TreeConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, child sums) per node from ``sums[node, feature, bin, (gradient, curvature)]``.

    Rows up to and including the bin go left. Equal gains go to the lower feature,
    then to the lower bin. A node without a split hands its sums to its left child.
    """
    nodes, features, bins, _ = sums.shape
    whole = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)
    right = whole[:, None, None, :] - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + cfg.penalty)
    gain = (score(left) + score(right) - score(whole)[:, None, None]) / 2
    possible = (left[..., 1] >= cfg.least_curvature) & (right[..., 1] >= cfg.least_curvature) & allowed[None, :, None]
    gain = np.where(possible, gain, -np.inf).reshape(nodes, -1)
    # sums of equal rows may differ in the last bits with the order of tasks
    top = gain.max(axis=1, keepdims=True)
    best = (gain >= top - 1e-10 * np.maximum(np.abs(top), 1)).argmax(axis=1) if nodes else np.zeros(0, np.int64)
    feature, at = np.divmod(best, bins)
    split = np.take_along_axis(gain, best[:, None], axis=1)[:, 0] > max(cfg.least_gain, 1e-9)
    children = np.stack([left[np.arange(nodes), feature, at], right[np.arange(nodes), feature, at]], axis=1)
    children[~split] = np.stack([whole, np.zeros_like(whole)], axis=1)[~split]
    return np.where(split, feature, -1), np.where(split, at, 0), children.reshape(2 * nodes, 2)


def histogram(cells: np.ndarray, values: tuple[np.ndarray, ...], tree: Tree, level: int, bins: int) -> np.ndarray:
    """``sums[node, feature, bin, value]`` of rows in the nodes of a level."""
    nodes, width = 1 << level, cells.shape[1]
    at = (tree.nodes(cells, level)[:, None] * width + np.arange(width)) * bins + cells
    return np.stack([np.bincount(at.ravel(), np.repeat(v, width), minlength=nodes * width * bins) for v in values], axis=-1).reshape(nodes, width, bins, -1)


def whole_tree(total: np.ndarray, features: np.ndarray, bins: int, cfg: TreeConfig) -> Tree:
    """All levels from ``total[combination, (gradient, curvature)]``: a combination of the features' bins is split as its rows are."""
    total = total.reshape(-1, 2)
    found = np.flatnonzero(total.any(axis=1))
    cells, tree = np.stack(np.unravel_index(found, (bins,) * len(features)), axis=1), Tree.of_depth(cfg.depth)
    for level in range(cfg.depth):
        tree.split(level, *best_splits(histogram(cells, tuple(total[found].T), tree, level, bins), np.ones(len(features), bool), cfg), cfg)
    tree.feature = np.where(tree.feature >= 0, features[tree.feature], -1)
    return tree


def _filled(cells: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(cells == MISSING, medians, cells)


def fit(rows: DataFrame, names: Sequence[str], turns: Turns, cfg: TreeConfig = TreeConfig()) -> Boosted:
    """Train all turns on rows (candidate_id, group, y, features); the driver holds trees only.

    Missing values take the bin of the median of the turn's train rows; cut
    points are taken from all rows that some turn trains on.
    """
    width, n = len(names), len(turns)
    keyed = rows.withColumn("key", F.xxhash64("candidate_id"))
    trained = np.flatnonzero((turns.roles == TRAIN).any(axis=0)).tolist()
    cuts = cut_points(rows.where(F.col("group").isin(trained)), names, cfg.bins)
    bins = max([len(c) + 1 for c in cuts], default=1)
    data = stage(binned(keyed, names, cuts, n), "binned")
    groups = len(turns.groups)

    def count(batches):
        """Rows by class, then values by feature and bin, of each group."""
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, group, y = _cells(batch, width), np.asarray(batch["group"]), np.asarray(batch["y"])
            for g in np.unique(group):
                own = cells[group == g]
                parts = [np.bincount(y[group == g], minlength=2)[:2]]
                parts += [np.bincount(own[own[:, j] != MISSING, j], minlength=bins)[:bins] for j in range(width)]
                total = np.concatenate(parts).astype(float)
                out[int(g)] = out.get(int(g), 0) + total
        return out

    counts = summed(data, count, 2 + width * bins, groups)
    train = (turns.roles == TRAIN).astype(float)
    weights = turns.weights(counts[:, :2])
    upto = np.cumsum((train @ counts[:, 2:]).reshape(n, width, bins), axis=2)
    medians = (upto <= np.floor(upto[:, :, -1:] / 2)).sum(axis=2).clip(max=bins - 1)
    model = Boosted(tuple(names), cuts, medians, [[] for _ in range(n)])
    parts = partitions(data)
    seen = max(1, int(cfg.columns * width))
    at_once = n * bins**seen <= COMBINATIONS
    draw = np.random.default_rng(cfg.seed)
    held = 0
    for number in range(cfg.trees):
        allowed = np.zeros(width, bool)
        allowed[draw.choice(width, seen, replace=False)] = True
        trees = [Tree.of_depth(cfg.depth) for _ in range(n)]
        recent = [trees_of[len(trees_of) - held :] for trees_of in model.trees]
        for level in range(1 if at_once else cfg.depth):
            nodes = 1 << level

            def gradients(batches, level=level, allowed=allowed, trees=trees, recent=recent, number=number):
                sums = {}
                for batch in batches:
                    cells, group, y = _cells(batch, width), np.asarray(batch["group"]), np.asarray(batch["y"])
                    margins = floats(batch["margins"], n)
                    chosen = drawn(np.asarray(batch["key"]), cfg.seed * 100_003 + number, cfg.rows)
                    for r in range(n):
                        use = chosen & (turns.roles[r, group] == TRAIN)
                        own = _filled(cells[use], medians[r])
                        p = 1 / (1 + np.exp(-(margins[use, r] + sum(t.values(own) for t in recent[r]))))
                        w = weights[r, y[use]]
                        g, h = w * (p - y[use]), w * p * (1 - p)
                        if at_once:
                            cell = np.ravel_multi_index(tuple(own[:, allowed].T), (bins,) * seen)
                            found = np.stack([np.bincount(cell, v, minlength=bins**seen) for v in (g, h)], axis=-1).ravel()
                        else:
                            found = histogram(own, (g, h), trees[r], level, bins).ravel()
                        sums[r] = sums[r] + found if r in sums else found
                return sums

            def splits(total, nodes=nodes, allowed=allowed):
                feature, at, children = best_splits(total.reshape(nodes, width, bins, 2), allowed, cfg)
                return np.concatenate([feature + 1, at, children.ravel()]).astype(float)

            def grown(total, allowed=allowed):
                tree = whole_tree(total, np.flatnonzero(allowed), bins, cfg)
                return np.concatenate([tree.feature + 1, tree.bin, tree.leaf]).astype(float)

            inner = (1 << cfg.depth) - 1
            for tree, found in zip(trees, summed(data, gradients, 3 * inner + 1 if at_once else 6 * nodes, n, parts, grown if at_once else splits), strict=True):
                if at_once:
                    tree.feature, tree.bin, tree.leaf = found[:inner].astype(np.int64) - 1, found[inner : 2 * inner].astype(np.int64), found[2 * inner :]
                else:
                    tree.split(level, found[:nodes].astype(np.int64) - 1, found[nodes : 2 * nodes].astype(np.int64), found[2 * nodes :].reshape(-1, 2), cfg)
        for found, tree in zip(model.trees, trees, strict=True):
            found.append(tree)
        held += 1
        if held == TREES_HELD and number + 1 < cfg.trees:
            data, held = stage(_with_margins(data, model, held), "margins"), 0
            parts = partitions(data)
    return model


def _with_margins(data: DataFrame, model: Boosted, last: int) -> DataFrame:
    """Rows whose margins include the ``last`` trees of each turn."""
    width, n = len(model.names), len(model.trees)
    names = data.columns

    def run(batches):
        for batch in batches:
            cells, margins = _cells(batch, width), floats(batch["margins"], n).copy()
            for r, trees in enumerate(model.trees):
                own = _filled(cells, model.medians[r])
                margins[:, r] += sum(t.values(own) for t in trees[len(trees) - last :])
            lists = pa.array(list(margins), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists if c == "margins" else batch[c] for c in names], names)

    return data.mapInArrow(run, data.schema)


def score(rows: DataFrame, model: Boosted, turns: Turns, roles: Sequence[int] = (TEST,)) -> DataFrame:
    """(turn, role, candidate_id, match_id, y, probability) of the rows that have one of ``roles`` in a turn."""
    width = len(model.names)
    data = binned(rows.select("candidate_id", "match_id", "group", "y", *model.names), model.names, model.cuts, 1)

    def run(batches):
        for batch in batches:
            cells, group = _cells(batch, width), np.asarray(batch["group"])
            for r, trees in enumerate(model.trees):
                role = turns.roles[r, group]
                use = np.flatnonzero(np.isin(role, roles))
                margin = np.zeros(len(use)) + sum(t.values(_filled(cells[use], model.medians[r])) for t in trees)
                own = batch.take(pa.array(use))
                values = [pa.array(np.full(len(use), r, np.int32)), pa.array(role[use].astype(np.int32)), own["candidate_id"], own["match_id"], own["y"], pa.array(1 / (1 + np.exp(-margin)))]
                yield pa.RecordBatch.from_arrays(values, ["turn", "role", "candidate_id", "match_id", "y", "probability"])

    return data.mapInArrow(run, "turn int, role int, candidate_id string, match_id string, y int, probability double")
