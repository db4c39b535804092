"""Regularised logistic regression for all turns of a protocol at once.

A Newton step is one pass over the rows: tasks add up each turn's loss, gradient
and curvature over its train rows. A turn whose loss does not fall takes half the
step. Missing values, means and deviations come from each turn's train rows, by
way of sums and value counts per group, which turns share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from .parallel import TEST, TRAIN, Turns, partitions, summed

STEPS = 60
TOLERANCE = 1e-9


@dataclass
class Logistic:
    names: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    #: By turn: intercept, then a coefficient per standardised feature.
    coefficients: np.ndarray

    def design(self, values: np.ndarray, turn: int) -> np.ndarray:
        filled = np.where(np.isnan(values), self.medians[turn], values)
        return np.column_stack([np.ones(len(values)), (filled - self.means[turn]) / self.scales[turn]])


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch[c].to_numpy(zero_copy_only=False), dtype=float) for c in names])


def turn_medians(rows: DataFrame, names: Sequence[str], turns: Turns) -> np.ndarray:
    """Exact median by turn and feature over train rows; 0 for a feature without values.

    Values are counted by group before a turn takes the counts of its groups.
    """
    long = rows.select("group", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["group"], list(names), "feature", "value")
    counted = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("group", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    trained = F.array(*[F.array(*[F.lit(r) for r in np.flatnonzero(turns.roles[:, g] == TRAIN).tolist()]).cast("array<int>") for g in range(len(turns.groups))])
    each = counted.select(F.explode(F.element_at(trained, F.col("group") + 1)).alias("turn"), "feature", "value", "n")
    out = np.zeros((len(turns), len(names)))
    for row in ordered.exact_quantiles(each, ["turn", "feature"], "value", {"median": 0.5}, weight="n").collect():
        out[row["turn"], list(names).index(row["feature"])] = row["median"]
    return out


def fit(rows: DataFrame, names: Sequence[str], turns: Turns) -> Logistic:
    """Balanced weights and an L2 penalty of unit strength against the summed loss, the intercept free.

    ``rows`` (group, y, features) are read once a step; the driver holds a
    vector and a matrix of the features per turn.
    """
    names = tuple(names)
    d, n, groups = len(names), len(turns), len(turns.groups)
    medians = turn_medians(rows, names, turns)

    def moments(batches):
        """Rows by class; then number, sum and squares about a fixed origin, of each feature's values."""
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x, group, y = _matrix(batch, names) - medians[0], np.asarray(batch["group"]), np.asarray(batch["y"])
            for g in np.unique(group):
                own, known = x[group == g], ~np.isnan(x[group == g])
                filled = np.where(known, own, 0)
                total = np.concatenate([np.bincount(y[group == g], minlength=2)[:2], known.sum(axis=0), filled.sum(axis=0), (filled**2).sum(axis=0)]).astype(float)
                out[int(g)] = out.get(int(g), 0) + total
        return out

    sums = summed(rows, moments, 2 + 3 * d, groups)
    weights = turns.weights(sums[:, :2])
    train = (turns.roles == TRAIN).astype(float) @ sums
    total = np.maximum(train[:, :2].sum(axis=1, keepdims=True), 1)
    known, first, second = np.split(train[:, 2:], 3, axis=1)
    shift = medians - medians[0]
    missing = total - known
    means = (first + missing * shift) / total
    variance = np.maximum((second + missing * shift**2) / total - means**2, 0)
    scales = np.where(variance > 1e-24, np.sqrt(variance), 1.0)
    model = Logistic(names, medians, means + medians[0], scales, np.zeros((n, d + 1)))
    penalty = np.diag([0.0] + [1.0] * d)
    best = np.full(n, np.inf)
    kept, step = model.coefficients.copy(), np.zeros((n, d + 1))
    open_ = np.ones(n, bool)
    parts = partitions(rows)
    for _ in range(STEPS):
        trial = kept - step

        def newton(batches, trial=trial, active=open_.copy()):
            out = {}
            for batch in batches:
                x, group, y = _matrix(batch, names), np.asarray(batch["group"]), np.asarray(batch["y"])
                for r in np.flatnonzero(active):
                    use = turns.roles[r, group] == TRAIN
                    design, target = model.design(x[use], r), y[use]
                    z, w = design @ trial[r], weights[r, target]
                    p = 1 / (1 + np.exp(-z))
                    loss = (w * (np.logaddexp(0, z) - target * z)).sum()
                    curve = (design * (w * p * (1 - p))[:, None]).T @ design
                    found = np.concatenate([[loss], design.T @ (w * (p - target)), curve.ravel()])
                    out[int(r)] = out[int(r)] + found if int(r) in out else found
            return out

        found = summed(rows, newton, 1 + (d + 1) + (d + 1) ** 2, n, parts)
        for r in np.flatnonzero(open_):
            loss = found[r, 0] + trial[r] @ penalty @ trial[r] / 2
            if loss > best[r] + 1e-12 * abs(best[r]):
                step[r] /= 2
                open_[r] = np.abs(step[r]).max() > TOLERANCE
                continue
            best[r], kept[r] = loss, trial[r]
            gradient = found[r, 1 : d + 2] + penalty @ trial[r]
            step[r] = np.linalg.lstsq(found[r, d + 2 :].reshape(d + 1, d + 1) + penalty, gradient, rcond=None)[0]
            open_[r] = np.abs(step[r]).max() > TOLERANCE
        if not open_.any():
            break
    model.coefficients = kept
    return model


def score(rows: DataFrame, model: Logistic, turns: Turns, roles: Sequence[int] = (TEST,)) -> DataFrame:
    """(turn, role, candidate_id, match_id, y, probability) of the rows that have one of ``roles`` in a turn."""
    data = rows.select("candidate_id", "match_id", "group", "y", *[F.col(c).cast("double").alias(c) for c in model.names])

    def run(batches):
        for batch in batches:
            x, group = _matrix(batch, model.names), np.asarray(batch["group"])
            for r, coefficients in enumerate(model.coefficients):
                role = turns.roles[r, group]
                use = np.flatnonzero(np.isin(role, roles))
                p = 1 / (1 + np.exp(-(model.design(x[use], r) @ coefficients)))
                own = batch.take(pa.array(use))
                values = [pa.array(np.full(len(use), r, np.int32)), pa.array(role[use].astype(np.int32)), own["candidate_id"], own["match_id"], own["y"], pa.array(p)]
                yield pa.RecordBatch.from_arrays(values, ["turn", "role", "candidate_id", "match_id", "y", "probability"])

    return data.mapInArrow(run, "turn int, role int, candidate_id string, match_id string, y int, probability double")
