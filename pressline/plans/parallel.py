"""Data-parallel sums of arrays, and the turns of a training protocol.

A fit reads its staged rows once per step: every task adds up what the step needs
(gradients, curvatures, histograms) for all turns in one pass over its Arrow
batches and returns one array per turn. Arrays are added in a tree, so no task
meets more than ``FAN_IN`` of them for each turn, and tasks add up the last ones too:
the driver gets one array per turn, whose size depends on the model alone, or what a
task makes of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays of one turn that are added at a time.
FAN_IN = 64
#: Roles of a group of rows in a turn.
TRAIN, VALIDATION, TEST = 0, 1, 2
ROLES = {"train": TRAIN, "validation": VALIDATION, "test": TEST}

SUMS = "turn int, part int, total binary"


@dataclass(frozen=True)
class Turns:
    """What each group of rows is used for in each turn: ``roles[turn, group]``.

    Groups are the splits of a fixed split, or the matches of a rotation; there
    are few of either, and rows carry the number of their group.
    """

    groups: tuple[str, ...]
    roles: np.ndarray

    @staticmethod
    def fixed(splits: Sequence[str] = tuple(ROLES)) -> Turns:
        return Turns(tuple(splits), np.array([[ROLES[s] for s in splits]]))

    @staticmethod
    def rotation(matches: Sequence[str]) -> Turns:
        """Turn i tests match i and validates on the next one; the last is followed by the first."""
        n = len(matches)
        if n < 3:
            raise ValueError("a rotation needs three matches at least")
        roles = np.full((n, n), TRAIN)
        roles[np.arange(n), (np.arange(n) + 1) % n] = VALIDATION
        roles[np.arange(n), np.arange(n)] = TEST
        return Turns(tuple(matches), roles)

    def __len__(self) -> int:
        return len(self.roles)

    def numbered(self, df: DataFrame, column: str) -> DataFrame:
        """Rows with the number of their group; rows of no group are left out."""
        number = F.coalesce(*[F.when(F.col(column) == g, F.lit(i)) for i, g in enumerate(self.groups)])
        return df.withColumn("group", number).where(F.col("group").isNotNull())

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Balanced class weights by turn from row counts ``[group, class]``; an absent class counts as one row."""
        n = (self.roles == TRAIN).astype(float) @ counts
        return n.sum(axis=1, keepdims=True) / (2 * np.maximum(n, 1))


def _rows(sums: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    for turn, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([part], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["turn", "part", "total"])


def _adding(finish: Callable[[np.ndarray], np.ndarray] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            found = sorted(zip(batch["turn"].to_pylist(), batch["part"].to_pylist(), batch["total"].to_pylist(), strict=True))
            for turn, _, total in found:
                array = np.frombuffer(total, "<f8")
                sums[turn] = sums[turn] + array if turn in sums else array
        if finish is not None:
            sums = {turn: finish(total) for turn, total in sums.items()}
        yield from _rows(sums, TaskContext.get().partitionId())

    return run


def partitions(rows: DataFrame) -> int:
    return rows.rdd.getNumPartitions()


def summed(
    rows: DataFrame,
    step: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]],
    size: int,
    turns: int,
    parts: int | None = None,
    finish: Callable[[np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """``step`` of every task added up: ``[turn, size]``; a turn that no task met is zero.

    ``parts``: partitions of ``rows``, if known from an earlier step. With
    ``finish``, a task applies it to each turn's sum, and ``size`` numbers of a turn
    are what it returns.
    """

    def run(batches):
        yield from _rows(step(batches), TaskContext.get().partitionId())

    parts = parts or partitions(rows)
    sums = rows.mapInArrow(run, SUMS)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts, F.col("part") % parts).mapInArrow(_adding(), SUMS)
    if parts > 1 or finish is not None:
        # adaptive execution merges the partitions of small arrays, so that few tasks add them; one turn needs one
        sums = (sums.repartition(1) if turns == 1 else sums.repartition("turn")).mapInArrow(_adding(finish), SUMS)
    out = np.zeros((turns, size))
    for row in sums.collect():
        out[row["turn"]] += np.frombuffer(row["total"], "<f8")
    return out


def floats(column: pa.Array, width: int) -> np.ndarray:
    """An array column of ``width`` doubles as a matrix."""
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return np.asarray(flat, dtype=float).reshape(len(column), width)
