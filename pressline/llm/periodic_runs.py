"""Periodic runs of words by block convolution.

A run is a stretch of words whose smallest period ``q`` fits at least twice. At
every dyadic scale ``P`` the text is cut into aligned blocks of about ``P / 2``
words, so a run with a period in ``[P, 2 P)`` holds a whole block together with
the block's copy one period on. The sums of squared differences of a block and
the following windows, for all these distances at once, come from one exact
number-theoretic transform; a sum of zero is an occurrence. Its distance seeds
an extension word by word to both sides, which also settles words that share a
code, so the runs are exact.

The documents of a slice are handled as one sequence in which words of different
documents never equal each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import id_text, slices

#: A prime 15 * 2**27 + 1 and a generator of its group; products of residues fit 64 bits.
PRIME, GENERATOR = 2013265921, 31
#: A run has so many words at least.
LEAST_WORDS = 12
#: Words of a block at the scale of the periods below ``FIRST_SCALE``, and at most.
LEAST_BLOCK, FIRST_SCALE, MOST_BLOCK = 3, 8, 1 << 20
#: Numbers that a transform holds at a time, one row at least.
TRANSFORM_CELLS = 1 << 19

RUNS = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


def _mod(x: np.ndarray) -> np.ndarray:
    return x - (x // np.uint64(PRIME)) * np.uint64(PRIME)


class Transform:
    """Number-theoretic transform of rows of ``size`` residues; the spectrum is in bit-reversed order."""

    def __init__(self, size: int):
        self.size = size
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        self.forth, self.back = self._powers(root), self._powers(pow(root, -1, PRIME))
        self.scale = np.uint64(pow(size, -1, PRIME))

    def _powers(self, root: int) -> np.ndarray:
        out = np.ones(max(self.size // 2, 1), np.uint64)
        have = 1
        while have < len(out):
            take = min(have, len(out) - have)
            out[have : have + take] = _mod(out[:take] * np.uint64(pow(root, have, PRIME)))
            have += take
        return out

    def forward(self, a: np.ndarray) -> np.ndarray:
        width = self.size
        while width > 1:
            half = width // 2
            v = a.reshape(len(a), -1, 2, half)
            low, high = v[:, :, 0, :], v[:, :, 1, :]
            down = _mod((low + (np.uint64(PRIME) - high)) * self.forth[:: self.size // width])
            low += high
            np.minimum(low, low - np.uint64(PRIME), out=low)
            v[:, :, 1, :] = down
            width = half
        return a

    def inverse(self, a: np.ndarray) -> np.ndarray:
        width = 2
        while width <= self.size:
            half = width // 2
            v = a.reshape(len(a), -1, 2, half)
            low, high = v[:, :, 0, :], _mod(v[:, :, 1, :] * self.back[:: self.size // width])
            down = low + (np.uint64(PRIME) - high)
            low += high
            np.minimum(low, low - np.uint64(PRIME), out=low)
            np.minimum(down, down - np.uint64(PRIME), out=v[:, :, 1, :])
            width *= 2
        return _mod(a * self.scale)


def zero_distances(codes: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance in ``[low, high)``) wherever the squared differences of block and window add up to zero.

    The sum is own squares + window squares - 2 products. ``codes`` are small
    enough that ``block`` products stay below the prime, so a residue is the sum.
    """
    size = 1 << max(1, min(high - low + block - 2, 4 * block - 1)).bit_length()
    step = size - block + 1
    plan = Transform(size)
    padded = np.concatenate([codes, np.zeros(high + size, np.uint64)])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded)])
    rows = max(1, TRANSFORM_CELLS // size)
    for a in range(0, len(starts), rows):
        at = starts[a : a + rows, None]
        blocks = np.zeros((len(at), size), np.uint64)
        blocks[:, (-np.arange(block)) % size] = padded[at + np.arange(block)]
        spectrum = plan.forward(blocks)
        own = squares[at + block] - squares[at]
        for first in range(low, high, step):
            window = padded[at + first + np.arange(size)]
            shared = plan.inverse(_mod(spectrum * plan.forward(window)))[:, : min(step, high - first)]
            begin = at + first + np.arange(shared.shape[1])
            row, d = np.nonzero(own + squares[begin + block] - squares[begin] == shared + shared)
            yield starts[a + row], d + first


class _Runs:
    """Runs found so far, and for each word the end and period of one run around it."""

    def __init__(self, same: np.ndarray, document: np.ndarray, bounds: np.ndarray):
        self.same, self.document, self.bounds = same, document, bounds
        self.end = np.zeros(len(same), np.int64)
        self.period = np.ones(len(same), np.int64)
        self.found: dict[tuple[int, int], int] = {}

    def extend(self, at: int, d: int, begin: int, stop: int) -> tuple[int, int]:
        """The stretch around ``at`` whose words equal those ``d`` further on; empty if ``at`` has none."""
        same, step, right = self.same, 64, at
        while right < stop - d:
            take = min(step, stop - d - right)
            differ = same[right : right + take] != same[right + d : right + d + take]
            if differ.any():
                right += int(differ.argmax())
                break
            right, step = right + take, 4 * step
        left, step = at, 64
        while right > at and left > begin:
            take = min(step, left - begin)
            differ = (same[left - take : left] != same[left - take + d : left + d])[::-1]
            if differ.any():
                left -= int(differ.argmax())
                break
            left, step = left - take, 4 * step
        return left, right

    def seed(self, at: np.ndarray, d: np.ndarray, block: int) -> None:
        """Extend occurrences, ascending by distance; known runs explain multiples of their period."""
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        known = (self.end[at] >= at + block + d) & (d % self.period[at] == 0)
        last, reach = -1, 0
        for i, q in zip(at[~known].tolist(), d[~known].tolist(), strict=True):
            if q != last:
                last, reach = q, 0
            if i < reach or (self.end[i] >= i + block + q and q % self.period[i] == 0):
                continue
            doc = self.document[i]
            left, reach = self.extend(i, q, int(self.bounds[doc]), int(self.bounds[doc + 1]))
            stop = reach + q
            if stop - left >= max(LEAST_WORDS, 2 * q) and (left, stop) not in self.found:
                self.found[left, stop] = q
                part = slice(left, stop)
                better = self.end[part] < stop
                self.period[part][better] = q
                self.end[part][better] = stop


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of word numbers ``words``, none across ``bounds``; sorted."""
    total = len(words)
    sizes = np.diff(bounds)
    if not total or sizes.max() < LEAST_WORDS:
        return []
    document = np.repeat(np.arange(len(sizes)), sizes)
    # equal words of a document lie next to each other, in text order, on one number line
    key = document * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.cumsum(fresh) - 1
    same = np.empty(total, np.int64)
    same[order] = group
    span = 3 * total + 1
    line = group * span + order
    last = order[np.append(np.flatnonzero(fresh)[1:] - 1, total - 1)][group]
    runs = _Runs(same, document, bounds)
    low, high, block = 1, FIRST_SCALE, LEAST_BLOCK
    alive = np.flatnonzero(last - order >= low)
    while 2 * low <= sizes.max():
        # an occurrence needs each word of its block again at such a distance
        alive = alive[(last[alive] - order[alive] >= low) & (sizes[document[order[alive]]] >= 2 * low)]
        ahead = np.searchsorted(line, line[alive] + low)
        again = np.zeros(total + 1, np.int64)
        near = (ahead < total) & (line[np.minimum(ahead, total - 1)] < line[alive] + high)
        again[order[alive[near]] + 1] = 1
        upto = np.cumsum(again)
        starts = np.arange(0, total - block + 1, block)
        starts = starts[upto[starts + block] - upto[starts] == block]
        if len(starts):
            limit = math.isqrt((PRIME - 1) // block)
            codes = ((same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(limit)
            seeds = zero_distances(codes, starts, block, low, high)
            if low == 1:  # the only scale with multiples of its own periods
                seeds = [tuple(np.concatenate(x) for x in zip(*seeds, strict=True))]
            for at, d in seeds:
                runs.seed(at, d, block)
        low, high = high, 2 * high
        block = min(low // 2, MOST_BLOCK)
    return sorted((a, b, q) for (a, b), q in runs.found.items())


def split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and words ``[^ \\t-\\r]+`` of all rows, as they are."""
    lists = pc.split_pattern(pc.replace_substring_regex(text, pattern="[\t-\r]", replacement=" "), " ")
    keep = np.asarray(pc.greater(pc.binary_length(lists.values), 0))
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[np.asarray(lists.offsets)], lists.values.filter(pa.array(keep))


@dataclass(frozen=True)
class Repeat:
    """Which documents get a periodic tail: those whose hash leaves ``0`` by ``every``."""

    every: int = 10
    folds: int = 3
    further: int = 8


def planted(ids: list, sizes: np.ndarray, offsets: np.ndarray, rule: Repeat | None) -> np.ndarray:
    """For each word the number of the word that stands there after the rule is applied."""
    source = np.arange(offsets[-1])
    for k, doc in enumerate(ids if rule else []):
        n = int(sizes[k])
        h = zlib.crc32(str(doc).encode())
        if doc is not None and n and h % rule.every == 0:
            g = h // rule.every
            a = g % n
            p = 1 + (n - a) // (rule.folds + g % rule.further)
            source[offsets[k] + a : offsets[k + 1]] = offsets[k] + a + np.arange(n - a) % p
    return source


def periodic_runs(docs: DataFrame, rule: Repeat | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period), collapsed.

    Words are runs of characters other than white space, as written and numbered
    from 0. ``runs`` are ordered by start, then period; ``collapsed`` joins by one
    space the words that no run holds after its first period. With ``rule``, each
    document it names gets a periodic tail first; a document without an id never
    does. A null, empty or wordless text has no runs and collapses to an empty
    text. Repeated rows are answered each, an empty table gives no rows, and other
    columns are ignored. A task holds a slice of documents, one at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, flat = split(batch.column("text"))
            sizes = np.diff(offsets)
            ids = batch.column("doc_id")
            source = planted(ids.to_pylist(), sizes, offsets, rule)
            coded = flat.dictionary_encode()
            found = find_runs(np.asarray(coded.indices).astype(np.int64)[source], offsets)
            keep = np.ones(len(source), bool)
            for a, b, q in found:
                keep[a + q : b] = False
            table = np.array(found, np.int64).reshape(-1, 3)
            owner = np.searchsorted(offsets, table[:, 0], side="right") - 1
            table = table[np.lexsort((table[:, 2], table[:, 0], owner))]
            owner.sort()
            entries = pa.StructArray.from_arrays([pa.array(table[:, 0] - offsets[owner]), pa.array(table[:, 1] - table[:, 0]), pa.array(table[:, 2])], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)), entries)
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(kept), flat.take(pa.array(source[keep])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), runs, pc.binary_join(words, " ")], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(run, RUNS)

