"""A temporal graph network with learned weights, for all turns of a protocol at once.

Two graph convolutions and a layer norm encode each frame, the mean over its valid
nodes enters a gated recurrent unit, and a linear layer classifies the last state.
An episode is one row (its frames and roster are bounded). Candidates that share a
graph share its last state too: a row may list many of them, and the graph is
written and passed through once for all. An epoch is one pass
over the rows: tasks add up loss and gradient of the train rows and the loss of
the validation rows of every turn that is still open; the driver, which holds one
parameter vector per turn, takes one step of AdamW. The parameters with the least
validation loss are kept, and a turn that does not improve for a while is closed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import CONTINUOUS, NODE_FEATURES
from .parallel import TEST, TRAIN, VALIDATION, Turns, partitions, summed

#: Graphs that a task evaluates at a time, and candidates that a row of one lists at most.
BATCH_EPISODES, MEMBERS = 64, 1024
#: Least variance of the layer norm, and least deviation of a feature.
NORM_FLOOR, LEAST_DEVIATION = 1e-5, 1e-6


@dataclass(frozen=True)
class NetworkConfig:
    hidden: int = 32
    state: int = 32
    dropout: float = 0.2
    epochs: int = 60
    patience: int = 10
    #: A full pass is one step, so steps are larger than with small batches.
    rate: float = 0.01
    decay: float = 1e-4
    least_improvement: float = 1e-5
    seed: int = 42


@dataclass
class History:
    """Losses of one turn by epoch; ``best`` is the epoch whose parameters are kept."""

    train: list[float] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)
    best: int = -1


@dataclass
class Episodes:
    """Graphs as dense arrays: all frames one after the other, padded to the most nodes; then the candidates, by graph."""

    x: np.ndarray  # frame, node, feature
    mix: np.ndarray  # frame, target, source: normalised adjacency with self-links
    valid: np.ndarray  # frame, node
    place: np.ndarray  # frame: its graph
    step: np.ndarray  # frame: its number within the graph
    length: np.ndarray  # frames of each graph
    graph: np.ndarray  # candidate: its graph, in rising order
    key: np.ndarray
    y: np.ndarray

    def chosen(self, use: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Episodes:
        """Some of the candidates and their graphs, the continuous features of valid nodes standardised and those of others 0."""
        needed = np.bincount(self.graph[use], minlength=len(self.length)) > 0
        frames = needed[self.place]
        x, valid = self.x[frames].copy(), self.valid[frames]
        k = len(mean)
        x[..., :k] = np.where(valid[..., None], (x[..., :k] - mean) / scale, 0.0)
        number = np.cumsum(needed) - 1
        return Episodes(x, self.mix[frames], valid, number[self.place[frames]], self.step[frames], self.length[needed], number[self.graph[use]], self.key[use], self.y[use])


class Network:
    """Shapes, forward and backward pass; parameters are one vector."""

    def __init__(self, cfg: NetworkConfig, features: int = len(NODE_FEATURES)):
        h, s = cfg.hidden, cfg.state
        self.cfg = cfg
        self.shapes = {
            "w1": (features, h), "b1": (h,), "w2": (h, h), "b2": (h,), "gain": (h,), "shift": (h,),
            "wi": (h, 3 * s), "bi": (3 * s,), "wh": (s, 3 * s), "bh": (3 * s,), "wo": (s, 2), "bo": (2,),
        }
        self.size = sum(int(np.prod(shape)) for shape in self.shapes.values())

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name], at = vector[at : at + n].reshape(shape), at + n
        return out

    def start(self) -> np.ndarray:
        rng, vector = np.random.default_rng(self.cfg.seed), np.zeros(self.size)
        for name, part in self.views(vector).items():
            if name in ("w1", "w2"):
                part[:] = rng.uniform(-1, 1, part.shape) * np.sqrt(6 / sum(part.shape))
            elif name in ("wi", "wh", "bi", "bh", "wo", "bo"):
                part[:] = rng.uniform(-1, 1, part.shape) / np.sqrt(self.cfg.state)
        self.views(vector)["gain"][:] = 1
        return vector

    def forward(self, vector: np.ndarray, e: Episodes, epoch: int | None = None) -> tuple[np.ndarray, dict]:
        """Class log-probabilities and what the backward pass needs; dropout only with an ``epoch``."""
        p, kept = self.views(vector), {}
        mixed1 = e.mix @ e.x
        a1 = mixed1 @ p["w1"] + p["b1"]
        h1 = np.maximum(a1, 0)
        mixed2 = e.mix @ h1
        a2 = mixed2 @ p["w2"] + p["b2"]
        h2 = np.maximum(a2, 0)
        centred = h2 - h2.mean(axis=-1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + NORM_FLOOR)
        unit = centred * scale
        mask = e.valid[..., None]
        count = np.maximum(mask.sum(axis=1), 1)
        frames = ((unit * p["gain"] + p["shift"]) * mask).sum(axis=1) / count
        s, n, steps = self.cfg.state, len(e.length), int(e.length.max(initial=0))
        inputs = np.zeros((n, steps, frames.shape[1]))
        inputs[e.place, e.step] = frames
        state, trace = np.zeros((n, s)), []
        into = inputs @ p["wi"] + p["bi"]
        for t in range(steps):
            own = state @ p["wh"] + p["bh"]
            r = 1 / (1 + np.exp(-(into[:, t, :s] + own[:, :s])))
            z = 1 / (1 + np.exp(-(into[:, t, s : 2 * s] + own[:, s : 2 * s])))
            c = np.tanh(into[:, t, 2 * s :] + r * own[:, 2 * s :])
            live = (t < e.length)[:, None]
            trace.append((state, r, z, c, own[:, 2 * s :], live))
            state = np.where(live, (1 - z) * c + z * state, state)
        state = state[e.graph]
        drop = np.ones_like(state)
        if epoch is not None and self.cfg.dropout:
            drop = _uniform(e.key, epoch, s) >= self.cfg.dropout
            drop = drop / (1 - self.cfg.dropout)
        out = (state * drop) @ p["wo"] + p["bo"]
        top = out.max(axis=1, keepdims=True)
        logs = out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))
        kept |= {"mixed1": mixed1, "a1": a1, "mixed2": mixed2, "a2": a2, "scale": scale, "unit": unit, "count": count, "inputs": inputs, "trace": trace, "state": state, "drop": drop}
        return logs, kept

    def gradient(self, vector: np.ndarray, e: Episodes, weight: np.ndarray, epoch: int | None) -> tuple[float, np.ndarray]:
        """Weighted sum of the losses and its gradient."""
        p = self.views(vector)
        logs, k = self.forward(vector, e, epoch)
        loss = -(weight * logs[np.arange(len(e.y)), e.y]).sum()
        total = np.zeros(self.size)
        g = self.views(total)
        dout = np.exp(logs)
        dout[np.arange(len(e.y)), e.y] -= 1
        dout *= weight[:, None]
        g["wo"][:], g["bo"][:] = (k["state"] * k["drop"]).T @ dout, dout.sum(axis=0)
        dstate = np.add.reduceat((dout @ p["wo"].T) * k["drop"], np.searchsorted(e.graph, np.arange(len(e.length))))
        s = self.cfg.state
        dinto = np.zeros((len(e.length), len(k["trace"]), 3 * s))
        for t in range(len(k["trace"]) - 1, -1, -1):
            before, r, z, c, candidate, live = k["trace"][t]
            d = np.where(live, dstate, 0)
            dc = d * (1 - z) * (1 - c**2)
            dz = d * (before - c) * z * (1 - z)
            dr = dc * candidate * r * (1 - r)
            dinto[:, t] = np.concatenate([dr, dz, dc], axis=1)
            down = np.concatenate([dr, dz, dc * r], axis=1)
            g["wh"][:] += before.T @ down
            g["bh"][:] += down.sum(axis=0)
            dstate = np.where(live, d * z + down @ p["wh"].T, dstate)
        flat = k["inputs"].reshape(-1, k["inputs"].shape[-1])
        g["wi"][:], g["bi"][:] = flat.T @ dinto.reshape(len(flat), -1), dinto.sum(axis=(0, 1))
        dframes = (dinto @ p["wi"].T)[e.place, e.step]
        dnode = (dframes / k["count"])[:, None, :] * e.valid[..., None]
        g["gain"][:], g["shift"][:] = (dnode * k["unit"]).sum(axis=(0, 1)), dnode.sum(axis=(0, 1))
        du = dnode * p["gain"]
        dh2 = k["scale"] * (du - du.mean(axis=-1, keepdims=True) - k["unit"] * (du * k["unit"]).mean(axis=-1, keepdims=True))
        da2 = dh2 * (k["a2"] > 0)
        g["w2"][:], g["b2"][:] = _flat(k["mixed2"]).T @ _flat(da2), da2.sum(axis=(0, 1))
        da1 = (e.mix.transpose(0, 2, 1) @ (da2 @ p["w2"].T)) * (k["a1"] > 0)
        g["w1"][:], g["b1"][:] = _flat(k["mixed1"]).T @ _flat(da1), da1.sum(axis=(0, 1))
        return float(loss), total


def _flat(a: np.ndarray) -> np.ndarray:
    """A row per node of all frames."""
    return a.reshape(-1, a.shape[-1])


def _uniform(keys: np.ndarray, epoch: int, width: int) -> np.ndarray:
    """Numbers in [0, 1) from key, epoch and unit: the same however rows are dealt."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + np.uint64(epoch + 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) / 2.0**64


def episode_rows(nodes: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per candidate: its columns of ``rows`` and its graph, packed once.

    ``nodes`` and ``edges`` are shuffled once, by candidate, and packed before they
    meet ``rows``: several candidates may share the graph that ``graph_id`` of
    ``rows`` names; without that column each has its own. An episode is a bounded
    number of frames of one roster.
    """
    named = rows if "graph_id" in rows.columns else rows.withColumn("graph_id", F.col("candidate_id"))
    return named.join(_packed(nodes, edges), "graph_id").drop("graph_id").withColumn("key", F.xxhash64("candidate_id"))


#: What a row of a shared graph lists of its candidates.
LISTED = {"candidate_id": "string", "match_id": "string", "group": "int", "y": "int", "key": "bigint"}


def shared_rows(nodes: DataFrame, edges: DataFrame, rows: DataFrame, members: int = MEMBERS) -> DataFrame:
    """One row per graph and up to ``members`` of the candidates that name it by ``graph_id``, for :func:`fit` and :func:`score`.

    Lists are cut from ranges of candidates in order, so a graph that many
    candidates name is spread over tasks, and written again only for each full
    list, each batch of rows and each range of its candidates.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("key", F.xxhash64("candidate_id")).select("graph_id", *[F.col(c).cast(t).alias(c) for c, t in LISTED.items()])
    ranges = keyed.repartitionByRange(parts, "graph_id", "key").sortWithinPartitions("graph_id", "key", "candidate_id")
    lists = ranges.mapInArrow(_listed(members), "graph_id string, " + ", ".join(f"`{c}` array<{t}>" for c, t in LISTED.items()))
    # much work a row: adaptive execution must not merge the partitions
    return lists.join(_packed(nodes, edges), "graph_id").repartition(parts, "graph_id", F.col("key")[0])


def _listed(members: int):
    """Runs of rows of one graph to lists, ``members`` rows each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["graph_id"]
            changes = (np.flatnonzero(np.asarray(pc.not_equal(names[1:], names[:-1]).fill_null(True))) + 1).tolist()
            starts = [a for begin, end in zip([0, *changes], [*changes, batch.num_rows], strict=True) for a in range(begin, end, members)]
            offsets = pa.array([*starts, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(starts)), *[pa.ListArray.from_arrays(offsets, batch[c]) for c in LISTED]], ["graph_id", *LISTED])

    return run


def _packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs by ``graph_id``, their candidate."""
    values = F.array(*[F.col(c).cast("double") for c in NODE_FEATURES])
    by_node = nodes.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "node_idx", "valid", values.alias("f")))).alias("nodes"))
    by_link = edges.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "src", "dst"))).alias("links"))
    none = F.array().cast(by_link.schema["links"].dataType)
    lists = by_node.join(by_link, "candidate_id", "left").withColumn("links", F.coalesce("links", none))
    return lists.select(F.col("candidate_id").alias("graph_id"), "nodes", "links").mapInArrow(_pack, PACKED)


#: Features (doubles) and validity (bytes) by frame and node; links as places (frame, target, source) in the adjacency.
PACKED = "graph_id string, frames int, width int, x binary, valid binary, links binary"


def _number(a: pa.Array) -> np.ndarray:
    return np.asarray(a.to_numpy(zero_copy_only=False)).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Graphs as lists of nodes and links to dense bytes; a link of an unknown frame or node is left out."""
    for batch in _batches(batches):
        node, link = batch["nodes"].flatten(), batch["links"].flatten()
        node_ends, link_ends = (np.cumsum(np.asarray(pc.list_value_length(batch[c])))[:-1] for c in ("nodes", "links"))
        features = np.asarray(node.field("f").flatten(), dtype=float).reshape(len(node), len(NODE_FEATURES))
        columns = [_number(node.field("frame_id")), _number(node.field("node_idx")), np.asarray(node.field("valid").to_numpy(zero_copy_only=False)).astype(bool), features]
        split = [np.split(c, node_ends) for c in columns] + [np.split(_number(link.field(c)), link_ends) for c in ("frame_id", "src", "dst")]
        out = []
        for graph_id, frame, index, valid, values, *ends in zip(batch["graph_id"].to_pylist(), *split, strict=True):
            frames, at = np.unique(frame, return_inverse=True)
            slots, slot = np.unique(index, return_inverse=True)
            x = np.zeros((len(frames), len(slots), len(NODE_FEATURES)))
            x[at, slot] = values
            usable = np.zeros((len(frames), len(slots)), bool)
            usable[at, slot] = valid
            found = [np.minimum(np.searchsorted(known, v), len(known) - 1) for known, v in zip((frames, slots, slots), ends, strict=True)]
            there = np.all([known[f] == v for known, f, v in zip((frames, slots, slots), found, ends, strict=True)], axis=0)
            of, src, dst = (f[there] for f in found)
            places = (of * len(slots) + dst) * len(slots) + src
            out.append((graph_id, len(frames), len(slots), x.astype("<f8").tobytes(), usable.tobytes(), places.astype("<u4").tobytes()))
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["graph_id", "frames", "width", "x", "valid", "links"])


def _of_candidates(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A value per candidate, whether a row is one or lists many."""
    column = batch[name]
    return column.flatten() if pa.types.is_list(column.type) else column


def unpack(batch: pa.RecordBatch) -> Episodes:
    """Dense arrays of the rows of :func:`episode_rows` or :func:`shared_rows`.

    A link brings the source's features to its target; sums are divided by the
    roots of both in-degrees, each counting the node itself.
    """
    length, widths = _number(batch["frames"]), _number(batch["width"])
    frames, width = int(length.sum()), int(widths.max(initial=1))
    x = np.zeros((frames, width, len(NODE_FEATURES)))
    valid = np.zeros((frames, width), bool)
    mix = np.zeros((frames, width, width))
    begins = np.cumsum(length) - length
    for a, n, w, *packed in zip(begins.tolist(), length.tolist(), widths.tolist(), *[batch[c].to_pylist() for c in ("x", "valid", "links")], strict=True):
        x[a : a + n, :w] = np.frombuffer(packed[0], "<f8").reshape(n, w, -1)
        valid[a : a + n, :w] = np.frombuffer(packed[1], bool).reshape(n, w)
        mix[a : a + n, :w, :w] = np.bincount(np.frombuffer(packed[2], "<u4"), minlength=n * w * w).reshape(n, w, w)
    mix[:, np.arange(width), np.arange(width)] += 1
    root = np.sqrt(mix.sum(axis=2))
    mix /= root[:, :, None] * root[:, None, :]
    place = np.repeat(np.arange(batch.num_rows), length)
    graph = np.arange(batch.num_rows)
    if pa.types.is_list(batch["key"].type):
        graph = np.repeat(graph, np.asarray(pc.list_value_length(batch["key"])))
    return Episodes(x, mix, valid, place, np.arange(frames) - begins[place], length, graph, _number(_of_candidates(batch, "key")), _number(_of_candidates(batch, "y")))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_EPISODES):
            yield batch.slice(a, BATCH_EPISODES)


@dataclass
class GraphModel:
    """By turn: parameters, losses, and mean and deviation of the continuous features over valid train nodes."""

    cfg: NetworkConfig
    parameters: np.ndarray
    history: list[History]
    means: np.ndarray
    scales: np.ndarray


def fit(rows: DataFrame, turns: Turns, cfg: NetworkConfig = NetworkConfig()) -> GraphModel:
    """Train all turns on staged rows of :func:`episode_rows` or :func:`shared_rows` with ``group`` and ``y``."""
    net, n = Network(cfg), len(turns)

    k = len(CONTINUOUS)

    def count(batches):
        """Rows by class; then number, sums and squares of valid nodes, of each group."""
        out: dict[int, np.ndarray] = {}
        for batch in _batches(batches):
            group, e = _number(_of_candidates(batch, "group")), unpack(batch)
            x = np.where(e.valid[..., None], e.x[..., :k], 0.0)
            by_frame = np.concatenate([e.valid.sum(axis=1)[:, None], x.sum(axis=1), (x**2).sum(axis=1)], axis=1)
            by_graph = np.stack([np.bincount(e.place, v, minlength=len(e.length)) for v in by_frame.T], axis=1)
            for g in np.unique(group):
                own = group == g
                total = np.concatenate([np.bincount(e.y[own], minlength=2)[:2], np.bincount(e.graph[own], minlength=len(e.length)) @ by_graph]).astype(float)
                out[int(g)] = out.get(int(g), 0) + total
        return out

    counts = summed(rows, count, 3 + 2 * k, len(turns.groups))
    weights = turns.weights(counts[:, :2])
    train = (turns.roles == TRAIN).astype(float) @ counts[:, 2:]
    means = train[:, 1 : k + 1] / np.maximum(train[:, :1], 1)
    scales = np.maximum(np.sqrt(np.maximum(train[:, k + 1 :] / np.maximum(train[:, :1], 1) - means**2, 0)), LEAST_DEVIATION)
    held = np.repeat(net.start()[None], n, axis=0)
    first, second = np.zeros_like(held), np.zeros_like(held)
    kept, least = held.copy(), np.full(n, np.inf)
    history = [History() for _ in range(n)]
    open_ = np.ones(n, bool)
    parts = partitions(rows)
    for epoch in range(cfg.epochs):

        def step(batches, held=held.copy(), active=np.flatnonzero(open_), epoch=epoch):
            sums: dict[int, np.ndarray] = {}
            for batch in _batches(batches):
                group, whole = _number(_of_candidates(batch, "group")), unpack(batch)
                for r in active.tolist():
                    found = np.zeros(4 + net.size)
                    role = turns.roles[r, group]
                    if (role == TRAIN).any():
                        e = whole.chosen(role == TRAIN, means[r], scales[r])
                        w = weights[r, e.y]
                        found[0], found[4:] = net.gradient(held[r], e, w, epoch)
                        found[1] = w.sum()
                    if (role == VALIDATION).any():
                        e = whole.chosen(role == VALIDATION, means[r], scales[r])
                        found[2] = -net.forward(held[r], e)[0][np.arange(len(e.y)), e.y].sum()
                        found[3] = len(e.y)
                    sums[r] = sums[r] + found if r in sums else found
            return sums

        totals = summed(rows, step, 4 + net.size, n, parts)
        for r in np.flatnonzero(open_):
            past = history[r]
            past.train.append(totals[r, 0] / max(totals[r, 1], 1e-300))
            past.validation.append(totals[r, 2] / max(totals[r, 3], 1))
            if past.validation[-1] < least[r] - cfg.least_improvement:
                least[r], kept[r], past.best = past.validation[-1], held[r], epoch
            elif epoch - past.best >= cfg.patience:
                open_[r] = False
                continue
            gradient = totals[r, 4:] / max(totals[r, 1], 1e-300)
            first[r] = 0.9 * first[r] + 0.1 * gradient
            second[r] = 0.999 * second[r] + 0.001 * gradient**2
            mean, spread = first[r] / (1 - 0.9 ** (epoch + 1)), second[r] / (1 - 0.999 ** (epoch + 1))
            held[r] = held[r] * (1 - cfg.rate * cfg.decay) - cfg.rate * mean / (np.sqrt(spread) + 1e-8)
        if not open_.any():
            break
    if any(h.best < 0 for h in history):
        raise ValueError("training gave no finite validation loss")
    return GraphModel(cfg, kept, history, means, scales)


def score(rows: DataFrame, model: GraphModel, turns: Turns, roles: Sequence[int] = (TEST,)) -> DataFrame:
    """(turn, role, candidate_id, match_id, y, probability) of the rows that have one of ``roles`` in a turn."""
    net = Network(model.cfg)
    data = rows.select("candidate_id", "match_id", "group", "y", "frames", "width", "x", "valid", "links", "key")

    def run(batches):
        for batch in _batches(batches):
            group, whole = _number(_of_candidates(batch, "group")), unpack(batch)
            for r, parameters in enumerate(model.parameters):
                role = turns.roles[r, group]
                use = np.isin(role, roles)
                if not use.any():
                    continue
                own = {c: _of_candidates(batch, c).filter(pa.array(use)) for c in ("candidate_id", "match_id", "y")}
                p = np.exp(net.forward(parameters, whole.chosen(use, model.means[r], model.scales[r]))[0][:, 1])
                values = [pa.array(np.full(len(p), r, np.int32)), pa.array(role[use].astype(np.int32)), own["candidate_id"], own["match_id"], own["y"], pa.array(p)]
                yield pa.RecordBatch.from_arrays(values, ["turn", "role", "candidate_id", "match_id", "y", "probability"])

    return data.mapInArrow(run, "turn int, role int, candidate_id string, match_id string, y int, probability double")
