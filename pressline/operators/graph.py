"""Nearest-neighbour edges, graph shape, normalising, propagation and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..functions.ordered import with_scalars

FRAME = ["candidate_id", "frame_id"]
CONTINUOUS = ("x", "y", "speed")
NODE_FEATURES = ("x", "y", "speed", "is_ball", "is_losing", "is_opponent")


def knn_edges(nodes: DataFrame, k: int = 4) -> DataFrame:
    """Edges from each valid node to its k nearest valid nodes of the frame.

    A frame needs more than k valid nodes. Equal distances go to the lower node.
    A frame holds a roster and the ball, so the join inside a frame is small;
    both sides share the partitioning on (candidate, frame), and the k-limit is
    applied while the pairs stream out of the join.
    """
    frame = Window.partitionBy(*FRAME)
    usable = (
        nodes.where("valid")
        .select(*FRAME, "node_idx", "x", "y")
        .withColumn("_n", F.count(F.lit(1)).over(frame))
        .where(F.col("_n") > k)
        .drop("_n")
    )
    other = usable.select(*FRAME, F.col("node_idx").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    nearest = Window.partitionBy(*FRAME, "src").orderBy("distance", "dst")
    return (
        usable.withColumnRenamed("node_idx", "src")
        .join(other, FRAME)
        .where(F.col("src") != F.col("dst"))
        .select(*FRAME, "src", "dst", F.sqrt(dx * dx + dy * dy).alias("distance"))
        .withColumn("_rank", F.row_number().over(nearest))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def graph_shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per episode: frames, nodes, features, least and most edges of a frame, invalid nodes."""
    per_frame = nodes.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("_nodes"), count_where(~F.col("valid")).alias("_invalid")
    )
    per_edge = edges.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_edges"))
    found = F.coalesce("_edges", F.lit(0).cast("bigint"))
    return (
        per_frame.join(per_edge, FRAME, "left")
        .groupBy("candidate_id")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.max("_nodes").alias("nodes"),
            F.lit(len(NODE_FEATURES)).alias("node_features"),
            F.min(found).alias("edges_per_frame_min"),
            F.max(found).alias("edges_per_frame_max"),
            F.sum("_invalid").alias("invalid_node_observations"),
        )
    )


def only_valid(nodes: DataFrame, audit: DataFrame) -> DataFrame:
    """Nodes of strict-valid candidates."""
    return nodes.join(audit.where("strict_valid").select("candidate_id"), "candidate_id", "left_semi")


def require_valid(nodes: DataFrame, audit: DataFrame) -> DataFrame:
    """The same nodes; a candidate that is not strict-valid stops the job."""
    flags = audit.select("candidate_id", F.col("strict_valid").alias("_ok"))
    checked = F.when(F.col("_ok"), F.col("candidate_id")).otherwise(
        F.raise_error(F.concat(F.lit("candidate is not strict-valid: "), F.col("candidate_id")))
    )
    return nodes.join(flags, "candidate_id", "left").withColumn("candidate_id", checked).drop("_ok")


def crop(rows: DataFrame, start_s: float = 0.0, end_s: float = 2.0, tol: float = 1e-5) -> DataFrame:
    """Frames from the turnover to the end of the decision window."""
    return rows.where(F.col("relative_time_s").between(start_s - tol, end_s + tol))


def feature_normalizer(train_nodes: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the continuous features over valid nodes."""
    return train_nodes.where("valid").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in CONTINUOUS],
        *[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"std_{c}") for c in CONTINUOUS],
    )


def normalize_nodes(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise valid nodes with the one-row ``stats``; invalid ones become 0."""
    scaled = {
        c: F.when(F.col("valid"), (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).otherwise(0.0)
        for c in CONTINUOUS
    }
    return with_scalars(nodes, stats).withColumns(scaled).select(*nodes.columns)


def propagate(nodes: DataFrame, edges: DataFrame, features: Sequence[str] = NODE_FEATURES, hops: int = 2) -> DataFrame:
    """Features after ``hops`` steps of D^-1/2 (A + I) D^-1/2, degrees counted at the target.

    Each edge carries features from ``src`` to ``dst``; each node also keeps
    itself. A frame's nodes and links are small arrays of one row, so both
    inputs are shuffled once, by frame, for any number of hops.
    """
    node = F.struct("node_idx", "valid", F.array(*[F.col(c).cast("double") for c in features]).alias("f"))
    at = nodes.groupBy(*FRAME).agg(F.sort_array(F.collect_list(node)).alias("_nodes"))
    by = edges.groupBy(*FRAME).agg(F.collect_list(F.struct("src", "dst")).alias("_links"))
    rows = at.join(by, FRAME, "left")
    rows = rows.withColumn("_links", F.coalesce("_links", F.array().cast("array<struct<src:int,dst:int>>")))
    # per node: the sources it hears from, the square root of its degree, its features
    heard = F.transform(
        "_nodes",
        lambda n: F.transform(F.filter("_links", lambda e: e["dst"] == n["node_idx"]), lambda e: e["src"]),
    )
    rows = rows.withColumn("_from", heard).withColumns(
        {"_root": F.transform("_from", lambda x: F.sqrt(F.size(x) + 1.0)), "_f": F.transform("_nodes", lambda n: n["f"])}
    )
    ids = F.transform("_nodes", lambda n: n["node_idx"])
    zero = F.array(*[F.lit(0.0)] * len(features))

    def add(x, y):
        return F.zip_with(x, y, lambda a, b: a + b)

    for _ in range(hops):
        scaled = F.zip_with("_f", "_root", lambda f, r: F.transform(f, lambda v: v / r))
        rows = rows.withColumn("_out", scaled).withColumn("_map", F.map_from_arrays(ids, F.col("_out")))
        total = F.zip_with(
            "_out", "_from", lambda own, src: F.aggregate(src, own, lambda acc, i: add(acc, F.coalesce(F.col("_map")[i], zero)))
        )
        rows = rows.withColumn("_f", F.zip_with(total, "_root", lambda f, r: F.transform(f, lambda v: v / r)))
    out = rows.select(*FRAME, F.inline(F.zip_with("_nodes", "_f", lambda n, f: F.struct(n["node_idx"].alias("node_idx"), n["valid"].alias("valid"), f.alias("f")))))
    return out.select(*FRAME, "node_idx", "valid", *[F.col("f")[i].alias(c) for i, c in enumerate(features)])


def frame_embedding(state: DataFrame, features: Sequence[str] = NODE_FEATURES) -> DataFrame:
    """Mean over the valid nodes of each frame."""
    return state.groupBy(*FRAME).agg(
        *[F.coalesce(F.avg(F.when(F.col("valid"), F.col(c))), F.lit(0.0)).alias(c) for c in features]
    )


def temporal_pooling(embedding: DataFrame, features: Sequence[str] = NODE_FEATURES) -> DataFrame:
    """Per episode and feature: mean, last, slope over frames, maximum."""
    aggs = []
    for c in features:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.max_by(c, "frame_id").alias(f"{c}_last"),
            F.regr_slope(F.col(c), F.col("frame_id").cast("double")).alias(f"{c}_slope"),
            F.max(c).alias(f"{c}_max"),
        ]
    return embedding.groupBy("candidate_id").agg(*aggs)
