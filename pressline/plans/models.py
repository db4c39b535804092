"""Classifiers on feature tables and graphs, and the runs around them.

A training table is written once to the shared folder and read back, so the
iterations of a fit never recompute the plan that produced it, and a lost
executor costs a re-read. Fits loop on the driver; rows never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import SPLITS
from ..functions import ordered
from ..functions.columns import count_where, strict_bool
from ..operators import gates, graph, keys, labels, metrics
from ..session import exists, shared_file, stage
from ..sources import tables
from . import newton, temporal_graph, trees
from .parallel import ROLES, TEST, VALIDATION, Turns

LABEL = "gegenpressing_label"
PREDICTION = ["model", "split", "candidate_id", "match_id", "y_true", "probability", "threshold", "y_pred"]


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight n / (2 n_class) per class; an absent class counts as one row."""
    y = F.col(label)
    n = F.count(y)
    counts = train.agg(n.alias("_n"), count_where(y == 0).alias("_n0"), count_where(y == 1).alias("_n1"))

    def row(value, c):
        return F.struct(
            F.lit(value).alias("label"), F.col(c).alias("n"), (F.col("_n") / (F.greatest(F.col(c), F.lit(1)) * 2)).alias("weight")
        )

    return counts.select(F.inline(F.array(row(0, "_n0"), row(1, "_n1"))))


def with_class_weights(df: DataFrame, train: DataFrame, label: str = LABEL) -> DataFrame:
    """Row weights from the two-row weight table of the train split."""
    weights = class_weights(train, label).select(F.col("label").alias("_label"), "weight")
    return df.join(F.broadcast(weights), F.col(label) == F.col("_label"), "left").drop("_label")


def train_medians(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of exact medians, all features in one pass; a feature without any value gets 0."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "feature", "value")
    medians = ordered.exact_quantiles(long, ["feature"], "value", {"median": 0.5})
    return medians.agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("median"))), F.lit(0.0)).alias(f"med_{c}") for c in names]
    )


def impute(df: DataFrame, train: DataFrame, names: Sequence[str]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")) for c in names}
    return ordered.with_scalars(df, train_medians(train, names)).withColumns(filled).select(*df.columns)


def impute_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Median imputation, then zero mean and unit population deviation; both fitted on train rows."""
    filled = impute(df, df.where(F.col("split") == "train"), names)
    stats = filled.where(F.col("split") == "train").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names]
    )
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in names
    }
    return ordered.with_scalars(filled, stats).withColumns(scaled).select(*df.columns)


def baseline_dataset(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Features with split and label; a feature row without manifest row is an error."""
    wanted = ["candidate_id", "match_id", "split", LABEL, "label_status", "eligible_for_detection_training"]
    known = keys.checked_unique(manifest.select(*wanted), ["candidate_id"]).withColumn("_known", F.lit(True))
    joined = keys.checked_unique(features, ["candidate_id"]).join(known, ["candidate_id", "match_id"], "left")
    complete = F.when(F.col("_known"), F.col("candidate_id")).otherwise(
        F.raise_error(F.concat(F.lit("feature row without manifest: "), F.col("candidate_id")))
    )
    return joined.withColumn("candidate_id", complete).drop("_known")


def graph_dataset(manifest: DataFrame, graphs: DataFrame) -> DataFrame:
    """Manifest rows with their graphs; either side without the other is an error."""
    left = keys.checked_unique(manifest, ["candidate_id"]).withColumn("_row", F.lit(True))
    right = keys.checked_unique(graphs, ["candidate_id"]).withColumn("_graph", F.lit(True))
    joined = left.join(right, ["candidate_id", "match_id"], "full_outer")
    both = F.when(F.col("_row") & F.col("_graph"), F.col("candidate_id")).otherwise(
        F.raise_error(F.concat(F.lit("graph and manifest do not match: "), F.col("candidate_id")))
    )
    return joined.withColumn("candidate_id", both).drop("_row", "_graph")


def usable_rows(dataset: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows to train on: eligible ones where that is known, else those with a binary label.

    Every split must hold usable rows of both classes; reads one row per split.
    """
    eligible = "eligible_for_detection_training"
    usable = dataset.where(F.col(label).isin(0, 1))
    if eligible in dataset.columns:
        usable = usable.where(eligible)
    found = {r["split"]: r["classes"] for r in usable.groupBy("split").agg((F.max(label) - F.min(label) + 1).alias("classes")).collect()}
    for split in SPLITS:
        if split not in found:
            raise ValueError(f"no usable labels in the {split} split")
        if found[split] < 2:
            raise ValueError(f"one class only in the {split} split")
    return usable


def _assembled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(df)
    return vectors.select("candidate_id", "match_id", "split", F.col(LABEL).alias("label"), "features", "weight")


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(
        F.lit(name).alias("model"),
        "split",
        "candidate_id",
        "match_id",
        F.col("label").cast("int").alias("y_true"),
        p.alias("probability"),
    )


def fit_logistic(rows: DataFrame, iterations: int = 2000) -> object:
    """L2 with unit strength against the summed loss: the penalty of the mean loss is 1/n."""
    n = max(rows.count(), 1)
    return LogisticRegression(
        maxIter=iterations, regParam=1.0 / n, standardization=False, weightCol="weight", tol=1e-6
    ).fit(rows)


def _finish(scores: DataFrame, selector: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score once, keep the table, and take threshold and predictions from that same table."""
    kept = stage(scores, "scores")
    return metrics.predict(kept, selector(kept)).select(*PREDICTION)


def train_logistic(
    dataset: DataFrame, names: Sequence[str], selector=metrics.validation_threshold, name: str = "logistic_regression"
) -> DataFrame:
    usable = usable_rows(dataset)
    ready = with_class_weights(impute_scale(usable, names), usable.where(F.col("split") == "train"))
    rows = stage(_assembled(ready, names), "logistic")
    model = fit_logistic(rows.where(F.col("split") == "train"))
    return _finish(_scored(model, rows, name), selector)


def _turn_rows(usable: DataFrame, turns: Turns, column: str, names: Sequence[str]) -> DataFrame:
    """Rows as the fits of turns read them: group and y beside ids and features."""
    numbered = turns.numbered(usable.withColumn("candidate_id", F.col("candidate_id").cast("string")), column)
    return numbered.select("candidate_id", F.col("match_id").cast("string").alias("match_id"), "group", F.col(LABEL).cast("int").alias("y"), *names)


def _by_split(scores: DataFrame, name: str) -> DataFrame:
    split = F.element_at(F.array(*[F.lit(s) for s in ROLES]), F.col("role") + 1)
    return scores.select(F.lit(name).alias("model"), split.alias("split"), "candidate_id", "match_id", F.col("y").alias("y_true"), "probability")


def train_boosted(
    dataset: DataFrame,
    names: Sequence[str],
    cfg: trees.TreeConfig = trees.TreeConfig(),
    selector=metrics.validation_threshold,
    name: str = "boosted_trees",
) -> DataFrame:
    """Boosted trees on the train split; scores of all splits."""
    turns = Turns.fixed()
    rows = stage(_turn_rows(usable_rows(dataset), turns, "split", names), "boosted")
    model = trees.fit(rows, names, turns, cfg)
    return _finish(_by_split(trees.score(rows, model, turns, tuple(ROLES.values())), name), selector)


def graph_rows(nodes: DataFrame, edges: DataFrame, rows: DataFrame, turns: Turns, column: str, until_s: float = 2.0) -> DataFrame:
    """Staged episodes as the graph network reads them.

    ``rows``: candidate_id, match_id, label and, if known, strict_valid; graphs of
    other candidates and of invalid ones are not used. Frames end ``until_s``
    after the turnover. With graph_id, a candidate uses the graph of that name, and
    candidates of one graph share its rows.
    """
    if "strict_valid" in rows.columns:
        rows = rows.where(strict_bool("strict_valid"))
    nodes = graph.crop(nodes, end_s=until_s)
    if "graph_id" in rows.columns:
        return stage(temporal_graph.shared_rows(nodes, edges, _turn_rows(rows, turns, column, ["graph_id"])), "episodes")
    episodes = temporal_graph.episode_rows(nodes, edges, _turn_rows(rows, turns, column, []))
    # much work a row: adaptive execution must not merge the partitions
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(episodes.repartition(parts, "candidate_id"), "episodes")


def train_graph_model(
    nodes: DataFrame,
    edges: DataFrame,
    rows: DataFrame,
    until_s: float = 2.0,
    selector=metrics.validation_threshold,
    name: str = "graph_model",
    cfg: temporal_graph.NetworkConfig = temporal_graph.NetworkConfig(),
) -> DataFrame:
    """Crop, normalise by train rows, train the temporal graph network, score all splits.

    ``rows``: candidate_id, match_id, split, label and, if known, strict_valid and graph_id.
    """
    turns = Turns.fixed()
    episodes = graph_rows(nodes, edges, usable_rows(rows), turns, "split", until_s)
    model = temporal_graph.fit(episodes, turns, cfg)
    return _finish(_by_split(temporal_graph.score(episodes, model, turns, tuple(ROLES.values())), name), selector)


def macro_selector(scores: DataFrame) -> DataFrame:
    """Threshold per model by macro-F1 on validation rows."""
    return metrics.macro_f1_threshold(scores.where(F.col("split") == "validation"), ["model"])


def evaluate(preds: DataFrame) -> DataFrame:
    """Metrics per split and per match, only for predictions that pass every check."""
    checks = gates.prediction_checks(preds)
    passed = reduce(lambda a, b: a & b, [F.col(c) for c in checks.columns])
    flag = checks.select(passed.alias("_passed"))
    by_split = metrics.classification_metrics(preds, ["model", "split"]).withColumn("match_id", F.lit("ALL"))
    by_match = metrics.classification_metrics(preds, ["model", "split", "match_id"])
    both = ordered.with_scalars(by_split.unionByName(by_match), flag)
    model = F.when(F.col("_passed"), F.col("model")).otherwise(F.raise_error(F.lit("predictions failed the checks")))
    return both.withColumn("model", model).drop("_passed")


def rotation(dataset: DataFrame, least_matches: int = 3) -> Turns:
    """Each match with usable rows once as test, the next one validates (wraps).

    The driver reads one row per match of the protocol. A turn without both
    classes among its train, validation or test rows is an error.
    """
    found = sorted((r["match_id"], r["zero"], r["one"]) for r in dataset.groupBy(F.col("match_id").cast("string").alias("match_id")).agg(
        count_where(F.col(LABEL) == 0).alias("zero"), count_where(F.col(LABEL) == 1).alias("one")
    ).collect())
    if len(found) < least_matches:
        raise ValueError(f"a rotation needs {least_matches} matches at least")
    turns = Turns.rotation([m for m, _, _ in found])
    counts = np.array([[zero, one] for _, zero, one in found])
    for turn, roles in enumerate(turns.roles):
        for split, role in ROLES.items():
            if not counts[roles == role].sum(axis=0).all():
                raise ValueError(f"one class only in the {split} rows of the turn of {turns.groups[turn]}")
    return turns


def boosted_turns(names: Sequence[str], cfg: trees.TreeConfig = trees.TreeConfig()):
    """Boosted trees for :func:`leave_one_match_out`."""

    def scores(dataset: DataFrame, turns: Turns) -> DataFrame:
        rows = stage(_turn_rows(dataset, turns, "match_id", names), "turns")
        return trees.score(rows, trees.fit(rows, names, turns, cfg), turns, (VALIDATION, TEST))

    return scores


def logistic_turns(names: Sequence[str]):
    """Logistic regression for :func:`leave_one_match_out`."""

    def scores(dataset: DataFrame, turns: Turns) -> DataFrame:
        rows = stage(_turn_rows(dataset, turns, "match_id", names), "turns")
        return newton.score(rows, newton.fit(rows, names, turns), turns, (VALIDATION, TEST))

    return scores


def graph_turns(nodes: DataFrame, edges: DataFrame, cfg: temporal_graph.NetworkConfig = temporal_graph.NetworkConfig(), until_s: float = 2.0):
    """The temporal graph network for :func:`leave_one_match_out`."""

    def scores(dataset: DataFrame, turns: Turns) -> DataFrame:
        rows = graph_rows(nodes, edges, dataset, turns, "match_id", until_s)
        return temporal_graph.score(rows, temporal_graph.fit(rows, turns, cfg), turns, (VALIDATION, TEST))

    return scores


def leave_one_match_out(dataset: DataFrame, trainers: dict[str, Callable[[DataFrame, Turns], DataFrame]], selector=metrics.macro_f1_threshold) -> DataFrame:
    """Held-out predictions of every trainer over all turns, each match once as test.

    A trainer fits all turns together: a step of its fit is one pass over the
    rows. Thresholds are chosen by turn on its validation match. Every usable row
    must be predicted once by every model. Adds validation_match to the columns
    of a prediction.
    """
    usable = dataset.where(F.col(LABEL).isin(0, 1))
    if "eligible_for_detection_training" in dataset.columns:
        usable = usable.where("eligible_for_detection_training")
    turns = rotation(usable)
    parts = [train(usable, turns).withColumn("model", F.lit(name)) for name, train in trainers.items()]
    scored = stage(reduce(DataFrame.unionByName, parts).withColumnRenamed("y", "y_true"), "turn-scores")
    thresholds = selector(scored.where(F.col("role") == VALIDATION), ["model", "turn"])
    after = F.element_at(F.array(*[F.lit(turns.groups[int(np.flatnonzero(r == VALIDATION)[0])]) for r in turns.roles]), F.col("turn") + 1)
    # one threshold for each model and turn
    held_out = stage(
        scored.where(F.col("role") == TEST)
        .join(F.broadcast(thresholds), ["model", "turn"], "left")
        .withColumns({"split": F.lit("test"), "validation_match": after, "y_pred": (F.col("probability") >= F.col("threshold")).cast("int")})
        .select(*PREDICTION, "validation_match"),
        "held-out",
    )
    for row in gates.complete_prediction_checks(held_out, usable.select("candidate_id")).collect():
        if not (row["unique"] and row["complete"]):
            raise ValueError(f"held-out predictions are not complete: {row['model']}")
    return held_out


def finalize_review(annotations: DataFrame, log: DataFrame, choices: DataFrame) -> DataFrame:
    """Labels after the review; stops where they fail the annotation checks."""
    final = stage(labels.finalize_labels(annotations, log, choices), "final-labels")
    _require(gates.annotation_checks(final), "labels after the review")
    return final


def revise_labels(revised: DataFrame, annotations: DataFrame, episodes: DataFrame, split_table: DataFrame) -> DataFrame:
    """Change log of a revision; stops where the revised labels fail a check.

    ``revised`` is the result of :func:`labels.apply_revisions`. The annotation
    checks run on the revised table and the manifest checks on the manifest
    built from it, before the log is given out.
    """
    kept = stage(revised, "revised-labels")
    final = kept.select(*annotations.columns)
    _require(gates.annotation_checks(final), "labels after the revision")
    _require(gates.manifest_checks(labels.model_manifest(episodes, final, split_table)), "manifest after the revision")
    return labels.change_log(kept)


def _as_rows(checks: DataFrame, prefix: str) -> DataFrame:
    """One-row gate as (name, value) rows."""
    entries = [F.struct(F.lit(f"{prefix}{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in checks.columns]
    return checks.select(F.inline(F.array(*entries)))


def _require(checks: DataFrame, what: str) -> None:
    """Stop the run on a failed gate; reads its single row."""
    row = checks.first().asDict()
    if not all(row.values()):
        raise ValueError(f"{what}: {sorted(k for k, v in row.items() if not v)}")


#: Parts of a run that are frozen before training.
FOLDERS = ("frozen_annotations", "frozen_model_manifest")


def _digest(df: DataFrame, name: str) -> DataFrame:
    """One row: rows and a sum of row hashes, whatever the order of the rows."""
    columns = [F.col(f"`{c}`").cast("string") for c in sorted(df.columns)]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return df.agg(F.lit(name).alias("input"), F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit("0")).alias("digest"))


def _part():
    """Folder of a run's file."""
    return F.regexp_replace("path", r"/[^/]*$", "")


def final_run(
    annotations: DataFrame,
    manifest: DataFrame,
    features: DataFrame,
    trainers: dict[str, Callable[[DataFrame], DataFrame]],
    graph_trainer: Callable[[DataFrame], DataFrame],
    folder: str | None = None,
    minimum_per_class: int = 5,
) -> DataFrame:
    """Gate, freeze, audit, train, evaluate, hash, and audit the run folder.

    ``trainers`` maps a name to dataset -> predictions; ``graph_trainer`` trains
    the graph model. Every flag of the metadata says what this run did. Hashes
    are listed from the files as written, and checked against the folder as it
    is at the end. Returns the hashed inventory; a failed gate stops the run.

    A part is finished when its writer has committed it. A run into a ``folder``
    that an earlier run of the same inputs has left unfinished keeps the finished
    parts and writes the others; other inputs than those are an error.
    """
    spark = annotations.sparkSession
    dataset = baseline_dataset(features, manifest)
    _require(gates.readiness(annotations, dataset, minimum_per_class), "not ready for final training")
    out = folder or shared_file(spark, "final_run")

    def keep(df: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
        path = f"{out}/{name}"
        if exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path)
        made = df() if callable(df) else df
        made.write.mode("overwrite").parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    inputs = reduce(DataFrame.unionByName, [_digest(df, name) for df, name in ((annotations, "annotations"), (manifest, "manifest"), (features, "features"))])
    if sorted(map(tuple, keep(inputs, "inputs").collect())) != sorted(map(tuple, inputs.collect())):
        raise ValueError(f"{out} holds a run of other inputs")

    frozen = keep(annotations, "frozen_annotations")
    frozen_manifest = keep(manifest, "frozen_model_manifest")
    keep(labels.annotation_summary(frozen, frozen_manifest), "annotation_audit_summary")
    keep(labels.review_queue(frozen, frozen_manifest), "annotation_review_queue")
    rows = stage(dataset, "dataset")
    done: list[tuple[str, str]] = []
    preds = []
    for name, train in {**trainers, "temporal_gnn": graph_trainer}.items():
        preds.append(keep(lambda name=name, train=train: train(rows).withColumn("model", F.lit(name)), f"predictions/{name}"))
        done.append(("model", name))
    done.append(("baseline.final_run", str(bool(trainers)).lower()))
    done.append(("temporal_gnn.final_run", str(not preds[-1].isEmpty()).lower()))
    combined = reduce(DataFrame.unionByName, preds)
    scores = keep(evaluate(combined), "evaluation")
    done.append(("evaluation.final_run", str(not scores.isEmpty()).lower()))
    summary = keep(scores.where(F.col("match_id") == "ALL").withColumn("status", F.lit("FINAL")), "summary")
    status = summary.agg(F.when(F.count_if(F.col("status") != "FINAL") == 0, "FINAL").otherwise("DRAFT").alias("value"))
    parts = [FOLDERS[0], FOLDERS[1], "annotation_audit_summary", "annotation_review_queue", *[f"predictions/{n}" for _, n in done if _ == "model"], "evaluation", "summary"]
    written = tables.file_inventory(spark, out, "*.parquet")
    listed = keep(written.select("path", "sha256"), "run_manifest")
    missing = set(parts) - {r["part"] for r in written.select(_part().alias("part")).distinct().collect()}
    done.append(("status", "incomplete" if missing else "final_training_complete"))
    metadata = keep(
        spark.createDataFrame(done, "name string, value string")
        .unionByName(status.select(F.lit("summary.status").alias("name"), "value"))
        .unionByName(_as_rows(gates.prediction_checks(combined), "check.evaluation."))
        .unionByName(_as_rows(gates.annotation_checks(frozen), "check.annotation.")),
        "metadata",
    )
    inventory = tables.file_inventory(spark, out, "*.parquet")
    models_run = [n for k, n in done if k == "model"]
    _require(
        gates.artifact_checks(tables.by_artifact(inventory, _part()), tables.by_artifact(listed, _part()), metadata, frozen, [*parts, "metadata"], [*FOLDERS, "evaluation"], models_run),
        "artifact audit",
    )
    return inventory
