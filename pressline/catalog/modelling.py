"""Datasets, classifiers and runs."""

# ruff: noqa: E501

from functools import reduce

from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.columns import seeded_key, strict_bool
from ..operators import labels
from ..plans import models, temporal_graph
from ..session import shared_file, stage
from .bindings import doc_id_key
from .registry import query, view
from .scoring import R9

FEATURES = ["f1", "f2", "f3"]

view("fx_rows", """
SELECT 'V' || vec_id AS candidate_id, 'G' || (vec_id % 7) AS match_id, CASE WHEN vec_id % 19 <> 0 THEN list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)) END AS f1,
       list_sum(list_transform(embedding[17:32], lambda x: x::DOUBLE)) AS f2, list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)) AS f3, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS gegenpressing_label,
       CASE vec_id % 7 WHEN 5 THEN 'validation' WHEN 6 THEN 'test' ELSE 'train' END AS split FROM embeddings""")


@query("class_weights", """
SELECT label, n, c / (2.0::DOUBLE * greatest(n, 1)) AS weight FROM (
  SELECT 0 AS label, count(*) FILTER (WHERE gegenpressing_label = 0) AS n, count(*) AS c FROM fx_rows WHERE split = 'train'
  UNION ALL SELECT 1, count(*) FILTER (WHERE gegenpressing_label = 1), count(*) FROM fx_rows WHERE split = 'train')""")
def _(s):
    return models.class_weights(s.feature_rows.where(F.col("split") == "train"))


FILLED = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM fx_rows WHERE split = 'train')) AS {c}" for c in FEATURES)
view("fx_filled", f"SELECT candidate_id, split, {FILLED} FROM fx_rows")


@query("impute_scale", "SELECT candidate_id, split, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM fx_filled WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM fx_filled WHERE split = 'train'), 6) AS {c}" for c in FEATURES
) + " FROM fx_filled")
def _(s):
    out = models.impute_scale(s.feature_rows, FEATURES).select("candidate_id", "split", *FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in FEATURES})


def _doc_features(s):
    """Plain document features of strict-valid rows."""
    rows = s.table("documents").select(
        doc_id_key().alias("candidate_id"), F.col("source").alias("match_id"), F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
    )
    return rows.join(s.manifest.select("candidate_id"), "candidate_id", "left_semi")


@query("baseline_dataset", """
SELECT m.candidate_id, m.match_id, d.n_chars::DOUBLE AS n_chars, m.split, m.gegenpressing_label, m.label_status, m.eligible_for_detection_training
FROM fx_manifest m JOIN documents d ON 'D' || d.doc_id = m.candidate_id""")
def _(s):
    return models.baseline_dataset(_doc_features(s).drop("n_words"), s.manifest)


@query("graph_dataset", """
SELECT candidate_id, match_id, split, gegenpressing_label, 'g/' || candidate_id AS cache_file FROM fx_manifest""")
def _(s):
    """Graphs of strict-valid episodes against the whole manifest."""
    valid = s.episodes.where(strict_bool("strict_valid", accept=("true",)))
    graphs = valid.select("candidate_id", "match_id", F.concat(F.lit("g/"), "candidate_id").alias("cache_file"))
    return models.graph_dataset(s.manifest.select("candidate_id", "match_id", "split", "gegenpressing_label"), graphs)


def _graph_rows(s):
    """Candidates of the tracks with a split that leaves every part both classes."""
    rows = s.track_candidates.select("candidate_id", "match_id", F.col("label_regain_5s").alias("gegenpressing_label"), seeded_key("candidate_id", 42).alias("_digest"))
    numbered = ordered.row_numbers(rows, ["gegenpressing_label"], ["_digest", "candidate_id"], ordered.digest_slices("_digest"), "_n")
    place = F.col("_n") % 5
    return numbered.withColumn("split", F.when(place == 1, "validation").when(place == 2, "test").otherwise("train")).withColumn("turn", F.concat(F.lit("G"), (F.col("_n") % 3).cast("string"))).drop("_n", "_digest")


def _checked(preds, *more):
    """What a model leaves open is its probabilities; ids, split, truth and decisions are fixed."""
    sane = F.col("probability").between(0, 1)
    decided = F.col("y_pred") == (F.col("probability") >= F.col("threshold")).cast("int")
    return preds.select("model", "split", "candidate_id", "match_id", "y_true", *more, sane.alias("probability_ok"), decided.alias("decision_ok"))


def _trained(name, rows="fx_rows"):
    return f"SELECT '{name}' AS model, split, candidate_id, match_id, gegenpressing_label AS y_true, TRUE AS probability_ok, TRUE AS decision_ok FROM {rows}"


@query("train_logistic", _trained("logistic_regression"))
def _(s):
    return _checked(models.train_logistic(s.feature_rows, FEATURES))


@query("train_boosted", _trained("boosted_trees"))
def _(s):
    return _checked(models.train_boosted(s.feature_rows, FEATURES))


view("fx_graph_rows", """
SELECT candidate_id, match_id, label_regain_5s AS gegenpressing_label, CASE n % 5 WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'train' END AS split, 'G' || (n % 3) AS turn
FROM (SELECT *, row_number() OVER (PARTITION BY label_regain_5s ORDER BY md5(candidate_id || '-42'), candidate_id) AS n FROM fx_tcand)
WHERE candidate_id IN (SELECT candidate_id FROM fx_nodes)""")


@query("train_graph_model", _trained("graph_model", "fx_graph_rows"))
def _(s):
    return _checked(models.train_graph_model(s.graph_nodes, s.graph_edges, _graph_rows(s)))


view("fx_eval", """
SELECT model, split, 'ALL' AS match_id, n, accuracy, f1, roc_auc, average_precision FROM fx_metrics
UNION ALL SELECT c.model, c.split, c.match_id, c.n, round((tp + tn) / c.n, 9), round(2 * tp / greatest(2 * tp + fp + fn, 1), 9), round(r.roc_auc, 9), round(a.average_precision, 9)
FROM fx_match_counts c LEFT JOIN fx_match_rank r USING (model, match_id) LEFT JOIN fx_match_ap a USING (model, match_id)""")


@query("evaluate", "SELECT * FROM fx_eval")
def _(s):
    out = models.evaluate(s.prediction_files).select("model", "split", "match_id", "n", "accuracy", "f1", "roc_auc", "average_precision")
    return R9(out, "accuracy", "f1", "roc_auc", "average_precision")


@query("leave_one_match_out", """
SELECT model, 'test' AS split, candidate_id, match_id, gegenpressing_label AS y_true, 'G' || ((CAST(substr(match_id, 2) AS INT) + 1) % 7) AS validation_match,
       TRUE AS probability_ok, TRUE AS decision_ok
FROM fx_rows, (VALUES ('logistic'), ('boosted')) m(model)""")
def _(s):
    rows = stage(s.feature_rows, "rotation")
    trainers = {"logistic": models.logistic_turns(FEATURES), "boosted": models.boosted_turns(FEATURES)}
    return _checked(models.leave_one_match_out(rows, trainers), "validation_match")


@query("leave_one_match_out_graph", """
SELECT 'temporal_graph' AS model, 'test' AS split, candidate_id, turn AS match_id, gegenpressing_label AS y_true,
       'G' || ((CAST(substr(turn, 2) AS INT) + 1) % 3) AS validation_match, TRUE AS probability_ok, TRUE AS decision_ok
FROM fx_graph_rows""")
def _(s):
    """The graph network over three groups of episodes; both labels are in each."""
    rows = stage(_graph_rows(s).drop("match_id").withColumnRenamed("turn", "match_id"), "rotation")
    trainers = {"temporal_graph": models.graph_turns(s.graph_nodes, s.graph_edges)}
    return _checked(models.leave_one_match_out(rows, trainers), "validation_match")


view("fx_finished", """
SELECT CASE WHEN doc % 11 = 0 THEN -1 WHEN doc % 3 = 0 OR doc % 7 = 0 THEN 1 ELSE 0 END AS label, split, match_id
FROM (SELECT CAST(substr(candidate_id, 2) AS BIGINT) AS doc, split, match_id FROM fx_manifest)""")


@query("final_run", """
SELECT 'frozen_annotations' AS part, count(*) AS n_rows, TRUE AS hashed FROM fx_finished
UNION ALL SELECT 'frozen_model_manifest', count(*), TRUE FROM fx_finished
UNION ALL SELECT 'annotation_audit_summary', count(*), TRUE FROM (SELECT DISTINCT split, match_id FROM fx_finished)
UNION ALL SELECT 'predictions/' || model, count(*), TRUE FROM fx_finished, (VALUES ('logistic_regression'), ('boosted_trees'), ('temporal_gnn')) m(model)
  WHERE label >= 0 GROUP BY model
UNION ALL SELECT 'evaluation', 3 * (3 + count(*)), TRUE FROM (SELECT DISTINCT split, match_id FROM fx_finished WHERE label >= 0)
UNION ALL SELECT 'summary', 9, TRUE""")
def _(s):
    """A run over the finished annotation of every strict-valid document; nothing is left out before the gate.

    Fits have the length of a final run: 200 trees, and 100 epochs with a patience of 15.
    """
    annotations = s.finished_annotations
    manifest = labels.model_manifest(s.episodes, annotations, s.split_table)
    names = ["n_chars", "n_words"]
    trainers = {
        "logistic_regression": lambda rows: models.train_logistic(rows, names),
        "boosted_trees": lambda rows: models.train_boosted(rows, names),
    }
    network = temporal_graph.NetworkConfig(epochs=100, patience=15)
    columns = ["candidate_id", "match_id", "split", "gegenpressing_label", "eligible_for_detection_training"]

    def graph_trainer(rows):
        return models.train_graph_model(s.graph_nodes, s.graph_edges, s.borrowing(rows.select(*columns)), cfg=network)

    folder = shared_file(s.spark, "final_run")
    inventory = models.final_run(annotations, manifest, _doc_features(s), trainers, graph_trainer, folder)
    found = inventory.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("part")).agg(F.min(F.length("sha256") == 64).alias("hashed"))
    parts = ["frozen_annotations", "frozen_model_manifest", "annotation_audit_summary", *[f"predictions/{m}" for m in (*trainers, "temporal_gnn")], "evaluation", "summary"]
    sizes = [s.spark.read.parquet(f"{folder}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n_rows")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), sizes).join(found, "part")
