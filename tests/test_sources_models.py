"""Raw files, sinks, hashes and classifiers."""

import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressline.operators import gates
from pressline.plans import models, newton, parallel, trees
from pressline.sources import tables, tracking


def test_load_match(spark, tmp_path):
    head = "period_id,timestamp,frame_id,ball_state,ball_owning_team_id,ball_x,ball_y,ball_z,ball_speed,"
    a = "1,0 days 00:00:00.040000,2,alive,T,0.5,0.5,,1.0,0.1,0.2,3.0,,,\n1,bad,3,dead,,0.5,0.5,0,1,,,,,,\n"
    (tmp_path / "A_tracking.csv").write_text(head + "DFL-OBJ-1_x,DFL-OBJ-1_y,DFL-OBJ-1_s,DFL-OBJ-2_x,DFL-OBJ-2_y,DFL-OBJ-2_s\n" + a)
    (tmp_path / "B_tracking.csv").write_text(head + "DFL-OBJ-9_x,DFL-OBJ-9_y,DFL-OBJ-9_s\n" + "2,0 days 00:00:01,7,alive,U,0.1,0.1,0,0,0.3,0.4,1.5\n")
    events = "event_id,event_type,period_id,timestamp,team_id,player_id,receiver_player_id,success\n"
    for m in "AB":
        (tmp_path / f"{m}_events.csv").write_text(events + "1,PASS,1,-1 days +23:59:59,T,P,,True\n")
    frames, positions, ev = tracking.load_matches(spark, str(tmp_path), ["A", "B"])
    assert [(r.match_id, r.frame_id, r.t_us) for r in frames.orderBy("match_id", "frame_id").collect()] == [
        ("A", 2, 40_000), ("A", 3, None), ("B", 7, 1_000_000)]
    assert [(r.player_id, r.x, r.speed) for r in positions.orderBy("player_id").collect()] == [("DFL-OBJ-1", 0.1, 3.0), ("DFL-OBJ-9", 0.3, 1.5)]
    assert {(r.t_us, r.success) for r in ev.collect()} == {(-1_000_000, True)}
    with pytest.raises(FileNotFoundError):
        tracking.load_match(spark, str(tmp_path), "C")


def test_inventory_of_a_folder_named_with_its_store(spark, tmp_path):
    """Paths are below the folder however its store is written, also where the folder's name occurs again."""
    deep = tmp_path / "sub" / str(tmp_path)[1:]
    deep.mkdir(parents=True)
    (deep / "a.txt").write_bytes(b"abc")
    for folder in (f"file://{tmp_path}", f"file:{tmp_path}/", str(tmp_path)):
        assert [r.path for r in tables.file_inventory(spark, folder).collect()] == [f"sub{tmp_path}/a.txt"]


def test_answer_sheet_and_gate(spark, tmp_path):
    answer = {"person": "Ann", "label": 1, "confidence": 3, "notes": "x", "utc": "2024-01-01T00:00:00Z"}
    sheet = {"hash": "h", "role": "second", "person": "Ann", "answers": {"c1": answer, "c2": {**answer, "label": -1}}}
    (tmp_path / "s.json").write_text(json.dumps(sheet, indent=1))
    from pressline.operators import labels

    rows = labels.explode_answers(tables.read_answer_sheets(spark, [str(tmp_path / "s.json")]).drop("person"))
    expected = spark.createDataFrame([("c1",), ("c2",)], "candidate_id string")
    assert all(gates.answer_checks(rows, expected, "second", "h").first().asDict().values())
    earlier = spark.createDataFrame([(" ANN ",)], "person string")
    assert not gates.rater_checks(rows, earlier).first().second_rater_differs


def test_file_hashes_and_artifact_gate(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"xyz")
    inventory = tables.file_inventory(spark, str(tmp_path))
    got = {r.path: (r.bytes, r.sha256) for r in inventory.collect()}
    assert got == {"sub/a.txt": (3, hashlib.sha256(b"abc").hexdigest()), "b.txt": (3, hashlib.sha256(b"xyz").hexdigest())}
    names = ["baseline.final_run", "temporal_gnn.final_run", "evaluation.final_run", "check.annotation.x", "check.evaluation.y"]
    meta = spark.createDataFrame([(n, "true") for n in names] + [("status", "final_training_complete"), ("summary.status", "FINAL"), ("model", "m")], "name string, value string")
    ann = spark.createDataFrame([(1,)], "is_gegenpressing int")
    good = spark.createDataFrame([({"sub\\a.txt": got["sub/a.txt"][1]},)], "artifact_sha256 map<string,string>")
    assert all(gates.artifact_checks(inventory, tables.listed_hashes(good), meta, ann, ["b.txt"], ["sub/a.txt"], ["m"]).first().asDict().values())
    bad = spark.createDataFrame([({"b.txt": "0"},)], "artifact_sha256 map<string,string>")
    row = gates.artifact_checks(inventory, tables.listed_hashes(bad), meta, ann, ["b.txt", "gone.txt"], ["sub/a.txt"], ["m", "n"]).first()
    assert not row.artifact_hashes_match and not row.critical_hashes_listed
    assert not row.all_expected_files_nonempty and not row.expected_models_present and row.summary_marked_final


def test_partitioned_sink_round_trip(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("match_id"), "id")
    tables.write_partitioned(df, str(tmp_path / "out"), order=["id"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {p.name for p in (tmp_path / "out").glob("match_id=*")} == {"match_id=m0", "match_id=m1", "match_id=m2"}


def toy(spark, n=240):
    i = F.col("id")
    noise = (F.hash("id") % 100) / 100.0
    return spark.range(n).select(
        F.concat(F.lit("c"), i.cast("string")).alias("candidate_id"),
        F.concat(F.lit("g"), (i % 4).cast("string")).alias("match_id"),
        F.when(i % 11 != 0, (i % 2) * 2.0 + noise).alias("f1"),
        noise.alias("f2"),
        (i % 2).cast("int").alias(models.LABEL),
        F.when(i % 4 == 2, "validation").when(i % 4 == 3, "test").otherwise("train").alias("split"),
    )


def test_logistic_and_boosted_separate_toy_data(spark):
    df = toy(spark).withColumn("split", F.when(F.col("candidate_id").rlike("[05]$"), "validation").when(F.col("candidate_id").rlike("[27]$"), "test").otherwise("train"))
    for preds in (
        models.train_logistic(df, ["f1", "f2"]),
        models.train_boosted(df, ["f1", "f2"], trees.TreeConfig(trees=3)),
    ):
        rows = preds.collect()
        assert len(rows) == 240 and all(0 <= r.probability <= 1 for r in rows)
        test = [r for r in rows if r.split == "test"]
        assert sum(r.y_true == r.y_pred for r in test) / len(test) > 0.8


def test_class_weights_and_rotations(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], f"{models.LABEL} int")
    assert [(r.label, r.n, round(r.weight, 6)) for r in models.class_weights(df).collect()] == [(0, 3, round(4 / 6, 6)), (1, 1, 2.0)]
    mixed = toy(spark).withColumn("match_id", F.concat(F.lit("g"), F.pmod(F.hash("candidate_id"), F.lit(4)).cast("string")))
    turns = models.rotation(mixed)
    assert turns.groups == ("g0", "g1", "g2", "g3") and turns.roles[3].tolist() == [1, 0, 0, 2]
    with pytest.raises(ValueError, match="one class only in the validation rows"):
        models.rotation(toy(spark))


def test_every_match_is_held_out_once(spark):
    df = toy(spark).withColumn("match_id", F.concat(F.lit("g"), F.pmod(F.hash("candidate_id"), F.lit(4)).cast("string")))
    trainers = {"logistic": models.logistic_turns(["f1", "f2"]), "boosted": models.boosted_turns(["f1", "f2"], trees.TreeConfig(trees=4, step=0.3))}
    out = models.leave_one_match_out(df, trainers).toPandas()
    assert out.groupby(["model", "candidate_id"]).size().eq(1).all() and len(out) == 480
    assert (out.y_pred == (out.probability >= out.threshold)).all() and (out.y_pred == out.y_true).mean() > 0.8
    assert dict(zip(out.match_id, out.validation_match, strict=True)) == {"g0": "g1", "g1": "g2", "g2": "g3", "g3": "g0"}
    assert (out.groupby(["model", "match_id"]).threshold.nunique() == 1).all()
    # by hand: one turn alone has the same numbers
    turns = parallel.Turns(("g0", "g1", "g2", "g3"), np.array([[2, 1, 0, 0]]))
    rows = models._turn_rows(df, turns, "match_id", ["f1", "f2"])
    alone = newton.score(rows, newton.fit(rows, ["f1", "f2"], turns), turns).toPandas().set_index("candidate_id").probability
    both = out[(out.model == "logistic") & (out.match_id == "g0")].set_index("candidate_id").probability
    assert np.abs(alone - both.reindex(alone.index)).max() < 1e-6


def test_feature_row_without_manifest_is_an_error(spark):
    features = spark.createDataFrame([("c1", "g", 1.0)], "candidate_id string, match_id string, f double")
    manifest = spark.createDataFrame([("c2", "g", "train", 1, "usable", True)],
                                     f"candidate_id string, match_id string, split string, {models.LABEL} int, label_status string, eligible_for_detection_training boolean")
    with pytest.raises(Exception, match="feature row without manifest"):
        models.baseline_dataset(features, manifest).collect()


def test_predictions_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("model,candidate_id,y_true,probability,threshold\nm1,c1,1,0.9,0.5\n")
    (tmp_path / "b.csv").write_text("threshold,probability,candidate_id,model,extra\n0.4,0.2,\"c,2\",m2,x\n")
    rows = {r.candidate_id: r for r in tables.read_predictions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert (rows["c1"].model, rows["c1"].y_true, rows["c1"].probability, rows["c1"].threshold) == ("m1", 1, 0.9, 0.5)
    assert (rows["c,2"].model, rows["c,2"].y_true, rows["c,2"].probability, rows["c,2"].threshold) == ("m2", None, 0.2, 0.4)


def test_training_needs_both_classes_in_every_split(spark):
    with pytest.raises(ValueError, match="no usable labels in the train"):
        models.train_logistic(toy(spark).where("split <> 'train'"), ["f1"])
    with pytest.raises(ValueError, match="one class only in the validation"):
        models.train_logistic(toy(spark), ["f1"])
    with pytest.raises(ValueError, match="no usable labels in the train"):
        models.usable_rows(toy(spark).withColumn("eligible_for_detection_training", F.lit(False)))


def test_graph_without_manifest_row_is_an_error(spark):
    a = spark.createDataFrame([("c1", "m")], "candidate_id string, match_id string")
    b = spark.createDataFrame([("c2", "m")], "candidate_id string, match_id string")
    with pytest.raises(Exception, match="do not match"):
        models.graph_dataset(a, b).collect()


def test_every_artifact_flag_turns_false_on_its_own(spark):
    files = spark.createDataFrame([("a", 5, "h1"), ("b", 5, "h2")], "path string, bytes long, sha256 string")
    listed = files.select("path", "sha256")
    good = {"baseline.final_run": "true", "temporal_gnn.final_run": "true", "evaluation.final_run": "true", "status": "final_training_complete",
            "summary.status": "FINAL", "check.evaluation.x": "true", "check.annotation.x": "true", "model": "m"}
    ann = spark.createDataFrame([(1,)], "is_gegenpressing int")
    meta = lambda d: spark.createDataFrame(list(d.items()), "name string, value string")

    def wrong(metadata=good, inventory=files, hashes=listed, labels=ann, expected=("a", "b"), critical=("a",), models_=("m",)):
        row = gates.artifact_checks(inventory, hashes, meta(metadata), labels, expected, critical, models_).first().asDict()
        return {k for k, v in row.items() if not v}

    assert wrong() == set()
    for name, flag in (
        ("baseline.final_run", "baseline_marked_final"), ("temporal_gnn.final_run", "graph_model_marked_final"),
        ("evaluation.final_run", "evaluation_marked_final"), ("status", "run_manifest_complete"), ("summary.status", "summary_marked_final"),
        ("check.evaluation.x", "evaluation_checks_passed"), ("check.annotation.x", "annotation_checks_passed"), ("model", "expected_models_present"),
    ):
        assert wrong(metadata={**good, name: "no"}) == {flag}
    assert wrong(expected=("a", "c")) == {"all_expected_files_nonempty"} == wrong(expected=())
    assert wrong(critical=("c",)) == {"critical_hashes_listed"} == wrong(critical=())
    assert wrong(models_=()) == {"expected_models_present"}
    assert wrong(hashes=listed.withColumn("sha256", F.lit("other"))) == {"artifact_hashes_match"}
    assert wrong(labels=spark.createDataFrame([(None,)], "is_gegenpressing int")) == {"frozen_annotations_complete"}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from pressline import session

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert session.shared_folder(spark) == session.shared_folder(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(spark)


def test_files_of_any_size_are_hashed_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "WHOLE_FILE_BYTES", 100)
    rng = np.random.default_rng(1)
    files = {
        "small.bin": b"x" * 100,
        "ends.bin": b"line\r\n" * 40_000,
        "open.bin": b"line\n" * 30_000 + b"rest",
        "sub/random.bin": rng.integers(0, 256, 300_000).astype(np.uint8).tobytes(),
        "long.bin": b"y" * 70_000,
        "breaks.bin": b"\n" * 5000,
    }
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.bin").write_bytes(b"")  # has no bytes to read and no row
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.path: (r.bytes, r.sha256) for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}


def test_a_folder_of_matches_is_one_plan(spark, tmp_path):
    fixed = ["period_id", "timestamp", "frame_id", "ball_state", "ball_owning_team_id", "ball_x", "ball_y", "ball_z", "ball_speed"]
    rng = np.random.default_rng(2)
    want_frames, want_positions, want_events = set(), set(), set()
    for m in range(500):
        players = [f"DFL-OBJ-{m}{k}" for k in range(1 + m % 4)]
        head = fixed + [f"{p}_{c}" for p in players for c in ("x", "y", "s")]
        head = [head[i] for i in rng.permutation(len(head))]
        lines = [",".join(head)]
        for f in range(2):
            cells = {"period_id": "1", "timestamp": f"0 days 00:00:0{f}", "frame_id": str(f), "ball_state": "alive", "ball_owning_team_id": '"T,""1"', "ball_x": "0.5"}
            for k, p in enumerate(players):
                if k != 1:
                    cells |= {f"{p}_x": f"0.{k + 1}", f"{p}_y": "0.5"}
                    want_positions.add((f"M{m}", f, p, (k + 1) / 10))
            lines.append(",".join(cells.get(c, "") for c in head))
            want_frames.add((f"M{m}", f, f * 1_000_000, 'T,"1'))
        (tmp_path / f"M{m}_tracking.csv").write_text("\r\n".join(lines) + "\r\n")
        (tmp_path / f"M{m}_events.csv").write_text("success,event_id,period_id,timestamp,event_type,team_id,player_id,receiver_player_id\nTrue,7,1,-1 days +23:59:59,PASS,T,P,\n")
        want_events.add((f"M{m}", 7, -1_000_000, True))
    frames, positions, events = tracking.load_folder(spark, str(tmp_path))
    assert {(r.match_id, r.frame_id, r.t_us, r.owner) for r in frames.collect()} == want_frames
    assert {(r.match_id, r.frame_id, r.player_id, r.x) for r in positions.collect()} == want_positions
    assert {(r.match_id, r.event_id, r.t_us, r.success) for r in events.collect()} == want_events
    assert positions._jdf.queryExecution().optimizedPlan().toString().count("\n") < 25
    some = tracking.load_folder(spark, str(tmp_path), ["M3", "M499"])[0]
    assert {r.match_id for r in some.collect()} == {"M3", "M499"}
    with pytest.raises(FileNotFoundError, match="gone"):
        tracking.load_folder(spark, str(tmp_path), ["M3", "gone"])
    (tmp_path / "bad_tracking.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="file without header"):
        tracking.load_folder(spark, str(tmp_path))[0].collect()


def test_revision_that_breaks_a_check_is_stopped(spark):
    from pressline.operators import labels

    rows = [(f"c{i}", f"m{i % 3}", i % 2, 3, "note", "r1") for i in range(12)]
    ann = spark.createDataFrame(rows, "candidate_id string, match_id string, is_gegenpressing int, annotation_confidence int, annotation_notes string, annotator string")
    episodes = ann.select("candidate_id", "match_id", F.lit("True").alias("strict_valid"), F.lit(1).alias("period_id"), F.lit(1).alias("loss_frame"))
    splits = spark.createDataFrame([("m0", "train"), ("m1", "validation"), ("m2", "test")], "match_id string, split string")
    fine = spark.createDataFrame([("c1", -1)], "candidate_id string, is_gegenpressing int")
    log = models.revise_labels(labels.apply_revisions(ann, fine), ann, episodes, splits)
    assert [(r.candidate_id, r.column, r.old_value, r.new_value) for r in log.collect()] == [("c1", "is_gegenpressing", "1", "-1")]
    wrong = spark.createDataFrame([("c1", 5)], "candidate_id string, is_gegenpressing int")
    with pytest.raises(ValueError, match="after the revision"):
        models.revise_labels(labels.apply_revisions(ann, wrong), ann, episodes, splits)


def test_an_unfinished_run_goes_on(spark, tmp_path):
    n = 60
    i = F.col("id")
    ids = F.concat(F.lit("c"), i.cast("string")).alias("candidate_id")
    match = F.concat(F.lit("m"), (i % 3).cast("string")).alias("match_id")
    y = (F.floor(i / 3) % 2).cast("int")
    annotations = spark.range(n).select(ids, match, y.alias("is_gegenpressing"), F.lit(3).alias("annotation_confidence"), F.lit("note").alias("annotation_notes"), F.lit("r").alias("annotator"), F.lit("t").alias("annotated_at_utc"), i.alias("annotation_order"))
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (i % 3 + 1).cast("int"))
    manifest = spark.range(n).select(ids, match, split.alias("split"), y.alias(models.LABEL), F.lit("usable").alias("label_status"), F.lit(True).alias("eligible_for_detection_training"),
                                     F.lit(1).alias("period_id"), i.alias("loss_frame"), F.lit(1).alias("label_regain_5s"), y.alias("is_gegenpressing"), F.lit(3).alias("annotation_confidence"))
    features = spark.range(n).select(ids, match, (y + F.rand(1) / 2).alias("f1"))
    features = spark.createDataFrame(features.collect(), features.schema)
    calls = []

    def trainer(name, fail=False):
        def train(rows):
            calls.append(name)
            if fail:
                raise RuntimeError("stopped")
            return models.train_logistic(rows, ["f1"], name=name)

        return train

    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError, match="stopped"):
        models.final_run(annotations, manifest, features, {"a": trainer("a"), "b": trainer("b")}, trainer("g", fail=True), folder)
    resumed = models.final_run(annotations, manifest, features, {"a": trainer("a"), "b": trainer("b")}, trainer("g"), folder)
    assert calls == ["a", "b", "g", "g"]
    parts = {r.path.rsplit("/", 1)[0] for r in resumed.collect()}
    whole = models.final_run(annotations, manifest, features, {"a": trainer("a"), "b": trainer("b")}, trainer("g"), str(tmp_path / "other"))
    assert parts == {r.path.rsplit("/", 1)[0] for r in whole.collect()}
    a, b = (spark.read.parquet(f"{d}/evaluation").orderBy("model", "split", "match_id").collect() for d in (folder, str(tmp_path / "other")))
    assert a == b
    with pytest.raises(ValueError, match="other inputs"):
        models.final_run(annotations, manifest.limit(30), features.limit(30), {"a": trainer("a")}, trainer("g"), folder)


def test_artifact_gate_takes_tables_of_many_files(spark, tmp_path):
    """Every table of the smallest folder as a folder of two files: the gate's flags stay as they are."""
    import __spark_entry__ as contract

    for table in sorted(Path("/root/testdata/sf0.001").glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(2).write.parquet(f"{tmp_path}/{table.name}")
    row = contract.queries()["gate_artifacts"](spark, str(tmp_path)).first().asDict()
    assert all(row.values()), row
    files = tables.file_inventory(spark, str(tmp_path), "*.parquet")
    by_table = {r.path: r.bytes for r in tables.by_artifact(files, F.substring_index("path", "/", 1)).collect()}
    assert by_table["documents.parquet"] == sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))


def test_large_files_are_hashed_in_one_pass(spark, tmp_path, monkeypatch):
    """No sort and no shuffle, whatever a file's suffix says of its content; names and first bytes of any kind."""
    monkeypatch.setattr(tables, "WHOLE_FILE_BYTES", 100)
    noise = np.random.default_rng(2).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    files = {"a b%20.bin": noise, "packed.gz": noise, "marked.bin": b"\xef\xbb\xbfx\n" * 900, "open.bin": b"\xef\xbb\xbfx\ny" * 900, "marks.bin": b"\xef\xbb\xbf" * 100}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for plain in ({}, {"none": noise, "d.x/no-suffix": b"\n" + noise}):
            for name, content in plain.items():
                (tmp_path / name).parent.mkdir(exist_ok=True)
                (tmp_path / name).write_bytes(content)
            for name, content in files.items():
                (tmp_path / name).write_bytes(content)
            found = tables.file_inventory(spark, str(tmp_path))
            assert {r.path: (r.bytes, r.sha256) for r in found.collect()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (files | plain).items()}
            assert ("Exchange" in found._jdf.queryExecution().toString()) == bool(plain)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
