"""Bind the driver's tables to the schemas the operators expect.

Everything here is derived by Spark from the given tables, so it grows with
them: a user of ``events`` is a match, a run of 23 consecutive vectors of
``embeddings`` is an episode (22 players and the ball), a document is a
labelled candidate of the match named by its source.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import HOUR, EpisodeConfig, TimeSlices
from ..session import stage


# The event stream is far sparser than 25 Hz tracking: hours take the place of seconds.
EVENT_CFG = EpisodeConfig(
    pre_us=24 * HOUR,
    post_us=24 * HOUR,
    regain_horizon_us=24 * HOUR,
    frame_step_us=3 * HOUR,
    slices=TimeSlices(fine=HOUR),  # at most 16 days, 384 slices, per period
)
# Embeddings give 32 frames per episode, the turnover in frame 15.
TRACK_CFG = EpisodeConfig(pre_us=600_000, post_us=640_000)
NODES = 23
TRACK_FRAMES = 32
LOSS_AT = 15


def doc_id_key() -> Column:
    return F.concat(F.lit("D"), F.col("doc_id").cast("string"))


def wall_us(c: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000
    return ((days * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + seconds.cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- event stream -------------------------------------------------
    @cached_property
    def frames(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.col("event_type")
        return self.table("events").select(
            F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("match_id"),
            F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("period_id"),
            wall_us("ts").alias("t_us"),
            F.col("event_id").alias("frame_id"),
            F.when(kind.isin("view", "click"), "T1").when(kind.isin("purchase", "signup"), "T2").alias("owner"),
            F.when(k % 7 == 0, "dead").otherwise("alive").alias("ball_state"),
            "value",
        )

    @cached_property
    def candidates(self) -> DataFrame:
        from ..operators import turnover

        return turnover.turnover_candidates(self.frames, EVENT_CFG)

    @cached_property
    def match_events(self) -> DataFrame:
        """Events as match events; times start one day early, so some are negative."""
        kind = F.col("event_type")
        epoch = 1_704_067_200_000_000  # 2024-01-01 UTC
        return self.table("events").select(
            F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("match_id"),
            F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("period_id"),
            (wall_us("ts") - epoch - 24 * HOUR).alias("t_us"),
            "event_id",
            "event_type",
            F.when(kind.isin("view", "click"), "T1").when(kind.isin("purchase", "signup"), "T2").alias("team_id"),
            F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("P"), (F.col("event_id") % 50).cast("string"))).alias(
                "player_id"
            ),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("P"), (F.col("event_id") % 47).cast("string"))).alias(
                "receiver_player_id"
            ),
            (F.col("value") > 100).alias("success"),
        )

    # --- tracking -----------------------------------------------------
    @cached_property
    def _points(self) -> DataFrame:
        vec, i = F.col("vec_id"), F.col("i")
        episode = F.floor(vec / NODES)
        # Gaps only in some episodes, so that strict-valid ones remain.
        invalid = ((vec % 17 == 0) & (i % 4 == 1) & (episode % 3 == 0)) | (
            (vec % 41 == 3) & (i == LOSS_AT) & (episode % 4 == 1)
        )
        x = F.col("embedding")[i * 2].cast("double")
        y = F.col("embedding")[i * 2 + 1].cast("double")
        frame = ((episode % 10) * 100 + i).cast("bigint")
        return (
            self.table("embeddings")
            .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(TRACK_FRAMES - 1))).alias("i"))
            .where(~((episode % 5 == 0) & (i == 20)))
            .select(
                F.concat(F.lit("G"), F.floor(vec / (NODES * 10)).cast("string")).alias("match_id"),
                F.lit(1).alias("period_id"),
                frame.alias("frame_id"),
                (frame * TRACK_CFG.frame_step_us).alias("t_us"),
                episode.alias("episode"),
                (vec % NODES).cast("int").alias("node"),
                "vec_id",
                "i",
                F.when(~invalid, x).alias("x"),
                F.when(~invalid, y).alias("y"),
                F.when((vec + i) % 11 != 0, F.sqrt(x * x + y * y) * 10).alias("speed"),
            )
        )

    @cached_property
    def track_frames(self) -> DataFrame:
        losing = F.when(F.col("episode") % 2 == 0, "A").otherwise("B")
        other = F.when(F.col("episode") % 2 == 0, "B").otherwise("A")
        return self._points.where(F.col("node") == NODES - 1).select(
            "match_id",
            "period_id",
            "frame_id",
            "t_us",
            F.when((F.col("i") + F.col("episode")) % 9 == 0, "dead").otherwise("alive").alias("ball_state"),
            F.when(F.col("i") < LOSS_AT, losing).otherwise(other).alias("owner"),
            F.col("x").alias("ball_x"),
            F.col("y").alias("ball_y"),
            (F.abs("x") * 3).alias("ball_z"),
            F.col("speed").alias("ball_speed"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self._points.where(F.col("node") < NODES - 1).select(
            "match_id",
            "period_id",
            "frame_id",
            "t_us",
            F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("player_id"),
            "x",
            "y",
            "speed",
        )

    @cached_property
    def track_events(self) -> DataFrame:
        """Events that reveal the team of a player; some players appear for both teams later."""
        vec = F.col("vec_id")
        team = F.when(vec % NODES % 2 == 0, "A").otherwise("B")
        other = F.when(vec % NODES % 2 == 0, "B").otherwise("A")
        players = self.table("embeddings").where(vec % NODES < NODES - 1)
        return players.select(
            F.concat(F.lit("G"), F.floor(vec / (NODES * 10)).cast("string")).alias("match_id"),
            F.lit(1).alias("period_id"),
            F.inline(
                F.array(
                    F.struct(
                        (vec * 2).alias("event_id"),
                        (vec * 1000).alias("t_us"),
                        team.alias("team_id"),
                        F.concat(F.lit("P"), vec.cast("string")).alias("player_id"),
                    ),
                    F.struct(
                        (vec * 2 + 1).alias("event_id"),
                        (vec * 1000 + 500_000_000).alias("t_us"),
                        F.when(vec % 7 == 0, other).otherwise(team).alias("team_id"),
                        F.when(vec % 13 != 0, F.concat(F.lit("P"), vec.cast("string"))).alias("player_id"),
                    ),
                )
            ),
        )

    @cached_property
    def track_candidates(self) -> DataFrame:
        """One turnover per episode; a few name a loss frame that does not exist."""
        episode = F.col("episode")
        frame = (episode % 10) * 100 + F.when(episode % 11 == 7, 99).otherwise(LOSS_AT)
        even = episode % 2 == 0
        return (
            self.table("embeddings")
            .where(F.col("vec_id") % NODES == NODES - 1)
            .select(F.floor(F.col("vec_id") / NODES).alias("episode"))
            .select(
                F.concat(F.lit("G"), F.floor(episode / 10).cast("string")).alias("match_id"),
                F.lit(1).alias("period_id"),
                frame.cast("bigint").alias("loss_frame"),
                ((episode % 10) * 100 + LOSS_AT).cast("bigint").alias("_at"),
                F.when(even, "A").otherwise("B").alias("losing_team"),
                F.when(even, "B").otherwise("A").alias("opponent_team"),
                (episode % 3 == 0).cast("int").alias("label_regain_5s"),
            )
            .select(
                F.concat("match_id", F.lit("_P1_F"), F.col("loss_frame").cast("string")).alias("candidate_id"),
                "match_id",
                "period_id",
                (F.col("_at") * TRACK_CFG.frame_step_us).alias("loss_t_us"),
                "loss_frame",
                "losing_team",
                "opponent_team",
                "label_regain_5s",
            )
        )

    # --- labels -------------------------------------------------------
    @cached_property
    def episodes(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.table("documents").select(
            doc_id_key().alias("candidate_id"),
            F.col("source").alias("match_id"),
            (doc % 2 + 1).cast("int").alias("period_id"),
            doc.alias("loss_frame"),
            (doc * 1_000_000).alias("loss_t_us"),
            F.when(doc % 10 == 9, "False").otherwise("True").alias("strict_valid"),
            (F.col("n_chars") % 2).cast("int").alias("label_regain_5s"),
        )

    @cached_property
    def annotations(self) -> DataFrame:
        doc = F.col("doc_id")
        labelled = F.col("quality").isNotNull()
        label = F.when((F.col("toxic") == 1) & (doc % 3 == 0), -1).otherwise(F.col("quality"))
        return (
            self.table("documents")
            .select("doc_id", "source", "lang")
            .join(self.table("labels"), "doc_id", "left")
            .select(
                doc_id_key().alias("candidate_id"),
                F.col("source").alias("match_id"),
                label.cast("int").alias("is_gegenpressing"),
                F.when(labelled, doc % 3 + 1).cast("int").alias("annotation_confidence"),
                F.when(labelled, F.when(doc % 4 == 0, " ").otherwise(F.col("lang"))).alias("annotation_notes"),
                F.when(labelled, F.concat(F.lit("r"), (doc % 2).cast("string"))).alias("annotator"),
                F.when(
                    labelled, F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
                ).alias("annotated_at_utc"),
                F.when(labelled, doc + 1).alias("annotation_order"),
                F.when(labelled & (doc % 5 == 0), "True").otherwise("False").alias("pilot_selected"),
                F.when(labelled & (doc % 5 == 0), F.floor(doc / 5) + 1).alias("pilot_order"),
            )
        )

    def borrowing(self, rows: DataFrame) -> DataFrame:
        """Rows of strict-valid documents with ``graph_id``, the episode whose graph each borrows, in turn."""
        from ..functions import ordered

        episodes = ordered.row_numbers(
            self.track_candidates.select(F.col("candidate_id").alias("graph_id"), "loss_frame"), [], ["graph_id"], ordered.time_slices("loss_frame", [1 << 40]), "_n"
        )
        count = episodes.agg(F.count(F.lit(1)).alias("_count"))
        doc = F.regexp_extract("candidate_id", r"(\d+)", 1).cast("bigint")
        docs = ordered.with_scalars(rows, count)
        return docs.withColumn("_n", F.pmod(doc, F.col("_count")) + 1).join(episodes.select("_n", "graph_id"), "_n").drop("_n", "_count")

    @cached_property
    def finished_annotations(self) -> DataFrame:
        """Every strict-valid document with a decision, a confidence, a note and a reviewer."""
        doc = F.regexp_extract("candidate_id", r"(\d+)", 1).cast("bigint")
        label = F.when(doc % 11 == 0, -1).when((doc % 3 == 0) | (doc % 7 == 0), 1).otherwise(0)
        return self.manifest.select(
            "candidate_id",
            "match_id",
            label.cast("int").alias("is_gegenpressing"),
            (doc % 3 + 1).cast("int").alias("annotation_confidence"),
            F.concat(F.lit("note "), "candidate_id").alias("annotation_notes"),
            F.concat(F.lit("r"), (doc % 2).cast("string")).alias("annotator"),
            F.lit("2024-01-01T00:00:00Z").alias("annotated_at_utc"),
            (doc + 1).alias("annotation_order"),
        )

    @staticmethod
    def split_of_source(source="match_id") -> Column:
        n = F.regexp_extract(source, r"(\d+)", 1).cast("int") % 5
        return F.when(n == 3, "validation").when(n == 4, "test").otherwise("train")

    @cached_property
    def split_table(self) -> DataFrame:
        return (
            self.table("documents")
            .select(F.col("source").alias("match_id"))
            .distinct()
            .withColumn("split", self.split_of_source())
        )

    @cached_property
    def manifest(self) -> DataFrame:
        from ..operators import labels

        return labels.model_manifest(self.episodes, self.annotations, self.split_table)

    @cached_property
    def raters(self) -> DataFrame:
        return self.table("labels").select(
            doc_id_key().alias("candidate_id"),
            F.col("quality").cast("int").alias("rater_1"),
            F.when(F.col("doc_id") % 50 == 0, -1).otherwise(1 - F.col("toxic")).cast("int").alias("rater_2"),
        )

    @cached_property
    def answer_sheets(self) -> DataFrame:
        """Sheets of at most 20 answers, as a map column keyed by candidate."""
        doc = F.col("doc_id")
        answer = F.struct(
            F.concat(F.lit("r"), (F.floor(doc / 20) % 3).cast("string")).alias("person"),
            F.col("quality").cast("int").alias("label"),
            (doc % 3 + 1).cast("int").alias("confidence"),
            F.concat(F.lit("note "), doc.cast("string")).alias("notes"),
            F.when(doc % 37 == 0, "bad").otherwise("2024-02-01T10:00:00Z").alias("utc"),
        )
        return (
            self.table("labels")
            .groupBy(F.floor(doc / 20).alias("sheet_id"))
            .agg(F.map_from_entries(F.collect_list(F.struct(doc_id_key(), answer))).alias("answers"))
            .select("sheet_id", F.when(F.col("sheet_id") % 50 == 49, "v0").otherwise("v1").alias("hash"), F.lit("second").alias("role"), "answers")
        )

    @cached_property
    def decisions(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("candidate_id"),
            F.when(F.col("role") == "system", -1).when(F.col("role") == "user", 0).otherwise(1).alias("label"),
            (F.col("turn") % 4).cast("int").alias("confidence"),
            F.col("text").alias("notes"),
            F.col("role").alias("annotator"),
            (F.col("turn") * 1_000_000 + F.when(F.col("role") == "assistant", 500_000).otherwise(0)).alias("decided_t_us"),
        )

    # --- predictions --------------------------------------------------
    @cached_property
    def scores(self) -> DataFrame:
        """Two rule-based scorers of every labelled document; scores tie often."""
        doc = F.col("doc_id")
        base = (
            self.table("labels")
            .select("doc_id", "quality")
            .join(self.table("documents").select("doc_id", "source", "n_chars"), "doc_id")
        )
        return base.select(
            F.inline(
                F.array(
                    F.struct(
                        F.lit("m1").alias("model"),
                        F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("probability"),
                    ),
                    F.struct(
                        F.lit("m2").alias("model"),
                        ((doc * 37 % 101) / F.lit(100.0)).alias("probability"),
                    ),
                )
            ),
            self.split_of_source("source").alias("split"),
            doc_id_key().alias("candidate_id"),
            F.col("source").alias("match_id"),
            F.col("quality").cast("int").alias("y_true"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        from ..operators import metrics

        return metrics.predict(self.scores, metrics.validation_threshold(self.scores))

    @cached_property
    def prediction_files(self) -> DataFrame:
        """The same predictions as files, the way several checks read them."""
        return stage(self.predictions, "predictions")

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """Node table of all candidates, written once like a graph cache."""
        from ..operators import roster, windows

        window = windows.episode_window(self.track_candidates, self.track_frames, TRACK_CFG)
        seats = roster.active_roster(self.track_candidates, self.positions, roster.player_team(self.track_events))
        return stage(roster.node_table(self.track_candidates, window, seats, self.positions), "nodes")

    @cached_property
    def graph_edges(self) -> DataFrame:
        from ..operators import graph

        return stage(graph.knn_edges(self.graph_nodes, TRACK_CFG.k_neighbors), "edges")

    @cached_property
    def feature_rows(self) -> DataFrame:
        """Rows for the classifiers: three position sums per vector, target = high label class."""
        part = lambda a, n: F.aggregate(
            F.slice("embedding", a, n), F.lit(0.0), lambda s, v: s + v.cast("double")
        )
        return self.table("embeddings").select(
            F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("candidate_id"),
            F.concat(F.lit("G"), (F.col("vec_id") % 7).cast("string")).alias("match_id"),
            F.when(F.col("vec_id") % 19 != 0, part(1, 16)).alias("f1"),
            part(17, 16).alias("f2"),
            part(33, 32).alias("f3"),
            (F.col("label") >= 5).cast("int").alias("gegenpressing_label"),
            F.when(F.col("vec_id") % 7 == 5, "validation").when(F.col("vec_id") % 7 == 6, "test").otherwise("train").alias(
                "split"
            ),
        )


__all__ = ["EVENT_CFG", "TRACK_CFG", "NODES", "LOSS_AT", "Tables"]
