"""Scans of raw match files and tables; typed projections instead of schema inference."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import coerce_double, coerce_int, elapsed_us, strict_bool, truth
from ..session import stage

FRAME_COLUMNS = {
    "ball_state": "ball_state",
    "ball_owning_team_id": "owner",
}
BALL = ("ball_x", "ball_y", "ball_z", "ball_speed")


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All columns as text; a missing file is reported as such."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        return spark.read.option("header", True).csv(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"match files incomplete: {paths}") from error
        raise


def player_columns(columns: Sequence[str], prefix: str = "DFL-OBJ-") -> dict[str, dict[str, str]]:
    """Player id -> {x, y, s: column} from the column names of a wide table."""
    found: dict[str, dict[str, str]] = {}
    for name in columns:
        hit = re.fullmatch(rf"({re.escape(prefix)}.+)_([xys])", name)
        if hit:
            found.setdefault(hit[1], {})[hit[2]] = name
    return {player: parts for player, parts in sorted(found.items()) if {"x", "y"} <= parts.keys()}


def typed_frames(wide: DataFrame, match_id: str | None = None) -> DataFrame:
    """Ball and possession part of a wide tracking table."""
    key = [F.lit(match_id).alias("match_id")] if match_id else [F.col("match_id")]
    return wide.select(
        *key,
        coerce_int("period_id").alias("period_id"),
        F.col("frame_id").try_cast("bigint").alias("frame_id"),
        elapsed_us("timestamp").alias("t_us"),
        *[F.col(a).alias(b) for a, b in FRAME_COLUMNS.items()],
        *[coerce_double(c).alias(c) for c in BALL],
    )


def unpivot_tracks(wide: DataFrame, match_id: str | None = None, prefix: str = "DFL-OBJ-") -> DataFrame:
    """Player columns to one row per (frame, player); rows without any value are dropped.

    The struct array is built and flattened inside the row: no shuffle.
    """
    key = [F.lit(match_id).alias("match_id")] if match_id else [F.col("match_id")]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(player).alias("player_id"),
            coerce_double(F.col(f"`{parts['x']}`")).alias("x"),
            coerce_double(F.col(f"`{parts['y']}`")).alias("y"),
            (coerce_double(F.col(f"`{parts['s']}`")) if "s" in parts else none).alias("speed"),
        )
        for player, parts in player_columns(wide.columns, prefix).items()
    ]
    if not rows:
        raise ValueError("no player columns")
    long = wide.select(
        *key,
        coerce_int("period_id").alias("period_id"),
        F.col("frame_id").try_cast("bigint").alias("frame_id"),
        elapsed_us("timestamp").alias("t_us"),
        F.inline(F.array(*rows)),
    )
    return long.where(F.coalesce("x", "y", "speed").isNotNull())


def typed_events(raw: DataFrame, match_id: str | None = None) -> DataFrame:
    """Event table with elapsed times (negative ones stay) and a nullable success flag."""
    key = [F.lit(match_id).alias("match_id")] if match_id else [F.col("match_id")]
    text = ["event_type", "team_id", "player_id", "receiver_player_id"]
    return raw.select(
        *key,
        coerce_int("period_id").alias("period_id"),
        elapsed_us("timestamp").alias("t_us"),
        F.col("event_id").try_cast("bigint").alias("event_id"),
        *text,
        F.when(F.col("success").isNotNull(), strict_bool("success")).alias("success"),
    )


def load_match(spark: SparkSession, folder: str, match_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, player positions and events of one match."""
    wide = read_csv(spark, f"{folder}/{match_id}_tracking.csv")
    events = read_csv(spark, f"{folder}/{match_id}_events.csv")
    return typed_frames(wide, match_id), unpivot_tracks(wide, match_id), typed_events(events, match_id)


def union_matches(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_matches(spark: SparkSession, folder: str, match_ids: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All matches as one plan; column sets differ per match, so each is unpivoted first."""
    loaded = [load_match(spark, folder, m) for m in match_ids]
    frames, positions, events = (union_matches(side) for side in zip(*loaded))
    return frames, positions, events


def _cells(line: str = "_line"):
    """Cells of a line of comma-separated text; quoted cells may hold commas and doubled quotes."""
    c = F.regexp_replace(line, "^\ufeff", "")
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1),
        lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')).otherwise(x),
    )
    return F.when(c.contains('"'), quoted).otherwise(F.split(c, ",", -1))


def _by_header(spark: SparkSession, folder: str, pattern: str, match: str, known: str, places) -> DataFrame:
    """Lines of all files of a folder, each with match_id and what ``places`` reads from its file's header.

    A header is the line that names ``period_id`` and ``known``. Headers are one
    row per file, written as a table, so Spark knows the table's size when it
    joins it to the lines: the plan is the same for any number of files.
    """
    source = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    meta = F.col("_metadata")
    lines = source.text(folder).select(meta["file_path"].alias("_file"), F.col("value").alias("_line")).where(F.trim("_line") != "")
    parsed = lines.select("_file", _cells().alias("_cells"))
    is_header = truth(F.array_contains("_cells", "period_id") & F.array_contains("_cells", known))
    headers = parsed.where(is_header).groupBy("_file").agg(F.first("_cells").alias("_names"))
    headers = stage(headers.select("_file", F.regexp_extract("_file", match, 1).alias("match_id"), *places("_names")), "headers")
    rows = parsed.where(~is_header).join(headers, "_file", "left")
    named = F.when(F.col("match_id").isNotNull(), F.col("match_id")).otherwise(F.raise_error(F.concat(F.lit("file without header: "), "_file")))
    return rows.withColumn("match_id", named)


def _cell(place):
    """The cell at a place counted from 1; empty text and a missing place are null."""
    return F.when(place > 0, F.nullif(F.try_element_at("_cells", place), F.lit("")))


def _columns(names: Sequence[str]):
    return lambda header: [F.array_position(header, c).cast("int").alias(f"_at_{c}") for c in names]


def _players(header: str, prefix: str):
    """(player_id, place of x, y and speed) of the players that a header names with x and y."""
    of = F.array_distinct(F.filter(F.transform(header, lambda c: F.regexp_extract(c, f"^({re.escape(prefix)}.+)_[xys]$", 1)), lambda c: c != ""))
    place = lambda p, part: F.array_position(header, F.concat(p, F.lit(part))).cast("int")
    found = F.transform(of, lambda p: F.struct(p.alias("player_id"), place(p, "_x").alias("x"), place(p, "_y").alias("y"), place(p, "_s").alias("speed")))
    return F.filter(found, lambda p: (p["x"] > 0) & (p["y"] > 0)).alias("_players")


#: Columns of an event file.
EVENT_COLUMNS = ("period_id", "timestamp", "event_id", "event_type", "team_id", "player_id", "receiver_player_id", "success")


def load_folder(
    spark: SparkSession,
    folder: str,
    match_ids: Sequence[str] | None = None,
    tracking: str = "*_tracking.csv",
    events: str = "*_events.csv",
    match: str = r"([^/]+)_(?:tracking|events)\.csv$",
    prefix: str = "DFL-OBJ-",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, player positions and events of every match of a folder, or of ``match_ids``.

    Files differ in their columns. They are read as lines, split by position
    and cut by the places that each file's header gives; the number of matches
    does not change the plan. A cell must not hold a line end. A missing file of
    a listed match is an error, as is a tracking file without player columns.
    """
    names = ["period_id", "timestamp", "frame_id", *FRAME_COLUMNS, *BALL]
    wide = _by_header(spark, folder, tracking, match, "frame_id", lambda h: [*_columns(names)(h), _players(h, prefix)])
    raw = _by_header(spark, folder, events, match, "event_id", _columns(EVENT_COLUMNS))
    if match_ids is not None:
        wanted = sorted(set(match_ids))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        for pattern in (tracking, events):
            there = files.option("pathGlobFilter", pattern).load(folder).select(F.regexp_extract("path", match, 1).alias("match_id"))
            missing = spark.createDataFrame([(m,) for m in wanted], "match_id string").join(there, "match_id", "left_anti").take(5)
            if missing:
                raise FileNotFoundError(f"match files incomplete: {[r['match_id'] for r in missing]}")
        wide, raw = wide.where(F.col("match_id").isin(wanted)), raw.where(F.col("match_id").isin(wanted))
    cells = wide.select("match_id", "_cells", "_players", *[_cell(F.col(f"_at_{c}")).alias(c) for c in names])
    none = F.lit(None).cast("double")
    number = lambda p: F.when(p > 0, coerce_double(F.try_element_at("_cells", p))).otherwise(none)
    listed = F.when(F.size("_players") > 0, F.col("_players")).otherwise(F.raise_error(F.concat(F.lit("no player columns: "), "match_id")))
    rows = F.transform(listed, lambda p: F.struct(p["player_id"].alias("player_id"), number(p["x"]).alias("x"), number(p["y"]).alias("y"), number(p["speed"]).alias("speed")))
    positions = cells.select(
        "match_id",
        coerce_int("period_id").alias("period_id"),
        F.col("frame_id").try_cast("bigint").alias("frame_id"),
        elapsed_us("timestamp").alias("t_us"),
        F.inline(rows),
    ).where(F.coalesce("x", "y", "speed").isNotNull())
    happened = raw.select("match_id", *[_cell(F.col(f"_at_{c}")).alias(c) for c in EVENT_COLUMNS])
    return typed_frames(cells), positions, typed_events(happened)
