"""Manifests, predictions, answer sheets, sinks and file inventories."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerce_double, coerce_int, truth
from .tracking import read_csv

ANSWER = T.StructType(
    [
        T.StructField("person", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("notes", T.StringType()),
        T.StructField("utc", T.StringType()),
    ]
)
SHEET = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("person", T.StringType()),
        T.StructField("answers", T.MapType(T.StringType(), ANSWER)),
    ]
)
# Columns of a prediction file.
PREDICTION_COLUMNS = ("model", "split", "candidate_id", "match_id", "y_true", "probability", "threshold", "y_pred")
#: Most columns of a prediction file that are looked at.
PREDICTION_WIDTH = 64
MANIFEST_INTS = ("is_gegenpressing", "annotation_confidence", "annotation_order", "pilot_order")


def scan_manifest(raw: DataFrame, ints: Sequence[str] = MANIFEST_INTS) -> DataFrame:
    """Annotation manifest with nullable integers; text that is no number becomes null."""
    return raw.withColumns({c: coerce_int(c) for c in ints if c in raw.columns})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return scan_manifest(read_csv(spark, path))


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction files of several models as one table, columns by name.

    Files may hold their columns in different orders, or lack some. One scan
    reads the lines; the header of a file is its line with the header names, a
    small table that meets the lines by file.
    """
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("_file"), F.col("value").alias("_line"))
    cells = F.from_csv("_line", ", ".join(f"c{i} string" for i in range(PREDICTION_WIDTH)))
    parsed = lines.select("_file", F.array(*[cells[f"c{i}"] for i in range(PREDICTION_WIDTH)]).alias("_cells"))
    is_header = truth(F.array_contains("_cells", "candidate_id") & F.array_contains("_cells", "model"))
    headers = parsed.where(is_header).groupBy("_file").agg(F.first("_cells").alias("_names"))
    rows = parsed.where(~is_header).join(headers, "_file")
    place = {c: F.array_position("_names", c).cast("int") for c in PREDICTION_COLUMNS}
    raw = rows.select(*[F.when(p > 0, F.nullif(F.try_element_at("_cells", p), F.lit(""))).alias(c) for c, p in place.items()])
    return raw.withColumns(
        {
            **{c: coerce_int(c) for c in ("y_true", "y_pred") if c in raw.columns},
            **{c: coerce_double(c) for c in ("probability", "threshold") if c in raw.columns},
        }
    )


def read_answer_sheets(spark: SparkSession, paths: Sequence[str], lines: bool = False) -> DataFrame:
    """Answer sheets, one per file or, with ``lines``, one per line."""
    return spark.read.option("multiLine", not lines).schema(SHEET).json(list(paths))


def write_partitioned(df: DataFrame, path: str, key: str = "match_id", order: Sequence[str] = ()) -> None:
    """Parquet partitioned by ``key``.

    Rows are range-partitioned first: one task writes few partitions, and a
    large partition is spread over several tasks when ``order`` splits it.
    """
    spread = df.repartitionByRange(key, *order)
    spread.write.option("maxRecordsPerFile", 5_000_000).partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


#: Files up to this size are hashed as one value.
WHOLE_FILE_BYTES = 16 << 20
#: The end of a name that Hadoop takes for a codec's, and a byte order mark, which its line reader drops.
SUFFIX, MARK = r"(\.[A-Za-z0-9_-]+)$", b"\xef\xbb\xbf"


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path below ``folder``, size and SHA-256 of every file; files are hashed in parallel.

    A larger file than ``WHOLE_FILE_BYTES`` is read as lines of raw bytes by one
    task, from its begin to its end, and that task holds one batch of them. The codec that
    passes bytes through is declared for the file's suffix, so Spark neither
    splits the file nor unpacks it. Only large files without a suffix are read in splits
    and their lines sorted. The distance between two line ends must stay below 2 GB.
    """

    def found(kind: str):
        return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)

    files = found("binaryFile").load(folder)
    parts = [files.where(F.col("length") <= WHOLE_FILE_BYTES).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))]
    meta = F.col("_metadata")
    large = files.where(F.col("length") > WHOLE_FILE_BYTES).select(F.regexp_extract("path", SUFFIX, 1).alias("suffix")).distinct()
    for suffix in sorted(r["suffix"] for r in large.collect()):
        source = found("text").option("lineSep", "\n")
        if suffix:
            source = source.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
            for name in ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension"):
                source = source.option(name, suffix)
        named = source.load(folder).where((meta["file_size"] > WHOLE_FILE_BYTES) & (F.regexp_extract(meta["file_path"], SUFFIX, 1) == suffix))
        line = F.concat("value", F.lit("\n")).cast("binary").alias("line")
        lines = named.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"), line, meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("number"))
        if not suffix:  # numbers rise within a split, and splits are told apart by their place in the file
            lines = lines.repartition("path").sortWithinPartitions("path", "block", "number")
        parts.append(lines.select("path", "bytes", "line").mapInArrow(_hashed_lines, "path string, bytes long, sha256 string"))
    # a path may name its store otherwise than the folder does (file:/ or file:///)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return reduce(DataFrame.unionByName, parts).withColumn("path", F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(F.col("path")))


def _hashed_lines(batches):
    """One row per file from its lines in order; a first mark and a last line end count if the size says so."""
    path, size, read, hashes = None, 0, 0, ()

    def row():
        left = size - read
        if left not in (-1, 0, len(MARK) - 1, len(MARK)):
            raise ValueError(f"read {read} of {size} bytes of {path}")
        whole = hashes[left > 0]
        if left in (0, len(MARK)):
            whole.update(b"\n")
        return pa.RecordBatch.from_pydict({"path": [unquote(path)], "bytes": [size], "sha256": [whole.hexdigest()]})

    for batch in batches:
        if not batch.num_rows:
            continue
        names, lines = batch["path"], batch["line"].cast(pa.large_binary())
        at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :]
        data = memoryview(lines.buffers()[2])
        changes = np.flatnonzero(np.asarray(pc.not_equal(names[1:], names[:-1]))) + 1
        for a, b in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            if names[a].as_py() != path:
                if path is not None:
                    yield row()
                path, size, read, hashes = names[a].as_py(), batch["bytes"][a].as_py(), 0, (hashlib.sha256(), hashlib.sha256(MARK))
            for h in hashes:
                if read:
                    h.update(b"\n")
                h.update(data[at[a] : at[b] - 1])
            read += int(at[b] - at[a])
    if path is not None:
        yield row()


def by_artifact(files: DataFrame, name: Column) -> DataFrame:
    """One row per artifact ``name`` of an inventory: bytes, and a hash over its files' paths and hashes.

    One file that is an artifact of its own keeps its hash. An artifact's list of
    files meets in one row, 64 bytes and a path for each.
    """
    size = F.sum("bytes") if "bytes" in files.columns else F.lit(None).cast("bigint")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), ","), 256)
    single = (F.count(F.lit(1)) == 1) & (F.min("path") == F.min("_name"))
    per_name = files.withColumn("_name", name).groupBy("_name").agg(size.alias("bytes"), F.when(single, F.min("sha256")).otherwise(digest).alias("sha256"))
    return per_name.withColumnRenamed("_name", "path")


def listed_hashes(manifest: DataFrame, column: str = "artifact_sha256") -> DataFrame:
    """Map column path -> hash of a run manifest to rows; paths in forward slashes."""
    return manifest.select(F.explode(column).alias("path", "sha256")).withColumn(
        "path", F.translate("path", "\\", "/")
    )
