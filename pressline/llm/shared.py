"""Helpers of the text operators: words and shingles as arrays, hash blocks, staging, components.

Word work runs on Arrow batches inside tasks. Where a table of all n-grams must
be shuffled, a task sends *blocks*: one row per (slice of documents, hash range)
holding packed arrays, so a shuffle of many million small rows becomes one of a
few thousand byte strings. A block key is a range of 64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

#: Fixed value: seed of every word hash, so that tasks agree.
HASH_KEY = "pressline-words0"
#: Text bytes that a task turns into arrays at a time.
SLICE_BYTES = 8 << 20
#: Most rows of a slice, so that 16 bits number them.
SLICE_ROWS = 1 << 16
#: Odd multipliers of the shingle hash.
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back and let go of the shuffle files behind it."""
    out = stage(df, name)
    let_go(df.sparkSession)
    return out


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no table needs any more; those of the last query may stay until another has run."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def release(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remainder(key: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def id_text(docs: DataFrame) -> DataFrame:
    """Id and text alone, a null text as empty: extra columns never meet an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def text_hash(column: str):
    """Tells texts of one id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by ``doc_id`` and ``text_hash``; rows without an id stay."""
    names = gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(names, (F.col("doc_id").cast("long") == F.col("_gone")) & (text_hash("text") == F.col("_hash")), "left_anti")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(length) // size + np.arange(len(length)) // SLICE_ROWS * (1 << 40)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^ \\t-\\r]+`` after lower-casing A-Z: codes of all rows, row offsets, dictionary."""
    plain = pc.replace_substring_regex(pc.ascii_lower(text), pattern="[\t-\r]", replacement=" ")
    lists = pc.split_pattern(plain, " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), before[offsets], coded.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    if not len(dictionary):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(dictionary.to_numpy(zero_copy_only=False), hash_key=HASH_KEY, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums (xor-shift and multiply, twice)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mix(out + words[i : i + size] * np.uint64(MULTIPLIERS[i % 5]))
    return out


def shingle_sets(text: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter text is one shingle, an empty one has none."""
    codes, offsets, dictionary = split_words(text)
    words = word_hashes(dictionary)[codes]
    grams = gram_hashes(words, n)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield gram_hashes(words[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal hash ranges begins in sorted 64-bit ``keys``; one entry more."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def by_bucket(batches: Iterator[pa.RecordBatch], reduce: Callable[[list[dict]], Iterator]) -> Iterator:
    """Hand the rows of each bucket, which arrive together, to ``reduce``."""
    held: list[dict] = []
    for row in rows_of(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield from reduce(held)
            held = []
        held.append(row)
    if held:
        yield from reduce(held)


def dealt(df: DataFrame, buckets: int, *then) -> DataFrame:
    """Blocks of a bucket into one partition, next to each other."""
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", *then)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): one node of all that each node of ``links`` reaches.

    Contracts edges until none is left: every node points to its smallest
    neighbour, if that is smaller, and pointers are followed once more; edges
    then join what their ends point to. A round is a few joins of edge-sized
    tables and writes the remaining edges to the shared folder. With node
    numbers in random order, such as hashes, a round leaves a fraction of the
    nodes, and a star of any size one.
    """
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    steps = [_pointers(edges)]
    while True:
        to = lambda end, step=steps[-1]: step.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        moved = edges.join(to("u"), "u").join(to("v"), "v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v"))
        edges = staged(moved.where("u <> v").distinct(), "edges")
        if edges.isEmpty():
            break
        steps.append(_pointers(edges))
    out = steps[0].withColumnRenamed("to", "component")
    for step in steps[1:]:
        out = out.join(step.withColumnRenamed("node", "component"), "component", "left")
        out = out.select("node", F.coalesce("to", "component").alias("component"))
    return out


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, to) of every node of ``edges``, two steps down."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to"))
    return least.join(least.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
