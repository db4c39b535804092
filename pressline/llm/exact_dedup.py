"""Exact duplicates by content sort.

The normalised bytes are range-partitioned by sampled splitters, each partition
is sorted externally, and neighbours are compared in full. The range key ends
with the document id, so a group of copies of any size is cut over as many
partitions as it fills; runs that touch a partition's edge are joined afterwards
by their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_text, slices, staged

#: Leading bytes of a text in the range key; the rest of the order is a digest and the text itself.
PREFIX_BYTES = 32

KEYED = "doc_id long, norm binary, head binary, digest binary"
SORTED = "doc_id long, digest binary, keep_id long, group_size long, edge boolean, edge_text binary"


def _keyed(batches):
    for batch in slices(batches):
        norm = pc.ascii_lower(batch.column("text")).cast(pa.binary())
        digest = [hashlib.sha256(x.as_py()).digest() for x in norm]
        head = pc.binary_slice(norm, 0, PREFIX_BYTES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), norm, head, pa.array(digest, pa.binary())], ["doc_id", "norm", "head", "digest"])


class _Run:
    """Equal neighbours of one partition: their ids and one copy of the text."""

    def __init__(self, text: bytes, digest: bytes, first: bool):
        self.text, self.digest, self.first, self.ids = text, digest, first, []

    def rows(self, last: bool):
        ids = np.concatenate(self.ids)
        valid = ids[ids != _NONE]
        keep = int(valid.max()) if len(valid) else None
        edge = self.first or last
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=ids == _NONE),
                pa.array([self.digest] * n, pa.binary()),
                pa.array([keep] * n, pa.int64()),
                pa.array([n] * n, pa.int64()),
                pa.array([edge] * n),
                pa.array([self.text if edge and i == 0 else None for i in range(n)], pa.binary()),
            ],
            ["doc_id", "digest", "keep_id", "group_size", "edge", "edge_text"],
        )


#: Stands for a null id inside the arrays.
_NONE = np.iinfo(np.int64).min


def _neighbours(batches):
    run, first, ready, held = None, True, [], 0
    for batch in batches:
        norm = batch.column("norm")
        n = len(norm)
        if not n:
            continue
        ids = np.asarray(pc.fill_null(batch.column("doc_id"), int(_NONE)))
        starts = [0, *(np.flatnonzero(np.asarray(pc.not_equal(norm[1:], norm[:-1]))) + 1)]
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            text = norm[int(a)].as_py()
            if run is None or run.text != text:
                if run is not None:
                    ready.append(run.rows(False))
                    held += ready[-1].num_rows
                    first = False
                run = _Run(text, batch.column("digest")[int(a)].as_py(), first)
            run.ids.append(ids[a:b])
        if held >= 5000:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            ready, held = [], 0
    if run is not None:
        ready.append(run.rows(True))
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of
    a group is its keep_id. A null text counts as empty, so null and empty texts
    are one group. Rows that repeat an id and a text are counted each and kept
    once per row with that id. A null id is never kept unless its whole group has
    none (keep_id is then null and kept false). An empty table gives no rows.
    Other columns are ignored. A task holds one text and the ids of one run.
    """
    spark = docs.sparkSession
    keyed = id_text(docs).mapInArrow(_keyed, KEYED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "head", "digest", "doc_id").sortWithinPartitions("head", "digest", "norm", "doc_id")
    found = staged(ranged.select("doc_id", "norm", "digest").mapInArrow(_neighbours, SORTED), "content-sort")
    # at most two runs of a partition touch its edge, so this table is bounded by the number of partitions
    whole = (
        found.where("edge_text is not null")
        .groupBy("edge_text", "digest")
        .agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        .select("digest", "all_keep", "all_size", F.lit(True).alias("edge"))
    )
    joined = found.drop("edge_text").join(F.broadcast(whole), ["digest", "edge"], "left")
    keep, size = F.coalesce("all_keep", "keep_id"), F.coalesce("all_size", "group_size")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep; all its columns.

    Decided by id and text, so another text with the id of a dropped row stays. Of
    rows that repeat both, one stays. A row without an id can not be named by a
    result and stays.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), capitals, capitals.lower()), 256)
    found = exact_duplicates(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256"), "_rows")
    named = docs.withColumns({"_key": F.col("doc_id").cast("long"), "_digest": digest})
    kept = named.join(found, (F.col("_key") == F.col("_id")) & (F.col("_digest") == F.col("_sha256")), "left")
    kept = kept.where("_key is null or _rows is not null")
    # a row that is there once is alone in its window; a key of many rows keeps the first one read
    first = F.row_number().over(Window.partitionBy("_key", "_digest").orderBy("_rows"))
    return kept.withColumn("_first", first).where("_key is null or _first = 1").select(*docs.columns)
