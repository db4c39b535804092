"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the similarity of whole signatures says
little. Items are therefore partitioned by size; for each partition a document
is read as overlapping windows of twice the partition's upper size, and a
window's one-permutation MinHash signature is matched with those of the items,
bin by bin. Any equal bin makes a candidate; candidates are verified by exact
containment of the item's shingles in the whole document.

The documents are read once for each block of items, without a shuffle. A block
is bounded, and so is what is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lang_id import letter_runs
from .shared import gram_hashes, id_text, slices, text_hash, without, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.75
#: Signature bins for each shingle of a window: many, so that a shared shingle is rarely hidden.
BINS_PER_SHINGLE = 4
#: Size classes up to this many shingles match every shingle of a document instead of bins of windows.
EVERY_SHINGLE = 3
#: Characters of items that one pass over the documents searches for.
BLOCK_CHARS = 16 << 20


def item_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and row offsets; words are lower-case runs of letters and digits."""
    codes, offsets, words = letter_runs(text, r"\p{L}\p{N}")
    return word_hashes(words)[codes], np.asarray(offsets).astype(np.int64)


def signature(grams: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty bins of a one-permutation MinHash and their least values."""
    ranked = np.sort(grams)
    bin_of = (ranked % np.uint64(bins)).astype(np.int64)
    first = np.unique(bin_of, return_index=True)
    return first[0], ranked[first[1]]


@dataclass
class Partition:
    """Items of one size class and shingle length: bin keys sorted, and the item of each."""

    shingle: int
    upper: int
    keys: np.ndarray
    owner: np.ndarray

    @property
    def window(self) -> int:
        return 2 * self.upper

    @property
    def bins(self) -> int:
        return BINS_PER_SHINGLE * self.window

    def candidates(self, grams: np.ndarray) -> set[int]:
        """Items that share a bin's least value with a window of the document's shingles."""
        if not len(grams) or not len(self.keys):
            return set()
        step, bins = self.upper, np.uint64(self.bins)
        if step <= EVERY_SHINGLE:
            # a neighbour's value could hide an only shingle from its bin: all shingles are looked up
            a, b = (np.searchsorted(self.keys, np.unique(grams), side) for side in ("left", "right"))
            return {int(i) for x, y in zip(a[a < b], b[a < b], strict=True) for i in self.owner[x:y]}
        # window j covers blocks j and j + 1 of ``step`` shingles: every run of up to ``step`` lies in one
        block = np.arange(len(grams)) // step
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        known = self.keys[at] == grams
        if not known.any():
            return set()
        # only bins that hold an item's value in that window can match: compare their least values
        windows = np.unique(np.concatenate([block[known], block[known] - 1]))
        found: set[int] = set()
        for w in windows[windows >= 0] if len(grams) > step else np.zeros(1, np.int64):
            _, least = signature(grams[w * step : (w + 2) * step], int(bins))
            a, b = np.searchsorted(self.keys, least), np.searchsorted(self.keys, least, side="right")
            for i, j in zip(a[a < b], b[a < b], strict=True):
                found.update(self.owner[i:j].tolist())
        return found


@dataclass
class Items:
    """A block of items: size partitions and the exact shingle set of each item."""

    ids: list
    sets: list[np.ndarray]
    partitions: list[Partition]

    @staticmethod
    def build(ids: list, texts: list[str], n: int) -> Items:
        words, offsets = item_words(pa.array(texts, pa.string()))
        sets, sizes = [], defaultdict(list)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            length = int(min(n, b - a))
            sets.append(np.unique(gram_hashes(words[a:b], length)) if length else np.zeros(0, np.uint64))
            if length:
                sizes[length, int(b - a - length + 1).bit_length()].append(i)
        parts = []
        for (length, bits), members in sorted(sizes.items()):
            upper = (1 << bits) - 1
            keys, owner = [], []
            for i in members:
                _, least = signature(sets[i], BINS_PER_SHINGLE * 2 * upper)
                keys.append(least)
                owner.append(np.full(len(least), i))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            parts.append(Partition(length, upper, keys[order], owner[order]))
        return Items(ids, sets, parts)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, item_shingles, shared, containment) of documents that contain an item.

    Contained means: at least ``threshold`` of the item's distinct ``n``-word
    shingles are in the whole document. An item of fewer words is one shingle of
    that length. Null, empty and wordless texts match nothing. Items with equal
    texts are reported each; a repeated row gives repeated results, and
    ``text_hash`` tells texts of one id apart. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    # dealt to blocks by a hash; each block is bounded and the loop covers all of them
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    source = id_text(docs).withColumn("text_hash", text_hash("text"))
    out = None
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(cloudpickle.dumps(Items.build([r["item_id"] for r in rows], [r["text"] for r in rows], n)))

        def search(batches, block=block):
            items = cloudpickle.loads(block.value)
            lengths = sorted({p.shingle for p in items.partitions})
            for batch in slices(batches):
                words, offsets = item_words(batch.column("text"))
                grams = {length: gram_hashes(words, length) for length in lengths}
                found = []
                for doc, mark, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    for length in lengths:
                        own = grams[length][a : max(a, b - length + 1)]
                        likely = set().union(*[p.candidates(own) for p in items.partitions if p.shingle == length])
                        for i in sorted(likely):
                            shared = int(np.isin(items.sets[i], own).sum())
                            if shared >= threshold * len(items.sets[i]):
                                found.append((doc, mark, items.ids[i], len(items.sets[i]), shared, shared / len(items.sets[i])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["doc_id", "text_hash", "item_id", "item_shingles", "shared", "containment"])

        hits = source.mapInArrow(search, "doc_id long, text_hash long, item_id long, item_shingles long, shared long, containment double")
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all its columns.

    A row without an id can not be named by a result and stays.
    """
    return without(docs, leaks(docs, items))
