"""Ranked lexical search with a document FP-tree and branch-and-bound.

One pass over the documents counts terms and keeps, for each document, its vector
restricted to the items' terms. After the counts have given every term its weight,
a task takes its vectors in chunks and restricts them once more, to the terms of
one item, ordered from frequent to rare. Sorted by these vectors, documents that
share a path of terms lie side by side: a node of the tree is a range of them, its
children begin where the next term changes. The largest frequency of each term and
the smallest length factor below a node bound every score there, since a score
rises with the one and falls with the other. The search goes depth first, best
bound first, and leaves out what cannot reach the item's best documents so far.

Scores are 64-bit integers and exact; only the weights use a logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_text, slices, staged

#: Fixed value: what separates terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a tree.
CHUNK_DOCUMENTS = 1 << 14
#: A node of so few documents is scored at once.
LEAF_DOCUMENTS = 24
#: Characters of items that one pass over the documents serves.
BLOCK_CHARS = 8_000_000
#: Parts that the tasks' results are reduced in before the last step.
PARTS = 32

VECTORS = "doc_id long, n_terms long, terms binary, counts binary, df binary, documents long, tokens long"


def split_terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of all rows, A-Z lower-cased: codes, row offsets, dictionary."""
    plain = pc.replace_substring_regex(pc.ascii_lower(text), pattern=SEPARATORS, replacement=" ")
    lists = pc.split_pattern(plain, " ")
    keep = np.asarray(pc.greater(pc.binary_length(lists.values), 0))
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = lists.values.filter(pa.array(keep)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), before[np.asarray(lists.offsets)], coded.dictionary


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row per document with terms of the vocabulary, and one with the task's counts."""
    names = [c.split()[0] for c in VECTORS.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in VECTORS.split(", ")]
    df, documents, tokens = np.zeros(len(vocabulary), np.int64), 0, 0
    for batch in slices(batches):
        codes, offsets, dictionary = split_terms(batch.column("text"))
        sizes = np.diff(offsets)
        documents, tokens = documents + int((sizes > 0).sum()), tokens + int(sizes.sum())
        known = np.asarray(pc.fill_null(pc.index_in(dictionary, vocabulary), -1)).astype(np.int64)
        term = known[codes] if len(codes) else codes
        own = term >= 0
        key = np.repeat(np.arange(len(sizes)), sizes)[own] * max(len(vocabulary), 1) + term[own]
        key, count = np.unique(key, return_counts=True)
        row, term = np.divmod(key, max(len(vocabulary), 1))
        df += np.bincount(term, minlength=len(vocabulary))
        cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
        found = np.flatnonzero(np.diff(cuts))
        term, count = term.astype("<u4"), count.astype("<u4")
        packed = [(term[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts[found], cuts[found + 1], strict=True)]
        none = [None] * len(found)
        columns = [batch.column("doc_id").take(pa.array(found)), pa.array(sizes[found]), [t for t, _ in packed], [c for _, c in packed], none, none, none]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    last = [None, None, None, None, df.tobytes(), documents, tokens]
    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds, strict=True)], names)


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]

    def reachable(self, bound: int, least_doc: int) -> bool:
        """Whether a document with at most this score and at least this id could enter."""
        if bound <= 0:
            return False
        return len(self.doc) < self.k or (bound, -least_doc) > (int(self.score[-1]), -int(self.doc[-1]))


class Tree:
    """Documents in the order of their vectors over one item's terms, frequent terms first.

    Vectors with an earlier term come before those without it. Nodes are ranges.
    """

    def __init__(self, weight: np.ndarray, tf: np.ndarray, m: np.ndarray, doc: np.ndarray):
        present = tf > 0
        bits = np.packbits(present, axis=0)
        order = np.lexsort(bits[::-1])[::-1]
        self.weight, self.m, self.doc = weight[:, None], m[order], doc[order]
        self.tf, self.present = tf[:, order], present[:, order]

    def score(self, tf: np.ndarray, m) -> np.ndarray:
        return (self.weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))).sum(axis=0)

    def nodes(self, low: int, cuts: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray]:
        """What no document of each node scores above, and the least id in it; nodes begin at ``cuts`` after ``low``."""
        most = np.maximum.reduceat(self.tf[:, low:high], cuts, axis=1)
        return self.score(most, np.minimum.reduceat(self.m[low:high], cuts)), np.minimum.reduceat(self.doc[low:high], cuts)

    def search(self, best: Best) -> int:
        """Bring ``best`` up to date; returns the number of nodes visited."""
        (bound,), (least,) = self.nodes(0, np.zeros(1, np.int64), len(self.doc))
        stack, visited = [(int(bound), int(least), 0, len(self.doc), -1)], 0
        while stack:
            bound, least, low, high, term = stack.pop()
            if not best.reachable(bound, least):
                continue
            visited += 1
            if high - low <= LEAF_DOCUMENTS or term + 1 >= len(self.weight):
                score = self.score(self.tf[:, low:high], self.m[low:high])
                best.add(score[score > 0], self.doc[low:high][score > 0])
                continue
            # subtrees begin where the next term changes; documents whose path ends here come last
            part = self.present[term + 1 :, low:high]
            first = np.where(part.any(axis=0), part.argmax(axis=0), len(part))
            cuts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
            bounds, leasts = self.nodes(low, cuts, high)
            ends = np.append(cuts[1:], high - low) + low
            order = np.argsort(bounds, kind="stable")
            found = zip(bounds[order].tolist(), leasts[order].tolist(), (cuts[order] + low).tolist(), ends[order].tolist(), (first[cuts[order]] + term + 1).tolist(), strict=True)
            stack += [node for node in found if best.reachable(node[0], node[1])]
        return visited


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Scores and terms are as in the module's description: a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))) and adds that times (10^9 tf) div
    (1000 tf + 12 m), m = 75 + (25 n N) div L, once for each time the item holds
    it. Only scores above 0 count; equal ones go by ascending doc_id. Null and
    empty texts have no terms; such items have no rows, and documents without an
    id are counted but never returned. A repeated document can be returned as
    often as it is there; a repeated item is answered each, one with a null id
    under null. Empty tables give no rows; other columns are ignored.

    The items' terms, bounded by ``BLOCK_CHARS``, go to every task, and one count
    per such term to the driver; each further block of items costs another pass.
    """
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    out = None
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = _search_block(docs, [(r["item_id"], r["text"]) for r in rows], k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    spark = docs.sparkSession
    codes, offsets, vocabulary = split_terms(pa.array([t for _, t in items], pa.string()))
    shared = spark.sparkContext.broadcast(vocabulary)
    read = staged(id_text(docs).mapInArrow(lambda batches: _vectors(batches, shared.value), VECTORS), "term-vectors")
    df, documents, tokens = np.zeros(len(vocabulary), np.int64), 0, 0
    for row in read.where("df is not null").select("df", "documents", "tokens").toLocalIterator():
        df += np.frombuffer(bytes(row["df"]), np.int64)
        documents, tokens = documents + row["documents"], tokens + row["tokens"]
    weights = np.array([term_weight(documents, int(n)) for n in df], np.int64)
    order = np.lexsort((np.arange(len(df)), -df))
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    wanted = []  # per item: its terms from frequent to rare, with their weight times their repeats
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        term, repeats = np.unique(codes[a:b], return_counts=True)
        term, repeats = term[np.argsort(place[term])], repeats[np.argsort(place[term])]
        wanted.append((term, repeats * weights[term]))
    plan = spark.sparkContext.broadcast(wanted)
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in plan.value]
        for doc, n, term, count, lengths in _chunks(batches):
            m = 75 + (25 * n * documents) // max(tokens, 1)
            owner = np.repeat(np.arange(len(doc)), lengths)
            by_term = np.argsort(term, kind="stable")
            begin = np.searchsorted(term[by_term], np.arange(size + 1))
            owner, count = owner[by_term], count[by_term]
            for top, (terms, weight) in zip(best, plan.value, strict=True):
                parts = [(owner[begin[t] : begin[t + 1]], count[begin[t] : begin[t + 1]]) for t in terms]
                having = np.zeros(len(doc), bool)
                for o, _ in parts:
                    having[o] = True
                rows = np.flatnonzero(having)
                if not len(rows):
                    continue
                at = np.cumsum(having) - 1
                tf = np.zeros((len(terms), len(rows)), np.int64)
                for line, (o, c) in zip(tf, parts, strict=True):
                    line[at[o]] = c
                Tree(weight, tf, m[rows], doc[rows]).search(top)
        item = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        if len(item):
            part = pa.array(np.full(len(item), TaskContext.get().partitionId() % PARTS, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(item), part, pa.array(np.concatenate([b.doc for b in best])), pa.array(np.concatenate([b.score for b in best]))], ["item", "part", "doc_id", "score"])

    local = read.where("terms is not null and doc_id is not null").select("doc_id", "n_terms", "terms", "counts")
    found = local.mapInArrow(run, "item long, part int, doc_id long, score long")
    # a task gives k rows an item at most; parts of the tasks are reduced before the last step
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k)
    ids = {i: item for i, (item, _) in enumerate(items)}
    if not ids:
        return found.select(F.lit(None).cast("long").alias("item_id"), "rank", "doc_id", "score")
    names = spark.createDataFrame(list(ids.items()), "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, lengths and restricted vectors of up to ``CHUNK_DOCUMENTS`` documents: the entries one after the other."""
    held, rows = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK_DOCUMENTS):
            part = batch.slice(a, CHUNK_DOCUMENTS)
            if rows and rows + part.num_rows > CHUNK_DOCUMENTS:
                yield _joined(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(batches)
    flat = lambda name: np.frombuffer(b"".join(table[name].to_pylist()), "<u4").astype(np.int64)
    lengths = np.asarray(pc.binary_length(table["terms"])).astype(np.int64) // 4
    return np.asarray(table["doc_id"]), np.asarray(table["n_terms"]), flat("terms"), flat("counts"), lengths
