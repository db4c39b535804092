"""Packing of token sequences by multiway number partitioning (Karmarkar-Karp).

Documents are cut into pieces and gathered, in the order a task reads them, into
groups of ``GROUP_WINDOWS`` windows. Within a group the largest differencing
method merges partial partitions with opposing imbalances until one partition
with near-equal windows is left; if a window exceeds the capacity, the group is
partitioned again into more windows. Groups are independent, so no shuffle is
needed and a task holds one group.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import id_text, slices

CAPACITY = 4096
#: Token that ends a document.
END_ID = 2
GROUP_WINDOWS = 64
#: Longest piece; short ones let the windows of a group come out near-equal.
PIECE_TOKENS = 1024
#: Tokens that a group leaves free in each window, for the windows' inequality.
SLACK = 2
#: Chunks of text whose ids a Python worker remembers.
MEMORY_CHUNKS = 800_000

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` sets of indices of ``sizes`` with near-equal sums.

    A partial partition is k sums in descending order with their sets. The two
    with the largest difference between first and last sum are merged, the
    largest set of one with the smallest of the other.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # empty sets are left out
    heapq.heapify(heap)
    while len(heap) > 1:
        a, (_, tag, b) = heapq.heappop(heap)[2], heapq.heappop(heap)
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            a, b = (x + [(0, [])] * (k - len(x)) for x in (a, b))
            merged = [(s + t, x + y) for (s, x), (t, y) in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda p: (-p[0], p[1]))
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tag, merged))
    sets = [x for _, x in heap[0][2]] if heap else []
    return sets + [[] for _ in range(k - len(sets))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sets of indices whose sizes fit ``capacity`` each; no size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        k += 1


class Encoder:
    """Ids of whole texts, by way of their distinct chunks between white space.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its chunks. Chunks without ids of their own yet are
    encoded as one line; where the ends of words do not add up, one by one.
    """

    #: What the tokenizer splits chunks by; fixed values.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    #: Characters from here on may change their number or their parts when composed or lower-cased.
    PLAIN_END = "\u0250"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memory: dict[str, bytes] = {}

    def _alone(self, chunks: list[str]):
        for chunk, found in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
            self.memory[chunk] = np.array(found.ids, np.uint32).tobytes()

    def _parts(self, chunk: str) -> int:
        return 1 if chunk.isalpha() else len(self.PARTS.findall(chunk.lower()))

    def learn(self, chunks: list[str]):
        plain = [c for c in chunks if c.isascii() and "<" not in c or max(c) < self.PLAIN_END and "<|" not in c and "\u0130" not in c]
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            words = np.cumsum([self._parts(c) for c in part])
            if len(ends) != words[-1] or (len(ends) and ends[-1] != len(ids)):
                self._alone(part)
                continue
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], words])]
            for c, i, j in zip(part, cuts[:-1], cuts[1:], strict=True):
                self.memory[c] = ids[i:j].tobytes()
        self._alone([c for c in chunks if c not in self.memory])

    def encode(self, text: pa.Array) -> Iterator[np.ndarray]:
        # the tokenizer lower-cases, except in its special tokens, which are in lower case only; and it always
        # splits between a letter and a stop or comma, but for U+0130, whose lower case ends in a mark
        lowered = pc.if_else(pc.match_substring(text, "<|"), text, pc.ascii_lower(text))
        plain = pc.replace_substring_regex(lowered, pattern=r"([^\P{L}\x{0130}])([.,])", replacement=r"\1 \2")
        lists = pc.split_pattern(pc.replace_substring_regex(plain, pattern="[\t-\r]", replacement=" "), " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        fresh = [c for c in chunks if c not in self.memory]
        if len(self.memory) + len(fresh) > MEMORY_CHUNKS:
            self.memory, fresh = {}, chunks
        self.learn(fresh)
        known = [self.memory[c] for c in chunks]
        pool = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            c = codes[a:b]
            n = size[c]
            at = np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pool[at]


def pack(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int = END_ID, capacity: int = CAPACITY, piece: int = PIECE_TOKENS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Every id of every document is in exactly one piece. Null and empty texts are
    the end id alone. Repeated rows are packed each. Neighbouring pieces of one
    document in one sequence are joined to one. An empty table gives no rows;
    other columns are ignored. ``encoder`` is called once in each task.
    """

    def run(batches):
        coder, part, made = encoder(), TaskContext.get().partitionId(), 0
        group: list[tuple[int | None, int, int, np.ndarray]] = []
        held = 0
        most = GROUP_WINDOWS * (capacity - SLACK)

        def flush():
            nonlocal group, held, made
            rows = []
            for window in windows([len(p[3]) for p in group], capacity):
                pieces = []
                for i in sorted(window):
                    doc, start, total, ids = group[i]
                    if pieces and pieces[-1][4] == i - 1 and pieces[-1][1] + len(pieces[-1][3]) == start and start:
                        pieces[-1] = (doc, pieces[-1][1], total, np.concatenate([pieces[-1][3], ids]), i)
                    else:
                        pieces.append((doc, start, total, ids, i))
                at, size = 0, sum(len(p[3]) for p in pieces)
                for doc, start, total, ids, _ in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (part << 32) + made, at, size))
                    at += len(ids)
                made += 1
            group, held = [], 0
            names = [c.split()[0] for c in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                start = 0
                while start < len(ids):
                    take = min(piece, len(ids) - start, most - held)
                    group.append((doc, start, len(ids), ids[start : start + take]))
                    start, held = start + take, held + take
                    if held == most:
                        yield flush()
        if group:
            yield flush()

    return id_text(docs).mapInArrow(run, PACKED)
