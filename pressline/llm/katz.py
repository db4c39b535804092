"""Language-model scores by Katz backoff over bigrams.

Good-Turing discounts take probability from seen n-grams; what they free goes to
the next lower order by a backoff weight per history, so that every history's
distribution sums to one. Counts are made by hash blocks and kept as tables; a
token's probability backs off from bigram to unigram to the unknown word.

Words are counted first. Those with more than ``FREQUENT_SHARE`` of all tokens get
a number, known to every task; bigrams then travel as packed blocks of numbers, by
history. Such a block holds all bigrams of its histories, so a history's count and
backoff weight come from the block itself; only bigrams that end in a rare word meet
the word's count in a join.

With p(w | h) = p(w) a(h) for bigrams that the model does not hold, a text's log
probability is a sum over its words of log p(w) + log a(w), plus a gain for each
bigram that the model holds. Both are looked up in one exchange: texts send each
slice's distinct bigrams once, by history, with the rows that use them. The few
histories with a large share of all tokens are spread by their bigrams instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MULTIPLIERS, bucket_cuts, by_bucket, id_text, let_go, mix, remainder, runs, slices, split_words, staged, word_hashes

#: Keys of the end token and of the history before the first word.
END, BEGIN = np.uint64(1), np.uint64(2)
#: Counts above this are not discounted.
TRUSTED = 5
#: Distinct keys of a count block, and tokens of a look-up block, on average.
COUNT_KEYS, LOOKUP_KEYS = 1_000_000, 4_000_000

#: Histories with more than this share of all tokens are spread by their bigrams: at most 1 / HOT_SHARE.
HOT_SHARE = 0.001
#: Words with more than this share of all tokens have a number: at most 1 / FREQUENT_SHARE (500,000) of them.
FREQUENT_SHARE = 2e-6
#: Text bytes whose bigrams a task sorts at a time.
TEXT_BYTES = 4 << 20
#: Bytes of blocks that a look-up turns into Python objects at a time.
PIECE_BYTES = 2 << 20
#: Most bytes of an Arrow batch that Spark hands to a task's Python; a little below 4 * TEXT_BYTES, so that no small slice is left over.
BATCH_BYTES = 15 << 20
#: Fixed value: stands for a word without number.
RARE = np.uint32(0xFFFFFFFF)

#: Blocks of bigrams by history, those of hot histories, and documents.
COLD, HOT, DOCUMENTS = range(3)
PAIRS = "h binary, sizes binary, code binary, rare binary"
WORD_COUNTS = "bucket int, w binary, n binary"
COUNTS = f"bucket int, kind int, {PAIRS}, n binary"
GRAMS = "h long, code int, w long, n long"
BLOCKS = f"bucket int, model boolean, kind int, slice long, {PAIRS}, n binary, n_low binary, uses binary, row binary, gain binary, base binary, known binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>"
SUMS = "kind int, slice long, row binary, gain binary, base binary, known binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>"


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(MULTIPLIERS[0]) + mix(w * np.uint64(MULTIPLIERS[1])))


def _pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small ones take little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


@dataclass
class Vocabulary:
    """Frequent words by number, most frequent first, and the hot histories among them; of bounded size."""

    keys: np.ndarray  # sorted
    number: np.ndarray  # of each of ``keys``
    by_number: np.ndarray
    n: np.ndarray  # by number
    hot: np.ndarray  # sorted, with ``BEGIN``

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, hot_above: float) -> Vocabulary:
        by_number = np.lexsort((keys, -n))
        keys, n = keys[by_number], n[by_number]
        order = np.argsort(keys)
        hot = np.union1d(keys[(n > hot_above) & (keys != END)], np.array([BEGIN]))
        return cls(keys[order], order.astype(np.uint32), keys, n, hot)

    def encode(self, kind: int, h: np.ndarray, w: np.ndarray) -> dict:
        """A block's bigrams, those of a history next to each other."""
        at, known = _find(self.keys, w)
        code = np.full(len(w), RARE)
        code[known] = self.number[at[known]]
        out = {"kind": kind, "code": _pack(code), "rare": _pack(w[~known])}
        if kind == HOT:
            return out | {"h": _pack(np.searchsorted(self.hot, h).astype(np.uint16))}
        first = runs(h)
        return out | {"h": _pack(h[first]), "sizes": _pack(np.diff(np.append(first, len(h))).astype(np.uint32))}

    def decode(self, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Histories, words and numbers of a block's bigrams."""
        code = _unpack(block["code"], np.uint32)
        if block["kind"] == HOT:
            h = self.hot[_unpack(block["h"], np.uint16)]
        else:
            h = np.repeat(_unpack(block["h"], np.uint64), _unpack(block["sizes"], np.uint32))
        w = np.empty(len(code), np.uint64)
        known = code != RARE
        w[known], w[~known] = self.by_number[code[known]], _unpack(block["rare"], np.uint64)
        return h, w, code

    def deal(self, h: np.ndarray, w: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Kind, bucket, tokens in order of their bigrams, and where each distinct bigram starts among them."""
        warm = _hot_mask(h, self.hot)
        for kind, of in ((HOT, warm), (COLD, ~warm)):
            at = np.flatnonzero(of)
            place = pair_key(h[at], w[at]) if kind == HOT else mix(h[at])
            order = np.lexsort((w[at], place))
            at, place = at[order], place[order]
            first = _runs2(place, w[at])
            ends = np.append(first, len(at))
            cuts = bucket_cuts(place[first], buckets)
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    yield kind, k, at[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def _hot_mask(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each history is hot; ``hot`` is sorted."""
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return hot[at] == h


def _runs2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Start of each run of equal pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and word of every token, ends included, and row offsets."""
    codes, offsets, dictionary = split_words(text)
    words = word_hashes(dictionary)[codes] if len(dictionary) else np.zeros(0, np.uint64)
    n = len(offsets) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(offsets))] = words
    starts = offsets + np.arange(n + 1)
    history = np.empty_like(out)
    history[1:] = out[:-1]
    history[starts[:-1]] = BEGIN
    return history, out, starts


def _rows(schema: str, rows: list[dict]):
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in columns], [n for n, _ in columns])


def _columns(names: list[str], *columns: np.ndarray | pa.Array) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names)


def _staged(df: DataFrame, name: str) -> DataFrame:
    """Staged with batches of bounded size, as Spark holds them outside of its heap: while it runs, the session's limit is lower."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_BYTES)
    try:
        return staged(df, name)
    finally:
        conf.set(key, before)


def _dealt(df: DataFrame, buckets: int, *then) -> DataFrame:
    """Each bucket into a partition of its own; hashed numbers would put several into one task and none into others."""
    return df.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", *then)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, of which a few are made at a time: a batch may hold a whole partition of blocks."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for a in range(0, batch.num_rows, step):
            yield from batch.slice(a, step).to_pylist()


def _word_blocks(buckets: int):
    def run(batches):
        for batch in slices(batches):
            w, n = np.unique(_tokens(batch.column("text"))[1], return_counts=True)
            place = mix(w)
            order = np.argsort(place)
            cuts = bucket_cuts(place[order], buckets)
            out = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    out.append({"bucket": k, "w": _pack(w[order[a:b]]), "n": _pack(n[order[a:b]].astype(np.uint32))})
            yield _rows(WORD_COUNTS, out)

    return run


def _sum_words(rows):
    """Counts of a block's words."""
    w = np.concatenate([_unpack(r["w"], np.uint64) for r in rows])
    n = np.concatenate([_unpack(r["n"], np.uint32) for r in rows])
    order = np.argsort(w)
    first = runs(w[order])
    yield from _columns(["w", "n"], w[order[first]].astype(np.int64), np.add.reduceat(n[order].astype(np.int64), first))


def _count_blocks(buckets: int, vocabulary: Vocabulary):
    def run(batches):
        for batch in slices(batches, size=TEXT_BYTES):
            h, w, _ = _tokens(batch.column("text"))
            out = []
            for kind, k, at, ends in vocabulary.deal(h, w, buckets):
                one = at[ends[:-1]]
                out.append({"bucket": k, "n": _pack(np.diff(ends).astype(np.uint32))} | vocabulary.encode(kind, h[one], w[one]))
            yield _rows(COUNTS, out)

    return run


def _sum_pairs(vocabulary: Vocabulary):
    """Counts of a block's bigrams, by history."""

    def run(rows):
        n = np.concatenate([_unpack(r["n"], np.uint32) for r in rows])
        h, w, code = np.empty(len(n), np.uint64), np.empty(len(n), np.uint64), np.empty(len(n), np.uint32)
        a = 0
        for r in rows:
            part = vocabulary.decode(r)
            b = a + len(part[0])
            h[a:b], w[a:b], code[a:b] = part
            a = b
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        first = _runs2(h, w)
        n = np.add.reduceat(n[order], first, dtype=np.int64)
        h, w, code = h[first], w[first], code[order[first]]
        del order, first
        rare = code == RARE
        yield from _columns(["h", "code", "w", "n"], h.astype(np.int64), pa.array(code.astype(np.int64).astype(np.int32), mask=rare), pa.array(w.astype(np.int64), mask=~rare), n)

    return run


def discounts(types: dict[int, int], tokens: int, k: int = TRUSTED) -> list[float]:
    """Katz's factors for counts 1 to ``k`` from the numbers of types with each count.

    Where Good-Turing gives no factor between 0 and 1 (as in small tables), the
    counts are lowered by n1 / (n1 + 2 n2), or a half, instead. Some probability
    is always freed.
    """
    n = lambda r: types.get(r, 0)
    if all(n(r) for r in range(1, k + 2)):
        a = (k + 1) * n(k + 1) / n(1)
        if a < 1:
            out = [((r + 1) * n(r + 1) / n(r) / r - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in out):
                return out
    d = n(1) / (n(1) + 2 * n(2)) if n(1) and n(2) else 0.5
    return [(r - d) / r for r in range(1, k + 1)]


def _factor(factors: list[float], count):
    out = F.lit(1.0)
    for r, d in enumerate(factors, 1):
        out = F.when(count == r, F.lit(d)).otherwise(out)
    return out


def _discounted(factors: list[float], n: np.ndarray) -> np.ndarray:
    return n * np.array([0.0, *factors, 1.0])[np.minimum(n, len(factors) + 1)]


@dataclass
class Katz:
    """Tables of a fitted model and its few totals."""

    counts: DataFrame  # w, n
    known: DataFrame  # h, code, n of bigrams that end in a numbered word
    rare: DataFrame  # h, w, n, n_low (count of the word) of the others
    vocabulary: Vocabulary
    first: list[float]
    second: list[float]
    tokens: int
    types: int
    docs: int  # training rows, the count of the end token
    #: A factor of all word probabilities, below 1 where every count is trusted.
    shrink: float
    log_unknown: float
    keys: int
    #: Hot histories in their order: log10 of scale, log10 of backoff weight.
    hot_scale: np.ndarray
    hot_log_a: np.ndarray

    @property
    def log_begin(self) -> float:
        return float(self.hot_log_a[np.searchsorted(self.vocabulary.hot, BEGIN)]) if self.tokens else 0.0

    @property
    def pairs(self) -> DataFrame:
        """h, code, w (null where there is a code), n, n_low of all bigrams."""
        known = self.known.mapInArrow(_counts_of(self.vocabulary.n), "h long, code int, n long, n_low long")
        return known.unionByName(self.rare, allowMissingColumns=True)

    def _weighted(self, pairs: DataFrame) -> DataFrame:
        """Sums per history: h, log10 scale, log10 backoff weight."""
        n = F.col("n")
        sums = pairs.groupBy("h").agg(F.sum(_factor(self.second, n) * n).alias("high"), F.sum(self._low(F.col("n_low"))).alias("low"), F.sum("n").alias("n_h"))
        high = F.col("high") / F.col("n_h")
        # a history whose counts are all trusted frees what one more token would have
        most = F.col("n_h") / (F.col("n_h") + 1)
        scale = F.when(high > most, most / high).otherwise(1.0)
        return sums.select("h", "n_h", F.log10(scale).alias("log_scale"), F.log10((1 - high * scale) / F.greatest(1 - F.col("low"), F.lit(1e-15))).alias("log_a"))

    def _low(self, n):
        return _factor(self.first, n) * n * F.lit(self.shrink / max(1, self.tokens))

    @property
    def words(self) -> DataFrame:
        """w, n, log_p, log_a of every word; made when asked for, scoring does without."""
        back = self._weighted(self.pairs).select(F.col("h").alias("w"), "log_a")
        return self.counts.join(back, "w", "left").select("w", "n", F.log10(self._low(F.col("n"))).alias("log_p"), F.coalesce("log_a", F.lit(0.0)).alias("log_a"))

    @property
    def bigrams(self) -> DataFrame:
        """h, w, gain of every bigram over backing off; made when asked for, scoring does without."""
        number = {int(i): int(w) for i, w in enumerate(self.vocabulary.by_number.astype(np.int64))}
        spark = self.pairs.sparkSession
        names = spark.createDataFrame(list(number.items()), "code int, word long")
        full = self.pairs.join(names, "code", "left").withColumn("w", F.coalesce("w", "word")).join(self._weighted(self.pairs), "h")
        share = F.log10(_factor(self.second, F.col("n")) * F.col("n") / F.col("n_h"))
        return full.select("h", "w", (share + F.col("log_scale") - F.col("log_a") - F.log10(self._low(F.col("n_low")))).alias("gain"))


def fit(docs: DataFrame) -> Katz:
    """Count all rows' n-grams and make the model's tables, in the shared folder.

    What reaches the driver are totals, six counts of counts per order and the
    frequent words.
    """
    source = id_text(docs)
    size = source.agg(F.sum(F.length("text") + 6)).first()[0] or 0
    buckets = max(4, math.ceil(size / 6 * 0.7 / COUNT_KEYS))
    counts = _staged(_dealt(source.mapInArrow(_word_blocks(buckets), WORD_COUNTS), buckets).mapInArrow(lambda b: by_bucket(b, _sum_words), "w long, n long"), "word-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("w") == int(END), F.col("n"))).alias("docs")).first()
    tokens, types = totals["n"] or 0, totals["v"] or 0
    frequent = counts.where(F.col("n") > FREQUENT_SHARE * tokens).select("w", "n").toArrow()
    vocabulary = Vocabulary.of(frequent["w"].to_numpy().astype(np.uint64), frequent["n"].to_numpy(), HOT_SHARE * tokens)
    blocks = source.mapInArrow(_count_blocks(buckets, vocabulary), COUNTS)
    sums = _sum_pairs(vocabulary)
    grams = _staged(_dealt(blocks, buckets).mapInArrow(lambda b: by_bucket(b, sums), GRAMS), "bigram-counts")
    few = lambda t: {r["n"]: r["types"] for r in t.where(F.col("n") <= TRUSTED + 1).groupBy("n").agg(F.count("*").alias("types")).collect()}
    first, second = discounts(few(counts), tokens), discounts(few(grams), tokens)
    freed = 1 - (counts.agg(F.sum(_factor(first, F.col("n")) * F.col("n"))).first()[0] or 0.0) / max(1, tokens)
    shrink = 1.0
    if tokens and freed <= 1e-12:  # every count is trusted: free what one more token would have
        shrink, freed = tokens / (tokens + 1), 1 / (tokens + 1)
    low = counts.where(F.col("n") <= FREQUENT_SHARE * tokens).select("w", F.col("n").alias("n_low"))
    rare = staged(grams.where("code is null").drop("code").join(low, "w"), "rare-bigrams")
    known = grams.where("code is not null").drop("w")
    model = Katz(counts, known, rare, vocabulary, first, second, tokens, types, totals["docs"] or 0, shrink, math.log10(freed) if tokens else 0.0, size // 6, np.zeros(0), np.zeros(0))
    hot = vocabulary.hot.astype(np.int64).tolist()
    back = {r["h"]: r for r in model._weighted(model.pairs.where(F.col("h").isin(hot))).collect()} if tokens else {}
    model.hot_scale, model.hot_log_a = (np.array([back[h][c] if h in back else 0.0 for h in hot]) for c in ("log_scale", "log_a"))
    let_go(docs.sparkSession)  # of the join of rare words, which its own staging still held
    return model


def _counts_of(n: np.ndarray):
    """Add the count of each bigram's numbered word."""

    def run(batches):
        for batch in batches:
            code = np.asarray(batch.column("code"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n[code].astype(np.int64))], [*batch.schema.names, "n_low"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _model_blocks(buckets: int, vocabulary: Vocabulary):
    """The model's bigrams as blocks; they lie with their history, those of hot ones by themselves."""

    def run(batches):
        for batch in _gathered(batches):
            h, n, rare = np.asarray(batch.column("h")).astype(np.uint64), np.asarray(batch.column("n")), np.asarray(batch.column("code").is_null())
            n_low = np.zeros(len(h), np.uint32)
            n_low[rare] = np.asarray(batch.column("n_low").drop_null())
            w = np.empty(len(h), np.uint64)
            w[rare] = np.asarray(batch.column("w").drop_null()).astype(np.uint64)
            w[~rare] = vocabulary.by_number[np.asarray(batch.column("code").drop_null())]
            out = []
            for kind, k, at, _ in vocabulary.deal(h, w, buckets):
                out.append({"bucket": k, "model": True, "n": _pack(n[at]), "n_low": _pack(n_low[at][rare[at]])} | vocabulary.encode(kind, h[at], w[at]))
            yield _rows(BLOCKS, out)

    return run


def _text_blocks(buckets: int, vocabulary: Vocabulary, hot_gain: np.ndarray, word_base: np.ndarray):
    """Bigrams of each slice of texts with the rows that use them; and the slice's documents.

    ``hot_gain`` holds the gain of each hot history, ``word_base`` the base of each numbered word; they are added up here.
    """

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in slices(batches, size=TEXT_BYTES):
            number = (part << 24) + made
            made += 1
            h, w, starts = _tokens(batch.column("text"))
            n = batch.num_rows
            row = np.repeat(np.arange(n, dtype=np.uint16), np.diff(starts))
            warm = _hot_mask(h, vocabulary.hot)
            at, known = _find(vocabulary.keys, h)
            sums = [
                np.bincount(row[warm], hot_gain[np.searchsorted(vocabulary.hot, h[warm])], n),
                np.bincount(row[known], word_base[vocabulary.number[at[known]]], n),
                np.bincount(row[known], None, n).astype(float),
            ]
            del at, known, warm
            out = []
            for kind, k, at, ends in vocabulary.deal(h, w, buckets):
                one = at[ends[:-1]]
                block = {"bucket": k, "model": False, "slice": number, "uses": _pack(np.diff(ends).astype(np.uint32)), "row": _pack(row[at])}
                out.append(block | vocabulary.encode(kind, h[one], w[one]))
            docs = {"doc_id": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(), "n_tokens": np.diff(starts).tolist()}
            gain, base, known = (_pack(x) for x in sums)
            yield _rows(BLOCKS, [*out, {"bucket": number % buckets, "model": False, "kind": DOCUMENTS, "slice": number, "gain": gain, "base": base, "known": known, **docs}])

    return run


@dataclass
class _Rule:
    """What a look-up needs of the model beside its blocks."""

    vocabulary: Vocabulary
    first: list[float]
    second: list[float]
    tokens: int
    shrink: float
    log_unknown: float
    size: int
    hot_n: np.ndarray
    hot_seen: np.ndarray

    def tables(self, blocks: list[dict]) -> tuple:
        """Words (sorted keys; gain, base, known, what a held bigram adds) and bigrams (sorted keys; gain) of one bucket's blocks.

        Blocks of cold histories hold all their bigrams, so counts and backoff weights are sums over them.
        Of numbered words, base and known are added up with the texts.
        """
        keys, gains, sums = [], [], []
        for b in blocks:
            h, w, code = self.vocabulary.decode(b)
            n, rare = _unpack(b["n"], np.int64), code == RARE
            n_low = np.empty(len(n), np.int64)
            n_low[rare], n_low[~rare] = _unpack(b["n_low"], np.uint32), self.vocabulary.n[code[~rare]]
            p_low = _discounted(self.first, n_low) * (self.shrink / self.tokens)
            high = _discounted(self.second, n)
            gain = np.log10(high / p_low)
            keys.append(pair_key(h, w))
            if b["kind"] == HOT:
                at = np.searchsorted(self.vocabulary.hot, h)
                gain += self.hot_seen[at] - np.log10(self.hot_n[at])
            else:
                first = runs(h)
                sums.append((h[first], *(np.add.reduceat(x, first) for x in (n, high, p_low))))
            gains.append(gain)
        words = (np.zeros(0, np.uint64), *np.zeros((4, 0)))
        if sums:
            h, n, high, low = (np.concatenate(c) for c in zip(*sums, strict=True))
            own, to = np.unique(h, return_inverse=True)
            n, low = np.bincount(to, n), np.bincount(to, low)
            share = np.bincount(to, high) / n
            most = n / (n + 1)
            scale = np.where(share > most, most / share, 1.0)
            log_a = np.log10((1 - share * scale) / np.maximum(1 - low, 1e-15))
            p = _discounted(self.first, n.astype(np.int64)) * (self.shrink / self.tokens)
            alone = ~_find(self.vocabulary.keys, own)[1]
            base = np.log10((n + 1) / self.size) - math.log10(1 / self.size)
            words = own, np.log10(p) + log_a - self.log_unknown, base * alone, alone.astype(float), np.log10(scale / n) - log_a
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        del keys
        order = np.argsort(key)
        key = key[order]
        gain = np.concatenate(gains)[order] if gains else np.zeros(0)
        return words, (key, gain)


def _look_up(rule: _Rule):
    """Sums of gains per row of each slice, from one block of the model; its tables are in memory, texts stream by."""

    def run(batches):
        bucket, tables = None, None
        parts: list[dict] = []
        for r in _rows_of(batches):
            if r["bucket"] != bucket:
                bucket, tables, parts = r["bucket"], None, []
            if r["model"]:
                parts.append(r)
                continue
            if r["kind"] == DOCUMENTS:
                yield _rows(SUMS, [r | {"kind": 0}])
                continue
            if tables is None:
                tables, parts = rule.tables(parts), []
            words, bigrams = tables
            h, w, _ = rule.vocabulary.decode(r)
            uses, row = _unpack(r["uses"], np.uint32), _unpack(r["row"], np.uint16)
            at, held = _find(bigrams[0], pair_key(h, w))
            gain, base, known = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h))
            gain[held] = bigrams[1][at[held]]
            if r["kind"] == COLD:
                at, hit = _find(words[0], h)
                at = at[hit]
                gain[hit] += words[1][at] + words[4][at] * held[hit]
                base[hit], known[hit] = words[2][at], words[3][at]
            rows, to = np.unique(row, return_inverse=True)
            sums = [np.bincount(to, np.repeat(v, uses), len(rows)) for v in (gain, base, known)]
            yield _rows(SUMS, [{"kind": 1, "slice": r["slice"], "row": _pack(rows)} | {c: _pack(v) for c, v in zip(("gain", "base", "known"), sums, strict=True)}])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double"


def _add_up(batches):
    held: list[dict] = []

    def out():
        docs = next(r for r in held if r["kind"] == 0)
        sums = [_unpack(docs[c], float).copy() for c in ("gain", "base", "known")]
        for r in held:
            if r["kind"] == 1:
                at = _unpack(r["row"], np.uint16)
                for total, c in zip(sums, ("gain", "base", "known"), strict=True):
                    total[at] += _unpack(r[c], float)
        gain, base, known = sums
        return pa.RecordBatch.from_arrays(
            [pa.array(docs["doc_id"], pa.int64()), pa.array(docs["held_out"], pa.bool_()), pa.array(docs["n_tokens"], pa.int64()), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(gain)],
            [c.split()[0] for c in SCORED.split(", ")],
        )

    for r in _rows_of(batches):
        if held and held[0]["slice"] != r["slice"]:
            yield out()
            held = []
        held.append(r)
    if held:
        yield out()


def score(docs: DataFrame, model: Katz, modulus: int = 7, rest: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end; null and empty texts are the end alone.
    ``score`` is the model's log10 probability of the whole text; with an empty
    model it is 0. Repeated rows are scored each; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (remainder("doc_id", modulus) == rest).alias("held_out"))
    buckets = max(4, math.ceil(model.keys / LOOKUP_KEYS))
    size = model.tokens + model.types + 1
    unseen = math.log10(1 / size)
    vocabulary = model.vocabulary
    if model.tokens:
        n = {int(w): int(c) for w, c in zip(vocabulary.by_number, vocabulary.n, strict=True)} | {int(BEGIN): model.docs}
        hot_n = np.array([n[int(w)] for w in vocabulary.hot], float)
        # a word adds its own probability and, as the next token's history, its backoff weight; both relative to an unknown word's
        p = _discounted(model.first, hot_n.astype(np.int64)) * (model.shrink / model.tokens)
        hot_gain = np.log10(p) + model.hot_log_a - model.log_unknown
        hot_gain[np.searchsorted(vocabulary.hot, BEGIN)] = model.log_begin
        end_gain = math.log10(_discounted(model.first, np.array([model.docs]))[0] * model.shrink / model.tokens)
        end_base, end_known = math.log10((model.docs + 1) / size), 1
    else:
        hot_n, hot_gain = np.zeros(1), np.zeros(1)
        end_gain, end_base, end_known = 0.0, unseen, 0
    rule = _Rule(vocabulary, model.first, model.second, model.tokens, model.shrink, model.log_unknown, size, hot_n, model.hot_scale - model.hot_log_a)
    blocks = source.mapInArrow(_text_blocks(buckets, vocabulary, hot_gain, np.log10((vocabulary.n + 1) / size) - unseen), BLOCKS)
    if model.tokens:
        pairs = model.known.unionByName(model.rare, allowMissingColumns=True)
        blocks = blocks.unionByName(pairs.mapInArrow(_model_blocks(buckets, vocabulary), BLOCKS))
    sums = _staged(_dealt(blocks, buckets, F.col("model").desc()).mapInArrow(_look_up(rule), SUMS), "look-up-sums")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = sums.repartition(parts, "slice").sortWithinPartitions("slice", "kind").mapInArrow(_add_up, SCORED)
    n_words = F.col("n_tokens") - 1
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + end_known).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + n_words * unseen + end_base).alias("base_score"),
        (F.col("gain") + n_words * F.lit(model.log_unknown) + end_gain).alias("score"),
    )
