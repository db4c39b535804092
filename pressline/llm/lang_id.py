"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, computed
by a forward pass; the pieces' probabilities are learned by expectation-
maximisation over the same sums. Words are runs of letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, slices, staged, text_hash

#: The fit uses about this many labelled texts of each language, chosen by a hash of the id.
SAMPLE_TEXTS = 1500
ROUNDS = 3
#: Longer words are summed one by one, with rescaled sums; shorter ones of equal length together.
TOGETHER_CHARS = 32
#: Ends of pieces that are looked up at a time in a long word.
LOOK_UP = 4096
#: Words whose scores a Python worker remembers.
MEMORY_WORDS = 400_000
#: Probability of a character that no piece covers, alike in all languages.
UNKNOWN = 1e-6
PSEUDO = 0.05
BASE = np.uint64(0x100000001B3)
#: Fixed value: the mark of a word's begin in the vocabulary.
BEGIN = "▁"


def public_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece vocabulary, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def letter_runs(text: pa.Array, kinds: str = r"\p{L}") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-case runs of letters (or of ``kinds``): codes, row offsets, dictionary."""
    plain = pc.replace_substring_regex(pc.utf8_lower(text), pattern=f"[^{kinds}]+", replacement=" ")
    lists = pc.split_pattern(plain, " ")
    flat = lists.values
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), before[np.asarray(lists.offsets)], coded.dictionary


@dataclass
class PieceModel:
    """Piece probabilities by language: ``prob`` has a row per piece and a last row of zeros."""

    keys: np.ndarray
    rows: np.ndarray
    longest: int
    langs: list[str]
    prob: np.ndarray
    prior: np.ndarray

    @staticmethod
    def start(pieces: list[str], langs: list[str], prior: np.ndarray) -> PieceModel:
        pieces = sorted(set(pieces), key=lambda p: (len(p), p))
        keys = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            keys[i] = _hash(_points([piece], len(piece)))[0, -1]
        order = np.argsort(keys)
        even = np.full((len(pieces) + 1, len(langs)), 1.0 / max(1, len(pieces)))
        even[-1] = 0
        return PieceModel(keys[order], order, max(map(len, pieces), default=1), langs, even, prior)

    def arcs(self, words: list[str], length: int) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: piece row of every substring (begin, end), -1 where there is none."""
        h = _hash(_points([BEGIN + w for w in words], length + 1))
        out = {}
        for j in range(1, length + 2):
            for i in range(max(0, j - self.longest), j):
                key = h[:, j] - h[:, i] * BASE ** np.uint64(j - i)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                row = np.where(self.keys[at] == key, self.rows[at], -1)
                if j - i == 1 or (row >= 0).any():
                    out[i, j] = row
        return out

    def weight(self, row: np.ndarray, single: bool) -> np.ndarray:
        p = self.prob[row]
        return np.where((row < 0)[:, None], UNKNOWN, p) if single else p

    def forward(self, arcs: dict, n: int, length: int) -> list[np.ndarray]:
        alpha = [np.zeros((n, len(self.langs))) for _ in range(length + 2)]
        alpha[0][:] = 1
        for (i, j), row in arcs.items():
            alpha[j] += alpha[i] * self.weight(row, j - i == 1)
        return alpha

    def ending(self, word: str):
        """For each end in a long word, in blocks: (first end, piece row by length - 1 and end); -1 where there is none."""
        h = _hash(_points([BEGIN + word], len(word) + 1))[0]
        for a in range(1, len(h), LOOK_UP):
            ends = np.arange(a, min(a + LOOK_UP, len(h)))
            rows = np.full((self.longest, len(ends)), -1, np.int64)
            for d in range(1, min(self.longest, int(ends[-1])) + 1):
                own = ends >= d
                key = h[ends[own]] - h[ends[own] - d] * BASE ** np.uint64(d)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rows[d - 1, own] = np.where(self.keys[at] == key, self.rows[at], -1)
            yield a, rows

    def long_forward(self, word: str) -> np.ndarray:
        """Logs of the forward sums at each end of a word of any length: the last ones are its probability."""
        log = np.zeros((len(word) + 2, len(self.langs)))
        for a, rows in self.ending(word):
            for k in range(rows.shape[1]):
                log[a + k] = self._step(log, a + k, rows[:, k])[1]
        return log

    def _step(self, log: np.ndarray, end: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the pieces that end here in the forward sum, by length - 1, and the sum's log."""
        d = min(self.longest, end)
        weight = self.prob[rows[:d]]
        if rows[0] < 0:
            weight[0] = UNKNOWN
        before = log[end - d : end][::-1]
        top = before.max(axis=0)
        part = np.exp(before - top) * weight
        total = part.sum(axis=0)
        return part / total, np.log(total) + top

    def log_prob(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.langs)))
        for i in _long(words):
            out[i] = self.long_forward(words[i])[-1]
        for at, group, length in _by_length(words):
            arcs = self.arcs(group, length)
            out[at] = np.log(self.forward(arcs, len(group), length)[-1])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; ``counts`` is words by languages."""
        total = np.zeros_like(self.prob)
        for i in _long(words):
            log = self.long_forward(words[i])
            # uses of each end, from the last one back: a piece takes its share of its end's
            use = np.zeros_like(log)
            use[-1] = counts[i]
            for a, rows in reversed(list(self.ending(words[i]))):
                for end in range(a + rows.shape[1] - 1, a - 1, -1):
                    part = self._step(log, end, rows[:, end - a])[0] * use[end]
                    use[end - len(part) : end] += part[::-1]
                    np.add.at(total, rows[: len(part), end - a], part)
        for at, group, length in _by_length(words):
            arcs = self.arcs(group, length)
            alpha = self.forward(arcs, len(group), length)
            beta = [np.zeros_like(alpha[0]) for _ in alpha]
            beta[-1][:] = counts[at] / alpha[-1]
            for (i, j), row in sorted(arcs.items(), key=lambda x: -x[0][1]):
                flow = self.weight(row, j - i == 1) * beta[j]
                beta[i] += flow
                used = alpha[i] * flow
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(row + 1, used[:, k], len(total))[np.r_[1 : len(total), 0]]
        total[-1] = 0
        return total


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _hash(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        h[:, j + 1] = h[:, j] * BASE + points[:, j] + np.uint64(1)
    return h


def _long(words: list[str]) -> list[int]:
    return [i for i, w in enumerate(words) if len(w) > TOGETHER_CHARS]


def _by_length(words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths <= TOGETHER_CHARS]):
        all_at = np.flatnonzero(lengths == length)
        for c in range(0, len(all_at), 20_000):
            at = all_at[c : c + 20_000]
            yield at, [words[i] for i in at], int(length)


def _counted(batches):
    """(lang, word, n) of each slice."""
    for batch in slices(batches):
        codes, offsets, words = letter_runs(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        row_lang = np.asarray(langs.indices).astype(np.int64)
        pair = np.repeat(row_lang, np.diff(offsets)) * max(1, len(words)) + codes
        pair, n = np.unique(pair, return_counts=True)
        if len(pair):
            lang, word = np.divmod(pair, len(words))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), words.take(pa.array(word)), pa.array(n)], ["lang", "word", "n"])


def fit(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS, sample: int = SAMPLE_TEXTS) -> PieceModel:
    """Learn from rows with a language (columns doc_id, text, lang); the caller leaves out held-out rows.

    About ``sample`` texts of each language are used. What reaches the driver is
    one number per piece and language, whatever the size of the table.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    prior = {r["lang"]: r["rows"] for r in sizes.collect()}
    langs = sorted(prior)
    if not langs:
        return PieceModel.start(pieces, [], np.zeros(0))
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / prior[lang])))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    cells = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(langs)]
    words = staged(counts.groupBy("word").agg(*cells), "language-words")
    weight = np.array([prior[x] for x in langs], float)
    model = PieceModel.start(pieces, langs, np.log(weight / weight.sum()))

    for _ in range(rounds):

        def expect(batches, model=model):
            total = np.zeros_like(model.prob)
            for batch in batches:
                n = np.stack([np.asarray(batch.column(k + 1), dtype=float) for k in range(len(model.langs))], 1)
                total += model.expected(batch.column(0).to_pylist(), n)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, k]) for k in range(len(model.langs))]], ["piece", *[f"e{k}" for k in range(len(model.langs))]])

        schema = "piece long, " + ", ".join(f"e{k} double" for k in range(len(langs)))
        sums = words.mapInArrow(expect, schema).groupBy("piece").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(len(langs))])
        total = np.zeros_like(model.prob)
        for row in sums.collect():
            total[row["piece"]] = row[1:]
        total[:-1] += PSEUDO
        model = PieceModel(model.keys, model.rows, model.longest, langs, total / total.sum(axis=0), model.prior)
    return model


def predict(docs: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, lang_pred, score, letters, text_hash): the likeliest language of each whole text and its posterior.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned; ``letters`` says whether there is a letter. Ties go to
    the language that sorts first. Repeated rows give repeated results, told apart
    from others with their id by ``text_hash``; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        memory: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)))
        for batch in slices(batches):
            codes, offsets, dictionary = letter_runs(batch.column("text"))
            words = dictionary.to_pylist()
            fresh = [w for w in words if w not in memory]
            if len(memory) + len(fresh) > MEMORY_WORDS:
                memory, table, fresh = {}, table[:0], words
            memory.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
            if fresh:
                table = np.concatenate([table, model.log_prob(fresh)])
            scores = table[np.fromiter(map(memory.__getitem__, words), np.int64, len(words))][codes]
            sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
            total = sums[offsets[1:]] - sums[offsets[:-1]] + model.prior
            some = np.diff(offsets) > 0
            best = total.argmax(axis=1) if model.langs else np.zeros(len(some), np.int64)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if model.langs else np.zeros(len(some))
            known = some & bool(model.langs)
            lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(some), batch.column("text_hash")],
                ["doc_id", "lang_pred", "score", "letters", "text_hash"],
            )

    rows = id_text(docs).withColumn("text_hash", text_hash("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, letters boolean, text_hash long")
