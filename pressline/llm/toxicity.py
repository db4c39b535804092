"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech). Two
transducers are composed into one table: the first marks insults and threats
that stand in the scope of a negation or of reported speech, the second raises
those near a target. Matched clauses, not single words, give a text's features,
and a logistic function of these, fitted on labelled texts, gives its score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, slices, split_words, staged

#: The fit uses about this many labelled texts of each label, chosen by a hash of the id.
SAMPLE_TEXTS = 8000
#: A learned insult is in at least this share of the toxic texts and this many of them ...
LEAST_SHARE, LEAST_TEXTS = 0.002, 4
#: ... and this much more frequent there than in others (log of the ratio).
LEAST_LIFT = 2.5

#: Word classes besides the learned insults, in the four languages of the tables.
THREAT = "kill killing hurt beat destroy die burn umbringen töten schlagen tuer frapper mourir matar golpear morir".split()
TARGET = "you your yours he she they them his her their du dich dein ihr euch sie tu toi ton vous votre ils elles tú tu usted ustedes ellos ellas".split()
NEGATION = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ninguno".split()
REPORT = "said says say called calls wrote quoted sagte sagt nannte dit disait appelait dijo dice llamó".split()

OTHER, INSULT, THREATEN, AIM, NEGATE, QUOTE, END = range(7)
#: Outputs of the scope transducer and of the whole grammar.
PLAIN, NEGATED, REPORTED = range(3)
SCOPE, NEAR = 3, 4
TARGET_GAIN = 1.5


@dataclass
class Transducer:
    """A deterministic transducer: ``step[state, symbol]`` and ``out[state, symbol]`` (-1: nothing)."""

    step: np.ndarray
    out: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other one reads this one's outputs; a silent step reads its symbol 0."""
        n, m, k = self.step.shape[0], other.step.shape[0], self.step.shape[1]
        step, out = np.zeros((n * m, k), int), np.zeros((n * m, k), int)
        for a in range(n):
            for b in range(m):
                for s in range(k):
                    read = self.out[a, s]
                    step[a * m + b, s] = self.step[a, s] * m + other.step[b, read]
                    out[a * m + b, s] = other.out[b, read]
        return Transducer(step, out)


def scopes() -> Transducer:
    """State: words left in a negation's scope, and whether the clause is reported.

    Output: 0 other, 1 target, 2 clause end, 3 + 3 * (threat) + (plain, negated or reported).
    """
    n = 2 * (SCOPE + 1)
    step, out = np.zeros((n, 7), int), np.zeros((n, 7), int)
    for left in range(SCOPE + 1):
        for quoted in (0, 1):
            a = left * 2 + quoted
            kind = REPORTED if quoted else NEGATED if left else PLAIN
            for s in range(7):
                after, said, tell = max(0, left - 1), quoted, 0
                if s == NEGATE:
                    after = SCOPE
                elif s == QUOTE:
                    said = 1
                elif s == AIM:
                    tell = 1
                elif s == END:
                    after, said, tell = 0, 0, 2
                elif s in (INSULT, THREATEN):
                    tell = 3 + 3 * (s == THREATEN) + kind
                step[a, s], out[a, s] = after * 2 + said, tell
    return Transducer(step, out)


def aims() -> Transducer:
    """State: words since a target. Output: -1, or 2 * kind + (1 if a target is near)."""
    step, out = np.zeros((NEAR + 1, 9), int), np.full((NEAR + 1, 9), -1)
    for left in range(NEAR + 1):
        for s in range(9):
            step[left, s] = NEAR if s == 1 else 0 if s == 2 else max(0, left - 1)
            if s >= 3:
                out[left, s] = 2 * (s - 3) + (left > 0)
    return Transducer(step, out)


GRAMMAR = scopes().then(aims())
FEATURES = 9


@dataclass
class ToxicModel:
    insults: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    fixed: dict[str, int] = field(default_factory=lambda: {w: c for c, words in ((THREATEN, THREAT), (AIM, TARGET), (NEGATE, NEGATION), (QUOTE, REPORT)) for w in words})

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _clean(words: pa.Array) -> list[str]:
    """Dictionary words without their edges of signs."""
    return pc.replace_substring_regex(pc.utf8_lower(words), pattern=r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", replacement="").to_pylist()


def _ends(codes: np.ndarray, words: pa.Array, quotes: np.ndarray) -> np.ndarray:
    """Whether each token ends a clause. A colon after a reporting word opens what is reported, so it does not."""
    hard = np.asarray(pc.match_substring_regex(words, pattern=r"[.!?;|]"))[codes]
    colon = np.asarray(pc.match_substring_regex(words, pattern=":"))[codes]
    alone = np.asarray(pc.match_substring_regex(words, pattern="^:$"))[codes]
    said = quotes[codes]
    return hard | colon & ~said & ~(alone & np.r_[False, said[:-1]])


def _tokens(text: pa.Array):
    return split_words(pc.replace_substring(text, "\n", " . "))


def features(text: pa.Array, model: ToxicModel) -> np.ndarray:
    """Per text: best clause and sum of clauses of insults, and sum of threats, each plain, negated and reported."""
    codes, offsets, words = _tokens(text)
    bare = _clean(words)
    kind = np.array([INSULT if w in model.insults else model.fixed.get(w, OTHER) for w in bare], np.int64).reshape(-1)
    worth = np.array([model.insults.get(w, 1.0) for w in bare]).reshape(-1)
    out = np.zeros((len(text), FEATURES))
    hot = np.flatnonzero((kind[codes] == INSULT) | (kind[codes] == THREATEN))
    clause = np.concatenate([[0], np.cumsum(_ends(codes, words, kind == QUOTE))]) if len(codes) else np.zeros(1, int)
    done = (-1, -1)
    for t in hot:
        row = int(np.searchsorted(offsets, t, side="right") - 1)
        if done == (row, clause[t]):
            continue
        done = (row, clause[t])
        a = max(int(offsets[row]), int(np.searchsorted(clause, clause[t])))
        b = min(int(offsets[row + 1]), int(np.searchsorted(clause, clause[t], side="right")))
        state, sums = 0, np.zeros(6)
        for code in codes[a:b]:
            symbol = kind[code]
            tell = GRAMMAR.out[state, symbol]
            state = GRAMMAR.step[state, symbol]
            if tell >= 0:
                sums[tell // 2] += worth[code] * (TARGET_GAIN if tell % 2 else 1.0)
        out[row, :3] = np.maximum(out[row, :3], sums[:3])
        out[row, 3:6] += sums[:3]
        out[row, 6:] += sums[3:]
    return np.log1p(out)


def _word_rows(batches):
    for batch in slices(batches):
        codes, offsets, words = _tokens(batch.column("text"))
        bare = pa.array(_clean(words), pa.string()).dictionary_encode()
        to = np.asarray(bare.indices).astype(np.int64)
        toxic = np.asarray(batch.column("toxic")).astype(np.int64)
        size = max(1, len(bare.dictionary))
        seen = np.unique(np.repeat(np.arange(len(toxic)), np.diff(offsets)) * size + to[codes]) if len(codes) else np.zeros(0, np.int64)
        row, word = np.divmod(seen, size)
        bad = np.bincount(word, toxic[row], size).astype(np.int64)
        some = np.bincount(word, minlength=size)
        yield pa.RecordBatch.from_arrays([bare.dictionary, pa.array(bad[: len(bare.dictionary)]), pa.array((some - bad)[: len(bare.dictionary)])], ["word", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TEXTS) -> ToxicModel:
    """Learn the insults and the weights from labelled texts; the caller leaves out held-out rows.

    Only ids of about ``sample`` texts of each label are broadcast, and only the
    word list (words of at least ``LEAST_SHARE`` of the toxic ones of them) and
    nine numbers for each of those texts reach the driver. Equal texts are
    learned from once.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return ToxicModel()
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = staged(texts.select("text", "toxic"), "toxic-sample")
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not (bad and good):
        return ToxicModel()
    lift = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    words = texts.mapInArrow(_word_rows, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.where((F.length("word") > 2) & (F.col("bad") >= max(LEAST_TEXTS, LEAST_SHARE * bad))).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
    model = ToxicModel({r["word"]: float(r["lift"]) for r in words.collect()})

    def featured(batches):
        for batch in slices(batches):
            x = features(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = texts.mapInArrow(featured, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    model.weights = _logistic(x, np.array([r["toxic"] for r in rows], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; labels weigh equally; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + penalty * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(h, g)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) for every whole text; null and empty texts have the score of a text without matches.

    Repeated rows give repeated results; an empty table gives none; other columns
    are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"), model)))], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")
