"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, give each word a probability: what its count of documents in the class
is beyond a discount, and for the discounted mass a backoff that both classes share, a Kneser-Ney model of a word's
characters whose lower orders count distinct left neighbours over both classes. Both are proper: over all words, known or
not, each sums to 1. An expression that is rare in both classes has the same backoff in both and tells almost nothing.

A text is judged by length-normalised log-likelihoods, toxic less ordinary, of its ``TELLING`` most telling words beyond the
median word's (what all of the text shares, such as its language, tells nothing), and by the log of its length, since longer
texts have larger extremes by chance; a logistic regression calibrates both. The mean over all words of a text, which is the
plain form of the method, cannot find a few words in hundreds: see the README for its figures and how this form was chosen.

Labels are learned from at most ``MAX_PER_CLASS`` labelled rows of each class, those of the smallest id hash; a quarter
of them is held back to calibrate. Words of the sample are counted on the executors; the driver gets those that at least
``MIN_DOCUMENTS`` documents have, and how many words there are in all.

Defined results: a null, empty or white-space text has difference 0 and is scored like any other; ids, languages and
sources are never inputs; labels other than 0 and 1, null labels, ids that have both labels, and labels without a row are
not learned from; with no label of one class every score is 0; repeated rows score alike; further columns are not read
(``scores``) or passed on (``keep_ordinary``).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

ORDER = 4
MAX_PER_CLASS = 3000
#: Documents that a word must be in to count as known; the others make up the mass of unknown words.
MIN_DOCUMENTS = 3
THRESHOLD = 0.7
DISCOUNT = 0.75
#: Words by which a text is judged: those whose difference is largest.
TELLING = 5
#: Words whose differences a worker remembers, and bytes of the longest of them.
REMEMBERED, SHORT = 400_000, 64
#: Characters of which the last resort is even.
ALPHABET = 1_114_112
_TRIM = b".,;:!?\"'()[]{}%&*$#|<>-"


class Spelling:
    """Kneser-Ney model of the characters of words (each counted once), an end after each; order ``ORDER``."""

    def __init__(self, words: list[str]):
        grams: Counter = Counter()
        for w in words:
            text = "\x02" * (ORDER - 1) + w + "\x03"
            grams.update(text[i : i + ORDER] for i in range(len(text) - ORDER + 1))
        self.levels, self.totals, self.kinds = [], [], []
        for _ in range(ORDER):  # each lower order counts distinct left neighbours of the order above
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in grams.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.levels.append(grams)
            self.totals.append(total)
            self.kinds.append(kinds)
            grams = Counter(g[1:] for g in grams)
        self.known: dict[str, float] = {}

    def next(self, g: str) -> float:
        """Probability of the last character of ``g`` after those before."""
        if not g:
            return 1 / ALPHABET
        if (p := self.known.get(g)) is None:
            i, h, low = ORDER - len(g), g[:-1], self.next(g[1:]) if len(g) > 1 else 1 / ALPHABET
            total = self.totals[i].get(h, 0)
            p = self.known[g] = (max(self.levels[i].get(g, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[i][h] * low) / total if total else low
        return p

    def __call__(self, word: str) -> float:
        text, p = "\x02" * (ORDER - 1) + word + "\x03", 1.0
        for i in range(len(text) - ORDER + 1):
            p *= self.next(text[i : i + ORDER])
        return p

    def log(self, word: str) -> float:
        """Logarithm of the probability, which is below the least float for words of a few hundred characters."""
        text = "\x02" * (ORDER - 1) + word + "\x03"
        return math.fsum(math.log(self.next(text[i : i + ORDER])) for i in range(len(text) - ORDER + 1))


class Model:
    """Differences (toxic minus ordinary) of known words and of any other, and the calibration."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], totals: tuple[int, int]):
        """counts: documents of known words in each class; totals: of all words of a class, known or not. What known words leave
        of a class's mass is for the backoff."""
        spelt = Spelling([w.decode("utf-8", "replace") for w in counts])
        self.totals = totals
        self.spare = [1 - sum(max(n[k] - DISCOUNT, 0) for n in counts.values()) / totals[k] for k in (0, 1)]
        self.words = {}
        for word, n in counts.items():
            shared = spelt.log(word.decode("utf-8", "replace"))
            self.words[word] = self.log_probability(n[1], 1, shared) - self.log_probability(n[0], 0, shared)
        self.unknown = math.log(self.spare[1] / self.spare[0])
        self.memory: dict[bytes, float] = {}
        self.weights = None

    def probabilities(self, n: tuple[int, int], shared: float) -> list[float]:
        """Of a word with ``n`` documents in each class whose shared backoff is ``shared``."""
        return [max(n[k] - DISCOUNT, 0) / self.totals[k] + self.spare[k] * shared for k in (0, 1)]

    def log_probability(self, n: int, k: int, log_shared: float) -> float:
        """Of a word with ``n`` documents in class ``k``, where ``probabilities`` might be 0 for the shortness of floats."""
        own, backoff = max(n - DISCOUNT, 0) / self.totals[k], math.log(self.spare[k]) + log_shared
        return math.log(own + math.exp(backoff)) if own else backoff

    def difference(self, token: bytes) -> float:
        """Of a token as it stands in the text, upper and lower case alike."""
        word = token.strip(_TRIM)
        x = self.words.get(word, self.unknown) if word else self.unknown
        if len(token) <= SHORT:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[token] = x
        return x

    def features(self, data: bytes | None) -> tuple[float, float]:
        tokens = (data or b"").lower().split()
        if not tokens:
            return 0.0, 0.0
        memory, miss = self.memory, self.difference
        d = np.array([memory[t] if t in memory else miss(t) for t in tokens])
        d -= np.median(d)
        most = d if len(d) <= TELLING else np.partition(d, len(d) - TELLING)[-TELLING:]
        return float(most.sum() / TELLING), math.log(len(tokens))

    def score(self, data: bytes | None) -> float:
        if self.weights is None:
            return 0.0
        mean, scale, w, bias = self.weights
        z = float(((np.array(self.features(data)) - mean) / scale) @ w + bias)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def calibrate(self, rows: list[tuple[float, float, int]]) -> None:
        """Logistic regression on the two features; classes weigh alike."""
        if len({r[2] for r in rows}) < 2:
            return
        x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.column_stack(((x - mean) / scale, np.ones(len(x))))
        weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w = np.zeros(3)
        for _ in range(60):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = np.diag([1e-4, 1e-4, 0])
            w -= np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (weigh * (p - y)) + ridge @ w)
        self.weights = (mean, scale, w[:2], w[2])

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}


def known_words(data: bytes | None) -> set[bytes]:
    """The different words of a text."""
    return {w for t in (data or b"").lower().split() if (w := t.strip(_TRIM))}


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """``learn``: which labelled rows may be learned from, over the column ``id``."""
    marked = common.labelled(labels, id_col, label_col).where(learn)
    place = F.xxhash64("id")
    sample = [common.smallest(marked.where(F.col("y") == y), place, MAX_PER_CLASS) for y in (0, 1)]
    sample = sample[0].unionByName(sample[1])  # at most 2 * MAX_PER_CLASS rows: it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = common.checkpoint(texts.join(F.broadcast(sample), "id").select("id", "text", "y", (F.pmod(place, F.lit(4)) == 3).alias("calibrates")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(), Counter()]
            for data, y in zip(common.as_bytes(b.column(0)), b.column(1).to_pylist()):
                found[y].update(known_words(data))
            all_words = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(all_words, pa.binary()), *(pa.array([found[k][w] for w in all_words], pa.int64()) for k in (0, 1))], ["word", "n0", "n1"])

    counted = common.map_batches(rows.where("not calibrates").select("text", "y"), count, "word binary, n0 long, n1 long")
    counts = common.checkpoint(counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not (total[0] and total[1]):
        return None
    got = counts.where(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).toArrow()
    words, n0, n1 = (got.column(i).to_pylist() for i in range(3))
    model = Model({bytes(w): (a, b) for w, a, b in zip(words, n0, n1)}, tuple(total))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.features(x) for x in common.as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), b.column(1)], ["a", "b", "y"])

    measured = common.map_batches(rows.where("calibrates").select("text", "y"), measure, "a double, b double, y int")
    model.calibrate(sorted(tuple(r) for r in measured.collect()))
    return model


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.score(x) if held.value else 0.0 for x in common.as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return common.map_batches(df, run, f"id {df.schema['id'].dataType.simpleString()}, score double")


def keep_ordinary(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not (held.value and held.value.score(x) >= threshold) for x in common.as_bytes(b.column(at))], pa.bool_()))

    return common.map_batches(docs, run, docs.schema)
