"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are a text's words (A-Z lower-cased, split at ASCII white space) and one end. The model predicts a token in two
steps. First one of ``SYMBOLS`` symbols from the two before it: a symbol is one of the most frequent words, the end, or a
class that rarer words share by their last letters. The context's vector is a sum of linear maps of the two symbols'
vectors; scores against all symbols are one matrix product, and since the contexts are few, the normalised
log-probabilities of all of them are one table made by batched products. Then, if the symbol is a class, a word of it from
the symbol before: the next ``MODELLED`` words by count have vectors of their own, and what is left of each class is one
more; scores are normalised within the class, again as one table made by batched products. A word that has no vector has
its smoothed share of what is left of its class, so the probabilities of all known words and of one unknown word per class
sum to 1.

Corpus counts are exact: each word's count over all training texts is summed on the executors and written to the shared
folder. The ``HEAD`` most frequent words travel to the workers; the rest of a text's words meet their counts in a join,
where no word is frequent. Training covers all training texts: in each of ``ROUNDS`` rounds every task trains on its
share from the same start, and the results are averaged, weighted by tokens, in a tree of bounded fan-in. Each text
takes part in one round.

Defined results: a null text is empty and is one token, the end; without training texts base and model are uniform over
one unseen token; repeated rows score alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

#: Words whose counts travel to every worker (about 5 MB).
HEAD = 200_000
#: Symbols that the model predicts: the end, frequent words, classes of rarer words.
SYMBOLS, CLASSES = 256, 64
DIMENSION = 24
NOISE = 48
BATCH = 4096
RATE = 0.08
#: Of 8 parts of the training texts, those of each round.
ROUNDS = ((0,), (1, 2, 3), (4, 5, 6, 7))
FAN_IN = 16
END = 0
#: Words of the classes that have vectors of their own, noise for each when they are trained, and the rounds that train them.
MODELLED, INNER_NOISE, INNER_ROUNDS = 20_000, 10, (0, 1, 2)
#: Words of one class that share their noise in a step.
SHARING = 8
#: Words that a task counts before it passes the counts on.
COUNTED = 200_000


def word_class(word: bytes) -> int:
    return SYMBOLS - CLASSES + zlib.crc32(word[-3:]) % CLASSES


class Vocabulary:
    """Counts of the head, masses of the classes, and the slots of each class: its words that have vectors, and the rest."""

    def __init__(self, head: list[tuple[bytes, int]], masses: dict[int, int], n: int, v: int, ends: int):
        self.n, self.v, self.ends = n, v, ends
        frequent = SYMBOLS - CLASSES - 1
        self.place = {w: i for i, (w, _) in enumerate(head)}
        self.symbol = np.array([i + 1 if i < frequent else word_class(w) for i, (w, _) in enumerate(head)] or [0], np.int64)
        counts = np.array([c for _, c in head] or [0], float)
        self.log_count = np.log10(counts + 1)
        modelled = np.arange(frequent, min(len(head), frequent + MODELLED))
        first = SYMBOLS - CLASSES
        inner = self.symbol[modelled] - first if len(modelled) else np.empty(0, np.int64)
        # Slots by class, the rest of a class after its words. Masses: count + 1, and + 1 for any unknown word in the rest.
        owner = np.concatenate((inner, np.arange(CLASSES)))
        mass = np.concatenate((counts[modelled] + 1, [masses.get(first + k, 0) + 1.0 for k in range(CLASSES)]))
        np.subtract.at(mass, len(modelled) + inner, counts[modelled] + 1)
        order = np.argsort(owner, kind="stable")
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        self.slot_class, self.slot_mass = owner[order], np.maximum(mass[order], 1.0)
        self.starts = np.searchsorted(self.slot_class, np.arange(CLASSES + 1))
        self.rest = slot[len(modelled) :]  # of each class
        self.log_rest = np.log10(self.slot_mass[self.rest])
        # Of each place of the head: its slot (-1: a symbol of its own), and its share of the rest of its class.
        self.slot = np.where(self.symbol >= first, self.rest[np.maximum(self.symbol - first, 0)], -1)
        self.own = np.where(self.symbol >= first, self.log_count - self.log_rest[np.maximum(self.symbol - first, 0)], 0.0)
        self.slot[modelled], self.own[modelled] = slot[: len(modelled)], 0.0

    def read(self, data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Symbols of the words, slots (-1: none), places in the head (-1: none), words that the head lacks."""
        words = (data or b"").lower().split()
        get = self.place.get
        places = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(places < 0)
        symbols, slots = self.symbol[places], self.slot[places]
        rare = [words[i] for i in lacking.tolist()]
        symbols[lacking] = [word_class(w) for w in rare]
        slots[lacking] = self.rest[symbols[lacking] - (SYMBOLS - CLASSES)]
        return symbols, slots, places, rare


class Model:
    """q = R[a] A + R[b] B; score of symbol w = q . V[w] + c[w]; of slot s of a class after symbol b: I[b] . U[s] + d[s]."""

    def __init__(self, unigram: np.ndarray, slot_class: np.ndarray, slot_mass: np.ndarray):
        rng = np.random.default_rng(7)
        self.p = [rng.normal(0, 0.1, (SYMBOLS, DIMENSION)), np.eye(DIMENSION) * 0.7, np.eye(DIMENSION) * 0.5, rng.normal(0, 0.1, (SYMBOLS, DIMENSION)), np.log(unigram)]
        self.unigram, self.slot_class, self.slot_mass = unigram, slot_class, slot_mass
        self.sums, self.starts = np.concatenate(([0.0], np.cumsum(slot_mass))), np.searchsorted(slot_class, np.arange(CLASSES + 1))
        share = slot_mass / np.bincount(slot_class, slot_mass, CLASSES)[slot_class]
        self.log_inner = np.log(INNER_NOISE * share)
        self.p += [rng.normal(0, 0.3, (SYMBOLS, DIMENSION)), np.zeros((len(slot_class), DIMENSION)), np.log(share)]

    def flat(self, inner: bool) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p[: None if inner else 5]]).astype(np.float32)

    def with_weights(self, flat: np.ndarray) -> Model:
        """A model with these weights; what they don't give stays."""
        out, at = copy.copy(self), 0
        out.p = list(self.p)
        for i, x in enumerate(self.p):
            if at < len(flat):
                out.p[i] = flat[at : at + x.size].reshape(x.shape).astype(float)
                at += x.size
        return out

    def table(self) -> np.ndarray:
        """log10 probability of each symbol after each pair of symbols, by batched matrix products."""
        r, a, b, v, c = (x.astype(np.float32) for x in self.p[:5])
        first, second = r @ a, r @ b
        out = np.empty((SYMBOLS, SYMBOLS, SYMBOLS), np.float32)
        for i in range(SYMBOLS):
            z = (first[i] + second) @ v.T + c
            top = z.max(axis=1, keepdims=True)
            out[i] = (z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))) / np.float32(math.log(10))
        return out

    def inner_table(self) -> np.ndarray:
        """log10 probability of each slot in its class after each symbol."""
        i, u, d = (x.astype(np.float32) for x in self.p[5:])
        z = i @ u.T + d
        starts = np.searchsorted(self.slot_class, np.arange(CLASSES))
        top = np.maximum.reduceat(z, starts, axis=1)[:, self.slot_class]
        total = np.add.reduceat(np.exp(z - top), starts, axis=1)[:, self.slot_class]
        return (z - top - np.log(total)) / np.float32(math.log(10))

    def train(self, streams: Iterator[tuple[np.ndarray, np.ndarray]], inner: bool) -> int:
        """Noise-contrastive estimation over texts' (symbols, slots), in mini-batches with shared noise and adaptive rates."""
        rng, inner_rng = np.random.default_rng(11), np.random.default_rng(12)  # so symbols learn alike, whatever the classes draw
        cumulative, log_noise = np.cumsum(self.unigram), np.log(NOISE * self.unigram)
        squares, held, size, total = [np.full(x.shape, 1e-2) for x in self.p], [], 0, 0
        for s, slots in streams:
            held.append(np.stack((np.concatenate(([END, END], s)), np.concatenate(([-1, -1], slots)))))
            size += len(s)
            if size >= 8 * BATCH:
                total += self._epoch(held, rng, cumulative, log_noise, squares, inner and inner_rng)
                held, size = [], 0
        if held:
            total += self._epoch(held, rng, cumulative, log_noise, squares, inner and inner_rng)
        return total

    def _epoch(self, held, rng, cumulative, log_noise, squares, inner) -> int:
        grams = np.concatenate([np.stack((s[0, :-2], s[0, 1:-1], s[0, 2:], s[1, 2:])) for s in held], axis=1)
        grams = grams.take(rng.permutation(grams.shape[1]), axis=1)
        for at in range(0, grams.shape[1], BATCH):
            a, b, w, slots = grams[:, at : at + BATCH]
            r, ma, mb, v, c = self.p[:5]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), SYMBOLS - 1)
            q, own = (r @ ma).take(a, axis=0) + (r @ mb).take(b, axis=0), v.take(w, axis=0)
            single = q.astype(np.float32)
            up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) + (c - log_noise)[w]))
            down = single @ (-v[noise].T).astype(np.float32) - (c[noise] - log_noise[noise]).astype(np.float32)
            np.exp(down, out=down)  # single precision, in place: it is most of the arithmetic
            down += 1
            np.divide(-1, down, out=down)
            own *= up[:, None]
            own += down @ v[noise].astype(np.float32)
            q *= up[:, None]
            dv, dc = scatter(w, q, SYMBOLS), np.bincount(w, up, SYMBOLS)
            np.add.at(dv, noise, down.T @ single)
            np.add.at(dc, noise, down.sum(axis=0))
            da, db = scatter(a, own, SYMBOLS), scatter(b, own, SYMBOLS)
            for i, g in enumerate((da @ ma.T + db @ mb.T, r.T @ da, r.T @ db, dv, dc)):
                g = g / len(w)
                squares[i] += g * g
                self.p[i] = self.p[i] + RATE * g / np.sqrt(squares[i])
            if inner and len(rare := np.flatnonzero(slots >= 0)):
                self._inner(b[rare], slots[rare], inner, squares)
        return grams.shape[1]

    def _inner(self, b, slots, rng, squares) -> None:
        """One step for words of classes: noise is drawn from a class by count, and up to SHARING of its words share it."""
        i, u, d = self.p[5:]
        owner = self.slot_class[slots]
        order = np.argsort(owner.astype(np.uint8), kind="stable")
        b, slots, owner = b[order], slots[order], owner[order]
        counts = np.bincount(owner, minlength=CLASSES)
        blocks = -(-counts // SHARING)
        own = np.repeat(np.arange(CLASSES), blocks)  # class of each block
        place = (np.cumsum(blocks) - blocks)[owner] * SHARING + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        low, high = self.sums[self.starts[:-1]], self.sums[self.starts[1:]]
        drawn = np.searchsorted(self.sums, low[own, None] + rng.random((len(own), INNER_NOISE)) * (high - low)[own, None], "right") - 1
        drawn = np.clip(drawn, self.starts[own][:, None], self.starts[own + 1][:, None] - 1)
        offset = d - self.log_inner
        q, v = i.take(b, axis=0), u.take(slots, axis=0)
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, v) + offset[slots]))
        # Contexts by block, zeros in free places; noise by block.
        source = np.full(len(own) * SHARING, len(q))
        source[place] = np.arange(len(q))
        shared = np.concatenate((q, np.zeros((1, DIMENSION)))).astype(np.float32).take(source, axis=0).reshape(len(own), SHARING, DIMENSION)
        noise = u.take(drawn, axis=0).astype(np.float32)
        down = shared @ noise.swapaxes(1, 2)
        down += offset[drawn].astype(np.float32)[:, None]
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        down.reshape(-1, INNER_NOISE)[source == len(q)] = 0
        at = np.concatenate((slots, drawn.ravel()))
        met = np.zeros(len(self.slot_mass), bool)
        met[at] = True
        rows = np.flatnonzero(met)
        number = np.empty(len(met), np.int64)
        number[rows] = np.arange(len(rows))
        at = number[at]
        q *= up[:, None]
        v *= up[:, None]
        v += (down @ noise).reshape(-1, DIMENSION).take(place, axis=0)
        di = scatter(b, v, SYMBOLS)
        dv = scatter(at, np.concatenate((q, (down.swapaxes(1, 2) @ shared).reshape(-1, DIMENSION))), len(rows))
        dd = np.bincount(at, np.concatenate((up, down.sum(axis=1).ravel())), len(rows))
        for k, g, where in ((5, di, np.arange(SYMBOLS)), (6, dv, rows), (7, dd, rows)):
            g /= len(b)
            total = squares[k].take(where, axis=0)
            total += g * g
            squares[k][where] = total
            g *= RATE
            g /= np.sqrt(total, out=total)
            g += self.p[k].take(where, axis=0)
            self.p[k][where] = g


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n rows."""
    cells = np.arange(n * DIMENSION).reshape(n, DIMENSION).take(rows, axis=0)
    return np.bincount(cells.ravel(), values.ravel(), n * DIMENSION).reshape(n, DIMENSION)


class Scorer:
    """Vocabulary and model, and the model's tables, which a worker makes once for all its tasks."""

    def __init__(self, vocabulary: Vocabulary, model: Model):
        self.vocabulary, self.model = vocabulary, model

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.model.table(), self.model.inner_table()

    def score(self, data: bytes | None) -> tuple[int, int, float, float, list[bytes]]:
        """Of a text: words, those of the head, base score but for the end's count and the counts of the words that the head
        lacks, score but for the latter, and these words."""
        vocabulary, (table, inner) = self.vocabulary, self.tables
        symbols, slots, places, rare = vocabulary.read(data)
        within = np.flatnonzero(slots >= 0)
        ends = np.concatenate(([END, END], symbols, [END]))
        lacking = places < 0
        known = places[~lacking]
        score = float(table[ends[:-2], ends[1:-1], ends[2:]].sum(dtype=np.float64))
        score += float(inner[ends[1:-2][within], slots[within]].sum(dtype=np.float64)) + float(vocabulary.own[known].sum())
        score -= float(vocabulary.log_rest[symbols[lacking] - (SYMBOLS - CLASSES)].sum())
        base = float(vocabulary.log_count[known].sum()) - (len(places) + 1) * math.log10(vocabulary.n + vocabulary.v + 1)
        return len(places), len(known), base, score, rare


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of the column ``text``; the end is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for data in common.as_bytes(b.column(0)):
                found.update((data or b"").lower().split())
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        yield out()

    return common.map_batches(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> tuple[Vocabulary, Model, DataFrame]:
    """From all rows of (text, part): vocabulary, trained model, and the table of all counts."""
    spark = rows.sparkSession
    counts = common.checkpoint(word_counts(rows))
    ends = rows.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The head: all words from the lowest count on at which they are HEAD or fewer, found from a histogram of a few
    # hundred rows; a sorted limit would bring HEAD rows of every task to the driver.
    level = F.floor(F.log2("n") * 8)
    floor, room = None, HEAD
    for k, size in sorted(map(tuple, counts.groupBy(level.alias("k")).agg(F.count(F.lit(1))).collect()), reverse=True):
        room -= size
        if room < 0:
            break
        floor = k
    found = [] if floor is None else counts.where(level >= floor).collect()  # HEAD rows at most
    head = sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))
    held = spark.sparkContext.broadcast({w for w, _ in head[: SYMBOLS - CLASSES - 1]})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, times = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in held.value:
                    mass[k := word_class(w)] += c + 1
                    times[k] += c
        yield pa.RecordBatch.from_arrays([pa.array(range(SYMBOLS), pa.int32()), pa.array(mass), pa.array(times)], ["k", "mass", "times"])

    weighed = common.map_batches(counts, weigh, "k int, mass long, times long").groupBy("k").agg(F.sum("mass"), F.sum("times")).collect()
    vocabulary = Vocabulary(head, {k: m for k, m, _ in weighed}, n + ends, v + (ends > 0), ends)
    unigram = np.ones(SYMBOLS)
    unigram[END] += ends
    for i, (_, c) in enumerate(head[: SYMBOLS - CLASSES - 1]):
        unigram[i + 1] += c
    for k, _, t in weighed:
        unigram[k] += t
    model = Model(unigram / unigram.sum(), vocabulary.slot_class, vocabulary.slot_mass)
    words = spark.sparkContext.broadcast(vocabulary)
    for turn, parts in enumerate(ROUNDS):
        start, inner = spark.sparkContext.broadcast(model), turn in INNER_ROUNDS

        def learn(batches: Iterator[pa.RecordBatch], start=start, inner=inner) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(start.value)
            total = own.train((tuple(np.append(x, e) for x, e in zip(words.value.read(d)[:2], (END, -1))) for b in batches for d in common.as_bytes(b.column(0))), inner)
            if total:
                yield average([(own.flat(inner), total)], TaskContext.get().partitionId())

        trained = common.checkpoint(common.map_batches(rows.where(F.col("part").isin(*parts)).select("text"), learn, "grp long, weights binary, n long"))
        while trained.count() > FAN_IN:

            def merge(pdf):
                return average([(np.frombuffer(w, np.float32), n) for w, n in zip(pdf["weights"], pdf["n"])], int(pdf["grp"].iloc[0]) // FAN_IN).to_pandas()

            trained = common.checkpoint(trained.groupBy(F.floor(F.col("grp") / FAN_IN)).applyInPandas(merge, trained.schema))
        got = sorted((r["grp"], r["weights"], r["n"]) for r in trained.collect())
        if got:
            model = model.with_weights(np.average([np.frombuffer(w, np.float32) for _, w, _ in got], axis=0, weights=[k for *_, k in got]))
    return vocabulary, model, counts


def average(found: list[tuple[np.ndarray, int]], grp: int) -> pa.RecordBatch:
    total = sum(n for _, n in found)
    mean = sum(w * (n / total) for w, n in found)
    return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([total], pa.int64())], ["grp", "weights", "n"])


def scores(docs: DataFrame, held_out: Column, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts for which ``held_out`` (over the
    column ``id``) is false are learned from; ``part`` deals them into 8 parts for the rounds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out)
    vocabulary, model, counts = fit(rows.where(~F.col("held_out")).select("text", part.alias("part")))
    held = spark.sparkContext.broadcast(Scorer(vocabulary, model))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each rare word of it; the key of the former is no word."""
        scorer = held.value
        end_known = scorer.vocabulary.n > 0
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts: list[tuple] = []
            owners, words, times = [], [], []
            for data in common.as_bytes(b.column(1)):
                size, met, base, score, rare = scorer.score(data)
                texts.append((row, f" {row}".encode(), 1, size + 1, base, score, met + end_known))
                if rare:
                    found = Counter(rare)
                    owners.append(np.full(len(found), row))
                    words.extend(found)
                    times.extend(found.values())
                row += 1
            rows, keys, ones, sizes, bases, found, knowns = zip(*texts) if texts else [()] * 7
            of_words = (np.concatenate([np.empty(0, np.int64), *owners]), None, words, times, None, None, None, None, None)
            of_texts = (rows, b.column(0), keys, ones, b.column(2), sizes, bases, found, knowns)
            kinds = (pa.int64(), b.column(0).type, pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            both = [(x if isinstance(x, pa.Array) else pa.array(x, k), pa.nulls(len(words), k) if y is None else pa.array(y, k)) for x, y, k in zip(of_texts, of_words, kinds)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in both], names)

    names = ["row", "id", "word", "k", "held_out", "n_tokens", "fixed", "score", "known"]
    found = common.map_batches(rows, run, f"row long, id {kind}, word binary, k long, held_out boolean, n_tokens long, fixed double, score double, known long")
    ends = math.log10(1 + vocabulary.ends)  # each text has one end
    met = found.join(counts, "word", "left").select("row", "id", "held_out", "n_tokens", "fixed", "score", "known", F.when(F.col("id").isNull() & F.col("n_tokens").isNull(), F.col("k")).alias("k"), F.coalesce("n", F.lit(0)).alias("n"))
    share = F.sum(F.coalesce(F.col("k"), F.lit(0)) * F.log10(F.col("n") + F.lit(1.0)))
    per = met.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("n") > 0, F.coalesce("k", F.lit(0))).otherwise(0))).alias("n_known"),
        (F.max("fixed") + share).alias("fixed"),
        (F.max("score") + share).alias("score"),
    )
    return per.select("id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("fixed") + F.lit(ends)).alias("base_score"), "score")

