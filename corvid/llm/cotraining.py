"""Quality classifier by co-training over two views of a document.

The text view sees statistics of the whole text, the metadata view only what is known about the document: source,
language and length. Each view is a logistic regression, first learned from labelled rows. Over ``ROUNDS`` rounds each
view labels the unlabelled pool, and the documents it is surest of (as many of each class as the classes' shares ask
for) join what the *other* view learns from. Each view is then calibrated on labelled rows that neither learned from,
and a document's score adds the views' calibrated log-odds, less the prior that both hold.

At most ``LABELLED`` labelled and ``POOL`` unlabelled rows, those of the smallest id hash, are learned from; all rows
are scored, one at a time.

Defined results: a null text is empty, null metadata is a value of its own; null labels and labels other than 0 and 1
are not learned from, nor ids that have both; where the rows learned from or those that calibrate lack a class, every score is the
mean label, 1 without any label; repeated rows score alike; an empty
table gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

LABELLED = 6000
POOL = 6000
ROUNDS = 4
#: Part of the pool that a view labels for the other in a round.
SHARE = 0.05
SOURCES = 64
TEXT_SIZE, META_SIZE = 11, SOURCES + 18
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_SYMBOL, _POINT = b"#*$%&|<>{}[]=_~^@\\/", b".,;:!?"


def text_view(data: bytes | None) -> list[float]:
    data = data or b""
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(data))
    share = lambda chosen: (len(data) - len(data.translate(None, chosen))) / chars
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n / 10,
        10 * share(_UPPER),
        10 * share(_DIGIT),
        10 * share(_SYMBOL),
        10 * share(_POINT),
        10 * share(b"!"),
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / max(1, len(lines))),
        float(len(words) < 50),
    ]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * META_SIZE
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32((lang or "").encode()) % 16] = 1.0
    out[SOURCES + 16] = math.log1p(max(0, n_chars or 0)) / 10
    out[SOURCES + 17] = float(n_chars is None or n_chars < 300)
    return out


class View:
    """Logistic regression by Newton steps, then two numbers that calibrate its log-odds."""

    def __init__(self):
        self.mean = self.scale = self.w = None
        self.a, self.b = 1.0, 0.0

    def learn(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w = _newton(np.column_stack(((x - self.mean) / self.scale, np.ones(len(x)))), y, ridge)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.raw(x)
        self.a, self.b = _newton(np.column_stack((z, np.ones(len(z)))), y, 1e-3)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w, n = np.zeros(x.shape[1]), len(x)
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + np.diag(penalty + 1e-9), x.T @ (p - y) / n + penalty * w)
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return w


class CoTrained:
    def __init__(self, constant: float):
        self.views, self.prior, self.constant = None, 0.0, constant

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.constant)
        z = self.views[0].log_odds(text) + self.views[1].log_odds(meta) - self.prior
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrates: np.ndarray) -> CoTrained:
    """y: 1, 0, or -1 where unlabelled."""
    known = (y >= 0) & ~calibrates
    if len(set(y[known])) < 2 or len(set(y[(y >= 0) & calibrates])) < 2:
        return CoTrained(float(y[y >= 0].mean()) if (y >= 0).any() else 1.0)
    x, pool = (text, meta), np.flatnonzero(y < 0)
    share = float(y[known].mean())
    own = [list(np.flatnonzero(known)), list(np.flatnonzero(known))]
    given = [y.copy(), y.copy()]
    views = [View(), View()]
    for turn in range(ROUNDS + 1):
        for k in (0, 1):
            views[k].learn(x[k][own[k]], given[k][own[k]].astype(float))
        if turn == ROUNDS:
            break
        for k in (0, 1):
            other = 1 - k
            free = pool[given[other][pool] < 0]
            z = views[k].raw(x[k][free])
            order = np.argsort(z, kind="stable")
            take = int(SHARE * len(pool))
            for chosen, label in ((order[len(order) - int(take * share) :] if int(take * share) else order[:0], 1), (order[: take - int(take * share)], 0)):
                sure = chosen[np.abs(z[chosen]) > 1.0]
                sure = sure[(z[sure] > 0) == bool(label)]
                given[other][free[sure]] = label
                own[other].extend(free[sure])
    model = CoTrained(share)
    held = (y >= 0) & calibrates
    for k in (0, 1):
        views[k].calibrate(x[k][held], y[held].astype(float))
    p = min(1 - 1e-6, max(1e-6, float(y[held].mean())))
    model.views, model.prior = views, math.log(p / (1 - p))
    return model


_VIEWS = "text array<double>, meta array<double>"


def _views(b: pa.RecordBatch) -> tuple[list, list]:
    texts = [text_view(x) for x in common.as_bytes(b.column(0))]
    return texts, [meta_view(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]


def _inputs(docs: DataFrame) -> list[Column]:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality") -> CoTrained:
    """``learn``: which labelled rows may be learned from, over the column ``id``."""
    marked = common.labelled(labels, "doc_id", label_col)
    marked = marked if learn is None else marked.where(learn)
    place = F.xxhash64("id")
    chosen = common.smallest(marked, place, LABELLED)
    known = labels.select(F.col("doc_id").alias("id")).distinct()
    # The pool is drawn before labelled ids are taken out, so that only its rows meet them.
    others = common.smallest(docs.select(F.col("doc_id").alias("id")).where("id is not null"), place, 2 * POOL).distinct().join(known, "id", "left_anti")
    pool = common.smallest(others, place, POOL).select("id", F.lit(-1).alias("y"))
    sample = chosen.unionByName(pool)  # at most LABELLED + POOL rows: it may be broadcast
    rows = docs.withColumn("id", F.col("doc_id")).select("id", *_inputs(docs)).join(F.broadcast(sample), "id")
    rows = rows.select("text", "source", "lang", "n_chars", "y", (F.pmod(place, F.lit(4)) == 3).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = _views(b)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.float64())), b.column(4), b.column(5)], ["text", "meta", "y", "c"])

    got = sorted((r["text"], r["meta"], r["y"], r["c"]) for r in common.map_batches(rows, run, f"{_VIEWS}, y int, c boolean").collect())
    text, meta = np.array([r[0] for r in got]).reshape(-1, TEXT_SIZE), np.array([r[1] for r in got]).reshape(-1, META_SIZE)
    return co_train(text, meta, np.array([r[2] for r in got], int), np.array([r[3] for r in got], bool))


def scores(docs: DataFrame, model: CoTrained) -> DataFrame:
    """id and score (probability of good quality) of every row of documents."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = _views(b)
            found = held.value.scores(np.array(text).reshape(-1, TEXT_SIZE), np.array(meta).reshape(-1, META_SIZE))
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(found, pa.float64())], ["id", "score"])

    return common.map_batches(docs.select(*_inputs(docs), F.col("doc_id").alias("id")), run, f"id {kind}, score double")
