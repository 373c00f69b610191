"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Normal form: A-Z lower-cased; words are runs of 0-9, a-z and all code points above U+007F; one space between words.
A window is ``size`` consecutive words of an item, or the whole of a shorter item that has words. The automaton holds
each window once, with its items, and scans each text once; a hit's end gives its words, and those words' places in
the original text.

Benchmarks are taken to be small, but that is checked: an automaton takes some 400 bytes of memory a byte of item text, so
beyond ``SHARD_BYTES`` of item text the items are dealt to several automata by hash, and a chain of passes scans the texts
once for each; no worker holds more than one at a time, and the driver holds the text of one, while it is sent out.

Defined results: a null or empty text, or one without words, has no windows and no hits; items without words have no
window; items that repeat a window are all counted; an item without id is searched for like any other, and all such items
together are one null among a text's items, counted but without a name in their hash; repeated rows are judged alike; empty tables give no hits or no rows;
columns besides the named ones are not read by ``hits`` and are passed on unchanged by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

SIZE = 10
#: Text of items that one automaton holds.
SHARD_BYTES = 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEPT else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_NORMAL).split()


def ordered(items: set[str | None]) -> list[str | None]:
    """Sorted, the null last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def windows(items: list[tuple], size: int = SIZE) -> dict[str, list[str | None]]:
    """Window (with a space at both ends) to the ids of the items that have it."""
    found: dict[str, set[str | None]] = defaultdict(set)
    for item, text in items:
        w = words(text.encode() if text is not None else None)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found[f" {b' '.join(w[i : i + size]).decode('latin-1')} "].add(None if item is None else str(item))
    return {k: ordered(v) for k, v in found.items()}


_HELD: list = []


class Scanner:
    """The automaton; items travel as they are, and a worker makes it from their windows where it is first used."""

    def __init__(self, items: list[tuple], size: int = SIZE):
        self.items, self.size, self.found, self.automaton = items, size, None, None

    def __getstate__(self):
        return {"items": self.items, "size": self.size, "found": None, "automaton": None}

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans [first word, last word + 1) of the windows that occur, and the items that have them."""
        if self.found is None:
            self.found = windows(self.items, self.size)
        if self.automaton is None and self.found:
            if _HELD and _HELD[0] is not self:  # one automaton a worker
                _HELD.pop().automaton = None
            _HELD[:] = [self]
            self.automaton = ahocorasick.Automaton()
            for k, items in self.found.items():
                self.automaton.add_word(k, (k.count(" ") - 1, items))
            self.automaton.make_automaton()
        spans, items, ends = [], set(), None
        if self.found and w:
            for end, (n, own) in self.automaton.iter(f" {b' '.join(w).decode('latin-1')} "):
                if ends is None:
                    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
                last = int(np.searchsorted(ends, end)) + 1
                spans.append((last - n, last))
                items.update(own)
        return spans, items


def scanners(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> Iterator[Broadcast]:
    """An automaton's items for each shard, broadcast one after the other."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / SHARD_BYTES))
    for k in range(n):
        items = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]  # about SHARD_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(Scanner(items, size))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans in the original text of spans of words."""
    at = [m.span() for m in _WORD.finditer(data)] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted), spans (hit passages as byte offsets into the original text)."""
    shards = list(scanners(benchmark, size=size))
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.array().cast("array<bigint>").alias("ws"), F.array().cast("array<string>").alias("items"))
    kind = df.schema["id"].dataType.simpleString()
    for k, held in enumerate(shards):
        last = k == len(shards) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = common.as_bytes(b.column(1))
                found, n_words = [], []
                for data, ws, items in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist()):
                    w = words(data)
                    spans, own = held.value.scan(w)
                    found.append((covered([*zip(ws[::2], ws[1::2]), *spans]), ordered({*items, *own})))
                    n_words.append(len(w))
                items = pa.array([x[1] for x in found], pa.list_(pa.string()))
                if not last:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[y for s in x[0] for y in s] for x in found], pa.list_(pa.int64())), items], ["id", "text", "ws", "items"])
                    continue
                spans = pa.array([[{"start": s, "end": e} for s, e in original(data or b"", x[0])] for data, x in zip(texts, found)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array([sum(e - s for s, e in x[0]) for x in found], pa.int64()), items, spans], ["id", "n_words", "n_hit", "items", "spans"])

        df = common.map_batches(df, run, f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" if last else f"id {kind}, text string, ws array<long>, items array<string>")
        df = df if last else common.checkpoint(df)  # else the workers of all passes would stand side by side
    return df


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` without the rows in which a window occurs; all columns stay as they are."""
    at = docs.columns.index(text_col)
    for k, held in enumerate(scanners(benchmark, size=size)):
        docs = common.checkpoint(docs) if k else docs

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not held.value.scan(words(x))[0] for x in common.as_bytes(b.column(at))], pa.bool_()))

        docs = common.map_batches(docs, run, docs.schema)
    return docs


def items_sha256(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


__all__ = ["clean", "hits", "items_sha256"]
