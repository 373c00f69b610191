"""Chunkers: each turns (doc_id, text) into chunks with exact UTF-8 byte offsets; a chunk's text is that slice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalar import trim_unicode

SCHEMA = "doc_id long, pos int, start long, end long, text string"


#: Blocks that one piece of a text holds: offsets are summed within a piece and over pieces, never over a whole text at once.
PIECE = 256


def fixed(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of ``size`` characters, each trimmed; the first that reaches the end is the last. Pure expressions.

    The text is cut once into blocks of ``size - overlap`` characters; a window is a block and the characters after it, and
    its offset the sum of the bytes of the blocks before, so a text costs time in proportion to its length. A null or empty
    text has no chunk; repeated rows have theirs each; other columns are not read."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and larger than the overlap")
    step = size - overlap
    cut = lambda text, n: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    ahead = lambda parts, i, n, wide: F.substring(F.array_join(F.slice(parts, i + 2, -(-n // wide)), ""), 1, n)  # noqa: E731  the n characters after part i
    wide, none = step * PIECE, F.array().cast("array<struct<piece:string,ahead:string,at:bigint,pos:int>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    numbered = F.transform(F.col("pieces"), lambda p, i: F.struct(p.alias("piece"), ahead(F.col("pieces"), i, size, wide).alias("ahead"), (i * PIECE).cast("int").alias("pos")))
    summed = F.aggregate(
        numbered,
        state,
        lambda s, x: F.struct((s["at"] + F.octet_length(x["piece"])).alias("at"), F.concat(s["out"], F.array(F.struct(x["piece"].alias("piece"), x["ahead"].alias("ahead"), s["at"].alias("at"), x["pos"].alias("pos")))).alias("out")),
    )["out"]
    w = docs.select("doc_id", cut(F.col("text"), wide).alias("pieces")).select("doc_id", F.inline(summed))
    w = w.withColumn("blocks", cut(F.concat("piece", "ahead"), step)).withColumn("own", F.ceil(F.length("piece") / step).cast("int"))
    w = w.withColumn("sizes", F.transform("blocks", lambda b: F.octet_length(b)))
    row = lambda b, j: F.struct(
        (F.col("pos") + j).alias("pos"),
        (F.col("at") + F.aggregate(F.slice("sizes", 1, j), F.lit(0).cast("long"), lambda s, x: s + x)).alias("at"),
        F.substring(F.array_join(F.slice("blocks", j + 1, -(-size // step)), ""), 1, size).alias("raw"),
    )
    w = w.select("doc_id", F.inline(F.transform(F.slice("blocks", 1, F.col("own")), row)))
    w = w.where((F.col("pos") == 0) | (F.length("raw") > overlap))  # else the window before reached the end
    w = w.withColumn("cut", trim_unicode(F.col("raw"))).where("cut <> ''")
    start = F.col("at") + F.octet_length("raw") - F.octet_length(trim_unicode(F.col("raw"), "left"))
    return w.select("doc_id", "pos", start.alias("start"), (start + F.octet_length("cut")).alias("end"), F.col("cut").alias("text"))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _bytes(x: str) -> int:
    return len(x.encode())


def sentences(text: str, max_bytes: int = 1000) -> Iterator[tuple[int, int]]:
    """Sentences (cut after . ! ?) packed greedily while they fit; a longer one stays whole."""
    start = end = used = 0
    for m in re.finditer(r"[^.!?]*[.!?]|[^.!?]+$", text):
        n = _bytes(m[0])
        if used and used + n > max_bytes:
            yield start, end
            start, used = m.start(), 0
        end, used = m.end(), used + n
    if end > start:
        yield start, end


def propositions(text: str) -> Iterator[tuple[int, int]]:
    for m in re.finditer(r"[^.!?\n]+", text):
        yield m.span()


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line), line.removesuffix("\r")
        at += len(line) + 1


def sections(text: str) -> Iterator[tuple[int, int]]:
    """Bodies of sections that headings of up to three # open; the text before the first is one, too."""
    start, titled, end = 0, False, 0
    for a, b, line in _lines(text):
        if re.match(r"#{1,3} ", line):
            if titled or text[start:a].strip():
                yield start, a
            start, titled = min(b + 1, len(text)), True
        end = b
    if titled or text[start:end].strip():
        yield start, max(start, end)


def structure(text: str, max_bytes: int = 2000) -> Iterator[tuple[int, int]]:
    """Fenced code and blocks of table rows stay whole; other lines are packed while they fit."""
    start = used = 0
    open_, fence = False, False
    end = 0
    for a, b, line in _lines(text):
        mark = line.lstrip().startswith("```")
        if mark and not fence:
            if open_:
                yield start, end
            start, open_, fence = a, True, True
        elif fence:
            end = b
            if mark:
                yield start, b
                open_, fence, used = False, False, 0
            continue
        elif open_ and used + _bytes(line) + 1 > max_bytes and not line.lstrip().startswith("|"):
            yield start, end
            start, used = a, _bytes(line) + 1
        else:
            if not open_:
                start, open_, used = a, True, 0
            used += _bytes(line) + 1
        end = b
    if open_ or not text:
        yield start, end


STRATEGIES: dict[str, Callable] = {"semantic": sentences, "propositional": propositions, "hierarchical": sections, "structure": structure}


def chunk(docs: DataFrame, strategy: str, **params: int) -> DataFrame:
    """Chunks by a named strategy; an unknown name or a limit below 1 is an error on the driver."""
    if strategy == "fixed":
        return fixed(docs, **params)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy: {strategy}")
    if any(v < 1 for v in params.values()):
        raise ValueError("limits must be positive")
    cut = STRATEGIES[strategy]
    keep_empty = strategy in ("hierarchical", "structure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, done, at = text or "", 0, 0
                for pos, (x, y) in enumerate(cut(text, **params)):
                    x, y = _trimmed(text, x, y)
                    if x == y and not keep_empty:
                        continue
                    at, done = at + _bytes(text[done:x]) if x >= done else _bytes(text[:x]), x
                    for column, value in zip(out, (doc, pos, at, at + _bytes(text[x:y]), text[x:y])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "pos", "start", "end", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


#: The lines that each cut documents by themselves.
BACKENDS = ("vector", "lexical", "graph", "tree")


def by_backend(docs: DataFrame, configs: dict[str, tuple[str, dict[str, int]] | None]) -> DataFrame:
    """Chunks of each backend by its own (strategy, parameters), with ``backend``; one without takes that of the vectors."""
    unknown = set(configs) - set(BACKENDS)
    if unknown:
        raise ValueError(f"unknown backend: {', '.join(sorted(unknown))}")
    out = None
    for backend, config in configs.items():
        strategy, params = config or configs.get("vector") or ("fixed", {})
        one = chunk(docs, strategy, **params).withColumn("backend", F.lit(backend))
        out = one if out is None else out.unionByName(one)
    return out


def inspect(chunks: DataFrame) -> DataFrame:
    """Per chunk: characters, estimated tokens, overlap in bytes with the chunk before it."""
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("pos"))
    return chunks.select("doc_id", "pos", F.length("text").alias("chars"), F.floor(F.length("text") / 4).alias("tokens"), F.greatest(F.coalesce(before - F.col("start"), F.lit(0)), F.lit(0)).alias("overlap"))
