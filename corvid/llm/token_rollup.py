"""Token totals kept up to date by deltas.

A change is an insert, a delete or a revised count of one document under one tokenizer version; it becomes signed rows,
and a batch of changes becomes one small table of sums by source, language and version. Sums are additive, so totals
are the sum over all committed batches and no old row is ever read again.

A batch's sums are written aside, and committed by creating a small marker, named by the hash of the batch's id, that
tells where they are. Creating never overwrites, so of writers that send the same batch one commits and the others are told
so, and a batch that is sent again changes nothing. A marker that a dying writer left unfinished does not count as
committed; who sends the batch again after ``STALE_S`` seconds completes it.

Compaction writes the sum of the batches that it has seen, and then a fold, one more marker that names them and the sum: from
then on readers take the latest fold and the batches that it does not name. A batch that is committed meanwhile is not named
and counts by itself, and a compaction that dies leaves nothing that counts. Files of folded batches stay until the next
fold, for readers that began before.

Defined results: a null source, language or version is a group of its own; a null text has no tokens; a null count is 0;
repeated change rows each count (changes are events, batches are the unit that is idempotent); an empty batch commits
and changes nothing; totals without documents and tokens are left out; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import common

#: Where the vocabulary is and how it cuts text before merging (fixed values of that public vocabulary).
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


#: Seconds after which an unfinished marker is taken over.
STALE_S = 60


class Rollup:
    """A folder of committed batches. Any number of drivers may write and compact."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("batches", "folds"):
            self.fs.mkdirs(self.path(f"{self.root}/{name}"))

    def _marks(self, kind: str) -> dict[str, dict]:
        """Finished markers by name."""
        out = {}
        for x in self.fs.listStatus(self.path(f"{self.root}/{kind}")):
            if (found := self._mark(x.getPath())) is not None:
                out[x.getPath().getName()] = found
        return out

    def _mark(self, path) -> dict | None:
        try:
            stream = self.fs.open(path)
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            finally:
                stream.close()
        except (ValueError, Py4JJavaError):  # unfinished, or gone since it was listed
            return None

    def _create(self, name: str, content: dict, over: bool = False) -> bool:
        path = self.path(f"{self.root}/{name}")
        try:
            out = self.fs.create(path, over)
        except Py4JJavaError:
            if self.fs.exists(path):
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def _state(self) -> tuple[dict | None, dict[str, dict]]:
        """The latest fold, and the batches that it does not name."""
        batches = self._marks("batches")  # before the folds: a batch that is folded meanwhile is seen in one of them
        folds = self._marks("folds")
        fold = folds[max(folds)] if folds else None
        named = set(fold["batches"]) if fold else set()
        return fold, {k: v for k, v in batches.items() if k not in named}

    def committed(self) -> list[str]:
        return sorted(x["id"] for x in self._marks("batches").values())

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add signed rows (KEYS, n_docs, n_tokens) as one batch; False if that batch was there already."""
        if not batch_id:
            raise ValueError("a batch id is not empty")
        name = f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"
        mark = self.path(f"{self.root}/{name}")
        if self._mark(mark) is not None:
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        data = uuid.uuid4().hex
        sums.coalesce(1).write.parquet(f"{self.root}/data/{data}")  # a row for each group, however large the batch
        content = {"id": batch_id, "data": data}
        done = self._create(name, content)
        if not done and self._mark(mark) is None and time.time() - self.fs.getFileStatus(mark).getModificationTime() / 1000 > STALE_S:
            done = self._create(name, content, over=True)
        if not done:
            self.fs.delete(self.path(f"{self.root}/data/{data}"), True)
        return done

    def _sums(self, folders: list[str]) -> DataFrame:
        names = [f"{self.root}/data/{x}" for x in folders]
        rows = self.spark.read.schema(SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        fold, batches = self._state()
        folders = [x["data"] for x in ([fold] if fold else [])] + sorted(x["data"] for x in batches.values())
        return self._sums(folders).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Folds all batches into one; False if there is nothing to fold or another compaction was first."""
        folds = sorted(self._marks("folds"))
        fold, batches = self._state()
        if len(batches) + (fold is not None) < 2:
            return False
        data, old = uuid.uuid4().hex, [x["data"] for x in [*([fold] if fold else []), *batches.values()]]
        self._sums(old).coalesce(1).write.parquet(f"{self.root}/data/{data}")
        number = int(folds[-1]) + 1 if folds else 0
        if not self._create(f"folds/{number:012d}", {"batches": sorted([*(fold["batches"] if fold else []), *batches]), "data": data, "old": old}):
            self.fs.delete(self.path(f"{self.root}/data/{data}"), True)
            return False
        for x in fold["old"] if fold else []:
            self.fs.delete(self.path(f"{self.root}/data/{x}"), True)
        return True


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows for new counts (KEYS, n_tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Signed rows for counts that replace others (KEYS, old_version, old_tokens, n_tokens)."""
    old = F.struct("source", "lang", F.col("old_version").alias("tokenizer_version"), F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"))
    new = F.struct("source", "lang", "tokenizer_version", F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return counts.select(F.inline(F.array(old, new)))


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def token_counts(docs: DataFrame, version: str = "byte_bpe_50k", ranks_path: str = RANKS_PATH, text_col: str = "text") -> DataFrame:
    """Per row: source, lang, tokenizer_version, n_tokens of the whole text, n_words."""
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _ENCODINGS:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
            _ENCODINGS[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = _ENCODINGS[version].encode_ordinary
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            n = pa.array([len(count(t)) for t in texts], pa.int64())
            words = pa.array([len(t.encode().split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([version] * len(texts)), n, words], [*KEYS, "n_tokens", "n_words"])

    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, run, "source string, lang string, tokenizer_version string, n_tokens long, n_words long")
