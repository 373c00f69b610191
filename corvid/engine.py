"""The engine as methods that return DataFrames, and its configuration."""

from __future__ import annotations

import os
import tomllib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.scalar import embed
from corvid.operators import chunking, context, lifecycle, retrieval, search, stores, verification
from corvid.sources import documents
from corvid.sources.tables import Table


@dataclass(frozen=True)
class Config:
    """Defaults, then a TOML file, then environment variables CORVID_<NAME>."""

    environment: str = "development"
    store: str = "parquet"
    mode: str = "parallel"
    top_k: int = 10
    chunk_size: int = 512
    overlap: int = 64
    token_budget: int = 4000
    candidate_k: int = 50
    dedup_threshold: float = 0.95

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found: dict = {}
        if path:
            with open(path, "rb") as f:
                found |= tomllib.load(f)
        for name, value in (os.environ if env is None else env).items():
            if name.startswith("CORVID_"):
                found[name.removeprefix("CORVID_").lower()] = value
        unknown = set(found) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **{k: kinds[k](v) for k, v in found.items()}).checked()

    def checked(self) -> Config:
        if self.store == "sqlite" and self.environment != "development":
            raise ValueError("sqlite is for development only")
        if self.mode not in search.MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if not 0 < self.top_k or not 0 < self.candidate_k <= context.CANDIDATES or self.token_budget <= 0:
            raise ValueError("limits out of range")
        return self


CHUNKS = "collection_id string, source_uri string, document_id string, version_num int, chunk string, doc_id string, pos int, start long, end long, text string, vector array<double>, snapshot_uri string"
VERSIONS = "document_id string, version_num int, content_hash string, at timestamp, status string, source_uri string, collection_id string"


def not_blank(name: str, value: str | None) -> str:
    if value is None or not value.strip():
        raise ValueError(f"{name} must not be blank")
    return value


@dataclass
class Engine:
    """Ingestion, search, context, generation, verification and lifecycle over tables below ``root``, a shared folder."""

    spark: SparkSession
    root: str
    config: Config = field(default_factory=Config)

    @cached_property
    def chunks(self) -> Table:
        return Table(self.spark, f"{self.root}/chunks", CHUNKS, ("collection_id", "chunk"))

    @cached_property
    def versions(self) -> Table:
        return Table(self.spark, f"{self.root}/versions", VERSIONS, ("document_id", "version_num"))

    def _written(self, rows: DataFrame) -> DataFrame:
        """What a step has decided, in files, so that all that follows reads one and the same."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def ingest(self, docs: DataFrame, collection_id: str) -> DataFrame:
        """docs (source_uri, text): unchanged texts are skipped, changed ones replace their version. Returns (source_uri, change,
        version_num)."""
        not_blank("collection", collection_id)
        document = stores.chunk_id(F.lit(collection_id), F.col("source_uri"))
        rows = docs.where("source_uri <> ''").select("source_uri", "text", document.alias("document_id"), documents.content_hash(F.col("text")).alias("content_hash")).dropDuplicates(["document_id"])
        found = self._written(lifecycle.classified(rows.drop("text"), self.versions.read()))
        fresh = rows.join(found.where("change <> 'unchanged'").select("document_id", "version_num", "change"), "document_id")
        cut = chunking.fixed(fresh.select(F.col("document_id").alias("doc_id"), "text"), self.config.chunk_size, self.config.overlap)
        new = fresh.select(F.col("document_id").alias("doc_id"), F.lit(collection_id).alias("collection_id"), "source_uri", "version_num", F.concat(F.lit("snapshot://"), "document_id", F.lit("/"), "version_num").alias("snapshot_uri"))
        now = self.chunks.read()
        kept = now.join(fresh.select("document_id"), "document_id", "left_anti")
        added = stores.stamped(cut, new).withColumn("vector", embed(F.col("text"))).select(*now.columns)
        old = self.versions.read()
        changed = found.where("change <> 'unchanged'").select("document_id", "version_num", "content_hash", F.current_timestamp().alias("at"), F.lit("active").alias("status"), "source_uri", F.lit(collection_id).alias("collection_id"))
        met = old.join(changed.select("document_id").withColumn("replaced", F.lit(True)), "document_id", "left")
        status = F.when(F.col("replaced") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
        after = met.withColumn("status", status).select(*old.columns).unionByName(changed)
        # The versions come last: an ingestion that stops before is done again.
        self.chunks.replace(kept.unionByName(added))
        self.versions.replace(after)
        return found.select("source_uri", "change", "version_num")

    def _scope(self, collection_id: str, filters: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        return stores.scoped(self.chunks.read(), collection_id, filters)

    def strategies(self, collection_id: str, filters: Sequence[tuple[str, str, object]] = ()) -> dict[str, search.Strategy]:
        """Vectors and BM25. Statistics of BM25 are those of all collections, its hits those of one."""
        scope, all_chunks = self._scope(collection_id, filters), self.chunks.read()

        def vector(q: DataFrame, k: int) -> DataFrame:
            hits = retrieval.knn(scope.select(F.col("chunk").alias("vec_id"), F.col("vector").alias("embedding")), q.select("query_id", embed(F.col("text")).alias("q")), k)
            return hits.withColumnRenamed("vec_id", "chunk").join(scope.select("chunk", F.col("document_id").alias("doc_id")), "chunk")

        def bm25(q: DataFrame, k: int) -> DataFrame:
            hits = retrieval.bm25(all_chunks.select("doc_id", "pos", "text"), q, k, scope.select("doc_id", "pos"))
            return hits.join(scope.select("doc_id", "pos", "chunk"), ["doc_id", "pos"])

        return {"vector": vector, "bm25": bm25}

    def search(self, queries: DataFrame, collection_id: str, k: int | None = None, mode: str | None = None, filters: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
        """queries (query_id, text)."""
        registry = self._scope(collection_id).select("chunk", "source_uri", "version_num", "snapshot_uri", "start", "end", "text", "vector", F.col("document_id").alias("doc_id"))
        return search.search(queries, self.strategies(collection_id, filters), registry, k or self.config.top_k, mode or self.config.mode, threshold=self.config.dedup_threshold)

    def context(self, queries: DataFrame, collection_id: str, style: str = "xml") -> tuple[DataFrame, DataFrame]:
        """Passages and (query_id, rendered, used) of each query."""
        hits = self.search(queries, collection_id, self.config.candidate_k)
        passages = hits.select("query_id", F.col("chunk").alias("id"), F.col("doc_id").alias("doc"), F.col("source_uri").alias("uri"), F.col("version_num").alias("version"), "start", "end", "text", "score")
        none = passages.limit(0).select("query_id", "id", "text", "score")
        found, _, text = context.assembled(passages, none, self.config.token_budget, style)
        return found, text

    def generate(self, queries: DataFrame, collection_id: str, generator=None) -> DataFrame:
        """(query_id, answer, status) by a function of (query_id, ref, text); the default takes sentences of the passages."""
        passages, _ = self.context(queries, collection_id)
        met = queries.select("query_id").join(passages.select("query_id", "ref", "text"), "query_id", "left")
        return (generator or context.extractive)(met)

    def verify(self, answers: DataFrame, passages: DataFrame) -> DataFrame:
        """answers (answer_id, answer), passages (answer_id, ref): units with their citations, known and invalid."""
        units = verification.segment(answers)
        return units.join(verification.attribute(units, passages), ["answer_id", "unit"])

    def documents(self, collection_id: str) -> DataFrame:
        own = self.versions.read().where(F.col("collection_id") == collection_id)
        return lifecycle.documents_newest_first(own, own.select("document_id", "source_uri", "collection_id").distinct())

    def collections(self) -> DataFrame:
        return stores.collections(self.versions.read(), self.chunks.read())

    def stats(self) -> DataFrame:
        return stores.document_counts(self.chunks.read())

    def delete_source(self, collection_id: str, source_uri: str) -> None:
        for table in (self.chunks, self.versions):
            table.replace(stores.delete_source(table.read(), not_blank("collection", collection_id), not_blank("source", source_uri)))

    def gc(self, policies: DataFrame, now: Column | None = None) -> DataFrame:
        """Versions that retention removes; they are marked deleted and their chunks go."""
        gone = self._written(lifecycle.collected(self.versions.read(), policies, now if now is not None else F.current_timestamp()))
        keys = gone.select("document_id", "version_num")
        self.chunks.replace(self.chunks.read().join(keys, ["document_id", "version_num"], "left_anti"))
        old = self.versions.read()
        met = old.join(keys.withColumn("gone", F.lit(True)), ["document_id", "version_num"], "left")
        self.versions.replace(met.withColumn("status", F.when(F.col("gone"), "deleted").otherwise(F.col("status"))).select(*old.columns))
        return gone

    def evaluate(self, queries: DataFrame, relevant: DataFrame, collection_id: str, k: int = 5) -> DataFrame:
        """relevant (query_id, source_uri) against the distinct sources found, in order."""
        if not 1 <= k <= 100:
            raise ValueError("k must be 1 to 100")
        hits = self.search(queries, collection_id).select("query_id", F.col("source_uri").alias("item"), "rank")
        return retrieval.report(retrieval.metrics(hits, relevant.select("query_id", F.col("source_uri").alias("item")), k))
