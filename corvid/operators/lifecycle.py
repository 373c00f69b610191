"""Versions, retention, deletes and statistics of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame) -> DataFrame:
    """Highest active version of each document."""
    w = Window.partitionBy("document_id").orderBy(F.desc("version_num"))
    return versions.where("status = 'active'").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def add_versions(versions: DataFrame, incoming: DataFrame, replace: bool = True) -> DataFrame:
    """incoming (document_id, content_hash, at): unchanged hashes are skipped, others get the next number; under
    ``replace`` the versions before are superseded."""
    now = latest(versions).select("document_id", F.col("version_num").alias("last"), F.col("content_hash").alias("old"))
    fresh = incoming.join(now, "document_id", "left").where("old is null or old <> content_hash")
    new = fresh.select("document_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version_num"), "content_hash", "at", F.lit("active").alias("status"))
    changed = new.select("document_id").withColumn("changed", F.lit(True))
    kept = versions.join(changed, "document_id", "left") if replace else versions.withColumn("changed", F.lit(None).cast("boolean"))
    kept = kept.withColumn("status", F.when(F.col("changed") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))).drop("changed")
    return kept.select(*new.columns).unionByName(new)


def expired(versions: DataFrame, days: Column, now: Column) -> DataFrame:
    """Superseded versions older than the policy's days, and whether they are the document's last that isn't deleted."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400)
    alive = F.count_if(F.col("status") != "deleted").over(Window.partitionBy("document_id"))
    return versions.withColumn("alive", alive).where((F.col("status") == "superseded") & (age >= days)).select("document_id", "version_num", age.alias("age_days"), (F.col("alive") == 1).alias("is_last"))


def cascade_delete(table: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a store without those of the deleted sources."""
    return table.join(gone.select(*on).distinct(), on, "left_anti")


def source_counts(chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """Distinct non-empty sources of each collection, 0 for those that only exist by name."""
    n = chunks.where("source_uri <> ''").groupBy("collection_id").agg(F.countDistinct("source_uri").alias("n_sources"))
    return collections.select("collection_id").distinct().join(n, "collection_id", "left").select("collection_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def classified(incoming: DataFrame, versions: DataFrame, force: bool = False) -> DataFrame:
    """incoming (document_id, content_hash) with ``change``: new, unchanged (to be skipped) or changed (to be replaced), by the latest
    active version; with ``force`` what is unchanged is changed."""
    now = latest(versions).select("document_id", F.col("content_hash").alias("old"), "version_num")
    change = F.when(F.col("old").isNull(), "new").when((F.col("old") == F.col("content_hash")) & ~F.lit(force), "unchanged").otherwise("changed")
    met = incoming.join(now, "document_id", "left")
    return met.select(*incoming.columns, change.alias("change"), (F.coalesce("version_num", F.lit(0)) + F.when(change == "unchanged", 0).otherwise(1)).cast("int").alias("version_num"))


def documents_newest_first(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document of sources (document_id, source_uri, collection_id) with its last ``at``, number of versions and place, the newest
    first, of equal ones by source."""
    per = versions.groupBy("document_id").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n_versions"))
    return per.join(sources, "document_id").withColumn("place", F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("at"), "source_uri")))


def collected(versions: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """What retention removes: superseded versions older than the days of their collection's policy (collection_id, policy, days), if that
    is "retention"; ``is_last``: no other version of the document is left that is not deleted, so tree and graph go too."""
    met = versions.join(policies.where("policy = 'retention'").select("collection_id", "days"), "collection_id")
    return expired(met, F.col("days"), now)


def submissions(requests: DataFrame) -> DataFrame:
    """requests (key, hash, at, id) in order by key: the first of a key is accepted, a later one of the same hash is the same submission
    (existing), one of another hash a conflict. ``operation`` is the first one's id."""
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.struct("id", "hash")).over(w)
    met = requests.withColumn("f", first)
    outcome = F.when(F.col("f.id") == F.col("id"), "accepted").when(F.col("f.hash").eqNullSafe(F.col("hash")), "existing").otherwise("conflict")
    return met.select("key", "id", F.col("f.id").alias("operation"), outcome.alias("outcome"))


#: Stages without which an ingestion has failed.
CORE = ("load", "preprocess", "vector_chunk", "lexical_chunk", "graph_chunk", "tree_chunk", "embed", "vector_write", "lexical_write")


def progress(stages: DataFrame) -> DataFrame:
    """stages (operation_id, stage, success, duration_ms): status of each operation: failed with a core stage, partial_success with another,
    else success; the failed stages in order, and the time of all."""
    bad = ~F.col("success")
    per = stages.groupBy("operation_id").agg(F.array_sort(F.collect_set(F.when(bad, F.col("stage")))).alias("failed"), F.count_if(bad & F.col("stage").isin(*CORE)).alias("core"), F.sum("duration_ms").alias("duration_ms"))
    status = F.when(F.col("core") > 0, "failed").when(F.size("failed") > 0, "partial_success").otherwise("success")
    return per.select("operation_id", status.alias("status"), "failed", "duration_ms")


#: Attempts after the first, and seconds of the first and the longest delay.
RETRIES, BASE_S, LONGEST_S = 3, 1.0, 30.0


def retry_bound(attempt: Column, base: float = BASE_S, longest: float = LONGEST_S) -> Column:
    """The longest delay before an attempt (0: the first retry); full jitter draws evenly from 0 to it."""
    return F.least(F.lit(longest), F.lit(base) * F.pow(F.lit(2.0), attempt))


def retried(call, attempts: int = RETRIES, base: float = BASE_S, longest: float = LONGEST_S, sleep=None, random=None):
    """``call()`` again after an exception, with full jitter; the last exception is raised."""
    import random as source
    import time

    for n in range(attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            (sleep or time.sleep)((random or source.random)() * min(longest, base * 2**n))


class Experiments:
    """Champion and challenger configurations of collections, at most one active experiment each; a small table of the driver's."""

    def __init__(self):
        self.rows: dict[str, dict] = {}
        self.configs: dict[str, object] = {}

    def start(self, experiment: str, collection: str, challenger) -> bool:
        """False if the collection has an experiment that is not closed, or the name is taken."""
        if experiment in self.rows or any(r["collection"] == collection and r["status"] != "closed" for r in self.rows.values()):
            return False
        self.rows[experiment] = {"collection": collection, "challenger": challenger, "status": "running", "shadow": f"{collection}__shadow_{experiment}"}
        return True

    def measure(self, experiment: str, samples: int, champion: float, challenger: float) -> str:
        from corvid.operators.verification import MIN_GAIN, MIN_SAMPLES

        row = self.rows[experiment]
        if row["status"] == "closed":
            raise ValueError(f"experiment {experiment} is closed")
        if samples >= MIN_SAMPLES and challenger > champion + MIN_GAIN:
            row["status"] = "ready_to_promote"
        return row["status"]

    def promote(self, experiment: str) -> None:
        row = self.rows[experiment]
        if row["status"] != "ready_to_promote":
            raise ValueError(f"experiment {experiment} is {row['status']}")
        self.configs[row["collection"]] = row["challenger"]
        row["status"] = "closed"

    def abandon(self, experiment: str) -> None:
        self.rows[experiment]["status"] = "closed"

    def active(self) -> list[str]:
        return sorted(k for k, r in self.rows.items() if r["status"] != "closed")


class Sources:
    """Configured ingestion sources by unique id."""

    def __init__(self):
        self.rows: dict[str, dict] = {}

    def create(self, source: str, **config) -> None:
        if source in self.rows:
            raise ValueError(f"source {source} exists")
        self.rows[source] = config

    def delete(self, source: str) -> None:
        if source not in self.rows:
            raise KeyError(source)
        del self.rows[source]

    def list(self) -> list[str]:
        return sorted(self.rows)
