"""What stores do, on tables: keyed upserts, deletes by source, collections and counts, the chunk registry, caches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """``table`` with ``incoming``: rows of the same keys are replaced (a null key is a key); of several new rows the last by
    ``order`` stays, or any without one. Old rows only meet keys, so nothing but keys is compared in the shuffle."""
    w = Window.partitionBy(*keys).orderBy((order if order is not None else F.lit(0)).desc())
    new = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    same = [table[k].eqNullSafe(incoming[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return table.join(incoming, on, "left_anti").unionByName(new.select(*table.columns))


def delete_source(table: DataFrame, collection_id: str, source_uri: str) -> DataFrame:
    """Without the rows of a source in a collection; an empty source deletes nothing."""
    if not source_uri:
        return table
    return table.where(~F.coalesce((F.col("collection_id") == collection_id) & (F.col("source_uri") == source_uri), F.lit(False)))


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each store without the rows of the sources ``gone`` (collection_id, source_uri), empty ones excepted; relations
    (store "relations": source, target) go with the entities (store "entities": node) that they touch."""
    which = gone.where("source_uri <> ''").select("collection_id", "source_uri").distinct()
    out = {name: t.join(which, ["collection_id", "source_uri"], "left_anti") for name, t in tables.items() if name != "relations"}
    if "relations" in tables and "entities" in tables:
        lost = tables["entities"].join(which, ["collection_id", "source_uri"], "left_semi").select("node").distinct()
        r = tables["relations"]
        for end in ("source", "target"):
            r = r.join(lost.withColumnRenamed("node", end), end, "left_anti")
        out["relations"] = r
    return out


def collections(created: DataFrame, *present: DataFrame) -> DataFrame:
    """collection_id of those created or present in a table, each once."""
    out = created.select("collection_id")
    for t in present:
        out = out.union(t.select("collection_id"))
    return out.where("collection_id is not null").distinct()


def document_counts(chunks: DataFrame) -> DataFrame:
    """Distinct non-empty sources of each collection, and under the null collection of all together."""
    named = chunks.where("source_uri <> ''").select("collection_id", "source_uri")
    each = named.groupBy("collection_id").agg(F.countDistinct("source_uri").alias("n_documents"))
    return each.unionByName(named.agg(F.lit(None).cast("string").alias("collection_id"), F.countDistinct("source_uri").alias("n_documents")))


#: Comparisons that a metadata filter may ask for.
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(True),
}


def scoped(chunks: DataFrame, collection_id: str | None, filters: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """Rows of a collection that pass all filters (column, comparison, value). A collection must be named; an empty list of
    values is no filter; a row whose column is null passes none."""
    if not collection_id:
        raise ValueError("a search needs a collection")
    out = chunks.where(F.col("collection_id") == collection_id)
    for column, how, value in filters:
        if how not in COMPARISONS:
            raise ValueError(f"unknown comparison: {how}")
        out = out.where(COMPARISONS[how](F.col(column), value))
    return out


def allowed(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """rows (user_id, collection_id, ...) that claims (user_id, is_admin, collections) allow: administrators may see all, others
    what their list has; an empty list or no claim denies."""
    met = rows.join(claims.select("user_id", "is_admin", "collections"), "user_id")
    return met.where(F.col("is_admin") | F.array_contains(F.coalesce("collections", F.array().cast("array<string>")), F.col("collection_id"))).drop("is_admin", "collections")


def chunk_id(*parts: Column) -> Column:
    """An id from what identifies a chunk, the same at each attempt."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def stamped(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """chunks (doc_id, pos, start, end, text) with collection, document, version and snapshot of versions (doc_id, collection_id,
    source_uri, version_num, snapshot_uri), and their chunk ids. ``error`` where there is no snapshot."""
    met = chunks.join(versions.select("doc_id", "collection_id", "source_uri", "version_num", "snapshot_uri"), "doc_id", "left")
    document = F.sha2(F.concat_ws("\x1f", "collection_id", "source_uri"), 256)
    error = F.when(F.coalesce("snapshot_uri", F.lit("")) == "", "no_snapshot")
    return met.withColumns({"document_id": document, "chunk": chunk_id(F.col("collection_id"), F.col("source_uri"), F.col("version_num"), F.col("pos")), "error": error})


def records(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Registry rows: chunks (doc_id, pos, start, end) with the slice ``text`` of docs (doc_id, text) that their bytes are,
    never a chunk's own, perhaps enriched text. ``error`` for spans outside the text or within a character; then no text."""
    met = chunks.drop("text").join(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")), "doc_id")
    size = F.octet_length("data")
    fits = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= size)
    inner = lambda at: F.coalesce(F.hex(F.substring("data", (at + 1).cast("int"), F.lit(1))).rlike("^[89AB]"), F.lit(False))  # noqa: E731  a byte that goes on a character
    error = F.when(~fits, "out_of_range").when(inner(F.col("start")) | inner(F.col("end")), "within_character")
    cut = F.substring("data", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return met.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.decode(cut, "UTF-8"))).drop("data")


def hydrated(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """hits (query_id, chunk, score, rank, ...) with the registry's columns; unknown chunks go, ranks stay as they are."""
    return hits.join(registry, "chunk")


def unresolved(hits: DataFrame, registry: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """How many hits of each ``by`` the registry does not know."""
    return hits.join(registry.select("chunk"), "chunk", "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n_unresolved"))


def hydrated_lists(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates of all lists (..., kind, chunk, text): a source gets the registry's text, and goes if it is unknown; a
    summary stays as it is."""
    met = candidates.join(registry.select("chunk", F.col("text").alias("own")), "chunk", "left")
    return met.where((F.col("kind") != "source") | F.col("own").isNotNull()).withColumn("text", F.when(F.col("kind") == "source", F.col("own")).otherwise(F.col("text"))).drop("own")


def citations(hits: DataFrame) -> DataFrame:
    """Citations of hits (chunk, source_uri, section, version_num, snapshot_uri, metadata map): provenance first, what the
    metadata say where it is missing; titles from metadata only; versions above 0 and snapshots that are not empty only."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    uri = F.coalesce(F.nullif(F.col("source_uri"), F.lit("")), meta("source_uri"), F.lit(""))
    given = {"source_uri": uri, "title": meta("title"), "section": F.coalesce("section", meta("section")), "version": F.when(F.col("version_num") > 0, F.col("version_num")), "snapshot_uri": F.nullif(F.col("snapshot_uri"), F.lit(""))}
    return hits.withColumns(given).drop("version_num", "metadata")


def query_key(text: Column, collection: Column, top_k: Column, filters: Column) -> Column:
    return F.concat_ws(":", text, collection, top_k, F.coalesce(filters, F.lit("[]")))


def embedding_key(text: Column, model: Column, dimension: Column) -> Column:
    return F.concat(F.lit("embed:"), F.sha2(text.cast("binary"), 256), F.lit(":"), model, F.lit(":"), dimension)


def cached(wanted: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """wanted (key, ...) with ``value`` and ``hit`` from cache (key, value, at): entries no older than the TTL, of several the
    newest. What is not hit is to be computed, all in one batch."""
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("at") <= ttl_seconds).groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return wanted.join(live, "key", "left").withColumn("hit", F.col("value").isNotNull())


def kept_in_cache(cache: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` entries; the oldest are evicted."""
    return cache.orderBy(F.desc("at"), "key").limit(size)


def invalidated(cache: DataFrame, collection_id: str) -> DataFrame:
    """Without entries whose key names the collection."""
    return cache.where(~F.contains("key", F.lit(collection_id)))


def newest(log: DataFrame, n: int, at: str = "at", then: str = "id") -> DataFrame:
    """The newest entries of a log; each task keeps n."""
    return log.orderBy(F.desc(at), F.desc(then)).limit(n)
