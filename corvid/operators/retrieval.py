"""Retrieval strategies and fusion, many queries at once. The table in between is (query_id, strategy, doc_id, chunk, score)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalar import cosine, doubles, tokens
from corvid.operators import nearest
from corvid.session import written

K1, B, RRF_K = 1.2, 0.75, 60


def top(df: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their rank; Spark prunes to k rows a task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Pairs of a query and a term up to which queries travel to the tasks (a few dozen MB); more meet chunks in joins by term.
CARRIED = 1_000_000
#: Scores that a task holds at a time.
CELLS = 1 << 21
_TERM, _SPLIT = re.compile("[a-z0-9]+"), re.compile("[ \\t\\n\\r]+")


def _sparse(chunks: DataFrame, q: DataFrame, cut: Callable[[str], dict[str, int] | Counter], weigh: Callable[..., np.ndarray], k: int, scope: DataFrame | None) -> DataFrame:
    """(query_id, doc_id, pos, score), the best k of each query and task, of the sums over shared terms of ``weigh(number of chunks,
    chunks with the term, count in the chunk, length of the chunk, mean length)``; q (query_id, term) has at most ``CARRIED`` rows.

    Texts are read once: postings, a row of term numbers and counts for each chunk, are written to the shared folder. From them
    come the terms' document counts, and then each task scores its chunks against all queries as a sparse product, so neither a
    frequent term nor the number of pairs that share one ever meets a shuffle."""
    spark, got = q.sparkSession, q.toArrow().combine_chunks()
    names = got.column("query_id").combine_chunks() if got.num_rows else pa.array([], got.schema.field("query_id").type)
    # Numbers for queries by what their ids are written as, since not all types have a dictionary.
    _, first, of_query = np.unique(np.array(list(map(repr, names.to_pylist())), str), return_index=True, return_inverse=True)
    query_ids = names.take(pa.array(first, pa.int64()))
    terms, of_term = np.unique(np.array(got.column("term").to_pylist(), object), return_inverse=True)
    order = np.argsort(of_term, kind="stable")
    of_query, starts = of_query[order], np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    place = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms.tolist())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for b in batches:
            sizes, numbers, counts, ends = [], [], [], [0]
            for text in b.column(2).to_pylist():
                own = cut(text or "")
                kept = [(known[t], n) for t, n in own.items() if t in known]
                numbers += [t for t, _ in kept]
                counts += [n for _, n in kept]
                sizes.append(sum(own.values()))
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), *lists], ["doc_id", "pos", "dl", "terms", "tfs"])

    kinds = {f.name: f.dataType.simpleString() for f in chunks.select("doc_id", "pos").schema}
    held = written(chunks.select("doc_id", "pos", "text").mapInArrow(read, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, dl int, terms array<int>, tfs array<int>"))
    n, length = held.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = np.zeros(len(terms))
    for t, c in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as queries have terms
        df[t] = c
    weights = spark.sparkContext.broadcast((df, of_query, starts, query_ids))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, of_query, starts, query_ids = weights.value
        wide = max(1, CELLS // max(1, len(query_ids)))
        for whole in batches:
            whole = whole.take(pc.sort_indices(whole, sort_keys=[("doc_id", "ascending"), ("pos", "ascending")]))
            for at in range(0, whole.num_rows, wide):
                b = whole.slice(at, wide)
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column(3).offsets)))
                t, tf = np.asarray(b.column(3).flatten()), np.asarray(b.column(4).flatten()).astype(float)
                if not len(t):
                    continue
                s = weigh(n, df[t], tf, np.asarray(b.column(2))[row], length)
                each = starts[t + 1] - starts[t]
                # Each posting to all queries that have its term: their numbers stand in one run.
                run = np.repeat(starts[t] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                cells = np.bincount(of_query[run] * b.num_rows + np.repeat(row, each), np.repeat(s, each), len(query_ids) * b.num_rows).reshape(len(query_ids), b.num_rows)
                best = _first(-np.round(cells, 6), k)
                values = np.take_along_axis(cells, best, axis=1)
                query, column = np.nonzero(values > 0)
                chosen = pa.array(best[query, column])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), b.column(0).take(chosen), b.column(1).take(chosen), pa.array(values[query, column])], ["query_id", "doc_id", "pos", "score"])

    held = held if scope is None else held.join(scope.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").select(*held.columns)
    kind = q.schema["query_id"].dataType.simpleString()
    return held.mapInArrow(score, f"query_id {kind}, doc_id {kinds['doc_id']}, pos {kinds['pos']}, score double")


def _first(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each row, of equal ones the first; there may be more of the k-th."""
    if x.shape[1] <= 4 * k:
        return np.argsort(x, axis=1, kind="stable")[:, :k]
    bound = np.partition(x, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(x), k), np.int64)
    for i in range(len(x)):
        near = np.flatnonzero(x[i] <= bound[i])
        out[i] = near[np.argsort(x[i][near], kind="stable")[:k]]
    return out


def _okapi(n, df, tf, dl, length) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / length))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """chunks (doc_id, pos, text), queries (query_id, text). Terms are OR-ed; statistics are those of all chunks, hits those of
    ``scope`` (doc_id, pos) if it is given. More than ``CARRIED`` pairs of query and term go through ``bm25_joined``, which gives
    the same."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    if q.limit(CARRIED + 1).count() > CARRIED:
        return bm25_joined(chunks, queries, k, scope)
    found = _sparse(chunks, q, lambda text: Counter(_TERM.findall(text.lower())), _okapi, k, scope)
    return top(found.withColumn("score", F.round("score", 6)), k, F.desc("score"), "doc_id", "pos")


def bm25_joined(chunks: DataFrame, queries: DataFrame, k: int = 10, scope: DataFrame | None = None) -> DataFrame:
    """``bm25`` for any number of queries, by joins on terms. Occurrences of query terms are dealt out once, by chunk; counts and
    scores of a chunk need no further shuffle of their own."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    t = chunks.select("doc_id", "pos", tokens(F.col("text")).alias("ts"))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    # An outer explode: an inner one would have its input filtered by size first, and texts cut into terms once more for it.
    hits = t.select("doc_id", "pos", F.size("ts").alias("dl"), F.explode_outer("ts").alias("term")).join(q.select("term").distinct(), "term")
    tf = hits.repartition("doc_id", "pos").groupBy("doc_id", "pos", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q.join(df, "term").join(F.broadcast(stats)).select("query_id", "term", idf.alias("idf"), "avgdl")  # stats: one row
    tf = tf if scope is None else tf.join(scope.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
    s = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = tf.join(weights, "term").groupBy("query_id", "doc_id", "pos").agg(F.round(F.sum(s), 6).alias("score"))
    return top(found, k, F.desc("score"), "doc_id", "pos")


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """vectors (vec_id, embedding), queries (query_id, q): a stated query set against all rows. Every pair is compared, in blocks
    (see ``nearest``); the scores are those of ``cosine`` and ``l2_similarity``."""
    found = nearest.candidates(vectors.select("vec_id", F.col("embedding").alias("v"), F.lit(1.0).alias("divisor")), queries, k, metric)
    return top(found.select("query_id", "vec_id", F.round("score", 6).alias("score")), k, F.desc("score"), "vec_id")


def max_sim(query_tokens: Column, row_tokens: Column) -> Column:
    """Sum over the query's token vectors of the best cosine with a token vector of the row; 0 if a side has none."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(row_tokens, lambda t: cosine(q, t))))
    return F.when((F.size(query_tokens) > 0) & (F.size(row_tokens) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def late_interaction(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors (vec_id, embedding, tokens), queries (query_id, q, q_tokens): max(4k, 20) rows by cosine, then the k best by
    MaxSim; a row without token vectors keeps its cosine. Only candidates' ids are shuffled before their tokens are met."""
    found = knn(vectors, queries, max(4 * k, 20)).drop("rank")
    met = found.join(vectors.select("vec_id", "tokens"), "vec_id").join(queries.select("query_id", "q_tokens"), "query_id")
    score = F.when(F.size(F.coalesce("tokens", F.array())) > 0, max_sim(F.col("q_tokens"), F.col("tokens"))).otherwise(F.col("score"))
    return top(met.select("query_id", "vec_id", F.round(score, 6).alias("score")), k, F.desc("score"), "vec_id")


def distinct_hits(hits: DataFrame, threshold: float = 0.95) -> DataFrame:
    """hits (query_id, rank, item, text, vector) without those that resemble a better one that stays.

    In the order of rank, a hit stays unless its cosine with one that stays is ``threshold`` or more; where one of two has
    no vector, equal texts resemble. A query's hits are few: the k of the search before."""
    one = F.array_sort(F.collect_list(F.struct("rank", "item", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(doubles(F.col("vector")), F.array().cast("array<double>")).alias("vector"))))
    grouped = hits.groupBy("query_id").agg(one.alias("hits"))
    alike = lambda a, b: F.when((F.size(a["vector"]) == 0) | (F.size(b["vector"]) == 0), a["text"] == b["text"]).otherwise(cosine(a["vector"], b["vector"]) >= threshold)
    none = F.slice(F.col("hits"), 1, 0)
    kept = F.aggregate("hits", none, lambda kept, h: F.when(F.exists(kept, lambda x: alike(x, h)), kept).otherwise(F.concat(kept, F.array(h))))
    return grouped.select("query_id", F.explode(kept).alias("h")).select("query_id", "h.item", "h.rank")


def best_per_document(hits: DataFrame) -> DataFrame:
    """The best chunk of each (query, strategy, document)."""
    w = Window.partitionBy("query_id", "strategy", "doc_id").orderBy(F.desc("score"), "chunk")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion by document over strategies."""
    w = Window.partitionBy("query_id", "strategy").orderBy(F.desc("score"), "doc_id")
    ranked = best_per_document(hits).withColumn("r", F.row_number().over(w))
    return ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("r"))), 8).alias("score"), F.count(F.lit(1)).alias("n_strategies"))


def weighted(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The largest weighted score of a document; a strategy without weight counts 1."""
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("strategy") == name, F.lit(float(value))).otherwise(w)
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.max(F.col("score") * w), 6).alias("score"))


def classify(text: Column) -> Column:
    """Strategies by the kind of query."""
    low = F.lower(text)
    named = low.rlike("who is|ceo|founder|relationship between") | text.rlike("[\"'“”‘’]") | (F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))) >= 2)
    return F.when(low.rlike("summarize|summarise|overview|across all|throughout"), F.array(F.lit("raptor"))).when(named, F.array(F.lit("graph"), F.lit("vector"))).otherwise(F.array(F.lit("vector"), F.lit("bm25")))


def overlap_hits(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Number of distinct white-space tokens that query and chunk share: as a sparse product like ``bm25``, or, beyond ``CARRIED``
    pairs of query and token, as an equi-join on the token."""
    split = lambda c: F.explode(F.array_remove(F.array_distinct(F.split(c, r"[ \t\n\r]+")), ""))
    q = queries.select("query_id", split(F.col("text")).alias("term"))
    if q.limit(CARRIED + 1).count() > CARRIED:
        c = chunks.select("doc_id", "pos", split(F.col("text")).alias("term"))
        found = c.join(q, "term").groupBy("query_id", "doc_id", "pos").agg(F.count(F.lit(1)).alias("score"))
    else:
        found = _sparse(chunks, q, lambda text: dict.fromkeys(_SPLIT.split(text), 1), lambda n, df, tf, dl, length: tf, k, None).withColumn("score", F.col("score").cast("long"))
    return top(found, k, F.desc("score"), "doc_id", "pos")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, item, rank), relevant (query_id, item): hit rate, MRR, NDCG, precision, recall at k of each query that
    either table has. MRR has no cutoff; an item returned again counts again for NDCG and once for precision and recall; a
    query without relevant items has recall 1 and the rest 0, one without results has 0 for all it has relevant items for."""
    wanted = relevant.select("query_id", "item").distinct()
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    r = ranked.join(wanted.withColumn("rel", F.lit(1)), ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return _measures(r, size, k)


def metrics_by_class(ranked: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``metrics`` where the relevant items of a query are those of its class: asked (query_id, label), items (item, label). A class is
    counted, not joined, so neither its size nor the number of its queries makes rows."""
    sets = lambda df, name, to: df.groupBy(name).agg(F.array_sort(F.collect_set("label")).alias(to))
    q, i = sets(asked, "query_id", "own"), sets(items, "item", "of")
    met = q.select("own").distinct().crossJoin(F.broadcast(i.groupBy("of").agg(F.count(F.lit(1)).alias("n")))).where(F.arrays_overlap("own", "of"))
    size = q.join(met.groupBy("own").agg(F.sum("n").alias("n_rel")), "own").select("query_id", "n_rel")
    r = ranked.join(q, "query_id", "left").join(i, "item", "left").withColumn("rel", F.coalesce(F.arrays_overlap("own", "of"), F.lit(False)).cast("int"))
    return _measures(r, size, k)


def _measures(r: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """Metrics of r (query_id, item, rank, rel) and size (query_id, n_rel)."""
    here = (F.col("rank") <= k) & (F.col("rel") == 1)
    per = r.groupBy("query_id").agg(
        F.max(F.when(here, 1).otherwise(0)).alias("hit"),
        F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(here, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.countDistinct(F.when(here, F.col("item"))).alias("found"),
        F.least(F.lit(k), F.count(F.lit(1))).alias("shown"),
    )
    both = per.join(size, "query_id", "full_outer").na.fill(0, ["hit", "mrr", "dcg", "found", "shown", "n_rel"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel"))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    share = lambda x, n, none: F.when(n > 0, F.round(x / F.greatest(n, F.lit(1)), 6)).otherwise(F.lit(none))
    return both.select("query_id", "hit", F.round("mrr", 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), share(F.col("found"), F.col("shown"), 0.0).alias("precision"), share(F.col("found"), F.col("n_rel"), 1.0).alias("recall"))


def report(per_query: DataFrame) -> DataFrame:
    """Means of the metrics over all queries and their number; no query: a row of nulls and 0."""
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "mrr", "ndcg", "precision", "recall")))


def golden(ranked: DataFrame, versions: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Evaluation by documents: ranked (query_id, doc_id, version, rank) to the latest version of each document, distinct
    documents in order of first rank, against relevant (query_id, doc_id)."""
    last = versions.groupBy("doc_id").agg(F.max("version").alias("version"))
    first = ranked.join(last, ["doc_id", "version"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return metrics(first.select("query_id", F.col("doc_id").alias("item"), F.row_number().over(w).alias("rank")), relevant.select("query_id", F.col("doc_id").alias("item")), k)
