"""Search as one plan: query transforms, strategies, fusion over strategies and transformed queries, reranking, removal of
resembling hits, citations. Models are functions of columns; those here are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalar import embed
from corvid.operators import retrieval, stores

#: The prompts of each intent.
PROMPTS = {
    "context_prefix": "Generate a brief context sentence for this chunk that will help with retrieval. Chunk: %s\nContext sentence:",
    "summarize": "Summarize the following text concisely:\n%s",
    "extract_entities": 'Extract named entities and relationships from the following text as JSON {"entities": [...], "relations": [...]}: \n%s',
    "caption": "Describe this image content: %s",
    "rerank": "Rate the relevance of this passage to the query on a scale of 0-1. Return only the number. Passage: %s",
    "rewrite_query": "Rewrite the final user message in the conversation below as a single standalone question. Resolve pronouns and references using the earlier messages. "
    "Return only the question as plain text, with no preamble.\n\nConversation:\n%s\n\nStandalone question:",
}


def prompt(intent: str, text: Column, prefix: str | None = None) -> Column:
    """The prompt of an intent, or of a custom ``prefix``."""
    if intent == "custom":
        return F.concat(F.lit(f"{prefix}\n"), text)
    before, after = PROMPTS[intent].split("%s")
    return F.concat(F.lit(before), text, F.lit(after))


def with_prefix(chunks: DataFrame, prefix: Column) -> DataFrame:
    """Chunks for the vector line: a context sentence before the text; offsets stay those of the document."""
    return chunks.withColumn("text", F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.col("text")))


def embedded(rows: DataFrame, text_col: str = "text", embedder: Callable[[Column], Column] = embed) -> DataFrame:
    return rows.withColumn("vector", embedder(F.col(text_col)))


#: Query transforms: from a text to the texts that are searched for.
def hyde(hypothesis: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The query and a hypothetical answer."""
    return lambda text: F.array(text, hypothesis(text))


def multi_query(variant: Callable[[Column, Column], Column], n: int = 3) -> Callable[[Column], Column]:
    """n variants instead of the query."""
    return lambda text: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: variant(text, i))


def rewrite(rewriter: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.array(rewriter(text))


def transformed(queries: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """queries (query_id, text) as (query_id, query_index, text): what the transform gives, without nulls and blanks; the query
    itself where that is nothing."""
    made = F.coalesce(F.filter(transform(F.col("text")), lambda t: F.trim(t) != ""), F.array()) if transform else F.array("text")
    return queries.select("query_id", F.posexplode(F.when(F.size(made) > 0, made).otherwise(F.array("text"))).alias("query_index", "text"))


def static(_: Column) -> Column:
    return F.array(F.lit("vector"), F.lit("bm25"))


def all_strategies(_: Column) -> Column:
    return F.array(*(F.lit(x) for x in ("vector", "bm25", "colbert", "graph", "raptor")))


#: How strategies are chosen; the last is the default.
MODES: dict[str, Callable[[Column], Column]] = {"static": static, "classified": retrieval.classify, "parallel": all_strategies}


def planned(queries: DataFrame, mode: str = "parallel") -> DataFrame:
    """(query_id, query_index, text, strategy): a row for each strategy of each query."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return queries.withColumn("strategy", F.explode(MODES[mode](F.col("text"))))


Strategy = Callable[[DataFrame, int], DataFrame]


def candidates(plan: DataFrame, strategies: dict[str, Strategy], k: int) -> tuple[DataFrame, list[str]]:
    """(query_id, query_index, strategy, doc_id, chunk, score) of all strategies, and those that failed to plan: one that raises
    is left out and named, never fatal. A strategy takes (query_id, text) and k; query_id stands for query and index."""
    key = F.struct("query_id", "query_index")
    out, failed = None, []
    for name, run in strategies.items():
        own = plan.where(F.col("strategy") == name).select(key.alias("query_id"), "text")
        try:
            found = run(own, k).select("query_id.query_id", "query_id.query_index", F.lit(name).alias("strategy"), "doc_id", "chunk", "score")
        except Exception:  # whatever a strategy raises
            failed.append(name)
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no strategy could be planned")
    return out, failed


def fused(hits: DataFrame, k: int = retrieval.RRF_K) -> DataFrame:
    """Reciprocal ranks by document over the strategies of each transformed query, then over the queries' fused lists: (query_id,
    doc_id, chunk, score, rank). The chunk is that of the first list (by query, then strategy) that has the document."""
    per = hits.select(F.struct("query_id", "query_index").alias("query_id"), "strategy", "doc_id", "chunk", "score")
    one = retrieval.rrf(per, k).select("query_id", "doc_id", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    lists = one.withColumn("r", F.row_number().over(w)).select("query_id.query_id", "doc_id", "r")
    two = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("r"))), 8).alias("score"))
    first = retrieval.best_per_document(per).groupBy("query_id.query_id", "doc_id").agg(F.min_by("chunk", F.struct("query_id.query_index", "strategy")).alias("chunk"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return two.join(first, ["query_id", "doc_id"]).withColumn("rank", F.row_number().over(ranked))


def reranked(hits: DataFrame, score: Column | None = None) -> DataFrame:
    """hits (query_id, doc_id, chunk, score) ranked anew: by ``score`` where it is a number (a text is parsed), else by the score
    before; without ``score`` by the score before."""
    new = F.col("score") if score is None else F.coalesce(score.try_cast("double"), F.col("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk")
    return hits.withColumn("score", new).withColumn("rank", F.row_number().over(w))


def cross_encoded(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """hits (query_id, rank, score, ...) with scores (query_id, scores array<double>) given to them in order; a list that is too
    short leaves the others' scores as they are."""
    met = hits.join(scores.select("query_id", "scores"), "query_id", "left")
    return reranked(met.withColumn("score", F.coalesce(F.get("scores", F.col("rank") - 1), F.col("score"))).drop("scores", "rank"))


def search(queries: DataFrame, strategies: dict[str, Strategy], registry: DataFrame, k: int = 10, mode: str = "parallel", transform=None, rerank: Column | None = None, threshold: float | None = None) -> DataFrame:
    """queries (query_id, text) to hits (query_id, rank, doc_id, chunk, score and the registry's columns). Results hold up to
    strategies x k documents. With ``threshold`` hits that resemble a better one go."""
    found, _ = candidates(planned(transformed(queries, transform), mode), strategies, k)
    hits = stores.hydrated(fused(found), registry.drop("doc_id"))
    if rerank is not None:
        hits = reranked(hits, rerank)
    if threshold is not None:
        kept = retrieval.distinct_hits(hits.select("query_id", "rank", F.col("chunk").alias("item"), "text", "vector"), threshold)
        hits = hits.join(kept.select("query_id", F.col("item").alias("chunk")), ["query_id", "chunk"], "left_semi")
    return hits


def benchmark(chunks: DataFrame, queries: DataFrame, relevant: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Recall of overlap retrieval at each k, as a mean over queries: (k, recall). Documents may repeat in a result."""
    hits = retrieval.overlap_hits(chunks, queries, max(ks)).select("query_id", F.col("doc_id").alias("item"), "rank")
    out = None
    for k in ks:
        one = retrieval.metrics(hits, relevant, k).agg(F.lit(k).alias("k"), F.round(F.avg("recall"), 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def judged_metrics(scores: DataFrame) -> DataFrame:
    """scores (query_id, metric, raw): what a model said of each chunk, context or answer, as text. context_precision is the share
    of 0.5 or more, the others the mean; numbers are cut to 0..1, what is no number is 0."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.trim("raw").try_cast("double"), F.lit(0.0))))
    x = F.when(F.isnan(x), 0.0).otherwise(x)
    value = F.avg(F.when(F.col("metric") == "context_precision", (F.col("x") >= 0.5).cast("double")).otherwise(F.col("x")))
    return scores.withColumn("x", x).groupBy("query_id", "metric").agg(F.round(value, 6).alias("value"))
