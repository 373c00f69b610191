"""Every query of the engine by name, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import chunking, context, graph, lifecycle, retrieval, tree, verification
from corvid.session import table
from corvid.sources import documents as sources
from corvid.streaming import stateful

FLAGSHIP = "bm25_fixed_top10"


def _queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_fixed_top10(spark, sf):
    chunks = chunking.fixed(table(spark, sf, "documents"))
    return retrieval.bm25(chunks, _queries(spark, sf)).select("query_id", "doc_id", "pos", "score", "rank")


def chunk_fixed(spark, sf):
    return chunking.fixed(table(spark, sf, "documents")).select("doc_id", "pos", "start", "end", F.sha2("text", 256).alias("text_hash"))


def _chunker(name):
    return lambda spark, sf: chunking.chunk(table(spark, sf, "documents"), name)


def chunk_inspect(spark, sf):
    return chunking.inspect(chunking.fixed(table(spark, sf, "documents")))


def chunk_sizes(spark, sf):
    n = chunking.inspect(chunking.fixed(table(spark, sf, "documents"))).select(F.greatest("tokens", F.lit(1)).alias("t"))
    # Nearest rank from counts of each size: no list of all values.
    c = n.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    s = F.array_sort(F.collect_list(F.struct("t", "c")))  # a row for each distinct size, at most size / 4
    a = c.agg(s.alias("s"), F.sum("c").alias("n"), F.sum(F.col("t") * F.col("c")).alias("total"))
    at = lambda p: F.aggregate("s", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")), lambda x, y: F.struct((x["seen"] + y["c"]).alias("seen"), F.coalesce(x["v"], F.when(x["seen"] + y["c"] > F.floor(p * (F.col("n") - 1) + 0.5), y["t"])).alias("v")))["v"]
    return a.select("n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def _vector_queries(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def knn_cosine_top10(spark, sf):
    return retrieval.knn(table(spark, sf, "embeddings"), _vector_queries(spark, sf))


def knn_l2_top10(spark, sf):
    return retrieval.knn(table(spark, sf, "embeddings"), _vector_queries(spark, sf), metric="l2")


def _token_vectors(v):
    """Four vectors of a quarter of the places each stand in for token vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v.cast("array<double>"), i * 16 + 1, 16))


def late_interaction_top5(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", _token_vectors(F.col("embedding")).alias("tokens"))
    return retrieval.late_interaction(v, _vector_queries(spark, sf).withColumn("q_tokens", _token_vectors(F.col("q"))))


def distinct_hits(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    hits = knn_cosine_top10(spark, sf).join(v, "vec_id").select("query_id", "rank", F.col("vec_id").alias("item"), F.lit("").alias("text"), "vector")
    return retrieval.distinct_hits(hits, 0.3).withColumnRenamed("item", "vec_id")


def _tree(spark, sf):
    """Leaves, a level by label, and a root over it."""
    one, name = F.lit("embeddings"), F.format_string("L%d", F.col("label"))
    v = table(spark, sf, "embeddings")
    leaves = v.select(one.alias("source"), F.format_string("%d", F.col("vec_id")).alias("node"), F.col("vec_id").alias("leaf"), F.lit(1).alias("n_leaves"), F.col("embedding").alias("vector"))
    first = tree.level_up(leaves, v.select(one.alias("source"), F.format_string("%d", F.col("vec_id")).alias("node"), name.alias("parent")), 1)
    root = tree.level_up(first, v.select(one.alias("source"), name.alias("node"), F.lit("root").alias("parent")).distinct(), 2)
    return leaves, first, root


def tree_levels(spark, sf):
    _, first, root = _tree(spark, sf)
    length = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return first.unionByName(root).select("node", "level", "n_children", "n_leaves", "leaf", "summary", length.alias("length"))


def tree_search_top10(spark, sf):
    leaves, first, root = _tree(spark, sf)
    kinds = (leaves.withColumn("level", F.lit(0)), first, root)
    leaf, one, two = (n.select("node", "level", F.col("vector").cast("array<double>").alias("vector")) for n in kinds)
    return tree.search(leaf.unionByName(one).unionByName(two), _vector_queries(spark, sf))


def experiment_ready(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("samples"), *(F.round(F.avg(F.col(c).cast("double")) * 10, 6).alias(a) for c, a in (("l_tax", "champion"), ("l_discount", "challenger"))))
    return li.select(F.col("l_suppkey").alias("experiment_id"), "samples", verification.ready_to_promote(F.col("samples"), F.col("champion"), F.col("challenger")).alias("ready"))


def retrieval_metrics(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label")
    ranked = knn_cosine_top10(spark, sf).select("query_id", F.col("vec_id").alias("item"), "rank")
    return retrieval.metrics_by_class(ranked, v.where("item % 50 = 0").select(F.col("item").alias("query_id"), "label"), v, 5)


def _hits(spark, sf):
    """Two strategies' hits of the benchmark queries: BM25 and shared words, both over fixed chunks."""
    chunks, q = chunking.fixed(table(spark, sf, "documents")), _queries(spark, sf)
    one = retrieval.bm25(chunks, q).select("query_id", F.lit("bm25").alias("strategy"), "doc_id", F.col("pos").alias("chunk"), "score")
    two = retrieval.overlap_hits(chunks, q, 10).select("query_id", F.lit("overlap").alias("strategy"), "doc_id", F.col("pos").alias("chunk"), F.col("score").cast("double").alias("score"))
    return one.unionByName(two)


def rrf_fusion(spark, sf):
    return retrieval.rrf(_hits(spark, sf))


def weighted_fusion(spark, sf):
    return retrieval.weighted(_hits(spark, sf), {"bm25": 2.0})


def overlap_retrieval(spark, sf):
    return retrieval.overlap_hits(chunking.fixed(table(spark, sf, "documents")), _queries(spark, sf)).select("query_id", "doc_id", "pos", "score", "rank")


def classify_queries(spark, sf):
    return _queries(spark, sf).select("query_id", F.array_join(retrieval.classify(F.col("text")), ",").alias("strategies"))


def _edges(spark, sf):
    """Customers, nations, regions, suppliers, orders and parts."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return c.union(n).union(s).union(o).union(l)


def _seeds(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("node"))


def graph_bfs(spark, sf):
    return graph.bfs(_edges(spark, sf), _seeds(spark, sf), 2)


def graph_hop_decay(spark, sf):
    sources_ = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("chunk"))
    return graph.decayed(_edges(spark, sf), _seeds(spark, sf), sources_, 2)


def document_dedup(spark, sf):
    return sources.unchanged_first(table(spark, sf, "documents"), "doc_id", "text")


def mime_types(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", sources.scheme(F.col("url")).alias("scheme"), sources.mime_by_name(F.regexp_replace("url", "[?#].*$", "")).alias("mime_type"))


def conversation_history(spark, sf):
    return context.histories(table(spark, sf, "conversations"))


def context_rrf(spark, sf):
    h = _hits(spark, sf)
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "strategy").orderBy(F.desc("score"), "doc_id", "chunk")
    ranked = h.select("query_id", F.col("strategy").alias("list"), F.concat_ws(":", "doc_id", "chunk").alias("chunk"), F.row_number().over(w).alias("rank"))
    return context.chunk_rrf(ranked).select("query_id", "chunk", "score", F.array_join("lists", ",").alias("lists"))


def _spans(spark, sf):
    c = chunking.fixed(table(spark, sf, "documents"))
    h = retrieval.bm25(c, _queries(spark, sf))
    return h.join(c.select("doc_id", "pos", "start", "end", "text"), ["doc_id", "pos"])


def merge_passages(spark, sf):
    return context.merge_spans(_spans(spark, sf))


def cluster_passages(spark, sf):
    return context.cluster(_spans(spark, sf).withColumn("chunk", F.concat_ws(":", "doc_id", "pos")))


def pack_budget(spark, sf):
    c = _spans(spark, sf).select("query_id", F.concat_ws(":", "doc_id", "pos").alias("id"), "score", F.ceil(F.length("text") / 4).alias("cost"))
    return context.pack(c, 400)


def render_xml(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(context.render(F.lit("P1"), F.concat(F.lit("doc://"), "doc_id"), F.col("text"), "xml"), 256).alias("rendered"))


def citation_refs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("["), F.lit("P"), F.col("doc_id") % 7, F.lit(", S2] "), F.col("text"), F.lit(" [P1]")).alias("answer"))
    p = d.select("answer_id", F.explode(F.array(F.lit("P1"), F.lit("P3"))).alias("ref"))
    return verification.citations(d, p).select("answer_id", F.array_join("known", ",").alias("known"), F.array_join("unknown", ",").alias("unknown"))


def verdict_counts(spark, sf):
    li = table(spark, sf, "lineitem")
    v = verification.verdict(F.col("l_linenumber") % 4, F.least(F.col("l_linenumber") % 4, F.col("l_quantity").cast("int") % 4), F.col("l_suppkey") % 2, F.least(F.col("l_linenumber") % 4, F.col("l_partkey") % 4))
    return verification.overall(li.select(F.col("l_orderkey").alias("answer_id"), v.alias("verdict")))


def _versions(spark, sf):
    o = table(spark, sf, "orders")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("deleted")
    return o.select(F.col("o_custkey").alias("document_id"), n.alias("version_num"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("content_hash"), F.col("o_orderdate").alias("at"), status.alias("status"))


def versions_latest(spark, sf):
    return lifecycle.latest(_versions(spark, sf)).select("document_id", "version_num")


def retention_gc(spark, sf):
    return lifecycle.expired(_versions(spark, sf), F.lit(1000), F.lit("1999-01-01").cast("timestamp"))


def source_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("collection_id"), F.col("source").alias("source_uri"))
    named = d.select("collection_id").union(spark.range(1).select(F.lit("empty")))
    return lifecycle.source_counts(d, named)


def rate_limits(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("o", F.struct("ts", "event_id"))
    return stateful.fold(e, "user_id", "o", ["t", "event_id"], lambda s, t, _: stateful.limiter_step(s, t, 3, 86400), "allowed").select("event_id", "allowed")


def circuit_breaker(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("o", F.struct("ts", "event_id")).withColumn("failed", F.col("event_type") == "error")
    return stateful.fold(e, "user_id", "o", ["t", "failed", "event_id"], lambda s, t, f, _: stateful.breaker_step(s, t, f, 2, 86400), "state").select("event_id", "state")


def provider_stats(spark, sf):
    e = table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    return e.groupBy(F.col("user_id").alias("provider")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(bad).alias("errors"), F.round(F.count_if(bad) / F.count(F.lit(1)), 6).alias("error_rate"), F.round(F.avg(F.when(~bad, F.col("value"))), 4).alias("avg_latency"))


_FIXED = """fx AS (SELECT doc_id, pos, start0 + strlen(raw) - strlen(regexp_replace(raw, '^[ \\t\\n\\r\\x0B\\f]+', '')) AS "start", regexp_replace(raw, '^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+$', '', 'g') AS text
  FROM (SELECT doc_id, pos, substring(text, pos * 448 + 1, 512) AS raw, strlen(substring(text, 1, pos * 448)) AS start0
        FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 512, 0) / 448.0) AS BIGINT) + 1)) AS pos FROM documents))),
  fixed AS (SELECT doc_id, CAST(pos AS INT) AS pos, "start", "start" + strlen(text) AS "end", text FROM fx WHERE text <> '')"""
_BM25 = f"""{_FIXED},
  q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
  t AS (SELECT doc_id, pos, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM fixed),
  st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
  tf AS (SELECT doc_id, pos, dl, term, count(*) AS tf FROM (SELECT doc_id, pos, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sc AS (SELECT query_id, doc_id, pos, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM sc) WHERE rank <= 10)"""
_OVER = """, cw AS (SELECT DISTINCT doc_id, pos, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS term FROM fixed),
  qw AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS term FROM benchmark),
  ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM (SELECT query_id, doc_id, pos, count(*) AS score FROM cw JOIN qw USING (term) GROUP BY ALL)),
  hits AS (SELECT query_id, 'bm25' AS strategy, doc_id, pos AS chunk, score FROM bm UNION ALL SELECT query_id, 'overlap', doc_id, pos, CAST(score AS DOUBLE) FROM ov WHERE rank <= 10)"""
_KNN = """k AS (SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
  kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k) WHERE rank <= 10)"""
_COS = _KNN.format(score="list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))")
_TREE = """x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p1 AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM x) GROUP BY ALL), c1 AS (SELECT label, list(m ORDER BY i) AS v FROM p1 GROUP BY label),
  n1 AS (SELECT 'L' || label AS node, 1 AS level, n AS n_children, n AS n_leaves, leaf, n || ' chunks clustered at level 1' AS summary, v FROM (SELECT label, count(*) AS n, min(vec_id) AS leaf FROM x GROUP BY label) JOIN c1 USING (label)),
  p2 AS (SELECT i, avg(m) AS m FROM p1 GROUP BY i),
  n2 AS (SELECT 'root' AS node, 2 AS level, count(*) AS n_children, CAST(sum(n_leaves) AS BIGINT) AS n_leaves, min(leaf) AS leaf, count(*) || ' chunks clustered at level 2' AS summary, (SELECT list(m ORDER BY i) FROM p2) AS v FROM n1),
  n AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2)"""
_GRAPH = """e0 AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
  e AS (SELECT DISTINCT * FROM (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0)),
  h0 AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS node FROM supplier),
  h1 AS (SELECT query_id, b AS node FROM h0 JOIN e ON node = a), h2 AS (SELECT query_id, b AS node FROM h1 JOIN e ON node = a),
  g AS (SELECT query_id, node, min(h) AS hops FROM (SELECT *, 0 AS h FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)"""
_VERSIONS = """v AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_num, o_orderdate AS "at", CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'deleted' END AS status FROM orders)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_fixed_top10, chunk_fixed, chunk_inspect, chunk_sizes, knn_cosine_top10, knn_l2_top10, late_interaction_top5, distinct_hits, tree_levels, tree_search_top10, experiment_ready, retrieval_metrics, rrf_fusion, weighted_fusion, overlap_retrieval, classify_queries, graph_bfs, graph_hop_decay,
        document_dedup, mime_types, conversation_history, context_rrf, merge_passages, cluster_passages, pack_budget, render_xml, citation_refs, verdict_counts, versions_latest, retention_gc, source_counts, rate_limits, circuit_breaker, provider_stats,
    )
} | {f"chunk_{n}": _chunker(n) for n in chunking.STRATEGIES}

ORACLES = {
    "bm25_fixed_top10": f"WITH {_BM25} SELECT * FROM bm",
    "chunk_fixed": f'WITH {_FIXED} SELECT doc_id, pos, "start", "end", sha256(text) AS text_hash FROM fixed',
    "chunk_inspect": f"""WITH {_FIXED} SELECT doc_id, pos, length(text) AS chars, length(text) // 4 AS tokens, greatest(coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY pos) - "start", 0), 0) AS overlap FROM fixed""",
    "chunk_sizes": f"""WITH {_FIXED}, s AS (SELECT greatest(length(text) // 4, 1) AS t FROM fixed), o AS (SELECT list_sort(list(t)) AS l, count(*) AS n, round(avg(t), 6) AS mean FROM s)
        SELECT n, mean, l[CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1] AS p95 FROM o""",
    "knn_cosine_top10": f"WITH {_COS} SELECT * FROM kn",
    "knn_l2_top10": f"WITH {_KNN.format(score='1 / (1 + list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) ** 2)')} SELECT * FROM kn",
    "late_interaction_top5": f"""WITH {_COS.replace('rank <= 10', 'rank <= 20')},
        t AS (SELECT kn.query_id, kn.vec_id, i, max(list_cosine_similarity(CAST(q.embedding[i * 16 + 1:i * 16 + 16] AS DOUBLE[]), CAST(v.embedding[j * 16 + 1:j * 16 + 16] AS DOUBLE[]))) AS best
              FROM kn JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = kn.query_id, range(4) a(i), range(4) b(j) GROUP BY ALL),
        s AS (SELECT query_id, vec_id, round(sum(best), 6) AS score FROM t GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "distinct_hits": f"""WITH RECURSIVE {_COS}, h AS (SELECT kn.query_id, kn.rank, vec_id, CAST(v.embedding AS DOUBLE[]) AS e FROM kn JOIN embeddings v USING (vec_id)),
        r AS (SELECT query_id, CAST(1 AS BIGINT) AS rank, [{{'id': vec_id, 'rank': rank, 'e': e}}] AS kept FROM h WHERE rank = 1
              UNION ALL SELECT r.query_id, r.rank + 1, CASE WHEN len(list_filter(r.kept, lambda x: list_cosine_similarity(x.e, h.e) >= 0.3)) > 0 THEN r.kept ELSE list_append(r.kept, {{'id': h.vec_id, 'rank': h.rank, 'e': h.e}}) END
              FROM r JOIN h ON h.query_id = r.query_id AND h.rank = r.rank + 1),
        u AS (SELECT query_id, unnest(kept) AS k FROM r WHERE rank = 10)
        SELECT query_id, k.id AS vec_id, k.rank AS rank FROM u""",
    "tree_levels": f"WITH {_TREE} SELECT node, level, n_children, n_leaves, leaf, summary, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS length FROM n",
    "tree_search_top10": f"""WITH {_TREE}, a AS (SELECT CAST(vec_id AS VARCHAR) AS node, 0 AS level, e AS v FROM x UNION ALL SELECT node, level, v FROM n),
        s AS (SELECT q.vec_id AS query_id, node, level, round(list_cosine_similarity(q.e, v) / (1 + level), 6) AS score FROM a, x q WHERE q.vec_id % 50 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM s) WHERE rank <= 10""",
    "experiment_ready": """SELECT l_suppkey AS experiment_id, samples, samples >= 50 AND d > t + 0.05 AS ready
        FROM (SELECT l_suppkey, count(*) AS samples, round(avg(CAST(l_tax AS DOUBLE)) * 10, 6) AS t, round(avg(CAST(l_discount AS DOUBLE)) * 10, 6) AS d FROM lineitem GROUP BY l_suppkey)""",
    "retrieval_metrics": f"""WITH {_COS}, r AS (SELECT kn.query_id, rank, CASE WHEN v.label = q.label THEN 1 ELSE 0 END AS rel, q.label FROM kn JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = kn.query_id),
        n AS (SELECT label, count(*) AS n_rel FROM embeddings GROUP BY label)
        SELECT query_id, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr,
        round(coalesce(sum(CASE WHEN rank <= 5 AND rel = 1 THEN 1 / log2(rank + 1) END), 0) / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, least(5, n_rel) + 1) x(i))), 6) AS ndcg,
        round(sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5, 6) AS precision, round(sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / any_value(n_rel), 6) AS recall FROM r JOIN n USING (label) GROUP BY query_id""",
    "rrf_fusion": f"""WITH {_BM25}{_OVER}, b AS (SELECT query_id, strategy, doc_id, max(score) AS score FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, doc_id) AS r FROM b)
        SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 8) AS score, count(*) AS n_strategies FROM r GROUP BY ALL""",
    "weighted_fusion": f"WITH {_BM25}{_OVER} SELECT query_id, doc_id, round(max(score * CASE strategy WHEN 'bm25' THEN 2.0 ELSE 1.0 END), 6) AS score FROM hits GROUP BY ALL",
    "overlap_retrieval": f"WITH {_BM25}{_OVER} SELECT * FROM ov WHERE rank <= 5",
    "classify_queries": """SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), 'summarize|summarise|overview|across all|throughout') THEN 'raptor'
        WHEN regexp_matches(lower(text), 'who is|ceo|founder|relationship between') OR regexp_matches(text, '["''“”‘’]') OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\p{Lu}'))) >= 2 THEN 'graph,vector' ELSE 'vector,bm25' END AS strategies FROM benchmark""",
    "graph_bfs": f"WITH {_GRAPH} SELECT * FROM g",
    "graph_hop_decay": f"WITH {_GRAPH} SELECT query_id, c_mktsegment AS chunk, round(sum(1.0 / (1 + hops)), 6) AS score FROM g JOIN customer ON node = 'c' || c_custkey GROUP BY ALL",
    "document_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_rows FROM documents GROUP BY 1",
    "mime_types": "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'http' ELSE 'file' END AS scheme, CASE WHEN ends_with(regexp_replace(url, '[?#].*$', ''), '.html') THEN 'text/html' ELSE 'application/octet-stream' END AS mime_type FROM pages",
    "conversation_history": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substring(text, 1, 2000), chr(10) ORDER BY turn) AS history, arg_max(text, CASE WHEN role = 'user' THEN turn END) AS question, count(*) AS n_messages FROM t WHERE back <= 6 GROUP BY conv_id""",
    "context_rrf": f"""WITH {_BM25}{_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, doc_id, chunk) AS r FROM hits)
        SELECT query_id, doc_id || ':' || chunk AS chunk, round(sum(1.0 / (60 + r)), 8) AS score, string_agg(strategy, ',' ORDER BY strategy) AS lists FROM r GROUP BY ALL""",
    "merge_passages": f"""WITH {_BM25}, s AS (SELECT query_id, doc_id, "start", "end", score FROM bm JOIN fixed USING (doc_id, pos)),
        i AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY query_id, doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
        j AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM i)
        SELECT query_id, doc_id, min("start") AS "start", max("end") AS "end", max(score) AS score, count(*) AS n_chunks FROM j GROUP BY query_id, doc_id, island""",
    "render_xml": """SELECT doc_id, sha256('<passage id="P1" source="doc://' || doc_id || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</passage>') AS rendered FROM documents""",
    "citation_refs": """WITH a AS (SELECT doc_id, '[P' || (doc_id % 7) || ', S2] ' || text || ' [P1]' AS t FROM documents),
        g AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(t, '\\[\\s*[PS]\\d{1,3}(?:\\s*,\\s*[PS]\\d{1,3})*\\s*\\]'), lambda x: regexp_extract_all(x, '[PS]\\d{1,3}'))) AS r FROM a),
        d AS (SELECT doc_id, list_filter(r, lambda x, i: list_position(r, x) = i) AS r FROM g)
        SELECT doc_id AS answer_id, array_to_string(list_filter(r, lambda x: x IN ('P1', 'P3')), ',') AS known, array_to_string(list_filter(r, lambda x: x NOT IN ('P1', 'P3')), ',') AS unknown FROM d""",
    "verdict_counts": """WITH s AS (SELECT l_orderkey AS answer_id, l_linenumber % 4 AS c, least(l_linenumber % 4, CAST(trunc(l_quantity) AS INT) % 4) AS s, l_suppkey % 2 AS d, least(l_linenumber % 4, l_partkey % 4) AS k FROM lineitem),
        v AS (SELECT answer_id, CASE WHEN c = 0 THEN 'no_claim' WHEN s = 0 THEN 'unsupported' WHEN s < c THEN 'partial' WHEN d = 0 THEN 'uncited_supported' WHEN k = c THEN 'supported' ELSE 'miscited' END AS v FROM s)
        SELECT answer_id, count(*) FILTER (v = 'supported') AS supported, count(*) FILTER (v = 'partial') AS partial, count(*) FILTER (v = 'unsupported') AS unsupported, count(*) FILTER (v = 'miscited') AS miscited, count(*) FILTER (v = 'uncited_supported') AS uncited_supported, count(*) FILTER (v = 'no_claim') AS no_claim, count(*) FILTER (v IN ('partial', 'unsupported')) = 0 AS passes FROM v GROUP BY answer_id""",
    "versions_latest": f"WITH {_VERSIONS} SELECT document_id, max(version_num) AS version_num FROM v WHERE status = 'active' GROUP BY document_id",
    "retention_gc": f"""WITH {_VERSIONS}, a AS (SELECT *, count(*) FILTER (status <> 'deleted') OVER (PARTITION BY document_id) AS alive, CAST(floor((epoch(TIMESTAMP '1999-01-01') - epoch("at")) / 86400) AS BIGINT) AS age_days FROM v)
        SELECT document_id, version_num, age_days, alive = 1 AS is_last FROM a WHERE status = 'superseded' AND age_days >= 1000""",
    "source_counts": "SELECT lang AS collection_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang UNION ALL SELECT 'empty', 0",
    "provider_stats": "SELECT user_id AS provider, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(avg(value) FILTER (event_type <> 'error'), 4) AS avg_latency FROM events GROUP BY user_id",
}


def queries() -> dict:
    from corvid.plans import more

    return QUERIES | more.QUERIES


def oracle_sql() -> dict:
    from corvid.plans import more

    return ORACLES | more.ORACLES


__all__ = ["FLAGSHIP", "oracle_sql", "queries"]
