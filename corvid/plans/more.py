"""Queries over stores, search, context, verification and lifecycle, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import scalar
from corvid.operators import chunking, context, graph, lifecycle, retrieval, search, stores, tree, verification
from corvid.plans import registry as base
from corvid.session import table, written
from corvid.sources import documents as sources

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def _uris(spark, sf) -> DataFrame:
    """The pages' URLs as URIs of all kinds."""
    rest = F.regexp_replace("url", "^https?://", "")
    p = table(spark, sf, "pages")
    return p.select("page_id", F.explode(F.array("url", *(F.concat(F.lit(f), rest) for f in ("s3://", "gs://", "az://", "raw://", "/data/")))).alias("uri"))


_URIS = """u AS (SELECT page_id, unnest([url] || list_transform(['s3://', 'gs://', 'az://', 'raw://', '/data/'], lambda f: f || regexp_replace(url, '^https?://', ''))) AS uri FROM pages),
  k AS (SELECT *, CASE WHEN regexp_matches(uri, '^https?://') THEN 'http' WHEN uri LIKE 'raw://%' THEN 'raw' WHEN uri LIKE 's3://%' THEN 's3' WHEN uri LIKE 'gs://%' THEN 'gcs' WHEN uri LIKE 'az://%' THEN 'azure' ELSE 'file' END AS kind FROM u)"""


@query(f"""WITH {_URIS}, b AS (SELECT *, kind IN ('s3', 'gcs', 'azure') AS cloud, substr(uri, 6) AS rest FROM k)
  SELECT page_id, uri, kind, CASE WHEN cloud THEN split_part(rest, '/', 1) END AS bucket, CASE WHEN cloud AND rest LIKE '%/%' THEN substr(rest, strpos(rest, '/') + 1) WHEN cloud THEN '' END AS "key",
  CASE WHEN cloud AND rest NOT LIKE '%/%' THEN uri || '/' ELSE uri END AS display FROM b""")
def source_uris(spark, sf):
    return _uris(spark, sf).select("page_id", "uri", sources.parsed_uri(F.col("uri")).alias("u")).select("page_id", "uri", "u.*")


@query(f"WITH {_URIS} SELECT page_id, uri, CASE kind WHEN 'http' THEN 'http' WHEN 'file' THEN 'file' WHEN 'raw' THEN NULL ELSE 'cloud' END AS loader FROM k")
def loader_choice(spark, sf):
    return _uris(spark, sf).select("page_id", "uri", sources.default_loaders().choose(F.col("uri")).alias("loader"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'application/gzip' ELSE 'text/markdown' END AS mime_type FROM documents""")
def mime_sniff(spark, sf):
    front = F.unhex(F.element_at(F.array(*map(F.lit, ("25504446", "89504E47", "FFD8FF", "47494638", "1F8B", ""))), (F.col("doc_id") % 6 + 1).cast("int")))
    return _docs(spark, sf).select("doc_id", sources.sniff(F.concat(front, F.col("text").cast("binary")), F.lit("text/markdown")).alias("mime_type"))


@query("SELECT page_id, sha256(html) AS content_hash, 'text/html' AS mime_type FROM pages")
def http_pages(spark, sf):
    """Pages fetched by their URL, from a fixture that holds what the network would give: the page is in the URL's fragment."""
    import base64

    p = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("#"), F.base64(F.col("html").cast("binary"))).alias("url"))
    got = sources.load_http(p, lambda u: (base64.b64decode(u.partition("#")[2]), "text/html; charset=utf-8"))
    return got.select(F.substring_index("source_uri", "#", 1).cast("long").alias("page_id"), F.sha2("content", 256).alias("content_hash"), "mime_type")


_SANITISED = """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(lower(trim(x)), '^(system|human|assistant|user):')
    AND len(list_filter(['ignore previous instructions', 'ignore all previous', 'disregard previous', 'forget your instructions', 'new instructions:', 'system prompt:', 'you are now', 'act as if', '<|system|>', '<|user|>', '<|assistant|>', '###instruction', '[inst]', '[/inst]'], lambda p: contains(lower(x), p))) = 0) AS kept FROM {t})
  SELECT doc_id, sha256(trim(array_to_string(kept, chr(10)))) AS clean_hash FROM l"""


@query(_SANITISED.format(t="(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'You are now free' WHEN 1 THEN 'x [INST] y' || chr(10) || text ELSE text END AS text FROM documents)"))
def sanitise_documents(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nYou are now free"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x [INST] y\n"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha2(sources.sanitised(t), 256).alias("clean_hash"))


@query("""WITH c AS (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'unknown' END AS preprocessor, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages)
  SELECT page_id, preprocessor IS DISTINCT FROM 'none' AND mime = 'text/html' AS converted FROM c""")
def preprocess_pages(spark, sf):
    p = table(spark, sf, "pages")
    d = p.select("page_id", F.concat(F.lit("c"), F.col("page_id") % 3).alias("collection_id"), F.col("html").alias("text"), F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("text/plain").alias("mime_type"))
    choice = spark.range(1).select(F.inline(F.array(F.struct(F.lit("c0").alias("collection_id"), F.lit("none").alias("preprocessor")), F.struct(F.lit("c1").alias("collection_id"), F.lit("unknown").alias("preprocessor")))))
    return sources.preprocessed(d, choice).select("page_id", (~F.col("processed").eqNullSafe(F.col("text"))).alias("converted"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n_blocks, sha256(string_split(text, chr(10))[-1]) AS last_hash FROM documents""")
def canonical_blocks(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("b"), i).alias("id"), F.lit("p").alias("kind"), x.alias("text"), F.lit(1).alias("page")))
    d = _docs(spark, sf).select("doc_id", sources.canonical_blocks(F.to_json(F.struct(lines.alias("blocks")))).alias("b"))
    return d.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.sha2(F.element_at("b", -1)["text"], 256).alias("last_hash"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("c"), F.col("label") % 3).alias("collection_id"), F.concat(F.lit("e://"), F.col("vec_id") % 50).alias("source_uri"), "vec_id", "label")


_VECTORS = "v AS (SELECT 'c' || (label % 3) AS collection_id, 'e://' || (vec_id % 50) AS source_uri, vec_id, label FROM embeddings)"


@query(f"""WITH {_VECTORS}, n AS (SELECT collection_id, source_uri, vec_id, label + g AS label, g, row_number() OVER (PARTITION BY collection_id, vec_id ORDER BY g DESC) AS n FROM v, range(1, 3) r(g) WHERE vec_id % 2 = 0)
  SELECT collection_id, source_uri, vec_id, label FROM v WHERE vec_id % 3 <> 0 AND vec_id % 2 <> 0 UNION ALL SELECT collection_id, source_uri, vec_id, CAST(label AS INT) FROM n WHERE n = 1""")
def upsert_vectors(spark, sf):
    v = _vectors(spark, sf)
    new = v.where("vec_id % 2 = 0").withColumn("g", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("label", F.col("label") + F.col("g"))
    return stores.upsert(v.where("vec_id % 3 <> 0"), new, ["collection_id", "vec_id"], F.col("g")).select("collection_id", "source_uri", "vec_id", "label")


@query(f"WITH {_VECTORS} SELECT collection_id, count(*) AS n_rows FROM (SELECT * FROM v UNION ALL SELECT * FROM v WHERE vec_id % 2 = 0) GROUP BY collection_id")
def append_vectors(spark, sf):
    v = _vectors(spark, sf)
    return v.unionByName(v.where("vec_id % 2 = 0")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_VECTORS} SELECT collection_id, source_uri, vec_id FROM v WHERE NOT (collection_id = 'c1' AND source_uri = 'e://7')")
def delete_vectors(spark, sf):
    v = stores.delete_source(_vectors(spark, sf), "c1", "e://7")
    return stores.delete_source(v, "c2", "").select("collection_id", "source_uri", "vec_id")


@query(f"WITH {_VECTORS} SELECT vec_id FROM v WHERE collection_id = 'c1' AND label <> 4 AND vec_id > 50 AND vec_id < 400 AND source_uri IN ('e://1', 'e://2', 'e://3')")
def filter_vectors(spark, sf):
    asked = [("label", "ne", 4), ("vec_id", "gt", 50), ("vec_id", "lt", 400), ("source_uri", "in", ["e://1", "e://2", "e://3"]), ("label", "in", [])]
    return stores.scoped(_vectors(spark, sf), "c1", asked).select("vec_id")


@query(f"WITH {_VECTORS} SELECT collection_id FROM v UNION SELECT 'empty'")
def list_collections(spark, sf):
    return stores.collections(spark.range(1).select(F.lit("empty").alias("collection_id")), _vectors(spark, sf))


@query(f"WITH {_VECTORS} SELECT collection_id, count(DISTINCT source_uri) AS n_documents FROM v GROUP BY collection_id UNION ALL SELECT NULL, count(DISTINCT source_uri) FROM v")
def document_counts(spark, sf):
    return stores.document_counts(_vectors(spark, sf))


def _claims(c: Column) -> Column:
    return F.struct((F.col("user_id") % 5 == 0).alias("is_admin"), F.when(F.col("user_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("click"), F.lit("view"))).alias("collections"))


@query("SELECT event_id, user_id, event_type AS collection_id FROM events WHERE user_id % 5 = 0 OR (user_id % 3 <> 0 AND event_type IN ('click', 'view'))")
def allowed_collections(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("collection_id"))
    claims = e.select("user_id").distinct().select("user_id", _claims(F.col("user_id")).alias("c")).select("user_id", "c.*")
    return stores.allowed(e, claims).select("event_id", "user_id", "collection_id")


def _stamped(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    v = d.select("doc_id", F.col("lang").alias("collection_id"), F.concat(F.lit("doc://"), "doc_id").alias("source_uri"), (F.col("doc_id") % 3 + 1).cast("int").alias("version_num"), F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("snap://"), "doc_id")).alias("snapshot_uri"))
    return stores.stamped(chunking.fixed(d), v)


_STAMPED = f"""{base._FIXED}, st AS (SELECT lang AS collection_id, 'doc://' || d.doc_id AS source_uri, CAST(d.doc_id % 3 + 1 AS INT) AS version_num, CASE WHEN d.doc_id % 10 > 0 THEN 'snap://' || d.doc_id END AS snapshot_uri, fixed.* FROM fixed JOIN documents d USING (doc_id)),
  sm AS (SELECT *, sha256(collection_id || chr(31) || source_uri) AS document_id, sha256(collection_id || chr(31) || source_uri || chr(31) || version_num || chr(31) || pos) AS chunk, CASE WHEN snapshot_uri IS NULL THEN 'no_snapshot' END AS error FROM st)"""


@query(f"WITH {_STAMPED} SELECT doc_id, pos, document_id, chunk, error FROM sm")
def stamp_chunks(spark, sf):
    return _stamped(spark, sf).select("doc_id", "pos", "document_id", "chunk", "error")


@query(f"""WITH {_STAMPED}, s AS (SELECT sm.*, sm.start + CAST(sm.doc_id % 4 = 1 AS INT) * 1000000 AS s FROM sm)
  SELECT doc_id, pos, CASE WHEN s <> start THEN 'out_of_range' END AS error, CASE WHEN s = start THEN sha256(text) END AS text_hash FROM s""")
def registry_records(spark, sf):
    c = _stamped(spark, sf).drop("error").withColumn("text", F.lit("context\n")).withColumn("start", F.col("start") + F.when(F.col("doc_id") % 4 == 1, 1_000_000).otherwise(0))
    return stores.records(c, _docs(spark, sf)).select("doc_id", "pos", "error", F.when(F.col("error").isNull(), F.sha2("text", 256)).alias("text_hash"))


@query(f"WITH {base._FIXED}, a AS (SELECT count(*) AS n_chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM fixed) SELECT 'vector' AS backend, * FROM a UNION ALL SELECT 'lexical', * FROM a")
def backend_chunks(spark, sf):
    """Each backend's own chunker; a backend without one takes that of the vectors."""
    c = chunking.by_backend(_docs(spark, sf), {"vector": ("fixed", {}), "lexical": None})
    return c.groupBy("backend").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"""WITH {base._FIXED} SELECT doc_id, pos, start, sha256(CASE WHEN doc_id % 2 = 0 THEN 'From ' || source || chr(10) || fixed.text ELSE fixed.text END) AS text_hash FROM fixed JOIN documents USING (doc_id)""")
def context_prefix(spark, sf):
    d = _docs(spark, sf)
    c = chunking.fixed(d).join(d.select("doc_id", "source"), "doc_id")
    c = search.with_prefix(c, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("From "), "source")).otherwise(""))
    return c.select("doc_id", "pos", "start", F.sha2("text", 256).alias("text_hash"))


_EMBED = """(SELECT list_transform(range(64), lambda i: len(list_filter(places, lambda p: p = i))) FROM (SELECT list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_reduce([37] || list_transform(range(1, strlen(w) + 1), lambda k: CAST(('0x' || substr(hex(encode(w)), CAST(2 * k - 1 AS BIGINT), 2)) AS INT)), lambda h, b: xor(h, b) * 51 % 64)) AS places))"""


@query(f"WITH e AS (SELECT item_id, {_EMBED.format(t='text')} AS c FROM benchmark) SELECT item_id, round(c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS first, round(list_sum(list_transform(c, lambda x, i: i * x)) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 4) AS weighed FROM e")
def hash_embeddings(spark, sf):
    v = search.embedded(table(spark, sf, "benchmark"))
    weighed = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("item_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(weighed, 4).alias("weighed"))


def _hits(spark, sf) -> DataFrame:
    """kNN hits as chunks, some of which the registry does not know."""
    return base.knn_cosine_top10(spark, sf).select("query_id", F.concat(F.lit("v"), "vec_id").alias("chunk"), F.col("vec_id").alias("doc_id"), "score", "rank")


def _known(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 7 <> 3").select(F.concat(F.lit("v"), "vec_id").alias("chunk"), F.concat(F.lit("text "), "label").alias("text"), F.concat(F.lit("e://"), "vec_id").alias("source_uri"))


_HITS = f"{base._COS}, hk AS (SELECT query_id, 'v' || vec_id AS chunk, vec_id AS doc_id, score, rank FROM kn), kw AS (SELECT 'v' || vec_id AS chunk, 'text ' || label AS text, 'e://' || vec_id AS source_uri FROM embeddings WHERE vec_id % 7 <> 3)"


@query(f"WITH {_HITS} SELECT query_id, rank, chunk, text, source_uri FROM hk JOIN kw USING (chunk)")
def hydrate_hits(spark, sf):
    return stores.hydrated(_hits(spark, sf), _known(spark, sf)).select("query_id", "rank", "chunk", "text", "source_uri")


@query(f"WITH {_HITS} SELECT query_id, count(*) AS n_unresolved FROM hk WHERE chunk NOT IN (SELECT chunk FROM kw) GROUP BY query_id")
def unresolved_hits(spark, sf):
    return stores.unresolved(_hits(spark, sf), _known(spark, sf))


@query(f"WITH {_HITS}, c AS (SELECT *, CASE WHEN rank % 4 = 0 THEN 'summary' ELSE 'source' END AS kind FROM hk) SELECT query_id, rank, kind, c.chunk, CASE kind WHEN 'source' THEN kw.text ELSE 'prefixed' END AS text FROM c LEFT JOIN kw USING (chunk) WHERE kind = 'summary' OR kw.text IS NOT NULL")
def hydrate_lists(spark, sf):
    c = _hits(spark, sf).withColumn("kind", F.when(F.col("rank") % 4 == 0, "summary").otherwise("source")).withColumn("text", F.lit("prefixed"))
    return stores.hydrated_lists(c, _known(spark, sf)).select("query_id", "rank", "kind", "chunk", "text")


@query(f"""WITH {_HITS} SELECT query_id, rank, CASE WHEN doc_id % 2 = 0 THEN 'e://' || doc_id ELSE 'meta://' || doc_id END AS source_uri, 'T' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'meta' END AS section, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 4 AS INT) END AS version, CASE WHEN doc_id % 5 > 0 THEN 's' || doc_id END AS snapshot_uri FROM hk""")
def hit_citations(spark, sf):
    i = F.col("doc_id")
    h = _hits(spark, sf).withColumns({"source_uri": F.when(i % 2 == 0, F.concat(F.lit("e://"), i)).otherwise(""), "section": F.when(i % 3 == 0, "own"), "version_num": (i % 4).cast("int"), "snapshot_uri": F.when(i % 5 > 0, F.concat(F.lit("s"), i)).otherwise("")})
    h = h.withColumn("metadata", F.create_map(F.lit("source_uri"), F.concat(F.lit("meta://"), i), F.lit("title"), F.concat(F.lit("T"), i), F.lit("section"), F.lit("meta")))
    return stores.citations(h).select("query_id", "rank", "source_uri", "title", "section", "version", "snapshot_uri")


def _asked(spark, sf) -> DataFrame:
    return base._queries(spark, sf)


@query("""WITH t AS (SELECT item_id AS query_id, text, item_id % 4 AS k FROM benchmark), m AS (SELECT query_id, CASE k WHEN 0 THEN [text, 'About ' || text] WHEN 1 THEN [text || ' 1', text || ' 2', text || ' 3'] WHEN 2 THEN ['Re: ' || text] ELSE [text] END AS a FROM t)
  SELECT query_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS query_index, unnest(a) AS text FROM m""")
def query_transforms(spark, sf):
    q, out = _asked(spark, sf), None
    variants = {0: search.hyde(lambda t: F.concat(F.lit("About "), t)), 1: search.multi_query(lambda t, i: F.concat(t, F.lit(" "), i), 3), 2: search.rewrite(lambda t: F.concat(F.lit("Re: "), t)), 3: search.rewrite(lambda t: F.lit(" "))}
    for k, f in variants.items():
        one = search.transformed(q.where(F.col("query_id") % 4 == k), f)
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT item_id AS query_id, m AS mode, CASE m WHEN 'static' THEN 'vector,bm25' WHEN 'parallel' THEN 'vector,bm25,colbert,graph,raptor' END AS strategies FROM benchmark, (VALUES ('static'), ('parallel')) t(m)""")
def search_modes(spark, sf):
    q = _asked(spark, sf).withColumn("query_index", F.lit(0))
    parts = [search.planned(q, m).groupBy("query_id").agg(F.collect_list("strategy").alias("s")).select("query_id", F.lit(m).alias("mode"), "s") for m in ("static", "parallel")]
    order = F.array(*(F.lit(x) for x in ("vector", "bm25", "colbert", "graph", "raptor")))
    return parts[0].unionByName(parts[1]).select("query_id", "mode", F.array_join(F.filter(order, lambda x: F.array_contains("s", x)), ",").alias("strategies"))


def _lists(spark, sf) -> DataFrame:
    """Two lists for each of two transformed queries: cosine and Euclidean hits, the second query in reverse order."""
    one = base.knn_cosine_top10(spark, sf).withColumn("strategy", F.lit("cosine"))
    two = base.knn_l2_top10(spark, sf).withColumn("strategy", F.lit("l2"))
    h = one.unionByName(two).withColumn("query_index", F.explode(F.array(F.lit(0), F.lit(1))))
    score = F.when(F.col("query_index") == 0, -F.col("rank")).otherwise(F.col("rank")).cast("double")
    # Fusion reads the lists twice; the searches behind them run once.
    return written(h.select("query_id", "query_index", "strategy", (F.col("vec_id") % 100).alias("doc_id"), F.col("vec_id").alias("chunk"), score.alias("score")))


_LISTS = f"""{base._COS}, k2 AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 / (1 + list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) ** 2), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
  kn2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k2) WHERE rank <= 10),
  li AS (SELECT query_id, qi, strategy, vec_id % 100 AS doc_id, vec_id AS chunk, CASE qi WHEN 0 THEN -rank ELSE rank END AS score FROM (SELECT *, 'cosine' AS strategy FROM kn UNION ALL SELECT *, 'l2' FROM kn2), range(2) r(qi)),
  bs AS (SELECT *, row_number() OVER (PARTITION BY query_id, qi, strategy, doc_id ORDER BY score DESC, chunk) AS n FROM li), b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, qi, strategy ORDER BY score DESC, doc_id) AS r FROM bs WHERE n = 1),
  f1 AS (SELECT query_id, qi, doc_id, round(sum(1.0 / (60 + r)), 8) AS s FROM b1 GROUP BY ALL), f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, qi ORDER BY s DESC, doc_id) AS r FROM f1),
  f3 AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 8) AS score FROM f2 GROUP BY ALL), fc AS (SELECT query_id, doc_id, arg_min(chunk, qi * 10 + CASE strategy WHEN 'cosine' THEN 0 ELSE 1 END) AS chunk FROM b1 GROUP BY ALL),
  fu AS (SELECT f3.*, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f3 JOIN fc USING (query_id, doc_id))"""


@query(f"WITH {_LISTS} SELECT query_id, doc_id, chunk, score, rank FROM fu")
def multi_query_fusion(spark, sf):
    return search.fused(_lists(spark, sf)).select("query_id", "doc_id", "chunk", "score", "rank")


@query(f"WITH {_LISTS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 2 = 0 THEN doc_id / 100.0 ELSE score END DESC, doc_id, chunk) AS rank FROM fu")
def rerank_scores(spark, sf):
    said = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") / 100).cast("string")).otherwise("no number")
    return search.reranked(search.fused(_lists(spark, sf)), said).select("query_id", "doc_id", "rank")


@query(f"WITH {_LISTS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE rank WHEN 1 THEN 0.001 WHEN 2 THEN 0.5 ELSE score END DESC, doc_id, chunk) AS rank FROM fu")
def cross_encoder_rerank(spark, sf):
    f = search.fused(_lists(spark, sf))
    return search.cross_encoded(f, f.select("query_id").distinct().withColumn("scores", F.array(F.lit(0.001), F.lit(0.5)))).select("query_id", "doc_id", "rank")


@query(f"""WITH {base._FIXED}, ve AS (SELECT doc_id, pos, {_EMBED.format(t='text')} AS c FROM fixed), vq AS (SELECT item_id AS query_id, {_EMBED.format(t='text')} AS q FROM benchmark WHERE item_id % 50 = 0),
  sc AS (SELECT query_id, doc_id, pos, round(CASE WHEN list_sum(c) > 0 AND list_sum(q) > 0 THEN list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(c AS DOUBLE[])) ELSE 0 END, 6) AS score FROM ve, vq)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rank FROM sc) WHERE rank <= 10""")
def search_vector(spark, sf):
    """The stated query set, benchmark items of an id divisible by 50, embedded and compared with all embedded chunks."""
    v = search.embedded(chunking.fixed(_docs(spark, sf))).select(F.struct("doc_id", "pos").alias("vec_id"), F.col("vector").alias("embedding"))
    q = search.embedded(_asked(spark, sf).where("query_id % 50 = 0")).select("query_id", F.col("vector").alias("q"))
    return retrieval.knn(v, q).select("query_id", "vec_id.doc_id", "vec_id.pos", "score", "rank")


def _members(spark, sf) -> DataFrame:
    l = _lists(spark, sf)
    w = Window.partitionBy("query_id", "query_index", "strategy").orderBy(F.desc("score"), "chunk")
    return l.select("query_id", F.lit("d").alias("doc_id"), (F.col("chunk") % 7).alias("cluster"), F.concat("query_index", F.lit(":"), "strategy").alias("list"), F.row_number().over(w).alias("rank"), "chunk")


_MEMBERS = f"{_LISTS}, me AS (SELECT query_id, 'd' AS doc_id, chunk % 7 AS cluster, qi || ':' || strategy AS list, row_number() OVER (PARTITION BY query_id, qi, strategy ORDER BY score DESC, chunk) AS rank, chunk FROM li)"


@query(f"WITH {_MEMBERS}, b AS (SELECT query_id, doc_id, cluster, list, min(rank) AS rank FROM me GROUP BY ALL) SELECT query_id, doc_id, cluster, round(sum(1.0 / (60 + rank)), 8) AS score, string_agg(list, ',' ORDER BY list) AS lists FROM b GROUP BY query_id, doc_id, cluster")
def cluster_scores(spark, sf):
    return context.cluster_scores(_members(spark, sf)).withColumn("lists", F.array_join("lists", ","))


@query(f"WITH {_MEMBERS} SELECT query_id, chunk, round(sum(1.0 / (60 + rank)), 8) AS score, arg_min(rank % 3, list || lpad(CAST(rank AS VARCHAR), 3, '0')) AS level, arg_min(list, list) AS text FROM me GROUP BY query_id, chunk")
def summary_scores(spark, sf):
    m = _members(spark, sf).withColumns({"level": (F.col("rank") % 3).cast("long"), "covers": F.array("chunk"), "text": F.col("list")})
    return context.summary_scores(m).drop("covers")


def _passages(spark, sf) -> DataFrame:
    s = base._spans(spark, sf)
    return s.select("query_id", F.format_string("%010d:%05d", "doc_id", "pos").alias("id"), F.col("doc_id").cast("string").alias("doc"), F.concat(F.lit("doc://"), "doc_id").alias("uri"), F.lit(1).alias("version"), "start", "end", "text", "score")


_PASSAGES = f"""{base._BM25}, pa AS (SELECT query_id, printf('%010d:%05d', doc_id, pos) AS id, CAST(doc_id AS VARCHAR) AS doc, 'doc://' || doc_id AS uri, "start", "end", text, score FROM bm JOIN fixed USING (doc_id, pos))"""


@query(f"""WITH RECURSIVE {_PASSAGES}, esc AS (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM pa),
  co AS (SELECT query_id, id, doc, score, CAST(ceil(ceil(length('<passage ref="P999">' || t || '</passage>' || chr(10)) / 4.0) * 11 / 10.0) AS BIGINT) AS cost, CAST(ceil(ceil(length('<document source="' || uri || '" version="1">' || chr(10) || '</document>' || chr(10)) / 4.0) * 11 / 10.0) AS BIGINT) AS wrap, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM esc),
  en AS (SELECT CAST(ceil(ceil(length('<documents>' || chr(10) || '</documents>' || chr(10)) / 4.0) * 11 / 10.0) AS BIGINT) AS e),
  g AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS docs FROM (SELECT DISTINCT query_id FROM co)
    UNION ALL SELECT g.query_id, c.n, CASE WHEN fits THEN used + full_cost ELSE used END, CASE WHEN fits THEN list_append(ids, c.id) ELSE ids END, CASE WHEN fits THEN list_append(docs, c.doc) ELSE docs END
    FROM g JOIN co c ON c.query_id = g.query_id AND c.n = g.n + 1, LATERAL (SELECT c.cost + CASE WHEN len(g.ids) = 0 THEN (SELECT e FROM en) ELSE 0 END + CASE WHEN list_contains(g.docs, c.doc) THEN 0 ELSE c.wrap END AS full_cost), LATERAL (SELECT g.used + full_cost <= 800 AS fits)),
  l AS (SELECT query_id, unnest(ids) AS id FROM (SELECT query_id, arg_max(ids, n) AS ids FROM g GROUP BY query_id)) SELECT query_id, id, cost FROM l JOIN co USING (query_id, id)""")
def select_passages(spark, sf):
    p = _passages(spark, sf)
    return context.selected(p, p.limit(0).select("query_id", "id", "text", "score"), 800).select("query_id", "id", "cost")


@query(f"""WITH {_PASSAGES}, s AS (SELECT *, max("end") OVER (PARTITION BY query_id, doc ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pa), i AS (SELECT *, sum(CASE WHEN "start" <= b THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, doc ORDER BY "start", "end", id ROWS UNBOUNDED PRECEDING) AS island FROM s),
  m AS (SELECT query_id, doc, island, min("start") AS "start", max("end") AS "end", max(score) AS score FROM i GROUP BY ALL), mt AS (SELECT m.*, array_slice(encode(d.text), "start" + 1, "end") AS data, max(score) OVER (PARTITION BY query_id, doc) AS best FROM m JOIN documents d ON CAST(d.doc_id AS VARCHAR) = doc)
  SELECT query_id, doc, "start", "end", 'P' || row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc, "start", "end") AS ref, sha256(data) AS text_hash FROM mt""")
def number_passages(spark, sf):
    m = context.numbered(context.merge_texts(_passages(spark, sf)))
    return m.select("query_id", "doc", "start", "end", "ref", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {_PASSAGES}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id, doc) AS best FROM pa), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc, "start", "end") AS n FROM b),
  f AS (SELECT query_id, n, uri, CASE WHEN lag(uri) OVER (PARTITION BY query_id ORDER BY n) IS DISTINCT FROM uri THEN '### ' || uri || ' (v1)' || chr(10) || chr(10) ELSE '' END || '[P' || n || '] ' || text || chr(10) || chr(10) AS line FROM n)
  SELECT query_id, sha256(string_agg(line, '' ORDER BY n) || '#### Background' || chr(10) || chr(10) || '[S1] all' || chr(10) || chr(10)) AS rendered FROM f GROUP BY query_id""")
def render_markdown(spark, sf):
    p = context.numbered(_passages(spark, sf))
    s = p.select("query_id").distinct().select("query_id", F.lit("S1").alias("ref"), F.lit("all").alias("text"))
    return context.rendered(p, s, "markdown").select("query_id", F.sha2("rendered", 256).alias("rendered"))


@query(f"""WITH {_PASSAGES}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id, doc) AS best FROM pa), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, doc, "start", "end") AS n FROM b)
  SELECT query_id, sha256(string_agg('[P' || n || '] ' || uri || ' (v1)' || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS rendered FROM n GROUP BY query_id""")
def render_numbered(spark, sf):
    p = context.numbered(_passages(spark, sf))
    return context.rendered(p, p.limit(0).select("query_id", "ref", "text"), "numbered").select("query_id", F.sha2("rendered", 256).alias("rendered"))


_TURNS = "tu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"""WITH {_TURNS}, e AS (SELECT conv_id, turn, role, text, min(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS from_turn FROM tu WHERE back BETWEEN 2 AND 3), h AS (SELECT conv_id, string_agg(role || ': ' || substring(text, 1, 4000), chr(10) ORDER BY turn) AS history FROM e WHERE turn >= from_turn GROUP BY conv_id)
  SELECT tu.conv_id, coalesce(history, '') AS history, 'docs of ' || tu.conv_id || chr(10) || chr(10) || 'Question: ' || text AS "user" FROM tu LEFT JOIN h ON h.conv_id = tu.conv_id WHERE back = 1""")
def answer_prompts(spark, sf):
    t = table(spark, sf, "conversations")
    return context.prompts(t, t.select("conv_id").distinct().withColumn("docs", F.concat(F.lit("docs of "), "conv_id")), history=2)


@query(f"""WITH {_TURNS}, o AS (SELECT conv_id, max(n) AS n, arg_max(text, turn) AS only_, arg_max(text, turn) FILTER (role = 'user') AS asked FROM tu GROUP BY conv_id)
  SELECT conv_id, CASE WHEN n <= 1 THEN only_ WHEN conv_id % 3 = 0 THEN 'Standalone ' || conv_id ELSE coalesce(asked, '') END AS text, CASE WHEN n <= 1 THEN 'original' WHEN conv_id % 3 = 0 THEN 'rewritten' ELSE 'fallback' END AS source FROM o""")
def conversation_rewrite(spark, sf):
    t = table(spark, sf, "conversations")
    new = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" Standalone "), F.col("conv_id"), F.lit("\n"))).when(F.col("conv_id") % 3 == 1, F.repeat(F.lit("x"), 1001)).otherwise(" ")
    return context.resolved(t, t.select("conv_id").distinct().withColumn("rewritten", new))


@query("SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN ceil(ceil(length(text) / 4.0) * 11 / 10.0) ELSE 0 END AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf):
    return _docs(spark, sf).select("doc_id", scalar.counted_tokens(F.col("text")).alias("tokens"))


@query("""SELECT item_id, i AS intent, sha256(CASE i WHEN 'summarize' THEN 'Summarize the following text concisely:' || chr(10) || text WHEN 'caption' THEN 'Describe this image content: ' || text ELSE 'Translate' || chr(10) || text END) AS prompt FROM benchmark, (VALUES ('summarize'), ('caption'), ('custom')) t(i)""")
def enricher_prompts(spark, sf):
    b = table(spark, sf, "benchmark")
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("intent"), F.sha2(search.prompt(i, F.col("text"), "Translate"), 256).alias("prompt")) for i in ("summarize", "caption", "custom"))))
    return b.select("item_id", parts.alias("p")).select("item_id", "p.*")


def _answers(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("Claim one [P1]. Claim two, really! [P2][S9] Three? [P3, P1]\n```\ncode [P1].\n```\nLast "), F.col("doc_id")).alias("answer"))


@query("""SELECT doc_id AS answer_id, CAST(unit AS INT) AS unit, "start", "start" + strlen(t) AS "end", code, t AS text FROM documents, LATERAL (SELECT * FROM (VALUES (0, 0, false, 'Claim one [P1].'), (1, 16, false, 'Claim two, really! [P2][S9]'), (2, 44, false, 'Three? [P3, P1]'), (3, 60, true, '```' || chr(10) || 'code [P1].' || chr(10) || '```'), (4, 79, false, 'Last ' || doc_id)) x(unit, "start", code, t))""")
def segment_answers(spark, sf):
    return verification.segment(_answers(spark, sf))


@query("""SELECT doc_id AS answer_id, CAST(unit AS INT) AS unit, cited, invalid FROM documents, (VALUES (0, 'P1', ''), (1, 'P2', 'S9'), (2, 'P1', 'P3'), (3, '', ''), (4, '', '')) x(unit, cited, invalid)""")
def attribute_citations(spark, sf):
    a = _answers(spark, sf)
    refs = a.select("answer_id", F.explode(F.array(F.lit("P1"), F.lit("P2"))).alias("ref"))
    return verification.attribute(verification.segment(a), refs).select("answer_id", "unit", F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"))


@query(f"""WITH {base._FIXED}, c AS (SELECT doc_id, count(*) AS n_chunks, min("start") AS "start", max("end") AS "end", count(*) FILTER (g) AS gaps FROM (SELECT *, "start" > lag("end") OVER (PARTITION BY doc_id ORDER BY "start", "end") AS g FROM fixed WHERE NOT (doc_id % 5 = 1 AND pos = 1)) GROUP BY doc_id)
  SELECT doc_id AS passage, "start", CASE WHEN gaps = 0 AND NOT mixed THEN "end" END AS "end", CASE WHEN gaps = 0 AND NOT mixed THEN sha256(array_slice(encode(text), "start" + 1, "end")) END AS text_hash, CAST(n_chunks AS INT) AS n_chunks, CASE WHEN mixed THEN 'mixed_versions' WHEN gaps > 0 THEN 'not_contiguous' END AS error
  FROM (SELECT c.*, d.text, doc_id % 7 = 3 AND n_chunks > 1 AS mixed FROM c JOIN documents d USING (doc_id))""")
def join_chunks(spark, sf):
    """Each document's chunks joined again; some lack the second chunk, some mix versions."""
    c = chunking.fixed(_docs(spark, sf)).where("not (doc_id % 5 = 1 and pos = 1)")
    mixed = F.when((F.col("doc_id") % 7 == 3) & (F.col("pos") > 0), 2).otherwise(1)
    got = verification.join_chunks(c.select(F.col("doc_id").alias("passage"), F.col("pos").alias("chunk"), F.col("doc_id").alias("document_id"), mixed.alias("version_num"), "start", "end", "text"))
    return got.select("passage", "start", "end", F.sha2("text", 256).alias("text_hash"), "n_chunks", "error")


@query(f"""WITH {base._FIXED}, o AS (SELECT DISTINCT doc_id AS passage, unnest([0, 600, 100000000]) AS "offset" FROM fixed)
  SELECT passage, "offset", coalesce((SELECT arg_min(pos, "start") FROM fixed f WHERE f.doc_id = passage AND "start" <= "offset" AND "offset" < "end"), (SELECT arg_min(pos, "start") FROM fixed f WHERE f.doc_id = passage)) AS chunk FROM o""")
def quote_chunks(spark, sf):
    c = chunking.fixed(_docs(spark, sf)).select(F.col("doc_id").alias("passage"), F.col("pos").alias("chunk"), "start", "end")
    o = c.select("passage").distinct().withColumn("offset", F.explode(F.array(F.lit(0), F.lit(600), F.lit(100_000_000))))
    return verification.chunk_at(c, o)


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents), q AS (SELECT doc_id, text, array_to_string(w[2:4], ' ') AS q FROM w),
  f AS (SELECT doc_id, text, CASE WHEN strpos(text, q) > 0 THEN q END AS exact FROM q WHERE q <> '') SELECT doc_id, CASE WHEN exact IS NOT NULL THEN strlen(substring(text, 1, strpos(text, exact) - 1)) END AS "start" FROM f WHERE exact IS NOT NULL""")
def locate_quotes(spark, sf):
    """The second to fourth word of each text, joined by single spaces, where they stand so."""
    w = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    d = _docs(spark, sf).select("doc_id", "text", F.array_join(F.slice(w, 2, 3), " ").alias("q")).where("q <> '' and instr(text, q) > 0")
    return d.select("doc_id", verification.locate(F.col("text"), F.col("q"))["start"].alias("start"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS answer_id, CAST(l_linenumber AS INT) AS unit, CAST(trunc(l_quantity) AS BIGINT) AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(trunc(l_quantity) AS BIGINT)) AS n FROM lineitem), b AS (SELECT answer_id, CASE WHEN answer_id % 10 = 0 THEN 200 ELSE 20 END AS base FROM (SELECT DISTINCT answer_id FROM s)),
  g AS (SELECT answer_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS unit, 0 AS batch, CAST(0 AS BIGINT) AS k, CAST(base AS BIGINT) AS total FROM b UNION ALL
    SELECT g.answer_id, s.n, s.unit, g.batch + CAST(x AS INT), CASE WHEN x THEN 1 ELSE g.k + 1 END, CASE WHEN x THEN b.base ELSE g.total END + s.cost FROM g JOIN s ON s.answer_id = g.answer_id AND s.n = g.n + 1 JOIN b ON b.answer_id = g.answer_id, LATERAL (SELECT g.k >= 3 OR (g.k > 0 AND g.total + s.cost > 100) AS x))
  SELECT answer_id, unit, CASE WHEN base <= 100 THEN batch END AS batch, CASE WHEN base > 100 THEN 'passages_over_budget' END AS error FROM g JOIN b USING (answer_id) WHERE n > 0""")
def judge_batches(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").cast("int").alias("unit"), F.col("l_quantity").cast("long").alias("cost"))
    return verification.plan_batches(s, F.when(F.col("answer_id") % 10 == 0, 200).otherwise(20), 100, 3)


@query("""SELECT doc_id AS answer_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'truncated' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'unknown_sentence' WHEN 4 THEN 'duplicate_sentence' WHEN 5 THEN 'missing_sentence' WHEN 6 THEN 'claim_without_claims' ELSE 'unknown_ref' END AS error FROM documents""")
def judge_parse(spark, sf):
    one = '{"id": %d, "kind": "claim", "claims": [{"text": "t", "support": [{"ref": "%s", "quote": "q"}]}]}'
    good = one % (1, "P1") + ', {"id": 2, "kind": "no_claim"}'
    said = ["```json\n{\"sentences\": [" + good + "]}\n```", '{"sentences": []}', "Sorry, {no", '{"sentences": [' + good + ", " + one % (9, "P1") + "]}", '{"sentences": [' + good + ", " + one % (1, "P1") + "]}", 'Here: {"sentences": [' + one % (1, "P1") + "]}", '{"sentences": [{"id": 1, "kind": "claim", "claims": []}, {"id": 2, "kind": "no_claim"}]}', '{"sentences": [' + one % (1, "P7") + ', {"id": 2, "kind": "no_claim"}]}']
    k = (F.col("doc_id") % 8).cast("int")
    r = _docs(spark, sf).select(F.col("doc_id").alias("answer_id"), F.get(F.array(*map(F.lit, said)), k).alias("raw"), (k == 1).alias("truncated"), F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("ids"), F.array(F.lit("P1")).alias("available"))
    return verification.parse_judgement(r).select("answer_id", "error")


@query("SELECT l_orderkey AS answer_id, CASE WHEN count(*) FILTER (l_linenumber = 4) = 0 THEN CAST(sum(l_suppkey) AS BIGINT) END AS prompt_tokens, CAST(sum(l_partkey) AS BIGINT) AS completion_tokens FROM lineitem GROUP BY l_orderkey")
def token_usage(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey")).alias("prompt_tokens"), F.col("l_partkey").alias("completion_tokens"))
    return verification.token_usage(li, "answer_id", "prompt_tokens", "completion_tokens")


def _proof(spark, sf):
    li = table(spark, sf, "lineitem")
    chunk = F.concat("l_partkey", F.lit("-"), "l_suppkey")
    claims = li.select(F.concat(F.lit("o"), "l_orderkey").alias("root"), F.lit("entity").alias("kind"), chunk.alias("chunk")).distinct()
    registry = li.where("l_partkey % 9 > 0").select(chunk.alias("chunk"), F.col("l_partkey").alias("document_id"), (F.col("l_partkey") % 4).alias("version_num"), F.concat(F.lit("p://"), "l_partkey").alias("source_uri"), F.concat(F.lit("s"), "l_partkey").alias("snapshot_uri"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("page"), F.when(F.col("l_suppkey") % 3 == 0, "sec").alias("section"), (F.col("l_suppkey") % 2).alias("start"), F.lit(9).alias("end")).distinct()
    versions = registry.where("version_num < 3").select("document_id", "version_num", F.when(F.col("version_num") == 0, "active").otherwise("superseded").alias("status")).distinct()
    return claims, registry, versions


@query("""WITH c AS (SELECT DISTINCT 'o' || l_orderkey AS root, l_partkey AS p, l_suppkey AS s, l_partkey || '-' || l_suppkey AS chunk FROM lineitem WHERE l_partkey % 9 > 0)
  SELECT root, 'entity' AS kind, chunk, 'p://' || p || ' p.' || CASE WHEN s % 2 = 0 THEN CAST(s AS VARCHAR) ELSE '-' END || ' §' || CASE WHEN s % 3 = 0 THEN 'sec' ELSE '-' END AS label, CASE WHEN p % 4 = 0 THEN 'active' WHEN p % 4 < 3 THEN 'superseded' ELSE 'unknown' END AS version_status, row_number() OVER (PARTITION BY root, p, s % 2 ORDER BY chunk) = 1 AS is_source FROM c""")
def evidence_proofs(spark, sf):
    return verification.evidence(*_proof(spark, sf))


@query("SELECT l_orderkey AS experiment_id, CASE WHEN l_orderkey % 3 = 1 THEN 'closed' END AS promoted, CASE WHEN l_orderkey % 3 = 2 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'ready_to_promote' ELSE CASE l_orderkey % 3 WHEN 0 THEN 'running' ELSE 'ready_to_promote' END END AS measured FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def experiment_transitions(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("experiment_id")).distinct()
    status = F.element_at(F.array(F.lit("running"), F.lit("ready_to_promote"), F.lit("closed")), (F.col("experiment_id") % 3 + 1).cast("int"))
    return e.select("experiment_id", verification.promote(status).alias("promoted"), verification.measured(status, F.col("experiment_id") % 2 == 0).alias("measured"))


def _graph(spark, sf):
    """Entities and relations read off JSON that a model would give: customers and nations of a customer's chunk."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = F.array(F.struct(F.col("c_name").alias("name"), F.lit("customer").alias("entity_type")), F.struct(F.col("n_name").alias("name"), F.lit("nation").alias("entity_type")))
    r = F.array(F.struct(F.col("c_name").alias("source"), F.lit("lives in").alias("relation"), F.col("n_name").alias("target")), F.struct(F.col("c_name").alias("source"), F.lit("knows").alias("relation"), F.lit("nobody").alias("target")))
    json = F.when(F.col("c_custkey") % 10 == 0, "not json {").otherwise(F.to_json(F.struct(e.alias("entities"), r.alias("relations"))))
    replies = c.select(F.col("c_mktsegment").alias("collection_id"), F.concat(F.lit("c://"), "c_custkey").alias("source_uri"), F.concat(F.lit("k"), "c_custkey").alias("chunk"), json.alias("json"))
    return graph.extracted(replies)


_GRAPH = """j AS (SELECT c_mktsegment AS collection_id, 'c://' || c_custkey AS source_uri, 'k' || c_custkey AS chunk, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 > 0),
  e AS (SELECT sha256(collection_id || chr(31) || chunk || chr(31) || name) AS node, name, entity_type, chunk, source_uri, collection_id FROM (SELECT *, c_name AS name, 'customer' AS entity_type FROM j UNION ALL SELECT *, n_name, 'nation' FROM j)),
  r AS (SELECT sha256(collection_id || chr(31) || chunk || chr(31) || c_name) AS source, 'lives in' AS relation_type, sha256(collection_id || chr(31) || chunk || chr(31) || n_name) AS target, chunk FROM j)"""


@query(f"WITH {_GRAPH} SELECT node, name, entity_type, chunk, source_uri, collection_id FROM e")
def extract_entities(spark, sf):
    return _graph(spark, sf)[0]


@query(f"WITH {_GRAPH} SELECT source, relation_type, target, CAST(0.9 AS DOUBLE) AS confidence, chunk FROM r")
def extract_relations(spark, sf):
    return _graph(spark, sf)[1]


@query(f"""WITH {_GRAPH}, f AS (SELECT node FROM e ORDER BY name, node LIMIT 100) SELECT CAST(1 AS BIGINT) AS query_id, node FROM e WHERE contains(name, 'AN') UNION SELECT 2, node FROM e WHERE entity_type = 'nation' AND contains(name, 'GER') UNION SELECT 3, node FROM f""")
def entity_seeds(spark, sf):
    asked = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(n).cast("string").alias("name"), F.lit(t).cast("string").alias("entity_type")) for i, n, t in ((1, "AN", None), (2, "GER", "nation"), (3, None, None))))))
    return graph.seeds(_graph(spark, sf)[0], asked)


@query(f"WITH {_GRAPH} SELECT source, target FROM r JOIN e ON node = source WHERE collection_id = 'BUILDING' AND relation_type IN ('lives in')")
def relations_in_scope(spark, sf):
    e, r = _graph(spark, sf)
    return graph.in_scope(r, e, "BUILDING", ["lives in"]).select("source", "target")


@query(f"WITH {_GRAPH}, f AS (SELECT * FROM e ORDER BY name, node LIMIT 100) SELECT f.node, r.target FROM f LEFT JOIN r ON r.source = f.node")
def graph_view(spark, sf):
    nodes, edges = graph.view(*_graph(spark, sf))
    return nodes.join(edges, F.col("node") == F.col("source"), "left").select("node", "target")


@query(f"WITH {_GRAPH}, n AS (SELECT name AS node, name, entity_type, chunk FROM e) SELECT node, arg_max(entity_type, chunk) AS entity_type, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS chunks FROM n GROUP BY node")
def upsert_entities(spark, sf):
    e = _graph(spark, sf)[0].withColumn("node", F.col("name"))
    return graph.merge_entities(e).select("node", "entity_type", F.array_join("chunks", ",").alias("chunks"))


@query(f"WITH {_GRAPH}, g AS (SELECT DISTINCT source_uri FROM e WHERE collection_id = 'BUILDING' AND length(source_uri) % 2 = 0), le AS (SELECT * FROM e WHERE NOT (collection_id = 'BUILDING' AND source_uri IN (SELECT source_uri FROM g))) SELECT 'entities' AS store, count(*) AS n FROM le UNION ALL SELECT 'relations', count(*) FROM r WHERE source IN (SELECT node FROM le) UNION ALL SELECT 'chunks', count(*) FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND 'c://' || c_custkey IN (SELECT source_uri FROM g))")
def delete_sources(spark, sf):
    e, r = _graph(spark, sf)
    chunks = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("collection_id"), F.concat(F.lit("c://"), "c_custkey").alias("source_uri"))
    gone = e.where("collection_id = 'BUILDING' and length(source_uri) % 2 = 0").select("collection_id", "source_uri")
    left = stores.delete_sources({"entities": e, "relations": r, "chunks": chunks}, gone)
    out = None
    for name, t in left.items():
        one = t.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 > 0 THEN text END AS t FROM benchmark) SELECT DISTINCT query_id, name FROM (SELECT query_id, unnest(['Name ' || query_id, substring(t, 1, 12)]) AS name FROM q WHERE t IS NOT NULL)""")
def planned_seeds(spark, sf):
    names = F.array(F.struct(F.concat(F.lit("Name "), "query_id").alias("name"), F.lit("x").alias("entity_type")), F.struct(F.substring("text", 1, 12).alias("name"), F.lit("y").alias("entity_type")))
    q = _asked(spark, sf).select("query_id", F.when(F.col("query_id") % 3 > 0, F.to_json(F.struct(names.alias("entities")))).otherwise("[]").alias("json"))
    return graph.planned_seeds(q)


def _nodes(spark, sf) -> DataFrame:
    leaves, first, root = base._tree(spark, sf)
    parent = table(spark, sf, "embeddings").select(F.format_string("%d", "vec_id").alias("node"), F.format_string("L%d", "label").alias("parent"))
    up = lambda df, level: df.select("source", "node", F.lit(level).alias("level"), "leaf")
    low = up(leaves, 0).join(parent, "node")
    mid = up(first, 1).withColumn("parent", F.lit("root"))
    return low.unionByName(mid).unionByName(up(root, 2).withColumn("parent", F.lit(None).cast("string")))


@query("SELECT 'L' || (label) AS parent, CAST(vec_id AS VARCHAR) AS node FROM embeddings WHERE label IN (2, 5) UNION ALL SELECT 'root', 'L' || label FROM (SELECT DISTINCT label FROM embeddings)")
def tree_children(spark, sf):
    n = _nodes(spark, sf)
    return tree.children(n, n.where("node in ('root', 'L2', 'L5')")).select("parent", "node")


@query("SELECT 'L' || label AS node, CAST(vec_id AS VARCHAR) AS leaf FROM embeddings UNION ALL SELECT 'root', CAST(vec_id AS VARCHAR) FROM embeddings")
def tree_leaves(spark, sf):
    return tree.leaves_of(_nodes(spark, sf)).select("node", "leaf")


@query(f"""WITH {base._TREE}, a AS (SELECT CAST(vec_id AS VARCHAR) AS node, 0 AS level, vec_id AS leaf, NULL AS summary, e AS v FROM x UNION ALL SELECT node, level, leaf, summary, v FROM n), s AS (SELECT q.vec_id AS query_id, node, level, leaf, summary, round(list_cosine_similarity(q.e, v) / (1 + level), 6) AS score FROM a, x q WHERE q.vec_id % 50 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM s) SELECT query_id, rank, CASE level WHEN 0 THEN 'source' ELSE 'summary' END AS kind, CASE level WHEN 0 THEN 'v' || leaf ELSE node END AS chunk, leaf AS document_id, CASE level WHEN 0 THEN 'text ' || leaf ELSE summary END AS text FROM t WHERE rank <= 10 AND leaf % 7 <> 3""")
def tree_hit_kinds(spark, sf):
    leaves, first, root = base._tree(spark, sf)
    cols = ["node", F.concat(F.lit("v"), "leaf").alias("leaf"), "summary"]
    nodes = leaves.withColumn("summary", F.lit(None).cast("string")).select(*cols).unionByName(first.select(*cols)).unionByName(root.select(*cols))
    registry = table(spark, sf, "embeddings").where("vec_id % 7 <> 3").select(F.concat(F.lit("v"), "vec_id").alias("chunk"), F.col("vec_id").alias("document_id"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.concat(F.lit("text "), "vec_id").alias("text"))
    return tree.kinds(base.tree_search_top10(spark, sf), nodes, registry).select("query_id", "rank", "kind", "chunk", "document_id", "text")


@query(base.ORACLES["retrieval_metrics"].join(("SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM (", ")")))
def eval_report(spark, sf):
    return retrieval.report(base.retrieval_metrics(spark, sf))


@query(f"""WITH {base._COS}, l AS (SELECT query_id, vec_id % 100 AS d, vec_id // 100 AS ver, rank FROM kn), v AS (SELECT vec_id % 100 AS d, max(vec_id // 100) AS ver FROM embeddings GROUP BY 1), f AS (SELECT query_id, d, min(rank) AS r0 FROM l JOIN v USING (d, ver) GROUP BY ALL), g AS (SELECT query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY r0, d) AS rank FROM f),
  a AS (SELECT DISTINCT vec_id AS query_id, vec_id % 100 AS d FROM embeddings WHERE vec_id % 50 = 0) SELECT a.query_id, CAST(coalesce(max(CASE WHEN rank <= 5 THEN 1 END), 0) AS INT) AS hit, round(coalesce(max(1.0 / rank), 0), 6) AS mrr FROM a LEFT JOIN g ON g.query_id = a.query_id AND g.d = a.d GROUP BY a.query_id""")
def golden_eval(spark, sf):
    """Vectors as versions of documents: the golden document of a query is its own."""
    e = table(spark, sf, "embeddings")
    of = lambda c: ((F.col(c) % 100).alias("doc_id"), F.floor(F.col(c) / 100).alias("version"))
    ranked = base.knn_cosine_top10(spark, sf).select("query_id", *of("vec_id"), "rank")
    relevant = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 100).alias("doc_id"))
    return retrieval.golden(ranked, e.select(*of("vec_id")), relevant).select("query_id", "hit", "mrr")


@query(f"""WITH {base._BM25}{base._OVER}, r AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40 AND doc_id < 400), th AS (SELECT * FROM ov WHERE rank <= 10), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
  f AS (SELECT n.query_id, k, n, (SELECT count(DISTINCT th.doc_id) FROM th JOIN r ON r.query_id = th.query_id AND r.doc_id = th.doc_id WHERE th.query_id = n.query_id AND th.rank <= k) AS found FROM n, (VALUES (5), (10)) x(k)), u AS (SELECT DISTINCT query_id FROM th WHERE query_id NOT IN (SELECT query_id FROM n))
  SELECT CAST(k AS INT) AS k, round(avg(rec), 6) AS recall FROM (SELECT k, round(found / n, 6) AS rec FROM f UNION ALL SELECT k, 1.0 FROM u, (VALUES (5), (10)) x(k)) GROUP BY k""")
def chunk_benchmark(spark, sf):
    """Recall at 5 and 10 of overlap retrieval, as if a fixed handful of documents were each item's answer."""
    d = _docs(spark, sf)
    relevant = _asked(spark, sf).select("query_id", (F.col("query_id") % 40).alias("m")).join(d.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 40).alias("m")), "m").select("query_id", F.col("doc_id").alias("item"))
    return search.benchmark(chunking.fixed(d), _asked(spark, sf), relevant)


@query("""WITH s AS (SELECT event_id % 97 AS query_id, CASE event_id % 2 WHEN 0 THEN 'context_precision' ELSE 'faithfulness' END AS metric, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 3.0 ELSE (event_id % 10) / 10.0 END AS x FROM events), c AS (SELECT query_id, metric, greatest(0, least(1, coalesce(x, 0))) AS x FROM s)
  SELECT query_id, metric, round(avg(CASE metric WHEN 'context_precision' THEN CASE WHEN x >= 0.5 THEN 1 ELSE 0 END ELSE x END), 6) AS value FROM c GROUP BY ALL""")
def judge_metrics(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 11 == 0, "none").when(i % 7 == 0, " 3.0").otherwise(((i % 10) / 10).cast("string"))
    e = table(spark, sf, "events").select((i % 97).alias("query_id"), F.when(i % 2 == 0, "context_precision").otherwise("faithfulness").alias("metric"), raw.alias("raw"))
    return search.judged_metrics(e)


@query("""SELECT doc_id, 'embed:' || sha256(text) || ':m:64' AS "key", doc_id % 3 = 0 AS hit FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""")
def embedding_cache(spark, sf):
    d = _docs(spark, sf).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", stores.embedding_key(F.col("text"), F.lit("m"), F.lit(64)).alias("key"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01 23:30:00")).otherwise(F.lit("2024-01-01 22:59:59")).cast("timestamp")
    return stores.cached(d, d.select("key", F.lit(1.0).alias("value"), at.alias("at")), now).select("doc_id", "key", "hit")


@query("""SELECT item_id, text || ':c:10:[]' AS "key", item_id >= (SELECT max(item_id) FROM benchmark) - 19 AND item_id % 2 = 0 AS hit FROM benchmark""")
def query_cache(spark, sf):
    """A cache of 20 entries, the newest; those of the collection "d" were invalidated."""
    key = lambda c: stores.query_key(F.col("text"), c, F.lit(10), F.lit(None).cast("string"))
    b = table(spark, sf, "benchmark")
    entries = b.select(key(F.when(F.col("item_id") % 2 == 0, "c").otherwise("d-coll")).alias("key"), F.col("item_id").alias("value"), F.timestamp_seconds("item_id").alias("at"))
    cache = stores.invalidated(stores.kept_in_cache(entries, 20), ":d-coll:")
    return stores.cached(b.select("item_id", key(F.lit("c")).alias("key")), cache, F.timestamp_seconds(F.lit(0))).select("item_id", "key", "hit")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_newest(spark, sf):
    return stores.newest(table(spark, sf, "events"), 100, "ts", "event_id").select("event_id", "event_type")


def _changes(spark, sf):
    o = table(spark, sf, "orders")
    last = lambda df: df.groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("k"))
    v = last(o.where("o_orderkey % 2 = 0")).select("document_id", F.lit(3).alias("version_num"), F.sha2((F.col("k") % 4).cast("string"), 256).alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit("active").alias("status"))
    new = last(o).select("document_id", F.sha2((F.col("k") % 4).cast("string"), 256).alias("content_hash"), F.lit("2024-01-02").cast("timestamp").alias("at"))
    return v, new


_CHANGES = """oldv AS (SELECT o_custkey AS document_id, max(o_orderkey) % 4 AS h FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), newv AS (SELECT o_custkey AS document_id, max(o_orderkey) % 4 AS h FROM orders GROUP BY 1),
  ch AS (SELECT n.document_id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM newv n LEFT JOIN oldv o USING (document_id))"""


@query(f"WITH {_CHANGES} SELECT document_id, change, CASE change WHEN 'new' THEN 1 WHEN 'unchanged' THEN 3 ELSE 4 END AS version_num FROM ch")
def ingest_changes(spark, sf):
    v, new = _changes(spark, sf)
    return lifecycle.classified(new, v).select("document_id", "change", "version_num")


@query(f"""WITH {_CHANGES} SELECT document_id, 3 AS version_num, CASE change WHEN 'changed' THEN 'superseded' ELSE 'active' END AS status FROM oldv LEFT JOIN ch USING (document_id) UNION ALL SELECT document_id, CASE change WHEN 'new' THEN 1 ELSE 4 END, 'active' FROM ch WHERE change <> 'unchanged'""")
def add_versions(spark, sf):
    v, new = _changes(spark, sf)
    return lifecycle.add_versions(v, new).select("document_id", "version_num", "status")


@query("""WITH v AS (SELECT o_custkey AS document_id, max(o_orderdate) AS "at", count(*) AS n_versions FROM orders GROUP BY 1), m AS (SELECT v.*, c_name AS source_uri, c_mktsegment AS collection_id FROM v JOIN customer ON c_custkey = document_id) SELECT document_id, n_versions, row_number() OVER (PARTITION BY collection_id ORDER BY "at" DESC, source_uri) AS place FROM m""")
def list_documents(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("source_uri"), F.col("c_mktsegment").alias("collection_id"))
    return lifecycle.documents_newest_first(base._versions(spark, sf), c).select("document_id", "n_versions", F.col("place").cast("int"))


@query(f"""WITH {base._VERSIONS}, m AS (SELECT v.*, c_mktsegment AS collection_id FROM v JOIN customer ON c_custkey = document_id), a AS (SELECT *, count(*) FILTER (status <> 'deleted') OVER (PARTITION BY document_id) AS alive, CAST(floor((epoch(TIMESTAMP '1999-01-01') - epoch("at")) / 86400) AS BIGINT) AS age_days FROM m WHERE collection_id IN ('BUILDING', 'MACHINERY'))
  SELECT document_id, version_num, alive = 1 AS is_last FROM a WHERE status = 'superseded' AND age_days >= CASE collection_id WHEN 'BUILDING' THEN 500 ELSE 1500 END""")
def gc_policies(spark, sf):
    v = base._versions(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("collection_id")), "document_id")
    policies = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("collection_id"), F.lit(p).alias("policy"), F.lit(d).alias("days")) for c, p, d in (("BUILDING", "retention", 500), ("MACHINERY", "retention", 1500), ("AUTOMOBILE", "replace", 1))))))
    return lifecycle.collected(v, policies, F.lit("1999-01-01").cast("timestamp")).select("document_id", "version_num", "is_last")


@query("""WITH r AS (SELECT user_id AS "key", event_type AS h, event_id AS id, first_value(event_id) OVER w AS op, first_value(event_type) OVER w AS fh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT "key", id, op AS operation, CASE WHEN op = id THEN 'accepted' WHEN fh = h THEN 'existing' ELSE 'conflict' END AS outcome FROM r""")
def submissions(spark, sf):
    e = table(spark, sf, "events")
    return lifecycle.submissions(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("hash"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


@query("""WITH s AS (SELECT l_orderkey AS operation_id, ['load', 'dedup', 'embed', 'snapshot', 'vector_write', 'entity_extract', 'raptor_build'][l_linenumber] AS stage, l_suppkey % 5 > 0 AS success, l_partkey AS duration_ms FROM lineitem)
  SELECT operation_id, CASE WHEN count(*) FILTER (NOT success AND stage IN ('load', 'embed', 'vector_write')) > 0 THEN 'failed' WHEN count(*) FILTER (NOT success) > 0 THEN 'partial_success' ELSE 'success' END AS status, coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (NOT success), '') AS failed, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM s GROUP BY operation_id""")
def ingest_progress(spark, sf):
    names = F.array(*map(F.lit, ("load", "dedup", "embed", "snapshot", "vector_write", "entity_extract", "raptor_build")))
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("operation_id"), F.element_at(names, F.col("l_linenumber").cast("int")).alias("stage"), (F.col("l_suppkey") % 5 > 0).alias("success"), F.col("l_partkey").alias("duration_ms"))
    return lifecycle.progress(s).withColumn("failed", F.array_join("failed", ","))


@query("SELECT event_id, CAST(least(30, power(2, event_id % 8)) AS DOUBLE) AS bound FROM events")
def retry_bounds(spark, sf):
    return table(spark, sf, "events").select("event_id", lifecycle.retry_bound(F.col("event_id") % 8).alias("bound"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(CAST(trunc(l_quantity) AS BIGINT), l_suppkey) - greatest(CAST(l_linenumber AS BIGINT), l_partkey % 10)) AS overlap FROM lineitem")
def interval_overlaps(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalar.overlap(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.col("l_partkey") % 10, F.col("l_suppkey")).cast("long").alias("overlap"))


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'a', '&lt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS text_hash FROM documents""")
def xml_unescaped(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(scalar.xml_unescape(F.replace("text", F.lit("a"), F.lit("&lt;"))), 256).alias("text_hash"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {_PASSAGES}, tl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n, trim(regexp_extract(text, '(?s)^(.*?[.!?])(?:\\s|$)', 1)) AS line FROM pa WHERE query_id % 2 = 0)
  SELECT q.item_id AS query_id, coalesce(sha256(a), sha256('No relevant documents were found.')) AS answer_hash, CASE WHEN a IS NULL THEN 'no_context' ELSE 'ok' END AS status FROM benchmark q LEFT JOIN (SELECT query_id, string_agg(line || ' [P' || n || ']', ' ' ORDER BY n) AS a FROM tl WHERE n <= 2 GROUP BY query_id) ON query_id = item_id""")
def generate_answers(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    p = _passages(spark, sf).where("query_id % 2 = 0").withColumn("ref", F.concat(F.lit("P"), F.row_number().over(w)))
    got = context.extractive(_asked(spark, sf).select("query_id").join(p.select("query_id", "ref", "text"), "query_id", "left"))
    return got.select("query_id", F.sha2("answer", 256).alias("answer_hash"), "status")


_TRIM = "regexp_replace({x}, '^[ \\t\\n\\r\\x0B\\f]+', '')"
_ENDS = "regexp_replace({x}, '[ \\t\\n\\r\\x0B\\f]+$', '')"


def _trimmed(parts: str, where: str = "") -> str:
    """Chunks from ``parts`` (doc_id, pos, at0, raw): trimmed, with their bytes."""
    lead = _TRIM.format(x="raw")
    return f"""SELECT doc_id, CAST(pos AS INT) AS pos, CAST(at0 + strlen(raw) - strlen(t) AS BIGINT) AS "start", CAST(at0 + strlen(raw) - strlen(t) + strlen({_ENDS.format(x="t")}) AS BIGINT) AS "end", {_ENDS.format(x="t")} AS text FROM (SELECT *, {lead} AS t FROM {parts}) WHERE {_ENDS.format(x="t")} <> '' {where}"""


_PIECES = """pc AS (SELECT doc_id, unnest(l) AS seg, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS l FROM documents)),
  sg AS (SELECT *, sum(strlen(seg)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(seg) AS at0 FROM pc)"""

#: SQL of queries that other modules define: greedy steps as recursive queries.
ORACLES["chunk_propositional"] = f"""WITH {_PIECES.format(pattern='[^.!?\\n]+|[.!?\\n]')}, ow AS (SELECT doc_id, at0, seg AS raw, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM sg WHERE seg NOT IN ('.', '!', '?', chr(10))) {_trimmed('ow')}"""
ORACLES["chunk_semantic"] = f"""WITH RECURSIVE {_PIECES.format(pattern='[^.!?]*[.!?]|[^.!?]+')},
  gr AS (SELECT doc_id, i, 0 AS g, strlen(seg) AS used FROM sg WHERE i = 1 UNION ALL
    SELECT sg.doc_id, sg.i, CASE WHEN used + strlen(seg) > 1000 THEN g + 1 ELSE g END, CASE WHEN used + strlen(seg) > 1000 THEN 0 ELSE used END + strlen(seg) FROM gr JOIN sg ON sg.doc_id = gr.doc_id AND sg.i = gr.i + 1),
  ow AS (SELECT doc_id, g AS pos, min(at0) AS at0, string_agg(seg, '' ORDER BY i) AS raw FROM gr JOIN sg USING (doc_id, i) GROUP BY doc_id, g) {_trimmed('ow')}"""
# The documents have neither headings nor code fences; both are tested on small texts.
ORACLES["chunk_hierarchical"] = f"""WITH ow AS (SELECT doc_id, 0 AS pos, 0 AS at0, text AS raw FROM documents) {_trimmed('ow')}"""
ORACLES["chunk_structure"] = f"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  lo AS (SELECT *, strlen(line) + 1 AS n, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - 1 AS at0 FROM ln),
  gr AS (SELECT doc_id, i, 0 AS g, n AS used FROM lo WHERE i = 1 UNION ALL
    SELECT lo.doc_id, lo.i, CASE WHEN x THEN g + 1 ELSE g END, CASE WHEN x THEN 0 ELSE used END + n FROM gr JOIN lo ON lo.doc_id = gr.doc_id AND lo.i = gr.i + 1, LATERAL (SELECT used + n > 2000 AND NOT starts_with({_TRIM.format(x='line')}, '|') AS x)),
  ow AS (SELECT doc_id, g AS pos, min(at0) AS at0, string_agg(line, chr(10) ORDER BY i) AS raw FROM gr JOIN lo USING (doc_id, i) GROUP BY doc_id, g) {_trimmed('ow').replace("<> ''", "IS NOT NULL")}"""
ORACLES["cluster_passages"] = f"""WITH RECURSIVE {base._BM25}, h AS (SELECT query_id, doc_id, doc_id || ':' || pos AS chunk, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, "start", doc_id || ':' || pos) AS n FROM bm JOIN fixed USING (doc_id, pos)),
  r AS (SELECT query_id, doc_id, n, chunk, [{{'s': s, 'e': e}}] AS anchors, CAST(0 AS BIGINT) AS cluster FROM h WHERE n = 1 UNION ALL
    SELECT h.query_id, h.doc_id, h.n, h.chunk, CASE WHEN joins THEN anchors ELSE list_append(anchors, {{'s': h.s, 'e': h.e}}) END, CASE WHEN joins THEN list_position(ov, list_max(ov)) - 1 ELSE len(anchors) END
    FROM r JOIN h ON h.query_id = r.query_id AND h.doc_id = r.doc_id AND h.n = r.n + 1, LATERAL (SELECT list_transform(r.anchors, lambda a: greatest(0, least(h.e, a.e) - greatest(h.s, a.s))) AS ov), LATERAL (SELECT list_max(ov) > 0 AND 2 * list_max(ov) >= h.e - h.s AS joins))
  SELECT query_id, doc_id, chunk, cluster FROM r"""
ORACLES["pack_budget"] = f"""WITH RECURSIVE {base._BM25}, c AS (SELECT query_id, doc_id || ':' || pos AS id, score, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM bm JOIN fixed USING (doc_id, pos)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM c),
  r AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, 0 AS i, false AS taken FROM o UNION ALL SELECT r.query_id, o.n, CASE WHEN used + cost <= 400 THEN used + cost ELSE used END, CASE WHEN used + cost <= 400 THEN i + 1 ELSE i END, used + cost <= 400 FROM r JOIN o ON o.query_id = r.query_id AND o.n = r.n + 1)
  SELECT query_id, 'P' || i AS ref, id, score, cost FROM r JOIN o USING (query_id, n) WHERE taken"""
_EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
ORACLES["rate_limits"] = f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, n, event_id, t AS s, 1 AS k FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - s >= 86400 THEN e.t ELSE s END, CASE WHEN e.t - s >= 86400 THEN 1 ELSE k + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT event_id, CASE WHEN k <= 3 THEN 'true' ELSE 'false' END AS allowed FROM r"""
ORACLES["circuit_breaker"] = f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'closed' AS state, 0 AS k, CAST(0 AS DOUBLE) AS at0 FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.n, e.event_id, CASE WHEN NOT e.failed THEN 'closed' WHEN was = 'closed' AND k + 1 >= 2 THEN 'open' ELSE was END, CASE WHEN NOT e.failed THEN 0 WHEN was = 'closed' THEN k + 1 ELSE k END, CASE WHEN e.failed AND was = 'closed' AND k + 1 >= 2 THEN e.t ELSE at0 END
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT CASE WHEN r.state = 'open' AND e.t - r.at0 >= 86400 THEN 'half_open' ELSE r.state END AS was))
  SELECT event_id, state FROM r WHERE n > 0"""
