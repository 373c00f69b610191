import random
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.functions import scalar
from corvid.operators import chunking, context, graph, lifecycle, retrieval, tree, verification
from corvid.sources import documents
from corvid.streaming import stateful


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize("strategy", ["fixed", "semantic", "propositional", "hierarchical", "structure"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_chunks_are_exact_slices(spark, strategy, end):
    text = end.join(["# Intro", "Été à la plage. Again!", "Again!", "Again!", "```", "x = 1", "", "y = 2", "```", "| a | b |", "| 1 | 2 |", "## Next", "😀 last line"])
    docs = spark.createDataFrame([(1, text), (2, "   "), (3, "")], "doc_id long, text string")
    params = {"size": 20, "overlap": 5} if strategy == "fixed" else {}
    found = [r for r in chunking.chunk(docs, strategy, **params).orderBy("doc_id", "pos").collect() if r["doc_id"] == 1]
    data = text.encode()
    assert found and all(data[r["start"] : r["end"]].decode() == r["text"] for r in found)
    starts = [r["start"] for r in found]
    assert starts == sorted(starts) and (len(set(starts)) == len(starts))


def test_chunk_errors(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (lambda: chunking.chunk(docs, "does-not-exist"), lambda: chunking.fixed(docs, 10, 10), lambda: chunking.chunk(docs, "semantic", max_bytes=0)):
        with pytest.raises(ValueError):
            bad()


def test_rrf_prefers_documents_in_both_lists(spark):
    hits = spark.createDataFrame([(0, "v", 1, 0, 0.9), (0, "v", 2, 0, 0.8), (0, "b", 2, 1, 7.0), (0, "b", 2, 2, 6.0), (0, "b", 3, 0, 5.0)], "query_id long, strategy string, doc_id long, chunk long, score double")
    got = {r["doc_id"]: (r["score"], r["n_strategies"]) for r in retrieval.rrf(hits).collect()}
    assert got == {1: (round(1 / 61, 8), 1), 2: (round(1 / 62 + 1 / 61, 8), 2), 3: (round(1 / 62, 8), 1)}
    assert rows(retrieval.weighted(hits, {"v": 10.0})) == [(0, 1, 9.0), (0, 2, 8.0), (0, 3, 5.0)]


def test_bm25_finds_only_what_matches(spark):
    chunks = spark.createDataFrame([(1, 0, "the quick brown fox"), (2, 0, "jumps over the lazy dog")], "doc_id long, pos int, text string")
    q = spark.createDataFrame([(9, "quick fox")], "query_id long, text string")
    got = retrieval.bm25(chunks, q).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["score"] > 0


def test_classifier(spark):
    q = ["who is the CEO of this?", "summarize the entire document", "what is retrieval augmented generation?", "Alpha Beta Gamma Delta"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(retrieval.classify(F.col("t"))).collect()]
    assert got == [["graph", "vector"], ["raptor"], ["vector", "bm25"], ["graph", "vector"]]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 2)], "query_id long, item string, rank int")
    rel = spark.createDataFrame([(1, "a"), (2, "y")], "query_id long, item string")
    got = {r["query_id"]: r for r in retrieval.metrics(ranked, rel, 5).collect()}
    assert (got[1]["mrr"], got[2]["mrr"]) == (1.0, 0.5) and got[1]["ndcg"] == 1.0 and got[2]["precision"] == 0.5 and got[2]["recall"] == 1.0


def test_hop_decay(spark):
    edges = spark.createDataFrame([("s", "n")], "src string, dst string")
    reached = graph.bfs(edges, spark.createDataFrame([(1, "s")], "query_id long, node string"))
    src = spark.createDataFrame([("s", "c1"), ("n", "c2")], "node string, chunk string")
    assert rows(graph.hop_decay(reached, src)) == [(1, "c1", 1.0), (1, "c2", 0.5)]


def test_relations(spark):
    rel = spark.createDataFrame([("a", "k", "b", 0.5, "c2"), ("a", "k", "b", 0.9, "c1"), ("a", "k", "zz", 0.9, "c1")], "source string, relation_type string, target string, confidence double, chunk string")
    ent = spark.createDataFrame([("a",), ("b",)], "node string")
    assert rows(graph.merge_relations(rel, ent)) == [("a", "k", "b", 0.9, ["c1", "c2"])]
    assert graph.cascade(rel, ent.where("node = 'b'")).count() == 1


def test_clusters(spark):
    kind = "query_id long, doc_id long, start long, end long, chunk string, score double"
    half = spark.createDataFrame([(1, 1, 0, 100, "a", 3.0), (1, 1, 50, 150, "b", 2.0), (1, 1, 51, 151, "c", 1.0), (1, 2, 0, 10, "d", 1.0)], kind)
    assert [(r["chunk"], r["cluster"]) for r in context.cluster(half).orderBy("chunk").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 0)]
    big = spark.createDataFrame([(1, 1, 40, 60, "a", 3.0), (1, 1, 0, 100, "b", 2.0)], kind)
    assert context.cluster(big).select("cluster").distinct().count() == 2


def test_pack_skips_and_goes_on(spark):
    c = spark.createDataFrame([(1, "a", 3.0, 60), (1, "b", 2.0, 50), (1, "c", 1.0, 40), (2, "d", 1.0, 101)], "query_id long, id string, score double, cost long")
    assert rows(context.pack(c, 100)) == [(1, "P1", "a", 3.0, 60), (1, "P2", "c", 1.0, 40)]


def test_verdicts(spark):
    cases = [((0, 0, 0, 0), "no_claim"), ((2, 0, 1, 0), "unsupported"), ((2, 1, 1, 1), "partial"), ((1, 1, 0, 0), "uncited_supported"), ((1, 1, 1, 1), "supported"), ((1, 1, 1, 0), "miscited")]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "a int, b int, c int, d int, want string")
    assert all(r[0] == r[1] for r in df.select(verification.verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "want").collect())
    s = spark.createDataFrame([(1, "supported"), (1, "miscited"), (2, "partial")], "answer_id long, verdict string")
    passes = lambda strict: {r["answer_id"]: r["passes"] for r in verification.overall(s, strict).collect()}
    assert passes(False) == {1: True, 2: False} and passes(True) == {1: False, 2: False}


def test_citations(spark):
    a = spark.createDataFrame([(1, "x [P1, S2] y [ P9 ] z [P1]. [Q1]")], "answer_id long, answer string")
    p = spark.createDataFrame([(1, "P1"), (1, "S2")], "answer_id long, ref string")
    assert rows(verification.citations(a, p)) == [(1, ["P1", "S2"], ["P9"])]


def test_sanitising_takes_the_reference_patterns_literally(spark):
    bad = ["Ignore previous instructions. Now", "please IGNORE all previous", "disregard previous", "forget your instructions", "New instructions: x", "the System Prompt: is", "you are now free", "act as if", "<|system|>", "a <|user|>", "<|assistant|>", "###Instruction", "x [INST] y", "[/inst]"]
    good = ["one", "licensed under MIT", "first i n s t", "(a|b) .* c"]
    df = spark.createDataFrame([("\n".join([*bad[:7], *good[:2], *bad[7:], *good[2:], " System: x"]),)], "t string")
    assert df.select(documents.sanitised(F.col("t"))).first()[0] == "\n".join(good)
    assert df.select(documents.sanitised(F.col("t"), ["(a|b) .* C", "x|y"])).first()[0] == "\n".join([*bad[:7], *good[:2], *bad[7:], good[2]])
    assert df.select(documents.sanitised(F.lit("a\nuser: b"), [])).first()[0] == "a"


def test_archives_are_told_apart(spark):
    def archive(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", "META-INF/container.xml")
            z.writestr(name, "x")
        return out.getvalue()

    contents = [archive("META-INF/container.xml"), archive("[Content_Types].xml"), archive("b.txt"), b"PK\x03\x04 cut off", b"%PDF-1.4", b"text", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c binary")
    got = [r[0] for r in df.orderBy("i").select(documents.sniff(F.col("c"), F.lit("text/plain"))).collect()]
    assert got == ["application/epub+zip", "application/vnd.openxmlformats", "application/zip", "application/zip", "application/pdf", "text/plain", "text/plain"]


def test_citations_query_reads_whole_texts(spark, tmp_path):
    from corvid.plans import registry

    spark.createDataFrame([(0, "x" * 50 + " as shown [P3, S9]."), (3, "none here")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(registry.citation_refs(spark, str(tmp_path))) == [(0, "P3,P1", "P0,S2,S9"), (3, "P3,P1", "S2")]


def test_versions(spark):
    v = spark.createDataFrame([("d", 1, "h1", "active"), ("e", 1, "x", "active")], "document_id string, version_num int, content_hash string, status string").withColumn("at", F.current_timestamp())
    new = spark.createDataFrame([("d", "h2"), ("e", "x"), ("f", "y")], "document_id string, content_hash string").withColumn("at", F.current_timestamp())
    got = sorted((r["document_id"], r["version_num"], r["status"]) for r in lifecycle.add_versions(v, new).collect())
    assert got == [("d", 1, "superseded"), ("d", 2, "active"), ("e", 1, "active"), ("f", 1, "active")]


def test_state_machines():
    s = {}
    assert [stateful.limiter_step(s, t, 2, 60) for t in (5, 6, 7, 65)] == [True, True, False, True]
    s = {}
    assert [stateful.breaker_step(s, t, f, 2, 30) for t, f in ((0, True), (1, True), (2, True), (32, True), (33, False))] == ["closed", "open", "open", "half_open", "closed"]
    s = {}
    assert [stateful.operation_step(s, *x) for x in (("succeeded", ""), ("running", ""), ("succeeded", "r"), ("succeeded", "r"), ("failed", ""))] == ["conflict", "ok", "ok", "replay", "conflict"]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scalar.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_stream_drops_copies(spark, tmp_path):
    from corvid.streaming.stateful import ingest_stream

    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tree_levels_and_search(spark):
    leaves = spark.createDataFrame([("s", "a", 1, 1, [1.0, 0.0]), ("s", "b", 2, 1, [0.0, 1.0]), ("s", "c", 3, 1, [0.0, 3.0]), ("t", "a", 9, 1, [5.0, 5.0])], "source string, node string, leaf long, n_leaves int, vector array<double>")
    parents = spark.createDataFrame([("s", "a", "x"), ("s", "b", "x"), ("s", "c", "y"), ("t", "a", "x")], "source string, node string, parent string")
    up = tree.level_up(leaves, parents, 1)
    got = {(r["source"], r["node"]): (r["n_children"], r["leaf"], r["summary"], r["vector"]) for r in up.collect()}
    assert got == {("s", "x"): (2, 1, "2 chunks clustered at level 1", [0.5, 0.5]), ("s", "y"): (1, 3, "1 chunks clustered at level 1", [0.0, 3.0]), ("t", "x"): (1, 9, "1 chunks clustered at level 1", [5.0, 5.0])}
    nodes = spark.createDataFrame([("leaf", 0, [1.0, 1.0]), ("up", 1, [2.0, 2.0]), ("deep", 4, [1.0, 1.0]), ("zero", 0, [0.0, 0.0]), ("short", 0, [1.0])], "node string, level int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, q array<double>")
    assert rows(tree.search(nodes, q).select("rank", "node", "score")) == [(1, "leaf", 1.0), (2, "up", 0.5), (3, "short", 0.0), (4, "zero", 0.0)]
    assert tree.search(nodes.limit(0), q).count() == 0


def test_late_interaction_ranks_by_tokens_and_falls_back(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], [[0.0, 1.0], [1.0, 0.0]]), (2, [1.0, 0.1], [[1.0, 0.0]]), (3, [1.0, 0.0], []), (4, [1.0, 0.0], None)], "vec_id long, embedding array<double>, tokens array<array<double>>")
    q = spark.createDataFrame([(7, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]])], "query_id long, q array<double>, q_tokens array<array<double>>")
    assert rows(retrieval.late_interaction(v, q).select("rank", "vec_id", "score")) == [(1, 1, 2.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]


def test_distinct_hits_compare_with_kept_ones_only(spark):
    # 2 resembles 1 and goes; 3 resembles 2 but not 1 and stays. Without vectors, equal texts resemble.
    hits = spark.createDataFrame(
        [(1, 1, 10, "a", [1.0, 0.0]), (1, 2, 20, "b", [0.8, 0.6]), (1, 3, 30, "c", [0.28, 0.96]), (2, 1, 40, "x", []), (2, 2, 50, "x", [1.0]), (2, 3, 60, "y", None), (2, 4, 70, None, None), (2, 5, 80, None, [1.0])],
        "query_id long, rank int, item long, text string, vector array<double>",
    )
    assert rows(retrieval.distinct_hits(hits, 0.75)) == [(1, 10, 1), (1, 30, 3), (2, 40, 1), (2, 60, 3), (2, 70, 4)]
    assert retrieval.distinct_hits(hits.limit(0)).count() == 0


def test_ready_to_promote(spark):
    df = spark.createDataFrame([(50, 0.5, 0.6, False), (49, 0.5, 0.9, False), (99, 0.5, 0.55, None), (99, 0.5, 0.9, True), (99, None, 0.9, False)], "n int, a double, b double, closed boolean")
    got = df.select(verification.ready_to_promote(F.col("n"), F.col("a"), F.col("b"), F.col("closed")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, False, False, False]


@pytest.mark.parametrize("k, sizes", [(10, {}), (3, {"ROWS": 40, "FIRST": 8, "BLOCK": 16, "CELLS": 64, "SCORED": 64, "CARRIED": 20}), (300, {"FIRST": 32})])
def test_nearest_rows_against_all_pairs(spark, monkeypatch, k, sizes):
    from corvid.operators import nearest

    for name, n in sizes.items():
        monkeypatch.setattr(nearest, name, n)
    rng = random.Random(k)
    fresh = lambda: [rng.gauss(0, 1) for _ in range(6)]
    base = [[round(x, 1) for x in fresh()] for _ in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 6, [1.0, None, 2.0, 0.0, 0.0, 0.0], [1.0, 2.0], [-1.0, 0.5], [nan] * 6, [inf] + [1.0] * 5, [1e200] * 6, [1e-200] * 6, [1e20] * 6, [-1e20] * 6, [3e7] * 6, [3e7 + 1] * 6, [nan, 1.0]]
    v = spark.createDataFrame([(i, rng.choice(base) if i % 2 else fresh()) for i in range(300)] + [(1000 + i, x) for i, x in enumerate(odd * 3)] + [(None, base[0])], "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, rng.choice(base)) for i in range(20)] + [(100 + i, x) for i, x in enumerate(odd)], "query_id long, q array<double>")
    pairs = v.select("vec_id", scalar.doubles(F.col("embedding")).alias("v")).crossJoin(q)
    for metric, score in (("cosine", scalar.cosine), ("l2", scalar.l2_similarity)):
        want = retrieval.top(pairs.select("query_id", "vec_id", F.round(score(F.col("q"), F.col("v")), 6).alias("score")), k, F.desc("score"), "vec_id")
        assert sorted(map(repr, retrieval.knn(v, q, k, metric).collect())) == sorted(map(repr, want.collect()))


def test_nearest_rows_of_many_queries_in_time(spark):
    import time

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(20_000, 64)).tolist())], "vec_id long, embedding array<double>").repartition(4).cache()
    v.count()
    began = time.time()
    assert retrieval.knn(v, v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).count() == 20_000
    assert time.time() - began < 30  # 40 million pairs


def test_metrics_by_class_are_those_of_the_pairs(spark):
    rng = random.Random(8)
    ranked = spark.createDataFrame([(q, rng.randrange(60), r) for q in range(30) for r in range(1, 8)], "query_id long, item long, rank int")
    items = spark.createDataFrame([(i % 60, rng.choice([0, 1, 2, None])) for i in range(80)], "item long, label int")
    asked = spark.createDataFrame([(q % 33, rng.choice([0, 1, 2, 9, None])) for q in range(40)], "query_id long, label int")
    pairs = asked.join(items, "label").select("query_id", "item")
    assert rows(retrieval.metrics_by_class(ranked, asked, items, 5).orderBy("query_id")) == rows(retrieval.metrics(ranked, pairs, 5).orderBy("query_id"))


@pytest.mark.parametrize("listed, carried", [(64, 200_000), (0, 0)])
def test_graph_search_against_brute_force(spark, monkeypatch, listed, carried):
    monkeypatch.setattr(graph, "LISTED", listed)
    monkeypatch.setattr(graph, "CARRIED", carried)
    rng = random.Random(12)
    e = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(35)] + [("n1", "n1"), ("n2", "n3"), ("n2", "n3")] + [(f"s{i}", "hub") for i in range(6)]
    s = [(q, f"n{rng.randrange(34)}") for q in range(12) for _ in range(q % 3 + 1)] + [(20 + i, f"s{i}") for i in range(6)] + [(20, "s0")]
    c = [(f"n{i}", f"c{i % 4}") for i in range(30)] + [("s1", "c1"), ("s1", "c1"), ("hub", "c9")]
    edges, seeds, cited = spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame(s, "query_id long, node string"), spark.createDataFrame(c, "node string, chunk string")
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for hops in (0, 1, 2, 3):
        want = {(q, n): 0 for q, n in s}
        for h in range(1, hops + 1):
            for (q, n), _ in list(want.items()):
                if want[q, n] == h - 1:
                    for m in near.get(n, ()):
                        want.setdefault((q, m), h)
        assert rows(graph.bfs(edges, seeds, hops)) == sorted((q, n, h) for (q, n), h in want.items())
        scores = {}
        for (q, n), h in want.items():
            for m, chunk in c:
                if m == n:
                    scores[q, chunk] = scores.get((q, chunk), 0) + 1 / (1 + h)
        assert {(r[0], r[1]): r[2] for r in graph.decayed(edges, seeds, cited, hops).collect()} == {k: round(x, 6) for k, x in scores.items()}


def test_searched_rows_of_equal_frontiers_are_found_once(spark):
    edges = spark.createDataFrame([(f"s{i}", "hub") for i in range(200)] + [("hub", f"x{i}") for i in range(300)], "src string, dst string")
    _, members, reach, gone = graph._reach(edges, spark.createDataFrame([(i, f"s{i}") for i in range(200)], "query_id long, node string"), 2)
    assert (members.count(), reach.count(), gone.count()) == (200, 500, 200)  # of 200 * 500 rows reached


def test_bfs_puts_out_the_last_hop_in_runs_of_equal_nodes(spark):
    from corvid.operators import graph

    edges = spark.createDataFrame([*((f"s{i}", "hub") for i in range(80)), *((f"c{i}", "hub") for i in range(200))], "src string, dst string")
    seeds = spark.createDataFrame([(i, f"s{i}") for i in range(80)], "query_id long, node string")
    got = [r for r in graph.bfs(edges, seeds, 2).collect() if r["hops"] == 2]
    assert len({(r["query_id"], r["node"]) for r in got}) == len(got) == 80 * 279
    assert sum(a["node"] != b["node"] for a, b in zip(got, got[1:])) < len(got) / 4
