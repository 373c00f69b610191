"""Stores, loaders, search, assembly, verification, lifecycle and the engine on small cases, and all queries against their SQL."""

import random
import re
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.engine import Config, Engine
from corvid.functions import scalar
from corvid.operators import context, graph, lifecycle, retrieval, search, stores, tree, verification
from corvid.plans import more
from corvid.sources import documents
from corvid.sources.tables import Conflict, Payloads, Table, read_snapshots, write_snapshots

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)) else x


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(more.ORACLES))
def test_query_against_its_sql(spark, duck, name):
    from corvid.plans import registry

    df, rel = registry.queries()[name](spark, str(SF)), duck.sql(more.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ours = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[rel.columns.index(c)]) for c in sorted(df.columns)) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_tables_keep_what_was_committed(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    got = lambda: sorted(map(tuple, t.read().collect()), key=repr)
    assert got() == []
    t.append(rows(("a", 1), (None, 2)))
    t.upsert(rows(("a", 3), ("b", 4), ("b", 5), (None, 6)), F.col("v"))
    assert got() == [("a", 3), ("b", 5), (None, 6)]
    before, other = t.read(), Table(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    t.delete(F.col("k") == "a")
    assert got() == [("b", 5), (None, 6)] and before.count() == 3
    after, _ = other._state()
    t.append(rows(("c", 1)))
    with pytest.raises(Conflict):
        other._commit(after, [])
    (tmp_path / "t" / "commits" / "000000000099.json").write_text('{"fold')  # a writer died
    assert ("c", 1) in got()
    t.append(rows(("d", 1)))
    t.vacuum()
    assert [k for k, _ in got()] == ["b", "c", "d", None]


def test_payloads_and_snapshots(spark, tmp_path):
    p = Payloads(spark, str(tmp_path / "p"))
    one = p.stage(b"\x00 bytes")
    assert p.stage(b"\x00 bytes") == one and p.open(one) == b"\x00 bytes" and p.delete(one) and not p.delete(one)
    with pytest.raises(ValueError):
        p.open("../x")
    write_snapshots(spark.createDataFrame([("d", 1, b"x", "{}"), ("d", 2, b"y", None)], "document_id string, version_num int, content binary, canonical_json string"), str(tmp_path / "s"))
    assert read_snapshots(spark, str(tmp_path / "s")).where("version_num = 2").first()["content"] == b"y"


def test_loaders(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / "a.md").write_text("# x")
    (tmp_path / "repo" / ".git" / "b.md").write_text("no")
    assert [r["mime_type"] for r in documents.load_git(spark, str(tmp_path / "repo"), "*.md").collect()] == ["text/markdown"]
    assert documents.default_loaders().load(spark, str(tmp_path / "repo")).count() >= 1
    with pytest.raises(ValueError):
        documents.default_loaders().load(spark, "raw://x")
    with pytest.raises(ValueError):
        documents.load_cloud(spark, "ftp://x")

    def fetch(u):
        if "bad" in u:
            raise OSError("no")
        return u.encode(), "text/html ; charset=x" if "h" in u else ""

    got = {r["source_uri"]: (r["mime_type"], r["error"]) for r in documents.load_http(spark.createDataFrame([("h",), ("x",), ("bad",)], "url string"), fetch).collect()}
    assert got == {"h": ("text/html", None), "x": ("application/octet-stream", None), "bad": (None, "no")}
    assert [r["source_uri"] for r in documents.load_connector(spark, "notion", ["r1"], lambda p, r: (b"", "a/b")).collect()] == ["notion://r1"]
    spark.createDataFrame([(1, "a")], "i int, t string").write.orc(str(tmp_path / "o"))
    assert documents.read_table(spark, str(tmp_path / "o"), "orc").count() == 1
    page = '<html><head><title>t</title></head><body><nav>n</nav><h2>Big &amp; small</h2><p>One <a href="u">two</a></p><ul><li>x<li>y</ul></body></html>'
    assert spark.createDataFrame([(page,)], "h string").select(documents.markdown(F.col("h"))).first()[0] == "## Big & small\n\nOne [two](u)\n\n- x\n- y"
    bad = documents.preprocessed(spark.createDataFrame([("c", " ", "text/plain")], "collection_id string, text string, mime_type string"), spark.createDataFrame([], "collection_id string, preprocessor string"))
    assert bad.first()["error"] == "empty output"


def test_quotes_are_found_in_the_original(spark):
    cases = [("é a  b\nc d", "a b c", 3, 9), ("x & <y>", "&amp; &lt;y&gt;", 2, 7), ("abc", " ", None, None), ("abc", "zz", None, None), ("a (b", "(b", 2, 4), ("q\\E x", "q\\E  x", 0, 5)]
    df = spark.createDataFrame([(t, q, s, e) for t, q, s, e in cases], "t string, q string, s long, e long")
    for r in df.withColumn("at", verification.locate(F.col("t"), F.col("q"))).collect():
        assert (r["at"] and r["at"]["start"], r["at"] and r["at"]["end"]) == (r["s"], r["e"]), r


def test_sentences_and_their_citations():
    text = "One. Two [P1].[P2] Three! (no [P3, P4]) é。次。\n\n```py\nx. y.\n```\n  Tail [P1] goes on. ```"
    found = [text[a:b] for a, b, _ in verification.units(text)]
    assert found == ["One.", "Two [P1].[P2]", "Three!", "(no [P3, P4]) é。", "次。", "```py\nx. y.\n```", "Tail [P1] goes on.", "```"]
    assert [c for *_, c in verification.units("a\n```\nopen. code")] == [False, True] and list(verification.units("  \n")) == []


def test_answers_without_markers_stay(spark):
    a = spark.createDataFrame([(1, "no marker"), (2, "[P1]"), (3, None)], "answer_id long, answer string")
    got = {r["answer_id"]: (r["known"], r["unknown"]) for r in verification.citations(a, a.limit(0).select("answer_id", F.lit("P1").alias("ref"))).collect()}
    assert got == {1: ([], []), 2: ([], ["P1"]), 3: ([], [])}


def test_metrics_of_odd_queries(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id long, item string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c"), (3, "z")], "query_id long, item string")
    got = {r["query_id"]: (r["hit"], r["mrr"], r["precision"], r["recall"]) for r in retrieval.metrics(ranked, relevant, 5).collect()}
    assert got == {1: (1, 1.0, round(1 / 3, 6), 0.5), 2: (0, 0.0, 0.0, 1.0), 3: (0, 0.0, 0.0, 0.0)}


def test_bm25_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(i // 3, i % 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)], "doc_id long, pos int, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice([*words, "none"]) for _ in range(4))) for i in range(12)] + [(99, ""), (98, None)], "query_id long, text string")
    scope = chunks.where("doc_id % 2 = 0").select("doc_id", "pos")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["pos"], round(r["score"], 5)) for r in df.collect())
    for s in (None, scope):
        assert rows(retrieval.bm25(chunks, q, 5, s)) == rows(retrieval.bm25_joined(chunks, q, 5, s))
    one = rows(retrieval.overlap_hits(chunks, q))
    monkeypatch.setattr(retrieval, "CELLS", 1)
    assert rows(retrieval.bm25(chunks, q, 5)) == rows(retrieval.bm25_joined(chunks, q, 5))
    monkeypatch.setattr(retrieval, "CARRIED", 0)
    assert rows(retrieval.overlap_hits(chunks, q)) == one and retrieval.bm25(chunks.limit(0), q).count() == 0


def test_failing_strategies_are_named(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")

    def bad(own, k):
        raise RuntimeError("no")

    good = lambda own, k: own.select("query_id", F.lit("d").alias("doc_id"), F.lit("c").alias("chunk"), F.lit(1.0).alias("score"))
    found, failed = search.candidates(search.planned(search.transformed(q)), {"vector": good, "bm25": bad}, 3)
    assert failed == ["bm25"] and found.count() == 1
    with pytest.raises(ValueError):
        search.candidates(search.planned(search.transformed(q)), {"bm25": bad}, 3)


def test_assembled_contexts_fit_their_budget(spark):
    rng = random.Random(9)
    text = {d: "".join(rng.choice("abcdé <&\n") for _ in range(3000)) for d in "xyz"}
    data = {d: t.encode() for d, t in text.items()}

    def cut(d):
        a = rng.randrange(0, 2500)
        t = text[d][a : a + rng.randint(1, 400)]
        start = len(text[d][:a].encode())
        return d, start, start + len(t.encode()), t

    rows = [(q, f"{q}-{i}", d, f"u://{d}", 1, s, e, t, round(rng.random(), 3)) for q in range(6) for i, (d, s, e, t) in enumerate(cut(rng.choice("xyz")) for _ in range(rng.randint(1, 12)))]
    p = spark.createDataFrame(rows, "query_id long, id string, doc string, uri string, version int, start long, end long, text string, score double")
    s = spark.createDataFrame([(q, f"s{i}", f"Summary {i} of all.", 0.5 - i / 10) for q in range(6) for i in range(3)], "query_id long, id string, text string, score double")
    for budget, style in ((60, "xml"), (300, "markdown"), (1500, "numbered")):
        passages, summaries, rendered = context.assembled(p, s, budget, style)
        assert all(r["used"] <= budget for r in rendered.collect())
        found = passages.collect()
        for r in found:  # each passage is an exact slice
            assert data[r["doc"]][r["start"] : r["end"]].decode() == r["text"]
        for q in range(6):
            refs = [r["ref"] for r in found if r["query_id"] == q]
            assert sorted(refs) == sorted(f"P{i + 1}" for i in range(len(refs)))


def test_prompts_and_modes():
    with pytest.raises(ValueError):
        search.planned(None, "none")
    with pytest.raises(ValueError):
        context.fragment("html", None, None, None, None)


def test_system_prompts(spark):
    got = spark.createDataFrame([("Be brief.",), (" ",), (None,)], "i string").select(context.system_prompt("answer", F.col("i")).alias("p")).collect()
    assert got[0]["p"].endswith(":\nBe brief.") and got[1]["p"] == got[2]["p"] and "[P1]" in got[1]["p"]


def test_graph_of_replies(spark):
    replies = spark.createDataFrame([("c", "u", "k1", '{"entities":[{"name":"A","entity_type":"t"},{"name":"A","entity_type":"t"},{"name":"B"}],"relations":[{"source":"A","relation":"r","target":"B"},{"source":"A","relation":"r","target":"Z"}]}'), ("c", "u", "k2", "no json"), ("c", "u", "k3", None)], "collection_id string, source_uri string, chunk string, json string")
    e, r = graph.extracted(replies)
    assert e.count() == 2 and r.count() == 1 and r.first()["confidence"] == 0.9


def test_trees_of_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (3, 4))
    rows = [("s", f"n{i:02}", f"c{i}", 1, (centres[i % 3] + rng.normal(0, 0.1, 4)).tolist()) for i in range(9)] + [("t", "only", "c", 1, [1.0, 2.0, 3.0, 4.0])]
    nodes = tree.build(spark.createDataFrame(rows, "source string, node string, leaf string, n_leaves long, vector array<double>")).cache()
    parents = {r["node"]: r["parent"] for r in nodes.where("source = 's' and level = 0").collect()}
    assert len(set(parents.values())) == 3 and all(parents[f"n{i:02}"] == parents[f"n{i % 3:02}"] for i in range(9))
    assert nodes.where("source = 't'").count() == 1 and tree.at_level(nodes, 1).count() == 3
    top = tree.at_level(nodes, 2)
    assert top.agg(F.sum("n_leaves")).first()[0] == 9 and tree.children(nodes, top).count() == 3
    assert tree.k_means(np.zeros((5, 2)), 3).tolist() == [0] * 5 and tree.k_means(np.zeros((1, 0)), 3).tolist() == [0]


def test_experiments_sources_and_retries():
    e = lifecycle.Experiments()
    assert e.start("x", "c", {"size": 9}) and not e.start("y", "c", {}) and e.active() == ["x"]
    with pytest.raises(ValueError):
        e.promote("x")
    assert e.measure("x", 49, 0.1, 0.9) == "running" and e.measure("x", 50, 0.1, 0.2) == "ready_to_promote"
    e.promote("x")
    assert e.configs == {"c": {"size": 9}} and e.active() == []
    with pytest.raises(ValueError):
        e.measure("x", 99, 0, 1)
    assert e.start("z", "c", {})
    e.abandon("z")
    s = lifecycle.Sources()
    s.create("a", uri="u")
    with pytest.raises(ValueError):
        s.create("a")
    s.delete("a")
    with pytest.raises(KeyError):
        s.delete("a")
    slept, left = [], [1, 1, 0]

    def call():
        if left.pop(0):
            raise OSError
        return "ok"

    assert lifecycle.retried(call, sleep=slept.append, random=lambda: 1.0) == "ok" and slept == [1.0, 2.0]
    with pytest.raises(OSError):
        lifecycle.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=1, sleep=slept.append)


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text('top_k = 7\nmode = "static"\n')
    c = Config.load(str(tmp_path / "c.toml"), {"CORVID_TOP_K": "9", "PATH": "x"})
    assert (c.top_k, c.mode, c.chunk_size) == (9, "static", 512)
    for env in ({"CORVID_NOPE": "1"}, {"CORVID_STORE": "sqlite", "CORVID_ENVIRONMENT": "production"}, {"CORVID_CANDIDATE_K": "201"}, {"CORVID_MODE": "x"}):
        with pytest.raises(ValueError):
            Config.load(None, env)


def test_engine_from_ingestion_to_deletion(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"), Config(mode="static", chunk_size=60, overlap=10))
    docs = spark.createDataFrame([("u1", "Foxes are quick and brown. They jump over lazy dogs."), ("u2", "Ships sail the sea. Sailors sing at night."), ("u3", "Compost feeds the garden.")], "source_uri string, text string")
    assert {r["source_uri"]: r["change"] for r in e.ingest(docs, "c").collect()} == {"u1": "new", "u2": "new", "u3": "new"}
    again = docs.withColumn("text", F.when(F.col("source_uri") == "u3", "Compost feeds roses.").otherwise(F.col("text")))
    assert {r["source_uri"]: (r["change"], r["version_num"]) for r in e.ingest(again, "c").collect()} == {"u1": ("unchanged", 1), "u2": ("unchanged", 1), "u3": ("changed", 2)}
    q = spark.createDataFrame([(1, "quick brown foxes"), (2, "compost roses")], "query_id long, text string")
    hits = e.search(q, "c", 3).collect()
    first = {r["query_id"]: r["source_uri"] for r in hits if r["rank"] == 1}
    assert first == {1: "u1", 2: "u3"} and not any("garden" in r["text"] for r in hits)
    answers = {r["query_id"]: (r["answer"], r["status"]) for r in e.generate(q, "c").collect()}
    assert re.search(r"\[P1\]", answers[1][0]) and answers[1][1] == "ok"
    assert e.evaluate(q, spark.createDataFrame([(1, "u1"), (2, "u3")], "query_id long, source_uri string"), "c").first()["hit"] == 1.0
    for bad in (lambda: e.search(q, ""), lambda: e.ingest(docs, " "), lambda: e.evaluate(q, q, "c", 101)):
        with pytest.raises(ValueError):
            bad()
    gone = e.gc(spark.createDataFrame([("c", "retention", 0)], "collection_id string, policy string, days int"))
    assert [(r["version_num"], r["is_last"]) for r in gone.collect()] == [(1, False)]
    e.delete_source("c", "u1")
    assert sorted(r["source_uri"] for r in e.documents("c").collect()) == ["u2", "u3"] and {r["collection_id"]: r["n_documents"] for r in e.stats().collect()} == {"c": 2, None: 2}
    assert [r["collection_id"] for r in e.collections().collect()] == ["c"]


def test_embedder(spark):
    got = [r[0] for r in spark.createDataFrame([("Été été x1",), ("",), (None,), ("!",)], "t string").select(scalar.embed(F.col("t"))).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-12 and max(got[0]) > 0.8 and got[1] == got[2] == got[3] == [0.0] * 64


def test_cached_entries_expire(spark):
    now = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp")
    cache = spark.createDataFrame([("a", 1, datetime(2024, 1, 1, 11, 30)), ("a", 2, datetime(2024, 1, 1, 11, 40)), ("b", 3, datetime(2024, 1, 1, 10))], "key string, value int, at timestamp")
    got = {r["key"]: (r["value"], r["hit"]) for r in stores.cached(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), cache, now).collect()}
    assert got == {"a": (2, True), "b": (None, False), "c": (None, False)}
