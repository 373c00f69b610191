"""Entity graph: upserts, undirected breadth-first search, hop-decay scores, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.stores import chunk_id
from corvid.session import written

#: The confidence of an extracted relation, and the seeds of a query that names none.
CONFIDENCE, SEEDS = 0.9, 100
_EXTRACTED = "entities array<struct<name:string,entity_type:string>>, relations array<struct<source:string,relation:string,target:string>>"


#: Nodes up to which a frontier travels to the edges, nodes that a query's row carries, parts of a join on a class of queries.
CARRIED, LISTED, SALTS = 200_000, 64, 8


def _around(near: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges from nodes of ``frontier``: where these are few, the others are left out before anything is dealt out."""
    nodes = frontier.select(F.col("node").alias("src")).distinct()
    return near.join(F.broadcast(nodes), "src", "left_semi") if nodes.count() <= CARRIED else near


def _reach(edges: DataFrame, seeds: DataFrame, max_hops: int) -> tuple[DataFrame, ...]:
    """seen (query_id, node, hops) of fewer than ``max_hops`` hops; of the last hop members (query_id, cls), reach (cls, node) and gone
    (query_id, node): a query reaches the nodes of its class that are not gone for it, since it has seen them before.

    Queries of equal frontiers are a class; what they reach is found and kept once. A class is named by two hashes of its nodes."""
    near = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    seen = frontier = written(seeds.select("query_id", "node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, max_hops):
        reached = frontier.join(_around(near, frontier), F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, ["query_id", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    name = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node")))
    members = written(frontier.groupBy("query_id").agg(name.alias("cls")))
    own = members.withColumnRenamed("query_id", "q")
    fronts = frontier.join(own, F.col("query_id").eqNullSafe(F.col("q"))).select("cls", "node").distinct()
    reach = written(fronts.join(_around(near, frontier), F.col("node") == F.col("src")).select("cls", F.col("dst").alias("node")).distinct())
    gone = written(seen.select("query_id", "node").join(members, "query_id").join(reach, ["cls", "node"]).select("query_id", "node"))
    return seen, members, reach, gone


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, node, hops): smallest number of undirected edges (src, dst) from a query's seeds (query_id, node).

    One equi-join with the adjacency for each hop; only the frontier, the nodes first reached in the hop before, goes on. The rows
    of the last hop are the result's bulk: they are made from the classes of queries as they are put out, and not dealt out again."""
    if max_hops < 1:
        return seeds.select("query_id", "node").distinct().withColumn("hops", F.lit(0))
    seen, members, reach, gone = _reach(edges, seeds, max_hops)
    packed = gone.groupBy("query_id").agg(F.collect_list("node").alias("gone"))
    few = (gone.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) <= LISTED
    rows = members.join(packed, "query_id", "left") if few else members
    spread = reach.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Each reached node meets the queries of its class, so equal nodes are adjacent and a file of the result stores them once a run.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    last = spread.join(salted.hint("merge"), ["cls", "salt"])
    last = last.where(F.coalesce(~F.array_contains("gone", F.col("node")), F.lit(True))) if few else last.join(gone, ["query_id", "node"], "left_anti")
    return seen.unionByName(last.select("query_id", "node", F.lit(max_hops).alias("hops")))


def hop_decay(reached: DataFrame, sources: DataFrame) -> DataFrame:
    """Score of each chunk: sum of 1 / (1 + hops) over the reached nodes that cite it; sources (node, chunk)."""
    return reached.join(sources, "node").groupBy("query_id", "chunk").agg(F.round(F.sum(1 / (1 + F.col("hops"))), 6).alias("score"))


def decayed(edges: DataFrame, seeds: DataFrame, sources: DataFrame, max_hops: int = 2) -> DataFrame:
    """``hop_decay`` of ``bfs``, from the numbers of nodes that cite a chunk, by query or class of queries and hop: the rows that each
    query reaches are counted and never made."""
    if max_hops < 1:
        return hop_decay(bfs(edges, seeds, 0), sources)
    seen, members, reach, gone = _reach(edges, seeds, max_hops)
    cites = lambda df, *by: df.join(sources, "node").groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n"))
    last = F.lit(max_hops).alias("hops")
    all_of = cites(reach, "cls").join(members, "cls").select("query_id", "chunk", last, "n")
    counts = cites(seen, "query_id", "hops").select("query_id", "chunk", "hops", "n").unionByName(all_of).unionByName(cites(gone, "query_id").select("query_id", "chunk", last, (-F.col("n")).alias("n")))
    each = counts.groupBy("query_id", "chunk", "hops").agg(F.sum("n").alias("n")).where("n > 0")
    return each.groupBy("query_id", "chunk").agg(F.round(F.sum(F.col("n") / (1 + F.col("hops"))), 6).alias("score"))


def merge_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each (source, type, target) whose ends exist: highest confidence, union of chunks in order."""
    ends = entities.select("node").distinct()
    kept = relations.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept.groupBy("source", "relation_type", "target").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("chunk")).alias("chunks"))


def cascade(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations without those that touch a removed node."""
    g = gone.select("node").distinct()
    return relations.join(g.withColumnRenamed("node", "source"), "source", "left_anti").join(g.withColumnRenamed("node", "target"), "target", "left_anti")


def extracted(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies (collection_id, source_uri, chunk, json) to entities (node, name, entity_type, chunk, source_uri, collection_id) and
    relations (source, relation_type, target, confidence, chunk). Entities of one name and chunk are one; a relation stays if
    both its names are entities of the same chunk; bad JSON has neither."""
    got = replies.select("collection_id", "source_uri", "chunk", F.from_json("json", _EXTRACTED).alias("j"))
    node = lambda name: chunk_id(F.col("collection_id"), F.col("chunk"), name)
    named = got.select("collection_id", "source_uri", "chunk", F.inline("j.entities")).where("name is not null").dropDuplicates(["collection_id", "chunk", "name"])
    entities = named.select(node(F.col("name")).alias("node"), "name", "entity_type", "chunk", "source_uri", "collection_id")
    names = F.transform("j.entities", lambda e: e["name"])
    pairs = got.select("collection_id", "chunk", names.alias("names"), F.inline("j.relations")).where(F.array_contains("names", F.col("source")) & F.array_contains("names", F.col("target")))
    relations = pairs.select(node(F.col("source")).alias("source"), F.col("relation").alias("relation_type"), node(F.col("target")).alias("target"), F.lit(CONFIDENCE).alias("confidence"), "chunk")
    return entities, relations


def planned_seeds(replies: DataFrame) -> DataFrame:
    """(query_id, name) of the entities that a planner's JSON names; bad JSON names none."""
    got = F.from_json("json", _EXTRACTED)["entities"]
    return replies.select("query_id", F.explode(F.transform(got, lambda e: e["name"])).alias("name")).where("name is not null").distinct()


def seeds(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (query_id, name, entity_type): the entities (query_id, node) whose name holds the asked one, case and all, and whose
    type is the asked one; a query that asks for neither gets the first ``SEEDS`` by name."""
    free = asked.where("name is null and entity_type is null").select("query_id")
    named = asked.where("name is not null or entity_type is not null")
    e = entities.select("node", F.col("name").alias("own"), F.col("entity_type").alias("own_type"))
    fits = (F.col("name").isNull() | F.contains("own", "name")) & (F.col("entity_type").isNull() | (F.col("own_type") == F.col("entity_type")))
    hits = named.join(e, fits).select("query_id", "node")  # a stated set of queries against all names
    first = e.orderBy("own", "node").limit(SEEDS).select("node")
    return hits.unionByName(free.crossJoin(first)).distinct()


def in_scope(relations: DataFrame, entities: DataFrame, collection_id: str, types: list[str] | None = None) -> DataFrame:
    """Relations with both ends in a collection and, if given, of the types."""
    own = entities.where(F.col("collection_id") == collection_id).select("node").distinct()
    out = relations.where(F.col("relation_type").isin(types)) if types else relations
    for end in ("source", "target"):
        out = out.join(own.withColumnRenamed("node", end), end, "left_semi")
    return out


def outgoing(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return relations.join(nodes.select(F.col("node").alias("source")).distinct(), "source", "left_semi")


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row a node: name and type of the last chunk, all its chunks in order."""
    last = F.max_by(F.struct("name", "entity_type"), "chunk")
    return entities.groupBy("node").agg(last.alias("l"), F.array_sort(F.collect_set("chunk")).alias("chunks")).select("node", "l.*", "chunks")


def ordered(reached: DataFrame, entities: DataFrame) -> DataFrame:
    """Reached nodes (query_id, node, hops) with their place by hops, then name."""
    met = reached.join(entities.select("node", "name"), "node")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "name", "node")))


def ranked_chunks(reached: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """The best k chunks of each query by hop decay, of equal ones the first by name."""
    from corvid.operators.retrieval import top

    return top(hop_decay(reached, sources), k, F.desc("score"), "chunk")


def view(entities: DataFrame, relations: DataFrame, n: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """The first n entities by name, and the relations that go out of them."""
    nodes = entities.orderBy("name", "node").limit(n)
    return nodes, outgoing(relations, nodes)


def neighbours(relations: DataFrame, node: Column) -> DataFrame:
    return relations.where(F.col("source") == node)
