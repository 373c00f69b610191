"""Summary trees: levels of nodes over the leaves of a source, and search over all levels.

A node is (source, node, level, vector); leaves have level 0. Which parent a node belongs to is a table of its own, one
row per child, so no cluster's leaves are ever gathered in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalar import doubles
from corvid.operators import nearest
from corvid.operators.retrieval import top

MAX_DEPTH = 3


def centroids(vectors: DataFrame, *by: str) -> DataFrame:
    """``by`` and the mean ``vector`` of each group, place by place; partial sums meet in the shuffle, not vectors."""
    places = vectors.select(*by, F.posexplode(doubles(F.col("vector"))).alias("i", "x"))
    means = places.groupBy(*by, "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))  # as many as the vectors have places
    return means.groupBy(*by).agg(F.transform(ordered, lambda e: e["x"]).alias("vector"))


def summary(n: Column, level: Column) -> Column:
    """The text of a node that no model summarised."""
    return F.format_string("%d chunks clustered at level %d", n, level)


def level_up(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` over ``nodes`` (source, node, leaf, n_leaves, vector) by ``parents`` (source, node, parent):
    source, node, level, n_children, n_leaves, leaf (the first of its leaves), summary, vector."""
    met = nodes.join(parents, ["source", "node"]).select("source", F.col("parent").alias("node"), "leaf", "n_leaves", "vector")
    counted = met.groupBy("source", "node").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.min("leaf").alias("leaf"))
    found = counted.join(centroids(met, "source", "node"), ["source", "node"])
    return found.withColumns({"level": F.lit(level), "summary": summary(F.col("n_children"), F.lit(level))})


def k_means(x, k: int, rounds: int = 100, tolerance: float = 1e-4):
    """Cluster of each row of a matrix: Lloyd's rounds from rows that are farthest from those before, so the same rows in the
    same order have the same clusters. Fewer than k different rows have as many clusters."""
    import numpy as np

    if k <= 1 or x.shape[1] == 0 or len(x) < 2:
        return np.zeros(len(x), int)
    centres, far = [x[0]], ((x - x[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 0:
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        moved, centres = ((new - centres) ** 2).sum() ** 0.5, new
        if moved < tolerance:
            break
    own = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
    return np.unique(own, return_inverse=True)[1]


#: Nodes of a level of one source that one task clusters; a larger level is first dealt out by a hash of the id.
CLUSTERED = 4096


def clustered(nodes: DataFrame) -> DataFrame:
    """nodes (source, node, level, vector) to (source, node, parent): max(2, ceil(sqrt(n))) clusters of each source's level. Sources
    are clustered in one task each, those of more than ``CLUSTERED`` nodes in parts of about that many by a hash of the id."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("node")
        x = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), -1)
        own = k_means(x, max(2, int(np.ceil(np.sqrt(len(pdf))))))
        level, part = int(pdf["level"].iloc[0]) + 1, int(pdf["part"].iloc[0])
        return pdf.assign(parent=[f"L{level}.{part}.{i}" for i in own])[["source", "node", "parent"]]

    counts = nodes.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / CLUSTERED).alias("parts"))
    dealt = nodes.select("source", "node", "level", doubles(F.col("vector")).alias("vector")).join(counts, "source").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.groupBy("source", "part").applyInPandas(run, "source string, node string, parent string")


def build(leaves: DataFrame, max_depth: int = MAX_DEPTH, keep=lambda df: df) -> DataFrame:
    """All nodes over leaves (source, node, leaf, n_leaves, vector): source, node, level, parent, n_children, n_leaves, leaf, summary,
    vector; the leaves are level 0. A source goes up while it has more than one node, to ``max_depth`` at most. ``keep`` writes a
    level down (a checkpoint) so that none is computed again."""
    level = keep(leaves.select(F.col("source").cast("string"), F.col("node").cast("string"), "leaf", F.col("n_leaves").cast("long"), "vector").withColumns({"level": F.lit(0), "n_children": F.lit(0).cast("long"), "summary": F.lit(None).cast("string")}))
    columns, out = ["source", "node", "level", "parent", "n_children", "n_leaves", "leaf", "summary", "vector"], None
    for depth in range(1, max_depth + 1):
        several = level.groupBy("source").count().where("count > 1").select("source")
        parents = keep(clustered(level.join(several, "source", "left_semi")))
        done = level.join(parents, ["source", "node"], "left").select(*columns)
        out = done if out is None else out.unionByName(done)
        up = level_up(level, parents, depth)
        level = keep(up.select("source", "node", "leaf", "n_leaves", "vector", "level", F.col("n_children").cast("long"), "summary"))
        if level.isEmpty():
            return out
    return out.unionByName(level.withColumn("parent", F.lit(None).cast("string")).select(*columns))


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes whose parent is one of ``parents`` (source, node)."""
    return nodes.join(parents.select("source", F.col("node").alias("parent")).distinct(), ["source", "parent"], "left_semi")


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level)


def leaves_of(nodes: DataFrame) -> DataFrame:
    """(source, node, leaf, level): the leaves below each node that has children, by walking up one level a join."""
    up = nodes.where("level = 0").select("source", F.col("node").alias("leaf"), "parent")
    out = None
    for _ in range(MAX_DEPTH):
        one = up.where("parent is not null").select("source", F.col("parent").alias("node"), "leaf")
        out = one if out is None else out.unionByName(one)
        up = one.join(nodes.select("source", "node", "parent"), ["source", "node"]).select("source", "leaf", "parent")
    return out


def kinds(hits: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """hits (query_id, node, level, score, rank) as chunks: a leaf is a source with its registry row (chunk, document_id, start, end,
    text), any other node a summary with its text, no span, and the document of its first leaf. A hit whose (first) leaf the
    registry does not know goes, and the result is shorter."""
    met = hits.join(nodes.select("node", "leaf", "summary"), "node").join(registry.select(F.col("chunk").alias("leaf"), "document_id", "start", "end", "text"), "leaf")
    own = F.col("level") == 0
    span = lambda c: F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c)
    return met.select("query_id", "rank", "score", F.when(own, "source").otherwise("summary").alias("kind"), F.when(own, F.col("leaf")).otherwise(F.col("node")).alias("chunk"), "document_id", span("start"), span("end"), F.when(own, F.col("text")).otherwise(F.col("summary")).alias("text"))


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, max_depth: int = MAX_DEPTH) -> DataFrame:
    """nodes (node, level, vector) of all levels up to ``max_depth``, queries (query_id, q): a stated query set against
    all nodes. Similarity counts 1 / (1 + level), so leaves come before what summarises them."""
    left = nodes.where(F.col("level") <= max_depth).select("node", "level", F.col("vector").alias("v"), (1 + F.col("level")).alias("divisor"))
    found = nearest.candidates(left, queries, k)
    return top(found.select("query_id", "node", "level", F.round("score", 6).alias("score")), k, F.desc("score"), "node")
