"""SimHash near-duplicates by bit-sliced comparison.

A text's words are split at ASCII white space after A-Z are lower-cased; its shingles are ``shingle`` consecutive
words joined by one space, repeats included (fewer words: the whole sequence is the one shingle). A fingerprint bit is
set if over half the shingles' XXH64 (seed 42) have it set. ``near_duplicates`` links texts whose fingerprints differ in at
most ``radius`` bits; ``similar`` links texts whose sets of shingles have a Jaccard similarity of ``least`` or more. A
component is what links connect.

How links are found: equal fingerprints (equal sets) are one row from the start, so copies cost nothing further. Rows are
compared only within blocks that share a key. For a small radius the 64 bits are cut into ``radius + 2`` parts; two
fingerprints within the radius agree on at least two parts, so every pair of parts gives a key and no pair is missed. A
similarity of 0.8 leaves some 10 of 64 bits different, where such keys tell nothing apart; there the keys are ``BANDS``
bands of ``ROWS`` minimum hashes of the shingles each, the bit-sliced comparison within ``WIDE`` bits leaves candidates, and
each is checked on whole sets. That joins large groups cheaply and can miss links, so ``candidates`` then finds every pair
of sets not joined yet that can meet the threshold, by the rarest shingles of each and a bound on what differs, and these are
checked on whole sets too.

In a block the fingerprints are stored as 64 vertical bit planes, once. Rows are compared with the rows ``d`` places on, for
all rows at a time: planes are shifted by ``d`` bits, exclusive-or gives 64 planes of differences, carry-save counters add
them up 64 lanes to a machine word, and a block of lanes is abandoned once each lane is beyond the radius. A task emits a
spanning forest of least distances, not pairs. A key with more than ``TILE`` rows goes on in tiles whose pairs are dealt
to different tasks, so no task compares an unbounded group and none is skipped.

Defined results: a null or empty text, or one of white space only, has no shingle and fingerprint zero and is linked like
any other; repeated rows and repeated ids share a component; ids are long integers (others raise an error); a null id never
becomes a component's id unless all its ids are null; an empty table gives an empty result; other columns of the input are
not read, so their names cannot clash, or are passed on (``keep_one``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

SEED = 42
#: Rows of one key that one task compares with each other.
TILE = 1024
#: Machine words of lanes that are abandoned together.
WORDS = 16
#: Shingle hashes that are unpacked to bits, or multiplied, at once.
CHUNK = 1 << 13
#: Rows, and pairs of one key, that a task compares at a time.
BATCH, PAIRS = 1 << 16, 1 << 21
#: Edges that one task joins to components; beyond that they are joined in rounds.
EDGES = 1 << 20
#: Parts of which a join on a root is made.
SALTS = 16
#: Block keys for a similarity, hashes in each, and the radius within which fingerprints are candidates.
BANDS, ROWS, WIDE = 16, 5, 20
#: Texts up to which their numbers travel to the table of texts; what rounding may take from a bound.
CARRIED, SLACK = 200_000, 1e-6
#: Bits of a place in the table of how frequent shingles are, parts in which its counts are added up; words of the parities of a set.
PLACES, SLICES, PARITIES = 21, 64, 8
_MULTIPLY = (np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(data: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, in order."""
    words = (data or b"").lower().split()  # bytes.lower() changes A-Z only, bytes.split() splits at ASCII white space
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    del words
    out = np.empty(len(ends) - shingle + 1, np.uint64)
    for at in range(0, len(out), CHUNK):
        until = min(at + CHUNK, len(out))
        starts = ([0] if at == 0 else []) + ends[max(at - 1, 0) : until - 1].tolist()
        out[at:until] = [digest(text[a:b], SEED) for a, b in zip(starts, (ends[at + shingle - 1 : until + shingle - 1] - 1).tolist())]
    return out


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    return majority(shingles(data, shingle))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its minimum hashes."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[at : at + CHUNK] * _MULTIPLY[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row: id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in common.as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, run, "id long, fp long")


class Planes:
    """Fingerprints as 64 vertical bit planes: bit i of a plane's words belongs to row i."""

    def __init__(self, fp: np.ndarray):
        self.n = len(fp)
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.words = packed(bits.T)

    def near(self, d: int, active: np.ndarray, radius: int) -> np.ndarray:
        """Rows i of which ``active`` is true and whose fingerprint differs from row i + d's in at most ``radius`` bits."""
        alive = packed(active)
        blocks = np.flatnonzero(alive.reshape(-1, WORDS).any(axis=1))
        alive = alive.reshape(-1, WORDS)[blocks]
        depth = (radius + 1).bit_length()
        counter = [np.zeros_like(alive) for _ in range(depth)]
        beyond = np.zeros_like(alive)
        by, rest = divmod(d, 64)
        at = blocks[:, None] * WORDS + np.arange(WORDS)
        size = self.words.shape[1]
        one, two = np.minimum(at + by, size - 1), np.minimum(at + by + 1, size - 1)  # lanes past the end are not active
        for i in range(64):
            plane = self.words[i]
            ahead = plane[one] >> np.uint64(rest) | plane[two] << np.uint64(64 - rest) if rest else plane[one]
            carry = plane[at] ^ ahead
            for k in range(depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            beyond |= carry
            if i % 8 == 7:
                alive = alive & ~_over(counter, radius, beyond)
                keep = alive.any(axis=1)
                if not keep.any():
                    return np.empty(0, np.int64)
                if not keep.all():  # each lane of the others is beyond the radius already
                    alive, beyond, at, one, two, blocks = alive[keep], beyond[keep], at[keep], one[keep], two[keep], blocks[keep]
                    counter = [c[keep] for c in counter]
        found = np.flatnonzero(np.unpackbits(alive.view(np.uint8).ravel(), bitorder="little"))
        return blocks[found // (64 * WORDS)] * (64 * WORDS) + found % (64 * WORDS)


def packed(bits: np.ndarray) -> np.ndarray:
    """The last axis as bits of whole blocks of machine words."""
    out = np.packbits(bits, axis=-1, bitorder="little")
    missing = -out.shape[-1] % (8 * WORDS)
    return np.ascontiguousarray(np.concatenate((out, np.zeros((*out.shape[:-1], missing), np.uint8)), axis=-1)).view(np.uint64)


def _over(counter: list, radius: int, beyond: np.ndarray) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = beyond, ~np.zeros_like(beyond)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: places (low, high) of the edges of a spanning forest of the links within each group, of
    least distances first.

    side: 0 and 1 mark the halves of a tile pair, whose rows are compared across the halves only; 2: all with all."""
    n, planes, lows, highs, d = len(fp), Planes(fp), [], [], 1
    while d < n:
        active = group[: n - d] == group[d:]
        if not active.any():
            break
        found = planes.near(d, active & ((side[: n - d] == 2) | (side[: n - d] != side[d:])), radius)
        lows.append(found)
        highs.append(found + d)
        d += 1
    lo, hi = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lows, highs))
    order = np.argsort(np.bitwise_count((fp[lo] ^ fp[hi]).view(np.uint64)), kind="stable")
    lo, hi = lo[order], hi[order]
    root, chosen = np.arange(n), np.zeros(len(lo), bool)
    live = np.arange(len(lo))
    while len(live):  # each tree takes its first edge to another
        a, b = root[lo[live]], root[hi[live]]
        live, a, b = (x[a != b] for x in (live, a, b))
        if not len(live):
            break
        first = np.full(n, len(lo))
        np.minimum.at(first, a, live)
        np.minimum.at(first, b, live)
        taken = np.unique(first[first < len(lo)])
        chosen[taken] = True
        a, b = root[lo[taken]], root[hi[taken]]
        while True:
            low, before = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if np.array_equal(root, before):
                break
    return lo[chosen], hi[chosen]


def _compare(rows: DataFrame, radius: int, whole: bool) -> DataFrame:
    """rows (grp, side, fp, node): edges (u, v) of nodes, and of groups of more than TILE rows, unless ``whole``, the rows
    themselves as (u: node, fp, grp, tile) with one more, without u, that gives the number of tiles."""
    rows = rows.select("grp", "side", "fp", "node").repartition("grp").sortWithinPartitions("grp", "fp", "node")
    names = ["u", "v", "fp", "grp", "tile"]

    def batch(*columns) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, seen = np.empty((4, 0), np.int64), None, 0

        def compared(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(part[0], prepend=~part[0][:1]))
            sizes = np.diff(np.append(starts, part.shape[1]))
            starts, sizes = starts[sizes > 1], sizes[sizes > 1]  # the others have no pair
            turns = np.cumsum(sizes * sizes) // PAIRS
            for turn in np.unique(turns):
                chosen = turns == turn
                own = np.concatenate([part[:, a : a + k] for a, k in zip(starts[chosen], sizes[chosen])], axis=1)
                lo, hi = forest(own[0], own[1], own[2], radius)
                if len(lo):
                    yield batch(own[3][lo], own[3][hi], None, None, None)

        def spread(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            if part.shape[1]:
                yield batch(part[3], None, part[2], part[0], (seen + np.arange(part.shape[1])) // TILE)
                seen += part.shape[1]

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal large, seen
            if large is not None:
                yield batch(None, None, None, np.array([large]), np.array([-(-seen // TILE)]))
            large, seen = None, 0

        for b in batches:
            held = np.concatenate((held, np.stack([np.asarray(b.column(i)) for i in range(4)])), axis=1)
            if large is not None:
                until = int(np.searchsorted(held[0], large, "right"))
                yield from spread(held[:, :until])
                held = held[:, until:]
                if held.shape[1]:
                    yield from ended()
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if held.shape[1] else 0  # the last group may go on
            if not whole and held.shape[1] - last > TILE:
                yield from compared(held[:, :last])
                large = int(held[0][-1])
                yield from spread(held[:, last:])
                held = held[:, held.shape[1] :]
            elif last >= BATCH:
                yield from compared(held[:, :last])
                held = held[:, last:]
        yield from ended()
        if held.shape[1]:
            yield from compared(held)

    return common.map_batches(rows, run, "u long, v long, fp long, grp long, tile long")


def links(blocks: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect just what links within blocks connect, from rows (grp, fp, node): a node is in a block once."""
    found = common.checkpoint(_compare(blocks.withColumn("side", F.lit(2).cast("long")), radius, False))
    edges = found.where("v is not null").select("u", "v")
    large = found.where("grp is not null")
    if large.isEmpty():
        return edges.distinct()
    # Tile pairs of the large groups: a row goes to each of its group's tiles; the join is dealt out by tile too.
    sizes = large.where("u is null").select("grp", F.col("tile").alias("tiles"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    rows = large.where("u is not null").withColumn("salt", F.col("tile") % SALTS).join(sizes, ["grp", "salt"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1).cast("long")
    pairs = rows.select(F.xxhash64("grp", F.least("tile", "other"), F.greatest("tile", "other")).alias("grp"), side.alias("side"), "fp", F.col("u").alias("node"))
    return edges.unionByName(_compare(pairs, radius, True).select("u", "v")).distinct()


def blocks_of(distinct: DataFrame, radius: int) -> DataFrame:
    """Block rows for a small radius, from rows (fp, node): a key for each two of ``radius + 2`` parts."""
    parts = radius + 2
    edges_at = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges_at, edges_at[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(masks[a] | masks[b])))) for i, (a, b) in enumerate(combinations(range(parts), 2))))
    return distinct.select("fp", "node", F.explode(keys).alias("grp"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge that is not its component's root, the smallest node. Up to ``EDGES`` edges are
    joined in one task; more in large-star and small-star rounds until nothing changes, each written to the shared folder."""
    edges = common.checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([np.asarray(b.column(i)) for i in (0, 1)]) for b in batches]
        if not got:
            return
        names, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(names))
        while True:
            low, before = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["node", "root"])

    seen = state(edges)
    if seen[0] <= EDGES:
        return common.map_batches(edges.coalesce(1), join, "node long, root long")
    # A root may have any number of neighbours: joins on it are dealt out by the neighbour, too.
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), spread.alias("salt"))
        large = both.withColumn("salt", salt).join(low, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", spread.alias("salt"))
        small = large.withColumn("salt", salt).join(low, ["u", "salt"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = common.checkpoint(small.select("e.*").where("u <> v").distinct())
        if (now := state(edges)) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _named(distinct: DataFrame, edges: DataFrame, key: list[str], low: Column) -> DataFrame:
    """``key`` and first: the least ``low`` of the component, from rows of nodes and the edges between them."""
    rooted = distinct.join(components(edges).withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    rooted = rooted.select(*key, low.alias("low"), F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("first"))
    return common.checkpoint(rooted.join(least, "root").select(*key, "first"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of ``df``: id, fp, component_id (the smallest id of its component)."""
    rows = common.checkpoint(fingerprints(df, id_col, text_col, shingle))
    distinct = common.checkpoint(rows.groupBy("fp").agg(F.min("id").alias("low")).withColumn("node", F.col("fp")))
    named = _named(distinct, links(blocks_of(distinct, radius), radius), ["fp"], F.col("low"))
    return rows.join(named.withColumnRenamed("first", "component_id"), "fp")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of batches sorted by the first, in parts that hold each of its values whole."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = np.stack([np.asarray(b.column(i)) for i in range(b.num_columns)])
        last = int(np.searchsorted(part[0], part[0][-1], "left"))
        if held and (last or held[-1][0, -1] != part[0, 0]):  # what is held ends in this part, or before it
            until = int(np.searchsorted(part[0], held[-1][0, -1], "right"))
            held.append(part[:, : max(until, last)])
            yield np.concatenate(held, axis=1)
            held, part = [], part[:, max(until, last) :]
        elif last:
            yield part[:, :last]
            part = part[:, last:]
        if part.shape[1]:
            held.append(part)
    if held:
        yield np.concatenate(held, axis=1)


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES places: whether an odd number of the set's shingles fall there. Two sets differ in at least
    as many shingles as bits."""
    odd = np.bincount((own & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def crossing(root: np.ndarray, size: np.ndarray, rest: np.ndarray, bits: np.ndarray, least: float, brief: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of pairs of a block that have different roots and may meet the threshold; ``brief``: one of a row and the
    rows of each other root, drawn at random, instead of all. Rows are of ascending size."""
    half = least / (1 + least)
    names, counts = np.unique(root, return_counts=True)
    main = root == names[np.argmax(counts)]  # rows of the commonest root meet the others only
    small = rest >= 2 * half * size - SLACK
    for turned, a, b in ((False, np.flatnonzero(small & ~main), np.arange(len(root))), (True, np.flatnonzero(small & main), np.flatnonzero(~main))):
        low = np.searchsorted(size[b], size[a], "left")
        n = np.searchsorted(size[b], size[a] / least + SLACK, "right") - low
        turns = np.cumsum(n) // PAIRS
        for turn in np.unique(turns):
            own = np.flatnonzero(turns == turn)
            x = np.repeat(a[own], n[own])
            y = b[np.arange(len(x)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + np.repeat(low[own], n[own])]
            fits = (root[x] != root[y]) & (np.minimum(rest[x], rest[y]) >= half * (size[x] + size[y]) - SLACK)
            x, y = x[fits], y[fits]
            apart = np.zeros(len(x), np.int64)
            for word in bits:
                apart += np.bitwise_count((word[x] ^ word[y]).view(np.uint64))
            fits = apart <= (1 - 2 * half) * (size[x] + size[y]) + SLACK  # what may differ at most
            x, y = x[fits], y[fits]
            if brief and len(x):
                mixed = np.random.default_rng(int(size.sum()) + len(x)).permutation(len(x))
                x, y = x[mixed], y[mixed]
                chosen = np.unique(np.stack((y, root[x]) if turned else (x, root[y])), axis=1, return_index=True)[1]
                x, y = x[chosen], y[chosen]
            yield x, y


def rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """How frequent the shingles of each place, their first PLACES bits, are in the sets of (node, text): steps of a logarithm."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << PLACES, np.uint32)
        for b in batches:
            for x in common.as_bytes(b.column(0)):
                np.add.at(found, np.unique(shingles(x, shingle)) >> np.uint64(64 - PLACES), 1)
        parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(found.reshape(SLICES, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["part", "counts"])

    def merge(pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8).tobytes()]})

    table = np.zeros((SLICES, (1 << PLACES) // SLICES), np.uint8)
    for part, counts in common.map_batches(texts.select("text"), count, "part int, counts binary").groupBy("part").applyInPandas(merge, "part int, counts binary").collect():
        table[part] = np.frombuffer(counts, np.uint8)
    return table.ravel()


def prefixes(texts: DataFrame, shingle: int, least: float, bits: DataFrame | None = None) -> DataFrame:
    """Block rows (h, node, size, rest, bits) of (node, text), sets of shingles that all differ, from which ``candidates`` finds all
    pairs that may have a similarity of ``least`` or more; ``bits`` (node, bits) are their parities, if known.

    All shingles are put in one order, those of rare places first: any order misses nothing, a good one makes small blocks. Of two
    sets that meet the threshold, take the first shingle that both have: what both share is not before it, so ``rest``, the
    shingles of a set from there on, is at least ``least`` of the set's, 2 ``least`` / (1 + ``least``) of the smaller set's, and in
    both at least ``least`` / (1 + ``least``) of the sum of sizes. So a set is in the blocks of its first shingles, those that
    leave enough of it, and only these are shuffled; a block of one set is dropped."""
    spark = texts.sparkSession
    rare = spark.sparkContext.broadcast(rarity(texts, shingle))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, nodes, rests = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for node, x in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1))):
                own = np.unique(shingles(x, shingle))
                rest = np.arange(len(own), 0, -1)
                rest = rest[rest >= least * len(own) - SLACK]
                hs.append(own[np.argsort(rare.value[own >> np.uint64(64 - PLACES)], kind="stable")[: len(rest)]].view(np.int64))
                nodes.append(np.full(len(rest), node, np.int64))
                rests.append(len(own) << 32 | rest)  # both in one number
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, nodes, rests)], ["h", "node", "rest"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            starts = np.flatnonzero(np.diff(part[0], prepend=~part[0][:1]))
            times = np.diff(np.append(starts, part.shape[1]))
            h, node, rest = part[:, np.repeat(times, times) > 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, node, rest >> 32, rest & 0xFFFFFFFF)], ["h", "node", "size", "rest"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parities(np.unique(shingles(x, shingle))) for x in common.as_bytes(b.column(1))], pa.list_(pa.int64()))], ["node", "bits"])

    if bits is None:
        bits = common.map_batches(texts.select("node", "text"), marked, "node long, bits array<long>")
    shared = common.map_batches(texts.select("node", "text"), spread, "h long, node long, rest long").repartition("h").sortWithinPartitions("h")
    shared = common.checkpoint(common.map_batches(shared, met, "h long, node long, size long, rest long"))
    return common.checkpoint(shared.join(bits.select("node", "bits"), "node"))


def candidates(prefix: DataFrame, roots: DataFrame, least: float, brief: bool = False) -> DataFrame:
    """The pairs (u, v) of rows of ``prefixes`` that may meet the threshold and are not in one component of ``roots`` (node,
    root): all of them, none is missed, or if ``brief`` a few of each node and component."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            starts = np.flatnonzero(np.diff(part[0], prepend=~part[0][:1]))
            several = np.minimum.reduceat(part[2], starts) != np.maximum.reduceat(part[2], starts)
            ends = np.append(starts[1:], part.shape[1])
            for i, j in zip(starts[several], ends[several]):
                _, node, root, size, rest, *bits = part[:, i:j][:, np.argsort(part[3, i:j], kind="stable")]
                for a, b in crossing(root, size, rest, bits, least, brief):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["u", "v"])

    rows = prefix.join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"), "size", "rest", *(F.col("bits")[i].alias(f"b{i}") for i in range(PARITIES)))
    return common.checkpoint(common.map_batches(rows.repartition("h").sortWithinPartitions("h"), compared, "u long, v long").distinct())


def similar(df: DataFrame, number: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(number, first) of every row of ``df``, whose column ``number`` is a different long in each row: first is the number
    of the row that stands for its component, that of smallest id, of equal ids of smallest number, null ids last."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, shingle) for x in common.as_bytes(b.column(2))]
            sets = [np.unique(h).tobytes() for h in found]
            both = [pa.array(np.array([xxhash.xxh64_intdigest(x, seed) for x in sets], np.uint64).view(np.int64)) for seed in (1, 2)]
            fps = np.array([majority(h) for h in found], np.uint64).view(np.int64)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([bands(h) for h in found], [parities(np.frombuffer(x, np.uint64)) for x in sets])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *both, pa.array(fps), *lists], ["node", "id", "one", "two", "fp", "keys", "bits"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(x, shingle)).view(np.int64) for x in common.as_bytes(b.column(1))], pa.list_(pa.int64()))], ["node", "own"])

    texts = df.select(F.col(number).alias("node"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = common.checkpoint(common.map_batches(texts, mark, "node long, id long, one long, two long, fp long, keys array<long>, bits array<long>"))
    place = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), F.col("node").alias("n"))
    distinct = marks.groupBy("one", "two").agg(F.min(place).alias("low"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("bits").alias("bits")).withColumn("node", F.col("low.n"))
    distinct = common.checkpoint(distinct)  # of equal sets the fingerprints may differ, by repeats: any will do

    def linked(found: DataFrame) -> DataFrame:
        """The pairs (u, v) that meet the threshold, by whole sets."""
        wanted = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= CARRIED else wanted
        sets = common.checkpoint(common.map_batches(texts.join(wanted, "node", "left_semi").select("node", "text"), gather, "node long, own array<long>"))
        pairs = found.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return common.checkpoint(pairs.where(shared >= F.lit(least) * (F.size("a") + F.size("b") - shared)).select("u", "v"))

    first = linked(common.checkpoint(links(distinct.select("fp", "node", F.explode("keys").alias("grp")), WIDE)))
    copies = marks.select("node").join(distinct.select("node"), "node", "left_anti")
    few = copies.count() <= CARRIED  # then the texts stay where they are
    own = texts.join(F.broadcast(copies), "node", "left_anti") if few else texts.join(distinct.select("node").hint("merge"), "node", "left_semi")
    # A few pairs of each text and component link most of what is alike, so the last turn, over all pairs, has few to try.
    prefix, edges = prefixes(own, shingle, least, distinct), first
    for brief in (True, False):
        edges = edges.unionByName(linked(candidates(prefix, components(edges), least, brief)))
    named = _named(distinct.select("one", "two", "low", "node"), edges, ["one", "two"], F.col("low"))
    return marks.join(named, ["one", "two"]).select(F.col("node").alias(number), F.col("first.n").alias("first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``df`` with one row of each component of ``similar``: the one of smallest id, of equal ids the first. All columns stay
    as they are. The input is numbered once, in a table that is written, so any input will do."""
    number = "_row"
    while number in df.columns:
        number += "_"
    rows = common.checkpoint(df.withColumn(number, F.monotonically_increasing_id()))
    best = common.checkpoint(similar(rows, number, id_col, text_col, shingle, least).where(F.col(number) == F.col("first")).select(number))
    # The set of rows that stay grows with the input, so it is dealt out with the rows at every size.
    return rows.join(best.hint("merge"), number, "left_semi").drop(number)
