"""The operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import math
import random
import re
import threading
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corvid.llm import common, cotraining, decision_list, decontaminate, lattice, lbl, simhash, token_rollup, toxicity, url_rules, wrappers

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, extra=(), n=60):
    rng = random.Random(3)
    base = [(i, text(rng, rng.randint(1, 80)), "en", f"s{i % 3}", 9) for i in range(n)]
    base += [(100, base[4][1], "en", "s1", 9), (101, base[4][1] + " tail", "en", "s1", 9), (101, base[4][1] + " tail", "en", "s1", 9)]
    odd = [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 3), (None, "no id here", "en", "s", 3), (203, text(rng, 4000), "en", "s", 9), (204, "É😀▁ x\x0by #!", "fr", "s", 9)]
    return spark.createDataFrame([*base, *odd, *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fp(t):
    w = words_of(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    rows = documents(spark).collect()
    got = {(r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(spark)).collect()}
    fps = [brute_fp(r["text"]) for r in rows]
    comp = brute_components(fps)
    ids = {c: min((rows[i]["doc_id"] for i in range(len(rows)) if comp[i] == c and rows[i]["doc_id"] is not None), default=None) for c in comp}
    assert got == {(r["doc_id"], f, ids[c]) for r, f, c in zip(rows, fps, comp)}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("edges", [0, 1 << 20])
@pytest.mark.parametrize("batch", [7, 1 << 16])
def test_links_of_clusters_in_tiles(spark, monkeypatch, edges, batch):
    for name, value in (("TILE", 16), ("EDGES", edges), ("BATCH", batch), ("PAIRS", 8 * batch)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)  # chains of up to two bits
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) * 2 for f in fps], "fp long, node long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(simhash.blocks_of(df, 2), 2)).collect()}
    comp = brute_components(fps)
    for i, f in enumerate(fps):  # a root has no row of its own
        assert {got.get(g, g) for g, c in zip(fps, comp) if c == comp[i]} == {got.get(f, f)}
    assert len({got.get(f, f) for f in fps}) == len(set(comp))


def test_bit_planes():
    rng = np.random.default_rng(0)
    fps = np.concatenate((np.array([0, 1, 3, 7, 2**64 - 1], np.uint64), rng.integers(0, 2**64, 3000, np.uint64) & rng.integers(0, 64, 3000, np.uint64), rng.integers(0, 2**64, 900, np.uint64)))
    planes = simhash.Planes(fps.view(np.int64))
    for radius in (0, 1, 2, 3, 5, 20):
        for d in (1, 2, 63, 64, 65, 700, len(fps) - 1):
            active = rng.random(len(fps) - d) < 0.7
            want = [i for i in np.flatnonzero(active).tolist() if int(fps[i] ^ fps[i + d]).bit_count() <= radius]
            assert planes.near(d, active, radius).tolist() == want


def test_forests_connect_what_links_connect_by_least_distances():
    rng = random.Random(4)
    for _ in range(30):
        fps = np.array([rng.getrandbits(6) for _ in range(40)], np.int64)
        group, side = np.sort(np.array([rng.randrange(3) for _ in fps])), np.array([rng.randrange(2) for _ in fps]) if rng.random() < 0.5 else np.full(40, 2)
        lo, hi = simhash.forest(group, side, fps, 2)
        near = [(int(fps[i] ^ fps[j]).bit_count(), i, j) for i in range(40) for j in range(i + 1, 40) if group[i] == group[j] and (side[i] == 2 or side[i] != side[j]) and int(fps[i] ^ fps[j]).bit_count() <= 2]
        root, least = list(range(40)), 0
        for x, i, j in sorted(near):  # Kruskal
            if root[i] != root[j]:
                least += x
                root = [root[i] if r == root[j] else r for r in root]
        assert len(lo) == 40 - len(set(root)) and sum(int(fps[i] ^ fps[j]).bit_count() for i, j in zip(lo, hi)) == least


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "one two"), (3, "One  two"), (4, "one two three four five"), (None, "one two")]
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 5)):
            rows.append((rng.randrange(1000), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice((0, 1, 2, 6))):  # some within the similarity, some beyond it
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    sets = []
    for _, t in rows:
        w = lower(t).split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add((2**63 if rows[i][0] is None else rows[i][0], i))
    got = {r["n"]: r["first"] for r in simhash.similar(df, "n").collect()}
    assert got == {i: min(members)[1] for members in want.values() for _, i in members} and len(want) > 40
    kept = simhash.keep_one(df.withColumnRenamed("n", "_row").repartition(3))
    assert kept.columns == ["doc_id", "text", "_row"] and {r["_row"] for r in kept.collect()} >= {min(m)[1] for m in want.values() if len(m) == 1} and kept.count() == len(want)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_similar_texts_that_share_no_band_or_differ_in_many_bits_are_linked(spark):
    pairs, missed = [], []
    for i in range(3000):  # four shingles of five in common: the similarity is 0.8
        words = [f"w{i}x{k}" for k in range(9)]
        a, b = (simhash.shingles(" ".join(words[:n]).encode(), 5) for n in (8, 9))
        if not set(simhash.bands(a)) & set(simhash.bands(b)) or (simhash.majority(a) ^ simhash.majority(b)).bit_count() > simhash.WIDE:
            missed.append(i)
        pairs += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    assert missed
    kept = [x for i in missed for x in pairs[2 * i : 2 * i + 2]]
    # A frequent passage in texts that are not alike, and texts just below the similarity.
    line = " ".join(f"l{k}" for k in range(30))
    kept += [(10_000 + i, f"{line} " + " ".join(f"o{i}x{k}" for k in range(8 + i % 3))) for i in range(40)]
    df = spark.createDataFrame([(*x, n) for n, x in enumerate(kept)], "doc_id long, text string, n long")
    got = {r["n"]: r["first"] for r in simhash.similar(df, "n").collect()}
    assert got == {n: n - n % 2 if n < 2 * len(missed) else n for n in range(len(kept))}


def test_candidates_against_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS[:6]) for _ in range(rng.choice((3, 5, 7, 12, 30, 60)))] for _ in range(25)]
    texts = [" ".join(w if rng.random() > 0.02 else rng.choice(WORDS) for w in words[: len(words) - rng.randrange(3)]) for words in base for _ in range(8)]
    sets = {}
    for x in texts:
        sets.setdefault(frozenset(simhash.shingles(x.encode(), 2).tolist()), x)
    for least in (0.5, 0.8, 0.9):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= least * len(a | b)}
        df = spark.createDataFrame(list(enumerate(sets.values())), "node long, text string")
        prefix, roots = simhash.prefixes(df, 2, least), spark.createDataFrame([(1, 0), (2, 0)], "node long, root long")
        found, few = (set(map(tuple, simhash.candidates(prefix, roots, least, brief).collect())) for brief in (False, True))
        assert want - {(0, 1), (0, 2), (1, 2)} <= found and few <= found


def test_candidates_of_a_group_just_below_the_similarity_are_few(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(150):  # each pair shares the first half and most of the rest, but not enough
        words = list(base)
        for k in range(3):
            words[80 + rng.randrange(80)] = f"x{i}y{k}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingles(x.encode(), 5).tolist()) for x in texts]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)}
    prefix = simhash.prefixes(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 0.8)
    found = set(map(tuple, simhash.candidates(prefix, spark.createDataFrame([], "node long, root long"), 0.8).collect()))
    assert want <= found and len(found) < len(want) + 150 * 149 // 2 / 5
    for i, j in ((rng.randrange(150), rng.randrange(150)) for _ in range(300)):
        one, two = (simhash.parities(np.array(sorted(sets[x]), np.uint64)) for x in (i, j))
        assert np.bitwise_count((one ^ two).view(np.uint64)).sum() <= len(sets[i] ^ sets[j])


def test_only_first_shingles_are_shuffled(spark, monkeypatch):
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(100 + i % 2)) for i in range(40)]  # pairs of copies but for a word
    prefix = simhash.prefixes(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 0.8)
    assert all(r["n"] <= 21 for r in prefix.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect())
    found = set(map(tuple, simhash.candidates(prefix, spark.createDataFrame([], "node long, root long"), 0.8).collect()))
    assert found == {(i, i + 1) for i in range(0, 40, 2)}
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    monkeypatch.setattr(simhash, "rarity", lambda *_: np.zeros(1 << simhash.PLACES, np.uint8))  # any order finds all
    assert set(map(tuple, simhash.candidates(simhash.prefixes(df, 5, 0.8), spark.createDataFrame([], "node long, root long"), 0.8).collect())) == found


def test_groups_of_more_rows_than_a_tile_are_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    blocks = spark.createDataFrame([(7, 1 << (n % 3), n) for n in range(20)], "grp long, fp long, node long")
    assert simhash.components(simhash.links(blocks, 2)).where("root = 0").count() == 19


def test_language_model(spark):
    docs = documents(spark)
    held = common.remainder(F.col("id"), 7) == 2
    got = lbl.scores(docs, held, F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(8))).collect()
    rows = docs.collect()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not out(r["doc_id"]):
            c.update([*words_of(lower(r["text"])), None])
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r in rows for t in [[*words_of(lower(r["text"])), None]])
    assert sorted((-1 if r["id"] is None else r["id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lbl.scores(empty(spark), held, F.lit(0)).count() == 0


def test_language_model_is_normalised_and_learns():
    first = lbl.SYMBOLS - lbl.CLASSES
    slot_class = np.sort(np.concatenate((np.arange(lbl.CLASSES), [0, 0, 1])))
    model = lbl.Model(np.full(lbl.SYMBOLS, 1 / lbl.SYMBOLS), slot_class, np.ones(len(slot_class)))
    # After 3 comes class 0 with its first word, after 7 the same class with its second.
    s = np.append(np.tile([3, first, 7, first], 30), lbl.END)
    slots = np.append(np.tile([-1, 0, -1, 1], 30), -1)
    for _ in range(15):
        model.train(iter([(s, slots)] * 200), True)
    table, inner = model.table(), model.inner_table()
    assert np.allclose((10 ** table.astype(float)).sum(axis=2), 1, atol=1e-3)
    for k in range(lbl.CLASSES):
        assert np.allclose((10 ** inner[:, slot_class == k].astype(float)).sum(axis=1), 1, atol=1e-3)
    assert table[3, first, 7] > table[3, first, 3] + 0.5
    assert inner[3, 0] > inner[3, 1] + 0.5 and inner[7, 1] > inner[7, 0] + 0.5


def test_language_model_scores_of_texts_against_its_model(spark, monkeypatch):
    monkeypatch.setattr(lbl, "MODELLED", 150)
    rng = random.Random(31)
    docs = documents(spark, [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(120)), "en", "s", 1) for i in range(700, 780)])
    held = common.remainder(F.col("id"), 7) == 2
    part = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(8))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary, model, counts = lbl.fit(rows.where(~held).select("text", part.alias("part")))
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    table, inner = model.table().astype(float), model.inner_table().astype(float)
    order, first = sorted(n, key=lambda w: (-n[w], w)), lbl.SYMBOLS - lbl.CLASSES
    symbol = lambda w: order.index(w) + 1 if w in order[: first - 1] else lbl.word_class(w)
    modelled = order[first - 1 : first - 1 + lbl.MODELLED]

    def score(t):
        context, total = [lbl.END, lbl.END], 0.0
        for w in [x.encode() for x in words_of(lower(t))]:
            s = symbol(w)
            total += table[context[0], context[1], s]
            if s >= first:
                rest = sum(n[x] + 1 for x in order[first - 1 :] if x not in modelled and symbol(x) == s) + 1
                slot = vocabulary.slot[vocabulary.place[w]] if w in modelled else vocabulary.rest[s - first]
                total += inner[context[1], slot] + (0 if w in modelled else math.log10((n.get(w, 0) + 1) / rest))
            context = [context[1], s]
        return total + table[context[0], context[1], lbl.END]

    got = Counter((r["id"], round(r["score"], 2)) for r in lbl.scores(docs, held, part).collect())
    assert got == Counter((r["doc_id"], round(score(r["text"]), 2)) for r in docs.collect())


def test_all_vectors_of_the_language_model_learn_from_all_texts():
    for rounds in (range(len(lbl.ROUNDS)), lbl.INNER_ROUNDS):
        assert sorted(part for turn in rounds for part in lbl.ROUNDS[turn]) == list(range(8))


def test_words_of_a_class_share_noise_in_a_step(monkeypatch):
    rng = np.random.default_rng(3)
    mass = np.repeat([5.0, 2.0, 1.0], [64, 200, 100])
    owner = np.sort(np.concatenate((np.arange(lbl.CLASSES), rng.integers(0, lbl.CLASSES, 300))))
    model = lbl.Model(np.full(lbl.SYMBOLS, 1 / lbl.SYMBOLS), owner, rng.permutation(mass))
    model.p[6] = rng.normal(0, 0.5, model.p[6].shape)
    b, slots = rng.integers(0, lbl.SYMBOLS, 500), rng.integers(0, len(owner), 500)
    drawn = []

    class Noise:
        def random(self, shape):
            drawn.append(rng.random(shape))
            return drawn[-1]

    before, squares = [x.copy() for x in model.p], [np.full(x.shape, 1e-2) for x in model.p]
    model._inner(b, slots, Noise(), squares)
    assert len(drawn[0]) <= 500 / lbl.SHARING + lbl.CLASSES  # a row of noise for each few words, not for each word
    # The same step word by word.
    i, u, d = before[5:]
    want = [np.zeros_like(x) for x in (i, u, d)]
    row, used = 0, 0
    share = model.slot_mass / np.bincount(owner, model.slot_mass)[owner]
    for c in range(lbl.CLASSES):
        own = np.flatnonzero(owner[slots] == c)
        for at in range(0, len(own), lbl.SHARING):
            low, high = model.sums[model.starts[c]], model.sums[model.starts[c + 1]]
            noise = np.searchsorted(model.sums, low + drawn[0][row] * (high - low), "right") - 1
            row += 1
            for n in own[at : at + lbl.SHARING].tolist():
                for w, y in ((slots[n], 1), *((w, 0) for w in noise)):
                    assert owner[w] == c
                    z = i[b[n]] @ u[w] + d[w] - math.log(lbl.INNER_NOISE * share[w])
                    pull = y - 1 / (1 + math.exp(-z))
                    want[0][b[n]] += pull * u[w]
                    want[1][w] += pull * i[b[n]]
                    want[2][w] += pull
                    used += 1
    assert row == len(drawn[0]) and used == 500 * (1 + lbl.INNER_NOISE)
    for old, now, g in zip(before[5:], model.p[5:], want):
        g = g / 500
        assert np.allclose(now, old + lbl.RATE * g / np.sqrt(1e-2 + g * g), atol=1e-5)


def test_a_training_step_sums_all_dimensions_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    rows, values = rng.integers(0, 50, 400), rng.normal(size=(400, lbl.DIMENSION))
    want = np.zeros((60, lbl.DIMENSION))
    np.add.at(want, rows, values)
    owner = np.sort(np.concatenate((np.arange(lbl.CLASSES), rng.integers(0, lbl.CLASSES, 300))))
    model = lbl.Model(np.full(lbl.SYMBOLS, 1 / lbl.SYMBOLS), owner, np.ones(len(owner)))
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *x, **y: calls.append(1) or bincount(*x, **y))
    assert model.train(iter([(rng.integers(0, lbl.SYMBOLS, 500), rng.integers(0, len(owner), 500))]), True) == 500
    assert len(calls) < lbl.DIMENSION  # one step: a few sums, not one a dimension
    assert np.allclose(lbl.scatter(rows, values, 60), want)


def test_tables_of_the_language_model_are_made_once_for_many_texts(monkeypatch):
    head = sorted(((f"w{i}".encode(), 400 - i) for i in range(300)), key=lambda x: (-x[1], x[0]))
    masses = Counter()
    for w, c in head[lbl.SYMBOLS - lbl.CLASSES - 1 :]:
        masses[lbl.word_class(w)] += c + 1
    vocabulary = lbl.Vocabulary(head, masses, sum(c for _, c in head) + 10, 301, 10)
    model = lbl.Model(np.full(lbl.SYMBOLS, 1 / lbl.SYMBOLS), vocabulary.slot_class, vocabulary.slot_mass)
    made, table = [], lbl.Model.table
    monkeypatch.setattr(lbl.Model, "table", lambda self: made.append(1) or table(self))
    scorer = lbl.Scorer(vocabulary, model)
    assert not made  # nor is a table sent to the workers
    got = [scorer.score(x) for x in (b"W1 w299 other  other", None, b"", b"w1")]
    assert len(made) == 1 and [x[:2] for x in got] == [(4, 2), (0, 0), (0, 0), (1, 1)] and got[0][4] == [b"other"] * 2 and got[1] == got[2]


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/71?x", "https://example.com/en/8", "x://m.net/de/", "y://b.example.net/de/81#t", "https://net/de", "http://a.org/es/1", None, "no scheme com/en/", "", "http://m.casino-win.example.com/fr/1", "http://casinos.example.com/fr/1", "a://b.com/en/://c", "http://xcom/en/"]
    want = [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "block"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("com/en/", "block"), (None, "allow")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string")
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    got = url_rules.judge(df, rules).orderBy("id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [*want, want[0]]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[6]["path"]) == ("a.example.com", "/en/71", "", "")
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert [t for t, *_ in url_rules.index([url_rules.Rule("example.com/en/7", "allow", True)])] == ["example"]


def test_thousands_of_url_rules_against_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    names = [f"n{i}" for i in range(400)]
    rules = list({r.text: r for r in [url_rules.Rule(f"{rng.choice(names)}.example/{rng.choice(names)[:2]}", rng.choice(("block", "allow")), True) for _ in range(600)] + [url_rules.Rule(rng.choice((f"^{x}^", f"/{x}*{rng.choice(names)}/", f"{x}.", f"*{x}-")), rng.choice(("block", "allow")), False) for x in (rng.choice(names) for _ in range(2500))]}.values())
    urls = [f"http://{rng.choice(('', 'a.', 'B.c.'))}{rng.choice(names)}.example/{rng.choice(names)}/{rng.choice(names)}-x?{rng.choice(names)}" for _ in range(300)]
    df = spark.createDataFrame([*enumerate(urls), *((1000 + i, urls[0]) for i in range(500))], "page_id long, url string")
    compiled = [(re.compile(url_rules.regex(r)), r) for r in rules]

    def brute(u):
        rest = u.partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        place = host.lower() + re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(r.host, 0 if r.host else r.verdict == "allow", len(r.text), r.text, r.verdict) for p, r in compiled if p.search(place if r.host else u.lower())]
        best = max(fits, default=None)
        return (best[3] if best and best[0] else None, best[4] if best else "allow")

    want = {i: brute(u) for i, u in enumerate(urls)} | {1000 + i: brute(urls[0]) for i in range(500)}
    assert len({v for v in want.values()}) > 10
    for limit in (url_rules.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
        assert {r["id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df, rules).collect()} == want


@pytest.fixture(scope="module")
def pieces():
    return lattice.load()


def test_segmentations_against_all(pieces):
    def every(t):
        s, found = " " + t, []

        def go(i, score):
            if i == len(s):
                found.append(score)
                return
            for j in range(i + 1, min(len(s), i + pieces.longest) + 1):
                if (p := pieces.pieces.get(s[i:j])) is not None:
                    go(j, score + p[1])
            if s[i] not in pieces.pieces:
                go(i + 1, score + pieces.unknown)

        go(0, 0.0)
        return sorted(found, reverse=True)[: pieces.best]

    rng = random.Random(5)
    for _ in range(150):
        t = "".join(rng.choice("ab the\n▁é中😀") for _ in range(rng.randint(1, 9)))
        ids, score, best = pieces.encode(t)
        assert pieces.decode(ids) == t and best[0] == score and np.allclose(best, every(t))


def test_pieces_are_found_by_their_characters(pieces):
    def walked(follow, text=""):
        for c, (found, more) in follow.items():
            if found:
                yield text + c, found
            yield from walked(more, text + c)

    assert dict(walked(pieces.starts)) == pieces.pieces


def test_short_parts_of_many_texts_are_solved_together(pieces, monkeypatch):
    rng = random.Random(12)
    parts = list({"".join(rng.choice("abetheé  1中_日<▁😀\0" if rng.random() < 0.1 else "the nigsaro") for _ in range(rng.randint(1, lattice.LONG))) for _ in range(3000)})
    got = pieces.solve_together(parts)
    # A part with a character that is no piece is left to the plain form, all others are as it has them.
    assert [x is None for x in got] == [any(c not in pieces.pieces for c in p) for p in parts]
    assert all(x is None or x == pieces.solve(p) for p, x in zip(parts, got))

    asked = []
    fresh, solve = lattice.load(), lattice.Lattice.solve
    monkeypatch.setattr(lattice.Lattice, "solve", lambda self, part: asked.append(part) or solve(self, part))
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(50)) for _ in range(20)]
    texts += [None, "", "\0 " + "ab" * lattice.LONG]
    assert [fresh.decode(x[0]) for x in fresh.encode_all(texts)] == [t or "" for t in texts]
    assert len(asked) == 2 and all("\0" in p or len(p) > lattice.LONG for p in asked)


def test_long_parts_without_breaks_take_linear_time(pieces):
    rng = random.Random(2)
    took = []
    for n in (5_000, 50_000):
        t = "".join(rng.choice("abcdefgh0123456789+/") for _ in range(n))
        start = time.perf_counter()
        ids, score, best = pieces.encode(t)
        took.append(time.perf_counter() - start)
        assert pieces.decode(ids) == t and best == sorted(best, reverse=True) and len(best) == pieces.best and best[0] == score
    assert took[1] < 40 * took[0] + 1  # squares would take a hundred times as long
    for g, own in pieces.n_best("abc de"[3:] * 50):
        data = b"".join(pieces.bytes_of[i] for i in own)
        assert data.decode() == "abc de"[3:] * 50 and g <= 0


def test_encoding_of_tables(spark, pieces):
    got = lattice.encode(documents(spark), pieces).collect()
    assert len(got) == documents(spark).count() and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert lattice.encode(empty(spark), pieces).count() == 0
    assert {r["n_pieces"] for r in got if r["id"] in (200, 201)} == {0}


def test_statistics_and_rules(spark):
    def brute(t):
        w = words_of(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    docs = documents(spark, [(300, "a b c\n" * 40, "en", "s", 1), (301, text(random.Random(8), 5) + " x" * 300, "en", "s", 1)])
    rows, name = decision_list.with_statistics(docs.withColumnRenamed("source", "_stats"))
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r["doc_id"], *(r[name][k] for k in keys)) for r in rows.collect())
    assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    rng = random.Random(2)
    marked = [(i, text(rng, 60) + (" ###$" * 30 if i % 3 == 0 else ""), "en", "s", 1) for i in range(400, 640)]
    labelled = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400, 640)] + [(None, 1), (1, None), (9999, 0)], "doc_id long, quality int")
    all_docs = documents(spark, marked)
    rules = decision_list.fit(all_docs, labelled)
    assert rules
    kept = {r["doc_id"] for r in decision_list.keep_good(all_docs, rules).collect()}
    assert all((i in kept) == (i % 3 != 0) for i in range(400, 640))
    assert decision_list.fit(all_docs, labelled.limit(0)) == [] and decision_list.keep_good(empty(spark), rules).columns == all_docs.columns


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><!-- c --><div class="cookie notice">ok?</div><article><h1>Big &amp; small</h1><p>One <b>t</b>wo<br>three&nbsp;four<p>five<form>f</form><div class="comments"><p>no</p></div></article><aside>side</aside><footer>&copy; f</footer><scr'
    pages = [(i, "http://h.example/%d" % i, page.replace("five", f"five{i}")) for i in range(12)]
    plain = [(i, "http://p.example/%d" % i, f"<div id=menu><a>m</a></div><div><p>Sentence number {i} of this page, which goes on for a while.</p></div><div>the same line on all</div>") for i in range(20, 30)]
    odd = [(50, None, None), (51, "", ""), (52, "http://h.example/z", "<article><p>cut off &am"), (53, "u", "just text &lt;b&gt;"), (50, None, None)]
    df = spark.createDataFrame([*pages, *plain, *odd], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in wrappers.texts(df).collect()}
    assert got[3] == "Big & small One two three four five3"
    assert got[25] == "Sentence number 25 of this page, which goes on for a while."
    assert (got[50], got[51], got[52], got[53]) == ("", "", "cut off &am", "just text <b>")
    assert wrappers.texts(df.limit(0)).count() == 0
    folded = wrappers.fold(["<a>", "#", "<a>", "#", "<a>", "#", "<b>"])
    assert wrappers.written(folded) == "(<<a>>#)+<<b>>" and "?" in wrappers.written(wrappers.align(folded, ["<b>"]))


def test_html_of_slots_with_the_same_path(spark, monkeypatch):
    line = "Sentence number {} of this page, which goes on for a while."
    # Slots of the same path: one varies, one is the same on all pages, one holds a link; a part that some pages leave out.
    page = "<body><div>" + line + "</div>{}<hr><div>The same line on all.</div><table></table><div><a href=a>Another page of the site {}</a></div></body>"
    pages = [(i, f"http://s.example/{i}", page.format(i, "<h4>The same line where it is.</h4>" if i % 2 else "", i)) for i in range(40)]
    pages += [(100, "http://s.example/z", "<body><table><tr><td>A page of another form, which is not in the sample.</td></tr></table></body>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for hosts in (wrappers.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(wrappers, "BROADCAST_HOSTS", hosts)
        got = {r["id"]: r["text"] for r in wrappers.texts(df).collect()}
        assert {i: got[i] for i in range(40)} == {i: line.format(i) for i in range(40)}
        assert got[100] == "A page of another form, which is not in the sample."


def test_matching_against_regular_expressions():
    rng = random.Random(3)
    for _ in range(300):
        nodes = [x if k < 2 else ("+", (x, y)) if k == 2 else ("?", (x, ("+", (y,)))) for k, x, y in ((rng.randrange(4), rng.choice("ab#"), rng.choice("abc")) for _ in range(4))]
        form = "".join(n if isinstance(n, str) else f"({''.join(n[1])})+" if n[0] == "+" else f"{n[1][0]}?({n[1][1][1][0]}+)?" for n in nodes)
        wrapper = wrappers.Wrapper(nodes)
        for _ in range(20):
            stream = [rng.choice("ab#c") for _ in range(rng.randint(0, 7))]
            places = wrapper.match(stream)
            assert (places is not None) == bool(re.fullmatch(form, "".join(stream)))
            assert places is None or [wrapper.tokens[p] for p in places] == stream


def test_html_of_pages_that_differ_within_a_host(spark):
    line = "Sentence number {} of this page, which goes on for a while."
    two = [(i, f"http://t.example/{i}", (f"<article><p>{line}</p></article>" if i % 3 else f"<div class=entry><p>{line}</p></div><div>same</div>").format(i)) for i in range(12)]
    copies = [(100 + i, f"http://c.example/{i}", f"<div><p>{line}</p></div><div>same</div>".format(i if i < 3 else "x")) for i in range(300)]
    got = {r["id"]: r["text"] for r in wrappers.texts(spark.createDataFrame([*two, *copies], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [line.format(i) for i in range(12)]
    assert [got[100 + i] for i in (0, 1, 2, 3, 299)] == [line.format(x) for x in (0, 1, 2, "x", "x")]


def test_expressions_come_from_all_pages_of_a_host(spark, monkeypatch):
    line = "Sentence number {} of this page, which goes on for a while."
    often = [(i, f"http://f.example/{i}", f"<body><h4>{line}</h4></body>".format(i)) for i in range(200)]
    rare = [(1000 + i, f"http://f.example/{i}", f"<body><div>{line}</div><hr><div>The same line on all pages of this form.</div></body>".format(i)) for i in range(3)]
    df = spark.createDataFrame([*often, *rare], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in wrappers.texts(df).collect()}
    assert got == {i: line.format(i % 1000) for i, *_ in [*often, *rare]}
    # Hundreds of forms, aligned a few at a time: the expression accepts every page.
    rng = random.Random(4)
    mixed = ["<body>" + "".join(rng.choice(("<p>a</p>", "<hr>", "<h2>b</h2>", "<ul><li>c</li><li>d</li></ul>")) for _ in range(rng.randint(1, 8))) + "</body>" for _ in range(400)]
    rows = spark.createDataFrame([("h" if i % 9 else "other", page) for i, page in enumerate(mixed)], "host string, html string")
    for forms in (64, 5):
        monkeypatch.setattr(wrappers, "FORMS", forms)
        found = {r["host"]: wrappers.Wrapper(wrappers.nodes_of(r["wrapper"])) for r in wrappers.wrappers(rows).collect()}
        assert set(found) == {"h", "other"}
        assert all(found["h" if i % 9 else "other"].match(wrappers.stream_of(list(wrappers.slots(page)))) is not None for i, page in enumerate(mixed))
    # What a page matches does not take longer with the number of places that would do.
    long = wrappers.Wrapper([("?", tuple("ab" * 3000))])
    assert long.match(list("ab" * 3000)) == list(range(6000)) and long.match(list("ba" * 3000)) is None


def test_differences_of_long_streams(monkeypatch):
    rng = random.Random(11)
    for compared in (1 << 22, 40, 0):
        monkeypatch.setattr(wrappers, "COMPARED", compared)
        for _ in range(60):
            a, b = ([rng.choice("abcdef") if rng.random() < 0.8 else f"u{rng.randrange(30)}" for _ in range(rng.randint(0, 40))] for _ in range(2))
            i = j = 0
            for op, x, y, z, w in wrappers.differences(a, b):
                assert (x, z) == (i, j) and (op != "equal" or a[x:y] == b[z:w])
                i, j = y, w
            assert (i, j) == (len(a), len(b))


def test_html_of_pages_of_many_blocks(spark):
    line = "Sentence number {} of this page, which goes on for a while."
    page = "<body><div class=q>Always the same words here.</div>" + "".join(f"<h5>{{0}} part {k}, which is as long as any text.</h5><table></table>" if k % 3 else f"<pre>{{0}} part {k}, which is as long as any text.</pre>" for k in range(3000)) + "<blockquote>" + line.replace("{}", "{0}") + "</blockquote><div class=q>Always the same words here.</div></body>"
    pages = [(i, f"http://long.example/{i}", page.format(i) if i % 2 else page.format(i).replace("<table></table>", "")) for i in range(6)]
    got = {r["id"]: r["text"] for r in wrappers.texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].startswith(f"{i} part 0,") and got[i].endswith(line.format(i)) and "Always" not in got[i] and got[i].count(" part ") == 3000
    assert len(list(wrappers.slots("<div><b>" * 20_000 + "x" + "</b></div>" * 20_000))) > 20_000


def test_wrappers_in_a_join_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.x/{i}", f"<nav>n</nav><p>Text number {i} is here for all to read.</p>") for i in range(30)], "page_id long, url string, html string")
    one = sorted(map(tuple, wrappers.texts(df).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_HOSTS", 1)
    assert sorted(map(tuple, wrappers.texts(df).collect())) == one


@pytest.mark.parametrize("shard", [32 << 20, 200])
def test_decontamination_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(4)
    items = [(i, text(rng, rng.randint(3, 30))) for i in range(12)] + [(20, None), (21, "--"), (22, "Solo"), (23, "solo")]
    planted = [(500 + i, f"{text(rng, 20)}, {t.upper()}! {text(rng, 5)}", "en", "s", 1) for i, t in items[:8]] + [(600, "a SOLO, b-solo", "en", "s", 1)]
    docs, bench = documents(spark, planted), spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    def brute(t):
        w, hit, own = norm(t), set(), set()
        for item, x in items:
            v = norm(x)
            for win in {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9) if v else 0)}:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        own.add(str(item))
        return len(w), len(hit), tuple(sorted(own))

    got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.hits(docs, bench).collect())
    assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for (_, _, h, _), n in got.items() if not h)
    r = next(r for r in decontaminate.hits(docs, bench).collect() if r["id"] == 600)
    assert [tuple(s) for s in r["spans"]] == [(2, 6), (10, 14)]
    assert decontaminate.hits(empty(spark), bench).count() == 0 and decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("shard", [32 << 20, 20])
def test_decontamination_finds_items_without_id(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    bench = spark.createDataFrame([(None, "held out words"), (None, "more words"), (1, "held out words"), (2, "other")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Held, out words"), (2, "more words b"), (3, "nothing here"), (4, "other")], "doc_id long, text string")
    found = decontaminate.hits(docs, bench).withColumn("sha", decontaminate.items_sha256(F.col("items")))
    got = {r["id"]: (r["n_hit"], r["items"]) for r in found.collect()}
    assert got == {1: (3, ["1", None]), 2: (2, [None]), 3: (0, []), 4: (1, ["2"])}
    sha = {r["id"]: r["sha"] for r in found.collect()}
    assert sha[2] == sha[3] == hashlib.sha256(b"").hexdigest() and sha[1] == hashlib.sha256(b"1").hexdigest()
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_probabilities_of_words_sum_to_one(monkeypatch):
    monkeypatch.setattr(toxicity, "ALPHABET", 6)
    alphabet = "abcd\x02\x03"
    spelt = toxicity.Spelling(["ab", "abc", "dab", "bb"])
    for h in ("\x02\x02\x02", "\x02\x02a", "dab", "ccc", "bd"):
        assert abs(sum(spelt.next(h[-3:] + c) for c in alphabet) - 1) < 1e-9
    counts = {b"ab": (5, 0), b"abc": (3, 4), b"dab": (0, 6), b"bb": (2, 1)}
    model = toxicity.Model(counts, (12, 13))
    for k in (0, 1):  # known words beside the backoff's share of all other strings
        known = sum(model.probabilities(n, spelt(w.decode()))[k] for w, n in counts.items())
        others = model.spare[k] * (1 - sum(spelt(w.decode()) for w in counts))
        assert abs(known + others - 1) < 1e-9


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(16)
    rows = [(i, text(rng, rng.randint(20, 60)) + (" vile, Nasty foul!" if i % 3 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(7, 1), (8, 1)], "doc_id long, toxic int")  # 7 and 8 have both
    model = toxicity.train(df, labels, F.lit(True))
    known = {r["id"]: r["c"] for r in df.select(F.col("doc_id").alias("id"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("c")).collect()}
    counts = [Counter(), Counter()]
    for i, t in rows:
        if i not in (7, 8) and not known[i]:
            counts[int(i % 3 == 0)].update({w.strip(".,!") for w in t.lower().split()})
    every = {w: (counts[0][w], counts[1][w]) for w in counts[0] | counts[1] if counts[0][w] + counts[1][w] >= toxicity.MIN_DOCUMENTS}
    total = [sum(c.values()) for c in counts]
    spelt = toxicity.Spelling(list(every))
    spare = [1 - sum(max(n[k] - 0.75, 0) for n in every.values()) / total[k] for k in (0, 1)]
    llr = {w: math.log((max(n[1] - 0.75, 0) / total[1] + spare[1] * spelt(w)) / (max(n[0] - 0.75, 0) / total[0] + spare[0] * spelt(w))) for w, n in every.items()}
    for i, t in rows[:40]:
        d = np.array([llr.get(w.strip(".,!"), math.log(spare[1] / spare[0])) for w in t.lower().split()])
        assert np.allclose(model.features(t.encode()), (np.sort(d - np.median(d))[-5:].sum() / 5, math.log(len(d))))


def test_toxicity_of_words_of_thousands_of_characters():
    rng = random.Random(20)
    one, two = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)).encode() for _ in range(2))
    model = toxicity.Model({one: (0, 3), two: (3, 0), b"a": (3, 3), b"b": (2, 4)}, (1000, 900))  # their backoff is below any float
    assert math.isfinite(model.words[one]) and model.words[one] > 100 and model.words[two] < -100
    assert math.isclose(model.words[b"b"], math.log((p := model.probabilities((2, 4), toxicity.Spelling([w.decode() for w in model.words])("b")))[1] / p[0]))
    assert model.features(one + b" a a")[0] > 20 and one not in model.memory


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilething", "vilestuff", "vileness"]
    rows = [(i, text(rng, 60) + (" " + " ".join(rng.choice(bad) for _ in range(4)) if i % 4 == 0 else ""), "en", "s", 1) for i in range(1000, 1400)]
    docs = documents(spark, [*rows, (2000, text(rng, 60) + " vilemost vilething, Vileness", "en", "s", 1)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000, 1400)] + [(None, 1), (1, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, common.remainder(F.col("id"), 3) != 1)
    got = {r["id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held) and got[2000] >= 0.7
    assert all(0 <= s <= 1 for s in got.values()) and got[200] == got[201] == got[202] < 0.7
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and 2000 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.scores(docs, None).collect()} == {0.0} and toxicity.scores(empty(spark), model).count() == 0


def test_co_training(spark):
    rng = random.Random(7)
    rows = [(i, (text(rng, 70) if i % 3 else "$$ || ## " * 40), "en", "good" if i % 3 else "junk", 300) for i in range(3000, 3600)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(3000, 3200)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = cotraining.fit(docs, labels)
    got = {r["id"]: r["score"] for r in cotraining.scores(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(3200, 3600))
    assert cotraining.fit(docs, labels.limit(0)).views is None and cotraining.scores(empty(spark), model).count() == 0


def test_rollup(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", None)], "source string, lang string, tokenizer_version string, n_tokens long")
    assert r.commit("b1", token_rollup.inserts(rows)) and not r.commit("b1", token_rollup.inserts(rows))
    total = lambda: sorted(map(tuple, r.totals().collect()), key=repr)
    assert total() == sorted([("a", "en", "v1", 2, 12), (None, None, "v1", 1, 0)], key=repr)
    assert r.commit("b2", token_rollup.deletes(rows.where("n_tokens = 5")))
    new = rows.where("n_tokens = 7").select("source", "lang", F.lit("v2").alias("tokenizer_version"), F.lit(9).cast("long").alias("n_tokens"), F.lit("v1").alias("old_version"), F.col("n_tokens").alias("old_tokens"))
    assert r.commit("b3", token_rollup.revisions(new)) and r.commit("b4", token_rollup.inserts(rows.limit(0)))
    want = sorted([("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)], key=repr)
    assert total() == want
    assert r.compact() and not r.compact()
    assert total() == want and r.committed() == ["b1", "b2", "b3", "b4"] and not r.commit("b2", token_rollup.inserts(rows))
    long = [f"a batch/with+a very long id {i} " + "x" * 300 for i in range(4)]
    assert all(r.commit(i, token_rollup.inserts(rows)) for i in long) and r.compact() and r.compact() is False
    assert r.commit("b5", token_rollup.deletes(rows)) and {tuple(x) for x in r.totals().collect()} == {("a", "en", "v1", 6, 36), ("a", "en", "v2", 1, 9), (None, None, "v1", 4, 0)}
    counted = token_rollup.token_counts(documents(spark)).collect()
    assert len(counted) == documents(spark).count() and token_rollup.token_counts(empty(spark)).count() == 0


def test_rollup_of_racing_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer_version string, n_tokens long")
    r, won = token_rollup.Rollup(spark, str(tmp_path / "r")), []

    def write(k):
        other = token_rollup.Rollup(spark, str(tmp_path / "r"))
        for i in range(3):
            won.append((i, other.commit(f"b{i}", token_rollup.inserts(rows))))
            other.compact()

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(i for i, done in won if done) == [0, 1, 2]
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 15)]
    # A writer died with its marker half written: not committed, and taken over when it is stale.
    (tmp_path / "r" / "batches" / hashlib.sha256(b"b9").hexdigest()).write_text('{"id": "b')
    assert r.committed() == ["b0", "b1", "b2"] and not r.commit("b9", token_rollup.inserts(rows))
    token_rollup.STALE_S, before = -1, token_rollup.STALE_S
    try:
        assert r.commit("b9", token_rollup.inserts(rows)) and r.totals().first()["n_docs"] == 4
    finally:
        token_rollup.STALE_S = before


def test_rollup_query_against_a_count(spark, tmp_path):
    from corvid.llm import registry

    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    encoding, want = None, Counter()
    list(token_rollup.token_counts(docs.limit(1)).collect())
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(token_rollup.RANKS_PATH, "rb"))}
    encoding = tiktoken.Encoding("test", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = Counter()
    for r in docs.collect():
        n[r["source"], r["lang"]] += 1
        want[r["source"], r["lang"]] += len(encoding.encode_ordinary(r["text"] or ""))
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in registry.op10_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {(*k, "byte_bpe_50k"): (n[k], want[k]) for k in n}


def test_bounded_samples(spark):
    df = spark.range(10_000)
    place = F.xxhash64("id")
    got = common.smallest(df, place, 500)
    order = [r[0] for r in df.orderBy(place).select("id").collect()]
    found = {r[0] for r in got.collect()}
    assert 400 < len(found) <= 500 and found == set(order[: len(found)])
    assert common.smallest(df, place, 20_000).count() == 10_000 and common.smallest(df.limit(0), place, 5).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 7), (5, 1)], "doc_id long, y int")
    assert sorted(map(tuple, common.labelled(labels, "doc_id", "y").collect())) == [(1, 0), (5, 1)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, text(rng, 60) + (" vilething vileness vilestuff" if i % 5 == 0 else ""), "en", "s", 1) for i in range(1000, 1200)]
    documents(spark, rows).withColumn("fp", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000, 1200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1001 not in kept and 1002 in kept and 1005 not in kept and 101 not in kept
