"""SentencePiece encoding and decoding by N-best segmentation.

Every text is a lattice of pieces. Forward Viterbi gives the best score of each prefix; that score is an exact
heuristic for a best-first (A-star) search backwards from the end, which pops the N best segmentations in order. No
piece crosses a break between a non-space and a space, nor a line feed, so the lattice falls apart at these breaks:
each part is solved once and remembered, and a text's N best are the N smallest sums of one detour per part. Only the
N-1 parts with the smallest first detour can take part in those, so a second score beside Viterbi's best finds the parts,
and the search runs on those alone; this is exact and linear. Viterbi takes the short parts of many texts together, in numpy.

The model file gives pieces and scores (it is read, never trained). The space is put in front of the text as the model
asks; characters without a piece become their UTF-8 bytes at the unknown score, the lowest score minus 10. U+2581 in a
text counts as such a character, so decoding gives back every text.

Defined results: a null text is an empty one; an empty text has no pieces, score 0 and one segmentation; repeated rows
and ties give the same result everywhere (of equal scores the best segmentation has the longer last piece); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import common

#: Where the vocabulary file is; a parameter of every function that needs it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
UNKNOWN_PENALTY = 10.0
#: Parts that each of two generations of a worker's memory holds, and the longest of them in characters.
REMEMBERED = 250_000
LONG = 48
#: Parts that Viterbi takes together at most, and the mark after each, which is no character.
TOGETHER, MARK = 20_000, 0x1FFFFF
SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class Lattice:
    def __init__(self, model: bytes, best: int = BEST):
        self.model, self.best = model, best
        self._load()

    def __getstate__(self):
        return {"model": self.model, "best": self.best}

    def __setstate__(self, state):
        self.__init__(**state)

    def _load(self) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.pieces[text] = ((i,), sp.get_score(i))
                self.bytes_of.append(text.encode())
        # Pieces by their characters: of each character what it ends, if a piece, and the characters that may follow.
        self.starts: dict[str, tuple] = {}
        for piece in sorted(self.pieces, key=len):
            here = self.starts
            for c in piece[:-1]:
                here = here.setdefault(c, (None, {}))[1]
            here[piece[-1]] = (self.pieces[piece], here.get(piece[-1], (None, {}))[1])
        self._number()
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - UNKNOWN_PENALTY  # -1e9 marks runs of spaces
        if any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("pieces that go on after a space or over lines are not supported")
        # Where a vocabulary has no piece that joins Latin letters to other characters, these breaks are forced as well.
        mixed = any(re.search(f"[{LATIN}][^{LATIN}]|[^{LATIN} ][{LATIN}]", p) for p in self.pieces)
        self.parts = re.compile(" *[^ \n]+|\n| +" if mixed else f" *[{LATIN}]+| *[^ \n{LATIN}]+|\n| +").findall
        self.memory: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.detours: dict[str, list[float]] = {}

    def _number(self) -> None:
        """``starts`` as arrays: nodes by number, and a hash table, eight times as large as its content at least, from a node and
        a character to the next node."""
        keys, pieces, inner, nodes = [], [((-1,), 0.0)], [True], [(0, self.starts)]
        for number, follow in nodes:  # grows while it is read
            for c, (found, more) in follow.items():
                keys.append(number << 21 | ord(c))
                nodes.append((len(pieces), more))
                pieces.append(found or ((-1,), 0.0))
                inner.append(bool(more))
        self.node_id = np.array([own[0] for own, _ in pieces], np.int32)  # -1: no piece ends here
        self.node_score, self.node_inner = np.array([x for _, x in pieces]), np.array(inner)
        bits = (8 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, node = np.array(keys, np.int64), np.arange(1, len(pieces), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.slot_key[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.slot_key[slot[free]], self.slot_node[slot[free]] = key[free], node[free]
            left = np.ones(len(key), bool)
            left[free] = False
            key, node, slot = key[left], node[left], (slot[left] + 1) & (len(self.slot_key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after each node by each character; 0 if there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slot(key)
        held = self.slot_key[slot]
        out = np.where(held == key, self.slot_node[slot], 0)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[slot[open_]]
            met = held == key[open_]
            out[open_[met]] = self.slot_node[slot[open_[met]]]
            open_ = open_[~met & (held >= 0)]
        return out

    def recall(self, parts: list[str]) -> dict[str, tuple[float, float, bytes]]:
        """``solve`` of different parts with a memory of two generations: when the young one is full the old one goes, so
        frequent parts, which are asked for again meanwhile, stay."""
        out = {p: found for p in parts if (found := self.old.pop(p, None))}
        short, rest = [], []
        for p in parts:
            if p not in out:
                (short if len(p) <= LONG else rest).append(p)
        for at in range(0, len(short), TOGETHER):
            for p, found in zip(some := short[at : at + TOGETHER], self.solve_together(some)):
                out[p] = found or self.solve(p)
        for p in rest:
            out[p] = self.solve(p)
        for p, found in out.items():
            if len(p) <= LONG:
                if len(self.memory) >= REMEMBERED:
                    self.old = dict(self.memory)
                    self.memory.clear()
                self.memory[p] = found
        return out

    def solve_together(self, parts: list[str]) -> list[tuple[float, float, bytes] | None]:
        """``solve`` of parts of at most LONG characters, with the same sums in the same order; None for a part that has
        a character without a piece, which takes bytes."""
        n = np.array(list(map(len, parts)), np.int64)
        # Each part is followed by a mark, so the places of a part, its end included, are those of its characters and the mark.
        chars = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        end = np.cumsum(n + 1) - 1
        first = end - n
        chars[end] = MARK
        rel = np.arange(len(chars)) - np.repeat(first, n + 1)
        at, node, k = np.arange(len(chars)), np.zeros(len(chars), np.int32), 0
        edges = []  # start, length, node of each piece that fits
        while len(at):
            node = self._next(node, chars[at + k])
            k += 1
            fits = self.node_id[node] >= 0
            edges.append((at[fits], np.full(int(fits.sum()), k), node[fits]))
            if k == 1:
                known = fits
            more = self.node_inner[node] & (node > 0)
            at, node = at[more], node[more]
        start, size, node = (np.concatenate(x) for x in zip(*edges))
        key = (rel[start] * (k + 1) + size).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        start, size, node = start[order], size[order], node[order]
        x, stop = self.node_score[node], start + size
        best, second, back = np.full(len(chars), -1e300), np.full(len(chars), -1e300), np.zeros(len(chars), np.int64)
        best[first] = 0.0
        bounds = np.cumsum(np.bincount(key))
        for lo, hi in zip([0, *bounds.tolist()], bounds.tolist()):
            if lo == hi:
                continue
            # Pieces of one length from one place of their parts: each ends at a place of its own.
            s, e, own = start[lo:hi], stop[lo:hi], x[lo:hi]
            y, old = best[s] + own, best[e]
            second[e] = np.maximum(np.maximum(second[e], np.minimum(y, old)), second[s] + own)
            better = np.flatnonzero(y > old)
            e = e[better]
            best[e], back[e] = y[better], better + lo
        known[end] = True
        whole = np.logical_and.reduceat(known, first)
        ids, steps = self.node_id[node], []
        number, place = np.flatnonzero(whole), end[whole]
        while len(number):
            edge = back[place]
            steps.append((number, ids[edge]))
            place = start[edge]
            left = rel[place] > 0
            number, place = number[left], place[left]
        count = np.zeros(len(parts), np.int64)
        for number, _ in steps:
            count[number] += 1
        last = np.cumsum(count)
        flat = np.empty(int(last[-1]) if len(last) else 0, "<i4")
        for t, (number, own) in enumerate(steps):
            flat[last[number] - 1 - t] = own
        data, to = flat.tobytes(), (4 * last).tolist()
        rows = zip(best[end].tolist(), (best[end] - second[end]).tolist(), [0, *to], to, whole.tolist())
        return [(score, gap, data[i:j]) if ok else None for score, gap, i, j, ok in rows]

    def solve(self, part: str) -> tuple[float, float, bytes]:
        """Forward Viterbi: score of the best segmentation, what the second best lacks to it, ids of the best."""
        starts, n, none = self.starts, len(part), -1e300
        best, second, back = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for i in range(n):
            here, also, j, known, follow = best[i], second[i], i, False, starts
            while j < n and (node := follow.get(part[j])):
                j += 1
                found, follow = node
                if found:  # a piece, not only the start of one
                    known = known or j == i + 1
                    ids, x = found
                    y = here + x
                    if y > best[j]:
                        second[j], best[j], back[j] = best[j], y, (i, ids)
                    elif y > second[j]:
                        second[j] = y
                    if also + x > second[j]:
                        second[j] = also + x
                if not follow:
                    break
            if not known:
                j, y = i + 1, here + self.unknown
                if y > best[j]:
                    second[j], best[j], back[j] = best[j], y, (i, self._spelt(part[i]))
                elif y > second[j]:
                    second[j] = y
                if also + self.unknown > second[j]:
                    second[j] = also + self.unknown
        ids, j = [], len(part)
        while j:
            j, own = back[j]
            ids.extend(reversed(own))
        ids.reverse()
        return best[-1], best[-1] - second[-1], struct.pack(f"<{len(ids)}i", *ids)

    def _spelt(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))

    def n_best(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the N best segmentations in order, by A-star from the end; what Viterbi found for each
        prefix is the exact score of the rest. Time and memory grow with the length of the part: an open item holds its
        last piece and a link to the item it came from, and ids are put together for the N best alone."""
        return [(g, _linked(link)) for g, link in self._search(part)]

    def _search(self, part: str) -> list[tuple[float, tuple | None]]:
        n, get = len(part), self.pieces.get

        def edges(j: int) -> list[tuple[int, float, tuple[int, ...]]]:
            own = [(i, found[1], found[0]) for i in range(max(0, j - self.longest), j) if (found := get(part[i:j])) is not None]
            if get(part[j - 1]) is None:
                own.append((j - 1, self.unknown, self._spelt(part[j - 1])))
            return own

        best = array("d", [0.0])
        for j in range(1, n + 1):
            best.append(max([best[i] + x for i, x, _ in edges(j)]))
        # Each open item has a completion of just its score and no two share one, so no more items than there are
        # segmentations missing need stay open.
        out: list[tuple[float, tuple | None]] = []
        open_items: list[tuple] = [(-best[n], 0, 0, n, 0.0, None)]
        number = 0  # of equal scores fewer pieces come first, then the item that was opened first
        while open_items and len(out) < self.best:
            _, size, _, at, g, link = open_items.pop(0)
            if at == 0:
                out.append((g, link))
                continue
            for i, x, own in edges(at):
                number += 1
                bisect.insort(open_items, (-(g + x + best[i]), size + len(own), number, i, g + x, (own, link)))
            del open_items[self.best - len(out) :]
        return out

    def encode(self, text: str | None) -> tuple[bytes, float, list[float]]:
        """Ids of the best segmentation (little-endian 32-bit), its score, the scores of the N best in order."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, float, list[float]]]:
        """``encode`` of each text; the parts that the memory lacks are solved together."""
        names = [self.parts(f" {t}") if t else [] for t in texts]
        found = [list(map(self.memory.get, own)) for own in names]
        new = self.recall(list(dict.fromkeys(p for own, parts in zip(names, found) if None in parts for p, x in zip(own, parts) if x is None)))
        return [self._joined(own, [x or new[p] for p, x in zip(own, parts)] if None in parts else parts) for own, parts in zip(names, found)]

    def _joined(self, names: list[str], parts: list[tuple[float, float, bytes]]) -> tuple[bytes, float, list[float]]:
        if not parts:
            return b"", 0.0, [0.0]
        scores, gaps, ids = zip(*parts)
        score, first = float(sum(scores)), np.array(gaps)
        k = min(self.best - 1, len(parts))
        sums = [0.0]
        for i in np.argpartition(first, k - 1)[:k].tolist() if k < len(parts) else range(k):
            detours = self.detours.get(names[i])
            if detours is None:
                if len(self.detours) > 20_000:
                    self.detours.clear()
                detours = self.detours[names[i]] = [scores[i] - g for g, _ in self._search(names[i])]
            sums = sorted(a + b for a in sums for b in detours)[: self.best]
        return b"".join(ids), score, [score - s for s in sums]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return data.decode("utf-8", "surrogatepass")[1:]


def _linked(link: tuple | None) -> tuple[int, ...]:
    out: list[int] = []
    while link is not None:
        out.extend(link[0])
        link = link[1]
    return tuple(out)


def load(path: str = MODEL_PATH, best: int = BEST) -> Lattice:
    with open(path, "rb") as f:
        return Lattice(f.read(), best)


def encode(df: DataFrame, lattice: Lattice, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_pieces, score, best_scores (N best), ids_sha256 (of the ids as little-endian 32-bit numbers),
    round_trip (decoding gives the text back), and the ids themselves unless ``with_ids`` is false."""
    held = df.sparkSession.sparkContext.broadcast(lattice)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_pieces", "score", "best_scores", "ids_sha256", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = held.value
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                texts = part.column(1).to_pylist()
                found = lattice.encode_all(texts)
                sizes = np.array([len(x[0]) // 4 for x in found], np.int64)
                columns = [
                    part.column(0),
                    pa.array(sizes),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.list_(pa.float64())),
                    pa.array([hashlib.sha256(x[0]).hexdigest() for x in found]),
                    pa.array([lattice.decode(x[0]) == (t or "") for x, t in zip(found, texts)]),
                ]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x[0] for x in found), "<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    return common.map_batches(rows, run, f"id {kind}, n_pieces long, score double, best_scores array<double>, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
