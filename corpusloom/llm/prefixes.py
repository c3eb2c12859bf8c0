"""Pairs of word bags that can share a given part of the words of the longer one: a superset, without loss.

Method: prefix filter. The words of each bag stand in one order for all bags, rare ones first; the k-th occurrence of a word
is a word of its own. Of n words a pair at the threshold shares at least least_shared(n), so both bags hold their first
common word among their first n - least_shared(n) + 1; bags meet in a cell for each of these. The pairs of a cell that lengths
allow are looked at, by bounds that can't reject a pair at the threshold: the words left after the common one, and the
parities of word counts in a row of bits, whose differing bits are no more than the words that only one of both bags has. The
bits are a few times as many as the words, and never so few that bags of many words, which share the frequent ones, pass
whatever they hold; of two bags the finer row is folded to the coarser by exclusive or.

A cell of more than BLOCK bags is cut into parts, and each two parts meet in rows of their own, so no task holds more than two
parts. Which cells are cut is estimated from one bag in SAMPLE; it decides who works where and never what comes out. The cells
are worked in rounds, each a part of the key space and written before the next begins: as many, ROUNDS at least, as keep the
rows sent in one within the bytes of the words themselves. So the disk needed stays in proportion to the bags even where cut
cells send a bag many times. The pairs looked at grow with the square of a word's bags; where words don't get rarer as a table
grows, so does that part of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ranges
from ..plans.storage import discard, materialise
from . import codepoints as cp

BLOCK = 4096
SAMPLE = 16
ROUNDS = 3
PAIRS_AT_ONCE = 400_000
FREQUENT = 0.0001
MOST_FREQUENT = 1_000_000
LEAST_BITS, MOST_BITS = 64, 4096
MANY_WORDS, FINE_OF_MANY = 512, 1.25
ROW_BYTES, BYTES_AT_ONCE = 40, 1 << 24
SIDE, LENGTH = 1 << 3, 32
U64 = np.uint64

POSTED = "cell long, node long, meta long, bits binary"


def least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def order_of(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts), sorted by word, of the words (word, df) in more than FREQUENT of all rows: at most mean words / FREQUENT.

    Texts so long that these were more than MOST_FREQUENT words get the most frequent of them; all other words come first,
    in the order of their hashes, which is an order for all bags as well.
    """
    frequent = counts.where(F.col("df") > int(FREQUENT * total)).select("word", "df")
    got = frequent.orderBy(F.desc("df"), "word").limit(MOST_FREQUENT).toArrow()
    words, df = got.column("word").to_numpy().astype(np.uint32), got.column("df").to_numpy().astype(np.int64)
    o = np.argsort(words)
    return words[o], np.minimum(df[o], (1 << 31) - 1)


def _tokens(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each word of bags, words sorted within rows."""
    row = cp.row_ids(offs)
    if not len(words):
        return row, np.empty(0, U64)
    new = np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])
    idx = np.arange(len(words))
    occ = idx - np.maximum.accumulate(np.where(new, idx, 0))
    return row, cp.mix64((words.astype(U64) << U64(20)) + occ.astype(U64) + U64(0x2545F491))


def _prefix(words: np.ndarray, offs: np.ndarray, row: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the prefix words, position of each in its bag's order). The order is (count, word, occurrence)."""
    known, df = order
    count = np.zeros(len(words), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        count = np.where(known[at] == words, df[at], 0)
    o = np.argsort((row << 32) | count, kind="stable")
    n = np.diff(offs)
    take = np.where(n > 0, n - least_shared(n, similarity) + 1, 0)
    pos = np.arange(len(words)) - np.repeat(offs[:-1], n)
    first = pos < np.repeat(take, n)
    return o[first], pos[first]


def _width(n: np.ndarray, fine: float) -> np.ndarray:
    """Bits of a bag of n words. Bags over MANY_WORDS, which send many rows, get as few a word as still tell them apart."""
    least = np.where(n > MANY_WORDS, np.maximum(n * min(fine, FINE_OF_MANY), min(MANY_WORDS * fine, MOST_BITS)), n * fine)
    return np.clip(1 << np.ceil(np.log2(np.maximum(least, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def _parities(row: np.ndarray, token: np.ndarray, n: np.ndarray, fine: float) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all rows, where each row's begin): bit t % width is odd where the row holds an odd number of tokens t."""
    width = _width(n, fine)
    base = np.concatenate([[0], np.cumsum(width)])
    at = base[row] + (token & (width[row] - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), base // 64


def _flat(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches words[begin : begin + size], one after the other."""
    ends = np.cumsum(size)
    return words[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(begin, size)]


def sizes_of(words: np.ndarray, offs: np.ndarray, group: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float, fine: float) -> pa.RecordBatch:
    """(cell, bytes, own) of each prefix word: bytes of its row, and its part of the bytes of its bag's words."""
    n = np.diff(offs)
    row, token = _tokens(words, offs)
    at, _ = _prefix(words, offs, row, order, similarity)
    r = row[at]
    own = (4.0 * n / np.maximum(1, np.bincount(r, minlength=len(n))))[r]
    return pa.RecordBatch.from_arrays([pa.array(cp.mix64(token[at] + group[r]).view(np.int64)), pa.array((ROW_BYTES + _width(n, fine) / 8)[r]), pa.array(own)], names=["cell", "bytes", "own"])


def _turns(keys: np.ndarray, node: np.ndarray, hot: tuple[np.ndarray, np.ndarray], rounds: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in keys, cells, parts) of the rows of this turn. A cell in hot is cut: the bag meets each part in a cell of its own.

    The part is 0 where a bag meets its own one, else 1 or 2 by the side it is on.
    """
    cut, many = hot
    parts = np.ones(len(keys), np.int64)
    if len(cut):
        at = np.minimum(np.searchsorted(cut, keys), len(cut) - 1)
        parts = np.where(cut[at] == keys, many[at], 1)
    for x, y in ranges(parts, 1 << 20):
        at = np.repeat(np.arange(x, y), parts[x:y])
        other = (np.arange(len(at)) - np.repeat(np.cumsum(parts[x:y]) - parts[x:y], parts[x:y])).astype(U64)
        mine = cp.mix64(node[at].view(U64) + U64(0x7F4A7C15)) % parts[at].astype(U64)
        pair = (np.minimum(mine, other) << U64(32)) | np.maximum(mine, other)
        cell = np.where(parts[at] > 1, cp.mix64(keys[at] ^ cp.mix64(pair + U64(0x9E3779B9))), keys[at])
        part = np.where(mine == other, 0, np.where(mine < other, 1, 2))
        sel = cell % U64(rounds) == U64(turn)
        yield at[sel], cell[sel], part[sel]


def posted(words: np.ndarray, offs: np.ndarray, node: np.ndarray, side: np.ndarray, group: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float, hot: tuple[np.ndarray, np.ndarray], rounds: int, turn: int, fine: float) -> Iterator[pa.RecordBatch]:
    """A row for each prefix word, and each part of its cell, whose key belongs to this turn; keys differ by group. fine: least bits for each word."""
    n = np.diff(offs)
    row, token = _tokens(words, offs)
    at, pos = _prefix(words, offs, row, order, similarity)
    keys = cp.mix64(token[at] + group[row[at]])
    bits, begin = _parities(row, token, n, fine)
    width = np.diff(begin)
    for places, cells, parts in _turns(keys, node[row[at]], hot, rounds, turn):
        for x, y in ranges(width[row[at[places]]] * 8, BYTES_AT_ONCE):
            k = places[x:y]
            r = row[at[k]]
            size = width[r]
            flat = _flat(bits, begin[:-1][r], size)
            ends = np.concatenate([[0], np.cumsum(size)]) * 8
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            meta = (n[r] << LENGTH) | (pos[k] << 4) | np.where(side[r] > 0, SIDE, 0) | parts[x:y]
            yield pa.RecordBatch.from_arrays([pa.array(cells[x:y].view(np.int64)), pa.array(node[r]), pa.array(meta), held], names=["cell", "node", "meta", "bits"])


def _apart(bits: np.ndarray, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The differing bits of rows i and j, the finer folded to the coarser."""
    out = np.zeros(len(i), np.int64)
    kind = (size[i] << 32) | size[j]
    for k in np.unique(kind):
        sel = np.flatnonzero(kind == k)
        si, sj = int(k) >> 32, int(k) & 0xFFFFFFFF
        w = min(si, sj)
        for c in range(w):
            x = bits[begin[i[sel]] + c]
            for d in range(c + w, si, w):
                x = x ^ bits[begin[i[sel]] + d]
            for d in range(c, sj, w):
                x = x ^ bits[begin[j[sel]] + d]
            out[sel] += np.bitwise_count(x)
    return out


def _met(similarity: float, cross: bool):
    def pairs(cell, node, meta, bits, size) -> Iterator[pa.RecordBatch]:
        begin = np.cumsum(size) - size
        n, part = meta >> LENGTH, meta & 7
        o = np.lexsort((node, meta & 15, n, cell))
        again = np.concatenate([[False], (cell[o][1:] == cell[o][:-1]) & (node[o][1:] == node[o][:-1]) & ((meta[o][1:] & 15) == (meta[o][:-1] & 15))])
        o = o[~again]  # a class that several tasks sent on
        cell, node, meta, n, part, begin, size = (x[o] for x in (cell, node, meta, n, part, begin, size))
        pos, side = (meta & ((1 << LENGTH) - 1)) >> 4, (meta & SIDE) > 0
        group = np.cumsum(np.concatenate([[True], cell[1:] != cell[:-1]])).astype(np.int64) << 32
        # Of two lengths the longer is at most the shorter / similarity.
        longest = group + np.floor(n / similarity + 1e-6).astype(np.int64)
        if cross:
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
            at = (group + n)[right]
            lo = np.searchsorted(at, (group + np.ceil(n * similarity - 1e-6).astype(np.int64))[left], side="left")
            hi = np.searchsorted(at, longest[left], side="right")
        else:
            left = right = np.arange(len(n))
            lo, hi = left + 1, np.searchsorted(group + n, longest, side="right")
        count = np.maximum(0, hi - lo)
        ends = np.cumsum(count)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            c = count[at:to]
            i = np.repeat(left[at:to], c)
            j = right[np.repeat(lo[at:to], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)]
            at = to
            need = least_shared(np.maximum(n[i], n[j]), similarity)
            ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ((part[i] == 0) | (part[i] != part[j]))
            if not cross:
                ok &= node[i] != node[j]
            i, j, need = i[ok], j[ok], need[ok]
            ok = _apart(bits, begin, size, i, j) <= n[i] + n[j] - 2 * need
            a, b = node[i[ok]], node[j[ok]]
            if not cross:
                a, b = np.minimum(a, b), np.maximum(a, b)
            if len(a):
                one = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1])], names=["a", "b"])

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        cell, node, meta = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "node", "meta"))
        held = b.column("bits").cast(pa.large_binary())
        offs = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        return [cell, node, meta, np.frombuffer(held.buffers()[2], np.uint8)[offs[0] : offs[-1]].view("<u8"), np.diff(offs) // 8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not len(b):
                continue
            now = arrays(b)
            held.append(now)
            rows += len(b)
            if rows < 50_000 or held[0][0][0] == now[0][-1]:
                continue
            x = [np.concatenate(y) for y in zip(*held)]
            cut = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1
            bit = int(x[4][:cut].sum())
            yield from pairs(*(y[:cut] for y in x[:3]), x[3][:bit], x[4][:cut])
            held, rows = [[*(y[cut:] for y in x[:3]), x[3][bit:], x[4][cut:]]], len(x[0]) - cut
        if held:
            yield from pairs(*[np.concatenate(x) for x in zip(*held)])

    return run


def plan(sizes: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """((cells that are cut, their parts), rounds) by the sample's cells (cell, parts, bytes, own).

    A cut cell holds BLOCK bags or more, so they are no more than rows sent / BLOCK.
    """
    got = sizes.where("parts > 1").select("cell", "parts").toArrow()
    cell, many = got.column("cell").to_numpy().astype(np.int64).view(U64), got.column("parts").to_numpy().astype(np.int64)
    o = np.argsort(cell)
    sent, own = sizes.agg(F.sum(F.col("bytes") * F.col("parts")), F.sum("own")).head()
    return (cell[o], many[o]), max(ROUNDS, int(np.ceil((sent or 0) / max(own or 0, 1))))


def candidates(bags: DataFrame, unpack, order: tuple[np.ndarray, np.ndarray], similarity: float, cross: bool = False, fine: float = 2.0) -> DataFrame:
    """Distinct pairs (a, b) of nodes of a written table of bags (node, side, grp, words) that pass the bounds, written.

    Bags of one node and side are the same; unpack gives (words, offsets) of a column. With cross, a is of side 1, b of side 0.
    Finer bits let fewer pairs pass that aren't at the threshold, and are more bytes to move.
    """

    def arrays(b: pa.RecordBatch, seen: Seen) -> tuple:
        node, side = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "side"))
        fresh = seen.fresh(node ^ (side * 0x5851F42D4C957F2D))
        b = b.filter(pa.array(fresh))
        return *unpack(b.column("words")), node[fresh], side[fresh], b.column("grp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)

    def size_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in cp.slices(batches, "words", most=1 << 22):
            words, offs, _, _, group = arrays(b, seen)
            yield sizes_of(words, offs, group, order, similarity, fine)

    def post_rows(hot: tuple[np.ndarray, np.ndarray], rounds: int, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Seen()
            for b in cp.slices(batches, "words", most=1 << 22):
                words, offs, node, side, group = arrays(b, seen)
                if len(node):
                    yield from posted(words, offs, node, side, group, order, similarity, hot, rounds, turn, fine)

        return run

    rows = bags.select("node", "side", "grp", "words")
    some = rows.where(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(size_rows, "cell long, bytes double, own double")
    sizes = some.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.sum("own").alias("own"))
    sizes = materialise(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("size") * SAMPLE / BLOCK)).cast("long").alias("parts"), "bytes", "own"), "sizes")
    hot, rounds = plan(sizes)
    discard(sizes)
    parts = []
    for turn in range(rounds):
        cells = rows.mapInArrow(post_rows(hot, rounds, turn), POSTED)
        met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_met(similarity, cross), "a long, b long").distinct()
        met = materialise(met, "met")
        parts.append(met)
        discard(spark=bags.sparkSession)
    edges = materialise(reduce(DataFrame.union, parts).distinct(), "edges")
    discard(*parts)
    return edges


class Seen:
    """Nodes that a task has already sent on: copies leave a task once, so a hot group of copies is one row a task."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.most, self.parts, self.size = most, [], 0

    def fresh(self, nodes: np.ndarray) -> np.ndarray:
        first = np.zeros(len(nodes), bool)
        first[np.unique(nodes, return_index=True)[1]] = True
        for known in self.parts:
            at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
            first &= known[at] != nodes
        new = np.sort(nodes[first])
        if self.size + len(new) > self.most:
            self.parts, self.size = [], 0
        if len(new):
            # Sorted runs, merged when a run is no longer than the one behind it.
            self.size += len(new)
            while self.parts and len(self.parts[-1]) <= 2 * len(new):
                new = np.sort(np.concatenate([self.parts.pop(), new]))
            self.parts.append(new)
        return first
