"""Problem 1: records whose texts share most of their words, found without comparing all pairs.

Method: prefix filter over words in order of their frequency (prefixes), exact check.

1. Each text in its consistent form (problem 3) becomes a bag of word hashes, lower case. Equal bags are one class; only
   classes go on, so exact copies, however many, cost one row.
2. Words are counted over all texts. Two texts that share `similarity` of the words of the longer share one of their rarest
   (1 - similarity) n + 1 words; classes meet in a bucket for each of these. Frequent words are only last in the order, so
   nothing depends on how many texts hold a word, and families of near copies over any part of the table meet.
3. All pairs of a bucket that bounds on length, rest and differing words don't exclude are checked exactly: no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, materialise
from ..sources.tables import table
from . import codepoints as cp
from . import lookalikes, prefixes

MIN_WORDS = 30
SIMILARITY = 0.8
PART = 4096
U64 = np.uint64

BAG_SCHEMA = "tab string, record_key string, bag long, words binary"


def bag_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes uint32 sorted within rows, row offsets) of a text column."""
    cps, offs = cp.decode(col)
    cps, offs, _ = lookalikes.canonical(cps, offs)
    low = cp.tables()[0][cps]
    start, end, row = cp.word_runs(low, offs)
    return sorted_bags(cp.run_hashes(low, start, end), row, len(offs) - 1)


def sorted_bags(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = (row.astype(U64) << U64(32)) | (hashes >> U64(32))
    key.sort()
    offs = np.searchsorted(key, np.arange(n + 1, dtype=U64) << U64(32))
    return (key & U64(0xFFFFFFFF)).astype(np.uint32), offs.astype(np.int64)


def bag_ids(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One id for each row: equal for equal bags."""
    n = len(offs) - 1
    out = np.zeros(n, U64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(cp.mix64(words.astype(U64) + U64(0x51ED270B)), offs[:-1][full])
    return cp.mix64(out + np.diff(offs).astype(U64)).view(np.int64)


def _binary(words: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs * 4).astype(np.int64).tobytes()), pa.py_buffer(words.astype("<u4").tobytes())]).cast(pa.binary())


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    if data is None:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view("<u4"), (o - o[0]) // 4


def _bags(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cp.pieces(batches):
            words, offs = bag_arrays(b.column("text"))
            n = np.diff(offs)
            keep = np.flatnonzero(n >= least)
            if len(keep):
                sel = np.repeat(n >= least, n)
                w, o = words[sel], np.concatenate([[0], np.cumsum(n[keep])])
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [b.column("tab").take(take), b.column("record_key").take(take), pa.array(bag_ids(w, o)), _binary(w, o)],
                    names=["tab", "record_key", "bag", "words"],
                )

    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, number of rows with it), summed over a few batches before they leave the task."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        w = np.concatenate([x[0] for x in held])
        c = np.concatenate([x[1] for x in held])
        o = np.argsort(w, kind="stable")
        w, c = w[o], c[o]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(w[first].astype(np.int64)), pa.array(np.add.reduceat(c, first))], names=["word", "df"])

    for b in cp.slices(batches, "words", most=1 << 22):
        words, offs = unpack(b.column("words"))
        if not len(words):
            continue
        row = cp.row_ids(offs)
        first = np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])
        w, c = np.unique(words[first], return_counts=True)
        held.append((w, c.astype(np.int64)))
        size += len(w)
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def shared_words(wa: np.ndarray, oa: np.ndarray, wb: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """For each row how many words both bags hold, counted as often as they occur in both.

    Words are sorted within rows, so that the keys (row, word, occurrence) are sorted and the sides are merged by search.
    """
    n = len(oa) - 1
    keys = []
    for w, o in ((wa, oa), (wb, ob)):
        row = cp.row_ids(o)
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (row[1:] != row[:-1])]) if len(w) else np.empty(0, bool)
        idx = np.arange(len(w))
        occ = idx - np.maximum.accumulate(np.where(new, idx, 0)) if len(w) else idx
        keys.append(((row << 32) | w.astype(np.int64), occ))
    (a, i), (b, _) = keys
    if not len(a) or not len(b):
        return np.zeros(n, np.int64)
    # The k-th occurrence in a is shared if b holds the word more than k times: b's run of the word begins at its first place.
    first = np.searchsorted(b, a, side="left")
    at = first + i
    both = (at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)
    return np.bincount((a >> 32)[both], minlength=n)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in cp.slices(batches, "wa", "wb"):
        wa, oa = unpack(b.column("wa"))
        wb, ob = unpack(b.column("wb"))
        hit, na, nb = shared_words(wa, oa, wb, ob), np.diff(oa), np.diff(ob)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(hit / np.maximum(1, np.maximum(na, nb))), pa.array(hit / np.maximum(1, na))], names=["a", "b", "sim", "contained"])


def checked(edges: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, sim, contained) of pairs of classes, by their bags; bags has one row for each class.

    sim is the share of the longer bag's words that both hold, contained the share of a's words.
    """
    wa = bags.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    wb = bags.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return edges.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInArrow(_check, "a long, b long, sim double, contained double")


def text_bags(texts: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(tab, record_key, node, words) of texts (tab, record_key, text) with at least `least` words, written once.

    A node is an id of (tab, bag): rows of one node have the same words.
    """
    plain = texts.where("text is not null and record_key is not null").select("tab", "record_key", "text")
    bags = plain.mapInArrow(_bags(least), BAG_SCHEMA)
    return materialise(bags.select("tab", "record_key", F.xxhash64("tab", "bag").alias("node"), "words"), "bags")


def word_counts(bags: DataFrame) -> DataFrame:
    """(word, df): the number of rows that hold each word."""
    return bags.select("words").mapInArrow(_distinct_words, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))


def verified(edges: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sim, contained) of the written edges whose bags share at least `similarity` of the longer one's words, written."""
    near = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = materialise(bags.select("node", "words").join(near, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "held")
    links = materialise(checked(edges, held).where(F.col("sim") >= similarity), "links")
    discard(held)
    return links


def similar_classes(bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, sim, contained): the links between the nodes of written bags, written."""
    order = prefixes.order_of(word_counts(bags), bags.count())
    edges = prefixes.candidates(bags.select("node", F.lit(0).alias("side"), F.xxhash64("tab").alias("grp"), "words"), unpack, order, similarity)
    links = verified(edges, bags, similarity)
    discard(edges)
    return links


def pairs_within(members: DataFrame, group: str, key: str) -> DataFrame:
    """(group, x, y): all pairs x < y of keys of one group. A large group is cut into parts of PART, and each part is a task's own."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(group, F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    many = members.select(group, key).join(sizes, group)
    left = many.select(group, F.col(key).alias("x"), F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    right = many.select(group, F.col(key).alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [group, "part"]).where("x < y").select(group, "x", "y")


def pairs(texts: DataFrame, similarity: float = SIMILARITY, least: int = MIN_WORDS) -> DataFrame:
    """(tab, key_a, key_b): pairs of different keys of one tab whose texts share at least `similarity` of the words of the longer.

    Null and empty texts and texts under `least` words are in no pair. Rows that come again give no pair of their own;
    copies under several keys give every pair of keys, which is what the result's form asks for.
    """
    bags = text_bags(texts, least)
    links = similar_classes(bags, similarity)
    keys = bags.select("tab", "record_key", "node").distinct()
    x = keys.select("tab", F.col("record_key").alias("x"), F.col("node").alias("a"))
    y = keys.select(F.col("record_key").alias("y"), F.col("node").alias("b"))
    near = links.join(x, "a").join(y, "b").select("tab", "x", "y")
    named = materialise(keys.select("node", F.struct("tab", "record_key").alias("k")), "keys")
    same = pairs_within(named, "node", "k").select("x.tab", F.col("x.record_key").alias("x"), F.col("y.record_key").alias("y"))
    out = near.where("x <> y").unionByName(same)
    return out.select("tab", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def groups(texts: DataFrame, similarity: float = SIMILARITY, least: int = MIN_WORDS) -> DataFrame:
    """(tab, record_key, class_id, links, copies): one row for each row of text with at least `least` words.

    class_id is the least key of all texts that links join, directly or through others; links counts the different texts that a
    text is linked to, copies the rows with the same text.
    """
    from .groupsplit import propagate

    keyed = text_bags(texts, least)
    found = similar_classes(keyed, similarity)
    nodes = materialise(keyed.groupBy("node").agg(F.min("tab").alias("tab"), F.min("record_key").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    name = F.concat_ws("\x1f", "tab", "first")
    ends = found.select(F.concat_ws("-", "a", "b").alias("record_id"), F.explode(F.array("a", "b")).alias("node"))
    edges = ends.join(nodes.select("node", name.alias("document")), "node").select("record_id", "document")
    labels = propagate(materialise(edges, "edges")).select("document", F.split_part("label", F.lit("\x1f"), F.lit(2)).alias("class_id"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    per = nodes.select("node", "first", "copies", name.alias("document")).join(labels, "document", "left").join(degree, "node", "left")
    out = keyed.select("tab", "record_key", "node").join(per, "node")
    return out.select("tab", "record_key", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")


def corpus_texts(spark: SparkSession, folder: str, *tabs: str) -> DataFrame:
    """(tab, record_key, text, ...) of the named tables, keys as strings."""
    keys = {"raw_records": "record_id", "documents": "doc_id", "wikipedia": "article_id"}
    out = None
    for t in tabs:
        df = table(spark, folder, t).select(F.lit(t).alias("tab"), F.col(keys[t]).cast("string").alias("record_key"), "text")
        out = df if out is None else out.unionByName(df)
    return out
