"""From texts to labelled rows: label counts, splits, windows, statistics."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.batches import in_pieces
from ..functions.casing import event, lower
from ..functions.text import normalize_for_dataset
from ..plans.storage import materialise

SEED = 42
CELL_ROWS = 10_000


def label_counts(texts: DataFrame, *by: str) -> DataFrame:
    """(by..., label, n): labels of all words, every label listed for every group. One pass, one exchange of a row a group and task."""
    labels = T.labelled(T.tokenize(normalize_for_dataset(F.col("text"))))["label"]
    rows = texts.select(*by, F.explode_outer(labels).alias("label"))
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col("label") == x).alias(x) for x in T.LABELS))
    return counts.select(*by, F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in T.LABELS))).alias("c")).select(*by, "c.label", "c.n")


def hash_order(key: Column, seed: int = SEED) -> Column:
    """A fixed order by chance: md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def in_ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows cut into ranges of an order and sorted: `_part` numbers the ranges, `_at` the rows of a range from 0.

    The ranges are found from a sample, anew each time they are asked for; they are written, so that all readers see the same.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return materialise(cut, "ranges").select(*rows.columns, F.shiftright("_m", 33).cast("int").alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_at"))


def _before(parts: DataFrame, amount: str) -> DataFrame:
    """parts (_part, amount), a row a range, with `_before`: the amount of all ranges before."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(amount).over(w), F.lit(0)))


def ranked(ids: DataFrame, *order: Column | str) -> DataFrame:
    """ids with `rank` from 1 in a total order, without sorting all rows in one task.

    A row's rank is its place in its range and the rows of the ranges before, which are one row a range.
    """
    cut = in_ranges(ids, *order)
    before = _before(cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_n").select("_part", "_before")
    return cut.join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def split_ids(ids: DataFrame, key: str, train: float = 0.9, validation: float = 0.05, seed: int = SEED) -> DataFrame:
    """(key, split): train and validation get the floor of their share of the ids, test the rest."""
    one = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", hash_order(F.col(key).cast("string"), seed))
    total = one.count()
    a, b = int(total * train), int(total * validation)
    r = F.col("rank")
    return ranked(one, "_h", key).select(key, F.when(r <= a, "train").when(r <= a + b, "validation").otherwise("test").alias("split"))


def shared_ids(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split: empty where the splits are disjoint."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assert_disjoint(rows: DataFrame, key: str, split: str = "split") -> None:
    """An error that names some keys, if any key is in more than one split."""
    bad = shared_ids(rows.where(F.col(key).isNotNull()), key, split).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"in more than one {split}: {', '.join(str(r[key]) for r in bad)}")


def overlap_counts(rows: DataFrame, value: Column, split: str = "split") -> DataFrame:
    """(split_a, split_b, shared): distinct values that each pair of splits has in common, pairs without any included."""
    v = rows.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.array_sort(F.collect_set(split)).alias("s"))
    a = v.select("v", F.explode("s").alias("split_a"), "s").select("v", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    counted = a.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))
    names = rows.select(split).where(F.col(split).isNotNull()).distinct()
    pairs = names.select(F.col(split).alias("split_a")).join(names.select(F.col(split).alias("split_b")), F.col("split_a") < F.col("split_b"))
    return pairs.join(counted, ["split_a", "split_b"], "left").select("split_a", "split_b", F.coalesce("shared", F.lit(0)).alias("shared"))


def until_sum(rows: DataFrame, amount: str, most: float, key: str, order: Column | str | None = None) -> DataFrame:
    """Rows in order until the amounts before them reach `most`: the row that crosses it is kept. Null amounts count 0; none is negative.

    Ranges that end before `most` are kept whole, those that begin after it are dropped; only the rows of the range between
    need a running sum.
    """
    h = hash_order(F.col(key).cast("string")) if order is None else (F.col(order) if isinstance(order, str) else order)
    cut = in_ranges(rows.withColumn("_h", h), "_h", key)
    parts = _before(cut.groupBy("_part").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum")), "_sum").where(F.col("_before") < most)
    cut = cut.join(F.broadcast(parts), "_part")
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    crossing = cut.where(F.col("_before") + F.col("_sum") >= most).withColumn("_in", F.coalesce(F.sum(amount).over(w), F.lit(0))).where(F.col("_in") + F.col("_before") < most)
    whole = cut.where(F.col("_before") + F.col("_sum") < most)
    return whole.select(*rows.columns).union(crossing.select(*rows.columns))


def word_costs(words: Column) -> Column:
    """array<int>: sub-word cost of each word when no vocabulary is at hand: a quarter of its characters, one at least."""
    return F.transform(words, lambda w: F.greatest(F.lit(1), F.ceil(F.length(w) / 4)).cast("int"))


class _Budget:
    """Which words fit a budget, for many sequences at once: prefix sums of all costs, in which ends are found by search."""

    def __init__(self, costs: pa.ListArray, budget: int) -> None:
        size = pc.fill_null(pc.list_value_length(costs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.sums = np.concatenate([[0], np.cumsum(pc.list_flatten(costs).to_numpy(zero_copy_only=False).astype(np.int64))])
        self.first = np.cumsum(size) - size
        self.size, self.room = size, budget - 2  # two special tokens

    def reach(self, which: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The largest ends, at most `most`, whose words from `start` fit; one word always does."""
        at = self.first[which]
        far = np.searchsorted(self.sums, self.sums[at + start] + self.room, side="right") - 1 - at
        return np.clip(far, start + 1, most)


def _listed(n: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.ListArray:
    """list<struct<start,end>> of each of n sequences, from the (sequences, starts, ends) of each step."""
    which, start, end = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    o = np.argsort(which, kind="stable")
    offs = np.searchsorted(which[o], np.arange(n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(start[o].astype(np.int32)), pa.array(end[o].astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offs), pairs)


def training_spans(costs: pa.ListArray, ids: pa.Array, seed: int = SEED, budget: int = 256, least: int = 80, low: int = 110, high: int = 180, overlap: int = 8, tiny: int = 40) -> pa.ListArray:
    """The continuous windows of each sequence as list<struct<start,end>>, one window of every sequence at a time.

    A sequence under `tiny` words has none, one under `least` is one window. A window aims at a length between `low` and `high`
    drawn from a hash of seed, id and window, shares `overlap` words with the one before, and ends where the budget does. What
    is left at the end: under `tiny` words go into the last window as far as they fit or are dropped; a last window under
    `least` words begins earlier, but always after the one before.
    """
    fit = _Budget(costs, budget)
    n, names = fit.size, [x or "" for x in ids.to_pylist()]
    short = np.flatnonzero((n >= tiny) & (n < least))
    found = [(short, np.zeros(len(short), np.int64), n[short])]
    live = np.flatnonzero(n >= max(least, tiny))
    start, before = np.zeros(len(n), np.int64), np.full(len(n), -1)
    turn = 0
    while len(live):
        draw = np.array([int(hashlib.md5(f"{seed}:{names[i]}:{turn}".encode()).hexdigest()[:8], 16) for i in live], np.int64)
        aim, size = low + draw % (high - low + 1), n[live]
        at, rest = start[live], size - start[live]
        if turn:
            early = np.maximum(size - np.maximum(least, np.minimum(aim, rest + overlap)), before[live] + 1)
            at = np.where(rest < least, np.minimum(at, early), at)
        end = fit.reach(live, at, np.minimum(at + aim, size))
        stub = (end < size) & (size - end < tiny)
        end = np.where(stub, np.maximum(end, fit.reach(live, at, size)), end)
        found.append((live, at, end))
        before[live], start[live] = at, np.maximum(end - overlap, at + 1)
        live = live[(end < size) & (size - start[live] >= tiny)]
        turn += 1
    return _listed(len(n), found)


def inference_spans(costs: pa.ListArray, budget: int = 256, overlap: int = 32) -> pa.ListArray:
    """Windows of each sequence that fill the budget and share `overlap` words with the one before, as list<struct<start,end>>."""
    fit = _Budget(costs, budget)
    start, found = np.zeros(len(fit.size), np.int64), []
    live = np.flatnonzero(fit.size > 0)
    while len(live):
        end = fit.reach(live, start[live], fit.size[live])
        found.append((live, start[live], end))
        start[live] = np.maximum(end - overlap, start[live] + 1)
        live = live[end < fit.size[live]]
    return _listed(len(fit.size), found)


SPANS = "array<struct<start:int,end:int>>"


def windows(words: DataFrame, key: str, costs: Column, items: str = "items", training: bool = True, **rules: int) -> DataFrame:
    """(key, win, start, end, items): windows over the array column `items`; only costs and keys go through Python.

    rules: budget, overlap and, for training windows, least, low, high, tiny, seed. Null and empty items have no window.
    """

    @F.arrow_udf(SPANS)
    def spans(c: pa.Array, ids: pa.Array) -> pa.Array:
        cut = (lambda x, y: training_spans(x, y, **rules)) if training else (lambda x, y: inference_spans(x, **rules))
        return in_pieces(cut, c, ids, most=1 << 21)

    cut = words.select(key, items, F.posexplode(spans(costs, F.col(key).cast("string"))).alias("_k", "_s"))
    return cut.select(key, (F.col("_k") + 1).alias("win"), "_s.start", "_s.end", F.slice(items, F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("items"))


def edge_masked(labels: Column, first: int = 2, last: int = 4) -> Column:
    """Labels with the first and last few made null, where any would be left."""
    n = F.size(labels)
    hide = lambda x, i: F.when((i >= first) & (i < n - last), x)
    return F.when(n > first + last + 4, F.transform(labels, hide)).otherwise(labels)


def placed_labels(word_ids: Column, labels: Column, last: bool = True) -> Column:
    """A label for each sub-token: on the last (or first) of its word, null elsewhere; null word ids are special tokens."""

    def at(w: Column, i: Column) -> Column:
        beside = F.get(word_ids, i + 1) if last else F.when(i > 0, F.get(word_ids, i - 1))
        return F.when(w.isNotNull() & ~w.eqNullSafe(beside), F.get(labels, w))

    return F.transform(word_ids, at)


def window_statistics(rows: DataFrame, label: str = "PERIOD", by: str = "split") -> DataFrame:
    """(by, windows, labels, on_last, none, one, more, fraction_last): how often a label occurs in and ends windows."""
    n = F.size(F.filter("labels", lambda x: x == label))
    last = F.coalesce(F.element_at("labels", -1) == label, F.lit(False))
    some = rows.where(F.size("labels") > 0).select(by, n.alias("n"), last.alias("last"))
    return some.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").cast("long").alias("labels"), F.count_if("last").alias("on_last"), F.count_if(F.col("n") == 0).alias("none"),
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("more"),
        F.round(F.coalesce(F.try_divide(F.count_if("last"), F.sum("n")), F.lit(0.0)), 6).alias("fraction_last"),
    )


def weighted_share(rows: DataFrame, flag: str, weight: float = 2.0) -> DataFrame:
    """(windows, flagged, share, weighted_share) when flagged windows are drawn `weight` times as often."""
    n, f = F.count(F.lit(1)), F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return rows.agg(n.alias("windows"), f.alias("flagged"), F.round(F.try_divide(f, n), 6).alias("share"), F.round(F.try_divide(f * weight, f * weight + (n - f)), 6).alias("weighted_share"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from 8 hexadecimal digits of the md5 of seed and key: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def drawn(rows: DataFrame, key: str, weight: str, draws: int, seed: int = SEED) -> DataFrame:
    """(key, draw): `draws` draws with replacement, each row's chance being its weight over all weights.

    Weights are laid end to end in the order of key; draw k takes the row whose stretch holds the point uniform(seed, k). Rows
    and points meet in cells of about CELL_ROWS mean weights, so neither side is one task. Rows of one key are one with the
    largest weight; null keys and weights, and weights that aren't positive, are never drawn.
    """
    one = rows.where(F.col(key).isNotNull() & (F.col(weight) > 0)).groupBy(key).agg(F.max(F.col(weight).cast("double")).alias("_w"))
    cut = in_ranges(one, key)
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    parts = _before(cut.groupBy("_part").agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_rows")), "_sum")
    whole = parts.agg(F.sum("_sum").alias("w"), F.sum("_rows").alias("n")).head()
    if not whole["n"]:
        return one.select(key, F.lit(0).cast("long").alias("draw")).limit(0)
    cell = whole["w"] / whole["n"] * CELL_ROWS
    laid = cut.join(F.broadcast(parts.select("_part", F.col("_before").cast("double"))), "_part").withColumn("_to", F.col("_before") + inside).withColumn("_from", F.col("_to") - F.col("_w"))
    laid = laid.select(key, "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor(F.col("_to") / cell))).alias("_cell"))
    points = rows.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw"), (uniform(seed, F.col("id").cast("string")) * whole["w"]).alias("_x"))
    points = points.withColumn("_cell", F.floor(F.col("_x") / cell))
    return points.join(laid, "_cell").where("_x >= _from and _x < _to").select(key, "draw")


def class_weights(counts: DataFrame, base: str = "O", cap: float = 8.0) -> DataFrame:
    """(label, n, weight): the inverse square root of the count, over that of the base label, at most cap."""
    ref = counts.where(F.col("label") == base).agg(F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))).alias("ref"))
    w = F.sqrt(F.col("ref") / F.greatest(F.lit(1), F.col("n")))
    return counts.crossJoin(F.broadcast(ref)).select("label", "n", F.round(F.least(F.lit(cap), w), 6).alias("weight"))


def integrity(rows: DataFrame) -> DataFrame:
    """(checked, after_end, after_end_labelled, not_lower) of case windows (id, tokens, labels)."""
    flat = rows.select("id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "x")).select("id", "pos", F.col("x.tokens").alias("tok"), F.col("x.labels").alias("label"))
    return integrity_of(flat)


def integrity_of(rows: DataFrame) -> DataFrame:
    """The same of rows (id, pos, tok, label), a row a token.

    after_end counts the letter-words right after a sentence end, with the rule that a leading number clears it.
    """
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    flat = rows.where("tok is not null").withColumn("e", event(F.col("tok")))
    flat = flat.withColumn("before", F.last("e", True).over(w))
    after = (F.col("e") == "CONSUME") & (F.col("before") == "SET")
    trained = F.col("label").isNotNull() & (F.col("label") != "IGNORE")
    return flat.agg(
        F.count_if(trained).alias("checked"), F.count_if(after).alias("after_end"), F.count_if(after & trained).alias("after_end_labelled"), F.count_if(trained & (lower(F.col("tok")) != F.col("tok"))).alias("not_lower")
    )
