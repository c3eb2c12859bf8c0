"""Samples and selections: ranks, floors, rounds over sources, a cap on shares, fillers."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import Counter, deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of
from ..plans.storage import materialise
from .corpus import SEED, hash_order, ranked, uniform, until_sum

AHEAD = 1000


def score(rows: DataFrame) -> Column:
    """The additive score of a record by length, questions, context, flags and source. Its limits and points are fixed values."""
    w, q = F.coalesce("word_count", F.lit(0)), F.coalesce("question_count", F.lit(0))
    length = F.when((w >= 20) & (w <= 250), 5.0).when((w >= 10) & (w < 20), 1.0).when(w > 250, 2.0).otherwise(0.0)
    asks = F.when((q >= 1) & (q <= 3), 3.0).when(q > 3, 0.5).otherwise(0.0)
    context = F.when(F.coalesce("text", F.lit("")).rlike(r"[.!] .+\?"), 2.0).otherwise(0.0)
    minus = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), -x).otherwise(0.0)
    prior = F.when(F.col("source") == "kurdish_ai_corpus", 0.5).when(F.col("source") == "tatoeba", -1.5).otherwise(0.0)
    return length + asks + context + minus("needs_context", 3.0) + minus("turkish_review_flag", 1.0) + minus("context_constructed", 2.0) + prior


def best_of(rows: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each group in a total order, with `rank`.

    Spark keeps only `most` rows of a group in each task before the exchange, so a hot group is small when it meets.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def allocation(sizes: DataFrame, by: str, total: int, floor: int) -> DataFrame:
    """(by, size, take) of (by, size): how many of each group a sample of `total` rows takes.

    Each group gets its floor, or all it has; if the floors alone are too many, groups are served in the order of names. What
    is left is shared by the rows that groups have left: everyone its quota rounded down, then one each to the largest
    remainders, the first name of equals. No group gets more than it has, and the takes add up to `total` or to all rows.
    """
    names = Window.orderBy(by)
    every = Window.partitionBy()
    f = sizes.where(F.col(by).isNotNull() & (F.col("size") > 0)).select(by, "size", F.least(F.lit(floor), F.col("size")).alias("_f"))
    f = f.withColumn("_f", F.greatest(F.lit(0), F.least("_f", total - (F.sum("_f").over(names.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_f")))))
    f = f.withColumn("_free", F.col("size") - F.col("_f")).withColumn("_rest", F.least(F.greatest(F.lit(0), total - F.sum("_f").over(every)), F.sum("_free").over(every)))
    # Whole numbers throughout: the quota is rest * free / all free.
    all_free = F.greatest(F.lit(1), F.sum("_free").over(every))
    f = f.withColumn("_q", F.expr("_rest * _free").cast("decimal(38,0)")).withColumn("_all", all_free)
    f = f.withColumn("_whole", F.floor(F.col("_q") / F.col("_all")).cast("long")).withColumn("_part", F.col("_q") - F.col("_whole") * F.col("_all"))
    left = F.col("_rest") - F.sum("_whole").over(every)
    f = f.withColumn("_left", left).withColumn("_turn", F.row_number().over(Window.orderBy(F.desc("_part"), by)))
    return f.select(by, "size", (F.col("_f") + F.col("_whole") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("take"))


def stratified(rows: DataFrame, by: str, key: str, total: int = 400, floor: int = 50) -> DataFrame:
    """A sample of `total` rows with at least `floor` of each group where it has them; rows in hash order within groups.

    Only group sizes, a row a group, are windowed as a whole; a group never sends more than `total` rows.
    """
    sized = rows.where(F.col(by).isNotNull())
    take = allocation(sized.groupBy(by).agg(F.count(F.lit(1)).alias("size")), by, total, floor).select(by, "take")
    first = best_of(sized.withColumn("_h", hash_order(F.col(key).cast("string"))), by, total, F.col("_h"), F.col(key))
    return first.join(take, by).where("rank <= take").drop("_h", "take", "rank")


def holdout_pool(rows: DataFrame, least_words: int = 20) -> DataFrame:
    """Records (text, word_count, question_count) that may stand for a source in a hold-out: long enough, a question and another sentence."""
    marks = F.coalesce(count_of(F.col("text"), ".!"), F.lit(0))
    return rows.where((F.coalesce("word_count", F.lit(0)) >= least_words) & (F.coalesce("question_count", F.lit(0)) >= 1) & (marks >= 1))


def rounds(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """The first `most` rows taking one of each group in turn, groups in order of names; adds `pick` from 1.

    When a group runs dry the others go on; within a round the order is by name.
    """
    head = best_of(rows.where(F.col(by).isNotNull()).withColumn("_h", hash_order(F.col(key).cast("string"))), by, most, F.col("_h"), F.col(key))
    first = head.orderBy("rank", by, key).limit(most)
    return first.withColumn("pick", F.row_number().over(Window.orderBy("rank", by, key))).drop("_h", "rank")


def capped_selection(candidates: DataFrame, target: int = 3000, caps: dict[str, int] | None = None, free: int = 200, share: float = 0.40) -> DataFrame:
    """(record_id, source, type, pick): one of each source in turn by score; after `free` picks a type may not pass `share`.

    A source's turn takes its next row, in the order of score and id, whose type may be taken; the rows before it are used up.
    So a turn only asks where the next row of each type stands. Rows get their places once, written; a lookup loads for each
    source and type the next AHEAD places after the last row used, and holds for all turns until one of these lists runs out
    while the table has more. That is one lookup for each AHEAD rows of a type, and at most one a pick, however many rows are
    skipped; no task and no driver ever holds more than AHEAD rows of a source and type. Types are few (a fixed set of names); a null one counts as empty. Null ids are left out.
    """
    caps = caps or {"kurmanji_news": 1800, "kurdish_ai_corpus": 1500, "tatoeba": 200}
    some = candidates.where(F.col("source").isin(list(caps)) & F.col("record_id").isNotNull()).select("record_id", "source", F.coalesce("type", F.lit("")).alias("type"), "score")
    rows = materialise(ranked(some, "source", F.desc("score"), "record_id").select("record_id", "source", "type", "rank"), "places")
    used, taken, types, picks = dict.fromkeys(caps, 0), dict.fromkeys(caps, 0), Counter(), []

    def look() -> dict[str, dict[str, list]]:
        after = reduce(lambda c, s: c.when(F.col("source") == s, F.lit(used[s])), caps, F.when(F.lit(False), F.lit(0)))
        ahead = Window.partitionBy("source", "type").orderBy("place")
        found: dict[str, dict[str, list]] = {s: {} for s in caps}
        got = rows.withColumnRenamed("rank", "place").where(F.col("place") > after).withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= AHEAD)
        for r in sorted(got.select("source", "type", "place", "record_id").collect()):
            found[r["source"]].setdefault(r["type"], []).append((r["place"], r["record_id"]))
        return found

    def may(kind: str) -> bool:
        return len(picks) < free or (types[kind] + 1) / (len(picks) + 1) <= share

    lists = look()
    waiting = deque(s for s in caps if caps[s] > 0)
    idle = 0
    while waiting and len(picks) < target and idle < len(waiting):
        source = waiting[0]
        nexts = {}
        stale = False
        for kind, places in lists[source].items():
            if may(kind):
                at = bisect_right(places, used[source], key=lambda p: p[0])
                if at < len(places):
                    nexts[places[at][0]] = (kind, places[at][1])
                stale |= at >= len(places) >= AHEAD  # there may be more of this type
        if stale:
            lists = look()
            continue
        waiting.rotate(-1)
        if not nexts:
            # All that is left is of types that may not be taken now: the turn uses it up.
            used[source] = sys.maxsize
            idle += 1
            continue
        idle = 0
        place = min(nexts)
        kind, record = nexts[place]
        used[source] = place
        types[kind] += 1
        taken[source] += 1
        picks.append((record, source, kind, len(picks) + 1))
        if taken[source] >= caps[source]:
            waiting.remove(source)
    return candidates.sparkSession.createDataFrame(picks, "record_id string, source string, type string, pick long")


def with_fillers(short: DataFrame, pool: list[str], key: str, seed: int = SEED) -> DataFrame:
    """Short texts between two fillers of a pool, drawn by a hash of the key; adds `constructed`. An empty pool changes nothing."""
    if not pool:
        return short.withColumn("constructed", F.lit(False))
    bank = F.array(*map(F.lit, pool))
    draw = lambda side: F.get(bank, F.floor(uniform(seed, F.lit(side), F.col(key)) * len(pool)).cast("int"))
    return short.withColumn("text", F.concat_ws(" ", draw("before"), "text", draw("after"))).withColumn("constructed", F.lit(True))


def joined_until(rows: DataFrame, words: str, least: int, key: str) -> DataFrame:
    """(parts, words, text): texts in hash order joined until they have `least` words."""
    kept = until_sum(rows, words, least, key).withColumn("_h", hash_order(F.col(key).cast("string")))
    return kept.agg(F.count(F.lit(1)).alias("parts"), F.sum(words).alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_h", key, "text"))), lambda x: x["text"]), "\n\n").alias("text"))
