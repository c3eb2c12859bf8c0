"""Problem 6: a mixture in which each source has its target share of all words.

Method: entropy balancing. The rates r of the records stay as near as possible (in relative entropy) to one copy each,
subject to each source's words being its target; the solution is a rate exponentially tilted by the record's words,
min(max_repeats, exp(tilt * words)): a source that must shrink gives up its long records first, one that must grow repeats
them first, because they meet the constraint at the least change of rates. Newton iterations solve the convex dual; each is
one distributed aggregate over the histogram (source, words), which holds all records, and returns a row a source. Rates
become whole copies by a running sum over each source in the order of words, so a source's words are right to one record.

The total is the largest at which every source with records can reach its share within max_repeats. Shares of targets
without records can't be reached; the others keep their proportions.

Defined results: rows delivered again count once (the latest landed_at); word_count is kept where it is the number of words
of the text and counted from the text otherwise; records without words get no copies; sources without target get none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .truncation import source_name

BUCKETS, BUCKET_ROWS = 64, 200_000
# Fixed value: white space of the Unicode standard.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def count_words(text: Column) -> Column:
    """The number of runs of characters between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def countable(records: DataFrame) -> DataFrame:
    """(record_id, source, words): one row for each record, the latest, with its right number of words."""
    rows = records.where("record_id is not null").select("record_id", source_name(F.col("source")).alias("source"), "word_count", count_words(F.col("text")).alias("counted"), "landed_at")
    newest = rows.groupBy("record_id").agg(F.max(F.struct("landed_at", "source", "counted", "word_count")).alias("r"))
    words = F.when(F.col("r.word_count") == F.col("r.counted"), F.col("r.word_count")).otherwise(F.col("r.counted"))
    return newest.select("record_id", "r.source", words.cast("long").alias("words"))


def _newton(hist: DataFrame, want: dict[str, tuple[float, float, float]], tolerance: float = 1e-9, most: int = 80) -> dict[str, float]:
    """source -> tilt of the rate min(cap, exp(tilt * words / mean)); want: source -> (words, cap, mean).

    The dual of a source is convex in its one multiplier; its slope is the words at the tilt less the words wanted, which
    grows with the tilt. A step that would leave the interval in which the slope changes sign halves the interval instead.
    """
    at = dict.fromkeys(want, -0.01)
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    open_ = set(want)
    spark = hist.sparkSession
    for _ in range(most):
        if not open_:
            break
        par = spark.createDataFrame([(s, at[s], float(want[s][1]), float(want[s][2])) for s in sorted(open_)], "source string, tilt double, cap double, mean double")
        z = F.col("words") / F.col("mean")
        free = F.col("tilt") * z < F.log("cap")
        rate = F.when(free, F.exp(F.col("tilt") * z)).otherwise(F.col("cap"))
        rows = hist.join(F.broadcast(par), "source").groupBy("source").agg(F.sum(rate * F.col("n") * z).alias("value"), F.sum(F.when(free, rate * F.col("n") * z * z).otherwise(0.0)).alias("slope")).collect()
        for r in rows:
            s = r["source"]
            goal = want[s][0] / want[s][2]
            gap = r["value"] - goal
            if abs(gap) <= tolerance * goal:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = at[s]
            step = at[s] - gap / r["slope"] if r["slope"] > 0 else None
            inside = step is not None and low.get(s, -math.inf) < step < high.get(s, math.inf)
            if not inside and s in low and s in high:
                step = (low[s] + high[s]) / 2
            elif not inside:  # no end of the interval on that side yet
                step = at[s] - max(1.0, 2 * abs(at[s])) * (1 if gap > 0 else -1)
            if step == at[s] or (s in low and s in high and high[s] - low[s] <= 1e-14 * max(1.0, abs(step))):
                open_.discard(s)
            at[s] = step
    return at


def mixture(records: DataFrame, targets: DataFrame, total_words: float | None = None) -> DataFrame:
    """(record_id, source, words, copies): the records of the mixture, copies at least 1.

    records: record_id, source, text, word_count, landed_at. targets: source, target_share, max_repeats (a few rows).
    """
    spark = records.sparkSession
    words = materialise(countable(records).where("words > 0"), "words")
    hist = materialise(words.groupBy("source", "words").agg(F.count(F.lit(1)).alias("n")), "histogram")
    goal = {
        r["source"]: (float(r["share"]), int(r["cap"]))
        for r in targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("share > 0 and cap >= 1").collect()
    }
    have = {r["source"]: (int(r["w"]), int(r["n"])) for r in hist.where(F.col("source").isin(list(goal))).groupBy("source").agg(F.sum(F.col("words") * F.col("n")).alias("w"), F.sum("n").alias("n")).collect()}
    form = "record_id string, source string, words long, copies long"
    if not have:
        return spark.createDataFrame([], form)
    whole = sum(goal[s][0] for s in have)
    total = min(goal[s][1] * have[s][0] / (goal[s][0] / whole) for s in have)
    if total_words is not None:
        total = min(total, float(total_words))
    want = {s: (goal[s][0] / whole * total, float(goal[s][1]), have[s][0] / have[s][1]) for s in have}
    # A source that must be used to its cap has no inner solution: its rate is the cap, which any large tilt gives.
    inner = {s: x for s, x in want.items() if x[0] < x[1] * have[s][0] * (1 - 1e-12)}
    tilt = dict.fromkeys(want, 1e9) | _newton(hist, inner)
    rates = spark.createDataFrame([(s, tilt[s], *want[s][1:]) for s in want], "source string, tilt double, cap double, mean double")
    lift = F.col("tilt") * F.col("words") / F.col("mean")
    rate = F.when(lift < F.log("cap"), F.exp(lift)).otherwise(F.col("cap"))
    # The running sum of rates in the order (words, bucket, hash): cells by a sum over counts, records by a rank in their cell.
    buckets = max(BUCKETS, sum(n for _, n in have.values()) // BUCKET_ROWS)
    placed = words.withColumn("h", F.xxhash64("record_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    cells = placed.groupBy("source", "words", "bucket").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rates), "source").withColumn("rate", rate)
    order = Window.partitionBy("source").orderBy("words", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "words", "bucket", "rate", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(order), F.lit(0.0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "words", "bucket").orderBy("h", "record_id"))
    at = placed.withColumn("rank", rank).join(cells, ["source", "words", "bucket"])
    upto = F.col("before") + F.col("rank") * F.col("rate")
    eps = F.lit(0.5 + 1e-7)
    copies = (F.floor(upto + eps) - F.floor(upto - F.col("rate") + eps)).cast("long")
    return at.select("record_id", "source", "words", copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, records, copies, words, share, most_copies) of a mixture, for every target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("words")).alias("words"), F.max("copies").alias("most_copies"))
    all_of = got.agg(F.sum("words").alias("total"))
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records", "copies", "words", "most_copies")}
    return t.join(got, "source", "left").crossJoin(F.broadcast(all_of)).withColumns(zero).select(
        "source", "target_share", "max_repeats", "records", "copies", "words", F.round(F.col("words") / F.col("total"), 6).alias("share"), "most_copies"
    )
