"""Metrics of labelled sequences, all from one count of (slice, true, predicted), and threshold sweeps from histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCT = ["O", "COMMA", "PERIOD", "QUESTION", "EXCLAMATION"]
BOUNDARY = ["PERIOD", "QUESTION", "EXCLAMATION"]
CASE = ["KEEP", "TITLE", "UPPER"]


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """(by..., true, pred, n) of rows (by..., true, pred); nulls on either side are left out."""
    return pairs.where(F.col("true").isNotNull() & F.col("pred").isNotNull()).groupBy(*by, "true", "pred").agg(F.count(F.lit(1)).alias("n"))


def _f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def per_label(cube: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """(by..., label, precision, recall, f1, support), each label listed for each slice."""
    cells = cube.withColumn("label", F.explode(F.array_distinct(F.array("true", "pred"))))
    hit, t, p = (F.col("true") == F.col("pred")), F.col("true") == F.col("label"), F.col("pred") == F.col("label")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = cells.groupBy(*by, "label").agg(total(hit).alias("tp"), total(p & ~hit).alias("fp"), total(t & ~hit).alias("fn"))
    names = F.explode(F.array(*map(F.lit, labels))).alias("label")
    frame = cube.select(*by).distinct().select(*by, names) if by else cube.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    full = frame.join(sums, [*by, "label"], "left").fillna(0, ["tp", "fp", "fn"])
    pr, rc, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return full.select(*by, "label", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn")


def summary(cube: DataFrame, labels: list[str], scored: list[str], boundary: list[str] | None = None, *by: str) -> DataFrame:
    """(by..., tokens, accuracy, macro_f1, micro_f1, weighted_f1[, boundary_f1]): macro and micro over `scored`."""
    lab = per_label(cube, labels, *by)
    _, _, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    on = F.col("label").isin(scored)
    pick = lambda c: F.sum(F.when(on, F.col(c)).otherwise(0))
    micro = _f1(pick("tp"), pick("fp"), pick("fn"))[2]
    agg = [
        F.sum("support").alias("tokens"), F.round(F.sum("tp") / F.greatest(F.lit(1), F.sum("support")), 6).alias("accuracy"), F.round(F.sum(F.when(on, f1).otherwise(0.0)) / len(scored), 6).alias("macro_f1"),
        F.round(micro, 6).alias("micro_f1"), F.round(F.coalesce(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias("weighted_f1"),
    ]
    out = lab.groupBy(*by).agg(*agg)
    if boundary is None:
        return out
    t, p = F.col("true").isin(boundary), F.col("pred").isin(boundary)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    edge = cube.groupBy(*by).agg(F.round(_f1(total(t & p), total(~t & p), total(t & ~p))[2], 6).alias("boundary_f1"))
    return out.join(edge, list(by)) if by else out.crossJoin(edge)


def transitions(cube: DataFrame) -> DataFrame:
    """(transition, n) of errors, `true -> pred`."""
    return cube.where(F.col("true") != F.col("pred")).groupBy(F.concat_ws(" -> ", "true", "pred").alias("transition")).agg(F.sum("n").alias("n"))


def skip_reason(tokens: Column, labels: Column, pred: Column | None = None, least: int = 3) -> Column:
    """Why an evaluation leaves a text out, or null: no_gold, few_tokens, or length_mismatch of labels or predictions."""
    n = F.coalesce(F.size(tokens), F.lit(0))
    other = ~n.eqNullSafe(F.size(labels)) if pred is None else ~n.eqNullSafe(F.size(labels)) | ~n.eqNullSafe(F.size(pred))
    return F.when((n == 0) | labels.isNull(), "no_gold").when(n < least, "few_tokens").when(other, "length_mismatch")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    """array<double>: exponentials over their sum, shifted by the largest; each exponential is computed once."""
    z = F.transform(logits, lambda x: x.cast("double"))
    shifted = lambda v: bound(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda s: F.transform(e, lambda x: x / s))
    return bound(z, lambda v: bound(shifted(v), shares))


def argmax(values: Column) -> Column:
    """The place of the largest value, from 1; the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int")


def decode_marks(probs: Column, floors: dict[str, float]) -> Column:
    """struct(label, confidence): the likeliest label; below its floor it becomes O with the chance of O."""
    k = argmax(probs)
    label, conf = F.get(F.array(*map(F.lit, PUNCT)), k - 1), F.array_max(probs)
    low = F.lit(False)
    for name, floor in floors.items():
        low = low | ((label == name) & (conf < floor))
    return F.struct(F.when(low, "O").otherwise(label).alias("label"), F.when(low, F.get(probs, F.lit(0))).otherwise(conf).alias("confidence"))


def decode_case(probs: Column, protected: Column, start: Column, title: float = 0.8, upper: float = 0.85) -> Column:
    """struct(label, confidence): protected tokens stay; a sentence start may only become UPPER; else each needs its floor."""
    k, conf = argmax(probs), F.array_max(probs)
    up = (k == 3) & (conf >= upper)
    ti = (k == 2) & (conf >= title) & ~start
    label = F.when(protected, "KEEP").when(up, "UPPER").when(ti, "TITLE").otherwise("KEEP")
    return F.struct(label.alias("label"), F.when(protected, 1.0).when(up | ti, conf).otherwise(F.get(probs, F.lit(0))).alias("confidence"))


def histogram(rows: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """(by..., gold, arg, bucket, n): bucket counts the grid values that the confidence reaches. All that a sweep needs."""
    reach = sum((F.when(F.col("conf") >= F.lit(g), 1).otherwise(0) for g in grid), F.lit(0))
    return rows.where("gold is not null and arg is not null").groupBy(*by, "gold", "arg", reach.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sweep(rows: DataFrame, labels: list[str], grid: list[float], fallback: str) -> DataFrame:
    """(label, threshold, precision, recall, f1, best): each label's threshold alone; the first best of a label is marked.

    rows: gold, arg (the likeliest label), conf. A label below its threshold becomes `fallback`, so no other label's
    counts change and the sweep of a label needs its own histogram only.
    """
    hist = histogram(rows, grid)
    k = rows.sparkSession.createDataFrame([(i + 1, float(g)) for i, g in enumerate(grid)], "k int, threshold double")
    lab = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    both = hist.crossJoin(F.broadcast(lab.crossJoin(k)))
    on = (F.col("arg") == F.col("label")) & (F.col("bucket") >= F.col("k"))
    gold = F.col("gold") == F.col("label")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = both.groupBy("label", "threshold").agg(total(on & gold).alias("tp"), total(on & ~gold).alias("fp"), total(~on & gold).alias("fn"))
    p, r, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    out = sums.select("label", "threshold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("f1"), "threshold"))
    return out.withColumn("best", first == 1)


def sweep_pair(rows: DataFrame, title_grid: list[float], upper_grid: list[float]) -> DataFrame:
    """(title, upper, macro_f1, title_precision, title_recall, title_f1, upper_f1, best) over a grid of two floors.

    best marks one point: first those with a title precision of 0.90 and recall of 0.85, then by title precision, macro F1, title
    recall, and the lower floors of equals.

    rows: gold, arg, conf, protected, start. Decoding depends on arg, conf and two flags, so a histogram is enough.
    """
    flags = rows.withColumn("start", F.coalesce("start", F.lit(False))).withColumn("protected", F.coalesce("protected", F.lit(False)))
    grid = sorted({*title_grid, *upper_grid})
    hist = histogram(flags, grid, "protected", "start")
    place = {g: i + 1 for i, g in enumerate(grid)}
    spark = rows.sparkSession
    points = spark.createDataFrame([(float(t), place[t], float(u), place[u]) for t in title_grid for u in upper_grid], "title double, tk int, upper double, uk int")
    both = hist.crossJoin(F.broadcast(points))
    pred = F.when(F.col("protected"), "KEEP").when((F.col("arg") == "UPPER") & (F.col("bucket") >= F.col("uk")), "UPPER").when((F.col("arg") == "TITLE") & ~F.col("start") & (F.col("bucket") >= F.col("tk")), "TITLE").otherwise("KEEP")
    both = both.withColumn("pred", pred)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    aggs = []
    for x in ("TITLE", "UPPER"):
        g, p = F.col("gold") == x, F.col("pred") == x
        aggs += [total(g & p).alias(f"{x}_tp"), total(~g & p).alias(f"{x}_fp"), total(g & ~p).alias(f"{x}_fn")]
    s = both.groupBy("title", "upper").agg(*aggs)
    t, u = (_f1(F.col(f"{x}_tp"), F.col(f"{x}_fp"), F.col(f"{x}_fn")) for x in ("TITLE", "UPPER"))
    out = s.select("title", "upper", F.round((t[2] + u[2]) / 2, 6).alias("macro_f1"), F.round(t[0], 6).alias("title_precision"), F.round(t[1], 6).alias("title_recall"), F.round(t[2], 6).alias("title_f1"), F.round(u[2], 6).alias("upper_f1"))
    met = (F.col("title_precision") >= 0.90) & (F.col("title_recall") >= 0.85)
    order = Window.orderBy(met.desc(), F.desc("title_precision"), F.desc("macro_f1"), F.desc("title_recall"), "title", "upper")  # a row a grid point
    return out.withColumn("best", F.row_number().over(order) == 1)


def error_contexts(rows: DataFrame, label: str = "QUESTION", reach: int = 20) -> DataFrame:
    """(id, source, token_index, context, gold, predicted, error_type): the errors of a label, with the tokens around each.

    rows: id, source, tokens, labels, pred (arrays). Places beyond the shortest of the three arrays, and nulls, are no errors.
    """
    at = F.posexplode(F.arrays_zip("tokens", "labels", "pred")).alias("i", "x")
    wrong = rows.select("id", "source", "tokens", at).where("x.tokens is not null and x.labels is not null and x.pred is not null and x.labels <> x.pred").where((F.col("x.labels") == label) | (F.col("x.pred") == label))
    left = F.array_join(F.slice("tokens", F.greatest(F.lit(1), F.col("i") + 1 - reach), F.least(F.lit(reach), F.col("i"))), " ")
    right = F.array_join(F.slice("tokens", F.col("i") + 2, F.lit(reach)), " ")
    context = F.concat(left, F.lit(" ["), F.col("x.tokens"), F.lit("] "), right)
    return wrong.select("id", "source", F.col("i").alias("token_index"), context.alias("context"), F.col("x.labels").alias("gold"), F.col("x.pred").alias("predicted"), F.concat("x.labels", F.lit("_TO_"), "x.pred").alias("error_type"))
