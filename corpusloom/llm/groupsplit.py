"""Problem 5: splits that keep related records together.

Method: iterative minimum-label propagation over the bipartite graph of records and source documents, then a stratified
assignment of the groups to splits that minimises the deviation of the label distributions.

* A source document is named by an address (the page it leads to, whatever the spelling) or by a number or shard position
  within a source. A record with one document takes that document's group; only records with several documents join
  groups, so only their edges are propagated. Labels hook and jump, so long chains take few rounds.
* A group counts with its size (records and windows), its windows with and without a question, its labels by kind, and its
  source. Groups are placed one by one, large ones first, each in the split where the weighted squared deviation of all these
  counts from their targets, over the targets, grows least. Groups of more than BIG of all counts (at most 1 / BIG of them)
  are placed first, on the driver; all others in buckets of about BUCKET_UNITS groups by hash, each towards its share of
  what is left, so that the buckets' number grows with the groups and no stratum is one task.

Defined results: a record without a document is a group of its own; null record ids are left out; repeated rows count once
as edges, repeated windows once; an article that is no accepted record is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, to_nfc
from ..plans.storage import materialise
from .neardup import pairs_within
from .truncation import source_name

BIG = 0.0005
BUCKET_UNITS = 20_000
# Parameters that follow a reader and never select a page; such that do so only if they name a place in letters
# (`ref=rss`, but not `ref=17`); host prefixes of the same page.
TRACKING = "(?i)^(?:(?:utm_[^=]*|fbclid|gclid|dclid|msclkid|yclid|igshid|mc_[ce]id|ref_src|ref_url|referrer|spm|cmpid|_ga|_gl)(?:=.*)?|(?:ref|source|share)(?:=[a-z._-]*)?)$"
SEP = "\x1f"
PREFIX = r"^(?:(?:www\d?|m|mobile|amp)\.)+(?=[^.]+\.)"
# The labels of windows; all others count as one kind.
LABELS = ("O", "COMMA", "PERIOD", "QUESTION", "EXCLAMATION")
COUNTS = ("size", "asking", "plain", *(f"n_{x.lower()}" for x in LABELS), "n_other")
# How much each count matters: sizes most, then questions; the kinds of labels share a weight; sources have one of their own.
WEIGHTS = np.array([4.0, 1.0, 1.0, *[1 / (len(LABELS) + 1)] * (len(LABELS) + 1)])
SOURCE_WEIGHT = 1.0


def _unquoted(c: Column) -> Column:
    """Percent-encoding undone; percent signs that encode nothing stay."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def document_name(source: Column, text: Column) -> Column:
    """The document that (source, source_document_id) names; null if it names none.

    Addresses are told by `//` after an optional scheme, or by a host name before a slash. Scheme, user, default port, letter
    case of the host, www and the like, fragment, closing slashes, percent-encoding, order of parameters and those of
    TRACKING don't tell pages apart; all other parameters do.
    """
    t = strip(to_nfc(text))
    is_address = t.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//") | t.rlike(r"(?iu)^(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?/")
    rest = F.regexp_replace(F.regexp_replace(t, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", ""), "(?s)#.*$", "")
    authority, path, query = (F.regexp_extract(rest, r"(?s)^([^/?]*)([^?]*)(?:\?(.*))?$", i) for i in (1, 2, 3))
    authority = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    host = F.regexp_replace(F.lower(to_nfc(_unquoted(F.regexp_replace(authority, r":\d*$", "")))), r"\.+$", "")
    host = F.concat(F.regexp_replace(host, PREFIX, ""), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    asked = F.transform(F.split(query, "&"), lambda p: _unquoted(F.replace(p, F.lit("+"), F.lit("%20"))))
    asked = to_nfc(F.array_join(F.sort_array(F.filter(asked, lambda p: (p != "") & ~p.rlike(TRACKING))), SEP))
    page = F.concat(F.lit("page "), host, F.regexp_replace(to_nfc(_unquoted(path)), "/+$", ""), F.when(asked == "", "").otherwise(F.concat(F.lit("?" + SEP), asked)))
    digits = F.translate(t, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    number = F.when(digits.rlike(r"^[+]?[0-9]+(?:\.0+)?$"), F.regexp_replace(F.regexp_replace(digits, r"\.0+$", ""), "^[+]?0*(?=[0-9])", "")).otherwise(t)
    return F.when(t.isNull() | (t == ""), F.lit(None)).when(is_address, page).otherwise(F.concat(F.lit("place "), source, F.lit(" "), number))


def record_documents(accepted: DataFrame) -> DataFrame:
    """Distinct (record_id, document); the document is null where none is named."""
    rows = accepted.where("record_id is not null").select("record_id", source_name(F.col("source")).alias("source"), F.col("source_document_id").alias("doc"))
    return rows.select("record_id", document_name(F.col("source"), F.col("doc")).alias("document")).distinct()


def propagate(edges: DataFrame) -> DataFrame:
    """(document, label): the least document of each component of (record_id, document) edges."""
    labels = materialise(edges.select("document", F.col("document").alias("label")).distinct(), "labels")
    while True:
        at = edges.join(labels, "document")
        least = at.groupBy("record_id").agg(F.min("label").alias("least"))
        offer = at.join(least, "record_id").where("least < label")
        # What a document hears goes to itself and to the document it points at.
        heard = offer.select("document", "least").union(offer.select(F.col("label").alias("document"), "least")).groupBy("document").agg(F.min("least").alias("least"))
        hooked = labels.join(heard, "document", "left").select("document", F.coalesce(F.least("label", "least"), "label").alias("to"), F.col("least").isNotNull().alias("moved"))
        hooked = materialise(hooked, "hooked")
        if not hooked.where("moved").head(1):
            return labels
        onward = hooked.select(F.col("document").alias("to"), F.col("to").alias("further"))
        labels = materialise(hooked.join(onward, "to", "left").select("document", F.least("to", F.coalesce("further", "to")).alias("label")), "labels")


def groups(accepted: DataFrame) -> DataFrame:
    """(record_id, grp): one row for each record; records of one group must share a split."""
    edges = materialise(record_documents(accepted), "edges")
    named = edges.where("document is not null")
    several = named.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_id")
    labels = propagate(materialise(named.join(several, "record_id", "left_semi"), "bridges"))
    own = edges.groupBy("record_id").agg(F.min("document").alias("document"))
    return own.join(labels, "document", "left").select("record_id", F.coalesce("label", "document", F.concat(F.lit("record "), "record_id")).alias("grp"))


def found(accepted: DataFrame) -> DataFrame:
    """(article_id_a, article_id_b): all pairs of different records of one group, smaller first."""
    g = materialise(groups(accepted), "groups")
    return pairs_within(g, "grp", "record_id").select(F.col("x").alias("article_id_a"), F.col("y").alias("article_id_b"))


def place(counts: np.ndarray, sources: np.ndarray, targets: np.ndarray, source_targets: np.ndarray) -> np.ndarray:
    """The split of each group, in the order given: where the deviation from the targets grows least, the first of equals.

    counts: groups x COUNTS. sources: a number for each group. targets: splits x COUNTS. source_targets: splits x sources.
    """
    whole, whole_s = np.maximum(targets.sum(axis=0), 1e-9), np.maximum(source_targets.sum(axis=0), 1e-9)
    weight = WEIGHTS / (np.maximum(targets, 1e-6 * whole) * whole)
    weight_s = SOURCE_WEIGHT / (np.maximum(source_targets, 1e-6 * whole_s) * whole_s)
    off, off_s = -targets.astype(float), -source_targets.astype(float)
    out = np.zeros(len(counts), np.int64)
    for g in range(len(counts)):
        v, k = counts[g], sources[g]
        cost = (weight * v * (2 * off + v)).sum(axis=1) + weight_s[:, k] * v[0] * (2 * off_s[:, k] + v[0])
        out[g] = s = int(cost.argmin())
        off[s] += v
        off_s[s, k] += v[0]
    return out


def _matrix(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, counts, source numbers, counts by source) of groups, large ones first."""
    pdf = pdf.sort_values(["size", "h", "grp"], ascending=[False, True, True], kind="stable")
    counts = pdf[list(COUNTS)].to_numpy(float)
    number, _ = pd.factorize(pdf["source"].fillna(""), sort=True)
    return pdf, counts, number, np.bincount(number, weights=counts[:, 0])


def _placed(names: list[str], left: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """left: splits x COUNTS, the part of each count that a split should still get."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, counts, number, by_source = _matrix(pdf)
        chosen = place(counts, number, left * counts.sum(axis=0), left[:, :1] * by_source)
        return pd.DataFrame({"grp": pdf["grp"].to_numpy(), "split": [names[i] for i in chosen]})

    return run


def _equals(x: str) -> Callable[[Column], Column]:
    return lambda y: y == x


def article_counts(windows: DataFrame) -> DataFrame:
    """(article_id, wsource, windows, asking, plain, n_...): what the windows of each article hold, each window once."""
    n = {f"n_{x.lower()}": F.coalesce(F.size(F.filter("labels", _equals(x))), F.lit(0)) for x in LABELS}
    other = F.coalesce(F.size(F.filter("labels", lambda y: ~y.isin(*LABELS))), F.lit(0))
    rows = windows.where("article_id is not null").select("article_id", "id", source_name(F.col("source")).alias("source"), F.coalesce("has_question", F.lit(False)).cast("int").alias("asks"), *(c.alias(k) for k, c in n.items()), other.alias("n_other"))
    one = rows.groupBy("article_id", "id").agg(F.min("source").alias("source"), *(F.max(c).alias(c) for c in ("asks", *n, "n_other")))
    total = [F.sum(c).alias(c) for c in (*n, "n_other")]
    return one.groupBy("article_id").agg(F.min("source").alias("wsource"), F.count(F.lit(1)).alias("windows"), F.sum("asks").alias("asking"), F.sum(1 - F.col("asks")).alias("plain"), *total)


def assigned(accepted: DataFrame, windows: DataFrame, targets: DataFrame) -> DataFrame:
    """(article_id, grp, split, source, records, windows, and COUNTS): a split for each accepted record and each article with windows.

    targets: split, share (a few rows). Without any target the split is null.
    """
    g = groups(accepted)
    per_record = accepted.where("record_id is not null").groupBy(F.col("record_id").alias("article_id")).agg(F.min(source_name(F.col("source"))).alias("source"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", *COUNTS[1:])]
    members = (
        per_record.join(article_counts(windows), "article_id", "full")
        .join(g.withColumnRenamed("record_id", "article_id"), "article_id", "left")
        .select("article_id", F.coalesce("grp", F.concat(F.lit("article "), "article_id")).alias("grp"), F.coalesce("source", "wsource").alias("source"), F.col("source").isNotNull().cast("long").alias("records"), *zero)
        .withColumn("size", F.col("records") + F.col("windows"))
    )
    members = materialise(members, "members")
    shares = [(r["split"], float(r["share"])) for r in targets.where("split is not null and share > 0").groupBy("split").agg(F.max("share").alias("share")).orderBy(F.desc("share"), "split").collect()]
    if not shares:
        return members.withColumn("split", F.lit(None).cast("string"))
    names, share = [x for x, _ in shares], np.array([x for _, x in shares])
    share = share / share.sum()
    units = members.groupBy("grp").agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("source").alias("source"))
    units = materialise(units.withColumn("h", F.xxhash64("grp")), "units")
    whole = units.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).head()
    total = np.array([float(whole[c]) for c in COUNTS])
    limit = max(1.0, BIG * total[0])
    big = pd.DataFrame([r.asDict() for r in units.where(F.col("size") > limit).collect()], columns=["grp", *COUNTS, "source", "h"])  # at most 1 / BIG rows
    big, counts, number, by_source = _matrix(big)
    chosen = place(counts, number, share[:, None] * total, share[:, None] * by_source)
    taken = np.zeros((len(names), len(COUNTS)))
    np.add.at(taken, chosen, counts)
    left = np.maximum(share[:, None] * total - taken, 0)
    left = np.where(left.sum(axis=0) > 0, left, share[:, None])
    left = left / left.sum(axis=0)
    fixed = accepted.sparkSession.createDataFrame([(x, names[i]) for x, i in zip(big["grp"], chosen)], "grp string, split string")
    buckets = max(1, -(-int(whole["n"]) // BUCKET_UNITS))
    small = units.where(F.col("size") <= limit).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    rest = small.groupBy("bucket").applyInPandas(_placed(names, left), "grp string, split string")
    return members.join(rest.unionByName(fixed), "grp")


def split(accepted: DataFrame, windows: DataFrame, targets: DataFrame) -> DataFrame:
    """(article_id, grp, split, records, windows): a split for each accepted record and each article with windows."""
    return assigned(accepted, windows, targets).select("article_id", "grp", "split", "records", "windows")


def reached(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target, records, windows, share, source_deviation, question_deviation, label_deviation) of assigned rows.

    share is of records and windows together. A deviation is half the sum of differences between the split's shares and
    those of all rows: of sources, of windows with a question, of kinds of labels; null where the split has none.
    """
    counts = ("records", "windows", *COUNTS)
    got = rows.groupBy("split").agg(*(F.sum(c).alias(c) for c in counts))
    whole = got.agg(*(F.sum(c).alias(f"all_{c}") for c in counts))
    kinds = [c for c in COUNTS if c.startswith("n_")]

    def apart(names: list[str]) -> Column:
        mine, every = (sum((F.col(f"{p}{c}") for c in names), F.lit(0)) for p in ("", "all_"))
        return F.round(sum((F.abs(F.try_divide(F.col(c), mine) - F.try_divide(F.col(f"all_{c}"), every)) for c in names), F.lit(0.0)) / 2, 6)

    source = rows.groupBy(F.coalesce("source", F.lit("")).alias("source"), "split").agg(F.sum("size").alias("n"))
    frame = got.select("split", F.col("size").alias("mine")).crossJoin(F.broadcast(whole.select(F.col("all_size").alias("every"))))
    both = source.join(source.groupBy("source").agg(F.sum("n").alias("of_source")), "source").join(F.broadcast(frame), "split")
    # Sources that a split lacks count with their whole share.
    there = both.groupBy("split").agg(F.sum(F.abs(F.try_divide(F.col("n"), "mine") - F.try_divide(F.col("of_source"), "every"))).alias("d"), F.sum(F.try_divide(F.col("of_source"), "every")).alias("seen"))
    there = there.select("split", F.round((F.col("d") + 1 - F.col("seen")) / 2, 6).alias("source_deviation"))
    t = targets.where("split is not null").groupBy("split").agg(F.max("share").alias("target"))
    out = t.join(got, "split", "full").join(there, "split", "left").crossJoin(F.broadcast(whole))
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "split", "target", n("records").alias("records"), n("windows").alias("windows"), F.round(F.try_divide(n("size"), F.col("all_size")), 6).alias("share"),
        "source_deviation", apart(["asking", "plain"]).alias("question_deviation"), apart(kinds).alias("label_deviation"),
    )
