"""Leakage of hold-out records into training: keys, word spans, signatures; and the joins around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minhash
from ..functions import text as X
from ..functions.tokens import spans

SPANS = (12, 16, 20)
KEYS = {"exact": lambda t: X.exact_key(t, False), "lower": X.lower_key, "nopunct": lambda t: X.nopunct_key(t, False)}


def key_hits(train: DataFrame, refs: DataFrame, kind: str = "exact") -> DataFrame:
    """(id, ref_id): training rows (id, text) whose key some reference (id, text) has; the last reference of a key is named.

    References are one row a key before the join, so hot keys on their side cost nothing; blank keys count like others.
    """
    key = KEYS[kind]
    r = refs.where("text is not null").groupBy(X.sha256(key(F.col("text"))).alias("k")).agg(F.max("id").alias("ref_id"))
    return train.where("text is not null").select("id", X.sha256(key(F.col("text"))).alias("k")).join(r, "k").select("id", "ref_id")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of the composed text."""
    return F.regexp_extract_all(F.lower(X.to_nfc(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def span_rows(rows: DataFrame, sizes: tuple[int, ...] = SPANS, stride: int | None = None) -> DataFrame:
    """Distinct (id, span): hashes of the word spans of each row."""
    w = rows.where("text is not null").select("id", words(F.col("text")).alias("w"))
    return w.select("id", F.explode(F.array_distinct(F.concat(*(spans(F.col("w"), n, stride) for n in sizes)))).alias("s")).select("id", F.md5("s").alias("span")).distinct()


def span_hits(train: DataFrame, refs: DataFrame, sizes: tuple[int, ...] = SPANS, train_stride: int | None = None) -> DataFrame:
    """Distinct training ids that share a word span with a reference; both sides take every half span unless told otherwise."""
    r = span_rows(refs, sizes).select("span").distinct()
    return span_rows(train, sizes, train_stride).join(r, "span", "left_semi").select("id").distinct()


def near_hits(train: DataFrame, refs: DataFrame, least: int = 58) -> DataFrame:
    """(id, ref_id): training rows near a reference by signature; the first reference in the order of ids is named.

    Texts shorter than a gram have a signature of zeros here, so any two of them match.
    """
    sig = lambda df: df.where("text is not null").select("id", minhash.signature(X.nopunct_key(F.col("text"), False), False).alias("sig"))
    return minhash.near_pairs(sig(train), sig(refs), least).groupBy(F.col("id_a").alias("id")).agg(F.min("id_b").alias("ref_id"))


def leaked(train: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, reasons): all kinds of hit of each leaking row; the near test is made only where nothing else was found."""
    hits = None
    for kind in KEYS:
        h = key_hits(train, refs, kind).select("id", F.lit(kind).alias("kind"))
        hits = h if hits is None else hits.union(h)
    hits = hits.union(span_hits(train, refs).select("id", F.lit("span").alias("kind")))
    rest = train.join(hits.select("id").distinct(), "id", "left_anti")
    return hits.union(near_hits(rest, refs).select("id", F.lit("near").alias("kind"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the ids; null keys stay."""
    return rows.join(ids.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right, of the distinct non-null keys of two tables."""
    l = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("l", F.lit(1))
    r = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("r", F.lit(1))
    return l.join(r, key, "full").select(key, F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def token_key(tokens: Column) -> Column:
    return X.sha256(F.lower(F.array_join(tokens, " ")))


def fresh_windows(new: DataFrame, old: DataFrame) -> DataFrame:
    """New windows whose lower-case tokens are not among the old ones'."""
    return new.withColumn("_k", token_key(F.col("tokens"))).join(old.select(token_key(F.col("tokens")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def vocabulary_overlap(tokens: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """(distinct_b, shared, mass_b, shared_mass, share) of the lower-case forms of rows (split, tok)."""
    n = tokens.groupBy(F.lower("tok").alias("form")).agg(F.count_if(F.col("split") == a).alias("na"), F.count_if(F.col("split") == b).alias("nb")).where("nb > 0")
    both = F.col("na") > 0
    return n.agg(
        F.count(F.lit(1)).alias("distinct_b"), F.count_if(both).alias("shared"), F.coalesce(F.sum("nb"), F.lit(0)).alias("mass_b"), F.coalesce(F.sum(F.when(both, F.col("nb"))), F.lit(0)).alias("shared_mass"),
        F.round(F.try_divide(F.sum(F.when(both, F.col("nb")).otherwise(0)), F.sum("nb")), 6).alias("share"),
    )
