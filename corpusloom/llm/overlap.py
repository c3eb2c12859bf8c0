"""Problem 7: records of evaluation splits that occur, exactly or almost, in the training split.

Method: hashes of the word n-grams of evaluation records are partitioned with those of training, training is scanned for hits,
and the containment of each evaluation record in each training record that it hits is computed from their words.

* n is 1: shared words count in any order, so two records may share hardly any longer run. Of an evaluation record only the
  hashes are sent that a training record must hit one of: of n words that share `similarity` with another's, its rarest
  (1 - similarity) n + 1 (prefixes), and of training the same. Frequent words are only last in the order, so families of near
  copies of any size meet: no pair is lost.
* Records of the same words are one class, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ranges
from ..plans.storage import discard, materialise
from . import codepoints as cp
from . import lookalikes, prefixes
from .neardup import _binary, bag_ids, sorted_bags, unpack, verified, word_counts

SIMILARITY = 0.8


def token_bags(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes sorted within rows, row offsets) of a column of token lists; null tokens hold no word.

    Each different token of the batch is brought to its form and cut into words once.
    """
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(pc.fill_null(pc.list_flatten(col), ""))
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cps, offs = cp.decode(coded.dictionary)
    cps, offs, _ = lookalikes.canonical(cps, offs)
    low = cp.tables()[0][cps]
    start, end, token = cp.word_runs(low, offs)
    hashes = cp.run_hashes(low, start, end)
    many = np.bincount(token, minlength=len(coded.dictionary))
    first, n = np.cumsum(many) - many, many[at]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
    return sorted_bags(hashes[place], np.repeat(np.repeat(np.arange(len(size)), size), n), len(size))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        lengths = pc.list_value_length(whole.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
        for x, y in ranges(lengths, 1 << 20):
            b = whole.slice(x, y - x)
            words, offs = token_bags(b.column("tokens"))
            keep = pa.array(np.flatnonzero(np.diff(offs) > 0))
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column("eval"), pa.array(bag_ids(words, offs)), _binary(words, offs)], names=["id", "eval", "node", "words"])
            yield out.take(keep)


def cross_split(windows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(records (id, eval, node), links (a, b, sim, contained)): a is an evaluation class, b a training class.

    windows: id, split, tokens. Null tokens, empty lists and null splits are in no link; rows that come again are one.
    """
    texts = windows.where("id is not null and tokens is not null and split in ('train', 'validation', 'test')").select("id", (F.col("split") != "train").alias("eval"), "tokens")
    rows = materialise(texts.mapInArrow(_bags, "id string, eval boolean, node long, words binary"), "windows")
    order = prefixes.order_of(word_counts(rows), rows.count())
    bags = rows.select("node", F.col("eval").cast("int").alias("side"), F.lit(0).cast("long").alias("grp"), "words")
    edges = prefixes.candidates(bags, unpack, order, similarity, cross=True, fine=1.25)
    links = verified(edges, rows, similarity)
    discard(edges)
    return rows.select("id", "eval", "node"), links


def found(windows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b): pairs of ids, one in training and one in an evaluation split, smaller id first."""
    records, links = cross_split(windows, similarity)
    x = records.where("eval").select(F.col("id").alias("x"), F.col("node").alias("a")).distinct()
    y = records.where("not eval").select(F.col("id").alias("y"), F.col("node").alias("b")).distinct()
    out = links.select("a", "b").join(x, "a").join(y, "b").where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def report(windows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(split, source, windows, overlapping, same_article, containment): evaluation windows and how many of them occur in training.

    Windows are counted once for each id; a null source counts as unknown. containment is the mean, over the overlapping windows,
    of the largest share of a window's words that one training window holds; null where none overlaps.
    """
    records, links = cross_split(windows, similarity)
    meta = windows.where("split in ('train', 'validation', 'test')").select("id", "split", "article_id", F.coalesce("source", F.lit("unknown")).alias("source"))
    evals = meta.where("split <> 'train'").groupBy("id", "split").agg(F.min("source").alias("source"), F.min("article_id").alias("article_id"))
    ids = records.select("id", "eval", "node").distinct()
    train_articles = ids.where("not eval").join(meta.where("split = 'train'").select("id", "article_id"), "id").select(F.col("node").alias("b"), "article_id").distinct()
    hit = ids.where("eval").select("id", F.col("node").alias("a")).join(links.select("a", "b", "contained"), "a").join(train_articles.withColumnRenamed("article_id", "train_article"), "b").select("id", "b", "train_article", "contained")
    per = evals.join(hit, "id", "left").groupBy("split", "source", "id").agg(F.count("b").alias("n"), F.max("contained").alias("contained"), F.max((F.col("train_article") == F.col("article_id")).cast("int")).alias("same"))
    return per.groupBy("split", "source").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("n") > 0).alias("overlapping"), F.count_if(F.col("same") == 1).alias("same_article"), F.round(F.avg("contained"), 6).alias("containment"))
