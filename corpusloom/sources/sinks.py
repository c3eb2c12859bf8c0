"""Writers, and hashes of content that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import LABELS


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split, so that a reader of one split reads its files only."""
    df.write.partitionBy(split).json(path)


def statistics(df: DataFrame, split: str = "split") -> DataFrame:
    """(split, samples, articles, words, and a count for each label) of samples (split, article_id, labels)."""
    n = [F.sum(F.size(F.filter("labels", _is(x)))).cast("long").alias(x.lower()) for x in LABELS]
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("article_id").alias("articles"), F.sum(F.size("labels")).cast("long").alias("words"), *n)


def _is(value: str):
    return lambda x: x == value


def with_statistics(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split below `data`, and beside them `statistics`, a line for each split."""
    by_split(df, f"{path}/data", split)
    statistics(df, split).coalesce(1).write.json(f"{path}/statistics")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, hash): sha256 of each file below a folder. A file is a row, so this is for artefacts, not for tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("hash"))


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def confusion_csv(cube: DataFrame, labels: list[str], path: str) -> None:
    """The confusion matrix, one row a true label, in the order of the labels."""
    m = cube.groupBy("true").pivot("pred", labels).agg(F.sum("n")).fillna(0)
    csv(m.orderBy(F.array_position(F.array(*map(F.lit, labels)), F.col("true"))).coalesce(1), path)


def word_tsv(df: DataFrame, path: str, words: str = "words", labels: str = "labels") -> None:
    """word, whether a sentence ends, label: a line a word, an empty line after each sequence."""
    line = F.zip_with(words, labels, lambda w, x: F.concat_ws("\t", w, F.when(x.isin(".", "?"), "1").otherwise("0"), x))
    df.select(F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("value")).write.text(path)


def row_hash(*columns: str | Column) -> Column:
    """sha256 of a row's values as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, hash) of a table: equal for equal rows in any order; counts repeats. A sum of row hashes, so nothing is sorted."""
    h = F.md5(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}))
    part = lambda i: F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *(F.coalesce(part(i), F.lit(0)).cast("string") for i in (1, 9, 17, 25))).alias("hash"))


def without_ids(df: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """The rows whose key is not among the ids, at a new path: the old files stay until the caller swaps them."""
    df.join(ids.select(key).distinct(), key, "left_anti").write.json(path)


def blind(df: DataFrame, kept: list[str], judged: list[str]) -> DataFrame:
    """A table for review with all judgement columns blank."""
    return df.select(*kept, *(F.lit("").alias(c) for c in judged))
