"""Readers with fixed schemas: JSON lines, TSV, CSV, XML dumps, speech-recognition JSON, paired lines, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

ARTICLE = "article_id string, text string"
WINDOW = "id string, article_id string, tokens array<string>, labels array<string>, source string, has_question boolean"
RECORD = (
    "record_id string, source string, source_document_id string, source_url string, license string, retrieved_at date, text string, language_code string, dialect string, script string, "
    "author string, title string, url_or_reference string, hf_split string, hf_shard string, source_type string, original_source string, quality_score double, word_count bigint"
)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped; a broken line is an error unless strict is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def folder_lines(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All matching files below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)


def union_sources(parts: dict[str, DataFrame | None]) -> DataFrame:
    """The rows of several sources by column name, missing columns null; a null source is the part's name; missing parts are skipped."""
    out = None
    for name, df in parts.items():
        if df is None:
            continue
        df = df.withColumn("source", F.coalesce(F.col("source"), F.lit(name)) if "source" in df.columns else F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is there")
    return out


def keyed_texts(rows: DataFrame, key: str = "id", text: str = "text", order: str = "line") -> DataFrame:
    """(key, text): the last row of each key in the given order wins."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(text, order).alias(text))


def sentences_tsv(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(id, lang, text, user) of tab-separated files, compressed or not; rows of fewer than three fields are skipped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    out = rows.select(F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).alias("lang"), F.get("c", F.lit(2)).alias("text"), F.get("c", F.lit(3)).alias("user"))
    return out if language is None else out.where(F.col("lang") == language)


def language_rows(rows: DataFrame, language: str, text: str = "text", most: int | None = None) -> DataFrame:
    """Rows of one language with a question in a non-empty text; the filter reaches the scan. `most` is a wanted limit."""
    kept = rows.where((F.col("language_code") == language) & F.col(text).contains("?"))
    return kept if most is None else kept.limit(most)


def review_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Review tables with a header: every column is text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the main-space pages of an XML dump that have a title and a text; compressed dumps are read as they are."""
    schema = "title string, ns string, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = '0' and length(title) > 0").select("title", F.col("revision.text").alias("text")).where("text is not null")


def recognised(v: Column) -> Column:
    """array<string>: the words of a recognition result: a list of words, a list of objects, {"words": ...} or {"text": ...}."""
    listed = F.coalesce(F.try_variant_get(v, "$.words", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    word = lambda x: F.coalesce(*(F.try_variant_get(x, p, "string") for p in ("$.word", "$.text", "$.token")), F.try_variant_get(x, "$", "string"))
    words = F.when(listed.isNotNull(), F.transform(listed, word)).otherwise(F.split(strip(F.try_variant_get(v, "$.text", "string")), r"\s+"))
    return F.filter(words, lambda x: x.isNotNull() & (x != ""))


def asr_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, words): recognised words of files with one result each."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.parse_json("value").alias("v"))
    return raw.select("path", recognised(F.col("v")).alias("words"))


def landed_questions(rows: DataFrame) -> DataFrame:
    """Rows of a landed dataset with `text` from `content` or else `text`, that have a question mark in text or title."""
    body = F.coalesce(*(F.col(c) for c in ("content", "text") if c in rows.columns))
    title = F.col("title") if "title" in rows.columns else F.lit("")
    kept = rows.withColumn("text", body)
    return kept.where(F.coalesce(F.col("text"), F.lit("")).contains("?") | F.coalesce(title, F.lit("")).contains("?"))


def of_sources(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows whose source is among the allowed ones (source); a null source never is."""
    return rows.join(allowed.select("source").distinct(), "source", "left_semi")


def paired_lines(spark: SparkSession, path: str) -> DataFrame:
    """(gold, asr) of lines `gold | asr`; comments and lines without a bar are skipped."""
    rows = spark.read.text(path).where("not startswith(ltrim(value), '#') and contains(value, '|')")
    parts = F.split("value", r"\|", 2)
    return rows.select(strip(F.get(parts, F.lit(0))).alias("gold"), strip(F.get(parts, F.lit(1))).alias("asr"))


def one_text(spark: SparkSession, text: str) -> DataFrame:
    """A text given by hand, as one row."""
    return spark.createDataFrame([(text,)], "text string")
