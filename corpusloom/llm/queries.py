"""The queries of the ten problems over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise
from ..sources.tables import table
from . import abuse, bpe, groupsplit, languages, lookalikes, mixing, neardup, overlap, packing, truncation
from .neardup import corpus_texts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(corpus_texts(spark, d, "raw_records", "documents"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(corpus_texts(spark, d, "raw_records", "documents"))


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    """(tab, record_key, source, text) of raw_records and documents."""
    out = None
    for t, key in (("raw_records", "record_id"), ("documents", "doc_id")):
        rows = table(spark, d, t).select(F.lit(t).alias("tab"), F.col(key).cast("string").alias("record_key"), truncation.source_name(F.col("source")).alias("source"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.flag(_sourced(spark, d), "source", "tab", "record_key").where("cut").select("tab", "record_key").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """(tab, source, texts, cut, rate, marked): marked is the share of texts with a complete sentence, the source's baseline."""
    flags = truncation.flag(_sourced(spark, d).where("text is not null"), "source", "tab")
    return flags.groupBy("tab", "source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"), F.round(F.avg(F.col("marked").cast("double")), 6).alias("marked")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = corpus_texts(spark, d, "wikipedia", "raw_records", "documents")
    return lookalikes.normalise(texts, "tab", "record_key").where("changed").select("tab", "record_key").distinct()


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    texts = corpus_texts(spark, d, "wikipedia", "raw_records", "documents")
    return lookalikes.normalise(texts, "tab", "record_key")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records").select(F.lit("raw_records").alias("tab"), F.col("record_id").alias("record_key"), "text", F.col("language_code").alias("label"))
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("record_key"), "text", F.col("lang").alias("label"))
    return raw.unionByName(docs)


def _profiles(spark: SparkSession, d: str) -> languages.Profiles:
    return languages.profiles(table(spark, d, "language_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.unlabelled(_labelled(spark, d), _profiles(spark, d), "tab", "record_key")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    texts = _labelled(spark, d).withColumn("named", languages.label_language(F.col("label")))
    return languages.segment_table(texts, _profiles(spark, d), "tab", "record_key", "named")


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """(tab, record_key, language, confidence, segments, mixed): one row for each key; a record that came again counts all its texts."""
    texts = _labelled(spark, d).where("record_key is not null")
    keys = texts.select("tab", "record_key").distinct().withColumn("text", F.lit(None).cast("string"))
    return languages.documents(texts.select("tab", "record_key", "text").distinct(), _profiles(spark, d), "tab", "record_key", every=keys)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.found(table(spark, d, "accepted_records"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split(table(spark, d, "accepted_records"), table(spark, d, "window_samples"), table(spark, d, "split_targets"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """(split, target, records, windows, share, source_deviation, question_deviation, label_deviation)."""
    rows = groupsplit.assigned(table(spark, d, "accepted_records"), table(spark, d, "window_samples"), table(spark, d, "split_targets"))
    return groupsplit.reached(materialise(rows, "assigned"), table(spark, d, "split_targets"))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "raw_records"), table(spark, d, "source_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p6_mixture(spark, d), table(spark, d, "source_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "window_samples"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "window_samples"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return packing.containers(materialise(sizes, "sizes"), "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_containers(spark, d))


def _abuse(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = abuse.fit(docs, table(spark, d, "labels"), _profiles(spark, d))
    return abuse.score(docs, model, *keys)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d, "doc_id").where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d, "doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """(source, documents, flagged, rate)."""
    rows = _abuse(spark, d, "source").withColumn("source", truncation.source_name(F.col("source")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this module: the functions named after a problem."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# SQL versions. Look-alike letters are folded wherever they stand, which is enough to compare words, and to find
# texts that aren't in their usual form.
_LIKE = "".join([*lookalikes.CYRILLIC, *lookalikes.GREEK])
_AS = "".join([*lookalikes.CYRILLIC.values(), *lookalikes.GREEK.values()])
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_SMALL = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_HIDDEN = r"[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"


def _folded(x: str) -> str:
    plain = f"translate(translate(regexp_replace({x}, '{_HIDDEN}', '', 'g'), '{_WIDE}', '{_SMALL}'), '{_LIKE}ȘșȚț', '{_AS}ŞşŢţ')"
    # A dotless i under a circumflex is the dotted one's letter; the dotted capital I is one character in lower case.
    return f"lower(translate(nfc_normalize(replace({plain}, 'ı' || chr(770), 'î')), 'İ', 'i'))"


def _sql_words(x: str) -> str:
    return f"regexp_extract_all({_folded(x)}, '([\\p{{L}}\\p{{Nd}}]+)', 1)"


def _sql_pairs(texts: str, rule: str, out: str, least: int) -> str:
    """Pairs of rows (tab, k, side, text) by brute force: all that share a word, by the words that both hold."""
    return f"""WITH {_sql_shared(texts, least)} SELECT DISTINCT {out} FROM s JOIN d a ON a.r = ra JOIN d b ON b.r = rb WHERE a.tab = b.tab AND a.k <> b.k AND {rule} AND n >= 0.8 * greatest(len(a.w), len(b.w))"""


def _sql_shared(texts: str, least: int) -> str:
    """CTEs that end in s (ra, rb, n): the words that two rows of d share."""
    return f"""d AS (SELECT row_number() OVER () AS r, tab, k, side, {_sql_words('text')} AS w FROM ({texts}) WHERE text IS NOT NULL AND k IS NOT NULL),
w AS (SELECT r, x, row_number() OVER (PARTITION BY r, x) AS i FROM (SELECT r, unnest(w) AS x FROM d WHERE len(w) >= {least})),
s AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM w a JOIN w b ON a.x = b.x AND a.i = b.i AND a.r < b.r GROUP BY ALL)"""


_CHANGED = "|".join([
    r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ad}\x{200b}\x{2060}\x{feff}\x{ff01}-\x{ff5e}\x{fb50}-\x{fdcf}\x{fe70}-\x{fefc}ȘșȚț]|ı\x{302}",
    rf"[A-Za-zÀ-ɏ][{_LIKE}]|[{_LIKE}][A-Za-zÀ-ɏ]", r"[A-Za-zÀ-ɏ ][\x{200c}\x{200d}]|[\x{200c}\x{200d}][A-Za-zÀ-ɏ ]",
])


def oracle_sql() -> dict[str, str]:
    """Brute force over whole tables for pairs, and the signs of an unusual form."""
    texts = "SELECT 'raw_records' AS tab, record_id AS k, '' AS side, text FROM raw_records UNION ALL SELECT 'documents', doc_id::VARCHAR, '', text FROM documents"
    windows = "SELECT 'w' AS tab, id AS k, CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side, array_to_string(tokens, ' ') AS text FROM window_samples WHERE split IS NOT NULL"
    forms = "SELECT 'wikipedia' AS tab, article_id AS record_key, text FROM wikipedia UNION ALL SELECT 'raw_records', record_id, text FROM raw_records UNION ALL SELECT 'documents', doc_id::VARCHAR, text FROM documents"
    tracking = "^(utm_.*|fbclid|gclid|ref|source)$"
    parts = [f"regexp_extract(regexp_replace(nfc_normalize(url_decode(t)), '#.*$', ''), '^https?://([^/?]+)([^?]*)[?]?(.*)$', {i})" for i in (1, 2, 3)]
    page = f"""'page ' || regexp_replace(lower({parts[0]}), '^((www|m)[.])+', '') || rtrim({parts[1]}, '/') || '?' || array_to_string(list_sort(list_filter(string_split({parts[2]}, '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '{tracking}'))), '&')"""
    named = f"""SELECT record_id AS k, CASE WHEN regexp_matches(t, '^https?://') THEN {page} ELSE 'place ' || s || ' ' || CASE WHEN regexp_matches(t, '^[0-9]+$') THEN (t::HUGEINT)::VARCHAR ELSE t END END AS doc
FROM (SELECT record_id, trim(source_document_id) AS t, regexp_replace(lower(trim(coalesce(source, 'unknown'))), '[ -]+', '_', 'g') AS s FROM accepted_records) WHERE t <> '' AND record_id IS NOT NULL"""
    report = f"""WITH {_sql_shared(windows, 1)}, h AS (SELECT DISTINCT CASE WHEN a.side = 'eval' THEN a.k ELSE b.k END AS id, CASE WHEN a.side = 'eval' THEN b.k ELSE a.k END AS other, n / len(CASE WHEN a.side = 'eval' THEN a.w ELSE b.w END) AS inside FROM s JOIN d a ON a.r = ra JOIN d b ON b.r = rb WHERE a.side <> b.side AND n >= 0.8 * greatest(len(a.w), len(b.w))),
e AS (SELECT id, split, min(coalesce(source, 'unknown')) AS source, min(article_id) AS article_id FROM window_samples WHERE split IN ('validation', 'test') GROUP BY id, split),
t AS (SELECT h.id, w.article_id, inside FROM h JOIN window_samples w ON w.id = h.other AND w.split = 'train'), p AS (SELECT e.split, e.source, e.id, count(t.id) > 0 AS hit, max(inside) AS inside, coalesce(bool_or(t.article_id = e.article_id), false) AS same FROM e LEFT JOIN t ON t.id = e.id GROUP BY ALL)
SELECT split, source, count(*) AS windows, count(*) FILTER (hit) AS overlapping, count(*) FILTER (same) AS same_article, round(avg(inside), 6) AS containment FROM p GROUP BY split, source"""
    groups = f"""WITH RECURSIVE {_sql_shared(texts, 30)}, b AS (SELECT r, tab, k, tab || ' ' || array_to_string(list_sort(w), ' ') AS bag, len(w) AS n FROM d WHERE len(w) >= 30), c AS (SELECT bag, min(tab) AS tab, min(k) AS first, count(*) AS copies FROM b GROUP BY bag),
e AS (SELECT DISTINCT x.bag AS a, y.bag AS b FROM s JOIN b x ON x.r = s.ra JOIN b y ON y.r = s.rb WHERE x.tab = y.tab AND x.bag <> y.bag AND s.n >= 0.8 * greatest(x.n, y.n)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT bag AS a, bag AS b FROM c UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b), m AS (SELECT t.a, min(c.first) AS class_id FROM t JOIN c ON c.bag = t.b GROUP BY t.a), g AS (SELECT a, count(*) AS links FROM u GROUP BY a)
SELECT b.tab, b.k AS record_key, m.class_id, coalesce(g.links, 0) AS links, c.copies FROM b JOIN c USING (bag) JOIN m ON m.a = bag LEFT JOIN g ON g.a = bag"""
    return {
        "p1_groups": groups,
        "p7_report": report,
        "p5_found": f"""WITH RECURSIVE d AS (SELECT DISTINCT * FROM ({named})), e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM d x JOIN d y ON x.doc = y.doc AND x.k <> y.k),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS article_id_a, b AS article_id_b FROM c WHERE a < b""",
        "p1_found": _sql_pairs(texts, "true", "a.tab, least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b", 30),
        "p3_found": f"SELECT DISTINCT tab, record_key FROM ({forms}) WHERE text <> nfc_normalize(text) OR regexp_matches(text, '{_CHANGED}')",
        "p7_found": _sql_pairs(windows, "a.side <> b.side", "least(a.k, b.k) AS id_a, greatest(a.k, b.k) AS id_b", 1),
    }
