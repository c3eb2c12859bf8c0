"""More queries of the engine: readers and sinks, filters of articles and sentences, forms of text, labels, metrics of other label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casing as C
from .functions import subwords
from .functions import text as X
from .functions import tokens as T
from .operators import corpus, curation, metrics, restoration
from .plans.storage import new_path
from .queries import (
    S_CASES, S_CASE_WORDS, S_COST, S_OLD, S_OLD_MAP, S_PAIRS, S_SCRIPT, S_SKIP, _cases, _doc_tokens, _docs, _labelled_windows, _pairs, q, query, rx, s_collapse, s_dataset, s_f1, s_letters,
    s_logits, s_low, s_nfc, s_nopunct, s_strip, s_tokens, s_words, s_ws, table,
)
from .sources import readers, sinks


def written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The path of a text file with one line for each row of one string column."""
    path = new_path(spark, name)
    rows.write.text(path)
    return path


# Readers and sinks.
@query("SELECT id, split FROM window_samples WHERE split IS NOT NULL")
def folder_scan(spark, d):
    path = new_path(spark, "folder")
    sinks.by_split(table(spark, d, "window_samples").where("split is not null").select("id", F.col("split"), F.col("split").alias("part")), path, "part")
    return readers.folder_lines(spark, path, "id string, split string", "*.json")


@query("SELECT record_id AS id, md5(arg_max(text, landed_at)) AS text FROM raw_records WHERE record_id IS NOT NULL AND text IS NOT NULL GROUP BY record_id")
def last_texts(spark, d):
    rows = table(spark, d, "raw_records").where("text is not null").select(F.col("record_id").alias("id"), "text", "landed_at")
    return readers.keyed_texts(rows, order="landed_at").select("id", F.md5("text").alias("text"))


S_LINE = rx("text", r"[\t\n\r]", " ")


@query(f"SELECT sample_id::VARCHAR AS id, language AS lang, {S_LINE} AS text FROM language_samples WHERE language = 'kmr'")
def tsv_scan(spark, d):
    rows = table(spark, d, "language_samples").select(F.concat_ws("\t", F.col("sample_id").cast("string"), "language", F.regexp_replace("text", r"[\t\n\r]", " "), F.lit("user")).alias("value"))
    return readers.sentences_tsv(spark, written(spark, rows, "tsv"), "kmr").select("id", "lang", "text")


S_MARKABLE = s_collapse(rx("text", r"[^\p{L}\p{N},.?! ]", " "))


@query(f"SELECT article_id AS title, {S_MARKABLE} AS text FROM wikipedia WHERE length({S_MARKABLE}) > 0")
def dump_scan(spark, d):
    """Articles as pages of dump files of some 500 articles, each with a copy outside the main space that must not come back."""
    t = X.collapse(F.regexp_replace("text", r"[^\p{L}\p{N},.?! ]", " "))
    rows = table(spark, d, "wikipedia").select("article_id", t.alias("t")).where(F.length("t") > 0)
    page = lambda space: F.concat(F.lit("<page><title>"), "article_id", F.lit(f"</title><ns>{space}</ns><revision><text>"), "t", F.lit("</text></revision></page>"))
    files = rows.count() // 500 + 1
    pages = rows.select(F.pmod(F.xxhash64("article_id"), F.lit(files)).alias("part"), F.concat(page(0), page(10)).alias("page"))
    path = new_path(spark, "dump")
    dumps = pages.groupBy("part").agg(F.concat(F.lit("<mediawiki>"), F.array_join(F.collect_list("page"), "\n"), F.lit("</mediawiki>")).alias("value"))
    dumps.write.partitionBy("part").text(path)
    return readers.wiki_dump(spark, f"{path}/*")


@query(f"SELECT doc_id, list_filter(string_split({s_collapse('text')}, ' '), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL")
def recognised_words(spark, d):
    """Texts in the four forms of recognition files, a file a form, and back to words."""
    rows = _docs(spark, d).where("text is not null").select("doc_id", X.collapse(F.col("text")).alias("t")).select("doc_id", "t", F.filter(F.split("t", " "), lambda x: x != "").alias("w"))
    objects = F.to_json(F.transform("w", lambda x: F.struct(x.alias("word"))))
    forms = [F.to_json("w"), objects, F.concat(F.lit('{"words":'), objects, F.lit("}")), F.to_json(F.struct(F.col("t").alias("text")))]
    picked = F.when(F.size("w") == 0, forms[3])
    for i, form in enumerate(forms):
        picked = picked.when(F.col("doc_id") % 4 == i, form)
    lines = spark.read.schema("doc_id long, value string").json(_as_json(spark, rows.select("doc_id", picked.alias("value"))))
    return lines.select("doc_id", readers.recognised(F.parse_json("value")).alias("words"))


def _as_json(spark: SparkSession, rows: DataFrame) -> str:
    path = new_path(spark, "lines")
    sinks.json_lines(rows, path)
    return path


@query(f"SELECT {s_strip(rx('text', r'[\r\n|]', ' '))} AS gold, {s_strip(rx(s_dataset('text'), r'[\r\n|,.?!]', ' '))} AS asr FROM language_samples WHERE text NOT LIKE '#%'")
def paired_scan(spark, d):
    gold, asr = F.regexp_replace("text", r"[\r\n|]", " "), F.regexp_replace(X.normalize_for_dataset(F.col("text")), r"[\r\n|,.?!]", " ")
    rows = table(spark, d, "language_samples").where("text not like '#%'").select(F.concat(gold, F.lit(" | "), asr).alias("value"))
    return readers.paired_lines(spark, written(spark, rows.union(spark.createDataFrame([("# a comment | x",), ("no bar",)], "value string")), "pairs"))


@query("SELECT 'Roj baş! Tu çawa yî?' AS text")
def given_text(spark, d):
    return readers.one_text(spark, "Roj baş! Tu çawa yî?")


@query("SELECT article_id, md5(text) AS text FROM wikipedia WHERE article_id IN (SELECT article_id FROM window_samples WHERE split = 'test') ORDER BY md5('42:' || article_id), article_id LIMIT 10")
def articles_of_split_limited(spark, d):
    """The first ten articles, by a hash of their ids, that have a window in the test split."""
    keep = table(spark, d, "window_samples").where("split = 'test'").select("article_id")
    rows = table(spark, d, "wikipedia").join(keep, "article_id", "left_semi")
    return rows.orderBy(corpus.hash_order(F.col("article_id")), "article_id").limit(10).select("article_id", F.md5("text").alias("text"))


@query("SELECT record_id, landed_at FROM raw_records WHERE contains(coalesce(text, ''), '?') OR contains(coalesce(title, ''), '?')")
def landed_scan(spark, d):
    """Records of a landed dataset, whose text is in one of two columns, with a question in text or title."""
    raw = table(spark, d, "raw_records")
    parts = [raw.where("hf_split is null"), raw.where("hf_split is not null").withColumn("content", F.col("text")).drop("text")]
    return readers.landed_questions(parts[0].unionByName(parts[1], allowMissingColumns=True)).select("record_id", "landed_at")


@query("SELECT record_id, source FROM accepted_records WHERE source IN ('kurmanji_news', 'tatoeba')")
def allowed_sources(spark, d):
    allowed = spark.createDataFrame([("kurmanji_news",), ("tatoeba",), ("kurmanji_news",)], "source string")
    return readers.of_sources(table(spark, d, "accepted_records"), allowed).select("record_id", "source")


@query("SELECT id, tok AS word, CASE WHEN label IN ('.', '?') THEN '1' ELSE '0' END AS ends, label FROM (SELECT id, unnest(tokens) AS tok, unnest(list_transform(labels, lambda x: CASE x WHEN 'PERIOD' THEN '.' WHEN 'QUESTION' THEN '?' WHEN 'COMMA' THEN ',' WHEN 'EXCLAMATION' THEN '!' ELSE '0' END)) AS label FROM window_samples WHERE split = 'test' AND len(tokens) = len(labels)) ")
def word_tsv_round_trip(spark, d):
    """Words, ends and labels of test windows through the word sink; the id goes along as a word of its own before each window."""
    marks = F.create_map(*(F.lit(x) for pair in (("PERIOD", "."), ("QUESTION", "?"), ("COMMA", ","), ("EXCLAMATION", "!")) for x in pair))
    rows = table(spark, d, "window_samples").where("split = 'test' and size(tokens) = size(labels)").select("id", "tokens", F.transform("labels", lambda x: F.coalesce(F.element_at(marks, x), F.lit("0"))).alias("labels"))
    rows = rows.select(F.transform("tokens", lambda t: F.concat_ws("\x1f", "id", t)).alias("words"), "labels")
    path = new_path(spark, "words")
    sinks.word_tsv(rows, path)
    back = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("c"))
    name = F.split(F.get("c", F.lit(0)), "\x1f")
    return back.select(F.get(name, F.lit(0)).alias("id"), F.get(name, F.lit(1)).alias("word"), F.get("c", F.lit(1)).alias("ends"), F.get("c", F.lit(2)).alias("label"))


@query("SELECT record_id, source, text, '' AS accept, '' AS comment FROM accepted_records")
def blind_review(spark, d):
    return sinks.blind(table(spark, d, "accepted_records"), ["record_id", "source", "text"], ["accept", "comment"])


@query(f"""SELECT split, count(*) AS samples, count(DISTINCT article_id) AS articles, sum(len(labels))::BIGINT AS words, {', '.join(f"sum(len(list_filter(labels, lambda x: x = '{x}')))::BIGINT AS {x.lower()}" for x in T.LABELS)} FROM window_samples WHERE split IS NOT NULL GROUP BY split""")
def split_statistics(spark, d):
    """What the statistics file beside a dataset's splits says, read back."""
    path = new_path(spark, "dataset")
    sinks.with_statistics(table(spark, d, "window_samples").where("split is not null"), path)
    return readers.json_lines(spark, f"{path}/statistics", "split string, samples long, articles long, words long, " + ", ".join(f"{x.lower()} long" for x in T.LABELS))


@query("SELECT sha256(string_agg(sample_id::VARCHAR || chr(9) || language || chr(10), '' ORDER BY sample_id)) AS hash, 1::BIGINT AS files FROM language_samples")
def artefact_hashes(spark, d):
    """sha256 of the files of an artefact: here one file of lines."""
    rows = table(spark, d, "language_samples").select("sample_id", F.concat_ws("\t", F.col("sample_id").cast("string"), "language").alias("value"))
    path = written(spark, rows.orderBy("sample_id").select("value").coalesce(1), "artefact")
    return sinks.file_hashes(spark, path, "part-*").groupBy(F.col("hash")).agg(F.count(F.lit(1)).alias("files"))


# Filters of articles and sentences.
S_RATIOS = f"SELECT s.*, d.text FROM ({S_SCRIPT.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')}) s JOIN documents d USING (doc_id)"
S_LATIN = lambda n: f"(n_letters >= {n} AND arabic_ratio <= 0.05 AND latin_ratio >= 0.85)"


@query(f"SELECT doc_id, {S_LATIN(20)} AS article, {S_LATIN(12)} AS old, regexp_matches(lower({rx('text', f'^{X.WS}+')}), '^#(redirect|beralîkirin)') AS redirect, len(list_filter(string_split({s_collapse('text')}, ' '), lambda x: x <> '')) < 5 AS stub FROM ({S_RATIOS})")
def article_filters(spark, d):
    t = F.col("text")
    return _docs(spark, d).where("text is not null").select("doc_id", X.latin_text(t).alias("article"), X.latin_text(t, 12).alias("old"), X.is_redirect(t).alias("redirect"), X.is_stub(t).alias("stub"))


S_OLD_KEPT = f"""WITH t AS (SELECT doc_id, text, {S_OLD} AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, tok, {S_OLD_MAP} AS label FROM (SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM t)) WHERE regexp_matches(tok, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) BETWEEN 3 AND 128 AND count(*) FILTER (label <> '0') > 0)"""


@query(f"""{S_OLD_KEPT} SELECT doc_id, doc_id IN (SELECT doc_id FROM k) AND NOT contains(text, '"') AND NOT contains(text, '«') AND {S_LATIN(12)} AS kept FROM ({S_RATIOS})""")
def old_sentences(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.old_sentence(F.col("text")).alias("kept"))


@query(f"SELECT source, n, accepted, round(accepted / n, 6) AS accept_rate, CASE WHEN accepted / n >= 0.9 THEN 'PASS' WHEN accepted / n >= 0.8 THEN 'REFILTER' ELSE 'REJECT' END AS gate FROM (SELECT source, count(*) AS n, count(*) FILTER (lower({s_strip('accept')}) IN ('1', 'true', 'yes', 'y', 'accept', 'ok'))::BIGINT AS accepted FROM manual_review GROUP BY source)")
def source_gates(spark, d):
    rows = table(spark, d, "manual_review").select("source", X.as_bool(F.col("accept")).alias("accept"))
    return curation.gates(rows, "source")


@query(f"""WITH t AS (SELECT doc_id, text, {s_tokens(s_dataset('text'))} AS t FROM documents), w AS (SELECT doc_id, text, len(list_filter(t, lambda x: x NOT IN (',', '.', '?', '!'))) AS n FROM t)
SELECT coalesce(skip, 'kept') AS skip, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR n = 0 THEN 'no_gold' WHEN n < 3 THEN 'few_tokens' END AS skip FROM w) GROUP BY 1""")
def evaluation_skips(spark, d):
    items = T.labelled(T.tokenize(X.normalize_for_dataset(F.col("text"))))
    rows = _docs(spark, d).select(F.transform(items, lambda x: x["tok"]).alias("tokens"), F.transform(items, lambda x: x["label"]).alias("labels"))
    return rows.groupBy(F.coalesce(metrics.skip_reason(F.col("tokens"), F.col("labels")), F.lit("kept")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


# Forms of text and labels.
S_OLD_TOKS = f"list_filter({S_OLD}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))"


@query(f"SELECT doc_id, md5(array_to_string(list_transform({S_OLD_TOKS}, lambda x: {s_low('x')}), ' ')) AS asr FROM documents WHERE text IS NOT NULL")
def recognition_like(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.asr_like(F.col("text"))).alias("asr"))


# Marks that touch a digit are put aside before the others go; overlaps need no second pass, as a mark's neighbours are looked at, not taken.
S_FLAGS = f"list_transform(range(1, length(text) + 1), lambda i: CASE WHEN regexp_matches(substr(text, i, 1), '[.,;:!?—…-]') AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END, '\\p{{Nd}}') AND NOT regexp_matches(substr(text, i + 1, 1), '\\p{{Nd}}') THEN ' ' ELSE substr(text, i, 1) END)"


@query(f"SELECT sample_id, lower({s_collapse(f'''translate(array_to_string({S_FLAGS}, ''), '؟،', '  ')''')}) AS plain FROM language_samples")
def old_inputs(spark, d):
    return table(spark, d, "language_samples").select("sample_id", X.old_plain(F.col("text")).alias("plain"))


S_OLD_ROWS = f"SELECT doc_id, tok, i, {S_OLD_MAP} AS label FROM (SELECT doc_id, tok, i, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {S_OLD} AS t FROM documents WHERE text IS NOT NULL))) WHERE regexp_matches(tok, '[\\p{{L}}\\p{{N}}]')"


@query(f"""WITH f AS ({S_OLD_ROWS}), k AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) >= 3 AND count(*) FILTER (label <> '0') > 0), b AS (SELECT doc_id, i, {s_low('tok')} AS w, label, coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY i), '.') AS before FROM f JOIN k USING (doc_id))
SELECT doc_id, md5(string_agg(CASE WHEN before IN ('.', '?') THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END || CASE WHEN label IN ('.', '?', ',', '-', ':') THEN label ELSE '' END, ' ' ORDER BY i)) AS text FROM b GROUP BY doc_id""")
def old_restored(spark, d):
    """Texts of the older scheme written again from their words and labels."""
    rows = _docs(spark, d).select("doc_id", T.old_labelled(F.col("text")).alias("x")).where("x is not null")
    return rows.select("doc_id", F.md5(T.old_joined(F.transform("x", lambda s: s["tok"]), F.transform("x", lambda s: s["label"]))).alias("text"))


S_OLD_PLAIN = f"lower({s_collapse(f'''translate(array_to_string({S_FLAGS}, ''), '؟،', '  ')''')})"


@query(f"""WITH w AS (SELECT sample_id, text, unnest(list_filter(string_split({S_OLD_PLAIN}, ' '), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(string_split({S_OLD_PLAIN}, ' '), lambda x: x <> ''), 1) AS i FROM language_samples),
l AS (SELECT sample_id, tok, i, ['0', '.', ',', '?', '-', ':'][list_position(z, list_max(z))] AS label FROM (SELECT *, {s_logits(6)} AS z FROM w)), b AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY sample_id ORDER BY i), '.') AS before FROM l)
SELECT sample_id AS key, string_agg(CASE WHEN before IN ('.', '?') THEN upper(substr(tok, 1, 1)) || substr(tok, 2) ELSE tok END || CASE WHEN label = '0' THEN '' ELSE label END, ' ' ORDER BY i) AS output FROM b GROUP BY sample_id""")
def old_restoration(spark, d):
    """Texts restored by the older scheme, by a stand-in that each worker loads once."""
    rows = table(spark, d, "language_samples").select(F.col("sample_id").alias("key"), "text")
    return restoration.restore_old(rows, restoration.loaded("stand-in of six labels", lambda: restoration.stand_in(6)))


@query(f"SELECT article_id, lower(translate(array_to_string(list_filter({s_tokens(f'''replace({s_dataset('text')}, '|', ' ')''')}, lambda x: x NOT IN (',', '.', '?', '!')), ' '), 'İ', 'i')) AS words FROM wikipedia")
def plain_articles(spark, d):
    return table(spark, d, "wikipedia").select("article_id", T.plain_words(F.col("text")).alias("words"))


S_FORM = lambda x: s_ws(f"translate(lower(translate({s_nfc(x)}, 'İ', 'i')), ',.?!', '')")


@query(f"SELECT a.record_id, coalesce(a.text = r.text OR {S_FORM('a.text')} = {S_FORM('r.text')}, a.text IS NULL AND r.text IS NULL) AS near FROM (SELECT DISTINCT record_id, raw_record_id, text FROM accepted_records) a JOIN (SELECT DISTINCT record_id, text FROM raw_records) r ON a.raw_record_id = r.record_id")
def near_same(spark, d):
    a = table(spark, d, "accepted_records").select("record_id", "raw_record_id", F.col("text").alias("a")).distinct()
    r = table(spark, d, "raw_records").select(F.col("record_id").alias("raw_record_id"), F.col("text").alias("b")).distinct()
    return a.join(r, "raw_record_id").select("record_id", X.near_idempotent(F.col("a"), F.col("b")).alias("near"))


S_GRAMS = lambda x: f"list_distinct(list_transform(range(1, greatest(1, length({x}) - 3)), lambda i: substr({x}, i, 5)))"


@query(f"""SELECT record_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM
(SELECT record_id, {S_GRAMS('x')} AS a, {S_GRAMS('y')} AS b FROM (SELECT a.record_id, {s_nopunct('a.text')} AS x, {s_nopunct('r.text')} AS y FROM (SELECT DISTINCT record_id, raw_record_id, text FROM accepted_records WHERE text IS NOT NULL) a JOIN (SELECT DISTINCT record_id, text FROM raw_records WHERE text IS NOT NULL) r ON a.raw_record_id = r.record_id))""")
def gram_jaccard(spark, d):
    a = table(spark, d, "accepted_records").where("text is not null").select("record_id", "raw_record_id", "text").distinct()
    r = table(spark, d, "raw_records").where("text is not null").select(F.col("record_id").alias("raw_record_id"), F.col("text").alias("raw")).distinct()
    keys = a.join(r, "raw_record_id").select("record_id", X.nopunct_key(F.col("text")).alias("a"), X.nopunct_key(F.col("raw")).alias("b"))
    return keys.select("record_id", F.round(T.jaccard(T.grams(F.col("a"), 5, False), T.grams(F.col("b"), 5, False)), 6).alias("jaccard"))


@query("SELECT id, list_transform(labels, lambda x: CASE x WHEN 'O' THEN 0 WHEN 'COMMA' THEN 1 WHEN 'PERIOD' THEN 2 WHEN 'QUESTION' THEN 3 WHEN 'EXCLAMATION' THEN 4 END) AS ids, array_to_string(labels, ' ') AS labels FROM window_samples")
def label_numbers(spark, d):
    ids = T.label_ids(F.col("labels"))
    return table(spark, d, "window_samples").select("id", ids.alias("ids"), F.array_join(T.labels_of(ids), " ").alias("labels"))


@query(f"SELECT tok, CASE WHEN {s_letters('tok')} = '' THEN true ELSE upper(lower(translate(substr({s_letters('tok')}, 1, 1), 'İ', 'i'))) = substr({s_letters('tok')}, 1, 1) END AS upper FROM (SELECT DISTINCT tok FROM (SELECT unnest(tokens) AS tok FROM window_samples)) WHERE tok IS NOT NULL")
def first_letters(spark, d):
    toks = table(spark, d, "window_samples").select(F.explode("tokens").alias("tok")).where("tok is not null").distinct()
    return toks.select("tok", C.first_letter_is_upper(F.col("tok")).alias("upper"))


@query(f"""WITH r AS (SELECT DISTINCT id, tokens, labels FROM window_samples WHERE split = 'test' AND len(tokens) = len(labels)), w AS (SELECT id, tokens, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i, labels FROM r), c AS (SELECT id, tokens, labels, i, labels[i] AS label, {S_COST} AS n FROM w),
p AS (SELECT id, tokens, labels, (sum(n) OVER (PARTITION BY id, tokens, labels ORDER BY i))::BIGINT AS place, label FROM c)
SELECT id, count(*) AS placed, sum(place)::BIGINT AS places, string_agg(label, ' ' ORDER BY place) AS labels FROM p GROUP BY id, tokens, p.labels""")
def label_placement(spark, d):
    """Labels on the last sub-token of each word, between two special tokens; places count from the first sub-token after them."""
    rows = table(spark, d, "window_samples").where("split = 'test' and size(tokens) = size(labels) and size(tokens) > 0").select("id", "tokens", "labels").distinct()
    rows = rows.select("id", F.xxhash64("tokens", "labels").alias("row"), "labels", corpus.word_costs(F.col("tokens")).alias("n"))
    ids = F.concat(F.array(F.lit(None).cast("int")), F.flatten(F.transform("n", lambda n, i: F.array_repeat(i, n))), F.array(F.lit(None).cast("int")))
    rows = rows.select("id", "row", "labels", ids.alias("w")).select("id", "row", F.posexplode(corpus.placed_labels(F.col("w"), F.col("labels"))).alias("at", "label")).where("label is not null")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " ")
    return rows.groupBy("id", "row").agg(F.count(F.lit(1)).alias("placed"), F.sum("at").cast("long").alias("places"), listed.alias("labels")).drop("row")


S_CASE_EVENT = rf"CASE WHEN tok IN ('.', '?', '!') THEN 'SET' WHEN tok IN ({S_SKIP}) THEN NULL WHEN regexp_matches(tok, '\p{{L}}') THEN 'CONSUME' WHEN regexp_matches(tok, '\p{{Nd}}') THEN 'CLEAR' END"


@query(f"""WITH e AS (SELECT *, {S_CASE_EVENT} AS e FROM ({S_CASE_WORDS})), b AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT count(*) FILTER (label <> 'IGNORE') AS checked, count(*) FILTER (e = 'CONSUME' AND before = 'SET') AS after_end, count(*) FILTER (e = 'CONSUME' AND before = 'SET' AND label <> 'IGNORE') AS after_end_labelled, count(*) FILTER (label <> 'IGNORE' AND lower(translate({s_nfc('tok')}, 'İ', 'i')) <> tok) AS not_lower FROM b""")
def case_integrity(spark, d):
    flat = C.case_rows(table(spark, d, "wikipedia").select("article_id", X.normalize_for_inference(F.col("text")).alias("text")), "article_id")
    return corpus.integrity_of(flat.select(F.col("article_id").alias("id"), "pos", "tok", "label"))


# Metrics.
S_PRED = "SELECT id, source, tokens, labels, list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN tokens[i + 1] IS NULL OR regexp_matches(tokens[i + 1], '^\\p{Lu}') THEN CASE WHEN regexp_matches(tokens[i], '(?i)^(gelo|ma|kî|çi)') THEN 'QUESTION' ELSE 'PERIOD' END WHEN tokens[i + 1] IN ('ku', 'û', 'lê') THEN 'COMMA' ELSE 'O' END) AS pred FROM window_samples"


@query(f"""SELECT id, source, i - 1 AS token_index, array_to_string(tokens[greatest(1, i - 20):i - 1], ' ') || ' [' || tokens[i] || '] ' || array_to_string(tokens[i + 1:i + 20], ' ') AS context, labels[i] AS gold, pred[i] AS predicted, labels[i] || '_TO_' || pred[i] AS error_type FROM
(SELECT *, unnest(range(1, least(len(tokens), len(labels)) + 1)) AS i FROM ({S_PRED})) WHERE labels[i] <> pred[i] AND (labels[i] = 'QUESTION' OR pred[i] = 'QUESTION')""")
def error_contexts(spark, d):
    pred = lambda t, nx: F.when(nx.isNull() | nx.rlike(r"^\p{Lu}"), F.when(t.rlike("(?iu)^(gelo|ma|kî|çi)"), "QUESTION").otherwise("PERIOD")).when(nx.isin("ku", "û", "lê"), "COMMA").otherwise("O")
    rows = table(spark, d, "window_samples").select("id", "source", "tokens", "labels", F.transform("tokens", lambda t, i: pred(t, F.get("tokens", i + 1))).alias("pred"))
    return metrics.error_contexts(rows).withColumn("token_index", F.col("token_index").cast("long"))


S_PREDICTED = f"""SELECT labels[i] AS "true", ['O', 'COMMA', 'PERIOD', 'QUESTION', 'EXCLAMATION'][list_position(z, list_max(z))] AS pred FROM (SELECT labels, i, {s_logits(5)} AS z FROM (SELECT labels, coalesce(unnest(tokens), '') AS tok, generate_subscripts(tokens, 1) AS i FROM window_samples WHERE split = 'test' AND len(tokens) = len(labels)))"""


@query(f"""SELECT "true", pred, count(*) AS n FROM ({S_PREDICTED}) WHERE "true" IS NOT NULL GROUP BY ALL""")
def batch_evaluation(spark, d):
    rows = restoration.predicted(table(spark, d, "window_samples").where("split = 'test'").select("tokens", "labels"), restoration.stand_in(5), metrics.PUNCT).where("pred is not null")
    return metrics.confusion(rows.select(F.explode(F.arrays_zip(F.col("labels").alias("true"), "pred")).alias("x")).select("x.true", "x.pred"))


def s_report(pairs: str, labels: list[str], scored: list[str]) -> str:
    """(tokens, accuracy, macro_f1, micro_f1, weighted_f1) of pairs ("true", pred)."""
    values = ", ".join(f"('{x}')" for x in labels)
    on = f"label IN ({', '.join(map(q, scored))})"
    return f"""WITH c AS (SELECT "true", pred, count(*) AS n FROM ({pairs}) WHERE "true" IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
l AS (SELECT v.label, coalesce(sum(n) FILTER ("true" = v.label AND pred = v.label), 0) AS tp, coalesce(sum(n) FILTER ("true" <> v.label AND pred = v.label), 0) AS fp, coalesce(sum(n) FILTER ("true" = v.label AND pred <> v.label), 0) AS fn FROM (VALUES {values}) v(label) LEFT JOIN c ON true GROUP BY v.label)
SELECT sum(tp + fn)::BIGINT AS tokens, round(sum(tp)::DOUBLE / greatest(1, sum(tp + fn)), 6) AS accuracy, round(sum({s_f1('tp', 'fp', 'fn')}) FILTER ({on}) / {len(scored)}, 6) AS macro_f1,
 round({s_f1(f'sum(tp) FILTER ({on})', f'sum(fp) FILTER ({on})', f'sum(fn) FILTER ({on})')}, 6) AS micro_f1, round(coalesce(sum({s_f1('tp', 'fp', 'fn')} * (tp + fn)) / nullif(sum(tp + fn), 0), 0), 6) AS weighted_f1 FROM l"""


S_CASE_PAIRS = f"SELECT gold AS \"true\", CASE WHEN prot THEN 'KEEP' WHEN k = 3 AND c >= 0.85 THEN 'UPPER' WHEN k = 2 AND c >= 0.8 AND NOT start THEN 'TITLE' ELSE 'KEEP' END AS pred FROM ({S_CASES})"


@query(s_report(S_CASE_PAIRS, metrics.CASE, ["TITLE", "UPPER"]))
def case_metrics(spark, d):
    rows = _cases(spark, d).select(F.col("gold").alias("true"), metrics.decode_case(F.col("p"), F.col("prot"), F.col("start"))["label"].alias("pred"))
    return metrics.summary(metrics.confusion(rows), metrics.CASE, metrics.CASE[1:])


OLD = {"O": "0", "COMMA": ",", "PERIOD": ".", "QUESTION": "?", "EXCLAMATION": "."}
S_OLD_OF = lambda c: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OLD.items()) + " END"
S_OLD_PAIRS = f"""SELECT {S_OLD_OF('"true"')} AS "true", {S_OLD_OF('pred')} AS pred FROM {S_PAIRS}"""


def _old_pairs(spark, d) -> DataFrame:
    table_ = F.create_map(*(F.lit(x) for pair in OLD.items() for x in pair))
    return _pairs(spark, d).select(F.element_at(table_, F.col("true")).alias("true"), F.element_at(table_, F.col("pred")).alias("pred"))


@query(s_report(S_OLD_PAIRS, T.OLD_LABELS, T.OLD_LABELS[1:]))
def old_trainer_metrics(spark, d):
    return metrics.summary(metrics.confusion(_old_pairs(spark, d)), T.OLD_LABELS, T.OLD_LABELS[1:])


@query(f"""WITH c AS (SELECT "true", pred, count(*) AS n FROM ({S_OLD_PAIRS}) WHERE "true" IS NOT NULL GROUP BY ALL), l AS (SELECT v.label, coalesce(sum(n) FILTER ("true" = v.label AND pred = v.label), 0) AS tp, coalesce(sum(n) FILTER ("true" <> v.label AND pred = v.label), 0) AS fp, coalesce(sum(n) FILTER ("true" = v.label AND pred <> v.label), 0) AS fn FROM (VALUES {', '.join(f"('{x}')" for x in T.OLD_LABELS)}) v(label) LEFT JOIN c ON true GROUP BY v.label)
SELECT label, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({s_f1('tp', 'fp', 'fn')}, 6) AS f1, (tp + fn)::BIGINT AS support FROM l""")
def old_f1_report(spark, d):
    """The older report by label, with precision and recall the right way round."""
    return metrics.per_label(metrics.confusion(_old_pairs(spark, d)), T.OLD_LABELS).drop("tp", "fp", "fn")


# Windows by a real vocabulary: no SQL, as no SQL engine has it; tests hold them against the library itself.
@query()
def subword_training_windows(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", T.labelled(T.tokenize(X.normalize_for_dataset(F.col("text")))).alias("items"))
    return _labelled_windows(rows, subwords.word_costs(F.transform("items", lambda x: x["tok"])))


@query()
def subword_inference_windows(spark, d):
    return corpus.windows(_doc_tokens(spark, d), "doc_id", subwords.word_costs(F.col("items")), training=False).select("doc_id", "win", "start", "end")


@query()
def subword_lengths(spark, d):
    toks = _doc_tokens(spark, d)
    rows = toks.select(F.explode(F.arrays_zip("items", subwords.word_costs(F.col("items")).alias("pieces"))).alias("x")).select(F.col("x.items").alias("tok"), "x.pieces")
    return rows.groupBy("tok", "pieces").agg(F.count(F.lit(1)).alias("n"))
