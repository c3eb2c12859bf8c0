"""The engine's own queries over the tables of a data folder, and the same results in SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casing as C
from .functions import minhash
from .functions import text as X
from .functions import tokens as T
from .operators import corpus, curation, leakage, metrics, restoration, selection
from .plans.curation import curate
from .plans.storage import materialise, new_path
from .sources import readers, sinks
from .sources import tables
from .streaming import dedup as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


TEXTS = {"documents", "raw_records", "wikipedia", "accepted_records", "window_samples"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the folder; one with texts is spread over all cores if it is in few files."""
    df = tables.table(spark, d, name)
    return tables.spread(df) if name in TEXTS else df


# SQL pieces. Patterns are the same text as in the expressions.
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def s_strip(x: str) -> str:
    return rx(x, rf"^{X.WS}+|{X.WS}+$")


def s_nfc(x: str) -> str:
    return f"nfc_normalize({x})"


def s_collapse(x: str) -> str:
    return s_strip(rx(x, f"{X.WS}+", " "))


def s_ws(x: str) -> str:
    return s_strip(rx(rx(rx(x, r"\r\n|\r", "\n"), r"[ \t\x{0c}\x{0b}]+", " "), r"\n{3,}", "\n\n"))


def s_dataset(x: str) -> str:
    marks = "[" + "".join("\\" + c for c in X.STRIP_MARKS if c in "\"'()[]{}<>/:;") + "—–…«»“”]"
    return s_ws(rx(rx(s_nfc(x), r"\.\.\.|…", "."), marks, " "))


def s_tokens(x: str) -> str:
    return f"regexp_extract_all({s_nfc(x)}, {q(T.TOKEN)}, 1)"


def s_exact(x: str, quotes: bool = True) -> str:
    if not quotes:
        return s_collapse(s_nfc(x))
    t = s_strip(s_nfc(x))
    cls = "[\"'“”«»]"
    return s_collapse(f"(CASE WHEN length({t}) >= 2 AND regexp_matches(substr({t}, 1, 1), {q(cls)}) AND regexp_matches(right({t}, 1), {q(cls)}) THEN {s_strip(f'substr({t}, 2, length({t}) - 2)')} ELSE {t} END)")


def s_low(x: str) -> str:
    """Lower case where the dotted capital I gives two characters, as the engine and Unicode have it."""
    return f"lower(replace({x}, 'İ', 'i' || chr(775)))"


def s_nopunct(x: str, quotes: bool = True) -> str:
    return s_collapse(rx(s_low(s_exact(x, quotes)), "[,.?!;:…]+"))


def s_words(x: str, kind: str) -> str:
    return f"len(regexp_extract_all({x}, {q('[' + X.WORD_CLASSES[kind] + ']+')}))::BIGINT"


def s_count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(chars)}, '')))::BIGINT"


def s_letters(x: str) -> str:
    return rx(x, r"[^\p{L}]")


S_SCRIPT = f"""SELECT doc_id, n AS n_letters,
 round(CASE WHEN n = 0 THEN 1.0 ELSE (n - length({rx('l', '[' + X.ARABIC + ']')}))::DOUBLE / n END, 6) AS arabic_ratio,
 round(CASE WHEN n = 0 THEN 0.0 ELSE (n - length({rx('l', '[' + X.LATIN + ']')}))::DOUBLE / n END, 6) AS latin_ratio
FROM (SELECT doc_id, l, length(l)::BIGINT AS n FROM (SELECT doc_id, {s_letters('text')} AS l FROM documents WHERE text IS NOT NULL))"""

S_WORDS = f"""SELECT k, i, tok, nxt FROM (SELECT k, i, tok, lead(tok) OVER (PARTITION BY k ORDER BY i) AS nxt FROM
 (SELECT k, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT doc_id AS k, {s_tokens(s_dataset('text'))} AS t FROM documents WHERE text IS NOT NULL)))
 WHERE tok NOT IN (',', '.', '?', '!')"""
S_LABEL = "CASE nxt WHEN ',' THEN 'COMMA' WHEN '.' THEN 'PERIOD' WHEN '?' THEN 'QUESTION' WHEN '!' THEN 'EXCLAMATION' ELSE 'O' END"
S_LABELS = "(VALUES ('O'), ('COMMA'), ('PERIOD'), ('QUESTION'), ('EXCLAMATION')) v(label)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"""WITH w AS ({S_WORDS}), c AS (SELECT lang, {S_LABEL} AS label, count(*) AS n FROM w JOIN documents ON doc_id = k GROUP BY ALL)
SELECT g.lang, v.label, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT lang FROM documents WHERE text IS NOT NULL) g CROSS JOIN {S_LABELS}
LEFT JOIN c ON c.lang IS NOT DISTINCT FROM g.lang AND c.label = v.label""")
def label_distribution(spark, d):
    return corpus.label_counts(_docs(spark, d).where("text is not null").select("lang", "text"), "lang")


@query(f"SELECT article_id, {s_dataset('text')} AS text FROM wikipedia")
def normalize_text(spark, d):
    return table(spark, d, "wikipedia").select("article_id", X.normalize_for_dataset(F.col("text")).alias("text"))


@query(f"SELECT article_id, {s_ws(s_nfc('text'))} AS text, {rx(s_ws(s_nfc('text')), '[,.?!]')} AS bare FROM wikipedia")
def inference_text(spark, d):
    t = X.normalize_for_inference(F.col("text"))
    return table(spark, d, "wikipedia").select("article_id", t.alias("text"), F.regexp_replace(t, "[,.?!]", "").alias("bare"))


@query(f"SELECT record_id, landed_at, md5(array_to_string(t, '\t')) AS tokens, len(t)::BIGINT AS n, len(list_filter(t, lambda x: x NOT IN (',', '.', '?', '!')))::BIGINT AS words FROM (SELECT record_id, landed_at, {s_tokens('text')} AS t FROM raw_records WHERE text IS NOT NULL)")
def token_streams(spark, d):
    rows = table(spark, d, "raw_records").where("text is not null").select("record_id", "landed_at", T.tokenize(F.col("text")).alias("t"))
    return rows.select("record_id", "landed_at", F.md5(F.array_join("t", "\t")).alias("tokens"), F.size("t").cast("long").alias("n"), F.size(T.words_of(F.col("t"))).cast("long").alias("words"))


S_OLD = f"regexp_extract_all({s_nfc(s_strip('text'))}, {q(T.OLD_TOKEN)}, 1)"
S_OLD_MAP = "CASE coalesce(nxt, '') " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in T.OLD_MARKS.items()) + " ELSE '0' END"


@query(f"""WITH t AS (SELECT doc_id, {S_OLD} AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, tok, {S_OLD_MAP} AS label FROM (SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM t)) WHERE regexp_matches(tok, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) >= 3 AND count(*) FILTER (label <> '0') > 0)
SELECT label, count(*) AS n FROM f JOIN k USING (doc_id) GROUP BY label""")
def old_label_distribution(spark, d):
    rows = _docs(spark, d).where("text is not null").select(F.explode(T.old_labelled(F.col("text"))).alias("x"))
    return rows.groupBy(F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(S_SCRIPT)
def script_stats(spark, d):
    s = X.script_stats(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", s["n_letters"].alias("n_letters"), F.round(s["arabic_ratio"], 6).alias("arabic_ratio"), F.round(s["latin_ratio"], 6).alias("latin_ratio"))


@query(f"""SELECT source, sum({s_count('text', X.KURMANJI_LETTERS)})::BIGINT AS kurmanji, sum({s_count('text', X.TURKISH_LETTERS)})::BIGINT AS turkish, sum({s_count('text', '?')})::BIGINT AS questions,
 sum({s_words('text', 'filter')})::BIGINT AS words_filter, sum({s_words('text', 'review')})::BIGINT AS words_review, sum({s_words('text', 'build')})::BIGINT AS words_build FROM raw_records WHERE text IS NOT NULL GROUP BY source""")
def character_counts(spark, d):
    t = F.col("text")
    aggs = [F.sum(X.count_of(t, c)).alias(n) for n, c in (("kurmanji", X.KURMANJI_LETTERS), ("turkish", X.TURKISH_LETTERS), ("questions", "?"))]
    aggs += [F.sum(X.word_count(t, k)).alias(f"words_{k}") for k in ("filter", "review", "build")]
    return table(spark, d, "raw_records").where("text is not null").groupBy("source").agg(*aggs)


@query(f"""SELECT article_id, len(s)::BIGINT AS spans, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest, md5(array_to_string(s, '|')) AS hash FROM
(SELECT article_id, list_filter(list_transform(regexp_extract_all(text, '([^.?!]*[.?!]|[^.?!]+)', 1), lambda x: {s_strip('x')}), lambda x: x <> '') AS s FROM wikipedia WHERE text IS NOT NULL)""")
def sentence_spans(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", X.sentence_spans(F.col("text")).alias("s"))
    return rows.select("article_id", F.size("s").cast("long").alias("spans"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join("s", "|")).alias("hash"))


S_CAPS = "A-ZÇÊÎŞÛ"
S_PARAS = f"""SELECT article_id, unnest(string_split({rx(rx("text", r"\n{2,}", chr(1)), f"\\n([{S_CAPS}])", chr(1) + r"\1")}, chr(1))) AS p FROM wikipedia WHERE text IS NOT NULL"""
# A mark, blanks, and what begins a sentence: the place between is marked, as no engine's look-around is at hand.
S_PIECES = f"""SELECT article_id, p, list_filter(list_transform(string_split({rx("p", rf"([.!?…]){X.WS}+([" + chr(34) + "'«]?[A-ZÇÊÎŞÛÁÉÍÓÚÄËÖÜ])", r"\1" + chr(1) + r"\2")}, chr(1)), lambda x: {s_strip("x")}), lambda x: length(x) >= 8) AS s FROM (SELECT article_id, {s_collapse("p")} AS p FROM ({S_PARAS})) WHERE p <> ''"""


@query(f"SELECT article_id, unnest(CASE WHEN len(s) > 0 THEN s WHEN length(p) >= 8 THEN [p] ELSE [] END) AS sentence FROM ({S_PIECES})")
def soft_sentences(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", F.explode(X.paragraphs(F.col("text"))).alias("p"))
    return rows.select("article_id", F.explode(X.soft_sentences(F.col("p"))).alias("sentence"))


def s_markup(x: str) -> str:
    t = rx(rx(rx(x, r"\{\{[^{}]*\}\}", " "), r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1"), "<[^>]+>", " ")
    t = f"replace(replace({rx(rx(t, chr(39) + '{2,}'), '={2,}', ' ')}, '&nbsp;', ' '), '&amp;', '&')"
    return s_collapse(rx(rx(t, rf"\[https?://[^\]{X.SP}]+{X.WS}+([^\]]+)\]", r"\1"), rf"https?://{X.NWS}+", " "))


@query(f"SELECT doc_id, {s_markup('text')} AS plain FROM documents")
def plain_text(spark, d):
    return _docs(spark, d).select("doc_id", X.strip_markup(F.col("text")).alias("plain"))


S_TOKS = f"SELECT DISTINCT tok FROM (SELECT unnest({s_tokens('text')}) AS tok FROM documents WHERE text IS NOT NULL)"


def s_title(x: str) -> str:
    p = [f"regexp_extract({x}, {q(r'(?s)^([^\p{L}]*)(\p{L})(.*)$')}, {i})" for i in (1, 2, 3)]
    return f"(CASE WHEN regexp_matches({x}, '\\p{{L}}') THEN {p[0]} || upper({p[1]}) || lower(translate({p[2]}, 'İ', 'i')) ELSE {x} END)"


S_L = s_letters("tok")
S_UPPER = f"(length({S_L}) >= 2 AND upper(lower({S_L})) = {S_L})"
S_TITLE = f"(length({S_L}) >= 1 AND upper(lower(substr({S_L}, 1, 1))) = substr({S_L}, 1, 1) AND lower(substr({S_L}, 2)) = substr({S_L}, 2))"
S_LOWER = f"(length({S_L}) >= 1 AND lower({S_L}) = {S_L})"
S_SHAPE = f"CASE WHEN {S_L} = '' THEN 'NONE' WHEN {S_UPPER} THEN 'UPPER' WHEN {S_TITLE} THEN 'TITLE' WHEN {S_LOWER} THEN 'LOWER' ELSE 'MIXED' END"
S_PROTECTED = r"(tok IN (',', '.', '?', '!') OR regexp_matches(tok, '(?i)^https?://') OR regexp_matches(tok, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR regexp_matches(tok, '^[\p{Nd}.,]*\p{Nd}[\p{Nd}.,]*$') OR regexp_matches(tok, '\[\[|\]\]|\{\{|\}\}|={2,}|__+|</?[a-zA-Z]+>'))"
S_CASE = f"CASE WHEN {S_PROTECTED} OR NOT regexp_matches(tok, {q('^[' + T.LETTER + '0-9' + chr(39) + '’' + chr(92) + '-]+$')}) OR ({S_SHAPE}) IN ('NONE', 'MIXED') THEN 'IGNORE' WHEN {S_UPPER} THEN 'UPPER' WHEN {S_TITLE} AND length({S_L}) >= 2 THEN 'TITLE' WHEN {S_LOWER} THEN 'KEEP' ELSE 'IGNORE' END"


@query(f"SELECT tok, lower(translate(tok, 'İ', 'i')) AS low, replace(upper(tok), 'ẞ', 'SS') AS up, {s_title('tok')} AS title, {S_SHAPE} AS shape, {S_CASE} AS label, {S_PROTECTED} AS protected FROM ({S_TOKS})")
def case_images(spark, d):
    t = F.col("tok")
    toks = _docs(spark, d).select(F.explode(T.tokenize(F.col("text"))).alias("tok")).distinct()
    return toks.select("tok", C.lower(t).alias("low"), C.upper(t).alias("up"), C.title(t).alias("title"), C.shape(t).alias("shape"), C.case_label(t).alias("label"), T.is_protected(t).alias("protected"))


S_SKIP = ", ".join(q(c) for c in C.SKIP)
S_EVENTS = f"""SELECT k, i, tok, CASE WHEN tok IN ('.', '?', '!') THEN 'SET' WHEN tok IN ({S_SKIP}) THEN NULL WHEN regexp_matches(tok, '\\p{{L}}') THEN 'CONSUME' WHEN regexp_matches(tok, '\\p{{Nd}}') THEN 'CLEAR' END AS e
 FROM (SELECT k, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT article_id AS k, {s_tokens('text')} AS t FROM wikipedia WHERE text IS NOT NULL))"""


@query(f"""SELECT k AS article_id, count(*)::BIGINT AS tokens, count(*) FILTER (e = 'CONSUME' AND coalesce(b, 'SET') = 'SET')::BIGINT AS starts FROM
(SELECT k, e, last_value(e IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({S_EVENTS})) GROUP BY k""")
def sentence_starts(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "tok"))
    return C.mark_starts(rows, "article_id").groupBy("article_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("start").alias("starts"))


@query(f"SELECT record_id, landed_at, sha256({s_exact('text')}) AS exact, sha256({s_low(s_exact('text', False))}) AS low, sha256({s_nopunct('text')}) AS nopunct FROM raw_records WHERE text IS NOT NULL")
def hash_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "raw_records").where("text is not null").select("record_id", "landed_at", X.sha256(X.exact_key(t)).alias("exact"), X.sha256(X.lower_key(t)).alias("low"), X.sha256(X.nopunct_key(t)).alias("nopunct"))


S_CTX = s_collapse(s_nfc("text"))


@query(f"""SELECT record_id, landed_at, CASE WHEN length(t) <= 1200 THEN t WHEN p = 0 THEN substr(t, 1, 1200) ELSE {s_strip('substr(t, greatest(0, p - 601) + 1, 1200)')} END AS context FROM
(SELECT record_id, landed_at, t, strpos(t, '?') AS p FROM (SELECT record_id, landed_at, {S_CTX} AS t FROM raw_records))""")
def question_contexts(spark, d):
    return table(spark, d, "raw_records").select("record_id", "landed_at", X.question_context(F.col("text")).alias("context"))


S_BARE = rx("text", "(?i)" + X.URL, " ")
S_N = f"length({s_letters('text')})"
S_REASON = f"""CASE WHEN text IS NULL OR {s_strip('text')} = '' THEN 'empty' WHEN {S_N} = 0 THEN 'no_letters'
 WHEN ({S_N} - length({rx(s_letters('text'), '[' + X.ARABIC + ']')}))::DOUBLE / {S_N} > 0.01 THEN 'arabic_script'
 WHEN ({S_N} - length({rx(s_letters('text'), '[' + X.LATIN + ']')}))::DOUBLE / {S_N} < 0.80 THEN 'low_latin_ratio'
 WHEN NOT contains(text, '?') THEN 'no_question_mark' WHEN NOT contains({S_BARE}, '?') THEN 'question_mark_only_in_url'
 WHEN regexp_matches({s_strip(S_BARE)}, {q(f'^[?{X.SP}]+$')}) THEN 'only_question_marks' WHEN contains(text, '???') THEN 'triple_question_marks'
 WHEN regexp_matches(text, '\\{{\\{{[^}}]+\\}}\\}}|\\[\\[[^\\]]+\\]\\]') AND {s_words('text', 'filter')} < 5 AND contains(text, '{{{{') THEN 'wiki_template'
 WHEN {s_words('text', 'filter')} < 5 THEN 'too_short' END"""


@query(f"SELECT record_id, landed_at, {S_REASON} AS reason FROM raw_records")
def reject_reasons(spark, d):
    return table(spark, d, "raw_records").select("record_id", "landed_at", curation.reject_reason(F.col("text")).alias("reason"))


@query(f"""WITH r AS (SELECT source, coalesce({S_REASON}, 'accepted') AS reason FROM raw_records)
SELECT level, source, reason, n FROM (SELECT grouping(source, reason)::BIGINT AS level, source, reason, count(*) AS n FROM r GROUP BY GROUPING SETS ((source), (reason), ()))""")
def filter_statistics(spark, d):
    rows = table(spark, d, "raw_records").select("source", F.coalesce(curation.reject_reason(F.col("text")), F.lit("accepted")).alias("reason"))
    return curation.filter_statistics(rows)


S_HITS = [(n, f"regexp_matches(text, {q('(?i)' + curation.EDGE_L + p + curation.EDGE_R)})") for n, p in curation.MARKERS.items()] + [("MA", f"regexp_matches(text, {q('(?i)' + '|'.join(curation.MA))})")]


@query(f"""SELECT record_id, landed_at, CASE WHEN {' + '.join(f'({h})::INT' for _, h in S_HITS)} > 1 THEN 'MULTIPLE_QUESTION' {' '.join(f"WHEN {h} THEN '{n}'" for n, h in S_HITS)} WHEN contains(text, '?') THEN 'YES_NO' ELSE 'OTHER' END AS kind FROM raw_records WHERE text IS NOT NULL""")
def question_types(spark, d):
    return table(spark, d, "raw_records").where("text is not null").select("record_id", "landed_at", curation.question_type(F.col("text")).alias("kind"))


S_T = "coalesce(text, '')"
S_AR = f"coalesce((length({s_letters(S_T)}) - length({rx(s_letters(S_T), '[' + chr(92) + 'x{600}-' + chr(92) + 'x{6FF}]')}))::DOUBLE / nullif(length({s_letters(S_T)}), 0), 0)"
S_LA = f"coalesce((length({s_letters(S_T)}) - length({rx(s_letters(S_T), '[A-Za-zÀ-öø-ÿçêîşûÇÊÎŞÛ]')}))::DOUBLE / nullif(length({s_letters(S_T)}), 0), 0)"


@query(f"""WITH b AS (SELECT record_id, source, coalesce(source = 'tatoeba', false) AS short, {S_AR} <= 0.01 AND {S_LA} >= 0.85 AS lang, {s_count(S_T, X.KURMANJI_LETTERS)} AS kmr, {s_count(S_T, X.TURKISH_LETTERS)} >= 5 AS tr,
 {s_count(S_T, '?')} AS qm, {s_count(S_T, '.!')} AS other, {s_words(S_T, 'review')} AS n, NOT contains({S_T}, '???') AS no3, NOT regexp_matches({S_T}, {q(curation.MOJIBAKE)}) AS enc,
 coalesce(length(license) > 0, false) AND (coalesce(length(source_document_id) > 0, false) OR coalesce(length(source_url) > 0, false)) AS lic FROM accepted_records),
c AS (SELECT *, lang AND (kmr >= 1 OR short) AS kur, qm >= 1 AND no3 AS marks, CASE WHEN short THEN n >= 5 ELSE other + qm >= 2 OR n >= 20 END AS ctx FROM b)
SELECT record_id, source, lang AS language_ok, kur AND NOT tr AS kurmanji_ok, marks AS punctuation_ok, marks AND n >= 5 AS question_is_real, ctx AS context_ok, enc AS encoding_ok, lic AS license_metadata_ok, kur AND NOT tr AND marks AND n >= 5 AND ctx AND enc AND (lic OR short) AS accept,
 array_to_string(list_filter([CASE WHEN NOT lang THEN 'language' END, CASE WHEN NOT kur THEN 'kurmanji' END, CASE WHEN NOT marks THEN 'punct' END, CASE WHEN NOT (marks AND n >= 5) THEN 'not_question' END, CASE WHEN NOT ctx THEN 'context' END, CASE WHEN NOT enc THEN 'encoding' END, CASE WHEN tr THEN 'turkish_heavy' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def record_checks(spark, d):
    return curation.checks(table(spark, d, "accepted_records"))


S_BOOL = lambda c: f"CASE WHEN lower({s_strip(c)}) IN ('1', 'true', 'yes', 'y', 'accept', 'ok') THEN true WHEN lower({s_strip(c)}) IN ('0', 'false', 'no', 'n', 'reject') THEN false END"
REVIEW = ["language_ok", "kurmanji_ok", "punctuation_ok", "question_is_real", "context_ok", "encoding_ok", "license_metadata_ok", "accept"]


@query(f"SELECT source, count(*) AS n, {', '.join(f'round(avg(({S_BOOL(c)})::INT), 6) AS {c}_rate' for c in REVIEW)} FROM manual_review GROUP BY source")
def review_rates(spark, d):
    rows = table(spark, d, "manual_review").select("source", *(X.as_bool(F.col(c)).alias(c) for c in REVIEW))
    return curation.rates(rows, REVIEW, "source")


@query(f"""SELECT count(*) AS n, count(*) FILTER (a.verified_language = b)::BIGINT AS agree FROM (SELECT record_id, {S_BOOL('language_ok')} AS b FROM manual_review) m
JOIN (SELECT record_id, bool_or(verified_language) AS verified_language FROM accepted_records GROUP BY record_id) a USING (record_id) WHERE b IS NOT NULL""")
def review_agreement(spark, d):
    m = table(spark, d, "manual_review").select("record_id", X.as_bool(F.col("language_ok")).alias("b")).where("b is not null")
    a = table(spark, d, "accepted_records").groupBy("record_id").agg(F.bool_or("verified_language").alias("v"))
    return m.join(a, "record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == F.col("b")).alias("agree"))


def s_groups(key: str) -> str:
    return f"SELECT sha256(k) AS key, min(landed_at) AS first, count(*) AS n FROM (SELECT {key} AS k, landed_at FROM raw_records WHERE text IS NOT NULL) GROUP BY k HAVING count(*) > 1"


@query(s_groups(s_exact("text")))
def exact_groups(spark, d):
    g = curation.first_by(table(spark, d, "raw_records").where("text is not null"), X.exact_key(F.col("text")), F.col("landed_at"))
    return g.where("n > 1").select(X.sha256(F.col("key")).alias("key"), "first", "n")


@query(s_groups(s_nopunct("text")))
def nopunct_groups(spark, d):
    g = curation.first_by(table(spark, d, "raw_records").where("text is not null"), X.nopunct_key(F.col("text")), F.col("landed_at"))
    return g.where("n > 1").select(X.sha256(F.col("key")).alias("key"), "first", "n")


def s_sig(key: str, ids: str, source: str, short: bool = True) -> str:
    few = "[t]" if short else "[]::VARCHAR[]"
    return f"""SELECT {ids}, CASE WHEN count(x) = 0 THEN list_transform(range(64), lambda k: 0::BIGINT) ELSE [{', '.join(f'min(((2 * {k} + 1) * x + {k} * 2654435769) % 4294967296)' for k in range(64))}] END AS sig
 FROM (SELECT {ids}, ('0x' || substr(md5(g), 1, 8))::BIGINT AS x FROM (SELECT {ids}, unnest(CASE WHEN len(gs) = 0 THEN [NULL] ELSE gs END) AS g FROM (SELECT {ids}, list_distinct(CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) WHEN t = '' THEN []::VARCHAR[] ELSE {few} END) AS gs FROM (SELECT {ids}, {key} AS t FROM {source})))) GROUP BY {ids}"""


@query(f"SELECT doc_id, array_to_string(sig, ',') AS sig FROM ({s_sig(s_nopunct('text'), 'doc_id', '(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)')})")
def minhash_signatures(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.array_join(minhash.signature(X.nopunct_key(F.col("text"))).cast("array<string>"), ",").alias("sig"))


S_SIGS = f"SELECT doc_id, source, bucket, sig FROM ({s_sig(s_nopunct('text'), 'doc_id, source, bucket', f'(SELECT doc_id, source, {s_words(chr(116) + chr(101) + chr(120) + chr(116), chr(102) + chr(105) + chr(108) + chr(116) + chr(101) + chr(114))} // 20 AS bucket, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)')})"
S_EQUAL = " + ".join(f"(a.sig[{k}] = b.sig[{k}])::INT" for k in range(1, 65))


def _signed(spark, d) -> DataFrame:
    t = F.col("text")
    rows = _docs(spark, d).where("text is not null and source is not null").select(F.col("doc_id").alias("id"), "source", (X.word_count(t) / 20).cast("long").alias("bucket"), minhash.signature(X.nopunct_key(t)).alias("sig"))
    return materialise(rows, "signatures")


@query(f"WITH s AS ({S_SIGS}) SELECT id_a, id_b, equal FROM (SELECT a.doc_id AS id_a, b.doc_id AS id_b, ({S_EQUAL})::INT AS equal FROM s a JOIN s b ON a.source = b.source AND a.bucket = b.bucket AND a.doc_id < b.doc_id) WHERE equal >= 58")
def near_pairs(spark, d):
    s = _signed(spark, d)
    return minhash.near_pairs(s, s, extra=("source", "bucket")).where("id_a < id_b")


@query(f"WITH s AS ({S_SIGS}) SELECT id_a, id_b, equal FROM (SELECT a.doc_id AS id_a, b.doc_id AS id_b, ({S_EQUAL})::INT AS equal FROM s a JOIN s b ON a.doc_id < b.doc_id) WHERE equal >= 58")
def near_pairs_anywhere(spark, d):
    s = _signed(spark, d).select("id", "sig")
    return minhash.near_pairs(s, s).where("id_a < id_b")


S_CUT = f"CASE WHEN length(t) <= 1200 THEN t WHEN p = 0 THEN substr(t, 1, 1200) ELSE {s_strip('substr(t, greatest(0, p - 601) + 1, 1200)')} END"
# The sequential rule: the records that pass the tests, in order, each against the list of those accepted before.
S_CURATED = f"""WITH RECURSIVE c AS (SELECT pos, record_id, source, {S_CUT} AS text FROM (SELECT pos, record_id, source, t, strpos(t, '?') AS p FROM (SELECT row_number() OVER (ORDER BY landed_at NULLS FIRST, record_id NULLS FIRST, source NULLS FIRST, text NULLS FIRST) AS pos, record_id, source, {S_CTX} AS t FROM (SELECT DISTINCT record_id, source, text, landed_at FROM raw_records)))),
f AS MATERIALIZED (SELECT *, {S_REASON} AS reason FROM c),
k AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY pos) AS r, coalesce(source, '') AS src, {s_words('text', 'filter')} // 20 AS bucket, {s_exact('text')} AS e, {s_nopunct('text')} AS n, text FROM f WHERE reason IS NULL),
s AS MATERIALIZED (SELECT pos, src, bucket, sig FROM ({s_sig('n', 'pos, src, bucket', 'k')})),
nb AS MATERIALIZED (SELECT b.pos, a.pos AS other, CASE WHEN a.e = b.e THEN 1 WHEN a.n = b.n THEN 2 ELSE 3 END AS kind FROM k a JOIN k b ON a.pos < b.pos AND a.n = b.n
 UNION ALL SELECT b.pos, a.pos, 3 FROM s a JOIN s b ON a.src = b.src AND a.bucket = b.bucket AND a.pos < b.pos AND {S_EQUAL} >= 58),
l AS MATERIALIZED (SELECT r, k.pos, list(DISTINCT other) FILTER (other IS NOT NULL) AS others FROM k LEFT JOIN nb USING (pos) GROUP BY ALL),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS ok UNION ALL SELECT l.r, CASE WHEN list_has_any(g.ok, coalesce(l.others, []::BIGINT[])) THEN g.ok ELSE list_append(g.ok, l.pos) END FROM g JOIN l ON l.r = g.r + 1),
a AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY pos) AS number FROM (SELECT unnest(ok) AS pos FROM (SELECT ok FROM g ORDER BY r DESC LIMIT 1))),
d AS MATERIALIZED (SELECT nb.pos, min(kind) AS kind FROM nb JOIN a ON a.pos = nb.other WHERE nb.pos NOT IN (SELECT pos FROM a) GROUP BY nb.pos),
o AS (SELECT f.*, number, coalesce(reason, CASE d.kind WHEN 1 THEN 'exact_duplicate' WHEN 2 THEN 'punctuation_only_duplicate' WHEN 3 THEN 'near_duplicate' END) AS reject_reason FROM f LEFT JOIN a USING (pos) LEFT JOIN d USING (pos))"""
S_KIND = f"CASE WHEN {' + '.join(f'({h})::INT' for _, h in S_HITS)} > 1 THEN 'MULTIPLE_QUESTION' {' '.join(f"WHEN {h} THEN '{n}'" for n, h in S_HITS)} WHEN contains(text, '?') THEN 'YES_NO' ELSE 'OTHER' END"


@query(f"""{S_CURATED} SELECT CASE WHEN number IS NOT NULL THEN 'v2q_' || lpad(number::VARCHAR, 6, '0') END AS accepted_id, record_id, source, text, reject_reason, {s_count('text', '?')} AS question_count, {s_words('text', 'filter')} AS word_count,
 {S_KIND} AS question_type, {s_count('text', X.KURMANJI_LETTERS)} AS kmr_special_char_count, {s_count('text', X.TURKISH_LETTERS)} >= 3 AS turkish_review_flag, pos FROM o""")
def curated_records(spark, d):
    return curate(table(spark, d, "raw_records"))


@query(f"{S_CURATED} SELECT grouping(source, reason)::BIGINT AS level, source, reason, count(*) AS n FROM (SELECT source, coalesce(reject_reason, 'accepted') AS reason FROM o) GROUP BY GROUPING SETS ((source), (reason), ())")
def curation_funnel(spark, d):
    return curation.filter_statistics(curate(table(spark, d, "raw_records")).select("source", F.coalesce("reject_reason", F.lit("accepted")).alias("reason")))


S_TRAIN = "(SELECT DISTINCT record_id AS id, text FROM raw_records WHERE text IS NOT NULL)"
S_REFS = "(SELECT record_id AS id, text FROM accepted_records WHERE split <> 'train' AND text IS NOT NULL)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Raw records, and the accepted records that are held out; most of these were raw records once."""
    refs = table(spark, d, "accepted_records").where("split <> 'train'").select(F.col("record_id").alias("id"), "text")
    return table(spark, d, "raw_records").select(F.col("record_id").alias("id"), "text").distinct(), refs


def s_leak(key: str) -> str:
    return f"SELECT t.id, r.ref_id FROM (SELECT id, {key} AS k FROM {S_TRAIN}) t JOIN (SELECT {key} AS k, max(id) AS ref_id FROM {S_REFS} GROUP BY 1) r USING (k)"


@query(s_leak(s_exact("text", False)))
def leak_exact(spark, d):
    return leakage.key_hits(*_sides(spark, d), "exact")


@query(s_leak(s_low(s_exact("text", False))))
def leak_lower(spark, d):
    return leakage.key_hits(*_sides(spark, d), "lower")


@query(s_leak(s_nopunct("text", False)))
def leak_nopunct(spark, d):
    return leakage.key_hits(*_sides(spark, d), "nopunct")


def s_spans(source: str, stride: str) -> str:
    w = f"regexp_extract_all(lower({s_nfc('text')}), '([\\p{{L}}\\p{{N}}_]+)', 1)"
    return " UNION ".join(f"SELECT id, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - {n - 1} + 1, {stride if stride != 'half' else n // 2})) AS i FROM (SELECT id, {w} AS w FROM {source}) WHERE len(w) >= {n})" for n in leakage.SPANS)


@query(f"SELECT DISTINCT id FROM ({s_spans(S_TRAIN, 'half')}) WHERE s IN (SELECT s FROM ({s_spans(S_REFS, 'half')}))")
def leak_spans(spark, d):
    return leakage.span_hits(*_sides(spark, d))


@query(f"SELECT DISTINCT id FROM ({s_spans(S_TRAIN, '1')}) WHERE s IN (SELECT s FROM ({s_spans(S_REFS, 'half')}))")
def leak_spans_dense(spark, d):
    return leakage.span_hits(*_sides(spark, d), train_stride=1)


@query(f"""WITH t AS ({s_sig(s_nopunct('text', False), 'id, text', S_TRAIN, False)}), r AS ({s_sig(s_nopunct('text', False), 'id, text', S_REFS, False)})
SELECT a.id, min(b.id) AS ref_id FROM t a JOIN r b ON {S_EQUAL} >= 58 GROUP BY a.id""")
def leak_near(spark, d):
    return leakage.near_hits(*_sides(spark, d))


S_NEAR = f"""SELECT a.id, min(b.id) AS ref_id FROM t a JOIN r b ON {S_EQUAL} >= 58 GROUP BY a.id"""
S_KINDS = " UNION ".join(f"SELECT id, '{k}' AS kind FROM ({s_leak(x)})" for k, x in (("exact", s_exact("text", False)), ("lower", s_low(s_exact("text", False))), ("nopunct", s_nopunct("text", False))))


@query(f"""WITH k AS ({S_KINDS} UNION SELECT DISTINCT id, 'span' FROM ({s_spans(S_TRAIN, 'half')}) WHERE s IN (SELECT s FROM ({s_spans(S_REFS, 'half')}))),
t AS ({s_sig(s_nopunct('text', False), 'id, text', f'(SELECT * FROM {S_TRAIN} WHERE id NOT IN (SELECT id FROM k))', False)}), r AS ({s_sig(s_nopunct('text', False), 'id, text', S_REFS, False)}),
h AS (SELECT * FROM k UNION SELECT id, 'near' FROM ({S_NEAR})) SELECT id, string_agg(kind, ',' ORDER BY kind) AS reasons FROM (SELECT DISTINCT id, kind FROM h) GROUP BY id""")
def leak_report(spark, d):
    train, refs = _sides(spark, d)
    return leakage.leaked(train, refs)


@query(f"SELECT record_id, md5(text) AS text FROM raw_records WHERE record_id NOT IN (SELECT t.id FROM ({s_leak(s_exact('text', False))}) t)")
def clean_records(spark, d):
    """The records without those that leak, through the sink that rewrites a table."""
    hits = leakage.key_hits(*_sides(spark, d), "exact").select(F.col("id").alias("record_id"))
    path = new_path(spark, "clean")
    sinks.without_ids(table(spark, d, "raw_records").select("record_id", "text"), hits, "record_id", path)
    return readers.json_lines(spark, path, "record_id string, text string").select("record_id", F.md5("text").alias("text"))


S_KEY = "sha256(lower(array_to_string(tokens, ' ')))"


@query(f"SELECT id, split FROM window_samples WHERE split <> 'train' AND {S_KEY} NOT IN (SELECT {S_KEY} FROM window_samples WHERE split = 'train')")
def fresh_windows(spark, d):
    w = table(spark, d, "window_samples")
    return leakage.fresh_windows(w.where("split <> 'train'"), w.where("split = 'train'")).select("id", "split")


@query(f"""WITH v AS (SELECT DISTINCT split, {S_KEY} AS v FROM window_samples), s AS (SELECT DISTINCT split FROM window_samples WHERE split IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, (SELECT count(*) FROM v x JOIN v y ON x.v = y.v WHERE x.split = a.split AND y.split = b.split)::BIGINT AS shared FROM s a JOIN s b ON a.split < b.split""")
def split_overlap_texts(spark, d):
    return corpus.overlap_counts(table(spark, d, "window_samples"), leakage.token_key(F.col("tokens")))


@query("""WITH v AS (SELECT DISTINCT split, article_id AS v FROM window_samples), s AS (SELECT DISTINCT split FROM v)
SELECT a.split AS split_a, b.split AS split_b, (SELECT count(*) FROM v x JOIN v y ON x.v = y.v WHERE x.split = a.split AND y.split = b.split)::BIGINT AS shared FROM s a JOIN s b ON a.split < b.split""")
def split_overlap_articles(spark, d):
    return corpus.overlap_counts(table(spark, d, "window_samples"), F.col("article_id"))


@query("SELECT article_id, count(DISTINCT split)::BIGINT AS splits FROM window_samples WHERE article_id IS NOT NULL GROUP BY article_id HAVING count(DISTINCT split) > 1")
def split_violations(spark, d):
    return corpus.shared_ids(table(spark, d, "window_samples").where("article_id is not null"), "article_id")


@query("SELECT article_id, md5(text) AS text FROM wikipedia WHERE article_id IN (SELECT article_id FROM window_samples WHERE split = 'test')")
def articles_of_split(spark, d):
    keep = table(spark, d, "window_samples").where("split = 'test'").select("article_id")
    return table(spark, d, "wikipedia").join(keep, "article_id", "left_semi").select("article_id", F.md5("text").alias("text"))


@query("""SELECT side, count(*) AS n FROM (SELECT CASE WHEN m.record_id IS NULL THEN 'left' WHEN a.record_id IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT record_id FROM accepted_records WHERE record_id IS NOT NULL) a
FULL JOIN (SELECT DISTINCT record_id FROM manual_review WHERE record_id IS NOT NULL) m USING (record_id)) GROUP BY side""")
def review_sides(spark, d):
    return leakage.sides(table(spark, d, "accepted_records"), table(spark, d, "manual_review"), "record_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT split, lower(tok) AS form FROM (SELECT split, unnest(tokens) AS tok FROM window_samples) WHERE regexp_matches(tok, '^\\p{Lu}\\p{Ll}+$')),
n AS (SELECT form, count(*) FILTER (split = 'train') AS na, count(*) FILTER (split = 'test') AS nb FROM t GROUP BY form)
SELECT count(*) AS distinct_b, count(*) FILTER (na > 0)::BIGINT AS shared, coalesce(sum(nb), 0)::BIGINT AS mass_b, coalesce(sum(nb) FILTER (na > 0), 0)::BIGINT AS shared_mass, round(coalesce(sum(nb) FILTER (na > 0), 0)::DOUBLE / sum(nb), 6) AS share FROM n WHERE nb > 0""")
def title_vocabulary(spark, d):
    toks = table(spark, d, "window_samples").select("split", F.explode("tokens").alias("tok")).where(F.col("tok").rlike(r"^\p{Lu}\p{Ll}+$"))
    return leakage.vocabulary_overlap(toks)


@query("SELECT form, n FROM (SELECT lower(tok) AS form, count(*) AS n FROM (SELECT unnest(tokens) AS tok FROM window_samples) GROUP BY 1 HAVING count(*) >= 5) ORDER BY n DESC, form LIMIT 30")
def frequent_tokens(spark, d):
    n = table(spark, d, "window_samples").select(F.explode("tokens").alias("tok")).groupBy(F.lower("tok").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return n.where("n >= 5").orderBy(F.desc("n"), "form").limit(30)


def s_stats(label: str) -> str:
    return f"""SELECT split, count(*) AS windows, sum(n)::BIGINT AS labels, count(*) FILTER (l)::BIGINT AS on_last, count(*) FILTER (n = 0)::BIGINT AS none, count(*) FILTER (n = 1)::BIGINT AS one, count(*) FILTER (n > 1)::BIGINT AS more,
 round(coalesce(count(*) FILTER (l)::DOUBLE / nullif(sum(n), 0), 0), 6) AS fraction_last FROM (SELECT split, len(list_filter(labels, lambda x: x = '{label}')) AS n, coalesce(labels[-1] = '{label}', false) AS l FROM window_samples WHERE len(labels) > 0) GROUP BY split"""


@query(s_stats("PERIOD"))
def period_windows(spark, d):
    return corpus.window_statistics(table(spark, d, "window_samples"))


@query(s_stats("QUESTION"))
def question_windows(spark, d):
    return corpus.window_statistics(table(spark, d, "window_samples"), "QUESTION")


@query("SELECT n AS windows, f::BIGINT AS flagged, round(f::DOUBLE / n, 6) AS share, round(2.0 * f / (2.0 * f + n - f), 6) AS weighted_share FROM (SELECT count(*) AS n, count(*) FILTER (has_question) AS f FROM window_samples WHERE split = 'train')")
def question_share(spark, d):
    return corpus.weighted_share(table(spark, d, "window_samples").where("split = 'train'"), "has_question")


def s_uniform(*key: str) -> str:
    return f"(('0x' || substr(md5('42:' || {" || ':' || ".join(key)}), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH w AS (SELECT id, max(CASE WHEN has_question THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM window_samples WHERE split = 'train' AND id IS NOT NULL GROUP BY id), c AS (SELECT id, w, sum(w) OVER (ORDER BY id) AS upto, sum(w) OVER () AS total FROM w),
p AS (SELECT draw, {s_uniform('draw::VARCHAR')} * (SELECT max(total) FROM c) AS x FROM range(1, 1001) r(draw)) SELECT id, draw FROM p JOIN c ON x >= upto - w AND x < upto""")
def weighted_draws(spark, d):
    w = table(spark, d, "window_samples").where("split = 'train'").select("id", F.when(F.coalesce("has_question", F.lit(False)), 2.0).otherwise(1.0).alias("w"))
    return corpus.drawn(w, "id", "w", 1000)


# Predictions for the metrics come from a rule over the tokens: a capital after a word ends a sentence.
S_PAIRS = """(SELECT source, split, labels[i] AS "true", CASE WHEN tokens[i + 1] IS NULL OR regexp_matches(tokens[i + 1], '^\\p{Lu}') THEN CASE WHEN regexp_matches(tokens[i], '(?i)^(gelo|ma|kî|çi)') THEN 'QUESTION' ELSE 'PERIOD' END WHEN tokens[i + 1] IN ('ku', 'û', 'lê') THEN 'COMMA' ELSE 'O' END AS pred
 FROM (SELECT source, split, tokens, labels, unnest(range(1, least(len(tokens), len(labels)) + 1)) AS i FROM window_samples))"""
S_CUBE = f"""c AS (SELECT "true", pred, count(*) AS n FROM {S_PAIRS} WHERE "true" IS NOT NULL GROUP BY ALL)"""


def _pairs(spark, d) -> DataFrame:
    w = table(spark, d, "window_samples")
    n = F.least(F.size("tokens"), F.size("labels"))
    pred = lambda t, nx: F.when(nx.isNull() | nx.rlike(r"^\p{Lu}"), F.when(t.rlike("(?iu)^(gelo|ma|kî|çi)"), "QUESTION").otherwise("PERIOD")).when(nx.isin("ku", "û", "lê"), "COMMA").otherwise("O")
    rows = F.transform(F.slice("tokens", F.lit(1), n), lambda t, i: F.struct(F.get("labels", i).alias("true"), pred(t, F.get("tokens", i + 1)).alias("pred")))
    return w.where(n > 0).select("source", "split", F.explode(rows).alias("x")).select("source", "split", "x.true", "x.pred")


@query(f"WITH {S_CUBE} SELECT * FROM c")
def confusion_matrix(spark, d):
    return metrics.confusion(_pairs(spark, d))


S_F = "coalesce(2 * p * r / nullif(p + r, 0), 0)"
S_PRF = f"""l AS (SELECT v.label, coalesce(sum(n) FILTER ("true" = v.label AND pred = v.label), 0) AS tp, coalesce(sum(n) FILTER ("true" <> v.label AND pred = v.label), 0) AS fp, coalesce(sum(n) FILTER ("true" = v.label AND pred <> v.label), 0) AS fn FROM {S_LABELS} LEFT JOIN c ON true GROUP BY v.label),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM l)"""


@query(f"WITH {S_CUBE}, {S_PRF} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round({S_F}, 6) AS f1, (tp + fn)::BIGINT AS support FROM m")
def label_metrics(spark, d):
    return metrics.per_label(metrics.confusion(_pairs(spark, d)), metrics.PUNCT).drop("tp", "fp", "fn")


def s_f1(tp: str, fp: str, fn: str) -> str:
    p, r = f"coalesce(({tp})::DOUBLE / nullif({tp} + {fp}, 0), 0)", f"coalesce(({tp})::DOUBLE / nullif({tp} + {fn}, 0), 0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


S_EDGE = ["PERIOD", "QUESTION", "EXCLAMATION"]
S_IN = "IN ('PERIOD', 'QUESTION', 'EXCLAMATION')"


@query(f"""WITH {S_CUBE}, {S_PRF}, e AS (SELECT sum(n) FILTER ("true" {S_IN} AND pred {S_IN}) AS tp, sum(n) FILTER ("true" NOT {S_IN} AND pred {S_IN}) AS fp, sum(n) FILTER ("true" {S_IN} AND pred NOT {S_IN}) AS fn FROM c)
SELECT sum(m.tp + m.fn)::BIGINT AS tokens, round(sum(m.tp)::DOUBLE / greatest(1, sum(m.tp + m.fn)), 6) AS accuracy, round(sum({S_F}) FILTER (label <> 'O') / 4, 6) AS macro_f1,
 round({s_f1("sum(m.tp) FILTER (label <> 'O')", "sum(m.fp) FILTER (label <> 'O')", "sum(m.fn) FILTER (label <> 'O')")}, 6) AS micro_f1, round(coalesce(sum({S_F} * (m.tp + m.fn)) / nullif(sum(m.tp + m.fn), 0), 0), 6) AS weighted_f1, (SELECT round({s_f1('tp', 'fp', 'fn')}, 6) FROM e) AS boundary_f1 FROM m""")
def metric_summary(spark, d):
    return metrics.summary(metrics.confusion(_pairs(spark, d)), metrics.PUNCT, metrics.PUNCT[1:], metrics.BOUNDARY)


@query(f"""WITH c AS (SELECT source, "true", pred, count(*) AS n FROM {S_PAIRS} WHERE "true" IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
l AS (SELECT source, v.label, sum(n) FILTER ("true" = v.label AND pred = v.label) AS tp, sum(n) FILTER ("true" <> v.label AND pred = v.label) AS fp, sum(n) FILTER ("true" = v.label AND pred <> v.label) AS fn FROM c CROSS JOIN {S_LABELS} GROUP BY ALL),
m AS (SELECT source, label, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(tp, 0)::DOUBLE / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0) AS p0, coalesce(tp, 0)::DOUBLE / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0) AS r0 FROM l)
SELECT source, sum(tp + fn)::BIGINT AS tokens, round(sum(coalesce(2 * coalesce(p0, 0) * coalesce(r0, 0) / nullif(coalesce(p0, 0) + coalesce(r0, 0), 0), 0)) FILTER (label <> 'O') / 4, 6) AS macro_f1 FROM m GROUP BY source""")
def metrics_by_source(spark, d):
    cube = metrics.confusion(_pairs(spark, d).where("source is not null"), "source")
    return metrics.summary(cube, metrics.PUNCT, metrics.PUNCT[1:], None, "source").select("source", "tokens", "macro_f1")


@query(f"""WITH {S_CUBE} SELECT "true" || ' -> ' || pred AS transition, sum(n)::BIGINT AS n FROM c WHERE "true" <> pred GROUP BY 1""")
def error_transitions(spark, d):
    return metrics.transitions(metrics.confusion(_pairs(spark, d)))


@query(f"""WITH c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM window_samples WHERE split = 'train') GROUP BY label), o AS (SELECT greatest(1, sum(n)) AS ref FROM c WHERE label = 'O')
SELECT label, n, round(least(8.0, sqrt(ref::DOUBLE / greatest(1, n))), 6) AS weight FROM c CROSS JOIN o""")
def class_weights(spark, d):
    n = table(spark, d, "window_samples").where("split = 'train'").select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return corpus.class_weights(n)


@query("""WITH i AS (SELECT article_id, md5('42:' || article_id) AS h FROM wikipedia WHERE article_id IS NOT NULL GROUP BY article_id), r AS (SELECT article_id, row_number() OVER (ORDER BY h, article_id) AS k, count(*) OVER () AS n FROM i)
SELECT article_id, CASE WHEN k <= floor(n * 0.9) THEN 'train' WHEN k <= floor(n * 0.9) + floor(n * 0.05) THEN 'validation' ELSE 'test' END AS split FROM r""")
def article_splits(spark, d):
    return corpus.split_ids(table(spark, d, "wikipedia").select("article_id"), "article_id")


S_WC = "len(string_split(trim(text), ' '))"


@query(f"""SELECT article_id FROM (SELECT article_id, coalesce(sum(w) OVER (ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM
(SELECT article_id, {s_words('text', 'filter')} AS w, md5('42:' || article_id) AS h FROM wikipedia WHERE text IS NOT NULL)) WHERE b < 20000""")
def word_cap(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", X.word_count(F.col("text")).alias("w"))
    return corpus.until_sum(rows, "w", 20000, "article_id").select("article_id")


@query("SELECT article_id FROM (SELECT article_id FROM wikipedia ORDER BY md5('42:' || article_id), article_id LIMIT 100)")
def hash_sample(spark, d):
    return table(spark, d, "wikipedia").select("article_id").orderBy(corpus.hash_order(F.col("article_id")), "article_id").limit(100)


S_SCORE = """(CASE WHEN w >= 20 AND w <= 250 THEN 5.0 WHEN w >= 10 AND w < 20 THEN 1.0 WHEN w > 250 THEN 2.0 ELSE 0.0 END + CASE WHEN qc >= 1 AND qc <= 3 THEN 3.0 WHEN qc > 3 THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(coalesce(text, ''), '[.!] .+\\?') THEN 2.0 ELSE 0.0 END
 - CASE WHEN coalesce(needs_context, false) THEN 3.0 ELSE 0.0 END - CASE WHEN coalesce(turkish_review_flag, false) THEN 1.0 ELSE 0.0 END - CASE WHEN coalesce(context_constructed, false) THEN 2.0 ELSE 0.0 END + CASE source WHEN 'kurdish_ai_corpus' THEN 0.5 WHEN 'tatoeba' THEN -1.5 ELSE 0.0 END)::DOUBLE"""


@query(f"""SELECT source, record_id, score, rank FROM (SELECT source, record_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, record_id) AS rank FROM
(SELECT source, record_id, max({S_SCORE}) AS score FROM (SELECT *, coalesce(word_count, 0) AS w, coalesce(question_count, 0) AS qc FROM accepted_records) GROUP BY source, record_id)) WHERE rank <= 50""")
def ranked_in_source(spark, d):
    rows = table(spark, d, "accepted_records")
    one = rows.select("source", "record_id", selection.score(rows).alias("score")).groupBy("source", "record_id").agg(F.max("score").alias("score"))
    return selection.best_of(one, "source", 50, F.desc("score"), F.col("record_id")).select("source", "record_id", "score", F.col("rank").cast("long").alias("rank"))


CAPS = {"kurmanji_news": 1800, "kurdish_ai_corpus": 1500, "tatoeba": 200}
S_AT = lambda xs, value: "[" + ", ".join(f"CASE WHEN i = {k} THEN {value} ELSE {xs}[{k + 1}] END" for k in range(len(CAPS))) + "]"
# The rule turn by turn: i is the source whose turn it is, `hit` its next row that may be taken.
S_BATCH = f"""WITH RECURSIVE o AS (SELECT record_id, source, type, score FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, source DESC NULLS LAST, type DESC) AS k FROM (SELECT record_id, source, {S_KIND.replace('text', "coalesce(text, '')")} AS type, {S_SCORE} AS score FROM (SELECT *, coalesce(word_count, 0) AS w, coalesce(question_count, 0) AS qc FROM accepted_records))) WHERE k = 1),
l AS MATERIALIZED (SELECT source, list({{'p': p, 't': type, 'r': record_id}} ORDER BY p) AS l FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, record_id) AS p FROM o) GROUP BY source),
s AS MATERIALIZED (SELECT [{', '.join(f"(SELECT l FROM l WHERE source = {q(x)})" for x in CAPS)}] AS lists, {list(CAPS.values())} AS caps, {list(CAPS)} AS names),
g AS (SELECT -1::BIGINT AS i, 0::BIGINT AS n, [0, 0, 0]::BIGINT[] AS used, [0, 0, 0]::BIGINT[] AS taken, []::VARCHAR[] AS kinds, 0::BIGINT AS idle, NULL::VARCHAR AS record_id, NULL::VARCHAR AS source, NULL::VARCHAR AS type
 UNION ALL SELECT i, CASE WHEN hit IS NULL THEN n ELSE n + 1 END, {S_AT('used', "CASE WHEN taken[i + 1] >= caps[i + 1] THEN used[i + 1] ELSE coalesce(hit.p, 1000000000) END")}, {S_AT('taken', "taken[i + 1] + (hit IS NOT NULL)::BIGINT")},
 CASE WHEN hit IS NULL THEN kinds ELSE list_append(kinds, hit.t) END, CASE WHEN hit IS NULL THEN idle + 1 ELSE 0 END, hit.r, CASE WHEN hit IS NOT NULL THEN names[i + 1] END, hit.t FROM (SELECT *, CASE WHEN taken[i + 1] < caps[i + 1] THEN list_filter(coalesce(lists[i + 1], []), lambda x: x.p > used[i + 1] AND (n < 200 OR (len(list_filter(kinds, lambda k: k = x.t)) + 1)::DOUBLE / (n + 1) <= 0.4))[1] END AS hit FROM
 (SELECT (i + 1) % 3 AS i, n, used, taken, kinds, idle, lists, caps, names FROM g, s WHERE n < 3000 AND idle < 3)))"""


@query(f"{S_BATCH} SELECT record_id, source, type, n AS pick FROM g WHERE record_id IS NOT NULL")
def first_batch(spark, d):
    rows = table(spark, d, "accepted_records")
    one = rows.select("record_id", "source", curation.question_type(F.coalesce("text", F.lit(""))).alias("type"), selection.score(rows).alias("score"))
    return selection.capped_selection(one.groupBy("record_id").agg(F.max(F.struct("score", "source", "type")).alias("r")).select("record_id", "r.source", "r.type", "r.score"), caps=CAPS)


S_ONE = "(SELECT DISTINCT record_id, source FROM accepted_records WHERE source IS NOT NULL)"


@query(f"""WITH n AS (SELECT source, count(*) AS size FROM {S_ONE} GROUP BY source), f AS (SELECT *, greatest(0, least(least(20, size), 300 - (sum(least(20, size)) OVER (ORDER BY source) - least(20, size)))) AS f FROM n),
r AS (SELECT *, size - f AS free, least(greatest(0, 300 - sum(f) OVER ()), sum(size - f) OVER ()) AS rest, greatest(1, sum(size - f) OVER ()) AS every FROM f), w AS (SELECT *, (rest * free // every) AS whole, rest * free % every AS part FROM r),
t AS (SELECT source, f + whole + CASE WHEN row_number() OVER (ORDER BY part DESC, source) <= rest - sum(whole) OVER () THEN 1 ELSE 0 END AS take FROM w)
SELECT record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || record_id), record_id) AS k FROM {S_ONE}) JOIN t USING (source) WHERE k <= take""")
def stratified_sample(spark, d):
    rows = table(spark, d, "accepted_records").select("record_id", "source").distinct()
    return selection.stratified(rows, "source", "record_id", 300, 20)


S_POOL = f"(SELECT DISTINCT record_id, source FROM accepted_records WHERE source IS NOT NULL AND coalesce(word_count, 0) >= 20 AND coalesce(question_count, 0) >= 1 AND {s_count('text', '.!')} >= 1)"


@query("""SELECT record_id, source, row_number() OVER (ORDER BY r, source, record_id) AS pick FROM (SELECT record_id, source, r FROM (SELECT record_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || record_id), record_id) AS r FROM """ + S_POOL + """) ORDER BY r, source, record_id LIMIT 200)""")
def round_robin(spark, d):
    rows = selection.holdout_pool(table(spark, d, "accepted_records")).where("source is not null").select("record_id", "source").distinct()
    return selection.rounds(rows, "source", "record_id", 200).select("record_id", "source", F.col("pick").cast("long").alias("pick"))


@query(f"""SELECT count(*) AS parts, sum(w)::BIGINT AS words, md5(string_agg(text, chr(10) || chr(10) ORDER BY h, article_id)) AS text FROM (SELECT article_id, text, w, h, coalesce(sum(w) OVER (ORDER BY h, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM
(SELECT article_id, text, {s_words('text', 'filter')} AS w, md5('42:' || article_id) AS h FROM wikipedia WHERE text IS NOT NULL)) WHERE b < 10000""")
def joined_articles(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", "text", X.word_count(F.col("text")).alias("w"))
    return selection.joined_until(rows, "w", 10000, "article_id").select("parts", "words", F.md5("text").alias("text"))


FILLERS = ["Îro hewa xweş e.", "Em li malê ne.", "Roj baş, hevalno."]
S_FILL = lambda side: f"[{', '.join(map(q, FILLERS))}][floor({s_uniform(q(side), 'record_id')} * 3)::INT + 1]"


@query(f"SELECT record_id, concat_ws(' ', {S_FILL('before')}, text, {S_FILL('after')}) AS text, true AS constructed FROM (SELECT DISTINCT record_id, text FROM accepted_records WHERE needs_context)")
def filled_contexts(spark, d):
    rows = table(spark, d, "accepted_records").where("needs_context").select("record_id", "text").distinct()
    return selection.with_fillers(rows, FILLERS, "record_id")


S_COST = "greatest(1, ceil(length(tok) / 4))::BIGINT"


def s_sums(words: str, cost: str = S_COST) -> str:
    """(k, n, c) of rows (k, i, tok): c are the sums of costs before each word and after the last."""
    return f"SELECT k, count(*)::BIGINT AS n, [0::BIGINT] || list(upto ORDER BY i) AS c FROM (SELECT k, i, sum({cost}) OVER (PARTITION BY k ORDER BY i)::BIGINT AS upto FROM ({words})) GROUP BY k"


def s_reach(at: str, most: str, budget: int = 256) -> str:
    return f"least({most}, greatest({at} + 1, len(list_filter(c, lambda x: x <= c[{at} + 1] + {budget - 2})) - 1))"


def s_training(words: str) -> str:
    """CTEs that end in spans (k, win, start, stop), the continuous windows of (k, i, tok)."""
    draw = "110 + ('0x' || substr(md5('42:' || k || ':' || turn), 1, 8))::BIGINT % 71"
    return f"""RECURSIVE a AS MATERIALIZED ({s_sums(words)}), w AS (SELECT k, -1::BIGINT AS turn, -1::BIGINT AS start, -1::BIGINT AS stop, 0::BIGINT AS nxt, n, c FROM a WHERE n >= 80
 UNION ALL SELECT k, turn, start, stop, greatest(stop - 8, start + 1), n, c FROM (SELECT k, turn, start, CASE WHEN n - e BETWEEN 1 AND 39 THEN greatest(e, {s_reach('start', 'n')}) ELSE e END AS stop, n, c FROM (SELECT *, {s_reach('start', 'least(start + aim, n)')} AS e FROM
 (SELECT k, turn, aim, CASE WHEN turn > 0 AND n - nxt < 80 THEN least(nxt, greatest(n - greatest(80, least(aim, n - nxt + 8)), start + 1)) ELSE nxt END AS start, n, c FROM (SELECT k, turn, start, nxt, n, c, {draw} AS aim FROM (SELECT k, turn + 1 AS turn, start, nxt, n, c FROM w WHERE stop < n AND n - nxt >= 40)))))),
spans AS (SELECT k, turn + 1 AS win, start, stop FROM w WHERE turn >= 0 UNION ALL SELECT k, 1, 0, n FROM a WHERE n BETWEEN 40 AND 79)"""


def s_inference(words: str) -> str:
    """CTEs that end in spans (k, win, start, stop), the windows of (k, i, tok) that fill the budget."""
    return f"""RECURSIVE a AS MATERIALIZED ({s_sums(words)}), w AS (SELECT k, 0::BIGINT AS win, 0::BIGINT AS start, 0::BIGINT AS stop, 0::BIGINT AS nxt, n, c FROM a
 UNION ALL SELECT k, win, start, stop, greatest(stop - 32, start + 1), n, c FROM (SELECT k, win + 1 AS win, nxt AS start, {s_reach('nxt', 'n')} AS stop, n, c FROM w WHERE stop < n)), spans AS (SELECT k, win, start, stop FROM w WHERE win > 0)"""


S_ARTICLE_WORDS = f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, tok, {S_LABEL} AS label FROM (SELECT k, i, tok, lead(tok) OVER (PARTITION BY k ORDER BY i) AS nxt FROM (SELECT k, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT article_id AS k, {s_tokens(s_dataset('text'))} AS t FROM wikipedia WHERE text IS NOT NULL)))
 WHERE tok NOT IN (',', '.', '?', '!')"""


@query(f"""WITH {s_training(S_ARTICLE_WORDS)} SELECT k || '_' || lpad(win::VARCHAR, 6, '0') AS id, k AS article_id, list(tok ORDER BY i) AS tokens, list(label ORDER BY i) AS labels FROM spans JOIN ({S_ARTICLE_WORDS}) x USING (k) WHERE i > start AND i <= stop GROUP BY k, win""")
def training_windows(spark, d):
    rows = table(spark, d, "wikipedia").where("text is not null").select("article_id", T.labelled(T.tokenize(X.normalize_for_dataset(F.col("text")))).alias("items"))
    return _labelled_windows(rows, corpus.word_costs(F.transform("items", lambda x: x["tok"])))


def _labelled_windows(rows: DataFrame, costs) -> DataFrame:
    w = corpus.windows(rows, "article_id", costs)
    return w.select(F.format_string("%s_%06d", "article_id", "win").alias("id"), "article_id", F.transform("items", lambda x: x["tok"]).alias("tokens"), F.transform("items", lambda x: x["label"]).alias("labels"))


S_DOC_TOKENS = f"SELECT k, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT doc_id AS k, {s_tokens(s_ws(s_nfc('text')))} AS t FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {s_inference(S_DOC_TOKENS)} SELECT k AS doc_id, win, start, stop AS "end" FROM spans""")
def inference_windows(spark, d):
    return corpus.windows(_doc_tokens(spark, d), "doc_id", corpus.word_costs(F.col("items")), training=False).select("doc_id", F.col("win").cast("long").alias("win"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _doc_tokens(spark, d) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", T.tokenize(X.normalize_for_inference(F.col("text"))).alias("items"))


@query("SELECT id, split, CASE WHEN n > 10 THEN n - 6 ELSE n END AS kept FROM (SELECT id, split, len(labels)::BIGINT AS n FROM window_samples WHERE split = 'train')")
def edge_masks(spark, d):
    w = table(spark, d, "window_samples").where("split = 'train'")
    return w.select("id", "split", F.size(F.filter(corpus.edge_masked(F.col("labels")), lambda x: x.isNotNull())).cast("long").alias("kept"))


# The first five numbers of an embedding stand for logits over marks, the next three for logits over cases.
S_LOGITS = "SELECT vec_id, label, embedding[1:5]::DOUBLE[] AS z, embedding[6:8]::DOUBLE[] AS y FROM embeddings"
S_SOFT = "list_transform(list_transform({0}, lambda v: exp(v - list_max({0}))), lambda v: v / list_sum(list_transform({0}, lambda u: exp(u - list_max({0})))))"


@query(f"""SELECT vec_id, CASE WHEN (k = 2 AND c < 0.55) OR (k = 3 AND c < 0.55) OR (k = 4 AND c < 0.60) OR (k = 5 AND c < 0.70) THEN 'O' ELSE ['O', 'COMMA', 'PERIOD', 'QUESTION', 'EXCLAMATION'][k] END AS label,
 round(CASE WHEN (k = 2 AND c < 0.55) OR (k = 3 AND c < 0.55) OR (k = 4 AND c < 0.60) OR (k = 5 AND c < 0.70) THEN p[1] ELSE c END, 6) AS confidence FROM (SELECT vec_id, p, list_max(p) AS c, list_position(p, list_max(p)) AS k FROM (SELECT vec_id, {S_SOFT.format("list_transform(z, lambda w: w * 6)")} AS p FROM ({S_LOGITS})))""")
def decoded_marks(spark, d):
    z = F.transform(F.slice("embedding", 1, 5), lambda w: w.cast("double") * 6)
    x = metrics.decode_marks(metrics.softmax(z), restoration.FLOORS)
    return table(spark, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", "x.label", F.round("x.confidence", 6).alias("confidence"))


S_CASES = f"SELECT vec_id, p, list_max(p) AS c, list_position(p, list_max(p)) AS k, vec_id % 7 = 0 AS prot, vec_id % 5 = 0 AS start, ['KEEP', 'TITLE', 'UPPER'][(label % 3 + 1)::INT] AS gold FROM (SELECT vec_id, label, {S_SOFT.format('list_transform(y, lambda w: w * 12)')} AS p FROM ({S_LOGITS}))"


@query(f"""SELECT vec_id, CASE WHEN prot THEN 'KEEP' WHEN k = 3 AND c >= 0.85 THEN 'UPPER' WHEN k = 2 AND c >= 0.8 AND NOT start THEN 'TITLE' ELSE 'KEEP' END AS label,
 round(CASE WHEN prot THEN 1.0 WHEN (k = 3 AND c >= 0.85) OR (k = 2 AND c >= 0.8 AND NOT start) THEN c ELSE p[1] END, 6) AS confidence FROM ({S_CASES})""")
def decoded_case(spark, d):
    x = metrics.decode_case(F.col("p"), F.col("prot"), F.col("start"))
    return _cases(spark, d).select("vec_id", x.alias("x")).select("vec_id", "x.label", F.round("x.confidence", 6).alias("confidence"))


def _cases(spark, d) -> DataFrame:
    y = F.transform(F.slice("embedding", 6, 3), lambda w: w.cast("double") * 12)
    gold = F.get(F.array(*map(F.lit, metrics.CASE)), (F.col("label") % 3).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", metrics.softmax(y).alias("p"), (F.col("vec_id") % 7 == 0).alias("prot"), (F.col("vec_id") % 5 == 0).alias("start"), gold.alias("gold"))


@query(f"""WITH {s_inference(S_DOC_TOKENS)} SELECT k AS doc_id, pos, round(avg(pos - start), 5) AS place, round(avg(stop - start), 5) AS length FROM (SELECT k, start, stop, unnest(range(start, stop)) AS pos FROM spans) GROUP BY k, pos""")
def window_means(spark, d):
    """Means over windows, of a scorer that gives each token its place in the window and the window's length."""

    def places(windows_):
        return [[[i, len(w)] for i in range(len(w))] for w in windows_]

    z = restoration.logits_of(F.col("items"), None, places)
    rows = _doc_tokens(spark, d).select("doc_id", F.posexplode(z).alias("pos", "z"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round(F.get("z", F.lit(0)), 5).alias("place"), F.round(F.get("z", F.lit(1)), 5).alias("length"))


GRID = [round(0.30 + 0.05 * i, 2) for i in range(13)]
TITLE_GRID = [round(0.80 + 0.02 * i, 2) for i in range(9)]
UPPER_GRID = [round(0.85 + 0.02 * i, 2) for i in range(7)]
S_SWEEP = f"SELECT ['O', 'COMMA', 'PERIOD', 'QUESTION', 'EXCLAMATION'][(label % 5 + 1)::INT] AS gold, ['O', 'COMMA', 'PERIOD', 'QUESTION', 'EXCLAMATION'][k] AS arg, c AS conf FROM (SELECT label, list_max(p) AS c, list_position(p, list_max(p)) AS k FROM (SELECT label, {S_SOFT.format('list_transform(z, lambda w: w * 6)')} AS p FROM ({S_LOGITS})))"


def _arg(spark, d) -> DataFrame:
    p = metrics.softmax(F.transform(F.slice("embedding", 1, 5), lambda w: w.cast("double") * 6))
    names = F.array(*map(F.lit, metrics.PUNCT))
    rows = table(spark, d, "embeddings").select("label", p.alias("p"))
    return rows.select(F.get(names, (F.col("label") % 5).cast("int")).alias("gold"), F.get(names, metrics.argmax(F.col("p")) - 1).alias("arg"), F.array_max("p").alias("conf"))


S_GRID = ", ".join(f"({g}::DOUBLE)" for g in GRID)


@query(f"""WITH r AS ({S_SWEEP}), s AS (SELECT label, t, count(*) FILTER (arg = label AND conf >= t AND gold = label) AS tp, count(*) FILTER (arg = label AND conf >= t AND gold <> label) AS fp, count(*) FILTER (NOT (arg = label AND conf >= t) AND gold = label) AS fn FROM r CROSS JOIN {S_LABELS} CROSS JOIN (VALUES {S_GRID}) g(t) WHERE label <> 'O' GROUP BY label, t),
f AS (SELECT label, t AS threshold, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({s_f1('tp', 'fp', 'fn')}, 6) AS f1 FROM s)
SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) = 1 AS best FROM f""")
def threshold_sweep(spark, d):
    return metrics.sweep(_arg(spark, d), metrics.PUNCT[1:], GRID, "O")


@query(f"""WITH r AS (SELECT gold, CASE WHEN k = 1 THEN 'KEEP' WHEN k = 2 THEN 'TITLE' ELSE 'UPPER' END AS arg, c, prot, start FROM ({S_CASES})),
p AS (SELECT t.t, u.u, gold, CASE WHEN prot THEN 'KEEP' WHEN arg = 'UPPER' AND c >= u.u THEN 'UPPER' WHEN arg = 'TITLE' AND NOT start AND c >= t.t THEN 'TITLE' ELSE 'KEEP' END AS pred FROM r CROSS JOIN (VALUES {', '.join(f'({g}::DOUBLE)' for g in TITLE_GRID)}) t(t) CROSS JOIN (VALUES {', '.join(f'({g}::DOUBLE)' for g in UPPER_GRID)}) u(u)),
s AS (SELECT t, u, count(*) FILTER (gold = 'TITLE' AND pred = 'TITLE') AS tt, count(*) FILTER (gold <> 'TITLE' AND pred = 'TITLE') AS tf, count(*) FILTER (gold = 'TITLE' AND pred <> 'TITLE') AS tn, count(*) FILTER (gold = 'UPPER' AND pred = 'UPPER') AS ut, count(*) FILTER (gold <> 'UPPER' AND pred = 'UPPER') AS uf, count(*) FILTER (gold = 'UPPER' AND pred <> 'UPPER') AS un FROM p GROUP BY t, u)
SELECT t AS title, u AS upper, round(({s_f1('tt', 'tf', 'tn')} + {s_f1('ut', 'uf', 'un')}) / 2, 6) AS macro_f1, round(coalesce(tt::DOUBLE / nullif(tt + tf, 0), 0), 6) AS title_precision, round(coalesce(tt::DOUBLE / nullif(tt + tn, 0), 0), 6) AS title_recall, round({s_f1('tt', 'tf', 'tn')}, 6) AS title_f1, round({s_f1('ut', 'uf', 'un')}, 6) AS upper_f1, row_number() OVER (ORDER BY (round(coalesce(tt::DOUBLE / nullif(tt + tf, 0), 0), 6) >= 0.90 AND round(coalesce(tt::DOUBLE / nullif(tt + tn, 0), 0), 6) >= 0.85) DESC, round(coalesce(tt::DOUBLE / nullif(tt + tf, 0), 0), 6) DESC, round(({s_f1('tt', 'tf', 'tn')} + {s_f1('ut', 'uf', 'un')}) / 2, 6) DESC, round(coalesce(tt::DOUBLE / nullif(tt + tn, 0), 0), 6) DESC, t, u) = 1 AS best FROM s""")
def threshold_grid(spark, d):
    rows = _cases(spark, d).select("gold", F.get(F.array(*map(F.lit, metrics.CASE)), metrics.argmax(F.col("p")) - 1).alias("arg"), F.array_max("p").alias("conf"), F.col("prot").alias("protected"), "start")
    return metrics.sweep_pair(rows, TITLE_GRID, UPPER_GRID)


def s_logits(labels: int) -> str:
    """The stand-in's logits of `tok`: five bits of its md5 for each label."""
    return f"list_transform(range(0, {labels}), lambda j: ((('0x' || substr(md5(tok), 1, 8))::BIGINT >> (5 * j)::INT) % 32) / 4.0 + CASE WHEN j = 0 THEN 6.0 ELSE 0.0 END)"


S_LOW_FLOOR = "((k = 2 AND c < 0.55) OR (k = 3 AND c < 0.55) OR (k = 4 AND c < 0.60) OR (k = 5 AND c < 0.70))"
S_UNMARKED = lambda x: s_ws(f"translate({s_ws(s_nfc(x))}, ',.?!', '')")


def s_punctuated(source: str, p: str = "p") -> str:
    """CTEs that end in {p} (key, input, output, preserved) of rows (key, text)."""
    return f"""{p}i AS MATERIALIZED (SELECT key, {s_ws(s_nfc("coalesce(text, '')"))} AS input FROM ({source})),
{p}w AS (SELECT key, i, tok, {S_LABEL} AS label FROM (SELECT key, i, tok, lead(tok) OVER (PARTITION BY key ORDER BY i) AS nxt FROM (SELECT key, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT key, {s_tokens('input')} AS t FROM {p}i))) WHERE tok NOT IN (',', '.', '?', '!')),
{p}z AS (SELECT key, i, tok, label, list_max(p) AS c, list_position(p, list_max(p)) AS k FROM (SELECT *, {S_SOFT.format('z')} AS p FROM (SELECT *, {s_logits(5)} AS z FROM {p}w))),
{p}d AS (SELECT key, i, tok, CASE WHEN label <> 'O' THEN label WHEN {S_LOW_FLOOR} THEN 'O' ELSE ['O', 'COMMA', 'PERIOD', 'QUESTION', 'EXCLAMATION'][k] END AS label FROM {p}z),
{p}o AS (SELECT key, string_agg(tok || CASE label WHEN 'COMMA' THEN ',' WHEN 'PERIOD' THEN '.' WHEN 'QUESTION' THEN '?' WHEN 'EXCLAMATION' THEN '!' ELSE '' END, ' ' ORDER BY i) AS output FROM {p}d GROUP BY key),
{p} AS MATERIALIZED (SELECT *, {S_UNMARKED('input')} = {S_UNMARKED('output')} AS preserved FROM (SELECT key, input, coalesce(output, '') AS output FROM {p}i LEFT JOIN {p}o USING (key)))"""


def s_begun(source: str, text: str) -> str:
    """(key, i, tok, start) of the tokens of a text column."""
    return f"""SELECT key, i, tok, coalesce(e = 'CONSUME' AND coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'SET') = 'SET', false) AS start FROM
 (SELECT *, CASE WHEN tok IN ('.', '?', '!') THEN 'SET' WHEN tok IN ({S_SKIP}) THEN NULL WHEN regexp_matches(tok, '\\p{{L}}') THEN 'CONSUME' WHEN regexp_matches(tok, '\\p{{Nd}}') THEN 'CLEAR' END AS e FROM (SELECT key, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT key, {s_tokens(text)} AS t FROM {source})))"""


def s_respelt(text: str, new: str) -> str:
    """The text with new tokens; gaps is the list of what stands between its tokens."""
    return f"(CASE WHEN {new} IS NULL THEN {text} ELSE array_to_string(list_transform(range(1, len({new}) + 1), lambda j: gaps[j] || {new}[j]), '') || gaps[len({new}) + 1] END)"


def s_capitalised(source: str, p: str = "c") -> str:
    """CTEs that end in {p} (key, ruled, output, preserved) of rows (key, text)."""
    low = lambda x: f"lower(translate({s_nfc(x)}, 'İ', 'i'))"
    gaps = lambda x: f"string_split_regex({x}, {q(T.TOKEN)})"
    return f"""{p}l AS MATERIALIZED (SELECT key, {low(s_ws(s_nfc('text')))} AS low FROM ({source})),
{p}r AS MATERIALIZED (SELECT key, {s_respelt('low', 'new')} AS ruled FROM (SELECT *, {gaps('low')} AS gaps FROM {p}l) LEFT JOIN (SELECT key, list(CASE WHEN start THEN {s_title('tok')} ELSE tok END ORDER BY i) AS new FROM ({s_begun(p + 'l', 'low')}) GROUP BY key) USING (key)),
{p}z AS (SELECT key, i, tok, start, list_max(p) AS c, list_position(p, list_max(p)) AS k FROM (SELECT *, {S_SOFT.format('z')} AS p FROM (SELECT *, {s_logits(3)} AS z FROM ({s_begun(p + 'r', 'ruled')})))),
{p}n AS (SELECT key, list(CASE WHEN {S_PROTECTED} OR NOT regexp_matches(tok, '\\p{{L}}') THEN tok WHEN k = 3 AND c >= 0.85 THEN replace(upper(tok), 'ẞ', 'SS') WHEN k = 2 AND c >= 0.8 AND NOT start THEN {s_title('tok')} ELSE tok END ORDER BY i) AS new FROM {p}z GROUP BY key),
{p} AS MATERIALIZED (SELECT *, {low('ruled')} = {low('output')} AS preserved FROM (SELECT key, ruled, {s_respelt('ruled', 'new')} AS output FROM (SELECT *, {gaps('ruled')} AS gaps FROM {p}r) LEFT JOIN {p}n USING (key)))"""


S_RESTORED = f"{s_punctuated('SELECT doc_id AS key, text FROM documents')}, {s_capitalised('SELECT key, output AS text FROM p')}"


@query(f"WITH {S_RESTORED} SELECT key, input, p.output AS punctuated, ruled AS sentence_capitalized, c.output, p.preserved AS punctuation_only, c.preserved AS case_only FROM p JOIN c USING (key)")
def restored_texts(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("key"), "text")
    return restoration.restore(rows, "full", restoration.stand_in(5), restoration.stand_in(3))


@query(f"WITH {s_punctuated('SELECT article_id AS key, text FROM wikipedia')} SELECT * FROM p")
def punctuated_texts(spark, d):
    rows = table(spark, d, "wikipedia").select(F.col("article_id").alias("key"), "text")
    return restoration.punctuate(rows, restoration.stand_in(5)).drop("tokens")


S_AGAIN = f"""{S_RESTORED}, {s_punctuated('SELECT key, output AS text FROM c', 'q')}, {s_capitalised('SELECT key, output AS text FROM q', 'e')}"""


@query(f"""WITH {S_AGAIN} SELECT count(*) AS texts, round(avg(p.preserved::INT), 6) AS marks_only, round(avg(c.preserved::INT), 6) AS case_only, round(avg((c.output = e.output)::INT), 6) AS exact,
 round(avg((c.output = e.output OR {s_ws("translate(lower(translate(" + s_nfc('c.output') + ", 'İ', 'i')), ',.?!', '')")} = {s_ws("translate(lower(translate(" + s_nfc('e.output') + ", 'İ', 'i')), ',.?!', '')")})::INT), 6) AS near
 FROM p JOIN c USING (key) JOIN e USING (key) WHERE regexp_matches(array_to_string({s_tokens('p.input')}, ' '), '[^,.?! ]')""")
def preservation_rates(spark, d):
    """Rates of texts whose words and letters were kept, and of texts that a second restoration leaves as they are."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("key"), "text")
    r = restoration.idempotency(rows, restoration.stand_in(5), restoration.stand_in(3))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return r.agg(F.count(F.lit(1)).alias("texts"), rate("punctuation_only").alias("marks_only"), rate("case_only").alias("case_only"), rate("exact").alias("exact"), rate("near").alias("near"))


S_CASE_WORDS = f"""SELECT k, i, CASE WHEN start THEN {s_title('seen')} ELSE seen END AS tok, CASE WHEN start THEN 'IGNORE' ELSE {S_CASE} END AS label, seen FROM
 (SELECT o.key AS k, o.i, o.tok, l.tok AS seen, l.start FROM (SELECT key, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT key, {s_tokens('x')} AS t FROM ({{0}}))) o JOIN ({s_begun('({1})', 'x')}) l ON o.key = l.key AND o.i = l.i WHERE o.key IN (SELECT a.key FROM ({{0}}) a JOIN ({{1}}) b USING (key) WHERE len({s_tokens('a.x')}) = len({s_tokens('b.x')})))"""
S_CASE_WORDS = S_CASE_WORDS.replace("{0}", f"SELECT article_id AS key, {s_ws(s_nfc('text'))} AS x FROM wikipedia WHERE text IS NOT NULL").replace("{1}", f"SELECT article_id AS key, lower(translate({s_ws(s_nfc('text'))}, 'İ', 'i')) AS x FROM wikipedia WHERE text IS NOT NULL")


@query(f"""WITH cw AS MATERIALIZED ({S_CASE_WORDS}), x AS (SELECT * FROM (WITH {s_training('SELECT k, i, tok FROM cw')} SELECT * FROM spans)) SELECT k AS article_id, win, start, stop AS "end", list(label ORDER BY i) AS labels FROM x JOIN cw USING (k) WHERE i > start AND i <= stop GROUP BY ALL""")
def case_windows(spark, d):
    flat = C.case_rows(table(spark, d, "wikipedia").select("article_id", X.normalize_for_inference(F.col("text")).alias("text")), "article_id")
    rows = flat.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "label"))).alias("items"))
    w = corpus.windows(rows, "article_id", corpus.word_costs(F.transform("items", lambda x: x["tok"])))
    return w.select("article_id", F.col("win").cast("long").alias("win"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.transform("items", lambda x: x["label"]).alias("labels"))


@query("SELECT article_id, text FROM wikipedia")
def json_round_trip(spark, d):
    path = new_path(spark, "json")
    sinks.json_lines(table(spark, d, "wikipedia").select("article_id", "text"), path)
    return readers.json_lines(spark, path, readers.ARTICLE)


@query("SELECT id, split, tokens FROM window_samples WHERE split = 'test'")
def split_round_trip(spark, d):
    path = new_path(spark, "split")
    sinks.by_split(table(spark, d, "window_samples").select("id", "split", "tokens"), path)
    return spark.read.schema("id string, tokens array<string>, split string").json(path).where("split = 'test'").select("id", "split", "tokens")


@query("SELECT record_id, source, nullif(accept, '') AS accept, nullif(comment, '') AS comment FROM manual_review")
def csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    cols = ["record_id", "source", "accept", "comment"]
    sinks.csv(table(spark, d, "manual_review").select(*cols), path)
    back = readers.review_csv(spark, path, cols)
    return back.select("record_id", "source", F.when(F.col("accept") != "", F.col("accept")).alias("accept"), F.when(F.col("comment") != "", F.col("comment")).alias("comment"))


@query("SELECT 'raw_records' AS source, record_id, md5(text) AS text FROM raw_records UNION ALL SELECT 'accepted_records', record_id, md5(text) FROM accepted_records UNION ALL SELECT 'wikipedia', NULL, md5(text) FROM wikipedia")
def union_of_sources(spark, d):
    parts = {n: table(spark, d, n).select(*(c for c in ("record_id", "text", "article_id") if c in table(spark, d, n).columns)) for n in ("raw_records", "accepted_records", "wikipedia")}
    return readers.union_sources({**parts, "kurcorpus": None}).select("source", "record_id", F.md5("text").alias("text"))


@query("SELECT record_id, arg_max(word_count, landed_at) AS word_count, max(landed_at) AS landed_at FROM raw_records GROUP BY record_id")
def latest_records(spark, d):
    rows = table(spark, d, "raw_records").select("record_id", "word_count", "landed_at")
    latest = rows.where("word_count is not null").groupBy("record_id").agg(F.max_by("word_count", "landed_at").alias("word_count"))
    return rows.groupBy("record_id").agg(F.max("landed_at").alias("landed_at")).join(latest, "record_id", "left").select("record_id", "word_count", "landed_at")


@query("SELECT record_id, landed_at FROM raw_records WHERE language_code = 'kmr' AND contains(text, '?')")
def language_scan(spark, d):
    return readers.language_rows(table(spark, d, "raw_records"), "kmr").select("record_id", "landed_at")


@query("""SELECT count(*) AS rows, concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR) AS hash FROM
(SELECT md5('{"article_id":"' || article_id || '"}') AS h FROM wikipedia)""")
def dataset_hash(spark, d):
    return sinks.content_hash(table(spark, d, "wikipedia").select("article_id"))


S_EVENT_WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


@query(S_EVENT_WINDOWS)
def event_windows(spark, d):
    return streams.window_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def _stream(spark, d, name: str) -> DataFrame:
    schema = tables.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")


@query(S_EVENT_WINDOWS)
def event_stream(spark, d):
    base = new_path(spark, "events")
    counts = streams.window_counts(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return streams.run_once(counts, f"{base}/out", f"{base}/state", "complete")


# The rule of the stream row by row: each against the list of those accepted before in its source and twenty of words.
S_STREAM = f"""WITH RECURSIVE k AS MATERIALIZED (SELECT row_number() OVER () AS pos, row_number() OVER (PARTITION BY src, bucket ORDER BY record_id, md5(text)) AS r, * FROM (SELECT record_id, coalesce(source, '') AS src, {s_words('text', 'filter')} // 20 AS bucket, {s_nopunct('text')} AS n, text FROM raw_records WHERE text IS NOT NULL)),
s AS MATERIALIZED (SELECT pos, src, bucket, r, sig FROM ({s_sig('n', 'pos, src, bucket, r', 'k')})),
l AS MATERIALIZED (SELECT k.src, k.bucket, k.r, k.pos, list(DISTINCT o.pos) FILTER (o.pos IS NOT NULL) AS others FROM k LEFT JOIN (SELECT b.pos AS at, a.pos FROM s a JOIN s b ON a.src = b.src AND a.bucket = b.bucket AND a.r < b.r AND {S_EQUAL} >= 58) o ON o.at = k.pos GROUP BY ALL),
g AS (SELECT DISTINCT src, bucket, 0::BIGINT AS r, []::BIGINT[] AS ok FROM k UNION ALL SELECT l.src, l.bucket, l.r, CASE WHEN list_has_any(g.ok, coalesce(l.others, []::BIGINT[])) THEN g.ok ELSE list_append(g.ok, l.pos) END FROM g JOIN l ON l.src = g.src AND l.bucket = g.bucket AND l.r = g.r + 1),
a AS (SELECT DISTINCT unnest(ok) AS pos FROM g)"""


@query(f"{S_STREAM} SELECT record_id, src AS source, pos NOT IN (SELECT pos FROM a) AS reject FROM k")
def near_stream(spark, d):
    base = new_path(spark, "near")
    return streams.run_once(streams.near_stream(_stream(spark, d, "raw_records").where("text is not null")), f"{base}/out", f"{base}/state")
