"""Literal vectors of the text, token and case functions, against plain Python where a rule can be stated twice."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import casing as C
from corpusloom.functions import text as X
from corpusloom.functions import tokens as T


@pytest.fixture
def ev(spark):
    def run(make, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]

    return run


def pairs(value):
    return [(x["tok"], x["label"]) for x in value]


def test_next_mark_labels(ev):
    got = ev(lambda t: T.labelled(T.tokenize(t)), "Lê belê, em ê.", "Ez hatim.", "Tu baş î?", "Were!", ". , a , . b", "", None)
    assert pairs(got[0]) == [("Lê", "O"), ("belê", "COMMA"), ("em", "O"), ("ê", "PERIOD")]
    assert [x[-1][1] for x in map(pairs, got[1:4])] == ["PERIOD", "QUESTION", "EXCLAMATION"]
    assert pairs(got[4]) == [("a", "COMMA"), ("b", "O")]
    assert got[5] == [] and got[6] is None


def test_normal_forms(ev):
    assert ev(X.to_nfc, "ê", "ê", None) == ["ê", "ê", None]
    assert ev(X.normalize_for_dataset, "Ez hatim… Ew çû.", "a “b”\r\n\r\n\r\n\r\nc", "  ") == ["Ez hatim. Ew çû.", "a b \n\nc", ""]
    assert ev(lambda t: X.strip_unsupported(t, False), "a...b") == ["a b"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=20, max_size=60))
def test_composition_and_blanks_equal_python(ev, texts):
    assert ev(X.to_nfc, *texts) == [unicodedata.normalize("NFC", t) for t in texts]
    bmp = [t for t in texts if all(ord(c) < 0x10000 for c in t)]
    assert ev(X.collapse, *bmp) == [re.sub(r"\s+", " ", t).strip() for t in bmp] if bmp else True


def test_case_images(ev):
    assert ev(C.upper, "iîêşçû") == ["IÎÊŞÇÛ"]
    assert ev(C.lower, "ÎÊŞÇÛIİ") == ["îêşçûii"]
    assert ev(C.title, "amedê", "'amedê", "-kurdistan", "2026an", "42") == ["Amedê", "'Amedê", "-Kurdistan", "2026An", "42"]
    assert ev(C.case_label, "amedê", "Amedê", "UN", "McDonald", "42", "https://x.example", "A", ".", "كتاب") == ["KEEP", "TITLE", "UPPER", "IGNORE", "IGNORE", "IGNORE", "IGNORE", "IGNORE", "IGNORE"]


def test_apply_label(spark):
    df = spark.createDataFrame([("amedê", "TITLE"), ("un", "UPPER"), ("li", "KEEP")], "t string, l string")
    assert [r[0] for r in df.select(C.apply_label(F.col("t"), F.col("l"))).collect()] == ["Amedê", "UN", "li"]
    with pytest.raises(Exception, match="unknown case label"):
        df.select(C.apply_label(F.col("t"), F.lit("BAD"))).collect()


def test_sentence_starts(ev):
    out = ev(C.capitalise_starts, "ez li vir im. ew li wir e.", "tu kî yî? ez azad im.", "were! ez hatim.", 'got. "ez tême."', "binêre https://ku.example.org û name@example.com û 42.5", "", "42 kes hatin", "...")
    assert out[:3] == ["Ez li vir im. Ew li wir e.", "Tu kî yî? Ez azad im.", "Were! Ez hatim."]
    assert '"Ez' in out[3]
    assert out[4] == "Binêre https://ku.example.org û name@example.com û 42.5"
    assert out[5:] == ["", "42 kes hatin", "..."]


def test_starts_as_window_and_as_fold(spark):
    texts = ["ez. ew hat? 42 kes, re. \"ma\"", "", "a b. c", "1. du", "! x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string").withColumn("toks", T.tokenize(F.col("t")))
    fold = {r[0]: r[1] for r in df.select("doc_id", C.starts(F.col("toks"))).collect()}
    flat = C.mark_starts(df.select("doc_id", F.posexplode("toks").alias("pos", "tok")))
    for r in flat.collect():
        assert r["start"] == fold[r["doc_id"]][r["pos"]]


def test_case_labels_of_an_article(spark, ev):
    got = ev(C.case_labelled, "Ez li Amedê dijîm. Navê min Azad e.", "Ew ji UN tê.", "  ")
    first = {x["orig"]: x["label"] for x in got[0]}
    assert first["Ez"] == first["Navê"] == "IGNORE" and first["Amedê"] == first["Azad"] == "TITLE" and first["li"] == "KEEP"
    assert {x["orig"]: x["label"] for x in got[1]}["UN"] == "UPPER"
    assert got[2] is None
    df = spark.createDataFrame([(1, "Ez li Amedê dijîm. Navê min Azad e.")], "k int, text string")
    rows = C.case_rows(df, "k").orderBy("pos").collect()
    assert [(r["tok"], r["label"]) for r in rows] == [(x["tok"], x["label"]) for x in got[0]]


def test_joins_and_preservation(spark, ev):
    df = spark.createDataFrame([(["ez", "hatim"], ["", "."]), (["a", "b", "c"], [",", "", "?"]), ([], [])], "w array<string>, m array<string>")
    assert [r[0] for r in df.select(T.join_words(F.col("w"), F.col("m"))).collect()] == ["ez hatim.", "a, b c?", ""]
    bad = spark.createDataFrame([(["a"], [])], "w array<string>, m array<string>")
    with pytest.raises(Exception, match="differ in number"):
        bad.select(T.join_words(F.col("w"), F.col("m"))).collect()
    long = " ".join(f"w{i}" for i in range(10_001))
    words = ev(lambda t: T.words_of(T.tokenize(t)), long)[0]
    assert words == long.split()
    p = spark.createDataFrame([("ez îro çûm bajarê", "ez îro çûm bajarê."), ("ez îro", "ez iro.")], "a string, b string")
    assert [r[0] for r in p.select(X.preserves_text(F.col("a"), F.col("b"))).collect()] == [True, False]
    q = spark.createDataFrame([("ez li amedê", "Ez li Amedê"), ("ez dijîm", "Ez dijim")], "a string, b string")
    assert [r[0] for r in q.select(C.same_but_case(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_tokens_round_trip(ev):
    text = "navê welat-parêz û https://ku.example.org/a?b=1, name@example.com 42.5 21ê"
    assert ev(T.tokenize, text)[0] == ["navê", "welat-parêz", "û", "https://ku.example.org/a?b=1,", "name@example.com", "42.5", "21", "ê"]
    assert ev(lambda t: T.respell(t, T.tokenize(t)), text, "  a  b ", "")[0] == text


def test_counts_and_keys(ev):
    s = ev(X.script_stats, "abc", "كتاب", "12", None)
    assert (s[0]["n_letters"], s[0]["latin_ratio"]) == (3, 1.0) and s[1]["arabic_ratio"] == 1.0 and (s[2]["n_letters"], s[2]["arabic_ratio"]) == (0, 1.0)
    assert ev(X.nopunct_key, "“Ez, hatim!”", "Ez hatim") == ["ez hatim", "ez hatim"]
    assert ev(X.exact_key, '  "a  b"  ', '"') == ["a b", '"']
    assert ev(X.sentence_spans, "Ez im. Tu yî? 2.5", "", "a") == [["Ez im.", "Tu yî?", "2.", "5"], [], ["a"]]
    long = "a" * 700 + "?" + "b" * 900
    assert ev(X.question_context, long, "kurt?", "c" * 1300) == [long[100:1300], "kurt?", "c" * 1200]
    assert ev(X.as_bool, "Yes", " 0 ", "n/a", "", None, "OK") == [True, False, None, None, None, True]


def test_markup(ev):
    assert ev(X.strip_markup, "''Ez'' {{x|y}} [[a|b]] <b>c</b> &amp; [https://x.example d] == e ==") == ["Ez b c & d e"]
    assert ev(X.wiki_plain, "= H =\n* list\n|a\nmetn [[a|b]]\n\nd")[0].split() == ["metn", "b", "d"]
    assert ev(X.is_redirect, "  #REDIRECT [[x]]", "a") == [True, False]


def test_spans_grams_jaccard(spark, ev):
    assert ev(lambda t: T.spans(F.split(t, " "), 4), "a b c d e f g h", "a b")[0] == ["a b c d", "c d e f", "e f g h"]
    assert ev(T.grams, "abcdef", "ab", "") == [["abcde", "bcdef"], ["ab"], []]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [round(r[0], 4) for r in df.select(T.jaccard(F.col("x"), F.col("y"))).collect()] == [0.3333, 0.0]


def test_old_scheme(ev):
    got = ev(T.old_labelled, "Ez hatim; tu çûyî!", "Ez hatim.", "yek du sê")
    assert pairs(got[0]) == [("ez", "0"), ("hatim", ","), ("tu", "0"), ("çûyî", ".")] and got[1] is None and got[2] is None
    assert ev(X.soft_sentences, "Ev hevok e ya yekem. Ev ya duyem e! na", "kurt") == [["Ev hevok e ya yekem.", "Ev ya duyem e! na"], []]
