"""Problems 2, 3, 4, 8 and 10 on small cases, with nulls, empties, long texts, ties and clashing columns."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import abuse, bpe, languages, lookalikes, truncation


def canon(*texts):
    out, changed = lookalikes.normalise_column(pa.array(texts, pa.string()))
    return out.to_pylist(), changed.tolist()


def test_one_form():
    dirty = {
        "ｂｉｂîｎｉｎ！": "bibînin!", "Min kaxeka": "Min kaxeka", "Hi​nek": "Hinek", "Kaqû".replace("K", "Κ"): "Kaqû", "Fahûyê".replace("ê", "ê"): "Fahûyê",
        "șûșe": "şûşe", "ziνistan": "zivistan", "јі bеr": "ji ber", "Ge‍‍lo": "Gelo", "Tevı̂": "Tevî", "ﻻس": "لاس", "ȩ̂": unicodedata.normalize("NFC", "ȩ̂"),
        "ȩ̂": unicodedata.normalize("NFC", "ȩ̂"), "한": "한", "ﬁ": "fi",
    }
    clean = ["«слово»", "(λόγος)", "می‌خواهم", "👨‍👩‍👧", "“Iğdır’ın” – …", "a\r\nb\tc", "m² ½ İ ı", "", "– ἀρχή", "книга"]
    out, changed = canon(*dirty, *clean, None)
    assert out[: len(dirty)] == list(dirty.values()) and all(changed[: len(dirty)])
    assert out[len(dirty) :] == [*clean, None] and not any(changed[len(dirty) :])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=8))
def test_one_form_twice_is_once(texts):
    once, _ = canon(*texts)
    twice, changed = canon(*once)
    assert twice == once and not any(changed)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeicsuÊị̧̂̂̈إٔe"), max_size=12), max_size=8))
def test_composition_is_canonical(texts):
    out, _ = canon(*texts)
    assert all(unicodedata.normalize("NFC", x) == x for x in out)


def test_normalise_keeps_other_rows(rows):
    df = rows("k string, text string, changed string", ("a", "ｘ", "z"), ("a", "ｘ", "z"), (None, None, None), ("b", "y" * 200_000, "q"))
    got = lookalikes.normalise(df, "k").collect()
    assert sorted((str(r["k"]), str(r["text"])[:1], r["changed"]) for r in got) == [("None", "N", False), ("a", "x", True), ("a", "x", True), ("b", "y", False)]
    assert lookalikes.normalise(df.limit(0), "k").count() == 0


CUT = ["Ez hatim malê. Ew çû bo", "Ez hatim malê. Ew çû …", "Ez hatim malê. Ew çû […]", "Ez hatim malê. Ew ç [bêhtir]", "Ez hatim malê. Ew got: “ez", "Ez hatim malê. Ew got: “ez çûm.", "Ez hatim malê. Ji ber g�", "Ez hatim? Berî 1871,", "Baş e. Em diç...", "Ew hat. Ji bo &am"]
WHOLE = ["Ez hatim malê.", "Ez hatim malê. — Pesu", "Ez hatim malê. #nûçe #x", "Ez hatim malê. (Şeqok)", "Ez hatim malê. https://x.example/a", "Ez hatim malê. 👨‍👩‍👧", "Ew got: “ez çûm.” – „книга“", "Ez hatim malê. Maram / 9172", "Ez hatim malê. [9906]", "bê nîşan heta dawiyê", "", "  ", None, "Navê wî https://x.example/a.html", "Ez 2.5 kîlo"]


CUT += ["Baş e. Ew got: \"ez çûm.", "Ew li vir e. Ez (li malê bûm.", "Baş e. <b>Ez çûm.", "Baş e. Ew <a href"]
WHOLE += ["Ew got: \"ez çûm.\" Baş e.", "Yek. „Du. Sê.“ Çar (pênc).", "\"Yek. Du.\" Sê.", "<p>Baş e. Ez <b>çûm</b>.</p>", "Baş e. Ez çûm. <br>", "Nivîs: a@b.example. Baş e.", "Baş e. Ez li www.x.example/( bûm.", "Ev 5.5 ne. Baş e"]


def cut_states(*texts):
    out, _ = lookalikes.normalise_column(pa.array(texts, pa.string()))
    return truncation.states(out)[0].tolist()


def test_truncation():
    assert cut_states(*CUT) == [truncation.CUT] * len(CUT)
    assert [x == truncation.CUT for x in cut_states(*WHOLE[:-1])] == [False] * (len(WHOLE) - 1)
    assert cut_states("Ev e. " * 20_000 + "Ew çû bo", "(" * 3000 + ". Ev e." + ")" * 3000) == [truncation.CUT, truncation.WHOLE]
    assert cut_states("Ez hatim malê. Ew", "Ez hatim malê. 1923", "Ez hatim malê. ew") == [truncation.ONE_WORD, truncation.ONE_WORD, truncation.CUT]
    assert cut_states() == []


def test_truncation_is_the_same_in_any_batch():
    texts = [*CUT, *WHOLE] * 3
    assert cut_states(*texts) == [cut_states(x)[0] for x in texts]


def test_truncation_rows(rows):
    cuts = [("a", f"k{i}", "Ez hatim malê. Ew çû bo", 5) for i in range(40)] + [("a", "w", "Ez hatim malê. Ew", 5)]
    names = [("b", f"k{i}", "Ez hatim malê. Rojda", 5) for i in range(5)] + [("b", "c", "Ez hatim malê. Ew çû bo", 5)]
    df = rows("source string, k string, text string, cut int", *cuts, *names, (None, "n", None, 5), (None, "e", "", 5), (None, "w", "Ez hatim malê. Rojda", 5))
    got = {(r["source"], r["k"]): r["cut"] for r in truncation.flag(df, "source", "k").collect()}
    assert len(got) == df.count() and all(got[s, k] for s, k, *_ in cuts) and got["b", "c"]
    assert not any(got[s, k] for s, k, *_ in names[:5]) and not any(got[None, k] for k in "new")
    assert truncation.flag(df.limit(0), "source", "k").count() == 0


SAMPLES = {
    "aaa": ["na zo bo lu ko", "zo na ko bo mi", "bo lu na zo ko ri", "ko mi na lu zo"],
    "bbb": ["the spring thatch when other", "when thatch other the spring", "other spring the with when", "with the thatch spring when"],
}


def test_languages():
    p = languages.Profiles([(k, t) for k, v in SAMPLES.items() for t in v])
    text = "na zo bo lu ko mi. The spring thatch when other with. zo bo na lu ko mi!"
    s = languages.segments(pa.array([text, None, "", "123 ?!", "na zo"]), p)
    assert [p.languages[x] for x in s["language"]][:3] == ["aaa", "bbb", "aaa"] and s["row"].tolist()[:3] == [0, 0, 0] and s["words"].tolist()[:3] == [6, 6, 6]
    assert [text[a:b].strip() for a, b in zip(s["begin"][:3], s["end"][:3])][1] == "The spring thatch when other with."
    assert set(s["row"].tolist()) == {0, 4}


def test_language_rows(spark, rows):
    p = languages.Profiles([(k, t) for k, v in SAMPLES.items() for t in v])
    df = rows("k int, text string, label string, language string", (1, "na zo bo lu ko mi.", "aaa-Latn", "z"), (2, "na zo bo lu ko mi.", " BBB ", "z"), (3, "na zo bo", None, "z"), (4, None, None, "z"), (5, "na zo bo lu ko mi.", "und", "z"))
    assert sorted((r["k"], r["language"]) for r in languages.unlabelled(df, p, "k").collect()) == [(2, "aaa"), (5, "aaa")]
    docs = {r["k"]: (r["language"], r["segments"]) for r in languages.documents(df.select("k", "text"), p, "k").collect()}
    assert docs[1] == ("aaa", 1) and docs[4] == (None, 0) and len(docs) == 5
    labels = rows("l string", ("ku",), ("kmr_TR",), ("en-GB",), ("unknown",), ("",), (None,), ("TR ",))
    assert [r[0] for r in labels.select(languages.label_language(F.col("l"))).collect()] == ["kmr", "kmr", "eng", None, None, None, "tur"]


def test_rank_distance_by_hand():
    rank = np.full((3, 2), languages.ABSENT, np.int16)
    rank[0] = [0, 2]
    rank[1, 0] = 1
    got = languages._out_of_place([(np.array([0, 0, 0]), np.array([0, 0, 1]))], 2, rank, 4)
    assert got.tolist() == [[0.0, (2 + 4) / 8], [1.0, 1.0]]


def test_bpe(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", "  ", "Roj baş, hevalno! <|endoftext|>", "a" * 5000, "x" + "ê" * 300 + " it's 42.5km\r\n\t 日本語 👨‍👩", None, " 　 z q", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(400))]
    df = rows("doc_id long, text string, ids int, word int", *[(i, x, 0, 0) for i, x in enumerate(texts)])
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df.select("doc_id", "text"), "doc_id").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = bpe.encode(df.select("doc_id", "text"), "doc_id").select("doc_id", bpe.decode_ids(F.col("ids")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    counts = {r["doc_id"]: r["tokens"] for r in bpe.token_counts(df.select("doc_id", "text"), "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    ranks = bpe.read_ranks()
    assert bpe.heap_encode("rojbaş".encode(), ranks) == t.encode("rojbaş", add_special_tokens=False).ids


def test_bpe_with_rare_words(spark, rows, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abcd')}{rng.randrange(60)}" for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "z" * 500, "a1 a1"]
    df = rows("doc_id long, text string", *[(i if i % 9 else None, x) for i, x in enumerate(texts)])
    whole = sorted(map(str, bpe.encode(df, "doc_id").collect()))
    monkeypatch.setattr(bpe, "MOST_KNOWN", 20)
    assert sorted(map(str, bpe.encode(df, "doc_id").collect())) == whole and len(whole) == len(texts)
    assert bpe.encode(df.limit(0), "doc_id").count() == 0


def test_abuse_words():
    h, _, sent, of = abuse.read_words(pa.array(["tu gemarî yî", "tu GGGEMARİ yi", "tu g e m a r i yî", "tu g.e.m.a.r.î yî", "tu ge-marî yî", "tu g3m4rî yî", None, ""]))
    words = [h[of[sent] == i].tolist() for i in range(6)]
    assert all(w == words[0] for w in words)


def test_abuse_learns():
    rng = random.Random(5)
    good = ["roj", "mal", "av", "nan", "dar", "pir", "rê", "deng"]
    texts, labels = [], []
    for i in range(240):
        s = [" ".join(rng.choice(good) + rng.choice("abcdef") for _ in range(6)) + "." for _ in range(4)]
        if i % 4 == 0:
            s.insert(rng.randrange(4), f"Tu {rng.choice(['gemarî', 'ehmeq'])} yî, {rng.choice(good)}x{i}!")
        elif i % 4 == 1:
            s.insert(0, "Gemarî peyvek e.")
        texts.append(" ".join(s))
        labels.append(int(i % 4 == 0))
    p = languages.Profiles([("kmr", "roj mal av nan tu yî")])
    m = abuse.train(texts[:180], labels[:180], p)
    _, flagged = abuse.score_texts(pa.array(texts[180:] + [None, ""]), m)
    right = (flagged[:-2] == np.array(labels[180:], bool)).mean()
    assert right >= 0.9 and not flagged[-2:].any()
    none = abuse.train(["a b", "c"], [0, 0], p)
    assert abuse.score_texts(pa.array(["a b"]), none)[0].tolist() == [0.0]
