"""Operators against plain Python versions of their rules, and the published vectors of the metrics."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import minhash
from corpusloom.operators import corpus, curation, leakage, metrics, restoration, selection


def slow_signature(text, short=True):
    grams = {text[i : i + 5] for i in range(len(text) - 4)} or ({text} if text and short else set())
    if not grams:
        return [0] * 64
    xs = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
    return [min(((2 * k + 1) * x + k * 0x9E3779B9) & 0xFFFFFFFF for x in xs) for k in range(64)]


def test_signature():
    texts = ["", "ab", "rojbaş hevalno", "ê" * 20, None, "a😀bcd efg", "abcde", "x" * 5000]
    assert minhash.signatures(pa.array(texts)).to_pylist() == [None if t is None else slow_signature(t) for t in texts]
    assert minhash.signatures(pa.array(["ab", "abcde"]), False).to_pylist() == [[0] * 64, slow_signature("abcde")]
    assert minhash.signatures(pa.array([], pa.string())).to_pylist() == []
    rng = random.Random(6)
    many = ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(rng.randrange(300))) for _ in range(40)]
    assert minhash.signatures(pa.array(many)).to_pylist() == [slow_signature(t) for t in many]


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(1)
    base = [[rng.randrange(50) for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(60):
        s = list(rng.choice(base))
        for k in rng.sample(range(64), rng.randrange(0, 9)):
            s[k] = rng.randrange(1000, 2000)
        rows.append((i, s))
    rows.append((60, rows[0][1]))
    df = spark.createDataFrame(rows, "id int, sig array<long>")
    got = {(r[0], r[1], r[2]) for r in minhash.near_pairs(df, df).where("id_a < id_b").collect()}
    want = {(a, b, n) for a, x in rows for b, y in rows if a < b and (n := sum(p == q for p, q in zip(x, y))) >= 58}
    assert got == want and minhash.bands_for(58) == 8


def slow_greedy(rows):
    """rows: (pos, source, text) in order; the decision of each."""
    from collections import defaultdict

    exact, nop, sigs, out = set(), set(), defaultdict(list), {}
    for pos, source, text in rows:
        if text is None:
            out[pos] = "empty"
            continue
        e = " ".join(text.split())
        n = " ".join("".join(c for c in e.lower() if c not in ",.?!;:…").split())
        s, b = slow_signature(n), (source or "", len(e.split()) // 20)
        if e in exact:
            out[pos] = "exact_duplicate"
        elif n in nop:
            out[pos] = "punctuation_only_duplicate"
        elif any(sum(x == y for x, y in zip(s, t)) >= 58 for t in sigs[b]):
            out[pos] = "near_duplicate"
        else:
            out[pos] = None
            exact.add(e)
            nop.add(n)
            sigs[b].append(s)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_dedup(spark, seed):
    rng = random.Random(seed)
    words = ["roj", "baş", "heval", "mal", "çiya", "av", "nan", "kovar"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.choice([6, 25, 60]))) for _ in range(5)]
    rows = []
    for pos in range(45):
        t = rng.choice(base)
        kind = rng.randrange(5)
        if kind == 1:
            t = t + "!"
        elif kind == 2:
            t = t.replace(" ", ", ", 1)
        elif kind == 3:
            p = t.split()
            p[rng.randrange(len(p))] += "x"
            t = " ".join(p)
        rows.append((pos, rng.choice(["a", "b", None]), t if rng.random() > 0.05 else None))
    got = {r[0]: r[1] for r in curation.greedy_dedup(spark.createDataFrame(rows, "pos long, source string, text string")).collect()}
    assert got == slow_greedy(rows)


def test_reject_chain(spark):
    cases = [(None, "empty"), (" ", "empty"), ("123 ?", "no_letters"), ("كتاب جميل هنا ؟ ?", "arabic_script"), ("привет мир как дела?", "low_latin_ratio"), ("bê pirs e ev hevok", "no_question_mark"), ("binêre https://x.example/?a=1", "question_mark_only_in_url"), ("ev çi ye gelo îro???", "triple_question_marks"), ("{{a}} b?", "wiki_template"), ("tu kî?", "too_short"), ("tu îro li ku derê yî?", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(curation.reject_reason(F.col("text"))).collect()]
    assert got == [x for _, x in cases]


def test_question_types(spark):
    cases = [("tu kî yî?", "WHO"), ("KÎ ye?", "WHO"), ("ev çi ye?", "WHAT"), ("ew ku hat", "OTHER"), ("tu li ku yî?", "WHERE"), ("kengî kî hat?", "MULTIPLE_QUESTION"), ("tu baş î?", "YES_NO"), ("Ma tu hatî?", "MA"), ("gelo baş e?", "GELO"), ("roj", "OTHER")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(curation.question_type(F.col("text"))).collect()] == [x for _, x in cases]


def test_split_ids(spark):
    ids = spark.createDataFrame([(f"a{i}",) for i in range(100)] + [("a1",), (None,)], "id string")
    got = corpus.split_ids(ids, "id").collect()
    want = sorted((f"a{i}" for i in range(100)), key=lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest())
    assert {r["split"] for r in got if r["id"] in want[:90]} == {"train"} and sum(r["split"] == "validation" for r in got) == 5 and len(got) == 100
    assert corpus.split_ids(ids.limit(0), "id").count() == 0


def test_overlaps_and_caps(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("c", "validation"), (None, "test")], "id string, split string")
    got = {(r[0], r[1]): r[2] for r in corpus.overlap_counts(rows, F.col("id")).collect()}
    assert got == {("test", "train"): 1, ("test", "validation"): 0, ("train", "validation"): 0}
    assert [r["id"] for r in corpus.shared_ids(rows.where("id is not null"), "id").collect()] == ["a"]
    w = spark.createDataFrame([(f"d{i}", 10) for i in range(50)], "id string, w int")
    assert corpus.until_sum(w, "w", 95, "id").count() == 10


def slow_reach(costs, start, most, budget):
    end = start + 1
    while end < most and sum(costs[start : end + 1]) + 2 <= budget:
        end += 1
    return end


def slow_training(costs, name, budget=256):
    """Windows of one article, one after the other."""
    n, out = len(costs), []
    if n < 80:
        return [(0, n)] if n >= 40 else []
    at = 0
    while at < n and (not out or n - at >= 40):
        aim = 110 + int(hashlib.md5(f"42:{name}:{len(out)}".encode()).hexdigest()[:8], 16) % 71
        if out and n - at < 80:
            at = min(at, max(n - max(80, min(aim, n - at + 8)), out[-1][0] + 1))
        end = slow_reach(costs, at, min(at + aim, n), budget)
        if end < n and n - end < 40:
            end = max(end, slow_reach(costs, at, n, budget))
        out.append((at, end))
        if end == n:
            break
        at = max(end - 8, at + 1)
    return out


def pairs_of(spans):
    return [[(x["start"], x["end"]) for x in row] for row in spans.to_pylist()]


def test_training_spans():
    rng = random.Random(7)
    costs = [[rng.choice([1, 1, 2, 3, rng.randrange(1, 300)]) for _ in range(n)] for n in (0, 1, 39, 40, 79, 80, 81, 200, 333, 1000, 2500)] + [[1] * 5000, [400] * 100]
    names = [f"a{i}" for i in range(len(costs))]
    got = pairs_of(corpus.training_spans(pa.array(costs, pa.list_(pa.int32())), pa.array(names)))
    assert got == [slow_training(c, n) for c, n in zip(costs, names)]
    for c, spans in zip(costs, got):
        assert all(y[0] <= x[1] and y[0] > x[0] for x, y in zip(spans, spans[1:])) and (len(c) < 80 or all(b - a == 1 or sum(c[a:b]) <= 254 for a, b in spans))
    assert pairs_of(corpus.training_spans(pa.array([None, []], pa.list_(pa.int32())), pa.array([None, "x"]))) == [[], []]
    some = pa.array([[1] * 300, [], [500, 500], None], pa.list_(pa.int32()))
    assert pairs_of(corpus.inference_spans(some)) == [[(0, 254), (222, 300)], [], [(0, 1), (1, 2)], []]


def test_ranks_with_a_payload(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("id"), F.md5(F.col("id").cast("string")).alias("payload"), (F.col("id") % 7).alias("w"))
    got = corpus.ranked(rows, corpus.hash_order(F.col("id")), "id")
    s = got.select("rank", "payload").agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count(F.lit(1))).head()
    assert tuple(s) == (n, 1, n, n)
    assert corpus.until_sum(rows, "w", 1_500_000, "id").agg(F.sum("w")).head()[0] in range(1_500_000, 1_500_007)


def test_joined_texts_of_many_rows(spark):
    rows = spark.range(600_000).select(F.format_string("a%06d", "id").alias("id"), F.lit("x").alias("text"), F.lit(1).alias("w"))
    assert selection.joined_until(rows, "w", 300_000, "id").select("parts", F.length("text").alias("n")).head()[:] == (300_000, 300_000 * 3 - 2)


def test_draws(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", float(1 + i % 3)) for i in range(3000)] + [("k0000", 0.5), (None, 2.0), ("z", None), ("y", 0.0)], "id string, w double")
    got = corpus.drawn(rows, "id", "w", 6000).collect()
    assert sorted(r["draw"] for r in got) == list(range(1, 6001)) and len({r["id"] for r in got}) < 3000
    share = sum(int(r["id"][1:]) % 3 == 2 for r in got) / 6000
    assert abs(share - 0.5) < 0.03
    assert corpus.drawn(rows.limit(0), "id", "w", 5).count() == 0


def test_subwords(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from corpusloom.functions import subwords

    words = ["roj", "hevalno", "", "antîdemokratîk", "x" * 300, "roj"]
    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.DEFAULT_MODEL)
    want = [max(1, len(sp.encode(w))) for w in words]
    df = spark.createDataFrame([(1, words), (2, []), (3, None)], "k int, w array<string>")
    assert [r[0] for r in df.orderBy("k").select(subwords.word_costs(F.col("w"))).collect()] == [want, [], None]
    long = spark.createDataFrame([("a", ["antîdemokratîk"] * 400)], "k string, items array<string>")
    spans = [(r["start"], r["end"]) for r in corpus.windows(long, "k", subwords.word_costs(F.col("items")), training=False).orderBy("win").collect()]
    each = len(sp.encode("antîdemokratîk"))
    assert spans[0] == (0, 254 // each) and spans[-1][1] == 400
    assert subwords.quarters(pa.array(["", "abcd", "abcde", None])).tolist() == [1, 1, 2, 1]


def test_disjoint_splits(spark):
    ok = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test"), (None, "train"), (None, "test")], "id string, split string")
    corpus.assert_disjoint(ok, "id")
    with pytest.raises(ValueError, match="more than one split: b"):
        corpus.assert_disjoint(ok.union(spark.createDataFrame([("b", "train")], "id string, split string").select("id", "split")), "id")


def test_windows_and_masks(spark):
    df = spark.createDataFrame([("a", list(range(300))), ("b", []), ("c", None)], "k string, items array<int>")
    got = corpus.windows(df, "k", F.transform("items", lambda x: F.lit(1)), training=False).orderBy("win").collect()
    assert [(r["start"], r["end"], r["items"][0]) for r in got] == [(0, 254, 0), (222, 300, 222)]
    m = spark.createDataFrame([(["x"] * 12,), (["x"] * 10,)], "l array<string>")
    assert [sum(v is not None for v in r[0]) for r in m.select(corpus.edge_masked(F.col("l"))).collect()] == [6, 10]
    w = spark.createDataFrame([([None, 0, 0, 1, None], [1, 2]), ([0, 1, 1], [0, 3])], "w array<int>, l array<int>")
    assert [r[0] for r in w.select(corpus.placed_labels(F.col("w"), F.col("l"))).collect()] == [[None, None, 1, 2, None], [0, None, 3]]
    assert w.select(corpus.placed_labels(F.col("w"), F.col("l"), False)).head()[0] == [None, 1, None, 2, None]


def test_metrics_by_hand(spark):
    labels = metrics.CASE
    rng = random.Random(3)
    pairs = [(rng.choice(labels), rng.choice(labels)) for _ in range(500)]
    cube = metrics.confusion(spark.createDataFrame(pairs, "true string, pred string"))
    tp = {x: sum(a == b == x for a, b in pairs) for x in labels}
    f1 = {x: 2 * tp[x] / (sum(a == x for a, _ in pairs) + sum(b == x for _, b in pairs)) for x in labels}
    s = metrics.summary(cube, labels, labels[1:]).head()
    assert s["tokens"] == 500 and abs(s["accuracy"] - sum(tp.values()) / 500) < 1e-6
    assert abs(s["macro_f1"] - (f1["TITLE"] + f1["UPPER"]) / 2) < 1e-6
    assert abs(s["weighted_f1"] - sum(f1[x] * sum(a == x for a, _ in pairs) for x in labels) / 500) < 1e-6
    got = {r["label"]: r for r in metrics.per_label(cube, labels).collect()}
    assert all(abs(got[x]["f1"] - f1[x]) < 1e-6 for x in labels)
    assert metrics.per_label(metrics.confusion(spark.createDataFrame([], "true string, pred string")), labels).count() == 3


def test_class_weights(spark):
    counts = spark.createDataFrame([("KEEP", 3733862), ("TITLE", 620303), ("UPPER", 18747)], "label string, n long")
    got = {r["label"]: r["weight"] for r in corpus.class_weights(counts, "KEEP", 10.0).collect()}
    assert got == {"KEEP": 1.0, "TITLE": 2.45345, "UPPER": 10.0}


def test_decoding(spark):
    p = spark.createDataFrame([([0.4, 0.5, 0.1, 0.0, 0.0],), ([0.1, 0.6, 0.3, 0.0, 0.0],), ([0.3, 0.3, 0.2, 0.1, 0.1],)], "p array<double>")
    got = [(r[0]["label"], r[0]["confidence"]) for r in p.select(metrics.decode_marks(F.col("p"), restoration.FLOORS)).collect()]
    assert got == [("O", 0.4), ("COMMA", 0.6), ("O", 0.3)]
    c = spark.createDataFrame([([0.1, 0.9, 0.0], False, False), ([0.1, 0.9, 0.0], False, True), ([0.05, 0.0, 0.95], False, True), ([0.0, 1.0, 0.0], True, False)], "p array<double>, prot boolean, start boolean")
    got = [(r[0]["label"], r[0]["confidence"]) for r in c.select(metrics.decode_case(F.col("p"), F.col("prot"), F.col("start"))).collect()]
    assert got == [("TITLE", 0.9), ("KEEP", 0.1), ("UPPER", 0.95), ("KEEP", 1.0)]


def test_sweep_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.choice("OAB"), rng.choice("OAB"), rng.random()) for _ in range(400)]
    grid = [0.3, 0.5, 0.7]
    got = {(r["label"], r["threshold"]): r for r in metrics.sweep(spark.createDataFrame(rows, "gold string, arg string, conf double"), ["A", "B"], grid, "O").collect()}
    for lab in "AB":
        f1s = []
        for t in grid:
            pred = [a if a == lab and c >= t else ("O" if a == lab else a) for _, a, c in rows]
            tp = sum(p == g == lab for (g, _, _), p in zip(rows, pred))
            f1s.append(2 * tp / (sum(p == lab for p in pred) + sum(g == lab for g, _, _ in rows)))
            assert abs(got[lab, t]["f1"] - f1s[-1]) < 1e-6
        assert got[lab, grid[f1s.index(max(f1s))]]["best"]


def test_leakage(spark):
    text = "gelo tu îro li bajarê mezin bi hevalên xwe re çûyî û te nan xwar yan na bersiv bide min zû"
    train = spark.createDataFrame([("t1", "Roj baş."), ("t2", "roj baş"), ("t3", text + " ez li vir im"), ("t4", "tiştek din e"), ("t5", None)], "id string, text string")
    refs = spark.createDataFrame([("r1", "Roj  baş."), ("r2", "Roj baş."), ("r3", text)], "id string, text string")
    assert [tuple(r) for r in leakage.key_hits(train, refs, "exact").collect()] == [("t1", "r2")]
    assert sorted(r[0] for r in leakage.key_hits(train, refs, "nopunct").collect()) == ["t1", "t2"]
    assert [r[0] for r in leakage.span_hits(train, refs).collect()] == ["t3"]
    assert {r["id"]: r["reasons"] for r in leakage.leaked(train, refs).collect()}.keys() == {"t1", "t2", "t3"}
    assert {r["id"] for r in leakage.without(train, spark.createDataFrame([("t1",), (None,)], "id string")).collect()} == {"t2", "t3", "t4", "t5"}


def test_selection(spark):
    def take(sizes, total, floor):
        df = spark.createDataFrame([*sizes.items(), (None, 9)], "source string, size long")
        return {r["source"]: r["take"] for r in selection.allocation(df, "source", total, floor).collect()}

    # Floors 50, 10, 50; of the other 290 a has 950 of 1,000 free rows: 275.5 and 14.5, whole 275 and 14, and the one left to the first name.
    assert take({"a": 1000, "b": 10, "c": 100}, 400, 50) == {"a": 326, "b": 10, "c": 64}
    assert take({"a": 5, "b": 5}, 400, 50) == {"a": 5, "b": 5} and take({"a": 50, "b": 50, "c": 50}, 70, 40) == {"a": 40, "b": 30, "c": 0}
    rng = random.Random(9)
    for _ in range(5):
        sizes = {f"s{i}": rng.randrange(1, 3000) for i in range(12)}
        got = take(sizes, 900, 30)
        assert sum(got.values()) == 900 and all(min(30, sizes[k]) <= v <= sizes[k] for k, v in got.items())
    rows = spark.createDataFrame([(f"r{i}", "ab"[i % 2]) for i in range(30)] + [("x", None)], "id string, source string")
    assert selection.stratified(rows, "source", "id", 10, 3).count() == 10
    picks = selection.rounds(rows, "source", "id", 7).orderBy("pick").collect()
    assert [r["source"] for r in picks] == list("abababa")
    cand = spark.createDataFrame([(f"r{i:03d}", "kurmanji_news" if i % 3 else "tatoeba", "X" if i % 2 else "Y", float(i % 7)) for i in range(400)], "record_id string, source string, type string, score double")
    got = selection.capped_selection(cand, 100, {"kurmanji_news": 60, "tatoeba": 20}).collect()
    assert len(got) == 80 and len({r["record_id"] for r in got}) == 80
    assert selection.capped_selection(cand.limit(0)).count() == 0
    filled = selection.with_fillers(spark.createDataFrame([("a", "metn")], "id string, text string"), ["F."], "id").head()
    assert filled["text"] == "F. metn F." and filled["constructed"]


def slow_capped(rows, target, caps, free, share):
    """The rule one row after the other."""
    pools = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[0])) for s in caps}
    out, types, got, moved = [], {}, dict.fromkeys(caps, 0), True
    while moved and len(out) < target:
        moved = False
        for s in caps:
            while pools[s] and got[s] < caps[s] and len(out) < target:
                r = pools[s].pop(0)
                n = types.get(r[2], 0) + 1
                if len(out) < free or n / (len(out) + 1) <= share:
                    types[r[2]] = n
                    got[s] += 1
                    out.append(r[0])
                    moved = True
                    break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_capped_selection_follows_the_rule(spark, seed, monkeypatch):
    monkeypatch.setattr(selection, "AHEAD", 7)
    rng = random.Random(seed)
    rows = [(f"r{i:04d}", rng.choice("ab"), rng.choices("XYZ", [9, 1, rng.random()])[0], float(rng.randrange(9))) for i in range(500)]
    df = spark.createDataFrame(rows + [("q", "other", "X", 99.0)], "record_id string, source string, type string, score double")
    for target, caps, free, share in ((120, {"a": 100, "b": 100}, 10, 0.5), (400, {"b": 30, "a": 1000}, 5, 0.4)):
        got = [r["record_id"] for r in selection.capped_selection(df, target, caps, free, share).orderBy("pick").collect()]
        assert got == slow_capped(rows, target, caps, free, share)


def test_restoration(spark):
    rows = spark.createDataFrame([(1, "ez li amedê dijîm navê min azad e"), (2, ""), (3, None), (4, "Ez hatim. Tu?")], "key int, text string")

    def marks(windows):
        return [np.array([[0, 9, 0, 0, 0] if t == "dijîm" else [9, 0, 0, 0, 0] for t in w], float) for w in windows]

    def case(windows):
        return [np.array([[0, 9, 0] if t in ("amedê", "azad") else [9, 0, 0] for t in w], float) for w in windows]

    got = {r["key"]: r for r in restoration.restore(rows, "full", marks, case).collect()}
    assert got[1]["output"] == "Ez li Amedê dijîm, navê min Azad e" and got[1]["punctuation_only"] and got[1]["case_only"]
    assert got[2]["output"] == got[3]["output"] == "" and got[4]["output"] == "Ez hatim. Tu?"
    only = {r["key"]: r for r in restoration.restore(rows, "punctuation", marks).collect()}
    assert only[1]["output"] == "ez li amedê dijîm, navê min azad e" and only[1]["sentence_capitalized"] is None
    with pytest.raises(ValueError):
        restoration.restore(rows, "full", marks)
    with pytest.raises(ValueError):
        restoration.restore(rows, "other", marks, case)
    again = {r["key"]: r for r in restoration.idempotency(rows, marks, case).collect()}
    assert set(again) == {1, 4} and again[1]["exact"] and again[4]["near"]


def test_mean_logits():
    items = pa.array([["a"] * 300, [], None, ["b"]], pa.list_(pa.string()))
    used = pa.array([[i != 5 for i in range(300)], [], None, [True]], pa.list_(pa.bool_()))
    got = restoration.mean_logits(items, used, lambda ws: [[[i, len(w)] for i in range(len(w))] for w in ws], lambda w: np.ones(len(w), int)).to_pylist()
    assert [len(x) for x in got] == [300, 0, 0, 1] and got[0][5] is None and got[0][6] == [5.0, 254.0] and got[3] == [[0.0, 1.0]]
    # Words 222 to 253 are in both windows, 0-254 and 222-299.
    assert got[0][223] == [(222 + 0) / 2, (254 + 77) / 2] and got[0][299] == [76.0, 77.0]


def test_review_and_statistics(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "source string, reason string")
    got = {(r["source"], r["reason"]): r["n"] for r in curation.filter_statistics(rows).collect()}
    assert got == {("a", None): 2, ("b", None): 1, (None, "x"): 2, (None, "y"): 1, (None, None): 3}
    r = curation.rates(spark.createDataFrame([(True,), (False,), (None,)], "ok boolean"), ["ok"]).head()
    assert (r["n"], r["ok_rate"]) == (3, 0.5)
    w = spark.createDataFrame([("w1", ["Ez", ".", "ew", "Çû"], ["IGNORE", "IGNORE", "IGNORE", "KEEP"]), ("w2", [".", "5", "kes"], ["IGNORE", "IGNORE", "KEEP"])], "id string, tokens array<string>, labels array<string>")
    i = corpus.integrity(w).head()
    assert (i["checked"], i["after_end"], i["after_end_labelled"], i["not_lower"]) == (2, 1, 0, 1)
    g = curation.gates(spark.createDataFrame([("a", True)] * 9 + [("a", None)] + [("b", True)] * 4 + [("b", False), ("c", False)], "s string, accept boolean"), "s")
    assert {r["s"]: (r["accepted"], r["gate"]) for r in g.collect()} == {"a": (9, "PASS"), "b": (4, "REFILTER"), "c": (0, "REJECT")}


def test_label_numbers(spark):
    from corpusloom.functions import tokens as T

    df = spark.createDataFrame([(["O", "QUESTION", "IGNORE", None],)], "l array<string>")
    ids = T.label_ids(F.col("l"))
    assert df.select(ids).head()[0] == [0, 3, -100, -100] and df.select(T.labels_of(ids)).head()[0] == ["O", "QUESTION", "IGNORE", "IGNORE"]
    for bad in (T.label_ids(F.array(F.lit("X"))), T.labels_of(F.array(F.lit(9)))):
        with pytest.raises(Exception, match="unknown label"):
            df.select(bad).collect()


def test_events_in_complete_mode(spark, tmp_path):
    from corpusloom.streaming import dedup as streams

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a", 1.0) for h in range(5) for m in (0, 30)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    assert streams.run_once(streams.window_counts(stream()), f"{tmp_path}/a", f"{tmp_path}/b", "complete").count() == 5


def test_capped_selection_uses_up_skipped_rows(spark):
    kinds = ["Y" if i % 10 == 9 else "X" for i in range(2000)]
    cand = spark.createDataFrame([(f"r{i:04d}", "a", k, float(-i)) for i, k in enumerate(kinds)], "record_id string, source string, type string, score double")
    want, types = [], {}
    for i, k in enumerate(kinds):
        n = types.get(k, 0) + 1
        if len(want) < 100 and not (len(want) >= 10 and n / (len(want) + 1) > 0.6):
            types[k] = n
            want.append(f"r{i:04d}")
    got = selection.capped_selection(cand, 100, {"a": 100}, 10, 0.6).orderBy("pick").collect()
    assert [r["record_id"] for r in got] == want


def test_second_restoration_is_one_stage(spark, monkeypatch):
    written = []
    monkeypatch.setattr(restoration, "materialise", lambda df, name="table": written.append(name) or df)
    df = spark.createDataFrame([(i, f"Ez li malê bûm {i % 3}.") for i in range(9)] + [(9, " .!"), (10, None)], "key int, text string")
    got = restoration.idempotency(df, restoration.stand_in(5), restoration.stand_in(3)).where("near or not near").select("key", "exact", "near", "output", "again")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and not written
    assert sorted(r["key"] for r in got.collect()) == list(range(9))


def test_each_stretch_is_cut_once():
    from corpusloom.functions import stretches as S

    texts = ["ez li malê bûm ez li malê", "li\n malê", ""] * 500
    S.tokens_of.cache_clear()
    t = S.Tokens.of(S.Texts.of(texts))
    assert S.tokens_of.cache_info().misses == 4 and t.texts.written() == texts and [t.names[k] for k in t.ids[:9]] == "ez li malê bûm ez li malê li malê".split()
    assert np.flatnonzero(t.starts())[:3].tolist() == [0, 7, 9]


def test_stretches_are_as_expressions(spark):
    from corpusloom.functions import casing, stretches as S
    from corpusloom.functions import text as X
    from corpusloom.functions import tokens as T

    rng = random.Random(7)
    odd = list("abÇİIıiŞßŉſΣσς09٣.,?!;'’-_@/<>=[]{}½²ẞƛɤ") + ["http://", "HTTPS://", "a@b.co", "A.b@C.Org", "é", "̇", "ࡰ", "\U00010570", "\U00011f51", "3.14", "1,5", "[[x]]", "<b>", "K", "Ω"]
    texts = sorted({"".join(rng.choice(odd) for _ in range(rng.randrange(1, 9))) for _ in range(600)})
    x = F.col("x")
    kept = T.is_protected(x) | ~x.rlike(r"\p{L}")
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.tokenize(x), casing.lower(x), casing.title(x), F.upper(x), kept, casing.event(x)).collect()
    events = {None: 0, "SET": S.SET, "CONSUME": S.CONSUME, "CLEAR": S.CLEAR}
    for t, toks, low, title, up, fixed, what in rows:
        assert (list(S.tokens_of(t)[0]), S.lower(t), S.title(t), S.upper(t), S.keeps_case(t), S.event(t)) == (toks, low, title, up, fixed, events[what]), t
    blank = sorted({"".join(rng.choice(["a", ".", " ", "\n", "\r", "\t", "\v", "\f", "\x85", "\xa0", "\x1c", " ", "B"]) for _ in range(9)) for _ in range(400)})
    for t, w, s, near in spark.createDataFrame([(t,) for t in blank], "x string").select("x", X.normalize_whitespace(x), X.strip_supported(x), X.near_idempotent(x, F.lower(x))).collect():
        assert (S.normalize_whitespace(t), S.strip_supported(t), S.near_idempotent(t, t.lower())) == (w, s, near), t
