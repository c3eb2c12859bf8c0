"""Readers, sinks and streams on small files."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.curation import curate
from corpusloom.sources import readers, sinks
from corpusloom.streaming import dedup


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"article_id": "1", "text": "ê"}\n\n{"article_id": 2, "text": "b", "more": 1}\n', encoding="utf-8")
    got = readers.json_lines(spark, str(p), readers.ARTICLE).collect()
    assert [(r[0], r[1]) for r in got] == [("1", "ê"), ("2", "b")]
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), readers.ARTICLE).collect()
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.jsonl").write_text('{"article_id": "3", "text": "c"}\n')
    p.unlink()
    assert readers.folder_lines(spark, str(tmp_path), readers.ARTICLE).count() == 1


def test_tsv_csv_pairs(spark, tmp_path):
    p = tmp_path / "s.tsv.bz2"
    p.write_bytes(bz2.compress("1\tkmr\tTu kî yî?\tu\n2\teng\tWho?\n3\tkmr\n".encode()))
    assert [(r["id"], r["text"], r["user"]) for r in readers.sentences_tsv(spark, str(p)).collect()] == [("1", "Tu kî yî?", "u"), ("2", "Who?", None)]
    assert readers.sentences_tsv(spark, str(p), "kmr").count() == 1
    q = tmp_path / "r.csv"
    q.write_text('record_id,accept,comment\n1,yes,"a ""b"", c"\n', encoding="utf-8")
    assert tuple(readers.review_csv(spark, str(q), ["record_id", "accept", "comment"]).head()) == ("1", "yes", 'a "b", c')
    t = tmp_path / "pairs.txt"
    t.write_text("# no | no\na b. | a b\nplain\n", encoding="utf-8")
    assert [tuple(r) for r in readers.paired_lines(spark, str(t)).collect()] == [("a b.", "a b")]
    assert readers.one_text(spark, "x").head()[0] == "x"


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text></revision></page>"
    p = tmp_path / "dump.xml.bz2"
    p.write_bytes(bz2.compress(("<mediawiki>" + page.format("A", 0, "metn ê") + page.format("T:B", 1, "x") + page.format("", 0, "y") + "</mediawiki>").encode()))
    assert [tuple(r) for r in readers.wiki_dump(spark, str(p)).collect()] == [("A", "metn ê")]


def test_asr_json(spark, tmp_path):
    for n, x in enumerate((["a", "b"], [{"word": "a"}, {"text": "b"}, {"token": "c"}], {"words": ["a"]}, {"text": " a b "})):
        (tmp_path / f"{n}.json").write_text(json.dumps(x))
    got = {r["path"][-6:]: r["words"] for r in readers.asr_json(spark, str(tmp_path)).collect()}
    assert got == {"0.json": ["a", "b"], "1.json": ["a", "b", "c"], "2.json": ["a"], "3.json": ["a", "b"]}


def test_union_and_last_wins(spark):
    a = spark.createDataFrame([("1", None)], "id string, source string")
    b = spark.createDataFrame([("2", "x")], "id string, text string")
    got = sorted((r["id"], r["source"], r["text"]) for r in readers.union_sources({"a": a, "none": None, "b": b}).collect())
    assert got == [("1", "a", None), ("2", "b", "x")]
    with pytest.raises(ValueError):
        readers.union_sources({"a": None})
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), (None, "z", 3)], "id string, text string, line int")
    assert [tuple(r) for r in readers.keyed_texts(rows).collect()] == [("k", "new")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 2)], "id string, split string, n int")
    sinks.by_split(df, str(tmp_path / "s"))
    assert {x.name for x in (tmp_path / "s").iterdir() if x.is_dir()} == {"split=train", "split=test"}
    h = sinks.content_hash(df).head()
    assert h == sinks.content_hash(df.orderBy(F.desc("id")).repartition(3)).head() and h != sinks.content_hash(df.limit(1)).head()
    sinks.confusion_csv(spark.createDataFrame([("A", "A", 3), ("B", "A", 1)], "true string, pred string, n long"), ["A", "B"], str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text().split()
    assert text == ["true,A,B", "A,3,0", "B,1,0"]
    sinks.word_tsv(spark.createDataFrame([(["ez", "im"], ["0", "."])], "words array<string>, labels array<string>").coalesce(1), str(tmp_path / "t"))
    assert next((tmp_path / "t").glob("*.txt")).read_text() == "ez\t0\t0\nim\t1\t.\n\n"
    sinks.without_ids(df, df.where("id = 'a'"), "id", str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 1
    assert sinks.blind(df, ["id"], ["ok"]).head()["ok"] == ""


def test_streams(spark, tmp_path):
    texts = [("r1", "a", "Roj baş ji we re hevalno.", 0), ("r2", "a", "Roj baş ji we re hevalno.", 1), ("r3", "a", "Roj baş ji we re hevalno", 2), ("r4", "b", "Tiştek din e ev.", 3)]
    df = spark.createDataFrame(texts, "record_id string, source string, text string, n int").withColumn("landed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = dedup.run_once(dedup.exact_stream(stream), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(r["record_id"] for r in out.collect()) in (["r1", "r3", "r4"], ["r2", "r3", "r4"])
    near = dedup.run_once(dedup.near_stream(stream), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert {r["record_id"]: r["reject"] for r in near.collect()} == {"r1": False, "r2": True, "r3": True, "r4": False}


def test_curation_plan(spark):
    rows = [("r1", "a", "Tu îro li ku derê yî, hevalo?", 1), ("r2", "a", "Tu îro li ku derê yî hevalo?", 2), ("r3", "b", None, 3), ("r4", "b", "Gelo tu sibê bi me re tê malê?", 4)]
    df = spark.createDataFrame(rows, "record_id string, source string, text string, n int").withColumn("landed_at", F.timestamp_seconds("n"))
    got = {r["record_id"]: (r["accepted_id"], r["reject_reason"]) for r in curate(df).collect()}
    assert got == {"r1": ("v2q_000001", None), "r2": (None, "punctuation_only_duplicate"), "r3": (None, "empty"), "r4": ("v2q_000002", None)}
    assert curate(df.limit(0)).count() == 0


def test_near_stream_reaches_back_to_the_first_row(spark, tmp_path):
    texts = [f"{i * 7919 % 10007:05d}{i:05d}{i * 104729 % 99991:05d} kurt e" for i in range(2300)]
    data = [(f"r{i:05d}", "a", x) for i, x in enumerate(texts)] + [("z", "a", texts[0])]
    df = spark.createDataFrame(data, "record_id string, source string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["record_id"]: r["reject"] for r in dedup.run_once(dedup.near_stream(stream), str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    assert sum(not x for x in got.values()) > 2100 and got["z"]
