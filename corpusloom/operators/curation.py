"""Curation: the ordered reject chain, question types, checks of records, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import minhash
from ..functions import text as X
from ..plans.storage import materialise

# The markers of the question types, each a pattern between characters that are no part of a word.
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
MARKERS = {
    "WHO": "kî",
    "WHAT": "çi",
    "WHERE": rf"(?:li{X.WS}+ku|kuder[eê]?|li{X.WS}+kû)",
    "WHEN": "(?:kengî|kengê)",
    "WHY": "çima",
    "HOW": "çawa",
    "HOW_MANY": "çend",
    "GELO": "gelo",
}
MA = [rf"(?:^|[.!?]{X.WS}+){X.WS}*ma{EDGE_R}", rf"{EDGE_L}ma{X.WS}+{X.NWS}+{X.WS}+{X.NWS}+\?"]
# Signs of a broken decoding.
MOJIBAKE = r"\x{fffd}|Ã.|â€"


def question_problem(text: Column) -> Column:
    """Why a text is no question, or null: the first of the rules that holds."""
    bare = F.regexp_replace(text, "(?i)" + X.URL, " ")
    stub = text.rlike(r"\{\{[^}]+\}\}|\[\[[^\]]+\]\]") & (X.word_count(text) < 5) & text.contains("{{")
    return (
        F.when(~text.contains("?"), "no_question_mark")
        .when(~bare.contains("?"), "question_mark_only_in_url")
        .when(X.strip(bare).rlike(rf"^[?{X.SP}]+$"), "only_question_marks")
        .when(text.contains("???"), "triple_question_marks")
        .when(stub, "wiki_template")
    )


def reject_reason(text: Column, least_words: int = 5) -> Column:
    """Why a text is rejected, or null: the order of the tests is part of the result. Null and blank are empty."""
    s = X.script_stats(text)
    return (
        F.when(text.isNull() | (X.strip(text) == ""), "empty")
        .when(s["n_letters"] == 0, "no_letters")
        .when(s["arabic_ratio"] > 0.01, "arabic_script")
        .when(s["latin_ratio"] < 0.80, "low_latin_ratio")
        .otherwise(F.coalesce(question_problem(text), F.when(X.word_count(text) < least_words, "too_short")))
    )


def _matches(text: Column) -> list[tuple[str, Column]]:
    hits = [(n, text.rlike(f"(?iu){EDGE_L}{p}{EDGE_R}")) for n, p in MARKERS.items()]
    return [*hits, ("MA", text.rlike("(?iu)" + "|".join(MA)))]


def question_type(text: Column) -> Column:
    """The one marker that a text has, MULTIPLE_QUESTION for several, YES_NO for a bare question mark, else OTHER."""
    hits = _matches(text)
    n = sum((h.cast("int") for _, h in hits), F.lit(0))
    out = F.when(n > 1, "MULTIPLE_QUESTION")
    for name, h in hits:
        out = out.when(h, name)
    return out.when(text.contains("?"), "YES_NO").otherwise("OTHER")


def checks(records: DataFrame) -> DataFrame:
    """The records' seven checks, whether all hold, and the reasons of those that fail; columns record_id, source, text, license and ids.

    Thresholds are fixed values. A record of short sentences needs no licence to be accepted.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    s, n = X.script_stats(t), X.word_count(t, "review")
    only = X.letters(t)
    latin = F.coalesce(F.try_divide(F.length(only) - F.length(F.regexp_replace(only, "[A-Za-zÀ-öø-ÿçêîşûÇÊÎŞÛ]", "")), F.length(only)), F.lit(0.0))
    arabic = F.coalesce(F.try_divide(F.length(only) - F.length(F.regexp_replace(only, r"[\x{600}-\x{6FF}]", "")), F.length(only)), F.lit(0.0))
    q = X.count_of(t, "?")
    short = F.coalesce(F.col("source") == "tatoeba", F.lit(False))
    language = (arabic <= 0.01) & (latin >= 0.85)
    kurmanji = language & ((X.count_of(t, X.KURMANJI_LETTERS) >= 1) | short)
    turkish = X.count_of(t, X.TURKISH_LETTERS) >= 5
    marks = (q >= 1) & ~t.contains("???")
    question = marks & (n >= 5)
    context = F.when(short, n >= 5).otherwise((X.count_of(t, ".!") + q >= 2) | (n >= 20))
    encoding = ~t.rlike(MOJIBAKE)
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    licensed = some(F.col("license")) & (some(F.col("source_document_id")) | some(F.col("source_url")))
    accept = kurmanji & marks & question & context & encoding & (licensed | short) & ~turkish
    why = [("language", ~language), ("kurmanji", ~kurmanji), ("punct", ~marks), ("not_question", ~question), ("context", ~context), ("encoding", ~encoding), ("turkish_heavy", turkish)]
    return records.select(
        "record_id", "source", language.alias("language_ok"), (kurmanji & ~turkish).alias("kurmanji_ok"), marks.alias("punctuation_ok"), question.alias("question_is_real"), context.alias("context_ok"),
        encoding.alias("encoding_ok"), licensed.alias("license_metadata_ok"), accept.alias("accept"), F.concat_ws(",", *(F.when(c, F.lit(name)) for name, c in why)).alias("reasons"),
    )


def first_by(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """(key, first, n): for each key the least `order` (a struct with the id) and the number of rows."""
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def greedy_dedup(records: DataFrame, least: int = 58) -> DataFrame:
    """(pos, reject): the greedy decision of each record (pos, source, text), in the order of pos, without a loop over rows.

    A record is rejected if an earlier accepted one has its exact key, else its key without marks, else (same source, same
    twenty of words) at least `least` of 64 equal signature positions. Null texts are rejected as empty. pos is unique.

    Records of one key without marks, source and number of words have one signature and share every edge, so only the first
    of them can be accepted: the graph is of those heads, known by 128-bit hashes. A head is accepted if no earlier accepted
    head has its key or is near. Heads without an earlier neighbour are accepted at once; rounds decide the others, and carry only
    the open ones. The reasons follow from what was accepted.
    """
    base = records.select("pos", "source", X.exact_key(F.col("text")).alias("exact"), X.nopunct_key(F.col("text")).alias("nopunct"), (X.word_count(F.col("text")) / 20).cast("long").alias("bucket"), F.col("text").isNull().alias("empty"))
    base = base.select("pos", F.coalesce("source", F.lit("")).alias("src"), "bucket", F.unhex(F.md5("exact")).alias("e"), F.unhex(F.md5("nopunct")).alias("p"), minhash.signature(F.col("nopunct")).alias("sig"), "empty")
    base = materialise(base, "keys")
    live = base.where("not empty")
    heads = materialise(live.groupBy("p", "src", "bucket").agg(F.min("pos").alias("id"), F.first("sig").alias("sig")), "heads")
    near = minhash.near_classes(heads, heads, least, ("src", "bucket"))
    of = heads.select("id", "sig", "src", "bucket")
    near = near.join(of.withColumnsRenamed({"id": "a", "sig": "sig_a"}), ["sig_a", "src", "bucket"]).join(of.withColumnsRenamed({"id": "b", "sig": "sig_b"}), ["sig_b", "src", "bucket"]).where("a < b").select("a", "b")
    same = heads.groupBy("p").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = materialise(near, "near")
    keyed = materialise(heads.join(same, "p").select("id", "p", "first"), "keyed")  # heads whose key other heads have
    waits = near.select(F.col("b").alias("id")).union(keyed.where("id > first").select("id")).distinct()
    accepted = [materialise(heads.select("id").join(waits, "id", "left_anti"), "accepted")]
    open_ = materialise(waits, "open")
    while open_.head(1):
        done = reduce(DataFrame.union, accepted)
        # Earlier neighbours: any accepted one rejects; else any open one makes the head wait.
        by_near = near.join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        hit = by_near.join(done.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        wait = by_near.join(open_.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        mine = keyed.join(open_, "id", "left_semi")
        for others, name in ((done, "hit"), (open_, "wait")):
            least_id = keyed.join(others, "id", "left_semi").groupBy("p").agg(F.min("id").alias("least"))
            found = mine.join(least_id, "p").where("least < id").select("id")
            hit, wait = (hit.union(found), wait) if name == "hit" else (hit, wait.union(found))
        state = open_.join(hit.distinct().withColumn("hit", F.lit(True)), "id", "left").join(wait.distinct().withColumn("wait", F.lit(True)), "id", "left")
        state = materialise(state, "state")
        accepted.append(state.where("hit is null and wait is null").select("id"))
        open_ = state.where("hit is null and wait").select("id")
    done = materialise(reduce(DataFrame.union, accepted), "done")
    ok = heads.join(done, "id", "left_semi")
    by_exact = live.join(ok.select(F.col("id").alias("pos")), "pos", "left_semi").groupBy("e").agg(F.min("pos").alias("e_ok"))
    by_key = ok.groupBy("p").agg(F.min("id").alias("p_ok"))
    taken = ok.select(F.col("id").alias("pos"), F.lit(True).alias("ok"))
    judged = live.select("pos", "e", "p").join(taken, "pos", "left").join(by_exact, "e", "left").join(by_key, "p", "left")
    reason = F.when(F.col("ok"), F.lit(None)).when(F.col("e_ok") < F.col("pos"), "exact_duplicate").when(F.col("p_ok") < F.col("pos"), "punctuation_only_duplicate").otherwise("near_duplicate")
    return judged.select("pos", reason.alias("reject")).unionByName(base.where("empty").select("pos", F.lit("empty").alias("reject")))


def filter_statistics(rows: DataFrame) -> DataFrame:
    """(source, reason, n): counts by source, by reason and in all, in one pass; a null marks what was summed over."""
    return rows.groupingSets([["source"], ["reason"], []], "source", "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select("level", "source", "reason", "n")


def rates(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by..., n, rate of each column): shares of true among the known values of each column; null where none is known."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in columns))


def gates(rows: DataFrame, by: str, accept: str = "accept", good: float = 0.90, fair: float = 0.80) -> DataFrame:
    """(by, n, accepted, accept_rate, gate): PASS, REFILTER or REJECT by the share of rows accepted; unknown counts as not accepted."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(accept), F.lit(False))).alias("accepted"))
    rate = F.col("accepted") / F.col("n")
    return n.select(by, "n", "accepted", F.round(rate, 6).alias("accept_rate"), F.when(rate >= good, "PASS").when(rate >= fair, "REFILTER").otherwise("REJECT").alias("gate"))
