"""Letter case: Kurmanji images of a token, shapes, case labels, starts of sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from .batches import in_pieces
from .text import letters, strip, to_nfc
from .tokens import is_latin_word, is_mark, is_protected, respell, tokenize

CASE_LABELS = ["KEEP", "TITLE", "UPPER"]


def _low(x: Column) -> Column:
    return F.lower(F.translate(x, "İ", "i"))


def lower(text: Column) -> Column:
    """Lower case; both the dotted and the plain capital I become i."""
    return _low(to_nfc(text))


def upper(text: Column) -> Column:
    return F.upper(to_nfc(text))


def title(token: Column) -> Column:
    """The first letter upper, later letters lower, all else as it is."""
    parts = [F.regexp_extract(token, r"(?s)^([^\p{L}]*)(\p{L})(.*)$", i) for i in (1, 2, 3)]
    return F.when(token.rlike(r"\p{L}"), F.concat(parts[0], F.upper(parts[1]), _low(parts[2]))).otherwise(token)


def is_upper(token: Column) -> Column:
    x = letters(token)
    return (F.length(x) >= 2) & (F.upper(_low(x)) == x)


def is_title(token: Column) -> Column:
    x = letters(token)
    first, rest = F.substring(x, 1, 1), F.substring(x, F.lit(2), F.length(x))
    return (F.length(x) >= 1) & (F.upper(_low(first)) == first) & (_low(rest) == rest)


def is_lower(token: Column) -> Column:
    x = letters(token)
    return (F.length(x) >= 1) & (_low(x) == x)


def shape(token: Column) -> Column:
    return F.when(letters(token) == "", "NONE").when(is_upper(token), "UPPER").when(is_title(token), "TITLE").when(is_lower(token), "LOWER").otherwise("MIXED")


def apply_label(token: Column, label: Column) -> Column:
    """The token in the case that the label names; an error for any other label."""
    bad = F.raise_error(F.concat(F.lit("unknown case label: "), label)).cast("string")
    return F.when(label == "KEEP", token).when(label == "TITLE", title(token)).when(label == "UPPER", F.upper(token)).otherwise(bad)


def case_label(token: Column) -> Column:
    """The label of a token as written: KEEP, TITLE, UPPER, or IGNORE where case says nothing."""
    s = shape(token)
    ignored = is_protected(token) | ~is_latin_word(token) | s.isin("NONE", "MIXED")
    return F.when(ignored, "IGNORE").when(s == "UPPER", "UPPER").when((s == "TITLE") & (F.length(letters(token)) >= 2), "TITLE").when(s == "LOWER", "KEEP").otherwise("IGNORE")


def same_but_case(a: Column, b: Column) -> Column:
    return lower(a).eqNullSafe(lower(b))


# Tokens that neither start nor end a sentence.
SKIP = list(",\"'«»“”‘’()[]{}<>")


def first_letter_is_upper(token: Column) -> Column:
    """Whether the first letter of a token is upper case; true where it has none."""
    x = F.substring(letters(token), 1, 1)
    return (x == "") | (F.upper(_low(x)) == x)


def event(token: Column, after: str = ".?!", number_starts: bool = False) -> Column:
    """What a token does to the state "a sentence starts next": SET, CONSUME, CLEAR, or null for nothing."""
    out = F.when(token.isin(*after), "SET").when(token.isin(*SKIP) | is_mark(token), F.lit(None)).when(token.rlike(r"\p{L}"), "CONSUME")
    return out if number_starts else out.when(token.rlike(r"\p{Nd}"), "CLEAR")


def start_flags(events: pa.ListArray, first: bool = True) -> pa.ListArray:
    """list<boolean> of lists of events: a word begins a sentence if the last event before it, or else the text's begin, says so."""
    size = pc.fill_null(pc.list_value_length(events), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    flat = pc.list_flatten(events)
    places = np.arange(len(flat))
    text = np.repeat(offs[:-1], size)
    is_set, consumes = (pc.fill_null(pc.equal(flat, x), False).to_numpy(zero_copy_only=False).astype(bool) for x in ("SET", "CONSUME"))
    last = np.maximum.accumulate(np.where(np.asarray(flat.is_valid()), places, -1)) if len(flat) else places
    before = np.concatenate([[-1], last[:-1]]) if len(flat) else places
    open_ = np.where(before >= text, is_set[np.maximum(before, 0)], first) if len(flat) else is_set
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(consumes & open_, pa.bool_()))


@F.arrow_udf(ArrayType(BooleanType()))
def _start_flags(events: pa.Array) -> pa.Array:
    return in_pieces(start_flags, events)


@F.arrow_udf(ArrayType(BooleanType()))
def _start_flags_inside(events: pa.Array) -> pa.Array:
    return in_pieces(lambda x: start_flags(x, False), events)


def starts(tokens: Column, first: bool = True) -> Column:
    """array<boolean>: whether each token is the first letter-word of a sentence. Events are expressions, their order arrays of a batch."""
    return (_start_flags if first else _start_flags_inside)(F.transform(tokens, lambda t: event(t)))


def mark_starts(tokens: DataFrame, key: str = "doc_id", pos: str = "pos", tok: str = "tok") -> DataFrame:
    """The same for one row a token: adds `start`. The state before a token is the last event before it."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    e = event(F.col(tok))
    return tokens.withColumn("event", e).withColumn("before", F.last("event", True).over(w)).withColumn("start", F.coalesce((F.col("event") == "CONSUME") & F.coalesce(F.col("before") == "SET", F.lit(True)), F.lit(False))).drop("before", "event")


def capitalise_starts(text: Column) -> Column:
    """The text with the first letter-word of each sentence in title case and all spacing kept."""
    t = to_nfc(text)
    toks = tokenize(t)
    new = F.zip_with(toks, starts(toks), lambda x, s: F.when(s, title(x)).otherwise(x))
    return F.when(F.size(toks) > 0, respell(t, new)).otherwise(t)


def case_labelled(text: Column) -> Column:
    """array<struct<tok,label,orig>>: tokens as a model sees them (lower case, sentence starts capital), with case labels.

    Null for blank texts and where lower case changes the number of tokens.
    """
    t = to_nfc(text)
    orig = tokenize(t)
    low = lower(t)
    seen = tokenize(low)
    begin = starts(seen)
    rows = F.zip_with(F.arrays_zip(orig.alias("o"), seen.alias("s")), begin, lambda x, b: F.struct(F.when(b, title(x["s"])).otherwise(x["s"]).alias("tok"), F.when(b, "IGNORE").otherwise(case_label(x["o"])).alias("label"), x["o"].alias("orig")))
    return F.when((strip(t) != "") & (F.size(orig) == F.size(seen)) & (F.size(orig) > 0), rows)


def case_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, tok, label, orig): the same as case_labelled with a row for each token, which is the way for whole tables:
    each expression is evaluated once a token in compiled code, and the sentence state is a window over the text's tokens.
    """
    t = texts.where(F.col(text).isNotNull()).select(key, to_nfc(F.col(text)).alias("_t"))
    both = t.select(key, tokenize(F.col("_t")).alias("o"), tokenize(lower(F.col("_t"))).alias("s")).where((F.size("o") == F.size("s")) & (F.size("o") > 0))
    rows = both.select(key, F.posexplode(F.arrays_zip("o", "s")).alias("pos", "x")).select(key, "pos", F.col("x.o").alias("orig"), F.col("x.s").alias("seen"))
    rows = mark_starts(rows, key, "pos", "seen")
    return rows.select(key, "pos", F.when(F.col("start"), title(F.col("seen"))).otherwise(F.col("seen")).alias("tok"), F.when(F.col("start"), "IGNORE").otherwise(case_label(F.col("orig"))).alias("label"), "orig")
