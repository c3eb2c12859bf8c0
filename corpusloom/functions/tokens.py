"""Tokens, labels by the next mark, joins that keep every word, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MARKS, NWS, latin_text, normalize_for_dataset, strip, to_nfc

# Letters of a word, and the patterns of a token in order of preference.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſÇçÊêÎîŞşÛûİı"
TOKEN = (
    rf"(https?://{NWS}+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}|[{LETTER}][{LETTER}0-9]*(?:['’\-][{LETTER}0-9]+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|[,.?!]|{NWS})"
)
OLD_TOKEN = rf"([0-9]+(?:[.,][0-9]+)*|[{LETTER}]+(?:['’][{LETTER}]+)*|[.?,:;\-!—…¿¡]|{NWS})"
LABEL_OF = {",": "COMMA", ".": "PERIOD", "?": "QUESTION", "!": "EXCLAMATION"}
LABELS = ["O", "COMMA", "PERIOD", "QUESTION", "EXCLAMATION"]
# Older labels and the marks that count as one of them.
OLD_LABELS = ["0", ".", ",", "?", "-", ":"]
OLD_MARKS = {"!": ".", ";": ",", "…": ".", "؟": "?", "،": ",", ".": ".", ",": ",", "?": "?", "-": "-", ":": ":"}


def tokenize(text: Column) -> Column:
    """array<string>: addresses, words with inner apostrophes and hyphens, numbers, marks, any other character."""
    return F.regexp_extract_all(to_nfc(text), F.lit(TOKEN), F.lit(1))


def is_mark(token: Column) -> Column:
    return token.isin(*MARKS)


def words_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_mark(t))


def _lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = (F if out is None else out).when(c == k, F.lit(v))
    return out.otherwise(default)


def label_of(mark: Column) -> Column:
    return _lookup(mark, LABEL_OF, F.lit("O"))


def mark_of(label: Column) -> Column:
    return _lookup(label, {v: k for k, v in LABEL_OF.items()}, F.lit(""))


def following(tokens: Column) -> Column:
    """The array moved up by one: at each place the next token, at the last an empty string."""
    return F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit("")))


def labelled(tokens: Column) -> Column:
    """array<struct<tok,label>>: each word with the mark right after it; leading and further marks are skipped."""
    pairs = F.zip_with(tokens, following(tokens), lambda t, n: F.struct(t.alias("tok"), label_of(n).alias("label")))
    pairs = F.filter(pairs, lambda x: x["tok"].isNotNull())
    return F.filter(pairs, lambda x: ~is_mark(x["tok"]))


def old_tokens(text: Column) -> Column:
    return F.regexp_extract_all(to_nfc(strip(text)), F.lit(OLD_TOKEN), F.lit(1))


def old_labelled(text: Column) -> Column:
    """array<struct<tok,label>> of the older scheme: a word's label is the mark after it, mapped to the older labels.

    Null where there are fewer than three words or no mark at all.
    """
    toks = old_tokens(text)
    mapped = lambda c: _lookup(c, OLD_MARKS, F.lit("0"))
    pairs = F.zip_with(toks, following(toks), lambda t, n: F.struct(F.lower(t).alias("tok"), mapped(n).alias("label")))
    words = F.filter(pairs, lambda x: x["tok"].rlike(r"[\p{L}\p{N}]"))
    return F.when((F.size(words) >= 3) & F.exists(words, lambda x: x["label"] != "0"), words)


def old_sentence(text: Column) -> Column:
    """Whether the older preparation keeps a sentence: no straight or opening angle quotes, Latin letters, 3 to 128 words, a mark."""
    words = old_labelled(text)
    return F.coalesce(~text.contains('"') & ~text.contains("«") & latin_text(text, 12) & (F.size(words) <= 128), F.lit(False))


def asr_like(text: Column) -> Column:
    """What speech recognition would write: the older tokens with a letter or digit, lower case, no marks."""
    return F.array_join(F.transform(F.filter(old_tokens(text), lambda t: t.rlike(r"[\p{L}\p{N}]")), F.lower), " ")


def old_joined(words: Column, labels: Column) -> Column:
    """The older way to write words with their labels: marks attached, capitals at the beginning and after a full or question mark."""
    before = F.concat(F.array(F.lit(".")), F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    spelt = F.zip_with(words, before, lambda w, b: F.when(b.isin(".", "?"), up(w)).otherwise(w))
    return F.array_join(F.zip_with(spelt, labels, lambda w, x: F.when(x.isin(".", "?", ",", "-", ":"), F.concat(w, x)).otherwise(w)), " ")


def plain_words(text: Column) -> Column:
    """The words of an article as they go into a restoration test: dataset form, bars as blanks, joined by one space, lower case."""
    words = words_of(tokenize(F.replace(normalize_for_dataset(text), F.lit("|"), F.lit(" "))))
    return F.lower(F.translate(F.array_join(words, " "), "İ", "i"))


def label_ids(labels: Column, names: list[str] | None = None, ignored: int = -100) -> Column:
    """array<int>: the place of each label among the names; IGNORE and null have the ignored id; an error for any other."""
    names = names or LABELS
    table = {x: i for i, x in enumerate(names)} | {"IGNORE": ignored}
    bad = lambda x: F.raise_error(F.concat(F.lit("unknown label: "), x)).cast("int")
    number = lambda x: _lookup(x, table, bad(x))
    return F.transform(labels, lambda x: F.when(x.isNull(), ignored).otherwise(number(x)))


def labels_of(ids: Column, names: list[str] | None = None, ignored: int = -100) -> Column:
    """array<string>: the reverse of label_ids; ignored ids are IGNORE; an error for ids without a label."""
    table = F.array(*map(F.lit, names or LABELS))
    bad = lambda i: F.raise_error(F.concat(F.lit("unknown label id: "), i.cast("string"))).cast("string")
    return F.transform(ids, lambda i: F.when(i == ignored, "IGNORE").otherwise(F.coalesce(F.get(table, i), bad(i))))


def join_words(words: Column, marks: Column) -> Column:
    """Words with their marks, one space between; an error where the lengths differ."""
    same = F.size(words) == F.size(marks)
    joined = F.array_join(F.zip_with(words, marks, lambda w, m: F.concat(w, F.when(is_mark(m), m).otherwise(""))), " ")
    return F.when(~same, F.raise_error(F.lit("words and marks differ in number")).cast("string")).otherwise(joined)


def respell(text: Column, tokens: Column) -> Column:
    """The text with its tokens respelt and all that stands between them kept; an error where the numbers differ."""
    gaps = F.split(text, TOKEN, -1)
    same = F.size(gaps) == F.size(tokens) + 1
    body = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.concat(g, t)), "")
    return F.when(~same, F.raise_error(F.lit("tokens don't fit the text")).cast("string")).otherwise(F.concat(body, F.element_at(gaps, -1)))


def is_url(token: Column) -> Column:
    return token.rlike("(?i)^https?://")


def is_email(token: Column) -> Column:
    return token.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def is_number(token: Column) -> Column:
    return token.rlike(r"^[\p{Nd}.,]*\p{Nd}[\p{Nd}.,]*$")


# Fixed value: signs of markup in a token.
MARKUP = r"\[\[|\]\]|\{\{|\}\}|={2,}|__+|</?[a-zA-Z]+>"


def is_protected(token: Column) -> Column:
    """Marks, addresses, numbers and markup: tokens whose letter case is left alone."""
    return is_mark(token) | is_url(token) | is_email(token) | is_number(token) | token.rlike(MARKUP)


def is_latin_word(token: Column) -> Column:
    return token.rlike(rf"^[{LETTER}0-9'’\-]+$")


def spans(words: Column, size: int, stride: int | None = None) -> Column:
    """array<string>: word spans of one size; the stride is half the size unless given."""
    step = max(1, size // 2) if stride is None else stride
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def grams(text: Column, size: int = 5, short_as_itself: bool = True) -> Column:
    """Distinct character n-grams; a shorter text is one gram, or none."""
    n = F.length(text)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size))))
    few = F.filter(F.array(text), lambda x: x != "") if short_as_itself else F.array().cast("array<string>")
    return F.when(n >= size, many).otherwise(few)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 where one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
