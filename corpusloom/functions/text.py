"""Text functions as Catalyst expressions: normal forms, keys, counts, spans.

White space is always named by an explicit class, because the engines disagree on the short one. Every function takes and
returns columns; null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that Python calls white space.
SP = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SP}]"
NWS = f"[^{SP}]"
# Marks that labels name, marks that preparation drops, letters that count as Kurmanji or Turkish.
MARKS = ",.?!"
STRIP_MARKS = ":;—–…\"'«»“”()[]{}<>/"
OUTER_QUOTES = "\"'“”«»"
KURMANJI_LETTERS = "çêîşûÇÊÎŞÛ"
TURKISH_LETTERS = "ğıİöüĞ"
ARABIC = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
LATIN = r"A-Za-zÀ-öø-ÿĀ-ſƀ-ɏ"
URL = r"https?://" + NWS + r"+|www\." + NWS + "+"
# What counts as a word in the three word counts.
WORD_CLASSES = {
    "filter": r"A-Za-zÀ-öø-ÿĀ-ſƀ-ɏçêîşûÇÊÎŞÛğĞıİöÖüÜ'",
    "review": r"A-Za-zÀ-öø-ÿçêîşûÇÊÎŞÛğĞıİöÖüÜ'",
    "build": r"A-Za-zÀ-öø-ÿĀ-ſƀ-ɏçêîşûÇÊÎŞÛ'",
}
# Characters before or at which composition can change a text: marks, and characters whose composed form is another.
UNSTABLE = r"[\p{M}\x{340}-\x{345}\x{374}\x{37e}\x{387}\x{1100}-\x{11ff}\x{1f00}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{f900}-\x{faff}\x{fb1d}-\x{fb4f}\x{2f800}-\x{2fa1f}\x{958}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{2adc}]"


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def to_nfc(text: Column) -> Column:
    """Canonical composition. Only texts with a character that it could change are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(UNSTABLE), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def normalize_whitespace(text: Column) -> Column:
    """One kind of line end, runs of blanks as one space, at most one empty line, nothing at the ends."""
    t = F.regexp_replace(text, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[ \t\x{0c}\x{0b}]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_unsupported(text: Column, ellipsis_to_period: bool = True) -> Column:
    """Marks that no label names become spaces; an ellipsis becomes a full stop or a space."""
    to = "." if ellipsis_to_period else " "
    t = F.replace(F.replace(text, F.lit("..."), F.lit(to)), F.lit("…"), F.lit(to))
    return normalize_whitespace(F.translate(t, STRIP_MARKS, " " * len(STRIP_MARKS)))


def normalize_for_dataset(text: Column, ellipsis_to_period: bool = True) -> Column:
    return strip_unsupported(to_nfc(text), ellipsis_to_period)


def normalize_for_inference(text: Column) -> Column:
    return normalize_whitespace(to_nfc(text))


def strip_supported(text: Column) -> Column:
    """Without the marks that labels name."""
    return normalize_whitespace(F.translate(text, MARKS, ""))


def preserves_text(before: Column, after: Column) -> Column:
    """Whether only marks were inserted."""
    side = lambda x: strip_supported(normalize_whitespace(to_nfc(x)))
    return side(before).eqNullSafe(side(after))


def near_idempotent(a: Column, b: Column) -> Column:
    """Whether two texts differ in marks and letter case only."""
    side = lambda x: strip_supported(F.lower(F.translate(to_nfc(x), "İ", "i")))
    return a.eqNullSafe(b) | side(a).eqNullSafe(side(b))


def strip_outer_quotes(text: Column) -> Column:
    t = strip(text)
    quotes = [q for q in OUTER_QUOTES]
    both = (F.length(t) >= 2) & F.substring(t, 1, 1).isin(quotes) & F.right(t, F.lit(1)).isin(quotes)
    return F.when(both, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def exact_key(text: Column, outer_quotes: bool = True) -> Column:
    """The text by which exact copies are told: composed, blanks collapsed, outer quotes dropped if asked."""
    t = to_nfc(text)
    return collapse(strip_outer_quotes(t) if outer_quotes else t)


def lower_key(text: Column) -> Column:
    return F.lower(exact_key(text, False))


def nopunct_key(text: Column, outer_quotes: bool = True) -> Column:
    """The text by which copies are told that differ in marks and letter case only."""
    return collapse(F.regexp_replace(F.lower(exact_key(text, outer_quotes)), "[,.?!;:…]+", ""))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def script_stats(text: Column) -> Column:
    """struct(n_letters, arabic_ratio, latin_ratio); a text without letters counts as Arabic."""
    only = letters(text)
    n = F.length(only)
    arabic = n - F.length(F.regexp_replace(only, f"[{ARABIC}]", ""))
    latin = n - F.length(F.regexp_replace(only, f"[{LATIN}]", ""))
    none = n == 0
    return F.struct(n.cast("long").alias("n_letters"), F.when(none, 1.0).otherwise(F.try_divide(arabic, n)).alias("arabic_ratio"), F.when(none, 0.0).otherwise(F.try_divide(latin, n)).alias("latin_ratio"))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are among the given ones."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_count(text: Column, kind: str = "filter") -> Column:
    return F.regexp_count(text, F.lit(f"[{WORD_CLASSES[kind]}]+")).cast("long")


def sentence_spans(text: Column) -> Column:
    """array of stretches that end after each sentence mark, also inside decimals; blank ones are dropped."""
    found = F.regexp_extract_all(text, F.lit(r"([^.?!]*[.?!]|[^.?!]+)"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def question_context(text: Column, most: int = 1200) -> Column:
    """At most `most` characters around the first question mark, or from the start where there is none."""
    t = collapse(to_nfc(text))
    at = F.greatest(F.lit(0), F.locate("?", t) - 1 - most // 2)
    cut = F.when(F.locate("?", t) == 0, F.substring(t, 1, most)).otherwise(strip(F.substring(t, at + 1, F.lit(most))))
    return F.when(F.length(t) <= most, t).otherwise(cut)


def strip_markup(text: Column) -> Column:
    """Plain text of wiki or HTML markup by replacement rules; nested templates lose their innermost level only.

    The patterns and their order are fixed values.
    """
    t = F.regexp_replace(text, r"\{\{[^{}]*\}\}", " ")
    t = F.regexp_replace(t, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "'{2,}", ""), "={2,}", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, rf"\[https?://[^\]{SP}]+{WS}+([^\]]+)\]", "$1")
    return collapse(F.regexp_replace(t, rf"https?://{NWS}+", " "))


# Beginnings of lines that are tables, lists, files or categories.
LINE_STARTS = ["{|", "|", "*", "#", ":", "[[file:", "[[dosya:", "[[category:", "[[kategorî:"]


def drop_markup_lines(text: Column) -> Column:
    """Without headings, table and list lines, files and categories."""

    def kept(line: Column) -> Column:
        s = F.lower(strip(line))
        bad = F.lit(False)
        for p in LINE_STARTS:
            bad = bad | s.startswith(p)
        return (s == "") | ~(bad | (s.startswith("=") & s.endswith("=")))

    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), kept), "\n")


def wiki_plain(text: Column) -> Column:
    """Plain text of an article's source: lines dropped first, then links, templates, tags and addresses."""
    t = F.regexp_replace(drop_markup_lines(text), r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\{\{[^{}]*\}\}", " "), "<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(t, "'{2,}", ""), rf"https?://{NWS}+", " ")


def is_redirect(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, f"^{WS}+", "")).rlike("^#(?:redirect|beralîkirin)")


def is_stub(text: Column, least_words: int = 5) -> Column:
    """Fewer words, parted by white space, than an article needs; null and blank texts are stubs."""
    t = F.coalesce(collapse(text), F.lit(""))
    return F.when(t == "", True).otherwise(F.size(F.split(t, " ")) < least_words)


def old_plain(text: Column) -> Column:
    """The input form of the older restoration: marks that don't touch a digit and Arabic marks become blanks, all in lower case."""
    t = F.regexp_replace(text, r"(?<!\p{Nd})[.,;:!?\-—…](?!\p{Nd})", " ")
    return F.lower(collapse(F.translate(t, "؟،", "  ")))


def latin_text(text: Column, least_letters: int = 20, most_arabic: float = 0.05, least_latin: float = 0.85) -> Column:
    s = script_stats(text)
    return F.coalesce((s["n_letters"] >= least_letters) & (s["arabic_ratio"] <= most_arabic) & (s["latin_ratio"] >= least_latin), F.lit(False))


def paragraphs(text: Column) -> Column:
    """Paragraphs of older preparation: parted by empty lines or by a line end before a capital."""
    return F.filter(F.transform(F.split(text, r"\n{2,}|\n(?=[A-ZÇÊÎŞÛ])"), collapse), lambda x: x != "")


def soft_sentences(paragraph: Column, least: int = 8) -> Column:
    """Sentences of older preparation: parted after a mark before a capital; short ones are dropped, unless all are.

    The capitals and the least length are fixed values.
    """
    p = strip(paragraph)
    kept = F.filter(F.transform(F.split(p, rf"(?<=[.!?…]){WS}+(?=[\"'«]?[A-ZÇÊÎŞÛÁÉÍÓÚÄËÖÜ])"), strip), lambda x: F.length(x) >= least)
    return F.when(F.size(kept) > 0, kept).when(F.length(p) >= least, F.array(p)).otherwise(F.array().cast("array<string>"))


def as_bool(text: Column) -> Column:
    """Spellings of yes and no; all else, blank and null is unknown (null)."""
    t = F.lower(strip(text))
    return F.when(t.isin("1", "true", "yes", "y", "accept", "ok"), True).when(t.isin("0", "false", "no", "n", "reject"), False)
