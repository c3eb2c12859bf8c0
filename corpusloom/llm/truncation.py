"""Problem 2: texts that were cut before their end.

Method: structural completeness check with a stack automaton, against the baseline of each source.

* The structural marks of a whole text (quotes, straight ones too, brackets, tags) go through a stack automaton; sentence
  ends outside addresses, numbers and ellipses are found with the quotes and brackets that close after them. All this runs
  on arrays of code points of whole batches; the automaton takes one mark of every text at a time.
* What follows the last complete sentence, the rest, is taken apart from its end (brackets, tags, pictures, signatures,
  addresses, continuation marks), again for all texts of a batch at once.
* A text is cut if words are left of the rest; if nothing follows but a quote, bracket or tag that its last sentence opened
  isn't closed; or if the rest ends in a broken multibyte sequence, entity, escape or tag.
* A rest of one capitalised word or number is a name or the first word of a sentence that was cut. The source's baseline
  decides: cuts at any place leave such a rest about once in as many as a sentence has words, so where a source has
  RATIO times that or more, they are names and whole; where it has fewer, they lack their terminator and are cut.

Defined results: null, empty and blank texts and texts without any complete sentence are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialise
from . import codepoints as cp
from . import lookalikes

# Sentence marks, pairs of quotes and brackets, what may stand between a sentence mark and the next blank, tags that stay open.
ENDS = ".!?؟۔。！？"
PAIRS = {"“": "”“\"", "„": "“”\"", "«": "»", "(": ")", "[": "]", "{": "}", "‹": "›", '"': '"'}
CLOSERS = "”“»)]}›\"'’"
LONE_TAGS = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")
NAME_WORDS = 4
NOTE_WORDS = 12
RATIO = 2.0

WHOLE, CUT, ONE_WORD = 0, 1, 2

# RE2 patterns of the rest. W is a word character, S anything but white space.
W, S = r"[\p{L}\p{N}_]", r"[^\s\x{85}\x{2028}\x{2029}]"
_ADDRESS_END = rf"(?P<x>(?:https?://|www\.){S}+)$"
_BROKEN = rf"\x{{FFFD}}[^\p{{L}}\p{{N}}_]*$|&(?:#|{W}){{0,8}}$|\\(?:u[0-9a-fA-F]{{0,3}}|x[0-9a-fA-F]?)?$|<[^<>]*$|%[0-9a-fA-F]?$"
# What may follow a complete sentence without being one, taken off from the end; whether it marks a continuation, and whether it may be long.
_AFTER = [
    (r"(?P<x>(?:\.{2,}|…+))$", True, True),
    (r"(?P<x>[\[(]\s*(?:\.{2,}|…+)\s*[\])])$", True, True),
    (r"(?P<x>(?:[–—-]\s*)?(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"))$", False, False),
    (r"(?P<x><[^<>]*>)$", False, False),
    (_ADDRESS_END, False, False),
    (rf"(?P<x>(?:{W}|[.+-])+@(?:{W}|-)+\.(?:{W}|[.-])+)$", False, False),
    (rf"(?P<x>[#@]{W}+)$", False, False),
    (rf"(?P<x>{S}+\s*[/|]\s*\p{{Nd}}+)$", False, False),
    (rf"(?P<x>[–—]\s*[^\s–—]+(?:\s+[^\s–—]+){{0,{NAME_WORDS - 1}}})$", False, False),
    (r"(?P<x>[←-⯿〰〽\x{1F000}-\x{1FAFF}\x{200d}\x{fe0f}*•·_~|/–—-]+)$", False, True),
    (r"(?P<x>[^\p{L}\p{N}]+)$", False, True),
]

_SPACE, _END, _CLOSER, _OPENER, _MARK, _WORD = 1, 2, 4, 8, 16, 32
_C: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """The classes of each code point, as bits."""
    if not _C:
        c = np.zeros(cp.NCP, np.uint8)
        c[cp.tables()[1]] |= _WORD
        c[ord("_")] |= _WORD
        for chars, bit in (("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))), _SPACE), (ENDS, _END), (CLOSERS, _CLOSER), ("".join(PAIRS), _OPENER), ("".join(PAIRS) + "".join(PAIRS.values()), _MARK)):
            c[[ord(x) for x in chars]] |= bit
        _C["class"] = c
    return _C["class"]


def _run_ends(flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of flagged places; a run never crosses rows."""
    if not len(flag):
        z = np.empty(0, np.int64)
        return z, z
    same = np.concatenate([[False], row[1:] == row[:-1]])
    begin = flag & ~(np.concatenate([[False], flag[:-1]]) & same)
    nxt = np.concatenate([flag[1:] & same[1:], [False]])
    return np.flatnonzero(begin), np.flatnonzero(flag & ~nxt) + 1


def _spread(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in one of the stretches."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:-1] > 0


def _starts_with(cps: np.ndarray, word: str) -> np.ndarray:
    """The places where the characters of the word begin."""
    n = len(cps) - len(word) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(cps[:n] == ord(word[0]))
    for k, ch in enumerate(word[1:], 1):
        at = at[cps[at + k] == ord(ch)]
    return at


def _addresses(cps: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which places belong to a web or mail address."""
    at = np.concatenate([_starts_with(cps, w) for w in ("http://", "https://", "www.")])
    mail = np.flatnonzero(cps == ord("@"))
    if not len(at) and not len(mail):
        return np.zeros(len(cps), bool)
    solid_b, solid_e = _run_ends((kind & _SPACE) == 0, row)
    run = lambda b, e, x: np.searchsorted(b, x, side="right") - 1
    begin, end = [at], [solid_e[run(solid_b, solid_e, at)]] if len(at) else [at]
    if len(mail):
        word = (kind & _WORD) > 0
        host = word | (cps == ord(".")) | (cps == ord("-"))
        lb, le = _run_ends(host | (cps == ord("+")), row)
        rb, re = _run_ends(host, row)
        i, j = run(lb, le, mail - 1), run(rb, re, mail + 1)
        ok = (mail > 0) & (mail + 1 < len(cps)) & (i >= 0) & (j >= 0)
        i, j, mail = i[ok], j[ok], mail[ok]
        ok = (le[i] == mail) & (rb[j] == mail + 1) if len(lb) and len(rb) else np.zeros(len(mail), bool)
        i, j, mail = i[ok], j[ok], mail[ok]
        dots = np.concatenate([[0], np.cumsum(cps == ord("."))])
        ok = (cps[rb[j]] != ord(".")) & (dots[re[j] - 1] - dots[rb[j]] > 0)  # a dot inside the host
        begin.append(lb[i][ok])
        end.append(re[j][ok])
    return _spread(np.concatenate(begin), np.concatenate(end), len(cps))


def _open_at_end(cps: np.ndarray, at: np.ndarray, row: np.ndarray, tag: np.ndarray) -> dict[int, int]:
    """row -> the place of the last mark that is never closed, of rows that have one. Marks at `at`, in order; tag: see _tags.

    The automaton: a mark that closes the top of its row's stack takes it off; else one that can open is put on. One mark of
    every row is taken at a time, so the steps are as many as the longest row has marks.
    """
    if not len(at):
        return {}
    rows, first = np.unique(row, return_index=True)
    count = np.diff(np.concatenate([first, [len(at)]]))
    order = np.argsort(-count, kind="stable")
    rows, first, count = rows[order], first[order], count[order]
    width = 8
    stack = np.zeros((len(rows), width), np.int64)  # indices into `at`, plus one
    depth = np.zeros(len(rows), np.int64)
    codes = sorted({ord(x) for x in "".join(PAIRS) + "".join(PAIRS.values())})
    closes = np.zeros((len(codes), len(codes)), bool)
    opens = np.zeros(len(codes), bool)
    for a, bs in PAIRS.items():
        opens[codes.index(ord(a))] = True
        for b in bs:
            closes[codes.index(ord(a)), codes.index(ord(b))] = True
    code = np.minimum(np.searchsorted(codes, cps[at]), len(codes) - 1)
    for k in range(int(count[0])):
        n = int(np.searchsorted(-count, -k, side="left"))  # rows with more than k marks
        m = first[:n] + k
        top = np.where(depth[:n] > 0, stack[np.arange(n), np.maximum(depth[:n] - 1, 0)] - 1, 0)
        some = depth[:n] > 0
        tags = (tag[m] != 0)
        hit = some & np.where(tags, (tag[m] < 0) & (tag[top] == -tag[m]), (tag[top] == 0) & closes[code[top], code[m]])
        push = ~hit & np.where(tags, tag[m] > 0, opens[code[m]])
        depth[:n] -= hit
        where = np.flatnonzero(push)
        if len(where):
            if int(depth[where].max()) >= width:
                stack = np.concatenate([stack, np.zeros_like(stack)], axis=1)
                width *= 2
            stack[where, depth[where]] = m[where] + 1
            depth[where] += 1
    left = np.flatnonzero(depth > 0)
    return dict(zip(rows[left].tolist(), at[stack[left, depth[left] - 1] - 1].tolist()))


def _tags(cps: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the name of each tag `<...>`: positive if it opens, negative if it closes, 0 if it is no tag or stays open."""
    out = np.zeros(len(begin), np.int64)
    for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
        x = "".join(map(chr, cps[b + 1 : min(e - 1, b + 40)]))
        name = x.lstrip("/").split(None, 1)[0].rstrip("/").lower() if x.strip("/ ") else ""
        if name.isalnum() and name.isascii() and name[0].isalpha() and name not in LONE_TAGS and not x.endswith("/"):
            number = int.from_bytes(name.encode()[:7], "big") + 1
            out[k] = -number if x.startswith("/") else number
    return out


def _rest_states(rest: pa.Array) -> np.ndarray:
    """WHOLE, CUT or ONE_WORD of each rest, which isn't empty."""
    n = len(rest)
    broken = pc.match_substring_regex(rest, _BROKEN).to_numpy(zero_copy_only=False) & ~pc.match_substring_regex(rest, _ADDRESS_END).to_numpy(zero_copy_only=False)
    goes_on = pc.match_substring_regex(rest, "[,:;-]$").to_numpy(zero_copy_only=False).copy()
    state = np.where(broken, CUT, WHOLE)
    live, text = np.flatnonzero(~broken), rest.filter(pa.array(~broken))
    done_at, done = [], []
    while len(live):
        moved = np.zeros(len(live), bool)
        for pattern, marks, long in _AFTER:
            found = pc.struct_field(pc.extract_regex(text, pattern), [0])
            hit = np.asarray(found.is_valid()) & ~moved
            if hit.any() and not long:
                hit &= pc.fill_null(pc.count_substring_regex(found, S + "+"), 0).to_numpy(zero_copy_only=False) <= NOTE_WORDS
            if hit.any():
                text = pc.if_else(pa.array(hit), pc.utf8_rtrim_whitespace(pc.replace_substring_regex(text, pattern, "")), text)
                moved |= hit
                if marks:
                    goes_on[live[hit]] = True
        empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        stop = ~moved | empty
        done_at.append(live[stop])
        done.append(text.filter(pa.array(stop)))
        live, text = live[~stop], text.filter(pa.array(~stop))
    if done:
        at, left = np.concatenate(done_at), pa.concat_arrays(done)
        words = pc.count_substring_regex(left, S + "+").to_numpy(zero_copy_only=False)
        name = pc.match_substring_regex(left, r"^\s*(?:\p{Lu}|\p{Nd}+\s*$)").to_numpy(zero_copy_only=False)
        state[at] = np.where(words > 1, CUT, np.where(words == 1, np.where(name & ~goes_on[at], ONE_WORD, CUT), WHOLE))
    return state[:n]


def states(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, number of complete sentences, words) of each text in its consistent form."""
    cps, offs = cp.decode(col)
    n = len(offs) - 1
    state, sentences, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not len(cps):
        return state, sentences, words
    kind, row = _classes()[cps], cp.row_ids(offs)
    words = np.bincount(row[_run_ends((kind & _SPACE) == 0, row)[0]], minlength=n)
    space = (kind & _SPACE) > 0
    solid = np.flatnonzero(~space)
    stop = offs[:-1].copy()  # where each text ends, blanks at its end left out
    np.maximum.at(stop, row[solid], solid + 1)
    hidden = _addresses(cps, kind, row)
    eb, ee = _run_ends(((kind & _END) > 0) & ~hidden, row)
    # A run that begins with two full stops begins with an ellipsis, which ends nothing.
    dot = cps == ord(".")
    db, de = _run_ends(dot & ~hidden, row)
    lead = np.zeros(len(cps) + 1, np.int64)
    lead[db] = de - db
    skip = np.where(lead[eb] >= 2, lead[eb], 0)
    eb = eb + skip
    eb, ee = eb[eb < ee], ee[eb < ee]
    # After the sentence mark closing quotes and brackets, then a blank, the end, a tag, or what opens.
    closer = (kind & _CLOSER) > 0
    cb, ce = _run_ends(closer, row)
    after = np.arange(len(cps) + 1)
    after[cb] = ce
    limit = stop[row[eb]] if len(eb) else eb
    to = np.minimum(np.where(ee < limit, after[np.minimum(ee, len(cps))], ee), limit)
    nxt = np.minimum(to, len(cps) - 1)
    good = (to >= limit) | space[nxt] | ((kind[nxt] & _OPENER) > 0) | (cps[nxt] == ord("<"))
    er, to = row[eb][good], to[good]
    sentences = np.bincount(er, minlength=n)
    last, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(to):
        is_last = np.concatenate([er[1:] != er[:-1], [True]])
        last[er[is_last]] = to[is_last]
        second = np.flatnonzero(is_last) - 1
        own = (second >= 0) & (er[np.maximum(second, 0)] == er[is_last])
        before[er[is_last][own]] = to[second[own]]
    complete = sentences > 0
    rest_b = last.copy()
    # The rest without blanks at its beginning.
    nonblank = np.concatenate([np.where(space, len(cps), np.arange(len(cps))), [len(cps)]])
    nonblank = np.minimum.accumulate(nonblank[::-1])[::-1]
    rest_b = np.where(complete, np.minimum(nonblank[np.minimum(rest_b, len(cps))], stop), 0)
    has_rest = complete & (rest_b < stop)
    r = np.flatnonzero(has_rest)
    if len(r):
        size = stop[r] - rest_b[r]
        ends = np.cumsum(size)
        flat = cps[np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(rest_b[r], size)]
        state[r] = _rest_states(cp.encode(flat, np.concatenate([[0], ends])))
    # Nothing follows: something that the last sentence opened may still be open. Earlier marks are read too, as they tell which quotes close.
    lanes = complete & ~has_rest & (before > 0)
    angle_b = np.flatnonzero((cps == ord("<")) & ~hidden)
    shut = np.flatnonzero(cps == ord(">"))
    k = np.searchsorted(shut, angle_b)
    ok = k < len(shut)
    angle_b, angle_e = angle_b[ok], shut[k[ok]] + 1 if len(shut) else angle_b[ok]
    ok = (row[angle_b] == row[np.maximum(angle_e - 1, 0)]) & lanes[row[angle_b]] if len(angle_b) else np.zeros(0, bool)
    angle_b, angle_e = angle_b[ok], angle_e[ok]
    marks = np.flatnonzero(((kind & _MARK) > 0) & ~hidden & lanes[row])
    opened = marks[((kind[marks] & _OPENER) > 0) & (marks >= before[row[marks]])]
    some = np.zeros(n, bool)
    some[row[opened]] = True
    some[row[angle_b[angle_b >= before[row[angle_b]]]]] = True
    tags = _tags(cps, row, angle_b, angle_e)
    inside = _spread(angle_b[tags != 0] + 1, angle_e[tags != 0], len(cps)) if (tags != 0).any() else np.zeros(len(cps), bool)
    marks = marks[some[row[marks]] & ~inside[marks]]
    keep = (tags != 0) & some[row[angle_b]]
    at = np.concatenate([marks, angle_b[keep]])
    tag = np.concatenate([np.zeros(len(marks), np.int64), tags[keep]])
    o = np.argsort(at, kind="stable")
    for r_, place in _open_at_end(cps, at[o], row[at[o]], tag[o]).items():
        if place >= before[r_]:
            state[r_] = CUT
    return state, sentences, words


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in cp.pieces(batches):
        text, _ = lookalikes.normalise_column(b.column("text"))
        state, sentences, words = states(text)
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(state.astype(np.int32)), pa.array(sentences.astype(np.int32)), pa.array(words.astype(np.int32))], names=[*names, "state", "sentences", "words"])


def features(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, state, sentences, words) of a DataFrame with a text column, written: the texts are read once."""
    kept = texts.select(*keys, "text")
    schema = T.StructType([*(kept.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("state", "sentences", "words"))])
    return materialise(kept.mapInArrow(_batches, schema), "states")


def baseline(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., texts, marked, open, one_word, per_sentence, names): the baseline of each source over rows of `features`.

    marked counts the texts with a complete sentence, open those of them that are cut for sure, one_word those with a rest of
    one word; names tells whether these are names.
    """
    n = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("sentences") > 0).alias("marked"), F.count_if(F.col("state") == CUT).alias("open"), F.count_if(F.col("state") == ONE_WORD).alias("one_word"),
        F.try_divide(F.sum(F.when(F.col("sentences") > 0, F.col("words"))), F.sum("sentences")).alias("per_sentence"),
    )
    expected = F.coalesce(F.col("open") / F.greatest(F.lit(2.0), F.col("per_sentence") - 1), F.lit(0.0))
    return n.withColumn("names", F.col("one_word") >= RATIO * expected)


def flag(texts: DataFrame, source: str, *keys: str) -> DataFrame:
    """(keys, source, cut) of a DataFrame with text and source columns; `source` names the column whose values have a baseline each."""
    by = [k for k in keys if k == "tab"]
    rows = features(texts, *keys, source)
    names = baseline(rows, *by, source).select(*(F.col(c).alias(f"_{c}") for c in (*by, source)), "names")
    on = F.lit(True)
    for c in (*by, source):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    cut = (F.col("state") == CUT) | ((F.col("state") == ONE_WORD) & ~F.coalesce("names", F.lit(True)))
    return rows.join(names, on, "left").select(*keys, source, cut.alias("cut"), (F.col("sentences") > 0).alias("marked"))


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, blanks around it dropped, hyphens and blanks as underscores; null is unknown."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit("unknown"))
