"""Problem 3: text that looks the same in one consistent form.

Method: the Arrow column is copied to one array of code points; lookup tables replace, expand or delete
characters; look-alike letters are decided per word run; marks are ordered and composed by vectorised
passes over the runs of marks. No string call is made per row.

Defined results: null stays null; empty stays empty; the result of a second pass equals the first.
Line ends, tabs, typographic quotes, dashes and ellipses, signs such as a superscript two, words wholly in another
script, joiners of Arabic-script spelling and of picture characters are left as they are.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from . import codepoints as cp

# Look-alike letters and the Latin letters they stand for.
CYRILLIC = dict(zip("АВЕКМНОРСТХІЈЅҮҪЁЇаеорсухіјѕһԁԛԝҫёїѵү", "ABEKMHOPCTXIJSYÇËÏaeopcyxijshdqwçëïvy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυ", "ABEZHIKMNOPTYXaiĸvopu".replace("ĸ", "k")))
LATIN = dict(zip("ɡɑȷșȘțȚ", "gajşŞţŢ"))
# Characters that show nothing.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), 0x2060, *range(0x2061, 0x2070), 0xFEFF, *range(0xE0000, 0xE0080)]
CONTROLS = [*range(0, 9), 0xB, 0xC, *range(0xE, 0x20), 0x7F, *range(0x80, 0x85), *range(0x86, 0xA0)]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Blocks whose characters are other forms of ordinary characters.
FORM_BLOCKS = [(0xFF01, 0xFFE7), (0xFB00, 0xFB07), (0xFB50, 0xFDFC), (0xFE70, 0xFEFD), (0x1D400, 0x1D800), (0x2160, 0x2180)]
# Arabic ligatures that stand for whole phrases are signs, not letters.
PHRASES = range(0xFDF0, 0xFDFD)
DOT_ABOVE = 0x307


class _Tables:
    def __init__(self) -> None:
        n = cp.NCP
        self.flag = np.zeros(n, bool)  # a row without any of these is in its usual form
        self.map = np.arange(n, dtype=np.uint32)
        self.drop = np.zeros(n, bool)
        self.expand: dict[int, list[int]] = {}
        for c in INVISIBLE + CONTROLS:
            self.drop[c] = True
        for c in SPACES:
            self.map[c] = 0x20
        for a, b in LATIN.items():
            self.map[ord(a)] = ord(b)
        self.map[0x326] = 0x327  # a comma below is written as the cedilla
        for lo, hi in FORM_BLOCKS:
            for c in range(lo, hi):
                if c in PHRASES:
                    continue
                k = unicodedata.normalize("NFKC", chr(c))
                if k != chr(c):
                    to = [ord(x) for x in k]
                    if len(to) == 1:
                        self.map[c] = to[0]
                    else:
                        self.expand[c] = to
        self.ccc = np.zeros(n, np.uint8)
        self.mark = np.zeros(n, bool)
        pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        singles: dict[int, list[int]] = {}
        for c in range(0x20, 0x2FA20):
            if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xF900 or 0x17000 <= c < 0x1B000 or 0x20000 <= c < 0x2F800:
                continue
            ch = chr(c)
            k = unicodedata.combining(ch)
            if k:
                self.ccc[c], self.mark[c] = k, True
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<":
                p = [int(x, 16) for x in d.split()]
                nfc = unicodedata.normalize("NFC", ch)
                if nfc == ch and len(p) == 2:
                    pairs[p[0], p[1]] = c
                    self.split[c] = (p[0], p[1])
                elif nfc != ch:
                    singles[c] = [ord(x) for x in nfc]
        for c, to in singles.items():
            if c not in self.expand and self.map[c] == c:
                if len(to) == 1:
                    self.map[c] = to[0]
                else:
                    self.expand[c] = to
        pairs[ord("i"), DOT_ABOVE] = ord("i")  # a dotted i with one more dot looks like i
        for (a, b), c in list(pairs.items()):  # under a mark above, the dotless i looks like the dotted one
            if a == ord("i") and self.ccc[b] == 230:
                pairs[ord("ı"), b] = c
        self.pair_keys = np.array(sorted(a << 21 | b for a, b in pairs), dtype=np.int64)
        self.pair_vals = np.array([pairs[k >> 21, k & 0x1FFFFF] for k in self.pair_keys.tolist()], dtype=np.uint32)
        self.second = np.zeros(n, bool)
        for _, b in pairs:
            self.second[b] = True
        self.second |= self.mark
        self.starter_splits = np.zeros(n, bool)
        self.starter_splits[list(self.split)] = True
        self.grow = np.ones(n, np.int32)
        for c, to in self.expand.items():
            self.grow[c] = len(to)
        self.grow[self.drop] = 0
        # Expansions and splits as arrays: a code point's expansion begins at expand_at.
        self.expand_at = np.zeros(n, np.int32)
        self.expanded = np.array([x for to in self.expand.values() for x in to], np.uint32)
        self.expand_at[list(self.expand)] = np.cumsum([0, *(len(to) for to in self.expand.values())])[:-1]
        self.split_at = np.zeros(n, np.int32)
        self.split_at[list(self.split)] = np.arange(len(self.split))
        self.halves = np.array(list(self.split.values()), np.uint32)
        self.like = np.zeros(n, np.uint32)
        self.script = np.zeros(n, np.uint8)  # 1 Latin, 2 Cyrillic, 3 Greek, 4 Arabic, 5 other letters
        _, word, _ = cp.tables()
        self.script[word] = 5
        for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xAA, 0xAB), (0xBA, 0xBB), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x250), (0x250, 0x2B0), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800)):
            self.script[lo:hi] = np.where(word[lo:hi], 1, 0)
        for lo, hi, s in ((0x400, 0x530, 2), (0x1C80, 0x1C90, 2), (0x2DE0, 0x2E00, 2), (0xA640, 0xA6A0, 2), (0x370, 0x400, 3), (0x1F00, 0x2000, 3), (0x600, 0x780, 4), (0x8A0, 0x900, 4)):
            self.script[lo:hi] = np.where(word[lo:hi], s, 0)
        digits = np.array([c for c in range(0x30, 0x3A)])
        self.script[digits] = 0
        for t in (CYRILLIC, GREEK):
            for a, b in t.items():
                self.like[ord(a)] = ord(b)
        self.picture = np.zeros(n, bool)
        self.picture[0x2190:0x2C00] = self.picture[0x3030] = self.picture[0x303D] = True
        self.picture[[0x23, 0x2A, 0xA9, 0xAE, 0x203C, 0x2049, 0x2122, 0x2139, 0xFE0F]] = True
        self.picture[0x30:0x3A] = True
        self.picture[0x1F000:0x1FC00] = True
        self.flag |= (self.map != np.arange(n)) | self.drop | (self.grow != 1) | self.second | (self.script == 2) | (self.script == 3)
        self.flag[[0x200C, 0x200D, 0xFE0E, 0xFE0F]] = True
        self.flag[0x1100:0x1200] = True


_T: list[_Tables] = []


def _tables() -> _Tables:
    if not _T:
        _T.append(_Tables())
    return _T[0]


def _rowlens(keep_rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(keep_rows, minlength=n))]).astype(np.int64)


def _joiners(t: _Tables, c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which joiners and variation selectors stay: between letters of a joining script, or in a picture sequence."""
    j = np.flatnonzero((c == 0x200C) | (c == 0x200D) | (c == 0xFE0F) | (c == 0xFE0E))
    keep = np.ones(len(c), bool)
    if len(j):
        a, b = np.maximum(j - 1, 0), np.minimum(j + 1, len(c) - 1)
        left = np.where((j > 0) & (row[a] == row[j]), c[a], 0)
        right = np.where((j < len(c) - 1) & (row[b] == row[j]), c[b], 0)
        zw = (c[j] == 0x200C) | (c[j] == 0x200D)
        joins = lambda x: (t.script[x] >= 4) | (t.mark[x] & (x >= 0x600))
        text_ok = zw & joins(left) & (joins(right) | (c[j] == 0x200D))
        pic_ok = t.picture[left] & np.where(c[j] == 0x200D, t.picture[right] & (right >= 0x2190) & (right < 0xFE00) | (right >= 0x1F000), c[j] != 0x200C)
        pic_ok &= ~((c[j] != 0x200D) & (left < 0x2000) & (right != 0x20E3) & (left < 0x80))
        keep[j] = text_ok | pic_ok
    return keep


def _homoglyphs(t: _Tables, c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Look-alike letters inside Latin words, and whole words of them among Latin words, become Latin."""
    s = t.script[c]
    letter = (s > 0) | t.mark[c]
    if not ((s == 2) | (s == 3)).any():
        return c
    same = np.concatenate([[False], row[1:] == row[:-1]])
    start = letter & ~(np.concatenate([[False], letter[:-1]]) & same)
    wid = np.cumsum(start) - 1
    li = np.flatnonzero(letter)
    n = int(start.sum())
    w = wid[li]
    has = lambda m: np.bincount(w[m[li]], minlength=n) > 0
    foreign = (s == 2) | (s == 3)
    latin, pure = has(s == 1), has(foreign & (t.like[c] == 0))
    any_foreign = has(foreign)
    wrow = row[np.flatnonzero(start)]
    row_latin = np.bincount(wrow[latin], minlength=int(row[-1]) + 1) > 0
    adj = np.zeros(n, bool)
    same_w = wrow[1:] == wrow[:-1]
    adj[1:] |= pure[:-1] & same_w
    adj[:-1] |= pure[1:] & same_w
    fix = any_foreign & (latin | (~pure & row_latin[wrow] & ~adj))
    at = li[fix[w] & foreign[li] & (t.like[c[li]] > 0)]
    if len(at):
        c = c.copy()
        c[at] = t.like[c[at]]
    return c


def _compose(t: _Tables, c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition: split starters before marks, order the marks, compose pass by pass."""
    m = t.second[c]
    if not m.any():
        return c, row
    for _ in range(4):  # a composed starter before a mark is taken apart, so that the marks can be ordered
        nxt = np.concatenate([t.second[c[1:]] & (row[1:] == row[:-1]), [False]])
        at = np.flatnonzero(t.starter_splits[c] & nxt)
        if not len(at):
            break
        rep = np.ones(len(c), np.int64)
        rep[at] = 2
        first = np.cumsum(rep) - rep
        pairs = t.halves[t.split_at[c[at]]]
        row, c = np.repeat(row, rep), np.repeat(c, rep)
        c[first[at]], c[first[at] + 1] = pairs[:, 0], pairs[:, 1]
    ccc = t.ccc[c]
    same = np.concatenate([[False], row[1:] == row[:-1]])
    seq = np.cumsum((ccc == 0) | ~same)
    multi = np.concatenate([[False], (ccc[1:] > 0) & (ccc[:-1] > 0) & (seq[1:] == seq[:-1])])
    if (multi & (np.concatenate([[0], ccc[:-1]]) > ccc)).any():
        order = np.argsort(seq * 256 + ccc, kind="stable")
        c, ccc = c[order], ccc[order]
    m = t.second[c] & same
    # A run: a starter and the marks (or composing second characters) after it.
    start = ~m
    run = np.cumsum(start) - 1
    head = np.flatnonzero(start)
    pos = np.arange(len(c)) - head[run]
    alive = np.ones(len(c), bool)
    out = c.copy()
    cur, last = c[head].copy(), np.zeros(len(head), np.int16)  # last: class of the last mark left standing, -1 after a left starter
    where = head.copy()
    marks = np.flatnonzero(pos > 0)
    marks = marks[np.argsort(pos[marks], kind="stable")]
    upto = np.searchsorted(pos[marks], np.arange(1, int(pos.max()) + 2))
    for k in range(1, int(pos.max()) + 1):  # the k-th mark of every run at once
        at = marks[upto[k - 1] : upto[k]]
        r = run[at]
        key = cur[r].astype(np.int64) << 21 | c[at].astype(np.int64)
        i = np.searchsorted(t.pair_keys, key)
        i[i == len(t.pair_keys)] = 0
        ok = (t.pair_keys[i] == key) & ((last[r] == 0) | ((last[r] > 0) & (last[r] < ccc[at])))
        cur[r[ok]] = t.pair_vals[i[ok]]
        alive[at[ok]] = False
        left = ~ok
        last[r[left]] = ccc[at[left]]
        fresh = left & (ccc[at] == 0)  # a second character that did not compose is itself a starter
        out[where[r[fresh]]] = cur[r[fresh]]
        where[r[fresh]], cur[r[fresh]], last[r[fresh]] = at[fresh], c[at[fresh]], 0
    out[where] = cur
    return out[alive], row[alive]


def _hangul(c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jamo sequences become syllables, by the arithmetic of the Unicode standard."""
    if not ((c >= 0x1100) & (c < 0x1200)).any():
        return c, row
    for step in (0, 1):
        nxt = np.concatenate([c[1:], [0]])
        same = np.concatenate([row[1:] == row[:-1], [False]])
        if step == 0:
            at = np.flatnonzero(same & (c >= 0x1100) & (c < 0x1113) & (nxt >= 0x1161) & (nxt < 0x1176))
            to = 0xAC00 + ((c[at] - 0x1100) * 21 + (nxt[at] - 0x1161)) * 28
        else:
            at = np.flatnonzero(same & (c >= 0xAC00) & (c < 0xD7A4) & ((c - 0xAC00) % 28 == 0) & (nxt > 0x11A7) & (nxt < 0x11C3))
            to = c[at] + (nxt[at] - 0x11A7)
        keep = np.ones(len(c), bool)
        keep[at + 1] = False
        c = c.copy()
        c[at] = to
        c, row = c[keep], row[keep]
    return c, row


def canonical(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, changed by row) of the consistent form of a batch."""
    t = _tables()
    n = len(offs) - 1
    changed = np.zeros(n, bool)
    if not len(cps):
        return cps, offs, changed
    hot = np.flatnonzero(t.flag[cps])
    if not len(hot):
        return cps, offs, changed
    rows = np.unique(np.searchsorted(offs, hot, side="right") - 1)
    lens = np.diff(offs)
    sel = np.zeros(n, bool)
    sel[rows] = True
    pick = np.repeat(sel, lens)
    src = cps[pick]
    row = np.repeat(np.arange(len(rows)), lens[rows])
    c, r = src, row
    keep = _joiners(t, c, r)
    grow = t.grow[c] * keep
    if (grow != 1).any():
        exp = np.flatnonzero((grow > 1))
        first = np.cumsum(grow) - grow
        c2 = np.repeat(c, grow)
        for k in range(int(grow.max()) if len(exp) else 0):
            e = exp[grow[exp] > k]
            c2[first[e] + k] = t.expanded[t.expand_at[c[e]] + k]
        plain = np.repeat(grow == 1, grow)
        c2[plain] = t.map[c2[plain]]
        c, r = c2, np.repeat(r, grow)
    else:
        c = t.map[c]
    if len(c):
        c = _homoglyphs(t, c, r)
        c, r = _compose(t, c, r)
        c = t.map[c]  # letters composed with a comma below
        c, r = _hangul(c, r)
    new_lens = np.bincount(r, minlength=len(rows)) if len(c) else np.zeros(len(rows), np.int64)
    old_lens = lens[rows]
    diff = new_lens != old_lens
    eq = np.flatnonzero(~diff)
    if len(eq):
        a = np.repeat(~diff, old_lens)
        b = np.repeat(~diff, new_lens)
        ne = src[a] != c[b]
        rr = row[a][ne]
        diff[rr] = True
    changed[rows[diff]] = True
    out_lens = lens.copy()
    out_lens[rows] = new_lens
    out_offs = np.concatenate([[0], np.cumsum(out_lens)])
    out = np.empty(int(out_offs[-1]), np.uint32)
    dest = np.repeat(sel, out_lens)
    out[dest], out[~dest] = c, cps[~pick]
    return out, out_offs, changed


def normalise_column(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the column in its consistent form, whether each text changed)."""
    valid = cp.valid_mask(col)
    cps, offs = cp.decode(col)
    out, offs2, changed = canonical(cps, offs)
    return cp.encode(out, offs2, valid), changed


def _normalise_batches(batches):
    for b in cp.pieces(batches):
        text, changed = normalise_column(b.column("text"))
        cols = [b.column(n) for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*cols, text, pa.array(changed)], names=[*(n for n in b.schema.names if n != "text"), "text", "changed"])


def normalise(texts, *keys: str):
    """(keys, text in its consistent form, whether it changed) of a DataFrame with a text column.

    Null text stays null and counts as unchanged. Other columns than the keys and text are left out.
    """
    from pyspark.sql import types as T

    kept = texts.select(*keys, "text")
    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    return kept.mapInArrow(_normalise_batches, schema)
