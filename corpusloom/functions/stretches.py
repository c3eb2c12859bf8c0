"""Tokens, letter case and forms of the texts of an Arrow batch, worked out once for each different stretch without white space.

The functions are those of `tokens`, `casing` and `text`. No token holds white space, and neither composition nor letter case
looks across it, so what is made of a text is made of its stretches, and what stands between them stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .casing import SKIP
from .text import MARKS
from .tokens import LABEL_OF, LETTER, MARKUP

# Letters and digits that the expressions don't know, which have Unicode 13, and letters whose case only they know.
NEW_LETTERS = (
    "ࡰ-ࢇࢉ-ࢎࢵࣈࣉౝೝᜍᜟᭌⰯⱟ鿽-鿿ꟀꟁꟐꟑꟓꟕ-ꟙꟲ-ꟴ\U00010570-\U000105bc\U00010780-\U000107ba"
    "\U00010f70-\U00010f81\U00011071\U00011072\U00011075\U0001123f\U00011240\U00011740-\U00011746\U00011ab0-\U00011abf\U00011f02-\U00011f33\U00012f90-\U00012ff0\U0001342f\U00013441-\U00013446\U00016a70-\U00016abe"
    "\U0001aff0-\U0001affe\U0001b11f-\U0001b122\U0001b132\U0001b155\U0001df00-\U0001df2a\U0001e030-\U0001e06d\U0001e290-\U0001e2ad\U0001e4d0-\U0001e4eb\U0001e7e0-\U0001e7fe\U0002a6de\U0002a6df\U0002b735-\U0002b739"
    "\U0002ebf0-\U0002ee5d\U00031350-\U000323af"
)
NEW_DIGITS = "\U00011f50-\U00011f59\U00016ac0-\U00016ac9\U0001e4f0-\U0001e4f9"
NEW_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}

_OLD_CASE = {b: a for a, b in NEW_CASE.items()}
_DIGIT = rf"(?:(?![{NEW_DIGITS}])\d)"
_TOKEN = re.compile(rf"https?://\S+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}|[{LETTER}][{LETTER}0-9]*(?:['’\-][{LETTER}0-9]+)*|{_DIGIT}+(?:[.,]{_DIGIT}+)*|\S")
_NEW_LETTER = re.compile(f"[{NEW_LETTERS}]")
_HAS_DIGIT = re.compile(_DIGIT)
_PROTECTED = re.compile(rf"(?ai:https?://)|[^@\s]+@[^@\s]+\.[^@\s]+\Z|(?:{_DIGIT}|[.,])*{_DIGIT}(?:{_DIGIT}|[.,])*\Z|(?s:.*?)(?:{MARKUP})")
_BLANKS = re.compile(r"[ \t\f\v]+")
_GAPS = re.compile(r"\S+")
# What a token does to the state "a sentence starts next", see casing.event.
SET, CONSUME, CLEAR = 1, 2, 3
# What is known of so many different stretches or tokens is kept from batch to batch, some 20 MB a function.
KEPT = 1 << 17


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@lru_cache(KEPT)
def tokens_of(text: str) -> tuple[tuple[str, ...], bool]:
    """The tokens, and whether composition leaves their number as it is."""
    t = nfc(text)
    found = tuple(_TOKEN.findall(t))
    return found, t == text or len(_TOKEN.findall(text)) == len(found)


def _low(text: str) -> str:
    return text.replace("İ", "i").translate(NEW_CASE).lower()


@lru_cache(KEPT)
def lower(text: str) -> str:
    return _low(nfc(text))


def upper(token: str) -> str:
    return token.translate(_OLD_CASE).upper()


def first_letter(token: str) -> int:
    """The place of the first letter, or -1."""
    for k, c in enumerate(token):
        if c.isalpha() and not _NEW_LETTER.match(c):
            return k
    return -1


def title(token: str) -> str:
    k = first_letter(token)
    return token if k < 0 else token[:k] + upper(token[k]) + _low(token[k + 1 :])


@lru_cache(KEPT)
def keeps_case(token: str) -> bool:
    """Whether it is protected or has no letter."""
    return first_letter(token) < 0 or token in LABEL_OF or _PROTECTED.match(token) is not None


@lru_cache(KEPT)
def event(token: str) -> int:
    if token in (".", "?", "!"):
        return SET
    if token in SKIP or token in LABEL_OF:
        return 0
    return CONSUME if first_letter(token) >= 0 else CLEAR if _HAS_DIGIT.search(token) else 0


def normalize_whitespace(text: str) -> str:
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "  " in t or "\t" in t or "\f" in t or "\v" in t:
        t = _BLANKS.sub(" ", t)
    return (re.sub(r"\n{3,}", "\n\n", t) if "\n\n\n" in t else t).strip()


def strip_supported(text: str) -> str:
    for m in MARKS:
        text = text.replace(m, "")
    return normalize_whitespace(text)


def preserves_text(before: str, after: str) -> bool:
    """Both in inference form."""
    return strip_supported(before) == strip_supported(after)


def same_but_case(a: str, b: str) -> bool:
    return a == b or lower(a) == lower(b)


def near_idempotent(a: str, b: str) -> bool:
    return a == b or strip_supported(_low(nfc(a))) == strip_supported(_low(nfc(b)))


def offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def looked_up(names: list[str], f: Callable[[str], object], kind: type) -> np.ndarray:
    return np.array([f(x) for x in names], kind)


class _Places(dict):
    def __missing__(self, x: str) -> int:
        self[x] = n = len(self)
        return n


def coded(values: np.ndarray | list[str]) -> tuple[np.ndarray, list]:
    """The place of each value among the different ones, and those."""
    if isinstance(values, list):
        places = _Places()
        return np.fromiter(map(places.__getitem__, values), np.int64, len(values)), list(places)
    x = pc.dictionary_encode(pa.array(values))
    return x.indices.to_numpy(zero_copy_only=False).astype(np.int64), x.dictionary.to_pylist()


@dataclass
class Texts:
    """Texts as places in a list of stretches; text k has those from offs[k] to offs[k + 1]. gaps: what stands around them where that isn't one space between."""

    names: list[str]
    ids: np.ndarray
    offs: np.ndarray
    gaps: dict[int, list[str]]

    @classmethod
    def of(cls, texts: list[str], spaced: bool = True) -> Texts:
        """spaced: with what stands between the stretches; without, they are written with one space between."""
        parts = [t.split() for t in texts]
        ids, names = coded(list(chain.from_iterable(parts)))
        gaps = {k: _GAPS.split(t) for k, (t, p) in enumerate(zip(texts, parts)) if t != " ".join(p)} if spaced else {}
        return cls(names, ids, offsets(np.array([len(p) for p in parts], np.int64)), gaps)

    def mapped(self, f: Callable[[str], str]) -> Texts:
        return Texts([f(x) for x in self.names], self.ids, self.offs, self.gaps)

    def written(self) -> list[str]:
        each, o = np.array(self.names, object)[self.ids].tolist() if len(self.ids) else [], self.offs.tolist()
        out = [" ".join(each[a:b]) for a, b in zip(o, o[1:])]
        for k, g in self.gaps.items():
            out[k] = "".join(x + y for x, y in zip(g, [*each[o[k] : o[k + 1]], ""]))
        return out

    def all_of(self, other: Texts, same: Callable[[str, str], bool]) -> np.ndarray:
        """For each text, whether all its stretches are the same as those of the other texts at their places."""
        pairs, codes = coded(self.ids * len(other.names) + other.ids)
        ok = np.array([same(self.names[c // len(other.names)], other.names[c % len(other.names)]) for c in codes], bool)
        wrong = offsets(~ok[pairs])[self.offs] if len(pairs) else self.offs
        return np.diff(wrong) == 0


@dataclass
class Tokens:
    """The tokens of texts as places in a list; a stretch at a time in `size`, text k from offs[k] to offs[k + 1]."""

    names: list[str]
    ids: np.ndarray
    size: np.ndarray
    offs: np.ndarray
    texts: Texts

    @classmethod
    def of(cls, texts: Texts, respelt: bool = False) -> Tokens:
        """respelt: the tokens will be written again in their places, so composition mustn't change their number."""
        cut = [tokens_of(x) for x in texts.names]
        if respelt and not all(fits for _, fits in cut):
            raise ValueError("tokens don't fit the text")
        parts = [p for p, _ in cut]
        flat, names = coded(list(chain.from_iterable(parts)))
        count = np.array([len(p) for p in parts], np.int64)
        begin = offsets(count)[texts.ids]
        size = count[texts.ids]
        ends = offsets(size)
        ids = flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return cls(names, ids, size, ends[texts.offs], texts)

    def table(self, f: Callable[[str], object], kind: type) -> np.ndarray:
        """f of each token, worked out once for each different one."""
        return looked_up(self.names, f, kind)[self.ids]

    def strings(self, at: np.ndarray) -> pa.Array:
        """The tokens at the places."""
        return pa.array(self.names, pa.string()).take(pa.array(self.ids[at]))

    def starts(self) -> np.ndarray:
        """Whether each token is the first letter-word of a sentence, see casing.starts."""
        kind = self.table(event, np.int8)
        if not len(kind):
            return np.zeros(0, bool)
        last = np.maximum.accumulate(np.where(kind > 0, np.arange(len(kind)), -1))
        before = np.concatenate([[-1], last[:-1]])
        inside = before >= np.repeat(self.offs[:-1], np.diff(self.offs))
        return (kind == CONSUME) & np.where(inside, kind[np.maximum(before, 0)] == SET, True)

    def respelt(self, how: np.ndarray, *ways: Callable[[str], str]) -> Texts:
        """The texts with token i as it is (how 0) or spelt the way how[i]."""
        n = len(self.names)
        ids, used = coded(self.ids + n * how)
        names = [self.names[c % n] if c < n else ways[c // n - 1](self.names[c % n]) for c in used]
        m, ends = len(names), offsets(self.size)
        first = ids[ends[:-1]] if len(ids) else ids
        code = first.copy()
        two = self.size == 2
        code[two] = m + first[two] * m + ids[ends[:-1][two] + 1]
        long, more = {}, []
        for k in np.flatnonzero(self.size > 2).tolist():
            part = ids[ends[k] : ends[k + 1]]
            key = part.tobytes()
            if key not in long:
                long[key] = -1 - len(more)
                more.append("".join(names[i] for i in part.tolist()))
            code[k] = long[key]
        places, codes = coded(code)
        spelt = [more[-1 - c] if c < 0 else names[c] if c < m else names[c // m - 1] + names[c % m] for c in codes]
        return Texts(spelt, places, self.texts.offs, self.texts.gaps)


def words_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens that aren't marks, the number of the label that the next token gives each (0: none), offsets by text."""
    mark = t.table(lambda x: 1 + list(LABEL_OF).index(x) if x in LABEL_OF else 0, np.int64)
    follows = np.append(mark[1:], 0)[: len(mark)]
    follows[t.offs[1:][np.diff(t.offs) > 0] - 1] = 0
    word = mark == 0
    return np.flatnonzero(word), follows[word], offsets(word)[t.offs]
