"""Problem 10: abusive, hateful or sexual content.

Method: a convolutional text classifier trained in numpy: hashed word embeddings, filters of several widths over the words
of a sentence, max pooling, one output; thresholds calibrated by language. A document's score is its worst sentence's.

* Words are read through disguise: accents, doubled letters, digits and signs that stand for letters, letters parted by
  blanks, dots or hyphens all come out alike. A word seen in fewer than RARE training texts is known by its shape only, so
  that names don't matter.
* Labels are of documents, so training is of several instances: every sentence of an unoffending document is a negative, and of
  an offending one the sentence that scores worst is the positive, first by counts, then by nets that were trained on
  the other half of the documents. Reviewers err: offending documents without a sentence that such a net finds bad are left out. The same
  scores of documents not trained on calibrate the thresholds.
* The training sample is at most SAMPLE labelled documents, the first by a hash of the id.

Defined results: null, empty and wordless texts score 0; without any positive label every score is 0.
"""

from __future__ import annotations

import hashlib
import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as cp
from . import languages, lookalikes

SAMPLE = 10_000
BUCKETS = 1 << 14
SHAPES = 16
RARE = 3
DIM, FILTERS = 24, 32
WIDTHS = (1, 2, 3, 4)
MOST_WORDS = 24
UNBROKEN = 1 << 40  # words after which a sentence without a mark ends: none
BATCH = 128
STEPS = (500, 500, 1200)
NEGATIVES = 12_000
SEED = 20
U64 = np.uint64

# Signs that stand for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"}
MASK = "*"
JOINERS = ".-_·•'’"

_T: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _T:
        plain = cp.tables()[0].copy()
        for c in range(0xC0, 0x250):
            d = unicodedata.normalize("NFD", chr(int(plain[c])))
            plain[c] = ord(d[0])
        plain[ord("ı")] = ord("i")
        leet = np.zeros(cp.NCP, np.uint32)
        for a, b in LEET.items():
            leet[ord(a)] = ord(b)
        letter = cp.tables()[1].copy()
        letter[0x30:0x3A] = False
        join = np.zeros(cp.NCP, bool)
        join[[ord(x) for x in JOINERS]] = True
        _T.update(plain=plain, leet=leet, letter=letter, join=join)
    return _T


def read_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, shapes, sentence of each word, row of each sentence) of a text column."""
    t = _tables()
    cps, offs = cp.decode(col)
    cps, offs, _ = lookalikes.canonical(cps, offs)
    z = np.empty(0, np.int64)
    if not len(cps):
        return np.empty(0, U64), z, z, z
    sent, of, _ = languages.sentences(cps, offs, UNBROKEN)
    upper = cp.tables()[2][cps]
    c = t["plain"][cps]
    same_l = np.concatenate([[False], sent[1:] == sent[:-1]])
    letter = t["letter"][c]
    # Signs between letters, one or two together, are letters; asterisks are masked letters.
    sign = (t["leet"][c] > 0) | (c == ord(MASK))
    for _ in range(3):
        left = np.concatenate([[False], letter[:-1]]) & same_l
        right = np.concatenate([(letter[1:] | sign[1:]) & same_l[1:], [False]])
        letter = letter | (sign & left & right)
    masked = letter & (c == ord(MASK))
    swap = letter & (t["leet"][c] > 0)
    c = np.where(swap, t["leet"][c], c)
    # Hyphens and dots between letters don't part a word.
    left = np.concatenate([[False], letter[:-1]]) & same_l
    right = np.concatenate([letter[1:] & same_l[1:], [False]])
    drop = t["join"][c] & left & right
    # Letters parted by single blanks, four or more in a row, are one word.
    lone = letter & ~left & ~right
    blank = c == 0x20
    gap = blank & np.concatenate([[False], lone[:-1]]) & np.concatenate([lone[1:], [False]]) & same_l & np.concatenate([same_l[1:], [False]])
    if gap.any():
        at = np.flatnonzero(gap)
        new = np.concatenate([[True], at[1:] - at[:-1] != 2])
        run = np.cumsum(new) - 1
        drop[at[np.bincount(run)[run] >= 3]] = True
    drop |= letter & same_l & np.concatenate([[False], (c[1:] == c[:-1]) & letter[:-1]])
    keep = ~drop
    c, sent, upper, letter, masked = c[keep], sent[keep], upper[keep], letter[keep], masked[keep]
    start, end = languages._runs(letter, sent)
    if not len(start):
        return np.empty(0, U64), z, z, of
    h = cp.run_hashes(c, start, end)
    cap = upper[start]
    has_mask = np.add.reduceat(masked.astype(np.int64), start) > 0 if masked.any() else np.zeros(len(start), bool)
    if masked.any():  # reduceat runs to the next start: masked letters are letters, so none lies between runs
        has_mask = np.array(np.add.reduceat(masked.astype(np.int64), start) > 0)
    size = np.minimum((end - start - 1) // 3, 3)
    return h, (size + 4 * cap + 8 * has_mask).astype(np.int64), sent[start], of


@dataclass
class Model:
    """The trained classifier: known word hashes, tables of filter answers by word and offset, output weights, thresholds."""

    known: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    profiles: languages.Profiles | None = None

    def rows(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Embedding rows: 0 is padding, then shapes, then hash buckets of known words."""
        if not len(self.known):
            return 1 + shape
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == h, 1 + SHAPES + (h % U64(BUCKETS)).astype(np.int64), 1 + shape)

    def score(self, idx: np.ndarray) -> np.ndarray:
        """Scores 0 to 1 of sentences (rows of word rows, 0-padded)."""
        n, length = idx.shape
        z = np.full(n, self.shift, np.float32)
        for k, w in enumerate(WIDTHS):
            a = self.tables[k][0][idx[:, : length - w + 1]]
            for j in range(1, w):
                a = a + self.tables[k][j][idx[:, j : length - w + 1 + j]]
            z += np.maximum(a.max(axis=1) + self.bias[k], 0) @ self.out[k]
        return 1 / (1 + np.exp(-z))


def padded(rows: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of word rows with a margin of padding, sentence of each matrix row).

    A sentence of more than MOST_WORDS words, or a stretch without any marks, goes on in rows that share half their words, so
    that no passage is seen in halves only.
    """
    if not len(rows):
        return np.zeros((0, MOST_WORDS + 6), np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
    pos = np.arange(len(rows)) - np.repeat(at, np.diff(np.concatenate([at, [len(rows)]])))
    which = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(rows)]])))
    half = MOST_WORDS // 2
    lines = np.maximum(1, -(-(np.diff(np.concatenate([at, [len(rows)]])) - MOST_WORDS) // half) + 1)
    base = np.concatenate([[0], np.cumsum(lines)])
    m = np.zeros((int(base[-1]), MOST_WORDS + 6), np.int32)
    for back in (0, 1):
        line = pos // half - back
        ok = (line >= 0) & (line < lines[which])
        m[base[which[ok]] + line[ok], 3 + pos[ok] - half * line[ok]] = rows[ok]
    return m, np.repeat(sent[at], lines)


class _Net:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.e = (rng.standard_normal((1 + SHAPES + BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.e[0] = 0
        self.w = [(rng.standard_normal((w, DIM, FILTERS)) * (2 / (w * DIM)) ** 0.5).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = [(rng.standard_normal(FILTERS) * 0.1).astype(np.float32) for _ in WIDTHS]
        self.c = np.zeros(1, np.float32)
        self.m: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.t = 0

    def forward(self, idx: np.ndarray) -> tuple[np.ndarray, list]:
        x = self.e[idx]
        n, length, _ = x.shape
        z = np.full(n, self.c[0], np.float32)
        kept = []
        for k, w in enumerate(WIDTHS):
            a = x[:, : length - w + 1] @ self.w[k][0]
            for j in range(1, w):
                a += x[:, j : length - w + 1 + j] @ self.w[k][j]
            pos = a.argmax(axis=1)
            top = np.take_along_axis(a, pos[:, None, :], axis=1)[:, 0] + self.b[k]
            act = np.maximum(top, 0)
            z += act @ self.v[k]
            kept.append((pos, top, act))
        return z, [x, kept]

    def _adam(self, name: str, p: np.ndarray, g: np.ndarray, lr: float) -> None:
        m, v = self.m.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        p -= lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)

    def step(self, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, lr: float) -> float:
        z, (x, kept) = self.forward(idx)
        p = 1 / (1 + np.exp(-z))
        dz = ((p - y) * weight / len(y)).astype(np.float32)
        self.t += 1
        n = len(y)
        rows, grads = [], []
        updates = []
        at = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            pos, top, act = kept[k]
            g = dz[:, None] * self.v[k] * (top > 0)
            updates.append((f"v{k}", self.v[k], act.T @ dz))
            updates.append((f"b{k}", self.b[k], g.sum(axis=0)))
            dw = np.empty_like(self.w[k])
            for j in range(w):
                xs = x[at, pos + j]  # n x F x D
                dw[j] = np.einsum("nf,nfd->df", g, xs)
                rows.append(idx[at, pos + j].reshape(-1))
                grads.append((g[:, :, None] * self.w[k][j].T[None]).reshape(-1, DIM))
            updates.append((f"w{k}", self.w[k], dw))
        updates.append(("c", self.c, np.array([dz.sum()], np.float32)))
        for name, par, g in updates:
            self._adam(name, par, g + 1e-5 * par, lr)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        o = np.argsort(rows, kind="stable")
        r = rows[o]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        touched, sums = r[first], np.add.reduceat(grads[o], first, axis=0)
        some = touched > 0
        touched, sums = touched[some], sums[some]
        acc = self.m.setdefault("e", (np.zeros((len(self.e), 1), np.float32), np.zeros(1)))[0]
        acc[touched] += (sums * sums).mean(axis=1, keepdims=True)
        self.e[touched] -= 4 * lr * sums / (np.sqrt(acc[touched]) + 1e-6)
        return float(np.mean(weight * np.logaddexp(0, np.where(y > 0, -z, z))))

    def scores(self, idx: np.ndarray) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-self.forward(idx[i : i + 2048])[0])) for i in range(0, len(idx), 2048)]) if len(idx) else np.empty(0)

    def freeze(self, model: Model) -> Model:
        model.tables = [np.stack([self.e @ self.w[k][j] for j in range(w)]) for k, w in enumerate(WIDTHS)]
        model.bias, model.out, model.shift = self.b, self.v, float(self.c[0])
        return model


def _first_guess(m: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each sentence the log odds of its most telling word or word pair, from counts of documents."""
    n = len(m)
    a = m[:, 3:-3]
    pair = a[:, :-1].astype(np.int64) * 100_003 + a[:, 1:]
    feats = [(np.repeat(np.arange(n), a.shape[1]), a.reshape(-1), a.reshape(-1) > 1 + SHAPES)]
    feats.append((np.repeat(np.arange(n), pair.shape[1]), pair.reshape(-1) + (1 << 40), ((a[:, :-1] > SHAPES) & (a[:, 1:] > SHAPES)).reshape(-1)))
    best = np.full(n, -9.0)
    np_, nn = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    for s, f, ok in feats:
        s, f = s[ok], f[ok]
        if not len(f):
            continue
        d = doc[s]
        u, inv = np.unique(f, return_inverse=True)
        one = np.unique(inv * (len(label) + 1) + d)
        fi, di = one // (len(label) + 1), one % (len(label) + 1)
        pos = np.bincount(fi[label[di] == 1], minlength=len(u))
        neg = np.bincount(fi[label[di] == 0], minlength=len(u))
        odds = np.log((pos + 0.5) / np_) - np.log((neg + 0.5) / nn)
        odds *= pos > 1
        np.maximum.at(best, s, odds[inv])
    return best


def _learn(m: np.ndarray, pos: np.ndarray, neg: np.ndarray, hard: np.ndarray, steps: int, rng: np.random.Generator) -> _Net:
    """A net trained to tell sentences pos from sentences neg; hard orders the negatives when there are too many."""
    if len(neg) > NEGATIVES:  # the hardest half, and others by chance
        top = neg[np.argsort(-hard[neg], kind="stable")[: NEGATIVES // 2]]
        rest = np.setdiff1d(neg, top, assume_unique=True)
        neg = np.concatenate([top, rng.choice(rest, NEGATIVES - len(top), replace=False)])
    idx = np.concatenate([pos, neg])
    lab = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))]).astype(np.float32)
    wt = np.where(lab > 0, min(6.0, max(1.0, 0.3 * len(neg) / max(1, len(pos)))), 1.0).astype(np.float32)
    net = _Net(rng)
    epochs = max(3, -(-steps * BATCH // max(1, len(idx))))
    for ep in range(epochs):
        o = rng.permutation(len(idx))
        lr = 3e-3 * (1 - 0.9 * ep / epochs)
        for i in range(0, len(o), BATCH):
            x = m[idx[o[i : i + BATCH]]]
            # Words drop out to a shape now and then, so that no single word decides alone.
            net.step(np.where((rng.random(x.shape) < 0.05) & (x > 0), 1 + rng.integers(0, SHAPES), x), lab[o[i : i + BATCH]], wt[o[i : i + BATCH]], lr)
    return net


def _fit(m: np.ndarray, doc: np.ndarray, label: np.ndarray, seed: int) -> tuple[_Net, np.ndarray]:
    """(net, score of each document by nets that were not trained on it)."""
    rng = np.random.default_rng(seed)
    y = label[doc]
    half = rng.integers(0, 2, len(label))
    score, least = _first_guess(m, doc, label), -np.inf

    def positives(at: np.ndarray) -> np.ndarray:
        cand = at[y[at] == 1]
        order = cand[np.lexsort((-score[cand], doc[cand]))]
        best = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
        sure = best[score[best] > least]
        return sure if len(sure) else best

    for steps, bound in zip(STEPS[:-1], (0.3, 0.5)):
        crossed = np.zeros(len(m))
        for k in (0, 1):
            at, other = np.flatnonzero(half[doc] == k), np.flatnonzero(half[doc] != k)
            if len(at) and len(other):
                crossed[other] = _learn(m, positives(at), at[y[at] == 0], score, steps, rng).scores(m[other])
        score, least = crossed, bound
    held = np.zeros(len(label))
    np.maximum.at(held, doc, score)
    at = np.arange(len(m))
    return _learn(m, positives(at), at[y == 0], score, STEPS[-1], rng), held


def train(texts: list[str], labels: list[int], profiles: languages.Profiles, seed: int = SEED) -> Model:
    """The classifier of labelled texts."""
    label = np.array(labels, np.int64)
    found, rows, sentences, lang = [], 0, 0, []
    column = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for piece in cp.pieces([column]):  # a slice at a time: the arrays of a slice are many times its text
        h, shape, sent, of = read_words(piece.column("text"))
        found.append((h, shape, sent + sentences, of + rows))
        lang += _languages(piece.column("text"), profiles)
        rows, sentences = rows + piece.num_rows, sentences + len(of)
    h, shape, sent, of = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, U64), *(np.empty(0, np.int64),) * 3)
    if not len(h) or label.sum() < 2 or label.sum() == len(label):
        return Model(np.empty(0, U64), profiles=profiles)
    doc_of_word = of[sent]
    pair = np.unique(np.stack([h, doc_of_word.astype(U64)], axis=1), axis=0)
    word, df = np.unique(pair[:, 0], return_counts=True)
    model = Model(word[df >= min(RARE, max(2, int(label.sum()) // 8))], profiles=profiles)
    m, owner = padded(model.rows(h, shape), sent)
    doc = of[owner]
    net, held = _fit(m, doc, label, seed)
    model = net.freeze(model)
    model.thresholds = {"": _threshold(held, label)}
    for x in sorted(set(lang)):
        at = np.flatnonzero(np.array(lang) == x)
        if label[at].sum() >= 10 and (1 - label[at]).sum() >= 10:
            model.thresholds[x] = _threshold(held[at], label[at])
    return model


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1, within 0.1 and 0.9."""
    grid = np.linspace(0.1, 0.9, 81)
    f1 = np.array([2 * ((score >= t) & (label == 1)).sum() / max(1, (score >= t).sum() + (label == 1).sum()) for t in grid])
    good = grid[f1 >= f1.max() - 0.003]
    return float(np.median(good))


def _languages(col: pa.Array, p: languages.Profiles) -> list[str]:
    """The main language of each text, '' where none is known."""
    s = languages.segments(col, p)
    out = [""] * len(col)
    top = [0] * len(col)
    for r, lang, w in zip(s["row"].tolist(), s["language"].tolist(), s["words"].tolist()):
        if w > top[r]:
            out[r], top[r] = p.languages[lang], w
    return out


def score_texts(col: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, flagged) of each text."""
    n = len(col)
    score = np.zeros(n)
    flagged = np.zeros(n, bool)
    if model.out is None:
        return score, flagged
    h, shape, sent, of = read_words(col)
    m, owner = padded(model.rows(h, shape), sent)
    for i in range(0, len(m), 4096):
        np.maximum.at(score, of[owner[i : i + 4096]], model.score(m[i : i + 4096]))
    base = model.thresholds.get("", 0.5)
    limit = np.full(n, base)
    near = np.flatnonzero(score >= min(model.thresholds.values(), default=0.5))
    if len(near) and model.profiles is not None:
        lang = _languages(col.take(pa.array(near)), model.profiles)
        limit[near] = [model.thresholds.get(x, base) for x in lang]
    return score, score >= limit


def _batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in cp.pieces(batches):
            score, flagged = score_texts(b.column("text"), model)
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(np.round(score, 6)), pa.array(flagged)], names=[*keep, "score", "flagged"])

    return run


_TRAINED: dict[bytes, Model] = {}


def fit(documents: DataFrame, labels: DataFrame, profiles: languages.Profiles, sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled documents (doc_id, text; doc_id, toxic), taken in the order of a hash of the id.

    The ids are taken first, so only their texts move. The last model is kept and given again for the same sample.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(taken), "doc_id").collect()
    rows = sorted((r["doc_id"], r["text"], int(r["toxic"])) for r in rows)
    key = hashlib.sha256(pickle.dumps((rows, profiles))).digest()
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train([x for _, x, _ in rows], [y for _, _, y in rows], profiles)
    return _TRAINED[key]


def score(texts: DataFrame, model: Model, *keys: str) -> DataFrame:
    """(keys, score, flagged) of a DataFrame with a text column."""
    kept = texts.select(*keys, "text")
    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return kept.mapInArrow(_batches(texts.sparkSession.sparkContext.broadcast(model)), schema)
