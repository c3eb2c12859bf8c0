"""Problem 4: the language of each document and of each segment of mixed documents, with a confidence.

Method: rank-order profiles. A language's profile is the list of its most frequent character n-grams (1 to 3 characters,
words padded); a sentence is compared by the out-of-place distance: over its n-grams, the difference between the rank in the
sentence and the rank in the profile, an absent n-gram counting as far as the profile is long; whole words have a ranked
list of their own. What is in no profile is as far from every language and is left out. Everything runs on arrays over whole batches.

Profiles are built from labelled samples (language_samples, a fixed table, read on the driver). A Latin-script language also
gets a second profile without its accents, because texts are written so too.

A sentence is what ends with a sentence mark, a line end, or STEP words where marks are missing. A sentence of fewer than
SHORT words, or one whose best distance is within CLOSE of the distance to the language of a neighbour, takes the neighbour's
language; one within PRIOR of the language that the text's label names takes that. Neighbouring sentences of one language
are a segment. A name, tag or remark after a sentence belongs to its segment, but its words don't count.

Defined results: null, empty and letterless texts have no segment; digits, marks, addresses and picture characters say nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from . import lookalikes

TOP = 600
STEP = 14
SHORT = 4
CLOSE = 0.05
PRIOR = 0.04
SEGMENT_WORDS = 6
MOST_SAMPLES = 100_000
ORDERS = 3
BASE = 128
COUNTS = 16
TOP_WORDS = 300
WORD_WEIGHT = 0.5
ABSENT = 20_000
U64 = np.uint64

# Usual two-letter codes of the languages.
TWO = {"ku": "kmr", "tr": "tur", "en": "eng", "de": "deu", "ar": "ara"}


class Profiles:
    """Rank tables: letters -> small codes, n-gram codes -> rows of ranks by profile."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        texts: dict[tuple[str, bool], list[str]] = {}
        for lang, text in samples:
            if not lang or not text:
                continue
            low = text.lower()
            texts.setdefault((lang, False), []).append(low)
            plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)).replace("ı", "i")
            if plain != low and any("a" <= c <= "z" for c in plain):
                texts.setdefault((lang, True), []).append(plain)
        self.keys = sorted(texts)
        self.languages = sorted({k[0] for k in self.keys})
        letters = Counter(c for rows in texts.values() for r in rows for c in r if c.isalpha())
        self.code = np.zeros(cp.NCP, np.int16)
        _, word, _ = cp.tables()
        self.code[word] = BASE - 1  # a letter that no sample has
        self.code[0x30:0x3A] = 0
        for i, c in enumerate([c for c, _ in letters.most_common(BASE - 2)]):
            self.code[ord(c)] = i + 1
        ranks: list[dict[int, int]] = []
        for k in self.keys:
            counts: Counter[int] = Counter()
            cps, offs = cp.decode(pa.array(texts[k]))
            for codes, _ in self.grams(cps, cp.row_ids(offs)):
                counts.update(codes.tolist())
            ranks.append({g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP])})
        known = sorted(set().union(*ranks)) if ranks else []
        self.index = np.full(BASE**ORDERS * 1, -1, np.int32)
        self.index[known] = np.arange(len(known))
        self.rank = np.full((len(known), len(self.keys)), ABSENT, np.int16)
        for j, r in enumerate(ranks):
            for g, x in r.items():
                self.rank[self.index[g], j] = x
        self.of = np.array([self.languages.index(k[0]) for k in self.keys], np.int64)
        words: list[dict[int, int]] = []
        for k in self.keys:
            cps, offs = cp.decode(pa.array(texts[k]))
            start, end, _ = cp.word_runs(cps, offs)
            counts = Counter(cp.run_hashes(cps, start, end)[~_number(cps, start)].tolist())
            words.append({w: r for r, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP_WORDS])})
        self.words = np.array(sorted(set().union(*words)) if words else [], U64)
        self.word_rank = np.full((len(self.words), len(self.keys)), ABSENT, np.int16)
        for j, r in enumerate(words):
            at = np.searchsorted(self.words, np.array(list(r), U64))
            self.word_rank[at, j] = list(r.values())

    def grams(self, cps: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, (codes, unit) of the n-grams; a boundary (code 0) stands on each side of a word, once."""
        c = self.code[cps].astype(np.int32)
        keep = (c > 0) | np.concatenate([[False], c[:-1] > 0])
        c, u = c[keep], unit[keep]
        if not len(c):
            return []
        # A word that begins its unit has its boundary put in front.
        same = np.concatenate([[False], u[1:] == u[:-1]])
        lead = (c > 0) & ~(same & True)
        rep = np.where(lead, 2, 1)
        first = np.cumsum(rep) - rep
        c2, u2 = np.repeat(c, rep), np.repeat(u, rep)
        c2[first[lead]] = 0
        out = [(c2[c2 > 0], u2[c2 > 0])]
        n = len(c2)
        two = (u2[1:] == u2[:-1]) & ((c2[1:] > 0) | (c2[:-1] > 0)) if n > 1 else np.zeros(0, bool)
        out.append(((c2[:-1] * BASE + c2[1:])[two], u2[1:][two]))
        if n > 2:
            three = (u2[2:] == u2[:-2]) & (c2[1:-1] > 0)
            out.append((((c2[:-2] * BASE + c2[1:-1]) * BASE + c2[2:])[three], u2[2:][three]))
        return out

    def distances(self, cps: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
        """units x languages: the mean out-of-place distance of n-grams and of whole words, or 1 where nothing is known."""
        keys = []
        for codes, u in self.grams(cps, unit):
            g = self.index[codes]
            hit = g >= 0
            keys.append((u[hit], g[hit]))
        chars = _out_of_place(keys, units, self.rank, TOP)
        start, end = _runs(self.code[cps] > 0, unit)
        h = cp.run_hashes(cps, start, end)
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        hit = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        words = _out_of_place([(unit[start[hit]], at[hit])], units, self.word_rank, TOP_WORDS)
        both = np.where(chars == 1, 1.0, (chars + WORD_WEIGHT * words) / (1 + WORD_WEIGHT))
        best = np.ones((units, len(self.languages)))
        for j, lang in enumerate(self.of.tolist()):
            best[:, lang] = np.minimum(best[:, lang], both[:, j])
        return best


def _number(cps: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (cps[start] >= 0x30) & (cps[start] <= 0x39)


def _runs(on: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = unit[1:] == unit[:-1]
    start = on & ~np.concatenate([[False], on[:-1] & same])
    stop = on & ~np.concatenate([on[1:] & same, [False]])
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _out_of_place(parts: list[tuple[np.ndarray, np.ndarray]], units: int, rank: np.ndarray, top: int) -> np.ndarray:
    """units x profiles: the mean over a unit's features of |rank in the unit - rank in the profile|, at most top, over top."""
    out = np.ones((units, rank.shape[1]))
    size = max(1, len(rank))
    kind = np.int32 if units * size < 1 << 31 else np.int64
    key = np.concatenate([u.astype(kind) * kind(size) + g.astype(kind) for u, g in parts]) if parts else np.empty(0, kind)
    if not len(key):
        return out
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.minimum(np.diff(np.concatenate([first, [len(key)]])), COUNTS - 1)
    u, g = np.divmod(key[first], kind(size))
    # The rank in the unit is the number of its features that occur more often; equal counts share a rank.
    hist = np.bincount(u.astype(np.int64) * COUNTS + count, minlength=units * COUNTS).reshape(units, COUNTS)
    above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist
    gap = rank[g]
    gap -= above[u, count].astype(np.int16)[:, None]
    np.abs(gap, out=gap)
    np.minimum(gap, np.int16(top), out=gap)
    at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    total = np.diff(np.concatenate([at, [len(u)]]))
    out[u[at]] = np.add.reduceat(gap, at, axis=0, dtype=np.int32) / (total[:, None] * float(top))
    return out


def sentences(cps: np.ndarray, offs: np.ndarray, most: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each code point, row of each sentence, words of each sentence)."""
    n = len(cps)
    row = cp.row_ids(offs)
    ends = np.isin(cps, np.array([0x2E, 0x21, 0x3F, 0x61F, 0x6D4, 0x2026, 0x3002], np.uint32))
    space = np.isin(cps, np.array([0x20, 9, 10, 13, 0x85, 0x2028, 0x2029], np.uint32))
    line = np.isin(cps, np.array([10, 13, 0x2028, 0x2029], np.uint32))
    closing = np.isin(cps, np.array([0x201D, 0x201C, 0xBB, 0x29, 0x5D, 0x22, 0x27, 0x2019], np.uint32))
    idx = np.arange(n)
    # The last code point before this one that neither closes nor is an end tells whether an end stands there.
    plain = np.maximum.accumulate(np.where(~closing, idx, -1))
    stop = space & (np.concatenate([[False], ends[np.maximum(plain[:-1], 0)] & (plain[:-1] >= 0)])) | line
    stop &= np.concatenate([[False], row[1:] == row[:-1]])
    word_space = space & np.concatenate([[True], ~space[:-1]])
    begin = np.concatenate([[True], (row[1:] != row[:-1])]) | np.concatenate([[False], stop[:-1]])
    sent = np.cumsum(begin) - 1
    # Sentences of more than `most` words are cut: marks may be missing.
    wcount = np.cumsum(word_space)
    base = wcount[np.flatnonzero(begin)][sent] if n else wcount
    step = (wcount - base) // most
    cut = np.concatenate([[False], (step[1:] != step[:-1]) & (sent[1:] == sent[:-1])])
    begin |= cut
    sent = np.cumsum(begin) - 1
    units = int(sent[-1]) + 1 if n else 0
    start, end, _ = cp.word_runs(cps, offs)
    # Words are parted by white space: count the first run of each.
    wid, su = wcount[start], sent[start]
    fresh = np.concatenate([[True], (wid[1:] != wid[:-1]) | (su[1:] != su[:-1])]) if len(wid) else np.empty(0, bool)
    words = np.bincount(su[fresh], minlength=units)
    if not n:
        return sent, np.empty(0, np.int64), words
    at = np.flatnonzero(begin)
    of = row[at]
    # A name, tag or remark after a sentence isn't one: a few words that no mark ends, and that don't begin their text.
    content = np.maximum.accumulate(np.where(~closing & ~space, idx, 0))
    ended = ends[content[np.concatenate([at[1:], [n]]) - 1]]
    inner = np.concatenate([[False], of[1:] == of[:-1]])
    words[~ended & inner & (words < SHORT)] = 0
    return sent, of, words


def smooth(lang: np.ndarray, dist: np.ndarray, row: np.ndarray, words: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The language of each sentence after short and doubtful ones have followed a neighbour, or else the label."""
    n = len(lang)
    idx = np.arange(n)
    lang = lang.copy()
    best = dist[idx, lang] if n else np.empty(0)
    sure = (words >= SHORT) & (best < 1)
    prev = np.maximum.accumulate(np.where(sure, idx, -1))
    prev = np.concatenate([[-1], prev[:-1]])
    nxt = np.minimum.accumulate(np.where(sure, idx, n)[::-1])[::-1]
    nxt = np.concatenate([nxt[1:], [n]])
    out = lang.copy()
    if label is not None:
        at = label[row]
        near = (at >= 0) & (dist[idx, np.maximum(at, 0)] - best <= PRIOR)
        out = np.where(near, at, out)
    for side in (nxt, prev):
        ok = (side >= 0) & (side < n)
        s = np.where(ok, side, 0)
        ok &= row[s] == row
        other = lang[s]
        near = dist[idx, other] - best <= np.where(words < SHORT, 0.25, CLOSE)
        out = np.where(ok & near & (other != lang), other, out)
    return out


def segments(col: pa.Array, p: Profiles, label: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Arrays row, language, words, confidence, begin, end (code points) of the segments of a text column."""
    cps, offs = cp.decode(col)
    cps, offs, _ = lookalikes.canonical(cps, offs)
    low = cp.tables()[0][cps]
    sent, row, words = sentences(low, offs)
    units = len(row)
    if not units:
        z = np.empty(0, np.int64)
        return {"row": z, "language": z, "words": z, "confidence": np.empty(0), "begin": z, "end": z}
    dist = p.distances(low, sent, units)
    lang = dist.argmin(axis=1)
    lang = smooth(lang, dist, row, words, label)
    known = (dist.min(axis=1) < 1) & (words > 0)
    first_cp = np.searchsorted(sent, np.arange(units))
    last_cp = np.concatenate([first_cp[1:], [len(sent)]])
    # Sentences that say nothing follow the one before them in their text.
    idx = np.arange(units)
    src = np.maximum.accumulate(np.where(known, idx, -1))
    ok = (src >= 0) & (row[np.maximum(src, 0)] == row)
    keep = np.flatnonzero(ok)
    row, lang, words, first_cp, last_cp, dist = row[keep], lang[np.maximum(src, 0)][keep], words[keep], first_cp[keep], last_cp[keep], dist[keep]
    if not len(row):
        z = np.empty(0, np.int64)
        return {"row": z, "language": z, "words": z, "confidence": np.empty(0), "begin": z, "end": z}
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])])
    at = np.flatnonzero(new)
    w = np.maximum(words, 1)[:, None]
    mean = np.add.reduceat(dist * w, at, axis=0) / np.add.reduceat(w, at, axis=0)
    mine = mean[np.arange(len(at)), lang[at]]
    rest = mean.copy()
    rest[np.arange(len(at)), lang[at]] = np.inf
    other = rest.min(axis=1) if rest.shape[1] > 1 else np.ones(len(at))
    conf = np.clip(1.0 / (1.0 + np.exp(-40.0 * (other - mine))), 0.0, 1.0)
    ends = np.concatenate([at[1:], [len(row)]]) - 1
    return {
        "row": row[at], "language": lang[at], "words": np.add.reduceat(words, at), "confidence": conf,
        "begin": first_cp[at] - offs[row[at]], "end": last_cp[ends] - offs[row[at]],
    }


def _segment_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = np.array(p.languages, dtype=object)
        for b in cp.pieces(batches):
            label = None
            if "named" in b.schema.names:
                at = {x: i for i, x in enumerate(p.languages)}
                label = np.array([at.get(x, -1) for x in b.column("named").to_pylist()], np.int64)
            s = segments(b.column("text"), p, label)
            take = pa.array(s["row"])
            keep = [n for n in b.schema.names if n != "text"]
            first = np.concatenate([[True], s["row"][1:] != s["row"][:-1]]) if len(s["row"]) else np.empty(0, bool)
            idx = np.arange(len(first))
            number = idx - np.maximum.accumulate(np.where(first, idx, 0)) if len(idx) else idx
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n).take(take) for n in keep), pa.array(number.astype(np.int32)), pa.array(names[s["language"]].tolist(), pa.string()), pa.array(s["words"].astype(np.int32)), pa.array(np.round(s["confidence"], 6)), pa.array(s["begin"].astype(np.int32)), pa.array(s["end"].astype(np.int32))],
                names=[*keep, "segment", "language", "words", "confidence", "begin", "end"],
            )

    return run


def profiles(samples: DataFrame) -> Profiles:
    """Profiles of a fixed table of labelled samples (language, text); an error if it has more than MOST_SAMPLES rows."""
    rows = samples.where("language is not null and text is not null").select("language", "text").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} language samples")
    return Profiles([(r["language"], r["text"]) for r in rows])


def segment_table(texts: DataFrame, p: Profiles, *keys: str) -> DataFrame:
    """(keys, segment, language, words, confidence, begin, end): begin and end count code points of the consistent form."""
    from pyspark.sql import types as T

    kept = texts.where("text is not null").select(*keys, "text")
    fields = [("segment", T.IntegerType()), ("language", T.StringType()), ("words", T.IntegerType()), ("confidence", T.DoubleType()), ("begin", T.IntegerType()), ("end", T.IntegerType())]
    schema = T.StructType([*(kept.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])
    return kept.mapInArrow(_segment_batches(texts.sparkSession.sparkContext.broadcast(p)), schema)


def label_language(c):
    """The three-letter code that a label names, or null: case, blanks and suffixes don't matter."""
    base = F.lower(F.regexp_extract(F.trim(c), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    out = F.when(base.isin("und", "unk", "", "mis", "zxx", "mul"), F.lit(None))
    for a, b in TWO.items():
        out = out.when(base == a, F.lit(b))
    return out.otherwise(base)


def unlabelled(texts: DataFrame, p: Profiles, *keys: str, label: str = "label") -> DataFrame:
    """Distinct (keys, language): languages of whole segments of SEGMENT_WORDS words or more that the label doesn't name."""
    named = texts.withColumn("named", label_language(F.col(label)))
    seg = segment_table(named, p, *keys, "named").where(F.col("words") >= SEGMENT_WORDS)
    return seg.where(~F.col("language").eqNullSafe(F.col("named"))).select(*keys, "language").distinct()


def documents(texts: DataFrame, p: Profiles, *keys: str, every: DataFrame | None = None) -> DataFrame:
    """(keys, language, confidence, segments, mixed): the language with most words of each key.

    Keys without a segment have a null language and confidence 0. `every` has the keys, once each; without it the rows of
    texts have unique keys.
    """
    seg = segment_table(texts, p, *keys)
    per = seg.groupBy(*keys, "language").agg(F.sum("words").alias("w"), F.sum(F.col("words") * F.col("confidence")).alias("c"), F.count(F.lit(1)).alias("n"))
    doc = per.groupBy(*keys).agg(F.max(F.struct("w", "language", "c")).alias("top"), F.sum("w").alias("all"), F.sum("n").cast("int").alias("segments"), F.count(F.lit(1)).alias("languages"))
    doc = doc.select(*keys, F.col("top.language").alias("language"), F.round(F.coalesce(F.try_divide("top.c", "all"), F.lit(0.0)), 6).alias("confidence"), "segments", (F.col("languages") > 1).alias("mixed"))
    return (texts if every is None else every).select(*keys).join(doc, list(keys), "left").select(*keys, "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
