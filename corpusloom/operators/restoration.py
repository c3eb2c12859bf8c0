"""Restoring marks and case with a scoring function given by the caller; words are kept or the row says so.

A scorer takes a list of windows (lists of tokens) and gives an array of logits, tokens x labels, for each. All passes of a
restoration are one Arrow stage, a row in and a row out for each text, over arrays of the batch's tokens (`stretches`), so no
token is ever a row of its own and nothing is shuffled. A scorer that loads a model does so through `subwords.once`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stretches as S
from ..functions import subwords
from ..functions import text as X
from ..functions import tokens as T
from ..functions.batches import in_pieces, ranges
from ..plans.storage import materialise
from . import metrics as M
from .corpus import inference_spans

Scorer = Callable[[list[list[str]]], list[np.ndarray]]
Cost = Callable[[pa.Array], np.ndarray]
FLOORS = {"COMMA": 0.55, "PERIOD": 0.55, "QUESTION": 0.60, "EXCLAMATION": 0.70}
AT_ONCE = 256
# So many tokens of whole texts are worked on at once, more than elsewhere, as that makes fewer different stretches.
TOGETHER = 1_000_000


@lru_cache(S.KEPT)
def _number(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def stand_in(labels: int) -> Scorer:
    """A scorer that needs no model: logits from the md5 of the token, five bits a label, the same on every machine."""

    def run(windows_: list[list[str]]) -> list[np.ndarray]:
        bits = 5 * np.arange(labels)
        flat = np.fromiter(map(_number, chain.from_iterable(windows_)), np.int64)
        z = ((flat[:, None] >> bits) % 32) / 4.0 + np.where(bits == 0, 6.0, 0.0)
        ends = np.cumsum([0, *map(len, windows_)]).tolist()
        return [z[a:b] for a, b in zip(ends, ends[1:])]

    return run


def loaded(name: str, load: Callable[[], Scorer]) -> Scorer:
    """A scorer that each worker process loads once, when it first scores: a model and its vocabulary under a name."""
    return lambda windows_: subwords.once(f"scorer {name}", load)(windows_)


def _means(words: list[str], each: np.ndarray, first: np.ndarray, scorer: Scorer, budget: int = 256, overlap: int = 32) -> np.ndarray:
    """tokens x labels: for each word, whose costs are `each`, the mean of its logits over the windows that hold it; text k has those from first[k] to first[k + 1]."""
    costs = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(each))
    spans = inference_spans(costs, budget, overlap)
    base = np.repeat(first[:-1], np.diff(spans.offsets.to_numpy()))
    begin, end = (base + spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    total, times = None, np.zeros(len(words))
    for k in range(0, len(begin), AT_ONCE):
        pairs = list(zip(begin[k : k + AT_ONCE].tolist(), end[k : k + AT_ONCE].tolist()))
        for (a, b), z in zip(pairs, scorer([words[a:b] for a, b in pairs])):
            z = np.asarray(z, float)
            total = np.zeros((len(words), z.shape[1])) if total is None else total
            total[a:b] += z
            times[a:b] += 1
    return np.empty((len(words), 0)) if total is None else total / times[:, None]


def mean_logits(items: pa.ListArray, used: pa.ListArray | None, scorer: Scorer, cost: Cost, budget: int = 256, overlap: int = 32) -> pa.ListArray:
    """list<list<double>>: for each token the mean of its logits over the windows that hold it; null for tokens that aren't used."""
    size = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    tokens = pc.list_flatten(items)
    use = np.ones(len(tokens), bool) if used is None else pc.fill_null(pc.list_flatten(used), False).to_numpy(zero_copy_only=False).astype(bool)
    first = np.concatenate([[0], np.cumsum(use)])[offs]
    kept = tokens.filter(pa.array(use))
    z = _means(kept.to_pylist(), cost(kept) if len(kept) else np.empty(0, np.int32), first, scorer, budget, overlap)
    inner = np.concatenate([[0], np.cumsum(use)]) * z.shape[1]
    each = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(z.reshape(-1)), mask=pa.array(~use) if len(use) and not use.all() else None)
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), each)


def logits_of(items: Column, used: Column | None, scorer: Scorer, cost: Cost = subwords.quarters, budget: int = 256, overlap: int = 32) -> Column:
    """array<array<double>> of the tokens of an array, see mean_logits; used: array<boolean>, by default all."""
    kind = "array<array<double>>"
    if used is None:
        return F.arrow_udf(lambda x: in_pieces(lambda y: mean_logits(y, None, scorer, cost, budget, overlap), x), kind)(items)
    return F.arrow_udf(lambda x, u: in_pieces(lambda y, v: mean_logits(y, v, scorer, cost, budget, overlap), x, u), kind)(items, used)


def _scored(t: S.Tokens, at: np.ndarray, first: np.ndarray, scorer: Scorer, cost: Cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_shares of the mean logits of the tokens at the places, of which text k has those from first[k] to first[k + 1]."""
    ids = t.ids[at]
    return _shares(_means(np.array(t.names, object)[ids].tolist(), cost(pa.array(t.names, pa.string()))[ids], first, scorer))


def _shares(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax of each row as a column, the place of its largest value and that value."""
    z = np.ascontiguousarray(z.T)
    e = np.exp(z - z.max(0))
    p = e / sum(e)
    return p, p.argmax(0), p.max(0)


def _marked(texts: S.Texts, scorer: Scorer, floors: dict[str, float], cost: Cost) -> tuple[S.Texts, S.Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with marks, and of the words without them: tokens, places, offsets by text, numbers of labels, confidences."""
    t = S.Tokens.of(texts)
    at, label, offs = S.words_of(t)
    sure, bare = np.ones(len(at)), label == 0
    if bare.any():
        p, k, conf = _scored(t, at[bare], S.offsets(bare)[offs], scorer, cost)
        low = np.isin(k, [M.PUNCT.index(x) for x in floors]) & (conf < np.array([floors.get(x, 0.0) for x in M.PUNCT])[k])
        label[bare], sure[bare] = np.where(low, 0, k), np.where(low, p[0], conf)
    codes, used = S.coded(t.ids[at] * len(M.PUNCT) + label)
    marks = ["", *T.LABEL_OF]
    names = [t.names[c // len(M.PUNCT)] + marks[c % len(M.PUNCT)] for c in used]
    return S.Texts(names, codes, offs, {}), t, at, offs, label, sure


def _cased(texts: S.Texts, scorer: Scorer, title: float, upper: float, cost: Cost) -> tuple[S.Texts, S.Texts]:
    """The texts in lower case with sentence starts, and with the labels of the scorer."""
    t = S.Tokens.of(texts.mapped(S.lower), True)
    ruled = t.respelt(t.starts().astype(np.int64), S.title)
    # Title case can change what a token is (an address that begins a sentence), so the tokens are found again.
    t = S.Tokens.of(ruled, True)
    how = np.zeros(len(t.ids), np.int64)
    if len(how):
        _, k, conf = _scored(t, np.arange(len(how)), t.offs, scorer, cost)
        how = np.where((k == 2) & (conf >= upper), 2, np.where((k == 1) & (conf >= title) & ~t.starts(), 1, 0))
        how[t.table(S.keeps_case, bool)] = 0
    return ruled, t.respelt(how, S.title, S.upper)


def _stage(f: Callable[[list[str]], dict[str, pa.Array]], kind: str, text: Column) -> Column:
    """A struct of what f makes of the texts in inference form, a few at a time. It isn't worked out twice for a filter or a second field."""

    def of(col: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 6
        parts = []
        for a, b in ranges(size, TOGETHER) or [(0, 0)]:
            got = f([S.normalize_whitespace(S.nfc(x or "")) for x in col.slice(a, b - a).to_pylist()])
            parts.append(pa.StructArray.from_arrays(list(got.values()), names=list(got)))
        return pa.concat_arrays(parts)

    return F.arrow_udf(of, kind).asNondeterministic()(text)


def _strings(x: list[str]) -> pa.Array:
    return pa.array(x, pa.string())


def _preserved(before: list[str], after: list[str]) -> pa.Array:
    return pa.array([S.preserves_text(a, b) for a, b in zip(before, after)], pa.bool_())


def punctuate(texts: DataFrame, scorer: Scorer, floors: dict[str, float] | None = None, cost: Cost = subwords.quarters) -> DataFrame:
    """(key, input, output, preserved, tokens array<struct<token,label,confidence>>) of rows (key, text).

    Marks that are there stay, with confidence 1, and their words are never scored. Null and empty texts come out empty.
    """
    floors = floors or FLOORS

    def run(x: list[str]) -> dict[str, pa.Array]:
        p, t, at, offs, label, sure = _marked(S.Texts.of(x, False), scorer, floors, cost)
        out = p.written()
        labels = _strings(M.PUNCT).take(pa.array(label))
        each = pa.StructArray.from_arrays([t.strings(at), labels, pa.array(sure)], names=["token", "label", "confidence"])
        return {"input": _strings(x), "output": _strings(out), "tokens": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), each), "preserved": _preserved(x, out)}

    kind = "struct<input:string,output:string,tokens:array<struct<token:string,label:string,confidence:double>>,preserved:boolean>"
    rows = materialise(texts.select("key", _stage(run, kind, F.col("text")).alias("_r")).select("key", "_r.*"), "tokens")
    return rows.select("key", "input", "output", "tokens", "preserved")


def capitalise(texts: DataFrame, scorer: Scorer, title: float = 0.8, upper: float = 0.85, cost: Cost = subwords.quarters) -> DataFrame:
    """(key, input, ruled, output, preserved) of rows (key, text): lower case, sentence starts, then labels of the scorer."""

    def run(x: list[str]) -> dict[str, pa.Array]:
        ruled, c = _cased(S.Texts.of(x), scorer, title, upper, cost)
        return {"input": _strings(x), "ruled": _strings(ruled.written()), "output": _strings(c.written()), "preserved": pa.array(ruled.all_of(c, S.same_but_case))}

    kind = "struct<input:string,ruled:string,output:string,preserved:boolean>"
    return materialise(texts.select("key", _stage(run, kind, F.col("text")).alias("_r")).select("key", "_r.*"), "cased")


def predicted(samples: DataFrame, scorer: Scorer, labels: list[str], cost: Cost = subwords.quarters) -> DataFrame:
    """samples (tokens, labels, ...) with `pred`: the likeliest label of each token, no floors. Null tokens are scored as empty ones.

    A batch evaluation takes the metrics of the pairs (labels, pred); where their lengths differ `pred` is null.
    """
    toks = F.transform("tokens", lambda t: F.coalesce(t, F.lit("")))
    names = F.array(*map(F.lit, labels))
    rows = samples.withColumn("_z", logits_of(toks, None, scorer, cost))
    pred = F.transform("_z", lambda z: F.get(names, M.argmax(z) - 1))
    return rows.withColumn("pred", F.when(F.size("tokens") == F.size("labels"), pred)).drop("_z")


def restore_old(texts: DataFrame, scorer: Scorer, cost: Cost = subwords.quarters) -> DataFrame:
    """(key, output) of rows (key, text) by the older scheme: words without marks, the likeliest of the older labels for each, written again.

    The scorer gives a logit for each of OLD_LABELS. Null and wordless texts come out as they are.
    """
    rows = texts.select("key", "text", F.filter(F.split(X.old_plain(F.col("text")), " "), lambda w: w != "").alias("words"))
    rows = rows.withColumn("z", logits_of(F.col("words"), None, scorer, cost))
    names = F.array(*map(F.lit, T.OLD_LABELS))
    label = F.transform("z", lambda z: F.get(names, M.argmax(z) - 1))
    return rows.select("key", F.when(F.size("words") > 0, T.old_joined(F.col("words"), label)).otherwise(F.col("text")).alias("output"))


def restore(texts: DataFrame, mode: str = "full", marks: Scorer | None = None, case: Scorer | None = None) -> DataFrame:
    """(key, input, punctuated, sentence_capitalized, output, punctuation_only, case_only): the stages of full restoration.

    mode: full, punctuation or capitalization; the scorers that it needs must be given. Stages that don't run are null.
    """
    if mode not in ("full", "punctuation", "capitalization"):
        raise ValueError(f"unknown mode {mode}")
    if (mode != "capitalization" and marks is None) or (mode != "punctuation" and case is None):
        raise ValueError(f"a scorer is missing for mode {mode}")
    none = F.lit(None).cast("string")
    true = F.lit(True)
    if mode == "capitalization":
        c = capitalise(texts, case)
        return c.select("key", "input", none.alias("punctuated"), F.col("ruled").alias("sentence_capitalized"), "output", true.alias("punctuation_only"), F.col("preserved").alias("case_only"))
    if mode == "punctuation":
        p = punctuate(texts, marks)
        return p.select("key", "input", F.col("output").alias("punctuated"), none.alias("sentence_capitalized"), "output", F.col("preserved").alias("punctuation_only"), true.alias("case_only"))

    def run(x: list[str]) -> dict[str, pa.Array]:
        p, ruled, c = _full(x, marks, case)
        marked = p.written()
        return {"input": _strings(x), "punctuated": _strings(marked), "sentence_capitalized": _strings(ruled.written()), "output": _strings(c.written())} | _kept(x, marked, ruled, c)

    kind = "struct<input:string,punctuated:string,sentence_capitalized:string,output:string,punctuation_only:boolean,case_only:boolean>"
    return materialise(texts.select("key", _stage(run, kind, F.col("text")).alias("_r")).select("key", "_r.*"), "restored")


def _full(x: list[str], marks: Scorer, case: Scorer) -> tuple[S.Texts, S.Texts, S.Texts]:
    """The stages of full restoration with the usual floors: with marks, with sentence starts, with case."""
    p = _marked(S.Texts.of(x, False), marks, FLOORS, subwords.quarters)[0]
    return p, *_cased(p, case, 0.8, 0.85, subwords.quarters)


def _kept(x: list[str], marked: list[str], ruled: S.Texts, c: S.Texts) -> dict[str, pa.Array]:
    return {"punctuation_only": _preserved(x, marked), "case_only": pa.array(ruled.all_of(c, S.same_but_case))}


def idempotency(texts: DataFrame, marks: Scorer, case: Scorer) -> DataFrame:
    """(key, input, output, again, punctuation_only, case_only, exact, near): restoration of restored texts.

    near: the second pass changed marks and letter case only. Texts without a word are left out.
    """

    def run(x: list[str]) -> dict[str, pa.Array]:
        p, ruled, c = _full(x, marks, case)
        two = _cased(_marked(c.mapped(S.nfc), marks, FLOORS, subwords.quarters)[0], case, 0.8, 0.85, subwords.quarters)[1]
        before, after = c.written(), two.written()
        pairs = list(zip(before, after))
        exact, near = (pa.array([f(a, b) for a, b in pairs], pa.bool_()) for f in (str.__eq__, S.near_idempotent))
        return {"input": _strings(x), "output": _strings(before), "again": _strings(after)} | _kept(x, p.written(), ruled, c) | {"exact": exact, "near": near}

    kind = "struct<input:string,output:string,again:string,punctuation_only:boolean,case_only:boolean,exact:boolean,near:boolean>"
    worded = texts.where(F.col("text").rlike(rf"[^{X.SP}{T.MARKS}]"))
    return worded.select("key", _stage(run, kind, F.col("text")).alias("_r")).select("key", "_r.*")
