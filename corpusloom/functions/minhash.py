"""MinHash signatures of character n-grams, and a band join that loses no qualifying pair."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .batches import ranges

HASHES = 64
GRAM = 5
# The family (2k+1) x + k * STEP modulo 2^32.
STEP = 0x9E3779B9


def _grams(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each gram, first place of each number) of the grams at all places of all texts; grams of one number are equal.

    codes: the characters of the texts one after the other; only places with GRAM characters of their text left are asked for.
    """
    begin = np.cumsum(size) - size
    many = np.maximum(size - GRAM + 1, 0)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    letters, small = np.unique(codes, return_inverse=True)
    number = small[at]
    for k in range(1, GRAM):
        number = number * len(letters) + small[at + k]
        if int(number.max(initial=0)) > (1 << 62) // max(1, len(letters)):
            number = np.unique(number, return_inverse=True)[1]
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, at[first]


def signatures(texts: pa.Array, short_as_itself: bool = True) -> pa.ListArray:
    """The signature of each text, which is in the form of its key already: null for null, zeros for texts without a gram.

    Each different gram of the batch is hashed once; then each of the HASHES minima is one pass over all grams.
    """
    rows = texts.to_pylist()
    known = ["" if x is None else x for x in rows]
    size = np.array([len(x) for x in known], np.int64)
    codes = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
    digest = lambda x: int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:4], "big")
    out = np.zeros((len(rows), HASHES), np.int64)
    whole = np.flatnonzero(size >= GRAM)
    if len(whole):
        number, first = _grams(codes, size)
        spelt = codes[first[:, None] + np.arange(GRAM)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        x = np.array([digest(spelt[i : i + GRAM]) for i in range(0, len(spelt), GRAM)], np.uint32)[number]
        many = (size - GRAM + 1)[whole]
        begin = np.cumsum(many) - many
        for k in range(HASHES):
            out[whole, k] = np.minimum.reduceat(x * np.uint32(2 * k + 1) + np.uint32(k * STEP & 0xFFFFFFFF), begin)
    if short_as_itself:
        for i in np.flatnonzero((size > 0) & (size < GRAM)):
            x = digest(known[i])
            out[i] = [((2 * k + 1) * x + k * STEP) & 0xFFFFFFFF for k in range(HASHES)]
    offs = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * HASHES)
    mask = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(offs, pa.array(out.reshape(-1)), mask=mask if len(rows) and mask.true_count else None)


def _pieces(texts: pa.Array, short: bool) -> pa.Array:
    """Batches of long texts are cut, so that the arrays of a piece stay small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = [signatures(texts.slice(a, b - a), short) for a, b in ranges(size, 1 << 20)]
    return pa.concat_arrays(out) if out else signatures(texts, short)


@F.arrow_udf(ArrayType(LongType()))
def _signature(s: pa.Array) -> pa.Array:
    return _pieces(s, True)


@F.arrow_udf(ArrayType(LongType()))
def _signature_long(s: pa.Array) -> pa.Array:
    return _pieces(s, False)


def signature(key: Column, short_as_itself: bool = True) -> Column:
    return (_signature if short_as_itself else _signature_long)(key)


def agreement(a: Column, b: Column) -> Column:
    """The number of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def bands_for(least: int, hashes: int = HASHES) -> int:
    """The fewest bands, dividing the hashes, of which one must be equal when `least` positions are."""
    need = hashes - least + 1
    return next(b for b in range(need, hashes + 1) if hashes % b == 0)


def near_classes(left: DataFrame, right: DataFrame, least: int = 58, extra: tuple[str, ...] = ()) -> DataFrame:
    """(sig_a, sig_b, extra..., equal): signatures of both sides with at least `least` equal positions, each once.

    With d differing positions at most d bands differ, so more bands than d leave one equal: no pair is lost. Rows of equal
    signature are one class, however many they are.
    """
    n = bands_for(least)
    width = HASHES // n

    def classes(df: DataFrame, s: str) -> DataFrame:
        one = df.select("sig", *extra).distinct()
        band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("no"), F.xxhash64(F.slice(F.col("sig"), i * width + 1, F.lit(width))).alias("h"))))
        return one.select(F.col("sig").alias(f"sig_{s}"), *extra, band.alias("band")).select(f"sig_{s}", *extra, "band.no", "band.h")

    pairs = classes(left, "a").join(classes(right, "b"), ["no", "h", *extra]).withColumn("equal", agreement(F.col("sig_a"), F.col("sig_b"))).where(F.col("equal") >= least)
    return pairs.select("sig_a", "sig_b", *extra, "equal").distinct()


def near_pairs(left: DataFrame, right: DataFrame, least: int = 58, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, equal) of rows (id, sig, extra...) with at least `least` equal positions and equal extra columns.

    The classes of near_classes with their rows; copies are in every pair, as the form of the result asks for.
    """
    a = left.select(F.col("id").alias("id_a"), F.col("sig").alias("sig_a"), *extra)
    b = right.select(F.col("id").alias("id_b"), F.col("sig").alias("sig_b"), *extra)
    return near_classes(left, right, least, extra).join(a, ["sig_a", *extra]).join(b, ["sig_b", *extra]).select("id_a", "id_b", "equal")
