"""Problem 9: items of varying length in containers of fixed capacity.

Method: bounded-space online best-fit. A fixed number of bins is open; a bitset has a bit for each free space that an open
bin has, so the tightest bin that takes an item is the lowest bit at or above its size. When one bin too many is open, the
fullest closes first. Items meet the bins in hash order. The corpus is cut into groups of about GROUP tokens by a hash of
the key; each group packs by itself and leaves at most OPEN bins part-filled.

Defined results: an item longer than the capacity is cut into full containers and one rest; every other item is whole;
items without tokens are in no container; keys are unique; null keys are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN = 64
GROUP = 4_000_000


def pack(sizes: list[int], capacity: int = CAPACITY, most_open: int = OPEN) -> list[int]:
    """The bin number of each item, in order; every size is between 1 and the capacity."""
    bits, bins, out, count, is_open = 0, {}, [], 0, 0
    for size in sizes:
        at = bits >> size
        if at:
            free = size + (at & -at).bit_length() - 1
            number = bins[free].pop()
            if not bins[free]:
                bits ^= 1 << free
            is_open -= 1
        else:
            free, number, count = capacity, count, count + 1
        out.append(number)
        left = free - size
        if left:
            bins.setdefault(left, []).append(number)
            bits |= 1 << left
            is_open += 1
        if is_open > most_open:
            low = (bits & -bits).bit_length() - 1
            bins[low].pop()
            if not bins[low]:
                bits ^= 1 << low
            is_open -= 1
    return out


def _pack_group(key: str, capacity: int, most_open: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", key, "part"], kind="stable")
        number = pack(pdf["tokens"].tolist(), capacity, most_open)
        pdf["container"] = [f"{g}-{n}" for g, n in zip(pdf["grp"], number)]
        return pdf[[key, "part", "tokens", "container"]]

    return run


def containers(sizes: DataFrame, key: str, capacity: int = CAPACITY, most_open: int = OPEN, group: int = GROUP) -> DataFrame:
    """(key, part, tokens, container) of (key, tokens); part counts the pieces of an item longer than the capacity from 0."""
    sized = sizes.where(F.col(key).isNotNull() & (F.col("tokens") > 0))
    total = sized.agg(F.sum("tokens")).head()[0] or 0
    n = max(1, -(-int(total) // group))
    cut = (F.col("tokens") / capacity).cast("long")
    rest = F.col("tokens") % capacity
    full = sized.where(F.col("tokens") >= capacity).select(key, F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("part")).select(key, "part", F.lit(capacity).cast("long").alias("tokens"), F.concat(F.lit("full-"), F.col(key).cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"))
    h = F.xxhash64(F.col(key).cast("string"))
    items = sized.where(rest > 0).select(key, cut.alias("part"), rest.cast("long").alias("tokens"), h.alias("h"), F.pmod(h, F.lit(n)).alias("grp"))
    kind = dict(sizes.dtypes)[key]
    packed = items.groupBy("grp").applyInPandas(_pack_group(key, capacity, most_open), f"{key} {kind}, part long, tokens long, container string")
    return packed.unionByName(full)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, items, tokens, fill): how much of the containers is used."""
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("fullest")).withColumn("fill", F.round(F.try_divide("tokens", F.col("containers") * capacity), 6))
