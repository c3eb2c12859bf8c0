"""Streams: exact duplicates within a watermark, near duplicates against all accepted ones, counts in event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minhash
from ..functions import text as X


def exact_stream(records: DataFrame, time: str = "landed_at", delay: str = "1 hour") -> DataFrame:
    """The stream without rows whose exact key came within the watermark; columns as they are."""
    keyed = records.withColumn("_key", X.sha256(X.exact_key(F.col("text"))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def near_stream(records: DataFrame, least: int = 58) -> DataFrame:
    """(record_id, source, reject) of a stream (record_id, source, text): near duplicates of any row accepted before.

    State is kept for each source and twenty of words: the signatures of all accepted rows, 512 bytes each, as no age makes
    a row less of a candidate. Rows meet where a band is equal, which loses none (minhash.near_pairs); rows of a
    micro-batch are taken in the order of record_id and of a hash of the text.
    """
    keyed = records.select("record_id", F.coalesce("source", F.lit("")).alias("source"), (X.word_count(F.col("text")) / 20).cast("long").alias("bucket"), minhash.signature(X.nopunct_key(F.col("text"))).alias("sig"), F.md5("text").alias("h"))

    n = minhash.bands_for(least)
    width = minhash.HASHES // n * 8

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        kept = list(state.get[0]) if state.exists else []
        index: dict[tuple[int, bytes], list[int]] = {}

        def bands(x: bytes) -> list[tuple[int, bytes]]:
            return [(i, x[i * width : (i + 1) * width]) for i in range(n)]

        def enter(at: int, x: bytes) -> None:
            for k in bands(x):
                index.setdefault(k, []).append(at)

        for at, x in enumerate(kept):
            enter(at, x)
        rows = pd.concat(list(batches)).sort_values(["record_id", "h"], kind="stable")
        out = []
        for r, sig in zip(rows["record_id"], rows["sig"]):
            s = np.asarray(sig, np.int64)
            x = s.tobytes()
            met = {at for k in bands(x) for at in index.get(k, ())}
            near = any(int((np.frombuffer(kept[at], np.int64) == s).sum()) >= least for at in met)
            out.append((r, key[0], near))
            if not near:
                enter(len(kept), x)
                kept.append(x)
        state.update((kept,))
        yield pd.DataFrame(out, columns=["record_id", "source", "reject"])

    return keyed.where("sig is not null").groupBy("source", "bucket").applyInPandasWithState(step, "record_id string, source string, reject boolean", "sigs array<binary>", "append", "NoTimeout")


def window_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) of each event-time window; late rows beyond the delay are dropped by the watermark."""
    agg = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream, written as Parquet and read again.

    In append mode windows that the watermark hasn't closed are not there; in complete mode each micro-batch writes the whole
    result, open windows included, and the last one is read.
    """
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)
    last = [f"{path}/none"]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[0] = f"{path}/{number}"

    writer.foreachBatch(keep).start().awaitTermination()
    if last[0].endswith("/none"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(last[0])
