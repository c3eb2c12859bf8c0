"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Method: texts are cut into words by the vocabulary's own pattern; each distinct word is encoded once, by Spark
higher-order functions that fold the ranked merges over the word's bytes, with the ranks in a literal map. A byte is held as
the character of the same number (ISO 8859-1), so that pieces are strings and a merge is a concatenation. The literal is an
array of small maps, the piece's hash naming the map, because a map is searched in line. Decoding concatenates binary pieces.

No row a word is moved: words are counted with partial sums, the MOST_KNOWN most frequent ones of at most LONG bytes are sent
to all tasks with their ids (at most MOST_KNOWN * LONG * 5 bytes), and texts get the ids by a lookup over arrays. Words that
aren't among these, if any, are rows of their own, joined with the dictionary; frequent words are never among them.

Words of more than LONG bytes would cost a fold of quadratic length; they are merged with a heap, to the same ids.

Defined results: null and empty texts have an empty list; blank texts are encoded as they are; special tokens are ordinary
text; keys may repeat and be null. The vocabulary file is read on the driver (default: the installed public_tokenizers).
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import ranges
from ..plans.storage import materialise

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAPS = 4096
LONG = 128
MOST_KNOWN = 200_000
NONE = 1 << 30
# The white space of the Unicode standard, and the vocabulary's word pattern written with it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def read_ranks(path: str = DEFAULT_FILE) -> dict[bytes, int]:
    """Piece -> rank of a vocabulary file with one `base64 rank` in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<string,int>>: the map number crc32(piece) % MAPS holds the piece; Catalyst folds it to a literal."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece.decode("latin-1").encode("utf-8")) % MAPS][piece.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_word(pieces: Column, ranks: Column) -> Column:
    """array<int> ids of an array of one-byte pieces: the pair of lowest rank, leftmost first, is merged until none is left."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(ranks, F.pmod(F.crc32(piece), F.lit(MAPS)).cast("int")), piece)

    def best(acc: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct(F.coalesce(rank(F.concat(F.get(acc, i - 1), F.get(acc, i))), F.lit(NONE)).alias("r"), i.alias("i")))
        return F.array_min(pairs)

    def merged(acc: Column, b: Column) -> Column:
        i = b["i"]
        return F.concat(F.slice(acc, F.lit(1), i - 1), F.array(F.concat(F.get(acc, i - 1), F.get(acc, i))), F.slice(acc, i + 2, F.size(acc)))

    def step(state: Column, _: Column) -> Column:
        acc = state["p"]
        again = F.get(
            F.transform(F.array(best(acc)), lambda b: F.when(b["r"] == NONE, F.struct(acc.alias("p"), F.lit(True).alias("done"))).otherwise(F.struct(merged(acc, b).alias("p"), (F.size(acc) == 2).alias("done")))),
            F.lit(0),
        )
        return F.when(state["done"], state).otherwise(again)

    first = F.struct(pieces.alias("p"), (F.size(pieces) < 2).alias("done"))
    steps = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, first, step, lambda s: F.transform(s["p"], rank))


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as the fold, in n log n steps."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = nxt[i] if piece[i] else n
        if j >= n or piece[i] + piece[j] != p:
            continue
        piece[i], piece[j] = p, b""
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (q := p + piece[nxt[i]]) in ranks:
                heapq.heappush(heap, (ranks[q], i, q))
        if prev[i] >= 0 and (q := piece[prev[i]] + p) in ranks:
            heapq.heappush(heap, (ranks[q], prev[i], q))
    return [ranks[p] for p in piece if p]


def _long_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [heap_encode(w.encode("utf-8"), shared.value) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def words_of(text: Column) -> Column:
    """array<string>: the words of a text, in order, white space included; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def dictionary(words: DataFrame, path: str = DEFAULT_FILE) -> DataFrame:
    """(word, n, ids) of distinct words (word, n)."""
    ranks = read_ranks(path)
    latin = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    pieces = F.transform(F.sequence(F.lit(1), F.length("latin")), lambda i: F.substring(F.col("latin"), i, F.lit(1)))
    short = words.where(F.octet_length("word") <= LONG).select("word", "n", latin.alias("latin")).select("word", "n", pieces.alias("pieces"))
    short = short.select("word", "n", encode_word(F.col("pieces"), rank_literal(ranks)).alias("ids"))
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    long = words.where(F.octet_length("word") > LONG).mapInArrow(_long_words(shared), "word string, n long, ids array<int>")
    return short.unionByName(long)


def sliced(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` words."""
    size = pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
    return (b.slice(at, to - at) for at, to in ranges(size, most))


def _lookup(shared):
    """(keys..., ids, rest) of (keys..., words): a word that isn't known has -1 - its place in `rest` instead of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        words, ids = known.column("word").combine_chunks(), known.column("ids").combine_chunks()
        begin = ids.offsets.to_numpy().astype(np.int64)
        flat_ids = ids.values.to_numpy(zero_copy_only=False)
        size = np.concatenate([np.diff(begin), [1]])  # the last is for words that aren't known
        begin = np.concatenate([begin[:-1], [0]])
        for b in (piece for x in batches for piece in sliced(x)):
            col = b.column("words")
            offs = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.slice(offs[0], offs[-1] - offs[0])
            offs = offs - offs[0]
            at = pc.fill_null(pc.index_in(flat, value_set=words), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = size[at]
            ends = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(int(ends[-1]), np.int32)
            place = np.arange(len(out)) - np.repeat(ends[:-1], n) + np.repeat(begin[at], n)
            missing = np.flatnonzero(at == len(words))
            place[ends[missing]] = 0
            out = flat_ids[place].astype(np.int32) if len(flat_ids) else np.zeros(len(out), np.int32)
            row = np.searchsorted(offs, missing, side="right") - 1
            first = np.searchsorted(row, np.arange(len(b) + 1))
            out[ends[missing]] = -1 - (np.arange(len(missing)) - first[row])
            rest = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat.take(pa.array(missing)))
            keys = [c for c in b.schema.names if c != "words"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(ends[offs].astype(np.int32)), pa.array(out)), rest], names=[*keys, "ids", "rest"])

    return run


def encode(texts: DataFrame, key: str, path: str = DEFAULT_FILE) -> DataFrame:
    """(key, ids array<int>) of each row of (key, text)."""
    none = F.array().cast("array<string>")
    split = texts.select(F.col(key), F.coalesce(words_of(F.col("text")), none).alias("words"))
    counted = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = materialise(dictionary(materialise(counted, "words"), path), "dictionary")
    short = known.where(F.octet_length("word") <= LONG)
    all_known = known.count() <= MOST_KNOWN and short.count() == known.count()
    sent = known if all_known else short.orderBy(F.desc("n"), "word").limit(MOST_KNOWN)
    sink = pa.BufferOutputStream()
    table = sent.select("word", "ids").toArrow()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    shared = texts.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    schema = T.StructType([texts.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("rest", T.ArrayType(T.StringType()))])
    found = split.mapInArrow(_lookup(shared), schema)
    if all_known:
        return found.select(key, "ids")
    found = materialise(found.withColumn("_row", F.monotonically_increasing_id()), "found")
    rest = found.select("_row", F.posexplode("rest").alias("k", "word")).join(known.select("word", F.col("ids").alias("of")), "word")
    rest = rest.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "of"))), lambda x: x["of"]).alias("more"))
    put = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get(F.col("more"), -1 - i))))
    return found.join(rest, "_row", "left").select(key, F.when(F.col("more").isNull(), F.col("ids")).otherwise(put).alias("ids"))


def token_counts(texts: DataFrame, key: str, path: str = DEFAULT_FILE) -> DataFrame:
    """(key, tokens): the number of ids of each text."""
    return encode(texts, key, path).select(key, F.size("ids").cast("long").alias("tokens"))


def decode_ids(ids: Column, path: str = DEFAULT_FILE) -> Column:
    """The text of a list of ids: the binary pieces of a literal list, concatenated."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    pieces = F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in table])), "array<binary>")
    return F.decode(F.aggregate(ids, F.lit(b"").cast("binary"), lambda acc, i: F.concat(acc, F.get(pieces, i))), "UTF-8")
