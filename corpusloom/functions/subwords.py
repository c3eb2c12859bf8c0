"""Sub-word lengths of words by a public vocabulary, a model file of the sentencepiece library.

The file is read once, on the driver, and sent with the function; each worker process loads it once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import in_pieces

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_LOADED: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """What `load` gives, loaded once in this process under the name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _model(proto: bytes):
    import sentencepiece

    return once(hashlib.sha256(proto).hexdigest(), lambda: sentencepiece.SentencePieceProcessor(model_proto=proto))


def lengths(words: pa.Array, proto: bytes) -> np.ndarray:
    """The number of pieces of each word by itself, one at least. Each different word of the batch is cut once."""
    coded = pc.dictionary_encode(pc.fill_null(words, ""))
    cut = _model(proto).encode(coded.dictionary.to_pylist(), num_threads=1)
    return np.array([max(1, len(x)) for x in cut], np.int32)[coded.indices.to_numpy(zero_copy_only=False)]


def quarters(words: pa.Array) -> np.ndarray:
    """A quarter of each word's characters, one at least: the cost where no vocabulary is at hand."""
    return np.maximum(1, -(-pc.fill_null(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4)).astype(np.int32)


def piece_costs(path: str = DEFAULT_MODEL) -> Callable[[pa.Array], np.ndarray]:
    """The cost function of a model file."""
    with open(path, "rb") as f:
        proto = f.read()
    return lambda words: lengths(words, proto)


def word_costs(words: Column, path: str = DEFAULT_MODEL) -> Column:
    """array<int>: the number of pieces of each word of an array; null for null."""
    cost = piece_costs(path)

    def of(col: pa.Array) -> pa.Array:
        offs = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = pc.list_flatten(col)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(cost(flat) if len(flat) else np.empty(0, np.int32)), mask=pc.is_null(col) if col.null_count else None)

    return F.arrow_udf(lambda col: in_pieces(of, col), "array<int>")(words)
