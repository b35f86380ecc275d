"""Batches of texts: slices of bounded size, and hashes of all words in vectorised steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20  # of text that come to a Python worker at once


def in_small_batches(texts: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches are bounded in bytes.

    By default only their number of rows is bounded, and long texts then fill the buffers of
    both the executor and its Python workers. A smaller limit that the session has stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = texts.sparkSession.conf
    limit = conf.get(name).lower().removesuffix("b")
    if limit.lstrip("-").isdigit() and not 0 < int(limit) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return texts


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, every word's place among them, and the texts' offsets."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), bounds


def hashes_of(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and the texts' offsets into them."""
    words, places, bounds = distinct_words(texts)
    return hashes_of(words)[places], bounds


def text_slices(batch: pa.RecordBatch, most_bytes: int = BATCH_BYTES):
    """The batch in parts of a bounded number of text bytes, at least one row each.

    The parts are copies: some Arrow string functions misread arrays that start inside a buffer.
    Memory of a finished part goes back to the system before the next one.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            pa.default_memory_pool().release_unused()
            yield batch.take(pa.array(np.arange(a, b)))
