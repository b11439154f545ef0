"""Token counts: batch encoding in Arrow functions that gives lengths only.

Rows come to a task in batches balanced by the bytes of their texts. Longer texts are cut at safe boundaries into
pieces, which are balanced again, so that neither many rows nor a long one need more memory than a batch. Arrow splits
the pieces at white space and dictionary-encodes the chunks; the tokenizer sees each new chunk once, and what is kept of
it is a length. A text's count is the sum of its chunks' lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import small_batches
from barloom.llm.tokens import encoder, regrouped, text_slices

BATCH_BYTES, PIECE_BYTES, LIMIT = 4 << 20, 1 << 20, 2048
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)
_ALNUM = _DIGIT | np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])


def safe_cuts(raw: bytes, most: int = PIECE_BYTES) -> list[int]:
    """Places at which the tokens of a text can be counted apart, about ``most`` bytes from each other.

    Before white space, which separates words and is itself no token; where there is none, between an ASCII digit and
    an ASCII letter or digit, as a digit is a word of its own, no special token holds one, and normalisation joins no
    two ASCII characters. A stretch that has neither stays whole.
    """
    cuts, at = [], 0
    while len(raw) - at > most:
        window = np.frombuffer(raw, np.uint8, most + 1, at)
        good = np.flatnonzero(_BLANK[window[1:]])
        if not len(good):
            good = np.flatnonzero(_DIGIT[window[:-1]] & _ALNUM[window[1:]])
        if len(good):
            at += int(good[-1]) + 1
        else:  # the next safe place, if any
            rest = np.frombuffer(raw, np.uint8, offset=at)
            good = np.flatnonzero(_BLANK[rest[1:]] | (_DIGIT[rest[:-1]] & _ALNUM[rest[1:]]))
            if not len(good):
                break
            at += int(good[0]) + 1
        cuts.append(at)
    return cuts


def count_tokens(texts: pa.Array, path: str, most: int = PIECE_BYTES, batch: int = BATCH_BYTES) -> np.ndarray:
    """Number of tokens of each text; nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    owner, pieces = np.arange(len(texts)), texts
    long = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > most)
    if len(long):
        cut = {i: [0, *safe_cuts(texts[i].as_py().encode(), most), None] for i in long.tolist()}
        parts, owner, done = [], [], 0
        for i in long.tolist():
            raw = texts[i].as_py().encode()
            parts += [texts.slice(done, i - done), pa.array([raw[a:b].decode() for a, b in zip(cut[i], cut[i][1:])], pa.large_string())]
            owner += [*range(done, i), *[i] * (len(cut[i]) - 1)]
            done = i + 1
        pieces, owner = pa.concat_arrays([*parts, texts.slice(done)]), np.array([*owner, *range(done, len(texts))])
    out = np.zeros(len(texts), np.int64)
    for first, n in text_slices(pieces, batch):
        np.add.at(out, owner[first : first + n], encoder(path).lengths(pieces.slice(first, n)))
    return out


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Tokens are the tokenizer's without begin, end or added special tokens; special strings inside a text are one token
    each, as is the library's default. Null texts are empty; repeated rows are counted each; texts are taken whole,
    however long; an empty table gives an empty result. Only doc_id and text are read, whatever else is there. No shuffle.
    """

    def run(batches):
        for part in regrouped(batches, "text", BATCH_BYTES):
            texts = part.column("text")
            size, n = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), count_tokens(texts, path)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    with small_batches(docs.sparkSession):
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
