"""Importance resampling toward a target: documents are drawn by how much more their words are the target's than the corpus's.

Tasks work in Arrow kernels: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode give word indices; the
indices and the same indices shifted by one form the pairs; each distinct word and pair of a batch gets its CRC once, and
its bucket's count or gain is taken for all places and summed over each document's segment. A first pass counts buckets
(one fixed-size vector a task, summed by Spark), a second scores documents with the table of gains. Drawing without
replacement is a Gumbel draw: the highest sums of weight and a noise that a document's id fixes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import NOT_ALNUM, free_names, numbered, save, small_batches
from barloom.llm.tokens import regrouped

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
BATCH_BYTES = 2 << 20  # of text that a task splits at once: what it holds for that goes with it


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, of_word, words, of_pair, pairs): words of each text; text and bucket of every word and of every pair of words.

    Words are lower-cased (A-Z) runs without the characters of NOT_ALNUM; nulls have none.
    """
    whole = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # ascii_lower errs on slices
    split = pc.split_pattern_regex(pc.ascii_lower(whole), pattern=NOT_ALNUM)
    coded = pc.list_flatten(split).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if "" in distinct:  # before the first word and after the last
        real = codes != distinct.index("")
        codes, of = codes[real], of[real]
    n_words = np.bincount(of, minlength=len(texts))
    raw = [w.encode() for w in distinct]
    crc = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    together = of[1:] == of[:-1]
    keys, place = np.unique((codes[:-1] * len(raw) + codes[1:])[together], return_inverse=True)
    # the CRC of a pair goes on from that of its first word and the blank
    first = np.array([zlib.crc32(b" ", int(x)) for x in crc], np.int64)[keys // max(len(raw), 1)]
    second = [raw[i] for i in (keys % max(len(raw), 1)).tolist()]
    of_keys = np.fromiter(map(zlib.crc32, second, first.tolist()), np.int64, len(keys)) % buckets
    return n_words, of, (crc % buckets)[codes], of[1:][together], of_keys[place]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows: a vector a task, summed by Spark to at most ``buckets`` rows."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for part in regrouped(batches, "text", BATCH_BYTES):
            _, _, words, _, pairs = features(part.column("text"), buckets)
            n += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    with small_batches(docs.sparkSession):
        summed = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the target's smoothed share over the corpus's, for each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain of a document's features; 0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        for part in regrouped(batches, "text", BATCH_BYTES):
            table = shared.value
            n_words, of_word, words, of_pair, pairs = features(part.column("text"), len(table))
            n = n_words + np.maximum(n_words - 1, 0)
            total = np.zeros(len(n_words), np.int64)
            for of, bucket in ((of_word, words), (of_pair, pairs)):
                if len(of):
                    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    total[of[starts]] += np.add.reduceat(table.take(bucket), starts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    with small_batches(docs.sparkSession):
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank.

    score is weight plus Gumbel noise of the seed and doc_id. Of the documents with at least ``least_words`` words the
    ``percent`` of the highest scores are drawn, ties to the smaller doc_id; rank is 1, 2, 3... in that order, null for the
    others. Null texts have no words and weight 0; a null doc_id has the noise of an empty one and comes last among
    equals; repeated rows are scored and drawn each; texts are taken whole, however long. Without a target every bucket's
    target count is 0; an empty docs gives an empty result. Only doc_id and text are read, whatever else is there.
    """
    scored = save(weigh(docs, gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))), "weighed")
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digest, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scored.withColumn("score", (F.col("weight") + noise).cast("long"))
    asked = scored.where(F.col("n_words") >= least_words)
    n = asked.count() * percent // 100
    (down, none) = free_names(scored, "down", "none")
    order = asked.withColumns({down: -F.col("score"), none: F.col("doc_id").isNull()})
    ranked = numbered(order, [down, none, "doc_id", "weight", "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, "rank").unionByName(rest)
