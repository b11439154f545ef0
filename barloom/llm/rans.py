"""Token ids in files of static range asymmetric numeral systems (rANS), written and read in parallel.

Layout: one row per segment, as Parquet, in ascending order of (shard, segment); shards are ranges of doc_id. A segment
holds whole documents of about ``segment_tokens`` ids: its documents' ids and lengths, one frequency table shared by
its blocks, and its blocks. A block is independent of all others: LANES interleaved 32-bit states over 16-bit words,
with a checkpoint (place in the words, all states) every CHECKPOINT_STEPS steps from which decoding can start, and CRC-32
checksums of the words and of the ids of each checkpoint's span. Any reader can decode any block, or any span, alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import small_batches
from barloom.llm.tokens import SLICE_BYTES, encoder, regrouped

SCALE = 16  # of the frequency tables: they add up to 2**16, the low end of the states' range
LANES, BLOCK_STEPS, CHECKPOINT_STEPS = 512, 256, 128
SEGMENT_TOKENS = 4_000_000

BLOCK = "struct<n:long, words:binary, words_crc32:long, states:binary, at:array<long>, ids_crc32:array<long>>"
SEGMENT = f"shard int, segment int, first long, doc_ids array<long>, n_tokens array<long>, symbols binary, freqs binary, blocks array<{BLOCK}>"
_BLOCK_TYPE = pa.struct([("n", pa.int64()), ("words", pa.binary()), ("words_crc32", pa.int64()), ("states", pa.binary()), ("at", pa.list_(pa.int64())), ("ids_crc32", pa.list_(pa.int64()))])
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(_BLOCK_TYPE)]
_NAMES = ["shard", "segment", "first", "doc_ids", "n_tokens", "symbols", "freqs", "blocks"]


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, 1 at least, adding up to 2**SCALE (ids: one at least)."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} distinct ids in a segment; {total} at most")
    freqs = np.maximum(1, counts * total // counts.sum())
    over = int(freqs.sum()) - total
    if over < 0:
        freqs[np.argmax(freqs)] -= over
    while over > 0:  # rare ids were raised to 1: the frequent ones give it back, each in proportion
        give = np.minimum((freqs - 1) * over // max(1, int((freqs - 1).sum())), freqs - 1)
        if not give.any():
            give[np.argsort(freqs)[::-1][:over]] = 1
            give = np.minimum(give, freqs - 1)
        freqs -= give
        over = int(freqs.sum()) - total
    return symbols.astype("<u4"), freqs.astype("<u4")


def encode_block(index: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, list[int]]:
    """(words, states at each checkpoint, their places in the words) of indexes into the table, a whole number of steps."""
    steps = index.reshape(-1, LANES)
    free = (1 << SCALE) - freqs.astype(np.int64)  # what a quotient adds beyond its symbol's own share
    f_all, s_all, free_all = freqs[steps].astype(np.int64), starts[steps].astype(np.int64), free[steps]
    top_all, per_all = f_all << 16, freqs.astype(np.float64)[steps]
    x = np.full(LANES, 1 << 16, np.int64)
    out, states, at, written = [], [], [], 0
    for t in range(len(steps) - 1, -1, -1):
        big = np.flatnonzero(x >= top_all[t])
        if len(big):
            much = x[big]
            out.append(much.astype("<u2"))  # the low 16 bits
            written += len(big)
            x[big] = much >> 16
        # states have 32 bits and frequencies 17, so the quotient in doubles is cut to the exact one
        q = (x / per_all[t]).astype(np.int64)
        x = x + q * free_all[t] + s_all[t]
        if t % CHECKPOINT_STEPS == 0:
            states.append(x.astype("<u4"))
            at.append(written)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u2")
    return words.tobytes(), np.concatenate(states[::-1]).tobytes(), [written - a for a in at[::-1]]


def decode_steps(words: np.ndarray, at: int, x: np.ndarray, n_steps: int, slot: np.ndarray, share: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Indexes into the table of n_steps steps from a checkpoint (place in the words, states); tables by the states' low bits."""
    out = np.empty((n_steps, LANES), np.int64)
    x = x.astype(np.int64)
    for t in range(n_steps):
        low = x & ((1 << SCALE) - 1)
        out[t] = low
        x = share[low] * (x >> SCALE) + within[low]
        small = np.flatnonzero(x < 1 << 16)
        n = len(small)
        if n:
            x[small] = (x[small] << 16) | words[at : at + n]
            at += n
    return slot[out.reshape(-1)]


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes, list[dict]]:
    """(symbols, freqs, blocks) of a segment's ids; a last block's free places hold the table's first symbol."""
    symbols, freqs = frequency_table(ids)
    starts = np.cumsum(freqs) - freqs
    place = np.zeros(int(symbols[-1]) + 1, np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    index = place[ids]
    blocks, size, span = [], LANES * BLOCK_STEPS, LANES * CHECKPOINT_STEPS
    for a in range(0, len(ids), size):
        part = index[a : a + size]
        full = np.concatenate([part, np.zeros(-len(part) % LANES, index.dtype)])
        words, states, at = encode_block(full, freqs, starts)
        some = ids[a : a + size].astype("<u4")
        blocks.append({"n": len(part), "words": words, "words_crc32": zlib.crc32(words), "states": states, "at": at, "ids_crc32": [zlib.crc32(some[b : b + span]) for b in range(0, len(some), span)]})
    return symbols.tobytes(), freqs.tobytes(), blocks


class SegmentReader:
    """Decodes any block of a segment, or from any checkpoint on; raises if a checksum differs."""

    def __init__(self, symbols: bytes, freqs: bytes):
        self.symbols, of = np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.int64)
        self.slot = np.repeat(np.arange(len(of)), of)
        self.share = of[self.slot]  # of a state's low bits: their symbol's frequency, their place among its slots
        self.within = np.arange(1 << SCALE) - np.repeat(np.cumsum(of) - of, of)

    def block(self, block: dict, checkpoint: int = 0) -> np.ndarray:
        span = LANES * CHECKPOINT_STEPS
        first, n = checkpoint * span, block["n"]
        if zlib.crc32(block["words"]) != block["words_crc32"]:
            raise ValueError("a block's words do not match their checksum")
        states = np.frombuffer(block["states"], "<u4").reshape(-1, LANES)[checkpoint]
        index = decode_steps(np.frombuffer(block["words"], "<u2"), block["at"][checkpoint], states, -(-(n - first) // LANES), self.slot, self.share, self.within)
        ids = self.symbols[index[: n - first]]
        if [zlib.crc32(ids[b : b + span]) for b in range(0, len(ids), span)] != list(block["ids_crc32"][checkpoint:]):
            raise ValueError("a block's ids do not match their checksum")
        return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write every document's ids and end_id to path, in ascending order of doc_id (nulls first, equal ids by the texts' hashes).

    Null text is empty, so only its end id is written; an empty table writes an empty file set. One shuffle deals the
    texts out by range of doc_id; each task then holds one segment and a slice of texts at a time. Texts are taken whole,
    however long: a document is one part of one segment. A segment may have 65,536 distinct ids at most, so a larger
    vocabulary asks for smaller segments; beyond that it raises. Only doc_id and text are read, whatever else is there.
    """

    def run(batches):
        encode = encoder(tokenizer)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, n = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, segment, first, doc_ids, lengths, *encode_segment(np.concatenate(held))), _SEGMENT_TYPES)], _NAMES)

        for part in regrouped(batches, "text", SLICE_BYTES):
            bounds, ids = encode.batch(part.column("text"), end_id)
            doc_ids += part.column("doc_id").to_pylist()
            lengths += np.diff(bounds).tolist()
            held.append(ids)
            n += len(ids)
            if n >= segment_tokens:
                yield row()
                segment, first = segment + 1, first + n
                doc_ids, lengths, held, n = [], [], [], 0
        if n:
            yield row()

    few = docs.select(F.col("doc_id").cast("long"), "text")
    with small_batches(docs.sparkSession):
        # rows of one id, or without one, are dealt by their texts' hashes
        order = [F.col("doc_id"), F.xxhash64("text")]
        few.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode a written file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, segment.

    Reads are split by file and row group; the driver sees one count per shard.
    """
    rows = spark.read.schema(SEGMENT).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    base, before = {}, 0
    for r in totals:
        base[r["shard"]], before = before, before + r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("shard", "segment", "first", "doc_ids", "n_tokens", "symbols", "freqs")}
                reader = SegmentReader(r["symbols"], r["freqs"])
                ids = np.concatenate([reader.block(b.as_py()) for b in batch.column("blocks")[i].values])
                lengths = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - m : b]) for b, m in zip(ends.tolist(), lengths.tolist())]
                start = base[r["shard"]] + r["first"] + ends - lengths
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([r["shard"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int")
