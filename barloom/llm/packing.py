"""Best-fit-decreasing packing of token sequences, planned once on the histogram of lengths and applied by joins on rank.

Best-fit decreasing looks only at lengths. Lengths are at most ``capacity``, so its whole course follows from how many
pieces have each length: pieces of one length go, in rank order, to the tightest open sequences, which a segment tree
over remaining capacities finds in logarithmic time. The driver sees one count per length (at most ``capacity`` rows);
pieces stay distributed and find their place from (length, rank).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop, save, small_batches
from barloom.llm.tokens import encoder, regrouped

SLICE_BYTES = 4 << 20  # of text that a task tokenizes at once: what it holds for that goes with it
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities: which of them have an open sequence, and the least one that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.leaves
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least need that an open sequence has."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:  # up until a right sibling has one, then down to its first
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass
class Plan:
    """Runs of ranks of one length: piece rank first + j goes to sequence bin + j // each at base + (j % each) * length."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    sequences: int = 0


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """What one-by-one best-fit decreasing does, with runs of equal sequences taken together.

    The tightest sequence stays the tightest while another piece of the same length fits, so each sequence of a run
    takes ``remaining // length`` pieces in a row. A capacity's runs are used last opened first.
    """
    tree, runs, plan = CapacityTree(capacity), {}, Plan()

    def put(remaining: int, run: tuple[int, int]) -> None:
        if remaining and run[1]:
            runs.setdefault(remaining, []).append(run)
            tree.set(remaining, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, n = plan.sequences, -(-left // each)
                plan.sequences += n
            else:
                each = remaining // length
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.set(remaining, False)
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            for name, x in (("length", length), ("first", rank), ("bin", first), ("each", each), ("base", capacity - remaining)):
                getattr(plan, name).append(x)
            put(remaining, (first + full + (rest > 0), n - full - (rest > 0)))
            put(remaining - each * length, (first, full))
            if rest:
                put(remaining - rest * length, (first + full, 1))
            rank, left = rank + placed, left - placed
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most capacity tokens of each document's ids and end_id (null text: the end alone)."""

    def run(batches):
        encode = encoder(tokenizer)
        for part in regrouped(batches, "text", SLICE_BYTES):
            bounds, ids = encode.batch(part.column("text"), end_id)
            ids = ids.astype("<u4", copy=False)
            lengths = np.diff(bounds)
            n_each = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), n_each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            start = piece * capacity
            length = np.minimum(lengths[doc] - start, capacity)
            at = bounds[doc] + start
            crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to capacity, in as few sequences as best-fit decreasing needs.

    Any other columns stay as they are. Rows are dealt by range of (length, row number), so a length that a third of
    the rows share spreads over many tasks. Repeated rows are pieces of their own; an empty table gives an empty one.
    The driver gets a count per length, and one per (task, length) of the dealt table: capacity plus tasks at most.
    """
    if taken := {"sequence_id", "offset", "_row", "_at"} & {*pieces.columns}:
        raise ValueError(f"pack() adds columns that are there already: {sorted(taken)}")
    named = save(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    dealt = save(named.repartitionByRange("length", "_row").sortWithinPartitions("length", "_row").withColumn("_at", F.monotonically_increasing_id()), "dealt")
    drop(named)
    seen = dealt.groupBy("length", F.shiftright("_at", 33).alias("task")).agg(F.count("*").alias("n"), F.min("_at").alias("lo")).collect()
    counts: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for r in sorted(seen, key=lambda r: (r["length"], r["task"])):
        shift[r["length"], r["task"]] = counts.get(r["length"], 0) - r["lo"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths from {min(counts)} to {max(counts)}; 1 to {capacity} can be packed")
    plan = best_fit_decreasing(counts, capacity)
    wide = 1 << 44  # of a rank: (length, rank) in one sorted number
    keys = np.array(plan.length, np.int64) * wide + np.array(plan.first, np.int64)
    order = np.argsort(keys)
    held = [keys[order], *(np.array(x, np.int64)[order] for x in (plan.first, plan.bin, plan.each, plan.base))]
    shared = pieces.sparkSession.sparkContext.broadcast((held, shift))
    kept = [c for c in dealt.columns if c not in ("_row", "_at")]

    def place(batches):
        (keys, firsts, bins, each, base), shift = shared.value
        for batch in batches:
            length, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_at"))
            pairs, which = np.unique(np.stack([length, at >> 33]), axis=1, return_inverse=True)
            rank = at + np.array([shift[a, b] for a, b in pairs.T.tolist()], np.int64)[which.reshape(-1)]
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            j = rank - firsts[i]
            out = [batch.column(c) for c in kept] + [pa.array(bins[i] + j // each[i]), pa.array(base[i] + j % each[i] * length)]
            yield pa.RecordBatch.from_arrays(out, [*kept, "sequence_id", "offset"])

    schema = dealt.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return dealt.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Documents as token pieces (only those over capacity are cut) with their places in sequences of capacity tokens.

    Null text counts as empty and is one end token; a null doc_id stays null; repeated rows are packed each; an empty
    table gives an empty result; only doc_id and text are read, so other columns never clash.
    """
    with small_batches(docs.sparkSession):
        pieces = save(token_pieces(docs, tokenizer, end_id, capacity), "tokens")
    return pack(pieces, capacity)
