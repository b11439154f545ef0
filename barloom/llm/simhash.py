"""SimHash near-duplicates: 64-bit fingerprints, all links within a radius found in tables of key blocks, components.

Fingerprints of equal value are one node. Two fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` bit ranges, so each pair within the radius meets in a table keyed by two ranges
(6 blocks, radius 4). Within a key's group a bit-sliced comparison finds the links: bit planes are stored vertically,
64 fingerprints to a word, distances are counted by carry-save adders on whole words, and a block of words is abandoned
as soon as every distance in it exceeds the radius. Only links that join two groups are kept (a spanning forest), so a
group of m gives m - 1 rows at most. Groups over TILE are dealt over tiles; the rest of their pairs is compared only
between members that are not in one component yet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import components, drop, free_names, save, small_batches
from barloom.llm.tokens import text_slices

BLOCKS, TILE = 6, 512
_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_digests(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) hashes of the word shingles in order; of fewer words, one of all of them; none if there are no words."""
    words = (text or "").encode("utf-8", "replace").translate(_ASCII_LOWER).split()  # bytes.split knows the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is set if it is in over half the XXH64 (seed 42) hashes of the word shingles; 0 if there are no words."""
    h = shingle_digests(text, shingle)
    if len(h) <= 1:
        return int(h[0]) if len(h) else 0
    n, votes = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash (64 bits, null for null), fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            for first, n in text_slices(batch.column("text")):
                part = batch.slice(first, n)
                fps = np.array([fingerprint(x, shingle) for x in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    few = docs.select(F.col("doc_id").cast("long"), _text_hash("text").alias("text_hash"), "text")
    return few.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


class BitPlanes:
    """Fingerprints stored vertically: plane b holds bit b of 64 fingerprints to a word."""

    WORDS = 32  # of a block that is abandoned as one

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros((-(-self.n // 64) * 64, 64), np.uint8)
        padded[: self.n] = bits
        self.planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Boolean (queries, fingerprints): at most radius bits differ."""
        words = self.planes.shape[1]
        out = np.zeros((len(queries), words), np.uint64)
        bits = np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        flip = np.where(bits, np.uint64(2**64 - 1), np.uint64(0))
        full = np.uint64(2**64 - 1)
        digits = radius.bit_length()
        for a in range(0, words, self.WORDS):
            planes = self.planes[:, a : a + self.WORDS]
            live = np.arange(len(queries))
            count = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(digits)]
            over = np.zeros((len(queries), planes.shape[1]), np.uint64)
            for b in range(0, 64, 2):
                x, y = planes[b] ^ flip[live, b, None], planes[b + 1] ^ flip[live, b + 1, None]
                # a full adder takes two planes and the ones; its carries then ripple up through half adders
                half = x ^ y
                carry = (x & y) | (half & count[0])
                count[0] = half ^ count[0]
                for k in range(1, digits):
                    count[k], carry = count[k] ^ carry, count[k] & carry
                over |= carry
                if b % 8 == 6 and b > 8:
                    gone = ((over | self._above(count, radius)) == full).all(axis=1)
                    if gone.any():
                        keep = ~gone
                        live, over, count = live[keep], over[keep], [c[keep] for c in count]
                        if not len(live):
                            break
            if len(live):
                out[live, a : a + self.WORDS] = ~(over | self._above(count, radius))
        hits = np.unpackbits(out.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, : self.n]
        return hits.astype(bool)

    @staticmethod
    def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
        """Where the counters exceed radius."""
        above, equal = np.zeros_like(count[0]), np.full_like(count[0], np.uint64(2**64 - 1))
        for k in range(len(count) - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                above |= equal & count[k]
                equal = equal & ~count[k]
        return above


class _Forest:
    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def link_group(fps: np.ndarray, radius: int, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among fps (or of those between the queries and all of fps).

    64 members go first; of the rest only those outside the largest component so far are compared with all, since
    links within it join nothing new and every other link has such a member.
    """
    planes, forest = BitPlanes(fps), _Forest(len(fps))

    def ask(some: np.ndarray) -> None:
        for a in range(0, len(some), 64):
            part = some[a : a + 64]
            for q, t in zip(*np.nonzero(planes.within(fps[part], radius))):
                forest.join(int(part[q]), int(t))

    if queries is not None:
        ask(queries)
    else:
        ask(np.arange(min(64, len(fps))))
        if len(fps) > 64:
            roots = np.array([forest.find(i) for i in range(len(fps))])
            largest = np.bincount(roots).argmax()
            rest = np.flatnonzero(roots != largest)
            ask(rest[rest >= 64])
    return forest.edges


def _linker(radius: int):
    """mapInArrow body over rows (group, fp, asks) sorted by group: edges (a, b) of each group."""

    def of_group(fp: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
        edges = link_group(fp, radius, None if asks.all() else np.flatnonzero(asks))
        return [(int(fp[i]), int(fp[j])) for i, j in edges]

    def table(edges: list) -> pa.RecordBatch:
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []

        def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, fp, asks = rows
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            size, edges = np.diff(cut), []
            first = cut[:-1][size == 2]  # most groups have one or two rows: those at once
            near = np.bitwise_count(fp[first] ^ fp[first + 1]) <= radius if len(first) else first
            edges += [(int(fp[i]), int(fp[i + 1])) for i in first[near]] if len(first) else []
            for i in np.flatnonzero(size > 2):
                edges += of_group(fp[cut[i] : cut[i + 1]], asks[cut[i] : cut[i + 1]])
            return table(edges)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "tile", "other")], axis=1)
            rows = [keys, batch.column("fp").to_numpy().astype(np.int64).view(np.uint64), batch.column("asks").to_numpy(zero_copy_only=False)]
            if held:
                rows = [np.concatenate(x) for x in zip(*held, rows)]
            last = int(np.flatnonzero((rows[0] != rows[0][-1]).any(axis=1))[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
            if last:
                yield emit([x[:last] for x in rows])
            held = [[x[last:] for x in rows]]
        if held:
            yield emit([np.concatenate(x) for x in zip(*held)])

    return run


def _link(rows: DataFrame, radius: int) -> DataFrame:
    keys = ["t", "key", "tile", "other"]
    return rows.select(*keys, "fp", "asks").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linker(radius), "a long, b long")


def _tables(blocks: int, radius: int):
    """(masks) of each table: all ways to choose blocks - radius of the bit ranges."""
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    ranges = [sum(1 << b for b in range(cut[i], cut[i + 1])) for i in range(blocks)]
    return [sum(some) for some in combinations(ranges, blocks - radius)]


def links(nodes: DataFrame, radius: int = 4, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within radius; nodes must be saved."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _tables(blocks, radius)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).where(F.col("n") > 1)
    hot = save(sizes.where(F.col("n") > tile).select("t", "key", "pivot", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "hot")
    if hot.isEmpty():
        return save(_link(keyed.withColumns({"tile": F.lit(0), "other": F.lit(0), "asks": F.lit(True)}), radius), "links")
    at = F.pmod(F.xxhash64("fp", "t"), F.col("tiles")).cast("int")
    marked = keyed.join(hot, ["t", "key"], "left")
    crowded = save(keyed.join(hot, ["t", "key"]).withColumn("tile", at), "crowded")
    first = marked.withColumns({"tile": F.coalesce(at, F.lit(-1)), "other": F.lit(0), "asks": F.lit(True)})
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius
    found = save(_link(first, radius).unionByName(crowded.where(near).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))), "links")
    # pairs across tiles can matter only where a crowded key still has more than one component
    label = save(components(found, "a", "b"), "labels")
    known = crowded.join(label, crowded.fp == label.node, "left").select("t", "key", "tile", "tiles", "fp", F.coalesce("label", "fp").alias("label"))
    known = save(known, "known")
    per = known.groupBy("t", "key", "label").agg(F.count("*").alias("n"))
    largest = per.groupBy("t", "key").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    largest = largest.where("labels > 1").select("t", "key", F.col("most.label").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / tile).cast("int").alias("chunks"))
    largest = save(largest, "largest")
    if not largest.isEmpty():
        rest = known.join(largest, ["t", "key"])
        asks = rest.where("label <> main").withColumn("other", F.pmod(F.xxhash64("fp", "tiles"), F.col("chunks")).cast("int"))
        asked = asks.select("t", "key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "other", "fp", F.lit(True).alias("asks"))
        members = rest.select("t", "key", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "fp", F.lit(False).alias("asks"))
        found = save(found.unionByName(_link(asked.unionByName(members), radius)), "links")
    drop(hot, crowded, label, known, largest)
    return found


def _classes(docs: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Saved tables: doc_id, text_hash, fp of every row; fp, label (of its component) of every fingerprint."""
    with small_batches(docs.sparkSession):
        fps = save(fingerprints(docs, shingle), "fingerprints")
    nodes = save(fps.select("fp").distinct(), "nodes")
    found = links(nodes, radius)
    label = save(components(found, "a", "b"), "labels")
    of_fp = save(nodes.join(label, nodes.fp == label.node, "left").select("fp", F.coalesce("label", "fp").alias("label")), "classes")
    drop(nodes, found, label)
    return fps, of_fp


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach, null if it has none).

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows give one result row each.
    Null doc_ids take part in links; an empty table gives an empty result; only doc_id and text are read.
    """
    fps, of_fp = _classes(docs, radius, shingle)
    least = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of_fp, "fp"), "least")
    ids = save(least.groupBy("label").agg(F.min("least").alias("component_id")), "ids")
    of_fp2 = save(least.join(ids, "label").select("fp", "component_id"), "components")
    drop(of_fp, least, ids)
    return fps.join(of_fp2, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id, nulls last (then of the smallest text hash).

    All columns stay as they are. Rows that repeat doc_id and text are copies, so one of them stays at most.
    """
    return keep_labelled(docs, *_classes(docs, radius, shingle))


def keep_labelled(docs: DataFrame, fps: DataFrame, of_fp: DataFrame) -> DataFrame:
    """docs with one row of each label; tables as of _classes."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_hash").isNull().alias("no_text"), "text_hash")
    per_fp = save(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")).join(of_fp, "fp"), "per_fp")
    best = save(per_fp.groupBy("label").agg(F.min("first").alias("best")), "best")
    marked = per_fp.join(best, "label").select("fp", "best")
    rows = fps.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(save(marked, "marked"), "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))
    rows = save(rows.select("doc_id", "text_hash", kept.alias("kept"), "n").where("NOT kept OR n > 1"), "judged")
    a, b = free_names(docs, "gone_id", "gone_hash")
    gone = rows.where("NOT kept").select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    again = rows.where("kept").select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & _text_hash("text").eqNullSafe(F.col(b))
    out = docs.join(gone, same, "left_anti")
    if not again.isEmpty():
        copies = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, same, "left_anti").unionByName(copies)
    drop(of_fp, per_fp, best)
    return out
