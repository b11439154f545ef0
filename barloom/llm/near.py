"""SimHash near-duplicates by similarity: SimHash bits propose, bit-sliced SimHash distances prune, exact sets decide.

Similarity is that of the sets of word shingles, shared over all. Texts of equal sets are one node. A pair of similarity
0.8 differs in a SimHash bit with probability 0.152 (see shared.radius_for), so no few bit ranges of 64 bits guarantee
it. A node has LANES SimHashes of 16 bits instead; its keys are the first bits of each, as many as leave about CROWD of
unrelated texts to a key, 16 at most. A pair of 0.8 shares none of the keys with probability (1 - 0.848 ** bits) **
LANES: 7 in 100,000 at 16 bits, 1 in 10 million at 13, less above 0.8.

Within a key, SimHashes of 192 bits are compared by bit planes; what they join makes a group. Near copies meet again in
up to LANES keys, each time among others, so the groups are not compared one by one: all bits of the SimHashes split them
first, and those that share a member become one, where each text stands once.

The rest is exact: each text is first compared with the nearest one and with one that most of its groups share. Where that
leaves several components, tasks compare the members outside the largest with all others, a tile at a time: the bit planes
of a tile are compared at once, what is left is counted exactly, and only links that join two components leave the task.

A SimHash of few shingles has few votes: where one set has fewer than SMALL, a pair shares one of the least
n - ceil(0.8 n) + 1 hashes of each, and meets there, which is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import components, drop, radius_for, save, small_batches
from barloom.llm.simhash import BitPlanes, _Forest, _text_hash, keep_labelled, shingle_digests
from barloom.llm.tokens import text_slices

SHINGLE, SIMILARITY = 5, 0.8
TILE, SEED = 256, 42
LANES, WORDS, CROWD, HOT = 128, 3, 32, 4  # keys of a node; words of a compared SimHash; texts to a key; tiles of a key that is dealt out
WHOLE = 16  # tiles of a group that all bits still split
SMALL = 16  # sets of fewer shingles are compared exactly whatever their SimHashes
_RNG = np.random.default_rng(SEED)
_FLIP, _TIMES = _RNG.integers(0, 2**64, LANES // 4, np.uint64), _RNG.integers(0, 2**64, LANES // 4, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text, one of all its words; empty without words."""
    return np.unique(shingle_digests(text, shingle))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """LANES SimHashes of 16 bits, four to a word; the votes of each word are those of another mix of the hashes."""
    votes = np.zeros(16 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # a byte holds so many votes
        mixed = (hashes[at : at + 255, None] ^ _FLIP) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        votes += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)


def small_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes, one of which any set as similar shares; none of sets that no set under SMALL can be similar to."""
    n = len(hashes)
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1 if n and similarity * n < SMALL else 0]


def set_simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes of the set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


PRINTS = "doc_id long, text_hash long, fp long, sims array<long>, lanes array<short>, small array<long>"


def prints(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, fp (of the shingle set), sims (WORDS words of its SimHash), lanes and small (what keys are made of)."""
    names = [x.split()[0] for x in PRINTS.split(", ")]

    def run(batches):
        for batch in batches:
            for first, n in text_slices(batch.column("text")):
                part = batch.slice(first, n)
                sets = [shingle_set(x, shingle) for x in part.column("text").to_pylist()]
                fps = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
                wide = [wide_simhash(x) if len(x) >= SMALL else np.zeros(0, np.uint64) for x in sets]
                sims = pa.array([x[:WORDS].view(np.int64) for x in wide], pa.list_(pa.int64()))
                lanes = pa.array([x.view(np.int16) for x in wide], pa.list_(pa.int16()))
                small = pa.array([small_keys(x, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps), sims, lanes, small], names)

    few = docs.select(F.col("doc_id").cast("long"), _text_hash("text").alias("text_hash"), "text")
    return few.mapInArrow(run, PRINTS)


def pairs_within(sims: np.ndarray, cut: np.ndarray, asks: np.ndarray | None, radius: int, first_radius: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group (rows cut[g] to cut[g + 1]) that differ in radius bits at most.

    Each row is compared with those behind it, or, if asks is given, each asking row with all. The first two words go by
    bit planes, for many rows and groups at once: 64 rows to a word, distances in carry-save counters.
    """
    n = len(sims)
    bits = np.unpackbits(np.ascontiguousarray(sims[:, :2]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, 128), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)
    size = np.diff(cut)
    start, end = np.repeat(cut[:-1], size), np.repeat(cut[1:], size)
    rows = np.arange(n) if asks is None else np.flatnonzero(asks)
    low = (rows + 1 if asks is None else start[rows]) // 64
    many = np.maximum((end[rows] - 1) // 64 - low + 1, 0)
    who = np.repeat(rows, many)
    word = np.repeat(low, many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    left, right = [], []
    digits = first_radius.bit_length()
    for at in range(0, len(who), chunk):
        q, w = who[at : at + chunk], word[at : at + chunk]
        mine = [sims[q, 0], sims[q, 1]]
        count, over = [np.zeros(len(q), np.uint64) for _ in range(digits)], np.zeros(len(q), np.uint64)
        for b in range(0, 128, 2):
            up = np.uint64(63 - b % 64), np.uint64(62 - b % 64)
            x, y = (planes[b + i][w] ^ ((mine[b // 64] << up[i]).view(np.int64) >> 63).view(np.uint64) for i in (0, 1))
            half = x ^ y
            carry = (x & y) | (half & count[0])
            count[0] = half ^ count[0]
            for k in range(1, digits):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
        hit = ~(over | BitPlanes._above(count, first_radius))
        some = np.flatnonzero(hit)
        of, lane = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[some[of]], w[some[of]] * 64 + lane
        keep = (j < end[i]) & ((j > i) if asks is None else (j >= start[i]) & (j != i))
        i, j = i[keep], j[keep]
        near = np.bitwise_count(sims[i] ^ sims[j]).sum(axis=1, dtype=np.int64) <= radius
        left.append(i[near])
        right.append(j[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n by the pairs."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label = label[label]


def _grouper(keys: list[str], radius: int, first_radius: int):
    """mapInArrow body over rows sorted by keys: g, fp, pivot of the groups that distances within a key join."""

    def groups(rows: pa.Table, cut: np.ndarray):
        fp = rows.column("fp").to_numpy()
        sims = np.stack([rows.column(f"s{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
        asks = rows.column("asks").to_numpy() if "asks" in rows.column_names else None
        i, j = pairs_within(sims, cut, asks, radius, first_radius)
        label = joined(len(fp), i, j)
        some = np.unique(np.concatenate([i, j]))
        some = some[np.argsort(label[some], kind="stable")]
        out = []
        for x in np.split(some, np.flatnonzero(np.diff(label[some])) + 1):
            members = np.unique(fp[x])
            if len(members) > 1:  # the same members are the same group, whatever the key
                g = xxhash.xxh64_intdigest(members.tobytes(), SEED)
                out.append((np.full(len(members), g, np.uint64).view(np.int64), members, np.full(len(members), members[g % len(members)])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["g", "fp", "pivot"])

    return _by_group(keys, groups)


def _by_group(keys: list[str], groups):
    """mapInArrow body over rows sorted by keys: groups(rows, cut) of whole groups, those of a batch at once."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                whole = pa.Table.from_batches([*held, batch]).combine_chunks()
                at = np.stack([whole.column(c).to_numpy() for c in keys], axis=1)
                cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1])
                if len(cut) > 1:
                    yield from groups(whole.slice(0, int(cut[-1])), cut)
                held = whole.slice(int(cut[-1])).combine_chunks().to_batches()
        if held:
            last = pa.Table.from_batches(held)
            yield from groups(last, np.array([0, last.num_rows]))

    return run


def nearest_within(lanes: np.ndarray, wide: np.ndarray, cut: np.ndarray, radius: int, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, other, apart) of rows of groups (rows cut[g] to cut[g + 1]): the least index that pairs within the radius
    reach in the group, the nearest other row and the bits that it differs in.

    Rows that are not wide have no SimHash and are near all of their group.
    """
    n = len(lanes)
    behind = np.repeat(cut[1:], np.diff(cut)) - np.arange(n) - 1
    ends = np.cumsum(behind)
    other, apart = np.arange(n), np.full(n, 64 * lanes.shape[1] + 1)
    left, right = [], []
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
        i = np.repeat(np.arange(lo, hi), behind[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - behind[lo:hi] - ends[lo] + behind[lo], behind[lo:hi])
        d = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64)
        near = (d <= radius) | ~(wide[i] & wide[j])
        i, j, d = i[near], j[near], d[near]
        for x, y in ((i, j), (j, i)):
            best = np.lexsort((d, x))
            best = best[np.concatenate([[True], x[best][1:] != x[best][:-1]])] if len(best) else best
            best = best[d[best] < apart[x[best]]]
            other[x[best]], apart[x[best]] = y[best], d[best]
        left.append(i)
        right.append(j)
        lo = hi
    return joined(n, np.concatenate(left), np.concatenate(right)), other, apart


def _splitter(radius: int):
    """mapInArrow body over rows (g, fp, lanes) sorted by g: fp, pivot (the least of its part of the group), other (the nearest), apart."""

    def groups(rows: pa.Table, cut: np.ndarray):
        fp, lists = rows.column("fp").to_numpy(), rows.column("lanes").combine_chunks()
        wide = lists.value_lengths().to_numpy() > 0
        lanes = np.zeros((len(fp), LANES), np.int16)
        lanes[wide] = lists.flatten().to_numpy().reshape(-1, LANES)
        label, other, apart = nearest_within(lanes.view(np.uint64), wide, cut, radius)
        pivot = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(pivot, label, fp)
        some = np.flatnonzero(other != np.arange(len(fp)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[some], pivot[label[some]], fp[other[some]], apart[some])], ["fp", "pivot", "other", "apart"])

    return _by_group(["g"], groups)


def gathered(crowd: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Saved g, fp, pivot, other: each member of the proposed groups once, in a group with all that it may be similar to.

    Groups are split by all bits of the SimHashes first; those over WHOLE tiles stay whole. pivot and other are texts to
    be compared with first.
    """
    size = crowd.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE * tile)
    large = save(size.select("g"), "large")
    few, many = crowd, None
    if not large.isEmpty():
        few, many = crowd.join(F.broadcast(large), "g", "left_anti"), crowd.join(F.broadcast(large), "g", "left_semi")
    radius = radius_for(similarity, 1e-12, 16 * LANES)  # few shingles differ in more bits than the angle says: in 0.158 at 0.8
    rows = few.select("g", "fp").join(nodes.select("fp", "lanes"), "fp").select("g", "fp", "lanes")
    parts = rows.repartition("g").sortWithinPartitions("g").mapInArrow(_splitter(radius), "fp long, pivot long, other long, apart long")
    if many is not None:
        parts = parts.unionByName(many.where("fp <> pivot").select("fp", "pivot", F.col("pivot").alias("other"), F.lit(16 * LANES).cast("long").alias("apart")))
    per = parts.groupBy("fp", "pivot").agg(F.min(F.struct("apart", "other")).alias("nearest"))
    of_fp = Window.partitionBy("fp")  # a row a pivot: LANES of them, or those of small sets and crowded keys
    both = save(per.select("fp", "pivot", F.min("pivot").over(of_fp).alias("first"), F.min("nearest").over(of_fp)["other"].alias("other")), "parts")
    # a text joins all its pivots: with the first of them, and those with one another
    edges = both.select(F.col("fp").alias("a"), F.col("first").alias("b")).unionByName(both.select(F.col("pivot").alias("a"), F.col("first").alias("b")))
    label = save(components(edges, "a", "b"), "gathered")
    asks = both.groupBy("fp").agg(F.min("first").alias("pivot"), F.min("other").alias("other"))
    out = label.join(asks, label["node"] == asks["fp"], "left")
    out = save(out.select(F.col("label").alias("g"), F.col("node").alias("fp"), F.coalesce("pivot", "node").alias("pivot"), F.coalesce("other", "node").alias("other")), "whole")
    drop(large, both, label)
    return out


def proposals(nodes: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Groups (g, fp, pivot) that hold every pair which shares a key and is within the radius; nodes must be saved."""
    bits = min(16, max(8, math.ceil(math.log2(max(nodes.count(), 1) / CROWD))))
    radius, first_radius = radius_for(similarity, bits=64 * WORDS), radius_for(similarity, bits=128)
    words = [f"s{k}" for k in range(WORDS)]
    lanes = nodes.select("fp", *[F.get("sims", F.lit(k)).alias(w) for k, w in enumerate(words)], "lanes", F.posexplode("lanes").alias("t", "lane"))
    key = F.shiftleft("t", 16).bitwiseOR(F.col("lane").cast("int").bitwiseAND(F.lit((1 << bits) - 1)))
    keyed = lanes.select(key.alias("key"), "fp", *words)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    hot = save(counts.where(F.col("n") > HOT * tile), "hot")
    crowded = not hot.isEmpty()
    few = keyed.join(hot, "key", "left_anti") if crowded else keyed

    def grouped(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_grouper(list(keys), radius, first_radius), "g long, fp long, pivot long")

    found = grouped(few, "key")
    # small sets: what shares one of the least hashes, exact later on
    least = nodes.select("fp", F.explode("small").alias("key"))
    shares = least.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "key")).alias("pivot")).where("n > 1")
    found = found.unionByName(least.join(shares, "key").select(F.xxhash64("key").alias("g"), "fp", "pivot"))
    if crowded:
        # most of a crowded key is near one text of it, found by the most frequent lane beside the key: one group
        beside = F.element_at("lanes", F.pmod(F.col("t") + 1, F.lit(LANES)).cast("int") + 1)
        many = save(lanes.select(key.alias("key"), "fp", *words, beside.alias("beside")).join(hot, "key"), "crowded")
        one = F.min_by(F.struct("fp", *words), F.xxhash64("fp", "key"))
        alike = many.groupBy("key", "beside").agg(F.count("*").alias("m"), one.alias("one"))
        pivots = alike.groupBy("key").agg(F.max_by("one", F.struct("m", "beside")).alias("one"))
        apart: Column = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"one.{w}"))) for w in words), F.lit(0))
        marked = many.join(pivots, "key").select("key", "fp", *words, "n", F.col("one.fp").alias("pivot"), (apart > radius).alias("asks"))
        marked = save(marked, "marked")
        around = marked.where("NOT asks").select(F.xxhash64("key", "pivot").alias("g"), "fp", "pivot")
        # the others meet all, a chunk of them and a tile of all at a time
        others = marked.where("asks").groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
        rest = marked.join(others, "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        at, part = F.pmod(F.xxhash64("fp", "key"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("key", "fp"), F.col("chunks")).cast("int")
        all_tiles, all_chunks = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        asked = rest.where("asks").select("key", all_tiles.alias("tile"), part.alias("other"), "fp", *words, F.lit(1).alias("asks"))
        members = rest.select("key", at.alias("tile"), all_chunks.alias("other"), "fp", *words, F.lit(0).alias("asks"))
        found = found.unionByName(around).unionByName(grouped(asked.unionByName(members), "key", "tile", "other"))
    crowd = save(found.dropDuplicates(["g", "fp"]), "crowd")
    drop(hot, *((many, marked) if crowded else ()))
    return crowd


def _sets(docs: DataFrame, need: DataFrame, shingle: int) -> DataFrame:
    """fp, sim (the SimHash), hashes (the set) of the rows that ``need`` names by doc_id and text_hash, one per fp.

    A node is looked up by one of its rows, so copies of a text do not meet anywhere.
    """

    def run(batches):
        for batch in batches:
            for first, n in text_slices(batch.column("text")):
                part = batch.slice(first, n)
                sets = [shingle_set(x, shingle) for x in part.column("text").to_pylist()]
                sims = np.array([set_simhash(x) for x in sets], np.uint64).view(np.int64)
                hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(sims), hashes], ["fp", "sim", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), _text_hash("text").alias("h"), "text")
    named = need.select("fp", F.col("rep.doc_id").alias("rep_d"), F.col("rep.text_hash").alias("rep_h"))
    one = texts.join(named, texts["d"].eqNullSafe(named["rep_d"]) & texts["h"].eqNullSafe(named["rep_h"])).select("fp", "text").dropDuplicates(["fp"])
    return one.mapInArrow(run, "fp long, sim long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The saved pairs (a, b) whose sets are as similar as asked."""
    both = pairs
    for c, other in ("ab", "ba"):  # a member of many pairs is copied, so that they are dealt over tasks
        many = pairs.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > TILE)
        hot = F.broadcast(save(many.select(c, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "hot"))
        own = sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"{c}_set")).join(hot, c, "left")
        own = own.select(c, f"{c}_set", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("tile"))
        at = F.coalesce(F.pmod(F.xxhash64(other), F.col("tiles")).cast("int"), F.lit(0))
        dealt = both.join(hot, c, "left").withColumn("tile", at).drop("tiles")
        both = dealt.join(own, [c, "tile"]).drop("tile")
    both = both.withColumn("shared", F.size(F.array_intersect("a_set", "b_set")))
    union = F.size("a_set") + F.size("b_set") - F.col("shared")
    return save(both.where(F.col("shared") / union >= similarity).select("a", "b"), "links")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many hashes each sorted set of a shares with each of b: matrix products over the hashes that a has."""
    known = np.unique(np.concatenate(a))
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(known), width):
        some = known[lo : lo + width]

        def rows(sets: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(sets), len(some)), np.float32)
            for i, x in enumerate(sets):
                x = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
                at = np.searchsorted(some, x)
                m[i, at[some[at] == x]] = 1
            return m

        out += rows(a) @ rows(b).T
    return out


def link_tile(fp, label, sim, asks, member, sets, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links of asking rows with members of another label that are as similar as asked; only those that join two labels."""
    of = np.flatnonzero(asks)
    if not len(of):
        return []
    size = np.array([len(x) for x in sets])
    near = BitPlanes(sim).within(sim[of], radius)
    near |= np.minimum(size[of][:, None], size[None, :]) < SMALL
    near &= np.minimum(size[of][:, None], size[None, :]) >= similarity * np.maximum(size[of][:, None], size[None, :]) - 1e-6
    near &= member & (label[of][:, None] != label[None, :]) & ((fp[of][:, None] < fp[None, :]) | ~asks[None, :])
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    shared = shared_counts([sets[i] for i in of[rows]], [sets[j] for j in cols])
    union = size[of[rows]][:, None] + size[cols][None, :] - shared
    ids, where = np.unique(label, return_inverse=True)
    forest, edges = _Forest(len(ids)), []
    for i, j in zip(*np.nonzero(near[np.ix_(rows, cols)] & (shared / union >= similarity))):
        x, y = int(of[rows[i]]), int(cols[j])
        before = len(forest.edges)
        forest.join(int(where[x]), int(where[y]))
        if len(forest.edges) > before:
            edges.append((int(fp[x]), int(fp[y])))
    return edges


def _tile_linker(similarity: float, radius: int):
    """mapInArrow body over rows sorted by (g, tile, other): links (a, b)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                whole = pa.Table.from_batches(held).combine_chunks()
                keys = np.stack([whole.column(c).to_numpy() for c in ("g", "tile", "other")], axis=1)
                cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                for x, y in zip([0, *cut[:-1].tolist()], cut.tolist()):
                    yield from group(whole.slice(x, y - x))
                held = whole.slice(int(cut[-1])).combine_chunks().to_batches() if len(cut) else whole.to_batches()
        if held:
            yield from group(pa.Table.from_batches(held).combine_chunks())

    def group(rows: pa.Table):
        fp, label, asks = (rows.column(c).to_numpy() for c in ("fp", "label", "asks"))
        # an asking row may stand among the members, too: one of both is enough
        order = np.lexsort((~asks, fp))
        first = order[np.concatenate([[True], fp[order][1:] != fp[order][:-1]])]
        member = np.isin(fp[first], fp[~asks])
        sim = rows.column("sim").to_numpy().view(np.uint64)
        lists = rows.column("hashes").combine_chunks()
        values, offsets = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sets = [values[offsets[i] : offsets[i + 1]] for i in first]
        both = np.array(link_tile(fp[first], label[first], sim[first], asks[first], member, sets, similarity, radius), np.int64).reshape(-1, 2)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all proposed pairs of distinct ``fp`` as similar as asked; nodes must be saved."""
    crowd = proposals(nodes, similarity, tile)
    whole = gathered(crowd, nodes, similarity, tile)
    with small_batches(docs.sparkSession):
        sets = save(_sets(docs, nodes.join(whole.select("fp"), "fp", "left_semi").select("fp", "rep"), shingle), "sets")
    first = whole.select("fp", "pivot").unionByName(whole.select("fp", F.col("other").alias("pivot"))).where("fp <> pivot")
    star = save(first.select(F.least("pivot", "fp").alias("a"), F.greatest("pivot", "fp").alias("b")).distinct(), "star")
    found = _similar(star, sets, similarity)
    label = save(components(found, "a", "b"), "labels")
    known = whole.join(label, whole["fp"] == label["node"], "left")
    known = save(known.select("g", "fp", F.coalesce("label", "fp").alias("label")), "known")
    per = known.groupBy("g", "label").agg(F.count("*").alias("m")).groupBy("g")
    per = per.agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("labels"), F.sum("m").alias("n")).where("labels > 1")
    per = per.select(
        "g", F.col("most.label").alias("main"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"),
        F.ceil((F.col("n") - F.col("most.m")) / tile).cast("int").alias("chunks"),
    )
    rest = save(known.join(per, "g").withColumn("asks", F.col("label") != F.col("main")), "rest")
    # those outside the largest component meet all, a chunk of them and a tile of all at a time
    at, part = F.pmod(F.xxhash64("fp", "g"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("g", "fp"), F.col("chunks")).cast("int")
    all_tiles, all_chunks = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    asked = rest.where("asks").select("g", all_tiles.alias("tile"), part.alias("other"), "fp", "label", "asks")
    members = rest.select("g", at.alias("tile"), all_chunks.alias("other"), "fp", "label", F.lit(False).alias("asks"))
    rows = asked.unionByName(members).join(sets, "fp")
    keys = ["g", "tile", "other"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    with small_batches(docs.sparkSession):
        across = dealt.mapInArrow(_tile_linker(similarity, radius_for(similarity)), "a long, b long")
        out = save(found.unionByName(across), "links")
    drop(crowd, whole, sets, star, found, label, known, rest)
    return out


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """docs with one row of each component of texts as similar as asked: the smallest doc_id's (see simhash.keep_first).

    Null and blank texts are equal. Null doc_ids take part; repeated rows are copies, of which one stays at most; an
    empty table gives an empty result; all columns stay, whatever their names.
    """
    with small_batches(docs.sparkSession):
        fps = save(prints(docs, shingle, similarity), "prints")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = save(fps.groupBy("fp").agg(F.min(rep).alias("rep"), *[F.min(c).alias(c) for c in ("sims", "lanes", "small")]), "nodes")
    found = links(docs, nodes, similarity, shingle, tile)
    label = save(components(found, "a", "b"), "labels")
    of_fp = nodes.select("fp").join(label, nodes["fp"] == label["node"], "left")
    of_fp = save(of_fp.select("fp", F.coalesce("label", "fp").alias("label")), "classes")
    drop(nodes, found, label)
    return keep_labelled(docs, fps.select("doc_id", "text_hash", "fp"), of_fp)
