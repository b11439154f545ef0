"""Spelling variants: words one edit apart are found by dense tiling, and rarer ones follow their most frequent neighbour.

Counting: tasks split texts into runs of letters and count each run once per document and batch; Spark sums.

Pairs: of two words one edit apart let m be the shorter one's length. The edit falls into one of the gaps of at most two
places that m places are cut into, so both words have the prefix before that gap and the suffix behind it in common. A
word therefore meets others under one key per gap, for m its own length and one less, and no pair is lost. Rows sorted by
key are laid in tiles: padded code-point matrices of two tiles are compared column by column, which gives every pair's
common prefix and suffix; together they reach the longer length minus one if, and only if, a single edit lies between.
A key of more rows than HOT is dealt over tasks as pairs of its parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop, save, small_batches
from barloom.llm.tokens import lowered, regrouped

#: What stands between runs of letters (after lower-casing A-Z).
NOT_LETTERS = "[^a-zÀ-ÿ]+"
CODES = "ISO-8859-1"  # every letter of a run is one byte in it, and bytes sort as code points do
LEAST_LENGTH, LEAST_COUNT, SLIP, TIMES = 5, 3, 97, 2
BATCH_BYTES, TILE, HOT, MOST_GAPS = 4 << 20, 128, 4096, 16
_BASE, _MIX1, _MIX2, _MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def runs(batches, slip: int, least: int):
    """mapInArrow body over doc_id, text: (word, n) for the runs of each batch, with the slips of the pen that ids fix."""
    for part in regrouped(batches, "text", BATCH_BYTES):
        split = pc.split_pattern_regex(lowered(part.column("text")), pattern=NOT_LETTERS)
        coded = pc.list_flatten(split).dictionary_encode()
        words, size = coded.dictionary, max(len(coded.dictionary), 1)
        of = np.repeat(np.arange(part.num_rows), np.diff(split.offsets.to_numpy()))
        keys, n = np.unique(of * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        code, raw = keys % size, [w.encode() for w in words.to_pylist()]
        start = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("doc_id").to_pylist()], np.int64)
        h = np.fromiter(map(zlib.crc32, [raw[i] for i in code.tolist()], start[keys // size].tolist()), np.int64, len(keys))
        hit = h % slip == 0
        total = np.bincount(code[~hit], n[~hit], size).astype(np.int64)[: len(words)]
        some = (total > 0) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least)
        yield pa.RecordBatch.from_arrays([words.filter(pa.array(some)).cast(pa.string()), pa.array(total[some])], ["word", "n"])
        edited: dict[str, int] = {}
        for i, x, k in zip(code[hit].tolist(), h[hit].tolist(), n[hit].tolist()):
            if len(w := raw[i].decode()) > least:
                w = w[: x % len(w)] + w[x % len(w) + 1 :]
                edited[w] = edited.get(w, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(edited.keys(), pa.string()), pa.array(edited.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of letters of all texts, and how often each is there."""

    def run(batches):
        yield from runs(batches, slip, least_length)

    with small_batches(docs.sparkSession):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gap_starts(m: int) -> np.ndarray:
    """Starts of the gaps of a length: of two places each, but at most MOST_GAPS of them."""
    gaps = min(-(-m // 2), MOST_GAPS)
    return np.arange(gaps) * m // gaps


def keyed(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, m, a): for each word and each gap of its length and of one less, the hash of what stands around the gap.

    Prefixes and suffixes are hashed as polynomials, so that a gap costs the same in a word of any length. Equal hashes of
    unequal texts only bring words together that the comparison then keeps apart.
    """
    size = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)) + 1, _BASE)]), dtype=np.uint64)
        ahead = np.concatenate([[np.uint64(0)], np.cumsum(flat * power[np.arange(len(flat)) - np.repeat(start, size)], dtype=np.uint64)])
        out = []
        for m in np.unique(np.concatenate([size, size - 1])):
            if m < 1:
                continue
            a = gap_starts(int(m))
            end = np.append(a[1:], m)
            rows = np.flatnonzero((size == m) | (size == m + 1))
            at, more = start[rows, None], (size[rows] - m)[:, None]
            prefix = ahead[at + a] - ahead[at]
            suffix = (ahead[at + m + more] - ahead[at + end + more]) * np.where(more == 0, _BASE, np.uint64(1))
            key = ((prefix * _MIX1) ^ (prefix >> np.uint64(29))) * _MIX2 ^ (suffix + np.uint64(m)) * _MIX3 ^ (a.astype(np.uint64) + np.uint64(1)) * _MIX1
            key ^= key >> np.uint64(31)
            out.append((np.repeat(rows, len(a)), key.ravel(), np.full(key.size, m), np.tile(a, len(rows))))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row, key, m, a = (np.concatenate(x) for x in zip(*out))
    return row, key.view(np.int64), m, a


def matrix(flat: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool) -> np.ndarray:
    """Codes of words, a column a word, padded with zeros behind (or, read from the back, before) the word."""
    width = int(size.max(initial=0))
    at = np.arange(width)[:, None]
    place = start + size - 1 - at if back else start + at
    return np.where(at < size, flat[np.clip(place, 0, max(len(flat) - 1, 0))], 0).astype(np.uint8)


def common(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the pairs (column of a, column of b) that are alive."""
    out, alive = np.zeros(alive.shape, np.int32), alive.copy()
    for x, y in zip(a, b):
        alive &= (x[:, None] == y[None, :]) & (x != 0)[:, None]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(flat, start, size, group, m, a, part, across, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of words one edit apart in rows sorted by group, each pair under the first of its gaps only.

    Where ``across`` holds, a group has two parts of a hot key, and only pairs of a row of each are asked for.
    """
    n, left, right = len(size), [], []
    last = np.searchsorted(group, group, "right")  # behind a row's group
    gaps = np.minimum(-(-m // 2), MOST_GAPS)
    end = (-(-a * gaps // m) + 1) * m // gaps
    for lo in range(0, n, tile):
        hi = min(lo + tile, n)
        fore, rear = (matrix(flat, start[lo:hi], size[lo:hi], back) for back in (False, True))
        m_, a_, end_ = (x[lo:hi, None] for x in (m, a, end))
        for at in range(lo, int(last[hi - 1]), tile):
            to = min(at + tile, int(last[hi - 1]))
            asked = (group[lo:hi, None] == group[None, at:to]) & (np.arange(lo, hi)[:, None] < np.arange(at, to)[None, :])
            longer = np.maximum(size[lo:hi, None], size[None, at:to])
            asked &= np.minimum(size[lo:hi, None], size[None, at:to]) == m_
            asked &= ~across[lo:hi, None] | (part[lo:hi, None] != part[None, at:to])
            if not asked.any():
                continue
            other = (fore, rear) if at == lo and to == hi else tuple(matrix(flat, start[at:to], size[at:to], back) for back in (False, True))
            prefix, suffix = common(fore, other[0], asked), common(rear, other[1], asked)
            found = asked & (prefix + suffix >= longer - 1) & (prefix >= a_) & (suffix >= m_ - end_)
            # an insertion can fall into several gaps: an earlier one reports it if the suffix reaches to its end
            found &= (a_ == 0) | (a_ + suffix < m_)
            i, j = np.nonzero(found)
            left.append(i + lo)
            right.append(j + at)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


KEYED = "key long, m int, a int, code binary, n long"
PAIR = "code binary, n long, near binary, near_n long"


def _to_keys(batches):
    for batch in batches:
        row, key, m, a = keyed(batch.column("code"))
        for at in range(0, len(row), 50_000):
            of = pa.array(row[at : at + 50_000])
            arrays = [pa.array(key[at : at + 50_000]), pa.array(m[at : at + 50_000].astype(np.int32)), pa.array(a[at : at + 50_000].astype(np.int32)), batch.column("code").take(of), batch.column("n").take(of)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "m", "a", "code", "n"])


def _linker(tile: int):
    """mapInArrow body over rows sorted by (m, a, key, i, j): both directions of every pair."""

    def pairs(rows: pa.Table):
        rows = rows.combine_chunks()
        code, n = rows.column("code").combine_chunks(), rows.column("n").combine_chunks()
        size = pc.binary_length(code).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(code.to_pylist()), np.uint8)
        ids = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("m", "a", "key", "i", "j")])
        group = np.concatenate([[0], np.cumsum((ids[:, 1:] != ids[:, :-1]).any(axis=0))])
        # long words: fewer of them at once, so that a tile's matrices stay small
        some = max(2, min(tile, (4 << 20) // int(size.max(initial=1))))
        x, y = near_pairs(flat, np.cumsum(size) - size, size, group, ids[0], ids[1], rows.column("part").to_numpy(), ids[3] != ids[4], some)
        x, y = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
        return pa.RecordBatch.from_arrays([code.take(x), n.take(x), code.take(y), n.take(y)], ["code", "n", "near", "near_n"])

    def run(batches):
        held, count, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count, size = count + batch.num_rows, size + batch.nbytes
            if count < 20_000 and size < 16 << 20:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(whole.num_rows, bool)
            for c in ("m", "a", "key", "i", "j"):
                at = whole.column(c).to_numpy()
                last &= at == at[-1]
            cut = int(np.argmax(last))  # the last group may go on; those of at most two parts of HOT rows do not for long
            if cut:
                yield pairs(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                count, size = whole.num_rows - cut, 0
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def near_words(words: DataFrame, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """(code, n, near, near_n) for each ordered pair of words one inserted, deleted or replaced code point apart; words (code, n) must be saved."""
    rows = save(words.select("code", "n").mapInArrow(_to_keys, KEYED), "keyed")
    sizes = rows.groupBy("m", "a", "key").agg(F.count("*").alias("in_key"))
    many = save(sizes.where(F.col("in_key") > hot).select("m", "a", "key", F.ceil(F.col("in_key") / hot).cast("int").alias("parts")), "hot")
    keys = ["m", "a", "key"]
    if many.isEmpty():
        dealt = rows.withColumns({"part": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:  # every pair of parts is a group of its own; a row goes to as many as there are parts
        known = rows.join(many, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"), F.lit(0)))
        met = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        met = known.withColumn("met", met).withColumns({"i": F.least("part", "met"), "j": F.greatest("part", "met")})
        dealt = met.drop("met", "parts")
    dealt = dealt.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")
    pairs = save(dealt.mapInArrow(_linker(tile), PAIR), "near")
    drop(rows, many)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """code, root: the last of each word's chain, from (code, form); forms only lead upward in n, so chains end.

    Pointer doubling: a round joins every pointer that can still move to the pointer of its target, so the number of
    rounds grows with the logarithm of the longest chain, which itself is logarithmic in the largest count.
    """
    now = save(forms.select("code", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("code").alias("root"), F.col("root").alias("beyond"))
        both = save(now.join(nxt, "root", "left").select("code", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop(now)
        now = both
        if now.where("moved").isEmpty():
            return now.select("code", "root")


def variants(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters of at least ``least_length`` code points and ``least_count`` occurrences. form is the near
    word of the largest n (ties: smallest in code-point order) if that n is at least ``times`` the word's own; root is
    the end of the forms, the word itself if it has none. Null texts have no words; a null doc_id counts as an empty one;
    repeated rows count each; texts are taken whole, however long, and so are runs; an empty table gives an empty result.
    Only doc_id and text are read, whatever else is there.
    """
    words = word_counts(docs, slip, least_length, least_count).select(F.encode("word", CODES).alias("code"), "n")
    words = save(words, "words")
    near = near_words(words, tile, hot)
    best = F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("form"))).alias("best")
    per = near.groupBy("code").agg(F.count("*").alias("n_near"), best)
    known = words.join(per, "code", "left")
    leads = -F.col("best.down") >= times * F.col("n")
    known = known.select("code", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.down")).alias("form_n"))
    known = save(known, "forms")
    ends = roots(known.where(F.col("form").isNotNull()))
    text = lambda c: F.decode(c, CODES)
    out = known.join(ends, "code", "left")
    out = out.select(text(F.col("code")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "code")).alias("root"), "n", "n_near", "form_n")
    drop(words, near)
    return out
