"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

DataFrame functions only. Windows: moving a window to the left loses a shared shingle only at its right end, so of all
windows of the best similarity the first ends with a shingle of an item of its word count, or is the document's first.
Windows are laid at these places, in whatever order an item's parts stand, if enough of their shingles are such; no
other window can reach the similarity.

Elements: a shingle with the number of its earlier occurrences in the window. Sets of elements have as similarity the
weighted one of their shingles (the sum of the lesser counts over that of the greater), so the 64-bit SimHash is made of
elements, and what holds for sets holds for repeated shingles, too.

Index: windows of equal words are one. Two fingerprints within the radius agree in one at least of radius + 1 blocks of
bits; the radius follows from the least similarity (shared.radius_for: 28 bits at 0.8) so that all pairs that the last
step can accept are within it, but for one in 1e8. Blocks of two or three bits select nothing alone, so they are keys
within (word count, rare element): of an item's n elements a window as similar as asked has all but n - ceil(0.8 n), so
it has one at least of any n - ceil(0.8 n) + 1 of them, and those that the fewest items have are taken. A join on (word
count, rare element, block, its bits) meets every such pair; the first block they agree in reports it, and the Hamming
distance decides.

Verification: candidates are compared exactly, by the number of their common elements, through a join on the element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import NOT_ALNUM, drop, free_names, radius_for, save

#: Tables of the benchmark are broadcast up to this many rows (about 30 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
SALTS = 32  # shares of a hot key where a join shuffles
_NO_ID = -(1 << 63)


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, -1), lambda w: w != "")


def shingle_hashes(words: str, shingle: int) -> Column:
    """64-bit hashes of all runs of ``shingle`` words of an array column, in order; empty if there are fewer words."""
    tail = F.slice(F.col(words), F.lit(shingle), F.greatest(F.size(words) - (shingle - 1), F.lit(0)))
    return F.transform(tail, lambda w, i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle - 1)], w))


def simhash(hashes: str) -> Column:
    """Bit i is set if it is in over half the hashes of an array column, each as often as it is there."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 AS INT))"
    bit = f"IF(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (a, b) -> a | {bit})")


def elements(hashes: str) -> Column:
    """Hashes of an array column, each with the number of its earlier occurrences there: a set of 64-bit hashes.

    Only an array that repeats a hash is searched for its places: equal hashes stand together once it is sorted.
    """
    plain = F.transform(F.col(hashes), lambda h: F.xxhash64(h, F.lit(0)))
    first = f"transform(array_sort({hashes}), (h, i) -> xxhash64(h, cast(i + 1 - array_position(array_sort({hashes}), h) AS INT)))"
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(F.expr(first))


def block_masks(radius: int) -> list[int]:
    """radius + 1 disjoint ranges of the 64 bits, as signed masks."""
    cut = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cut, cut[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(windows: DataFrame, items: DataFrame, radius: int, within: list[str]) -> DataFrame:
    """Pairs of rows of equal ``within`` columns whose fp differ in at most radius bits, each once: all columns of both.

    windows and items have these columns, fp and columns of their own names. A hot key is dealt over SALTS tasks unless
    the items are few enough to be broadcast.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    each = F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("block", "bits")
    left, right = windows.select("*", each), items.select("*", each).withColumnRenamed("fp", "fp2")
    keys = [*within, "block", "bits"]
    if items.count() * (radius + 1) <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        left = left.withColumn("salt", F.pmod(F.xxhash64("fp", "block"), F.lit(SALTS)).cast("int"))
        right, keys = right.withColumn("salt", salt), [*keys, "salt"]
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    earlier = F.exists(F.slice(masks, F.lit(1), F.col("block")), lambda m: apart.bitwiseAND(m) == 0)
    both = left.join(right, keys).where((F.bit_count(apart) <= radius) & ~earlier)
    return both.drop("salt", "block", "bits", "fp", "fp2")


def rare_elements(items: DataFrame, similarity: float) -> DataFrame:
    """w, item_id, fp, e: of each item's n elements the n - ceil(similarity * n) + 1 that the fewest items of its word count have."""
    each = items.select("w", "item_id", "fp", F.size("el").alias("n"), F.explode("el").alias("e"))
    often = each.groupBy("w", "e").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("w", "item_id").orderBy("often", "e"))  # an item's elements
    ranked = each.join(often, ["w", "e"]).withColumn("place", place)
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).select("w", "item_id", "fp", "e")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"), "text")


def _with_marks(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Shingles of documents that some item has, once per word count of such items."""
    if marks.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(marks), ["h", "k"])
    salted = found.withColumn("salt", F.pmod(F.xxhash64("_id", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "k", "salt"]).drop("salt")


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """One row per document and benchmark text it holds: doc_id, item_id, n_items, similarity, first_word, n_words.

    Items of equal words are one text: item_id is the smallest, n_items their number. similarity is the best window's:
    shared over all shingles, counted with their repeats; first_word is that window's start (the first of equals), words
    from 0; n_words the item's words. A document shorter than the item is one window. An item of fewer than ``shingle``
    words is one shingle, so it is found where all its words stand in a row; one without words matches nothing.
    Null texts have no words; equal rows of docs give one result; a null doc_id stays null; texts are taken whole,
    however long. Empty tables give an empty result; only doc_id, text and item_id, text are read, whatever else is there.
    """
    radius = radius_for(similarity) if radius is None else radius
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    items = items.withColumns({"w": F.size("words"), "k": F.least(F.size("words"), F.lit(shingle))})
    by_k = [r["k"] for r in items.select("k").distinct().collect()] or [shingle]  # at most ``shingle`` numbers
    some = [items.where(F.col("k") == k).withColumn("sh", shingle_hashes("words", k)) for k in sorted(by_k)]
    items = reduce(DataFrame.unionByName, some).withColumn("el", elements("sh"))
    items = save(items.select("item_id", "n_items", "w", "k", "sh", "el", simhash("el").alias("fp")), "items")
    marks = save(items.select("w", "k", F.explode("sh").alias("h")).distinct(), "marks")
    keyed = _keyed(docs).withColumn("words", alnum_words(F.col("text")))
    placed = [
        keyed.select("_id", "_h", F.lit(k).alias("k"), F.posexplode(shingle_hashes("words", k)).alias("pos", "h")) for k in sorted(by_k)
    ]
    hits = _with_marks(reduce(DataFrame.unionByName, placed), marks)
    hits = hits.groupBy("_id", "_h", "w", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # so many places of a window must be hits, as a window and an item together have w - k + 1 shingles at least
    need = F.greatest(F.ceil(F.lit(similarity) * (F.col("w") - F.col("k") + 1) - 1e-6), F.lit(1)).cast("int")
    start = lambda p: F.greatest(p - (F.col("w") - F.col("k")), F.lit(0))  # noqa: E731  the window whose last shingle is at p
    starts = F.transform(F.filter("at", lambda p, i: F.get("at", i - need + 1) >= start(p)), start)
    spots = save(hits.select("_id", "_h", "w", "k", F.explode(F.array_distinct(starts)).alias("start")), "spots")
    # only documents with such a window are read again
    again = _keyed(docs).join(spots.select("_id", "_h").distinct(), ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    cut = F.slice(alnum_words(F.col("text")), F.col("start") + 1, F.col("w"))
    windows = again.join(spots, ["_id", "_h"]).withColumn("words", cut)
    windows = reduce(DataFrame.unionByName, [windows.where(F.col("k") == k).withColumn("sh", shingle_hashes("words", k)) for k in sorted(by_k)])
    # 128 bits name a window's content: equal windows, of whatever documents, are looked up once
    name = {"c1": F.xxhash64("sh"), "c2": F.xxhash64(F.lit(1), "sh")}
    windows = save(windows.select("doc_id", "_id", "_h", "w", "start", "sh", *[x.alias(c) for c, x in name.items()]), "windows")
    content = ["w", "c1", "c2"]
    contents = windows.select(*content, "sh").dropDuplicates(content).withColumn("el", elements("sh")).drop("sh")
    contents = save(contents.withColumn("fp", simhash("el")), "contents")
    rare = save(rare_elements(items, similarity), "rare")
    named = rare.select("w", "e").distinct()
    asked = contents.select(*content, "fp", F.explode("el").alias("e"))
    asked = asked.join(F.broadcast(named) if rare.count() <= BROADCAST_ROWS else named, ["w", "e"], "left_semi")
    pairs = within_radius(asked, rare, radius, ["w", "e"]).select(*content, "item_id").distinct()  # by any of their rare elements
    pairs = save(pairs, "candidates")
    in_items = save(items.select("item_id", "w", F.explode("el").alias("e")), "in_items")
    few = in_items.count() <= BROADCAST_ROWS
    met = pairs.join(contents.select(*content, F.explode("el").alias("e")), content)
    met = met.join(F.broadcast(in_items) if few else in_items, ["item_id", "w", "e"])
    shared = met.groupBy(*content, "item_id").agg(F.count("*").alias("shared"))
    sized = shared.join(contents.select(*content, F.size("el").alias("in_window")), content)
    sized = sized.join(items.select("item_id", "n_items", F.size("el").alias("in_item")), "item_id")
    alike = F.col("shared") / (F.col("in_window") + F.col("in_item") - F.col("shared"))
    kept = save(sized.withColumn("similarity", alike).where(F.col("similarity") >= similarity).select(*content, "item_id", "n_items", "similarity"), "kept")
    found = windows.select("doc_id", "_id", "_h", "start", *content).join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, content)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    out = found.groupBy("doc_id", "_id", "_h", "item_id", "n_items", "w").agg(best)
    leaks = out.select(
        "doc_id", "item_id", "n_items", F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("first_word"), F.col("w").alias("n_words"), "_id", "_h",
    )
    leaks = save(leaks, "leaks")
    drop(items, marks, rare, in_items, spots, windows, contents, pairs, kept)
    return leaks


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark text (see find_leaks); every other row and column stays as it is."""
    a, b = free_names(docs, "leak_id", "leak_hash")
    hit = find_leaks(docs, benchmark, **options).select(F.col("_id").alias(a), F.col("_h").alias(b)).distinct()
    id_, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), F.coalesce(docs["text"], F.lit(""))
    return docs.join(hit, (id_ == F.col(a)) & (F.xxhash64(text) == F.col(b)), "left_anti")
