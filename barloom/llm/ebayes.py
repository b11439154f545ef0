"""Quality classifier with hierarchical empirical Bayes: a text's own evidence, its host's and its path's.

A logistic model over hashed words and a few proportions is fitted on a bounded sample of labelled rows and scores every
text. Hosts and paths gather labels where there are some and the model's probabilities elsewhere, by grouped sums; a
host's rate is shrunk toward the global rate, a path's toward its host's, each with a prior strength found from the
spread of the rates themselves (method of moments for the beta-binomial). The verdict adds the path's log odds over the
global ones to the text's own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop, save, small_batches
from barloom.llm.tokens import regrouped

LABELLED = 8_000  # at most so many labelled rows are fitted: those of the smallest hash of doc_id
#: Rows of hosts and paths are broadcast up to this many (about 200 bytes each); beyond it the join shuffles, in SALTS shares.
BROADCAST_LEVELS, SALTS = 50_000, 32
HASHES, SHAPES = 1 << 17, 10
STARTS = (4, 5, 6, 7)  # characters of a longer word's start that are features of their own
STEPS, RATE, LEAST_Z = 300, 0.1, 5.0
HEADS = ("quality", "toxic")

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_UPPER, _SYMBOLS, _DIGITS = bytes(range(65, 91)), b"#*$%&|<>!@^~=+_", bytes(range(48, 58))


def featurize(texts: pa.Array, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, shapes): each text's distinct hashes of words and word starts, and SHAPES proportions.

    With live (a boolean per hash), other hashes are left out. Null texts count as empty.
    """
    raw = [(x or "").encode("utf-8", "replace") for x in texts.to_pylist()]
    split = pc.ascii_split_whitespace(pa.array([x.translate(_WORD_BYTES) for x in raw], pa.binary()).cast(pa.string()))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(raw)), np.diff(offsets))
    if "" in distinct:
        real = codes != distinct.index("")
        doc, codes = doc[real], codes[real]
    n_words = np.bincount(doc, minlength=len(raw))
    n_distinct = np.bincount(np.unique((doc << 32) + codes) >> 32, minlength=len(raw))
    together = doc[:-1] == doc[1:]
    pairs = np.unique(((doc[:-1] << 44) ^ (codes[:-1] << 22) ^ codes[1:])[together])
    n_pairs = np.bincount(pairs >> 44, minlength=len(raw))
    keys = [np.zeros(0, np.int64)]
    for size in (None, *STARTS):
        h = np.fromiter((zlib.crc32(w[:size].encode()) % HASHES if size is None or len(w) > size else -1 for w in distinct), np.int64, len(distinct))
        of = h[codes]
        some = of >= 0 if live is None else (of >= 0) & live[of]
        keys.append(np.unique(doc[some] * HASHES + of[some]))
    keys = np.unique(np.concatenate(keys))
    bounds = np.searchsorted(keys, np.arange(len(raw) + 1) * HASHES)
    shapes = np.zeros((len(raw), SHAPES), np.float32)
    for i, x in enumerate(raw):
        n, lines, m = max(1, len(x)), [y for y in x.split(b"\n") if y.strip()], max(1, n_words[i])
        shapes[i] = (
            1, np.sqrt((n - len(x.translate(None, _SYMBOLS))) / n), np.sqrt((n - len(x.translate(None, _UPPER))) / n), np.sqrt((n - len(x.translate(None, _DIGITS))) / n),
            1 - len(set(lines)) / max(1, len(lines)), n_distinct[i] / m, max(0, 1 - n_pairs[i] / m), np.log1p(n_words[i]) / 10,
            np.sqrt(x.count(b"|") / m), np.sqrt(x.count(b"!!") / m),
        )
    return bounds, keys % HASHES, shapes


def logits(bounds: np.ndarray, hashes: np.ndarray, shapes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of one log odds per head: the sum of the weights of a text's distinct words and of its proportions."""
    per = np.zeros((len(bounds) - 1, len(HEADS)), np.float32)
    full = np.diff(bounds) > 0
    if full.any():
        per[full] = np.add.reduceat(weights[hashes], bounds[:-1][full], axis=0)
    return np.clip(per + shapes @ weights[HASHES:], -30, 30)


def fit(bounds: np.ndarray, hashes: np.ndarray, shapes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights (HASHES + SHAPES, heads) by AdaGrad on the whole sample; labels are 0 to 1, NaN where unknown.

    The sample comes as featurize() gives it. A word takes part in a head if its rate of labels stands LEAST_Z standard
    errors off the mean rate; proportions are put on one scale while fitting.
    """
    w = np.zeros((HASHES + SHAPES, len(HEADS)), np.float32)
    n_texts = len(bounds) - 1
    if not n_texts:
        return w
    doc = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(bounds))
    known = ~np.isnan(labels)
    y, n = np.where(known, labels, 0), np.maximum(1, known.sum(axis=0))
    mean = y.sum(axis=0) / n
    spread = shapes.std(axis=0) + 1e-3
    scaled = shapes / spread
    used = np.zeros((HASHES, len(HEADS)), bool)
    for k in range(len(HEADS)):
        seen, hit = np.bincount(hashes, known[doc, k], HASHES), np.bincount(hashes, y[doc, k], HASHES)
        z = (hit - seen * mean[k]) / np.sqrt(np.maximum(seen * mean[k] * (1 - mean[k]), 1e-9))
        used[:, k] = (seen >= 3) & (np.abs(z) >= LEAST_Z) & (0 < mean[k] < 1)
    live = used.any(axis=1)
    keep = live[hashes]
    few, of = hashes[keep], doc[keep]
    few_bounds = np.searchsorted(of, np.arange(n_texts + 1))
    g2 = np.full(w.shape, 1e-6, np.float32)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-logits(few_bounds, few, scaled, w)))
        d = np.where(known, p - y, 0) / n
        g = np.concatenate([np.stack([np.bincount(few, d[of, k], HASHES) for k in range(len(HEADS))], axis=1) * used, scaled.T @ d])
        g2 += g * g
        w -= (RATE * g / np.sqrt(g2)).astype(np.float32)
    w[HASHES:] /= spread[:, None]
    return w


def host_and_path(source: Column, otherwise: Column) -> tuple[Column, Column]:
    """Host and first path part of a URL-like source; a source without a path has ``otherwise`` as its second level."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    path = F.regexp_extract(bare, "^[^/]*/([^/?#]*)", 1)
    return F.lower(F.regexp_extract(bare, "^[^/?#]*", 0)), F.when(path != "", path).otherwise(F.coalesce(otherwise, F.lit("")))


def shrink(groups: DataFrame, keys: list[str], head: str, prior: Column) -> DataFrame:
    """Adds <head>_rate: (sum + strength * prior) / (n + strength), and <head>_strength, by moments over the groups (one number).

    groups has n and <head>_sum. The spread of the groups' rates beyond what their sizes explain gives the variance of
    the true rates; the strength is mean * (1 - mean) / variance - 1, from 1 to 10,000.
    """
    rate = F.col(f"{head}_sum") / F.col("n")
    m = groups.withColumn("_prior", prior).agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * (rate - F.col("_prior")) ** 2).alias("between"), F.sum(F.col("n") * F.col("_prior") * (1 - F.col("_prior"))).alias("binomial"),
    ).first()
    strength = 10_000.0
    if m["k"] and m["k"] > 1 and m["binomial"]:
        var = (m["between"] - (m["k"] - 1) * m["binomial"] / m["n"]) / max(1e-9, m["n"] - m["n2"] / m["n"])
        if var > 0:
            strength = float(np.clip(m["binomial"] / m["n"] / var - 1, 1, 10_000))
    rate = (F.col(f"{head}_sum") + strength * prior) / (F.col("n") + strength)
    return groups.withColumns({f"{head}_rate": rate, f"{head}_strength": F.lit(strength)})


def fit_sample(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, int]:
    """(weights, rows fitted) from a bounded sample (doc_id, once each, and one column per head); the tasks make the features.

    Of rows that repeat a doc_id the one of the smallest text hash is fitted, so there are no more rows than doc_ids
    in the sample. The driver gets a few hundred small integers a row, never its text.
    """
    kinds = [pa.list_(pa.int32()), pa.list_(pa.float32()), *[pa.float64()] * len(HEADS)]
    names = ["hashes", "shapes", *HEADS]

    def run(batches):
        for part in regrouped(batches, "text", 4 << 20):
            bounds, hashes, shapes = featurize(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.astype(np.int32)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(shapes) + 1) * SHAPES, pa.int32()), pa.array(shapes.ravel()))
            yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip((flat, rows, *(part.column(h) for h in HEADS)), kinds)], names)

    text = F.coalesce("text", F.lit(""))
    labelled = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(sample), "doc_id")
    one = labelled.groupBy("doc_id").agg(F.min_by("text", "h").alias("text"), *[F.first(h).alias(h) for h in HEADS])
    few = one.select("text", *HEADS)
    with small_batches(docs.sparkSession):
        got = few.mapInArrow(run, "hashes array<int>, shapes array<float>, " + ", ".join(f"{h} double" for h in HEADS)).toArrow()
    if not got.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros((0, SHAPES), np.float32), np.zeros((0, len(HEADS)))), 0
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(got.column("hashes")).to_numpy())])
    hashes = pc.list_flatten(got.column("hashes")).to_numpy()
    shapes = pc.list_flatten(got.column("shapes")).to_numpy().reshape(-1, SHAPES)
    labels = np.stack([got.column(h).to_numpy() for h in HEADS], axis=1).astype(np.float64)
    return fit(bounds, hashes, shapes, labels), got.num_rows


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, host, path, the text's own log odds, path rates, p_quality, p_toxic, kept.

    p adds to a text's own log odds those of its path over the global ones, from the evidence of the other texts of its
    path and host. kept: p_quality is 0.5 or more and p_toxic below 0.5. Null texts are empty; null sources and languages are empty
    names; several labels of a document count as their mean, null labels as none; without labels every probability is
    0.5 and all is kept. Repeated rows are judged each; texts are taken whole, however long; an empty table gives an
    empty result. Only doc_id, text, source and lang are read, whatever else is there.
    """
    known = labels.groupBy("doc_id").agg(*[F.avg(F.col(h).cast("double")).alias(h) for h in HEADS]).where(F.col("doc_id").isNotNull())
    sample = save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "sample")
    weights, fitted = fit_sample(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    host, path = host_and_path(F.col("source"), F.col("lang"))
    schema = "doc_id long, host string, path string, quality_logit double, toxic_logit double"

    def run(batches):
        live = (shared.value[:HASHES] != 0).any(axis=1)
        for part in regrouped(batches, "text", 4 << 20):
            found = logits(*featurize(part.column("text"), live), shared.value).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "path")), *(pa.array(found[:, k]) for k in range(len(HEADS)))], ["doc_id", "host", "path", "quality_logit", "toxic_logit"])

    with small_batches(docs.sparkSession):
        scored = save(docs.select(F.col("doc_id").cast("long"), host.alias("host"), path.alias("path"), "text").mapInArrow(run, schema), "scored")
    soft = {h: 1 / (1 + F.exp(-F.col(f"{h}_logit"))) for h in HEADS}
    own = [F.coalesce(h, soft[h]).alias(h) for h in HEADS]
    evidence = scored.join(known, "doc_id", "left")
    evidence = save(evidence.select("doc_id", "host", "path", *[f"{h}_logit" for h in HEADS], *own), "evidence")
    paths = save(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(h).alias(f"{h}_sum") for h in HEADS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"{h}_sum").alias(f"{h}_sum") for h in HEADS])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(f"{h}_sum").alias(h) for h in HEADS]).first()
    world = {h: min(max((total[h] or 0) / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5 for h in HEADS}
    for h in HEADS:
        hosts = shrink(hosts, ["host"], h, F.lit(world[h]))
    parts = [F.col(f"{h}_{x}").alias(f"host_{h}_{x}") for h in HEADS for x in ("sum", "strength")]
    hosts = save(hosts.select("host", F.col("n").alias("host_n"), *parts, *[F.col(f"{h}_rate").alias(f"host_{h}") for h in HEADS]), "hosts")
    levels = paths.join(hosts, "host")
    for h in HEADS:
        levels = shrink(levels, ["host", "path"], h, F.col(f"host_{h}"))
    kept = [f"{lvl}{h}_{x}" for lvl in ("", "host_") for h in HEADS for x in ("sum", "strength")]
    paths_of = levels.select("host", "path", "n", "host_n", *kept, *[f"host_{h}" for h in HEADS], *[F.col(f"{h}_rate").alias(f"path_{h}") for h in HEADS])
    levels = save(paths_of, "levels")
    if levels.count() <= BROADCAST_LEVELS:
        out = evidence.join(F.broadcast(levels), ["host", "path"])
    else:  # a site of many texts is dealt over tasks
        salt = F.pmod(F.xxhash64("doc_id", "quality_logit"), F.lit(SALTS)).cast("int")
        copies = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = evidence.withColumn("salt", salt).join(copies, ["host", "path", "salt"]).drop("salt")
    for h in HEADS:
        # what the others of the host and of the path say: a text's own evidence is counted once, as its own
        of_host = F.col(f"host_{h}_sum") - F.col(h) + F.col(f"host_{h}_strength") * F.lit(world[h])
        of_host = of_host / (F.col("host_n") - 1 + F.col(f"host_{h}_strength"))
        others = F.col(f"{h}_sum") - F.col(h) + F.col(f"{h}_strength") * of_host
        rate = F.greatest(F.least(others / (F.col("n") - 1 + F.col(f"{h}_strength")), F.lit(1 - 1e-6)), F.lit(1e-6))
        odds = F.log(rate / (1 - rate)) - float(np.log(world[h] / (1 - world[h])))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"{h}_logit") + odds))))
    out = out.withColumn("kept", (F.col("p_quality") >= 0.5) & ((F.col("p_toxic") < 0.5) | (F.lit(not fitted))))
    drop(sample, scored, paths, hosts)
    return out.select("doc_id", "host", "path", "quality_logit", "toxic_logit", *[f"{lvl}_{h}" for lvl in ("host", "path") for h in HEADS], "p_quality", "p_toxic", "kept")
