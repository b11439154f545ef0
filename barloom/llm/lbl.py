"""Log-bilinear language model trained with noise-contrastive estimation in numpy; counts and scores over all texts.

Counts. Texts are cut into chunks of bounded size; a chunk keeps its distinct words once, its tokens as places in that
list. Word counts are summed over chunks by a shuffle, and come back to each chunk by a join on the word (of the TOP
words by a broadcast), so the whole vocabulary is never held anywhere.

Model. Symbols are the TOP most frequent words, the end mark, and BUCKETS shares of all rarer words by their first two
letters; in a share, a word has its part of the counts, add one. Every symbol has a vector for each of the two places
before a token (R1, R2). h = R1[w1] + R2[w2] scores units (GROUP words of neighbouring ranks, the end, a share) and
then the words of the unit: log p = log softmax(Q h + b)[unit] + log softmax(q h + c)[word in its unit] (Mnih and
Hinton, 2007 and 2009). Both softmaxes are normalised exactly, by matrix products over batches of tokens.

Training. Noise-contrastive estimation (Mnih and Teh, 2012) at both levels, from units by their frequency and words of
a unit alike. In each of ROUNDS rounds every task trains on its own part of that round's texts, from the parameters of
the round before; then Spark averages each vector over the tasks, weighted by how often a task used it. All training
texts are learnt from once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop, save, small_batches
from barloom.llm.tokens import lowered, regrouped, text_slices

GROUP, UNITS_OF_WORDS, BUCKETS = 128, 128, 64
TOP = GROUP * UNITS_OF_WORDS
SYMBOLS, END = TOP + 1 + BUCKETS, TOP
UNITS = UNITS_OF_WORDS + 1 + BUCKETS
DIM, NOISE, IN_UNIT, BATCH, RATE, ROUNDS, SEED = 16, 32, 4, 8192, 0.1, 3, 11
CHUNK_BYTES = 10 << 20

CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, words array<string>, counts array<long>"
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def chunks_of(docs: DataFrame) -> DataFrame:
    """Rows of about CHUNK_BYTES of text: documents, distinct words, tokens as places in them, counts in training texts."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for part in regrouped(batches, "text", CHUNK_BYTES):
            held = part.column("held").to_numpy(zero_copy_only=False)
            split = pc.ascii_split_whitespace(lowered(part.column("text")))
            words, offsets = split.flatten(), split.offsets.to_numpy()
            offsets = offsets - offsets[0]
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(real)])[offsets]
            coded = words.filter(pa.array(real)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
            lengths = np.diff(bounds)
            counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(coded.dictionary))
            cols = [(task << 24) + k, part.column("doc_id").to_pylist(), held.tolist(), lengths.tolist(), codes.tobytes()]
            arrays = [pa.array([x], t) for x, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()))]
            whole = pa.array([0, len(counts)], pa.int32())
            arrays.append(pa.ListArray.from_arrays(whole, coded.dictionary.cast(pa.string())))
            arrays.append(pa.ListArray.from_arrays(whole, pa.array(counts.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CHUNKS.split(", ")])
            k += 1

    few = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held"))
    return few.mapInArrow(run, CHUNKS)


def _bucket(word: str) -> Column:
    return (TOP + 1 + F.crc32(F.substring(word, 1, 2).cast("binary")) % BUCKETS).cast("int")


@dataclass
class Counts:
    """Totals of the training texts, by symbol; all bounded by the number of symbols."""

    tokens: int
    distinct: int
    ends: int
    by_class: np.ndarray  # tokens of each symbol
    mass: np.ndarray  # sum of count + 1 over the words of each symbol


def code_texts(docs: DataFrame) -> tuple[DataFrame, Counts, int]:
    """Saved table (CODED) of every row's counts, base score, part within shares, and symbols; the totals; how many words have a symbol of their own."""
    with small_batches(docs.sparkSession):
        chunks = save(chunks_of(docs), "chunks")
    pairs = chunks.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))).where("n > 0")
    sums = save(pairs.groupBy("word").agg(F.sum("n").alias("c")), "sums")
    ranked = sums.orderBy(F.desc("c"), "word").limit(TOP).collect()  # TOP rows at most
    top = F.broadcast(docs.sparkSession.createDataFrame([(r["word"], r["c"], i) for i, r in enumerate(ranked)], "word string, c long, class int"))
    rare = save(sums.join(top, "word", "left_anti").select("word", "c", _bucket("word").alias("class")), "rare")
    by_class, mass = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    distinct = 0
    for r in rare.unionByName(top).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # SYMBOLS rows at most
        by_class[r["class"]], mass[r["class"]], distinct = r["c"], r["c"] + r["n"], distinct + r["n"]
    ends = chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    by_class[END] = ends
    totals = Counts(int(by_class.sum()), distinct + (ends > 0), ends, by_class, mass)
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    # a frequent word is in every chunk: those are looked up where they stand, only the rarer ones are shuffled
    few = asked.join(top, "word", "left_anti").join(rare, "word", "left")
    few = few.select("chunk", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", _bucket("word")).alias("class"))
    found = few.unionByName(asked.join(top, "word").select("chunk", "at", "c", "class"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        c, cls = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        c[at], cls[at] = right.column("c").to_numpy(), right.column("class").to_numpy()
        base = np.log10((c + 1) / (totals.tokens + totals.distinct + 1))
        within = np.where(cls > END, np.log10((c + 1) / (totals.mass[cls] + 1)), 0.0)
        end_base = np.log10((totals.ends + 1) / (totals.tokens + totals.distinct + 1))
        codes = np.frombuffer(left.column("codes")[0].as_py(), "<i4")
        lengths = np.array(left.column("lengths")[0].as_py(), np.int64)
        ends_at = np.cumsum(lengths)

        def per_text(values: np.ndarray) -> np.ndarray:
            run_sum = np.concatenate([[0], np.cumsum(values)])
            return run_sum[ends_at] - run_sum[ends_at - lengths]

        classes = cls[codes].astype("<u2")
        return pa.Table.from_arrays(
            [
                pa.array(left.column("doc_ids")[0].as_py(), pa.int64()), pa.array(left.column("held")[0].as_py(), pa.bool_()), pa.array(lengths + 1),
                pa.array(per_text((c > 0)[codes].astype(np.int64)) + (totals.ends > 0)), pa.array(_summed(base[codes], ends_at, lengths) + end_base), pa.array(_summed(within[codes], ends_at, lengths)),
                pa.array([classes[b - n : b].tobytes() for b, n in zip(ends_at.tolist(), lengths.tolist())], pa.binary()),
            ],
            [x.split()[0] for x in CODED.split(", ")],
        )

    body = chunks.select(F.col("chunk").alias("of"), "doc_ids", "held", "lengths", "codes")
    coded = save(body.groupBy("of").cogroup(found.groupBy("chunk")).applyInArrow(run, CODED), "coded")
    drop(chunks, sums, rare)
    return coded, totals, len(ranked)


def _summed(values: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of each text's values, each from its own values alone (no difference of long running sums)."""
    out = np.zeros(len(ends))
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (ends - lengths)[some])
    return out


UNIT_OF = np.concatenate([np.arange(TOP) // GROUP, np.arange(UNITS_OF_WORDS, UNITS)]).astype(np.int64)
#: Parameters by kind: rows of DIM numbers and a bias. Those of contexts have no bias.
ROWS_OF = {"r1": SYMBOLS, "r2": SYMBOLS, "q": UNITS, "words": TOP}


@dataclass
class Model:
    """r1, r2 (contexts), q (units), words: arrays of ROWS_OF rows; the last column is the bias. live: words that exist."""

    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    words: np.ndarray
    live: np.ndarray
    unit_p: np.ndarray
    sizes: np.ndarray = field(init=False)  # words that exist, by unit

    def __post_init__(self):
        self.sizes = self.live.reshape(UNITS_OF_WORDS, GROUP).sum(axis=1)

    @staticmethod
    def start(by_class: np.ndarray, n_words: int) -> Model:
        """Random vectors, and biases that give each symbol its share of the counts."""
        rng = np.random.default_rng(SEED)
        params = {k: (rng.standard_normal((n, DIM + 1)) * 0.1).astype(np.float32) for k, n in ROWS_OF.items()}
        live = np.arange(TOP) < n_words
        mass = by_class + 0.5
        mass[:TOP][~live] = 0
        per_unit = np.bincount(UNIT_OF, mass, UNITS)
        with np.errstate(divide="ignore"):
            params["q"][:, DIM] = np.maximum(np.log(per_unit / per_unit.sum()), -1e9)
            params["words"][:, DIM] = np.maximum(np.log(mass[:TOP] / np.maximum(per_unit[UNIT_OF[:TOP]], 0.5)), -1e9)
        return Model(**params, live=live, unit_p=per_unit / per_unit.sum())

    def copy(self) -> Model:
        return Model(*(getattr(self, k).copy() for k in ROWS_OF), live=self.live, unit_p=self.unit_p)

    def log_probs(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, block: int = 2048) -> np.ndarray:
        """Natural log probabilities of symbols after two symbols, normalised over all symbols."""
        out = np.empty(len(w))
        h = self.r1[w1, :DIM] + self.r2[w2, :DIM]
        unit = UNIT_OF[w]
        self._level(out, h, np.arange(len(w)), unit, self.q, block)
        inside = np.flatnonzero(w < TOP)
        order = inside[np.argsort(unit[inside].astype(np.uint16), kind="stable")]
        cut = np.searchsorted(unit[order], np.arange(UNITS_OF_WORDS + 1))
        more = np.zeros(len(w))
        for u in np.flatnonzero(np.diff(cut)):
            at = order[cut[u] : cut[u + 1]]
            self._level(more, h, at, w[at].astype(np.int64) - u * GROUP, self.words[u * GROUP : (u + 1) * GROUP], block)
        return out + more

    @staticmethod
    def _level(out: np.ndarray, h: np.ndarray, at: np.ndarray, choice: np.ndarray, rows: np.ndarray, block: int) -> None:
        """out[at]: log softmax of rows at the choice; a batched matrix product makes all scores of a block of tokens."""
        vectors, bias = np.ascontiguousarray(rows[:, :DIM].T), rows[:, DIM]
        ones = np.ones(len(rows), np.float32)
        for a in range(0, len(at), block):
            some = at[a : a + block]
            scores = h[some] @ vectors
            scores += bias
            np.minimum(scores, 80, out=scores)  # exp stays finite
            chosen = scores[np.arange(len(some)), choice[a : a + block]].astype(np.float64)
            np.exp(scores, out=scores)
            out[some] = chosen - np.log((scores @ ones).astype(np.float64))


class Trainer:
    """Noise-contrastive estimation by AdaGrad on batches of (w1, w2, w); the noise units of a batch are shared by its tokens."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.m, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.steps = np.cumsum(model.unit_p)
        with np.errstate(divide="ignore"):
            self.log_kp = np.maximum(np.log(NOISE * model.unit_p), -1e9).astype(np.float32)
            self.log_kw = np.log(np.maximum(IN_UNIT / np.maximum(model.sizes, 1), 1e-9)).astype(np.float32)
        self.g2 = {k: np.full((n, DIM + 1), 1e-8, np.float32) for k, n in ROWS_OF.items()}
        self.used = {k: np.zeros(n, np.int64) for k, n in ROWS_OF.items()}

    def _apply(self, kind: str, rows: np.ndarray, grad: np.ndarray, n: int) -> None:
        """One step for the sums of the gradients of equal rows (uint16)."""
        order = np.argsort(rows, kind="stable")
        keys = rows[order]
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        g = np.add.reduceat(grad[order], first, axis=0) / np.float32(n)
        at = keys[first]
        width = g.shape[1]
        self.used[kind][at] += np.diff(np.append(first, len(keys)))
        g2 = self.g2[kind]
        g2[at, :width] += g * g
        getattr(self.m, kind)[at, :width] += self.rate * g / np.sqrt(g2[at, :width])

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        m, n, sigmoid = self.m, len(w), lambda x: 1 / (1 + np.exp(-x))
        h = np.empty((n, DIM + 1), np.float32)
        h[:, :DIM] = m.r1[w1, :DIM] + m.r2[w2, :DIM]
        h[:, DIM] = 1  # of the bias
        unit = UNIT_OF[w]
        noise = np.minimum(np.searchsorted(self.steps, self.rng.random(NOISE)), UNITS - 1)
        q, qn = m.q[unit], m.q[noise]
        up = 1 - sigmoid(np.einsum("ij,ij->i", h, q) - self.log_kp[unit])  # 1 - P(data)
        down = -sigmoid(h @ qn.T - self.log_kp[noise])  # - P(data) of the noise
        dh = up[:, None] * q + down @ qn
        rows, grads = np.concatenate([unit, noise]).astype(np.uint16), np.concatenate([up[:, None] * h, down.T @ h])
        inside = np.flatnonzero(w < TOP)
        if len(inside):
            hi, u = h[inside], unit[inside]
            other = u[:, None] * GROUP + (self.rng.random((len(inside), IN_UNIT), np.float32) * m.sizes[u][:, None]).astype(np.int64)
            t, v = m.words[w[inside]], m.words[other]
            up2 = 1 - sigmoid(np.einsum("ij,ij->i", hi, t) - self.log_kw[u])
            down2 = -sigmoid(np.einsum("ij,ikj->ik", hi, v) - self.log_kw[u][:, None])
            dh[inside] += up2[:, None] * t + np.einsum("ik,ikj->ij", down2, v)
            each = np.concatenate([w[inside], other.ravel()]).astype(np.uint16)
            push = np.concatenate([up2[:, None] * hi, (down2[:, :, None] * hi[:, None, :]).reshape(-1, DIM + 1)])
            self._apply("words", each, push, n)
        self._apply("q", rows, grads, n)
        self._apply("r1", w1.astype(np.uint16), dh[:, :DIM], n)
        self._apply("r2", w2.astype(np.uint16), dh[:, :DIM], n)


def contexts(classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, w1, w2, w) of a batch of texts: symbols and the end mark, after two end marks as a start."""
    raw = [np.frombuffer(x, "<u2") for x in classes.to_pylist()]
    n = np.array([len(x) + 1 for x in raw], np.int64)
    end = np.array([END], np.uint16)
    padded = np.concatenate([y for x in raw for y in (end, end, x, end)]) if raw else np.zeros(0, np.uint16)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) + np.repeat(2 * np.arange(1, len(n) + 1), n)
    return bounds, padded[at - 2], padded[at - 1], padded[at]


def train(coded: DataFrame, totals: Counts, n_words: int, rounds: int = ROUNDS) -> Model:
    """Rounds over parts of the training texts, each text once; tasks' vectors are averaged by Spark after each round.

    A task returns the vectors it used, so what is summed has as many rows as the model times the tasks.
    """
    model = Model.start(totals.by_class, n_words)
    spark = coded.sparkSession
    names = [f"x{i}" for i in range(DIM + 1)]
    schema = "kind string, row int, n long, " + ", ".join(f"{x} float" for x in names)
    for k in range(rounds):
        sent, rate = spark.sparkContext.broadcast(model), RATE / (k + 1)

        def run(batches, sent=sent, rate=rate, k=k):
            trainer = Trainer(sent.value.copy(), rate, SEED + 1000 * k + TaskContext.get().partitionId())
            for batch in batches:
                for first, n in text_slices(batch.column("classes"), 4 << 20):
                    _, w1, w2, w = contexts(batch.column("classes").slice(first, n))
                    order = trainer.rng.permutation(len(w))
                    for a in range(0, len(w), BATCH):
                        some = order[a : a + BATCH]
                        trainer.step(w1[some], w2[some], w[some])
            for kind in ROWS_OF:
                at = np.flatnonzero(trainer.used[kind])
                if len(at):
                    x = getattr(trainer.m, kind)[at]
                    cols = [pa.array([kind] * len(at)), pa.array(at.astype(np.int32)), pa.array(trainer.used[kind][at])]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x[:, i]) for i in range(DIM + 1))], ["kind", "row", "n", *names])

        part = coded.where("NOT held_out").where(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(rounds)) == k)
        rows = part.select("classes").mapInArrow(run, schema)
        mean = rows.groupBy("kind", "row").agg(*[(F.sum(F.col("n") * F.col(x).cast("double")) / F.sum("n")).alias(x) for x in names])
        got = mean.toArrow()  # a row for each vector of the model at most
        model = model.copy()
        kinds, at = np.array(got.column("kind").to_pylist(), object), got.column("row").to_numpy()
        x = np.stack([got.column(c).to_numpy() for c in names], axis=1).astype(np.float32)
        for kind in ROWS_OF:
            some = kinds == kind
            getattr(model, kind)[at[some]] = x[some]
        sent.destroy()
    return model


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null text is one end mark; a null id counts as empty text for the split; repeated rows are scored (and learnt from)
    each; with no training text the base score is 0 a token and all units are equally likely. Texts are taken whole, however
    long; an empty table gives an empty result. Only doc_id and text are read, whatever else is there.
    """
    coded, totals, n_words = code_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(coded, totals, n_words))
    out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, n in text_slices(batch.column("classes"), 1 << 20):
                part = batch.slice(first, n)
                bounds, w1, w2, w = contexts(part.column("classes"))
                total = np.add.reduceat(model.log_probs(w1, w2, w) / np.log(10), bounds[:-1]) + part.column("within").to_numpy()
                kept = [part.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(n, totals.tokens)), part.column("base_score"), pa.array(total)], out)

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
