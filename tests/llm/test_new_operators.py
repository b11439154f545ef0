"""Token counts, resampling and spelling variants against plain Python, with odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import resample, spelling, token_counts, tokens
from barloom.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} Häuser" for i in range(30_000))
ODD = [
    (900_001, "a b c d e f"), (900_002, None), (900_003, ""), (900_004, " \n\t "), (900_005, LONG), (900_005, LONG), (900_006, "É x <|endoftext|> \x01 é \U0001f600! <|EndOfText|>"),
    (None, "null id here and many other words to make it long enough for a draw of the documents that we have in here today"), (None, None), (900_007, "A<|STARTOFTEXT|>B"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    return spark.createDataFrame([(*r, "k", 5, "w") for r in rows], "doc_id long, text string, rank string, n long, word string")


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


# --- 12 --------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_tokenizers(table):
    tok = plain_tokenizer()
    want = collections.Counter()
    for r in table.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert collections.Counter(map(tuple, token_counts.counts(table, WORD_BPE).collect())) == want
    assert token_counts.counts(table.limit(0), WORD_BPE).count() == 0


def test_long_texts_are_cut_where_counts_add_up():
    tok, rng = plain_tokenizer(), random.Random(4)
    parts = ["a", "Zq", "7", "42", " ", "\n", "é", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "x'll", "...", " ", "\U0001f600", "_", "̸", "日本"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 400))) for _ in range(120)] + ["9" * 500, "ab" * 400, "a1" * 400, " " * 300, "é" * 300]
    want = [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    for most in (7, 50, 10_000):
        assert token_counts.count_tokens(pa.array(texts), WORD_BPE, most, 2 * most).tolist() == want
    for text in texts:
        cuts = [0, *token_counts.safe_cuts(text.encode(), 50), len(text.encode())]
        assert b"".join(text.encode()[a:b] for a, b in zip(cuts, cuts[1:])).decode() == text and cuts == sorted(cuts)
    assert token_counts.count_tokens(pa.array([None, ""], pa.string()), WORD_BPE).tolist() == [0, 0]


def test_special_strings_count_as_they_are_written():
    texts = ["x <|ENDOFTEXT|> y", "<|endoftext|>", "a<|EndOfText|>b THE <|startoftext|>"]
    bounds, ids = tokens.Encoder(WORD_BPE).batch(pa.array(texts), None)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain_tokenizer().encode(t, add_special_tokens=False).ids


# --- 11 --------------------------------------------------------------------------------------------------------------


def drawn_by_hand(rows, targets):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(text):
        ws = word.findall((text or "").translate(LOWER))
        return len(ws), ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]

    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s = collections.Counter(bucket(x) for _, t in rows for x in grams(t)[1])
    t = collections.Counter(bucket(x) for y in targets for x in grams(y)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, xs = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in map(bucket, xs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(xs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = collections.Counter()
    for k, x in enumerate(fit):
        ranks[*x[:4], k + 1 if k < 25 * len(fit) // 100 else None] += 1
    for x in out:
        if x[4] < 20:
            ranks[*x[:4], None] += 1
    return ranks


def test_drawn_documents_equal_plain_python(spark, table):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = drawn_by_hand([(r.doc_id, r.text) for r in table.collect()], [r.text for r in bench.collect()])
    assert collections.Counter(map(tuple, resample.draw(table, bench).collect())) == want
    want = drawn_by_hand([(r.doc_id, r.text) for r in table.collect()], [])
    assert collections.Counter(map(tuple, resample.draw(table, bench.limit(0)).collect())) == want
    assert resample.draw(table.limit(0), bench).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------------


def edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, slip=97, least=5, count=3):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    near = {w: [] for w in n}
    words = sorted(n)
    for x, a in enumerate(words):
        for b in words[x + 1 :]:
            if abs(len(a) - len(b)) <= 1 and edit_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("tile,hot", [(128, 4096), (3, 5)])
def test_variants_equal_all_pairs(spark, table, tile, hot):
    rng = random.Random(tile)
    made = ["".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(3000)] + ["q" * 41, "q" * 42, "q" * 41 + "x", "q" * 20 + "y" + "q" * 20] * 3
    rows = [(i, " ".join(made[i::40])) for i in range(40)] + [(None, "Straße STRASSE straße ×÷× naïve naive"), (900_009, "Straße " * 9)]
    both = table.select("doc_id", "text").limit(40).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    both = spark.createDataFrame([(r.doc_id, r.text, 1) for r in both.collect()], "doc_id long, text string, root int")
    want = variants_by_hand([(r.doc_id, r.text) for r in both.collect()], slip=7)
    got = sorted(map(tuple, spelling.variants(both, slip=7, tile=tile, hot=hot).collect()))
    assert got == want and any(x[1] for x in want)


def test_variants_of_the_table_and_of_none(spark, table):
    want = variants_by_hand([(r.doc_id, r.text) for r in table.collect()])
    assert sorted(map(tuple, spelling.variants(table).collect())) == want
    assert spelling.variants(table.limit(0)).count() == 0


def test_tiles_find_single_edits():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(60)} | {"a" * 70, "a" * 71, "a" * 69 + "b"})
    row, key, m, a = spelling.keyed(pa.array([w.encode("latin-1") for w in words], pa.binary()))
    order = np.lexsort((key, a, m))
    row, key, m, a = row[order], key[order], m[order], a[order]
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (a[1:] != a[:-1]))])
    flat, size = np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    zero = np.zeros(len(row), np.int64)
    for tile in (2, 7, 500):
        x, y = spelling.near_pairs(flat, start[row], size[row], group, m, a, zero, zero > 0, tile)
        got = sorted(tuple(sorted((words[row[i]], words[row[j]]))) for i, j in zip(x, y))
        assert got == sorted((v, w) for i, v in enumerate(words) for w in words[i + 1 :] if edit_apart(v, w))


def test_features_of_slices_equal_those_of_whole_arrays():
    texts = pa.array(["É A a", None, "Ünder THE É-É", "x" * 50, "É É É", "Z é"] * 40)
    whole = resample.features(texts)
    for first, n in ((1, 5), (7, 100), (239, 1)):
        part = resample.features(texts.slice(first, n))
        assert part[0].tolist() == whole[0][first : first + n].tolist()
        for of, bucket in ((1, 2), (3, 4)):
            inside = (whole[of] >= first) & (whole[of] < first + n)
            assert part[of].tolist() == (whole[of][inside] - first).tolist() and part[bucket].tolist() == whole[bucket][inside].tolist()


# --- memory of a task ------------------------------------------------------------------------------------------------


def peak_mb(run, size: int) -> float:
    """Most MB that run() holds at once over 10 MB of text in batches of 500 rows, dealt anew into slices of ``size``."""
    import tracemalloc

    rng = random.Random(5)
    words = [f"w{rng.randrange(1 << 16):x}" for _ in range(40_000)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(2500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 500])], ["text"]) for i in range(0, 2500, 500)]
    for b in batches:  # what is kept for good is not counted
        run(b.column("text"))
    tracemalloc.start()
    for part in tokens.regrouped(batches, "text", size):
        run(part.column("text"))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_a_slice_of_text_takes_little_memory_to_weigh():
    assert peak_mb(resample.features, resample.BATCH_BYTES) < 50


def test_a_slice_of_text_takes_little_memory_to_pack():
    from barloom.llm import packing

    encode = tokens.encoder(WORD_BPE)
    assert peak_mb(lambda texts: encode.batch(texts, 1), packing.SLICE_BYTES) < 60
