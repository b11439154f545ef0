"""Corpus operators against plain Python, with nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from barloom.llm import cascade, decontam, ebayes, lbl, licenses, near, packing, quotes, rans, secret_scan, shared, simhash, tokens
from barloom.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, start long, kept boolean"
OWN = 100_000  # ids of odd rows start here
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (6, "É x <|endoftext|> \x01 é \U0001f600!"),
    (None, "null id here"), (7, "same text of some words here"), (8, "same text of some words here"), (8, "same text of some words here"), (9, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i and OWN + i, t, None, None, None, "x", 1, None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_ids(text, end):
    from tokenizers import Tokenizer

    global _TOK
    if "_TOK" not in globals():
        _TOK = Tokenizer.from_file(WORD_BPE)
    return [*_TOK.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens, 2 and 9 -------------------------------------------------------------------------------------------------


def test_chunkwise_ids_equal_the_tokenizers(docs):
    import pyarrow as pa

    texts = [t for _, t in ODD] + [r.text for r in docs.limit(60).collect()] + ["don't it's WE'RE x.y,z a. b, c!? ... 3.14 'S", "İstanbul ΣΑΣ ß"]
    bounds, ids = tokens.Encoder(WORD_BPE, cache_chunks=50).batch(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain_ids(t, 2), t


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_token_files_hold_every_text_in_order(spark, request, tmp_path, source):
    table = request.getfixturevalue(source)
    rans.write_tokens(table, str(tmp_path / "t"), WORD_BPE, segment_tokens=5_000)
    got = rans.read_tokens(spark, str(tmp_path / "t")).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in table.select("doc_id", "text").collect()))
    start, expected = 0, []
    for known, doc_id, _, text in want:
        ids = plain_ids(text, 2)
        expected.append((doc_id if known else None, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda x: x[1]) == expected


def test_an_empty_table_gives_an_empty_file_set(spark, docs, tmp_path):
    rans.write_tokens(docs.limit(0), str(tmp_path / "t"), WORD_BPE)
    assert rans.read_tokens(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 70_000, 300_001])
def test_blocks_decode_from_any_checkpoint(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 49_000
    symbols, freqs, blocks = rans.encode_segment(ids.astype(np.uint32))
    reader, size, span = rans.SegmentReader(symbols, freqs), rans.LANES * rans.BLOCK_STEPS, rans.LANES * rans.CHECKPOINT_STEPS
    for i, b in enumerate(blocks):
        for k in range(len(b["at"])):
            assert (reader.block(b, k) == ids[i * size : (i + 1) * size][k * span :]).all()
    broken = {**blocks[0], "words": blocks[0]["words"][:-2] + b"zz"} if len(blocks[0]["words"]) > 1 else {**blocks[0], "ids_crc32": [0]}
    with pytest.raises(ValueError):
        reader.block(broken)


@pytest.mark.parametrize("freqs", [[1, 65535], [65536], [3, 7, 65526], [1] * 65536])
def test_steps_equal_whole_number_arithmetic(freqs):
    rng, freqs = np.random.default_rng(len(freqs)), np.array(freqs, "<u4")
    starts = np.cumsum(freqs) - freqs
    index = rng.integers(0, len(freqs), 4 * rans.LANES)
    words, states, _ = rans.encode_block(index, freqs, starts)
    x, out = [1 << 16] * rans.LANES, []
    for step in index.reshape(-1, rans.LANES)[::-1]:
        here = []
        for lane, i in enumerate(step.tolist()):
            f = int(freqs[i])
            if x[lane] >= f << 16:
                here.append(x[lane] & 0xFFFF)
                x[lane] >>= 16
            x[lane] = (x[lane] // f << 16) + x[lane] % f + int(starts[i])
        out = here + out
    assert words == np.array(out, "<u2").tobytes() and states == np.array(x, "<u4").tobytes()
    read = rans.SegmentReader(np.arange(len(freqs), dtype="<u4").tobytes(), freqs.tobytes())
    got = rans.decode_steps(np.frombuffer(words, "<u2"), 0, np.array(x, "<u4"), 4, read.slot, read.share, read.within)
    assert (got == index).all()


def test_best_fit_decreasing_equals_one_by_one():
    import bisect

    for seed in range(150):
        rng = random.Random(seed)
        cap = rng.choice([7, 64, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 200))]
        open_: list[int] = []
        for x in sorted(lengths, reverse=True):
            i = bisect.bisect_left(open_, x)
            bisect.insort(open_, (open_.pop(i) if i < len(open_) else cap) - x)
        assert packing.best_fit_decreasing(collections.Counter(lengths), cap).sequences == len(open_)


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_packing_places_every_piece_once(request, source):
    table = request.getfixturevalue(source)
    got = packing.pack_documents(table, WORD_BPE, 1, 512).collect()
    want = collections.Counter()
    for r in table.select("doc_id", "text").collect():
        ids = plain_ids(r.text, 1)
        for p in range(-(-len(ids) // 512)):
            want[r.doc_id, p, p * 512, len(ids[p * 512 : p * 512 + 512]), crc(ids[p * 512 : p * 512 + 512])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) <= 1.1 * sum(r.length for r in got) / 512 + 1
    assert packing.pack_documents(table.limit(0), WORD_BPE).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words][: len(words)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles if s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_near_duplicates_equal_all_pairs(request, source):
    table = request.getfixturevalue(source)
    rows = table.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    of = plain_components(fps)
    least = {c: min((r.doc_id for r, o in zip(rows, of) if o == c and r.doc_id is not None), default=None) for c in of}
    want = collections.Counter((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, of))
    assert collections.Counter(map(tuple, simhash.near_duplicates(table).collect())) == want
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns and kept.count() == len(set(of))
    assert simhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [8, 64])
def test_crowded_keys_lose_no_link(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for _ in range(400):
        x = int(base[rng.integers(6)])
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = shared.save(spark.createDataFrame([(f,) for f in signed], "fp long"), "t")
    label = {r.node: r.label for r in shared.components(simhash.links(nodes, 4, tile=tile), "a", "b").collect()}
    of = plain_components(fps)
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for s, c in zip(signed, of):
        want[c].add(s)
        got[label.get(s, s)].add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


# --- 3 ---------------------------------------------------------------------------------------------------------------


def leaks_by_hand(rows, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    found = {}
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in items:
            v = words(item)
            if len(v) < 5:
                continue
            at = collections.defaultdict(list)
            for p in range(len(v) - 4):
                at[tuple(v[p : p + 5])].append(p)
            starts = {min(max(i - p, 0), max(len(w) - len(v), 0)) for i in range(len(w) - 4) for p in at.get(tuple(w[i : i + 5]), ())}
            for s in starts:
                x, y = shingles(w[s : s + len(v)]), shingles(v)
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= 0.8:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), (0, 0)), (sim, -s))
    return found


def test_leaks_equal_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    text = items[3][1].split()
    extra = [(900, " ".join(["lead", "in", *text, "tail"])), (901, " ".join(text[:-1] + ["changed"])), (902, " ".join(text[: len(text) // 3])), (903, None), (904, ""), (None, items[4][1].upper()), (905, items[5][1]), (905, items[5][1])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = leaks_by_hand([(r.doc_id, r.text) for r in table.collect()], items)
    got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in decontam.find_leaks(table, bench).collect()}
    assert got == want and (900, 3) in got and (None, 4) in got and not {902, 903, 904} & {d for d, _ in got}
    kept = {r.doc_id for r in decontam.without_leaks(table, bench).collect()}
    assert kept == {r.doc_id for r in table.collect()} - {d for d, _ in want}


def test_leaks_of_odd_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, "too few"), (3, "same text of some words here"), (4, "Same text, of some words here!"), (5, "Null id"), (6, "w975 w976 w0")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_items, r.similarity, r.first_word) for r in decontam.find_leaks(odd, bench).collect()}
    assert got == {(OWN + 7, 3, 2, 1.0, 0), (OWN + 8, 3, 2, 1.0, 0), (None, 5, 1, 1.0, 0), (OWN + 5, 6, 1, 1.0, 975)}
    assert decontam.find_leaks(odd.limit(0), bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).count() == 0


def best_windows(rows, items):
    """As leaks_by_hand, over every start."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    found = {}
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in items:
            v, y = words(item), shingles(words(item))
            for s in range(max(len(w) - len(v), 0) + 1):
                x = shingles(w[s : s + len(v)])
                sim = sum((x & y).values()) / max(sum((x | y).values()), 1)
                if y and sim >= 0.8:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), (0, 0)), (sim, -s))
    return found


def test_leaks_stand_in_any_order(spark):
    rng = random.Random(5)
    item = [f"i{k}" for k in range(50)]
    loop = [f"r{k % 6}" for k in range(30)]
    items = [(1, " ".join(item)), (2, " ".join(loop)), (3, "five words and no more"), (4, " ".join(item[:49] + ["else"]))]
    lead, tail = ([f"{c}{k}" for k in range(40)] for c in "lt")
    rows = [(1, lead + item[25:] + item[:25] + tail), (2, lead + item[17:34] + item[:17] + item[34:] + tail), (3, item[10:] + item[:10]), (4, lead + loop[4:] + loop[:10] + tail), (5, lead + item[1:] + tail), (6, item[:46])]
    for i in range(40):
        cut, skip = rng.randrange(50), rng.randrange(8)
        rows.append((10 + i, lead[: rng.randrange(40)] + item[cut:] + item[: max(cut - skip, 0)] + tail[: rng.randrange(40)]))
    rows = [(i, " ".join(w)) for i, w in rows]
    want = best_windows(rows, items)
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in decontam.find_leaks(table, bench).collect()}
    assert got == want and got[1, 1] == (0.84, -40)
    assert decontam.without_leaks(table.where("doc_id = 1"), bench).count() == 0


def test_no_leak_at_the_least_similarity_is_lost(spark):
    rows, items = [], []
    for i in range(600):
        words = [f"q{i}x{k}" for k in range(49)]  # 45 shingles, of which a word five from the end changes five: 40 / 50
        items.append((i, " ".join(words)))
        rows.append((i, " ".join([f"lead{i}", *words[:-5], "changed", *words[-4:], "tail"])))
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(table, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(i, i, 0.8) for i in range(600)]


@pytest.mark.parametrize("few", [True, False])
def test_blocks_meet_all_fingerprints_within_the_radius(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    rng = random.Random(7)
    items = [(rng.choice([20, 30]), i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    windows = [(w, i, fp ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(14)))) for w, i, fp in items] + [(rng.choice([20, 30]), 100 + i, rng.getrandbits(64) - (1 << 63)) for i in range(60)]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    a = spark.createDataFrame(windows, "w int, window int, fp long")
    b = spark.createDataFrame(items, "w int, item int, fp long")
    for radius in (4, 28):
        want = sorted((i, j) for w, i, x in windows for v, j, y in items if v == w and apart(x, y) <= radius)
        assert sorted((r.window, r.item) for r in decontam.within_radius(a, b, radius, ["w"]).collect()) == want and want


def test_leaks_with_a_word_repeated_are_found(spark):
    """A repeated shingle costs little similarity, however often it is there: all are found, as by brute force."""
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))) for i in range(40)]
    rows = [(i, " ".join([*t.split()[:1360], *["the"] * 140])) for i, t in items]
    rows += [(100 + i, " ".join([*["the"] * 140, *t.split()[140:], "tail"])) for i, t in items[:5]]
    few = [(50 + i, " ".join(["go on"] * (10 + i) + [f"x{i}y{k}" for k in range(30)])) for i in range(8)]  # items that repeat, too
    rows += [(200 + i, " ".join(["lead", *t.split()[4:], "end"])) for i, t in few] + [(300 + i, " ".join(t.split()[: 20 + i])) for i, t in few]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + few, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(table, bench).collect()}
    by_hand = {k: v[0] for k, v in best_windows([r for r in rows if r[0] >= 200], few).items()}
    assert {k: v for k, v in got.items() if k[0] >= 200} == by_hand and by_hand
    assert {k for k in got if k[0] < 200} == {(i, i) for i in range(40)} | {(100 + i, i) for i in range(5)}
    assert min(got[i, i] for i in range(40)) < 0.84


def test_few_pairs_are_joined(spark):
    """Windows and items that share no rare shingle do not meet, whatever their fingerprints."""
    rng = random.Random(13)
    items = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(30))) for i in range(300)]
    table = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    plain = decontam.within_radius
    met = []

    def counted(*a):
        met.append((out := plain(*a)).count())
        return out

    decontam.within_radius, keep = counted, plain
    try:
        got = decontam.find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).count()
    finally:
        decontam.within_radius = keep
    assert got == 300 and met[0] <= 300 * 7 < 0.1 * 300 * 300  # a row for each rare element of a pair


def test_simhash_of_shingles(spark):
    rng = random.Random(8)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40)] + [[]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lists], "sh array<long>").select(decontam.simhash("sh")).collect()]
    plain = lambda x: sum((2 * sum((h >> b) & 1 for h in x) > len(x)) << b for b in range(64))
    assert [g & (2**64 - 1) for g in got] == [plain(x) for x in lists]


# --- 4 ---------------------------------------------------------------------------------------------------------------

SECRETS = [
    'token = "abcdef123" and deadbeef' + "0" * 20, "AKIA" + "A1" * 9 + " nearby secret: short1", "token:token:abcdef", "token=token=abcdef API-KEY: zzzzzz", "Api_Key='qwerty' é password : x",
    "user: alice\nmixed Zz0" + "aB3" * 12, "see https://api.example.org/v1 only", "user: bob", "AKIASHORT AKIA" + "B" * 15, "x" * 5000 + " passwd=" + "y" * 9 + " " + "z" * 5000, "", None,
]


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_plain_matching(spark, docs, odd):
    made = spark.createDataFrame(list(enumerate(SECRETS, 5000)), "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(made).union(made)
    texts = {(r.doc_id): r.text for r in table.collect()}
    got = secret_scan.scan(table).collect()
    assert len(got) == table.count()
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_weak_parts_count_only_together(spark):
    made = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in secret_scan.scan(made).collect()}
    assert kinds[5] == {"account", "mixed"} and not kinds[6] and not kinds[7]
    masked = {r.doc_id: r.text for r in secret_scan.redact(made).collect()}
    assert "abcdef123" not in masked[0] and masked[7] == "user: bob" and masked[11] is None
    assert secret_scan.scan(made.limit(0)).count() == 0


def test_masked_rows_keep_their_columns(spark):
    rows = [(i, t, 7, "keep", "x", "y", len(t or "")) for i, t in enumerate([*SECRETS, SECRETS[0], "password: " + "z" * 50_000 + "q"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id int, _h string, _text string, _row string, n_chars long")
    got = secret_scan.redact(d)
    assert got.columns == d.columns and got.where("_id = 7 AND _h = 'keep' AND _text = 'x' AND _row = 'y'").count() == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in got.collect()) and secret_scan.redact(d.limit(0)).count() == 0


def test_an_endpoint_may_have_a_long_scheme(spark):
    text = "password: abcdef1 " + "s" * 40 + "://host/path and 9ab://x/y " + "w" * 200_000
    spans = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans.split(",")
    assert [s.split(":")[0] for s in spans] == ["assign", "endpoint", "endpoint"]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_language_model(spark, docs, odd):
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r.doc_id, [*WORD.findall((r.text or "").translate(lower)), None]) for r in table.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter(w for i, ws in texts for w in ws if not held(i))
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(list)
    for i, ws in texts:
        want[i].append((held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)))
    got = lbl.score(table).collect()
    assert len(got) == len(texts)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4]) for w in want[r.doc_id])
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 1.02  # no worse than word counts
    assert lbl.score(table.limit(0)).count() == 0


def test_probabilities_add_up_and_training_learns():
    rng = np.random.default_rng(0)
    n_words = 300  # three units, the last one partly filled
    w2 = rng.integers(0, n_words, 200_000).astype(np.uint16)
    w = ((w2.astype(int) * 7 + rng.integers(0, 2, len(w2))) % n_words).astype(np.uint16)
    w[::50] = lbl.END
    by_class = np.bincount(w, minlength=lbl.SYMBOLS).astype(float)
    start = lbl.Model.start(by_class, n_words)
    t = lbl.Trainer(start.copy(), 0.1, 1)
    for _ in range(3):
        for a in range(0, len(w), 2048):
            t.step(w2[a : a + 2048], w2[a : a + 2048], w[a : a + 2048])
    every = np.array([x for x in range(lbl.SYMBOLS) if x < n_words or x >= lbl.END], np.uint16)
    for m in (start, t.m):
        for a, b in ((3, 5), (299, lbl.END), (lbl.END + 4, 128)):
            p = m.log_probs(np.full(len(every), a), np.full(len(every), b), every)
            assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)
            # by hand: exp of each score over the sum of all, unit by unit
            h = m.r1[a, : lbl.DIM].astype(float) + m.r2[b, : lbl.DIM]
            units = m.q[:, : lbl.DIM] @ h + m.q[:, lbl.DIM]
            words = m.words[:, : lbl.DIM] @ h + m.words[:, lbl.DIM]
            for i, x in enumerate(every.tolist()):
                u = lbl.UNIT_OF[x]
                want = units[u] - np.log(np.exp(units).sum())
                if x < lbl.TOP:
                    want += words[x] - np.log(np.exp(words[u * lbl.GROUP : (u + 1) * lbl.GROUP]).sum())
                assert p[i] == pytest.approx(want, abs=2e-3)
    before, after = (m.log_probs(w2, w2, w).mean() for m in (start, t.m))
    assert after > before + 1.5  # the best is 5.0 above


def test_scores_hold_under_another_partitioning(spark, docs):
    few = docs.select("doc_id", "text")
    a, b = ({r.doc_id: (r.base_score, r.score, r.n_tokens) for r in lbl.score(few.repartition(n, "doc_id")).collect()} for n in (1, 3))
    assert all(a[i][0] == pytest.approx(b[i][0]) for i in a)
    tokens = sum(x[2] for x in a.values())
    assert abs(sum(x[1] for x in a.values()) - sum(x[1] for x in b.values())) / tokens < 0.05  # log10 a token
    assert sum(x[1] for x in b.values()) > sum(x[0] for x in b.values())


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_license_places_equal_plain_search(spark, docs, odd):
    made = spark.createDataFrame([(7001, "Under the MIT license; under the mit LICENSE under the Apache License, Version 2.0"), (7002, "SPDX-License-Identifier: (MIT OR GPL-3.0) AND Apache-2.0\nrest"), (7003, "cc by-nc cc-by nc")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(made)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = licenses.scan(table).collect()
    assert len(got) == table.count()
    for r in got:
        low = (texts[r.doc_id] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[7002].labels == "apache-2.0,gpl-3.0,mit" and by_id[7002].score == 1.0


def test_license_expressions():
    eased = licenses.parse("MIT OR Apache-2.0 AND GPL-2.0+ WITH Classpath-exception-2.0 */")
    assert eased == ["mit", "apache-2.0", "gpl-2.0+", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.parse("MIT, Apache-2.0") == ["mit"] and licenses.parse("see the file") == [] and licenses.parse("MIT; OR ISC") == ["mit"]
    assert licenses.parse("LicenseRef-own AND MIT WITH MIT") == ["licenseref-own", "mit", "and"]
    assert licenses.parse("(MIT") == [] and licenses.parse("MIT OR") == ["mit"] and licenses.parse("") == []
    assert licenses.evaluate(licenses.parse("(MIT OR GPL-3.0) AND CC-BY-NC-4.0"))[0] == 0.2


def test_operands_that_no_table_lists():
    value = lambda text: licenses.evaluate(licenses.parse(text))
    assert value("MIT AND MS-PL") == (0.8, {"mit", "ms-pl"}) and value("MIT AND Foo-1.0") == (0.5, {"mit", "unknown"})
    assert value("(MIT OR Foo) AND GPL-3.0-only") == (0.4, {"mit", "unknown", "gpl-3.0-only"}) and value("Foo-2 OR MIT") == (1.0, {"unknown", "mit"})
    assert value("CC-BY-SA-2.5") == (0.6, {"cc-by-sa-2.5"}) and value("CC-BY-NC-SA-3.0-DE or agpl-9") == (0.3, {"cc-by-nc-sa-3.0-de", "agpl-9"})
    assert value("GPL-2.0 WITH Some-exception-1.0")[0] == pytest.approx(0.6) and value("GPL-2.0 WITH Some-note")[0] == 0.4
    assert licenses.parse("MIT and the rest") == ["mit"] and licenses.parse("MIT and Ownership") == ["mit"] and licenses.parse("MIT.") == ["mit"]
    assert licenses.parse("MIT. AND GPL-2.0") == ["mit"] and licenses.parse("Foo") == [] and licenses.parse("Foo", True) == ["unknown"]
    row = licenses.scan_text("x\n# SPDX-License-Identifier: Foo\n// License: Bar-1.1 AND MIT")
    assert row[5:8] == ("mit,unknown", 0.5, "unknown;unknown mit and")
    assert licenses.scan_text("license: see the file")[5:7] == ("", 0.0) and licenses.scan_text("All rights reserved")[5:7] == ("proprietary", 0.0)


IDENTIFIERS = """
    0bsd afl-2.1 agpl-3.0-or-later apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause-clear bsd-4-clause-uc bsl-1.0 busl-1.1 cc-by-4.0 cc-by-nc-nd-4.0 cc-by-sa-3.0
    cc0-1.0 cddl-1.1 cecill-2.1 epl-2.0 eupl-1.2 gfdl-1.3-no-invariants-only gpl-2.0-only isc lgpl-2.1-or-later mit mit-0 mpl-2.0-no-copyleft-exception ms-rl
    odbl-1.0 ofl-1.1-rfn osl-3.0 postgresql psf-2.0 sspl-1.0 unicode-dfs-2016 wtfpl x11 zlib licenseref-mine
""".split()


class Descent:
    """Recursive descent over the same grammar: or of and of terms; a term is a license, one with an exception, or in brackets."""

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def level(self, word, lower, pick):
        value, names = lower()
        while self.peek() == word:
            self.take()
            v, n = lower()
            value, names = pick(value, v), names | n
        return value, names

    def either(self):
        return self.level("or", self.both, max)

    def both(self):
        return self.level("and", self.term, min)

    def term(self):
        if self.peek() == "(":
            self.take()
            found = self.either()
            self.take()
            return found
        name = self.take()
        value = licenses.freedom(name)
        if self.peek() == "with":
            self.take(), self.take()
            value = min(1.0, value + licenses.EXCEPTION_GAIN)
        return value, {name}


def test_expressions_equal_recursive_descent():
    rng = random.Random(4)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            name = [rng.choice(IDENTIFIERS) + rng.choice(["", "", "+"]) if rng.random() < 0.9 else "unknown"]
            return name + (["with", rng.choice(licenses.EXCEPTIONS)] if rng.random() < 0.2 else [])
        if kind < 0.5:
            return ["(", *made(depth - 1), ")"]
        return [*made(depth - 1), rng.choice(["and", "or"]), *made(depth - 1)]

    for _ in range(500):
        tokens = made(4)
        written = [rng.choice(["Foo-1.0", "my-own", "bar9+"]) if x == "unknown" else x for x in tokens]
        text = " ".join(x.upper() if rng.random() < 0.5 else x for x in written).replace("( ", "(").replace(" )", ")")
        assert licenses.evaluate(licenses.parse(text)) == Descent(tokens).either(), text
        row = licenses.scan_text(f"# SPDX-License-Identifier: {text} -->\nmore")
        value, names = Descent(tokens).either()
        more = set(row[5].split(",")) - names  # phrases that an expression happens to hold, such as bsd-3-clause
        assert names <= set(row[5].split(",")) and row[6] == min([value, *map(licenses.freedom, more)])


def test_labels_equal_plain_search():
    rng = random.Random(6)
    table = {**licenses.MORE_PHRASES, **licenses.BASE_PHRASES}
    for _ in range(300):
        parts = [rng.choice([*table, "plain", "license", "the gnu", "under"]) for _ in range(6)]
        text = rng.choice([" ", ", ", "\n* "]).join(parts).title()
        words = re.findall("[0-9a-z]+", text.lower())
        want = {label for phrase, label in table.items() if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
        row = licenses.scan_text(text)
        assert set(filter(None, row[5].split(","))) == want
        assert row[6] == min((licenses.freedom(x) for x in want), default=0.0)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def posteriors_by_hand(rows, labels):
    """{row number: (p_quality, p_toxic)} from each row's host, path and log odds, by plain loops."""
    known = collections.defaultdict(list)
    for r in labels:
        known[r.doc_id].append(r)
    odds, out = (lambda p: math.log(p / (1 - p))), collections.defaultdict(dict)
    for h in ("quality", "toxic"):
        mean = {i: [float(r[h]) for r in some if r[h] is not None] for i, some in known.items() if i is not None}
        own = [sum(mean[r.doc_id]) / len(mean[r.doc_id]) if mean.get(r.doc_id) else 1 / (1 + math.exp(-r[f"{h}_logit"])) for r in rows]
        world = min(max(sum(own) / len(own), 1e-6), 1 - 1e-6)

        def shrunk(groups, prior):  # {key: evidence}, {key: prior}
            n = {k: len(v) for k, v in groups.items()}
            total, n2 = sum(n.values()), sum(x * x for x in n.values())
            between = sum(n[k] * (sum(v) / n[k] - prior[k]) ** 2 for k, v in groups.items())
            binomial = sum(n[k] * prior[k] * (1 - prior[k]) for k in groups)
            strength = 10_000.0
            if len(n) > 1 and binomial:
                var = (between - (len(n) - 1) * binomial / total) / max(1e-9, total - n2 / total)
                strength = min(max(binomial / total / var - 1, 1), 10_000) if var > 0 else strength
            return strength, {k: (sum(v) + strength * prior[k]) / (n[k] + strength) for k, v in groups.items()}

        hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
        for r, e in zip(rows, own):
            hosts[r.host].append(e)
            paths[r.host, r.path].append(e)
        host_strength, host = shrunk(hosts, dict.fromkeys(hosts, world))
        strength, _ = shrunk(paths, {k: host[k[0]] for k in paths})
        for i, (r, e) in enumerate(zip(rows, own)):
            v, all_of_host = paths[r.host, r.path], hosts[r.host]
            of_host = (sum(all_of_host) - e + host_strength * world) / (len(all_of_host) - 1 + host_strength)
            rate = min(max((sum(v) - e + strength * of_host) / (len(v) - 1 + strength), 1e-6), 1 - 1e-6)
            out[i][h] = 1 / (1 + math.exp(-(r[f"{h}_logit"] + odds(rate) - odds(world))))
    return out


@pytest.mark.parametrize("source", ["docs", "odd"])
def test_posteriors_equal_plain_loops(spark, request, source):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    if source == "odd":
        labels = spark.createDataFrame([(OWN + 1, 1, 0), (OWN + 1, 0, 0), (OWN + 2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = ebayes.classify(request.getfixturevalue(source), labels).collect()
    want = posteriors_by_hand(rows, labels.collect())
    for i, r in enumerate(rows):
        assert (r.p_quality, r.p_toxic) == pytest.approx((want[i]["quality"], want[i]["toxic"]), rel=1e-6)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = ebayes.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_repeated_rows_of_a_label_are_fitted_once(spark, docs):
    rows = spark.createDataFrame([(1, f"some words of text {i} are here") for i in range(300)] + [(2, "another text"), (2, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, None)], "doc_id long, quality double, toxic double")
    assert ebayes.fit_sample(rows, sample)[1] == 2
    many = docs.unionByName(docs.limit(3))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.quality_logit for r in ebayes.classify(docs, labels).collect()}
    assert {r.doc_id: r.quality_logit for r in ebayes.classify(many, labels).collect()} == got  # copies move no weight


def test_many_sites_are_joined_in_shares(spark, docs, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = sorted(ebayes.classify(docs, labels).collect())
    monkeypatch.setattr(ebayes, "BROADCAST_LEVELS", 0)
    assert sorted(ebayes.classify(docs, labels).collect()) == want


def test_classifier_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(OWN + 1, 1, 0), (OWN + 1, 0, 0), (OWN + 2, None, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = ebayes.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.p_quality <= 1 for r in got)
    assert ebayes.classify(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert ebayes.classify(odd.limit(0), labels).count() == 0


def test_sparse_hosts_shrink_toward_the_world(spark):
    g = spark.createDataFrame([("big", 1000, 900.0), ("mid", 500, 100.0), ("one", 1, 1.0)], "host string, n long, quality_sum double")
    rate = {r.host: r.quality_rate for r in ebayes.shrink(g, ["host"], "quality", F.lit(0.667)).collect()}
    assert abs(rate["big"] - 0.9) < 0.02 and 0.667 < rate["one"] < 0.95


# --- 10 --------------------------------------------------------------------------------------------------------------


def plain_features(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("source", ["odd", "docs"])
def test_quality_features_equal_plain_python(request, source):
    table = request.getfixturevalue(source)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = cascade.quality(table).collect()
    assert len(got) == table.count()
    for r in got:
        want = plain_features(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert cascade.quality(table.limit(0)).count() == 0


def test_quality_equals_its_sql(spark):
    import duckdb

    from barloom.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = c.execute(queries.oracle_sql()["op10_quality_cascade"])
    columns = [d[0] for d in found.description]
    got = queries.queries()["op10_quality_cascade"](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_passing_rows_keep_their_columns(spark, docs):
    odd_names = docs.withColumns({"kept": F.lit("x"), "_words": F.lit(1), "at": F.lit(2), "row": F.lit(3), "n_words": F.lit(None).cast("int")})
    got = cascade.passing(odd_names)
    assert got.columns == odd_names.columns and got.where("kept = 'x' AND at = 2 AND row = 3 AND n_words IS NULL").count() == sum(r.kept for r in cascade.quality(docs).select("kept").collect())


def test_the_order_of_rules_changes_no_verdict(spark, docs):
    rules = [*cascade.base_rules(), *cascade.default_rules()]
    text, words = F.coalesce("text", F.lit("")), shared.words_of(F.col("text"))
    verdict = lambda some: docs.select("doc_id", cascade.let(words, lambda w: cascade.cascade(text, w, some)).alias("k"))
    a = verdict(rules)
    assert a.exceptAll(verdict(rules[::-1])).count() == 0
    assert a.exceptAll(cascade.quality(docs).select("doc_id", "kept")).count() == 0


def test_rules_go_by_rejections_per_cost(spark):
    texts = ["# " * 60] * 30 + ["plain words " * 400] * 70
    slow = cascade.Rule("slow", lambda text, words: cascade.n_symbols(text) + cascade.n_repeat_words(words) * 0 > 20)
    cheap, never = cascade.Rule("cheap", lambda text, words: F.length(text) < 200), cascade.Rule("never", lambda text, words: F.size(words) < 0)
    found = cascade.order_rules(spark, texts, [never, slow, cheap])
    assert [r.name for r, _, _ in found] == ["cheap", "slow", "never"] and [round(x, 6) for _, x, _ in found] == [0.3, 0.3, 0.0]
    assert [r.name for r, _, _ in cascade.order_rules(spark, [], [never, slow])] == ["never", "slow"]


def test_the_sample_is_bounded(spark, odd):
    assert len(cascade.sample_of(odd, 3)) == 3 and max(map(len, cascade.sample_of(odd, 100, 50))) <= 50


def test_a_rejected_text_is_spared_later_rules(spark):
    table = spark.createDataFrame([("short",), ("word " * 60,)], "text string")
    fails = cascade.Rule("fails", lambda text, words: F.when(F.size(words) < 50, F.raise_error(F.lit("asked"))).otherwise(F.lit(False)))
    both = [cascade.base_rules()[0], fails]
    assert table.where(cascade.let(shared.words_of(F.col("text")), lambda w: cascade.cascade(F.col("text"), w, both))).count() == 1


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?\n\nSecond para."), (1, 1, "a", "On Mon, X wrote:\n> Hello there.\n> How are you?\n\nfine"),
        (1, 2, "u", ">> Hello there.\n>> How are you?\n> fine\nok"), (1, 4, "u", "new topic"), (1, 3, "u", "> Second   PARA.\nyes"),
        (2, 0, "u", "> fine"), (None, None, None, None), (3, 0, "u", ""), (3, 0, "u", ""),
    ]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(d).collect()}
    assert quotes.link_quotes(d).count() == len(rows)
    assert got[1, 1].parent_turn == 0 and got[1, 1].body.strip() == "fine" and got[1, 1].depth == 1
    assert got[1, 2].parent_turn == 1 and got[1, 2].root_turn == 0 and got[1, 2].depth == 2 and got[1, 2].n_linked == 2
    assert got[1, 3].parent_turn == 0 and got[1, 4].root_turn == 4
    assert [t for _, t in sorted((got[1, t].position, t) for t in range(5))] == [0, 1, 2, 3, 4]
    assert got[2, 0].body == "" and got[2, 0].n_linked == 0  # one word is too few for another conversation
    assert quotes.link_quotes(d.limit(0)).count() == 0


def conversations_by_hand(rows):
    """{row number: (position, root turn, depth, parent (conversation, turn), n_linked)} by plain loops over parsed messages."""
    parsed = [quotes.parse(r[3]) for r in rows]
    up, linked, away = {}, {}, {}
    for i, (conv, turn, _, _) in enumerate(rows):
        found = []
        for q, (level, asked) in enumerate(parsed[i][2]):
            best = []
            for unit, (kind, n, h) in enumerate(asked):
                has = [(rows[j][0], rows[j][1], j) for j in range(len(rows)) if h in parsed[j][1]]
                inside = [x for x in has if x[0] == conv and x[1] < turn]
                if inside:
                    best.append((0, kind, unit, min(inside)))
                if n >= quotes.FEWEST and has:
                    ends = [x for x in (min(has), max((c, *min((t, j) for d, t, j in has if d == c)) for c, _, _ in has)) if x[0] != conv]
                    if ends:
                        best.append((1, kind, unit, ends[0]))
            if best:
                b = min(best)
                found.append((b[0], level, q, b[3]))
        if found:
            b = min(found)
            linked[i] = (len(found), b[3])
            (up if b[0] == 0 else away)[i] = b[3][2]
    kids = collections.defaultdict(list)
    for i, p in up.items():
        kids[p].append(i)
    out, per = {}, collections.defaultdict(list)
    for i, r in enumerate(rows):
        if i not in up:
            per[r[0]].append((r[1], i))
    for conv, roots in per.items():
        at = 0
        # trees of two or more and single messages alike go by the root's turn, then by the message
        for turn, root in sorted(roots):
            stack = [(root, 0)]
            while stack:
                i, depth = stack.pop()
                out[i] = (at, turn, depth, linked[i][1][:2] if i in linked else (None, None), linked[i][0] if i in linked else 0)
                at += 1
                stack += [(k, depth + 1) for k in sorted(kids[i], key=lambda k: (rows[k][1], k), reverse=True)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 14))).capitalize() + rng.choice(".!?")
    rows = []
    for conv in range(4):
        said = []
        for turn in range(18):
            own = "\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
            text = own
            past = said if rng.random() < 0.8 else [t for _, _, _, t in rows]
            if past and rng.random() < 0.7:
                other = rng.choice(past).split(" ")
                cut = sorted(rng.sample(range(len(other) + 1), 2)) if rng.random() < 0.6 else [0, len(other)]
                width = rng.choice([5, 12, 10**6])
                piece = " ".join(other[cut[0] : cut[1]]).split("\n")
                lines = [" ".join(x.split(" ")[i : i + width]) for x in piece for i in range(0, max(len(x.split(" ")), 1), width)]
                text = rng.choice(["", "On Mon, 3 May,\nX <x@example.org> wrote:\n"]) + "\n".join("> " + x for x in lines) + "\n\n" + own
            said.append(text)
            rows.append((conv, turn // 2 if conv == 3 else turn, "u", text))
    rows += [rows[5], rows[40], (1, 30, "a", "> nothing known here at all, never said"), (1, 31, "a", "")]
    want = conversations_by_hand(rows)
    table = spark.createDataFrame([(*r, f"{r[0]}-{i}") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, msg string").coalesce(1)
    got = collections.Counter((r.conv_id, r.turn, r.position, r.root_turn, r.depth, (r.parent_conv_id, r.parent_turn), r.n_linked) for r in quotes.link_quotes(table).collect())
    assert got == collections.Counter((rows[i][0], rows[i][1], *x) for i, x in want.items())
    assert sum(x[2] > 1 for x in want.values()) > 5 and sum(x[3][0] not in (None, rows[i][0]) for i, x in want.items()) > 0


def test_an_introduction_may_be_long_and_wrapped():
    intro = "On Monday, " + "x" * 500 + ",\nSomebody\n<a@example.org> wrote:"
    body, own, found = quotes.parse(f"Text.\n\n{intro}\n> quoted words")
    assert body == "Text." and len(found) == 1
    assert quotes.parse("On the whole\nno.\n> quoted words")[0] == "On the whole\nno."


def test_a_quote_of_fifteen_words_finds_its_original(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(1, 0, "u", " ".join(words)), (1, 1, "u", "> " + "\n> ".join([" ".join(words[61:66]), " ".join(words[66:76])])), (1, 2, "u", "> " + " ".join(f"v{i % 5}" for i in range(5)))]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].parent_turn == 0 and got[2].parent_turn is None


def test_conversations_keep_every_message(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    got = quotes.link_quotes(c)
    assert got.count() == c.count()
    assert got.groupBy("conv_id").agg((F.max("position") + 1).alias("a"), F.count("*").alias("b")).where("a <> b").count() == 0


# --- near-duplicates of the pipeline ---------------------------------------------------------------------------------


def similarity_by_hand(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def test_the_pipeline_drops_near_copies_from_similarity_08(spark):
    import corpus_pipeline

    rng, rows, gone = random.Random(3), [], set()
    for n_words, edits in [(100, 1), (100, 2), (300, 2), (300, 6), (300, 5), (1000, 3), (1000, 20), (60, 1), (300, 8), (300, 12), (100, 4)] * 6:
        words = [f"x{rng.randrange(10**6)}" for _ in range(n_words)]
        copy = list(words)
        for at in rng.sample(range(n_words), edits):
            copy[at] = f"y{rng.randrange(10**6)}"
        i = len(rows)
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
        if similarity_by_hand(rows[i][1], rows[i + 1][1]) >= 0.8:
            gone.add(i + 1)
    assert 30 < len(gone) < 60
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, SF).collect()} == set(range(len(rows))) - gone


@pytest.mark.parametrize("tile", [2, 512])
def test_near_components_equal_all_pairs(spark, odd, tile):
    rng, rows = random.Random(tile), [(r.doc_id, r.text) for r in odd.where("length(text) < 1000 OR text IS NULL").collect()]
    for base in range(3):
        words = [f"b{base}_{i}" for i in range(80)]
        for i in range(25):
            at, k = rng.randrange(60), rng.choice([0, 1, 4, 8, 12])
            rows.append((100 * base + i, " ".join(words[:at] + [f"z{rng.randrange(6)}"] * k + words[at + k :])))
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = rows[i][1] or "", rows[j][1] or ""
            if (not x.split() and not y.split()) or (x.split() and y.split() and similarity_by_hand(x, y) >= 0.8):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    want = {c: min((r[0] is None, r[0] or 0) for r, u in zip(rows, up) if u == c) for c in up}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near.keep_first(table, tile=tile).collect())
    assert got == sorted(want.values())
    assert near.keep_first(table.limit(0)).count() == 0


def planted_sets(rng, n):
    """n pairs of sets of hashes, each just as similar as asked, some with one set inside the other."""
    out = []
    for i in range(n):
        size = int(rng.integers(5, 300))
        both = -(-4 * size // 5)  # of size hashes in all
        x = rng.integers(0, 2**64, size, np.uint64)
        cut = both + (size - both) // 2 * (i % 2)
        out.append((np.unique(x[:cut]), np.unique(x if i % 2 == 0 else np.concatenate([x[:both], x[cut:]]))))
    return out


@pytest.mark.parametrize("tile", [2, 256])
def test_simhash_keys_propose_pairs_of_similarity_08(spark, tile):
    rng = np.random.default_rng(tile)
    pairs = planted_sets(rng, 150)
    crowd = rng.integers(0, 2**64, 200, np.uint64)
    pairs += [(crowd[i:], np.delete(crowd[i:], 0)) for i in range(20)]  # near copies of one text crowd its keys
    rows = []
    for i, both in enumerate(pairs):
        for k, x in enumerate(both):
            wide = near.wide_simhash(x) if len(x) >= near.SMALL else np.zeros(0, np.uint64)
            rows.append((2 * i + k, wide[: near.WORDS].view(np.int64).tolist(), wide.view(np.int16).tolist(), near.small_keys(np.sort(x), 0.8).view(np.int64).tolist()))
    nodes = shared.save(spark.createDataFrame(rows, "fp long, sims array<long>, lanes array<short>, small array<long>"), "t")
    groups = collections.defaultdict(set)
    for r in near.proposals(nodes, tile=tile).collect():
        groups[r.g] |= {r.fp, r.pivot}
    met = {i for i in range(len(pairs)) if any({2 * i, 2 * i + 1} <= x for x in groups.values())}
    assert met == set(range(len(pairs)))
    assert sum(len(x) > 2 and any(f < 300 for f in x) for x in groups.values()) == 0  # unrelated texts are in no group


def test_wide_simhash_equals_plain_votes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 16, 255, 256, 700):
        x = rng.integers(0, 2**64, n, np.uint64)
        mixed = [[((int(h) ^ int(f)) * int(t)) % 2**64 for h in x] for f, t in zip(near._FLIP, near._TIMES)]
        want = [sum((2 * sum((m ^ m >> 32) >> b & 1 for m in word) > n) << b for b in range(64)) for word in mixed]
        assert near.wide_simhash(x).tolist() == want


def test_bit_planes_of_many_groups_equal_all_pairs():
    rng = np.random.default_rng(6)
    cut = np.concatenate([[0], np.cumsum([1, 2, 63, 64, 65, 1, 130, 3])])
    sims = rng.integers(0, 2**64, (cut[-1], 3), np.uint64)
    for i in range(1, cut[-1], 2):  # every other row is near the one before, at distances about the radius
        sims[i] = sims[i - 1]
        for b in rng.choice(192, rng.integers(50, 70), replace=False).tolist():
            sims[i, b // 64] ^= np.uint64(1 << b % 64)
    asks = rng.random(cut[-1]) < 0.3
    far = lambda i, j: int(np.bitwise_count(sims[i] ^ sims[j]).sum())
    whole = [(i, j) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) for i in range(a, b) for j in range(a, b) if i != j and far(i, j) <= 60]
    for some, want in ((None, {(i, j) for i, j in whole if i < j}), (asks, {(i, j) for i, j in whole if asks[i]})):
        i, j = near.pairs_within(sims, cut, some, 60, 128, chunk=100)
        assert len(want) > 20 and sorted(zip(i.tolist(), j.tolist())) == sorted(want)
    label = near.joined(10, np.array([9, 3, 4, 7]), np.array([8, 4, 2, 9]))
    assert label.tolist() == [0, 1, 2, 2, 2, 5, 6, 7, 7, 7]


@pytest.mark.parametrize("tile", [4, 256])
def test_near_copies_are_compared_once_not_once_a_key(spark, monkeypatch, tile):
    rng, rows = random.Random(8), []
    words = [f"w{i}" for i in range(200)]
    for i in range(120):
        copy = list(words)
        for at in rng.sample(range(200), rng.randrange(1, 9)):
            copy[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    counts, save = {}, near.save

    def counted(df, tag):
        out = save(df, tag)
        counts.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(near, "save", counted)
    got = {r.doc_id for r in near.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if up[i] != up[j] and similarity_by_hand(rows[i][1], rows[j][1]) >= 0.8:
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert got == set(up) and 1 < len(got) < 100
    # a text is in up to LANES groups of keys; what is joined and compared after that has it once
    assert counts["star"][0] <= 2 * len(rows) and counts["known"][0] <= len(rows) and counts["rest"][0] <= len(rows)


@pytest.mark.parametrize("tile", [1, 256])
def test_gathered_groups_hold_pairs_of_similarity_08(spark, tile):
    rng = np.random.default_rng(7)
    pairs = planted_sets(rng, 150)
    rows, crowd = [], []
    for i, both in enumerate(pairs):
        for k, x in enumerate(both):
            wide = near.wide_simhash(x) if len(x) >= near.SMALL else np.zeros(0, np.uint64)
            rows.append((2 * i + k, wide.view(np.int16).tolist()))
            # chained groups of unrelated pairs, as a key may join them
            crowd += [(g, 2 * i + k, 0) for g in (i // 10, 1000 + i // 7)]
    nodes = spark.createDataFrame(rows, "fp long, lanes array<short>")
    got = near.gathered(spark.createDataFrame(crowd, "g long, fp long, pivot long"), nodes, tile=tile).collect()
    of = {r.fp: r.g for r in got}
    assert len(of) == len(got) and all(of[2 * i] == of[2 * i + 1] for i in range(len(pairs)))
    small = {2 * i + k for i, both in enumerate(pairs) for k, x in enumerate(both) if len(x) < near.SMALL}
    if tile > 1:  # split by all bits; what has no SimHash is near all of its group
        unrelated = [i for i in range(len(pairs)) if not small & {2 * j + k for j in range(len(pairs)) if j // 10 == i // 10 or j // 7 == i // 7 for k in (0, 1)}]
        assert unrelated and all(sum(g == of[2 * i] for g in of.values()) == 2 and {r.other for r in got if r.fp == 2 * i} == {2 * i + 1} for i in unrelated)


def test_nearest_within_equals_all_pairs():
    rng = np.random.default_rng(11)
    lanes, wide = rng.integers(0, 2**64, (60, 32), np.uint64), rng.random(60) < 0.9
    for i in range(1, 60, 2):  # at distances about the radius
        lanes[i] = lanes[i - 1]
        for b in rng.choice(2048, int(rng.integers(380, 480)), replace=False).tolist():
            lanes[i, b // 64] ^= np.uint64(1 << b % 64)
    cut = [0, 1, 3, 30, 31, 60]
    label, other, apart = near.nearest_within(lanes, wide, np.array(cut), 430, chunk=37)
    far = lambda i, j: int(np.bitwise_count(lanes[i] ^ lanes[j]).sum())
    for a, b in zip(cut, cut[1:]):
        up = list(range(a, b))
        for i in range(a, b):
            met = [(far(i, j), j) for j in range(a, b) if j != i and (far(i, j) <= 430 or not (wide[i] and wide[j]))]
            assert (min(met)[0], True) == (apart[i], other[i] != i) if met else other[i] == i
            for _, j in met:
                up = [min(up[i - a], up[j - a]) if u in (up[i - a], up[j - a]) else u for u in up]
        assert label[a:b].tolist() == up


@pytest.mark.parametrize("dedup", [near.keep_first, simhash.keep_first])
def test_kept_rows_keep_their_columns(spark, dedup):
    d = spark.createDataFrame([(1, "a b c d e f g", 5, "h", None, 2), (2, "a b c d e f g", 5, "h", None, 2), (None, None, 5, "h", None, 2)], "doc_id long, text string, _id int, _h string, fp string, gone_id int")
    got = dedup(d)
    assert got.columns == d.columns and got.where("_id = 5 AND _h = 'h' AND gone_id = 2").count() == 2 == got.count()


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = shared.save(stage(spark, kept, SF), name)
        assert nxt.columns == docs.columns and nxt.count() <= kept.count()
        kept = nxt
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not any(base_spans(t) for t in texts.values())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert sum(r.length for r in packed) == sum(len(plain_ids(t, 1)) for t in texts.values())


def plain_verdict(text):
    """The quality rules by hand."""
    n, chars, symbols, dup, again = plain_features(text)
    t = text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    letters, capitals = (len(regex.findall(p, t)) for p in (r"\p{L}", r"\p{Lu}"))
    base = n < 50 or 100 * again > 50 * n
    some = max(n, 1)
    return not (base or symbols * 10 > some * 3 or not 1.5 <= chars / some <= 40 or dup * 10 > len(lines) * 4 or letters * 2 < chars or capitals * 10 > letters * 6)


def test_stages_of_odd_rows(spark, odd):
    """Each stage on nulls, empty and long texts, repeated rows, null ids and clashing names, against plain Python."""
    import corpus_pipeline

    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    rng = random.Random(9)
    prose = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}x" for _ in range(80)) for _ in range(6)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(200, prose[0]), (201, prose[0] + " tail"), (202, prose[1] + " " + bench[0]), (203, prose[2] + " password: hunter22 "), (204, prose[3].upper()), (None, prose[4]), (None, prose[4]), (205, "line\n" * 60), (206, "# " * 70)]
    clash = "_id int, _h string, fp string, start long, kept string, w int, words string, row int, at int"
    extra = (5, "h", "f", 9, "k", 3, "ws", 4, 6)
    table = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, " + clash)
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        got = shared.save(stages[name](spark, table, SF), name)
        assert got.columns == table.columns and got.where("_id = 5 AND _h = 'h' AND fp = 'f' AND start = 9 AND kept = 'k' AND w = 3 AND words = 'ws' AND row = 4 AND at = 6").count() == got.count()
        return collections.Counter((r.doc_id, r.text) for r in got.collect())

    every = collections.Counter(rows)
    assert run("quality_rules") == collections.Counter(r for r in rows if plain_verdict(r[1]))
    best = {}
    for i, t in rows:
        group = next((g for g in best if ((not (t or "").split()) == (not (g or "").split())) and (not (t or "").split() or similarity_by_hand(t, g) >= 0.8)), t)
        best[group] = min(best.get(group, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in run("near_dedup").elements()) == sorted(best.values())
    assert every - run("decontaminate") == collections.Counter({(202, prose[1] + " " + bench[0]): 1})
    masked = run("mask_secrets")
    assert every - masked == collections.Counter({rows[len(odd.collect()) + 3]: 1}) and masked[203, prose[2] + " [SECRET] "] == 1
    packed = stages["best_fit_packing"](spark, table, SF).collect()
    want = collections.Counter(i for i, _ in rows)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == want
