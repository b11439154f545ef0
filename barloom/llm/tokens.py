"""Public tokenizers over Arrow batches: each distinct blank-separated chunk of a batch is encoded once.

The tokenizer drops white space and never joins what white space separates, so the ids of a text are the ids of its
chunks in order. ``Encoder.batch`` splits with Arrow, dictionary-encodes, and looks the few distinct chunks up in a
bounded cache of the worker; only chunks not seen before reach the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20  # of text that a task tokenizes at once
_ENCODERS: dict[str, Encoder] = {}


def lowered(texts: pa.Array) -> pa.LargeStringArray:
    """Texts (nulls count as empty) with A-Z in lower case; works on the bytes, as Arrow's own function errs on slices."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes().lower()
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(raw))


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    MARK = "\x01"  # between chunks that are encoded in one call; chunks that hold it go alone
    TAIL = ".,;:!?"  # marks that the tokenizer always splits off a word before them

    def __init__(self, path: str, cache_chunks: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_chunks = Tokenizer.from_file(path), cache_chunks
        self.tokenizer.no_truncation()
        self.mark = self._plain(self.MARK)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # the tokenizer lower-cases, and splits words from marks, if a few words come out alike both ways
        self.lowers = all(self._plain(x) == self._plain(x.lower()) for x in ("THE", "Zq", "A"))
        self.splits = all(self._plain(w + t) == self._plain(w) + self._plain(t) for w in ("the", "zqx", "\u00e9t\u00e9") for t in (".", ",", "?!", "..."))
        self.special = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.young: dict[str, bytes] = {}  # ids of chunks, in two generations: what is not asked for again goes
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out, joined, size = [], f" {self.MARK} ", self.kind.itemsize
        for at in range(0, len(chunks), 2000):
            some = chunks[at : at + 2000]
            text = joined.join(some)
            if len(self.mark) == 1 and text.count(self.MARK) == len(some) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
                cut = np.flatnonzero(ids == self.mark[0])
                if len(cut) == len(some) - 1:
                    raw, ends = ids.tobytes(), [*(cut * size).tolist(), len(ids) * size]
                    out += [raw[a:b] for a, b in zip([0, *(x + size for x in ends)], ends)]
                    continue
            out += [np.array(self._plain(x), self.kind).tobytes() for x in some]
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.young) > self.cache_chunks:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = [young.get(x) for x in chunks]
        new = []
        for i, x in enumerate(found):
            if x is None:
                w = chunks[i]
                if (ids := old.get(w)) is not None:
                    found[i] = young[w] = ids
                else:
                    new.append(i)
        stems = {}
        if self.splits:
            for i in new:
                w = chunks[i]
                stem = w.rstrip(self.TAIL)
                if stem is not w and len(stem) < len(w) and stem and stem[-1].isalpha():
                    stems[i] = (stem, w[len(stem) :])
        want = dict.fromkeys(x for i in new for x in (stems[i] if i in stems else (chunks[i],)))
        want = [x for x in want if x not in young]
        young.update(zip(want, self._encode(want)))
        for i in new:
            found[i] = young[stems[i][0]] + young[stems[i][1]] if i in stems else young[chunks[i]]
        return found

    def _chunks(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(each, at, offsets): ids of the distinct chunks, a chunk's place in ``each``, the chunks of a text."""
        low = lowered(texts) if self.lowers else None
        letters = low.buffers()[2] if low is not None else None
        raw = letters.to_pybytes() if letters is not None else b""
        # special strings are found as they are written: where there may be one, letters stay as they are
        if low is None or any(x in raw for x in self.special):
            low = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(low)
        words, offsets = split.flatten(), split.offsets.to_numpy()
        coded = words.dictionary_encode()
        return self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; null texts count as empty."""
        each, at, offsets = self._chunks(texts)
        if not len(at):
            return np.zeros(len(offsets) - 1, np.int64)
        length = pa.array(np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize)
        total = np.concatenate([[0], np.cumsum(length.take(pa.array(at)).to_numpy())])
        return np.diff(total[offsets])

    def batch(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): ids[bounds[i]:bounds[i + 1]] are text i's, end_id at the end; null texts count as empty."""
        each, at, offsets = self._chunks(texts)
        n = len(offsets) - 1
        if end_id is not None:  # one more word at the end of each text
            each.append(np.array([end_id], self.kind).tobytes())
            whole = np.full(len(at) + n, len(each) - 1, np.int32)
            whole[np.arange(len(at)) + np.repeat(np.arange(n), np.diff(offsets))] = at
            at, offsets = whole, offsets + np.arange(n + 1)
        store, size = np.frombuffer(b"".join(each), self.kind), self.kind.itemsize
        length = np.fromiter(map(len, each), np.int64, len(each)) // size
        word_bounds = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length[at], out=word_bounds[1:])
        # places in store of all ids, in half the memory where they are few enough
        narrow = np.int32 if max(word_bounds[-1], len(store)) < 1 << 31 else np.int64
        first = (np.cumsum(length) - length)[at]
        first -= word_bounds[:-1]
        where = np.repeat(first.astype(narrow), length[at])
        del first
        where += np.arange(len(where), dtype=narrow)
        return word_bounds[offsets], store[where].astype(np.int32)


def text_slices(texts: pa.Array, most_bytes: int = 4 << 20):
    """(first, n) of runs of rows of about most_bytes of text: bounded work memory whatever the lengths."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most_bytes:
            yield first, i - first
            first, total = i, 0
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes) - first


def regrouped(batches, column: str, most_bytes: int):
    """The same rows in record batches of about most_bytes of a column's text, whatever sizes they come in."""
    held, total = [], 0
    for batch in batches:
        for first, n in text_slices(batch.column(column), most_bytes):
            part = batch.slice(first, n)
            size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and total + size > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
            held.append(part)
            total += size
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
