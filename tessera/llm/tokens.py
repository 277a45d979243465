"""Word-cached use of the tokenizers library, a batch of texts at a time.

The vocabulary used here splits on white space before anything else: white space separates
pre-tokens and is dropped, and no merge, contraction, normal form or added token spans it.  A text's
ids are therefore the concatenation of its words' ids.  A batch is split into words and reduced to
its distinct words by Arrow; the library encodes those that a bounded cache does not hold; ids are
gathered back in text order.  Tests compare with whole-text encoding.
"""

from __future__ import annotations

import contextlib
import gc
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PARTS = 400_000  # per Python worker; about 60 MB
SLICE_BYTES = 10 << 20
TRAILING = ".,;:!?|#$%&*()[]{}\"/\\+-=_~^@`>"
#: Latin letters whose lower case is one letter and which normalisation leaves alone.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """texts -> ids as little-endian integers of `dtype`."""

    def __init__(self, path: str, dtype: str = "<u4", parts: int = CACHE_PARTS, slice_bytes: int = SLICE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        # Plain words are one pre-token that normalisation leaves alone, so only the byte map is left of these steps.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.most_parts, self.slice_bytes = parts, slice_bytes
        self.pack = [struct.Struct(f"<{n}{self.dtype.char}").pack for n in range(16)]
        self.parts: dict[str, bytes] = {}

    def look_up(self, words: pa.Array, library) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of each); the library encodes what the cache does not hold."""
        words = words.to_pylist()
        out = list(map(self.parts.get, words))
        if missing := [i for i, x in enumerate(out) if x is None]:
            if len(self.parts) + len(missing) > self.most_parts:
                self.parts.clear()
            for at in range(0, len(missing), 20_000):
                some = [words[i] for i in missing[at : at + 20_000]]
                for i, w, e in zip(missing[at:], some, library.encode_batch_fast(some, add_special_tokens=False)):
                    ids = e.ids
                    out[i] = self.parts[w] = self.pack[len(ids)](*ids) if len(ids) < 16 else np.array(ids, self.dtype).tobytes()
        return np.frombuffer(b"".join(out), self.dtype), np.fromiter(map(len, out), np.int32, len(out)) // self.dtype.itemsize

    @staticmethod
    def gather(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words index[0], index[1], ... in a row, and the number of each."""
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[index]
        ends = np.cumsum(n, dtype=np.int32)
        return ids[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0, dtype=np.int32)], n

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, as look_up().  A plain word's trailing ASCII punctuation is a pre-token of its own."""
        stems = pc.utf8_rtrim(words, TRAILING)
        plain = pc.match_substring_regex(stems, PLAIN)
        behind = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        mask = plain.to_numpy(zero_copy_only=False)
        tailed = mask & (behind > 0)
        stems = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tails = pa.array([w[-n:] for w, n in zip(words.filter(pa.array(tailed)).to_pylist(), behind[tailed].tolist(), strict=True)], pa.string()).dictionary_encode()
        odd = words.filter(pa.array(~mask))
        ids, sizes = zip(*(self.look_up(*x) for x in ((stems.dictionary, self.plain), (tails.dictionary, self.library), (odd, self.library))), strict=True)
        a = len(sizes[0])
        b = a + len(sizes[1])
        units = np.full((len(words), 2), b + len(odd), np.int32)  # each word as two units: stem and tail, or the whole and nothing
        units[mask, 0] = stems.indices.to_numpy()
        units[tailed, 1] = a + tails.indices.to_numpy()
        units[~mask, 0] = b + np.arange(len(odd))
        flat, n = self.gather(np.concatenate(ids), np.concatenate([*sizes, [0]]).astype(np.int32), units.reshape(-1))
        return flat, n.reshape(-1, 2).sum(1, dtype=np.int32)

    def some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring(texts, "<|")  # added tokens are matched with their letter case
        low = pc.ascii_lower(texts)
        if pc.any(odd).as_py():
            low = pc.if_else(odd, texts, low)
        lists = pc.ascii_split_whitespace(low)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        del low, lists
        words, index = coded.dictionary, coded.indices.to_numpy()
        del coded
        flat, n = self.gather(*self.distinct(words), index)
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return flat, np.diff(ends[offsets - offsets[0]])

    def slices(self, texts: pa.Array, end_id: int | None = None):
        """Yield (from, to, ids of texts[from:to] in a row, number of ids of each), in slices of bounded size; end_id follows each text if given."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.slice_bytes, "right")))
            with paused_gc():
                ids, n = self.some(texts.slice(at, to - at))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), self.dtype.type(end_id)), n + 1
            yield at, to, ids, n
            at = to


@contextlib.contextmanager
def paused_gc():
    """No cyclic collection meanwhile: the library's many short-lived results hold no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def binary_column(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of each text as one binary value, without a copy of each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * ids.dtype.itemsize
    if offsets[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


_open: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One cache per worker process and vocabulary; Python workers are reused between tasks."""
    if (path, dtype) not in _open:
        _open.clear()
        _open[path, dtype] = Encoder(path, dtype)
    return _open[path, dtype]
