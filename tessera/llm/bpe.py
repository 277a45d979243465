"""BPE encoding and decoding with an index of pair occurrences.

The distinct words of a batch lie in one array of symbols, each slot linked to its neighbours in the word.  The index
maps every pair that has a merge to all its positions, kept by bands of consecutive ranks.  Active ranks are
applied in ascending order: all positions of a band are merged at once, and the pairs that arise left and right of each
enter the lists of their own, higher bands.  A band is a stretch of ranks none of which makes a part of another, so
within it only overlaps decide: of overlapping pairs the lower rank goes first, of equal ones the leftmost.
Normalisation and the split into words are the tokenizers library's, for plain words by their bytes alone; tests
compare whole texts with the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokens import Encoder, binary_column, default_vocabulary, paused_gc

NONE = np.int32(2**31 - 1)


class Merges:
    """The merge table: rank of a pair, product of a rank, and the first rank of each band."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, vocabulary: int):
        self.made, self.width = np.append(made, 0).astype(np.int32), np.int64(vocabulary + 1)
        keys = left * self.width + right
        self.by = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by]
        maker = np.full(vocabulary, -1)
        maker[made[::-1]] = np.arange(len(made))[::-1]  # the first rank that makes it
        if len(np.unique(made)) != len(made) or (np.maximum(maker[left], maker[right]) >= np.arange(len(made))).any():
            raise ValueError("merges must make each token once, from parts made before")
        starts = [0]
        for rank, part in enumerate(np.maximum(maker[left], maker[right]).tolist()):
            if part >= starts[-1]:
                starts.append(rank)
        self.starts = np.array([*starts, len(made)], np.int32)
        self.band = np.append(np.repeat(np.arange(len(starts)), np.diff(self.starts)), len(starts)).astype(np.int16)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it has no merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by[at], NONE)


class PairIndex:
    """Words as linked symbols, and for each band the positions of its pairs.

    Slot n, behind the last symbol, stands for no neighbour: its symbol is in no merge.
    """

    def __init__(self, merges: Merges, symbols: np.ndarray, sizes: np.ndarray):
        n = len(symbols)
        self.merges, self.n = merges, n
        self.symbol = np.append(symbols, merges.width - 1).astype(np.int64)
        self.right, self.left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(sizes)
        self.right[ends[sizes > 0] - 1] = n
        self.left[(ends - sizes)[sizes > 0]] = n
        self.right[n] = self.left[n] = n
        self.alive = np.ones(n, bool)
        self.rank = np.full(n + 1, NONE, np.int32)
        self.lists: list[list[np.ndarray]] = [[] for _ in range(len(merges.starts) - 1)]
        self.enter(np.arange(n, dtype=np.int32))

    def enter(self, slots: np.ndarray) -> None:
        """Look up the pairs that begin at these slots and put each into its band's list."""
        ranks = self.merges.ranks(self.symbol[slots], self.symbol[self.right[slots]])
        self.rank[slots] = ranks
        self.rank[self.n] = NONE
        has = ranks != NONE
        slots, bands = slots[has], self.merges.band[ranks[has]]
        by = np.argsort(bands, kind="stable")
        slots, bands = slots[by], bands[by]
        cuts = np.flatnonzero(np.diff(bands, prepend=-1))
        for band, part in zip(bands[cuts].tolist(), np.split(slots, cuts[1:]) if len(cuts) else [], strict=True):
            self.lists[band].append(part)

    def apply(self) -> None:
        """All merges, band by band."""
        for band, lists in enumerate(self.lists):
            if lists:
                low, high = self.merges.starts[band : band + 2]
                at = np.unique(np.concatenate(lists))
                lists.clear()
                at = at[(self.rank[at] >= low) & (self.rank[at] < high)]  # pairs that still stand
                while len(at):
                    took = self.first(at)
                    self.merge(at[took])
                    at = at[~took]
                    at = at[(self.rank[at] >= low) & (self.rank[at] < high)]

    def first(self, at: np.ndarray) -> np.ndarray:
        """Which of a band's pairs, ascending, no overlapping pair goes before; at least the lowest of each chain."""
        rank = self.rank[at]
        same = np.zeros(len(at), bool)  # overlaps the pair before it, of the same rank
        same[1:] = (self.right[at[:-1]] == at[1:]) & (rank[1:] == rank[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        free = self.rank[self.left[at]] > rank  # of a run's head: what overlaps it on the left comes later
        return free[head] & ((np.arange(len(at)) - head) % 2 == 0) & (self.rank[self.right[at]] >= rank)

    def merge(self, at: np.ndarray) -> None:
        gone = self.right[at]
        then = self.right[gone]
        self.symbol[at] = self.merges.made[self.rank[at]]
        self.right[at] = then
        self.left[then] = at
        self.left[self.n] = self.n
        self.alive[gone] = False
        self.rank[gone] = NONE
        before = self.left[at]
        self.enter(np.unique(np.concatenate([at, before[before < self.n]])))


class BpeEncoder(Encoder):
    """texts -> ids; words that its bounded cache does not hold go through a pair index together."""

    def __init__(self, path: str, dtype: str = "<u4", **limits: int):
        super().__init__(path, dtype, **limits)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match the text as it is")
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        table = np.array([(ids[a], ids[b], ids[(a.removesuffix(end) if end else a) + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.merges = Merges(*table.T, max([*ids.values(), *added.values()]) + 1)
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else "(?!)")
        self.inner, self.last = ids, {c: ids[c + end] for c in ids if len(c) == 1 and c + end in ids}
        shown = [self.byte_char(b) for b in range(256)]
        self.inner_bytes, self.last_bytes = (np.array([t.get(c, -1) for c in shown], np.int64) for t in (self.inner, self.last))
        self.by_words = not any("Ġ" in piece or " " in piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str("a b"))

    @staticmethod
    def byte_char(b: int) -> str:
        """The character that byte-level vocabularies show a byte as: itself if printable, else one from 256 on, in order."""
        printable = lambda x: 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        return chr(b) if printable(b) else chr(256 + sum(not printable(x) for x in range(b)))

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text as the library splits it, added tokens as their ids."""
        out: list[str | int] = []
        for i, part in enumerate(self.split.split(text)):
            if i % 2:
                out.append(self.added[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)] if norm else []
        return out

    def encode_pieces(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of each) of their symbols."""
        index = PairIndex(self.merges, symbols, sizes)
        index.apply()
        before = np.concatenate([[0], np.cumsum(index.alive)])
        ends = np.cumsum(sizes)
        return index.symbol[:-1][index.alive], before[ends] - before[ends - sizes]

    def symbols(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for p in pieces:
            if isinstance(p, int):
                flat.append(p)
                sizes.append(1)
            else:
                flat += [*map(self.inner.__getitem__, p[:-1]), self.last[p[-1]]]
                sizes.append(len(p))
        return np.array(flat, np.int64), np.array(sizes, np.int64)

    def look_up(self, words: pa.Array, library) -> tuple[np.ndarray, np.ndarray]:
        names = words.to_pylist()
        out = list(map(self.parts.get, names))
        if missing := [i for i, x in enumerate(out) if x is None]:
            if len(self.parts) + len(missing) > self.most_parts:
                self.parts.clear()
            if library is self.plain:  # one pre-token each, and its bytes are its symbols
                some = words.take(pa.array(missing, pa.int32()))
                sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
                raw = np.frombuffer("".join([names[i] for i in missing]).encode(), np.uint8)
                symbols, ends = self.inner_bytes[raw], np.cumsum(sizes)
                symbols[ends - 1] = self.last_bytes[raw[ends - 1]]
                ids, n = self.encode_pieces(symbols, sizes)
            else:
                pieces = [self.pieces(names[i]) for i in missing]
                ids, each = self.encode_pieces(*self.symbols([p for word in pieces for p in word]))
                held = np.array([len(word) for word in pieces], np.int64)
                upto = np.concatenate([[0], np.cumsum(each)])
                n = upto[np.cumsum(held)] - upto[np.cumsum(held) - held]
            raw, at = ids.astype(self.dtype).tobytes(), 0
            for i, size in zip(missing, (n * self.dtype.itemsize).tolist(), strict=True):
                out[i] = self.parts[names[i]] = raw[at : at + size]
                at += size
        return np.frombuffer(b"".join(out), self.dtype), np.fromiter(map(len, out), np.int32, len(out)) // self.dtype.itemsize

    def some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.by_words:
            return super().some(texts)
        split = [self.pieces(t) for t in texts.to_pylist()]
        seen = {p: i for i, p in enumerate(dict.fromkeys(p for text in split for p in text))}
        ids, sizes = self.encode_pieces(*self.symbols(list(seen)))
        flat, n = self.gather(ids.astype(self.dtype), sizes.astype(np.int32), np.array([seen[p] for text in split for p in text], np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])
        held = np.cumsum([0, *map(len, split)])
        return flat, np.diff(ends[held])


class Decoder:
    """ids -> text, as the library's decode that keeps special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        self.joint = b"" if kind else b" "
        byte = {BpeEncoder.byte_char(b): b for b in range(256)}
        shown = lambda t: bytes(byte[c] for c in t) if kind and all(c in byte for c in t) else t.encode()
        self.tokens = {i: shown(t) for t, i in names.items()}

    def text(self, ids: np.ndarray) -> str:
        """The text of ids; ids outside the vocabulary are passed over, bytes that are no UTF-8 become U+FFFD."""
        return self.joint.join([t for i in ids.tolist() if (t := self.tokens.get(i)) is not None]).decode("utf-8", "replace")


_kept: dict[tuple[type, str], object] = {}


def _of(kind: type, path: str):
    """One encoder and one decoder a worker process; workers are reused between tasks."""
    if (kind, path) not in _kept:
        for old in [k for k in _kept if k[0] is kind]:
            del _kept[old]
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def ids_column(text: Column, vocabulary: str | None = None) -> Column:
    """Token ids of a text as little-endian unsigned 32-bit integers; a null text is empty."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        parts = [binary_column(ids, n) for _, _, ids, n in _of(BpeEncoder, path).slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return run(F.coalesce(text.cast("string"), F.lit("")))


def text_column(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of token ids; null for null."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        decoder = _of(Decoder, path)
        with paused_gc():
            return pa.array([None if r is None else decoder.text(np.frombuffer(r, "<u4")) for r in rows.to_pylist()], pa.string())

    return run(ids)


def encode(docs: DataFrame, out_col: str = "ids", vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with out_col: token ids of each whole text, little-endian u32.

    Null and empty texts have no ids; rows without an id and repeated rows are encoded each; an empty table gives no
    rows.  Own columns, of any name and type, stay as they are; one named out_col is replaced.  One narrow pass; a word
    of any length is merged in time near linear.
    """
    return common.with_columns(docs, **{out_col: ids_column(common.quoted(text_col), vocabulary)})


def decode(rows: DataFrame, out_col: str = "text", vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with out_col: the text of each row's ids; null ids give null.  Other columns as in encode()."""
    return common.with_columns(rows, **{out_col: text_column(common.quoted(ids_col), vocabulary)})


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(common.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"), "decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
