"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and its neighbours'; forward-backward gives
each line's marginal probability of good, and their length-weighted mean, calibrated, is the document's
score.  The field is fitted on the driver from line features of a bounded sample of labelled
documents, each line bearing its document's label, and of joins of a good and a bad one, in which the
label changes between two lines; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

TRAIN_DOCS = 4000  # labelled documents the field is fitted on, picked by hash of their id
TRAIN_LINES = 200  # lines of one of them: a longer one gives this many in a row, from a place picked by its hash
GROUP_LINES = 50_000  # lines, padding included, of a group fitted at once
FOLDS = 5
THRESHOLD = 0.3

FEATURES = ("bias", "length", "letters", "digits", "symbols", "capitals", "pipes", "repeats", "echoes", "word_length", "short_words", "symbol_ends", "again", "sentence_end", "words")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*!^~@<>[]{}\\/=+_`"
_SYMBOL_END = re.compile(rb"[#$%&*!^~@<>=+_|]+(?:\s|$)")
_SHORT = re.compile(rb"(?:^|\s)[^\s]{1,3}(?=\s|$)")


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, weight of each line: its bytes and one)."""
    lines = text.split(b"\n")
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    rows = []
    for line in lines:
        n = len(line) or 1
        upper = len(line) - len(line.translate(None, _UPPER))
        lower = len(line) - len(line.translate(None, _LOWER))
        digits = len(line) - len(line.translate(None, _DIGITS))
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        words = line.split()
        k = len(words) or 1
        echoes = sum(map(bytes.__eq__, words, words[1:]))
        rows.append((
            1.0, math.log1p(len(line)) / 6, (upper + lower) / n, digits / n, symbols / n, upper / ((upper + lower) or 1), line.count(b"|") / k,
            1 - len(set(words)) / k if words else 0.0, echoes / k, min(n / k, 30) / 10, len(_SHORT.findall(line)) / k, len(_SYMBOL_END.findall(line)) / k,
            float(seen[line] > 1 and len(words) > 2), float(line.endswith((b".", b"!", b"?"))), math.log1p(len(words)) / 5,
        ))
    return np.array(rows, np.float64), np.array([len(line) + 1 for line in lines], np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, the line before's and the line after's (zero, bias too, beyond the ends)."""
    none = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


@dataclass
class Field:
    """Weights of the good label's emission (bad's are zero), 2 x 2 transitions (bad, good), calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward-backward in log odds."""
        e = (with_neighbours(x) @ self.weights).tolist()
        (bb, bg), (gb, gg) = self.transitions.tolist()
        fore = [e[0]]
        for t in range(1, len(e)):
            r = fore[-1]
            fore.append(e[t] + _log_add(r + gg, bg) - _log_add(r + gb, bb))
        back, out = 0.0, [0.0] * len(e)
        for t in range(len(e) - 1, -1, -1):
            out[t] = fore[t] + back
            s = e[t] + back
            back = _log_add(gg + s, gb) - _log_add(bg + s, bb)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def quality(self, x: np.ndarray, weight: np.ndarray) -> float:
        return float(self.marginals(x) @ weight / weight.sum())

    def score(self, text: bytes) -> float:
        q = min(max(self.quality(*line_features(text)), 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(q / (1 - q)) + self.shift)))


def joined(documents: list) -> list:
    """(features, labels of lines) of each document, and of halves of neighbours with unlike labels put together."""
    out = [(x, np.full(len(x), y)) for x, _, y in documents]
    for (x, _, y), (z, _, v) in itertools.pairwise(documents):
        if y != v:
            a, b = x[: -(-len(x) // 2)], z[len(z) // 2 :]
            out.append((np.vstack([a, b]), np.concatenate([np.full(len(a), y), np.full(len(b), v)])))
    return out


def padded(chains: list, most: int = GROUP_LINES):
    """Groups (features with neighbours, which cells are lines, labels) of chains of like length, of `most` cells at most if one fits."""
    chains, at = sorted(chains, key=lambda c: len(c[0])), 0
    while at < len(chains):
        to = at + 1
        while to < len(chains) and (to + 1 - at) * len(chains[to][0]) <= most:
            to += 1
        part, n = chains[at:to], len(chains[to - 1][0])
        x, on, y = np.zeros((len(part), n, 3 * len(FEATURES))), np.zeros((len(part), n), bool), np.zeros((len(part), n), np.int64)
        for i, (f, label) in enumerate(part):
            x[i, : len(f)], on[i, : len(f)], y[i, : len(f)] = with_neighbours(f), True, label
        yield x, on, y
        at = to


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 150, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Fit the field to (features, weights, label) of documents by Adam on the mean log likelihood of a line.

    Documents of like length are padded in groups of a bounded number of lines, so forward-backward runs over
    a group at once and memory is bounded by the documents' lines.
    """
    if not documents or len({y for *_, y in documents}) < 2:  # nothing to tell apart: every document gets the prior
        prior = (sum(y for *_, y in documents) + 1) / (len(documents) + 2)
        return Field(np.zeros(3 * len(FEATURES)), np.zeros((2, 2)), 0.0, math.log(prior / (1 - prior)))
    wide = 3 * len(FEATURES)
    w, tr = np.zeros(wide), np.zeros((2, 2))
    groups = list(padded(joined(documents)))
    chains = sum(len(x) for x, *_ in groups)
    m = [np.zeros(wide), np.zeros((2, 2))]
    v = [np.zeros(wide), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        gw, gt = -ridge * w, -ridge * tr
        for x, on, y in groups:
            a, b = _gradient(x, on, y, w, tr)
            gw, gt = gw + a / chains, gt + b / chains
        for p, g, i in ((w, gw, 0), (tr, gt, 1)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    field = Field(w, tr)
    q = np.clip([field.quality(x, k) for x, k, _ in documents], 1e-6, 1 - 1e-6)
    z, y = np.log(q / (1 - q)), np.array([y for *_, y in documents], float)
    c = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(c[0] * z + c[1], -30, 30)))
        d = np.stack([z, np.ones_like(z)])
        c = c - np.linalg.solve((d * (p * (1 - p))) @ d.T + 0.5 * np.eye(2), d @ (p - y) + 0.5 * (c - [1, 0]))
    field.slope, field.shift = max(float(c[0]), 0.05), float(c[1])
    return field


def _gradient(x, on, y, w, tr):
    """Gradient of the sum over chains of the log likelihood of their labels divided by the chain's lines."""
    e = x @ w
    emit = np.stack([np.zeros_like(e), e], -1)
    n = e.shape[1]
    fore, back = np.zeros_like(emit), np.zeros_like(emit)
    fore[:, 0] = emit[:, 0]
    for t in range(1, n):
        new = emit[:, t] + np.logaddexp(fore[:, t - 1, :1] + tr[0], fore[:, t - 1, 1:] + tr[1])
        fore[:, t] = np.where(on[:, t, None], new, fore[:, t - 1])
    for t in range(n - 2, -1, -1):
        s = emit[:, t + 1] + back[:, t + 1]
        new = np.logaddexp(tr[:, 0] + s[:, :1], tr[:, 1] + s[:, 1:])
        back[:, t] = np.where(on[:, t + 1, None], new, back[:, t + 1])
    z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
    p = np.exp(fore[..., 1] + back[..., 1] - z[:, None])
    size = on.sum(1)
    gw = np.einsum("dtf,dt->f", x, np.where(on, y - p, 0) / size[:, None])
    gt = np.zeros((2, 2))
    pair = on[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            expect = np.exp(fore[:, :-1, i] + tr[i, j] + emit[:, 1:, j] + back[:, 1:, j] - z[:, None])
            seen = (y[:, :-1] == i) & (y[:, 1:] == j)
            gt[i, j] = (np.where(pair, seen - expect, 0) / size[:, None]).sum()
    return gw, gt


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most train_docs labelled documents outside the held-out fold, with at most train_lines lines of each.

    Only labelled rows are bounded: features of a line are counted over its whole text.  Labels without an id
    or a quality are left out; an id labelled more than once is good if most of its labels are; of rows that
    repeat an id the least text counts.  The driver holds train_docs x train_lines lines of features at most.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg((F.col("y") > 0).cast("int")) >= 0.5).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = common.text_rows(docs, id_col, text_col).join(F.broadcast(rows), "doc_id")  # at most train_docs small rows
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for doc, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, k = line_features(text)
                at = zlib.crc32(str(doc).encode()) % max(1, len(x) - train_lines + 1)
                x, k = x[at : at + train_lines], k[at : at + train_lines]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([y], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([k.tobytes()], pa.binary())], names=["doc_id", "y", "x", "k"])

    got = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary, k binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit([(np.frombuffer(r["x"]).reshape(-1, len(FEATURES)), np.frombuffer(r["k"]), r["y"]) for r in got])


def score_column(text: F.Column, field: Field) -> F.Column:
    """Score of a text: 0 to 1, higher the likelier good; null and empty texts are one empty line."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([field.score(t or b"") for t in texts.to_pylist()], pa.float64())

    return run(text.cast("binary"))


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): 0 to 1, higher the likelier good.

    Null and empty texts are one empty line.  A null id stays null; repeated rows are scored each, alike;
    an empty table gives no rows; other columns are ignored.
    """
    return common.text_rows(docs, id_col, text_col).select("doc_id", score_column(F.col("text"), field).alias("score"))


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs that score the threshold or more, with their own columns, of any name and type."""
    return docs.where(score_column(common.quoted(text_col), field) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    field = train(docs, common.read(spark, sf_dir, "labels"))
    return score_documents(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
