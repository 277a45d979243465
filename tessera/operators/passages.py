"""Passages of documents, search text, captions: text operators."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold

CHARS_A_TOKEN = 3.5
TARGET, OVERLAP, LEAST = 480, 50, 8


def estimate(text: str) -> int:
    """Tokens of a text, estimated from its length."""
    return max(1, round(len(text) / CHARS_A_TOKEN))


def boundaries(text: str) -> list[tuple[int, int]]:
    """Where the units of a text lie: its lines that are not blank or, if it is one line, its sentences."""
    lines = [m.span() for m in re.finditer(r"[^\n]+", text) if not m[0].isspace()]
    if len(lines) != 1:
        return lines
    gaps = [m.span() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])", text)]
    return list(zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)], strict=True))


def passages(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, int, int, int]]:
    """(text, char_start, char_end, tokens) of a document's passages.

    Running totals of the units' sizes give each passage its last unit by binary search: the last one that keeps it
    within the target, but at least one.  A further passage begins with the tail of the one before, whose size
    counts.  Places are real ones in the stripped text, overlaps included: between them stands the passage, but for the white
    space between its units, which is one line break in the passage.  A last passage of fewer than `least` tokens is left out.
    """
    text = text.strip()
    if not text or estimate(text) < least:
        return []
    if estimate(text) <= target:
        return [(text, 0, len(text), estimate(text))]
    units = boundaries(text)
    totals = [0, *accumulate(estimate(text[a:b]) for a, b in units)]
    out, first, lead, spans = [], 0, "", []  # spans: where the parts of `lead` lie
    while first < len(units):
        room = target - (estimate(lead) if lead else 0)
        behind = max(first + 1, bisect_right(totals, totals[first] + room) - 1)
        body = "\n".join([*([lead] if lead else []), *(text[a:b] for a, b in units[first:behind])]).strip()
        spans = trimmed(text, [*spans, *units[first:behind]])
        if behind < len(units) or estimate(body) >= least:
            out.append((body, spans[0][0], spans[-1][1], estimate(body)))
        tail = int(overlap * CHARS_A_TOKEN)
        first, lead, spans = behind, body[max(0, len(body) - tail) :], last_part(spans, tail)
    return out


def trimmed(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a text without white space at both ends of the whole."""
    spans = list(spans)
    while len(spans) > 1 and not text[slice(*spans[0])].strip():
        spans.pop(0)
    while len(spans) > 1 and not text[slice(*spans[-1])].strip():
        spans.pop()
    a, b = spans[0]
    spans[0] = (b - len(text[a:b].lstrip()), b)
    a, b = spans[-1]
    spans[-1] = (a, a + len(text[a:b].rstrip()))
    return spans


def last_part(spans: list[tuple[int, int]], chars: int) -> list[tuple[int, int]]:
    """The spans of the last `chars` characters of spans joined by one character each."""
    out = []
    for a, b in reversed(spans):
        if chars <= 0:
            break
        out.append((max(a, b - chars), b))
        chars -= b - a + 1
    return out[::-1]


def chunk_documents(df: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, keep: DataFrame | None = None) -> DataFrame:
    """(id, chunk_index, text, token_count, char_start, char_end); documents too short for a passage give none.

    `keep`, a table with the id, adds its columns to each passage: a parent's denormalised copy.
    """
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = [[{"chunk_index": i, "text": t, "token_count": n, "char_start": a, "char_end": b} for i, (t, a, b, n) in enumerate(passages(x or "", target, overlap, least))] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item)], names=[id_col, "chunks"])

    out = df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunks array<struct<chunk_index:int,text:string,token_count:int,char_start:int,char_end:int>>")
    rows = out.select(id_col, F.explode("chunks").alias("c")).select(id_col, "c.*")
    return rows if keep is None else rows.join(keep, id_col, "left")


# -- search text ---------------------------------------------------------------------------------

#: Short function words by language.
STOPS = {
    "english": "a an and are as at be by for from in is it of on or that the this to was with".split(),
    "french": "au aux avec ce dans de des du elle en et il la le les mais ou par pas pour que qui sur un une".split(),
    "simple": [],
}
SUFFIXES = {"english": "ations?|ings?|edly|ed|es|ly|s", "french": "ations?|ements?|ees?|es|s|e", "simple": None}
CONFIG = {"en": "english", "fr": "french"}


def analyze(text: Column, config: str) -> Column:
    """Tokens of a text: folded words without stop words, common endings cut from words of five letters or more.

    Stop words and endings go by expressions over the whole text, which compile; nothing runs word by word.
    """
    folded = fold(text)
    if STOPS[config]:
        folded = F.regexp_replace(folded, rf"(?<![a-z0-9])(?:{'|'.join(STOPS[config])})(?![a-z0-9])", " ")
    if SUFFIXES[config]:
        folded = F.regexp_replace(folded, rf"(?<![a-z0-9])(?=[a-z0-9]{{5}})([a-z0-9]*?)(?:{SUFFIXES[config]})(?![a-z0-9])", "$1")
    return F.regexp_extract_all(folded, F.lit(r"[a-z0-9]+"), F.lit(0))


def analyze_by_language(text: Column, language: Column) -> Column:
    out = None
    for code, config in CONFIG.items():
        out = F.when(language == code, analyze(text, config)) if out is None else out.when(language == code, analyze(text, config))
    return out.otherwise(analyze(text, "simple"))


@dataclass
class WebQuery:
    """Alternatives of (terms and phrases that must occur), and those that must not."""

    any_of: list[list[tuple[str, ...]]] = field(default_factory=list)
    none_of: list[tuple[str, ...]] = field(default_factory=list)


def parse_websearch(query: str, words: Callable[[str], list[str]] | None = None) -> WebQuery:
    """Words are joined by AND, OR starts an alternative, a minus excludes, quotes make a phrase; anything else is text.

    words: how a text becomes words; folded ones unless given.
    """
    words = words or (lambda text: re.findall(r"[a-z0-9]+", _fold(text)))
    out, current = WebQuery(), []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word == "OR" and not minus:
            if current:
                out.any_of.append(current)
                current = []
            continue
        tokens = tuple(words(phrase or word))
        if tokens and minus:
            out.none_of.append(tokens)
        elif tokens:
            current.append(tokens)
    if current:
        out.any_of.append(current)
    return out


def _fold(text: str) -> str:
    from tessera.functions.text import folded

    return folded(text)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: the optimiser leaves a lambda's variable alone."""
    return F.element_at(F.transform(F.array(value), body), 1)


_both = lambda xs: reduce(lambda a, b: a & b, xs, F.lit(True))
_either = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))


def matches(tokens: Column, query: WebQuery) -> Column:
    """Whether a token array answers a parsed query; a query of nothing matches nothing.  Tokens are evaluated once."""

    def judged(x):
        has = lambda t: F.array_contains(x["tokens"], t[0]) if len(t) == 1 else F.contains(x["joined"], F.lit(f" {' '.join(t)} "))
        return _either(_both(map(has, group)) for group in query.any_of) & _both(~has(t) for t in query.none_of)

    phrases = any(len(t) > 1 for group in [*query.any_of, query.none_of] for t in group)
    joined = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")) if phrases else F.lit("")
    return _let(tokens, lambda t: _let(F.struct(t.alias("tokens"), joined(t).alias("joined")), judged))


def search(text: Column, config: str, query: WebQuery) -> Column:
    """Whether a text answers a parsed query.

    A token is a folded word or the beginning of one, so a text that lacks a needed token as a plain substring is
    ruled out before it is analysed.
    """
    folded_text = fold(text)
    may = _let(folded_text, lambda x: _either(_both(F.contains(x, F.lit(w)) for t in group for w in t) for group in query.any_of))
    return may & matches(analyze(text, config), query)


def rank(tokens: Column, query: WebQuery) -> Column:
    """Number of occurrences of the query's words."""
    words = sorted({w for g in query.any_of for t in g for w in t})
    return F.size(F.filter(tokens, lambda t: t.isin(*words))) if words else F.lit(0)


def headline(text: Column, words: list[str], before: int = 5, most: int = 35) -> Column:
    """Up to `most` words of the text around the first of the words, which are marked."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    plain = F.transform(parts, lambda p: F.regexp_replace(fold(p), "[^a-z0-9]", ""))
    hit = F.array_position(F.transform(plain, lambda p: p.isin(*words)), F.lit(True)).cast("int")
    start = F.greatest(hit - before, F.lit(1))
    marked = F.zip_with(parts, plain, lambda p, q: F.when(q.isin(*words), F.concat(F.lit("<b>"), p, F.lit("</b>"))).otherwise(p))
    return F.array_join(F.slice(marked, start, most), " ")


# -- captions ------------------------------------------------------------------------------------

_CUE = re.compile(r"^(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s+-->\s+(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})")
LINE = "pos int, start double, end double, text string"


def caption_lines(content: str, memory: int = 4) -> list[tuple[int, float, float, str]]:
    """Display lines of WebVTT captions in order: tags and entities resolved, the last few lines not repeated."""
    seconds = lambda h, m, s, ms: int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000
    out: list[tuple[int, float, float, str]] = []
    cue = None
    for line in content.replace("\r\n", "\n").replace("﻿", "").split("\n"):
        if found := _CUE.match(line):
            g = found.groups()
            cue = (seconds(*g[:4]), seconds(*g[4:]))
        elif not line.strip():
            cue = None
        elif cue:
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split())
            if text and text not in [t for *_, t in out[-memory:]]:
                out.append((len(out), *cue, text))
    return out


def parse_captions(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, pos, start, end, text) of caption files."""
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("pos", "start", "end", "text"), x, strict=True)) for x in caption_lines(c or "")] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item)], names=[id_col, "lines"])

    out = df.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, lines array<struct<pos:int,start:double,end:double,text:string>>")
    return out.select(id_col, F.explode("lines").alias("l")).select(id_col, "l.*")
