"""Fill-in-middle: a text's prefix, middle and suffix, told apart by sentinels and put in another order.

The cut is found by a streaming matcher of constant memory in two passes.  Units are the matches of a pattern
(code points unless said otherwise).  The first pass counts them; the ranks of both cuts follow from that count and
a hash of the document's id.  The second advances one lazy match iterator to the smaller rank and then on to the larger.
No unit is ever kept.  The way back needs no positions: sentinels cannot arise across a seam, so the text is
rebuilt by expressions from the output and its form alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice, product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

CODE_POINT = r"(?s:.)"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Sentinels:
        """These, if none is within another and no end of one begins one, so that none can arise across a seam."""
        for a, b in product(self, self):
            if len(set(self)) < len(self) or not a or (a != b and a in b) or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
        return self


class Rule(NamedTuple):
    """Which texts are cut and how: seed of the hash, share in percent left plain, share of the rest with the suffix first."""

    seed: str = "1"
    plain_from: int = 90
    spm_below: int = 20


def count_units(matches: Iterator) -> int:
    """First pass: how many matches there are, none kept."""
    counter = count()
    deque(zip(matches, counter), maxlen=0)  # a tuple and a match at a time  # noqa: B905
    return next(counter)


def advance(matches: Iterator, by: int, at: int) -> int:
    """Second pass: where the by-th next match ends; `at` if by is 0."""
    return next(islice(matches, by - 1, None)).end() if by else at


def draws(seed: str, key: str) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, key: str, units: re.Pattern, rule: Rule, marks: Sentinels) -> tuple[int, str, tuple[int, int], tuple[int, int]]:
    """(number of units, form, ranks of both cuts, places of both cuts)."""
    n = count_units(units.finditer(text))
    a, b, c, d = draws(rule.seed, key)
    if not text or any(m in text for m in marks) or c % 100 >= rule.plain_from:
        return n, PLAIN, (0, 0), (0, 0)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    matches = units.finditer(text)
    start = advance(matches, low, 0)
    return n, SPM if d % 100 < rule.spm_below else PSM, (low, high), (start, advance(matches, high - low, start))


def arranged(text: str, form: str, start: int, end: int, marks: Sentinels) -> str:
    """The text in its form; the middle is text[start:end]."""
    if form == PLAIN:
        return text
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if form == PSM:
        return "".join((marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle))
    return "".join((marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle))


CUT = "struct<output:string,form:string,units:bigint,prefix_units:bigint,middle_units:bigint>"


def cut_column(key: Column, text: Column, pattern: str = CODE_POINT, rule: Rule = Rule(), marks: Sentinels = Sentinels()) -> Column:
    """struct<output, form, units, prefix_units, middle_units>; the last two are null where the form is plain."""
    marks.checked()

    @F.arrow_udf(CUT)
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        units, columns = re.compile(pattern), [[] for _ in range(5)]
        for key, text in zip(keys, texts, strict=True):  # one text at a time leaves Arrow
            text = text.as_py()
            n, form, (low, high), (start, end) = cut(text, key.as_py(), units, rule, marks)
            row = arranged(text, form, start, end, marks), form, n, *((None, None) if form == PLAIN else (low, high - low))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["output", "form", "units", "prefix_units", "middle_units"])

    return run(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))


def transform(docs: DataFrame, out_col: str = "fim", pattern: str = CODE_POINT, rule: Rule = Rule(), marks: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with out_col: struct<output, form, units, prefix_units, middle_units>.

    A null text counts as empty; empty texts and those that hold a sentinel stay plain.  A document without an id
    is cut by the hash of an empty one; rows that repeat an id are cut each by its own text.  An empty table gives no
    rows.  Own columns, of any name and type, stay as they are; one named out_col is replaced.  Characters between
    units go with the unit behind them, those behind the last unit with the suffix.  One narrow pass.
    """
    return common.with_columns(docs, **{out_col: cut_column(common.quoted(id_col), common.quoted(text_col), pattern, rule, marks)})


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output and its form came from, by expressions alone; null for a null output."""
    marks.checked()

    def split(first: str, second: str, then: str):
        """Texts behind each of three sentinels that stand in this order."""
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        head = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(head) + len(second) + 1, F.length(body))
        mid = F.substring_index(rest, then, 1)
        return head, mid, F.substring(rest, F.length(mid) + len(then) + 1, F.length(rest))

    prefix, suffix, middle = split(marks.prefix, marks.suffix, marks.middle)
    late_suffix, late_prefix, late_middle = split(marks.suffix, marks.prefix, marks.middle)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_docs = transform(common.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut_docs.select(
        "doc_id", F.col("fim.units").alias("n"), "fim.form", F.col("fim.prefix_units").alias("prefix_chars"), F.col("fim.middle_units").alias("middle_chars"),
        sha(F.col("fim.output")).alias("output_sha256"), sha(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


ORACLE_OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE x END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
