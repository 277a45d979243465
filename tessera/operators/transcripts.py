"""Transcript pages to turns, by declared grammars.

A grammar says how a page of its kind is told, which elements are its nodes, what opens a turn, and where headings, times
and roles stand.  A page's nodes are numbered; a window over them carries the latest heading and time on and counts openers, and
the nodes of a turn are put together.  Nothing goes row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import html_to_text, squeeze


@dataclass(frozen=True)
class Grammar:
    """mark: a pattern that pages of this kind have.  node: an element, the smallest unit that belongs to one turn.

    opens: what a turn's first node begins with, the speaker in its first group; it is no part of the text.
    heading, time: nodes that name the section, and the time in a node's first group; '' if there is none.
    """

    name: str
    mark: str
    node: str
    opens: str
    heading: str = r"^<h[1-6]\b[^>]*>(.*?)</h[1-6]>"
    time: str = ""


_BLOCK = r"(?s)<(p|h[1-6])\b[^>]*>.*?</\1>"
#: More specific marks first: a page is of the first grammar whose mark it has.
GRAMMARS = (
    Grammar("speaker_class", r'<p class="Speaker(?:Begins|Name)"', _BLOCK, r'(?s)^<p class="Speaker(?:Begins|Name)"[^>]*>\s*(?:<b>)?([^<:]+)(?::\s*</b>|</b>:?|:)'),
    Grammar("timed_div", r'<div class="turn" data-time="', r'(?s)<(?:div class="turn"|p\b|h[1-6]\b)[^>]*>.*?</(?:div|p|h[1-6])>', r'(?s)^<div class="turn"[^>]*>\s*<span class="who">([^<]*)</span>', time=r'^<div class="turn" data-time="([0-9:]+)"'),
    Grammar("definitions", r"<dl\b", r"(?s)<(dt|dd|h[1-6])\b[^>]*>.*?</\1>", r"(?s)^<dt>([^<]*)</dt>"),
    Grammar("rows", r'<table class="transcript"', r"(?s)<(tr|h[1-6])\b[^>]*>.*?</\1>", r"(?s)^<tr><td>[0-9:]*</td><td>([^<]*)</td>", time=r"^<tr><td>([0-9:]+)</td>"),
    Grammar("bold_colon", r"<p>\s*<b>[^<]+:\s*</b>", _BLOCK, r"(?s)^<p>\s*<b>([^<:]+):\s*</b>"),
)
ROLES = (("presiding", r"^(?:The|Madam|Mr\.?)\s+(?:Speaker|Chair|President)\b"), ("minister", r"\((?:[^)]*\b)?(?:Minister|Premier)\b"), ("official", r"^(?:The\s+)?Clerk\b"))


def fingerprint(page: Column, grammars: Sequence[Grammar] = GRAMMARS) -> Column:
    """The grammar that a page is written in; null if none."""
    return F.coalesce(*(F.when(page.rlike(g.mark), g.name) for g in grammars))


def role_of(speaker: Column) -> Column:
    """What a speaker's label says they are; null for members."""
    return F.coalesce(*(F.when(speaker.rlike(pattern), role) for role, pattern in ROLES))


def turns(pages: DataFrame, id_col: str, page_col: str, grammars: Sequence[Grammar] = GRAMMARS) -> DataFrame:
    """(id, grammar, sequence, speaker, role, section, at, text, digest) of all turns of all pages, in order from 0.

    Nodes before the first opener belong to no turn, but headings and times among them count.  A turn without text is kept.
    Null pages and pages of no grammar give none.  digest: SHA-256 of the text.
    """
    name, none = fingerprint(F.col(page_col), grammars), lambda c: F.nullif(c, F.lit(""))
    told = pages.select(id_col, F.col(page_col).alias("_page"), name.alias("grammar"))
    ahead = Window.partitionBy(id_col).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)

    def by(what: Callable[[Grammar], Column]) -> Column:  # what a row's own grammar says; pages are read once for all grammars
        return F.coalesce(*(F.when(F.col("grammar") == g.name, what(g)) for g in grammars))

    group = lambda pattern: none(F.regexp_extract("_node", pattern, 1)) if pattern else F.lit(None).cast("string")
    nodes = told.where("grammar IS NOT NULL").select(id_col, "grammar", F.posexplode(by(lambda g: F.regexp_extract_all("_page", F.lit(g.node), F.lit(0)))).alias("_pos", "_node"))
    rows = nodes.select(
        id_col, "grammar", "_pos", by(lambda g: F.regexp_extract("_node", g.opens, 1)).alias("_who"), by(lambda g: F.col("_node").rlike(g.opens)).alias("_opens"),
        by(lambda g: group(g.heading)).alias("_head"), by(lambda g: group(g.time)).alias("_time"), by(lambda g: F.regexp_replace("_node", g.opens, " ")).alias("_body"),
    )
    rows = rows.select("*", F.sum(F.col("_opens").cast("int")).over(ahead).alias("_turn"), F.last("_head", True).over(ahead).alias("_section"), F.last("_time", True).over(ahead).alias("_at"))
    said = rows.where((F.col("_turn") > 0) & F.col("_head").isNull())
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_body"))), lambda x: x["_body"]), "\n")
    first = lambda c: F.min_by(c, "_pos")
    whole = said.groupBy(id_col, "grammar", "_turn").agg(parts.alias("_html"), first("_who").alias("_who"), first("_section").alias("_section"), first("_at").alias("at"))
    speaker = squeeze(html_to_text(F.col("_who")))
    shown = whole.select(id_col, "grammar", (F.col("_turn") - 1).cast("int").alias("sequence"), speaker.alias("speaker"), html_to_text(F.col("_section")).alias("section"), "at", html_to_text(F.col("_html")).alias("text"))
    return shown.select(id_col, "grammar", "sequence", "speaker", role_of(F.col("speaker")).alias("role"), "section", "at", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
