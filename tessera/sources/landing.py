"""Landed source formats to rows: metrics text, feeds, transcripts in HTML, fixed-width tables, text reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_pages(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Items of landed response pages, one row each."""
    return spark.read.schema(schema).json(path).select(F.explode(items).alias("item")).select("item.*")


def csv_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def rss_items(df: DataFrame, content: str) -> DataFrame:
    """(title, link, published) of RSS documents."""
    items = F.from_xml(content, "channel struct<item array<struct<title:string,link:string,pubDate:string>>>")
    return df.select(F.explode(items["channel"]["item"]).alias("i")).select("i.title", "i.link", F.col("i.pubDate").alias("published"))


def metric_lines(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """(keep, name, labels map, value) of metrics in the Prometheus text format; comments, blank lines and lines without a number drop."""
    line = F.explode(F.split(content, "\n")).alias("line")
    rows = df.select(*keep, line).where(~F.col("line").rlike(r"^\s*(#|$)"))
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    pairs = F.regexp_extract_all(F.regexp_extract("line", pattern, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^=]+)=", 1).alias("key"), F.regexp_extract(p, r'="([^"]*)"', 1).alias("value"))))
    return rows.select(*keep, F.regexp_extract("line", pattern, 1).alias("name"), labels.alias("labels"), F.expr(f"try_cast(regexp_extract(line, '{pattern.replace(chr(92), chr(92) * 2)}', 3) AS double)").alias("value")).where("value IS NOT NULL AND name <> ''")


#: Page grammars: a fingerprint, the pattern that opens a turn (speaker in its first group).
GRAMMARS: Mapping[str, tuple[str, str]] = {
    "speaker_class": (r'class="Speaker(?:Begins|Name)"', r'(?s)<p class="Speaker(?:Begins|Name)"[^>]*>\s*(?:<b>)?([^<:]+)'),
    "bold_colon": (r"<p>\s*<b>[^<]+:\s*</b>", r"(?s)<p>\s*<b>([^<:]+):\s*</b>"),
    "heading": (r"<h[12]\b", r"(?s)<h[12][^>]*>([^<]*)"),
}


def grammar_of(page: Column) -> Column:
    """Which grammar a page is written in, by fingerprint; null if none."""
    out = None
    for name, (mark, _) in GRAMMARS.items():
        out = F.when(page.rlike(mark), name) if out is None else out.when(page.rlike(mark), name)
    return out


def transcript_turns(df: DataFrame, id_col: str, page: str) -> DataFrame:
    """(id, grammar, sequence, speaker, text) of transcript pages; text before the first turn is left out."""
    from tessera.functions.text import html_to_text

    parts = F.array().cast("array<struct<speaker:string,text:string>>")
    grammar = grammar_of(F.col(page))
    for name, (_, opens) in GRAMMARS.items():
        speakers = F.regexp_extract_all(page, F.lit(opens), F.lit(1))
        bodies = F.split(F.col(page), opens, -1)
        turns = F.zip_with(speakers, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda s, b: F.struct(F.trim(s).alias("speaker"), b.alias("text")))
        parts = F.when(grammar == name, turns).otherwise(parts)
    rows = df.select(id_col, grammar.alias("grammar"), F.posexplode(parts).alias("sequence", "t"))
    return rows.select(id_col, "grammar", "sequence", F.col("t.speaker").alias("speaker"), html_to_text(F.col("t.text")).alias("text"))


def fixed_width(df: DataFrame, id_col: str, content: str, headings: list[str]) -> DataFrame:
    """(id, row, one column for each heading): fields between the places where the headings stand in the header line."""
    lines = F.split(content, "\n")
    header = F.element_at(F.filter(lines, lambda x: F.contains(x, F.lit(headings[0]))), 1)
    rows = df.select(id_col, header.alias("_h"), F.posexplode(lines).alias("row", "_line")).where((F.col("_line") != F.col("_h")) & (F.trim("_line") != ""))
    at = [F.instr("_h", h) for h in headings]
    ends = [*at[1:], F.lit(1 << 20)]
    return rows.select(id_col, "row", *(F.trim(F.substring(F.col("_line"), a, b - a)).alias(h) for h, a, b in zip(headings, at, ends, strict=True)))


def report_blocks(df: DataFrame, id_col: str, content: str, opens: str) -> DataFrame:
    """(id, block, title, dates, text) of a text report whose blocks start with a line of the pattern."""
    rows = df.select(id_col, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(F.col("line").rlike(opens).cast("int")).over(w)).where("block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy(id_col, "block").agg(text.alias("text"))
    return out.select(id_col, "block", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)).alias("dates"), "text")


def social_posts(df: DataFrame, raw: str, platforms: Mapping[str, Mapping[str, str]], platform: str = "platform") -> DataFrame:
    """df with the fields of landed posts, by the JSON paths of each platform."""
    names = sorted({n for paths in platforms.values() for n in paths})
    cells = {}
    for n in names:
        c = F.lit(None).cast("string")
        for p, paths in platforms.items():
            if n in paths:
                c = F.when(F.col(platform) == p, F.get_json_object(raw, paths[n])).otherwise(c)
        cells[n] = c
    return df.select("*", *(c.alias(n) for n, c in cells.items()))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def geo_ip(df: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """df with the country of its address from (low, high, country) ranges that do not overlap.

    Ranges are laid out over the blocks of 65,536 addresses they touch, so the join is by block, not a nested loop.
    """
    n = ip_number(F.col(ip))
    laid = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16))))
    wide = df.withColumn("_n", n).withColumn("_b", F.shiftright("_n", 16))
    hit = (wide["_b"] == laid["_b"]) & (wide["_n"] >= laid["low"]) & (wide["_n"] <= laid["high"])
    return wide.join(laid, hit, "left").select(*(wide[c] for c in df.columns), "country")


def sample_to(df: DataFrame, target: int, key: str, seed: int) -> DataFrame:
    """At most target rows, those of the smallest hash of their key: every row is as likely, whatever partition it lies in."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(target)
