"""Transcripts: every conversation written as a page of one of five grammars, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import transcripts as tr
from tessera.registry import query
from tessera.sources.tables import Tables


@query("transcript_grammars", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, trim(regexp_replace(coalesce(text, ''), '[\\s\\x{A0}]+', ' ', 'g')) AS said FROM conversations)
SELECT conv_id, ['speaker_class', 'timed_div', 'definitions', 'rows', 'bold_colon'][conv_id % 5 + 1] AS grammar, n::INTEGER AS sequence,
CASE role WHEN 'system' THEN 'The Chair' WHEN 'assistant' THEN 'Hon. A. Roy (Minister of ' || conv_id % 3 || ')' ELSE 'Mr. O''Neil & Co' END AS speaker,
CASE role WHEN 'system' THEN 'presiding' WHEN 'assistant' THEN 'minister' END AS role, 'Topic ' || conv_id || CASE WHEN n >= 2 THEN ', continued' ELSE '' END AS section,
CASE WHEN conv_id % 5 IN (1, 3) THEN '10:' || lpad((n % 60)::VARCHAR, 2, '0') END AS at_time, sha256(said) AS digest FROM c""")
def transcript_grammars(spark, d):
    c = Tables(spark, d).conversations
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    said = escaped(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s ]+", " ")))
    who = F.when(F.col("role") == "system", "The Chair").when(F.col("role") == "assistant", F.concat(F.lit("Hon. A. Roy (Minister of "), F.col("conv_id") % 3, F.lit(")"))).otherwise("Mr. O'Neil &amp; Co")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("who"), said.alias("said")))).alias("t"))

    def node(t, i):
        at, w, s = F.concat(F.lit("10:"), F.lpad((i % 60).cast("string"), 2, "0")), t["who"], t["said"]
        half = F.floor(F.length(s) / 2).cast("int")
        space = F.when(F.instr(F.substring(s, half + 1, F.lit(1 << 20)), " ") > 0, half + F.instr(F.substring(s, half + 1, F.lit(1 << 20)), " ")).otherwise(0)
        a, b = F.left(s, F.greatest(space - 1, F.lit(0))), F.substring(s, space + 1, F.lit(1 << 20))
        kind = F.col("conv_id") % 5
        forms = (
            F.concat(F.lit('<p class="SpeakerBegins"><b>'), w, F.lit(":</b> "), a, F.lit("</p>\n<p>"), b, F.lit("</p>")),
            F.concat(F.lit('<div class="turn" data-time="'), at, F.lit('"><span class="who">'), w, F.lit("</span> "), s, F.lit("</div>")),
            F.concat(F.lit("<dt>"), w, F.lit("</dt>\n<dd>"), a, F.lit("</dd><dd>"), b, F.lit("</dd>")),
            F.concat(F.lit("<tr><td>"), at, F.lit("</td><td>"), w, F.lit("</td><td>"), s, F.lit("</td></tr>")),
            F.concat(F.lit("<p><b>"), w, F.lit(":</b> "), s, F.lit("</p>")),
        )
        body = F.coalesce(*(F.when(kind == i, f) for i, f in enumerate(forms)))
        return F.concat(F.when(i == 2, F.concat(F.lit("<h3>Topic "), F.col("conv_id"), F.lit(", continued</h3>"))).otherwise(""), body)

    opened = F.when(F.col("conv_id") % 5 == 2, "<dl>").when(F.col("conv_id") % 5 == 3, '<table class="transcript">').otherwise("")
    page = F.concat(F.lit("<html><body><h2>Topic "), F.col("conv_id"), F.lit("</h2>"), opened, F.array_join(F.transform("t", node), "\n"), F.lit("</body></html>"))
    found = tr.turns(rows.select("conv_id", page.alias("page")), "conv_id", "page").withColumn("text", F.regexp_replace("text", "\n", " "))
    return found.select("conv_id", "grammar", "sequence", "speaker", "role", "section", F.col("at").alias("at_time"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
