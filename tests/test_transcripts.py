"""Transcript grammars on small pages."""

from pyspark.sql import functions as F

from tessera.operators import transcripts as tr

PAGES = {
    1: '<h1>Oral <i>Questions</i></h1><p>Preamble.</p><p class="SpeakerBegins"><b>Hon. Ann Lee (Premier):</b> One.</p><p>Two &amp; three.</p><h2>Bills</h2><p class="SpeakerName">Madam Speaker: Order.</p>',
    2: '<div class="turn" data-time="09:05"><span class="who">The  Clerk</span> A</div><p>more</p><div class="turn" data-time="09:07"><span class="who">Bo</span></div>',
    3: "<dl><dt>Cy Ng</dt><dd>x<br>y</dd></dl>",
    4: '<table class="transcript"><tr><td></td><td>Di</td><td>z</td></tr><tr><td>11:00</td><td>Ed</td><td>w</td></tr></table>',
    5: "<p><b>Mr. Roy:</b> a: b</p><p>c <b>d:</b> e</p>",
    6: "<p>No transcript.</p>", 7: "", 8: None,
}


def test_turns(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "id int, html string")
    got = sorted(map(tuple, tr.turns(pages, "id", "html").drop("digest").collect()))
    assert got == [
        (1, "speaker_class", 0, "Hon. Ann Lee (Premier)", "minister", "Oral Questions", None, "One.\nTwo & three."),
        (1, "speaker_class", 1, "Madam Speaker", "presiding", "Bills", None, "Order."),
        (2, "timed_div", 0, "The Clerk", "official", None, "09:05", "A\nmore"),
        (2, "timed_div", 1, "Bo", None, None, "09:07", ""),
        (3, "definitions", 0, "Cy Ng", None, None, None, "x\ny"),
        (4, "rows", 0, "Di", None, None, None, "z"),
        (4, "rows", 1, "Ed", None, None, "11:00", "w"),
        (5, "bold_colon", 0, "Mr. Roy", None, None, None, "a: b\nc d: e"),
    ]
    assert tr.turns(pages.where("id > 5"), "id", "html").count() == 0
    own = tr.Grammar("own", "##", r"(?s)<p>.*?</p>", r"^<p>#([^#]+)#", "")
    assert [tuple(r) for r in tr.turns(spark.createDataFrame([(1, "<h2>no</h2><p>#A#x</p>##")], "id int, html string"), "id", "html", [own]).select("speaker", "text", "section").collect()] == [("A", "x", None)]
    assert pages.select(tr.fingerprint(F.col("html"))).where("id = 6").count() == 1


def test_pages_are_read_once(spark):
    """Not once for each grammar."""
    pages = spark.createDataFrame(list(PAGES.items()), "id int, html string").groupBy("id").agg(F.max("html").alias("html"))
    plan = tr.turns(pages, "id", "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
