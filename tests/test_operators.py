"""Operators on small literal inputs with worked-out results."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import classify as cf
from tessera.functions import text as tx
from tessera.operators import captions as cp
from tessera.operators import changes as ch
from tessera.operators import cluster as cl
from tessera.operators import geo
from tessera.operators import passages as ps
from tessera.operators import relational as rel
from tessera.operators import resolve as rs
from tessera.operators import turns as tn
from tessera.operators import vector as vec
from tessera.plans import filters
from tessera.sources import landing
from tessera.streaming import streams as st


# -- passages ----------------------------------------------------------------------------------


def test_passages_edges():
    assert ps.passages("") == [] and ps.passages("  \n ") == [] and ps.passages("x" * 26) == []
    assert ps.passages("  " + "x" * 27 + " ") == [("x" * 27, 0, 27, 8)]
    whole = "y" * 1680
    assert ps.passages(whole) == [(whole, 0, 1680, 480)]


def test_passages_pack_and_overlap():
    parts = [c * 700 for c in "abcde"]
    got = ps.passages("\n".join(parts))
    # 200 tokens each: two fit, the next flushes; each further chunk begins with 175 characters of tail
    assert got[0] == ("a" * 700 + "\n" + "b" * 700, 0, 1401, 400)
    assert got[1][0].startswith("b" * 175 + "\n" + "c" * 700)
    assert [g[1] for g in got[1:]] == [g[2] - 175 for g in got[:-1]]  # a passage starts where its overlap does
    assert all(len(t) == b - a for t, a, b, _ in got)


def test_passages_long_paragraph_and_sentences():
    one = "z" * 5000
    assert ps.passages(one)[0][0] == one  # an oversized piece stays whole
    sentences = " ".join(f"Sentence {'w' * 300} ends." for _ in range(12))
    assert len(ps.passages(sentences)) > 1


def brute_passages(text, target, overlap, least):
    """The rule, unit by unit: add one more as long as the sum of sizes stays within the target."""
    size = lambda t: max(1, round(len(t) / 3.5))
    text = text.strip()
    if not text or size(text) < least:
        return []
    if size(text) <= target:
        return [(text, 0, len(text), size(text))]
    units = [u for u in re.split(r"\n+", text) if u.strip()]
    units = re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])", text) if len(units) == 1 else units
    out, tail = [], ""
    while units:
        n = 1
        while n < len(units) and sum(map(size, ([tail] if tail else []) + units[: n + 1])) <= target:
            n += 1
        chunk = "\n".join(([tail] if tail else []) + units[:n]).strip()
        units = units[n:]
        if units or size(chunk) >= least:
            start = out[-1][2] if out else 0
            out.append((chunk, start, start + len(chunk), size(chunk)))
        tail = chunk[-int(overlap * 3.5) :] if int(overlap * 3.5) else ""
    return out


def test_passages_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        unit = lambda: "".join(rng.choices("ab É.", k=rng.randint(0, 60))) + rng.choice([".", "!", "", " "])
        text = "".join(unit() + rng.choice(["\n", "\n\n", " ", ". A"]) for _ in range(rng.randint(0, 25)))
        args = rng.choice([(30, 5, 3), (20, 0, 8), (60, 10, 8), (10, 8, 2)])
        got, plain = ps.passages(text, *args), text.strip()
        assert [(t, n) for t, _, _, n in got] == [(t, n) for t, _, _, n in brute_passages(text, *args)], text
        for t, a, b, _ in got:  # the passage stands at its place
            assert 0 <= a < b <= len(plain) and t.split() == plain[a:b].split() and t[0] == plain[a] and t[-1] == plain[b - 1], (text, t)


def test_fold_matches_python(spark):
    words = ["Cœur Łódź Ås", "İstanbul ıI", "e\u0301", "Ĳssel ŉ", "日本 ñ", "plain", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(tx.fold(F.col("w"))).collect()] == [tx.folded(w) for w in words]
    assert tx.folded("Cœur Łódź Ås") == "coeur lodz as"


def test_character_references(spark):
    cases = {"&eacute;&Eacute;&notin;": "éÉ∉", "a & b &amp;amp; &": "a & b &amp; &", "&#233;&#xE9;&#X1F600;": "éé😀", "&#0;&#xD800;&#9999999;": "\ufffd" * 3, "&nosuch; &;": "&nosuch; &;", "": "", "&lt": "<", "&amp b &eacutes &#233 &#xE9g &notit; &notin &co;": "& b és é ég ¬it; ¬in &co;", "&ampamp;": "&amp;", "&NotEqualTilde;": "\u2242\u0338"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(tx.unescape(F.col("t"))).collect()] == list(cases.values())


def test_fuzzy_without_block(spark):
    names = spark.createDataFrame([("backet",), ("xy",), ("",)], "n string")
    roster = spark.createDataFrame([("packet", 1), ("rocket", 2), ("ab", 3)], "r string, id int")
    got = {r.n: (r.id, r.distance) for r in rs.fuzzy_unique(names, roster, "n", "r", "id").collect()}
    assert got == {"backet": (1, 1), "xy": (3, 2), "": (3, 2)}


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "word " * 20), (2, "tiny"), (3, None)], "doc_id int, text string")
    keep = spark.createDataFrame([(1, "en")], "doc_id int, lang string")
    [row] = ps.chunk_documents(df, "doc_id", "text", keep=keep).collect()
    assert (row.doc_id, row.chunk_index, row.char_start, row.char_end, row.lang) == (1, 0, 0, 99, "en")


def test_websearch():
    q = ps.parse_websearch('Road tax OR "clean WATER act" -gravel -"old mill" ""')
    assert q.any_of == [[("road",), ("tax",)], [("clean", "water", "act")]]
    assert q.none_of == [("gravel",), ("old", "mill")]
    assert ps.parse_websearch("").any_of == [] and ps.parse_websearch("OR").any_of == []


def test_websearch_match(spark):
    df = spark.createDataFrame([(1, "the clean water act"), (2, "clean act water"), (3, "road tax gravel"), (4, "tax the road")], "id int, t string").select("id", F.split("t", " ").alias("t"))
    q = ps.parse_websearch('road tax OR "clean water" -gravel')
    assert [r.id for r in df.where(ps.matches(F.col("t"), q)).orderBy("id").collect()] == [1, 4]
    assert df.where(ps.matches(F.col("t"), ps.parse_websearch(""))).count() == 0
    assert df.where(ps.matches(F.col("t"), ps.parse_websearch("-road"))).count() == 0


def test_analyzer(spark):
    df = spark.createDataFrame([("The Éléphants are walking quickly, nations!",)], "t string")
    assert df.select(ps.analyze(F.col("t"), "english")).first()[0] == ["elephant", "walk", "quick", "n"]
    assert df.select(ps.analyze(F.col("t"), "simple")).first()[0] == ["the", "elephants", "are", "walking", "quickly", "nations"]


def test_headline(spark):
    df = spark.createDataFrame([("a b c d e f Word, g h i j",)], "t string")
    assert df.select(ps.headline(F.col("t"), ["word"], 2, 4)).first()[0] == "e f <b>Word,</b> g"


def test_captions_repeat_window():
    cue = "00:00:0{0}.000 --> 00:00:0{1}.000\n{2}\n\n"
    content = "WEBVTT\n\n" + "".join(cue.format(i, i + 1, t) for i, t in enumerate(["A", "A", "B", "C", "D", "E", "A"]))
    assert [t for *_, t in ps.caption_lines(content)] == ["A", "B", "C", "D", "E", "A"]


# -- joins, ranks, merges ------------------------------------------------------------------------


def test_interval_edges(spark):
    f = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 5), (4, None, 10)], "id int, k string, t int")
    s = spark.createDataFrame([("a", 10, 20, "x"), ("a", 20, None, "y"), ("a", None, 6, "z")], "k string, s int, e int, v string")
    got = lambda **o: sorted((r.id, r.v) for r in rel.interval_join(f, s, ["k"], "t", "s", "e", how="inner", **o).collect())
    assert got() == [(1, "x"), (2, "y")]
    assert got(closed="both") == [(1, "x"), (2, "x"), (2, "y")]
    assert got(open_start=True) == [(1, "x"), (2, "y"), (3, "z")]
    assert rel.interval_join(f, s, ["k"], "t", "s", "e").count() == 4
    with pytest.raises(ValueError):
        got(closed="right")


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, 0.5, "o"), (None, 0.1, "o")], "k int, c double, v string")
    new = spark.createDataFrame([(1, 0.5, "n"), (None, 0.9, "n"), (2, None, "n"), (2, 0.3, "m")], "k int, c double, v string")
    got = lambda **o: sorted(((r.k, r.v) for r in rel.upsert(old, new, ["k"], **o).collect()), key=str)
    assert got() == sorted([(1, "o"), (None, "o"), (2, "m")], key=str)
    assert got(mode="highest", confidence="c") == sorted([(1, "o"), (None, "n"), (2, "m")], key=str)
    assert got(mode="replace") == sorted([(1, "n"), (None, "n"), (2, "m")], key=str)


def test_capped_and_pages(spark):
    df = spark.range(25).select(F.col("id").alias("d"))
    assert tuple(rel.capped_count(df, "d", 9, 5).first()) == (5, True)
    assert tuple(rel.capped_count(df, "d", 4, 5).first()) == (5, False)
    assert tuple(rel.page_totals(df.limit(0), 20).first()) == (0, 1)
    assert [r.d for r in rel.page(df, [F.asc("d")], 2, 10).collect()] == list(range(10, 20))


def test_unique_candidate_never_guesses(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, c int")
    assert [tuple(r) for r in rel.unique_candidate(df, ["k"], "c").collect()] == [("a", 1)]


def test_small_only_when_seen_small(spark):
    assert "broadcast" in rel.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in rel.small(spark.range(50), 10)._jdf.queryExecution().logical().toString().lower()


# -- changes -------------------------------------------------------------------------------------


def test_previous_row_changes(spark):
    rows = [(1, 1, "CA", None, 1), (2, 1, "CA", "", 2), (3, 1, "US", "x", 4), (4, 2, "FR", None, None)]
    df = spark.createDataFrame(rows, "id int, site int, country string, cdn string, tier int")
    got = ch.previous_row_changes(df, ["site"], ["id"], {"country": "major", "cdn": "info", "tier": ch.tier_severity()}, "id")
    assert sorted((r.to_id, r.change_type, r.severity) for r in got.collect()) == [(2, "tier", "notable"), (3, "cdn", "info"), (3, "country", "major"), (3, "tier", "major")]


def test_rotation_needs_an_open_term(spark):
    terms = spark.createDataFrame([(1, "A", "2000", None), (2, "A", "2000", "2001")], "k int, party string, started string, ended string")
    changes = spark.createDataFrame([(1, "party"), (2, "party"), (3, "name")], "k int, change_type string")
    now = spark.createDataFrame([(1, "B"), (2, "B")], "k int, party string")
    got = ch.rotate_terms(terms, changes, now, "k", "started", "ended", F.lit("2005"), ["party"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "A", "2000", "2005"), (1, "B", "2005", None), (2, "A", "2000", "2001")]))


def test_high_water(spark):
    df = spark.createDataFrame([("2024-01-20",), ("2024-01-01",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert str(ch.high_water(df, "t", 14).first()[0]) == "2024-01-06 00:00:00"
    assert str(ch.high_water(df, "t", 14, explicit="2023-01-01").first()[0]) == "2023-01-01 00:00:00"
    assert str(ch.high_water(df, "t", 14, since_days=3, as_of=F.lit("2024-02-01").cast("timestamp")).first()[0]) == "2024-01-29 00:00:00"
    empty = ch.high_water(df.limit(0), "t", 14)
    assert empty.first()[0] is None and ch.incremental(df, "t", empty).count() == 2


# -- turns ---------------------------------------------------------------------------------------


def test_alternation(spark):
    said = ["A", None, None, "B", None, "A", None, None, "A"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "m int, i int, s string")
    got = tn.alternate(df, ["m"], "i", "s").orderBy("i").collect()
    assert [r.filled for r in got] == ["A", "B", "A", "B", None, "A", None, None, "A"]
    assert [r.attribution for r in got][:2] == ["anchor", "alternation"]
    assert [r.filled for r in tn.alternate(df, ["m"], "i", "s", most=1).orderBy("i").collect()][1] is None


def test_repeats_depend_on_kept_rows(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("ABACDAB")], "m int, i int, t string")
    assert [r.t for r in tn.suppress_repeats(df, ["m"], "i", "t", 2).orderBy("i").collect()] == ["A", "B", "C", "D", "A", "B"]


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "a"])], "k int, i int, s string")
    got = tn.runs_to_intervals(df, ["k"], ["i"], "s", "i").orderBy("start").collect()
    assert [(r.s, r.start, r.end, r.n) for r in got] == [("a", 0, 1, 2), (None, 2, 3, 2), ("a", 4, 4, 1)]


# -- vectors, clusters ---------------------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "id int, embedding array<float>")
    got = vec.knn(df, [1.0, 0.0], "id", 4).collect()
    assert [r.id for r in got] == [0, 1, 3, 2] and got[3].similarity is None and round(got[1].similarity, 6) == 0.6
    assert [r.id for r in vec.knn(df, [1.0, 0.0], "id", 4, floor=0.5, exclude=0).collect()] == [1]


def test_ndcg(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "q string, i string, n int")
    gold = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "x")], "q string, i string")
    got = {r.q: (r.ndcg, r.recall) for r in vec.ndcg(ranked, gold, "q", "i", "n", 10).collect()}
    ideal = 1 + 1 / np.log2(3) + 1 / 2
    assert got == {"q": (round((1 + 1 / 2) / ideal, 6), round(2 / 3, 6)), "r": (0.0, 0.0)}


def test_plug_ins(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "a"), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in vec.embed_pending(df, "id", "t", lambda ts: [[len(t), 1.0] for t in ts]).collect()}
    assert got == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [0.0, 1.0]}
    assert [r.id for r in vec.rerank(df.where("t IS NOT NULL"), "q", "id", "t", lambda q, ts: [-len(t) for t in ts], 1).collect()] == [2]
    cache = {}
    assert vec.encode_query(lambda ts: [[len(ts[0])]], "ab", "do: ", cache) == [6.0] and len(cache) == 1


def test_offset():
    rng = np.random.default_rng(0)
    a = rng.random(400)
    at, score = vec.best_offset(a[50:], a[20:370], rate=10)
    assert at == -3.0 and score > 5


def test_levels_and_sample(spark):
    rows = [(i, [float(i % 4), float(i % 4) * 2], "ab"[i % 3 == 0]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, g string")
    assert cl.cluster_levels(df, "id", {"l1": 4}).groupBy("l1").count().count() == 4
    assert cl.project(df, "id", 1).count() == 90
    must = spark.createDataFrame([(1,), (2,)], "id int")
    got = cl.stratified_sample(df, ["g"], "id", 31, must)
    assert {1, 2} <= {r.id for r in got.collect()} and 31 <= got.count() <= 33
    labels = cl.labels(spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "z", 4)], "c int, term string, place int"), "c", "term")
    assert labels.first().label == "y, x"


# -- sources, filters, geometry --------------------------------------------------------------------


def test_landing_formats(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"objects": [{"id": 1}, {"id": 2}], "next": null}\n{"objects": [{"id": 3}], "next": "x"}\n')
    assert sorted(r.id for r in landing.json_pages(spark, f"file://{tmp_path}/p.json", "objects array<struct<id:int>>", "objects").collect()) == [1, 2, 3]
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in landing.csv_feed(spark, f"file://{tmp_path}/f.csv", "a int, b string").collect()] == [(1, "x"), (2, "y")]
    rss = "<rss><channel><item><title>T</title><link>L</link><pubDate>D</pubDate></item><item><title>U</title></item></channel></rss>"
    got = landing.rss_items(spark.createDataFrame([(rss,)], "c string"), "c").collect()
    assert [(r.title, r.link) for r in got] == [("T", "L"), ("U", None)]
    ip = spark.createDataFrame([("1.2.3.4",), ("x",)], "ip string")
    assert [r[0] for r in ip.select(landing.ip_number(F.col("ip"))).collect()] == [16909060, None]


def test_transcript_grammars(spark):
    pages = [(1, '<p class="SpeakerBegins"><b>Hon. A. Lee:</b> Hello.</p><p>More.</p><p class="SpeakerBegins"><b>B. Roy:</b> No.</p>'), (2, "<p> <b>Chair:</b> Order.</p>"), (3, "<div>none</div>")]
    rows = landing.transcript_turns(spark.createDataFrame(pages, "id int, html string"), "id", "html").orderBy("id", "sequence").collect()
    assert [(r.id, r.grammar, r.sequence, r.speaker) for r in rows] == [(1, "speaker_class", 0, "Hon. A. Lee"), (1, "speaker_class", 1, "B. Roy"), (2, "bold_colon", 0, "Chair")]
    assert rows[0].text == ": Hello.\nMore." and rows[2].text == "Order."


def test_filters():
    with pytest.raises(ValueError):
        filters.require_something(filters.SearchFilter(session=3))
    filters.require_something(filters.SearchFilter(resolved=True))
    assert filters.SearchFilter(ids=(1, 2, 1), more_ids=tuple(range(20))).chosen_ids() == [1, 2, 0, *range(3, 10)]


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([([[{"lng": a, "lat": b} for a, b in ring]],)], "rings array<array<struct<lng:double,lat:double>>>")
    inside = lambda x, y: df.select(geo.in_polygon(F.col("rings"), F.lit(x), F.lit(y))).first()[0]
    assert inside(2.0, 2.0) and not inside(5.0, 2.0) and not inside(2.0, 4.0) and inside(0.0, 0.0)
    assert tuple(df.select(geo.centroid(F.col("rings")[0])).first()[0]) == (2.0, 2.0)
    assert df.select(geo.valid_wgs84(F.col("rings"))).first()[0]


def test_tiers_and_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    none = F.lit(None).cast("string")
    assert one(cf.hosting_tier(none, none, F.lit(False), none, F.lit(True))) == 6
    assert one(cf.hosting_tier(F.lit("CA"), none, F.lit(False), F.lit("edge"), F.lit(False))) == 2
    assert one(cf.hosting_tier(none, none, F.lit(False), F.lit("edge"), F.lit(False))) == 3
    assert one(cf.coverage_status(F.lit(0), 10, 1, F.lit("partial"))) == "partial"
    assert [one(cf.grade(F.lit(x))) for x in (85, 84, 50, 29)] == ["A", "B", "C", "F"]


def test_html_and_snippet(spark):
    df = spark.createDataFrame([("<style>x</style><p>A &amp; B<br/>C</p>\n\n<p>  D&nbsp;E </p><script>no</script>",)], "h string")
    assert df.select(tx.html_to_text(F.col("h"))).first()[0] == "A & B\nC\nD E"
    long = spark.createDataFrame([("word " * 100,)], "t string")
    out = long.select(tx.snippet(F.col("t"))).first()[0]
    assert len(out) <= 280 and out.endswith("word...")


# -- streams -----------------------------------------------------------------------------------------


def test_alert_stream(spark, tmp_path):
    spark.sql("SELECT 1L AS id, 'a' AS kind, timestamp'2024-01-10' AS ts UNION ALL SELECT 2L, 'b', timestamp'2024-01-10' UNION ALL SELECT 3L, 'a', timestamp'2023-01-10'").write.parquet(f"file://{tmp_path}/in")
    stream = st.file_stream(spark, f"file://{tmp_path}/in", "id long, kind string, ts timestamp")
    searches = spark.sql("SELECT 7 AS sid, 'a' AS want, CAST(NULL AS timestamp) AS last_checked_at, 'daily' AS cadence")
    as_of = F.lit("2024-01-20").cast("timestamp")
    sink = lambda df, _: df.select("sid", "id").write.mode("append").parquet(f"file://{tmp_path}/out")
    st.alert_stream(stream, searches, lambda: F.col("kind") == F.col("want"), "ts", as_of, sink, f"file://{tmp_path}/log").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(7, 1)]


def spoken(spark, *lines, panel=None):
    df = spark.createDataFrame([(1, i, float(i), i + 1.0, x) for i, x in enumerate(lines)], "m int, pos int, start double, end double, text string")
    turns = cp.turns(df, "m", "pos", "start", "end", "text")
    spans = None if panel is None else spark.createDataFrame([(1, *p) for p in panel], "m int, start double, end double, owner string")
    return [(r.name, r.attribution) for r in cp.alternation(turns, "m", "start", spans).orderBy("seq").collect()]


@pytest.mark.parametrize("tail, name", [
    ("the motion is seconded by Councillor Parm.", None), ("thank you, Councillor Parm.", None), ("sorry, Mayor Gond", None), ("Councillor Wright, Counsellor Parm.", "PARM"),
    ("thank you, Councillor Parm, you have the floor", "PARM"), ("Councillor Parm left early that day", None), ("no one is named", None), (None, None), ("", None),
])
def test_hand_over(spark, tail, name):
    got = spark.range(1).select(cp.handed_to(F.lit(tail).cast("string")).alias("h")).first().h
    assert (got and got.name) == name


def test_turns_of_hard_captions(spark):
    assert spoken(spark) == []
    assert spoken(spark, "", None, ">>", ">> a") == []
    assert spoken(spark, "no mark at all") == [(None, None)]
    assert spoken(spark, ">> The Chair: Councillor Parm?", ">> Good morning from Councillor Wright.") == [("The Chair", "macro"), (None, None)]
    assert spoken(spark, ">> Deputy Ann Lee: Hello there.", ">> My name is ann o'neil-roy and I live here.") == [("Ann Lee", "macro"), ("Ann O'Neil-Roy", "self_intro")]


def test_alternation_ends_at_other_members_and_after_sixty_turns(spark):
    opening = [">> The Chair: Councillor Parm?", ">> What does it cost?"]
    assert spoken(spark, *opening, ">> A lot.", ">> How much?", ">> Thanks, Councillor Tang. Well.", ">> Why?")[2:] == [(None, None), ("PARM", "alternation"), (None, None), (None, None)]
    assert spoken(spark, *opening, ">> A lot.", ">> Thank you, Councillor Parm. More.", ">> I see.")[2:] == [(None, None), (None, None), ("PARM", "alternation")]
    filled = spoken(spark, *opening, *[">> And so on."] * 70)
    assert [i for i, (n, _) in enumerate(filled[1:]) if n] == list(range(0, 61, 2))


def test_panel_opens_blocks_that_words_confirm(spark):
    lines = [">> The Clerk: The budget.", ">> What does it cost?", ">> A lot.", ">> And the bridge?", ">> Thank you, Councillor Parm. That too.", ">> I see."]
    assert spoken(spark, *lines, panel=[(0.0, 9.0, "PARM")])[1:] == [("PARM", "panel"), (None, None), ("PARM", "panel"), (None, None), (None, None)]
    assert spoken(spark, *lines[:4], panel=[(0.0, 9.0, "PARM")])[1:] == [(None, None)] * 3
    assert spoken(spark, *lines, panel=[])[1:] == [(None, None)] * 5


def test_hosting_without_anything(spark):
    none = F.lit(None).cast("string")
    seen = lambda failed: spark.range(1).select(cf.hosting(none, none, none, F.lit(None).cast("array<string>"), none, none, F.lit(None).cast("array<string>"), F.lit(failed)).alias("h")).first().h
    assert tuple(seen(True)) == tuple(seen(False)) == (6, None, None, None, None)


def test_rules_leave_no_partner_out_and_take_the_least(spark):
    left = spark.createDataFrame([(1, "d", "budget"), (2, "d", "budget"), (3, "d", ""), (4, None, "audit"), (5, "d", "roadsandparks")], "id int, day string, s string")
    right = spark.createDataFrame([(10, "d", "budget"), (11, "d", "parks"), (12, "d", ""), (13, None, "audit"), (14, "e", "budget"), (15, "d", None)], "vid int, day string, v string")
    got = rel.match_by_rules(left, right, "day", "id", "vid", [(F.col("s"), F.col("v"))], within=("s", "v"))
    assert sorted(map(tuple, got.collect())) == [(10, 1, 1), (11, 5, 2)]


def test_postal_address(spark):
    cases = {
        "House of Commons\nOttawa ON  K1A 0A6": ("House of Commons", "Ottawa", "ON", "K1A 0A6"), "100 Main St\nSuite 4,\n\nCalgary, AB t2p1a1": ("100 Main St, Suite 4", "Calgary", "AB", "T2P 1A1"),
        "5 King St, Toronto, M5V 2T6": ("5 King St", "Toronto", None, "M5V 2T6"), "12 Elm\nHalifax\nB3H 4R2": ("12 Elm", "Halifax", None, "B3H 4R2"), "Box 1\nRoom 2, Regina, SK Canada": ("Box 1, Room 2", "Regina", "SK", None),
        "unknown place": ("unknown place", None, None, None), " \n ": (None, None, None, None), "": (None, None, None, None), "K1A0A6": (None, None, None, "K1A 0A6"), "AB": (None, None, "AB", None),
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select(tx.postal_address(F.col("t")).alias("a")).collect()
    assert [tuple(r.a) for r in rows] == [*cases.values(), (None,) * 4]
