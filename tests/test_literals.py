"""Text functions, landed formats and resolvers on literal rows, beside what they must give."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import passages as ps
from tessera.operators import resolve as rs
from tessera.plans.people import rows
from tessera.sources import landing

CASES = {}


def query(name, expected):
    def add(f):
        CASES[name] = f, expected
        return f

    return add


def _literal(spark, **cells):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items()))


METRICS = '# HELP up x\nup{job="api",host="a"} 1\nlat_bucket{le="0.1"} 5\nlat_bucket{le="0.5"} 18\nlat_bucket{le="+Inf"} 20\nbad line\n\ntemp 36.6\n'
VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\nHELLO &gt;&gt; ALL\n\n00:00:02.500 --> 00:00:04.000\nHELLO &gt;&gt; ALL\n<c>SECOND</c> LINE\n\n1:00:00.000 --> 1:00:01.000\nTHIRD\n"
FIXED = "Bill  Title            Status\n1     Roads Act        passed\n22    Water and Air    first\n\n"
REPORT = "intro\nBill 1 - Roads\nread 2024-02-03\nagain 2024-03-04\nBill 2 - Water\nno date\n"


@query("norm_names", "SELECT * FROM (VALUES (1, 'jose munoz'), (2, 'ann o connor'), (3, 'x')) t(id, name)")
def norm_names(spark, d):
    return rows(spark, "id int, raw string", (1, "Hon. José  MUÑOZ"), (2, "the Right Hon. Ann O'Connor"), (3, " X. ")).select("id", tx.norm_name(F.col("raw")).alias("name"))


@query("attributions", "SELECT * FROM (VALUES (1, 'Ann Lee', 'York', 'Green'), (2, 'Bo', NULL, NULL), (3, 'Cy Ng', 'East, West', 'NDP')) t(id, name, riding, party)")
def attributions(spark, d):
    r = rows(spark, "id int, raw string", (1, "Ann Lee (York, Green)"), (2, "Bo"), (3, "Cy Ng (East, West, NDP)"))
    return r.select("id", tx.attribution(F.col("raw")).alias("a")).select("id", "a.*")


@query("speaker_labels", "SELECT * FROM (VALUES (1, 'Mr', NULL, 'Smith'), (2, NULL, 'Ann', 'Lee'), (3, NULL, NULL, NULL), (4, 'Hon', 'É.', 'Roy')) t(id, honorific, first, last)")
def speaker_labels(spark, d):
    r = rows(spark, "id int, raw string", (1, "Mr. Smith:"), (2, "Ann Lee (York):"), (3, "The Speaker:"), (4, "Hon. É. Roy"))
    return r.select("id", tx.speaker_label(F.col("raw")).alias("s")).select("id", "s.honorific", "s.first", "s.last")


@query("postal_codes", "SELECT * FROM (VALUES (1, 'K1A 0B1', 'K1A'), (2, NULL, NULL), (3, 'T5J 2N9', 'T5J')) t(id, postcode, fsa)")
def postal_codes(spark, d):
    r = rows(spark, "id int, raw string", (1, "Ottawa ON k1a0b1 Canada"), (2, "no code D1A 1A1"), (3, "T5J-2N9"))
    return r.select("id", tx.postal(F.col("raw")).alias("p")).select("id", "p.*")


@query("social_profiles", "SELECT * FROM (VALUES (1, 'twitter', 'annlee'), (2, 'facebook', 'ann.lee'), (3, 'youtube', 'annlee'), (4, NULL, NULL), (5, 'linkedin', 'ann-lee'), (6, 'bluesky', 'ann.bsky.social')) t(id, platform, handle)")
def social_profiles(spark, d):
    r = rows(spark, "id int, url string", (1, "https://X.com/@AnnLee?s=1"), (2, "http://m.facebook.com/ann.lee/"), (3, "https://www.youtube.com/@annlee"), (4, "https://example.com/annlee"), (5, "https://ca.linkedin.com/in/x"), (6, "https://bsky.app/profile/ann.bsky.social"))
    r = r.withColumn("url", F.when(F.col("id") == 5, "https://linkedin.com/in/ann-lee").otherwise(F.col("url")))
    return r.select("id", tx.canonical_social(F.col("url")).alias("s")).select("id", "s.platform", "s.handle")


@query("truecased", "SELECT * FROM (VALUES (1, 'Thank you. We agree.'), (2, 'Mixed Case STAYS here'), (3, '123'), (4, 'The member for Saint-Henri, (Mr. McLeod''s friend), asked Ottawa.')) t(id, line)")
def truecased(spark, d):
    lines = rows(spark, "id int, raw string", (1, "THANK YOU. WE AGREE."), (2, "Mixed Case STAYS here"), (3, "123"), (4, "THE MEMBER FOR SAINT-HENRI, (MR. MCLEOD'S FRIEND), ASKED OTTAWA."))
    return lines.select("id", tx.truecase(F.col("raw"), ["Ottawa", "Saint-Henri", "McLeod's", "Mr"]).alias("line"))


@query("body_titles", "SELECT * FROM (VALUES (1, 'finance', '2024-02-03'), (2, 'roadsandparks', NULL)) t(id, body, day)")
def body_titles(spark, d):
    r = rows(spark, "id int, raw string, title string", (1, "Standing Committee on Finance", "Meeting 2024-02-03 part 1"), (2, "Roads and Parks", "no date"))
    return r.select("id", tx.squash_body(F.col("raw")).alias("body"), F.date_format(tx.title_date(F.col("title")), "yyyy-MM-dd").alias("day"))


@query("vote_passages", "SELECT * FROM (VALUES (1, 'passed', 50, 12, 'C-9'), (2, 'failed', NULL, NULL, NULL), (3, NULL, NULL, NULL, '22')) t(id, outcome, ayes, nays, bill)")
def vote_passages(spark, d):
    r = rows(spark, "id int, raw string", (1, "The motion was defeated. Correction: the motion on Bill C-9 is carried. Ayes: 50 Nays: 12"), (2, "[Motion lost]"), (3, "Bill 22 was read."))
    return r.select("id", tx.votes_in(F.col("raw")).alias("v")).select("id", "v.*")


@query("section_types", "SELECT * FROM (VALUES (1, 'question_period'), (2, 'debate'), (3, 'statement')) t(id, kind)")
def section_types(spark, d):
    r = rows(spark, "id int, raw string", (1, "Oral Questions"), (2, "Second Reading"), (3, "Members' Statements"))
    return r.select("id", tx.speech_type(F.col("raw"), {"question": "question_period", "statement": "statement"}).alias("kind"))


@query("first_name_relations", "SELECT * FROM (VALUES (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'high')) t(id, relation)")
def first_name_relations(spark, d):
    r = rows(spark, "id int, a string, b string", (1, "Bob", "Robert"), (2, "J", "John"), (3, "Ann", "Bo"), (4, "Zoé", "zoe"))
    return r.select("id", tx.first_name_relation(F.col("a"), F.col("b"), {"bob": "robert", "bill": "william"}).alias("relation"))


@query("sequence_ratios", "SELECT * FROM (VALUES (1, 1.0::DOUBLE), (2, 0.75), (3, 0.0), (4, NULL)) t(id, ratio)")
def sequence_ratios(spark, d):
    r = rows(spark, "id int, a string, b string", (1, "abc", "abc"), (2, "abcd", "bcde"), (3, "a", "z"), (4, None, "z"))
    return r.select("id", tx.sequence_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("nfkc_hash", "SELECT sha256('file 2') AS digest, 2::BIGINT AS n")
def nfkc_hash(spark, d):
    r = rows(spark, "raw string", ("ﬁle  ②",), ("FILE 2",))
    return r.select(tx.content_hash(tx.nfkc(F.col("raw"))).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


@query("motion_movers", "SELECT * FROM (VALUES (1, 30), (2, 31)) t(id, member)")
def motion_movers(spark, d):
    facts = rows(spark, "id int, city string, name string", (1, "a", "Councillor SMITH"), (2, "b", "Mayor Gond,"), (3, "a", "Doe"), (4, "b", "Smith"), (5, "a", None))
    roster = rows(spark, "city string, member int, surname string", ("a", 30, "Smith"), ("b", 31, "Gond"), ("a", 32, "Doe"), ("a", 33, "Doe"))
    return rs.by_surname(facts, roster, "id", "name", ["city"])


@query("stream_titles", "SELECT * FROM (VALUES (1, '2026-07-07', 'City Council - Public Hearing'), (2, '2026-07-07', 'Audit'), (3, NULL, NULL), (4, NULL, NULL)) t(id, day, body)")
def stream_titles(spark, d):
    r = rows(spark, "id int, title string", (1, "July 7, 2026 - City Council - Public Hearing"), (2, "Jul. 7 2026 – Audit "), (3, "Julember 7, 2026 - Audit"), (4, "City Council"))
    return r.select("id", tx.stream_title(F.col("title")).alias("s")).select("id", F.date_format("s.day", "yyyy-MM-dd").alias("day"), "s.body")


@query("metric_lines", "SELECT * FROM (VALUES ('up', 'api', 1.0::DOUBLE), ('lat_bucket', NULL, 5.0), ('lat_bucket', NULL, 18.0), ('lat_bucket', NULL, 20.0), ('temp', NULL, 36.6)) t(name, job, value)")
def metric_lines(spark, d):
    return landing.metric_lines(_literal(spark, content=METRICS), "content", []).select("name", F.col("labels")["job"].alias("job"), "value")


@query("caption_lines", "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 2.5::DOUBLE, 'HELLO >> ALL'), (1, 2.5, 4.0, 'SECOND LINE'), (2, 3600.0, 3601.0, 'THIRD')) t(pos, start, \"end\", text)")
def caption_lines(spark, d):
    return ps.parse_captions(_literal(spark, id=1, content=VTT), "id", "content").select("pos", "start", "end", "text")


@query("fixed_width_table", "SELECT * FROM (VALUES ('1', 'Roads Act', 'passed'), ('22', 'Water and Air', 'first')) t(Bill, Title, Status)")
def fixed_width_table(spark, d):
    return landing.fixed_width(_literal(spark, id=1, content=FIXED), "id", "content", ["Bill", "Title", "Status"]).select("Bill", "Title", "Status")


@query("report_blocks", "SELECT * FROM (VALUES (1::BIGINT, 'Bill 1 - Roads', '2024-02-03,2024-03-04'), (2, 'Bill 2 - Water', '')) t(block, title, dates)")
def report_blocks(spark, d):
    out = landing.report_blocks(_literal(spark, id=1, content=REPORT), "id", "content", r"^Bill \d+")
    return out.select("block", "title", F.array_join("dates", ",").alias("dates"))


@query("merge_stubs", "SELECT * FROM (VALUES (1, 20)) t(stub, member)")
def merge_stubs(spark, d):
    stubs = rows(spark, "stub int, surname string", (1, "Lee"), (2, "Roy"))
    said = rows(spark, "stub int, at timestamp", (1, "2019-02-01"), (1, "2019-05-01"), (2, "2019-01-01"), (2, "2022-01-01"))
    members = rows(spark, "surname string, member int, start timestamp, end timestamp", ("Lee", 20, "2019-01-01", "2020-01-01"), ("Lee", 21, "2019-03-01", None), ("Roy", 22, "2019-01-01", "2020-01-01"))
    return rs.merge_stubs(stubs, said, members, "stub", "surname", "at", "start", "end", "member")


@query("division_roster", "SELECT * FROM (VALUES (1, 30), (2, 31)) t(id, member)")
def division_roster(spark, d):
    names = rows(spark, "id int, key string, at timestamp", (1, "van dyke", "2019-02-01"), (2, "roy", "2020-01-01"), (3, "lee", "2019-02-01"))
    roster = rows(spark, "member int, name string, start timestamp, end timestamp", (30, "ann van dyke", "2019-01-01", None), (31, "bo roy", "2019-01-01", "2020-01-01"), (32, "cy lee", "2019-01-01", None), (33, "di lee", "2019-01-01", None))
    return rs.roster_by_keys(names, roster, "id", "key", "at", "name", "start", "end", "member")


@query("resolve_named_speakers", "SELECT * FROM (VALUES (1, 10, 0.85::DOUBLE), (2, 11, 0.8), (3, NULL, NULL), (4, 12, 0.8), (5, 10, 0.75), (6, NULL, NULL)) t(id, person, confidence)")
def resolve_named_speakers(spark, d):
    facts = rows(spark, "id int, first string, last string, at timestamp", (1, "Ann", "Lee", "2020-01-01"), (2, "B.", "Lee", "2020-01-01"), (3, "Zed", "Lee", "2020-01-01"), (4, None, "Roy", "2020-01-01"), (5, None, "Lee", "2019-06-01"), (6, None, "Lee", "2021-06-01"))
    people = rows(spark, "person int, first string, last string", (10, "Ann", "Lee"), (11, "Bo", "Lee"), (12, "Cy", "Roy"))
    terms = rows(spark, "person int, start timestamp, end timestamp", (10, "2019-01-01", "2020-01-01"), (11, "2020-01-01", None), (10, "2021-01-01", None))
    return rs.resolve_named(facts, people, terms, "id", "first", "last", "at")


@query("label_members", "SELECT * FROM (VALUES (1, 10), (2, 11), (3, 12), (5, 11), (8, 10)) t(id, member), (VALUES (0.85::DOUBLE)) c(confidence)")
def label_members(spark, d):
    """Labels in capitals: one in office, by riding, by initial; two of a riding, an office, no term and no label give none."""
    facts = rows(spark, "id int, label string, at date", (1, "HON. MR. DUPRÉ", "1990-01-01"), (2, "MR. WALLACE (Oak Bay – Gordon Head)", "1990-01-01"), (3, "MR. G.S. WALLACE", "1990-01-01"), (4, "MR. WALLACE (Premier)", "1990-01-01"), (5, "Mrs. A. Wallace (Minister of Mines)", "1990-01-01"), (6, "MR. WALLACE", "1990-01-01"), (7, "MR. DUPRÉ", "1995-01-01"), (8, "MR. DUPRE", "1994-12-31"), (9, "The Speaker", "1990-01-01"))
    terms = rows(spark, "member int, first string, last string, riding string, start date, end date", (10, "Luc", "Dupré", "Yale", "1980-01-01", "1995-01-01"), (11, "Ann", "Wallace", "Oak Bay-Gordon Head", "1980-01-01", None), (12, "George", "Wallace", "Yale", "1980-01-01", None), (13, "Bo", "Wallace", "Oak Bay-Gordon Head", "1970-01-01", "1980-01-01"))
    return rs.by_label(facts, terms, "id", "label", "at")


@query("middle_initials", "SELECT * FROM (VALUES (1, 20), (2, 21), (5, 20), (6, 22)) t(id, member), (VALUES (0.85::DOUBLE)) c(confidence)")
def middle_initials(spark, d):
    """Two members of one name told apart by their middle initials."""
    facts = rows(spark, "id int, full string, surname string, at date", (1, "Mr. David S. Cole", "Cole", "1988-01-01"), (2, "David R. Cole", "Cole", "1988-01-01"), (3, "Hon. David Cole", "Cole", "1988-01-01"), (4, "D. R. Cole", "Cole", "1995-01-01"), (5, "D. S. Cole", "COLE", "1975-01-01"), (6, "Ann M. Roy", "Roy", "1988-01-01"))
    members = rows(spark, "member int, name string, first string, last string, start date, end date", (20, "Dave S. Cole", "Dave", "Cole", None, "1997-01-01"), (21, "David R. Cole", "David", "Cole", "1985-01-01", "1990-01-01"), (22, "Ann Marie St. Roy", "Ann", "St. Roy", "1980-01-01", None), (23, "Dave Cole", "Dave", "Cole", "1980-01-01", None))
    return rs.by_middle_initial(facts, members, "id", "full", "surname", "at")


@pytest.mark.parametrize("name", CASES)
def test_literal(spark, name):
    f, expected = CASES[name]
    want = duckdb.sql(expected)
    got = f(spark, None)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_html_text_of_unclosed_references(spark, tmp_path):
    """The query on pages whose escaped titles were cut within a reference, beside its SQL."""
    from tessera import catalog

    pages = rows(spark, "page_id long, url string, html string", (1, "u", "<title>a &amp;&amp;&amp</title><p>b &lt c &lt; d</p>"), (2, "u", "x &am &#39 &#39; &copy 2 &amp;lt; &"), (3, "u", ""), (4, "u", None))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(catalog.ORACLES["html_text"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["html_text"](spark, str(tmp_path)).collect())) == sorted(want)
