"""Text functions over whole tables: inputs are built from keys and columns, as a source would write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import passages as ps
from tessera.operators import resolve as rs
from tessera.registry import query
from tessera.sources import landing
from tessera.sources.tables import Tables


def word(n: Column) -> Column:
    """A word of three letters or more for a number."""
    return F.translate((n + 100).cast("string"), "0123456789", "abcdefghij")


_W = "translate(({} + 100)::VARCHAR, '0123456789', 'abcdefghij')"
_k, _o = lambda: F.col("c_custkey"), lambda: F.col("o_orderkey")
_w, _cap = lambda: word(_k()), lambda: F.initcap(word(_k()))
_day = lambda: F.date_format("o_orderdate", "yyyy-MM-dd")
_SQL = _W.format("c_custkey")
_CAP = f"upper({_SQL}[1:1]) || {_SQL}[2:]"


def _by_thirds(*forms) -> Column:
    out = None
    for i, form in enumerate(forms):
        out = F.when(F.pmod(_k(), F.lit(len(forms))) == i, form) if out is None else out.when(F.pmod(_k(), F.lit(len(forms))) == i, form)
    return out


def _customers(spark, d, *forms):
    """(id, raw): each customer's row in one of the forms, by turns."""
    return Tables(spark, d).customer.select(_k().alias("id"), _by_thirds(*forms).alias("raw"), "c_mktsegment", "c_acctbal")


_cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("norm_names", f"SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'jose ' || {_SQL} WHEN 1 THEN 'ann o ' || {_SQL} ELSE {_SQL} END AS name FROM customer")
def norm_names(spark, d):
    return _customers(spark, d, _cat("Hon. José  ", F.upper(_w())), _cat("the Right Hon. Ann O'", _w()), _cat(" ", _cap(), ". ")).select("id", tx.norm_name(F.col("raw")).alias("name"))


@query("attributions", f"SELECT c_custkey AS id, {_CAP} AS name, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 2 THEN 'East, ' || c_mktsegment END AS riding, CASE c_custkey % 3 WHEN 0 THEN 'Green' WHEN 2 THEN 'NDP' END AS party FROM customer")
def attributions(spark, d):
    r = _customers(spark, d, _cat(_cap(), " (", F.col("c_mktsegment"), ", Green)"), _cap(), _cat(_cap(), " (East, ", F.col("c_mktsegment"), ", NDP)"))
    return r.select("id", tx.attribution(F.col("raw")).alias("a")).select("id", "a.*")


@query("speaker_labels", f"SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Mr' WHEN 3 THEN 'Hon' END AS honorific, CASE c_custkey % 4 WHEN 1 THEN 'Ann' WHEN 3 THEN 'É.' END AS first, CASE WHEN c_custkey % 4 <> 2 THEN {_CAP} END AS last FROM customer")
def speaker_labels(spark, d):
    r = _customers(spark, d, _cat("Mr. ", _cap(), ":"), _cat("Ann ", _cap(), " (York):"), F.lit("The Speaker:"), _cat("Hon. É. ", _cap()))
    return r.select("id", tx.speaker_label(F.col("raw")).alias("s")).select("id", "s.honorific", "s.first", "s.last")


@query("postal_codes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 < 2 THEN 'K' || c_custkey % 10 || 'A ' || c_custkey % 7 || 'B' || c_custkey % 9 END AS postcode, CASE WHEN c_custkey % 3 < 2 THEN 'K' || c_custkey % 10 || 'A' END AS fsa FROM customer")
def postal_codes(spark, d):
    n = lambda m: (_k() % m).cast("string")
    r = _customers(spark, d, _cat(_w(), " St, Ottawa ON k", n(10), "a", n(7), "b", n(9), " Canada"), _cat("K", n(10), "A-", n(7), "B", n(9)), _cat("no code D", n(10), "A ", n(7), "B", n(9)))
    return r.select("id", tx.postal(F.col("raw")).alias("p")).select("id", "p.*")


@query("postal_addresses", f"""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 2 THEN {_CAP} || ' Hall, ' || c_custkey || ' Main St' WHEN 3 THEN c_custkey || ' Main St, ' || {_CAP} ELSE c_custkey || ' Main St' END AS address,
CASE WHEN c_custkey % 4 < 3 THEN {_CAP} END AS city, CASE c_custkey % 4 WHEN 0 THEN 'AB' WHEN 2 THEN 'QC' END AS province, CASE WHEN c_custkey % 4 < 2 THEN 'K' || c_custkey % 10 || 'A ' || c_custkey % 7 || 'B' || c_custkey % 9 END AS postcode FROM customer""")
def postal_addresses(spark, d):
    """City, province and postcode on the last line; postcode on a line of its own; no postcode; neither."""
    n = lambda m: (_k() % m).cast("string")
    street, code = _cat(_k().cast("string"), " Main St"), _cat("k", n(10), "a", n(7), "B", n(9))
    forms = _cat(street, ",\n\n", _cap(), ", AB  ", code), _cat(street, ", ", _cap(), ", ", code), _cat(_cap(), " Hall\n", street, ", ", _cap(), ", QC Canada"), _cat(street, "\n", _cap())
    return _customers(spark, d, *forms).select("id", tx.postal_address(F.col("raw")).alias("a")).select("id", "a.*")


@query("social_profiles", f"SELECT c_custkey AS id, ['twitter', 'facebook', 'youtube', NULL, 'bluesky'][c_custkey % 5 + 1] AS platform, CASE c_custkey % 5 WHEN 3 THEN NULL WHEN 4 THEN {_SQL} || '.bsky.social' ELSE {_SQL} END AS handle FROM customer")
def social_profiles(spark, d):
    r = _customers(spark, d, _cat("https://X.com/@", _cap(), "?s=1"), _cat("http://m.facebook.com/", _w(), "/"), _cat("https://www.youtube.com/@", _w()), _cat("https://example.com/", _w()), _cat("https://bsky.app/profile/", _w(), ".bsky.social"))
    return r.select("id", tx.canonical_social(F.col("raw")).alias("s")).select("id", "s.platform", "s.handle")


@query("truecased", f"SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Thank you ' || {_SQL} || '. We agree.' WHEN 1 THEN 'Mixed Case STAYS ' || {_SQL} ELSE 'The member ' || {_SQL} || ' asked Ottawa, (Mr. X).' END AS line FROM customer")
def truecased(spark, d):
    lines = _customers(spark, d, _cat("THANK YOU ", F.upper(_w()), ". WE AGREE."), _cat("Mixed Case STAYS ", _w()), _cat("THE MEMBER ", F.upper(_w()), " ASKED OTTAWA, (MR. X)."))
    return lines.select("id", tx.truecase(F.col("raw"), ["Ottawa", "Mr", "X"]).alias("line"))


_OSQL = _W.format("o_orderkey")


@query("body_titles", f"SELECT o_orderkey, {_OSQL} || 'affairs' AS body, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def body_titles(spark, d):
    o = Tables(spark, d).orders
    raw = F.when(_o() % 2 == 0, _cat("Standing Committee on ", F.initcap(word(_o())), " Affairs")).otherwise(_cat("council of the ", word(_o()), "-affairs"))
    title = F.when(_o() % 5 > 0, _cat("Meeting ", _day(), " part 1")).otherwise("no date")
    return o.select("o_orderkey", tx.squash_body(raw).alias("body"), F.date_format(tx.title_date(title), "yyyy-MM-dd").alias("day"))


@query("stream_titles", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 < 3 THEN 'City Council - ' || {_OSQL} END AS body FROM orders")
def stream_titles(spark, d):
    at = F.col("o_orderdate")
    form = F.when(_o() % 4 == 0, F.date_format(at, "MMMM d, yyyy")).when(_o() % 4 == 1, F.date_format(at, "MMM. d yyyy")).when(_o() % 4 == 2, F.date_format(at, "MMMM dd yyyy")).otherwise("Julember 7, 2026")
    r = Tables(spark, d).orders.select("o_orderkey", tx.stream_title(_cat(form, " – City Council - ", word(_o()), " ")).alias("s"))
    return r.select("o_orderkey", F.date_format("s.day", "yyyy-MM-dd").alias("day"), "s.body")


@query("vote_passages", "SELECT o_orderkey, ['passed', 'failed', NULL][o_orderkey % 3 + 1] AS outcome, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 150)::INTEGER END AS ayes, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 77)::INTEGER END AS nays, CASE o_orderkey % 3 WHEN 0 THEN 'C-' || o_orderkey % 997 WHEN 2 THEN (o_orderkey % 9000)::VARCHAR END AS bill FROM orders")
def vote_passages(spark, d):
    n = lambda m: (_o() % m).cast("string")
    raw = F.when(_o() % 3 == 0, _cat("The motion was defeated. Correction: the motion on Bill C-", n(997), " is carried. Ayes: ", n(150), " Nays: ", n(77))).when(_o() % 3 == 1, _cat("[Motion by ", word(_o()), " lost]")).otherwise(_cat("Bill ", n(9000), " was read."))
    return Tables(spark, d).orders.select("o_orderkey", tx.votes_in(raw).alias("v")).select("o_orderkey", "v.*")


@query("section_types", "SELECT o_orderkey, ['question_period', 'debate', 'statement'][o_orderkey % 3 + 1] AS kind FROM orders")
def section_types(spark, d):
    raw = F.when(_o() % 3 == 0, _cat("Oral Questions ", word(_o()))).when(_o() % 3 == 1, _cat(word(_o()), ", Second Reading")).otherwise("Members' STATEMENTS")
    return Tables(spark, d).orders.select("o_orderkey", tx.speech_type(raw, {"question": "question_period", "statement": "statement"}).alias("kind"))


@query("first_name_relations", "SELECT c_custkey AS id, ['high', 'medium', 'low', 'high'][c_custkey % 4 + 1] AS relation FROM customer")
def first_name_relations(spark, d):
    other = _customers(spark, d, F.lit("Robert"), _w(), _cat("y", _w()), F.upper(_cat("zoe", _w()))).withColumnRenamed("raw", "b")
    a = _by_thirds(F.lit("Bob"), F.left(_w(), F.lit(1)), _cat("x", _w()), _cat("Zoé", _w()))
    return other.withColumn("c_custkey", F.col("id")).select("id", tx.first_name_relation(a, F.col("b"), {"bob": "robert", "bill": "william"}).alias("relation"))


@query("sequence_ratios", f"SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 * length({_SQL}) / (2 * length({_SQL}) + 4) WHEN 2 THEN 0.0 END::DOUBLE AS ratio FROM customer")
def sequence_ratios(spark, d):
    r = _customers(spark, d, _w(), _cat(_w(), "yy"), F.lit("zzz"), _w()).withColumn("c_custkey", F.col("id"))
    return r.select("id", tx.sequence_ratio(_by_thirds(_w(), _cat("zz", _w()), _w(), F.lit(None).cast("string")), F.col("raw")).alias("ratio"))


@query("nfkc_hash", "SELECT sha256('file 2 ' || o_orderkey % 50) AS digest, count(*) AS n FROM orders GROUP BY 1")
def nfkc_hash(spark, d):
    raw = _cat(F.when(_o() % 2 == 0, "ﬁle  ② ").otherwise("FILE 2 "), (_o() % 50).cast("string"))
    return Tables(spark, d).orders.select(tx.content_hash(tx.nfkc(raw)).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


@query("metric_lines", "SELECT c_custkey AS id, 'up' AS name, c_mktsegment AS job, c_custkey::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'lat_bucket', NULL, (c_custkey % 13)::DOUBLE FROM customer UNION ALL SELECT c_custkey, 'temp', NULL, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def metric_lines(spark, d):
    n = _k().cast("string")
    content = _cat('# HELP up x\nup{job="', F.col("c_mktsegment"), '",host="a"} ', n, '\nlat_bucket{le="0.1"} ', (_k() % 13).cast("string"), "\nbad line\n\ntemp ", F.coalesce(F.col("c_acctbal").cast("string"), F.lit("none")), "\n")
    return landing.metric_lines(Tables(spark, d).customer.select(_k().alias("id"), content.alias("content")), "content", ["id"]).select("id", "name", F.col("labels")["job"].alias("job"), "value")


@query("caption_lines", f"SELECT c_custkey AS id, 0 AS pos, (c_custkey % 60)::DOUBLE AS start, (c_custkey % 60 + 60.5)::DOUBLE AS \"end\", 'HELLO >> ' || upper({_SQL}) AS text FROM customer UNION ALL SELECT c_custkey, 1, (c_custkey % 60 + 60.5)::DOUBLE, 7200.0, 'SECOND LINE' FROM customer")
def caption_lines(spark, d):
    second = F.lpad((_k() % 60).cast("string"), 2, "0")
    hello = _cat("HELLO &gt;&gt; ", F.upper(_w()))
    content = _cat("WEBVTT\n\n00:00:", second, ".000 --> 00:01:", second, ".500\n", hello, "\n\n00:01:", second, ".500 --> 2:00:00.000\n", hello, "\n<c>SECOND</c> LINE\n")
    return ps.parse_captions(Tables(spark, d).customer.select(_k().alias("id"), content.alias("content")), "id", "content")


@query("fixed_width_table", f"SELECT c_custkey AS id, c_custkey::VARCHAR AS Bill, {_CAP} || ' Act' AS Title, c_mktsegment AS Status FROM customer UNION ALL SELECT c_custkey, '22', 'Water and Air', 'first' FROM customer")
def fixed_width_table(spark, d):
    content = _cat("Bill      Title            Status\n", F.rpad(_k().cast("string"), 10, " "), F.rpad(_cat(_cap(), " Act"), 17, " "), F.col("c_mktsegment"), "\n22        Water and Air    first\n\n")
    return landing.fixed_width(Tables(spark, d).customer.select(_k().alias("id"), content.alias("content")), "id", "content", ["Bill", "Title", "Status"]).select("id", "Bill", "Title", "Status")


@query("report_blocks", "SELECT o_orderkey, 1::BIGINT AS block, 'Bill ' || o_orderkey || ' - Roads' AS title, strftime(o_orderdate, '%Y-%m-%d') || ',2024-03-04' AS dates FROM orders UNION ALL SELECT o_orderkey, 2, 'Bill 2 - Water', '' FROM orders")
def report_blocks(spark, d):
    content = _cat("intro\nBill ", _o().cast("string"), " - Roads\nread ", _day(), "\nagain 2024-03-04\nBill 2 - Water\nno date\n")
    out = landing.report_blocks(Tables(spark, d).orders.select("o_orderkey", content.alias("content")), "o_orderkey", "content", r"^Bill \d+")
    return out.select("o_orderkey", "block", "title", F.array_join("dates", ",").alias("dates"))


@query("motion_movers", """
WITH r AS (SELECT s_suppkey % 5 AS city, s_suppkey % 47 AS n, s_suppkey AS member FROM supplier)
SELECT o_orderkey AS id, min(member) AS member FROM orders JOIN r ON city = o_custkey % 5 AND n = o_orderkey % 47 WHERE o_orderkey % 6 > 0 GROUP BY 1 HAVING count(DISTINCT member) = 1""")
def motion_movers(spark, d):
    t = Tables(spark, d)
    name = F.when(_o() % 6 == 0, F.lit(None)).when(_o() % 3 == 0, _cat("Councillor ", F.upper(word(_o() % 47)))).when(_o() % 3 == 1, _cat("Mayor ", F.initcap(word(_o() % 47)), ",")).otherwise(word(_o() % 47))
    roster = t.supplier.select((F.col("s_suppkey") % 5).alias("city"), F.col("s_suppkey").alias("member"), F.initcap(word(F.col("s_suppkey") % 47)).alias("surname"))
    return rs.by_surname(t.orders.select(_o().alias("id"), (F.col("o_custkey") % 5).alias("city"), name.alias("name")), roster, "id", "name", ["city"])


# -- resolvers: suppliers are members with overlapping terms, orders are what is said on their days --


def _w_sql(n: str) -> str:
    return _W.format(n)


_MEMBERS = f"""
WITH m AS (SELECT s_suppkey AS member, {_w_sql('s_suppkey * 7 % 90')} AS first, {_w_sql('s_suppkey % 41')} AS last, 'Oak ' || s_suppkey % 3 AS riding, translate((s_suppkey % 10)::VARCHAR, '0123456789', 'abcdefghij') AS middle,
make_timestamp(1992 + s_suppkey % 5, 1, 1, 0, 0, 0.0) AS "start", CASE WHEN s_suppkey % 4 > 0 THEN make_timestamp(1994 + s_suppkey % 5 + s_suppkey % 3, 1, 1, 0, 0, 0.0) END AS "end" FROM supplier),
f AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS day, {_w_sql('o_orderkey % 43')} AS last, {_w_sql('o_orderkey % 90')} AS first FROM orders)"""


def _members(spark, d):
    n, year = F.col("s_suppkey"), lambda y: F.make_timestamp(y.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return Tables(spark, d).supplier.select(
        n.alias("member"), word(n * 7 % 90).alias("first"), word(n % 41).alias("last"), _cat("Oak ", (n % 3).cast("string")).alias("riding"), F.translate((n % 10).cast("string"), "0123456789", "abcdefghij").alias("middle"),
        year(1992 + n % 5).alias("start"), F.when(n % 4 > 0, year(1994 + n % 5 + n % 3)).alias("end"),
    )


def _said(spark, d):
    return Tables(spark, d).orders.select(_o().alias("id"), "o_custkey", F.col("o_orderdate").alias("at"), word(_o() % 43).alias("last"), word(_o() % 90).alias("first"))


@query("merge_stubs", f"""{_MEMBERS}, spans AS (SELECT o_custkey AS stub, min(day) AS a, max(day) AS b FROM f WHERE id % 4 = 0 GROUP BY 1)
SELECT stub, min(member) AS member FROM spans JOIN m ON m.last = {_w_sql('stub % 43')} AND "start" <= a AND ("end" IS NULL OR b < "end") GROUP BY stub HAVING count(DISTINCT member) = 1""")
def merge_stubs(spark, d):
    stubs = Tables(spark, d).customer.select(_k().alias("stub"), word(_k() % 43).alias("last"))
    said = _said(spark, d).where("id % 4 = 0").select(F.col("o_custkey").alias("stub"), "at")
    return rs.merge_stubs(stubs, said, _members(spark, d), "stub", "last", "at", "start", "end", "member")


@query("division_roster", f"""{_MEMBERS}, k AS (SELECT member, "start", "end", unnest([last, 'van ' || last, first || ' van ' || last]) AS key FROM m),
asked AS (SELECT id, day, CASE id % 3 WHEN 0 THEN last WHEN 1 THEN 'van ' || last ELSE first || ' van ' || last END AS key FROM f)
SELECT id, min(member) AS member FROM asked JOIN k USING (key) WHERE "start" <= day AND ("end" IS NULL OR day <= "end") GROUP BY id HAVING count(DISTINCT member) = 1""")
def division_roster(spark, d):
    full = lambda: F.concat_ws(" van ", "first", "last")
    key = F.when(F.col("id") % 3 == 0, F.col("last")).when(F.col("id") % 3 == 1, _cat("van ", F.col("last"))).otherwise(full())
    roster = _members(spark, d).select("member", full().alias("name"), "start", "end")
    return rs.roster_by_keys(_said(spark, d).select("id", key.alias("key"), "at"), roster, "id", "key", "at", "name", "start", "end", "member")


@query("resolve_named_speakers", f"""{_MEMBERS}, asked AS (SELECT id, day, last, CASE id % 3 WHEN 0 THEN first WHEN 1 THEN first[1:1] END AS first FROM f),
one AS (SELECT first, last, min(member) AS p FROM m GROUP BY ALL HAVING count(DISTINCT member) = 1), two AS (SELECT first[1:1] AS i, last, min(member) AS p FROM m GROUP BY ALL HAVING count(DISTINCT member) = 1),
three AS (SELECT last, min(member) AS p FROM m GROUP BY ALL HAVING count(DISTINCT member) = 1),
four AS (SELECT id, min(member) AS p FROM asked JOIN m USING (last) WHERE "start" <= day AND ("end" IS NULL OR day < "end") GROUP BY id HAVING count(DISTINCT member) = 1)
SELECT id, coalesce(one.p, two.p, CASE WHEN a.first IS NULL THEN coalesce(three.p, four.p) END) AS person,
CASE WHEN one.p IS NOT NULL THEN 0.85 WHEN two.p IS NOT NULL THEN 0.8 WHEN a.first IS NULL AND three.p IS NOT NULL THEN 0.8 WHEN a.first IS NULL AND four.p IS NOT NULL THEN 0.75 END::DOUBLE AS confidence
FROM asked a LEFT JOIN one USING (first, last) LEFT JOIN two ON two.i = a.first[1:1] AND two.last = a.last LEFT JOIN three ON three.last = a.last LEFT JOIN four USING (id)""")
def resolve_named_speakers(spark, d):
    first = F.when(F.col("id") % 3 == 0, F.initcap("first")).when(F.col("id") % 3 == 1, _cat(F.upper(F.left("first", F.lit(1))), "."))
    facts = _said(spark, d).select("id", first.alias("first"), F.upper("last").alias("last"), "at")
    people = _members(spark, d).withColumnRenamed("member", "person")
    return rs.resolve_named(facts, people.select("person", "first", "last"), people.select("person", "start", "end"), "id", "first", "last", "at")


@query("label_members", f"""{_MEMBERS}, held AS (SELECT id, member, id % 4 AS form, m.riding = 'Oak ' || id % 3 AS here, m.first[1:1] = f.first[1:1] AS same FROM f JOIN m USING (last) WHERE "start" <= day AND ("end" IS NULL OR day < "end")),
c AS (SELECT id, form, count(DISTINCT member) AS n, min(member) AS p, count(DISTINCT member) FILTER (here AND form = 1) AS nr, min(member) FILTER (here AND form = 1) AS pr, count(DISTINCT member) FILTER (same AND form = 2) AS ni, min(member) FILTER (same AND form = 2) AS pi FROM held GROUP BY ALL)
SELECT id, CASE WHEN n = 1 THEN p WHEN nr = 1 THEN pr WHEN ni = 1 THEN pi END AS member, 0.85::DOUBLE AS confidence FROM c WHERE n = 1 OR nr = 1 OR ni = 1""")
def label_members(spark, d):
    name, form = F.upper("last"), F.col("id") % 4
    label = F.when(form == 0, _cat("MR. ", name)).when(form == 1, _cat("Hon. Mrs. ", name, " (OAK  ", (F.col("id") % 3).cast("string"), ")")).when(form == 2, _cat("MR. ", F.upper(F.left("first", F.lit(1))), ". ", name)).otherwise(_cat("HON. MR. ", name, " (Minister of Mines)"))
    return rs.by_label(_said(spark, d).select("id", label.alias("label"), "at"), _members(spark, d), "id", "label", "at")


@query("middle_initials", f"""{_MEMBERS}
SELECT id, min(member) AS member, 0.85::DOUBLE AS confidence FROM f JOIN m ON m.last = f.last AND middle = translate((id % 10)::VARCHAR, '0123456789', 'abcdefghij')
WHERE "start" <= day AND ("end" IS NULL OR day <= "end") AND id % 3 > 0 GROUP BY id HAVING count(DISTINCT member) = 1""")
def middle_initials(spark, d):
    members = _members(spark, d).withColumn("name", _cat(F.col("first"), " ", F.upper("middle"), ". ", F.col("last"))).select("member", "name", "first", "last", "start", "end")
    initial = F.upper(F.translate((F.col("id") % 10).cast("string"), "0123456789", "abcdefghij"))
    full = F.when(F.col("id") % 3 == 0, _cat("Hon. ", F.col("first"), " ", F.col("last"))).otherwise(_cat("Mr. David ", initial, ". ", F.col("last")))
    facts = _said(spark, d).withColumn("full", full)
    return rs.by_middle_initial(facts, members, "id", "full", "last", "at")
