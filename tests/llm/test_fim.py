"""Fill-in-middle against slices of lists of units."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim
from tessera.llm.registry import ORACLES, QUERIES

TEXTS = ["", None, "a", "two words", "é😀́ mixed\n\r\n\x00 text" * 7, "has <P> inside", "<S", "S>", "ends <", "<P<S<M" * 9, "x" * 300_000, "tail <S", "P>" * 5]


def rows(spark):
    data = [(i, t, 5, "y") for i, t in enumerate(TEXTS * 6)] + [(None, "no id here", 1, "z"), (3, TEXTS[3], 5, "y")]
    return spark.createDataFrame(data, "doc_id long, text string, `a.b` int, `_tz_id` string")


def brute(key, text, pattern, rule=fim.Rule()):
    h = hashlib.sha256(f"{rule.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    ends = [0, *(m.end() for m in re.finditer(pattern, text))]
    n = len(ends) - 1
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rule.plain_from:
        return text, "plain", n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    return (f"<S>{s}<P>{p}<M>{m}", "spm", n, a, b - a) if h4 % 100 < rule.spm_below else (f"<P>{p}<S>{s}<M>{m}", "psm", n, a, b - a)


@pytest.mark.parametrize("pattern", [fim.CODE_POINT, r"\S+", r"(?s:.)(?:́)?", "never"])
def test_brute(spark, pattern):
    docs = rows(spark).withColumn("gap", F.expr("make_interval(1)"))
    out = fim.transform(docs, pattern=pattern)
    assert out.columns == [*docs.columns, "fim"]
    got = out.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).drop("gap").collect()
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r.fim) == brute(r.doc_id, r.text, pattern) and r.back == (r.text or "")
        assert (r["a.b"], r["_tz_id"]) in ((5, "y"), (1, "z"))
    assert fim.transform(docs.limit(0)).count() == 0


def test_seams():
    rng, marks = random.Random(3), fim.Sentinels()
    for _ in range(3000):
        text = "".join(rng.choices("<PSM>", k=rng.randint(1, 9)))
        if not re.search("<[PSM]>", text):
            for form in (fim.PSM, fim.SPM):
                a, b = sorted(rng.choices(range(len(text) + 1), k=2))
                assert len(re.findall("<[PSM]>", fim.arranged(text, form, a, b, marks))) == 3
    for bad in (("<P>", "<P>S", "<M>"), ("aa", "<S>", "<M>"), ("<P", "P<", "<M>"), ("", "a", "b"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*bad).checked()


def test_query(spark):
    got = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(ORACLES["op12_fill_in_middle"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
