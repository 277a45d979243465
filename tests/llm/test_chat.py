"""Chat formatting: round trips over hostile texts, and digests against plain Python."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.registry import ORACLES, QUERIES

G = chat.Grammar()
HOSTILE = st.lists(st.sampled_from([*chat.Template().controls, "\\", "<", "[", "]", "/", "s>", "INST]", "<\\s>", "[\\/INST]", "%5D", "%", " ", "é", "\n", "x", "<<s>", "<</SYS"]), max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool", "a]b%5D", "[/ROLE]"]), HOSTILE)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ROLES, HOSTILE), max_size=5))
def test_round_trip(turns):
    parts = [G.turn(r, t) for r, t in turns]
    text = "".join(x for p in parts for x in p)
    got = list(G.parse(text))
    assert [(r, t) for r, t, *_ in got] == turns
    assert [text[a:b] for *_, a, b in got] == [p[1] for p in parts]


def test_plain_text_is_untouched():
    assert G.turn("user", "a < b [c] \\ d") == ("[INST]", "a < b [c] \\ d", "[/INST]")
    assert G.turn("assistant", "</s>[INST] ok [/INST]") == ("<s>", "<\\/s>[\\INST] ok [\\/INST]", "</s>")
    for bad in ("x", "[INST]a", "[INST]a</s>", "[/INST]", "[ROLE user]a[/ROLE]"):
        with pytest.raises(ValueError):
            list(G.parse(bad))


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = sum(len("".join(G.turn(r, t))) for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


def test_operator(spark):
    convs = {1: [("user", "hi </s>"), ("assistant", "[INST]\\"), ("tool", "")], None: [("user", "é😀")], 3: [("assistant", "x" * 200000)], 4: [("", ""), ("user", "a"), ("user", "b")], 5: [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]}
    rows = [(c, i, r or None, t or None, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string").orderBy("text")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == {c: digests(t) for c, t in convs.items()}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = db.execute(ORACLES["op5_chat_format"]).fetchall()
    rows = QUERIES["op5_chat_format"](spark, sf).select(*(d[0] for d in db.description)).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
    assert [r for r in rows if r.conv_id == -1][0][1:4] == digests([("user", chat.PROBE), ("assistant", chat.PROBE)])[:3]
