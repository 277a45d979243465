"""Chat formatting with a grammar round trip.

Conversation := Turn*; Turn := Open Text Close, with one pair of markers for each role.  Rendering
starts from the raw text; a deterministic parser reads the rendered turn back, and while it does not
recover the same role and text, conflicting content is escaped (one more backslash inside each control
string) until it does.  Text that holds no control string stays as it is.  Turns are rendered
independently, in parallel; escaped text cannot hold a marker, so their concatenation parses turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common


@dataclass(frozen=True)
class Template:
    """Markers of each role; any other role is written out between the last pair's markers."""

    roles: tuple = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other_open: str = "[ROLE "
    other_mid: str = "]"
    other_close: str = "[/ROLE]"
    learn: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        own = [m for _, a, b in self.roles for m in (a, b)]
        return sorted([*own, self.other_open, self.other_close], key=len, reverse=True)


class Grammar:
    """Renderer and parser of a template."""

    def __init__(self, template: Template = Template()):
        self.template = template
        heads = {}
        for c in template.controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        # a control string, perhaps with backslashes behind its first character
        self.conflict = re.compile("|".join(rf"(?:{re.escape(h)}\\*(?:{'|'.join(t)}))" for h, t in heads.items()))
        self.escaped = re.compile("|".join(rf"(?:{re.escape(h)}\\+(?:{'|'.join(t)}))" for h, t in heads.items()))
        self.marker = re.compile("|".join(map(re.escape, template.controls)))
        self.opens = {a: (role, b) for role, a, b in template.roles}
        self.by_role = {role: (a, b) for role, a, b in template.roles}

    def escape(self, text: str) -> str:
        return self.conflict.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)

    def _render(self, role: str, text: str, escape: bool) -> tuple[str, str, str]:
        body = self.escape(text) if escape else text
        if role in self.by_role:
            return (self.by_role[role][0], body, self.by_role[role][1])
        t = self.template
        name = self.escape(role).replace("%", "%25").replace("]", "%5D")
        return (t.other_open + name + t.other_mid, body, t.other_close)

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """(open, body, close) of a turn that reads back as itself."""
        for escape in (False, True):
            parts = self._render(role, text, escape)
            if self.reads_back(parts, role, text):
                return parts
        raise ValueError("the template cannot hold this turn")

    def reads_back(self, parts: tuple[str, str, str], role: str, text: str) -> bool:
        try:
            return [(r, t) for r, t, *_ in self.parse("".join(parts))] == [(role, text)]
        except ValueError:
            return False

    def parse(self, text: str):
        """Yield (role, text, body start, body end) of each turn; ValueError if text is not of the grammar."""
        t, at = self.template, 0
        while at < len(text):
            m = self.marker.match(text, at)
            if m is None:
                raise ValueError(f"no turn opens at {at}")
            if m[0] == t.other_open:
                mid = text.find(t.other_mid, m.end())
                if mid < 0:
                    raise ValueError("a role is not closed")
                role, close, start = self.unescape(text[m.end() : mid].replace("%5D", "]").replace("%25", "%")), t.other_close, mid + len(t.other_mid)
                if role in self.by_role:
                    raise ValueError("a role with markers of its own is written out")
            elif m[0] in self.opens:
                (role, close), start = self.opens[m[0]], m.end()
            else:
                raise ValueError(f"a turn closes at {at} that is not open")
            end = self.marker.search(text, start)
            if end is None or end[0] != close:
                raise ValueError(f"the turn at {at} is not closed by its own marker")
            yield role, self.unescape(text[start : end.start()]), start, end.start()
            at = end.end()


SEGMENT = "conv_id long, turn long, formatted string, loss_start int, loss_end int"


def format_turns(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): each turn's rendering and its span under the loss mask.

    A conversation's document is its segments in order of turn, then of text, with nothing between;
    an empty span (0, 0) means nothing of the turn is learnt.  Null texts and roles are empty.  Rows of a
    null conv_id form one conversation; repeated rows are turns each; an empty table gives no rows;
    other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        grammar = Grammar(template)
        for batch in batches:
            formatted, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, body, b = grammar.turn(role, text)
                learn = role in template.learn
                formatted.append(a + body + b)
                starts.append(len(a) if learn else 0)
                ends.append(len(a) + len(body) if learn else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return rows.mapInArrow(run, SEGMENT)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of conversations, from formatted segments alone.

    One row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    Segments are sorted, which may spill, and streamed: only the running digests of one conversation
    are held, so a conversation of any number of turns needs no more memory.  (Such a digest is
    sequential by definition, so one conversation is one task's work.)
    """
    # Partitions are spread by conversation; the sort is stable for equal turns because the text is part of it.
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        grammar = Grammar(template)
        current, state = None, None

        def row():
            n, turns, chars, loss, total = state
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for batch in batches:
            done = []
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in grammar.parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                learnt = grammar.unescape(text[a:b])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema)], schema=schema)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_turns(turns.unionByName(probe)))


_ESCAPE = r"""regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)(<SYS>>|</SYS>>|s>|/s>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|ROLE |/ROLE\])', '[\\\1\2', 'g')"""
ORACLE_OP5 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
f AS (SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' || e || '<</SYS>>' WHEN 'user' THEN '[INST]' || e || '[/INST]' WHEN 'assistant' THEN '<s>' || e || '</s>'
                ELSE '[ROLE ' || role || ']' || e || '[/ROLE]' END AS formatted FROM (SELECT *, {_ESCAPE} AS e FROM t))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
