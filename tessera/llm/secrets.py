"""Secret scanning: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

An automaton over all keywords reads each text once.  An expression is tried only where its keyword
starts (a long run of hexadecimal digits has no keyword: every eighth character is sampled, and only
spots where four samples in a row are such digits are looked at).  Candidates of kinds that embed a
checksum or a structure must pass it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

# Kinds in order of rank.  The first three are the base kinds; the others are public token formats.
KINDS = ("assign", "access", "hex", "checked_token", "jwt", "private_key", "service_key", "url_password")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
PRIVATE = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
PRIVATE_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
SERVICE = re.compile(r"(?:sk_live_[0-9A-Za-z]{16,}|rk_live_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|glpat-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])")
URL_PASSWORD = re.compile(r"://([^\s:/@?#]{1,64}):([^\s:/@?#]{3,128})@")

KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "checked_token"),
    "eyj": "jwt",
    "-----begin ": "private_key",
    "-----end ": "private_end",
    **dict.fromkeys(("sk_live_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "glpat-", "aiza"), "service_key"),
    "://": "url_password",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN, STRIDE = 32, 8
_HEX_SAMPLES = re.compile(rf"[0-9a-f]{{{HEX_RUN // STRIDE},}}")
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def base62_crc(body: str) -> str:
    """Six base-62 digits of the body's CRC-32, as such tokens end."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, nothing else, so positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _hex_starts(text: str):
    """Starts of runs that may have HEX_RUN digits, ascending: such a run holds four samples in a row."""
    last = -1
    for m in _HEX_SAMPLES.finditer(text[STRIDE - 1 :: STRIDE]):
        for at in range(STRIDE * m.start() + STRIDE - 1, STRIDE * m.end(), STRIDE):  # neighbouring samples may lie in different runs
            if at > last:
                while at and text[at - 1] in "0123456789abcdef":
                    at -= 1
                last = HEX.match(text, at).end()
                yield at


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed; end exclusive, in code points."""
    hits: dict[str, list[int]] = {}
    for end, (n, kind) in automaton().iter(lower_ascii(text)):
        hits.setdefault(kind, []).append(end - n + 1)
    for starts in hits.values():
        starts.sort()
    spans = []
    ends: dict[str, list[int]] = {}  # label -> ends of its closing markers, ascending
    for at in hits.get("private_end", ()):
        if m := PRIVATE_END.match(text, at):
            ends.setdefault(m[1], []).append(m.end())

    def private_end(m: re.Match) -> int:
        """The end of the first closing marker that begins behind the opening one."""
        there = ends.get(m[1], ())
        i = bisect_left(there, m.end() + len(m[1]) + 14)
        return there[i] if i < len(there) else 0

    def walk(kind: str, pattern: re.Pattern, good, run: re.Pattern | None = None) -> None:
        """Leftmost non-overlapping matches of the kind; those that fail `good` are dropped but do take their place.

        run: what a match begins with; where one hit in such a run fails, all later ones in it do.
        """
        free = 0
        for at in hits.get(kind, ()):
            if at < free:
                continue
            if m := pattern.match(text, at):
                free = m.end()
                if end := good(m):
                    spans.append((at, end, kind))
                    free = max(free, end)
            elif run:
                free = run.match(text, at).end()

    walk("assign", ASSIGN, lambda m: len(m[2]) >= 8 and m.end())
    walk("access", ACCESS, lambda m: len(m[0]) >= 16 and m.end())
    for at in _hex_starts(text):
        if (end := HEX.match(text, at).end()) - at >= HEX_RUN:
            spans.append((at, end, "hex"))
    walk("checked_token", CHECKED, lambda m: base62_crc(m[1]) == m[2] and m.end())
    walk("jwt", JWT, lambda m: _json_part(m[1]) and _json_part(m[2]) and m.end(), JWT_RUN)
    walk("private_key", PRIVATE, private_end)
    walk("service_key", SERVICE, lambda m: m.end())
    walk("url_password", URL_PASSWORD, lambda m: m.end() - 1)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every text's secrets as array<struct<kind, start, end>> by start, then kind.

    One narrow pass.  Null and empty texts have no spans; a null id stays null; repeated rows are
    scanned each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in find_secrets(t.decode("utf-8", "replace"))] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each group of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret of a text replaced by its kind in brackets; one narrow pass, other columns, of any name and type, stay.

    Null texts stay null; repeated rows are treated alike; an empty table gives no rows.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, find_secrets(t)) for t in texts.to_pylist()], pa.string())

    return common.with_columns(docs, **{text_col: run(common.quoted(text_col).cast("string"))})


def spans_text(spans: F.Column | str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
