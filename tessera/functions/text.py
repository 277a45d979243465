"""String functions as Spark expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that Unicode does not take apart, and what they are written as without marks.
LETTERS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ĳ": "ij", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ŋ": "n", "ĸ": "k", "ŀ": "l", "ŉ": "n"}


def _bases() -> dict[str, str]:
    """Lower-case Latin letters with marks (to the end of Latin Extended Additional), and their bare letters."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c.lower() == c and base != c and base.isascii():
            out[c] = base
    return out | {c: x for c, x in LETTERS.items() if len(x) == 1}


BASES = _bases()


def fold(c: Column) -> Column:
    """Lower case without accents: marks go, whether part of a letter or behind it, and ligatures are spelt out."""
    low = F.lower(c)
    out = F.translate(low, "".join(BASES), "".join(BASES.values()))
    for letter, spelt in LETTERS.items():
        if len(spelt) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelt))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"[\u0300-\u036F]", "")).otherwise(low)


def folded(text: str) -> str:
    """As fold(), of a Python string."""
    text = text.lower().translate(str.maketrans(BASES | LETTERS))
    return "".join(c for c in text if not "\u0300" <= c <= "\u036f")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: the optimiser leaves a lambda's variable alone."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def hostname(url: Column) -> Column:
    """Host of a URL, lower case, without scheme, path, query and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#:].*$", ""))


def norm_name(c: Column) -> Column:
    """A person's name for matching: folded, without honorifics, letters and single spaces only."""
    bare = F.regexp_replace(fold(c), r"\b(hon|honourable|honorable|mr|mrs|ms|dr|rt|right|the)\b\.?", " ")
    return squeeze(F.regexp_replace(bare, r"[^a-z0-9 ]", " "))


def attribution(c: Column) -> Column:
    """struct<name, riding, party> of 'Name (Riding, Party)'; the parts that are missing are null."""
    inner = F.regexp_extract(c, r"\(([^)]*)\)", 1)
    party = F.trim(F.regexp_extract(inner, r",\s*([^,]+)$", 1))
    riding = F.trim(F.regexp_replace(inner, r",[^,]*$", ""))
    none = lambda x: F.nullif(x, F.lit(""))
    return F.struct(none(F.trim(F.regexp_replace(c, r"\s*\(.*$", ""))).alias("name"), none(riding).alias("riding"), none(party).alias("party"))


def content_hash(c: Column) -> Column:
    """SHA-256 of the text in compatibility normal form, lower case and with single spaces."""
    return F.sha2(F.lower(squeeze(nfkc(c))).cast("binary"), 256)


def word_count(c: Column) -> Column:
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def snippet(c: Column, n: int = 280) -> Column:
    """At most n characters, cut at a word if longer."""
    return F.when(F.length(c) > n, F.concat(F.regexp_extract(F.left(c, F.lit(n - 3)), r"(?s)^(.*)\s", 1), F.lit("..."))).otherwise(c)


def _code_point(n: Column) -> Column:
    """The character of a number; numbers that name none give the replacement character."""
    good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, n)), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescape(c: Column, unclosed: bool = True) -> Column:
    """Text with named, decimal and hexadecimal character references resolved, each once.

    Of a reference that no semicolon closes, the longest beginning counts that is a number or one of the old names; unless
    `unclosed`, it is text.
    """
    from html.entities import html5

    common = ("amp", "lt", "gt", "quot", "nbsp", "apos")
    table = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")  # one literal to plan

    number = "#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}"
    old = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))

    def resolved(part):
        closed = F.regexp_extract(part, f"^({number}|[A-Za-z][A-Za-z0-9]{{0,31}});", 1)
        text = lambda: F.concat(F.lit("&"), part)
        return replaced(part, closed, 2, (lambda: replaced(part, F.regexp_extract(part, f"^({number}|{old})", 1), 1, text)) if unclosed else text)

    def replaced(part, name, behind, otherwise):  # behind: what follows starts so many characters behind the name
        return _let(name, lambda n: _let(char_of(n), lambda char: F.when(char.isNull(), otherwise()).otherwise(F.concat(char, F.substring(part, F.length(n) + behind, F.lit(1 << 30))))))

    def char_of(name):
        char = F.when(name == "", None)
        for k in common:
            char = char.when(name == k, html5[k + ";"])
        char = char.when(F.lower(F.left(name, F.lit(2))) == "#x", _code_point(F.conv(F.substring(name, 3, 6), 16, 10).cast("long")))
        return char.when(F.left(name, F.lit(1)) == "#", _code_point(F.substring(name, 2, 7).try_cast("long"))).otherwise(F.try_element_at(table, name))

    def joined(parts):
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), resolved), ""))

    return _let(c, lambda x: F.when(F.contains(x, F.lit("&")), _let(F.split(x, "&", -1), joined)).otherwise(x))


def html_to_text(c: Column, unclosed: bool = True) -> Column:
    """Text of HTML: scripts and styles go, breaks and paragraph ends are new lines, other tags are spaces, character references are resolved, blank lines drop."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</h[1-6]>|</li>|</div>", "\n")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]*>", " "), unclosed)
    t = F.regexp_replace(t, "[ \\t\\r\\f\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n+", "\n"), r"^\s+|\s+$", "")


def ordinal(n: Column) -> Column:
    last, two = n % 10, n % 100
    suffix = F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def squash_body(c: Column) -> Column:
    """A committee's name for matching: without leading words of kind, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"^(standing |special |select )?(committee|council) (on |of )?(the )?", ""), r"[^a-z0-9]", "")


# Words of scheduling that titles add to a body's name.
QUALIFIERS = r"(?i)\([^)]*\)|\b(?:continuation|continued|part\s*\d+|day\s*\d+|non\s*-?\s*regular|orientation|virtual|from\s+\w+\s+room)\b"


def meeting_body(c: Column, plain: bool = False) -> Column:
    """A meeting's name for matching: letters and digits, without a leading "special", and if plain without words of scheduling."""
    named = F.regexp_replace(c, QUALIFIERS, "") if plain else c
    return F.regexp_replace(F.regexp_replace(fold(named), r"^\s*special\s+", ""), "[^a-z0-9]", "")


def stream_title(c: Column) -> Column:
    """struct<day, body> of titles such as July 7, 2026 - City Council; null for others."""
    form = r"^\s*([A-Z][a-z]+)\.?\s*(\d{1,2}),?\s+(\d{4})\s*[-–]\s*(.+?)\s*$"
    stamp = F.concat_ws(" ", *(F.regexp_extract(c, form, i) for i in (1, 2, 3)))
    day = F.coalesce(*(F.try_to_timestamp(stamp, F.lit(p)) for p in ("MMMM d yyyy", "MMM d yyyy"))).cast("date")
    return F.when(day.isNotNull(), F.struct(day.alias("day"), F.regexp_extract(c, form, 4).alias("body")))


def title_date(c: Column) -> Column:
    """The first ISO date in a title."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def postal(c: Column) -> Column:
    """struct<postcode, fsa>: a Canadian postcode in the form A1A 1A1, and its first half."""
    raw = F.upper(F.regexp_extract(c, r"(?i)\b([ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z])[ -]?(\d[ABCEGHJ-NPRSTV-Z]\d)\b", 0))
    code = F.regexp_replace(raw, "[ -]", "")
    return F.when(code != "", F.struct(F.concat_ws(" ", F.left(code, F.lit(3)), F.right(code, F.lit(3))).alias("postcode"), F.left(code, F.lit(3)).alias("fsa")))


#: Two-letter codes of provinces and territories.
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")


def postal_address(c: Column) -> Column:
    """struct<address, city, province, postcode> of a mailing address; all null for blank text.

    Its parts are its lines or, of a single line, what commas divide.  The last one holds the postcode, before it the province
    and before that the city; where nothing stands before the postcode, the part above is the city.  Without a postcode a
    province in the last part closes it, and what stands before the city belongs to the address.  Without either all is address.
    """
    blank = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"[\s,]+$", "")), F.lit(""))
    kept = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"[\s,]+$", ""))), lambda p: p != "")
    province = rf"^(.*?)\b({'|'.join(PROVINCES)})\b"

    def read(x):
        parts, last = x["parts"], x["last"]
        above, up = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.try_element_at(parts, F.lit(-2))
        code = F.regexp_extract(last, r"(?i)\b([A-Z]\d[A-Z])\s*(\d[A-Z]\d)\b", 1), F.regexp_extract(last, r"(?i)\b([A-Z]\d[A-Z])\s*(\d[A-Z]\d)\b", 2)
        coded = code[0] != ""
        head = F.when(coded, F.coalesce(blank(F.regexp_extract(last, r"(?i)^(.*?)\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b", 1)), F.lit(""))).otherwise(last)
        place = F.regexp_extract(head, province, 2)
        before = F.when(place != "", F.regexp_extract(head, province, 1)).when(coded, head).otherwise("")
        pieces = kept(F.split(before, ","))
        city = F.when(coded & (place == "") & (head == ""), up).when(coded, blank(before)).when(place != "", F.try_element_at(pieces, F.lit(-1)))
        rest = F.when(coded & (place == "") & (head == ""), F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))))
        rest = rest.when(~coded & (place != ""), F.concat(above, F.when(F.size(pieces) > 1, F.array(F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1))), ", "))).otherwise(F.array().cast("array<string>"))))
        rest = rest.when(~coded, parts).otherwise(above)
        return F.struct(blank(F.array_join(rest, ", ")).alias("address"), city.alias("city"), F.nullif(place, F.lit("")).alias("province"), F.when(coded, F.upper(F.concat_ws(" ", *code))).alias("postcode"))

    parts = kept(F.split(c, F.when(F.contains(F.trim(c), F.lit("\n")), "\n").otherwise(",")))
    return _let(F.struct(parts.alias("parts"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("last")), read)


#: Hosts of social platforms and the path pattern that holds the handle.
PLATFORMS = {
    "twitter": (("twitter.com", "x.com"), r"^/@?([A-Za-z0-9_]{1,15})/?$"),
    "facebook": (("facebook.com", "fb.com"), r"^/([A-Za-z0-9.]{3,})/?$"),
    "instagram": (("instagram.com",), r"^/([A-Za-z0-9_.]{1,30})/?$"),
    "youtube": (("youtube.com",), r"^/(?:c/|user/|channel/|@)([A-Za-z0-9_.-]+)/?$"),
    "linkedin": (("linkedin.com",), r"^/(?:in|company)/([A-Za-z0-9_-]+)/?$"),
    "tiktok": (("tiktok.com",), r"^/@([A-Za-z0-9_.]+)/?$"),
    "bluesky": (("bsky.app",), r"^/profile/([A-Za-z0-9.-]+)/?$"),
    "threads": (("threads.net", "threads.com"), r"^/@([A-Za-z0-9_.]+)/?$"),
    "flickr": (("flickr.com",), r"^/(?:photos|people)/([A-Za-z0-9@_-]+)/?$"),
    "mastodon": (("mastodon.social", "mstdn.ca"), r"^/@([A-Za-z0-9_]+)/?$"),
}


def canonical_social(url: Column) -> Column:
    """struct<platform, handle, url> of a profile's address; null for anything else."""
    host = F.regexp_replace(hostname(url), r"^(www|m|mobile)\.", "")
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]*", ""), r"[?#].*$", "")
    out = None
    for name, (hosts, pattern) in PLATFORMS.items():
        handle = F.lower(F.regexp_extract(path, pattern, 1))
        hit = host.isin(*hosts) & (handle != "")
        row = F.struct(F.lit(name).alias("platform"), handle.alias("handle"), F.concat(F.lit(f"https://{hosts[0]}/"), handle).alias("url"))
        out = F.when(hit, row) if out is None else out.when(hit, row)
    return out


def truecase(c: Column, proper: Sequence[str] = ()) -> Column:
    """Sentence case for lines that are mostly capitals; others stay.

    proper: names as they are written; a word that is one but for its case is written so, wherever it stands.
    """
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    shouted = (F.length(letters) > 0) & (capitals >= 0.7 * F.length(letters))
    sentences = F.split(F.lower(c), r"(?<=[.!?])\s+")
    cased = F.array_join(F.transform(sentences, lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 20))), " ")
    if proper:
        names = F.create_map(*(F.lit(x) for p in dict.fromkeys(proper) for x in (p.lower(), p)))

        def named(w):
            lead = F.regexp_extract(w, r"^[^\p{L}]*", 0)
            core = F.regexp_extract(w, r"^[^\p{L}]*(\p{L}(?:[\p{L}'’-]*\p{L})?)", 1)
            known = F.try_element_at(names, F.lower(core))
            return F.when(known.isNotNull(), F.concat(lead, known, F.substring(w, F.length(lead) + F.length(core) + 1, F.lit(1 << 20)))).otherwise(w)

        cased = F.array_join(F.transform(F.split(cased, " "), named), " ")
    return F.when(shouted, cased).otherwise(c)


def language_by_markers(c: Column, markers: dict[str, tuple[str, ...]], default: str) -> Column:
    """The language with most marker words, the first listed on a tie, the default if none occurs."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    counts = {k: F.size(F.filter(words, (lambda v: lambda w: w.isin(*v))(v))) for k, v in markers.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, default)
    for k, n in counts.items():
        out = out.when(n == best, k)
    return out


def speaker_label(c: Column) -> Column:
    """struct<honorific, first, last> of a transcript's speaker label; labels of offices give null."""
    office = F.lower(F.trim(c)).rlike(r"^(the )?(speaker|chair|clerk|chairperson|deputy speaker|some hon\. members?|an hon\. member)\b")
    tidy = squeeze(F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", " "), r":\s*$", ""))
    pattern = r"^(?:(Hon|Mr|Mrs|Ms|Miss|Dr|M|Mme)\.?\s+)?(?:(\p{Lu}[\p{L}'.-]*)\s+)?(\p{Lu}[\p{L}' -]+)$"
    part = lambda i: F.nullif(F.regexp_extract(tidy, pattern, i), F.lit(""))
    return F.when(~office & (F.regexp_extract(tidy, pattern, 3) != ""), F.struct(part(1).alias("honorific"), part(2).alias("first"), part(3).alias("last")))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings in 0..1 by matching blocks, Arrow batches of difflib."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def nfkc(c: Column) -> Column:
    """Compatibility normal form; only rows with other than ASCII characters go to Arrow batches."""
    @F.pandas_udf("string")
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(normal(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def votes_in(text: Column) -> Column:
    """struct<outcome, ayes, nays, bill> of a passage: the last stated outcome wins, tallies and bill as found."""
    outcomes = F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:motion|amendment|bill)[^.\[\]]{0,60}?\b(carried|agreed to|defeated|negatived|lost|withdrawn)\b"), F.lit(1))
    last = F.try_element_at(outcomes, F.lit(-1))
    outcome = F.when(last.isin("carried", "agreed to"), "passed").when(last.isin("defeated", "negatived", "lost"), "failed").otherwise(last)
    tally = lambda p: F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")).cast("int")
    return F.struct(outcome.alias("outcome"), tally(r"\b(?:yeas?|ayes?|for the motion)[ :—-]+(\d{1,3})\b").alias("ayes"), tally(r"\b(?:nays?|noes|against the motion)[ :—-]+(\d{1,3})\b").alias("nays"), F.nullif(F.regexp_extract(text, r"\bBill (?:No\. )?([A-Z]?-?\d{1,4})\b", 1), F.lit("")).alias("bill"))


def speech_type(section: Column, kinds: dict[str, str], default: str = "debate") -> Column:
    """Kind of a section heading: that of the first listed phrase it contains."""
    return F.coalesce(*(F.when(F.contains(F.lower(section), F.lit(k)), v) for k, v in kinds.items()), F.lit(default))


def first_name_relation(a: Column, b: Column, nicknames: dict[str, str]) -> Column:
    """high for equal names or nicknames of one name, medium for an initial or a prefix, else low."""
    table = F.create_map(*(F.lit(x) for pair in nicknames.items() for x in pair)) if nicknames else None
    full = lambda c: F.coalesce(F.try_element_at(table, fold(c)), fold(c)) if nicknames else fold(c)
    x, y = full(a), full(b)
    short = (F.length(x) > 0) & (F.length(y) > 0) & (F.startswith(x, y) | F.startswith(y, x))
    return F.when(x == y, "high").when(short, "medium").otherwise("low")
