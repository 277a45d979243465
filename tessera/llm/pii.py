"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Everything on the main path is a Spark SQL expression over one row: no shuffle, no Python.  A pattern's
matches and the text between them (one regexp_extract_all, one split) give positions as running sums
of lengths.  Patterns use possessive quantifiers and look-behinds, which accept the same matches
but neither recurse nor rescan, so very long runs of digits or letters cost linear time.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.boosting import Boosted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "national_id", "iban", "obfuscated_email")

# Generators: pattern, and a cheap test that texts without any match mostly fail.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
    "number": (r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    "obfuscated_email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}+)+", lambda t: F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))),
}
CONTEXT = {
    "says_phone": r"(?i)\b(tel|phone|call|mobile|cell|fax|sms|text me|whatsapp|t[eé]l[eé]fono|telefon)\b",
    "says_id": r"(?i)\b(ssn|social security|national id|identity|passport|tax id|nif|dni)\b",
    "says_bank": r"(?i)\b(iban|account|bank|transfer|konto)\b",
    "says_mail": r"(?i)\b(mail|e-mail|contact|write|reach)\b",
    "says_other": r"(?i)\b(version|ver|build|release|isbn|order|invoice|ticket|issue|pages?|section|sku|serial|lat|lon|date|item|score|tracking|model|part|ref|batch|lot|catalog)\b",
}
FEATURES = ["generator", "digits", "length", "separators", "groups_334", "groups_324", "parenthesis", "iban_ok", "number_after", *CONTEXT]
WINDOW = 32
BLOCK = 64
LABELLED = 1500  # rows of the generated, labelled table the trees are fitted on
PRECISION = 0.95


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the optimiser leaves a lambda's variable alone."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def reach(ends: Column) -> Column:
    """For each i, the largest of the values before i (-1 for the first): maxima of whole blocks, and of a part of one."""
    top = lambda a: F.coalesce(F.array_max(a), F.lit(-1))

    def blocks(x):
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: top(F.slice(x, b * BLOCK + 1, BLOCK)))

        def one(t):
            def at(i):
                b = F.floor(i / BLOCK).cast("int")
                return F.greatest(F.element_at(t["ahead"], b + 1), top(F.slice(t["x"], b * BLOCK + 1, i % BLOCK)))

            return F.transform(F.sequence(F.lit(0), F.size(t["x"]) - 1), at)

        return let(tops, lambda t: let(F.struct(x.alias("x"), F.transform(t, lambda _, b: top(F.slice(t, 1, b))).alias("ahead")), one))

    return let(ends, lambda x: F.when(F.size(x) == 0, F.slice(x, 1, 0)).otherwise(blocks(x)))


def matches(text: Column, pattern: str, test) -> Column:
    """array<struct<start, end, text, before, after>> of the leftmost non-overlapping matches, in code points."""
    kind = "array<struct<start:int,end:int,text:string,before:string,after:string>>"

    def place(x):
        def at(y):  # y: p, m, lengths lp and lm
            def blocks(z):  # z: step = length of a gap and its match; sums: of whole blocks of steps
                def one(w):
                    def span(i):
                        b = F.floor(i / BLOCK).cast("int")
                        start = F.element_at(w["ahead"], b + 1) + _sum(F.slice(w["step"], b * BLOCK + 1, i % BLOCK)) + F.element_at(y["lp"], i + 1)
                        return F.struct(start.alias("start"), (start + F.element_at(y["lm"], i + 1)).alias("end"), F.element_at(x["m"], i + 1).alias("text"), F.right(F.element_at(x["p"], i + 1), F.lit(WINDOW)).alias("before"), F.left(F.element_at(x["p"], i + 2), F.lit(4)).alias("after"))

                    return F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), span)

                ahead = F.transform(F.sequence(F.lit(0), F.size(z["sums"]) - 1), lambda b: _sum(F.slice(z["sums"], 1, b)))
                return let(F.struct(z["step"].alias("step"), ahead.alias("ahead")), one)

            step = F.zip_with(F.slice(y["lp"], 1, F.size(x["m"])), y["lm"], lambda a, b: a + b)
            return let(step, lambda s: let(F.struct(s.alias("step"), F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(s, b * BLOCK + 1, BLOCK))).alias("sums")), blocks))

        return let(F.struct(F.transform(x["p"], F.length).alias("lp"), F.transform(x["m"], F.length).alias("lm")), at)

    none = F.from_json(F.lit("[]"), kind)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), place)))
    return F.when(test(text), found).otherwise(none).cast(kind)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(digits)

    def add(total, i):
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_base(kind: str, text: Column) -> Column:
    """Whether a base generator's match counts."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(digits(text), lambda d: F.length(d).between(14, 19) & luhn(d))
    return F.length(digits(text)).between(10, 15) if kind == "phone" else F.lit(True)


def iban_ok(text: Column) -> Column:
    """The check digits of an IBAN (ISO 7064, modulus 97)."""
    s = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)) == 1


def _flag(c: Column) -> Column:
    return c.cast("int")


def candidates(text: Column) -> Column:
    """Spans of all generators with features: base ones that count, and others that no base span holds."""

    def fit(kind, match):
        rank = list(PATTERNS).index(kind)
        named = F.when(match["text"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national_id").otherwise("local_phone") if kind == "number" else F.lit(kind)
        cells = {
            "kind": named, "start": match["start"], "end": match["end"], "base": F.lit(kind in BASE), "generator": F.lit(rank),
            "digits": F.length(digits(match["text"])), "length": F.length(match["text"]), "separators": F.length(F.regexp_replace(match["text"], r"[^\x20().-]", "")),
            "groups_334": _flag(match["text"].rlike(r"^(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$")), "groups_324": _flag(match["text"].rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
            "parenthesis": _flag(F.startswith(match["text"], F.lit("("))), "iban_ok": _flag(iban_ok(match["text"])) if kind == "iban" else F.lit(0), "number_after": _flag(match["after"].rlike(r"^[\x20]?[0-9%$€]")),
        } | {k: _flag(match["before"].rlike(p)) for k, p in CONTEXT.items()}
        return F.struct(*(v.alias(k) for k, v in cells.items()))

    def of(kind):
        pattern, test = PATTERNS[kind]
        found = matches(text, pattern, test)
        return found if kind not in BASE or kind == "email" else F.filter(found, lambda m: is_base(kind, m["text"]))

    def outside(x):
        """Base spans, and others that reach beyond every base span that begins before or with them."""
        ends = F.transform(x, lambda c: F.when(c["base"], c["end"]).otherwise(F.lit(-1)))
        return let(F.struct(x.alias("x"), reach(ends).alias("held")), lambda y: F.filter(y["x"], lambda c, i: c["base"] | (F.element_at(y["held"], i + 1) < c["end"])))

    def both(x):  # in order of start, base spans first
        order = F.array_sort(F.transform(F.concat(x["base"], x["others"]), lambda c: F.struct(c["start"].alias("start"), _flag(~c["base"]).alias("last"), c.alias("c"))))
        return F.when(F.size(x["others"]) == 0, x["base"]).otherwise(let(F.transform(order, lambda o: o["c"]), outside))

    def array(kinds):
        fits = {k: (lambda k: lambda m: fit(k, m))(k) for k in kinds}  # a second argument would be the index
        return F.flatten(F.array(*(F.transform(of(k), f) for k, f in fits.items())))

    return let(F.struct(array(BASE).alias("base"), array([k for k in PATTERNS if k not in BASE]).alias("others")), both)


# -- model ---------------------------------------------------------------------------------------


def labelled_texts(n: int = LABELLED, seed: int = 11, family: str = "fit") -> list[tuple[str, bool]]:
    """Generated sentences, each with one span to judge: personal data, or something of the same shape.

    The trees are fitted on one family of sentences; probabilities and thresholds are set on another one,
    of other wording, so that they hold where the trees have not seen the sentence.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))

    def iban(good):
        body = d(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + 3) % 97:02d}{body}"

    def us():
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(d(3), d(3), d(4))

    yes = [
        lambda: f"{rng.choice(['call', 'Tel', 'phone', 'mobile', 'fax'])} {us()}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"my number: {d(3)}-{d(3)}-{d(4)}",
        lambda: f"{rng.choice(['SSN', 'social security', 'tax id', 'passport'])} {d(3)}-{d(2)}-{d(4)}", lambda: f"{word()} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{rng.choice(['IBAN', 'account', word()])} {iban(True)}", lambda: f"{word()}.{word()} [at] {word()} [dot] com", lambda: f"{word()} (at) {word()}.org",
    ]
    no = [
        lambda: f"{rng.choice(['ISBN', 'order', 'ticket', 'tracking', 'invoice', 'serial'])} {rng.choice([us(), d(9), d(12), d(16)])}", lambda: f"{rng.choice(['date', word()])} 20{d(2)}-0{rng.randint(1, 9)}-1{d(1)} 1{d(1)}.{d(2)}",
        lambda: f"{word()} {d(rng.randint(7, 19))}", lambda: f"{rng.choice(['order', 'item', 'sku'])} {d(3)}-{d(2)}-{d(4)}", lambda: f"{word()} {d(1)}.{d(7)} {d(2)}", lambda: f"lat {d(2)}.{d(6)}",
        lambda: f"{word()} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{word()} {d(4)}-{d(4)}", lambda: f"{rng.choice(['serial', word()])} {iban(False)}", lambda: f"{word()} {d(2)}-{d(2)}-{d(3)} {d(2)}%",
    ]
    if family == "calibrate":
        name, brand = lambda: word().title(), lambda: rng.choice(["Model", "Part", "Ref", "Batch", "Lot", "Catalog no."])
        yes = [
            lambda: f"{name()} can be reached at {us()}, ask for {name()}", lambda: f"{name()}\n{us()}\n{name()} Street", lambda: f"text me: {us()}!", lambda: f"whatsapp {d(3)} {d(3)} {d(4)} thanks",
            lambda: f"my social security number is {d(3)}-{d(2)}-{d(4)}.", lambda: f"identity card {d(3)}-{d(2)}-{d(4)}, issued to {name()}", lambda: f"Name: {name()}, {d(3)}-{d(2)}-{d(4)}",
            lambda: f"please transfer it to {iban(True)} by Friday", lambda: f"bank: {iban(True)}, {name()}", lambda: f"write to {word()}_{d(2)} [at] {word()} [dot] net", lambda: f"({word()}(at){word()}.com)",
        ]
        no = [
            lambda: f"{brand()} {us()} is out of stock", lambda: f"{brand()} {d(3)}-{d(2)}-{d(4)}", lambda: f"release {d(3)}.{d(3)}.{d(4)}", lambda: f"pages {d(4)}-{d(4)}", lambda: f"it cost {d(3)} {d(3)} {d(3)} in {d(4)}",
            lambda: f"score {d(4)} {d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}", lambda: f"total: {d(rng.randint(7, 14))} bytes", lambda: f"lon {d(2)}.{d(7)}, {word()}", lambda: f"code {iban(False)} was refused",
        ]
    out = []
    for i in range(n):
        good = i % 2 == 0
        out.append((f"{word()} {word()} {rng.choice(yes if good else no)()} {word()} {word()}", good))
    return out


@lru_cache(maxsize=4)
def _fitted(app: str, rows: int) -> tuple[Boosted, dict[str, float]]:
    spark = SparkSession.getActiveSession()

    def judged(family, seed):
        table = json.dumps([{"text": t, "y": y} for t, y in labelled_texts(rows, seed, family)])
        frame = spark.range(1).select(F.explode(F.from_json(F.lit(table), "array<struct<text:string,y:boolean>>")).alias("r")).select("r.*")
        got = frame.select("y", F.explode(candidates(F.col("text"))).alias("c")).where("NOT c.base").select("y", "c.*").collect()  # a few rows a sentence
        return np.array([[float(r[f]) for f in FEATURES] for r in got]), np.array([float(r["y"]) for r in got]), np.array([r["kind"] for r in got])

    x, y, _ = judged("fit", 11)
    model = Boosted(FEATURES).fit(x, y)
    x, y, kinds = judged("calibrate", 12)
    model.calibrate(x, y)
    cut = {}
    for k in KINDS:
        if k not in BASE and (mine := kinds == k).any():
            cut[k] = max(0.5, model.threshold(x[mine], y[mine], PRECISION))
    return model, cut


def fitted(spark: SparkSession, rows: int = LABELLED) -> tuple[Boosted, dict[str, float]]:
    """(model, threshold of each further kind), fitted once a session on a generated table of bounded size."""
    return _fitted(spark.sparkContext.applicationId, rows)


# -- operator ------------------------------------------------------------------------------------


def spans_column(text: Column, model: Boosted, cut: dict[str, float]) -> Column:
    """array<struct<start, rank, end, kind, probability>> in order of start, then kind as listed."""
    limit = lambda c: F.coalesce(*(F.when(c["kind"] == k, F.lit(v)) for k, v in cut.items()), F.lit(2.0))
    scored = F.transform(candidates(text), lambda c: F.struct(c["start"].alias("start"), F.array_position(F.lit(list(KINDS)), c["kind"]).cast("int").alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), F.when(c["base"], F.lit(1.0)).otherwise(model.expression(c)).alias("probability"), c["base"].alias("base")))
    return F.array_sort(F.filter(scored, lambda c: c["base"] | (c["probability"] >= limit(c))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): personal data in every text, by start, then kind as listed in KINDS.

    Base kinds are kept whatever the trees say; spans of different kinds may overlap.  Null and empty
    texts have none; a null id stays null; repeated rows are judged each; an empty table gives no rows;
    other columns are ignored.
    """
    model, cut = fitted(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", spans_column(F.col("text"), model, cut).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each stretch of overlapping spans replaced by its first kind in brackets; other columns, of any name and type, stay.

    Null texts stay null.  `n_chars`, where there is one, becomes the new length.
    """
    model, cut = fitted(docs.sparkSession)
    name, chars = common.fresh(docs, "spans"), next((c for c in docs.columns if c.lower() == "n_chars"), None)
    wide = docs.withColumn(name, spans_column(F.coalesce(common.quoted(text_col), F.lit("")), model, cut))

    def groups(x):  # x: spans in order, and how far those before each reach
        heads = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: F.element_at(x["held"], i + 1) <= F.element_at(x["s"], i + 1)["start"])

        def group(h, k, all_heads):
            end = F.when(k + 1 < F.size(all_heads), F.element_at(x["held"], F.element_at(all_heads, F.least(k + 2, F.size(all_heads))) + 1)).otherwise(F.array_max(x["s"]["end"]))
            first = F.element_at(x["s"], h + 1)
            return F.struct(first["start"].alias("start"), end.alias("end"), first["kind"].alias("kind"))

        return let(heads, lambda all_heads: F.transform(all_heads, lambda h, k: group(h, k, all_heads)))

    kind = "array<struct<start:int,end:int,kind:string>>"
    none = F.from_json(F.lit("[]"), kind)
    merged = F.when(F.size(name) == 0, none).otherwise(let(F.struct(F.col(name).alias("s"), reach(F.col(name)["end"]).alias("held")), groups).cast(kind))
    wide = wide.withColumn(name, merged)
    # Four bytes a code point: slices by position cost their own length only.
    raw = F.encode(common.quoted(text_col), "UTF-32")
    part = lambda raw, a, b: F.decode(F.substring(raw, a * 4 + 1, (b - a) * 4), "UTF-32")

    def rebuilt(x):
        def piece(i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.element_at(x["s"], F.greatest(i, F.lit(1)))["end"])
            end = F.when(i == F.size(x["s"]), (F.octet_length(x["raw"]) / 4).cast("int")).otherwise(F.element_at(x["s"], F.least(i + 1, F.size(x["s"])))["start"])
            label = F.when(i == F.size(x["s"]), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(F.element_at(x["s"], F.least(i + 1, F.size(x["s"])))["kind"]), F.lit("]")))
            return F.concat(part(x["raw"], start, end), label)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["s"])), piece), "")

    text = F.when(F.size(name) == 0, common.quoted(text_col)).otherwise(let(F.struct(raw.alias("raw"), F.col(name).alias("s")), rebuilt))
    wide = common.with_columns(wide, **{text_col: text})
    if chars:
        wide = common.with_columns(wide, **{chars: F.when(F.size(name) == 0, common.quoted(chars)).otherwise(F.length(common.quoted(text_col)).cast("long"))})
    return wide.select(*common.own_columns(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(count, BASE), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
