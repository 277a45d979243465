"""Entity resolution: staged lookups that resolve only unambiguous keys, with a confidence for each stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.relational import interval_join, unique_candidate

LADDER = {"office": 0.9, "full": 0.85, "surname": 0.80, "dated": 0.75}


def staged(facts: DataFrame, stages: Sequence[tuple[DataFrame, Sequence[str], float]], candidate: str) -> DataFrame:
    """facts with `candidate` and `confidence` of the first stage, in order, whose key has one candidate.

    Each stage is (candidates, key columns, confidence).  Nothing is guessed: no stage, no candidate.
    """
    out, picks, scores = facts, [], []
    for i, (pool, keys, confidence) in enumerate(stages):
        one = unique_candidate(pool, keys, candidate).withColumnRenamed(candidate, f"_c{i}")
        out = out.join(one, list(keys), "left")
        picks.append(F.col(f"_c{i}"))
        scores.append(F.when(F.col(f"_c{i}").isNotNull(), F.lit(confidence)))
    return out.select(*facts.columns, F.coalesce(*picks).alias(candidate), F.coalesce(*scores).alias("confidence"))


def in_office(facts: DataFrame, terms: DataFrame, on: Sequence[str], at: str, start: str, end: str, candidate: str, closed: str = "left", open_start: bool = False) -> DataFrame:
    """(on, at, _low, _high): the least and the greatest candidate in office at each time that facts ask for; one is alone where they are equal.

    Distinct times of a key meet its distinct spans, so neither the facts of a time nor the candidates of a span multiply.
    """
    spans = terms.groupBy(*on, start, end).agg(F.min(candidate).alias("_low"), F.max(candidate).alias("_high"))
    met = interval_join(facts.select(*on, at).distinct(), spans, on, at, start, end, closed, "inner", open_start)
    return met.groupBy(*on, at).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))


def sole(met: DataFrame, row_id: str, candidate: str) -> DataFrame:
    """(row_id, candidate) of rows whose bounds `_low` and `_high`, over all rows of one id, are one candidate."""
    bounds = met.groupBy(row_id).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return bounds.where("_low = _high").select(row_id, F.col("_low").alias(candidate))


def join_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the further columns of right, by keys of which nulls are equal."""
    r = right.withColumnsRenamed({k: f"_r_{i}" for i, k in enumerate(on)})
    condition = F.lit(True)
    for i, k in enumerate(on):
        condition = condition & left[k].eqNullSafe(r[f"_r_{i}"])
    return left.join(r, condition, how).drop(*(f"_r_{i}" for i in range(len(on))))


def sole_in_office(facts: DataFrame, terms: DataFrame, on: Sequence[str], at: str, start: str, end: str, candidate: str, row_id: str, closed: str = "left", open_start: bool = False) -> DataFrame:
    """(row_id, candidate) of facts with one candidate in office at their time."""
    asked = facts.select(row_id, *on, at)
    return sole(join_safe(asked, in_office(asked, terms, on, at, start, end, candidate, closed, open_start), [*on, at]), row_id, candidate)


def dated(facts: DataFrame, terms: DataFrame, on: Sequence[str], at: str, start: str, end: str, candidate: str, row_id: str, confidence: float, closed: str = "left", open_start: bool = False) -> DataFrame:
    """(row_id, candidate, confidence) of facts with one candidate in office at their time."""
    return sole_in_office(facts, terms, on, at, start, end, candidate, row_id, closed, open_start).withColumn("confidence", F.lit(confidence))


def propagate(resolved: DataFrame, unresolved: DataFrame, keys: Sequence[str], candidate: str, confidence: float) -> DataFrame:
    """Unresolved rows with the one candidate that their document's other rows of the same key have."""
    return unresolved.join(unique_candidate(resolved, keys, candidate), list(keys)).withColumn("confidence", F.lit(confidence))


def surname_keys(members: DataFrame, candidate: str, last_name: str) -> DataFrame:
    """(candidate, key): a member's folded last name and, of a compound one, its last word."""
    name = fold(F.trim(F.col(last_name)))
    return members.select(candidate, F.explode(F.array_distinct(F.array(name, F.element_at(F.split(name, r"\s+"), -1)))).alias("key")).where("key <> ''").distinct()


def by_legislature(facts: DataFrame, members: DataFrame, terms: DataFrame, row_id: str, legislature: str, surname: str, candidate: str, last_name: str, confidence: float = 0.9) -> DataFrame:
    """(row_id, candidate, confidence) of facts whose surname one member of their legislature bears.

    terms: candidate and legislature, as many rows as there are; who sat twice in one legislature is one member.  A compound last name
    also answers to its last word.  Two bearers resolve to nothing.
    """
    seats = terms.select(candidate, legislature).distinct().join(surname_keys(members, candidate, last_name), candidate)
    bearers = seats.groupBy(legislature, "key").agg(F.min(candidate).alias("_low"), F.max(candidate).alias("_high"))  # one row a name
    held = facts.select(row_id, legislature, fold(F.trim(F.col(surname))).alias("key")).join(bearers, [legislature, "key"])
    return sole(held, row_id, candidate).withColumn("confidence", F.lit(confidence))


def continued(attributed: DataFrame, unresolved: DataFrame, members: DataFrame, terms: DataFrame, row_id: str, document: str, legislature: str, surname: str, candidate: str, last_name: str, confidence: float = 0.75) -> DataFrame:
    """(row_id, candidate, confidence) of unresolved rows, carried over from the rows of their document that are attributed.

    A document's member counts for a surname if they are the only one attributed there who bears it and holds a term in the
    row's legislature; two such members resolve to nothing.
    """
    known = attributed.where(F.col(candidate).isNotNull()).select(document, candidate).distinct().join(surname_keys(members, candidate, last_name), candidate)
    rows = unresolved.select(row_id, document, legislature, fold(F.trim(F.col(surname))).alias("key"))
    asked = rows.select(document, legislature, "key").distinct()
    held = asked.join(known, [document, "key"]).join(terms.select(candidate, legislature).distinct(), [candidate, legislature], "left_semi")
    bearers = held.groupBy(document, legislature, "key").agg(F.min(candidate).alias("_low"), F.max(candidate).alias("_high"))
    return sole(rows.join(bearers, [document, legislature, "key"]), row_id, candidate).withColumn("confidence", F.lit(confidence))


def raised(old: Column, new: Column) -> Column:
    """Confidence only rises."""
    return F.greatest(old, new)


def shortened(text: Column, most: int) -> Column:
    """The distinct strings that up to `most` deletions make of a text, itself included."""
    out = F.array(text)
    for _ in range(most):
        once = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.lit(1 << 20))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out


def fuzzy_unique(names: DataFrame, roster: DataFrame, name: str, reference: str, candidate: str, most: int = 2) -> DataFrame:
    """(name, candidate, distance): the one nearest reference within `most` edits, if it is alone at that distance.

    Strings within k edits have a string in common that up to k deletions make of each, so names and references
    meet by equi-join on these; no pair is missed, whatever letters differ, and none is made twice.
    """
    a = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_v", F.explode(shortened(F.col(name), most)))
    b = roster.select(F.col(reference).alias("_ref"), candidate, F.explode(shortened(F.col(reference), most)).alias("_v"))
    met = a.join(b, "_v").select(name, "_ref", candidate).distinct()
    near = met.withColumn("distance", F.levenshtein(name, "_ref", most)).where("distance >= 0")
    best = near.groupBy(name, "distance").agg(F.count_distinct(candidate).alias("_n"), F.min(candidate).alias(candidate))
    first = best.groupBy(name).agg(F.min_by(F.struct("distance", "_n", candidate), "distance").alias("x"))
    return first.where("x._n = 1").select(name, f"x.{candidate}", "x.distance")


def match_score(name_overlap: Column, context: Column, riding: Column, province: Column, party: Column, conflict: Column, parody: Column) -> Column:
    """Weighted evidence in 0..1: name .60, context .20, riding .15, province .10, party .05, less .30 and .40; a name alone never exceeds .55."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    other = context | riding | province | party
    raw = name_overlap * 0.60 + flag(context, 0.20) + flag(riding, 0.15) + flag(province, 0.10) + flag(party, 0.05) - flag(conflict, 0.30) - flag(parody, 0.40)
    capped = F.when(~other, F.least(raw, F.lit(0.55))).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped))


def name_keys(name: Column) -> Column:
    """Keys of a roster name: its last word, last two and last three words."""
    words = F.split(name, " ")
    return F.array_distinct(F.array(*(F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ") for n in (1, 2, 3))))


def resolve_named(facts: DataFrame, people: DataFrame, terms: DataFrame, row_id: str, first: str, last: str, at: str, person: str = "person") -> DataFrame:
    """(row_id, person, confidence) of speaker labels.

    In order: first and last name, initial and last name, last name alone, last name among those in
    office that day.  Each counts only if it names one person.  people: person, first, last; terms:
    person, start, end (half-open, null end open).
    """
    f = facts.select(row_id, F.lower(F.col(first)).alias("_f"), F.lower(F.col(last)).alias("_l"), at)
    p = people.select(person, F.lower(first).alias("_f"), F.lower(last).alias("_l"))
    initial = lambda df: df.withColumn("_i", F.left("_f", F.lit(1)))
    given = initial(f)
    found = staged(given, [(p, ["_f", "_l"], LADDER["full"]), (initial(p), ["_i", "_l"], LADDER["surname"])], person)
    alone = unique_candidate(p, ["_l"], person).withColumnRenamed(person, "_alone")
    held = terms.join(p, person).select("_l", F.col(person), "start", "end")
    by_day = dated(f, held, ["_l"], at, "start", "end", person, row_id, LADDER["dated"]).select(row_id, F.col(person).alias("_dated"))
    out = found.join(alone, "_l", "left").join(by_day, row_id, "left")
    bare = F.col("_f").isNull()
    pick = F.coalesce(F.col(person), F.when(bare, F.col("_alone")), F.when(bare, F.col("_dated")))
    score = F.coalesce("confidence", F.when(bare & F.col("_alone").isNotNull(), LADDER["surname"]), F.when(bare & F.col("_dated").isNotNull(), LADDER["dated"]))
    return out.select(row_id, pick.alias(person), F.when(pick.isNotNull(), score).alias("confidence"))


def merge_stubs(stubs: DataFrame, statements: DataFrame, members: DataFrame, stub: str, key: str, at: str, start: str, end: str, member: str) -> DataFrame:
    """(stub, member): the one member of the stub's key whose term covers all the stub's statements."""
    span = statements.groupBy(stub).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    spans = members.groupBy(key, start, end).agg(F.min(member).alias("_low"), F.max(member).alias("_high"))  # members of one term are one row
    joined = stubs.select(stub, key).join(span, stub).join(spans, key)
    cover = joined.where((F.col(start) <= F.col("_first")) & (F.col(end).isNull() | (F.col("_last") < F.col(end))))
    return sole(cover, stub, member)


def roster_by_keys(names: DataFrame, roster: DataFrame, row_id: str, key: str, at: str, name: str, start: str, end: str, member: str) -> DataFrame:
    """(row_id, member): a division list's name against the last one, two or three words of those in office, both ends closed."""
    keyed = roster.select(member, start, end, F.explode(name_keys(F.col(name))).alias(key))
    return sole_in_office(names, keyed, [key], at, start, end, member, row_id, "both")


def pair_filter(pairs: DataFrame, a: str, b: str, allowed: DataFrame, id_col: str) -> DataFrame:
    """Unordered distinct pairs of which both ids are allowed."""
    ids = allowed.select(F.col(id_col).alias("_id"))
    out = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return out.join(ids, F.col("a") == F.col("_id"), "left_semi").join(ids, F.col("b") == F.col("_id"), "left_semi")


# -- labels and captions --------------------------------------------------------------------------

# Forms of a speaker's label in capitals, words that mark an office, confidence by kind of attribution.
LABEL = r"(?i)^(?:HON|MRS?|MS)\.\s+(?:(?:HON|MRS?|MS)\.\s+)?((?:[A-Z]\.\s*){1,3})?\s*(\p{L}[\p{L}'’\-]*)(?:\s+\(([^)]+)\))?\s*$"
OFFICE = r"(?i)\b(premier|minister|attorney|leader\s+of\s+the|speaker|chair|government\s+house\s+leader|opposition|provincial\s+secretary|whip|deputy)\b"
HONORIFIC = r"(?i)^(Mr\.|Mrs\.|Ms\.|Mme|Hon\.|Hon|Dr\.|Sir|An|The)\s+"
BY_KIND = {"macro": 0.9, "recognition": 0.7, "panel": 0.75, "alternation": 0.65}
BY_NAME, BY_SPELLING = 0.7, 0.6


def surname_of(name: Column) -> Column:
    """The last word of a name, in capitals, without punctuation around it; null if shorter than two letters."""
    last = F.upper(F.regexp_replace(F.regexp_extract(F.rtrim(name), r"(\S+)$", 1), r"^[.,;:\-–]+|[.,;:\-–]+$", ""))
    return F.when(F.length(last) >= 2, last)


def riding_key(name: Column) -> Column:
    """A riding's name for comparison: folded, every dash a hyphen without space around it, letters and digits only."""
    dashed = F.regexp_replace(fold(name), r"\s*[‐-―−-]\s*", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(dashed, r"[^a-z0-9\-\s]", ""), r"\s+", " "))


def caption_members(turns: DataFrame, roster: DataFrame, row_id: str, council: str, at: str) -> DataFrame:
    """(row_id, member, confidence) of caption turns that have a name, from those in office on the day.

    turns: row_id, council, at, role, name, attribution.  roster: council, member, surname, mayor (boolean), start,
    end (half-open, null end open).  In order: the mayor where the turn says so, the one member of the surname, the
    one nearest within two edits.  Offices that rotate, unnamed turns and people who introduce themselves are left out.
    """
    role, low = F.lower(F.coalesce("role", F.lit(""))), F.lower("name")
    asks = turns.where(F.col("name").isNotNull() & ~F.coalesce(F.col("attribution") == "self_intro", F.lit(False)) & ~role.isin("chair", "clerk", "interpreter"))
    mayoral = role.rlike("mayor|worship") | low.rlike("^(mayor|her worship|his worship)")
    asks = asks.select(row_id, council, at, "attribution", mayoral.alias("_mayoral"), surname_of(F.col("name")).alias("_surname"))
    held = roster.select(council, "member", F.upper("surname").alias("_surname"), "mayor", "start", "end")
    mayor = sole_in_office(asks.where("_mayoral"), held.where("mayor"), [council], at, "start", "end", "member", row_id)
    exact = sole_in_office(asks, held, [council, "_surname"], at, "start", "end", "member", row_id)
    found = asks.join(mayor.withColumnRenamed("member", "_office"), row_id, "left").join(exact.withColumnRenamed("member", "_exact"), row_id, "left")
    spelt = found.where("_office IS NULL AND _exact IS NULL AND _surname IS NOT NULL").select(council, at, "_surname").distinct()
    forms = spelt.withColumn("_v", F.explode(shortened(F.col("_surname"), 2)))
    spans = held.groupBy(council, F.col("_surname").alias("_known"), "start", "end").agg(F.min("member").alias("_low"), F.max("member").alias("_high"))
    known = spans.withColumn("_v", F.explode(shortened(F.col("_known"), 2)))
    in_office = (F.col("start") <= F.col(at)) & (F.col("end").isNull() | (F.col(at) < F.col("end")))
    near = forms.join(known, [council, "_v"]).where(in_office).withColumn("_d", F.levenshtein("_surname", "_known", 2)).where("_d >= 0")
    best = near.groupBy(council, at, "_surname", "_d").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    one = best.groupBy(council, at, "_surname").agg(F.min_by(F.struct("_low", "_high"), "_d").alias("x")).where("x._low = x._high").select(council, at, "_surname", F.col("x._low").alias("_fuzzy"))
    out = found.join(one, [council, at, "_surname"], "left")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BY_KIND.items() for x in kv)), F.col("attribution")), F.lit(BY_NAME))
    member = F.coalesce("_office", "_exact", F.when(F.col("_office").isNull() & F.col("_exact").isNull(), F.col("_fuzzy")))
    score = F.when(F.coalesce("_office", "_exact").isNotNull(), kind).when(F.col("_fuzzy").isNotNull(), F.lit(BY_SPELLING))
    return out.select(row_id, member.alias("member"), score.alias("confidence")).where("member IS NOT NULL")


def by_middle_initial(facts: DataFrame, members: DataFrame, row_id: str, full: str, surname: str, at: str, confidence: float = 0.85) -> DataFrame:
    """(row_id, member, confidence): the one member in office of a surname and middle initial, both stated.

    members: member, name, first, last, start, end (both ends closed, null is open).  First names are not compared, so
    short forms do no harm; a surname also counts by its last word.
    """
    plain = F.regexp_replace(F.trim(full), HONORIFIC, "")
    middle = F.upper(F.left(F.regexp_extract(plain, r"^\S+\s+(\S+)\s+\S", 1), F.lit(1)))  # a name stands behind it
    f = facts.select(row_id, at, fold(F.col(surname)).alias("_s"), middle.alias("_m")).where(F.col("_m").rlike("^[A-Z]$"))
    inner = F.when(F.startswith("name", "first"), F.substring("name", F.length("first") + 1, F.lit(1 << 20))).otherwise(F.col("name"))
    inner = F.when(F.endswith(inner, F.col("last")), F.left(inner, F.length(inner) - F.length("last"))).otherwise(inner)
    low = fold(F.col("last"))
    keys = F.explode(F.array_distinct(F.array(low, F.element_at(F.split(low, " "), -1))))
    m = members.select("member", "start", "end", F.upper(F.left(F.trim(inner), F.lit(1))).alias("_m"), keys.alias("_s")).where("_m <> ''")
    return dated(f, m, ["_s", "_m"], at, "start", "end", "member", row_id, confidence, "both", open_start=True)


def by_label(facts: DataFrame, terms: DataFrame, row_id: str, label: str, at: str, confidence: float = 0.85) -> DataFrame:
    """(row_id, member, confidence) of labels such as MR. G.S. WALLACE (Oak Bay).

    terms: member, first, last, riding, start, end (half-open, null end open).  The one member of the surname in
    office; of several, the one of the riding in brackets, if these name no office; else the one of the first initial.
    """
    part = lambda i: F.regexp_extract(F.trim(label), LABEL, i)
    hint = F.when((part(3) != "") & ~part(3).rlike(OFFICE), riding_key(part(3)))
    f = facts.select(row_id, at, fold(part(2)).alias("_s"), F.nullif(fold(F.left(part(1), F.lit(1))), F.lit("")).alias("_i"), hint.alias("_r")).where("_s <> ''")
    t = terms.select("member", fold(F.col("last")).alias("_s"), F.left(fold(F.coalesce("first", F.lit(""))), F.lit(1)).alias("_i"), riding_key(F.coalesce("riding", F.lit(""))).alias("_r"), "start", "end")
    out, bounds, picks = f, [], []
    for i, keys in enumerate((["_s"], ["_s", "_r"], ["_s", "_i"])):  # in office; of the riding; of the initial
        low, high = f"_low{i}", f"_high{i}"
        held = in_office(f, t, keys, at, "start", "end", "member").withColumnsRenamed({"_low": low, "_high": high})
        out = out.join(held, [*keys, at], "left")
        bounds += F.min(low).alias(low), F.max(high).alias(high)
        picks.append(F.when(F.col(low) == F.col(high), F.col(low)))
    picked = out.groupBy(row_id).agg(*bounds).select(row_id, F.coalesce(*picks).alias("member"))
    return picked.where("member IS NOT NULL").withColumn("confidence", F.lit(confidence))


def by_surname(facts: DataFrame, roster: DataFrame, row_id: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """(row_id, member) of movers' names against a current roster (keys, member, surname) by surname, if it has one."""
    pool = unique_candidate(roster.select(*keys, "member", F.upper("surname").alias("_surname")), [*keys, "_surname"], "member")
    return facts.select(row_id, *keys, surname_of(F.col(name)).alias("_surname")).join(pool, [*keys, "_surname"]).select(row_id, "member")
