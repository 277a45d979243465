"""The public rule-based stemmers of English and French, as layers of SQL expressions over a table of words.

A layer adds or replaces columns of the one before it; `w` is the word so far, `r1`, `r2` and `rv` are how many
letters stand before its regions.  Expressions keep to what ANSI SQL engines share, so the same layers run as a
DataFrame and as nested subqueries.  Stemming is for lexicons: one row a distinct word, never one a token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

Layers = list[dict[str, str | tuple[str, str]]]  # two: for Spark and for other engines


def _cut(n: str) -> str:
    """The word without its last n letters."""
    return f"left(w, length(w) - {n})"


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _suffix(text: str, endings: str) -> str:
    """The longest of the endings, in any order, that the text ends with; '' if none."""
    return f"regexp_extract({text}, '({'|'.join(sorted(endings.split(), key=len, reverse=True))})$', 1)"


def _region(text: str, vowels: str) -> str:
    """Letters up to and with the first non-vowel behind a vowel; all if there is none."""
    head = f"regexp_extract({text}, '^([^{vowels}]*[{vowels}]+[^{vowels}])', 1)"
    return f"CASE WHEN {head} = '' THEN length({text}) ELSE length({head}) END"


def _cases(column: str, table: dict[str, str], other: str) -> str:
    """CASE over endings: 'a b' -> what takes their place, as SQL."""
    inside = lambda endings: ", ".join(f"'{e}'" for e in endings.split())
    return "CASE " + " ".join(f"WHEN {column} IN ({inside(k)}) THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


# -- English -------------------------------------------------------------------------------------

_V = "aeiouy"
_SHORT = f"([^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$"
#: Fixed values of the public algorithm: words that are stemmed by a list, and words that stay as they are from step 1a on.
ENGLISH_LIST = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
ENGLISH_STOP = "inning outing canning herring earring proceed exceed succeed"

_with = lambda tail: f"{_cut('length(suf)')} || '{tail}'"
_gone = _cut("length(suf)")
_in = lambda region: f"length(w) - length(suf) >= {region}"

ENGLISH: Layers = [
    {"w": "replace(replace(replace(replace(replace(replace(regexp_replace(word, '^y', 'Y'), 'ay', 'aY'), 'ey', 'eY'), 'iy', 'iY'), 'oy', 'oY'), 'uy', 'uY'), 'yy', 'yY')"},
    {"r1": f"CASE WHEN w LIKE 'gener%' OR w LIKE 'arsen%' THEN 5 WHEN w LIKE 'commun%' THEN 6 ELSE {_region('w', _V)} END"},
    {"r2": f"r1 + {_region('substring(w, r1 + 1)', _V)}"},
    {"w": f"CASE WHEN w LIKE '%sses' THEN {_cut('2')} WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN {_cut('2')} ELSE {_cut('1')} END WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN w LIKE '%s' AND {_has(_cut('2'), f'[{_V}]')} THEN {_cut('1')} ELSE w END"},
    {"first": "w", "suf": _suffix("w", "eed eedly ed edly ing ingly")},
    {"bare": f"CASE WHEN suf IN ('ed', 'edly', 'ing', 'ingly') AND {_has(_gone, f'[{_V}]')} THEN {_gone} ELSE '' END"},
    {"w": f"CASE WHEN suf IN ('eed', 'eedly') THEN CASE WHEN {_in('r1')} THEN {_with('ee')} ELSE w END WHEN bare = '' THEN w WHEN {_has('bare', '(at|bl|iz)$')} THEN bare || 'e' WHEN {_has('bare', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN left(bare, length(bare) - 1) WHEN length(bare) <= r1 AND {_has('bare', _SHORT)} THEN bare || 'e' ELSE bare END"},
    {"w": f"CASE WHEN {_has('w', f'.[^{_V}][yY]$')} THEN {_cut('1')} || 'i' ELSE w END"},
    {"suf": _suffix("w", "tional enci anci abli entli izer ization ational ation ator alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi fulli lessli li")},
    {"w": f"CASE WHEN suf = '' OR NOT {_in('r1')} THEN w ELSE " + _cases("suf", {
        "tional": _with("tion"), "enci": _with("ence"), "anci": _with("ance"), "abli": _with("able"), "entli": _with("ent"), "izer ization": _with("ize"), "ational ation ator": _with("ate"), "alism aliti alli": _with("al"), "fulness fulli": _with("ful"),
        "ousli ousness": _with("ous"), "iveness iviti": _with("ive"), "biliti bli": _with("ble"), "lessli": _with("less"), "ogi": f"CASE WHEN w LIKE '%logi' THEN {_cut('1')} ELSE w END", "li": f"CASE WHEN {_has('w', '[cdeghkmnrt]li$')} THEN {_gone} ELSE w END",
    }, "w") + " END"},
    {"suf": _suffix("w", "tional ational alize icate iciti ical ful ness ative")},
    {"w": f"CASE WHEN suf = '' OR NOT {_in('r1')} THEN w ELSE " + _cases("suf", {"tional": _with("tion"), "ational": _with("ate"), "alize": _with("al"), "icate iciti ical": _with("ic"), "ful ness": _gone, "ative": f"CASE WHEN {_in('r2')} THEN {_gone} ELSE w END"}, "w") + " END"},
    {"suf": _suffix("w", "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")},
    {"w": f"CASE WHEN suf = '' OR NOT {_in('r2')} OR (suf = 'ion' AND NOT {_has('w', '[st]ion$')}) THEN w ELSE {_gone} END"},
    {"w": f"CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_has(_cut('1'), _SHORT)})) THEN {_cut('1')} WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN {_cut('1')} ELSE w END"},
    {"stem": "CASE WHEN length(word) < 3 THEN word " + " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in ENGLISH_LIST.items()) + f" WHEN first IN ({', '.join(repr(x) for x in ENGLISH_STOP.split())}) THEN first ELSE replace(w, 'Y', 'y') END"},
]

# -- French --------------------------------------------------------------------------------------

_F = "aeiouyâàëéêèïîôûù"


def _consonants(group: str, flags: str) -> str:
    """u and i between vowels and y beside one stand for consonants, and so does u behind q: they become capitals.

    Left to right; each twice, for letters that share a neighbour.  group: how an engine names the n-th group.
    """
    one, two = group.format(1), group.format(2)
    steps = [(f"([{_F}])u([{_F}])", f"{one}U{two}"), (f"([{_F}])i([{_F}])", f"{one}I{two}"), (f"([{_F.replace('y', '')}])y", f"{one}Y"), (f"y([{_F}])", f"Y{one}")]
    return reduce(lambda e, s: f"regexp_replace({e}, '{s[0]}', '{s[1]}'{flags})", [s for s in steps for _ in range(2)], "replace(word, 'qu', 'qU')")


_ver = lambda endings: _suffix("substring(w, rv + 1)", endings)
_r2 = lambda then, other="w": f"CASE WHEN {_in('r2')} THEN {then} ELSE {other} END"


def _after(base: str, before: dict[str, str], other: str) -> str:
    """What becomes of a stem by what it ends with."""
    return "CASE " + " ".join(f"WHEN {base} LIKE '%{k}' THEN {v}" for k, v in before.items()) + f" ELSE {other} END"


def _drop(base: str, n: int, region: str, then: str = "", other: str | None = None) -> str:
    """base without its last n letters and with `then`, if they lie in the region; else `other`, or base as it is."""
    return f"CASE WHEN length({base}) - {n} >= {region} THEN left({base}, length({base}) - {n}) || '{then}' ELSE {other or base} END"


_B = f"({_gone})"
_iq = _after(_B, {"ic": _drop(_B, 2, "r2", other=f"left({_B}, length({_B}) - 2) || 'iqU'")}, _B)
_iv = _after(_B, {"ativ": _drop(_B, 4, "r2", other=_drop(_B, 2, "r2")), "iv": _drop(_B, 2, "r2"), "eus": _drop(_B, 3, "r2", other=_drop(_B, 3, "r1", "eux")), "abl": _drop(_B, 3, "r2"), "iqU": _drop(_B, 3, "r2"), "ièr": _drop(_B, 3, "rv", "i"), "Ièr": _drop(_B, 3, "rv", "i")}, _B)
_ab = _after(_B, {"abil": _drop(_B, 4, "r2", other=f"left({_B}, length({_B}) - 4) || 'abl'"), "ic": _drop(_B, 2, "r2", other=f"left({_B}, length({_B}) - 2) || 'iqU'"), "iv": _drop(_B, 2, "r2")}, _B)
_at = _after(_B, {"icat": _drop(_B, 4, "r2", other=_drop(_B, 2, "r2", other=_B).replace(f"left({_B}, length({_B}) - 2) || ''", f"left({_B}, length({_B}) - 4) || 'iqU'")), "at": _drop(_B, 2, "r2")}, _B)

_STANDARD = {
    "ance iqUe isme able iste eux ances iqUes ismes ables istes": _r2(_gone),
    "atrice ateur ation atrices ateurs ations": _r2(_iq),
    "logie logies": _r2(_with("log")),
    "usion ution usions utions": _r2(_with("u")),
    "ence ences": _r2(_with("ent")),
    "ement ements": f"CASE WHEN {_in('rv')} THEN {_iv} ELSE w END",
    "ité ités": _r2(_ab),
    "if ive ifs ives": _r2(_at),
    "eaux": _cut("1"),
    "aux": f"CASE WHEN {_in('r1')} THEN {_with('al')} ELSE w END",
    "euse euses": _r2(_gone, f"CASE WHEN {_in('r1')} THEN {_with('eux')} ELSE w END"),
    "issement issements": f"CASE WHEN {_in('r1')} AND {_has(_gone, f'[^{_F}]$')} THEN {_gone} ELSE w END",
    "amment": f"CASE WHEN {_in('rv')} THEN {_with('ant')} ELSE w END",
    "emment": f"CASE WHEN {_in('rv')} THEN {_with('ent')} ELSE w END",
    "ment ments": f"CASE WHEN length(w) - length(suf) - 1 >= rv AND {_has(_gone, f'[{_F}]$')} THEN {_gone} ELSE w END",
}
_I_VERB = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
_A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
_E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_VERB = f"ions {_E_VERB} {_A_VERB}"
_quoted = lambda words: ", ".join(f"'{x}'" for x in words.split())

FRENCH: Layers = [
    {"w": (_consonants("${}", ""), _consonants(r"\{}", ", 'g'"))},
    {"r1": _region("w", _F), "rv": f"CASE WHEN {_has('w', f'^[{_F}][{_F}]')} OR {_has('w', '^(par|col|tap)')} THEN least(3, length(w)) WHEN {_has('w', f'^.[^{_F}]*[{_F}]')} THEN length(regexp_extract(w, '^(.[^{_F}]*[{_F}])', 1)) ELSE length(w) END"},
    {"r2": f"r1 + {_region('substring(w, r1 + 1)', _F)}", "suf": _suffix("w", " ".join(_STANDARD))},
    {"old": "w", "w": _cases("suf", _STANDARD, "w")},
    {"verb": "w = old OR suf IN ('amment', 'emment', 'ment', 'ments')", "done": "w <> old"},  # whether verb endings are looked for
    {"suf": f"CASE WHEN verb THEN {_ver(_I_VERB)} ELSE '' END"},
    {"hit": f"suf <> '' AND length(w) - length(suf) > rv AND {_has(_gone, f'[^{_F}]$')}"},
    {"w": f"CASE WHEN hit THEN {_gone} ELSE w END"},
    {"suf": f"CASE WHEN verb AND NOT hit THEN {_ver(_VERB)} ELSE '' END"},
    {"w2": f"CASE WHEN suf = '' OR (suf = 'ions' AND NOT {_in('r2')}) THEN w WHEN suf IN ({_quoted(_A_VERB)}) AND length(w) - length(suf) > rv AND {_gone} LIKE '%e' THEN {_cut('length(suf) - 1')} ELSE {_gone} END"},
    {"hit": "hit OR w2 <> w", "w": "w2"},
    # an adverb whose verb ending is not there counts as not altered
    {"altered": "hit OR NOT verb"},
    {"w": f"CASE WHEN altered AND w LIKE '%Y' THEN {_cut('1')} || 'i' WHEN altered AND w LIKE '%ç' THEN {_cut('1')} || 'c' WHEN NOT altered AND {_has('w', '[^aiouès]s$')} THEN {_cut('1')} ELSE w END"},
    {"suf": f"CASE WHEN altered THEN '' ELSE {_ver('ion ier ière Ier Ière e ë')} END"},
    {"w": "CASE " + f"WHEN suf = 'ion' AND {_in('r2')} AND length(w) - 4 >= rv AND {_has('w', '[st]ion$')} THEN {_gone} WHEN suf IN ('ier', 'ière', 'Ier', 'Ière') THEN {_with('i')} WHEN suf = 'e' THEN {_gone} WHEN suf = 'ë' AND length(w) - 3 >= rv AND w LIKE '%guë' THEN {_gone} ELSE w END"},
    {"w": f"CASE WHEN {_has('w', '(enn|onn|ett|ell|eill)$')} THEN {_cut('1')} ELSE w END"},
    {"tail": f"regexp_extract(w, '[éè]([^{_F}]+)$', 1)"},
    {"w": "CASE WHEN tail = '' THEN w ELSE " + _cut("length(tail) - 1") + " || 'e' || tail END"},
    {"stem": "lower(w)"},
]

LAYERS = {"english": ENGLISH, "french": FRENCH, "simple": [{"stem": "word"}]}


def stems(words: DataFrame, config: str) -> DataFrame:
    """words (a table with a column `word` of lower-case words) with their stems; other columns stay."""
    own, out = words.columns, words
    for layer in LAYERS[config]:
        out = out.selectExpr(*(f"`{c}`" for c in out.columns if c not in layer), *(f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in layer.items()))
    return out.select(*own, "stem")


def stems_sql(words: str, config: str) -> str:
    """A query for (word, stem) of the words that the query `words` gives, for an engine other than Spark."""
    out, known = f"({words})", ["word"]
    for layer in LAYERS[config]:
        kept = ", ".join(c for c in known if c not in layer)
        out = f"(SELECT {kept}, {', '.join(f'{e if isinstance(e, str) else e[1]} AS {n}' for n, e in layer.items())} FROM {out})"
        known = [*(c for c in known if c not in layer), *layer]
    return f"SELECT word, stem FROM {out}"
