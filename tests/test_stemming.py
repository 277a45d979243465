"""Stemmers against samples of the public vocabularies."""

import duckdb
import pytest

from tessera.functions.stemming import stems, stems_sql

#: Words and stems as the public descriptions of the algorithms print them.
ENGLISH = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist|consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc|constant constant
knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot
generate generat|generates generat|general general|generously generous|communism communism|arsenal arsenal|skies sky|dying die|news news|innings inning|proceeds proceed|ties tie|cries cri|gas gas|kiwis kiwi|hopping hop|hoping hope|luxuriated luxuri|sized size|happy happi|by by|say say|enjoyment enjoy|youth youth|nationality nation|hopefulness hope|relational relat|apologies apolog|falling fall|controll control|agreed agre|as as|ponies poni"""
FRENCH = """continu continu|continua continu|continuait continu|continuant continu|continuation continu|continue continu|continué continu|continuel continuel|continuelle continuel|continuellement continuel|continuelles continuel|continuels continuel|continuer continu|continuera continu|continuerait continu|continueront continu|continuez continu|continuité continu|continuons continuon|contorsions contors|contour contour|contournait contourn|contournant contourn|contourne contourn|contours contour|contractait contract|contracté contract|contractée contract|contracter contract|contractés contract|contractions contract|contradictoirement contradictoir|contradictoires contradictoir|contraindre contraindr|contraint contraint|contrainte contraint|contraintes contraint|contraire contrair|contraires contrair|contraria contrari
main main|mains main|maintenaient mainten|maintenait mainten|maintenant mainten|maintenir mainten|maintenue maintenu|maintien maintien|maintint maintint|maire mair|maires mair|mairie mair|mais mais|maïs maï|maison maison|maisons maison|maistre maistr|maitre maitr|maître maîtr|maîtres maîtr|maîtresse maîtress|maîtresses maîtress|majesté majest|majestueuse majestu|majestueusement majestu|majestueux majestu|majeur majeur|majeure majeur|major major|majordome majordom|majordomes majordom|majorité major|majorités major|mal mal|malacca malacc|malade malad|malades malad|maladie malad|maladies malad|maladive malad"""


@pytest.mark.parametrize("config,listed", [("english", ENGLISH), ("french", FRENCH), ("simple", "running running|été été")])
def test_listed(spark, config, listed):
    want = dict(pair.split(" ") for pair in listed.replace("\n", "|").split("|"))
    rows = stems(spark.createDataFrame([(w, 7) for w in want], "word string, n int"), config)
    assert rows.columns == ["word", "n", "stem"]
    got = {r.word: r.stem for r in rows.collect()}
    assert {w: s for w, s in got.items() if s != want[w]} == {} and len(got) == len(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS word", [list(want)])
    assert dict(con.execute(stems_sql("SELECT word FROM words", config)).fetchall()) == want
