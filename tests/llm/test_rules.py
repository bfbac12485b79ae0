import re
from collections import Counter

from brindle.llm import rules

from .rows import WORD, empty, table


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
    seen, copies = set(), 0
    for line in t.split("\n"):
        copies += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_measures(spark):
    df = table(spark)
    want = {}
    for r in df.collect():
        want.setdefault(r["doc_id"], []).append(brute(r["text"]))
    got = rules.quality_rules(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert tuple(r[1:7]) in want[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty(spark)).count() == 0


def test_verdicts():
    prose = "\n".join(" ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(9)) + "." for i in range(12))
    nav = "\n".join(["Home | News | Sport | Weather | Travel | About"] * 1 + [f"Part{i} | Page{i} | Item{i} | Other{i} | More{i}" for i in range(12)])
    loud = " ".join(f"BUY{i}!!" for i in range(80))
    assert rules.judge(prose)["kept"]
    some = rules.judge(prose + "\n" + "All rights reserved." + "\n" + nav.split("\n")[0])
    assert some["kept"] and "rights" not in some["clean_text"] and "Home" not in some["clean_text"]
    assert not rules.judge(nav)["kept"] and not rules.judge(loud)["kept"] and not rules.judge(None)["kept"]
    assert rules.judge(prose)["clean_text"] == prose
    assert not rules.judge("\n".join(["The same line with several words stands here again."] * 30))["kept"]


def test_boilerplate_in_four_languages():
    for line in ("All rights reserved 2024", "Alle Rechte vorbehalten", "DATENSCHUTZERKLÄRUNG lesen", "Todos los derechos reservados", "Política de privacidad", "Tous droits réservés", "Conditions d'utilisation"):
        assert rules.line_fault(line, len(line.split()), rules.LineRules()) == "boilerplate", line
    assert rules.line_fault("Die Rechte der Leser sind gewahrt", 6, rules.LineRules()) is None
