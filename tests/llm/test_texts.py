"""Garbled and truncated texts."""

import random

from triagelake.llm import mojibake as B
from triagelake.llm import truncation as T

CLEAN = ["Höhe", "für", "größer", "também", "não", "réseau", "élévation", "разрез", "чертёж", "файл", "图层", "标注", "文件", "高さ", "レイヤー", "도면", "źródło", "posição"]
HARD = ["„29“", "± 75°", "½ \" × 3", "№ 5", "≤ 8 kN", "« 12 »", "ÂNGULO", "Å 3", "α = 2", "20 m²", "¿Cota 3?", "3‰", "µ = 2", "│ 30 │", "ЧЕРТЁЖ ТРЁХ", "Ö 4", "— “5” – ‘A’", "© plant", "图层plate.mnl"]


def garble(text, original, wrong):
    return text.encode(original).decode(wrong, "strict")


def tables(spark, values):
    r = spark.createDataFrame([("s", i, "string", v) for i, v in enumerate(values)], "sample_id string, idx int, kind string, value string")
    f = spark.createDataFrame([("s", ["plain", None, values[0]]), ("t", None), ("u", [])], "sample_id string, strings array<string>")
    return r, f


def test_garbled_values_are_found_and_restored(spark):
    cases = {}
    pairs = [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "gbk"), ("gbk", "latin-1"), ("cp1251", "cp1252"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp932", "latin-1"), ("cp949", "latin-1")]
    for w in CLEAN:
        for o, d in pairs:
            try:
                g = garble(w, o, d)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if g != w and any(ord(c) > 127 for c in g):
                cases[f"{g} 7"] = f"{w} 7"
    values = list(cases) + [w for w in CLEAN for _ in range(12)] + HARD * 12 + ["g�sty", None, "", "plain ascii"]
    got = {r.idx: r for r in B.restored(*tables(spark, values)).where("origin = 'resource'").collect()}
    found = {values[i] for i in got}
    assert not [v for v in (*CLEAN, *HARD) if v in found]
    assert "g�sty" in found and not got[values.index("g�sty")].restorable
    missed = [v for v in cases if v not in found]
    assert len(missed) <= 0.06 * len(cases), missed
    right = [v for i, r in got.items() if (v := values[i]) in cases and r.restored == cases[v]]
    assert len(right) >= 0.85 * len(cases)


def test_text_garbled_twice_and_in_part():
    twice = garble(garble("Höhe", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert B.analyse(twice)[:3] == ("spans", "Höhe", True)
    assert B.analyse("Lüftung")[0] is None
    assert B.decode_spans("xÃ¼y", "cp1252")[0] == "xüy"


def test_words_of_lost_continuations_only(spark):
    values = ["Ð?Ð?", "x Ð?Ñ?Ð?Ð? 7", "Ã?nÄ?", "MÃ?", "Å? Ö?"]
    got = {r.idx: r for r in B.restored(*tables(spark, values)).where("origin = 'resource'").collect()}
    assert set(got) == {0, 1, 2} and not any(r.restorable for r in got.values())
    # the third lead is the lost one; the others are letters of the word
    known = ["ÄnÄkóä"] * 12 + ["ÄnÄkÃä"]
    got = {r.idx: r.restored for r in B.restored(*tables(spark, known)).where("origin = 'resource'").collect()}
    assert got == {12: known[0]}


def test_routes_and_hot_words(spark, monkeypatch):
    """A word that most values hold is found in all of them; spans come first."""
    values = ["HÃ¶he Ã?nÄ?"] * 300 + ["g�sty", "Größe", "HÃ¶he g�sty"] + ["Höhe"] * 20
    got = {r.idx: r.route for r in B.restored(*tables(spark, values)).where("origin = 'resource'").collect()}
    assert got == {**dict.fromkeys(range(300), "spans"), 300: "lost", 302: "spans"}


def test_the_automaton():
    assert B.utf8_spans("aé漢".encode()) == [(1, 6)]
    assert B.utf8_spans(b"\xc0\x80\xed\xa0\x80\xf5\x80\xe9") == []
    assert B.utf8_spans(b"\xc3\xa9\xc3") == [(0, 2)]


def test_no_values(spark):
    r, f = tables(spark, ["plain"])
    assert B.found(r, f).count() == 0 and B.found(r.limit(0), f.limit(0)).count() == 0


def test_found_names_both_tables(spark):
    values = ["HÃ¶he"] + ["Höhe"] * 5
    got = {tuple(x) for x in B.found(*tables(spark, values)).collect()}
    assert got == {("resource", "s", 0), ("strings", "s", 2)}


SENTENCES = ["The loader builds its path from a list and a counter.", "Rule hits stayed below nine on most calls.", "Please compare the file with the older build.", "We do not know yet who wrote it, but the header matches.", "Nothing in it touches the registry, so the warning looks harsh."]


def documents(n=900, seed=1):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(3, 9)))
        if rng.random() < 0.3:
            text += rng.choice(["\nThanks in advance", "\nregards from the office", "\n(solved)", "\nAny hint is welcome..."])
        source = rng.choice(["a", "b", None])
        if source == "a" and len(text) > 300:
            text = text[:300]
            if text.rstrip()[-1] not in ".?!":
                cut.add(i)
        elif i % 13 == 0:
            text = text[: rng.randint(40, 120)].rstrip(" .") + rng.choice(["", "", "…", "\n[message clipped]"])
            cut.add(i)
        rows.append((i, source, text))
    return rows, cut


def test_truncation_on_held_out_texts(spark):
    rows, cut = documents()
    extra = [(5000, "a", None), (5001, "a", ""), (5002, "b", " \n"), (5003, "b", "x " * 20_000 + "end.")]
    df = spark.createDataFrame(rows + extra, "doc_id long, source string, text string").selectExpr("*", "1 as id", "2 as score")
    scores = {r.doc_id: r.score for r in T.scores(df).collect()}
    assert not {5000, 5001, 5002} & set(scores) and 5003 in scores
    got = {i for i, s in scores.items() if s >= T.THRESHOLD and i < 5000}
    assert len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got) > 0.9
    rates = {r.source: r for r in T.rates(df).collect()}
    assert set(rates) == {"a", "b", "(none)"} and rates["a"].rate > rates["(none)"].rate


def test_limits_of_every_source_are_known(spark):
    """A length at which most texts of a source end is a hot key, and no
    source is left out, however many there are."""
    rows, cut = documents()
    rows += [(10_000 + i, f"s{i % 40}", " ".join([SENTENCES[i % 5]] * 9)[: 150 + i % 40]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id for r in T.found(df).collect()}
    assert len(got & cut) / len(cut) > 0.85
    late = {i for i, _, t in rows if i >= 10_000 and t.rstrip()[-1] not in ".?!"}
    assert len(got & late) / len(late) > 0.9


def test_truncation_of_nothing(spark):
    s = "doc_id long, source string, text string"
    assert T.found(spark.createDataFrame([], s)).count() == 0
    assert T.found(spark.createDataFrame([(1, None, None), (2, "a", "One text.")], s)).count() == 0
