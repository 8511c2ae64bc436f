"""Small fixtures for every operator: results, brute force, round trips, nulls, ties, empty tables, clashing names."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import budget, chunking, frequent, language, leakage, names, normalize, packing, sentences
from weftline.llm import queries as llm_queries
from weftline.llm import tokens as tok

TEXTS = "sent_id bigint, text string, language string, source string, domain string, form string"
EN = [
    "The board of Acme Works S.L. met Dr. Anna Bell on Monday. Nobody told J. K. Smith that the bridge would cost 3.50 EUR!",
    "We have been waiting for the ring road since 1999. Does Anna know whether Acme Works S.L. still pays for the library?",
    "The share of Acme Works S.L. rose by 3.5% last week. Please write to a.b@c.example if Carl Jones is not in town.",
    "According to Carl Jones, Acme Works S.L. moved because of the thaw. At 9.30 a.m. Anna Bell left the house... and never phoned again.",
]
DE = [
    "Der Vorstand von Acme Works S.L. traf am 3. Mai Frau Bell. Niemand sagte ihm, dass die Brücke 3,50 EUR kosten würde!",
    "Wir warten seit 1999 auf die neue Straße. Weiß Anna, ob die Firma noch für die Bibliothek zahlt?",
    "Die Aktie stieg letzte Woche um 3,5 Prozent. Bitte schreiben Sie an a.b@c.example, wenn Herr Jones nicht in der Stadt ist.",
    "Laut Carl Jones ist die Firma wegen des Tauwetters umgezogen. Das Zeichen gilt für diesen Eintrag.",
]


SINGLE_EN = [
    "The board of Acme Works S.L. met Dr. Anna Bell on Monday.", "We have been waiting for the ring road since 1999.", "The share of Acme Works S.L. rose by 3.5% last week.",
    "According to Carl Jones, Acme Works S.L. moved because of the thaw.", "Nobody told Anna Bell about Acme Works S.L.",
]
SINGLE_DE = ["Wir warten seit 1999 auf die neue Straße.", "Die Aktie stieg letzte Woche um 3,5 Prozent.", "Laut Carl Jones ist die Firma wegen des Tauwetters umgezogen."]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lab, "s", None, "x") for i, (t, lab) in enumerate(rows)], TEXTS)


# -- 3 -------------------------------------------------------------------------------------------------
def test_forms(spark):
    cases = ["Ａｃｍｅ", "Acme", "Ac​me", "Асme", "é", "é", "ậ", "ậ", "a b", "a b", "x²", "x2", "a–b", "a-b", "", None, "​", "각", "각", "Москва это"]
    d = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(cases)], "id bigint, text string, form string")
    got = {r["id"]: r["form"] for r in normalize.with_form(d, "text").collect()}
    f = [got[i] for i in range(len(cases))]
    assert f[0] == f[1] == f[2] == f[3] == "Acme" and f[4] == f[5] == "é" and f[6] == f[7] == "ậ" and f[8] == f[9]
    assert f[10] != f[11] and f[12] != f[13] and f[14] == "" and f[15] is None and f[16] == "" and f[17] == f[18] == "각" and f[19] == "Москва это"


def test_form_equals_python(spark):
    rng = random.Random(1)
    pool = "abeiouAé漢ｗ̣́ ​оеΑ。ำऩा 1²"
    cases = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(cases)), "id bigint, text string")
    for r in normalize.with_form(d, "text", script=False).join(d, "id").collect():
        assert r["form"] == unicodedata.normalize("NFC", "".join(map(normalize.fold_char, r["text"])))


def test_same_look_pairs(spark):
    rows = [("t", 1, None, "Acme"), ("t", 2, None, "Асme"), ("t", 3, None, "Acme"), ("t", 4, None, "acme"), ("t", 5, None, None), ("e", 1, 7, "Acme"), ("e", 2, 7, "Ａcme"), ("e", 3, 8, "Ａcme"), ("e", 2, 7, "Ａcme")]
    d = spark.createDataFrame(rows, "tbl string, id bigint, grp bigint, text string")
    assert {tuple(r) for r in normalize.same_look_pairs(d).collect()} == {("t", 1, 2), ("t", 2, 3), ("e", 1, 2)}
    assert normalize.same_look_pairs(d.limit(0)).count() == 0
    c = normalize.same_look_classes(d).collect()
    assert {(r["tbl"], r["id"]) for r in c} == {("t", 1), ("t", 2), ("t", 3), ("e", 1), ("e", 2)} and len(c) == 5 and {r["n_variants"] for r in c} == {2}


def test_large_classes_are_split(spark):
    looks = ["Acme", "Асme", "Ａcme"]
    d = spark.createDataFrame([("t", k, None, looks[k % 3]) for k in range(60)], "tbl string, id bigint, grp bigint, text string")
    every = {("t", a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}
    for split in (7, 2_000):
        assert {tuple(r) for r in normalize.same_look_pairs(d, split).collect()} == every


def test_look_alikes_of_further_alphabets(spark):
    cases = ["ACME", "\u13aa\u13df\u13b7\u13ac", "\u2c80\u2ca4\u2c98\u2c88", "\ua4ee\ua4da\ua4df\ua4f0"]
    d = spark.createDataFrame([("t", k, None, t) for k, t in enumerate(cases)], "tbl string, id bigint, grp bigint, text string")
    got = {(r["id_a"], r["id_b"]) for r in normalize.same_look_pairs(d).collect()}
    assert got == {(a, b) for a in range(4) for b in range(a + 1, 4)}


# -- 5 -------------------------------------------------------------------------------------------------
def test_frequent_values_and_bounds(spark):
    rng = random.Random(2)
    vals = ["hot"] * 700 + ["warm"] * 20 + [f"v{rng.randrange(900)}" for _ in range(1300)] + [""] * 30 + [None] * 50
    d = spark.createDataFrame([("l", v, i) for i, v in enumerate(vals)], "label string, text string, lower int").repartition(7)
    got = {r["text"]: r for r in frequent.heavy_hitters(d, ["label", "text"], 0.01, width=64).collect()}
    true = d.na.drop(subset=["text"]).groupBy("text").count().filter("count >= 20.5").collect()
    assert set(got) == {r["text"] for r in true}
    for r in true:
        assert got[r["text"]]["lower"] <= r["count"] == got[r["text"]]["n"] <= got[r["text"]]["upper"]
    assert frequent.heavy_hitters(d.limit(0), ["label", "text"], 0.01).count() == 0
    bounds = frequent.heavy_hitters(d, ["label", "text"], 0.01, width=64, exact=False).collect()
    assert {r["text"] for r in bounds} >= set(got) and all(r["lower"] <= got[r["text"]]["n"] <= r["upper"] for r in bounds if r["text"] in got)
    rare = frequent.heavy_hitters(d, ["label", "text"], 0.0005, width=4, most_width=8)  # no certificate within the bound: exact grouping
    assert {(r["text"], r["n"]) for r in rare.collect()} == {(r["text"], r["count"]) for r in d.na.drop(subset=["text"]).groupBy("text").count().filter("count >= 2").collect()}


def test_sketch_bounds_hold_for_all(spark):
    rng = np.random.default_rng(4)
    vals = rng.zipf(1.3, 20_000) % 5000
    parts = [frequent.Sketch(32, 3) for _ in range(4)]
    for k, s in enumerate(parts):
        for chunk in np.array_split(vals[k::4].astype(np.int64), 5):
            s.add(*np.unique(chunk, return_counts=True))
    whole = frequent.Sketch(32, 3)
    for s in parts:
        f = s.frame()
        whole.merge(*(f[c].to_numpy(dtype=np.int64) for c in ("cell", "v", "k", "c")))
    h, n = np.unique(vals.astype(np.int64), return_counts=True)
    lower, upper = whole.bounds(h)
    assert (lower <= n).all() and (n <= upper).all()


# -- 8 -------------------------------------------------------------------------------------------------
def test_passages(spark):
    ask = "Read this with care and answer. "
    p = ["the quick brown fox jumps over one lazy dog near seven old green boats today", "a small red kite flew above nine quiet hills before winter came to the valley again"]
    items = spark.createDataFrame([(1, ask + p[0]), (2, ask + p[1]), (3, ask + "unrelated words only stand here for a third test item so nothing fits at all"), (4, None), (5, "")], "item_id bigint, text string")
    w = p[0].split()
    filler = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame(
        [(1, filler + " " + p[0].upper() + " " + filler), (2, " ".join(w[:9])), (3, " ".join(w[:4])), (4, ask), (5, None), (6, ""), (7, "the quick. BROWN foxx jumps over one — lazy dog"), (8, " ".join(w[:5] + ["x"] * 12 + w[5:])), (9, " ".join(sorted(w)))],
        "doc_id bigint, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_passages(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (7, 1), (8, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_passages(docs, items, block=1).collect()} >= {(1, 1), (2, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_passages(docs, items, phrase=True).collect()} == {(1, 1)}
    assert leakage.find_passages(docs.limit(0), items).count() == 0 and leakage.find_passages(docs, items.limit(0)).count() == 0


def test_repeated_passages_are_searched(spark):
    p = "The quick brown fox jumps over one lazy dog. Seven old green boats came home before winter today."
    ask = "Read this with care and answer."
    items = spark.createDataFrame([(1, p), (2, p), (3, p), (4, p.lower()), (5, ask), (6, ask + " Six red kites flew."), (7, ask + " Nine quiet hills stood.")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so it was " + p + " and so on"), (2, "six red kites flew")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_passages(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 6)}
    assert got == {(r["doc_id"], r["item_id"]) for r in leakage.find_passages(docs, items, block=1).collect()}
    assert {r["item_id"]: r["words"] for r in leakage.passages(items).collect()}[5] == leakage.words(ask)


def test_what_a_stretch_is(spark):
    w = [f"a{k}" for k in range(20)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    cases = [
        (1, [x for v in w for x in (v, "zz")], True),  # a foreign word after each
        (2, w[:10] + ["zz"] * 60 + w[10:], True),  # one foreign stretch
        (3, w[:8] + ["zz"] * 61 + w[8:16], False),  # longer than slack
        (4, w[:4] + ["zz"] * 9 + w[4:8] + ["zz"] * 9 + w[8:12], False),  # scattered phrases
        (5, w[:3] + w[6:9] + w[12:16], True),  # words missing, half of them there
        (6, list(reversed(w)), False), (7, w[:9], False), (8, w[:5] + w[15:], True),
    ]
    docs = spark.createDataFrame([(i, " ".join(["yy"] * 50 + t + ["yy"] * 50)) for i, t, _ in cases], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_found"] for r in leakage.find_passages(docs, items).collect()}
    assert set(got) == {i for i, _, found in cases if found} and got[1] == got[2] == 20 and got[5] == got[8] == 10


def test_best_chain_equals_brute_force():
    def slow(m, near, slack):
        best = {}
        for i, (p, o) in enumerate(m):
            best[i] = [1, 1]
            for k, (q, u) in enumerate(m[:i]):
                if q < p and u < o and p - q <= slack + 1:
                    if p - q <= near and o - u <= near:
                        best[i] = [max(a, b + 1) for a, b in zip(best[i], best[k])]
                    best[i][1] = max(best[i][1], best[k][0] + 1)
        return max(b[1] for b in best.values())

    rng = np.random.default_rng(12)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        m = sorted({(int(rng.integers(0, 90)), int(rng.integers(0, 25))) for _ in range(n)}, key=lambda x: (x[0], x[1]))
        pos, off = np.array([p for p, _ in m]), np.array([o for _, o in m])
        true = slow(m, 4, 20)
        for need in (1, true, true + 1):
            assert leakage.best_chain(pos, off, need, 4, 20) == (true if true >= need else 0)


# -- 4 -------------------------------------------------------------------------------------------------
def test_edits_against_brute_force():
    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert names.edits(a, b) == slow(a, b)


def test_link_names(spark):
    reg = spark.createDataFrame([(1, "Joaquim Zelbert", "person"), (2, "Acmero Textiles S.L.", "organization"), (3, "Anna Zelbert", "person"), (4, "Brunel & Kostava Inc.", "organization"), (5, "João Zelbert", "person"), (6, "Brunav Textiles Ltd.", "organization"), (7, "Corvidal Textiles Inc.", "organization")], "ref_id bigint, name string, label string")
    good = {"Zelbert, Joaquim": 1, "Quim Zelbert": 1, "Joaqium Zelbert": 1, "ANNA ZELBERT": 3, "A. Zelbert": 3, "Acmero Text. SL": 2, "Textiles Acmero S.L.": 2, "Acmero Textiles Sociedad Limitada": 2, "Acmeor Textiles": 2, "Brunel and Kostava Incorporated": 4, "Joaquim M. Zelbert": 1, "JoaquimZelbert": 1}
    bad = ["J. Zelbert", "Birgit Zelbert", "Acmero Shipping SARL", "Acmero Textiles GmbH", "Joaquim Zelbert", "Joaquim Zelbert", "12/05/1990", "", None, "Telville"]
    rows = [(i, t, 0) for i, t in enumerate([*good, *bad])]
    d = spark.createDataFrame(rows, "entity_id bigint, text string, ref_id int")
    got = {r["entity_id"]: r["ref_id"] for r in names.link_mentions(d.unionByName(d), reg).collect()}
    assert got == {i: good[t] for i, t, _ in rows if t in good}
    assert names.link_mentions(d, reg.limit(0)).count() == 0 and names.link_mentions(d.limit(0), reg).count() == 0
    assert got == {r["entity_id"]: r["ref_id"] for r in names.link_mentions(d, reg, block=1, split=2).collect()}


#: Names that share nothing with the project's tables: no name of the register, other legal forms.
OTHERS = [
    (1, "Thomas Wexham", "person"), (2, "Anthony Corvane", "person"), (3, "Barbara Milvane", "person"), (4, "Michael Astbury", "person"), (5, "Nicholas Penhallow", "person"),
    (6, "Patricia Uxbridge", "person"), (7, "Christopher Yarrow", "person"), (8, "Alexander Quimby", "person"), (9, "Mogens Kjeldsen", "person"), (10, "Rebecca Thistlewood", "person"),
    (11, "Acmero Textiles AG", "organization"), (12, "Corvidal Metals LLC", "organization"), (13, "Studio54 Records SL", "organization"), (14, "Nordhavn Shipping ApS", "organization"),
    (15, "Brandal Fisk AS", "organization"), (16, "Wolvercote Paper PLC", "organization"), (17, "Tolvane Optics BV", "organization"), (18, "Ostrava Steel s.r.o.", "organization"), (19, "Kanto Denki KK", "organization"), (20, "Zubiri Foods SA", "organization"),
]
TYPED = {
    "Tom Wexham": 1, "Wexham, Thomas": 1, "T. Wexham": 1, "Thomsa Wexham": 1, "Tony Corvane": 2, "Anthony Corvnae": 2, "Babs Milvane": 3, "Barbara B. Milvane": 3, "Mike Astbury": 4, "MICHAEL ASTBURRY": 4,
    "Nick Penhallow": 5, "Penhalow Nicholas": 5, "Trish Uxbridge": 6, "Patrica Uxbridge": 6, "Chris Yarrow": 7, "ChristopherYarrow": 7, "Alex Quimby": 8, "Alexander Qiumby": 8, "Mogens Kjeldsn": 9, "Becky Thistlewood": 10, "R. Thistlewood": 10,
    "Acmero Textiles A.G.": 11, "Acmero Text. Aktiengesellschaft": 11, "Corvidal Metals L.L.C.": 12, "Corvidal Metals Limited Liability Company": 12, "Studio54 Recrods SL": 13, "Acmero Textiles AG (2)": 11, "Studi054 Records S.L.": 13, "Studio 54 Records SL": 13,
    "Nordhavn Shiping ApS": 14, "Brandall Fisk": 15, "Wolvercote Paper Public Limited Company": 16, "Optics Tolvane B.V.": 17, "Ostrava Stele sro": 18, "Kanto Denki K.K.": 19, "Zubiri Foods Sociedad Anónima": 20, "Zubiri Foods S. A.": 20,
}


def test_names_outside_the_project(spark):
    reg = spark.createDataFrame(OTHERS, "ref_id bigint, name string, label string")
    no = ["Tom Milvane", "Nordhavn Shipping SARL", "Uxbridge", "Records SL", "Michael Quimby", "12 May 1990", "Zubiri Metals SA", "a.b@c.example", "Kjeldsen & Sons"]
    rows = list(enumerate([*TYPED, *no]))
    got = {r["entity_id"]: r["ref_id"] for r in names.link_mentions(spark.createDataFrame(rows, "entity_id bigint, text string"), reg).collect()}
    right = sum(got.get(i) == TYPED[t] for i, t in rows if t in TYPED)
    assert right / len(TYPED) >= 0.9 and not [t for i, t in rows if t in no and i in got] and all(TYPED[rows[i][1]] == k for i, k in got.items())


def test_words_are_counted_over_the_whole_register(spark):
    reg = spark.createDataFrame([(k, f"{w} Textiles S.L.", "organization") for k, w in enumerate(("Acmero", "Brunav", "Corvidal"))], "ref_id bigint, name string, label string")
    d = spark.createDataFrame([(1, "Acmero Text. SL"), (2, "Brunv Textiles")], "entity_id bigint, text string")
    one, many = ({tuple(r) for r in names.link_mentions(d, reg, block=b, split=1).collect()} for b in (1, 20_000))
    assert one == many == {(1, 0), (2, 1)}


def test_short_forms_are_learned(spark):
    surnames = [a + b for a in ("Wex", "Corv", "Milv", "Astb", "Penh", "Uxbr") for b in ("ane", "ury", "ollow", "idge")]
    reg = [(k, f"{'Zebedee' if k % 3 == 0 else 'Ottoline' if k % 3 == 1 else 'Ferelith'} {s}", "person") for k, s in enumerate(surnames)]
    said = [(k, f"Zuzu {s}") for k, s in enumerate(surnames) if k % 3 == 0] + [(100 + k, f"Birgit {s}") for k, s in enumerate(surnames)]
    got = {r["entity_id"]: r["ref_id"] for r in names.link_mentions(spark.createDataFrame(said, "entity_id bigint, text string"), spark.createDataFrame(reg, "ref_id bigint, name string, label string")).collect()}
    assert got == {k: k for k in range(0, len(surnames), 3)}


def test_bands_find_what_brute_force_finds(spark):
    reg = spark.createDataFrame(OTHERS, "ref_id bigint, name string, label string")
    rng = random.Random(9)

    def mistyped(t):
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(1, len(t) - 1)
            t = rng.choice([t[:k] + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[:k] + rng.choice("aeinrst") + t[k + 1 :], t[:k] + t[k] + t[k:]])
        return t

    texts = sorted({mistyped(n) for _, n, _ in OTHERS for _ in range(30)})
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["text"], r["ref_id"]) for r in names.link_names(d, reg, exact=True).collect()}
    known = [names.Entry(i, n, k, [], [], []) for i, n, k in OTHERS]
    every = set()
    for t in texts:
        ws, legal, whole = names.parse(t)
        s = sorted(((e.similarity(names.comparison_form(t), ws, legal, whole), e.ref_id) for e in known), reverse=True)
        if s[0][0] >= 0.78 and s[0][0] > s[1][0]:
            every.add((t, s[0][1]))
    assert got <= every and len(got) >= 0.97 * len(every)


def test_band_plan_follows_the_collision_curve():
    b, r = names.plan_bands(0.4, 0.985)
    assert 1 - (1 - 0.4**r) ** b >= 0.985 > 1 - (1 - 0.4**r) ** (b - 1)


# -- 1 and 2 -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(t, "en") for t in EN * 6] + [(t, "de") for t in DE * 6]
    single = [(s, lab) for ts, lab in ((SINGLE_EN, "en"), (SINGLE_DE, "de")) for s in ts] * 2
    rows += [(EN[0], "de"), (DE[1], None), (EN[1] + " " + DE[2], "en"), (None, "en"), ("", None), ("   ", ""), ("XQ12345 +00-11-222", None), (EN[2], "eng"), (DE[0], "de_AT"), (DE[3], "??")]
    return table(spark, rows + single)


def test_mislabelled(mixed):
    got = {}
    for r in language.mislabelled(mixed).collect():
        got.setdefault(r["sent_id"], set()).add(r["language"])
    assert got == {48: {"en"}, 49: {"de"}, 50: {"en", "de"}, 57: {"de"}}


def test_segments_cover_languages(mixed):
    u = language.classify_units(mixed)
    seg = [(r["segment"], r["language"]) for r in language.segments(u).filter("sent_id = 50").orderBy("segment").collect()]
    assert seg == [(0, "en"), (1, "de")]
    main = {r["sent_id"]: r for r in language.text_languages(u).collect()}
    assert main[54]["language"] is None and main[54]["confidence"] == 0 and 0.5 < main[0]["confidence"] <= 1 and 51 not in main


def test_texts_and_units_agree(mixed):
    a = {r["sent_id"]: (r["found"], round(r["confidence"], 6)) for r in language.classify_texts(mixed, {"sent_id": F.col("sent_id"), "form": F.col("form")}).collect()}
    b = {r["sent_id"]: (r["language"], round(r["confidence"], 6)) for r in language.text_languages(language.classify_units(mixed)).collect()}
    assert set(a) == {r["sent_id"] for r in mixed.collect()} and {k: v for k, v in a.items() if k in b} == b
    assert all(v == (None, 0.0) for k, v in a.items() if k not in b)


@pytest.mark.parametrize("rows", [[("Nobody told Anna.", "en")], [("Nobody told Anna.", "en"), ("We have been waiting.", "en")], [("Nobody told Anna", None)], [("...", "en"), ("?", "de")], [("12", "12"), (".", "x")]])
def test_tiny_tables(spark, rows):
    d = table(spark, rows)
    assert sentences.split_sentences(d).count() == len(rows)
    assert sum(r["n_texts"] for r in budget.token_budget(d).collect()) == len(rows)
    assert {r["language"] for r in language.mislabelled(d).collect()} <= {"en"}


def test_labels_without_support_are_no_languages(spark):
    d = table(spark, [(EN[0], "en")] * 40 + [(EN[0], "abc")] * 5 + [(EN[0], "qz")] * 5)
    assert {r["found"] for r in language.classify_texts(d, {"sent_id": F.col("sent_id")}).collect()} == {"en"}
    assert {r["sent_id"] for r in language.mislabelled(d).collect()} == set(range(40, 50))


def test_ordinals_do_not_end_sentences(spark):
    base = ["Wir warten seit dem 27. März auf die Autobahn. Niemand sagte es ihm.", "Am 12. Mai traf er die Mitarbeiter. Die Aktie stieg um 3 Prozent.", "Es gilt ab dem 3. Juni nach Vereinbarung. Wir warten seit 1999."]
    d = table(spark, [(t, "de") for t in base * 200] + [("Er zahlte 27.", "de")] * 3)
    got = {tuple(r) for r in sentences.split_sentences(d).filter("sent_id = 0").collect()}
    assert len(got) == 2


def test_empty_tables(mixed):
    e = mixed.limit(0)
    assert language.mislabelled(e).count() == 0 and sentences.split_sentences(e).count() == 0 and budget.token_budget(e).count() == 0


def test_units(spark, mixed):
    got = {}
    for r in sentences.split_sentences(mixed, with_text=True).orderBy("char_start").collect():
        got.setdefault(r["sent_id"], []).append(r["unit"])
    assert [len(got[i]) for i in range(4)] == [2, 2, 2, 2] and got[3][1].startswith("At 9.30 a.m. Anna")
    assert len(got[24]) == 2 and "3. Mai Frau" in got[24][0] and got[54] == ["XQ12345 +00-11-222"] and 51 not in got and 53 not in got


def test_splitter_is_fitted_on_all_texts(spark):
    rare = ["We read vgk. Anna wrote the rest of it.", "They met vgk. Carl in the old town."] * 3
    plain = ["Nobody told Anna. We have been waiting.", "We have been waiting. Nobody told Anna."] * 15_000
    d = spark.createDataFrame(list(enumerate(plain + rare)), "sent_id bigint, text string").repartition(8)
    got = {tuple(r) for r in sentences.split_sentences(d).filter(f"sent_id >= {len(plain)}").collect()}
    assert got == {(len(plain) + k, 0, len(t)) for k, t in enumerate(rare)}


def test_whole_texts_are_fitted(spark):
    long = "Nobody told Anna. We have been waiting. " * 120
    d = spark.createDataFrame([(k, long + f"We read vgk. Anna wrote {k} of it.") for k in range(6)], "sent_id bigint, text string")
    last = sentences.split_sentences(d, with_text=True).groupBy("sent_id").agg(F.max_by("unit", "char_start").alias("u")).collect()
    assert {r["u"] for r in last} == {f"We read vgk. Anna wrote {k} of it." for k in range(6)}


def test_whole_labelled_texts_are_fitted(spark):
    d = table(spark, [("7 " * 10_500 + "\n" + " ".join(t), lab) for t, lab in ((EN, "en"), (DE, "de"))])
    got = {(r["sent_id"], r["language"]) for r in language.text_languages(language.classify_units(d).filter("full_sentence")).collect()}
    assert got == {(0, "en"), (1, "de")}


def test_distributed_fit_equals_fit_in_memory(spark):
    texts = EN * 5 + DE * 5 + SINGLE_EN * 2 + SINGLE_DE * 2 + ['He said: "Go. Now." (It was late.) Then he left', "สวัสดี ครับ", "12 34", ""]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    a, b = sentences.train(texts), sentences.fit(d, "text")
    assert a.lexicon == b.lexicon and a.short == b.short
    mine, other = ({r[:3]: r[3:] for r in m.rows()} for m in (a, b))
    assert all(other.get(k, (0.0, 0.0)) == pytest.approx(v, abs=1e-3) for k, v in mine.items()) and set(other) <= set(mine)


def test_unit_rules():
    m = sentences.train(EN * 5 + DE * 5 + SINGLE_EN * 2 + SINGLE_DE * 2)
    cut = lambda t: [t[a:b] for a, b in sentences.units(t, m)]
    assert cut("Title here\nWe have been waiting.") == ["Title here", "We have been waiting."]
    assert cut("(Nobody told Anna.) We have been waiting.") == ["(Nobody told Anna.)", "We have been waiting."]
    assert cut("“Is it safe? Nobody knows.” was all she wrote.") == ["“Is it safe? Nobody knows.” was all she wrote."]
    assert cut("หุ้นของ Acme ขึ้น คุณทราบไหม") == ["หุ้นของ Acme ขึ้น", "คุณทราบไหม"]
    assert cut("  We have been waiting.  ") == ["We have been waiting."] and cut("") == []


# -- 6, 7 and 9 ----------------------------------------------------------------------------------------
def corpus():
    rng = random.Random(6)
    pool = [*EN, *DE, "漢字かな交じり文です。これは長い文です！", "ภาษาไทยไม่มีช่องว่าง", "x" * 900, "😀👍🏽 é ²½ ١٢٣", " \n\n\t  ", "a'll 'S don't"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", None]


def test_tokens_are_exact(spark):
    enc = tok.encoding(tok.default_vocabulary())
    counts = tok.PieceCounts(tok.default_vocabulary(), most=50)
    docs = corpus()
    for t in docs[:-1]:
        assert counts.count(t) == len(enc.encode_ordinary(t)) == sum(counts.pieces(t)[1] if t else [0])
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "id bigint, text string, n_tokens int")
    got = {r["id"]: r["n_tokens"] for r in budget.document_tokens(d, "id").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(docs)}


def test_budget_totals(spark, mixed):
    enc = tok.encoding(tok.default_vocabulary())
    got = {(r["language"], r["domain"]): (r["n_texts"], r["n_tokens"]) for r in budget.token_budget(mixed).collect()}
    assert sum(n for n, _ in got.values()) == mixed.count() and {k[1] for k in got} == {"unknown"}
    assert sum(t for _, t in got.values()) == sum(len(enc.encode_ordinary(r["text"] or "")) for r in mixed.collect())


def test_packing(spark):
    docs = corpus() * 3
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id bigint, text string, part int")
    enc = tok.encoding(tok.default_vocabulary())
    rows = packing.pack(d, capacity=700).collect()
    load, per = {}, {}
    for r in rows:
        load.setdefault((r["shard"], r["container"]), []).append((r["position"], r["n_tokens"]))
        per.setdefault(r["doc_id"], []).append(r["n_tokens"])
    for parts in load.values():
        assert sum(n for _, n in parts) <= 700
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    sizes = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(docs)}
    assert {i: sum(p) for i, p in per.items()} == {i: n for i, n in sizes.items() if n}
    assert all(len(p) == 1 for i, p in per.items() if sizes[i] <= 700)
    assert sum(sizes.values()) / (700 * len(load)) > 0.9
    assert packing.pack(d.limit(0)).count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (100, 20), (30, 26)])
def test_chunks(spark, limit, overlap):
    docs = corpus()
    d = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], "doc_id bigint, text string, piece string")
    enc = tok.encoding(tok.default_vocabulary())
    got = {}
    for r in chunking.chunk_texts(d, limit=limit, overlap=overlap).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, t in enumerate(docs) if t and len(enc.encode_ordinary(t)) > limit}
    for i, parts in got.items():
        assert [p["piece"] for p in parts] == list(range(len(parts))) and parts[0]["char_start"] == 0 and parts[-1]["char_end"] == len(docs[i])
        for p in parts:
            assert p["text"] == docs[i][p["char_start"] : p["char_end"]] and 0 < p["n_tokens"] <= limit and p["n_overlap"] <= overlap
        for a, b in zip(parts, parts[1:]):
            assert a["char_start"] < a["char_end"] and b["char_start"] <= a["char_end"] < b["char_end"]


def test_abbreviations_are_no_ends():
    path = tok.default_vocabulary()
    t = "Dr. Bell met J. Smith. They left, etc. and so on! Fine."
    chars, _, strength = chunking.boundaries(t, tok.PieceCounts(path), 64, path)
    assert [t[:c] for c, s in zip(chars.tolist(), strength.tolist()) if s == chunking.SENTENCE] == ["Dr. Bell met J. Smith.", "Dr. Bell met J. Smith. They left, etc. and so on!", t]


def test_pointer_doubling_equals_walking():
    rng = np.random.default_rng(8)
    nxt = np.minimum(np.arange(200) + rng.integers(1, 6, 200), 199)
    walk, at = {0}, 0
    while at != nxt[at]:
        at = nxt[at]
        walk.add(at)
    assert set(chunking.reached(np.array([0]), nxt).tolist()) == {int(x) for x in walk}


# -- the registered queries ------------------------------------------------------------------------------
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_registered_queries_run(spark, name):
    d = llm_queries.queries()[name](spark, SF)
    rows = d.collect()
    assert d.columns and (rows or name in ("p5_bounds",))
    if name.endswith("_found"):
        wanted = {"p1": ["sent_id", "language"], "p2": ["sent_id", "char_start", "char_end"], "p3": ["tbl", "id_a", "id_b"], "p4": ["entity_id", "ref_id"], "p5": ["label", "text"], "p8": ["doc_id", "item_id"]}
        assert d.columns == wanted[name[:2]] and len(set(rows)) == len(rows)


def test_frequent_values_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW extracted_entity AS SELECT * FROM '{SF}/extracted_entity.parquet'")
    assert {tuple(r) for r in llm_queries.p5_found(spark, SF).select("label", "text").collect()} == set(c.execute(llm_queries.oracle_sql()["p5_found"]).fetchall())


def test_forms_of_the_table_equal_python(spark):
    texts = {r["sent_id"]: r["text"] for r in spark.read.parquet(f"{SF}/test_sentences.parquet").collect()}
    got = {r["sent_id"]: r["form"] for r in normalize.with_form(spark.read.parquet(f"{SF}/test_sentences.parquet"), "text", script=False).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", "".join(map(normalize.fold_char, t))) for i, t in texts.items()}


def test_containers_of_several_shards(spark):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(corpus() * 3)], "doc_id bigint, text string, part int")
    enc = tok.encoding(tok.default_vocabulary())
    rows = packing.pack(d, capacity=700, shard_tokens=12_000).collect()
    load = {}
    for r in rows:
        load[r["shard"], r["container"]] = load.get((r["shard"], r["container"]), 0) + r["n_tokens"]
    total = sum(len(enc.encode_ordinary(t or "")) for t in corpus() * 3)
    assert len({s for s, _ in load}) > 1 and max(load.values()) <= 700 and sum(load.values()) == total and total / (700 * len(load)) > 0.85
