import random
from itertools import combinations

from lexmill.llm import lookalike as L

GROUPS = [
    ["The café owes naïve rent.", "The café owes naïve rent.", "Thе café оwes naïve rent.", "The café owes naïve　rent.", "The café ow​es naïve re­nt.", "Ｔｈｅ café owes naïve rent."],
    ["first office", "ﬁrst oﬃce"],
    ["a co-owner; here", "a co‑owner; here"],
    ["Москва и область", "Моcквa и облacть"],
]
APART = ["The cafe owes naive rent.", "The café owes naïve rents.", "THE café owes naïve rent.", "The  café owes naïve rent.", "The café owes\tnaïve rent.", "👨‍👩‍👧", "👨👩👧", "1", "l", "I", None, ""]


def test_found(spark):
    texts = [t for g in GROUPS for t in g] + APART
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id bigint, text string, raw int")
    got = {(texts[r.doc_id_a], texts[r.doc_id_b]) for r in L.found(df).collect()}
    assert got == {p for g in GROUPS for p in combinations(g, 2)}
    forms = {r.doc_id: r.text for r in L.canonical(df).collect()}
    for g in GROUPS:
        assert len({forms[texts.index(t)] for t in g}) == 1
    assert forms[texts.index("")] == "" and forms[texts.index(None)] is None
    assert L.found(df.limit(0)).collect() == []


def test_copies_make_no_pair(spark):
    df = spark.createDataFrame([(1, "café"), (2, "café"), (3, "café")], "doc_id bigint, text string")
    assert sorted(map(tuple, L.found(df).collect())) == [(1, 3), (2, 3)]


def test_automaton_costs():
    t = L.Trie([("résumé", 5), ("café", 9), ("cafés", 2)])
    assert t.search("cаfe\u0301") == [(0, "café", 9)]  # a Cyrillic letter, a mark by itself
    assert t.search("ca\u200bfé\xad") == [(0, "café", 9)]
    assert t.search("cafe") == []
    assert t.search("café", 1) == [(0, "café", 9), (1, "cafés", 2)]


def test_automaton_against_brute_force():
    """Costs are edit distances between what a reader sees."""
    r = random.Random(4)
    words = sorted({"".join(r.choice("aeoрé") for _ in range(r.randint(1, 4))) for _ in range(60)})
    trie = L.Trie([(w, 1) for w in words])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    looks = lambda t: [x for u in L.units(t) for x in u]
    for _ in range(60):
        t = "".join(r.choice("аaеoо\u0301\xadpе") for _ in range(r.randint(1, 5)))
        for budget in (0, 1):
            want = {w: d for w in words if (d := distance(looks(t), looks(w))) <= budget}
            assert {w: c for c, w, _ in trie.search(t, budget)} == want


def test_the_vocabulary_decides_the_spelling(spark):
    """роса in Cyrillic could be written in Latin letters throughout: by table it
    would be, but the corpus writes it in Cyrillic; with a text that has the Latin
    word, ASCII goes first, as ASCII texts stay as they are."""
    texts = ["роса и трава", "рoсa и трава", "роса\xad, роса"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in L.canonical(df).collect()} == {0: texts[0], 1: texts[0], 2: "роса, роса"}
    assert L.by_table("роса") == "poca"
    more = df.unionByName(spark.createDataFrame([(3, "poca")], df.schema))
    assert {r.text for r in L.canonical(more).collect()} == {"poca и трава", "poca, poca", "poca"}


def test_styles_and_scripts():
    for odd, plain in (("𝐓𝐡𝐞", "The"), ("ℂourt", "Court"), ("Ⅳ", "IV"), ("Ꭲhe", "The"), ("ﬃ", "ffi"), ("Ｑ", "Q")):
        assert L.by_table(odd) == plain
    assert L.by_table("ПОТОП") == L.by_table("ΠΟΤΟΠ")


def test_classes(spark):
    df = spark.createDataFrame([(1, "café"), (2, "cafe\u0301"), (3, "café"), (4, "cafe"), (5, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, L.classes(df).collect())) == [(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3), (4, 4, 1, 1)]


def test_very_long_text(spark):
    text = "Thе café " * 20000
    df = spark.createDataFrame([(1, text), (2, "x" * 200_000 + "é")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in L.canonical(df).collect()} == {1: "The café " * 20000, 2: "x" * 200_000 + "é"}
