import random

import pytest

from lexmill.llm import scans as S

BODY = "The court denied the motion because the parties never agreed on a delivery date."
#: What makes the vocabulary: filler rows that hold no noise.
WORDS = "the court denied motion because parties never agreed on a delivery date demand certificate of insurance was returned without guardianship order attached to amended complaint physician described wages and diminished earning capacity defendant long-standing out-of-pocket witness who saw it"
FILL = " ".join([WORDS] * 60)
KINDS = [
    ("The court denied the mo-\ntion because the parties agreed.", {"hyphen_break"}),
    ("The court denied the mo¬\n\nPage 3 of 9\n\ntion because the parties agreed.", {"hyphen_break", "page_number"}),
    ("The court denied the mo-" + "\n\nPage 3 of 9" * 12 + "\n\ntion because the parties agreed.", {"hyphen_break", "page_number"}),
    ("The physician described long-\nstanding wages and out-\nof-pocket demand.", set()),
    ("The court denied the m0tion because the parties agreed.", {"misread_chars"}),
    ("The rnotion was returned; the cornplaint was denied.", {"misread_chars"}),
    ("The cou~rt denied the mot¦ion.", {"misread_chars"}),
    (f"Index No. 256415/2022        Answer\n\n{BODY}", {"running_header"}),
    (f"CONFIDENTIAL - SUBJECT TO PROTECTIVE ORDER\n{BODY}", {"running_header"}),
    (f"{BODY}\nBRALLOVA PROPERTY MANAGEMENT LLC - ANSWER     51\n{BODY}", {"running_header", "page_number"}),
    (f"{BODY}\nBRALLOVA PROPERTY MANAGEMENT AND {'VERY ' * 30}LONG COMPANY LLC - ANSWER     51\n{BODY}", {"running_header", "page_number"}),
    (f"{BODY}\n\n- 33 -\n\n{BODY}", {"page_number"}),
    (f"{BODY}\nvii\n{BODY}", {"page_number"}),
    (f"PRAYER FOR RELIEF\n\n14. {BODY}", set()),
    ("2016    16,633.00\n2016    50,123.00", set()),
    ("Q.  Who prepared it?\nA. Yes.", set()),
    (BODY, set()),
]


def frame(spark, texts, fill=FILL):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(10_000, fill, "x")], "chunk_row_id bigint, chunk_text string, noise_kind string")


def test_kinds(spark):
    got = {}
    for r in S.found(frame(spark, [t for t, _ in KINDS])).collect():
        got.setdefault(r.chunk_row_id, set()).add(r.noise_kind)
    for i, (text, want) in enumerate(KINDS):
        assert got.pop(i, set()) == want, text
    assert not got


def test_repair(spark):
    texts = ["The court denied the m0tion be-\nPage 3\ncause the parties never\nagreed on a delivery date.", BODY]
    got = {r.chunk_row_id: (r.noise_kinds, r.chunk_text) for r in S.repair(frame(spark, texts)).collect()}
    assert got == {0: (["hyphen_break", "misread_chars", "page_number"], "The court denied the motion because the parties never agreed on a delivery date.")}


def test_a_plain_edit_needs_both_neighbours(spark):
    fill = " ".join([WORDS] * 2200)
    texts = ["It was a witnexs who saw it.", "It was the witnexs of it.", "They saw witnesses who saw it."]
    got = {r.chunk_row_id: r.chunk_text for r in S.repair(frame(spark, texts, "a witness who " * 10 + fill)).collect()}
    assert got == {0: "It was a witness who saw it."}


def test_neighbours_rank_equal_candidates(spark):
    """"tbe" and "hat" may be misread two ways: "bat" stands for "hat" or "bat"."""
    fill = ("the red hen saw one hen " * 3000) + ("a big ben rang " * 3000)
    got = {r.chunk_row_id: r.chunk_text for r in S.repair(frame(spark, ["the red 6en saw", "a big hcn rang"], fill)).collect()}
    assert got[1] == "a big hen rang" and got[0] == "the red ben saw"


@pytest.mark.parametrize("common, marks", [(1e-5, 32), (0.5, 1 << 20)])
def test_rare_candidates_are_ranked(spark, monkeypatch, common, marks):
    """Neighbours rank a candidate whatever its share of all words."""
    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "MARKS", marks, raising=False)
    fill = "we print each page " * 3000 + "they punt the ball " * 1000
    got = {r.chunk_row_id: r.chunk_text for r in S.repair(frame(spark, ["they pnnt the ball", "we pnnt each page"], fill)).collect()}
    assert (got[0], got[1]) == ("they punt the ball", "we print each page")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_candidates_are_complete():
    """The production call retrieves every vocabulary word one edit away, and every
    word that confusions turn into the token within the budget."""
    r = random.Random(5)
    words = {"".join(r.choice("abkxrnm") for _ in range(r.randint(5, 7))): 10 for _ in range(300)}
    trie = S.Trie(words)
    for _ in range(200):
        w = r.choice(list(words))
        i = r.randrange(len(w) - 1)
        t = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abkx") + w[i:], w[:i] + r.choice("abkx") + w[i + 1 :]])
        got = {x for x, _, _, edit in trie.candidates(t) if edit}
        if len(t) > 4:
            want = {x for x in words if levenshtein(t, x) == 1}
            # an edit of the last letter alone is left out
            assert {x for x in want if x[: len(t) - 1] != t[:-1]} <= got
        assert all(levenshtein(t, x) <= 1 or sorted(t) == sorted(x) for x in got)
    for w in list(words) * 3:
        t, i, n = "", 0, 0
        while i < len(w):
            fit = [x for x in S.CONFUSIONS if w.startswith(x[1], i)]
            seen, meant = r.choice(fit) if fit and n < 3 and r.random() < 0.4 else (w[i], w[i])
            n += seen != meant
            t, i = t + seen, i + len(meant)
        assert t == w or w in {x for x, _, c, edit in trie.candidates(t) if not edit and c <= S.BUDGET}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, (BODY + " ") * 2000 + "\n\n- 4 -\n\n" + BODY, "x"), (5, f"{BODY}\n\np. 9\n\n{BODY}", "x"), (5, f"{BODY}\n\np. 9\n\n{BODY}", "y")]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, chunk_text string, noise_kind string")
    assert sorted(map(tuple, S.found(df).collect())) == [(4, "page_number"), (5, "page_number")]
    assert sorted(r[0] for r in S.repair(df).collect()) == [4, 5]
    assert S.found(df.limit(0)).collect() == []


def test_common_and_short_misreadings(spark):
    n = {"the": 4000, "that": 2000, "had": 2600, "filed": 2500, "was": 2000, "filcd": 45, "tbat": 39, "thc": 23, "bad": 60, "no": 2000, "na": 24}
    fill = " ".join(" ".join([w] * k) for w, k in n.items() if w not in ("filcd", "tbat", "thc")) + " filcd" * 44 + " tbat" * 38 + " thc" * 22
    got = {r.chunk_row_id: r.chunk_text for r in S.repair(frame(spark, ["thc order tbat was filcd, had a bad copy na rua"], fill)).collect()}
    assert got[0] == "the order that was filed, had a bad copy na rua"
