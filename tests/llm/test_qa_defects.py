import pytest

from lexmill.llm import qa_defects as Q

ASK = "Which facilities treated the injured person?"
CASES = [
    (None, "empty"), ("", "empty"), (" \t\n", "empty"), (" ", "empty"), ("​", "empty"), ("--", "empty"), ("[]", "empty"), ("n/a", "empty"), ("(no answer)", "empty"), ("Answer:", "empty"), ("...", "empty"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("With respect, I must decline to respond.", "refusal"), ("Sorry, as a language model I have no view on such matters.", "refusal"),
    ("Prefiero no opinar sobre este asunto.", "refusal"), ("This falls outside the topics I may discuss.", "refusal"), ("The request conflicts with my usage guidelines.", "refusal"),
    ('Counsel stated: "I can\'t stipulate to that," and the motion was adjourned.', None), ("The witness refused to answer on the advice of counsel.", None), ("No information about this point appears in the excerpts that were provided.", None),
    (ASK, "copied_question"), ("You asked: which facilities treated the injured person?", "copied_question"), (f"{ASK} {ASK}", "copied_question"), (ASK.upper(), "copied_question"), ("Which facilities treated the injured person...", "copied_question"),
    (f"Question: {ASK} Corvin Regional Hospital treated the injured person in May.", None),
    ("El juzgado desestimó la petición porque nadie había firmado el acta.", "wrong_language"), ("Das Gericht wies den Antrag ab, weil keine Zeugen benannt wurden.", "wrong_language"), ("Ответчик обязан возместить убытки в срок.", "wrong_language"),
    ('The seal reads "Amtsgericht, Abteilung für Nachlasssachen", and the answer is otherwise in English.', None),
    ("The second cause of action is barred because the", "truncated"), ("Upon arrival at the main production line, the emp", "truncated"), ("The list names (a) the crate and (b the gasket.", "truncated"), ('He said "we agreed to the terms.', "truncated"),
    ("Steps:\n1. Serve the notice.\n2.", "truncated"), ("Use this:\n```\nSELECT 1", "truncated"), ("<p>The court denied the motion.", "truncated"), ("It was denied on the ground that no fou…", "truncated"), ("The panel considered the report and", "truncated"),
    ("No", None), ("None.", None), ("03/21/2019", None), ("$233,327 plus interest", None), ("Robert Vouvumba; Jacqueline S. Maizzane", None), ("- Edward Drilveth\n- Björn Briblaine", None), ("Thoamardt Nursing Home, LLC and Jalvow Insurance Company", None),
    ("The order issued. See also the discussion of Ex. 14, infra", None), ('The court denied it. The list ends with "other items"', None), ("The court denied it. (remainder sealed)", None), ("On August 22, 2021.", None),
]


@pytest.mark.parametrize("answer,defect", CASES)
def test_defects(answer, defect):
    assert Q.defect_of(ASK, answer, answer) == defect


def test_option_values():
    assert Q.defect_of("¿Se ha transigido la controversia?", "settled", "El juzgado desestimó la petición porque nadie había firmado el acta.") is None
    assert Q.defect_of("Is it settled?", "", "Court. By letter dated May 4, the defense was tendered.") == "empty"
    assert Q.defect_of(None, "yes", "Yes. The court denied the motion.") is None


def brute_cover(q, a, least):
    """The longest common runs, one by one, without indexes; both sides are marked."""
    c, left = [False] * len(a), [-(-len(a) // len(q))] * len(q)
    while True:
        runs = [(k, -j, -i) for j in range(len(a)) for i in range(len(q)) for k in range(1, min(len(a) - j, len(q) - i) + 1) if a[j : j + k] == q[i : i + k] and not any(c[j : j + k]) and all(left[i : i + k])]
        k, j, i = max(runs, default=(0, 0, 0))
        if k < least:
            return c
        c[-j : -j + k] = [True] * k
        left[-i : -i + k] = [x - 1 for x in left[-i : -i + k]]


def test_tiling_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(120):
        q, a = ([r.choice("abc") for _ in range(r.randint(1, n))] for n in (7, 12))
        assert Q.tiles(q, a) == brute_cover(q, a, 2)


def test_nothing_depends_on_length():
    for n in (1, 2, 6, 10, 300):
        assert Q.defect_of(ASK, " ".join([ASK] * n), " ".join([ASK] * n)) == "copied_question"
    for n in (1, 10, 200):
        said = "The witness stated: \"" + "the crate fell, and " * n + "I can't help you with that answer\", and then left."
        assert Q.defect_of(ASK, said, said) is None
    assert Q.unquoted('a "b\nc" d 5" e “h „j“ k” l "m\n\nn') == 'a   d 5" e   l "m\n\nn'


def test_edges(spark):
    schema = "qa_id bigint, question_text string, answer_value string, answer_text string, defect string"
    long_ = "The court denied the motion. " * 4000
    rows = [(1, None, None, None, "x"), (2, ASK, long_, long_, "x"), (3, ASK, "n/a", "n/a", "x"), (3, ASK, "n/a", "n/a", "y"), (4, None, "Yes.", "Yes.", None)]
    got = sorted(map(tuple, Q.found(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, "empty"), (3, "empty")]
    assert Q.found(spark.createDataFrame([], schema)).collect() == []
