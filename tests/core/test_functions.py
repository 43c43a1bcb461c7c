import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"t {type_}").select(column("t").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Case No. 1:23-cv-12345", ["Case No. 1", "Case No. 1:23-cv-12345"]),
        ("INDEX NO: 123456/2024 and Docket No. 2024-12345", ["Docket No. 2024-12345", "INDEX NO: 123456/2024"]),
        ("nothing", []),
        (None, None),
    ],
)
def test_case_numbers(spark, text, want):
    assert one(spark, T.case_numbers, text) == want


@pytest.mark.parametrize("line,want", [("Page 1", True), ("page 1 of 10", True), ("- 5 -", True), ("42", True), ("12345", False), ("Pg. 7", True), ("3/9", True), ("1. Item", False), ("", False)])
def test_page_number_lines(spark, line, want):
    assert one(spark, lambda c: T.is_page_number(F.col(c)), line) is want


def test_normalize(spark):
    text = "short\nSUPREME COURT\nThis is a reason-\nable line of text that stays.\nPage 4\n12345 67890 12345 6a7\n"
    assert one(spark, T.normalize, text) == "SUPREME COURT\nThis is a reasonable line of text that stays."
    assert one(spark, T.normalize, "") == "" and one(spark, T.normalize, None) is None


def test_sanitize(spark):
    assert one(spark, T.sanitize, "a███b\tc\x00d​e  f\n\n\n\ng") == "a [REDACTED] b c de f\n\ng"


def test_transcripts(spark):
    assert one(spark, T.remove_line_numbers, "1   First\n25  Last\n26  kept\n|3 piped\nAt 5 pm") == "First\nLast\n26  kept\npiped\nAt 5 pm"
    assert one(spark, T.convert_qa, "Q. Where?\nA: There.\nA dog barked.") == "Question: Where?\nAnswer: There.\nAnswer: dog barked."


def test_tokens(spark):
    text = "The plaintiff's x-ray and Café naïve A1 b"
    assert one(spark, T.vocabulary_tokens, text) == ["plaintiff's", "x-ray"]
    assert one(spark, T.corpus_tokens, text) == ["plaintiff's", "x-ray", "a1", "b"][:3]
    assert one(spark, T.retrieval_tokens, text) == ["the", "plaintiff", "s", "x-ray", "and", "café", "naïve", "a1", "b"]
    assert one(spark, T.question_keywords, "What is the name of the plaintiff?") == ["name", "plaintiff"]


def test_sentences(spark):
    got = one(spark, T.sentences, "Dr. Smith testified on Jan. 15, 2024. He stated the injury was severe.")
    assert got == ["Dr.. Smith testified on Jan", "15, 2024.. He stated the injury was severe."]


@pytest.mark.parametrize("s,want", [(0, "0s"), (59, "59s"), (125, "2m 5s"), (3725, "1h 2m 5s")])
def test_duration(spark, s, want):
    assert one(spark, T.duration, s, "int") == want


def test_names_and_case_types(spark):
    assert one(spark, T.normalize_name, "Dr. John  O'Smith, Jr.") == "john osmith"
    assert one(spark, T.case_type, "Slip and fall with injury") == "personal injury"
    assert one(spark, T.case_type, "Piping dispute") == "personal injury"
    assert one(spark, T.case_type, " Zoning ") == "zoning"


def test_title_pages(spark):
    page = "SUPREME COURT OF THE STATE\nJOHN DOE, Plaintiff,\n -against- \nINDEX NO. 12/2020\n\fQ. Where?\nA. Here."
    assert one(spark, T.remove_title_pages, page) == "Q. Where?\nA. Here."
    assert one(spark, T.title_score, "Q. Where?\nA. Here.") == -6


def test_unicode(spark):
    from lexmill.functions import unicode as U

    assert one(spark, lambda c: U.plain_ascii(F.col(c)), "Ｃａfé “naïve” Łódź – ½") == 'Cafe "naive" Lodz - 1⁄2'
    assert one(spark, lambda c: U.plain_ascii(F.col(c)), None) is None
    assert one(spark, lambda c: U.plain_ascii(F.col(c)), "Ⅳ ﬁn — “ß” Æ… Привет 日本") == 'IV fin -- "ss" AE... Привет 日本'
    assert one(spark, lambda c: U.plain_ascii(F.col(c)), "e\u0301") == "e"
    assert one(spark, lambda c: U.fix_garbled(F.col(c)), "CafÃ© â€“ â€œÃ±andÃºâ€™s São") == "Café – “ñandú’s São"
    for text in ("Vila Âncora", "SÃO", "", "plain"):
        assert one(spark, lambda c: U.fix_garbled(F.col(c)), text) == text
