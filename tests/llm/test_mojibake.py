"""Exact round trips: clean text garbled by a known pair must come back."""

import pytest

from lexmill.llm import mojibake as M

CLEAN = [
    "The café’s lease – governed by § 53 of the civil code – names “Société Béranne” as guarantor.",
    "La compañía Ñandú notificó el daño según el artículo 5º; el señor Peñalba pagó €45.",
    "Grüßner Präzision GmbH halted the pour in Żarnowiec, priced at £12 plus ½ of the freight…",
]
NOT_GARBLED = [
    "SÃO TELMÁRIO", "Vila Âncora", "Atelié “Ângela” – naïve façade", "Привет, мир: съезд № 5", "Ελληνικά κείμενα", "日本語の文章", "plain ASCII text", "“Å” and ‘é’", "Íñigo çã üß ñí", "50 °C ± 2 µm × 3 ÷ 4",
]


def garble(text: str, page: str) -> str:
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("page", ["cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251"])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(text, page):
    bad, fixed, pages, whole = M.restore(garble(text, page))
    assert bad and fixed == text and whole and pages


@pytest.mark.parametrize("text", CLEAN)
def test_twice(text):
    assert M.restore(garble(garble(text, "cp1252"), "cp1252"))[1] == text


@pytest.mark.parametrize("text", NOT_GARBLED + CLEAN)
def test_clean_text_stays(text):
    assert M.restore(text)[:2] == (False, text)


def test_part_of_a_text_and_lost_characters():
    bad, fixed, _, whole = M.restore("Café Élysande owes " + garble("¥12 – Señor", "cp1252") + " and São Telmário")
    assert bad and whole and fixed == "Café Élysande owes ¥12 – Señor and São Telmário"
    assert M.restore("Caf� Nuevo") == (True, "Caf� Nuevo", "lost", False)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, garble(CLEAN[0], "cp1252"), "x"), (4, garble(CLEAN[0], "cp1252"), "y"), (5, garble(CLEAN[1], "cp850") * 3000, "x")]
    df = spark.createDataFrame(rows, "chunk_row_id bigint, chunk_text string, restored_text string")
    assert sorted(r[0] for r in M.found(df).collect()) == [4, 5]
    got = {r.chunk_row_id: r.restored_text for r in M.repair(df).collect()}
    assert got[5] == CLEAN[1] * 3000
    assert M.found(df.limit(0)).collect() == []


def test_a_span_takes_its_lead_character_along():
    for page in ("latin_1", "cp1252"):
        clean = "– names “Compañía Ñandú” as guarantor; the pour… ended."
        odd = clean.replace("“", "“".encode().decode(page, "replace")).replace("…", "…".encode().decode(page))
        garbled, text, _, whole = M.restore(odd)
        assert garbled and whole and text == clean


def test_swapped_single_byte_pages():
    assert M.restore("Привет, мир".encode("cp1251").decode("cp1252"))[:2] == (True, "Привет, мир")
    assert M.restore("Caf\x82 Nuevo")[:2] == (True, "Café Nuevo")
    assert M.restore("a \x93quoted\x94 word \x96 here")[:2] == (True, "a “quoted” word – here")
    for clean in ("aperçú", "São Telmário e as ações", "żółć", "Íñigo", "ÄÖÜ", "coöperate naïve"):
        assert M.restore(clean)[:2] == (False, clean)


@pytest.mark.parametrize("times", [5, 7])
def test_any_number_of_layers(times):
    text = bad = "café – “ñandú”"
    for _ in range(times):
        bad = garble(bad, "cp1252")
    assert M.restore(bad)[1] == text
