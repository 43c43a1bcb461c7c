"""Problem 3: personal information inside free text.

Regular expressions propose spans, checksum and shape validators confirm them,
words nearby adjust the score, and spans whose score reaches the threshold are
kept.  Where spans overlap the higher score wins, then the longer span.

``found`` gives the distinct items of each record; ``mask`` gives the text with
a typed placeholder for each item, otherwise unchanged.

Defined results: null and empty texts have no items and are returned as they
are; texts are read whole; a repeated item in one record counts once, and
redelivered rows count once.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shingle_free

THRESHOLD = 0.5
#: Characters of context looked at on either side.
WINDOW = 48


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# -- validators ----------------------------------------------------------


def luhn(digits: str) -> bool:
    """The Luhn checksum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return len(digits) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 mod-97 checksum of bank account numbers."""
    s = re.sub(r"\s", "", iban).upper()
    if not 15 <= len(s) <= 34 or not s[:2].isalpha():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def phone_shape(raw: str) -> bool:
    d = re.sub(r"\D", "", raw)
    if raw.lstrip().startswith("+"):
        return 8 <= len(d) <= 15
    if d.startswith("0"):
        return 10 <= len(d) <= 11
    if len(d) == 11:
        return d[0] == "1"
    return len(d) == 10


# -- candidate expressions ----------------------------------------------

# ``re`` skips quickly to where an expression can begin only if that is one character
# out of a set. Hence what stands before a match is looked at behind its first
# character, or ``_at`` tries an expression at the few places where it can begin.

_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+%-]*(?:@|[ \t]@[ \t]|\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+(?=[\w-]+(?:\s+dot\s+\w+)+))"
    r"[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)[A-Za-z][A-Za-z0-9-]*)+",
    re.UNICODE,
)
#: What is in all that stands between the name and the host of an address.
_EMAIL_AT = re.compile(r"[@(\[a](?:(?<=@)|(?<=[(\[])(?=\s?at\s?[\])])|(?<=\sa)(?=t\s+[\w-]+\s+dot\s))")
_NAME_CHAR, _NAME_FIRST = re.compile(r"[\w.+%-]"), re.compile(r"[A-Za-z0-9]")
_PHONE_AT = re.compile(r"[+(\d](?<![\w.$£€#/-].)(?=\d[\d .-]|[ .-][(\d])")
_PHONE = re.compile(
    r"(?<![\w.$£€#/-])(?:\+\d{1,3}[ .-]\(?\d{1,4}\)?(?:(?:[ .-]\d{3,4}){1,3}(?!\d)|(?:[ .-]\d{2}){4})|\+\d{8,14}"
    r"|(?:1[ .-])?(?:\(\d{3}\)|\d{3})[ ./-]?\d{3}[ .-]\d{4}|\(0\d{2,4}\)[ -]?\d{3,4}[ -]?\d{3,4}|1?\d{10}|0\d{3,4}[ -]\d{3}[ -]?\d{3,4}|0\d{2}[ -]\d{4}[ -]\d{4})(?![\w-]|[.,/]\d)"
)
_SSN = re.compile(r"\d(?<![\w-].)\d\d([-. ]?)\d{2}\1\d{4}(?![\w-]|[.,]\d)")
_LABELLED_ID = re.compile(
    r"\b(?:(?P<ssn>SSN|S\.S\.N\.?|[Ss]ocial\s+[Ss]ecurity(?:\s+(?:number|no\.?|#))?)"
    r"|(?P<dl>[Dd]river['’]?s?['’]?\s+[Ll]icen[sc]e(?:\s+(?:number|no\.?|#))?|DL\s*#?|[Ll]icen[sc]e\s+(?:number|no\.))"
    r"|(?P<pp>[Pp]assport(?:\s+(?:number|no\.?|#))?|[Pp]asaporte(?:\s+(?:n[úu]mero|n[úu]m\.?|n\.?º))?|DNI|NIE|[Ss]eguro\s+[Ss]ocial)"
    r"|(?P<mrn>MRN|[Mm]edical\s+[Rr]ecord(?:\s+(?:number|no\.?|#))?))"
    r"(?:\s+(?:of|is|was|reads|listed\s+as))?\s*[:#]?\s*"
    r"(?P<num>[A-Z]{0,2}-?\d[\dA-Z]*(?:[-. ]\d[\dA-Z]*)*)(?![\w])"
)
_CARD = re.compile(r"\d(?<![\w-].)[ -]?(?:\d[ -]?){11,17}\d(?![\w-])")
_IBAN = re.compile(r"[A-Z](?<!\w.)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")

_TYPES = r"(?:Street|Avenue|Road|Lane|Drive|Court|Place|Boulevard|Way|Terrace|Square|Highway|Parkway|Circle|Crescent|Alley|Row|Walk|Trail|St|Ave|Rd|Ln|Dr|Ct|Pl|Blvd|Ter|Sq|Hwy|Pkwy|Cir)"
_SUFFIX_TOWN = r"(?:Harbor|Harbour|Point|Springs|Falls|Hills|City|Beach|Park|Junction|Heights|Grove|Valley|Ridge|Mills|Bay|Island|Lake|Creek|Bridge|Landing|Haven|Cove|Village|Township|Corner|Crossing)"
_UNIT = r"(?:(?:,?\s+(?:[Aa]pt|APT|[Uu]nit|UNIT|[Ss]uite|SUITE|[Ss]te|[Rr]oom|[Rr]m|[Ff]loor|[Ff]l)\b\.?\s*#?\s?\w+(?:-\w+)?)|,?\s+#\s?\w+)"
_TOWN = rf"[A-ZÀ-Þ][A-Za-zà-þ'’-]+(?:\s+{_SUFFIX_TOWN}\b)?"
_STATE_ZIP = r"[A-Z]{2},?\s+\d{5}(?:-\d{4})?(?!\d)"
_ADDRESS = re.compile(
    rf"\d(?<![\w#.,/$-].)\d{{0,5}}[A-Z]?\s+(?:(?:[NSEW]{{1,2}}\.?|North|South|East|West)\s+)?(?:(?:[A-Z][\w'’-]*|\d{{1,3}}(?:st|nd|rd|th))\s+){{1,3}}?{_TYPES}\b"
    rf"(?:\.(?=,|\s+(?:#|[Aa]pt|[Uu]nit|[Ss]uite|[Ss]te)))?(?:{_UNIT})?(?:,\s+{_TOWN}(?:,?\s+{_STATE_ZIP})?)?"
)
_ADDRESS_UPPER = re.compile(
    rf"\d(?<![\w#.,/$-].)\d{{0,5}}\s+(?:[A-Z0-9][A-Z0-9'’.]*\s+){{1,4}}?(?:STREET|AVENUE|ROAD|LANE|DRIVE|COURT|PLACE|BOULEVARD|WAY|TERRACE|BLVD|AVE|RD)\b\.?(?:{_UNIT})?(?:,\s+[A-Z][A-Z'’-]+(?:\s+[A-Z]+)?(?:,?\s+{_STATE_ZIP})?)?"
)
_FOREIGN_TOWN = r"[A-ZÀ-Þ][\wà-þ'’-]+(?:(?:\s+(?:de|del|la|los|las|do|da|sur|le|am|an|der))*\s+[A-ZÀ-Þ][\wà-þ'’-]+)*"
_ADDRESS_ABROAD = re.compile(
    rf"\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Rua|Via|Corso)\s+(?:(?:de|del|la|los|las|da|do|dos|das|di)\s+)*{_FOREIGN_TOWN},?\s+\d{{1,4}}(?:,\s+\d{{1,2}}[ºª°.]?\s?[A-Z]?\b)?(?:,\s+(?:\d{{4,5}}\s+)?{_FOREIGN_TOWN})?"
    rf"|\b\d{{1,4}}(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|place|allée|chemin|quai|impasse)\s+(?:(?:des|de|du|la|le|les)\s+|d['’]|de\s+l['’])*{_FOREIGN_TOWN}(?:,\s+(?:\d{{4,5}}\s+)?{_FOREIGN_TOWN})?"
    rf"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer)\s+\d{{1,4}}[a-z]?\b(?:,\s+\d{{4,5}}\s+{_FOREIGN_TOWN})?"
)

#: Given names in common use.
GIVEN_NAMES = (
    "Abigail Adam Ahmed Alan Alexander Alice Amanda Amara Amy Ana Andrea Andrew André Angela Anna Anthony Antonio Arthur Barbara Benjamin Beth Björn Brian Carl Carlos Carmen Carol Catherine Charles Chloe Chloé Chris Christine "
    "Christopher Cynthia Daniel David Deborah Denise Diana Diane Dmitri Donald Donna Dorothy Edward Elena Elias Elizabeth Emily Emma Eric Ethan Eva Fatima Frances Francis Frank Frederick Gary George Gloria Grace Gregory Greta "
    "Hannah Harold Harry Heather Helen Henry Hugo Ines Inès Irene Isabel Ivan Jack Jacob Jacqueline James Jane Janet Jason Jean Jeffrey Jennifer Jessica Joan Joel John Jonathan Jorge Jose José Joseph Joshua Joyce Juan Judith Julia Julie Jürgen "
    "Karen Katherine Kathleen Keiko Kelly Kenneth Kevin Kim Larry Laura Lawrence Lena Leonard Linda Lisa Louis Lucia Luis Luke Łucja Marcus Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Mónica Monica Nadia Nancy Nathan "
    "Nicholas Nicole Noah Noor Olivia Omar Oscar Pamela Patricia Patrick Paul Paula Peter Philip Priya Rachel Ralph Raymond Rebecca Renée Renee Richard Robert Roger Ronald Rosa Roy Ruth Ryan Samuel Sandra Sara Sarah Scott Sharon Simon Søren "
    "Sophia Stephen Steven Susan Teresa Theresa Thomas Timothy Tyler Vera Victor Victoria Virginia Walter Wayne William Yusuf Yvonne Zoe Zoë Íñigo"
).split()
_GIVEN = frozenset(GIVEN_NAMES)
_GIVEN_UPPER = frozenset(x.upper() for x in GIVEN_NAMES)
#: Words of organisations and places that end a run of capitals.
_NOT_SURNAME = frozenset(
    "LLC LLP Inc Corp Ltd Company Co Group Hospital Associates Partners Services Stores Center Centre Clinic Bank Insurance Assurance Manufacturing Pharmaceuticals International Logistics Consultants Management Construction Department Home Nursing Medical Regional Surgical Imaging Freight Property Engineering Orthopedic Mutual Harbor Point Springs Falls Street Avenue Road Lane Drive Court Place Boulevard Way Terrace County Township University College School Church Park Lake River Island Airport Index Exhibit Paragraph Claim Docket Rule Section Article Bates Reporting Service Act Code Law Hall House Hotel Société Compañía Clínica GmbH Ltda".split()
)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Hon|Rev|Sr|Sra|Srta|Herr|Frau|Mme|M|Nurse|Justice|Judge|Attorney|Officer|Detective|Sergeant|Captain|Magistrate|Professor|Doctor|Counselor|Don|Doña|Señor|Señora)"
_SUR = r"(?:(?:[Dd]e\s+la|[Dd]e\s+las|[Dd]e\s+los|[Dd]el|[Dd]e|[Dd]i|[Dd]a|[Vv]an\s+der|[Vv]an|[Vv]on|[Ll]a|[Ll]e)\s+)?(?:(?:Mc|Mac|O['’]|D['’]|St\.\s)?[A-ZÀ-ÞŁŻ][a-zà-þłżA-Z]*[a-zà-þłż](?:['’][a-zà-þ]{3,})?)(?:-(?:\n)?(?:Mc|O['’]|D['’])?[A-ZÀ-ÞŁŻ][a-zà-þłż]+)*"
_SUR_UPPER = r"(?:(?:DE\s+LA|DE|VAN|VON)\s+)?(?:MC|O['’]|D['’])?[A-ZÀ-ÞŁŻ]{2,}(?:-[A-ZÀ-ÞŁŻ]{2,})*"
_FULL = re.compile(rf"(?<![\w@.])(?P<given>[A-ZÀ-ÞŁ][a-zà-þøłżŁ]+(?:-[A-Z][a-zà-þ]+)?)(?P<mid>(?:\s+[A-ZÀ-Þ]\.)*)\s+(?P<sur>{_SUR})(?![\w@])")
_FULL_UPPER = re.compile(rf"(?<![\w@.])(?P<given>[A-ZÀ-ÞŁ]{{3,}})(?P<mid>(?:\s+[A-ZÀ-Þ]\.)*)\s+(?P<sur>{_SUR_UPPER})(?![\w@])")
_INITIALS = re.compile(rf"(?<![\w@.&])(?P<ini>[A-ZÀ-Þ]\.(?:\s?[A-ZÀ-Þ]\.){{0,2}})\s+(?P<sur>{_SUR})(?![\w@])")
_TITLED = re.compile(rf"(?<![\w.]){_TITLE}\.?\s+(?P<name>(?:[A-ZÀ-Þ]\.\s?){{0,2}}{_SUR})(?![\w@])")
_SURNAME_END = re.compile(rf"(?<![\w@.’'-])(?:{_SUR}|{_SUR_UPPER})$")
_INVERTED = re.compile(rf"(?<![\w@.])(?P<name>(?P<sur>{_SUR}|{_SUR_UPPER}),\s+(?P<given>[A-ZÀ-ÞŁ][a-zà-þøłż]+)(?:\s+[A-ZÀ-Þ]\.)*)(?![\w@])")
_PLACE_NEXT = re.compile(r"\s+(?:LLC|LLP|L\.L\.C|Inc|Corp|Ltd|P\.C|Company|Group|Hospital|Associates|Partners|Services|Stores|Center|Clinic|Bank|Insurance|Assurance|Manufacturing|Pharmaceuticals|International|Logistics|Consultants|Management|Construction|Department|Nursing|Medical|Regional|Surgical|Imaging|Freight|Property|Engineering|Orthopedic|Mutual|Street|Avenue|Road|Lane|Drive|Court|Place|Boulevard|Way|Terrace|St\.|Ave|Rd|Blvd|&)\b")
_CITED_NEXT = re.compile(r"\s+v(?:s)?\.\s")
_CITED_BEFORE = re.compile(r"\bv(?:s)?\.\s+$")
_WS = re.compile(r"\s")
_BREAK = re.compile(r"\n[^\S\n]*\n")
_SAID = re.compile(r"\s+(?:testified|stated|told|objected|inspected|charted|wrote|signed|said|declared)\b|['’]s\s")
_BY = re.compile(r"(?:\b(?:by|of|told|from|and|to|Attn|To|Dr|Mr|Mrs|Ms)[.:]?\s+)$")
_MORE_NAME = re.compile(r"\s+[A-ZÀ-Þ][a-zà-þ]+\b(?!\s*[;:|])")
_LAST_WORD = re.compile(r"([^\s,;:|]+)\s+$")
#: The last word of a run of capitals before what people do and are, which tells the
#: run for a person.
_DOES = re.compile(
    r"[A-ZÀ-ÞŁŻ](?<!\S.)\S*[\wà-þ.](?=\s+(?:testified|stated|told|objected|inspected|charted|wrote|signed|said|declared|recalled|replied|explained|lives|lived|resides|resided|swore|denies|denied|admits|admitted|phoned|emailed|was\s+(?:born|deposed|sworn|hired|admitted))\b"
    r"|,\s+(?:M\.D\.|MD\b|R\.N\.|RN\b|D\.O\.|L\.P\.N\.|Ph\.D\.|Esq\b|D\.D\.S\.|P\.E\.|C\.P\.A\.))"
)
_RUN_END = re.compile(rf"[A-ZÀ-ÞŁ](?<![\w@.’'-].)(?:[a-zà-þøłżŁ]+(?:-[A-Z][a-zà-þ]+)?)(?:\s+[A-ZÀ-Þ]\.)*(?:\s+{_SUR})+$")
_ENTRY = re.compile(rf"[:;] (?P<name>(?P<sur>{_SUR}),\s+[A-ZÀ-ÞŁ][a-zà-þøłż]+(?:\s+[A-ZÀ-Þ]\.)+)(?=;|\s*$)")
#: A run behind one of these isn't the one who acts ("the manager of ... wrote").
_NO_SUBJECT = frozenset("the a an of for at in from with by to on de del".split())
#: Capitalised words that are no part of a name.
_NO_NAME = _NOT_SURNAME | frozenset(
    "The A An This That These Those In On At By For From With When While After Before Once If As But And Or Nor Neither Either Both No Not Counsel Plaintiff Plaintiffs Defendant Defendants Petitioner Respondent Claimant Witness Court Tenant Landlord Insurer Insured Guarantor Intervenor Receiver "
    "Employer Employee Appellant Appellee Patient Expert Carrier Board Council Commission Agency Bureau Office Committee Union Trust Estate Team Staff Management Unit Division Branch State City Town Village District Department January February March April May June July August September October November December "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday North South East West Northern Southern Eastern Western New Old Upper Lower First Second Third Fourth Fifth Page Volume Appendix Schedule Motion Order Complaint Answer Affidavit Deposition Transcript Report Letter Notice Contract He She They We It His Her Their Our My".split()
)


def _name_before(text: str, at: int) -> bool:
    m = _LAST_WORD.search(text[max(0, at - 20) : at])
    return bool(m) and (m.group(1) in _GIVEN or re.fullmatch(r"[A-ZÀ-Þ]\.", m.group(1)) is not None)

_CONTEXT = {
    "phone": (re.compile(r"(?:tel|phone|call(?:s|ed|er)?|fax|mobile|cell|reached|contact|number of|callback|intake form|left|llam|teléfono|móvil)\w*\b", re.I), re.compile(r"(?:tracking|part|claim|policy|invoice|docket|index|bates|serial|account|order|case|model|batch|lot|MRN|SSN|licen[sc]e|passport)\b(?:[^.\n]|\n(?!\n)){0,24}$", re.I)),
    "address": (re.compile(r"\b(?:at|of|to|lives?|resid\w+|mail\w*|address\w*|located|premises|home|domicil\w+)\b", re.I), re.compile(r"\b(?:exhibits?|pages?|sections?|rules?|docket|index|paragraphs?|chapter|bates)\s*(?:nos?\.?|numbers?)?\s*$", re.I)),
    "id": (re.compile(r"\b(?:SSN|social\s+security|W-2)\b", re.I), re.compile(r"\b(?:tracking|part|claim|policy|invoice|docket|index|bates|serial|order|case|model|batch|lot)\b(?:[^.\n]|\n(?!\n)){0,24}$", re.I)),
}


def _context(kind: str, text: str, start: int, end: int) -> float:
    good, bad = _CONTEXT[kind]
    before = text[max(0, start - WINDOW) : start]
    score = 0.3 if good.search(before) or good.search(text[end : end + WINDOW // 2]) else 0.0
    return score - (0.7 if bad.search(before) else 0.0)


_DIGITS_HINT = re.compile(r"[+\d](?:(?<=\+)\d|(?<!\+)\d\d(?:[ ./)-]{1,2}\d|\d{6}))")
_EMAIL_SIGNS = ("@", "(at)", "[at]", " dot ", "( at", "[ at", "(AT)", "[AT]")
_ID_SIGNS = ("SSN", "S.S.N", "ocial", "icense", "icence", "assport", "asaporte", "DNI", "NIE", "eguro", "MRN", "ecord n", "ecord N", "ecord #", "DL ", "DL#")
_ABROAD_SIGNS = ("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Rua ", "Via ", "Corso", "rue ", "avenue ", "boulevard ", "place ", "allée", "chemin", "quai", "impasse", "straße", "strasse", "str. ", "gasse", "weg ", "platz", "allee", "ufer")
_UPPER_ADDRESS_SIGNS = ("STREET", "AVENUE", "ROAD", "LANE", "DRIVE", "COURT", "PLACE", "BOULEVARD", " WAY", "TERRACE", "BLVD", " AVE", " RD")
_CAPITAL = re.compile(r"[A-ZÀ-ÞŁ](?<![\w@.].)[\wà-þ]*\.?")
_GIVEN_AFTER_COMMA = re.compile(r",\s+([A-ZÀ-ÞŁ][a-zà-þøłż]+)")
_TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Hon Rev Sr Sra Srta Herr Frau Mme Nurse Justice Judge Attorney Officer Detective Sergeant Captain Magistrate Professor Doctor Counselor Don Doña Señor Señora".split())


def _begins() -> dict[str, str]:
    """What a capitalised word, with or without a full stop, may begin, by the first rule that it meets."""
    sets = {"titled": _TITLES, "upper": _GIVEN_UPPER, "given": _GIVEN}
    capitals = [c for c in map(chr, range(0x250)) if _CAPITAL.fullmatch(c)]
    return {f"{c}.": "initials" for c in capitals} | {f"{w}{dot}": kind for kind, words in sets.items() for w in words for dot in ("", ".")}


_BEGINS = _begins()


def _at(places: re.Pattern, expression: re.Pattern, text: str):
    """``expression.finditer(text)``, where it can begin at ``places`` only."""
    end = 0
    for c in places.finditer(text):
        if c.start() >= end and (m := expression.match(text, c.start())):
            end = m.end()
            yield m


def _emails(text: str):
    """``_EMAIL.finditer(text)``: the name is what stands before one of ``_EMAIL_AT``, and
    wherever it begins the same host follows, so its first letter decides."""
    end = 0
    for c in _EMAIL_AT.finditer(text):
        at = c.start()
        while at > end and text[at - 1].isspace():
            at -= 1
        stop = at
        while at > end and _NAME_CHAR.match(text, at - 1):
            at -= 1
        first = _NAME_FIRST.search(text, at, stop)
        if first and (m := _EMAIL.match(text, first.start())):
            end = m.end()
            yield m


def spans(text: str) -> list[Span]:
    """The confirmed spans of a text, in order, without overlaps."""
    got: list[Span] = []
    add = got.append
    if any(x in text for x in _EMAIL_SIGNS):
        for m in _emails(text):
            add(Span(m.start(), m.end(), "email", 0.95))
    if any(x in text for x in _ID_SIGNS):
        for m in _LABELLED_ID.finditer(text):
            num = m.group("num")
            digits = sum(c.isdigit() for c in num)
            if m.group("ssn") and digits != 9 or digits < 5:
                continue
            add(Span(m.start("num"), m.end("num"), "id_number", 0.97))
    if _DIGITS_HINT.search(text):
        _numbers(text, add)
    for m in _ADDRESS.finditer(text):
        add(Span(m.start(), m.end(), "address", min(0.95, 0.75 + _context("address", text, m.start(), m.end()))))
    if any(x in text for x in _ABROAD_SIGNS):
        for m in _ADDRESS_ABROAD.finditer(text):
            add(Span(m.start(), m.end(), "address", 0.85))
    if any(x in text for x in _UPPER_ADDRESS_SIGNS):
        for m in _ADDRESS_UPPER.finditer(text):
            add(Span(m.start(), m.end(), "address", min(0.9, 0.7 + _context("address", text, m.start(), m.end()))))
    _names(text, add)
    if not got:
        return got
    # no item crosses a paragraph break
    got = [g for g in got if g.score >= THRESHOLD and not ("\n" in text[g.start : g.end] and _BREAK.search(text, g.start, g.end))]
    got.sort(key=lambda g: (-g.score, g.start - g.end, g.start))
    kept: list[Span] = []
    for g in got:
        if all(g.end <= k.start or g.start >= k.end for k in kept):
            kept.append(g)
    return sorted(kept)


def _numbers(text: str, add) -> None:
    for m in _SSN.finditer(text):
        base = 0.45 if m.group(1) else 0.2
        if (s := base + _context("id", text, m.start(), m.end())) >= THRESHOLD:
            add(Span(m.start(), m.end(), "id_number", s))
    for m in _at(_PHONE_AT, _PHONE, text):
        raw = m.group()
        if not phone_shape(raw):
            continue
        base = 0.6 if re.search(r"\D", raw.strip()) else 0.25
        if raw.startswith(("+", "(")):
            base = 0.75
        if (s := base + _context("phone", text, m.start(), m.end())) >= THRESHOLD:
            add(Span(m.start(), m.end(), "phone", s))
    for m in _CARD.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits):
            add(Span(m.start(), m.end(), "id_number", 0.6 + _context("id", text, m.start(), m.end())))
    for m in _IBAN.finditer(text):
        if mod97(m.group()):
            add(Span(m.start(), m.end(), "id_number", 0.9))


def _names(text: str, add) -> None:
    def person(start: int, end: int, sur: str, score: float) -> None:
        last = _WS.split(sur)[-1].rstrip(".")
        if last in _NOT_SURNAME or last.capitalize() in _NOT_SURNAME:
            return
        if _PLACE_NEXT.match(text, end) or _CITED_NEXT.match(text, end) or _CITED_BEFORE.search(text[max(0, start - 5) : start]):
            return
        add(Span(start, end, "name", score))

    for c in _CAPITAL.finditer(text):
        if not (begins := _BEGINS.get(c.group())):
            continue
        at = c.start()
        if begins == "given":
            if m := _FULL.match(text, at):
                person(at, m.end("sur"), m.group("sur"), 0.8)
        elif begins == "upper":
            if m := _FULL_UPPER.match(text, at):
                person(at, m.end("sur"), m.group("sur"), 0.75)
        elif begins == "titled":
            if m := _TITLED.match(text, at):
                name = m.group("name")
                if " " not in name.strip() or name.split()[0] not in _GIVEN:
                    person(m.start("name"), m.end("name"), name, 0.72)
        else:
            # one initial is an abbreviation or a transcript mark as often as a name
            m = _INITIALS.match(text, at)
            if m and (m.group("ini").count(".") > 1 or _SAID.match(text, m.end()) or _BY.search(text[max(0, at - 16) : at])):
                person(at, m.end("sur"), m.group("sur"), 0.7)
    for c in _GIVEN_AFTER_COMMA.finditer(text):
        if c.group(1) in _GIVEN and (back := _SURNAME_END.search(text, max(0, c.start() - 60), c.start())):
            m = _INVERTED.match(text, back.start())
            if m and m.start("given") == c.start(1) and m.group("sur") not in _GIVEN and not _name_before(text, m.start()) and not _MORE_NAME.match(text, m.end()):
                person(m.start("name"), m.end("name"), m.group("sur"), 0.82)
    # names without a known given name: a run of capitals is a person by what stands around it
    for c in _DOES.finditer(text):
        end = c.end()
        if run := _RUN_END.search(text, max(0, end - 90), end):
            start, words = _trimmed(text, run.start(), end)
            if len(words) > 1 and not any(w in _NO_NAME or w in _TITLES for w in words) and not any(w in _NOT_SURNAME for w in run.group().split()):
                article = _LAST_WORD.search(text[max(0, start - 8) : start])
                behind = article and article.group(1).lower() in _NO_SUBJECT and text[end] != ","
                person(start, end, words[-1], 0.26 if behind else 0.66)
    for c in _ENTRY.finditer(text):
        if not any(w in _NO_NAME for w in c.group("name").replace(",", "").split()):
            person(c.start("name"), c.end(), c.group("sur"), 0.6)


def _trimmed(text: str, start: int, end: int) -> tuple[int, list[str]]:
    """A run of capitals without the words at its beginning that are no part of a
    name: where it begins, and its words."""
    while (m := _FIRST_WORD.match(text, start, end)) and (m.group(1) in _NO_NAME or m.group(1) in _TITLES):
        start = m.end()
    return start, text[start:end].split()


_FIRST_WORD = re.compile(r"([^\s.]+)\.?\s+")


# -- operators -----------------------------------------------------------


def masked(text: str | None, found: list[Span] | None = None) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]``, ... in place of each item."""
    if not text:
        return text
    out, at = [], 0
    for s in spans(text) if found is None else found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    out.append(text[at:])
    return "".join(out)


def items(df: DataFrame, key: str, field: str) -> DataFrame:
    """record_id, field_name, pii_type, pii_value of one text column, distinct."""

    def run(rows):
        for k, t in rows:
            for kind, value in dict.fromkeys((s.kind, t[s.start : s.end]) for s in spans(t)):
                yield field, k, kind, value

    cols = df.where(shingle_free(field)).select(F.col(key).cast("bigint"), field)
    return map_rows(cols, run, "field_name string, record_id bigint, pii_type string, pii_value string").distinct()


def mask(df: DataFrame, key: str, field: str) -> DataFrame:
    """Every row's key with the masked text and the number of items."""

    def run(rows):
        for k, t in rows:
            found = spans(t) if t else []
            yield k, masked(t, found), len(found)

    return map_rows(df.select(F.col(key).cast("bigint"), field), run, f"{key} bigint, {field} string, n_items int")


def found(work: DataFrame, results: DataFrame) -> DataFrame:
    return items(work, "chunk_row_id", "chunk_text").unionByName(items(results, "result_id", "chunk_summary"))
