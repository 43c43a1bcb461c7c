"""Problem 1: text decoded with the wrong character encoding.

A hidden Markov model labels the non-ASCII characters of a text.  One state is
clean text; each other state stands for one encoding pair: UTF-8 bytes that
were read as a single-byte code page, or one single-byte page read as another.
One more state holds characters that were already lost (U+FFFD).  The Viterbi path
gives the labelled spans, and every span gets the inverse transform of its state.
Text that was garbled more than once is labelled again after each repair, until
nothing changes.

ASCII is the same in all pairs, so pure ASCII texts never reach Python and
ASCII stretches inside a text only let the state decay.

Defined results: null, empty and ASCII texts are clean (no row in
``found``; ``repair`` returns them unchanged).  Texts are read whole.
Redelivered rows count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The single-byte code pages of the encoding pairs, likelier ones first.
PAIRS = ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "koi8_r", "iso8859_15")
#: Log probabilities of the model (documented parameters).
ENTER, STAY, LEAVE = math.log(5e-2), math.log(0.7), math.log(0.3)
LEAD, CONT, BROKEN = math.log(1 / 30), math.log(1 / 16), math.log(1e-7)
PAIR_PRIOR = math.log(0.8)
LOST = "�"
#: Single-byte pages that were read as another: (meant, read as).
SWAPS = (("cp1251", "cp1252"), ("cp1252", "latin_1"), ("cp850", "latin_1"))
#: How much less likely clean text makes each accented letter beside another one.
MEET = 1.5
#: A lead whose second half, a soft hyphen, was dropped by a program (í in UTF-8).
CUT = LEAD + math.log(0.05)

_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Well-formed UTF-8 of two to four bytes, as characters U+0080..U+00FF.
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")

_DROPPED = re.compile("(?<=[a-zà-ÿ\x80-\xbf])Ã(?=[a-z])")
#: Where a swapped page can show: C1 controls, or letters that hardly ever meet.
_SWAPPED = re.compile("[\x80-\x9f]|[À-ÖØ-öø-ÿ]{3}")
_SWAPPED_LETTER = re.compile("[À-ÖØ-öø-ÿ]")


@lru_cache(None)
def _swap(meant: str, read: str) -> dict[int, str]:
    """A character of the page that was read -> the one meant, where it is a letter
    or a mark; C1 controls only if the page read is Latin-1."""
    out = {}
    for b in range(0x80, 0x100):
        c, m = (bytes([b]).decode(x, "replace") for x in (read, meant))
        if c != m and c != LOST and m.isprintable() and m != LOST and (read != "latin_1" or b < 0xA0):
            out[ord(c)] = m
    return out


@lru_cache(None)
def _to_bytes(pair: str) -> dict[int, str]:
    """Translate table: a character of the code page -> its byte as U+0080..FF.
    Bytes that the code page leaves open show as C1 controls."""
    out: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(pair)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = chr(b)
    for c in range(0x80, 0x100):  # a character that the page lacks is no byte of it
        out.setdefault(c, " ")
    return out


@lru_cache(100_000)
def _kind(c: str) -> tuple[str, str]:
    """Script-like group and class of a character: upper, lower, open, close, symbol, control."""
    cat = unicodedata.category(c)
    if c in "ªº":
        return "sym", "symbol"
    if cat == "Lu" or cat == "Ll" or cat == "Lo" or cat == "Mn":
        o = ord(c)
        script = "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x300 <= o < 0x370 else "cyrillic" if 0x400 <= o < 0x530 else "greek" if 0x370 <= o < 0x400 else "other"
        return script, "upper" if cat == "Lu" else "lower"
    if cat == "Cc":
        return "", "control"
    if cat == "Pi":
        return "", "open"
    if cat in ("Pf", "Pd") or c == "…":
        return "", "close"
    return "", "symbol"


_PLAUSIBLE = {("lower", "lower"), ("upper", "upper"), ("upper", "lower"), ("open", "upper"), ("open", "lower"), ("lower", "close"), ("upper", "close"), ("close", "open"), ("close", "close"), ("symbol", "close"), ("close", "upper"), ("close", "lower")}


def _clean_cost(prev: str, c: str, nxt: str, before: str = "") -> float:
    """Log probability of ``c`` between its neighbours in clean text."""
    script, kind = _kind(c)
    p = {"lower": -3.5, "upper": -5.0, "open": -3.5, "close": -3.5, "symbol": -4.5, "control": -14.0}[kind]
    if kind == "upper" and script != "latin":
        p -= 1.0
    if 0x2500 <= ord(c) < 0x2600:
        p -= 4.0  # box drawing
    if prev and prev > "\x7f":
        if (_kind(prev)[1], kind) not in _PLAUSIBLE:
            p -= 5.0
        if kind in ("upper", "lower") and _kind(prev)[0] not in ("", script):
            p -= 5.0
        if kind == "close" and _kind(prev)[1] == "upper" and not before.isalpha():
            p -= 3.0 if nxt.isalpha() else 1.0  # a lone capital and a mark, then a word
    elif prev.isalpha():
        if kind == "upper" and prev.islower():
            p -= 3.0  # a capital inside a word
        if kind in ("upper", "lower") and script != "latin":
            p -= 5.0  # another script inside a Latin word
        if kind == "symbol":
            p -= 1.0
    if nxt and nxt < "\x80" and nxt.isalpha() and kind in ("upper", "lower") and script != "latin":
        p -= 5.0
    return p


def label(text: str) -> list[tuple[int, str]]:
    """Viterbi labels of the non-ASCII characters: (position, state), where the
    state is "" for clean, "lost", or the code page of a pair."""
    runs = [(m.start(), m.group()) for m in _NON_ASCII.finditer(text)]
    if not runs:
        return []
    formed: dict[str, dict[int, str]] = {}
    joined = {p: [r.translate(_to_bytes(p)) for _, r in runs] for p in PAIRS}
    for p in PAIRS:
        ok: dict[int, str] = {}
        for (at, _), r in zip(runs, joined[p]):
            for m in _UTF8.finditer(r):
                if any(ord(x) > 0xFF for x in m.group()):
                    continue
                for i in range(m.start(), m.end()):
                    ok[at + i] = "lead" if i == m.start() else "cont"
        if p in ("cp1252", "latin_1"):
            ok |= {m.start(): "cut" for m in _DROPPED.finditer(text) if m.start() not in ok} if ok else {}
        if ok:
            formed[p] = ok
    swaps = {f"{m}>{r}": _swap(m, r) for m, r in SWAPS} if _SWAPPED.search(text) else {}
    if not formed and not swaps and LOST not in text:
        return []
    states = ["", "lost", *formed, *swaps]
    score = {s: (0.0 if s == "" else ENTER) for s in states}
    back: list[dict[str, str]] = []
    places: list[int] = []
    n = len(text)
    for at, run in runs:
        for i, c in enumerate(run):
            pos = at + i
            prev = text[pos - 1] if pos else ""
            nxt = text[pos + 1] if pos + 1 < n else ""
            # across an ASCII stretch a state may end and another begin at no more cost than inside a run
            best_state = max(score, key=score.get)
            new, came = {}, {}
            for s in states:
                inside = False  # a span can't begin inside a byte sequence
                if s == "":
                    emit = _clean_cost(prev, c, nxt, text[pos - 2] if pos > 1 else "") if c != LOST else -16.0
                elif s == "lost":
                    emit = -0.7 if c == LOST else -30.0
                elif s in swaps:
                    page = swaps[s]
                    meant = page.get(ord(c))
                    near = [page.get(ord(x), x) if x else "" for x in (prev, nxt, text[pos - 2] if pos > 1 else "")]
                    emit = _clean_cost(near[0], meant, near[1], near[2]) + MEET * sum(bool(_SWAPPED_LETTER.match(x)) for x in (prev, nxt)) if meant else BROKEN * 1.5
                else:
                    role = formed[s].get(pos)
                    inside = role == "cont"
                    emit = {"lead": LEAD, "cont": CONT, "cut": CUT}[role] if role else BROKEN * 1.5
                stay = score[s] + (STAY if s else -0.02)
                move = score[best_state] + (LEAVE if s == "" else ENTER + PAIR_PRIOR * (PAIRS.index(s) if s in PAIRS else 0) * 0.1)
                if s == best_state or stay >= move or inside:
                    new[s], came[s] = stay + emit, s
                else:
                    new[s], came[s] = move + emit, best_state
            score = new
            back.append(came)
            places.append(pos)
    s = max(score, key=score.get)
    labels = []
    for k in range(len(back) - 1, -1, -1):
        labels.append((places[k], s))
        s = back[k][s]
    return labels[::-1]


def _invert(text: str, labels: list[tuple[int, str]]) -> str:
    """Each labelled span through the inverse transform of its state."""
    out, done, i = [], 0, 0
    while i < len(labels):
        pos, s = labels[i]
        j = i
        while j + 1 < len(labels) and labels[j + 1] == (labels[j][0] + 1, s):
            j += 1
        if ">" in s:
            out += [text[done:pos], text[pos : labels[j][0] + 1].translate(_swap(*s.split(">")))]
            done = labels[j][0] + 1
        elif s and s != "lost":
            span = text[pos : labels[j][0] + 1]
            raw = span.translate(_to_bytes(s))
            fixed, at = [], 0
            for m in _UTF8.finditer(raw):
                fixed.append(span[at : m.start()])
                fixed.append(m.group().encode("latin_1").decode("utf-8", "replace"))
                at = m.end()
            fixed.append(span[at:] if span[at:] != "Ã" else "í")  # a lead that lost its soft hyphen
            out.append(text[done:pos])
            out.append("".join(fixed))
            done = labels[j][0] + 1
        i = j + 1
    out.append(text[done:])
    return "".join(out)


def restore(text: str | None) -> tuple[bool, str | None, str | None, bool]:
    """(is garbled, restored text, code pages of the first layer, fully restored)."""
    if not text or text.isascii():
        return False, text, None, True
    garbled, pages, now = False, set(), text
    while True:  # an inverse transform shortens the text or turns letters into clean ones
        labels = label(now)
        hit = {s for _, s in labels if s}
        if not hit:
            break
        pages = pages if garbled else hit
        garbled = True
        after = _invert(now, labels)
        if after == now:
            break
        now = after
    return garbled, now, ",".join(sorted(pages)) or None, LOST not in now


_SCHEMA = "{key} bigint, garbled boolean, restored_text string, encodings string, complete boolean"


def repair(df: DataFrame, key: str = "chunk_row_id", text: str = "chunk_text") -> DataFrame:
    """One row for each text with something garbled: key, restored_text,
    encodings (the pairs of the outer layer, "lost" for lost characters) and
    complete (nothing was lost).  Only texts with non-ASCII characters reach
    Python."""

    def run(rows):
        for k, t in rows:
            g, fixed, pages, whole = restore(t)
            if g:
                yield k, g, fixed, pages, whole

    odd = df.select(F.col(key).cast("bigint").alias(key), text).where(F.col(text).rlike(r"[^\x00-\x7F]"))
    return map_rows(odd, run, _SCHEMA.format(key=key)).drop("garbled")


def found(df: DataFrame, key: str = "chunk_row_id", text: str = "chunk_text") -> DataFrame:
    return repair(df, key, text).select(key).distinct()
