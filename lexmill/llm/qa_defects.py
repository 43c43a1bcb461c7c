"""Problem 2: broken question/answer pairs.

Every pair gets at most one defect, in this order: empty, refusal,
copied_question, wrong_language, truncated.

* empty: nothing but blanks, marks or a placeholder.
* refusal: a small grammar of first-person declining, outside quotations.
* copied_question: greedy string tiling of the question over the answer leaves
  nothing but lead-ins.
* wrong_language: script checks, then function words, outside quotations.
* truncated: a pushdown parser over fences, brackets, quotations, lists and
  markup finds open structures or a sentence without its end.

Defined results: a null question is no defect by itself (its language is
unknown, nothing can be copied from it); null or blank answers are ``empty``.
Texts are read whole; redelivered rows count once.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# -- empty ---------------------------------------------------------------

#: Words that stand for a missing answer.
PLACEHOLDERS = {
    "n/a", "na", "null", "none given", "nil", "nan", "undefined", "tbd", "todo", "tba", "no answer", "no response", "not answered", "unanswered",
    "answer", "response", "answer text", "placeholder", "insert answer here", "missing", "empty", "blank", "sin respuesta", "respuesta", "not available", "unknown value",
}
_MARKS = re.compile(r"[\W_]+", re.UNICODE)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    core = _MARKS.sub(" ", text).strip().lower()
    return not core or core in PLACEHOLDERS or core.replace(" ", "/") in PLACEHOLDERS


# -- quotations ----------------------------------------------------------

_QUOTE = re.compile(r'["“”«»„]|\n[^\S\n]*\n')
_QUOTE_ENDS = {'"': '"', "“": "”", "«": "»", "„": "“”"}


def unquoted(text: str) -> str:
    """The text without its quotations, of any length: marks open and close on a
    stack, and a blank line ends what was never closed."""
    if not any(q in text for q in _QUOTE_ENDS):
        return text
    out, stack, at, begun = [], [], 0, 0
    for m in _QUOTE.finditer(text):
        t, i = m.group(), m.start()
        if len(t) > 1:
            stack.clear()
        elif any(t in _QUOTE_ENDS[x] for x in stack):
            while t not in _QUOTE_ENDS[stack.pop()]:
                pass
            if not stack:
                out += [text[at:begun], " "]
                at = m.end()
        elif t in _QUOTE_ENDS and not (t == '"' and text[i - 1 : i].isdigit()):  # inches
            if not stack:
                begun = i
            stack.append(t)
    return "".join([*out, text[at:]]) if out else text


# -- refusal -------------------------------------------------------------

_NEG = r"(?:can(?:no|')t|cannot|can not|could(?: not|n't)|won't|will not|would not|wouldn't|am not|'m not|do not|don't|must not|may not|shall not|am unable|'m unable|have no)"
_ACT = r"(?:help|assist|answer|respond|reply|comment|provide|process|offer|give|discuss|evaluate|assess|comply|fulfil\w*|speculate|share|disclose|do that|do this|be able|able|allowed|permitted|authori[sz]ed|the ability|ability|view|opinion|access|engage|review|generate|continue|support)"
_REFUSAL = re.compile(
    "|".join(
        [
            rf"\b(?:I|we)\s?(?:'m|’m|am|are)?\s*{_NEG}\b[^.!?]{{0,40}}\b{_ACT}",
            rf"\b(?:I|we)(?:'d| would|’d) (?:rather|prefer) not\b",
            rf"\b(?:I|we)(?:'m| am|’m| are)? (?:must|have to|need to|will|shall|am going to)?\s*(?:respectfully )?(?:decline|refuse|refrain|abstain)\b",
            rf"\bI(?:'m|’m| am) (?:sorry|afraid|unable|not able|not allowed|not permitted|not authori[sz]ed)\b",
            r"\bas an? (?:ai|language model|assistant|automated|large language)\b",
            r"\b(?:inappropriate|improper|not appropriate|not possible|impossible) for (?:me|us)\b",
            r"\b(?:beyond|outside|not within) (?:what|the (?:topics|subjects|scope|limits|bounds))[^.!?]{0,30}\b(?:I|my|we)\b",
            r"\b(?:conflicts? with|against|violates?|contrary to) (?:my|our) [\w ]{0,30}(?:guidelines|polic\w+|rules|instructions)",
            r"\bcontent (?:restrictions?|polic\w+|filters?|guidelines)\b",
            r"\bnot something (?:I|we) (?:can|may|could|am able)\b",
            r"\bno (?:reply|answer|response) can be (?:generated|given|provided)\b",
            r"\b(?:no (?:puedo|podemos|podré|podría|me es posible|me está permitido|estoy autorizad[oa]|debo|tengo permitido)|prefiero no|debo (?:declinar|rechazar|abstenerme)|lamento no poder|fuera de los temas que puedo|fuera de mi alcance|como (?:asistente|modelo de lenguaje))\b",
            r"\b(?:ich kann (?:leider )?(?:nicht|keine)|es ist mir nicht (?:möglich|erlaubt)|je ne (?:peux|suis) pas|je ne suis pas (?:autorisée?|en mesure)|il m'est impossible)\b",
        ]
    ),
    re.IGNORECASE,
)


def is_refusal(text: str) -> bool:
    if "’" in text:
        text = text.replace("’", "'")
    return bool(_REFUSAL.search(unquoted(text)))


# -- copied question -----------------------------------------------------

_WORD = re.compile(r"\w+", re.UNICODE)
#: What may stand around a copied question.
LEAD_INS = {
    "question", "answer", "q", "a", "you", "asked", "the", "was", "is", "your", "asks", "prompt", "instruction", "re", "regarding", "as", "follows", "query",
    "pregunta", "respuesta", "usted", "preguntó", "la", "es", "p", "r",
}
MIN_TILE = 2


def tiles(question: list[str], answer: list[str], least: int = MIN_TILE) -> list[bool]:
    """Greedy string tiling: which answer words the longest common word runs of
    the question cover.  Both sides are marked; each word of the question can be used
    as often as the question fits into the answer, so that one repeated any number of
    times is covered.  All tiles of one length are laid in one pass."""
    covered = [False] * len(answer)
    left = [-(-len(answer) // max(1, len(question)))] * len(question)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(question):
        at.setdefault(w, []).append(i)

    def longest(j: int) -> tuple[int, int]:
        best, where = 0, -1
        for i in at.get(answer[j], ()):
            k = 0
            while i + k < len(question) and j + k < len(answer) and left[i + k] and not covered[j + k] and question[i + k] == answer[j + k]:
                k += 1
            if k > best:
                best, where = k, i
        return best, where

    while True:
        top = max((longest(j)[0] for j in range(len(answer)) if not covered[j]), default=0)
        if top < least:
            return covered
        for j in range(len(answer)):
            k, i = longest(j) if not covered[j] else (0, -1)
            if k == top:
                covered[j : j + k] = [True] * k
                for x in range(i, i + k):
                    left[x] -= 1


def is_copied(question: str | None, answer: str) -> bool:
    """Nothing is said beyond the question: its words and lead-ins are all there is,
    and its runs cover most of the question or more."""
    q = [w.lower() for w in _WORD.findall(question or "")]
    a = [w.lower() for w in _WORD.findall(answer)]
    have = set(q)
    if not q or not all(w in have or w in LEAD_INS for w in a) or sum(w in have for w in a) < 0.7 * len(a) - 3:
        return False
    return sum(tiles(q, a, min(MIN_TILE, len(q)))) >= max(2, 0.6 * len(q))


# -- language ------------------------------------------------------------

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in that was for is on with by as which from not at it an were be are this or had has but who whether before after because under what did does when where how no yes their been".split(),
    "es": "el la los las de que en y del se por con una un para no al su fue según lo como qué cuál ha han porque sobre esta este sin entre cuando dónde quién resuma describa sus o".split(),
    "de": "der die das und ist von den mit des dem zu nicht ein eine auf für im wurde war nach bei aus als auch sich laut über hat wird oder dass zum zur einer keine keinen kein weil wurden worden ab obwohl zwischen diese dieser kam wies gegen durch".split(),
    "fr": "le la les de des et est en du un une que dans pour qui par sur pas au aux ce il elle été avec selon ne se a ou son sa ses cette aucun aucune leur cause sans avait étaient lequel parce mais car".split(),
    "pt": "o a os as de que e do da em um uma para com não no na por foi dos das ao se mais como mas segundo pelo pela são".split(),
    "it": "il lo la gli le di che e del della in un una per non con è da dei delle nel sono stato alla al si secondo".split(),
}
_SCORES: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _SCORES.setdefault(_w, {})[_lang] = 1.0
for _s in _SCORES.values():
    for _lang in _s:
        _s[_lang] = 1.0 / len(_s)
_LETTER_SIGNS = {"es": re.compile(r"[ñ¿¡]|ción\b"), "de": re.compile(r"[ß]|ung\b|[äöü]"), "fr": re.compile(r"[èêçœù]|\b[ldnqs]['’][a-zéè]"), "pt": re.compile(r"[ãõ]|ção\b")}
_SCRIPTS = {
    "cyrillic": re.compile("[Ѐ-ӿ]"), "greek": re.compile("[Ͱ-Ͽ]"), "arabic": re.compile("[؀-ۿ]"), "hebrew": re.compile("[֐-׿]"),
    "han": re.compile("[一-鿿]"), "kana": re.compile("[぀-ヿ]"), "hangul": re.compile("[가-힯]"), "devanagari": re.compile("[ऀ-ॿ]"), "latin": re.compile("[A-Za-zÀ-ɏ]"),
}
_PROPER = re.compile(r"\b[A-ZÀ-Þ][\w'’-]*(?:\s+[A-ZÀ-Þ][\w'’-]*)+")


def language(text: str, least: float = 2.0) -> str | None:
    """A language code or script name, None where the text is too short to tell."""
    if not text.isascii():
        n = {s: len(p.findall(text)) for s, p in _SCRIPTS.items()}
        top = max(n, key=n.get)
        if top != "latin" and n[top] >= 4 and n[top] > n["latin"]:
            return top
    score: Counter = Counter()
    words = [w.lower() for w in _WORD.findall(_PROPER.sub(" ", text))]
    for w in words:
        for lang, v in _SCORES.get(w, {}).items():
            score[lang] += v
    if not text.isascii():
        low = text.lower()
        for lang, p in _LETTER_SIGNS.items():
            score[lang] += 0.5 * min(len(p.findall(low)), 4)
    if not score:
        return None
    (lang, v), *rest = score.most_common(2)
    if v < least or v < 0.08 * len(words) or rest and rest[0][1] > 0.8 * v:
        return None
    return lang


def is_other_language(question: str | None, answer: str) -> bool:
    asked = language(question or "", 1.0)
    if not asked:
        return False
    said = language(unquoted(answer), 2.5)
    return said is not None and said != asked


# -- truncation ----------------------------------------------------------

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“”"}
_CLOSE = {")", "]", "}", "”", "»"}
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*?)?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_TOKEN = re.compile(r"```|~~~|\*\*|`|[()\[\]{}“”«»„\"]|<|\n")
#: Words that can't end a sentence, and ends that need no full stop.
DANGLING = set(
    "the a an of to in on at by for from with and or nor but that which who whom whose because before after under into than as if when while where whether between against upon about is are was were be been has have had do does did will would shall should may might must can could not no their its his her our your this these those such each every any some very more "
    "el la los las un una de del al y o u e que en por para con sin sobre según entre hasta desde como porque cuando donde cual su sus se es fue ha han lo le aunque ni".split()
)
COMPLETE_ENDS = {"infra", "supra", "passim", "ibid", "etc", "seq", "al", "sealed", "omitted", "interest", "costs", "fees"}
_ABBREVIATION_END = re.compile(r"(?:\b(?:v|vs|No|Nos|Kv|Rep|Dr|Mr|Mrs|Ms|St|Ave|Art|Arts|Ex|Fig|Sec|pp|p|cf|Inc|núm)|\b[A-Z])\.$")
_ORG_END = re.compile(r"\b(?:Inc|Corp|Co|Ltd|L\.L\.C|LLC|P\.C|Jr|Sr|al|M\.D|R\.N|D\.O|Ph\.D|U\.S|etc|seq|a\.m|p\.m)\.$")
_SENTENCE_END = re.compile(r"[.!?](?:[\"”»'’)\]]+)?(?=\s|$)")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)]|[a-z][.)])(?:\s+(.*))?$")


def open_structures(text: str) -> list[str]:
    """What a pushdown parser has on its stack at the end of the text."""
    stack: list[str] = []
    i, n = 0, len(text)
    for m in _TOKEN.finditer(text):
        t, at = m.group(), m.start()
        if at < i:
            continue
        top = stack[-1] if stack else ""
        if top in ("```", "~~~"):
            if t == top:
                stack.pop()
            continue
        if t in ("```", "~~~"):
            stack.append(t)
        elif t == "`":
            if top == "`":
                stack.pop()
            else:
                stack.append(t)
        elif top == "`":
            continue
        elif t == "**":
            if "**" in stack:
                while stack.pop() != "**":
                    pass
            elif at + 2 < n and not text[at + 2].isspace():
                stack.append(t)
        elif t == '"':
            before = text[at - 1] if at else " "
            if before.isdigit() and '"' not in stack:
                continue  # inches
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(t)
        elif t == "<":
            tag = _TAG.match(text, at)
            if tag:
                i = tag.end()
                name = tag.group(2).lower()
                if tag.group(3) or name in _VOID:
                    continue
                if tag.group(1):
                    if "<" + name in stack:
                        while stack.pop() != "<" + name:
                            pass
                elif f"</{name}" in text[i:].lower():
                    stack.append("<" + name)
                elif name in ("p", "li", "ul", "ol", "div", "b", "i", "em", "strong", "table", "tr", "td", "code", "pre", "span", "a", "blockquote"):
                    stack.append("<" + name)
            elif re.match(r"</?[A-Za-z][\w-]*[^<>]*$", text[at:]):
                stack.append("<")
        elif t in _OPEN and not (t == "“" and top == "„"):
            stack.append(t)
        elif t in _CLOSE or t == "“":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in _OPEN and t in _OPEN[stack[k]]:
                    del stack[k:]
                    break
        elif t == "\n" and top == '"' and text[at : at + 2] == "\n\n":
            stack.pop()
    return stack


def is_truncated(text: str) -> bool:
    t = text.rstrip(" \t\r\n\xa0​")
    if not t or t.rstrip(".").isalpha() and len(t) <= 12:
        return False  # one word: "No", "None."
    if t.endswith("…") or t.endswith("...") and len(t) > 3:
        return True
    if open_structures(t):
        return True
    if t[-1] in ",;:-–—/&+(" or t.endswith(("\\", "=")):
        return True
    last_line = t.rsplit("\n", 1)[-1]
    item = _LIST_ITEM.match(last_line)
    if item and not (item.group(1) or "").strip():
        return True  # a list mark without its item
    if _ORG_END.search(t):
        return False
    if t[-1] in ".!?" or t[-1] in "\"”»'’)]}`*>" and len(t) > 1:
        return bool(_ABBREVIATION_END.search(t))
    # no final mark: the stretch since the last sentence end
    end = 0
    for m in _SENTENCE_END.finditer(t):
        if m.end() < len(t) and not _ABBREVIATION_END.search(t, 0, m.start() + 1) and not _ORG_END.search(t, max(0, m.start() - 8), m.start() + 1):
            end = m.end()
    tail = t[end:].strip()
    words = tail.split()
    last = words[-1].strip("\"'”’").lower() if words else ""
    if last in COMPLETE_ENDS:
        return False
    if last in DANGLING:
        return True
    if item or "\n" in tail and all(_LIST_ITEM.match(x) for x in tail.split("\n")):
        tail = (item.group(1) if item else last_line).strip()
        words = tail.split()
    # names, dates, amounts and noun phrases need no full stop: nearly all words capitalised or figures
    plain = [w for w in words if w[:1].islower() and w not in ("and", "y", "plus", "of", "de", "interest", "or", "in", "total")]
    if end == 0:
        return len(plain) >= 2 and len(words) >= 5
    return len(plain) >= 1


# -- the operator --------------------------------------------------------


def defect_of(question: str | None, value: str | None, text: str | None) -> str | None:
    if is_empty(text) or is_empty(value):
        return "empty"
    same = value == text
    option = not same and " " not in value.strip()
    fields = [text] if same or option else [text, value]
    if any(is_refusal(x) for x in fields):
        return "refusal"
    if any(is_copied(question, x) for x in fields):
        return "copied_question"
    if is_other_language(question, text) or not (same or option) and is_other_language(question, value):
        return "wrong_language"
    if any(is_truncated(x) for x in fields):
        return "truncated"
    return None


def found(df: DataFrame) -> DataFrame:
    """qa_id, defect of every defective pair, once."""

    def run(rows):
        for k, q, v, t in rows:
            d = defect_of(q, v, t)
            if d:
                yield k, d

    cols = df.select(F.col("qa_id").cast("bigint"), "question_text", "answer_value", "answer_text")
    return map_rows(cols, run, "qa_id bigint, defect string").distinct()
