"""Problem 5: noise in text from scanned pages.

Four kinds: ``hyphen_break``, ``misread_chars``, ``running_header`` and
``page_number``.  The vocabulary of the corpus is cut into tries (see ``tries``); a
Levenshtein automaton with the confusions of character recognition as cheap edits is
intersected with each, which gives every vocabulary word within the budget of a
token: by confusions and strays, or by one plain edit.  Candidates are ranked by
cost, by the words beside the token, then by frequency.  Page furniture is removed
and the lines are reflowed.

A word may correct a token that is ``RATIO`` times rarer.  A plain edit, which any two
words may differ by, counts only where the token is ``EDIT_RATIO`` times rarer, the
edit is not in the ending and the word is at home between both neighbours.

1. ``observe`` reads every text once: counts of all words, page furniture, words
   divided at a line end, tokens with digits or marks inside.
2. ``corrections`` looks up all distinct tokens that could be misread.
3. ``occurrences`` reads every text again for the plain misread tokens with their
   neighbours and counts the pairs of words that rank candidates.
4. Joins on tokens decide; only ``repair`` moves texts, those with noise.

Words, candidates and decisions are tables.  What is broadcast is a list of words with
a share of ``COMMON`` of all words, hence at most ``1 / COMMON`` words: it spares
lookups of common sound words; and a table of ``MARKS`` bits, in which all candidates
that need ranking are marked: it spares pairs of most other words.  Neither changes
a result.

Defined results: null, empty and blank texts have no noise and are returned as
they are; texts are read whole; redelivered rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tries
from .common import map_rows, shingle_free

COMMON = 1e-5
#: Bits of the table of candidates, each under its CRC-32.
MARKS = 1 << 20
#: A vocabulary word must be so many times as frequent as the token it corrects.
RATIO = 25
EDIT_RATIO = 1000
#: Times that a word must stand beside each neighbour for a plain edit to count.
AT_HOME = 5
BUDGET = 1.2
CONFUSION, STRAY, EDIT = 0.35, 0.1, 1.0

# Fixed values: (seen, meant) confusions of character recognition.
CONFUSIONS = [
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("n", "ri"), ("u", "ii"), ("h", "li"),
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("$", "s"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("q", "g"), ("g", "q"), ("l", "i"), ("i", "l"), ("o", "c"), ("n", "u"), ("u", "n"), ("v", "y"), ("a", "o"), ("s", "5"),
]
#: Marks that stray into words.
STRAYS = "~^¦|`¬\xad"
#: Words of two and three letters, which are meant as they stand
#: however rare beside a word that looks like them.
SHORT_WORDS = frozenset(
    "ad ah am an as at ax be by co do ed eg eh em en et ex go ha he hi hr id ie if in is it jr la lb ln lo lt ma me mg ml mm mo mr ms my no of oh ok on or ow ox pa pi pm pp re sr st so ti to up us vs we ye "
    "ace act add ads age ago aid ail aim air ale all and ant any ape apt arc are ark arm art ash ask ate awe axe bad bag ban bar bat bay bed bee beg bet bid big bin bit bog bow box boy bud bug bun bus but buy bye "
    "cab can cap car cat cob cod cog con cop cot cow cry cub cue cup cut dad dam day den dew did die dig dim din dip doe dog don dot dry dub due dug dye ear eat ebb egg ego elf elk elm end eon era eve ewe eye "
    "fad fan far fat fax fed fee few fib fig fin fir fit fix flu fly foe fog for fox fro fry fun fur gag gap gas gel gem get gin god got gum gun gut guy gym had ham has hat hay hem hen her hew hex hey hid him hip his hit hob hoe hog hop hot how hub hue hug hum hut "
    "ice icy ill ink inn ion ire irk its ivy jab jam jar jaw jet job jog joy jug keg key kid kin kit lab lad lag lap law lax lay led lee leg let lid lie lip lit log lot low lug mad man map mat may men met mid mix mob mom mop mud mug "
    "nab nap nay net new nil nip nod nor not now nub nun nut oak oar oat odd off oft oil old one opt orb ore our out owe owl own pad pal pan par pat paw pay pea peg pen per pet pie pig pin pit ply pod pop pot pro pub pun pup put "
    "rag ram ran rap rat raw ray red ref rep rib rid rig rim rip rob rod rot row rub rue rug run rut rye sac sad sag sap sat saw say sea see set sew sex she shy sin sip sir sit six ski sky sly sob sod son sow soy spa spy sub sue sum sun "
    "tab tag tan tap tar tax tea tee ten the thy tie tin tip toe ton too top tow toy try tub tug two urn use van vat vet via vie vow wag war was wax way web wed wet who why wig win wit woe won wry yam yes yet you zip zoo "
    "act apr aug dec feb jan jul jun mar nov oct sep sept mrs esq inc llc llp ltd etc ext hon hwy ave blvd ins mri ekg icu sec cl "
    "al da das de dei del dem den der des di die do dos du el em est et eu il ja je la las le les lo los lui mas moi mon na nas nel nem ni nos ou par pas por que qui rio sa se sein ser ses si sin son su sua sur te tu um un una und une uno von vos zu zum zur".split()
)
_BY_SEEN: dict[str, list[tuple[str, str]]] = {}
for _s, _m in CONFUSIONS:
    _BY_SEEN.setdefault(_s[0], []).append((_s, _m))

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_MIXED = re.compile(r"(?<![\w$#@.+/&-])(?=[A-Za-z0-9!|~^¦$]*[a-z])[A-Za-z]*(?:[a-z~^¦|!][01345689!|~^¦$]|[01345689!|~^¦$][a-z~^¦|!])[A-Za-z0-9!|~^¦$]*(?![\w@])")
_BREAK = re.compile(r"([^\W\d_]+[^\W_]*)([-‐\xad¬])[ \t]*\n")


class Trie:
    """Words with counts, and the automaton over them."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def search(self, token: str, budget: float = BUDGET) -> dict[str, float]:
        """All words within the budget by confusions and strays, with their costs."""
        best: dict[str, float] = {}
        seen: dict[tuple[int, int], float] = {}
        stack = [(0, self.root, 0.0)]
        n = len(token)
        while stack:
            i, node, cost = stack.pop()
            state = (i, id(node))
            if seen.get(state, 9.0) <= cost:
                continue
            seen[state] = cost
            if i == n:
                w = node.get("")
                if w is not None and cost < best.get(w, 9.0):
                    best[w] = cost
                continue
            c = token[i]
            if c in node:
                stack.append((i + 1, node[c], cost))
            if c in STRAYS and cost + STRAY <= budget:
                stack.append((i + 1, node, cost + STRAY))
            if cost + CONFUSION <= budget:
                for s, m in _BY_SEEN.get(c, ()):
                    if token.startswith(s, i):
                        child = node
                        for x in m:
                            child = child.get(x)
                            if child is None:
                                break
                        if child is not None:
                            stack.append((i + len(s), child, cost + CONFUSION))
        return best

    def near(self, token: str) -> dict[str, int]:
        """All words one insertion, deletion, substitution or swap of neighbours away,
        with the last place in the token at which the edit can be."""
        found: dict[str, int] = {}
        node, n = self.root, len(token)

        def exact(i: int, node: dict | None, at: int) -> None:
            while node is not None and i < n:
                node = node.get(token[i])
                i += 1
            w = node.get("") if node is not None else None
            if w is not None and w != token:
                found[w] = max(at, found.get(w, at))

        for i in range(n + 1):
            if i < n:
                exact(i + 1, node, i)
            if i + 1 < n and (two := node.get(token[i + 1])) is not None:
                exact(i + 2, two.get(token[i]), i + 1)
            for x, child in node.items():
                if x:
                    exact(i, child, i)
                    if i < n and x != token[i]:
                        exact(i + 1, child, i)
            if i == n or (node := node.get(token[i])) is None:
                break
        return found

    def candidates(self, token: str) -> list[tuple[str, int, float, bool]]:
        """(word, count, cost, by a plain edit) of every word that the token may be a
        misreading of; plain edits for plain tokens of five letters or more, up to
        their last letter but one."""
        out = [(w, self.words[w], c, False) for w, c in self.search(token).items() if w != token]
        if len(token) > 4 and token.isalpha():
            out += [(w, self.words[w], EDIT, True) for w, at in self.near(token).items() if at < len(token) - 1]
        return out


# -- page furniture ------------------------------------------------------


_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "e": "c", "f": "t", "h": "b", "q": "g", "8": "b", "~": None, "^": None, "¦": None, "\xad": None, "¬": None})


def fold(text: str) -> str:
    """Lower case with confusable characters made equal."""
    t = text.lower().translate(_FOLD)
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ll", "u"), ("rl", "n")):
        t = t.replace(a, b)
    return t


#: Kinds of filed papers, as they stand in page headings.
PAPERS = "complaint|answer|motion|order|exhibit|transcript|correspondence|bill of particulars|medical record|affidavit|deposition|brief|memorandum|petition|reply|notice|stipulation|subpoena|judgment|report|letter|contract|invoice|discovery|interrogatories|declaration|pleading".split("|")
_PAPER = "(?:" + "|".join(re.escape(fold(p)) for p in PAPERS) + ")"
_CONT = rf"(?:\s*\(?{fold('continued')}\)?|\s*\({fold('cont')}\.?[’']?d?\)?)?"
_SEP = r"(?:\s{2,}|\s*[-–—|]+\s*|\t)"
_HEADERS = [
    re.compile(p)
    for p in (
        rf"^{fold('confidential')}\b.*$",
        rf"^{fold('privileged')} (?:and|&|-) .*$",
        rf"^{fold('index no')}[.:]? .*{_SEP}{_PAPER}{_CONT}$",
        rf"^{fold('filed')} {fold('electronically')}\b.*$",
        rf"^.{{3,}} {fold('reporting service')}s?\b.*$",
        rf"^{fold('in the matter of')} .{{3,}}$",
        rf"^\S{{1,6}}-\S{{4}}-\S{{4,9}}{_SEP}.*$",
        rf"^(?:{fold('case')}|{fold('docket')}|{fold('claim')}) {fold('no')}[.:]? .*{_SEP}.*$",
    )
]
_HEADER_UPPER = re.compile(rf"^.{{3,}}{_SEP}{_PAPER}{_CONT}$")
_NUMBER = r"(?:\d{1,4}|[ivxl]{1,7})"
_PAGE = r"(?:page|paqe|pg|p)\.?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?"
_PAGE_LINE = re.compile(rf"^(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*\d{{1,4}}\s*\)|{_PAGE}|\d{{1,3}}\s*/\s*\d{{1,3}}|{_NUMBER})$")
_PAGE_TAIL = re.compile(rf"(?:\s{{2,}}|\t|\s+\|\s+)(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|{_PAGE}|\d{{1,4}}(?:\s*/\s*\d{{1,3}})?)$")
_PAGE_HEAD = re.compile(rf"^(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|{_PAGE}|\d{{1,4}})(?:\s{{2,}}|\t|\s+\|\s+)")
_DIGIT_FOLD = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "!": "1", "|": "1", "S": "5"})
_NUMBERISH = re.compile(r"(?<![A-Za-z])[0-9OoIl!|S]*[0-9OIl!S][0-9OoIl!|S]*(?![A-Za-z])")
_STRAY = re.compile("[~^¦\xad¬]")


def digits(line: str) -> str:
    """The line with misread digits inside numbers made digits."""
    line = _STRAY.sub("", line)
    return _NUMBERISH.sub(lambda m: m.group().translate(_DIGIT_FOLD) if any(c.isdigit() for c in m.group()) or len(m.group()) > 1 and m.group().translate(_DIGIT_FOLD).isdigit() and not m.group().isupper() else m.group(), line)


def is_page_line(line: str) -> bool:
    s = " ".join(line.split())
    if len(s) > 24:
        return False  # the longest form, "page 1234 of 1234", is shorter
    s = digits(s)
    low = s.lower()
    if not _PAGE_LINE.match(low):
        return False
    if low.isdigit():
        return len(low) < 4 and not low.startswith("0")
    if re.fullmatch(r"[ivxl]+", low):
        return s.islower() and re.fullmatch(r"x{0,4}(?:ix|iv|v?i{0,3})", low) is not None
    return True


#: Four words in small letters in a row are no heading.
_PROSE = re.compile(r"(?:\b[a-z][a-z,'’-]* ){4}")


def heading(line: str) -> tuple[bool, bool]:
    """(is a running header, has a page number beside it)."""
    s = line.strip()
    if len(s) < 4 or s[-1] in ".?!;," and not s.endswith((" Inc.", " Corp.", " Co.", " Ltd.", "P.C.")) or s[:1].islower():
        return False, False
    if _PROSE.search(s):
        return False, False
    d = digits(s)
    tail = _PAGE_TAIL.search(d.lower())
    core = s[: tail.start()].rstrip() if tail and len(d) == len(s) else d[: tail.start()].rstrip() if tail else s
    head = _PAGE_HEAD.match(core.lower())
    if head and not tail:
        core, tail = core[head.end() :].strip(), head
    if len(core) < 4:
        return False, False
    f = fold(core)
    if any(p.match(f) for p in _HEADERS):
        return True, bool(tail)
    letters = [c for c in core if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > 0.85 * len(letters) and _HEADER_UPPER.match(f):
        return True, bool(tail)
    return False, False


# -- one text ------------------------------------------------------------


def furniture(lines: list[str]) -> tuple[list[bool], set[str]]:
    """Which lines are page furniture, and the kinds of noise they are."""
    drop, kinds = [False] * len(lines), set()
    if len(lines) > 1:
        for i, line in enumerate(lines):
            s = line.strip()
            if not s:
                continue
            if is_page_line(s):
                if not _in_table(lines, i):
                    drop[i] = True
                    kinds.add("page_number")
                continue
            head, paged = heading(s)
            if head:
                drop[i] = True
                kinds |= {"running_header", "page_number"} if paged else {"running_header"}
    return drop, kinds


def line_ends(lines: list[str], drop: list[bool]) -> list[tuple[int, int, str, str, str]]:
    """(line, next body line, first part, second part, second part with what is tied
    to it) of words with a hyphen at a line end; the sign leads the first part unless
    it is a plain hyphen, as another sign always divides."""
    out = []
    for i, line in enumerate(lines):
        if drop[i] or line.rstrip()[-1:] not in _HYPHENS:
            continue
        m = _END_HYPHEN.search(line)
        if not m:
            continue
        j = i + 1
        while j < len(lines) and (drop[j] or not lines[j].strip()):
            j += 1
        if j < len(lines) and (m2 := _START_WORD.match(lines[j])):
            sign = "" if m.group(2) == "-" else m.group(2)
            out.append((i, j, sign + m.group(1), m2.group(1), _START_COMPOUND.match(lines[j]).group(1)))
    return out


def _clean(part: str) -> str:
    return part.lower().translate(_NO_STRAY)


def mixed_tokens(text: str) -> list[str]:
    """Distinct tokens with digits or marks inside."""
    out = {}
    for m in _MIXED.finditer(text):
        t = m.group()
        t2 = t.strip("!|") if t.rstrip("!|").isalpha() else t
        if not (t2.isalpha() or t[0] in STRAYS or sum(c.isalpha() for c in t) < 2):
            out[t] = None
    return list(out)


def mixed_meant(t: str, known: bool, best: str | None) -> str | None:
    """The word meant by a token with digits or marks inside: the token without its
    strays if that is ``known``, the ``best`` candidate, or what the shape tells."""
    low = t.lower()
    bare = low.translate(_NO_STRAY)
    meant = bare if bare != low and known else best
    if meant is None and bare != low and bare.isalpha() and len(bare) > 3:
        meant = bare
    if meant is None and len(t) > 4 and t[0].isupper() and sum(c.isdigit() or c in "!|" for c in t) == 1:
        meant = low.translate(_NAME_DIGITS)  # a name that the corpus lacks
        if not meant.isalpha():
            return None
    if meant is None:
        return None
    return meant.upper() if t.isupper() else meant.capitalize() if t[0].isupper() else meant


def repaired(text: str, wrong: dict[str, str], divided: set[tuple[str, str]]) -> str:
    """Furniture out, divided words joined, lines reflowed, misread tokens replaced."""
    lines = text.split("\n")
    drop, _ = furniture(lines)
    for i, j, a, b, _ in line_ends(lines, drop):
        if (a, b) in divided:
            rest = _FIRST_CHUNK.match(lines[j])
            lines[i] = lines[i][: _END_HYPHEN.search(lines[i]).start(2)] + rest.group(1)
            lines[j] = lines[j][rest.end() :]
    body: list[str] = []
    gap = furnished = False
    for line, gone in zip(lines, drop):
        s = line.strip()
        if gone:
            furnished = True
            continue
        if not s:
            gap = True
            continue
        before = body[-1] if body else ""
        flows = before and before[-1] not in ".?!:" and (s[0].islower() or not gap or furnished and not _ITEM.match(s))
        if before and (flows or not gap and not _ITEM.match(s) and len(before) > 30):
            body[-1] = f"{before} {s}"
        else:
            body.append(s)
        gap = furnished = False
    out = "\n\n".join(body)
    if wrong:
        out = _CHUNK.sub(lambda m: _WHOLE.sub(lambda w: wrong.get(w.group(), w.group()), m.group()), out)
    return out


_PLAIN = re.compile(r"(?<![\w~^¦|!'’.@-])[a-z]{2,}(?![\w~^¦|!@])")
_HYPHENS = frozenset("-‐\xad¬")
_END_HYPHEN = re.compile(r"(\w[\w~^¦|!]*)([-‐\xad¬])\s*$")
_START_WORD = re.compile(r"\s*([a-zß-ÿ][\w~^¦|!]*)")
_START_COMPOUND = re.compile(r"\s*([a-zß-ÿ][\w~^¦|!]*(?:-\w+)*)")
_FIRST_CHUNK = re.compile(r"\s*(\S+)\s*")
_ITEM = re.compile(r"(?:\d{1,4}[.)]|[-*•]|[QA][.:]|\([a-z0-9]\))\s|[A-Z][A-Z ,'&-]{5,}$")
_NO_STRAY = str.maketrans("", "", STRAYS)
_NAME_DIGITS = str.maketrans({"1": "l", "!": "i", "|": "l", "0": "o", "5": "s", "8": "b", "6": "b", "9": "g"})


def _in_table(lines: list[str], i: int) -> bool:
    """Whether a bare number stands among lines of figures."""
    s = lines[i].strip()
    if not s.isdigit():
        return False

    def figures(k: int) -> bool:
        return 0 <= k < len(lines) and re.fullmatch(r"[\d.,$%\s]*\d[\d.,$%\s]*", lines[k].strip()) is not None

    return figures(i - 1) and figures(i + 1)


_CHUNK = re.compile(r"\S+")
_WHOLE = re.compile(rf"(?<![\w~^¦|])(?:{_MIXED.pattern}|[a-z]{{2,}})(?![\w~^¦|])")
_LETTERS = re.compile(r"[^\W\d_]+")

# -- operators -----------------------------------------------------------

_SEEN = "kind string, id bigint, h bigint, a string, b string, c string, n bigint"
#: Words that a task counts before it hands them on.
HELD = 500_000


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, h (a hash of the text, which tells redelivered rows from others), t."""
    return df.where(shingle_free(text)).select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))


def observe(texts: DataFrame) -> DataFrame:
    """Rows by kind: ``word`` (a; b: "1" if it is a plain token somewhere; n),
    ``noise`` (a: its kind), ``break`` (a, b, c: the parts), ``mixed`` (a)."""

    def run(rows):
        chunks: Counter = Counter()
        memo: dict[str, tuple[str, ...]] = {}

        def words():
            n: Counter = Counter()
            small: set[str] = set()
            for chunk, k in chunks.items():  # words don't cross blanks
                for w in WORD.findall(chunk):
                    n[w.lower()] += k
                small.update(_PLAIN.findall(chunk))
            chunks.clear()
            return [("word", None, None, w, "1" if w in small else "0", None, k) for w, k in n.items()]

        for k, h, t in rows:
            cut = t.split()
            chunks.update(cut)
            if len(chunks) > HELD:
                yield from words()
            lines = t.split("\n")
            if len(lines) > 1:
                drop, kinds = furniture(lines)
                for x in kinds:
                    yield "noise", k, h, x, None, None, 1
                for _, _, a, b, c in line_ends(lines, drop):
                    yield "break", k, h, a, b, c, 1
            odd: dict[str, None] = {}
            for chunk in set(cut):  # tokens don't cross blanks
                if not chunk.isalpha():
                    got = memo.get(chunk)
                    if got is None:
                        if len(memo) > HELD:
                            memo.clear()
                        got = memo[chunk] = tuple(mixed_tokens(chunk))
                    for x in got:
                        odd[x] = None
            for x in odd:
                yield "mixed", k, h, x, None, None, 1
        yield from words()

    return materialize(map_rows(texts, run, _SEEN), "observed")


def word_counts(seen: DataFrame) -> DataFrame:
    """word, n, small, of all words of all texts."""
    return materialize(seen.where("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), (F.max("b") == "1").alias("small")), "words")


def _ask(words: list[tuple[str, int]]):
    trie = Trie(dict(words))
    return lambda token, n: trie.candidates(token)


def _bucket(length):
    return F.floor(length / 4).cast("string")


_lower = lambda c: F.translate(F.lower(c), STRAYS, "")


def corrections(words: DataFrame, seen: DataFrame) -> DataFrame:
    """token, own (its count), loose (without its occurrences as a part of a word with
    a hyphen at a line end), word, n, cost, edit: all candidates of all distinct tokens
    that may be misread and of all joined parts of divided words.

    Words that are frequent enough to correct anything are cut by their length; a
    token looks among the lengths that three confusions or an edit lead to.
    """
    able = words.where(F.col("n") >= RATIO).where(F.length("word") > 1).where(~F.col("word").contains("-"))
    top = able.agg(F.max("n").alias("top"))  # one row
    plain = words.where(F.col("small") & F.col("word").rlike("^[a-z]{2,}$") & ~F.col("word").isin(*SHORT_WORDS)).join(F.broadcast(top), F.col("n") * RATIO <= F.col("top")).select(F.col("word").alias("token"), F.col("n").alias("own"))
    others = seen.where("kind = 'mixed'").select(F.lower("a").alias("token")).unionByName(seen.where("kind = 'break'").select(F.concat(_lower("a"), _lower("b")).alias("token"))).distinct()
    tokens = plain.unionByName(others.join(words.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").select("token", F.coalesce("own", F.lit(0)).alias("own"))).distinct()
    tokens = materialize(tokens, "asked")
    size = F.length(F.translate("token", STRAYS, ""))
    asked = tokens.select("token", F.col("own").alias("n"), F.explode(F.sequence(F.floor(F.greatest(size - 3, F.lit(0)) / 4), F.floor((size + 3) / 4))).alias("bucket")).withColumn("block", F.col("bucket").cast("string"))
    hits = tries.search(able.select(_bucket(F.length("word")).alias("block"), "word", "n"), asked.select("block", "token", "n"), _ask, "word string, n bigint, cost double, edit boolean")
    parts = seen.where("kind = 'break'").select(F.explode(F.array(_lower("a"), _lower("b"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("parts"))
    return materialize(hits.join(tokens, "token").join(parts, "token", "left").withColumn("loose", F.col("own") - F.coalesce("parts", F.lit(0))).drop("parts"), "candidates")


def chosen(hits: DataFrame) -> DataFrame:
    """token, edit, cands: the candidates of least cost that are frequent enough
    beside the token, confusions before plain edits, the most frequent first."""
    size = F.length("token")
    limit = F.when(F.col("edit"), EDIT).when(size < 6, CONFUSION + 2 * STRAY).when(size < 9, 2 * CONFUSION + 2 * STRAY).otherwise(BUDGET) + 1e-9
    own = F.greatest("own", F.lit(1))
    fit = hits.where(~F.col("edit") | (F.col("loose") > 0)).where((F.col("cost") <= limit) & (F.col("n") >= F.when(F.col("edit"), EDIT_RATIO).otherwise(RATIO) * own)).where(~F.col("token").isin(*SHORT_WORDS))
    cost = F.round(F.col("cost") + F.when(F.col("edit"), 10).otherwise(0), 6)
    least = fit.groupBy("token").agg(F.min(cost).alias("least"))
    ties = fit.withColumn("rank", cost).join(least, "token").where("rank = least")
    return materialize(ties.groupBy("token").agg(F.max("edit").alias("edit"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]).alias("cands")), "chosen")


def occurrences(texts: DataFrame, words: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows by kind: ``plain`` (a: a token in small letters that may be misread,
    b and c: the words beside it) and ``pair`` (a, b: neighbouring words, n), of which
    all are there that have a candidate that needs ranking."""
    total = words.agg(F.sum("n")).first()[0] or 0
    common = words.where(F.col("n") >= max(total * COMMON, 1)).select("word")  # at most 1 / COMMON words
    asking = fixes.where("edit OR size(cands) > 1").select(F.explode("cands").alias("word")).distinct()
    sound = {r.word for r in common.join(fixes.select(F.col("token").alias("word")), "word", "left_anti").collect()}
    marks = asking.withColumn("at", F.crc32("word") % MARKS).groupBy(F.expr("at div 32").alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 32 AS INT)))").alias("bits"))
    sent = texts.sparkSession.sparkContext.broadcast((sound, {r.place: r.bits for r in marks.collect()}))  # at most MARKS / 32 rows

    def run(rows):
        sound, marks = sent.value
        memo: dict[str, tuple | None] = {}  # a chunk between blanks -> its odd tokens, its words; None if there is nothing to do
        pairs: Counter = Counter()
        asked: dict[str, int] = {"": 0}

        def wanted(w: str) -> int:
            """Not 0 for every candidate, and for few other words."""
            got = asked.get(w)
            if got is None:
                if len(asked) > HELD:
                    asked.clear()
                    asked[""] = 0
                at = crc32(w.encode()) % MARKS
                got = asked[w] = marks.get(at // 32, 0) >> at % 32 & 1
            return got

        def look(chunk: str):
            odd = tuple(x for x in _PLAIN.findall(chunk) if x not in sound)
            own = _LETTERS.findall(chunk.lower())
            return (odd, own) if odd or any(map(wanted, own)) else None

        def edge(chunk: str, at: int) -> str:
            own = _LETTERS.findall(chunk.lower())
            return own[at] if own else ""

        for k, h, t in rows:
            cut = t.split()
            for i, chunk in enumerate(cut):
                if chunk in memo:
                    todo = memo[chunk]
                else:
                    if len(memo) > HELD:
                        memo.clear()
                    todo = memo[chunk] = look(chunk)
                if todo is None:
                    continue
                odd, own = todo
                before = edge(cut[i - 1], -1) if i else ""
                after = edge(cut[i + 1], 0) if i + 1 < len(cut) else ""
                run_ = [before, *own, after]
                for j, w in enumerate(own, 1):
                    if wanted(w):
                        pairs[run_[j - 1], w] += 1
                        if not wanted(run_[j + 1]):  # else counted from there
                            pairs[w, run_[j + 1]] += 1
                    if w in odd:
                        yield "plain", k, h, w, run_[j - 1], run_[j + 1], 1
            if len(pairs) > HELD:
                yield from (("pair", None, None, a, b, None, n) for (a, b), n in pairs.items())
                pairs.clear()
        yield from (("pair", None, None, a, b, None, n) for (a, b), n in pairs.items())

    return materialize(map_rows(texts, run, _SEEN), "occurrences")


def _divided(seen: DataFrame, words: DataFrame, hits: DataFrame) -> DataFrame:
    """id, h, a, b of the words that are divided at a line end: those that occur in
    one piece, whose joined form is a misreading of a word, or whose parts are no two
    common words; not those that occur as compounds."""
    b = seen.where("kind = 'break'").select("id", "h", "a", "b", "c").distinct()
    sure = b.where(F.substring("a", 1, 1).isin(*[x for x in _HYPHENS if x != "-"])).select("id", "h", "a", "b")
    open_ = b.where(~F.substring("a", 1, 1).isin(*[x for x in _HYPHENS if x != "-"])).select("a", "b", "c").distinct()
    q = open_.select("*", _lower("a").alias("first"), _lower("b").alias("second")).select("*", F.concat("first", "second").alias("joined"), F.concat_ws("-", "first", "second").alias("tied"), F.concat_ws("-", "first", F.lower("c")).alias("longer"))
    total = words.agg(F.sum("n").alias("total"))  # one row
    for col in ("joined", "tied", "longer", "first", "second"):
        q = q.join(words.select(F.col("word").alias(col), F.col("n").alias(f"n_{col}")), col, "left").withColumn(f"n_{col}", F.coalesce(f"n_{col}", F.lit(0)))
    # a joined form that occurs once is no evidence by itself
    near = hits.where(F.col("cost") <= F.when(F.col("edit"), F.when(F.length("token") >= 8, EDIT).otherwise(0)).otherwise(3 * CONFUSION) + F.lit(1e-9)).select(F.col("token").alias("joined"), F.lit(True).alias("near")).distinct()
    q = q.join(near, "joined", "left").crossJoin(F.broadcast(total))
    known = F.col("n_joined") * (F.col("n_joined") > 1).cast("int")
    tied = F.greatest("n_tied", "n_longer")
    tied = tied * (tied > 1).cast("int")
    parts = (F.length("first") > 2) & (F.length("second") > 2) & (F.least("n_first", "n_second") > F.col("total") * 5e-6)
    yes = q.where((known > tied) | ((tied == 0) & (F.coalesce("near", F.lit(False)) | ~parts))).select("a", "b", "c")
    return sure.unionByName(b.join(yes, ["a", "b", "c"]).select("id", "h", "a", "b")).distinct()


def decide(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts; noise: id, h, noise_kind; wrong: id, h, token, meant; divided: id, h, a, b)."""
    texts = _texts(df, key, text)
    seen = observe(texts)
    words = word_counts(seen)
    hits = corrections(words, seen)
    fixes = chosen(hits)
    there = occurrences(texts, words, fixes)
    divided = materialize(_divided(seen, words, hits), "divided")

    plain = there.where("kind = 'plain'").select("id", "h", F.col("a").alias("token"), F.col("b").alias("before"), F.col("c").alias("after")).join(fixes, "token").distinct()
    sure = plain.where("NOT edit AND size(cands) = 1").select("id", "h", "token", F.get("cands", F.lit(0)).alias("meant"))
    asks = plain.where("edit OR size(cands) > 1").select("id", "h", "token", "edit", "before", "after", F.posexplode("cands").alias("place", "word"))
    pairs = there.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"))
    side = lambda a, b, name: pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(name))
    met = asks.join(side("before", "word", "n1"), ["before", "word"], "left").join(side("word", "after", "n2"), ["word", "after"], "left")
    met = met.withColumns({"n1": F.coalesce("n1", F.lit(0)), "n2": F.coalesce("n2", F.lit(0))}).where(f"NOT edit OR (n1 >= {AT_HOME} AND n2 >= {AT_HOME})")
    ranked = met.groupBy("id", "h", "token").agg(F.max_by("word", F.struct((F.col("n1") + F.col("n2")).alias("n"), (-F.col("place")).alias("p"))).alias("meant"))

    best = fixes.where("NOT edit").select(F.col("token").alias("low"), F.get("cands", F.lit(0)).alias("best"))
    odd = seen.where("kind = 'mixed'").select("id", "h", F.col("a").alias("token")).distinct().withColumns({"low": F.lower("token"), "bare": _lower("token")})
    sound = words.where("n > 1").join(fixes.where("NOT edit").select(F.col("token").alias("word")), "word", "left_anti")
    odd = odd.join(best, "low", "left").join(sound.select(F.col("word").alias("bare"), F.lit(True).alias("known")), "bare", "left").select("id", "h", "token", F.coalesce("known", F.lit(False)).alias("known"), "best")

    def shaped(rows):
        for k, h, t, known, best in rows:
            if meant := mixed_meant(t, known, best):
                yield k, h, t, meant

    mixed = map_rows(odd, shaped, "id bigint, h bigint, token string, meant string")
    parts = divided.select("id", "h", F.explode(F.array(F.lower(F.regexp_replace("a", "^[‐\xad¬]", "")), F.lower("b"))).alias("low"))
    every = sure.unionByName(ranked).unionByName(mixed).withColumn("low", F.lower("token"))
    wrong = materialize(every.join(parts, ["id", "h", "low"], "left_anti").select("id", "h", "token", "meant"), "wrong")
    kind = lambda d, name: d.select("id", "h", F.lit(name).alias("noise_kind"))
    noise = seen.where("kind = 'noise'").select("id", "h", F.col("a").alias("noise_kind")).unionByName(kind(divided, "hyphen_break")).unionByName(kind(wrong, "misread_chars")).distinct()
    return texts, noise, wrong, divided


def found(df: DataFrame, key: str = "chunk_row_id", text: str = "chunk_text") -> DataFrame:
    """key and noise_kind, one row for each kind present in a text."""
    noise = decide(df, key, text)[1]
    return noise.select(F.col("id").alias(key), "noise_kind").distinct()


def repair(df: DataFrame, key: str = "chunk_row_id", text: str = "chunk_text") -> DataFrame:
    """key, noise_kinds (sorted) and text as continuous paragraphs, of every
    text with noise, redelivered rows once.

    What is to be done in a text, at most its own tokens, is joined to it."""
    texts, noise, wrong, divided = decide(df, key, text)
    at = ["id", "h"]
    todo = noise.groupBy(*at).agg(F.sort_array(F.collect_set("noise_kind")).alias("kinds"))
    todo = todo.join(wrong.groupBy(*at).agg(F.map_from_entries(F.collect_set(F.struct("token", "meant"))).alias("wrong")), at, "left")
    todo = todo.join(divided.groupBy(*at).agg(F.collect_set(F.struct("a", "b")).alias("divided")), at, "left")

    def run(rows):
        for k, t, kinds, wrong, divided in rows:
            yield k, kinds, repaired(t, dict(wrong or ()), {(x["a"], x["b"]) for x in divided or ()})

    rows = texts.join(todo, at).dropDuplicates(at).select("id", "t", "kinds", "wrong", "divided")
    return map_rows(rows, run, f"{key} bigint, noise_kinds array<string>, {text} string")
