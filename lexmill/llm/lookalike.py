"""Problem 8: visually identical text stored with different characters.

The words of the corpus in plain spelling (one script, composed, nothing invisible,
no other width) form a vocabulary with their counts.  It is cut into tries of plain
spellings (see ``tries``), and a weighted edit automaton walks a trie along each raw
token: an ignorable character is passed at no cost, a look-alike, a composed, wide or
styled form takes the edge that looks like it at no cost, any other edit costs one.
Of the words reached within the budget of zero the canonical spelling is one in ASCII
if there is one, else the most frequent, then the smallest.  Tokens that no word looks
like are normalized by table.  Both depend on what the token looks like alone, so
texts that look the same get one form.

Nothing is collected or broadcast: vocabulary, tokens and spellings are tables.  ASCII
text is its own canonical form.

Defined results: null stays null, empty stays empty; neither makes pairs.
Identical strings are no pair; repeated rows with one id count once.  Case,
digits, accents, words, tabs, line ends and the number of spaces are visible, and so is
a line under a letter; the kind or width of a space, the width and style of letters,
ignorable characters, composition and look-alike letters of other scripts are not.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tries
from .common import map_rows

#: Ways into which the members of a class are spread when pairs are written.
SALTS = 16

# Letters of other scripts and the Latin letters they look like.
_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "ɡ": "g", "ɑ": "a",
    "Ս": "U", "Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Cyrillic letters and the Greek ones that look like them.
_GREEK = {"Г": "Γ", "П": "Π", "Ф": "Φ"}
# Marks that look like others.
_MARK = {"ʼ": "’"}
_ALIKE = _LATIN | _GREEK | _MARK
#: Zero-width and format characters; joiners count only where they join nothing.
_IGNORABLE = re.compile("[\xad\u034f\u061c\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
_JOINERS = "\u200c\u200d"
#: What stands between tokens: other spaces, wide marks and hyphens, and the ASCII
#: character that each looks like.
_WIDE = [chr(o) for o in range(0xFF01, 0xFF5F) if not chr(o - 0xFEE0).isalnum()]
_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_BETWEEN = _SPACES + "".join(_WIDE) + "‐‑\u037e"
_SHOWN = " " * len(_SPACES) + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "--;"
#: Tokens are cut at ASCII white space and marks.
_CUT = r"[ \t\n\x0B\f\r!-/:-@\[-`{-~]+"
_TOKEN = re.compile(r"[^ \t\n\x0b\f\r!-/:-@\[-`{-~]+")
_ODD = r"[^\x00-\x7F]"


def _joins(before: str, after: str) -> bool:
    """Whether a joiner is visible: between emoji, or between letters of a
    script whose letters join."""

    def shown(c: str) -> bool:
        return bool(c) and (ord(c) >= 0x1F000 or 0x2190 <= ord(c) < 0x2BFF or 0x600 <= ord(c) < 0x780 or 0x900 <= ord(c) < 0xE00)

    return shown(before) and shown(after)


@lru_cache(50_000)
def _unstyled(c: str) -> str:
    """Wide, narrow and mathematical forms, ligatures and Roman numerals as plain letters."""
    o = ord(c)
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind in ("<font>", "<wide>", "<narrow>") or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17 or 0x2160 <= o <= 0x217F:
        return unicodedata.normalize("NFKC", c)
    return c


def _symbols(text: str) -> list[str]:
    """Decomposed: each base character with its marks."""
    out: list[str] = []
    for c in unicodedata.normalize("NFD", text):
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return out


@lru_cache(50_000)
def _look(symbol: str) -> str:
    """What a reader sees of a symbol."""
    return "".join(_ALIKE.get(c, c) for c in symbol)


def units(token: str) -> list[list[str]]:
    """The raw token from left to right, as the automaton reads it: the looks of each
    character with its marks; none for a character that can't be seen."""
    out: list[list[str]] = []
    i, n = 0, len(token)
    while i < n:
        c = token[i]
        if _IGNORABLE.match(c) or c in _JOINERS and not _joins(token[i - 1 : i], token[i + 1 : i + 2]):
            out.append([])
            i += 1
            continue
        j, marks = i + 1, ""
        while j < n and (unicodedata.combining(token[j]) or _IGNORABLE.match(token[j])):
            marks += "" if _IGNORABLE.match(token[j]) else token[j]
            j += 1
        out.append([_look(s) for s in _symbols(_unstyled(c) + marks)])
        i = j
    return out


def prototypes(token: str) -> str:
    """What a reader sees of a token, as a string."""
    return "".join(x for u in units(token) for x in u)


@lru_cache(50_000)
def _script(c: str) -> str:
    """The script of a letter by its name; "" for other characters."""
    if not c.isalpha() or c in _MARK:
        return ""
    word = unicodedata.name(c, "").partition(" ")[0].lower()
    return word if word in ("latin", "greek", "cyrillic", "armenian", "cherokee", "coptic", "lisu") else ""


_BACK: dict[str, dict[str, str]] = {"cyrillic": {}, "greek": {}}
for _c, _l in (_LATIN | _GREEK).items():
    if _script(_c) in _BACK:
        _BACK[_script(_c)].setdefault(_l, _c)


def by_table(token: str) -> str:
    """The one script that the letters without look-alikes have decides how the
    others are written; Latin if there are none or several."""
    proto = prototypes(token)
    own = {s for c in proto if (s := _script(c)) in _BACK and c not in _GREEK.values()}
    firm = any(c.isascii() and c.isalpha() and len(own) == 1 and c not in _BACK[next(iter(own))] for c in proto) if own else True
    if len(own) == 1 and not firm:
        back = _BACK[own.pop()]
        proto = "".join(back.get(c, c) for c in proto)
    return unicodedata.normalize("NFC", proto)


def is_plain(word: str) -> bool:
    """Composed, all visible, of usual width and style, letters of one script."""
    if unicodedata.normalize("NFC", word) != word or not all(units(word)) or any(_unstyled(c) != c for c in word):
        return False
    scripts = {s for c in word if (s := _script(c))}
    return len(scripts) < 2 and not any(c in _LATIN and _script(c) == "latin" for c in word)


class _Node:
    __slots__ = ("edges", "alike", "word")

    def __init__(self) -> None:
        self.edges: dict[str, _Node] = {}
        self.alike: dict[str, list[_Node]] = {}  # the edges by what they look like
        self.word: tuple[str, int] | None = None


class Trie:
    """Plain spellings with counts, and the automaton over them."""

    def __init__(self, words: list[tuple[str, int]]):
        self.root = _Node()
        for w, n in words:
            node = self.root
            for s in _symbols(w):
                child = node.edges.get(s)
                if child is None:
                    child = node.edges[s] = _Node()
                    node.alike.setdefault(_look(s), []).append(child)
                node = child
            node.word = (w, n)

    def search(self, token: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """(cost, word, count) of the words within the budget."""
        read = units(token)
        best: dict[tuple[str, int], int] = {}
        stack = [(0, self.root, 0)]
        done: set[tuple[int, int, int]] = set()
        while stack:
            i, node, cost = stack.pop()
            if (i, id(node), cost) in done:
                continue
            done.add((i, id(node), cost))
            if i == len(read):
                if node.word:
                    best[node.word] = min(cost, best.get(node.word, cost))
            else:
                here = [node]  # an ignorable unit has no looks and stays where it is
                for x in read[i]:
                    here = [c for h in here for c in h.alike.get(x, ())]
                stack += [(i + 1, h, cost) for h in here]
            if cost < budget:
                if i < len(read):
                    stack.append((i + 1, node, cost + 1))
                for child in node.edges.values():
                    stack.append((i, child, cost + 1))
                    if i < len(read):
                        stack.append((i + 1, child, cost + 1))
        return sorted((c, *w) for w, c in best.items())


def _block(looks: list[str]) -> str:
    """What a token shares with all words that look like it: its beginning and length."""
    return f"{''.join(looks[:3])}:{len(looks)}"


def _ask(words: list[tuple[str, int]]):
    trie = Trie(words)
    return lambda token, n: [(w, k) for _, w, k in trie.search(token)]


def _shown(text: str) -> Column:
    return F.translate(text, _BETWEEN, _SHOWN)


def _tokens(shown: str) -> Column:
    return F.array_distinct(F.split(shown, _CUT))


def vocabulary(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(plain words: block, word, n; odd tokens: block, token, n, plain, by_table),
    n being the number of texts.  All words of all texts are counted."""

    def read(rows):
        for t, n in rows:
            yield _block([x for u in units(t) for x in u]), t, n, is_plain(t), by_table(t)

    cols = df.where(F.length(text) > 0).select(_shown(text).alias("shown"))
    counts = cols.select(F.explode(_tokens("shown")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "tokens")
    odd = materialize(map_rows(counts.where(F.col("token").rlike(_ODD)), read, "block string, token string, n bigint, plain boolean, by_table string"), "odd-tokens")
    usual = counts.where(~F.col("token").rlike(_ODD)).select(F.concat(F.substring("token", 1, 3), F.lit(":"), F.length("token")).alias("block"), F.col("token").alias("word"), "n")
    return usual.unionByName(odd.where("plain").select("block", F.col("token").alias("word"), "n")), odd


def spellings(df: DataFrame, text: str = "text") -> DataFrame:
    """token, canonical: the odd tokens that are written otherwise."""
    words, odd = vocabulary(df, text)
    hits = tries.search(words, odd.select("block", "token", "n"), _ask, "word string, n bigint")
    best = hits.groupBy("token").agg(F.min(F.struct(F.col("word").rlike(_ODD).alias("odd"), (-F.col("n")).alias("n"), "word")).alias("b"))
    form = odd.select("token", "by_table").join(best, "token", "left").select("token", F.coalesce("b.word", "by_table").alias("canonical"))
    return materialize(form.where("canonical <> token"), "spellings")


def _applied(df: DataFrame, key: str, text: str, out):
    """The odd texts with their changes, and the function over them that gives
    id and ``out(text, canonical text)``.

    A text meets the tokens to be changed by a join; a text's changes are at most its
    own distinct tokens.
    """
    new = spellings(df, text)
    odd = df.where(F.col(text).rlike(_ODD)).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), F.md5(text).alias("raw"))
    held = odd.select("id", "raw", F.explode(_tokens(_shown("t"))).alias("token")).where(F.col("token").rlike(_ODD)).join(new, "token").distinct()
    changes = held.groupBy("id", "raw").agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical"))).alias("changes"))

    def run(rows):
        for k, t, shown, change in rows:
            # an absent token stays as it is
            fixed = _TOKEN.sub(lambda m, c=dict(change): c.get(m.group(), m.group()), shown) if change else shown
            yield k, *out(t, fixed)

    rows = odd.join(changes, ["id", "raw"], "left").select("id", "t", _shown("t").alias("shown"), "changes")
    return rows, run


def canonical(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the text in canonical form, of every row."""
    rows, run = _applied(df, key, text, lambda t, fixed: (fixed,))
    usual = df.where(~F.coalesce(F.col(text).rlike(_ODD), F.lit(False))).select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    return usual.unionByName(map_rows(rows, run, f"{key} bigint, text string"))


def looks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, raw, look: hashes of the text as stored and of its canonical form."""
    md5 = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
    rows, run = _applied(df, key, text, lambda t, fixed: (md5(t), md5(fixed)))
    usual = df.where(F.length(text) > 0).where(~F.col(text).rlike(_ODD)).select(F.col(key).cast("bigint").alias("id"), F.md5(text).alias("raw"), F.md5(text).alias("look"))
    return materialize(usual.unionByName(map_rows(rows, run, "id bigint, raw string, look string")), "looks")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the smallest id of the texts that look the same), n_spellings
    and n_texts of every text: membership instead of pairs, linear in the rows."""
    keys = looks(df, key, text).distinct()
    per = keys.groupBy("look").agg(F.min("id").alias("class_id"), F.countDistinct("raw").alias("n_spellings"), F.count(F.lit(1)).alias("n_texts"))
    return keys.join(per, "look").select(F.col("id").alias(key), "class_id", "n_spellings", "n_texts")


def found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a < doc_id_b of texts that look the same and aren't the same."""
    keys = looks(df, key, text)
    # pairs of distinct strings of a look, then their members; a look or a string
    # that many documents share is spread by a salt on the members' side
    spelled = keys.select("look", "raw").distinct()
    b = spelled.select("look", F.col("raw").alias("raw_b"))
    pairs = spelled.withColumnRenamed("raw", "raw_a").join(b, "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    members = keys.select("id", "raw", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    salts = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("salt")
    with_a = pairs.select("*", salts).join(members.select(F.col("id").alias("id_a"), F.col("raw").alias("raw_a"), "salt"), ["raw_a", "salt"]).drop("salt")
    with_b = with_a.select("id_a", "raw_b", salts).join(members.select(F.col("id").alias("id_b"), F.col("raw").alias("raw_b"), "salt"), ["raw_b", "salt"])
    return with_b.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()
