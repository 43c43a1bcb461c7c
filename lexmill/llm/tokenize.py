"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by the tokenizer's own pattern.  The distinct
pre-tokens of a batch that are not known yet are laid into padded numpy
matrices, bucketed by length.  In every round each row merges its leftmost
pair of minimum rank; pairs are looked up in an open-addressing hash table, and
rows as well as columns are compacted after the merge.  Rows without a pair
leave the matrix.  Very long pre-tokens are merged one by one, all equal pairs
of the minimum rank in a round, which gives the same ids.

Defined results: an empty text and a null text both have the empty list of
ids; texts are encoded whole, without special tokens; special-token strings in
a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens of more bytes than this are encoded one by one.
LONG = 256
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 400_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: The public pattern of this family of tokenizers, and its equal on ASCII.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_PATTERN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\s\dA-Za-z]+|\s+(?!\S)|\s+", re.ASCII)
_PATTERN = regex.compile(PATTERN)
#: U+001C..U+001F are white space to ``re`` with str.isspace rules but not to the tokenizer.
_ODD_ASCII = re.compile(r"[\x1c-\x1f]")


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def _unit_text(unit: str) -> str:
    if unit == " ":
        return ""  # an empty first piece
    if unit[:1] == " ":
        return unit[1:]
    return unit[:-1] if unit[-1:] == " " else " " + unit


class Encoder:
    """Byte-level BPE over numpy matrices."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, stand = model["vocab"], byte_characters()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in stand.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._build((left << np.uint64(20)) | right, merged)
        self._forget()

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing; ranks are the merge order."""
        self.bits = int(len(keys) * 4).bit_length()
        size = 1 << self.bits
        self.keys = np.full(size, _EMPTY, np.uint64)
        self.rank = np.zeros(size, np.int64)
        self.merged = np.zeros(size, np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] == _EMPTY
            _, first = np.unique(s, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            t = todo[wins]
            self.keys[slot[t]], self.rank[slot[t]], self.merged[slot[t]] = keys[t], t, merged[t]
            todo = todo[~wins]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is no such pair."""
        out = np.full(keys.shape, -1, np.int64)
        slot = self._slot(keys)
        left = np.arange(keys.size)
        flat, mask = keys.ravel(), (1 << self.bits) - 1
        slot = slot.ravel()
        res = out.ravel()
        for _ in range(self.probes):
            at = slot[left]
            have = self.keys[at]
            hit = have == flat[left]
            res[left[hit]] = at[hit]
            go = ~hit & (have != _EMPTY)
            left = left[go]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & mask
        return res.reshape(keys.shape)

    def _matrix(self, ids: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Rows of ``ids`` padded with -1 -> the ids after all merges."""
        n = len(ids)
        done: list[np.ndarray | None] = [None] * n
        rows = np.arange(n)
        top = np.iinfo(np.int64).max
        while len(rows):
            width = int(lens.max())
            ids = ids[:, :width]
            if width < 2:
                break
            a, b = ids[:, :-1], ids[:, 1:]
            slot = np.full(a.shape, -1, np.int64)
            real = b >= 0
            slot[real] = self._find((a[real].astype(np.uint64) << np.uint64(20)) | b[real].astype(np.uint64))
            rank = np.where(slot >= 0, self.rank[slot], top)
            at = rank.argmin(axis=1)  # the leftmost minimum
            k = np.arange(len(rows))
            go = rank[k, at] < top
            for i in np.flatnonzero(~go):
                done[rows[i]] = ids[i, : lens[i]]
            rows, ids, lens, at, slot = rows[go], ids[go], lens[go], at[go], slot[go]
            if not len(rows):
                return done
            k = np.arange(len(rows))
            new = self.merged[slot[k, at]]
            cols = np.arange(width - 1)
            ids = np.where(cols[None, :] <= at[:, None], ids[:, :-1], ids[:, 1:])  # compaction
            ids[k, at] = new
            lens = lens - 1
            ids[np.arange(ids.shape[1])[None, :] >= lens[:, None]] = -1
        for i in range(len(rows)):
            done[rows[i]] = ids[i, : lens[i]]
        return done

    def _long(self, raw: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(raw, np.uint8)]
        while len(ids) > 1:
            slot = self._find((ids[:-1].astype(np.uint64) << np.uint64(20)) | ids[1:].astype(np.uint64))
            ok = slot >= 0
            if not ok.any():
                break
            low = self.rank[slot[ok]].min()
            hit = np.flatnonzero(ok & (self.rank[slot] == low))
            # runs of overlapping hits merge from the left: every other one
            start = np.r_[True, np.diff(hit) != 1]
            first = hit[start][np.cumsum(start) - 1]
            hit = hit[(hit - first) % 2 == 0]
            ids[hit] = self.merged[slot[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids = ids[keep]
        return ids

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        got: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, 64), (64, 128), (128, LONG)):
            pick = np.flatnonzero((size > lo) & (size <= hi))
            for part in (pick[i : i + 20_000] for i in range(0, len(pick), 20_000)):
                n = size[part]
                ids = np.full((len(part), int(n.max())), -1, np.int64)
                joined = np.frombuffer(b"".join(raws[i] for i in part), np.uint8)
                ids[np.arange(ids.shape[1])[None, :] < n[:, None]] = self.byte_id[joined]
                for i, row in zip(part, self._matrix(ids, n.copy())):
                    got[i] = row
        for i in np.flatnonzero(size > LONG):
            got[i] = self._long(raws[i])
        return got

    def _learn(self, units: list[str]) -> None:
        """Remember the ids of new units (see ``codes``)."""
        cut = [_PATTERN.findall(_unit_text(u)) for u in units]
        words = list(set().union(*cut))
        ids = dict(zip(words, self._words(words)))
        base = len(self.code)
        need = base + len(units)
        if need > len(self.starts):
            grow = max(need, 2 * len(self.starts))
            self.starts, self.lens = np.resize(self.starts, grow), np.resize(self.lens, grow)
        parts = [ids[w] for c in cut for w in c]
        n = np.fromiter((sum(len(ids[w]) for w in c) for c in cut), np.int64, len(cut))
        total = int(n.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + total, 2 * len(self.flat)))
        if parts:
            self.flat[self.used : self.used + total] = np.concatenate(parts)
        self.lens[base:need] = n
        self.starts[base:need] = self.used + np.cumsum(n) - n
        self.used += total
        for k, u in enumerate(units):
            self.code[u] = base + k

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units of all texts, and how many units each has.

        A single space always begins a pre-token, so a text without double
        spaces may be cut at its spaces first; each piece is a unit that is
        matched against the pattern once.  Units are named so that none are
        mixed up: a piece after a space by itself, the first piece with a space
        behind it, and a pre-token of a text with double spaces with a space
        before it.
        """
        if len(self.code) > REMEMBERED:
            self._forget()
        cut = []
        for t in texts:
            if not t:
                cut.append(())
            elif "  " in t:
                cut.append([" " + w for w in (_ASCII_PATTERN if t.isascii() and not _ODD_ASCII.search(t) else _PATTERN).findall(t)])
            else:
                c = t.split(" ")
                c[0] += " "
                cut.append(c)
        new = set().union(*cut) - self.code.keys()
        if new:
            self._learn(list(new))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        return codes, n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of the texts in them."""
        codes, n = self.codes(texts)
        size = self.lens[codes]
        ends = np.cumsum(size)
        flat = np.arange(int(size.sum())) + np.repeat(self.starts[codes] - (ends - size), size)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
        return self.flat[flat], bounds

    def count(self, texts: list[str | None]) -> np.ndarray:
        codes, n = self.codes(texts)
        ends = np.r_[0, np.cumsum(self.lens[codes])]
        return np.diff(ends[np.r_[0, np.cumsum(n)]])


@lru_cache(2)
def encoder(path: str = TOKENIZER) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


#: Characters handled at once inside a batch, so that memory stays bounded.
SLICE = 4_000_000


def _slices(texts: list[str | None]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """key and ids (array of int) of every row."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                flat, bounds = e.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], names=[key, "ids"])

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, ids array<int>")


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """key and n_tokens of every row, without building the lists."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(e.count(texts[lo:hi]), pa.int64())], names=[key, "n_tokens"])

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, n_tokens bigint")
