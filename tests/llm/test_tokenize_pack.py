from collections import Counter

import pytest

from lexmill.llm import pack, tokenize

TEXTS = [
    None, "", " ", "  ", "a", "The court's order\n\n  was denied.", "foo\n\n bar", "a   b\t\tc \n d", "x<|endoftext|>y", "日本語のテキスト" * 50, "Fjällräven Møbler — “naïve”", "👨‍👩‍👧 emoji", "'s 'll I'VE don't", "\x1c\x1d a", "𝔘𝔫𝔦 ½²Ⅷ٣",
    "a" * 3000, "ab" * 2000, " " * 2000, "=" * 700, "é́​x", "\r\n\r\n x", "1234567890 12.5%", "end ",
]


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenize.TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenize.ids(df).collect()}
    assert got == {i: library(t) for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokenize.sizes(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tokenize.ids(df.limit(0)).collect() == []


def test_random_texts(library):
    import random

    r = random.Random(7)
    alphabet = "ab cé\n\t 1.'’日 "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    flat, at = tokenize.encoder().encode(texts)
    for i, t in enumerate(texts):
        assert list(flat[at[i] : at[i + 1]]) == library(t)


def check_plan(lengths, capacity):
    segments, used = pack.plan(list(Counter(lengths).items()), capacity)
    fill, ranks = Counter(), Counter()
    for length, first, n, base, per in segments:
        for i in range(n):
            fill[base + i // per] += length
            ranks[length, first + i] += 1
    assert set(ranks.values()) <= {1} and Counter(x for x, _ in ranks) == Counter(lengths)
    assert all(v <= capacity for v in fill.values()) and set(fill) == set(range(used))
    return used


def test_plan_against_best_fit_decreasing():
    import random

    r = random.Random(2)
    for _ in range(60):
        capacity = r.randint(5, 60)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 150))]
        used = check_plan(lengths, capacity)
        boxes = []
        for x in sorted(lengths, reverse=True):
            fits = [b for b in boxes if b[0] >= x]
            if fits:
                min(fits)[0] -= x
            else:
                boxes.append([capacity - x])
        assert used == len(boxes)
    assert check_plan([7] * 1000 + [3] * 999, 10) == 1000


def test_fill(spark):
    texts = ["word " * n for n in (3, 3, 3, 40, 700, 1, 12)] + [None, "", "  "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, capacity int")
    rows = pack.fill(spark, df, [16, 100]).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokenize.sizes(df).collect()}
    for c in (16, 100):
        mine = [r for r in rows if r.capacity == c]
        assert {r.doc_id for r in mine} == {i for i, n in sizes.items() if n}
        for i, n in sizes.items():
            pieces = sorted((r.piece, r.length) for r in mine if r.doc_id == i)
            assert sum(x for _, x in pieces) == n and [p for p, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == -(-n // c)
        load = Counter()
        for r in mine:
            load[r.container] += r.length
        assert max(load.values()) <= c
    assert pack.fill(spark, df.limit(0), [16]).collect() == []


@pytest.mark.parametrize("salt", [1, 3, 100_000])
def test_frequent_lengths_and_long_texts_are_spread(spark, monkeypatch, salt):
    monkeypatch.setattr(pack, "SALT", salt)
    df = spark.createDataFrame([(i, "word " * (3 if i % 3 else 40), 1) for i in range(60)], "doc_id bigint, text string, capacity int")
    rows = pack.fill(spark, df, [16, 9]).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokenize.sizes(df).collect()}
    for c in (16, 9):
        mine = [r for r in rows if r.capacity == c]
        assert Counter(r.doc_id for r in mine) == Counter({i: -(-n // c) for i, n in sizes.items()})
        assert len({(r.doc_id, r.piece) for r in mine}) == len(mine)
        load = Counter()
        for r in mine:
            load[r.container] += r.length
        assert max(load.values()) <= c and set(load) == set(range(max(load) + 1))
        rest = Counter(n % c for n in sizes.values() if n % c)
        assert len(load) == sum(n // c for n in sizes.values()) + pack.plan(list(rest.items()), c)[1]
