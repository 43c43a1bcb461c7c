from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexmill.functions import constants as C
from lexmill.functions import text as T
from lexmill.operators import briefing, chunk, feedback, preprocess, qa, retrieval, summarize, terms, vocab
from lexmill.sources import corpus, files
from lexmill.streaming import feedback as stream

CHUNKS = [
    (0, "The plaintiff is seeking damages here in court from the defendant for an injury"),
    (1, "damages"),
    (2, "compensation damages compensation for the plaintiff"),
    (3, "nothing of note"),
]


def test_bm25_plus_against_brute_force(spark):
    import math

    q = "damages compensation"
    got = retrieval.bm25_plus(spark.createDataFrame(CHUNKS, "id int, t string"), "id", "t", spark.createDataFrame([("q", q)], "qid string, q string"), "qid", "q", 4).orderBy("rank").collect()
    docs = {i: t.lower().split() for i, t in CHUNKS}
    avg = sum(map(len, docs.values())) / len(docs)
    score = {}
    for i, d in docs.items():
        score[i] = 0.0
        for w in q.split():
            n = sum(w in x for x in docs.values())
            tf = d.count(w)
            score[i] += math.log((len(docs) + 1) / n) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(d) / avg) + tf))
    want = sorted(score, key=lambda i: (-round(score[i], 9), i))
    assert [r.id for r in got] == want and got[0].relevance == 0.5
    assert all(abs(r.score - score[r.id]) < 1e-5 for r in got)


def test_bm25_plus_in_blocks(spark, monkeypatch):
    """Blocks of any size give the ranking of all pairs; what ranks has rows for blocks
    and for the best of each, never for postings or pairs."""
    import math
    import random

    monkeypatch.setattr(retrieval, "TEXTS", 7)
    monkeypatch.setattr(retrieval, "TOKENS", 60)
    monkeypatch.setattr(retrieval, "QUESTIONS", 5)
    r = random.Random(3)
    draw = lambda n: " ".join(f"w{min(int(r.expovariate(0.3)), 30)}" for _ in range(n))
    docs = [(f"k{i:03}", draw(r.randint(0, 30))) for i in range(80)]
    docs += [(f"c{i:03}", docs[5][1]) for i in range(20)]  # copies tie
    asked = [(i, draw(4)) for i in range(90)] + [(90, "nowhere"), (91, None)]
    df = retrieval.bm25_plus(spark.createDataFrame(docs, "id string, t string"), "id", "t", spark.createDataFrame(asked, "q bigint, s string"), "q", "s", 6)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()
    texts = {i: t.split() for i, t in docs}
    avg = sum(map(len, texts.values())) / len(texts)
    idf = {w: math.log((len(texts) + 1) / sum(w in t for t in texts.values())) for w in {w for t in texts.values() for w in t}}
    want = []
    for q, s in asked:
        ws = [w for w in (s or "").split() if w in idf]
        score = {i: round(sum(idf[w] * (1 + t.count(w) * 2.5 / (1.5 * (0.25 + 0.75 * len(t) / avg) + t.count(w))) for w in ws), 9) for i, t in texts.items()}
        want += [(q, i, n) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:6], 1) if ws]
    assert sorted((x.q, x.id, x["rank"]) for x in df.collect()) == sorted(want)


def test_vocabulary_bm25(spark):
    df = spark.createDataFrame([(1, "hematoma " + " ".join(f"w{i}x" for i in range(11)))], "id int, t string")
    w = spark.createDataFrame([("w1x", 0.087)], "term string, idf double")
    got = {r.term: r for r in terms.bm25_terms(df, "id", "t", w).collect()}
    assert abs(got["hematoma"].score - 16.895) < 1e-3 and got["hematoma"].confidence == 1.0 and "w1x" not in got


def test_vectors_against_brute_force(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(x.query, x.rank): x.id for x in retrieval.vector_top_k(df, "id", "v", df.where("id % 50 = 0"), 3).collect()}
    for qi in range(0, 300, 50):
        d = sorted((max(0.0, 1 - sum((a - b) ** 2 for a, b in zip(rows[qi][1], v)) ** 0.5 / 2**0.5), i) for i, v in rows[:300])
        best = sorted(d, key=lambda x: (-round(x[0], 6), x[1]))[:3]
        assert got[qi, 1] == qi == best[0][1]


def test_merge_hits(spark):
    hits = spark.createDataFrame([("q", 1, "a", 1.0, 0.8), ("q", 1, "b", 0.5, 0.6), ("q", 2, "a", 1.0, 0.5), ("q", 3, "b", 0.5, 0.9)], "q string, id int, algorithm string, weight double, relevance double")
    got = {r.id: (r.score, r.rank) for r in retrieval.merge_hits(hits, "q", "id", 3).collect()}
    assert got == {1: (0.833333, 2), 2: (0.5, 3), 3: (0.9, 1)}


def test_merge_terms_and_quality(spark):
    rows = [(1, "Hematoma", "NER", 0.85, "Technical", 1, 0), (1, "hematoma", "RAKE", 0.4, "Medical", 1, 5), (1, "Smith", "NER", 0.85, "Person", 1, 1)]
    m = vocab.merge(spark.createDataFrame(rows, "id int, term string, algorithm string, confidence double, type string, frequency bigint, ord bigint"), "id")
    got = {r.k: r for r in m.collect()}
    assert got["hematoma"].term == "Hematoma" and got["hematoma"].type == "Technical" and abs(got["hematoma"].confidence - 0.664706) < 1e-6 and got["hematoma"].frequency == 2
    v = {r.term: r.quality_score for r in vocab.vocabulary(m, "id").collect()}
    assert v["Smith"] == 85.0
    q = lambda t, f, r, a: spark.range(1).select(vocab.quality(F.lit(t), F.lit(f), F.lit(r), F.lit(a)).alias("q")).first().q
    assert [q("Medical", 2, 0, 2), q("Technical", 4, 190_000, 3), q("Unknown", 2, 501, 1), q("Person", 4, 0, 3)] == [94.0, 94.0, 60.0, 100.0]


def test_frequency_ranks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "word string, count int")
    assert {r.word: r["rank"] for r in vocab.frequency_ranks(df).collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}


def test_header_footer(spark):
    text = "\n".join(f"Page {i}\nContent line {i}\nConfidential memo" for i in range(1, 5))
    r = preprocess.header_footer(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("id").collect()
    assert r[0].n_removed == 8 and r[0].t.count("Content line") == 4
    assert (r[1].n_removed, r[1].t) == (0, None) and (r[2].n_removed, r[2].t) == (0, "")


def test_chunks_keep_all_words(spark):
    text = "\n\n".join(f"STATEMENT OF FACTS {i}\n" + "word " * n for i, n in enumerate((10, 400, 900, 1500, 3)))
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, t string")
    for out in (chunk.section_chunks(df, "id", "t"), chunk.brief_chunks(df, "id", "t")):
        rows = [r.text for r in out.orderBy(out.columns[1]).collect()]
        assert " ".join(rows).split() == text.split() and len(rows) > 2
    assert all(r.char_count <= 2600 for r in chunk.brief_chunks(df, "id", "t").collect())
    parts = chunk.recursive_split("alpha beta. " * 200)
    assert max(map(len, parts)) <= 500 and all(a.split()[-1] in b for a, b in zip(parts, parts[1:]))


def test_adaptive_boundaries(spark):
    got = lambda n: spark.range(1).select(summarize.adaptive_boundaries(F.lit(n)).alias("b")).first().b
    assert got(3) == [3] and got(25) == [5, 10, 15, 20, 25]
    assert got(92) == [5, 10, 15, 20, 30, 40, 50, 60, 70, 80, 85, 90, 92]


def test_feedback(spark):
    schema = "feedback_ts timestamp, document_id string, term string, feedback int, term_type string, algorithms string, quality_score double, in_case_freq int, freq_rank int"
    from datetime import datetime as D

    rows = [(D(2024, 1, 1), "d", " Smith ", 1, "Person", "NER,RAKE", 75.0, 3, 250000), (D(2024, 1, 2), "d", "smith", 0, None, None, None, None, None), (D(2024, 1, 2), "d", "Doe", -1, "Medical", "BM25", 60.0, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    assert {r.term_key: r.feedback for r in feedback.latest(df).collect()} == {"smith": 0, "doe": -1}
    f = {r.document_id + str(r.feedback): r for r in feedback.features(df).collect()}["d1"]
    assert (f.quality_score, f.in_case_freq, f.num_algorithms, f.is_person) == (75.0, 3.0, 2.0, 1.0) and abs(f.freq_rank_normalized - 0.8333) < 1e-3
    assert feedback.train(df) is None
    assert {r.preference for r in feedback.predict(None, df).collect()} == {0.5}
    many = spark.range(80).select(F.current_timestamp().alias("feedback_ts"), F.lit("d").alias("document_id"), F.concat(F.lit("t"), "id").alias("term"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("feedback"), F.lit("Person").alias("term_type"), F.lit("NER").alias("algorithms"), (F.col("id") % 2 * -40 + 90.0).alias("quality_score"), F.lit(1).alias("in_case_freq"), F.lit(0).alias("freq_rank"))
    model = feedback.train(many)
    p = {r.term: r.preference for r in feedback.predict(model, many).collect()}
    assert p["t0"] > 0.9 and p["t1"] < 0.1


def test_question_graph(spark):
    opt = "array<struct<value:string,label:string,next_id:string>>"
    rows = [("a", [("yes", "Yes", "b"), ("no", "No", "c")], None), ("b", None, "c"), ("c", [], None)]
    q = spark.createDataFrame(rows, f"question_id string, options {opt}, next_id string")
    assert {r.question_id: r.steps for r in qa.steps_to_end(q).collect()} == {"a": 2, "b": 1, "c": 0}
    o = spark.createDataFrame([("It is a lawsuit.", [("no", "Non", None), ("yes", "Yea", None)])], f"t string, o {opt}")
    assert o.select(qa.classify(F.col("t"), F.col("o")).alias("x")).first().x == "yes"


def test_text_dedup(spark):
    rows = [(i, "c", [t]) for i, t in enumerate(["The driver ran the red light.", "The driver ran the red light!", "The driver ran the red light at night.", "A pipe burst.", "short"])]
    got = {r.value for r in briefing.dedup_text(spark.createDataFrame(rows, "chunk_id int, case_id string, allegations array<string>"), "allegations").collect()}
    assert got == {"The driver ran the red light at night.", "A pipe burst."}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("This is a line of text that is long enough. Index No. 123456/2024\n", encoding="utf-8")
    (tmp_path / "b.rtf").write_text(r"{\rtf1\ansi{\fonttbl\f0 Arial;}\f0 This motion is supported by caf\'e9 papers.\par Second line of the motion.}", encoding="latin-1")
    (tmp_path / "c.docx").write_bytes(b"x")
    got = {r.filename: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].case_numbers == ["Index No. 123456/2024"] and got["b.rtf"].text.startswith("This motion is supported by café papers.")
    assert (got["c.docx"].status, got["c.docx"].error_message) == ("error", "Unsupported file type")
    docs = spark.createDataFrame([("a", "x")], "name string, corpus string")
    assert {r.name for r in corpus.combine(docs, spark.createDataFrame([("a", "y"), ("b", "y")], "name string, corpus string"), "name", "corpus").collect()} == {"a", "y_a", "b"}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,0,id*1800)")).alias("ts"), F.lit("k").alias("g"), F.lit(1.0).alias("v"), (F.col("id") % 100).alias("id"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.run_folder(spark, str(tmp_path / "in"), e.schema, lambda s: stream.windowed(s, "ts", "g", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.start: r.n for r in stream.windowed(e, "ts", "g", "v").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


@pytest.mark.parametrize("name", ["bm25_top_terms", "normalized_text", "header_footer", "rake_phrases", "extracted_answers", "section_chunks"])
def test_plans_stay_in_the_jvm(spark, name):
    from lexmill.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_imports_without_the_text_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[2] / "lexmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
    assert C.K1 == 1.2


def test_narratives(spark):
    part = "struct<plaintiffs:array<string>,defendants:array<string>>"
    rows = [(1, "c", {"plaintiffs": ["Ann Bly"], "defendants": ["Cox LLC", "Dee"]}, ["A pipe burst."], [], ["Fact one.", "Fact two."], ["May 4, 2020"], ["slip and fall"], True)]
    df = spark.createDataFrame(rows, f"chunk_id int, case_id string, parties {part}, allegations array<string>, defenses array<string>, key_facts array<string>, dates_mentioned array<string>, case_type_hints array<string>, extraction_success boolean")
    want = "This is a premises liability case brought by Ann Bly against Cox LLC and Dee.\n\nThe plaintiff alleges that a pipe burst.\n\nKey facts include:\n- Fact one.\n- Fact two.\n\nRelevant dates: May 4, 2020"
    told = {}
    for r in briefing.narratives(df).orderBy("paragraph", "position").collect():
        told[r.paragraph] = told.get(r.paragraph, "") + r.part
    assert "\n\n".join(told[k] for k in sorted(told)) == want


def test_dictionary_confidence(spark):
    df = spark.createDataFrame([(1, "The cat sat, the dog ran"), (2, ""), (3, None)], "id int, t string")
    words = spark.createDataFrame([("the",), ("cat",), ("the",)], "word string")
    got = {r.id: (r.n_tokens, r.n_known, r.confidence) for r in terms.dictionary_confidence(df, "id", "t", words).collect()}
    assert got == {1: (6, 3, 50.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}


def test_ordinal(spark):
    from lexmill.operators.ranks import ordinal

    df = spark.createDataFrame([(g, k) for g in "ab" for k in (7, 1, 30, 12, 11, 25)], "g string, k int")
    got = {(r.g, r.k): r.ordinal for r in ordinal(df, ["g"], ["k"], F.floor(F.col("k") / 10)).collect()}
    assert got == {(g, k): i for g in "ab" for i, k in enumerate((1, 7, 11, 12, 25, 30))}


PEOPLE = "case_id string, chunk_id bigint, names_mentioned array<struct<name string, role string, category string>>"


def test_people_are_merged_like_by_hand(spark):
    names = ["Dr. Amara Sosk", "Amara Sosk", "Sosk", "Amara T. Sosk", "Amarra Sosk", "Elias Sosk", "Noor Pell", "noor pell", "Noor  Pell", None, " ", "Mr."]
    rows = [("c", i, [(n, "nurse" if i else "", "MEDICAL" if i % 2 else None)]) for i, n in enumerate(names)]
    rows += [("d", 90, [("Sosk", None, "OTHER")] * 3), ("e", 91, None), ("f", 92, [])]
    df = spark.createDataFrame(rows, PEOPLE)
    got = {(r.case_id, r.name): (r.n_spellings, r.n_mentions) for r in briefing.merged_people(df).collect()}

    def head(norm, all_norms):
        fits = [m for m in all_norms if (len(norm), norm) < (len(m), m) and (set(norm.split()) <= set(m.split()) or SequenceMatcher(None, norm, m).ratio() >= 0.85)]
        return head(max(fits, key=lambda m: (len(m), m)), all_norms) if fits else norm

    norms = ["amara sosk", "amara sosk", "sosk", "amara t sosk", "amarra sosk", "elias sosk", "noor pell", "noor pell", "noor pell"]
    groups = {}
    for n in norms:
        groups.setdefault(head(n, norms), []).append(n)
    assert sorted(v for (c, _), v in got.items() if c == "c") == sorted((len(set(g)), len(g)) for g in groups.values())
    assert ("c", "Dr. Amara Sosk") in got and ("c", "Elias Sosk") in got and got[("d", "Sosk")] == (1, 3) and {k[0] for k in got} == {"c", "d"}
    assert sum(n for (c, _), (_, n) in got.items() if c == "c") == 9
    assert briefing.merged_people(df.limit(0)).collect() == []


def test_sheets(spark):
    schema = "case_id string, chunk_id bigint, parties struct<plaintiffs array<string>, defendants array<string>>, allegations array<string>, defenses array<string>, key_facts array<string>, dates_mentioned array<string>, case_type_hints array<string>, vocabulary array<string>, names_mentioned array<struct<name string, role string, category string>>"
    full = ("a", 1, (["Ann Low"], []), [f"claim {i:02}" for i in range(12)], ["x" * 201], [], [], ["medical malpractice"], [f"term{i:02}" for i in range(31)], [("Ann Low", "buyer", "PARTY")])
    bare = ("b", 2, None, None, None, None, None, None, None, None)
    got = {}
    for r in briefing.sheets(spark.createDataFrame([full, bare], schema)).orderBy("section", "position").collect():
        got.setdefault(r.case_id, []).append(r.line)
    got = {k: "\n".join(v) for k, v in got.items()}
    a = got["a"]
    assert "PARTIES\n-------\nPlaintiff(s): Ann Low\nDefendant(s): Not identified" in a and "  10. claim 09\n  ... and 2 more" in a and "claim 10" not in a
    assert "  1. " + "x" * 197 + "...\n" in a and "term29\n  ... and 1 more terms" in a and "term30" not in a and "  Parties:\n    - Ann Low (buyer)" in a
    assert "CASE TYPE: Not determined" in got["b"] and got["b"].count("None identified in documents.") == 2 and "No key individuals identified." in got["b"]


def test_lead_summaries(spark):
    long = "Dr. Low saw it at once. " + "word " * 80 + "end. Third one here."
    rows = [(1, long), (2, "short."), (3, None), (4, ""), (5, "word " * 500), (6, "One two three four five. Six seven eight nine ten. " * 20)]
    got = {r.k: r.summary for r in summarize.lead_summaries(spark.createDataFrame(rows, "k int, t string"), "k", "t", 20).collect()}
    assert set(got) == {1, 5, 6} and got[1].endswith("saw it at once.") and len(got[5].split()) == 500 and len(got[6].split()) == 20


def test_answer_contexts(spark):
    sources = [("f", 1, "S", 0.9, 3), ("f", 2, "N/A", 0.05, 3), ("g", 1, None, 0.2, 3), ("h", 9, "S", 0.9, 1), (None, 1, "S", 0.9, 1)]
    answers = spark.createDataFrame([(1, sources), (2, []), (3, None)], "qa_id bigint, sources array<struct<filename string, chunk_num int, section string, score double, word_count int>>")
    chunks = spark.createDataFrame([("f", 1, "one"), ("f", 2, "two"), ("g", 1, "three"), ("h", 9, None)], "filename string, chunk_num int, text string")
    assert [tuple(r) for r in qa.contexts(answers, chunks, "qa_id").collect()] == [(1, 2, "[f, S]:\none\n\n---\n\n[g]:\nthree")]


def test_chunk_ids_count_over_all_documents(spark):
    rows = [(d, n) for d in ("b1", "a", "b", "b22", "c") for n in (3, 1, 70000, 2)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "d string, n int").repartition(5)
    want = {r: f"{r[0]}_{i}" for i, r in enumerate(sorted(r for r in rows if None not in r))}
    for coarse, fine in ((1, 1), (1, 2), (2, 5)):
        assert {(r.d, r.n): r.chunk_id for r in chunk.chunk_ids(df, "d", "n", coarse, fine, 2).collect()} == want
    assert chunk.chunk_ids(df.limit(0), "d", "n").collect() == []


def test_text_dedup_against_brute_force(spark):
    from itertools import product

    long = [f"the crate bore tracking number {i}71-204-97{i} and part number {i * 7919} when it came" for i in range(9)]
    other = [f"{a} {b} the {c} before the {d} of May" for a, b, c, d in product(("tenant", "driver"), ("left", "struck", "repaired the back of"), ("van", "wall"), ("third", "end"))]
    texts = long + other + ["struck the van", "number 371-204-973 and", "Nobody was told of it."] + [f"unit {'x' * i} {i * 104729} was sealed on {i * 31} orders" for i in range(150)]
    df = spark.createDataFrame([(i, "c", [t]) for i, t in enumerate(texts)], "chunk_id int, case_id string, allegations array<string>")
    got = {r.value for r in briefing.dedup_text(df, "allegations").collect()}
    norms = {t.lower(): t for t in texts}

    def goes(a):
        later = [b for b in norms if len(b) > len(a) or len(b) == len(a) and b < a]
        return any(a in b or SequenceMatcher(None, a, b, autojunk=False).ratio() >= C.TEXT_SIMILARITY for b in later)

    want = {t for n, t in norms.items() if not goes(n)}
    assert got == want and "struck the van" not in got and len(set(long) & got) < 9


def test_people_merged_against_brute_force(spark):
    firsts, lasts = ("Hugo", "Marta", "Oskar", "Lena", "Priya"), ("Proallison", "Brizzuga", "Kestrelman", "Tolliver", "Vandermeer")
    names = [f"{a} {b}" for a in firsts for b in lasts] + [f"{a[0]}{b[0]} {b}" for a in firsts for b in lasts] + [f"{a} {b[:4]}{b[5:]}" for a in firsts for b in lasts]
    names += [f"{b} medical group llc" for b in lasts] + ["Brizzuga Medycal Group", "Kestrelman Medcial Group", "Tolliverr Medical Grp"] + [f"Unit {i * 7919} {'x' * (i % 9)}" for i in range(120)]
    names += ["z" * k for k in (4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 49, 64, 83)]  # a chain of twelve steps
    df = spark.createDataFrame([("c", i, [(n, None, None)]) for i, n in enumerate(names)], PEOPLE)
    got = sorted((r.n_spellings, r.n_mentions) for r in briefing.merged_people(df).collect())
    norms = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.normalize_name("n").alias("n")).collect()]
    after = {}
    for a in set(norms):
        fits = [b for b in set(norms) if (len(a), a) < (len(b), b) and (set(a.split()) <= set(b.split()) or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)]
        if fits:
            after[a] = max(fits, key=lambda b: (len(b), b))

    def head(n):
        return head(after[n]) if n in after else n

    groups = {}
    for n in norms:
        groups.setdefault(head(n), []).append(n)
    assert got == sorted((len(set(g)), len(g)) for g in groups.values())


def test_event_windows_equal_the_batch(spark, tmp_path):
    from lexmill.plans import queries

    at = lambda h: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), h)
    e = spark.range(200).select(F.col("id").alias("event_id"), at((F.col("id") / 2).cast("int")).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") * 0.5).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, stream.windowed(e, "ts", "event_type", "value").collect()))
    assert sorted(map(tuple, queries.event_windows(spark, str(tmp_path)).select("start", "event_type", "n", "total").collect())) == want
    run = lambda: stream.run_folder_whole(spark, str(tmp_path / "in"), e.schema, lambda s: stream.windowed(s, "ts", "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for part in ("event_id >= 100", "event_id < 100"):  # the second batch is hours late
        e.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        got = run()
    assert sorted(map(tuple, got.collect())) == want and sorted(map(tuple, run().collect())) == want
