"""Sections, responses, vocabulary and summaries on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import briefing, chunk, feedback, ranks, summarize, vocab
from lexmill.session import discard, materialize, shared_dir
from lexmill.sources import corpus, sinks


@pytest.mark.parametrize(
    "text,name",
    [
        ("FACTS AND CIRCUMSTANCES", "FACTS"),
        ("ARGUMENTS follow", "ARGUMENT"),
        ("1. Intro\nBACKGROUND of it", "BACKGROUND"),
        ("a. Facts", "a. F"),
        ("plaintiff moved", "plaintiff"),
        ("[12] A note", "[12]"),
        ("no section here", None),
        ("On 2020\n2020-01-02 it began", "2020-01-02"),
        (None, None),
    ],
)
def test_section_name(spark, text, name):
    got = spark.createDataFrame([(text,)], "t string").select(T.section_name("t")).first()[0]
    assert got == name


def test_section_chunks_leave_a_section_behind_when_they_are_full(spark):
    text = "FACTS one two\n\n" + "w " * 8 + "\n\nx y z"
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id bigint, text string")
    got = [(r.chunk_num, r.word_count, r.section_name) for r in chunk.section_chunks(df, "doc_id", "text", 9).orderBy("chunk_num").collect()]
    assert got == [(1, 3, "FACTS"), (2, 8, None), (3, 3, None)]


def test_brief_chunks_keep_their_text(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(40))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    rows = chunk.brief_chunks(df, "doc_id", "text").orderBy("chunk_index").collect()
    assert {r.doc_id for r in rows} == {1} and max(r.char_count for r in rows) <= 2500
    assert "\n\n".join(r.text for r in rows) == "\n\n".join(p.strip() for p in text.split("\n\n"))


def test_json_in_responses(spark):
    rows = [
        (1, 'Sure: {"allegations": ["fell", "", null], "parties": {"plaintiffs": "A. Bell"}, "names_mentioned": [{"name": "Eva", "category": "medical"}, "Jo"]} done'),
        (2, "[1, 2]"),
        (3, '{"parties": {'),
        (4, "I could not."),
        (5, ""),
        (6, '{"a": {"b": {"c": 1}}, "key_facts": "one"}'),
        (7, None),
    ]
    got = {r.chunk_id: r for r in briefing.parsed_responses(spark.createDataFrame(rows, "chunk_id bigint, raw_response string")).collect()}
    assert {k: r.state for k, r in got.items()} == {1: "object", 2: "array", 3: "cut", 4: "prose", 5: "prose", 6: "object"}
    one = got[1].record
    assert one.allegations == ["fell"] and one.parties.plaintiffs == ["A. Bell"] and one.defenses == []
    assert [tuple(x) for x in one.names_mentioned] == [("Eva", "", "MEDICAL"), ("Jo", "", "OTHER")]
    assert got[6].record.key_facts == ["one"] and got[2].record is None


def test_unusual_words(spark):
    df = spark.createDataFrame([(1, "Dr. Nadia Bell saw the MRI of the adenoma; the adenoma grew. Plaintiff said MR no. a-b x1 Common"), (2, None), (3, "")], "doc_id bigint, text string")
    ranked = spark.createDataFrame([("saw", 5), ("grew", 6), ("common", 7), ("mri", 8), ("adenoma", 9)], "word string, rank bigint")
    got = {(r.term, r.type, r.frequency) for r in vocab.unusual(df, "doc_id", "text", ranked).collect()}
    assert got == {("MRI", "Technical", 1)}
    medical = spark.createDataFrame([("Adenoma ",)], "word string")
    got = {(r.term, r.type, r.frequency) for r in vocab.unusual(df, "doc_id", "text", ranked, medical.select(F.lit("mri").alias("word")), medical).collect()}
    assert got == {("adenoma", "Medical", 2)}


def test_vocabulary_with_lists(spark):
    merged = spark.createDataFrame(
        [(1, "adenoma", "adenoma", "BM25", 1, 0.5, "Technical", 3, 1), (1, "nadia bell", "Nadia Bell", "NER", 1, 0.8, "Person", 1, 0), (1, "often", "often", "BM25", 1, 0.5, "Technical", 9, 2), (1, "lien", "lien", "BM25,RAKE", 2, 0.5, "Technical", 2, 3)],
        "doc_id bigint, k string, term string, sources string, n_algorithms bigint, confidence double, type string, frequency bigint, ord bigint",
    )
    ranked = spark.createDataFrame([("lien", 190_000)], "word string, rank bigint")
    medical = spark.createDataFrame([("adenoma",)], "word string")
    meanings = spark.createDataFrame([("adenoma", "x" * 120), ("nadia bell", "no")], "word string, definition string")
    got = {r.term: r for r in vocab.vocabulary(merged, "doc_id", ranked, medical=medical, definitions=meanings).collect()}
    assert set(got) == {"adenoma", "Nadia Bell", "lien"}
    assert (got["adenoma"].type, got["adenoma"].quality_score, got["adenoma"].definition) == ("Medical", 93.0, "x" * 97 + "...")
    assert (got["lien"].quality_score, got["lien"].freq_rank, got["lien"].definition, got["lien"].position) == (50 + 10 + 10 + 5 + 6, 190_000, "—", 3)
    assert got["Nadia Bell"].definition == "—"


def test_a_small_corpus_has_no_bm25_terms(spark):
    df = spark.createDataFrame([(i, "lien adenoma estoppel lien") for i in range(4)] + [(9, None)], "doc_id bigint, text string")
    weights = spark.createDataFrame([("lien", 1, 9.0)], "term string, df bigint, idf double")
    none = spark.createDataFrame([], "word string, rank bigint")
    assert "BM25" not in {r.algorithm for r in vocab.candidates(df, "doc_id", "text", weights, none).collect()}


def test_doctor_without_a_pattern(spark):
    docs = spark.createDataFrame([(1, "It was Dr. Nadia Bell. It was not Hugo Cairn who left.")], "doc_id bigint, text string")
    persons = vocab.entities(docs, "doc_id", "text").where("type = 'Person'").groupBy("doc_id", "term").agg(F.max("doctor").alias("doctor"))
    got = {r.term: r.role for r in vocab.person_roles(persons, docs, "doc_id", "text").collect()}
    assert got["Nadia Bell"] == "Medical professional" and got["Hugo Cairn"] == "Person in case"


def test_contexts(spark):
    rows = [("d", 1, "One. Two. Three.", "all"), ("d", 2, " ", None), ("d", 3, "x", ""), ("e", 5, None, None)]
    df = spark.createDataFrame(rows, "source_document string, chunk_num int, chunk_summary string, progressive_summary string")
    got = {(r.source_document, r.chunk_num): (r.local_context, r.global_context) for r in summarize.contexts(df).collect()}
    none = "[Previous chunk summary not yet available]", "[Global context not yet available]"
    assert got == {("d", 1): ("[No preceding content.]", "[This is the beginning of the document.]"), ("d", 2): ("[Previous: One. Two.]", "[Document overview: all]"), ("d", 3): none, ("e", 5): none}


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [("d", i, "s" if i % 7 < 3 else "t", f"x{i}" if i % 3 else None) for i in range(1, 60) if i % 11]
    df = spark.createDataFrame(rows, "source_document string, chunk_num int, section_detected string, chunk_summary string")
    whole = [sorted(map(tuple, f(df).collect())) for f in (summarize.section_runs, summarize.recent_summaries)]
    monkeypatch.setattr(summarize, "BLOCK", 4)
    assert whole == [sorted(map(tuple, f(df).collect())) for f in (summarize.section_runs, summarize.recent_summaries)]
    kinds = [r[2] for r in rows]
    assert len(whole[0]) == 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))
    by_chunk = {r[1]: r[2] for r in whole[1]}
    for i, r in enumerate(rows):
        assert by_chunk[r[1]] == "\n".join(x[3] for x in rows[max(0, i - 4) : i + 1] if x[3])


def test_spread_takes_part_of_everything(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.summary for r in summarize.spread_summaries(df, "doc_id", "text", 50).collect()}
    assert set(got) == {1} and got[1].startswith("Sentence number 0 ") and "number 90 " in got[1] and len(got[1].split()) == 50


def test_boundaries(spark):
    of = lambda n, m: spark.range(1).select(summarize.boundaries(F.lit(n), m)).first()[0]
    assert of(3, "deep") == [1, 2, 3] and of(12, "fixed") == [5, 10, 12] and of(4, "fixed") == [4] and of(10, "fixed") == [5, 10]


def test_feedback_log(spark, tmp_path):
    rows = [("d", "lien", 1, None, "NER", 1.0, 2, 3), ("d", "lien", 0, "x", None, None, None, None)]
    log = spark.createDataFrame(rows, "document_id string, term string, feedback int, term_type string, algorithms string, quality_score double, in_case_freq int, freq_rank int").withColumn("feedback_ts", F.expr("timestamp_ntz'2024-01-02 03:04:05'"))
    path = str(tmp_path / "log")
    for part in (log.where("feedback = 1"), log.where("feedback = 0")):
        sinks.append_feedback(part.withColumn("extra", F.lit(1)), path)
    assert sorted(map(tuple, sinks.read_feedback(spark, path).select("term", "feedback").collect())) == [("lien", 0), ("lien", 1)]
    assert feedback.counts(log).first().pending == 2 and not feedback.counts(log).first().retrain


def test_sinks(spark, tmp_path):
    terms = spark.createDataFrame([("lien", "Technical", 5.0, 1)], "term string, type string, quality_score double, extra int")
    sinks.vocabulary_csv(terms, str(tmp_path / "v"), "basic")
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).columns == ["term", "type", "quality_score"]
    sinks.chunk_store(spark.createDataFrame([("c1", 1, "x"), ("c2", 2, "y")], "case_id string, n int, t string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("case_id = 'c1'").count() == 1
    sinks.answers_text(spark.createDataFrame([("c1", 1, "why?", None)], "case_id string, n int, question_text string, answer_text string"), str(tmp_path / "a"), "case_id", "n")
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).select("value").collect()][:2] == ["Q: why?", "A: "]


def test_combined_texts(spark):
    df = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("c", 3, None), ("c", 4, ""), (None, 5, "z")], "case_id string, doc_id bigint, text string")
    got = [(r.position, r.part) for r in corpus.combined_texts(df, "case_id", "doc_id", "text", "doc_id", 1).orderBy("position").collect()]
    assert got == [(0, "--- 1 ---\na"), (1, "--- 2 ---\nb")]


def test_ranks_of_frequencies(spark):
    words = [(w, n) for n, ws in ((9, "b a"), (3, "zz za y"), (1, "q")) for w in ws.split()]
    got = {r.word: r.rank for r in vocab.frequency_ranks(spark.createDataFrame(words, "word string, count bigint")).collect()}
    assert got == {"a": 0, "b": 1, "y": 2, "za": 3, "zz": 4, "q": 5}


def test_running(spark):
    df = spark.createDataFrame([("g", i, 1 if i % 3 else 0) for i in range(20)], "g string, i int, v int")
    got = {r.i: r.s for r in ranks.running(df, ["g"], "i", "v", F.floor(F.col("i") / 4), "s").collect()}
    assert got == {i: sum(1 if k % 3 else 0 for k in range(i + 1)) for i in range(20)}


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "local-cluster[2,1,1024]", "x"

    with pytest.raises(ValueError):
        shared_dir(Cluster)
    step = materialize(spark.range(3), "t")
    files = step.inputFiles()
    assert step.count() == 3
    discard(step)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
