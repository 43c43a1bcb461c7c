"""One query for each operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.unicode import fix_garbled, plain_ascii
from ..operators import briefing, chunk, feedback, preprocess, qa, rake, retrieval, summarize, terms, vocab
from ..operators.ranks import ordinal
from ..session import materialize, shared_dir, table
from ..sources import corpus, sinks
from ..streaming import feedback as stream

WORK = "summarization_20251116_215704"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _work(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, WORK)


def _once(s: SparkSession, d: str) -> DataFrame:
    return briefing.once(table(s, d, "chunk_extraction"))


def term_df(s, d):
    return terms.document_frequency(_docs(s, d), "text")


def idf(s, d):
    return terms.idf(_docs(s, d), "text")


def bm25_top_terms(s, d):
    return terms.bm25_terms(_docs(s, d), "doc_id", "text", terms.idf(_docs(s, d), "text"))


def token_counts(s, d):
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return _docs(s, d).where("text IS NOT NULL").select(
        "doc_id", n(T.vocabulary_tokens("text")).alias("n_vocabulary"), n(T.corpus_tokens("text")).alias("n_corpus"), n(T.retrieval_tokens("text")).alias("n_retrieval"), n(T.question_keywords("text")).alias("n_keywords")
    )


def normalized_text(s, d):
    t = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", T.normalize("chunk_text").alias("t"))
    return t.select("chunk_row_id", F.length("t").alias("n_chars"), F.md5("t").alias("hash")).distinct()


def page_number_lines(s, d):
    lines = F.split("chunk_text", "\n")
    return _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, T.is_page_number)).alias("n_page_numbers")).distinct()


def case_numbers(s, d):
    return _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", F.array_join(T.case_numbers("chunk_text"), "|").alias("numbers")).where("numbers <> ''").distinct()


def document_hash(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", T.document_hash("text").alias("document_hash"))


def sanitized_text(s, d):
    t = _docs(s, d).where("text IS NOT NULL").select("doc_id", "text", T.sanitize("text").alias("t"))
    return t.select("doc_id", F.regexp_count("text", F.lit(T.REDACTION)).alias("n_redacted"), F.length("t").alias("n_chars"), F.md5("t").alias("hash"))


def transcript_lines(s, d):
    t = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", F.md5(T.remove_line_numbers("chunk_text")).alias("without_numbers"), F.md5(T.convert_qa("chunk_text")).alias("converted"))
    return t.distinct()


def header_footer(s, d):
    h = preprocess.header_footer(_work(s, d).where("chunk_text IS NOT NULL"), "chunk_row_id", "chunk_text")
    return h.select("chunk_row_id", "n_removed", F.md5("chunk_text").alias("hash")).distinct()


def title_scores(s, d):
    return _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", T.title_score("chunk_text").alias("score")).distinct()


def title_pages_removed(s, d):
    t = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.size(T.pages("text")).alias("n_pages"), F.length(T.remove_title_pages("text")).alias("n_chars"))
    return t


def preprocessed_text(s, d):
    t = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", "chunk_text").transform(preprocess.default_pipeline("chunk_row_id", "chunk_text"))
    return t.select("chunk_row_id", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("hash")).distinct()


def document_types(s, d):
    return _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", T.document_type("chunk_text", "source_document").alias("document_type"), T.section_label("chunk_text").alias("section")).distinct()


def document_status(s, d):
    once = table(s, d, "document_result").drop("loaded_at").distinct()
    state = F.when(F.col("status") == "error", "error").when(F.col("confidence") < C.OCR_CONFIDENCE, "warning").otherwise("success")
    return once.withColumn("state", state).groupBy("state", "method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"))


def run_metrics(s, d):
    once = table(s, d, "document_result").drop("loaded_at").distinct()
    return once.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("document_count"), F.sum(F.coalesce("page_count", F.lit(0))).alias("total_pages"), F.sum(F.coalesce("file_size", F.lit(0))).alias("total_size_bytes"),
        F.round(F.avg(F.coalesce("page_count", F.lit(0))), 1).alias("avg_pages"), F.round(F.avg(F.coalesce("file_size", F.lit(0))), 0).alias("avg_size_bytes"),
    )


def corpus_status(s, d):
    return corpus.status(_docs(s, d), "source")


def corpus_fingerprint(s, d):
    return corpus.fingerprint(_docs(s, d), "source", "doc_id", "filed_at")


def pending_documents(s, d):
    files = table(s, d, "document_result").select("filename", "document_type").distinct()
    done = _work(s, d).where("source_document IS NOT NULL AND trim(progressive_summary) <> ''")
    return corpus.pending(files, done.select(F.col("source_document").alias("filename")), "filename")


def rake_phrases(s, d):
    return rake.rake(_docs(s, d), "doc_id", "text")


def vocabulary(s, d):
    """Each document's vocabulary.  The frequency list is the corpus itself, without
    words of fewer than three texts; terms that were rated as medical are the medical list."""
    weights = materialize(terms.idf(_docs(s, d), "text"), "idf")
    ranks = materialize(vocab.frequency_ranks(weights.where("df >= 3").select(F.col("term").alias("word"), F.col("df").alias("count"))), "ranks")
    medical = table(s, d, "vocab_feedback").where("lower(term_type) = 'medical' AND feedback > 0").select(F.col("term").alias("word")).distinct()
    merged = vocab.merge(vocab.candidates(_docs(s, d), "doc_id", "text", weights, ranks, medical), "doc_id")
    return vocab.vocabulary(merged, "doc_id", ranks, medical=medical)


def unusual_words(s, d):
    ranks = vocab.frequency_ranks(terms.document_frequency(_docs(s, d), "text").where("df >= 3").select(F.col("term").alias("word"), F.col("df").alias("count")))
    return vocab.unusual(_docs(s, d), "doc_id", "text", ranks).select("doc_id", "term", "type", "frequency")


def term_ranks(s, d):
    return vocab.frequency_ranks(terms.document_frequency(_docs(s, d), "text").select(F.col("term").alias("word"), F.col("df").alias("count")))


def person_roles(s, d):
    docs = _docs(s, d)
    persons = vocab.entities(docs, "doc_id", "text").where("type = 'Person'").groupBy("doc_id", "term").agg(F.max("doctor").alias("doctor"))
    return vocab.person_roles(persons, docs, "doc_id", "text")


def latest_feedback(s, d):
    f = feedback.redelivered_once(table(s, d, "vocab_feedback"))
    return feedback.latest(f).select("term_key", "feedback_ts", "feedback", "document_id")


def feedback_counts(s, d):
    return feedback.counts(feedback.redelivered_once(table(s, d, "vocab_feedback")))


def feedback_features(s, d):
    f = feedback.features(feedback.redelivered_once(table(s, d, "vocab_feedback")))
    cols = feedback.FEATURES
    return f.groupBy("feedback").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in cols])


def term_preferences(s, d):
    log = feedback.redelivered_once(table(s, d, "vocab_feedback"))
    model = feedback.train(log)
    scored = feedback.predict(model, feedback.latest(log))
    return scored.select("term_key", F.round("preference", 6).alias("preference"), feedback.boost(F.coalesce("quality_score", F.lit(0.0)), F.col("preference")).alias("boosted"))


def _chunks(s, d, text="chunk_text"):
    return _work(s, d).where(F.col(text).isNotNull()).groupBy("chunk_row_id").agg(F.first(text).alias("t"))


def bm25plus_topk(s, d):
    return retrieval.bm25_plus(_chunks(s, d), "chunk_row_id", "t", table(s, d, "question_def"), "question_id", "question_text", 5)


def vector_topk(s, d):
    e = table(s, d, "embeddings")
    return retrieval.vector_top_k(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 5)


def hybrid_merge(s, d):
    """Documents by the words and by the vectors of every fiftieth one: its first
    sentence asks the lexical side, its vector the other."""
    e = table(s, d, "embeddings")
    docs = _docs(s, d).where("text IS NOT NULL").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.get(T.sentences("text"), F.lit(0)).alias("q")).where("q IS NOT NULL")
    one = lambda hits, name, weight: hits.select("query", "doc_id", F.lit(name).alias("algorithm"), F.lit(weight).alias("weight"), "relevance")
    words = retrieval.bm25_plus(docs, "doc_id", "text", asked, "query", "q", 10)
    vectors = retrieval.vector_top_k(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "doc_id"), 10)
    return retrieval.merge_hits(one(words, "BM25+", 1.0).unionByName(one(vectors, "vectors", 0.5)), "query", "doc_id", 5)


def _qa(s, d):
    return table(s, d, "question_answer")


def qa_confidence(s, d):
    usable = qa.usable_sources(F.col("sources"))
    score = F.transform("sources", lambda x: x["score"])
    return _qa(s, d).select("qa_id", qa.confidence(score).alias("confidence"), F.greatest(F.size(usable), F.lit(0)).alias("n_usable"), qa.source_summary(F.col("sources")).alias("summary")).distinct()


def extracted_answers(s, d):
    return qa.extract_answers(_qa(s, d).where("answer_text IS NOT NULL"), "qa_id", "question_text", "answer_text").distinct()


def classified_answers(s, d):
    q = table(s, d, "question_def").where(F.size("options") > 0).select("question_id", "options")
    return _qa(s, d).join(q, "question_id").select("qa_id", qa.classify(F.col("answer_text"), F.col("options")).alias("option")).distinct()


def answers_by_category(s, d):
    once = _qa(s, d).select("qa_id", "category", "answer_text").distinct()
    return once.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(T.strip("answer_text") != "", 1)).alias("answered"))


def question_steps(s, d):
    return qa.steps_to_end(table(s, d, "question_def"))


def briefing_parties(s, d):
    e = _once(s, d)
    side = lambda x: briefing.parties(e, x).select("case_id", F.lit(x).alias("side"), "name")
    return side("plaintiffs").unionByName(side("defendants"))


def briefing_dates(s, d):
    return briefing.first_seen(_once(s, d), "dates_mentioned").select("case_id", "value")


def briefing_vocabulary(s, d):
    return briefing.first_seen(_once(s, d), "vocabulary").select("case_id", "norm", "value")


def case_types(s, d):
    return briefing.case_type_vote(_once(s, d))


def briefing_stats(s, d):
    return briefing.stats(_once(s, d))


def people_by_category(s, d):
    return briefing.people_by_category(_once(s, d))


def briefing_openings(s, d):
    return briefing.openings(_once(s, d))


def allegations_deduplicated(s, d):
    return briefing.dedup_text(_once(s, d), "allegations")


def section_runs(s, d):
    return summarize.section_runs(_work(s, d).select("source_document", "chunk_num", "section_detected").distinct())


def section_boundaries(s, d):
    return summarize.section_boundaries(_work(s, d).select("source_document", "chunk_num", "section_detected").distinct())


def adaptive_boundaries(s, d):
    total = _work(s, d).groupBy("source_document").agg(F.max("chunk_num").alias("n_chunks"))
    return total.select("source_document", "n_chunks", F.array_join(summarize.adaptive_boundaries(F.col("n_chunks")), ",").alias("boundaries"))


def summary_modes(s, d):
    total = _work(s, d).groupBy("source_document").agg(F.max("chunk_num").alias("n_chunks"))
    modes = [total.select("source_document", F.lit(m).alias("mode"), F.array_join(summarize.boundaries(F.col("n_chunks"), m), ",").alias("boundaries")) for m in ("deep", "fixed", "adaptive")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def feedback_log(s, d):
    """The log written in two goes to a shared folder and read again."""
    log = feedback.redelivered_once(table(s, d, "vocab_feedback"))
    path = f"{shared_dir(s)}/feedback-{uuid.uuid4().hex}"
    sinks.append_feedback(log.where("feedback > 0"), path)
    sinks.append_feedback(log.where("NOT feedback > 0 OR feedback IS NULL"), path)
    return sinks.read_feedback(s, path).groupBy("feedback").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents"), F.max("feedback_ts").alias("newest"))


def combined_documents(s, d):
    c = corpus.combined_texts(_docs(s, d), "case_id", "doc_id", "text", "doc_id")
    return c.select("case_id", "position", F.length("part").alias("n_chars"), F.md5("part").alias("hash"))


def corpus_preprocessed(s, d):
    t = _docs(s, d).where("text IS NOT NULL").select("doc_id", T.sanitize(fix_garbled("text")).alias("text")).transform(preprocess.default_pipeline("doc_id", "text"))
    return t.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


def sanitized_whole(s, d):
    """Every stage: garbled sequences, plain letters, redactions, controls, white space."""
    t = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", "chunk_text", F.xxhash64("chunk_text").alias("h")).dropDuplicates(["chunk_row_id", "h"])
    t = t.select("chunk_row_id", "chunk_text", fix_garbled("chunk_text").alias("fixed")).withColumn("n", T.sanitize_counts("fixed"))
    return t.select("chunk_row_id", (F.col("fixed") != F.col("chunk_text")).alias("garbled"), "n.redacted", "n.control", "n.private", F.md5(T.sanitize(plain_ascii("fixed"))).alias("hash"))


def chunk_contexts(s, d):
    cols = ["source_document", "chunk_num", "chunk_summary", "progressive_summary"]
    c = summarize.contexts(_work(s, d).select(*cols).distinct())
    return c.select("source_document", "chunk_num", F.md5("local_context").alias("local_context"), F.md5("global_context").alias("global_context"))


def reduce_batches(s, d):
    r = table(s, d, "summarization_result").select("result_id", "case_id", "chunk_summary").where("chunk_summary IS NOT NULL").distinct()
    return summarize.reduce_batches(r, "case_id", "result_id", "chunk_summary")


def summary_metadata(s, d):
    e = _once(s, d).withColumn("facts", F.array_join(F.coalesce("key_facts", F.array().cast("array<string>")), " "))
    return summarize.metadata(e, "case_id", "vocabulary", "facts")


def section_chunks(s, d):
    c = chunk.section_chunks(_docs(s, d), "doc_id", "text")
    return c.select("doc_id", "chunk_num", "word_count", "section_name", F.md5("text").alias("hash"))


def brief_chunks(s, d):
    c = chunk.brief_chunks(_docs(s, d), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "char_count", "section_hint", F.md5("text").alias("hash"))


def split_chunks(s, d):
    c = chunk.split_texts(_docs(s, d), "doc_id", "text")
    return c.select("doc_id", "chunk_num", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


def chunks_by_document(s, d):
    once = _work(s, d).where("source_document IS NOT NULL").select("source_document", "chunk_row_id", "chunk_num").distinct()
    return ordinal(once, ["source_document"], ["chunk_num", "chunk_row_id"], F.floor(F.col("chunk_num") / 65536), "position")


def event_windows(s, d):
    schema = table(s, d, "events").schema
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    return stream.run_folder_whole(s, f"{d}/events.parquet*", schema, lambda e: stream.windowed(e, "ts", "event_type", "value"), f"{base}/out", f"{base}/state")


def event_sessions(s, d):
    return stream.sessions(table(s, d, "events"), "ts", "user_id")


def dictionary_confidence(s, d):
    words = terms.document_frequency(_docs(s, d), "text").where("df >= 3").select(F.col("term").alias("word"))
    return terms.dictionary_confidence(_chunks(s, d), "chunk_row_id", "t", words)


def transliterated_text(s, d):
    t = _docs(s, d).where("text IS NOT NULL").select("doc_id", "text", plain_ascii(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("hash"), (F.col("t") != F.col("text")).alias("changed"))


def place_relevance(s, d):
    docs = _docs(s, d)
    places = vocab.entities(docs, "doc_id", "text").where("type = 'Place'").where(vocab.keeps_entity(F.col("term"))).select("doc_id", "term").distinct()
    return vocab.place_relevance(places, docs, "doc_id", "text")


def entity_filter(s, d):
    e = _once(s, d).select("chunk_id", F.explode("names_mentioned").alias("x")).select("chunk_id", F.col("x.name").alias("term")).where("term IS NOT NULL")
    return e.groupBy(vocab.keeps_entity(F.col("term")).alias("kept")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("n_terms"))


def terms_without_disliked(s, d):
    log = feedback.redelivered_once(table(s, d, "vocab_feedback"))
    disliked = feedback.latest(log).where("feedback = -1").select(F.col("term_key").alias("term"))
    return vocab.without(log.select("term").distinct(), disliked)


def briefing_narratives(s, d):
    return briefing.narratives(_once(s, d))


def names_section(s, d):
    return briefing.names_section(_once(s, d)).select("case_id", "section", "position", "line")


def parsed_responses(s, d):
    p = briefing.parsed_responses(table(s, d, "chunk_extraction"))
    return p.select("chunk_id", "state", "n_chars", F.size(F.coalesce("record.names_mentioned", F.array())).alias("n_names"), F.coalesce(F.array_join("record.allegations", "|"), F.lit("")).alias("allegations"))


def recent_summaries(s, d):
    r = summarize.recent_summaries(_work(s, d).select("source_document", "chunk_num", "chunk_summary").distinct())
    return r.select("source_document", "chunk_num", F.md5("recent").alias("recent"))


def success_rates(s, d):
    return summarize.success_rates(table(s, d, "document_result").drop("loaded_at").distinct(), "case_id")


def prompt_budgets(s, d):
    w = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", summarize.prompt_tokens("chunk_text").alias("prompt_tokens"), summarize.word_budget(T.word_count("chunk_text")).alias("b"))
    return w.select("chunk_row_id", "prompt_tokens", "b.least", "b.most", "b.tokens").distinct()


def debug_rows(s, d):
    return sinks.debug_rows(_work(s, d), ["chunk_row_id"]).distinct()


def processing_times(s, d):
    return _work(s, d).select("chunk_row_id", T.duration(F.coalesce("processing_time_sec", F.lit(0.0))).alias("took")).distinct()


def answer_contexts(s, d):
    answers = _qa(s, d).select("qa_id", "sources").distinct()
    chunks = _work(s, d).select(F.col("source_document").alias("filename"), "chunk_num", F.col("chunk_text").alias("text"), F.xxhash64("chunk_text").alias("h")).dropDuplicates(["filename", "chunk_num", "h"]).drop("h")
    return qa.contexts(answers, chunks, "qa_id").select("qa_id", "n_chunks", F.md5("context").alias("context"))


def chunk_summaries(s, d):
    once = _work(s, d).select("chunk_row_id", "chunk_text", F.xxhash64("chunk_text").alias("h")).dropDuplicates(["chunk_row_id", "h"])
    return summarize.lead_summaries(once, "chunk_row_id", "chunk_text")


def document_summaries(s, d):
    return summarize.spread_summaries(_docs(s, d), "doc_id", "text", 200)


def reading_methods(s, d):
    share = dictionary_confidence(s, d).select("chunk_row_id", "confidence")
    sized = _work(s, d).where("chunk_text IS NOT NULL").select("chunk_row_id", F.length("chunk_text").alias("n")).distinct()
    return share.join(sized, "chunk_row_id").select("chunk_row_id", corpus.reading_method(F.col("confidence"), F.col("n")).alias("method"))


def corpus_vocabulary(s, d):
    return corpus.vocabulary_size(_docs(s, d), "source")


def corpus_combined(s, d):
    files = table(s, d, "document_result").select("filename", "case_id").distinct()
    worked = _work(s, d).where("source_document IS NOT NULL").select(F.col("source_document").alias("filename"), "case_id").distinct()
    return corpus.combine(files, worked, "filename", F.lit("work"))


def chunk_ids(s, d):
    once = _work(s, d).select("chunk_row_id", "source_document", "chunk_num").distinct()
    return chunk.chunk_ids(once, "source_document", "chunk_num").select("chunk_row_id", "chunk_id")


def people_merged(s, d):
    return briefing.merged_people(_once(s, d))


def briefing_sheets(s, d):
    return briefing.sheets(_once(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        term_df, idf, bm25_top_terms, token_counts, normalized_text, page_number_lines, case_numbers, document_hash, sanitized_text, transcript_lines, header_footer, title_scores, title_pages_removed,
        preprocessed_text, document_types, document_status, run_metrics, corpus_status, corpus_fingerprint, pending_documents, rake_phrases, vocabulary, term_ranks, person_roles, latest_feedback,
        feedback_counts, feedback_features, term_preferences, bm25plus_topk, vector_topk, hybrid_merge, qa_confidence, extracted_answers, classified_answers, answers_by_category, question_steps,
        briefing_parties, briefing_dates, briefing_vocabulary, case_types, briefing_stats, people_by_category, briefing_openings, allegations_deduplicated, section_runs, section_boundaries,
        adaptive_boundaries, chunk_contexts, reduce_batches, summary_metadata, section_chunks, brief_chunks, split_chunks, chunks_by_document, event_windows, event_sessions,
        dictionary_confidence, transliterated_text, place_relevance, entity_filter, terms_without_disliked, briefing_narratives, names_section, parsed_responses, recent_summaries, success_rates, prompt_budgets, debug_rows, processing_times,
        unusual_words, summary_modes, feedback_log, combined_documents, corpus_preprocessed, sanitized_whole, answer_contexts, chunk_summaries, document_summaries, reading_methods, corpus_vocabulary, corpus_combined, people_merged, briefing_sheets, chunk_ids,
    )
}
