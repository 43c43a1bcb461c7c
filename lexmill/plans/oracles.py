"""The same results in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ..functions import constants as C
from ..functions import unicode as U

WORK = "summarization_20251116_215704"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def ascii_words(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def tokens(x: str, stop: list[str], least: int) -> str:
    return f"list_filter(regexp_extract_all({ascii_words(x)}, {_q(C.WORD_TOKEN)}), lambda w: len(w) >= {least} AND NOT list_contains({_list(stop)}, w))"


VOCAB = tokens("text", C.STOP_VOCAB, 3)
CORPUS = tokens("text", C.STOP_CORPUS, 2)


def retrieval(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_\-]+'), lambda w: w <> '')"


def keywords(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all({ascii_words(x)}, '\b[a-zA-Z]+\b'), lambda w: len(w) >= 3 AND NOT list_contains({_list(C.STOP_QUESTION)}, w))))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalized(x: str) -> str:
    dehyphenated = rf"regexp_replace({x}, '([\p{{L}}\p{{M}}\p{{N}}_]+)-\s*\n\s*([\p{{L}}\p{{M}}\p{{N}}_]+)', '\1\2', 'g')"
    header = rf"(regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '\p{{Ll}}') AND len(l) < 50 AND regexp_matches(l, '{'|'.join(C.LEGAL_HEADER_WORDS)}'))"
    keeps = rf"(len(l) > {C.MIN_LINE_LENGTH} OR {header}) AND (regexp_matches(l, '\p{{Ll}}') OR {header}) AND len(regexp_replace(l, '[^\p{{L}}]', '', 'g')) > len(regexp_replace(l, '[\p{{L}}\s]', '', 'g'))"
    lines = f"list_filter(string_split({dehyphenated}, chr(10)), lambda l: NOT regexp_matches({strip('l')}, {_q(C.PAGE_NUMBER_LINE)}) AND {keeps})"
    return strip(rf"regexp_replace(array_to_string({lines}, chr(10)), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")


def sanitized(x: str) -> str:
    t = rf"regexp_replace({x}, '[█▓▒]{{2,}}', ' [REDACTED] ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '[\p{{Cf}}\p{{Co}}]', '', 'g')"
    t = rf"regexp_replace({t}, '[\t\x{{A0}}\x{{2000}}\x{{2001}}]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


_N = r"([1-9]|1\d|2[0-5])"


def without_numbers(x: str) -> str:
    t = rf"regexp_replace({x}, '(?m)^(\s*){_N}\s{{2,}}', '\1', 'g')"
    t = rf"regexp_replace({t}, '(?m)\s{{2,}}{_N}$', '', 'g')"
    return rf"regexp_replace({t}, '(?m)^\|{_N}\s*', '', 'g')"


def converted(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?m)^(\s*)Q([.:])?\s+', '\1Question: ', 'g'), '(?m)^(\s*)A([.:])?\s+', '\1Answer: ', 'g')"


def title_score(x: str) -> str:
    points = " + ".join(f"CASE WHEN regexp_matches({x}, {_q(p)}) THEN {n} ELSE 0 END" for p, n in C.TITLE_PAGE_PATTERNS)
    return f"({points})"


def pages(x: str) -> str:
    gaps = rf"string_split_regex({x}, '\n{{4,}}|\n\s*-{{10,}}\s*\n')"
    full = lambda a: f"list_filter({a}, lambda p: {strip('p')} <> '')"
    return f"CASE WHEN contains({x}, chr(12)) THEN {full(f'string_split({x}, chr(12))')} WHEN len({gaps}) > 1 THEN {full(gaps)} WHEN len({x}) > 3000 THEN [substr({x}, 1, 2000), substr({x}, 2001)] ELSE [{x}] END"


def _many(x: str) -> str:
    for a, b in U.MULTIPLE.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def untitled(table: str, key: str, text: str) -> str:
    """key, n_pages, t: the text without its title pages."""
    score = f"{title_score('p')} + CASE WHEN len({strip('p')}) < 500 AND {title_score('p')} > 0 THEN 1 ELSE 0 END"
    return f"""SELECT {key}, len(ps) AS n_pages, CASE WHEN len(ps) > 1 THEN array_to_string(list_transform(list_filter(list_zip(ps, range(1, len(ps) + 1), ss), lambda z: z[2] > {C.TITLE_PAGES_LOOKED_AT} OR z[3] < {C.TITLE_PAGE_SCORE}), lambda z: z[1]), chr(10) || chr(10)) ELSE x END AS t
 FROM (SELECT {key}, x, ps, list_transform(ps, lambda p: {score}) AS ss FROM (SELECT {key}, {text} AS x, {pages(text)} AS ps FROM {table} WHERE {text} IS NOT NULL))"""


def first_label(x: str, rules: list[tuple[str, str]], wrap: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(wrap.format(p))}) THEN '{label}'" for p, label in rules) + " END"


def normal_name(x: str) -> str:
    n = f"regexp_replace(lower({x}), {_q(C.NAME_TITLES)}, '', 'g')"
    return rf"""trim(regexp_replace(regexp_replace({n}, '[,.''"()]', '', 'g'), '\s+', ' ', 'g'))"""


def case_type(x: str) -> str:
    low = f"lower(trim({x}))"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({low}, '{v}')" for v in variants) + f" THEN '{family}'" for family, variants in C.CASE_TYPES) + f" ELSE {low} END"


IDF = f"""
tok AS (SELECT doc_id, {CORPUS} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n_docs FROM tok WHERE len(t) > 0),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term),
idf AS (SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM df, n)
"""

ONCE = "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS rn FROM chunk_extraction WHERE extraction_success) WHERE rn = 1)"


def bm25_plus(field: str, name: str, k: int, rows: str = f"SELECT * FROM {WORK}", key: str = "chunk_row_id", asked: str = "SELECT * FROM question_def", qkey: str = "question_id", qtext: str = "question_text") -> str:
    """CTEs that end in ``name``: qkey, key, score, relevance, rank."""
    p = name
    return f"""
{p}_c AS (SELECT {key}, any_value({retrieval(field)}) AS t FROM ({rows}) WHERE {field} IS NOT NULL GROUP BY {key}),
{p}_s AS (SELECT count(*) AS n_chunks, avg(len(t)) AS avg_len FROM {p}_c),
{p}_a AS (SELECT {qkey}, term, count(*) AS times FROM (SELECT {qkey}, unnest({retrieval(qtext)}) AS term FROM ({asked})) GROUP BY ALL),
{p}_p AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM {p}_c) WHERE term IN (SELECT term FROM {p}_a) GROUP BY ALL),
{p}_i AS (SELECT term, avg_len, ln((n_chunks + 1) / df) AS idf FROM (SELECT term, count(*) AS df FROM {p}_p GROUP BY term), {p}_s),
{p}_w AS (SELECT * FROM {p}_a JOIN {p}_i USING (term)),
{p}_b AS (SELECT {qkey}, sum(times * idf * {C.PLUS_DELTA}) AS base FROM {p}_w GROUP BY {qkey}),
{p}_m AS (SELECT {qkey}, {key}, sum(times * idf * tf * ({C.PLUS_K1} + 1) / ({C.PLUS_K1} * (1 - {C.PLUS_B} + {C.PLUS_B} * dl / avg_len) + tf)) AS gain FROM {p}_p JOIN {p}_w USING (term) GROUP BY ALL),
{p}_x AS (SELECT {qkey}, {key}, round(base + coalesce(gain, 0), 9) AS score FROM {p}_b CROSS JOIN {p}_c LEFT JOIN {p}_m USING ({qkey}, {key})),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY {qkey} ORDER BY score DESC, {key}) AS rank FROM {p}_x),
{p} AS (SELECT {qkey}, {key}, round(score, 6) AS score, round(score / (score + max(score) OVER (PARTITION BY {qkey})), 6) AS relevance, rank FROM {p}_r WHERE rank <= {k})
"""


def sentences(x: str) -> str:
    return rf"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({x}, '\[[^\]]+\]:', '', 'g'),
 '(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Jr\.|Sr\.)', '\1' || chr(1), 'g'), '(Inc\.|Corp\.|Ltd\.|Co\.|\d+\.)', '\1' || chr(1), 'g'), '[.!?]+\s+'),
 lambda s: {strip("replace(s, chr(1), '.')")}), lambda s: s <> '')"""


_SENTENCES = sentences("answer_text")


def clean_sentence(s: str) -> str:
    t = strip(rf"regexp_replace({s}, '\s+', ' ', 'g')")
    return f"CASE WHEN regexp_matches({t}, '[.!?]$') THEN {t} ELSE {t} || '.' END"


def lead(table: str, key: str, text: str, words: int) -> str:
    return f"""WITH a AS (SELECT DISTINCT {key}, {sentences(text)} AS ss FROM {table} WHERE len({strip(text)}) > 50), b AS (SELECT {key}, unnest(list_transform(ss, lambda s: {clean_sentence('s')})) AS x, generate_subscripts(ss, 1) AS i FROM a),
 c AS (SELECT *, sum(len(string_split(x, ' '))) OVER (PARTITION BY {key} ORDER BY i) AS n FROM b)
 SELECT {key}, coalesce(string_agg(x, ' ' ORDER BY i), '') AS summary FROM c WHERE n <= {words} OR i = 1 GROUP BY {key}"""


_HEADER = "(?i)" + "|".join(f"(?:{p})" for p in C.HEADER_FOOTER_PATTERNS)
_NORM_LINE = rf"lower({strip(rf'''regexp_replace(regexp_replace({strip('line')}, '\s*-?\s*\d+\s*-?\s*$', ''), '\s+', ' ', 'g')''')})"
_LATEST_ORDER = "feedback_ts DESC, algorithms DESC NULLS LAST, document_id DESC NULLS LAST, feedback DESC NULLS LAST, freq_rank DESC NULLS LAST, in_case_freq DESC NULLS LAST, quality_score DESC NULLS LAST, term DESC, term_type DESC NULLS LAST"
FEEDBACK = "log AS (SELECT DISTINCT feedback_ts, document_id, term, feedback, term_type, algorithms, quality_score, in_case_freq, freq_rank FROM vocab_feedback)"
LATEST = f"{FEEDBACK}, latest AS (SELECT * FROM (SELECT *, lower(trim(term)) AS term_key, row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY {_LATEST_ORDER}) AS rn FROM log WHERE term IS NOT NULL) WHERE rn = 1)"
FIRST_SEEN = "SELECT case_id, norm, arg_min(value, (chunk_id, pos)) AS value FROM (SELECT case_id, chunk_id, pos, trim(raw) AS value, lower(trim(raw)) AS norm FROM (SELECT case_id, chunk_id, unnest({f}) AS raw, generate_subscripts({f}, 1) AS pos FROM ex) WHERE trim(raw) <> '') GROUP BY case_id, norm"


def parties(side: str) -> str:
    return f"""SELECT case_id, norm, first(name ORDER BY len(name) DESC, chunk_id, pos) AS name FROM (
 SELECT case_id, chunk_id, pos, trim(raw) AS name, {normal_name('raw')} AS norm FROM (SELECT case_id, chunk_id, unnest(parties.{side}) AS raw, generate_subscripts(parties.{side}, 1) AS pos FROM ex)) WHERE norm <> '' GROUP BY case_id, norm"""


CASE_VOTE = f"""SELECT c.case_id, coalesce(t, 'unknown') AS case_type, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT case_id FROM ex) c LEFT JOIN (
 SELECT case_id, t, votes FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, fc, fp) AS rn FROM (
  SELECT case_id, t, count(*) AS votes, min(chunk_id) AS fc, arg_min(pos, (chunk_id, pos)) AS fp FROM (SELECT case_id, chunk_id, pos, {case_type('hint')} AS t FROM (
   SELECT case_id, chunk_id, unnest(case_type_hints) AS hint, generate_subscripts(case_type_hints, 1) AS pos FROM ex) WHERE trim(hint) <> '') GROUP BY case_id, t)) WHERE rn = 1) v ON v.case_id = c.case_id"""


def _sentence_list(x: str) -> str:
    return f"CASE len({x}) WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"


_CHUNKS = f"(SELECT DISTINCT source_document, chunk_num, section_detected FROM {WORK})"
_RUNS = f"""SELECT source_document, run, min(section) AS section, min(chunk_num) AS first_chunk, max(chunk_num) AS last_chunk, count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY source_document ORDER BY chunk_num ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (
  SELECT source_document, chunk_num, coalesce(section_detected, '') AS section, coalesce((coalesce(section_detected, '') <> lag(coalesce(section_detected, '')) OVER (PARTITION BY source_document ORDER BY chunk_num))::INT, 1) AS fresh FROM {_CHUNKS})) GROUP BY source_document, run"""

_F = {
    "quality_score": "coalesce(quality_score, 0)", "in_case_freq": "CASE WHEN coalesce(in_case_freq, 1) = 0 THEN 1 ELSE coalesce(in_case_freq, 1) END",
    "freq_rank_normalized": "CASE WHEN coalesce(freq_rank, 0) > 0 THEN least(freq_rank / 300000, 1.0) ELSE 0 END", "has_ner": "contains(lower(coalesce(algorithms, '')), 'ner')::INT", "has_rake": "contains(lower(coalesce(algorithms, '')), 'rake')::INT",
    "num_algorithms": "contains(lower(coalesce(algorithms, '')), 'ner')::INT + contains(lower(coalesce(algorithms, '')), 'rake')::INT",
    **{f"is_{t}": f"(lower(coalesce(term_type, 'Unknown')) = '{t}')::INT" for t in ("person", "medical", "technical", "place", "unknown")},
}

_OPTION_WORDS = "CASE lower(o.value) " + " ".join(f"WHEN '{v}' THEN {_list(w)}" for v, w in C.ANSWER_KEYWORDS.items()) + " ELSE [] END"

_SIDES = f"v AS ({CASE_VOTE}), p AS (SELECT case_id, name, row_number() OVER (PARTITION BY case_id ORDER BY name, norm) - 1 AS i FROM ({parties('plaintiffs')})), d AS (SELECT case_id, name, row_number() OVER (PARTITION BY case_id ORDER BY name, norm) - 1 AS i FROM ({parties('defendants')}))"
_OPENING = """(WITH n AS (SELECT case_id, 'This is a ' || case_type || ' case' AS head, (SELECT count(*) FROM p WHERE p.case_id = v.case_id) AS np, (SELECT count(*) FROM d WHERE d.case_id = v.case_id) AS nd FROM v)
 SELECT case_id, 0::BIGINT AS position, head || CASE WHEN np = 0 THEN '.' WHEN nd = 0 THEN ' involving ' ELSE ' brought by ' END AS part FROM n
 UNION ALL SELECT case_id, 1 + i, CASE WHEN i = 0 THEN '' WHEN i < np - 1 THEN ', ' WHEN np = 2 THEN ' and ' ELSE ', and ' END || name || CASE WHEN i = np - 1 AND nd = 0 THEN '.' ELSE '' END FROM p JOIN n USING (case_id)
 UNION ALL SELECT case_id, 1 + np + i, CASE WHEN i = 0 THEN ' against ' WHEN i < nd - 1 THEN ', ' WHEN nd = 2 THEN ' and ' ELSE ', and ' END || name || CASE WHEN i = nd - 1 THEN '.' ELSE '' END FROM d JOIN n USING (case_id) WHERE np > 0)"""


def _firsts(field: str, paragraph: int, n: int) -> str:
    return f"""SELECT case_id, {paragraph} AS paragraph, value, rn FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seen) AS rn FROM (
 SELECT case_id, norm, arg_min(value, (chunk_id, pos)) AS value, min((chunk_id, pos)) AS seen FROM (SELECT case_id, chunk_id, pos, trim(raw) AS value, lower(trim(raw)) AS norm FROM (SELECT case_id, chunk_id, unnest({field}) AS raw, generate_subscripts({field}, 1) AS pos FROM ex) WHERE trim(raw) <> '') GROUP BY case_id, norm)) WHERE rn <= {n}"""


ORACLE_SQL = {
    "term_df": f"WITH {IDF} SELECT term, df FROM df",
    "idf": f"WITH {IDF} SELECT term, df, idf FROM idf",
    "bm25_top_terms": f"""WITH {IDF}, v AS (SELECT doc_id, {VOCAB} AS t FROM documents WHERE text IS NOT NULL),
 e AS (SELECT doc_id, len(t) AS doc_tokens, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM v),
 tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS pos, any_value(doc_tokens) AS doc_tokens FROM e WHERE len(list_distinct(string_split(term, ''))) > 1 GROUP BY doc_id, term),
 s AS (SELECT doc_id, term, tf, pos, coalesce(idf, {C.OOV_IDF}) * tf * ({C.K1} + 1) / (tf + {C.K1} * (1 - {C.B} + {C.B} * doc_tokens / {C.AVERAGE_DOC_LENGTH})) AS raw FROM tf LEFT JOIN idf USING (term)),
 r AS (SELECT *, round(raw, 4) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 4) DESC, pos) AS rank FROM s WHERE raw >= {C.MIN_BM25_SCORE})
 SELECT doc_id, term, tf, score, round(least(score / 15, 1.0), 4) AS confidence, rank FROM r WHERE rank <= {C.MAX_BM25_TERMS}""",
    "token_counts": f"SELECT doc_id, len({VOCAB}) AS n_vocabulary, len({CORPUS}) AS n_corpus, len({retrieval('text')}) AS n_retrieval, len({keywords('text')}) AS n_keywords FROM documents WHERE text IS NOT NULL",
    "normalized_text": f"SELECT DISTINCT chunk_row_id, len(t) AS n_chars, md5(t) AS hash FROM (SELECT chunk_row_id, {normalized('chunk_text')} AS t FROM {WORK} WHERE chunk_text IS NOT NULL)",
    "page_number_lines": f"SELECT DISTINCT chunk_row_id, len(ls) AS n_lines, len(list_filter(ls, lambda l: regexp_matches({strip('l')}, {_q(C.PAGE_NUMBER_LINE)}))) AS n_page_numbers FROM (SELECT chunk_row_id, string_split(chunk_text, chr(10)) AS ls FROM {WORK} WHERE chunk_text IS NOT NULL)",
    "case_numbers": "SELECT DISTINCT chunk_row_id, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(chunk_text, {_q(p.replace('(?iu)', '(?i)'))})" for p in C.CASE_NUMBER_PATTERNS) + "))), '|') AS numbers FROM " + WORK + " WHERE chunk_text IS NOT NULL AND len(list_concat(" + ", ".join(f"regexp_extract_all(chunk_text, {_q(p.replace('(?iu)', '(?i)'))})" for p in C.CASE_NUMBER_PATTERNS) + ")) > 0",
    "document_hash": "SELECT doc_id, 'doc_' || substr(md5(substr(text, 1, 1000)), 1, 12) AS document_hash FROM documents WHERE text IS NOT NULL",
    "sanitized_text": f"SELECT doc_id, len(regexp_extract_all(text, '[█▓▒]')) AS n_redacted, len(t) AS n_chars, md5(t) AS hash FROM (SELECT doc_id, text, {sanitized('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "transcript_lines": f"SELECT DISTINCT chunk_row_id, md5({without_numbers('chunk_text')}) AS without_numbers, md5({converted('chunk_text')}) AS converted FROM {WORK} WHERE chunk_text IS NOT NULL",
    "header_footer": f"""WITH w AS (SELECT chunk_row_id, any_value(string_split(chunk_text, chr(10))) AS ls FROM {WORK} WHERE chunk_text IS NOT NULL GROUP BY chunk_row_id),
 l AS (SELECT chunk_row_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM w), m AS (SELECT *, {_NORM_LINE} AS norm FROM l),
 g AS (SELECT *, norm <> '' AND count(*) OVER p >= {C.MIN_HEADER_OCCURRENCES} AND bool_or(len({strip('line')}) <= {C.MAX_HEADER_LENGTH} AND {strip('line')} <> '' AND regexp_matches(line, {_q(_HEADER)})) OVER p AS gone FROM m WINDOW p AS (PARTITION BY chunk_row_id, norm))
 SELECT chunk_row_id, count(*) FILTER (gone)::INT AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS hash FROM g GROUP BY chunk_row_id""",
    "title_pages_removed": f"SELECT doc_id, n_pages, len(t) AS n_chars FROM ({untitled('documents', 'doc_id', 'text')})",
    "preprocessed_text": f"""WITH w AS (SELECT DISTINCT chunk_row_id, t FROM ({untitled(WORK, 'chunk_row_id', 'chunk_text')})), v AS (SELECT chunk_row_id, string_split(t, chr(10)) AS ls FROM w),
 l AS (SELECT chunk_row_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM v), m AS (SELECT *, {_NORM_LINE} AS norm FROM l),
 g AS (SELECT *, norm <> '' AND count(*) OVER p >= {C.MIN_HEADER_OCCURRENCES} AND bool_or(len({strip('line')}) <= {C.MAX_HEADER_LENGTH} AND {strip('line')} <> '' AND regexp_matches(line, {_q(_HEADER)})) OVER p AS gone FROM m WINDOW p AS (PARTITION BY chunk_row_id, norm)),
 h AS (SELECT chunk_row_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM g GROUP BY chunk_row_id), n AS (SELECT chunk_row_id, {without_numbers('t')} AS t FROM h), c AS (SELECT chunk_row_id, {converted('t')} AS t FROM n)
 SELECT chunk_row_id, len(t) AS n_chars, md5(t) AS hash FROM c""",
    "transliterated_text": f"""SELECT doc_id, len(t) AS n_chars, md5(t) AS hash, t <> text AS changed FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN regexp_replace(translate({_many('text')}, {_q(''.join(U.SINGLE))}, {_q(''.join(U.SINGLE.values()))}), '\\p{{M}}', '', 'g') ELSE text END AS t FROM documents WHERE text IS NOT NULL)""",
    "title_scores": f"SELECT DISTINCT chunk_row_id, s + CASE WHEN s > 0 AND len({strip('chunk_text')}) < 500 THEN 1 ELSE 0 END AS score FROM (SELECT chunk_row_id, chunk_text, {title_score('chunk_text')} AS s FROM {WORK} WHERE chunk_text IS NOT NULL)",
    "document_types": f"""SELECT DISTINCT chunk_row_id, CASE WHEN contains(f, 'complaint') THEN 'complaint' WHEN contains(f, 'answer') THEN 'answer' WHEN contains(f, 'transcript') OR contains(f, 'depo') THEN 'transcript' WHEN contains(f, 'bill') AND contains(f, 'particulars') THEN 'bill_of_particulars'
 ELSE coalesce({first_label('substr(chunk_text, 1, 5000)', C.DOC_TYPE_PATTERNS, '(?i)(?:{})')}, 'unknown') END AS document_type, {first_label('substr(chunk_text, 1, 200)', C.SECTION_PATTERNS, '(?im)^\\s*(?:{})')} AS section
 FROM (SELECT *, lower(source_document) AS f FROM {WORK} WHERE chunk_text IS NOT NULL)""",
    "document_status": f"SELECT CASE WHEN status = 'error' THEN 'error' WHEN confidence < {C.OCR_CONFIDENCE} THEN 'warning' ELSE 'success' END AS state, method, count(*) AS n, sum(coalesce(page_count, 0))::BIGINT AS pages FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM document_result) GROUP BY ALL",
    "run_metrics": "SELECT document_type, count(*) AS document_count, sum(coalesce(page_count, 0))::BIGINT AS total_pages, sum(coalesce(file_size, 0))::BIGINT AS total_size_bytes, round(avg(coalesce(page_count, 0)), 1) AS avg_pages, round(avg(coalesce(file_size, 0)), 0) AS avg_size_bytes FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM document_result) GROUP BY document_type",
    "corpus_status": f"SELECT source, count(*) FILTER (len(trim(text)) > 0) AS n_documents, sum(coalesce(len(text), 0))::BIGINT AS n_chars, count(*) FILTER (len(trim(text)) > 0) >= {C.MIN_CORPUS_DOCS} AS ready FROM documents GROUP BY source",
    "corpus_fingerprint": "SELECT source, concat_ws('-', sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT, sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT, count(*)) AS fingerprint FROM (SELECT source, md5(concat_ws(':', doc_id::VARCHAR, strftime(filed_at, '%Y-%m-%d %H:%M:%S.%f'))) AS h FROM documents) GROUP BY source",
    "pending_documents": f"SELECT DISTINCT filename, document_type FROM document_result WHERE filename NOT IN (SELECT source_document FROM {WORK} WHERE source_document IS NOT NULL AND trim(progressive_summary) <> '')",
    "rake_phrases": rf"""WITH a AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*\d{{1,2}}\s+', '', 'g'), '\b\d+\b', '', 'g'), '\s+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(regexp_replace(t, '[^\p{{L}}\p{{N}}''\- ]+', ' | ', 'g'), ' +'), lambda w: CASE WHEN list_contains({_list(C.STOP_VOCAB)}, w) THEN '|' ELSE w END), ' ') AS t FROM a),
 c AS (SELECT doc_id, list_filter(list_transform(string_split(t, '|'), lambda p: trim(p)), lambda p: p <> '' AND len(string_split(p, ' ')) <= {C.RAKE_MAX_WORDS}) AS ps FROM b),
 p AS (SELECT doc_id, unnest(ps) AS phrase FROM c),
 w AS (SELECT doc_id, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS n FROM p),
 s AS (SELECT doc_id, word, sum(n) / count(*) AS weight FROM w GROUP BY doc_id, word),
 x AS (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT doc_id, phrase FROM p)),
 y AS (SELECT doc_id, phrase, sum(weight) AS score FROM x JOIN s USING (doc_id, word) GROUP BY doc_id, phrase),
 z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase DESC) AS rank FROM y WHERE round(score, 9) >= {C.RAKE_MIN_SCORE} AND len(phrase) BETWEEN 2 AND 50 AND regexp_matches(phrase, '[a-zA-Z]'))
 SELECT doc_id, phrase, round(score, 6) AS score, rank FROM z WHERE rank <= {C.RAKE_MAX_PHRASES}""",
    "term_ranks": f"WITH {IDF} SELECT term AS word, row_number() OVER (ORDER BY df DESC, term) - 1 AS rank FROM df",
    "latest_feedback": f"WITH {LATEST} SELECT term_key, feedback_ts, feedback, document_id FROM latest",
    "feedback_counts": f"WITH {LATEST} SELECT count(*) FILTER (feedback = 1) AS liked, count(*) FILTER (feedback = -1) AS disliked, count(*) FILTER (feedback = 0) AS cleared, any_value(p) AS pending, count(*) FILTER (feedback <> 0) >= {C.ML_MIN_SAMPLES} AND any_value(p) >= {C.ML_RETRAIN_AFTER} AS retrain FROM latest, (SELECT count(*) AS p FROM log)",
    "feedback_features": f"WITH {FEEDBACK} SELECT feedback, count(*) AS n, " + ", ".join(f"round(sum({e})::DOUBLE, 4) AS {c}" for c, e in _F.items()) + " FROM log GROUP BY feedback",
    "bm25plus_topk": f"WITH {bm25_plus('chunk_text', 'h', 5)} SELECT * FROM h",
    "vector_topk": """WITH x AS (SELECT q.vec_id AS query, e.vec_id, greatest(0.0, least(1.0, 1 - list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(2))) AS rel FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
 r AS (SELECT query, vec_id, round(rel, 6) AS relevance, row_number() OVER (PARTITION BY query ORDER BY round(rel, 6) DESC, vec_id) AS rank FROM x) SELECT * FROM r WHERE rank <= 5""",
    "hybrid_merge": f"""WITH {bm25_plus('text', 'h', 10, "SELECT doc_id, text FROM documents", 'doc_id', f"SELECT doc_id AS query, ({sentences('text')})[1] AS q FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0", 'query', 'q')},
 x AS (SELECT q.vec_id AS query, e.vec_id AS doc_id, round(greatest(0.0, least(1.0, 1 - list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(2))), 6) AS relevance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
 g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, doc_id) AS rank FROM x) WHERE rank <= 10),
 u AS (SELECT query, doc_id, 'BM25+' AS algorithm, 1.0 AS weight, relevance FROM h UNION ALL SELECT query, doc_id, 'vectors', 0.5, relevance FROM g),
 m AS (SELECT query, doc_id, round(least(1.0, sum(relevance * weight) / sum(weight) + 0.1 * (count(*) - 1)), 6) AS score, string_agg(algorithm, ',' ORDER BY algorithm) AS sources FROM u GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 5""",
    "qa_confidence": f"""SELECT DISTINCT qa_id, CASE WHEN coalesce(len(sources), 0) > 0 THEN round(coalesce(list_sum(list_transform(sources, lambda x: x.score)), 0) / len(sources), 2) ELSE 0 END AS confidence, coalesce(len(list_filter(sources, lambda x: x.score >= {C.MIN_RETRIEVAL_SCORE})), 0) AS n_usable,
 coalesce((SELECT string_agg(fn || ': ' || coalesce(sec, 'N/A'), '; ' ORDER BY p) FROM (SELECT x.filename AS fn, min(i) AS p, arg_min(coalesce(x.section, 'N/A'), i) AS sec FROM (SELECT unnest(sources) AS x, generate_subscripts(sources, 1) AS i) WHERE x.filename IS NOT NULL GROUP BY x.filename)), '') AS summary FROM question_answer""",
    "extracted_answers": rf"""WITH a AS (SELECT DISTINCT qa_id, question_text, answer_text FROM question_answer WHERE answer_text IS NOT NULL), b AS (SELECT qa_id, {keywords('question_text')} AS ks, {_SENTENCES} AS ss FROM a),
 c AS (SELECT qa_id, ss, list_reverse_sort(list_filter(list_transform(ss, lambda s: {{'n': len(list_intersect(ks, list_distinct(regexp_extract_all({ascii_words('s')}, '\b[a-zA-Z]+\b')))), 's': s}}), lambda x: x.n > 0))[1:3] AS best FROM b)
 SELECT DISTINCT qa_id, CASE WHEN len(best) > 0 THEN array_to_string(list_transform(best, lambda x: {clean_sentence('x.s')}), ' ') ELSE coalesce(list_transform(list_filter(ss, lambda s: len(s) > 50), lambda s: {clean_sentence('s')})[1], 'No relevant information found in the documents.') END AS answer FROM c""",
    "classified_answers": f"""SELECT DISTINCT qa_id, CASE WHEN answer_text IS NOT NULL THEN coalesce(
 list_filter(options, lambda o: contains(lower(answer_text), lower(o.value)) OR contains(lower(answer_text), lower(coalesce(o.label, ''))))[1].value,
 list_filter(options, lambda o: len(list_filter({_OPTION_WORDS}, lambda w: contains(lower(answer_text), w))) > 0)[1].value,
 list_filter(options, lambda o: o.value = 'unclear')[1].value, options[1].value) END AS option FROM question_answer JOIN question_def d USING (question_id) WHERE len(options) > 0""",
    "answers_by_category": f"SELECT category, count(*) AS n, count(*) FILTER ({strip('answer_text')} <> '') AS answered FROM (SELECT DISTINCT qa_id, category, answer_text FROM question_answer) GROUP BY category",
    "question_steps": """WITH RECURSIVE e AS (SELECT DISTINCT question_id, nxt FROM (SELECT question_id, unnest(list_transform(options, lambda o: o.next_id)) AS nxt FROM question_def UNION ALL SELECT question_id, next_id FROM question_def WHERE coalesce(len(options), 0) = 0) WHERE nxt IS NOT NULL),
 p(start, here, steps) AS (SELECT question_id, question_id, 0 FROM question_def UNION ALL SELECT start, e.nxt, steps + 1 FROM p JOIN e ON e.question_id = p.here JOIN question_def q ON q.question_id = e.nxt WHERE steps < 64) SELECT start AS question_id, max(steps) AS steps FROM p GROUP BY start""",
    "briefing_parties": f"WITH {ONCE} SELECT case_id, 'plaintiffs' AS side, name FROM ({parties('plaintiffs')}) UNION ALL SELECT case_id, 'defendants', name FROM ({parties('defendants')})",
    "briefing_dates": f"WITH {ONCE} SELECT case_id, value FROM ({FIRST_SEEN.format(f='dates_mentioned')})",
    "briefing_vocabulary": f"WITH {ONCE} SELECT case_id, norm, value FROM ({FIRST_SEEN.format(f='vocabulary')})",
    "case_types": f"WITH {ONCE} {CASE_VOTE}",
    "briefing_stats": f"WITH {ONCE} SELECT case_id, count(*) AS n_chunks, " + ", ".join(f"sum(coalesce(len({c}), 0))::BIGINT AS n_{c}" for c in ("allegations", "defenses", "key_facts", "dates_mentioned", "names_mentioned", "vocabulary")) + " FROM ex GROUP BY case_id",
    "people_by_category": f"""WITH {ONCE}, r AS (SELECT case_id, coalesce(upper(x.category), 'OTHER') AS category, trim(x.name) AS name, {normal_name('x.name')} AS norm FROM (SELECT case_id, unnest(names_mentioned) AS x FROM ex)),
 o AS (SELECT case_id, category, norm, first(name ORDER BY len(name) DESC, name DESC) AS name FROM r WHERE norm <> '' GROUP BY ALL)
 SELECT case_id, category, name FROM o""",
    "briefing_openings": f"WITH {ONCE}, {_SIDES} SELECT * FROM {_OPENING}",
    "briefing_narratives": f"""WITH {ONCE}, {_SIDES}, f AS ({_firsts('allegations', 1, 5)} UNION ALL {_firsts('defenses', 2, 3)} UNION ALL {_firsts('key_facts', 3, 5)} UNION ALL {_firsts('dates_mentioned', 4, 5)}),
 g AS (SELECT case_id, paragraph, list(value ORDER BY rn) AS c FROM f GROUP BY ALL)
 SELECT case_id, 0 AS paragraph, position, part FROM {_OPENING} UNION ALL SELECT case_id, paragraph, 0, CASE paragraph
 WHEN 1 THEN CASE WHEN len(c) = 1 THEN 'The plaintiff alleges that ' || lower(c[1]) ELSE 'The key allegations in this case include:' || chr(10) || array_to_string(list_transform(c, lambda x: '- ' || x), chr(10)) END
 WHEN 2 THEN CASE WHEN len(c) = 1 THEN 'The defendant contends that ' || lower(c[1]) ELSE 'The defense asserts:' || chr(10) || array_to_string(list_transform(c, lambda x: '- ' || x), chr(10)) END
 WHEN 3 THEN 'Key facts include:' || chr(10) || array_to_string(list_transform(c, lambda x: '- ' || x), chr(10)) ELSE 'Relevant dates: ' || {_sentence_list('c')} END FROM g""",
    "section_runs": _RUNS,
    "section_boundaries": f"SELECT source_document, last_chunk AS boundary FROM ({_RUNS}) WHERE n >= 3 AND NOT (run = 1 AND section = '') UNION SELECT source_document, max(chunk_num) FROM {_CHUNKS} GROUP BY source_document",
    "adaptive_boundaries": f"""SELECT source_document, n_chunks, array_to_string(list_sort(list_distinct(list_concat(list_filter([5, 10, 15, 20, 30, 40, 50, 60, 70, 80], lambda b: b <= n_chunks), list_filter(range(85, 100000, 5), lambda b: b <= n_chunks), [n_chunks]))), ',') AS boundaries FROM (SELECT source_document, max(chunk_num) AS n_chunks FROM {WORK} GROUP BY source_document)""",
    "chunk_contexts": f"""WITH c AS (SELECT DISTINCT source_document, chunk_num, chunk_summary, progressive_summary FROM {WORK}),
 b AS (SELECT source_document, chunk_num + 1 AS chunk_num, CASE WHEN trim(chunk_summary) <> '' THEN string_split(chunk_summary, '. ') END AS ps, CASE WHEN trim(chunk_summary) <> '' THEN chunk_summary END AS l, CASE WHEN trim(progressive_summary) <> '' THEN progressive_summary END AS g FROM c)
 SELECT c.source_document, c.chunk_num, md5(CASE WHEN c.chunk_num = 1 THEN '[No preceding content.]' ELSE coalesce('[Previous: ' || CASE WHEN len(ps) > 2 THEN array_to_string(ps[1:2], '. ') || '.' ELSE l END || ']', '[Previous chunk summary not yet available]') END) AS local_context,
 md5(CASE WHEN c.chunk_num = 1 THEN '[This is the beginning of the document.]' ELSE coalesce('[Document overview: ' || g || ']', '[Global context not yet available]') END) AS global_context FROM c LEFT JOIN b ON b.source_document = c.source_document AND b.chunk_num = c.chunk_num""",
    "reduce_batches": """WITH r AS (SELECT DISTINCT result_id, case_id, chunk_summary FROM summarization_result WHERE chunk_summary IS NOT NULL), m AS (SELECT case_id, greatest(2, floor(6192 / (avg(len(chunk_summary)) + 100)))::BIGINT AS per FROM r GROUP BY case_id)
 SELECT case_id, (rn // per)::BIGINT AS batch, count(*) AS n, sum(len(chunk_summary))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY result_id) - 1 AS rn FROM r) JOIN m USING (case_id) GROUP BY ALL""",
    "summary_metadata": rf"""WITH {ONCE}, b AS (SELECT case_id, count(*) AS n, (sum(len(list_filter(string_split_regex(array_to_string(coalesce(key_facts, []), ' '), '\s+'), lambda w: w <> ''))) // count(*))::BIGINT AS mean_words FROM ex GROUP BY case_id),
 k AS (SELECT case_id, k, count(*) AS c FROM (SELECT case_id, unnest(vocabulary) AS k FROM ex) WHERE k IS NOT NULL GROUP BY ALL)
 SELECT b.case_id, n, mean_words, coalesce(n_keywords, 0) AS n_keywords, top_keyword FROM b LEFT JOIN (SELECT case_id, count(*) AS n_keywords, first(k ORDER BY c DESC, k) AS top_keyword FROM k GROUP BY case_id) USING (case_id)""",
    "chunks_by_document": f"SELECT *, row_number() OVER (PARTITION BY source_document ORDER BY chunk_num, chunk_row_id) - 1 AS position FROM (SELECT DISTINCT source_document, chunk_row_id, chunk_num FROM {WORK} WHERE source_document IS NOT NULL)",
    "dictionary_confidence": rf"""WITH {IDF}, w AS (SELECT chunk_row_id, any_value(chunk_text) AS t FROM {WORK} WHERE chunk_text IS NOT NULL GROUP BY chunk_row_id),
 k AS (SELECT chunk_row_id, regexp_extract_all({ascii_words('t')}, '\b[a-zA-Z]+\b') AS t FROM w), e AS (SELECT chunk_row_id, unnest(t) AS word FROM k),
 kn AS (SELECT chunk_row_id, count(*) AS n_known FROM e WHERE word IN (SELECT term FROM df WHERE df >= 3) GROUP BY chunk_row_id)
 SELECT chunk_row_id, len(t) AS n_tokens, coalesce(n_known, 0) AS n_known, CASE WHEN len(t) > 0 THEN round(coalesce(n_known, 0) * 100 / len(t), 4) ELSE 0 END AS confidence FROM k LEFT JOIN kn USING (chunk_row_id)""",
    "entity_filter": f"""WITH {ONCE}, e AS (SELECT x.name AS term FROM (SELECT unnest(names_mentioned) AS x FROM ex) WHERE x.name IS NOT NULL)
 SELECT len(term) BETWEEN 3 AND 60 AND NOT regexp_matches(term, {_q('(?i)' + '|'.join(f'(?:{p})' for p in C.ENTITY_FILTERS[:-1]))}) AND NOT regexp_matches(term, {_q(C.ENTITY_FILTERS[-1])}) AS kept, count(*) AS n, count(DISTINCT term) AS n_terms FROM e GROUP BY 1""",
    "terms_without_disliked": f"WITH {LATEST} SELECT DISTINCT term FROM log WHERE term IS NOT NULL AND lower(trim(term)) NOT IN (SELECT term_key FROM latest WHERE feedback = -1) UNION SELECT term FROM log WHERE term IS NULL",
    "recent_summaries": f"""SELECT source_document, chunk_num, md5(coalesce(string_agg(s, chr(10)) OVER (PARTITION BY source_document ORDER BY chunk_num ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '')) AS recent
 FROM (SELECT DISTINCT source_document, chunk_num, CASE WHEN trim(chunk_summary) <> '' THEN chunk_summary END AS s FROM {WORK})""",
    "success_rates": "SELECT case_id, count(*) AS n, count(*) FILTER (status <> 'error') AS succeeded, round(count(*) FILTER (status <> 'error') / count(*), 6) AS rate FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM document_result) GROUP BY case_id",
    "prompt_budgets": rf"""SELECT DISTINCT chunk_row_id, (len(chunk_text) // 4)::BIGINT AS prompt_tokens, greatest(n - 20, 0) AS least, n + 20 AS most, floor((n + 20) * 1.5::DOUBLE * 1.3::DOUBLE)::BIGINT AS tokens
 FROM (SELECT *, len(list_filter(string_split_regex(chunk_text, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+'), lambda w: w <> '')) AS n FROM {WORK} WHERE chunk_text IS NOT NULL)""",
    "debug_rows": f"SELECT DISTINCT chunk_row_id, substr(chunk_text, 1, 100) || '...' AS chunk_text, substr(chunk_summary, 1, 75) || '...' AS chunk_summary, substr(progressive_summary, 1, 75) || '...' AS progressive_summary FROM {WORK}",
    "processing_times": f"""SELECT DISTINCT chunk_row_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took FROM (SELECT chunk_row_id, floor(coalesce(processing_time_sec, 0))::BIGINT AS s FROM {WORK})""",
}

ORACLE_SQL |= {
    "answer_contexts": f"""WITH q AS (SELECT DISTINCT qa_id, sources FROM question_answer), s AS (SELECT qa_id, unnest(sources) AS x, generate_subscripts(sources, 1) AS i FROM q),
 w AS (SELECT DISTINCT source_document, chunk_num, chunk_text FROM {WORK} WHERE chunk_text IS NOT NULL),
 p AS (SELECT qa_id, i, '[' || source_document || CASE WHEN coalesce(x.section, 'N/A') <> 'N/A' THEN ', ' || x.section ELSE '' END || ']:' || chr(10) || chunk_text AS part FROM s JOIN w ON x.filename = source_document AND x.chunk_num = w.chunk_num WHERE x.score >= {C.MIN_RETRIEVAL_SCORE})
 SELECT qa_id, count(*) AS n_chunks, md5(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS context FROM p GROUP BY qa_id""",
    "chunk_summaries": lead(WORK, "chunk_row_id", "chunk_text", 75),
    "document_summaries": f"""WITH a AS (SELECT doc_id, list_transform({sentences('text')}, lambda s: {clean_sentence('s')}) AS ss FROM documents WHERE len({strip('text')}) > 50),
 k AS (SELECT doc_id, ss, greatest(1, ceil(coalesce(list_sum(list_transform(ss, lambda s: len(string_split(s, ' ')))), 0) / 200))::INT AS k FROM a)
 SELECT doc_id, array_to_string(list_filter(ss, lambda x, i: (i - 1) % k = 0), ' ') AS summary FROM k""",
    "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "event_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events)) GROUP BY user_id, g""",
    "summary_modes": f"""WITH t AS (SELECT source_document, max(chunk_num) AS n FROM {WORK} GROUP BY source_document)
 SELECT source_document, 'deep' AS mode, array_to_string(range(1, n + 1), ',') AS boundaries FROM t UNION ALL SELECT source_document, 'fixed', array_to_string(list_sort(list_distinct(list_concat(range(5, n + 1, 5), [n]))), ',') FROM t
 UNION ALL SELECT source_document, 'adaptive', array_to_string(list_sort(list_distinct(list_concat(list_filter([5, 10, 15, 20, 30, 40, 50, 60, 70, 80], lambda b: b <= n), list_filter(range(85, 100000, 5), lambda b: b <= n), [n]))), ',') FROM t""",
    "feedback_log": f"WITH {FEEDBACK} SELECT feedback, count(*) AS n, count(DISTINCT document_id) AS n_documents, max(feedback_ts) AS newest FROM log GROUP BY feedback",
    "combined_documents": "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) - 1 AS position, len(part) AS n_chars, md5(part) AS hash FROM (SELECT case_id, doc_id, '--- ' || doc_id || ' ---' || chr(10) || text AS part FROM documents WHERE len(text) > 0 AND case_id IS NOT NULL)",
    "names_section": f"""WITH {ONCE}, r AS (SELECT case_id, coalesce(upper(x.category), 'OTHER') AS category, trim(x.name) AS name, trim(x.role) AS role, {normal_name('x.name')} AS norm FROM (SELECT case_id, unnest(names_mentioned) AS x FROM ex)),
 o AS (SELECT case_id, category, norm, first(name ORDER BY len(name) DESC, name DESC) AS name, first(role ORDER BY len(role) DESC NULLS LAST, role DESC) AS role FROM r WHERE norm <> '' GROUP BY ALL)
 SELECT case_id, CASE category WHEN 'PARTY' THEN 'Parties' WHEN 'MEDICAL' THEN 'Medical Personnel' WHEN 'WITNESS' THEN 'Witnesses' ELSE 'Other Individuals' END AS section, row_number() OVER (PARTITION BY case_id, category ORDER BY name, norm) AS position, name || CASE WHEN len(role) > 0 THEN ' (' || role || ')' ELSE '' END AS line FROM o""",
    "reading_methods": f"WITH c AS ({ORACLE_SQL['dictionary_confidence']}), w AS (SELECT DISTINCT chunk_row_id, len(chunk_text) AS n FROM {WORK} WHERE chunk_text IS NOT NULL) SELECT chunk_row_id, CASE WHEN confidence > {C.DIGITAL_CONFIDENCE} AND n > {C.DIGITAL_LENGTH} THEN 'digital' ELSE 'ocr' END AS method FROM c JOIN w USING (chunk_row_id)",
    "corpus_vocabulary": f"SELECT source, count(DISTINCT term) AS vocab_size FROM (SELECT source, unnest(list_distinct({CORPUS})) AS term FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "chunk_ids": f"SELECT chunk_row_id, source_document || '_' || (row_number() OVER (ORDER BY source_document, chunk_num) - 1) AS chunk_id FROM (SELECT DISTINCT chunk_row_id, source_document, chunk_num FROM {WORK} WHERE source_document IS NOT NULL AND chunk_num IS NOT NULL)",
    "corpus_combined": f"""WITH a AS (SELECT DISTINCT filename, case_id FROM document_result), b AS (SELECT DISTINCT source_document AS filename, case_id FROM {WORK} WHERE source_document IS NOT NULL)
 SELECT filename, case_id FROM a UNION ALL SELECT CASE WHEN filename IN (SELECT filename FROM a) THEN 'work_' || filename ELSE filename END, case_id FROM b""",
}
