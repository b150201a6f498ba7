"""SQL that gives the same rows as the queries of ``queries``, in the dialect of the checking engine."""

from __future__ import annotations

# The rules as SQL states them, apart from the library's own constants: a change on one side alone shows.
_PII = (
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), ("aadhaar", r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"), ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9.+_-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"), ("demat", r"\b[0-9]{16}\b"), ("phone_in", r"(?:\+91[ -]?|\b0?)[6-9][0-9]{4}[ -]?[0-9]{5}\b"), ("account", r"\b[0-9]{9,18}\b"),
    ("otp", r"(?i)\b(?:otp|pin|passcode|(?:one[- ]time|verification|security|login) (?:code|password|pin))\b(?:[^0-9A-Za-z\n]+[A-Za-z]+){0,3}[^0-9A-Za-z\n]+[0-9]{4,6}\b"),
)
_ADVICE = (r"\bshould (?:i|we)\b", r"\btell me (?:the|a) (?:best|top)\b", r"\bbetter than\b", r"\bwhere (?:do|can) i put\b", r"\bsuggest\b", r"\b(?:best|top|safest) (?:plan|fund)s?\b", r"\bdoubles? (?:fastest|my money)\b")
_CLAIMS = (r"\breturns?\b", r"\bgains?\b", r"\bgrew by\b", r"\bbeats?\b", r"\bout-?perform", r"\bguaranteed\b")
_OFF_TOPIC = (r"\brecipe\b", r"\btravel cover\b", r"\bboat race\b", r"\bhow tall\b")
_ALIASES = {"large cap": "large_cap", "flexi cap": "flexi_cap", "small cap": "small_cap", "mid cap": "mid_cap", "balanced advantage": "balanced_advantage", "gilt": "gilt", "liquid": "liquid", "elss": "elss", "tax saver": "elss"}
_FOOTERS = ("helpline ", "data as on ", "page last refreshed", "reproduction needs", " rights reserved", "belong to ", "toll-free line")
_NOTICES = ("carry market risk", "can fall as well as rise", "promise nothing", "nothing here is advice")
_FIGURE_NAMES = r"(?i)^(?:aum|benchmark|cut[\s-]*off[\s-]*time|exit[\s-]*load|expense[\s-]*ratio|fund[\s-]*manager|lock[\s-]*in|minimum[\s-]*sip|minimum[\s-]*purchase|nav|riskometer|stamp[\s-]*duty)$"
_URL = r"\b(?:[a-z]+://|www\.)\S*[^\s.,;:!?)\]]"
_AMOUNT = r"(?i)(?:₹|\brs\b\.?|\binr\b)\s*[0-9]|[0-9]\s*(?:%|per ?cent\b)|[0-9][.,][0-9]|[0-9]{3}"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(xs) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


_REG = """r AS (SELECT coalesce(source_id, '') AS source_id, coalesce(url, '') AS url, coalesce(authority, '') AS authority, coalesce(scheme, '') AS scheme, coalesce(scheme_category, '') AS scheme_category,
    coalesce(doc_type, '') AS doc_type, coalesce(retrieved_at, '') AS retrieved_at,
    CASE WHEN lower(trim(coalesce(discover_only, ''))) IN ('true', 'yes', '1') THEN true WHEN lower(trim(coalesce(discover_only, ''))) IN ('false', 'no', '0', '') THEN false END AS discover_only,
    CASE WHEN lower(trim(coalesce(enabled, ''))) IN ('true', 'yes', '1') THEN true WHEN lower(trim(coalesce(enabled, ''))) IN ('false', 'no', '0', '') THEN false END AS enabled,
    lower(regexp_extract(coalesce(url, ''), '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#\\s]*)', 1)) AS host FROM source_registry)"""
_CITABLE = """c AS (SELECT source_id, min(url) AS url, arg_min(scheme_category, url || '|' || authority || '|' || scheme || '|' || scheme_category) AS scheme_category, arg_min(doc_type, url || '|' || authority || '|' || scheme || '|' || scheme_category || '|' || doc_type) AS doc_type
    FROM r WHERE enabled AND NOT discover_only AND source_id <> '' GROUP BY source_id)"""
_GOLDEN = """g AS (SELECT id, unnest(min(struct_pack(query := query, expected_kind := expected_kind, expected_facts := expected_facts, expected_source_id := expected_source_id, forbidden_terms := forbidden_terms, note := note))) FROM golden_qa WHERE id IS NOT NULL GROUP BY id)"""
_BLOCKS = """d AS (SELECT doc_id, min(blocks) AS blocks FROM clean_docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
    b AS (SELECT doc_id, x.pos AS pos, x.kind AS kind, x.text AS text, x.level AS level FROM (SELECT doc_id, unnest(blocks) AS x FROM d) WHERE x.text IS NOT NULL)"""
_LINE = "CASE WHEN kind = 'heading' THEN repeat('#', greatest(level, 1)) || ' ' || text ELSE text END"
_RANKED = "k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, hit_id) AS rank FROM hits WHERE qid IS NOT NULL)"
_QUESTIONS = "q AS (SELECT DISTINCT id, query FROM golden_qa)"


def _masked(x: str) -> str:
    for _, p in _PII:
        x = f"regexp_replace({x}, {_q(p)}, '[redacted]', 'g')"
    return x


def _by_label(x: str, then) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(p)}) THEN {then(k, p)}" for k, p in _PII)


def _first_label(x: str) -> str:
    return _by_label(x, lambda k, p: _q(k)) + " END"


def _trace(x: str) -> str:
    return _by_label(x, lambda k, p: f"regexp_replace({x}, {_q(p)}, '[redacted]')") + f" ELSE {x} END"


def _any(patterns) -> str:
    return _q("(?i)(?:" + "|".join(patterns) + ")")


def _category(x: str) -> str:
    found = ", ".join(f"CASE WHEN contains(lower({x}), {_q(a)}) THEN struct_pack(n := {-len(a)}, at := instr(lower({x}), {_q(a)}), alias := {_q(a)}, category := {_q(c)}) END" for a, c in _ALIASES.items())
    return f"(list_sort(list_filter([{found}], lambda s: s IS NOT NULL))[1]).category"


def _intent(x: str) -> str:
    return f"""CASE WHEN {_first_label(x)} IS NOT NULL THEN 'PII' WHEN regexp_matches({x}, {_any(_ADVICE + _CLAIMS)}) THEN 'ADVICE'
        WHEN regexp_matches({x}, {_any(_OFF_TOPIC)}) AND NOT regexp_matches({x}, '(?i)\\bbenchmark\\b|\\bindex\\b') THEN 'OUT_OF_SCOPE' ELSE 'FACTUAL' END"""


def _contains(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), {_q(_NUMBER)}), lambda t: replace(t, ',', ''))"


ORACLES = {
    "registry_typed": f"WITH {_REG} SELECT source_id, url, host, discover_only, enabled FROM r",
    "citable_sources": f"WITH {_REG}, {_CITABLE} SELECT source_id, url, scheme_category, doc_type FROM c",
    "preferred_urls": f"WITH {_REG}, {_CITABLE} SELECT scheme_category, arg_min(url, CASE WHEN doc_type <> 'factsheet' THEN '1' ELSE '0' END || source_id) AS url, count(*) AS n_sources FROM c GROUP BY scheme_category",
    "registry_violations": f"""WITH {_REG}, n AS (SELECT source_id, count(*) AS n FROM r GROUP BY source_id), s AS (SELECT DISTINCT scheme FROM source_registry WHERE scheme LIKE '% Fund'),
        v AS (SELECT source_id, url, CASE WHEN trim(source_id) = '' THEN 'empty_id' WHEN n > 1 THEN 'repeated_id'
            WHEN host NOT IN ('www.larkstonefund.example', 'files.larkstonefund.example', 'board.fundregister.example', 'plainfolio.example', 'www.sip-atlas.example', 'www.unitdesk-assoc.example', 'fundlantern.example') THEN 'host'
            WHEN authority NOT IN ('official', 'aggregator') THEN 'authority' WHEN discover_only IS NULL OR enabled IS NULL THEN 'truth_value' WHEN authority = 'aggregator' AND NOT discover_only THEN 'citable_aggregator'
            WHEN scheme NOT IN (SELECT scheme FROM s) THEN 'scheme' WHEN doc_type NOT IN ('scheme_page', 'factsheet', 'fee_charges', 'kim', 'sid', 'guide', 'faq') THEN 'doc_type' END AS rule
          FROM r JOIN n USING (source_id)) SELECT source_id, url, rule FROM v WHERE rule IS NOT NULL""",
    "fetch_summary": "SELECT status, count(*) AS pages, count(*) FILTER (extracted_text IS NULL) AS without_text, max(length(extracted_text)) AS longest FROM (SELECT DISTINCT raw_id, status, http_status, extracted_text FROM raw_docs) GROUP BY status",
    "question_pii": f"WITH {_QUESTIONS} SELECT id, {_first_label('query')} AS label, {_masked('query')} AS masked FROM q",
    "question_intents": f"""WITH {_QUESTIONS} SELECT id, {_intent('query')} AS intent, {' + '.join(f"CASE WHEN regexp_matches(query, {_q('(?i)' + p)}) THEN 1 ELSE 0 END" for p in _ADVICE + _CLAIMS)} AS n_rules FROM q""",
    "question_categories": f"WITH {_QUESTIONS} SELECT id, {_category('query')} AS category FROM q",
    "document_numbers": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, {_q(_NUMBER)})) AS token FROM documents WHERE text IS NOT NULL) SELECT replace(token, ',', '') AS number, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1",
    "documents_without_urls": f"""SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\[\\]]*)\\]\\(\\s*[^\\s()]+\\s*\\)', '\\1', 'g'), {_q(_URL)}, '', 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""",
    "performance_claims": f"""SELECT DISTINCT doc_id, regexp_matches(text, {_any(_CLAIMS)}) OR (contains(text, '%') AND regexp_matches(text, '(?i)\\b(?:a year|annual|yield|interest|profit)')) AS claims, regexp_matches(text, {_q(_AMOUNT)}) AS figure FROM documents WHERE text IS NOT NULL""",
    "word_counts": "SELECT chunk_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS words, token_count FROM (SELECT DISTINCT chunk_id, text, token_count FROM chunks)",
    "prose_slices": """WITH t AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, len(w), 180)) // 180 AS slice FROM t WHERE len(w) > 0)
        SELECT doc_id, slice::INT AS slice, array_to_string(w[slice * 180 + 1 : slice * 180 + 180], ' ') AS text FROM s""",
    "chunk_ids": "SELECT source_id, chunk_index, sha256(concat_ws('|', source_id, chunk_index::VARCHAR, text))[1:32] AS chunk_id FROM (SELECT DISTINCT source_id, chunk_index, text FROM chunks)",
    "line_offsets": f"""WITH {_BLOCKS}, l AS (SELECT doc_id, pos, {_LINE} AS line FROM b), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l)
        SELECT doc_id, pos, line, char_start, char_start + length(line) AS char_end FROM o""",
    "block_sections": f"WITH {_BLOCKS} SELECT doc_id, pos, last_value(CASE WHEN kind = 'heading' AND level <= 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b",
    "blocks_once": f"""WITH {_BLOCKS}, k AS (SELECT *, CASE WHEN {_contains('lower(text)', _NOTICES)} THEN substr(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), 1, 120) ELSE text END AS key FROM b),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM k) SELECT doc_id, pos, text FROM n WHERE kind = 'heading' OR r = 1""",
    "blocks_before_footer": f"""WITH {_BLOCKS}, s AS (SELECT doc_id, pos, kind, min(CASE WHEN kind <> 'heading' AND {_contains('lower(text)', _FOOTERS)} THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM b)
        SELECT doc_id, pos, kind FROM s WHERE stop IS NULL OR pos < stop""",
    "label_value_facts": f"""WITH t AS (SELECT DISTINCT raw_id AS doc_id, string_split(extracted_text, chr(10)) AS l FROM raw_docs WHERE extracted_text IS NOT NULL), p AS (SELECT doc_id, l[i] AS text, (i - 1)::INT AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)),
        n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM p)
        SELECT doc_id, pos, text || ': ' || nxt AS text FROM n WHERE regexp_matches(text, {_q(_FIGURE_NAMES)}) AND length(nxt) <= 60 AND (regexp_matches(text, '(?i)^(?:benchmark|fund[\\s-]*manager|riskometer)$') OR regexp_matches(nxt, '(?i)^(?:\\D{{0,5}}[0-9].*|nil|none|not applicable|-)$')) AND NOT regexp_matches(nxt, {_q(_FIGURE_NAMES)})""",
    "foreign_urls": """WITH u AS (SELECT chunk_id, source_id, url, unnest(list_distinct(regexp_extract_all(text, 'https?://[^\\s)\\]]+'))) AS found FROM chunks), o AS (SELECT url AS found, min(source_id) AS other_id, list(source_id) AS ids FROM source_registry WHERE url IS NOT NULL AND url <> '' GROUP BY url)
        SELECT DISTINCT chunk_id, source_id, other_id FROM u JOIN o USING (found) WHERE NOT list_contains(ids, source_id) AND found <> coalesce(url, '')""",
    "chunks_by_authority": f"WITH {_REG}, {_CITABLE}, k AS (SELECT DISTINCT chunk_id, source_id, authority FROM chunks) SELECT authority, doc_type AS registered_type, count(*) AS chunks, count(DISTINCT source_id) AS sources FROM k JOIN c USING (source_id) GROUP BY ALL",
    "sources_without_chunks": "SELECT DISTINCT source_id FROM source_registry WHERE source_id <> '' AND source_id NOT IN (SELECT source_id FROM chunks WHERE source_id IS NOT NULL)",
    "store_metadata": "SELECT DISTINCT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("chunk_id", "source_id", "source_title", "url", "authority", "scheme", "scheme_category", "doc_type", "section", "faq_question", "retrieved_at", "block_kind")) + ", coalesce(discover_only, false) AS discover_only, coalesce(chunk_index, 0) AS chunk_index, coalesce(token_count, 0) AS token_count FROM chunks",
    "store_upsert": """WITH c AS (SELECT chunk_id, struct_pack(source_id := source_id, text := text, token_count := coalesce(token_count, 0)) AS r, coalesce(token_count, 0) AS token_count FROM chunks),
        n AS (SELECT chunk_id, min(r) AS r FROM c WHERE token_count >= 100 AND chunk_id IS NOT NULL GROUP BY chunk_id), o AS (SELECT chunk_id, min(r) AS r FROM c WHERE token_count < 120 GROUP BY chunk_id)
        SELECT chunk_id, unnest(r) FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n))""",
    "duplicate_chunks": "SELECT chunk_id, count(*) AS n, count(DISTINCT token_count) AS counts, max(loaded_at) AS last FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
    "knn_topk": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, r.vec_id AS id, round(list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v))), 6) AS score FROM e q JOIN e r USING (label) WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, score, rank FROM k WHERE rank <= 20""",
    "filtered_hits": f"""WITH {_GOLDEN}, q AS (SELECT id AS qid, {_category('query')} AS category FROM g), h AS (SELECT hits.* FROM hits JOIN q USING (qid) WHERE NOT discover_only AND (category IS NULL OR scheme_category = category))
        SELECT qid, hit_id, scheme_category, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, hit_id) AS rank FROM h""",
    "grounding_gate": "SELECT qid, round(coalesce(max(score), 0.0), 6) AS max_score, count(*) AS candidates, count(*) FILTER (score IS NULL) AS unscored, coalesce(max(score), 0.0) >= 0.6 AS grounded FROM hits WHERE qid IS NOT NULL GROUP BY qid",
    "hit_traces": f"WITH {_RANKED} SELECT qid, rank, hit_id, round(score, 4) AS score, replace(substr(text, 1, 160), chr(10), ' ') AS preview FROM k",
    "sources_consulted": "WITH k AS (SELECT qid, source_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, hit_id) AS rank FROM hits WHERE qid IS NOT NULL AND source_id IS NOT NULL) SELECT qid, source_id, min(rank) AS rank FROM k GROUP BY ALL",
    "vector_norms": "WITH e AS (SELECT hit_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM hits) SELECT hit_id, norm, abs(norm - 1) > 1e-3 AS off FROM e",
    "hashed_documents": """WITH d AS (SELECT doc_id AS id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id), t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM d),
        b AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 384)::INT AS bucket, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS length FROM b GROUP BY id) SELECT id, bucket, round(n / length, 6) AS weight FROM b JOIN l USING (id)""",
    "score_stats": f"WITH {_GOLDEN} SELECT expected_kind, count(score) AS n, round(min(score), 6) AS low, round(avg(score), 6) AS mean, round(max(score), 6) AS high FROM g JOIN hits ON hits.qid = g.id GROUP BY expected_kind",
    "tau_sweep": f"""WITH {_GOLDEN}, b AS (SELECT qid AS id, coalesce(max(score), 0.0) AS best FROM hits GROUP BY qid), s AS (SELECT id, expected_kind = 'ANSWERED' AS inside, best FROM g JOIN b USING (id)), e AS (SELECT id, inside, best, round(0.30 + 0.05 * k, 2) AS tau FROM s, range(12) AS t(k))
        SELECT tau, round(count(*) FILTER (inside AND best >= tau) / nullif(count(*) FILTER (inside), 0), 4) AS recall, round(count(*) FILTER (NOT inside AND best < tau) / nullif(count(*) FILTER (NOT inside), 0), 4) AS gated, count(*) FILTER (inside) AS n_inside, count(*) FILTER (NOT inside) AS n_outside, coalesce(list_sort(list(id) FILTER (inside AND best < tau)), []) AS lost FROM e GROUP BY tau""",
    "retrieval_rates": f"""WITH {_GOLDEN}, {_RANKED}, a AS (SELECT id, expected_source_id FROM g WHERE expected_source_id IS NOT NULL), s AS (SELECT id, max(coalesce(k.source_id = expected_source_id, false)) AS found, count(DISTINCT scheme_category) AS categories, count(k.qid) AS n FROM a LEFT JOIN k ON k.qid = a.id AND k.rank <= 5 GROUP BY id)
        SELECT count(*) AS questions, round(avg(found::INT), 4) AS recall_at_k, round(count(*) FILTER (categories = 1 AND n > 0) / nullif(count(*) FILTER (n > 0), 0), 4) AS isolation FROM s""",
    "question_spans": f"""WITH {_QUESTIONS}, m AS (SELECT id, query, {_first_label('query')} AS label, {_by_label('query', lambda k, p: f"regexp_extract(query, {_q(p)})")} END AS hit FROM q) SELECT id, label, (instr(query, hit) - 1)::INT AS start, (instr(query, hit) - 1 + length(hit))::INT AS "end" FROM m""",
    "question_traces": f"WITH {_QUESTIONS} SELECT id, {_trace('query')} AS trace FROM q",
    "stream_guard": f"SELECT DISTINCT id AS qid, {_first_label('query')} AS pii, {_intent('query')} AS intent, {_category('query')} AS category, {_trace('query')} AS query FROM golden_qa",
    "facts_supported": f"WITH {_GOLDEN}, f AS (SELECT id AS qid, unnest(expected_facts) AS fact FROM g WHERE expected_facts IS NOT NULL) SELECT qid, hit_id, fact, len(list_filter({_numbers('fact')}, lambda x: NOT list_contains({_numbers('text')}, x))) = 0 AS supported FROM f JOIN hits USING (qid)",
    "payload_checks": """SELECT hit_id, hit_id % 4 = 3 AS off_topic, CASE hit_id % 4 WHEN 0 THEN CASE WHEN trim(coalesce(substr(text, 1, 80), '')) = '' OR trim(coalesce(source_id, '')) = '' THEN 'schema' END WHEN 1 THEN 'schema' WHEN 2 THEN 'invalid_json' END AS error,
        CASE WHEN hit_id % 4 = 0 AND trim(coalesce(substr(text, 1, 80), '')) <> '' AND trim(coalesce(source_id, '')) <> '' THEN length(substr(text, 1, 80)) ELSE 0 END AS n FROM hits WHERE hit_id IS NOT NULL""",
    "rendered_contexts": f"""WITH {_RANKED} SELECT qid, string_agg('[' || rank || '] source_id=' || coalesce(source_id, '') || ' section="' || coalesce(section, '') || '" retrieved_at=' || coalesce(regexp_extract(text, '\\(retrieved ([^)]*)\\)\\s*$', 1), '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM k WHERE rank <= 5 GROUP BY qid""",
    "fact_ranks": f"WITH {_GOLDEN}, {_RANKED}, f AS (SELECT DISTINCT id, fact FROM (SELECT id, unnest(expected_facts) AS fact FROM g) WHERE fact IS NOT NULL) SELECT f.id, fact, min(CASE WHEN contains(lower(coalesce(k.text, '')), lower(fact)) THEN rank END) AS rank FROM f LEFT JOIN k ON k.qid = f.id GROUP BY ALL",
    "chunk_dump": """WITH o AS (SELECT chunk_id, min(struct_pack(source_id := source_id, section := section, block_kind := block_kind, token_count := coalesce(token_count, 0), text := text)) AS r FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
        SELECT chunk_id, '== ' || chunk_id || ' | ' || coalesce(r.source_id, '') || ' | ' || coalesce(r.section, '') || ' | ' || coalesce(r.block_kind, '') || ' | ' || r.token_count || ' words' || chr(10) || coalesce(r.text, '') AS line FROM o""",
    "embedding_preview": """SELECT DISTINCT hit_id AS id, array_to_string(list_transform(embedding[1:12], lambda x: format('{:.6f}', x::DOUBLE)), ' ') || ' | ' || format('{:.6f}', sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS preview FROM hits WHERE embedding IS NOT NULL AND hit_id IS NOT NULL""",
    "norm_stats": "WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM hits WHERE embedding IS NOT NULL) SELECT count(n) AS vectors, round(min(n), 6) AS least, round(avg(n), 6) AS mean, round(max(n), 6) AS greatest, round(max(abs(n - 1)), 6) AS off_by FROM n",
    "page_warnings": f"""WITH d AS (SELECT doc_id, min(blocks) AS blocks FROM clean_docs WHERE doc_id IS NOT NULL GROUP BY doc_id), t AS (SELECT doc_id, list_filter(list_transform(coalesce(blocks, []), lambda b: coalesce(b.text, '')), lambda x: trim(x) <> '') AS t, list_filter(coalesce(blocks, []), lambda b: b.text IS NOT NULL) AS b FROM d),
        n AS (SELECT doc_id, t, b, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS total, list_min(list_transform(list_filter(b, lambda x: coalesce(x.kind, '') <> 'heading' AND {_contains('lower(x.text)', _FOOTERS)}), lambda x: x.pos)) AS stop FROM t)
        SELECT doc_id, list_filter([CASE WHEN total < 2000 THEN 'text shorter than 2000' END, CASE WHEN len(t) > len(list_distinct(t)) THEN (len(t) - len(list_distinct(t))) || ' duplicates collapsed' END,
            CASE WHEN len(list_filter(t, lambda x: {_contains('lower(x)', _NOTICES)})) > 1 THEN len(list_filter(t, lambda x: {_contains('lower(x)', _NOTICES)})) || ' notices' END,
            CASE WHEN stop IS NOT NULL AND 2 * coalesce(list_sum(list_transform(list_filter(b, lambda x: x.pos >= stop), lambda x: length(x.text))), 0) > total THEN 'more than half dropped' END,
            CASE WHEN len(list_filter(t, lambda x: length(x) > 8000)) > 0 THEN len(list_filter(t, lambda x: length(x) > 8000)) || ' blocks truncated' END], lambda w: w IS NOT NULL) AS warnings FROM n""",
    "visible_rates": f"""WITH {_GOLDEN}, {_RANKED}, q AS (SELECT id, expected_source_id, coalesce(expected_facts, []) AS facts, {_category('query')} AS category FROM g),
        s AS (SELECT q.*, k.source_id = expected_source_id AND len(list_filter(facts, lambda f: contains(lower(coalesce(k.text, '')), lower(f)))) > 0 AS shown, k.scheme_category FROM q JOIN k ON k.qid = q.id AND rank <= 5),
        e AS (SELECT id, max(coalesce(shown, false)) AS shown, expected_source_id IS NOT NULL AS expects, category, list_sort(list(DISTINCT scheme_category) FILTER (scheme_category IS NOT NULL)) AS cats FROM s GROUP BY id, expected_source_id, category)
        SELECT count(*) FILTER (expects) AS expecting, count(*) FILTER (expects AND shown) AS shown, count(*) FILTER (category IS NOT NULL) AS naming, count(*) FILTER (category IS NOT NULL AND cats = [category]) AS isolated FROM e""",
    "events_streamed": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
