"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

BLANKS = r"[\x00-\x20]"


def jtrim(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+\z', '', 'g')"


def units(x: str) -> str:
    """Length in UTF-16 units."""
    beyond = rf"regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')"
    return f"(length({x}) + length({beyond}))"


RAW = "SELECT doc_id AS raw_data_id, text AS raw_text, source FROM documents"


def sentence_lists(source: str) -> str:
    """``(raw_data_id, source, raw_text, s)`` from rows that are not blank."""
    return rf"""
        SELECT raw_data_id, source, {jtrim('raw_text')} AS raw_text,
               list_filter(list_transform(
                   regexp_extract_all({jtrim('raw_text')}, '[^.!?]+[.!?]+\s*|[^.!?]+$'),
                   lambda p: {jtrim('p')}), lambda p: p <> '') AS s
        FROM ({source}) WHERE raw_text IS NOT NULL AND {jtrim('raw_text')} <> ''"""


def chunks(source: str = RAW, rule: str = "batch", target: int = 500, minimum: int = 50) -> str:
    """``(raw_data_id, chunk_index, chunk_text, source)``."""
    sep = 1 if rule == "actor" else 0
    whole = f"""
        UNION ALL
        SELECT raw_data_id, source, [raw_text] AS c FROM lists
        WHERE len(s) = 0 AND {units('raw_text')} <= {target}""" if rule == "actor" else ""
    first = f"len(a.done) = 0 AND a.n = 1 AND {units('a.cur')} > {target}" if target < minimum else "false"
    return f"""
    WITH lists AS ({sentence_lists(source)}),
    folded AS (
        SELECT raw_data_id, source, list_reduce(
            list_transform(s, lambda x: {{'done': []::VARCHAR[], 'cur': x, 'n': 1}}),
            lambda a, x: CASE
                WHEN ({units('a.cur')} >= {minimum} AND {units('a.cur')} + {units('x.cur')} + {sep} > {target})
                     OR ({first})
                THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': 1}}
                ELSE {{'done': a.done, 'cur': a.cur || ' ' || x.cur, 'n': a.n + 1}} END) AS f
        FROM lists WHERE len(s) > 0),
    arrays AS (SELECT raw_data_id, source, list_append(f.done, f.cur) AS c FROM folded {whole})
    SELECT raw_data_id, i::INT AS chunk_index, c[i + 1] AS chunk_text, source
    FROM (SELECT *, unnest(range(len(c))) AS i FROM arrays)"""


def embedded(source: str, text: str) -> str:
    """Adds the hashed bag of words, ``embedding FLOAT[]``, to the rows of ``source``."""
    words = rf"regexp_extract_all({text}, '[^\x00-\x20]+')"
    return f"""
    SELECT * EXCLUDE (slots, counts), list_transform(counts, lambda c: CASE WHEN len(slots) = 0 THEN 0 ELSE
        c / sqrt(list_sum(list_transform(counts, lambda y: (y * y)::DOUBLE))) END)::FLOAT[] AS embedding
    FROM (SELECT *, list_transform(range(64), lambda b: len(list_filter(slots, lambda h: h = b))) AS counts
          FROM (SELECT *, list_transform({words},
                    lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64) AS slots FROM ({source})))"""


def distance(a: str, b: str) -> str:
    return f"round(list_cosine_distance({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


def ranked(pairs: str, k: str, key: str) -> str:
    """The first k rows per query of ``pairs(query_id, key..., d, ...)``."""
    return f"""
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, {key}) AS rank
    FROM ({pairs}) QUALIFY rank <= {k}"""


VECTORS = "SELECT vec_id, embedding FROM embeddings"
EXACT_PAIRS = f"""
    SELECT q.vec_id AS query_id, s.vec_id, {distance('s.embedding', 'q.embedding')} AS d
    FROM embeddings q, embeddings s"""
EXACT = f"""
    SELECT query_id, rank, vec_id, round(d, 6) + 0.0 AS distance
    FROM ({ranked(EXACT_PAIRS, '5', 'vec_id')})"""

FLAWED = """
    SELECT vec_id, embedding FROM embeddings
    UNION ALL
    SELECT -1 - vec_id, CASE vec_id % 10
        WHEN 0 THEN list_transform(embedding, lambda x: 0.0::FLOAT)
        WHEN 1 THEN embedding[1:63]
        WHEN 2 THEN list_transform(embedding, lambda x, i: CASE WHEN i <> 6 THEN x END) END
    FROM embeddings WHERE vec_id % 10 < 4"""
HOLED = "len(list_filter(embedding, lambda x: x IS NULL)) > 0"
ZERO = "len(list_filter(embedding, lambda x: x IS NULL OR x <> 0)) = 0"

INSTRUCTIONS = """
    SELECT conv_id, exchange,
           string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS instruction,
           string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS input,
           string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS output
    FROM (SELECT *, greatest(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn), 1) AS exchange
          FROM conversations) GROUP BY conv_id, exchange"""


def combined(parts: tuple[str, str, str]) -> str:
    trimmed = [f"coalesce({jtrim(p)}, '')" for p in parts]
    return jtrim(f"({' || chr(32) || '.join(trimmed)})")


COMBINED = f"""
    SELECT conv_id, exchange, {combined(('instruction', 'input', 'output'))} AS raw_text
    FROM ({INSTRUCTIONS})"""

BOUNDS = """
    SELECT coalesce(min(doc_id), 1) AS min_id, coalesce(max(doc_id), 0) AS max_id,
           coalesce(max(doc_id), 0) - coalesce(min(doc_id), 1) + 1 AS id_span FROM documents"""
N = 7
RANGES = f"""
    SELECT range_id::INT AS range_id,
           min_id + range_id * (id_span // {N}) + least(range_id, id_span % {N}) AS start_id,
           min_id + (range_id + 1) * (id_span // {N}) + least(range_id + 1, id_span % {N}) AS end_id
    FROM ({BOUNDS}), range({N}) t(range_id)
    WHERE id_span // {N} + (range_id < id_span % {N})::INT > 0"""
RANGED = f"""
    SELECT doc_id AS raw_data_id, range_id FROM documents
    JOIN ({RANGES}) ON doc_id >= start_id AND doc_id < end_id"""

STORE = embedded(chunks(), "chunk_text")
MESSAGES = r"""
    SELECT conv_id * 1000 + turn AS query_id, text AS message FROM conversations WHERE role = 'user'
    UNION ALL
    SELECT -1 - (conv_id * 1000 + turn), ' ' || chr(10) FROM conversations WHERE role = 'user' AND turn = 1"""


def found(asked: str, text: str, k: int, store: str = STORE) -> str:
    """Nearest chunks of ``asked(query_id, text)``."""
    pairs = f"""
        SELECT q.query_id, s.raw_data_id, s.chunk_index, s.chunk_text,
               {distance('s.embedding', 'q.embedding')} AS d
        FROM ({embedded(f"SELECT * FROM ({asked}) WHERE {jtrim(text)} <> ''", text)}) q, ({store}) s"""
    return ranked(pairs, str(k), "raw_data_id, chunk_index")


HITS = found(MESSAGES, "message", 3)
CONTEXT = f"""
    SELECT query_id, string_agg('--- ' || chunk_text || ' ---', chr(10) ORDER BY rank) AS context
    FROM ({HITS}) GROUP BY query_id"""
PROMPTS = f"""
    SELECT m.query_id, m.message,
           'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10)
           || message || chr(10) || chr(10)
           || 'Instruction: Use the context to answer the question. If the answer is not in the context, '
           || 'say "I don''t know. No data is provided to us"' AS prompt
    FROM ({MESSAGES}) m LEFT JOIN ({CONTEXT}) c USING (query_id)"""

SYSTEM = "You are a helpful investment advisor assistant."
SLOTS = "len(list_filter(embedding, lambda x: x <> 0)) AS slots"
SUMMARY = f"SELECT raw_data_id, chunk_index, chunk_text, source, {SLOTS} FROM ({STORE})"

# Sign patterns: eight tables of eight planes whose entries come from MD5, as in ``Hyperplanes``.
LSH = f"""
    WITH planes AS (
        SELECT t, b, d, CASE WHEN substr(md5('1:' || t || ':' || b || ':' || d), 1, 1) < '8'
                        THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
        FROM range(8) x(t), range(8) y(b), range(64) z(d)),
    entries AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
    bits AS (
        SELECT vec_id, t, b, (sum(x * sign) >= 0)::INT AS bit
        FROM entries JOIN planes USING (d) GROUP BY ALL),
    patterns AS (SELECT vec_id, t, sum(bit << b)::INT AS pattern FROM bits GROUP BY ALL),
    meets AS (
        SELECT DISTINCT q.vec_id AS query_id, s.vec_id
        FROM patterns q JOIN patterns s ON q.t = s.t AND bit_count(xor(q.pattern, s.pattern)) <= 1),
    pairs AS (
        SELECT query_id, m.vec_id, {distance('s.embedding', 'q.embedding')} AS d
        FROM meets m JOIN embeddings q ON q.vec_id = query_id JOIN embeddings s ON s.vec_id = m.vec_id)
    SELECT query_id, rank, vec_id, round(d, 6) + 0.0 AS distance
    FROM ({ranked('SELECT * FROM pairs', '5', 'vec_id')})"""



def ivf(steps: int, lists: int, probes: int) -> str:
    """Lloyd's steps from the first vectors, then the search of the nearest cells."""
    close = "list_inner_product(u.x, c.x) - 0.5 * list_inner_product(c.x, c.x)"
    parts = [f"""
        units AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE / n) AS x
            FROM (SELECT vec_id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
                  FROM embeddings)),
        step_0 AS (
            SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, x
            FROM (SELECT * FROM units ORDER BY vec_id LIMIT {lists}))"""]
    for i in range(steps):
        parts.append(f"""
        at_{i} AS MATERIALIZED (
            SELECT vec_id, u.x, cell FROM units u, step_{i} c
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {close} DESC, cell) = 1),
        sums_{i} AS (
            SELECT cell, d, sum(floor(v * 1048576 + 0.5)::BIGINT) / (count(*) * 1048576.0::DOUBLE) AS mean
            FROM (SELECT cell, unnest(range(64)) AS d, unnest(x) AS v FROM at_{i}) GROUP BY cell, d),
        step_{i + 1} AS MATERIALIZED (
            SELECT cell, coalesce(m.x, s.x) AS x FROM step_{i} s
            LEFT JOIN (SELECT cell, list(mean ORDER BY d) AS x FROM sums_{i} GROUP BY cell) m USING (cell))""")
    return f"""
    WITH {', '.join(parts)},
    near AS MATERIALIZED (
        SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {close} DESC, cell) AS place
        FROM units u, step_{steps} c),
    pairs AS (
        SELECT q.vec_id AS query_id, s.vec_id, {distance('b.embedding', 'a.embedding')} AS d
        FROM near q JOIN near s ON q.cell = s.cell AND q.place <= {probes} AND s.place = 1
        JOIN embeddings a ON a.vec_id = q.vec_id JOIN embeddings b ON b.vec_id = s.vec_id)
    SELECT query_id, rank, vec_id, round(d, 6) + 0.0 AS distance
    FROM ({ranked('SELECT * FROM pairs', '5', 'vec_id')})"""


IVF = ivf(4, 10, 3)

MARKS = "SELECT doc_id AS raw_data_id, regexp_replace(text, '[^.!?]', '', 'g') AS raw_text, source FROM documents"

BLANK_TURN = "' ' || chr(9) || chr(10) || chr(1) || ' '"

NEIGHBOURS = f"""
    SELECT a.vec_id, coalesce({ZERO.replace('embedding', 'a.embedding')}, false) AS no_direction,
           CASE WHEN len(a.embedding) = 64 AND NOT ({HOLED.replace('embedding', 'a.embedding')})
                     AND NOT ({ZERO.replace('embedding', 'a.embedding')})
                THEN round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0
           END AS distance
    FROM ({FLAWED}) a JOIN embeddings b
    ON b.vec_id = CASE WHEN a.vec_id < 0 THEN -1 - a.vec_id ELSE a.vec_id END + 1"""

ORACLE: dict[str, str] = {
    "dense_ids": """
        SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, turn FROM conversations""",
    "dense_ids_tied": """
        SELECT role, min(id) AS first, max(id) AS last, count(*) AS ids
        FROM (SELECT role, row_number() OVER (ORDER BY role) AS id FROM conversations) GROUP BY role""",
    "dense_ids_of_files": """
        SELECT row_number() OVER () AS id, doc_id FROM documents""",
    "ordered_scan": "SELECT doc_id AS raw_data_id, text AS raw_text FROM documents ORDER BY doc_id",
    "id_bounds": BOUNDS,
    "id_ranges": RANGES,
    "range_scan": RANGED,
    "range_counters": f"""
        SELECT range_id, count(raw_data_id) AS records, count(raw_data_id) // 100 + 1 AS pages
        FROM ({RANGES}) LEFT JOIN ({RANGED}) USING (range_id) GROUP BY range_id""",
    "keyset_page": """
        SELECT doc_id AS raw_data_id, text AS raw_text FROM documents
        WHERE doc_id > 99 AND doc_id < 400 ORDER BY doc_id LIMIT 100""",
    "page_numbers": f"""
        SELECT raw_data_id, range_id,
               (row_number() OVER (PARTITION BY range_id ORDER BY raw_data_id) - 1) // 100 AS page
        FROM ({RANGED})""",
    "prefix_sample": f"""
        SELECT doc_id AS raw_data_id, text AS raw_text FROM documents, ({BOUNDS})
        WHERE doc_id <= least(min_id + greatest(1, floor(id_span * 0.3::DOUBLE)::BIGINT) - 1, max_id)""",
    "combined_text": COMBINED,
    "csv_source": f"SELECT raw_text FROM ({COMBINED}) WHERE raw_text <> ''",
    "raw_sink": f"""
        SELECT row_number() OVER (ORDER BY again, conv_id, exchange) AS raw_data_id, raw_text
        FROM ({COMBINED}), range(2) t(again)""",
    "blanks_dropped": f"""
        SELECT conv_id, turn FROM (
            SELECT conv_id, turn, text AS raw_text FROM conversations
            UNION ALL
            SELECT conv_id, -1 - turn, CASE WHEN turn % 2 = 0 THEN {BLANK_TURN} END FROM conversations)
        WHERE raw_text IS NOT NULL AND {jtrim('raw_text')} <> ''""",
    "sentences": f"""
        SELECT raw_data_id, i::INT AS pos, s[i + 1] AS sentence
        FROM (SELECT *, unnest(range(len(s))) AS i FROM ({sentence_lists(RAW)}))""",
    "chunks_batch": f"SELECT * EXCLUDE source FROM ({chunks()})",
    "chunks_actor": f"SELECT * EXCLUDE source FROM ({chunks(rule='actor')})",
    "chunks_small": f"SELECT * EXCLUDE source FROM ({chunks(rule='actor', target=40, minimum=60)})",
    "chunk_fallback": f"SELECT * EXCLUDE source FROM ({chunks(MARKS, 'actor')})",
    "chunks_fixed": f"""
        SELECT raw_data_id, i::INT AS chunk_index, c[i + 1] AS chunk_text
        FROM (SELECT *, unnest(range(len(c))) AS i FROM (
            SELECT raw_data_id, CASE WHEN length(t) <= 500 THEN [t] ELSE list_transform(
                range(0, length(t), 450), lambda p: substring(t, p + 1, 500)) END AS c
            FROM (SELECT raw_data_id, {jtrim('raw_text')} AS t FROM ({RAW})) WHERE t <> ''))""",
    "chunks_flattened": """
        SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk_text FROM documents""",
    "chunks_of_parents": f"""
        SELECT * EXCLUDE source FROM ({chunks()}) WHERE raw_data_id IN (SELECT doc_id FROM labels)""",
    "by_source": f"SELECT raw_data_id, chunk_index, source FROM ({chunks()})",
    "zero_vectors_dropped": f"SELECT vec_id FROM ({FLAWED}) WHERE NOT ({ZERO})",
    "dimension_check": f"""
        SELECT vec_id, 64 AS dim, coalesce(len(embedding) <> 64, true) OR ({ZERO}) AS is_zero
        FROM ({FLAWED})""",
    "null_element_check": f"SELECT vec_id FROM ({FLAWED}) WHERE {HOLED}",
    "reject_reasons": f"""
        SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing vector'
                            WHEN len(embedding) <> 64 THEN 'wrong dimension'
                            WHEN {HOLED} THEN 'null element'
                            WHEN {ZERO} THEN 'zero vector' END AS reason
        FROM ({FLAWED})
        UNION ALL SELECT vec_id + 1000000000000, 'not finite' FROM embeddings WHERE vec_id % 10 = 7""",
    "narrowed_vectors": """
        SELECT vec_id, unnest(range(64))::INT AS pos,
               round(unnest(list_transform(embedding, lambda x: (x::DOUBLE / 3)::FLOAT))::DOUBLE, 6) + 0.0 AS x
        FROM embeddings""",
    "cosine_distances": NEIGHBOURS,
    "cosine_expression": NEIGHBOURS,
    "topk_one": f"""
        SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (
            SELECT vec_id, {distance('embedding', '(SELECT arg_min(embedding, vec_id) FROM embeddings)')} AS d
            FROM embeddings ORDER BY d, vec_id LIMIT 10)""",
    "topk_cosine": EXACT,
    "topk_sliced": EXACT,
    "ann_ivf": IVF,
    "ann_ivf_all_lists": EXACT,
    "ann_ivf_kept": IVF,
    "ann_lsh": LSH,
    "topk_flawed": f"""
        WITH asked AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
        pairs AS (
            SELECT query_id, vec_id, CASE WHEN vec_id >= 0 THEN {distance('embedding', 'q')} END AS d,
                   CASE WHEN vec_id >= 0 THEN 0 WHEN (-1 - vec_id) % 10 = 0 THEN 1 ELSE 2 END AS place
            FROM asked, ({FLAWED}))
        SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance,
               row_number() OVER (PARTITION BY query_id ORDER BY place, d, vec_id) AS rank
        FROM pairs QUALIFY rank <= CASE WHEN query_id = 0 THEN 700 ELSE 3 END""",
    "embedded_texts": f"""
        SELECT conv_id, turn, len(slots) = 0 AS is_zero, len(list_distinct(slots)) AS slots,
               CASE WHEN len(slots) = 0 THEN 'blank text' END AS embed_error
        FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^\\x00-\\x20]+'),
                  lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64) AS slots
              FROM (SELECT conv_id, turn, text FROM conversations
                    UNION ALL SELECT conv_id, -1 - turn, ' ' FROM conversations WHERE role = 'system'))""",
    "embedded_once": f"""
        WITH first AS (SELECT chunk_text, {SLOTS} FROM ({STORE})),
        second AS (SELECT chunk_text, {SLOTS} FROM ({embedded(chunks(rule='actor'), 'chunk_text')})),
        counts AS (
            SELECT 'batch' AS rule, count(*) AS chunks, sum(slots)::BIGINT AS slots,
                   count(DISTINCT chunk_text) AS sent FROM first
            UNION ALL
            SELECT 'actor', count(*), sum(slots)::BIGINT,
                   count(DISTINCT chunk_text) FILTER (chunk_text NOT IN (SELECT chunk_text FROM first)) FROM second)
        SELECT CASE rule WHEN 'batch' THEN 0 ELSE 1 END AS call, rule, chunks, sent, slots FROM counts
        UNION ALL SELECT 2, rule, chunks, 0, slots FROM counts WHERE rule = 'batch'""",
    "short_replies": f"""
        SELECT conv_id, turn, blank OR odd AS is_zero,
               CASE WHEN blank THEN 'blank text' WHEN odd THEN 'reply count differs' END AS embed_error
        FROM (SELECT conv_id, turn, blank,
                     count(*) FILTER (NOT blank) OVER (PARTITION BY conv_id) % 2 = 1 AS odd
              FROM (SELECT *, {jtrim('text')} = '' AS blank FROM conversations))""",
    "hashed_embedding": f"""
        SELECT raw_data_id, chunk_index, slot::INT AS slot, round(weight::DOUBLE, 6) AS weight
        FROM (SELECT raw_data_id, chunk_index, unnest(range(64)) AS slot, unnest(embedding) AS weight
              FROM ({STORE})) WHERE weight <> 0""",
    "query_admission": """
        SELECT CASE WHEN blank THEN -1 - item_id ELSE item_id END AS item_id,
               CASE WHEN item_id % 4 = 3 THEN 7 ELSE 5 END AS k,
               CASE WHEN blank THEN 'Query cannot be empty.' END AS error
        FROM benchmark, (VALUES (false), (true)) t(blank)""",
    "topk_text": f"""
        SELECT query_id, rank, raw_data_id, chunk_index, chunk_text, round(d, 6) + 0.0 AS distance
        FROM ({found('SELECT item_id AS query_id, text AS query FROM benchmark', 'query', 5)})""",
    "topk_text_twice": f"""
        SELECT query_id, rank, raw_data_id, chunk_index, chunk_text, round(d, 6) + 0.0 AS distance
        FROM ({found('SELECT item_id AS query_id, text AS query FROM benchmark', 'query', 5,
                     f"SELECT * FROM ({STORE}), range(2)")})""",
    "limited_search": f"""
        SELECT query_id, rank, raw_data_id, chunk_index, chunk_text, round(d, 6) + 0.0 AS distance
        FROM ({found('SELECT item_id AS query_id, text AS query FROM benchmark', 'query', 7)})
        WHERE rank <= CASE WHEN query_id % 4 = 3 THEN 7 ELSE 5 END""",
    "context_section": CONTEXT,
    "built_prompts": f"SELECT query_id, prompt FROM ({PROMPTS})",
    "answers": f"""
        SELECT query_id,
               CASE WHEN {jtrim('message')} = '' THEN 'Message cannot be empty.'
                    ELSE md5('{SYSTEM}' || chr(10) || prompt) END AS reply,
               CASE WHEN {jtrim('message')} = '' THEN 'Message cannot be empty.' END AS reply_error
        FROM ({PROMPTS})""",
    "stage_counts": f"""
        WITH counts AS (
            SELECT (SELECT (count(DISTINCT range_id) + 3) // 4 FROM ({RANGED})) AS batches,
                   (SELECT count(*) FROM documents) AS records,
                   (SELECT count(*) FROM documents WHERE text IS NULL OR {jtrim('text')} = '') AS blank,
                   (SELECT count(*) FROM ({chunks()})) AS made)
        SELECT 'read' AS stage, 'batches' AS metric, batches AS value FROM counts
        UNION ALL SELECT 'read', 'failed_batches', 0 FROM counts
        UNION ALL SELECT 'read', 'records', records FROM counts
        UNION ALL SELECT 'read', 'blank', blank FROM counts
        UNION ALL SELECT 'chunk', 'generated', made FROM counts
        UNION ALL SELECT 'embed', 'succeeded', made FROM counts
        UNION ALL SELECT 'embed', 'failed', 0 FROM counts
        UNION ALL SELECT 'write', 'records', made FROM counts""",
    "ingested": SUMMARY,
    "ingested_stream": SUMMARY,
    "stream_after_outage": SUMMARY,
    "stream_updated": SUMMARY,
    "store_reset": SUMMARY,
    "rejects": f"""
        SELECT raw_data_id, chunk_index, source, 'wrong dimension' AS reason
        FROM ({chunks()}) WHERE length(chunk_text) > 500""",
    "null_vector_sink": f"""
        SELECT vec_id AS raw_data_id, embedding IS NULL AS no_vector, true AS dated FROM ({FLAWED})""",
    "run_ledger": f"""
        WITH counts AS (SELECT (SELECT count(*) FROM documents) AS records, count(*) AS made,
                               count(*) FILTER (length(chunk_text) > 500) AS skipped FROM ({chunks()}))
        SELECT 'read' AS stage, 'read_count' AS metric, records AS value FROM counts
        UNION ALL SELECT 'read', 'filter_count', 0 FROM counts
        UNION ALL SELECT 'chunk', 'chunk_count', made FROM counts
        UNION ALL SELECT 'write', 'write_count', made - skipped FROM counts
        UNION ALL SELECT 'embed', 'skip_count', skipped FROM counts""",
}
