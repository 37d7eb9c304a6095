"""SQL for the queries that SQL can express: DuckDB over the same tables."""

from __future__ import annotations

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), one AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    ELSE [array_to_string(w, ' ')] END) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN one USING (doc_id) GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
  ) JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a
), firsts AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id,
  doc_id <= coalesce(first, doc_id) AS kept
FROM sizes LEFT JOIN firsts USING (doc_id)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '{_ALNUM}'), []) AS w FROM documents
), i AS (
  SELECT item_id, coalesce(regexp_extract_all({_FOLD}, '{_ALNUM}'), []) AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
    unnest([w[p:p + least(10, len(w)) - 1] FOR p IN range(1, len(w) - least(10, len(w)) + 2)]) AS g
  FROM i WHERE len(w) > 0
), grams AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p,
    unnest([w[p:p + k - 1] FOR p IN range(1, len(w) - k + 2)]) AS g
  FROM d, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k
), found AS (
  SELECT doc_id, item_id, k, p FROM grams JOIN patterns USING (k, g)
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

WARC = r"""
WITH records AS (
  SELECT page_id, url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
    || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') AS record
  FROM pages
)
SELECT page_id, url, strlen(record) AS n_bytes, sha256(record) AS sha256,
  CASE WHEN page_id % 211 = 5 THEN 'missing'
    WHEN page_id % 101 = 7 AND contains(record, '<title>') THEN 'corrupt' ELSE 'intact' END AS status
FROM records
"""

_MARKED = (
    r"([<\[])(\\*)(s>|/s>|ROLE\]|/ROLE\]|IMAGE\]|AUDIO\]|DOCUMENT\]|FILE\]|INST\]|/INST\]"
    r"|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
)

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length('[ROLE]' || regexp_replace(role, '{_MARKED}', '\1\2\\\3', 'g') || '[/ROLE]'
      || regexp_replace(text, '{_MARKED}', '\1\2\\\3', 'g') || '</s>'))::BIGINT AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, length('<s>') + chars AS formatted_chars
FROM told
"""

VARIANTS = rf"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda k: k::UBIGINT)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)
    FOR i IN range(256)] AS t
), runs AS (
  SELECT r, coalesce(doc_id::VARCHAR, '') || ':' || r AS named, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[A-Za-zÀ-ÿ]+')) AS r FROM documents
  ) WHERE length(r) >= 7 GROUP BY ALL
), hashed AS (
  SELECT r, times, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
    flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT]
      ELSE [(192 + (ord(x) >> 6))::UBIGINT, (128 + (ord(x) & 63))::UBIGINT] END))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1]))) AS h
  FROM runs, crc
), counted AS (
  SELECT w, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0
      THEN substring(r, 1, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS w FROM hashed
  ) WHERE length(w) >= 7 GROUP BY w HAVING sum(times) >= 2
), holes AS (
  SELECT w, n, i, substring(w, 1, i - 1) || substring(w, i + 1) AS h
  FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM counted)
), near AS (
  SELECT a.w, b.w AS o, b.n FROM holes a JOIN holes b ON a.h = b.h AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM holes a JOIN counted b ON a.h = b.w
  UNION SELECT b.w, a.w, a.n FROM holes a JOIN counted b ON a.h = b.w
), best AS (
  SELECT w, count(*) AS k, min(struct_pack(less := -n, o := o)) AS b FROM near GROUP BY w
), formed AS (
  SELECT counted.w, n, coalesce(k, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.o END AS form,
    CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
  FROM counted LEFT JOIN best USING (w)
), led AS (
  SELECT w, coalesce(form, w) AS root, form IS NULL AS done FROM formed
  UNION ALL
  SELECT l.w, coalesce(f.form, l.root), f.form IS NULL FROM led l JOIN formed f ON f.w = l.root WHERE NOT done
)
SELECT w AS word, form, root, n, n_near, form_n FROM formed JOIN led USING (w) WHERE done
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(
    regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), ones AS (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM pieces) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang
), twos AS (
  SELECT lang, x, y, count(*) AS f FROM (
    SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM pieces WHERE len(w) > 1) GROUP BY ALL
), threes AS (
  SELECT lang, x, y, z, count(*) AS f FROM (
    SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM pieces WHERE len(w) > 2
  ) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT t.lang, x || ' ' || y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r, x, y
  FROM twos t JOIN ones p USING (lang, x) JOIN ones q ON q.lang = t.lang AND q.x = t.y WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || z, t.f, 1, p.f, q.f, NULL, NULL
  FROM threes t JOIN ones p USING (lang, x) JOIN twos q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || z, t.f, 2, p.f, q.f, NULL, NULL
  FROM threes t JOIN twos p USING (lang, x, y) JOIN ones q ON q.lang = t.lang AND q.x = t.z
), worst AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (
    SELECT lang, x, y, f FROM threes UNION ALL SELECT lang, y, z, f FROM threes) GROUP BY lang, x, y
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM worst w JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = w.lang AND g.x = w.x AND g.y = w.y
WHERE g.f IS NULL OR 100 * g.f < 50 * a
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op11_chat": CHAT, "op12_collocations": COLLOCATIONS, "op13_variants": VARIANTS, "op2_neardup": NEARDUP, "op4_warc": WARC, "op5_decontaminate": DECONTAMINATE}
