"""DuckDB SQL for the registered queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op9_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce({_WORDS.format('text')}, []) AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT rid, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k
), words AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE_SQL["op10_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), made AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS guarded,
         regexp_replace(replace(replace(role, '&', '&a'), chr(10), '&n'), '<(\\*)\|', '<\1\\|', 'g') AS guarded_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(guarded_role) + 1 + length(guarded) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

ORACLE_SQL["op11_collocations"] = rf"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, {_FOLD.format("coalesce(text, '')")} AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)
), grams AS (
  SELECT lang, n AS size, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM pieces, range(1, 5) AS sizes(n) WHERE len(w) >= n)
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(floor(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f)) AS BIGINT) AS score
  FROM halves c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = tail
), weakest AS (
  SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS more
  FROM (SELECT lang, w, a, n, unnest(range(1, size - n + 2)) AS i FROM candidates, range(2, 4) AS sizes(n) WHERE size > n) GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_phrases i USING (lang, phrase) WHERE i.more IS NULL OR CAST(100 AS HUGEINT) * i.more < CAST(80 AS HUGEINT) * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""

# CRC-32 from its definition: a table of the 256 bytes' remainders, then a step for each byte of the word
ORACLE_SQL["op12_importance_resampling"] = f"""
WITH remainders AS (
  SELECT list(r ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS r FROM range(256) AS bytes(b)
  )
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents
), dw AS (SELECT rid, unnest(w) AS word FROM d
), iw AS (SELECT unnest(coalesce({_WORDS.format('text')}, [])) AS word FROM benchmark
), known AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM iw)
), buckets AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
         lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM known, remainders
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM iw JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT b.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
         / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * CAST((SELECT count(*) FROM iw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) AS b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (rid)
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""

# the base columns from their definition, the ratios as the table of rules has them
ORACLE_SQL["op13_quality_rules"] = r"""
WITH stops AS (
  SELECT unnest(string_split('the of and to in is that it was for on are with as by this be at from der die das und ist nicht ein eine zu mit von auf den dem le la les des et est un une dans que qui pour sur du de el los las en y por con para del se', ' ')) AS stop
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), per_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09]*([-*•‣·]|[0-9]{1,3}[.)])[\x20\x09]+[^\x20\x09-\x0D]')) AS n_list,
         count(*) FILTER (suffix(rtrim(line), '...') OR suffix(rtrim(line), '…')) AS n_open
  FROM lines GROUP BY rid
), windows AS (
  SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2
), per_window AS (SELECT rid, count(DISTINCT x) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 3)) AS x FROM repeated) GROUP BY rid
), per_stop AS (
  SELECT rid, count(*) AS n_stop FROM (SELECT rid, unnest(w) AS word FROM d) JOIN stops ON rtrim(lower(word), '.,;:!?') = stop GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_list, 0) AS n_list,
         coalesce(n_open, 0) AS n_open, coalesce(n_stop, 0) AS n_stop, length(t) - length(replace(t, '!', '')) AS n_excl
  FROM d LEFT JOIN per_line USING (rid) LEFT JOIN per_window USING (rid) LEFT JOIN per_stop USING (rid)
), broken AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',',
    CASE WHEN n_words < 50 THEN 'too few words' END, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated windows' END,
    CASE WHEN word_chars < 2.5 * n_words THEN 'short words' END, CASE WHEN word_chars > 11 * n_words THEN 'long words' END,
    CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END, CASE WHEN 5 * n_excl > n_words THEN 'exclamations' END,
    CASE WHEN n_words >= 200 AND 200 * n_stop < n_words THEN 'no stop words' END, CASE WHEN 2 * n_dup_lines > n_lines THEN 'repeated lines' END,
    CASE WHEN 10 * n_list > 9 * n_lines THEN 'list items' END, CASE WHEN 2 * n_open > n_lines THEN 'lines that break off' END) AS broken_rules
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, broken_rules = '' AS kept, broken_rules
FROM broken
"""
