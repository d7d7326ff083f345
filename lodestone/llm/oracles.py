"""DuckDB SQL for the queries of this folder that SQL expresses."""

#: Smallest number that links reach, for nodes e(v) and links p(a, b) in both directions.
REACH = """reach AS (SELECT v, v AS w FROM e UNION SELECT r.v, p.b FROM reach r JOIN p ON p.a = r.w)"""

OP5_SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id AS v, embedding::DOUBLE[] AS a FROM embeddings),
y AS (SELECT v, a FROM x WHERE a IS NOT NULL AND len(list_filter(a, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(a, lambda z: z <> 0)) > 0),
p AS (SELECT s.v AS a, t.v AS b FROM y s JOIN y t ON s.v <> t.v AND len(s.a) = len(t.a) AND list_cosine_similarity(s.a, t.a) >= 0.9),
e AS (SELECT v FROM x), {REACH},
n AS (SELECT a AS v, count(*) AS n FROM p GROUP BY a), m AS (SELECT v, min(w) AS c FROM reach GROUP BY v)
SELECT m.v AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, m.v = c AS kept FROM m LEFT JOIN n ON n.v = m.v
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT doc_id AS v FROM d), {REACH}, m AS (SELECT v, min(w) AS c FROM reach GROUP BY v)
SELECT v AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, v = c AS kept FROM m LEFT JOIN n ON n.doc_id = v
"""

SAYS = "<|im_end|><|im_start|>assistant ok"
OP10_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{SAYS}' UNION ALL SELECT -1, 1, 'assistant', '{SAYS}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|><|im_end|>') + 2 AS chars FROM c),
a AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS t, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS l, sum(chars) AS f FROM o GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, f::BIGINT AS formatted_chars FROM a
"""

OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, unnest(ws[1:len(ws)]) AS phrase, 1 AS k FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM w
), f AS (
  SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cut AS (
  SELECT lang, phrase, k, a, j, array_to_string(ws[:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, range(1, 3) AS r(j) WHERE j < k
), s AS (
  SELECT cut.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
), m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.k = m.k + 1 AND 100 * c.a >= 50 * m.a
    AND (array_to_string(c.ws[:c.k - 1], ' ') = m.phrase OR array_to_string(c.ws[2:], ' ') = m.phrase))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH t AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) WHERE len(run) >= 7 GROUP BY ALL
), b AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(t.t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM b, t
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM h
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM w WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), d AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word
), m AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN m USING (word)
), g AS (
  WITH RECURSIVE g AS (
    SELECT word, word AS root, form AS further FROM f
    UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.further = f.word
  ) SELECT word, root FROM g WHERE further IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word)
"""
