"""SQL for the numbered queries that SQL can express, written apart from the operators."""

# The checksum of a decimal number, bit by bit: h numbers the bits, x is the register.
CRC32 = """RECURSIVE crc(doc_id, s, k, x) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(x, CAST(ord(s[k // 8 + 1]) AS BIGINT)) ELSE x END AS y FROM crc WHERE k < 8 * length(s)))"""

# Runs by joining each word with its earlier occurrences: islands of neighbouring words at one lag; one inside an island of a smaller lag isn't of smallest period.
OP11 = f"""WITH {CRC32},
sums AS (SELECT doc_id, xor(x, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE k = 8 * length(s)),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
dealt AS (SELECT d.doc_id, w, len(w) AS n, h, h // 10 AS g FROM split d LEFT JOIN sums USING (doc_id)),
bent AS (SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a,
         CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM dealt),
places AS (SELECT doc_id, w, a, p, unnest(range(n)) AS i FROM bent),
words AS (SELECT doc_id, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM places),
lags AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM words x JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i < x.i),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM lags),
stretches AS (SELECT doc_id, q, min(i) - q AS start, max(i) AS last FROM marked GROUP BY doc_id, q, island),
long AS (SELECT * FROM stretches WHERE last - start + 1 >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, start, last - start + 1 AS length, q AS period FROM long l WHERE NOT EXISTS (
  SELECT 1 FROM stretches s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.start <= l.start AND s.last >= l.last)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs) WHERE place = 1),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN kept k ON k.doc_id = d.doc_id"""

OP13 = """WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""

OP5 = """WITH whole AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

ASCII_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# Every window of every width in use as one text, on both sides.
OP9 = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {ASCII_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS size, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS t FROM starts),
docs AS (SELECT doc_id, {ASCII_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
cuts AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs JOIN sizes ON len(w) >= size),
places AS (SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS t FROM cuts),
hits AS (SELECT doc_id, size, i, item FROM places JOIN windows USING (size, t)),
spans AS (SELECT DISTINCT doc_id, size, i FROM hits),
held AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS word FROM spans),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id) h USING (doc_id) LEFT JOIN found f USING (doc_id)"""
