"""DuckDB SQL that gives the rows of the corpus queries."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, p, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
g2 AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g2 WHERE k > 1) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
k AS (SELECT d.r, doc_id, source, t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS key
      FROM l JOIN d USING (r)),
nw AS (SELECT d.r, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, coalesce(rep.n, 0) AS rep FROM d LEFT JOIN rep USING (r)),
bad AS (SELECT r, words, (words < 50 OR 100 * rep > 50 * words) AS failed FROM nw),
f AS (SELECT source, key FROM k GROUP BY source, key HAVING count(DISTINCT doc_id) > 20),
hit AS (SELECT k.r, k.doc_id, k.source, k.key, k.n, failed, words
        FROM k JOIN f ON k.key = f.key AND k.source IS NOT DISTINCT FROM f.source JOIN bad ON bad.r = k.r),
k1 AS (SELECT *, min(doc_id) FILTER (WHERE NOT failed) OVER (PARTITION BY source, key) AS keeper FROM hit),
thin AS (SELECT r FROM k1 WHERE doc_id IS DISTINCT FROM keeper GROUP BY r HAVING any_value(words) - sum(n) < 0.3 * any_value(words)),
k2 AS (SELECT *, coalesce(min(doc_id) FILTER (WHERE NOT failed AND r NOT IN (SELECT r FROM thin)) OVER (PARTITION BY source, key),
        keeper) AS second FROM k1),
gone AS (SELECT r, count(*) AS lines, sum(n) AS words FROM k2 WHERE doc_id IS DISTINCT FROM second GROUP BY r),
saved AS (SELECT DISTINCT r FROM k2 WHERE doc_id = second AND NOT failed),
s AS (SELECT d.doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words,
        (d.r IN (SELECT r FROM thin) AND d.r NOT IN (SELECT r FROM saved)) AS depleted
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT depleted AS kept,
  n_removed_lines, n_removed_words
FROM s"""

OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w)::DOUBLE AS target FROM l),
o AS (SELECT d.*, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past,
        floor(target)::BIGINT AS goal
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, goal // source_size AS rounds, greatest(least(goal - (goal // source_size) * source_size - past, size), 0) AS rest FROM o)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (rounds * size + rest)::BIGINT AS taken,
  CASE WHEN size = 0 THEN 0 ELSE rounds + (rest > 0)::INT END::BIGINT AS n_draws
FROM r"""

OP3 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, a.doc_id AS dx, b.doc_id AS dy, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT dx, dy FROM p JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
c AS (SELECT DISTINCT doc_id AS id, doc_id AS root FROM documents
      UNION SELECT e.dy, c.root FROM c JOIN e ON c.id = e.dx WHERE c.root < e.dy)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT id, min(root) AS root FROM c GROUP BY id) m ON m.id = w.doc_id"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT r, doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
gone AS (SELECT r, i FROM w JOIN m USING (s) WHERE least < doc_id),
cut AS (SELECT r, i, (i - lag(i) OVER o > 50)::INT AS fresh FROM gone WINDOW o AS (PARTITION BY r ORDER BY i)),
isle AS (SELECT r, i, sum(coalesce(fresh, 0)) OVER (PARTITION BY r ORDER BY i) AS k FROM cut),
span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY r, k),
piece AS (SELECT span.*, h, coalesce(lag(b) OVER o, 0) AS past FROM span JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY k)),
kept AS (SELECT r, sum(b - a) AS n, count(*) AS spans, max(b) AS tail,
           string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY k) AS front FROM piece GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT),
        lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) AS h FROM d),
ap AS (SELECT *, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM h),
x AS (SELECT r, doc_id, n, unnest(range(n)) AS i, ws[unnest(list_transform(range(n), lambda i:
        CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END)) + 1] AS w FROM ap),
g AS (SELECT r, n, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g
      FROM x WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY i + 5 <= n),
pair AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
run AS (SELECT r, start, length, min(q) AS period
        FROM (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM isle GROUP BY r, q, k)
        WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT x.r, x.i FROM x JOIN run ON x.r = run.r AND i >= start + period AND i < start + length),
rest AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (r, i) GROUP BY r),
f AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
        first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
        first(period ORDER BY length DESC, start, period) AS period FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(f.t, '')) AS runs_sha256, sha256(coalesce(rest.t, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (r) LEFT JOIN rest USING (r)"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.*, coalesce(keeper < doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id"""

ORACLES = {"op1_line_quality": OP1, "op3_jaccard": OP3, "op5_mixing": OP5, "op8_suffix_dedup": OP8, "op11_line_dedup": OP11, "op12_runs": OP12, "op13_fim": OP13}
