"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, doc_id, source, text, line FROM (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {WORDS})),
again AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY r),
normal AS (SELECT r, source, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k, len(regexp_extract_all(line, {WORDS})) AS n FROM lines),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
above AS (SELECT n.source, n.k FROM (SELECT source, k, count(DISTINCT text) AS c FROM normal GROUP BY source, k) n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source
  WHERE c >= greatest(20, 0.05 * h.texts)),
removed AS (SELECT n.r, sum(n.n)::BIGINT AS words FROM normal n JOIN above a ON n.k = a.k AND n.source IS NOT DISTINCT FROM a.source GROUP BY n.r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
  coalesce(words, 0)::BIGINT AS removed_words FROM d LEFT JOIN covered USING (r) LEFT JOIN again USING (r) LEFT JOIN removed USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words <= 0.75 * n_words AS kept, removed_words FROM b
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
t AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
u AS (SELECT *, (budget - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM t),
g AS (SELECT source, source_size, budget, CASE WHEN cap <= level * weight THEN cap ELSE (SELECT arg_min(level, place) FROM u WHERE cap > level * weight) * weight END AS target FROM u),
q AS (SELECT doc_id, size, source_size, target, budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(key, 1, 8))::BIGINT % 4096, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER () AS r
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT r, size, budget, (before + size + unnest([0, source_size]))::DOUBLE / target AS f FROM q WHERE size > 0 AND target > 0),
e AS (SELECT r, size, budget, floor(f * 65536) AS hi, floor((f * 65536 - floor(f * 65536)) * 65536) AS lo FROM c),
run AS (SELECT hi, lo, budget, sum(sum(size)) OVER (ORDER BY hi, lo) AS total FROM e GROUP BY hi, lo, budget),
cut AS (SELECT arg_min(hi, (hi, lo)) AS hi, arg_min(lo, (hi, lo)) AS lo FROM run WHERE total > budget),
k AS (SELECT r, count(*) AS copies FROM e, cut WHERE cut.hi IS NULL OR e.hi < cut.hi OR (e.hi = cut.hi AND e.lo < cut.lo) GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (r)
"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op4_ngram_join": OP4, "op5_mixing": OP5}
