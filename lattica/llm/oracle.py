"""DuckDB SQL of the queries that SQL can express at the size of the small tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_COUNT = "(length(t) - length(regexp_replace(t, '{}', '', 'g')))"

QUALITY_RULES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format('t')} AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE win IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) x(k) WHERE c > 1 GROUP BY 1),
top AS (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, word, count(*) AS c FROM u GROUP BY ALL) GROUP BY 1),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
 {_COUNT.format('[#*$%&|<>]')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
 len(lines) AS n_lines, {_COUNT.format('[A-Z]')} AS up, {_COUNT.format('[a-z]')} AS low, {_COUNT.format('!')} AS ex, {_COUNT.format('[0-9]')} AS dig,
 len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS letterless, coalesce(top.n, 0) AS top,
 len(list_filter(lines, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS listed, len(list_filter(lines, lambda l: regexp_matches(l, '([.][.][.]|…)[\\x20\\x09-\\x0D]*$'))) AS cut_short
 FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN top USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 20 * n_symbols > word_chars OR 10 * up > 3 * (up + low) OR 25 * ex > word_chars OR 2 * dig > word_chars OR 10 * n_dup_lines > 4 * n_lines
 OR 2 * letterless > n_words OR 10 * top > 4 * n_words OR (n_lines >= 5 AND (10 * listed > 9 * n_lines OR 10 * cut_short > 4 * n_lines))) AS kept FROM f"""

JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) m USING (doc_id)"""
