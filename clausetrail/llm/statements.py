"""The check statements, in DuckDB's SQL, of the queries that SQL can express; joins and groupings by plain strings."""

from __future__ import annotations

# crc32 of a list of byte values, continued from a state; the table comes from its polynomial.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    """An expression for the crc32 of a text; needs ``crc_table`` in scope as ``crc_table.t``."""
    octets = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


# Every 50-byte window, the smallest document it starts in, and the runs of covered bytes.
OP11 = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
windows AS (SELECT r, doc_id, p, array_slice(b, p + 1, p + 50) AS w FROM (SELECT r, doc_id, b, unnest(range(0, n - 49)) AS p FROM texts)),
firsts AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
late AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM windows JOIN firsts USING (w) WHERE doc_id > low),
numbered AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM late),
spans AS (SELECT r, k, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY r, k),
kept AS (SELECT r, string_agg(hex(array_slice(b, coalesce(last, 0) + 1, a)), '' ORDER BY k) AS head, max(z) AS z, sum(z - a) AS removed, count(*) AS runs
  FROM (SELECT s.*, lag(z) OVER (PARTITION BY r ORDER BY k) AS last FROM spans s) JOIN texts USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN runs IS NULL THEN b ELSE unhex(head || hex(array_slice(b, z + 1, n))) END) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

OP13 = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS seeded, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc('seeded')} AS h FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT word, other FROM (
  SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT x.word, y.word FROM holes x JOIN words y ON x.a || x.b = y.word UNION ALL SELECT y.word, x.word FROM holes x JOIN words y ON x.a || x.b = y.word)),
best AS (SELECT e.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS best, max(w.n) AS best_n FROM near e JOIN words w ON w.word = e.other GROUP BY e.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS here, 0 AS depth FROM forms UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN forms f ON f.word = s.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, depth) AS root FROM steps GROUP BY word)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, form_n, root FROM forms JOIN roots USING (word)
"""

# Costs to the end are found row by row from the last one, then the letters from the first one on.
OP12 = f"""
WITH RECURSIVE {_CRC},
seeded AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
cases AS (SELECT *, {_crc('key')} % 20 AS c FROM seeded, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cases, (VALUES (0), (1)) AS twice(k) WHERE c <> 0 AND (k = 0 OR c = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS size,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS tail FROM damaged),
judged AS (SELECT *, substr(role, 1, 1) AS x, CASE WHEN tail = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(tail, '[.!?]$') THEN 'truncated' END AS fault FROM placed),
priced AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM judged),
costs AS (
  SELECT conv_id, size + 1 AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3 FROM (SELECT DISTINCT conv_id, size FROM priced)
  UNION ALL
  SELECT conv_id, i, least(d0, 3 + least(d2, 3 + d3)), least(d1, 3 + least(d2, 3 + d3)), least(d2, 3 + d3), least(d3, 3 + d2) FROM (
    SELECT p.conv_id, p.i,
      least(4 + c0, CASE WHEN gone THEN 99999999 ELSE more + least(3 + c2, CASE x WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 99999999 END) END) AS d0,
      least(4 + c1, CASE WHEN gone THEN 99999999 ELSE more + least(3 + c2, CASE x WHEN 'u' THEN c2 ELSE 99999999 END) END) AS d1,
      least(4 + c2, CASE WHEN gone THEN 99999999 ELSE more + least(3 + c3, CASE x WHEN 'a' THEN c3 ELSE 99999999 END) END) AS d2,
      least(4 + c3, CASE WHEN gone THEN 99999999 ELSE more + least(3 + c2, CASE x WHEN 'u' THEN c2 ELSE 99999999 END) END) AS d3
    FROM costs k JOIN priced p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.i - 1)),
walk AS (
  SELECT conv_id, 1 AS i, 0 AS s, '' AS audit, [] :: VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM priced)
  UNION ALL
  SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN s = 2 THEN 3 ELSE 2 END END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN letter = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, p.x, p.role, p.text, CASE
      WHEN p.i IS NULL THEN 'I'
      WHEN [h.c0, h.c1, h.c2, h.c3][s + 1] = 4 + [n.c0, n.c1, n.c2, n.c3][s + 1] THEN 'D'
      WHEN [h.c0, h.c1, h.c2, h.c3][s + 1] = 3 + CASE WHEN s = 2 THEN h.c3 ELSE h.c2 END THEN 'I'
      WHEN (s = 0 AND x = 's' AND h.c0 = more + n.c1) OR (s IN (0, 1, 3) AND x = 'u' AND [h.c0, h.c1, h.c2, h.c3][s + 1] = more + n.c2) OR (s = 2 AND x = 'a' AND h.c2 = more + n.c3) THEN 'K'
      ELSE 'R' END AS letter
    FROM walk w JOIN costs h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i LEFT JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
    LEFT JOIN costs n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1 WHERE p.i IS NOT NULL OR s IN (1, 2))),
ended AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
pairs AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair, i > 1 AS later FROM priced),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE later AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c.c0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = 1
"""

STATEMENTS = {"op11_maximal_repeats": OP11, "op12_conversation_repair": OP12, "op13_spelling_variants": OP13}
