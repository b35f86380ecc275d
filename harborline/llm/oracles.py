"""SQL for the rows of the registered queries, written from the results' definitions."""

from harborline.llm import licenses

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null'))[1:12] AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM sized GROUP BY source),
-- the level is the largest of (words left) / (weights left) over all sets of sources that fill up first
filled AS (
  SELECT sum(3 * s) OVER o AS c, sum(w) OVER o AS cw FROM sources
  WINDOW o AS (ORDER BY 3.0 * s / w, source NULLS LAST)),
level AS (
  SELECT max((t - c)::DOUBLE / (tw - cw)) AS l
  FROM (SELECT c, cw FROM filled UNION ALL SELECT 0, 0),
       (SELECT sum(s) AS t, sum(w) AS tw FROM sources)
  WHERE tw > cw),
planned AS (
  SELECT source, s, least((3 * s)::DOUBLE, l * w) AS target FROM sources, level),
split AS (
  SELECT source, s, target, least(floor(target / greatest(s, 1)), 3)::BIGINT AS copies,
         round(target)::BIGINT - least(floor(target / greatest(s, 1)), 3)::BIGINT * s AS rest
  FROM planned),
units AS (
  SELECT source, hash, sum(size) AS unit,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS after
  FROM sized GROUP BY source, hash)
SELECT d.doc_id, d.size, p.s AS source_size, p.target,
       (d.size * (p.copies + CASE WHEN u.after <= p.rest OR 2 * (u.after - u.unit) + u.unit <= 2 * p.rest
                                  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d
JOIN split p ON p.source IS NOT DISTINCT FROM d.source
JOIN units u ON u.source IS NOT DISTINCT FROM d.source AND u.hash = d.hash
"""

HOST_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
numbered AS (SELECT *, row_number() OVER () AS r FROM counted),
grams AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM numbered WHERE len(ws) >= 3),
found AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM grams),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
stats AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (r)),
failing AS (
  SELECT *, row_number() OVER () AS r,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [word_chars < 3 * n_words OR word_chars > 12 * n_words,
          10 * n_symbols > n_words,
          100 * n_dup_lines > 30 * n_lines,
          100 * n_repeat_words > 20 * n_words] AS fails
  FROM stats),
by_rule AS (SELECT r, source, unnest(range(1, 5)) AS rule, unnest(fails) AS failed FROM failing),
hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT)::DOUBLE AS f FROM by_rule GROUP BY source, rule),
prior AS (
  SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 AS v
  FROM hosts GROUP BY rule),
weighed AS (
  SELECT rule, m, v, CASE WHEN v <= 0 THEN 1e6 ELSE least(greatest(m * (1 - m) / v - 1, 1), 1e6) END AS w FROM prior),
rated AS (SELECT *, (f + m * w) / (n + w) AS rate FROM hosts JOIN weighed USING (rule)),
bad AS (
  SELECT source, rule FROM rated
  WHERE v > 0 AND rate > m AND (rate - m) / sqrt(rate * (1 - rate) / (n + (w + 1))) > 1.0),
held AS (
  SELECT DISTINCT r FROM by_rule b JOIN bad ON bad.rule = b.rule AND bad.source IS NOT DISTINCT FROM b.source
  WHERE b.failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND held.r IS NULL AS kept
FROM failing LEFT JOIN held USING (r)
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS pos, role, text FROM conversations),
whole AS (
  SELECT conv_id, list({'p': pos, 'r': role, 'x': text} ORDER BY pos, role, text) AS said
  FROM turns GROUP BY conv_id),
different AS (SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY said),
maximal AS (
  SELECT conv_id, copies FROM different d WHERE NOT EXISTS (
    SELECT 1 FROM different o
    WHERE o.said[1] = d.said[1] AND len(o.said) > len(d.said) AND o.said[1:len(d.said)] = d.said)),
shown AS (
  SELECT conv_id, copies, pos, greatest(floor(pos / 64), 0)::BIGINT AS part, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM turns JOIN maximal USING (conv_id))
SELECT conv_id, part, copies, count(*) AS n_turns,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS trained_chars,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos, role, text) AS text
FROM shown GROUP BY conv_id, part, copies
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM d),
judged AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS mask
  FROM counted),
labelled AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM judged LEFT JOIN labelled USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
met AS (
  SELECT part, filter_order, step, mask, n, good, toxic,
         contains(mask, filter_order[step]) AS fails,
         coalesce(list_min([strpos(filter_order, x) for x in string_split(mask, '') if x <> '']), 9) AS gone_at
  FROM masks, steps),
totals AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (gone_at > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone_at = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone_at < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = filter_order[step]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone_at = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (gone_at = step), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM totals
"""


def _license_scan() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(
        f"({quoted(licenses._words_of(p))}, '{label}')" for p, label in licenses.PHRASES.items()
    )
    templates = ", ".join(
        f"({i}, '{label}', {licenses.block_step(len(ws))}, {quoted(dict.fromkeys(ws))})"
        for i, (label, ws) in enumerate((label, licenses._words_of(t)) for label, t in licenses.TEMPLATES)
    )
    return rf"""
WITH phrases(p, label) AS (VALUES {phrases}),
templates(template, label, step, own) AS (VALUES {templates}),
split AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
placed AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM split),
heads AS (SELECT r, i, p, label FROM placed JOIN phrases ON p[1] = w),
places AS (
  SELECT h.r, i, label FROM heads h JOIN split s USING (r) WHERE s.ws[i + 1 : i + len(p)] = p),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list(DISTINCT label) AS labels FROM places GROUP BY r),
words AS (SELECT template, label, step, len(own) AS size, unnest(own) AS w FROM templates),
shares AS (
  SELECT r, template, label, size, (i // step) - back AS block, count(DISTINCT w) AS shared
  FROM placed JOIN words USING (w), (SELECT unnest([0, 1]) AS back)
  WHERE (i // step) - back >= 0 GROUP BY ALL),
found AS (
  SELECT r, list(DISTINCT label) AS labels, max(shared::DOUBLE / size) AS best
  FROM shares WHERE 100 * shared >= {licenses.THRESHOLD} * size GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM split LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)
"""


ORACLE = {
    "op1_mixing": MIXING,
    "op2_chat_format": CHAT_FORMAT,
    "op3_host_rules": HOST_RULES,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_license_scan": _license_scan(),
}
