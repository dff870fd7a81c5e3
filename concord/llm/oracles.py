"""DuckDB SQL with the results of the registered queries."""

SQL = {}

SQL["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL["op5_rule_ledger"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM words, unnest(generate_series(1, len(w) - 4)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest(generate_series(0, 4)) AS u(k) GROUP BY doc_id),
m AS (SELECT words.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_bangs,
  len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i-1])) AS n_echoes
  FROM words LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
  + 4 * (n_symbols / greatest(n_words, 1) > 0.25::DOUBLE)::BIGINT
  + 8 * (n_dup_lines >= 2 AND n_dup_lines / greatest(n_lines, 1) > 0.3::DOUBLE)::BIGINT
  + 16 * (word_chars / greatest(n_words, 1) > 14)::BIGINT
  + 32 * (word_chars / greatest(n_words, 1) < 2.2::DOUBLE AND n_words > 0)::BIGINT
  + 64 * (n_upper / greatest(n_letters, 1) > 0.4::DOUBLE)::BIGINT
  + 128 * (n_bangs / greatest(n_words, 1) > 0.5::DOUBLE)::BIGINT
  + 256 * (n_letters / greatest(word_chars, 1) < 0.5::DOUBLE)::BIGINT
  + 512 * (n_echoes / greatest(n_words, 1) > 0.3::DOUBLE)::BIGINT AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits FROM b
"""

SQL["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!0123456789', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS weight,
  (('0x' || substr(sha256('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370498.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM k GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, (ratio, -level)) FROM f WHERE level <= ratio), cap)) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
q AS (SELECT *, round(target - epochs * source_size) AS rest FROM p),
run AS (SELECT k.*, q.source_size, q.target, q.epochs, q.rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
g AS (SELECT source AS gs, any_value(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS gap FROM run GROUP BY source),
c AS (SELECT source AS cs, arg_min(doc_id, (abs(size - gap), key, doc_id)) AS closing FROM run JOIN g ON source IS NOT DISTINCT FROM gs
  WHERE upto > rest AND rest > 0 AND size < 2 * gap GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR doc_id IS NOT DISTINCT FROM closing AND closing IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run LEFT JOIN c ON source IS NOT DISTINCT FROM cs
"""

SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.other) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON d.doc_id = reach.doc_id GROUP BY ALL
"""

SQL["op2_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
full_lines AS (SELECT doc_id, i - 1 AS i, trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM d, unnest(generate_series(1, len(lines))) AS u(i)
  WHERE trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
win AS (SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS g FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) AS k FROM win WHERE b IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(generate_series(a, b)) AS u(p)),
runs AS (SELECT doc_id, min(p) AS s, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM gone) GROUP BY doc_id, grp),
spans AS (SELECT doc_id, sum(e - s + 1)::BIGINT AS n_removed, string_agg(s || '-' || e, ',' ORDER BY s) AS removed FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(lines[i], chr(10) ORDER BY i) AS t FROM d JOIN spans USING (doc_id), unnest(generate_series(1, len(lines))) AS u(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND p = i - 1) GROUP BY d.doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce((SELECT count(*) FROM later WHERE later.doc_id = d.doc_id), 0) AS n_repeated,
  coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, md5(CASE WHEN spans.doc_id IS NULL THEN d.t ELSE coalesce(kept.t, '') END) AS text_md5
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""



def _ablation_sql() -> str:
    from . import rules

    listed = ", ".join(f"('{p}', {rules.mask(p)}, '{x}', {rules.BIT[x]})" for p, names in rules.POLICIES.items() for x in names)
    return f"""SELECT policy, rule, count(*) FILTER (WHERE bits & bit <> 0) AS fails, count(*) FILTER (WHERE bits & mask = bit) AS fails_alone, count(*) FILTER (WHERE bits & mask & ~bit = 0) AS kept_without
FROM ({SQL['op5_rule_ledger']}) l, (VALUES {listed}) r(policy, mask, rule, bit) GROUP BY policy, rule"""


SQL["rule_ablation"] = _ablation_sql()

SQL["op11_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first,
  CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role) END AS label,
  length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?turn>'))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN first THEN 4 + label + 2 + 8 ELSE 6 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _codes_sql(rounds: int = 4) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (s, entry)) AS entry, min(s) AS s FROM
  (SELECT p.vec_id, p.part, b.entry, sum((p.x - b.y) * (p.x - b.y))::BIGINT AS s FROM p JOIN b{i} b ON p.part = b.part AND p.d = b.d GROUP BY ALL) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT a.part, a.entry, p.d, sum(p.x)::BIGINT AS s, count(*) AS c FROM a{i} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.d, CASE WHEN c IS NULL THEN y ELSE (s - ((s % c + c) % c)) // c END AS y FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry AND b.d = m.d)""")
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, (d - 1) // w AS part, (d - 1) % w AS d, x FROM (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d, len(x) // 4 AS w FROM v)),
b0 AS MATERIALIZED (SELECT p.part, k.entry, p.d, p.x AS y FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) k JOIN p ON p.vec_id = k.vec_id WHERE entry < 256),
{', '.join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(s)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT e.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y, ',' ORDER BY part, entry, d)) FROM b{rounds}) AS codebooks_sha256
FROM e JOIN v ON e.vec_id = v.vec_id"""


SQL["op12_vector_codes"] = _codes_sql()
