"""Queries of the corpus operators, with their check SQL where SQL can express them."""

from __future__ import annotations

from kinfold.llm import (
    chat, decontaminate, fingerprint, line_dedup, merkle, near_dedup, packing, quality, repeats, rules, search, token_output, tokens,
)
from kinfold.llm.common import table


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.x, r.z FROM r JOIN e ON e.y = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(z) AS component_id,
  r.doc_id = min(z) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def op3_quality_rules(spark, sf_dir):
    return rules.score_rules(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS g FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM h),
p AS (SELECT DISTINCT doc_id, i + j AS i FROM d, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
ls AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
lw AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM ls
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lw.again, 0) AS n_dup_lines,
    coalesce(lw.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[a-z]')) AS lower
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN lw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * upper > 40 * (upper + lower)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


def op6_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
m AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM m WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
g AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, q.item_id FROM g JOIN q ON g.g = q.g AND g.n = q.n),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_output(spark, sf_dir):
    return token_output.packed_matrices(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.unionByName(chat.planted(spark)))


OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT conv_id, turn, r, t,
    contains(r || t, '</turn>') OR contains(t, '### ') OR contains(r, '### ') OR contains(r, ': ')
      OR contains(t, '\\\\') OR contains(t, '<\\/turn>') OR contains(t, '#\\## ') OR contains(r, '\\') AS clash,
    replace(replace(replace(t, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ') AS te,
    replace(replace(replace(replace(r, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## '), ': ', ':\\ ') AS re
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + CASE WHEN clash THEN length(re) + length(te) ELSE length(r) + length(t) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("\\\\", "\\")


def op2_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeated_strings(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
z AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
p AS (
  SELECT row, doc_id, m, term, count(*) AS tf FROM (
    SELECT row, doc_id, 75 + (25 * len(ws) * z.n) // z.l AS m, unnest(ws) AS term FROM d, z WHERE len(ws) > 0) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * z.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, z.n),
q AS (SELECT item_id, text, unnest(ws) AS term FROM i),
s AS (
  SELECT item_id, text, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def op12_merkle_manifest(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


OP12 = r"""
WITH RECURSIVE l AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
d AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || low, '-')) AS other FROM l),
p AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
bits AS (SELECT doc_id, unnest(range(8 * strlen(doc_id::VARCHAR))) AS b, doc_id::VARCHAR AS s FROM (SELECT DISTINCT doc_id FROM d)),
crc(doc_id, s, k, c) AS (
  SELECT DISTINCT doc_id, s, 0, 4294967295::BIGINT FROM bits
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (
    SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * strlen(s))),
hit AS (SELECT doc_id FROM crc WHERE k = 8 * strlen(s) AND xor(c, 4294967295) % 3 = 0),
runs(g, lvl, run, n, hs) AS (
  SELECT g, 0, i // 8, n, list(leaf ORDER BY i) FROM p GROUP BY g, i // 8, n
  UNION ALL
  SELECT g, lvl + 1, run // 8, (n + 7) // 8, list(sha256(array_to_string(hs, '')) ORDER BY run) FROM runs
  WHERE n > 8 GROUP BY g, lvl, run // 8, n),
subs AS (SELECT g, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM runs WHERE n <= 8),
tops(lvl, run, n, hs) AS (
  SELECT 0, g // 8, (SELECT count(*) FROM subs), list(h ORDER BY g) FROM subs GROUP BY g // 8
  UNION ALL
  SELECT lvl + 1, run // 8, (n + 7) // 8, list(sha256(array_to_string(hs, '')) ORDER BY run) FROM tops
  WHERE n > 8 GROUP BY lvl, run // 8, n),
root AS (SELECT CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM tops WHERE n <= 8),
walk(id, g, top, lvl, i, n, acc, sib) AS (
  SELECT row_number() OVER (), g, false, 0, i, n, CASE WHEN doc_id IN (FROM hit) THEN other ELSE leaf END, '' FROM p
  UNION ALL
  SELECT id, g, top OR n = 1, CASE WHEN n = 1 THEN 0 ELSE lvl + 1 END, CASE WHEN n = 1 THEN g ELSE i // 8 END,
    CASE WHEN n = 1 THEN trees ELSE (n + 7) // 8 END,
    CASE WHEN n = 1 THEN acc ELSE sha256(array_to_string(hs[:i % 8], '') || acc || array_to_string(hs[i % 8 + 2:], '')) END,
    CASE WHEN n = 1 THEN sib ELSE sib || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') END
  FROM (
    SELECT w.*, coalesce(r.hs, t.hs) AS hs, (SELECT count(*) FROM subs) AS trees FROM walk w
    LEFT JOIN runs r ON NOT top AND r.g = w.g AND r.lvl = w.lvl AND r.run = w.i // 8
    LEFT JOIN tops t ON top AND t.lvl = w.lvl AND t.run = w.i // 8
    WHERE w.n > 1 OR NOT top)),
q AS (SELECT row_number() OVER () AS id, * FROM p)
SELECT q.doc_id, q.leaf, s.h AS subroot, root.h AS root, sha256(w.sib) AS proof_sha256, CAST(strlen(w.sib) // 64 AS INT) AS n_siblings,
  w.acc AS folded_root, w.acc = root.h AS verified
FROM walk w JOIN q USING (id) JOIN subs s ON s.g = w.g, root WHERE w.top AND w.n = 1
"""


def op13_document_fingerprints(spark, sf_dir):
    return fingerprint.report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op11_ranked_search": (op11_ranked_search, OP11),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12),
    "op13_document_fingerprints": (op13_document_fingerprints, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op7_repeated_strings": (op7_repeated_strings, None),
    "op10_line_dedup": (op10_line_dedup, None),
    "op1_near_dedup": (op1_near_dedup, OP1),
    "op3_quality_rules": (op3_quality_rules, OP3),
    "op6_decontamination": (op6_decontamination, OP6),
    "op4_token_counts": (op4_token_counts, None),
    "op5_best_fit_packing": (op5_best_fit_packing, None),
    "op8_token_output": (op8_token_output, None),
    "op9_chat_formatting": (op9_chat_formatting, OP9),
}
