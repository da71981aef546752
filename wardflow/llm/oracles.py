"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from wardflow.llm.quality_rules import STOP_WORDS

#: Systematic sampling: the same order, rates and offsets as the operator.
OP4 = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
           FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
             2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM w),
r AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
l AS (SELECT min(k) AS k FROM r WHERE cap * ws > w * rest),
t AS (SELECT r.*, CASE WHEN l.k IS NULL OR r.k < l.k THEN r.cap
                       ELSE r.w * (SELECT x.rest / x.ws FROM r x WHERE x.k = l.k) END AS target,
             ('0x' || substr(md5('mix-1|' || coalesce('s:' || source, 'null')), 1, 6))::INT::DOUBLE / 16777216 AS u
      FROM r, l),
n AS (SELECT d.*, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rnk
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       ((floor(u + rnk * rate) - floor(u + (rnk - 1) * rate)) * size)::BIGINT AS taken
FROM n
"""


#: Trees by recursion; the checksum's lowest bit, bit by bit, says which texts were changed.
OP12 = r"""
WITH RECURSIVE crc(doc_id, bits, c) AS (
  SELECT DISTINCT doc_id, 8 * length(doc_id::VARCHAR), 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, bits - 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT doc_id, bits, CASE WHEN bits % 8 = 0
               THEN xor(c, ascii(substr(doc_id::VARCHAR, length(doc_id::VARCHAR) - bits // 8 + 1, 1))::BIGINT) ELSE c END AS x
        FROM crc WHERE bits > 0)),
touched AS (SELECT doc_id FROM crc WHERE bits = 0 AND xor(c, 4294967295) % 2 = 0),
d AS (SELECT *, doc_id IN (SELECT doc_id FROM touched) AS hit FROM documents),
f AS (SELECT doc_id, source,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS later FROM d),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                  sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS later FROM f),
place AS (SELECT *, coalesce('=' || source, '') AS tree, count(*) OVER (PARTITION BY source) AS n,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low(tree, k, n, idx, h, l, r) AS (
  SELECT tree, 0, n, idx, leaf, '', '' FROM place
  UNION ALL
  SELECT tree, k + 1, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), '', ''
  FROM low WHERE n > 1 GROUP BY tree, k, n, idx // 3),
up(tree, k, n, idx, h) AS (
  SELECT tree, 0, count(*) OVER (), row_number() OVER (ORDER BY tree) - 1, h FROM low WHERE n = 1
  UNION ALL
  SELECT min(tree), k + 1, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM up WHERE n > 1 GROUP BY k, n, idx // 3),
tops AS (SELECT row_number() OVER (ORDER BY tree) - 1 AS place, tree, h FROM low WHERE n = 1),
steps AS (
  SELECT p.doc_id, p.idx AS leaf_idx, p.tree, a.k, a.idx AS own, s.idx AS spot, s.h
  FROM place p JOIN low a ON a.tree = p.tree AND a.n > 1 AND a.idx = p.idx // pow(3, a.k)::BIGINT
  JOIN low s ON s.tree = a.tree AND s.k = a.k AND s.idx // 3 = a.idx // 3
  UNION ALL
  SELECT p.doc_id, p.idx, p.tree, 1000 + a.k, a.idx, s.idx, s.h
  FROM place p JOIN tops t ON t.tree = p.tree JOIN up a ON a.n > 1 AND a.idx = t.place // pow(3, a.k)::BIGINT
  JOIN up s ON s.k = a.k AND s.idx // 3 = a.idx // 3),
sides AS (SELECT tree, leaf_idx, k, coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS l,
                 coalesce(string_agg(h, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS r
          FROM steps GROUP BY tree, leaf_idx, k),
runs AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_idx ORDER BY k) AS step FROM sides),
folds(tree, idx, step, h) AS (
  SELECT tree, idx, 0, later FROM place
  UNION ALL
  SELECT x.tree, x.idx, x.step + 1, sha256(r.l || x.h || r.r)
  FROM folds x JOIN runs r ON r.tree = x.tree AND r.leaf_idx = x.idx AND r.step = x.step + 1),
last AS (SELECT tree, idx, arg_max(h, step) AS folded FROM folds GROUP BY tree, idx),
proofs AS (SELECT tree, leaf_idx, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM sides GROUP BY tree, leaf_idx)
SELECT p.doc_id, p.leaf, t.h AS subroot, u.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       last.folded AS folded_root, last.folded = u.h AS verified
FROM place p JOIN tops t ON t.tree = p.tree JOIN up u ON u.n = 1 JOIN last ON last.tree = p.tree AND last.idx = p.idx
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_idx = p.idx
"""

#: Every anchor against every row, without an index.
OP13 = r"""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT vec_id FROM x WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, floor(256 * x) AS x FROM x WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, sum(a.x * b.x)::BIGINT AS score
      FROM v a JOIN v b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
m AS (SELECT s.*, p.label = q.label AS same FROM s JOIN r p ON p.vec_id = s.anchor JOIN r q ON q.vec_id = s.other),
pos AS (SELECT anchor, other, score FROM m WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
neg AS (SELECT pos.anchor, pos.other AS positive, pos.score AS ps, m.other, m.score,
               row_number() OVER (PARTITION BY pos.anchor, pos.other ORDER BY m.score DESC, m.other) AS rank
        FROM pos JOIN m ON m.anchor = pos.anchor AND NOT m.same AND 30 * pos.score <= 100 * m.score
                           AND 100 * m.score <= 90 * pos.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, other AS negative_id,
       ps AS positive_score, score AS negative_score
FROM neg WHERE rank <= 10
"""


#: Measures by words, 8-word windows and lines, then the threshold table.
OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
x AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before,
             string_agg(w, ' ') OVER f AS k, count(*) OVER f AS long
      FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (SELECT doc_id, i FROM x WHERE long = 8 QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(8) r(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS kinds
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
             count(*) FILTER (WHERE lower(w) IN (STOP)) AS n_stop, count(*) FILTER (WHERE w = before) AS n_stutter
      FROM x GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(m.n_words, 0)::BIGINT AS n_words, coalesce(m.word_chars, 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(l.n - l.kinds, 0)::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
             coalesce(l.n, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop, coalesce(n_stutter, 0) AS n_stutter,
             strlen(t) <= 1.5 * length(t) AS latin
      FROM d LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN inside USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / word_chars <= 0.05
       AND (NOT latin OR n_stop / n_words >= 0.02) AND n_dup_lines / n_lines <= 0.6 AND n_stutter / n_words <= 0.3
       AND n_repeat_words / n_words <= 0.3 AS kept
FROM b
""".replace("STOP", ", ".join(f"'{w}'" for w in STOP_WORDS))

#: Every window of every item against every run of as many words of every document.
OP7 = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT DISTINCT item, m, array_to_string(list_slice(ws, i::BIGINT, (i + m - 1)::BIGINT), ' ') AS k
       FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i::BIGINT, (i + m - 1)::BIGINT), ' ') AS k
       FROM (SELECT doc_id, ws, s.m, unnest(range(1, len(ws) - s.m + 2)) AS i
             FROM d, (SELECT DISTINCT m FROM bw) s WHERE len(ws) >= s.m)),
hit AS (SELECT DISTINCT doc_id, dw.m, i, item FROM dw JOIN bw ON bw.m = dw.m AND bw.k = dw.k),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, m, i FROM hit), range(10) r(j) WHERE j < m GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names.t, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id
"""

#: All pairs that share a shingle, and what is reachable from each document.
OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
                            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
                     FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, c.low = d.doc_id AS kept
FROM d JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4, "op5_quality_rules": OP5, "op7_decontamination": OP7, "op8_near_dedup": OP8,
            "op12_merkle_manifest": OP12, "op13_hard_negatives": OP13}
