"""DuckDB SQL of the training-data queries that SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, n: int) -> str:
    words = _WORDS.format(_FOLD)
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {key}, {words} AS w FROM {table}))"""


ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM d, unnest(range(1, length(h) // 2 - 48)) AS t(i) WHERE length(h) >= 100),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
dup AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN m USING (s) WHERE m.low < w.doc_id),
part AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM dup),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM part GROUP BY doc_id, k),
piece AS (
  SELECT doc_id, a AS pos, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since, a AS until, z - a AS gone, 1 AS spans FROM span
  UNION ALL
  SELECT d.doc_id, 1e15, coalesce(max(span.z), 1), max(length(d.h)) // 2 + 1, 0, 0 FROM d LEFT JOIN span ON span.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT p.doc_id, max(length(d.h)) // 2 AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(spans) AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(substr(d.h, CAST(2 * since - 1 AS BIGINT), CAST(2 * (until - since) AS BIGINT)), '' ORDER BY pos))) AS kept_sha256
FROM piece p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id""",
    "op4_ngram_jaccard_join": f"""
WITH RECURSIVE s AS MATERIALIZED {_shingles("documents", "doc_id", 3)},
n AS MATERIALIZED (SELECT doc_id, count(s.s) AS k FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.s = r.s AND l.doc_id <> r.doc_id GROUP BY l.doc_id, r.doc_id) x
  JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * c >= 90 * (p.k + q.k - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT n.doc_id, n.k AS n_shingles, min(reach.other) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.k""",
    "op8_benchmark_decontamination": f"""
WITH d AS {_shingles("documents", "doc_id", 5)}, b AS {_shingles("benchmark", "item_id", 5)},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b ON d.s = b.s GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item""",
    "op5_arc_to_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS low FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND low < page_id THEN low END AS refers_to FROM m""",
    "op10_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels GROUP BY doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2 AS stop FROM s),
r AS (SELECT *, stop / w AS ratio, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS every, sum(w) OVER () AS every_w FROM o),
v AS (SELECT *, (every - coalesce(CAST(sum(stop) OVER b AS BIGINT), 0)) / (every_w - coalesce(sum(w) OVER b, 0)) AS lev FROM r
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, ratio) AS level FROM v WHERE lev <= ratio),
t AS (SELECT source, source_size, least(coalesce(level * w, stop), CAST(stop AS DOUBLE)) AS target FROM v LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(round(e.target - e.epochs * e.source_size) AS BIGINT) AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / coalesce(l.w, 0.5), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(rest - ahead, 0), size) AS BIGINT) AS taken FROM k""",
    "op12_merkle_manifest": """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, CASE WHEN bad THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS probe, text,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS head
  FROM (SELECT *, xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, k: list_reduce(range(0, 8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, CAST(ord(k) AS BIGINT))), 4294967295),
    4294967295) % 3 = 0 AS bad FROM documents)),
leaves AS MATERIALIZED (
  SELECT doc_id, g, leaf, probe, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, g, sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(head, '') || coalesce(octet_length(encode(probe)) || ':' || probe, '-')) AS probe FROM d)),
low AS (
  SELECT g, CAST(0 AS BIGINT) AS level, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT g, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY g, level, pos // 8, n),
sub AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT CAST(0 AS BIGINT) AS level, pos, h, n FROM sub
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
beside AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT g, level, pos, h FROM low WHERE n > 1 UNION ALL SELECT '/', level, pos, h FROM top WHERE n > 1)),
step AS MATERIALIZED (
  SELECT doc_id, l, r, row_number() OVER (PARTITION BY doc_id ORDER BY up, level) AS k FROM (
    SELECT doc_id, 0 AS up, level, l, r FROM leaves JOIN beside ON beside.g = leaves.g AND beside.pos = leaves.pos // CAST(8 ** level AS BIGINT)
    UNION ALL SELECT doc_id, 1, level, l, r FROM leaves JOIN sub ON sub.g = leaves.g JOIN beside ON beside.g = '/' AND beside.pos = sub.pos // CAST(8 ** level AS BIGINT))),
fold AS (SELECT doc_id, CAST(1 AS BIGINT) AS k, probe AS h FROM leaves UNION ALL SELECT fold.doc_id, fold.k + 1, sha256(l || h || r) FROM fold JOIN step ON step.doc_id = fold.doc_id AND step.k = fold.k),
done AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM step GROUP BY doc_id)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM leaves JOIN sub ON sub.g = leaves.g CROSS JOIN (SELECT h FROM top WHERE n = 1) AS top JOIN done USING (doc_id) LEFT JOIN proof USING (doc_id)""",
}
