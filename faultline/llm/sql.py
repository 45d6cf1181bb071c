"""DuckDB SQL for the operators that SQL can express."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUPS = " || ".join(f"substr('{_BASE32}', (('0x' || substr(h, {5 * g + 1}, 5))::INT // {32 ** (3 - k)}) % 32 + 1, 1)" for g in range(8) for k in range(4))

SQL: dict[str, str] = {
    "op1_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id FROM pages)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM p""",
    "op8_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p FROM t WHERE len(w) >= 20),
k AS (SELECT s.doc_id, p, sha256(array_to_string(list_slice(w, p, p + 19), ' ')) AS win FROM s JOIN t USING (doc_id)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM f WHERE again),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
r AS (SELECT t.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM t LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256 FROM r""",
}

#: CRC-32 of a number's decimal digits, by the table that its polynomial gives.
_CRC = """tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab)"""

SQL |= {
    "op11_prefix_trie": f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS place, k, length(text) AS chars FROM t),
b AS (SELECT c.conv_id, o.place, k, chars FROM crc c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.place < h
      UNION ALL SELECT conv_id, place, k, chars FROM o JOIN crc c USING (conv_id) WHERE place >= h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, k, chars FROM b),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS pk, 0::BIGINT AS chars FROM crc
      UNION ALL SELECT p.conv_id, r.depth, sha256(pk || k), r.chars FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (SELECT min(conv_id) AS conv_id, depth, pk, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256 FROM p JOIN l USING (conv_id) GROUP BY depth, pk),
u AS (SELECT n.*, m.conv_id AS parent_conv_id, m.pk AS parent_pk FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n m ON m.depth = p.depth AND m.pk = p.pk),
k AS (SELECT depth - 1 AS depth, parent_pk AS pk, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (depth, pk)),
s AS (SELECT a.depth, a.pk, sum(w.saved)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM w JOIN s USING (depth, pk)""",
    "op12_url_filters": """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT i, page_id, regexp_extract(rest, '^[^/?#]*') AS own, rest FROM r),
u AS (SELECT i, page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path FROM s),
b AS (SELECT i, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (i)""",
}
