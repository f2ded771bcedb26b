"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

# Boilerplate lines by exact distinct sites, in place of sketches.
LINE_DEDUP = r"""
WITH parts AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), lines AS (
    SELECT *, trim(part, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM parts
), candidates AS (
    SELECT * FROM lines WHERE line <> ''
), shared AS (
    SELECT line, min((doc_id, pos)) AS home FROM candidates
    GROUP BY line HAVING count(DISTINCT coalesce('+' || source, '-')) >= 5
), marked AS (
    SELECT l.doc_id, l.pos, l.part, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.home AS gone
    FROM lines l LEFT JOIN shared s ON l.line = s.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
    count(*) FILTER (gone) > 0 AND trim(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone), ''),
        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS emptied,
    coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit; null for null."""
    bits = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda crc, b: {bits}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


# Trees level by level; a proof is read off the levels.
MERKLE = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('+' || lang, '-') AS g, n_chars, {_crc32("doc_id::VARCHAR")} AS crc,
        {' || '.join(map(_field, ('doc_id', 'source', 'lang')))} AS head, {_field('text')} AS tail, {_field('n_chars')} AS chars,
        {_field('(n_chars::HUGEINT + 1)')} AS more
    FROM documents
), leaves AS (
    SELECT doc_id, g, sha256(head || chars || tail) AS leaf,
        CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || more || tail) END AS tampered
    FROM docs
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves
), lower_tree AS (
    SELECT g, 0 AS l, i, n AS m, leaf AS h FROM placed
    UNION ALL
    SELECT g, l + 1, i // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM lower_tree WHERE m > 1 GROUP BY g, l, i // 2
), subroots AS (
    SELECT g, h, row_number() OVER (ORDER BY g = '-' DESC, encode(g)) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE m = 1
), upper_tree AS (
    SELECT 0 AS l, i, n AS m, h FROM subroots
    UNION ALL
    SELECT l + 1, i // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE m > 1 GROUP BY l, i // 2
), steps AS (
    SELECT p.g, p.i, t.l, (p.i >> t.l) & 1 AS odd, s.h AS sib
    FROM placed p JOIN lower_tree t ON t.g = p.g AND t.i = p.i >> t.l AND t.m > 1
    LEFT JOIN lower_tree s ON s.g = p.g AND s.l = t.l AND s.i = xor(p.i >> t.l, 1)
    UNION ALL
    SELECT p.g, p.i, d.depth + t.l, (r.i >> t.l) & 1, s.h
    FROM placed p JOIN subroots r ON r.g = p.g JOIN (SELECT g, max(l) AS depth FROM lower_tree GROUP BY g) d ON d.g = p.g
    JOIN upper_tree t ON t.i = r.i >> t.l AND t.m > 1
    LEFT JOIN upper_tree s ON s.l = t.l AND s.i = xor(r.i >> t.l, 1)
), proof AS (
    SELECT g, i, sha256(coalesce(string_agg(sib, '' ORDER BY l), '')) AS proof_sha256 FROM steps GROUP BY g, i
), fold AS (
    SELECT g, i, 0 AS l, coalesce(tampered, leaf) AS h FROM placed
    UNION ALL
    SELECT f.g, f.i, f.l + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.sib, '') || f.h ELSE f.h || coalesce(s.sib, '') END)
    FROM fold f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.l = f.l
), ends AS (SELECT g, i, arg_max(h, l) AS folded_root FROM fold GROUP BY g, i),
top AS (SELECT h AS root FROM upper_tree WHERE m = 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, top.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM placed p JOIN subroots r ON r.g = p.g JOIN ends e ON e.g = p.g AND e.i = p.i LEFT JOIN proof f ON f.g = p.g AND f.i = p.i, top
"""

# A node is the concatenated MD5 of its turns; subtrees are found from the prefixes of every node.
TRIE = f"""
WITH own AS (
    SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, length(coalesce(text, '')) AS chars, turn
    FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS p FROM own
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
    SELECT c.conv_id, p.p, 0 AS part, p.m, p.chars FROM convs c JOIN placed p ON p.conv_id = c.base AND p.p < c.h
    UNION ALL
    SELECT c.conv_id, p.p, 1, p.m, p.chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.p >= c.h
), prefixes AS (
    SELECT conv_id, chars, string_agg(m, '') OVER o AS k, row_number() OVER o AS d,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, p ROWS UNBOUNDED PRECEDING)
    UNION ALL
    SELECT conv_id, 0, '', 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM prefixes GROUP BY k, d
), kids AS (SELECT left(k, 32 * (d::INT - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
kept AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM nodes n LEFT JOIN kids c ON c.k = n.k
), up AS (SELECT left(k, 32 * unnest(range(d::INT + 1))::INT) AS over, n_children, saved FROM kept),
sums AS (SELECT over, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY over)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM kept k JOIN sums s ON s.over = k.k LEFT JOIN nodes p ON p.d = k.d - 1 AND p.k = left(k.k, 32 * (k.d::INT - 1))
"""


def _classes(n: int, last: str = "") -> str:
    """Near-duplicates by joining shingles; equal sets are one node, components by spreading the least node."""
    return rf"""
WITH RECURSIVE words AS (
    SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
    FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), sets AS (
    SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, least(len(w), 1)) + 1),
        lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) AS s
    FROM words
), nodes AS (
    SELECT s, min(r) AS node, min(doc_id) AS least_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (SELECT node, n, unnest(s) AS t FROM nodes),
links AS (
    SELECT a.node AS u, b.node AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT node, node AS other FROM nodes
    UNION
    SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other
), classes AS (
    SELECT r.node, min(o.least_id) AS component_id FROM reach r JOIN nodes o ON o.node = r.other GROUP BY r.node
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) > 0 THEN c.component_id ELSE d.doc_id END AS component_id{last}
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN classes c ON c.node = n.node
"""


NEAR_DEDUP = _classes(3, ", d.doc_id IS NOT DISTINCT FROM CASE WHEN len(d.s) > 0 THEN c.component_id ELSE d.doc_id END AS kept")
JACCARD_JOIN = _classes(4)


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": LINE_DEDUP, "op9_near_dedup": NEAR_DEDUP, "op11_merkle_manifest": MERKLE, "op12_prefix_trie": TRIE,
        "op13_ngram_jaccard_join": JACCARD_JOIN,
    }
