"""DuckDB SQL of the queries that SQL can express, with its own constants."""

from __future__ import annotations

_SPANS = """
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum([length(x) for x in p[1:i - 1]]) AS a,
         length(p[i]) + length(p[i + 1]) AS n
  FROM (SELECT doc_id, p, unnest(generate_series(2, len(p) - 1, 3)) AS i
        FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}',
                       chr(1) || '{head}' || chr(1) || '{value}' || chr(1), 'g'), chr(1)) AS p FROM texts))
  WHERE length(p[i + 1]) >= {least}"""

_KINDS = [
    (
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])([\"'']?[ ]*[:=][ ]*[\"'']?)([A-Za-z0-9+/_.=-]+)",
        r"\1\2",
        r"\3",
        6,
    ),
    ("access", "(AKIA)([A-Z0-9]+)", r"\1", r"\2", 16),
    ("hex", "([0-9a-f]+)", "", r"\1", 24),
]


def _spans() -> str:
    return " UNION ALL ".join(
        _SPANS.format(rank=rank, kind=kind, pattern=pattern, head=head, value=value, least=least)
        for rank, (kind, pattern, head, value, least) in enumerate(_KINDS)
    )


SECRETS = f"""
WITH texts AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(3)) AS t FROM documents),
spans AS ({_spans()}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""

LINES = """
WITH lines AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_CRC = """xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT for i in range(8)]),
    lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""

_RAISE = """
  SELECT tree, 0 AS level, idx, n, {digest} AS h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM {nodes} WHERE n > 1 GROUP BY tree, level, idx // 8"""

# sides of each leaf's siblings at each level below the root
_SIDES = """
  SELECT l.tree, l.idx, s.level, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < l.idx // 8 ** s.level), '') AS a,
         coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > l.idx // 8 ** s.level), '') AS b
  FROM {leaves} l JOIN {nodes} s
    ON s.tree = l.tree AND s.n > 1 AND s.idx // 8 = (l.idx // (8 ** s.level)::BIGINT) // 8
  GROUP BY ALL"""


def _sides(leaves: str, nodes: str) -> str:
    return _SIDES.format(leaves=leaves, nodes=nodes).replace("l.idx // 8 ** s.level", "l.idx // (8 ** s.level)::BIGINT")


MANIFEST = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              END AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n FROM own),
nodes AS ({_RAISE.format(digest="leaf", leaves="leaves", nodes="nodes")}),
groups AS (
  SELECT 'top' AS tree, tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS ({_RAISE.format(digest="subroot", leaves="groups", nodes="tops")}),
sides AS ({_sides("leaves", "nodes")}),
top_sides AS ({_sides("groups", "tops")}),
steps AS (
  SELECT tree, idx, row_number() OVER (PARTITION BY tree, idx ORDER BY level) - 1 AS step, a, b
  FROM (SELECT * FROM sides
        UNION ALL
        SELECT l.tree, l.idx, 1000 + t.level, t.a, t.b
        FROM leaves l JOIN groups g ON g.name = l.tree JOIN top_sides t ON t.idx = g.idx)),
folded AS (
  SELECT tree, idx, 0::BIGINT AS step, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, f.step + 1, sha256(s.a || f.h || s.b)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.step = f.step),
last AS (SELECT tree, idx, arg_max(h, step) AS h FROM folded GROUP BY ALL),
proofs AS (SELECT tree, idx, string_agg(a || b, '' ORDER BY step) AS proof FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, g.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root,
       f.h = r.h AS verified
FROM leaves l JOIN groups g ON g.name = l.tree JOIN last f ON f.tree = l.tree AND f.idx = l.idx
LEFT JOIN proofs p ON p.tree = l.tree AND p.idx = l.idx CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""

ORACLE = {"op2_secret_scan": SECRETS, "op4_line_dedup": LINES, "op12_manifest": MANIFEST}
