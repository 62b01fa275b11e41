"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import secrets
from .queries import URL_RULES


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2() -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({ASCII_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS sh FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
      WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id
FROM s"""


def op10() -> str:
    return """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""


def op11() -> str:
    terms = rf"regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {terms} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf GROUP BY t),
p AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) CROSS JOIN s GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10"""


def _letters(pattern: str) -> str:
    """The pattern with each ASCII letter in either case (RE2's own flag folds beyond ASCII)."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _matches(name: str, kind: str, rank: int, pattern: str, keep: str) -> str:
    """Rows (doc_id, s, rank, kind, e, m) of the leftmost matches that pass ``keep`` (over m and g)."""
    quoted = pattern.replace("'", "''")
    return f"""
{name}_p AS (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, p, m FROM (
    SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p
    FROM t WHERE regexp_matches(t, '{quoted}'))),
{name} AS (
  SELECT doc_id, s, {rank} AS rank, '{kind}' AS kind, s + length(m) AS e, m FROM (
    SELECT doc_id, m[i] AS m, CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0)
           AS BIGINT) AS s FROM {name}_p) WHERE {keep})"""


def op3() -> str:
    key = "(?:" + "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + "|" + _letters("api") + "_?" + _letters("key") + ")"
    assign = key + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = (key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").replace("'", "''")
    entropy = ("coalesce(list_max([list_max([log2({window}) - list_sum([c * log2(c) FOR c IN map_values(list_aggregate("
               "string_split(x[w:w + {last}], ''), 'histogram'))]) / {window} FOR w IN range(1, length(x) - {last} + 1)]) "
               "FOR x IN string_split_regex(m, '{inner}') IF length(x) >= {window}]), 0.0)")
    parts = [_matches("a", "assign", 0, assign, f"length(regexp_extract(m, '{value}', 1)) >= {secrets.MIN_ASSIGN}"),
             _matches("b", "access", 1, "AKIA[A-Z0-9]{12,}", "true"), _matches("c", "hex", 2, "[0-9a-f]{32,}", "true")]
    seen = "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"
    parts.append(f"base AS ({seen})")
    for rank, c in enumerate(secrets.CLASSES, 3):
        needs = " AND ".join(f"regexp_matches(m, '{x}')" for x in c.needs)
        allowed = " OR ".join(f"regexp_matches(m, '{x}')" for x in secrets.ALLOW)
        bits = entropy.format(window=c.window, last=c.window - 1, inner=secrets.ALLOW_PARTS)
        # two windows' entropies may differ in the last bit from an incremental sum: far from the threshold
        keep = f"{needs} AND NOT ({allowed}) AND {bits} >= {c.min_bits}"
        parts.append(_matches(f"{c.name}_all", c.name, rank, c.run, keep))
        parts.append(f"""{c.name} AS (SELECT * FROM {c.name}_all x WHERE NOT EXISTS (
  SELECT 1 FROM ({seen}) y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND x.e <= y.e))""")
        seen += f" UNION ALL SELECT * FROM {c.name}"
    span = "string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, rank)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{",".join(parts)},
n AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, {span} AS spans FROM base GROUP BY doc_id),
f AS (SELECT doc_id, {span} AS spans FROM ({seen}) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(n.spans, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN f ON f.doc_id = t.doc_id"""


def op9() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(rh, rp, v) AS (VALUES {rules}),
parts AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT p.*, (SELECT max({{'n': length(rh) + length(rp), 'h': length(rh), 'rule': rh || rp, 'v': v}})
                      FROM rules WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS b
         FROM parts p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM best"""


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": op2(),
    "op3_secrets": op3(),
    "op10_ann": op10(),
    "op11_lexical": op11(),
    "op9_url_filter": op9(),
}
