"""DuckDB statements for the queries of this subpackage that SQL can express on whole tables."""

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _words(column: str) -> str:
    return WORDS.format(column)


PAIRS = f"""
WITH q AS (SELECT id, min(question) AS question, min(lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g'))) AS split
           FROM questions WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT DISTINCT id, unnest({_words('question')}) AS w FROM q),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b
      WHERE o >= 0.7 * (x.n + y.n - o) - 1e-9)
"""

P6 = """
SELECT id_a, id_b FROM p JOIN q a ON a.id = id_a JOIN q b ON b.id = id_b
WHERE (a.split = 'train' AND b.split IN ('validation', 'test')) OR (b.split = 'train' AND a.split IN ('validation', 'test'))
"""

P6_GROUPS = f"""
, x AS ({P6}), e AS (SELECT id_a AS id FROM x UNION ALL SELECT id_b FROM x), l AS (SELECT id, count(*) AS links FROM e GROUP BY id),
s AS (SELECT id, array_to_string({_words('question')}, ' ') AS t FROM q WHERE split IN ('train', 'validation', 'test'))
SELECT s.id, min(s.id) OVER (PARTITION BY t) AS cls, coalesce(links, 0) AS links FROM s LEFT JOIN l ON l.id = s.id WHERE t <> ''
"""

P1_GROUPS = (
    PAIRS.replace("WITH q", "WITH RECURSIVE q", 1)
    + """, e AS (SELECT id_a AS u, id_b AS v FROM p UNION ALL SELECT id_b, id_a FROM p),
c(id, m) AS (SELECT id, id FROM n UNION SELECT c.id, e.v FROM c JOIN e ON e.u = c.m)
SELECT id, min(m) AS group_id, (SELECT count(*) FROM e WHERE e.u = c.id) AS links FROM c GROUP BY id
"""
)

P5 = f"""
WITH RECURSIVE r AS (
  SELECT DISTINCT id,
    nullif(array_to_string({_words("coalesce(context, CASE WHEN strpos(question, chr(10) || chr(10)) > 0 THEN left(question, strpos(question, chr(10) || chr(10)) - 1) END)")}, ' '), '') AS p,
    CASE WHEN dataset = 'oil_and_gas' THEN nullif(array_to_string({_words('subject')}, ' '), '') END AS m
  FROM questions WHERE id IS NOT NULL),
k AS (SELECT DISTINCT id, 'p' || p AS e FROM r WHERE p IS NOT NULL UNION SELECT DISTINCT id, 'm' || m FROM r WHERE m IS NOT NULL),
l AS (SELECT DISTINCT a.e AS u, b.e AS v FROM k a JOIN k b USING (id)),
c(e, f) AS (SELECT u, v FROM l UNION SELECT c.e, l.v FROM c JOIN l ON c.f = l.u),
g AS (SELECT k.id, min(c.f) AS g FROM k JOIN c USING (e) GROUP BY k.id),
f AS (SELECT g, min(id) AS id_first FROM g GROUP BY g)
SELECT id_first, id AS id_other FROM g JOIN f USING (g) WHERE id <> id_first
"""


def oracles() -> dict:
    return {"p1_groups": P1_GROUPS, "p1_found": PAIRS + "SELECT id_a, id_b FROM p", "p6_found": PAIRS + P6, "p6_groups": PAIRS + P6_GROUPS, "p5_found": P5}
