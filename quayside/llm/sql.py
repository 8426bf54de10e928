"""DuckDB forms of the corpus queries that SQL can express."""

from .linerules import BOILERPLATE

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

#: Plain loops over the same rules; windows are compared as word lists.
OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT rid, i AS pos, words[i:i + 4] AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w
              WHERE len(words) >= 5)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n
                              FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - pos, 5)))::BIGINT AS n_repeat_words
        FROM (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM rep)
        GROUP BY rid),
lines AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
          FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)),
worded AS (SELECT *, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS bare,
             regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
             len(regexp_extract_all(line, '(?:^|[\x20\x09-\x0D])\p{Lu}')) AS caps FROM lines
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
items AS (SELECT *, length(bare) <= 40 AND len(ws) <= 4 AND NOT regexp_matches(line,
            '[.?!:;,\x{2026}\x{3002}\x{061f}"''\x{201d}\x{2019})\]][\x20\x09-\x0D]*\z') AS item
          FROM worded),
runs AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos)
           - row_number() OVER (PARTITION BY rid, item ORDER BY pos) AS run FROM items),
judged AS (
  SELECT rid, line, length(bare) AS chars,
    NOT (item AND count(*) OVER (PARTITION BY rid, item, run) >= 5) AND
    10 * len(regexp_extract_all(line, '[#*$%&|<>!]')) <= length(bare)
    AND (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) < 40
         OR regexp_matches(line, '[.?:;,\x{2026}\x{3002}\x{061f}]'))
    AND (len(regexp_extract_all(line, '[|\x{bb}\x{203a}\x{2022}\x{b7}]'))
         + len([x FOR x IN ws IF x = '/']) < 2
         OR 10 * (len(regexp_extract_all(line, '[|\x{bb}\x{203a}\x{2022}\x{b7}]'))
                  + len([x FOR x IN ws IF x = '/'])) < len(ws))
    AND (regexp_matches(line, '[.?!:;,\x{2026}\x{3002}\x{061f}]') OR caps < 6 OR caps < len(ws))
    AND NOT regexp_matches(lower(line), '@BOILERPLATE@') AS good
  FROM runs),
per AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines,
               sum(CASE WHEN good THEN 0 ELSE chars END)::BIGINT AS lost
        FROM judged GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN per USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.5::DOUBLE * word_chars AS kept
FROM b
""".replace("@BOILERPLATE@", "|".join(BOILERPLATE))

OP4 = f"""
WITH sizes AS (
  SELECT doc_id, source, {_SIZE}::BIGINT AS size,
         ('0x' || substr(md5('7' || '|' || coalesce(doc_id::VARCHAR, '') || '|' ||
          md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source),
weighted AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
             FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         (sum(weight) OVER (ORDER BY cap / weight, place
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM weighted),
flagged AS (SELECT *, (total - before) / rest AS level,
                   cap <= (total - before) / rest * weight AS capped FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN capped OR common IS NULL THEN cap::DOUBLE
                                   ELSE common * weight END AS target
  FROM (SELECT *, first(CASE WHEN NOT capped THEN level END IGNORE NULLS)
               OVER (ORDER BY cap / weight, place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common
        FROM flagged)),
ordered AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e
           FROM ordered)
SELECT doc_id, source, size, source_size, target,
       (e * size + greatest(0, least(size, budget - e * source_size - before)))::BIGINT AS taken
FROM epochs
"""

_BASE32 = """
list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(hex || '00', (5 * i // 4)::INTEGER + 1, 3))::INTEGER
    >> (7 - (5 * i) % 4)::INTEGER) & 31) + 1, 1)), 'string_agg', '')
"""

OP8 = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex,
                  strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
         row_number() OVER (PARTITION BY a.vec_id
           ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

def _lloyd(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Lloyd's rounds, unrolled; whole numbers throughout."""
    gap = (f"list_sum(list_transform(range(1, {size + 1}), "
           "lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))")
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q, embedding AS x
  FROM embeddings
  WHERE len(embedding) = {size}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, q
  FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, q, c, d FROM (
    SELECT v.rid, v.vec_id, v.q, c.c, {gap} AS d,
           row_number() OVER (PARTITION BY v.rid ORDER BY {gap}, c.c) AS place
    FROM v CROSS JOIN c{r} c) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS MATERIALIZED (
  SELECT c, list(mean ORDER BY i) AS q FROM (
    SELECT c, i, (total - ((total % n) + n) % n) // n AS mean FROM (
      SELECT c, i, sum(q[i])::HUGEINT AS total, count(*)::HUGEINT AS n
      FROM a{r} CROSS JOIN range(1, {size + 1}) t(i) GROUP BY c, i)) GROUP BY c),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.q, c.q)::BIGINT[] AS q FROM c{r} c LEFT JOIN m{r} m USING (c))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance,
       (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON a.c = f.c
"""


OP12 = _lloyd()


def _repair() -> str:
    """Least cost and least edits, row by row: each state's best is one text,
    the cost in nine digits and then the edits, so the least text is both."""
    def add(s: str, cost: str, edit: str) -> str:
        return (f"(lpad((substr({s}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0')"
                f" || substr({s}, 10) || '{edit}')")

    def least(*ways: str) -> str:
        return f"least({', '.join(ways)})"

    def stays(*ways: str) -> str:
        return f"CASE WHEN NOT gone THEN {least(*ways, 'NULL')} END"

    def kept(initial: str, *states: str) -> str:
        return f"CASE WHEN initial = '{initial}' THEN " + least(
            *[add(s, "more", "K") for s in states], "NULL") + " END"

    into_u = [add(s, "2 + more", "R") for s in ("s0", "s1", "s3")]
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(name, ''),
      lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS hit
  FROM d),
m AS (
  SELECT conv_id, k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                  ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST,
           md5(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS i FROM m),
f AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
              WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3
              ELSE 0 END AS fault,
         lead(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS next FROM o),
g AS (SELECT k, i, initial, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN 1 ELSE 0 END AS more
      FROM f),
r AS (
  SELECT DISTINCT k, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1,
         '000000002I' AS s2, '000000004II' AS s3 FROM d
  UNION ALL
  SELECT k, i, n0, n1, m2, least(n3, {add('m2', '2', 'I')}) FROM (
    SELECT *, {least('n2', *[add(s, '2', 'I') for s in ('n0', 'n1', 'n3')])} AS m2 FROM (
      SELECT g.k, g.i, {add('s0', '3', 'D')} AS n0,
        {least(add('s1', '3', 'D'), stays(kept('s', 's0')))} AS n1,
        {least(add('s2', '3', 'D'), stays(kept('u', 's0', 's1', 's3'), *into_u))} AS n2,
        {least(add('s3', '3', 'D'), stays(kept('a', 's2'), add('s2', '2 + more', 'R')))} AS n3
      FROM r JOIN g ON g.k = r.k AND g.i = r.i + 1))),
best AS (
  SELECT k, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit
  FROM (SELECT k, arg_max(least(s0, s3), i) AS b FROM r GROUP BY k)),
c AS (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
e AS (
  SELECT k, p, substr(audit, p, 1) AS edit,
         sum(CASE WHEN substr(audit, p, 1) <> 'I' THEN 1 ELSE 0 END)
           OVER (PARTITION BY k ORDER BY p) AS i FROM c),
w AS (
  SELECT e.k, p, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
         row_number() OVER (PARTITION BY e.k ORDER BY p) AS n,
         first(edit = 'K' AND initial = 's') OVER (PARTITION BY e.k ORDER BY p) AS led
  FROM e LEFT JOIN f ON f.k = e.k AND f.i = e.i WHERE edit <> 'D'),
t AS (
  SELECT k, sha256(string_agg(CASE WHEN edit = 'K' THEN role
                  WHEN (n - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                  ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha
  FROM w GROUP BY k),
s AS (
  SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au'))
           AS illegal
  FROM f GROUP BY k)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost, audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM d) a JOIN best USING (k) LEFT JOIN s USING (k)
LEFT JOIN t USING (k)
"""


OP11 = _repair()

ORACLE_SQL = {"op2_line_rules": OP2, "op5_topk": OP5, "op4_mixing": OP4, "op8_warc": OP8,
              "op11_dialogue": OP11, "op12_ns_bounds": OP12}
