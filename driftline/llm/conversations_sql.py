"""The SQL that the repair of damaged conversations is checked against: a recursive query that carries, for each state, the
cheapest edits with their audit and turns as one comparable struct."""

from __future__ import annotations

CRC = """
table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT * EXCLUDE (k), xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(k[i]))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM keyed, table_)"""


def _edit(state: str, cost: str, letter: str, turn: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {turn}}} END"


def _insert(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"'\n{role}:'")


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN r.fault NOT IN (1, 2) AND r.initial = '{initial}' THEN {_edit(state, 'r.more', 'K', 'r.whole')} END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN r.fault NOT IN (1, 2) THEN {_edit(state, 'r.more + 3', 'R', f"'\n{role}:' || r.text")} END"


def repair_sql() -> str:
    take = lambda role, initial, *states: [w for s in states for w in (_keep(s, initial), _rerole(s, role))]
    u = _least(_edit("p.u", "4", "D"), *take("user", "u", "p.n", "p.s", "p.a"))
    a = _least(_edit("p.a", "4", "D"), *take("assistant", "a", "p.u"))
    s = _least(_edit("p.s", "4", "D"), _keep("p.n", "s"))
    start = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    closed_u = _least("u", _insert("n", "user"), _insert("s", "user"), _insert("a", "user"))
    return f"""WITH RECURSIVE {CRC},
live AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM hashed WHERE kind <> 0)),
alike AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM live),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, role[1] AS initial,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS initial_before FROM alike),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
  '\n' || role || ':' || text AS whole FROM numbered),
r AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM faulty),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS i, n, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s, {_insert('n', 'user')} AS u,
  {_insert(_insert('n', 'user'), 'assistant')} AS a
  FROM (SELECT DISTINCT conv_id, {start} AS n FROM stats)
UNION ALL
SELECT conv_id, i, n, s, {closed_u} AS u, {_least('a', _insert(f'({closed_u})', 'assistant'))} AS a FROM (
  SELECT p.conv_id, r.i, {_edit('p.n', '4', 'D')} AS n, {s} AS s, {u} AS u, {a} AS a
  FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
done AS (SELECT p.conv_id, list_min([p.n, p.a]) AS best FROM p JOIN stats ON stats.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = stats.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""
