"""Trees and cuts of :mod:`operators.trees` as SQL: the nearest pair is joined again and again."""

from __future__ import annotations

_FAR = "CAST(1e300 AS DOUBLE)"


def tree(name: str, leaves: str, distances: str, method: str) -> str:
    """CTEs that end in ``name`` (idx, place, height, step) for queries of leaves (idx) and distances (x, y, d; x < y)."""
    both = "d[m.a][{k}], d[m.b][{k}]"
    if method == "complete":
        joined = f"greatest({both})"
    else:
        joined = "(sz[m.a] * d[m.a][{k}] + sz[m.b] * d[m.b][{k}]) / (sz[m.a] + sz[m.b])"
    to = lambda k: f"CASE WHEN greatest({both}) >= {_FAR} THEN {_FAR} ELSE {joined} END".format(k=k)
    n = name
    return f"""{n}_l AS (SELECT idx, row_number() OVER (ORDER BY idx) AS n FROM ({leaves})),
{n}_m AS (SELECT list(r ORDER BY a) AS d, count(*) AS n FROM (SELECT a.n AS a, list(coalesce(e.d, {_FAR}) ORDER BY b.n) AS r FROM {n}_l a CROSS JOIN {n}_l b LEFT JOIN ({distances}) e ON e.x = least(a.idx, b.idx) AND e.y = greatest(a.idx, b.idx) GROUP BY a.n)),
{n}_w AS (SELECT 0 AS step, n, d, [1 FOR a IN range(1, n + 1)] AS sz, [[a] FOR a IN range(1, n + 1)] AS ord, [CAST(NULL AS DOUBLE) FOR a IN range(1, n + 1)] AS h, [0 FOR a IN range(1, n + 1)] AS st FROM {n}_m
  UNION ALL SELECT step + 1, n, [[CASE WHEN a = m.b OR b = m.b OR a = b THEN {_FAR} WHEN a = m.a THEN {to("b")} WHEN b = m.a THEN {to("a")} ELSE d[a][b] END FOR b IN range(1, n + 1)] FOR a IN range(1, n + 1)],
    [CASE WHEN a = m.a THEN sz[a] + sz[m.b] ELSE sz[a] END FOR a IN range(1, n + 1)], [CASE WHEN a = m.a THEN ord[a] || ord[m.b] ELSE ord[a] END FOR a IN range(1, n + 1)],
    [CASE WHEN a = m.b THEN m.h ELSE h[a] END FOR a IN range(1, n + 1)], [CASE WHEN a = m.b THEN step + 1 ELSE st[a] END FOR a IN range(1, n + 1)]
  FROM (SELECT *, list_min(flatten([[{{'h': d[a][b], 'a': a, 'b': b}} FOR b IN range(a + 1, n + 1)] FOR a IN range(1, n)])) AS m FROM {n}_w WHERE step < n - 1)),
{n}_o AS (SELECT unnest(ord[1]) AS n, generate_subscripts(ord[1], 1) - 1 AS place, h, st FROM {n}_w WHERE step = n - 1),
{n} AS (SELECT l.idx, o.place, h[o.n] AS height, st[o.n] AS step FROM {n}_o o JOIN {n}_l l ON l.n = o.n)"""


def bounded(name: str, of: str, k: int, least: int, most: int) -> str:
    """CTEs that end in ``name`` (idx, cluster): the tree ``of``, cut into k clusters of bounded size."""
    n = name
    return f"""{n}_c AS (SELECT *, sum(CASE WHEN height IS NULL OR rank <= {k - 1} THEN 1 ELSE 0 END) OVER (ORDER BY place) AS run FROM (SELECT *, row_number() OVER (ORDER BY height DESC NULLS LAST, step DESC) AS rank FROM {of})),
{n}_r AS (SELECT min(place) AS lo, max(place) AS hi, false AS done FROM {n}_c GROUP BY run HAVING count(*) >= {least}
  UNION ALL SELECT unnest(parts).lo, unnest(parts).hi, unnest(parts).done FROM (
    SELECT CASE WHEN pos - lo < {least} AND hi - pos + 1 < {least} THEN [{{'lo': lo, 'hi': hi, 'done': true}}]
      ELSE [p FOR p IN [{{'lo': lo, 'hi': pos - 1, 'done': false}}, {{'lo': pos, 'hi': hi, 'done': false}}] IF p.hi - p.lo + 1 >= {least}] END AS parts
    FROM (SELECT lo, hi, arg_max(t.place, {{'h': t.height, 's': t.step}}) AS pos FROM {n}_r r JOIN {of} t ON t.place > r.lo AND t.place <= r.hi WHERE NOT r.done AND r.hi - r.lo + 1 > {most} GROUP BY lo, hi))),
{n} AS (SELECT t.idx, dense_rank() OVER (ORDER BY r.first) - 1 AS cluster FROM (SELECT lo, hi, min(t.idx) AS first FROM {n}_r JOIN {of} t ON t.place BETWEEN lo AND hi WHERE done OR hi - lo + 1 <= {most} GROUP BY lo, hi) r JOIN {of} t ON t.place BETWEEN r.lo AND r.hi)"""


def correlation_distances(cells: str, axis: str) -> tuple[str, str]:
    """Queries of leaves and distances (half of one minus the correlation, missing cells zero) of a CTE of cells (i, j, value)."""
    other = {"i": "j", "j": "i"}[axis]
    moments = f"(SELECT {axis} AS l, sum(value) AS s, sum(value * value) - sum(value) * sum(value) / (SELECT count(DISTINCT {other}) FROM {cells}) AS v FROM {cells} GROUP BY {axis})"
    cross = f"(SELECT a.{axis} AS x, b.{axis} AS y, sum(a.value * b.value) AS xy FROM {cells} a JOIN {cells} b ON a.{other} = b.{other} AND a.{axis} < b.{axis} GROUP BY ALL)"
    whole = "(sqrt(greatest(p.v, 0)) * sqrt(greatest(q.v, 0)))"
    r = f"CASE WHEN {whole} > 1e-12 THEN (coalesce(xy, 0) - p.s * q.s / (SELECT count(DISTINCT {other}) FROM {cells})) / {whole} ELSE 0 END"
    return f"SELECT DISTINCT {axis} AS idx FROM {cells}", f"SELECT p.l AS x, q.l AS y, (1 - round({r}, 12)) / 2 AS d FROM {moments} p JOIN {moments} q ON p.l < q.l LEFT JOIN {cross} c ON c.x = p.l AND c.y = q.l"
