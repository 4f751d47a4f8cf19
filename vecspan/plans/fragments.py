"""SQL fragments of the oracle: common table expressions that the catalog's queries share."""

from __future__ import annotations

K, EXTRA, SEED = 10, 60, 42
N_MID, N_FAR = 5, 20
MID_TRIES, FAR_TRIES = N_MID * 6 * 2 + 16, N_FAR * 4 + 16

V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"
CELLS = V + ", c AS (SELECT id, label, unnest(f) AS x, unnest(range(len(f)))::INT AS pos FROM v)"


def hash_draw(*parts: str) -> str:
    return f"concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def fold(expr: str) -> str:
    return f"list_sum({expr})"


def zipped(a: str, b: str, body: str) -> str:
    """Sum over both lists of body in p[1] and p[2]."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {body}))"


def dist(metric: str, a: str = "a.f", b: str = "b.f") -> str:
    if metric == "euclidean":
        return f"list_distance({a}, {b})"
    if metric == "sqeuclidean":
        return zipped(a, b, "(p[1] - p[2]) * (p[1] - p[2])")
    if metric == "manhattan":
        return zipped(a, b, "abs(p[1] - p[2])")
    if metric == "hamming":
        return zipped(a, b, "CASE WHEN abs(p[1] - p[2]) > 1e-6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END") + f" / len({a})"
    if metric == "correlation":
        return dist("cosine", a.replace(".f", ".cf"), b.replace(".f", ".cf"))
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    cos = f"least(greatest(list_dot_product({a}, {b}) / ({na} * {nb}), -1), 1)"
    one = f"CASE WHEN {na} < 1e-10 OR {nb} < 1e-10 THEN 1.0 ELSE 1.0 - {cos} END"
    return f"sqrt(greatest(2 - 2 * (1 - ({one})), 0))" if metric == "angular" else one


def knn(k: int, metric: str = "euclidean", name: str = "knn", rows: str = "v", where: str = "a.id <> b.id") -> str:
    src = rows
    if metric == "correlation":
        src = f"(SELECT *, list_transform(f, lambda x: x - list_avg(f)) AS cf FROM {rows})"
    return f"""{name} AS (SELECT i, j, rank, dist FROM (
      SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank
      FROM (SELECT a.id AS i, b.id AS j, {dist(metric)} AS dist FROM {src} a JOIN {src} b ON {where}))
      WHERE rank <= {k})"""


NORM = """mm AS (SELECT min(list_min(f)) AS lo, max(list_max(f)) AS hi FROM v),
s AS (SELECT id, label, list_transform(f, lambda x: (x - lo) / hi) AS f FROM v, mm),
sc AS (SELECT id, unnest(f) AS x, unnest(range(len(f)))::INT AS pos FROM s),
me AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM sc GROUP BY pos)),
nv AS (SELECT id, label, list_transform(list_zip(f, m), lambda p: p[1] - p[2]) AS f FROM s, me)"""

SIGMA = f"""sigma AS (SELECT i, greatest(avg(dist) FILTER (rank BETWEEN 4 AND 6), 1e-10) AS sigma FROM knn GROUP BY i),
scaled AS (SELECT k.i, k.j, k.rank, k.dist, k.dist * k.dist / (a.sigma * b.sigma) AS scaled
  FROM knn k JOIN sigma a ON a.i = k.i JOIN sigma b ON b.i = k.j),
near AS (SELECT i, j, 0 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY scaled, j) AS r FROM scaled) WHERE r <= {K})"""


def drawn(what: str, tries: int, name: str) -> str:
    j = hash_draw(f"'{SEED}'", f"'{what}'", "id::VARCHAR", "t::VARCHAR")
    return f"""{name} AS (SELECT i, j, min(t) AS t FROM (
      SELECT id AS i, t, {j} % (SELECT count(*) FROM v) AS j FROM v, range({tries}) r(t)) WHERE i <> j GROUP BY i, j)"""


FAR = drawn("far", FAR_TRIES, "fd") + f""",
far AS (SELECT i, j, 2 AS kind FROM (
  SELECT f.i, f.j, row_number() OVER (PARTITION BY f.i ORDER BY t) AS r FROM fd f ANTI JOIN near n ON f.i = n.i AND f.j = n.j) WHERE r <= {N_FAR})"""

MID = drawn("mid", MID_TRIES, "md") + f""",
mc AS (SELECT i, j, (spot // 6)::BIGINT AS slot FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS spot FROM md) WHERE spot < {6 * N_MID}),
mid AS (SELECT i, j, 1 AS kind FROM (
  SELECT mc.i, mc.j, row_number() OVER (PARTITION BY mc.i, slot ORDER BY list_distance(a.f, b.f), mc.j) AS r
  FROM mc JOIN v a ON a.id = mc.i JOIN v b ON b.id = mc.j) WHERE r = 2)"""

PAIRS = ", ".join([V, knn(EXTRA), SIGMA, FAR, MID, "pairs AS (SELECT * FROM near UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM far)"])
#: A fixed embedding: the first two features.
Y = "y AS (SELECT id, label, [f[1], f[2]] AS y FROM v)"
ENDS = """ends AS (SELECT p.i, p.j, p.kind, a.y AS yi, b.y AS yj,
  1.0 + (a.y[1] - b.y[1]) * (a.y[1] - b.y[1]) + (a.y[2] - b.y[2]) * (a.y[2] - b.y[2]) AS d2
  FROM pairs p JOIN y a ON a.id = p.i JOIN y b ON b.id = p.j)"""


def grad(w: tuple[float, float, float]) -> str:
    """Gradient id, pos, g at weights w."""
    force = f"CASE kind WHEN 0 THEN {w[0]} * 20.0 / ((10.0 + d2) * (10.0 + d2)) WHEN 1 THEN {w[1]} * 20000.0 / ((10000.0 + d2) * (10000.0 + d2)) ELSE -{w[2]} * 2.0 / ((1.0 + d2) * (1.0 + d2)) END"
    return f"""fc AS (SELECT i, j, {force} AS c, yi, yj FROM ends),
gl AS (SELECT i AS id, 0 AS pos, c * (yi[1] - yj[1]) AS g FROM fc UNION ALL SELECT i, 1, c * (yi[2] - yj[2]) FROM fc
  UNION ALL SELECT j, 0, -c * (yi[1] - yj[1]) FROM fc UNION ALL SELECT j, 1, -c * (yi[2] - yj[2]) FROM fc),
grad AS (SELECT id, pos, sum(g) AS g FROM gl GROUP BY id, pos)"""
