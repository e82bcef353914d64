"""DuckDB SQL of the registered queries, as common table expressions that build on one another.

Formulas and tables are written out here, in other forms than the operators use where there is one, so that a wrong
formula shows as a difference.  Only parameters are shared."""

from __future__ import annotations

SIGMA, THRESHOLD, Q = 3.0, 0.02, 0.01


def _e(k: int) -> str:
    return f"CAST(embedding[{k}] AS DOUBLE)"


_raw = f"""8 * {_e(1)} AS x, 8 * {_e(2)} AS y, 8 * {_e(3)} AS z, 10 * {_e(11)} + 2 AS opacity,
  {_e(4)} - 1.2 AS scale_0, {_e(5)} - 1.2 AS scale_1, {_e(6)} - 1.2 AS scale_2, {_e(7)} AS rot_0, {_e(8)} AS rot_1, {_e(9)} AS rot_2, {_e(10)} AS rot_3,
  5 * {_e(12)} AS f_dc_0, 5 * {_e(13)} AS f_dc_1, 5 * {_e(14)} AS f_dc_2"""
#: Rotation as a sum and difference of squares, opacity as the plain logistic function.
_act = """greatest(exp(scale_0), 0.00001::DOUBLE) AS s0, greatest(exp(scale_1), 0.00001::DOUBLE) AS s1, greatest(exp(scale_2), 0.00001::DOUBLE) AS s2,
  w * w + a * a - b * b - c * c AS r0, 2 * a * b - 2 * w * c AS r1, 2 * a * c + 2 * w * b AS r2,
  2 * a * b + 2 * w * c AS r3, w * w - a * a + b * b - c * c AS r4, 2 * b * c - 2 * w * a AS r5,
  2 * a * c - 2 * w * b AS r6, 2 * b * c + 2 * w * a AS r7, w * w - a * a - b * b + c * c AS r8,
  1 / (1 + exp(-opacity)) AS opacity,
  CASE WHEN isfinite(f_dc_0) THEN least(1, greatest(0, f_dc_0 * 0.28209479177387814 + 0.5)) ELSE 0.55::DOUBLE END AS cr,
  CASE WHEN isfinite(f_dc_1) THEN least(1, greatest(0, f_dc_1 * 0.28209479177387814 + 0.5)) ELSE 0.58::DOUBLE END AS cg,
  CASE WHEN isfinite(f_dc_2) THEN least(1, greatest(0, f_dc_2 * 0.28209479177387814 + 0.5)) ELSE 0.62::DOUBLE END AS cb"""
#: Half the sides of a support's box.
H = ("3 * (s0 * abs(r0) + s1 * abs(r1) + s2 * abs(r2))", "3 * (s0 * abs(r3) + s1 * abs(r4) + s2 * abs(r5))", "3 * (s0 * abs(r6) + s1 * abs(r7) + s2 * abs(r8))")
_h = H


def d2(dx: str, dy: str, dz: str) -> str:
    """Squared distance in scales, of an offset from the center: the offset along each of the Gaussian's own axes."""
    return f"(pow((({dx}) * r0 + ({dy}) * r3 + ({dz}) * r6) / s0, 2) + pow((({dx}) * r1 + ({dy}) * r4 + ({dz}) * r7) / s1, 2) + pow((({dx}) * r2 + ({dy}) * r5 + ({dz}) * r8) / s2, 2))"


def _rank(q: float) -> str:
    return f"CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) + 1"


GAUSSIANS = f"""
raw AS (SELECT vec_id AS gid, {_raw} FROM embeddings),
turned AS (SELECT *, sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3) AS n FROM raw),
unit AS (SELECT *, CASE WHEN n < 0.00001 THEN 1 ELSE rot_0 / n END AS w, CASE WHEN n < 0.00001 THEN 0 ELSE rot_1 / n END AS a, CASE WHEN n < 0.00001 THEN 0 ELSE rot_2 / n END AS b, CASE WHEN n < 0.00001 THEN 0 ELSE rot_3 / n END AS c FROM turned),
act AS (SELECT gid, x, y, z, {_act} FROM unit),
ga AS MATERIALIZED (SELECT * FROM act WHERE opacity >= {THRESHOLD})"""

BOUNDS = f"""
sorted AS (SELECT count(*) AS n, list_sort(list(x)) AS lx, list_sort(list(y)) AS ly, list_sort(list(z)) AS lz FROM ga),
cut AS (SELECT {", ".join(f"l{c}[{_rank(Q)}] AS {c}0, l{c}[{_rank(1 - Q)}] AS {c}1" for c in "xyz")} FROM sorted),
box AS (SELECT {", ".join(f"min({c} - ({_h[a]})) AS {c}_lo, max({c} + ({_h[a]})) AS {c}_hi" for a, c in enumerate("xyz"))}
  FROM ga, cut WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1),
bounds AS (SELECT {", ".join(f"{c}_lo - greatest(0.000001, ({c}_hi - {c}_lo) * 0.01) AS lo{c}, {c}_hi + greatest(0.000001, ({c}_hi - {c}_lo) * 0.01) AS hi{c}" for c in "xyz")} FROM box)"""


def grid(resolution: int) -> str:
    return f"""
sized AS (SELECT *, greatest(hix - lox, hiy - loy, hiz - loz, 0.000001) / {max(8, min(256, resolution))} AS sp FROM bounds),
grid AS MATERIALIZED (SELECT *, {", ".join(f"CAST(least(512, ceil((hi{c} - lo{c}) / sp) + 1) AS BIGINT) AS n{c}" for c in "xyz")} FROM sized)"""


VOXELS = f"""
boxes AS (SELECT ga.*, lox, loy, loz, sp, nx, ny, nz,
  {", ".join(f"greatest(0, CAST(ceil(({c} - ({_h[a]}) - lo{c}) / sp - 0.000001) AS BIGINT)) AS p{c}, least(n{c} - 1, CAST(floor(({c} + ({_h[a]}) - lo{c}) / sp + 0.000001) AS BIGINT)) AS q{c}" for a, c in enumerate("xyz"))}
  FROM ga, grid),
planes AS (SELECT *, unnest(range(pz, qz + 1)) AS k FROM boxes),
lines AS (SELECT *, unnest(range(py, qy + 1)) AS j FROM planes),
points AS (SELECT *, unnest(range(px, qx + 1)) AS i FROM lines),
near AS (SELECT *, {d2("lox + i * sp - x", "loy + j * sp - y", "loz + k * sp - z")} AS d2 FROM points),
vox AS MATERIALIZED (SELECT (k * ny + j) * nx + i AS vid, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST(sum(opacity * exp(-0.5 * d2)) AS FLOAT) AS density
  FROM near WHERE d2 <= {SIGMA * SIGMA} GROUP BY 1, 2, 3, 4)"""

STATS = """
found AS (SELECT min(CAST(density AS DOUBLE)) AS lo, max(CAST(density AS DOUBLE)) AS hi, count(*) FILTER (density > 0) AS non_zero, count(*) AS n FROM vox),
stats AS (SELECT CASE WHEN n < nx * ny * nz THEN least(coalesce(lo, 0), 0) ELSE lo END AS min_density, greatest(coalesce(hi, 0), 0) AS max_density, non_zero FROM found, grid),
bins AS (SELECT CAST(greatest(0, least(31, floor((CAST(density AS DOUBLE) - min_density) / greatest(0.000001, max_density - min_density) * 31))) AS INTEGER) AS bin, count(*) AS n FROM vox, stats WHERE density > 0 GROUP BY 1),
histogram AS (SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(32) r(b) LEFT JOIN bins ON bin = b),
running AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto FROM histogram),
chosen AS (SELECT min(bin) AS bin FROM running, stats WHERE upto >= greatest(1, ceil(non_zero * 0.55))),
auto AS MATERIALIZED (SELECT CASE WHEN max_density <= 0 THEN 0 WHEN bin IS NULL THEN max_density * 0.2 ELSE min_density + greatest(0.000001, max_density - min_density) * ((bin + 0.5) / 32) END AS iso FROM stats, chosen)"""

# Corners of a cube (number, x, y, z), and its tetrahedra as corners.
_corners = "(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)"
_tetrahedra = "(0, [0, 5, 1, 6]), (1, [0, 1, 2, 6]), (2, [0, 2, 3, 6]), (3, [0, 3, 7, 6]), (4, [0, 7, 4, 6]), (5, [0, 4, 5, 6])"


def _absent(n: int) -> str:
    dx, dy, dz = (int(n in inside) for inside in ((1, 2, 5, 6), (2, 3, 6, 7), (4, 5, 6, 7)))
    return f"CASE WHEN x + {dx} IN (0, nx - 1) OR y + {dy} IN (0, ny - 1) OR z + {dz} IN (0, nz - 1) THEN outside ELSE 0 END"


SURFACE = f"""
level AS (SELECT iso, iso - greatest(0.000001, abs(iso) * 0.000001) AS outside, grid.* FROM auto, grid),
corner(n, dx, dy, dz) AS (VALUES {_corners}),
val AS (SELECT i, j, k, CASE WHEN i IN (0, nx - 1) OR j IN (0, ny - 1) OR k IN (0, nz - 1) THEN outside ELSE CAST(density AS DOUBLE) END AS v FROM vox, level),
spread AS (SELECT i - dx AS x, j - dy AS y, k - dz AS z, n, v FROM val, corner, level WHERE i - dx BETWEEN 0 AND nx - 2 AND j - dy BETWEEN 0 AND ny - 2 AND k - dz BETWEEN 0 AND nz - 2),
gathered AS (SELECT x, y, z, {", ".join(f"max(v) FILTER (n = {n}) AS w{n}" for n in range(8))} FROM spread GROUP BY 1, 2, 3),
cubes AS (SELECT x, y, z, iso, lox, loy, loz, sp, nx, ny, nz, {", ".join(f"coalesce(w{n}, {_absent(n)}) AS v{n}" for n in range(8))} FROM gathered, level),
tet(t, c) AS (VALUES {_tetrahedra}),
tets AS (SELECT q.*, t, {" + ".join(f"{1 << b} * CAST([v0, v1, v2, v3, v4, v5, v6, v7][c[{b + 1}] + 1] >= iso AS INTEGER)" for b in range(4))} AS code
  FROM (SELECT * FROM cubes WHERE greatest(v0, v1, v2, v3, v4, v5, v6, v7) >= iso) q CROSS JOIN tet),
halves AS (SELECT t, code, [c[p] FOR p IN [1, 2, 3, 4] IF (code >> (p - 1)) % 2 = 1] AS own, [c[p] FOR p IN [1, 2, 3, 4] IF (code >> (p - 1)) % 2 = 0] AS other FROM tet, range(1, 15) r(code)),
paths AS (SELECT t, code, CASE len(own) WHEN 1 THEN [[own[1], other[1]], [own[1], other[2]], [own[1], other[3]]] WHEN 3 THEN [[other[1], own[1]], [other[1], own[2]], [other[1], own[3]]]
  ELSE [[own[1], other[1]], [own[1], other[2]], [own[2], other[2]], [own[2], other[1]]] END AS path FROM halves),
cases AS (SELECT t, code, s - 1 AS slot, path[s][1] AS ca, path[s][2] AS cb FROM paths, range(1, 5) r(s) WHERE s <= len(path)),
crossed AS MATERIALIZED (SELECT ((z * ny + y) * nx + x) * 8 + t AS tet_id, code, slot, iso, lox, loy, loz, sp, nx, ny, nz,
  ((z + a.dz) * ny + y + a.dy) * nx + x + a.dx AS ia, ((z + b.dz) * ny + y + b.dy) * nx + x + b.dx AS ib,
  [v0, v1, v2, v3, v4, v5, v6, v7][ca + 1] AS va, [v0, v1, v2, v3, v4, v5, v6, v7][cb + 1] AS vb
  FROM tets JOIN cases USING (t, code) JOIN corner a ON a.n = ca JOIN corner b ON b.n = cb),
firsts AS (SELECT least(ia, ib) AS lo, greatest(ia, ib) AS hi, * FROM crossed QUALIFY row_number() OVER (PARTITION BY least(ia, ib), greatest(ia, ib) ORDER BY tet_id * 8 + slot) = 1),
edges AS (SELECT *, CASE WHEN abs(vb - va) > 0.000001 THEN greatest(0, least(1, (iso - va) / (vb - va))) ELSE 0.5 END AS t, row_number() OVER (ORDER BY tet_id * 8 + slot) - 1 AS vid FROM firsts),
placed AS (SELECT *, lox + (ia % nx) * sp AS pax, loy + ((ia // nx) % ny) * sp AS pay, loz + (ia // (nx * ny)) * sp AS paz,
  lox + (ib % nx) * sp AS pbx, loy + ((ib // nx) % ny) * sp AS pby, loz + (ib // (nx * ny)) * sp AS pbz FROM edges),
verts AS MATERIALIZED (SELECT vid, lo, hi, ia, ib, t, pax + (pbx - pax) * t AS x, pay + (pby - pay) * t AS y, paz + (pbz - paz) * t AS z FROM placed),
ends AS (SELECT ia AS p FROM verts UNION SELECT ib FROM verts),
ijk AS (SELECT p, p % nx AS i, (p // nx) % ny AS j, p // (nx * ny) AS k, nx, ny, nz, sp FROM ends, grid),
grad AS (SELECT p,
  (coalesce(xb.density, 0)::DOUBLE - coalesce(xa.density, 0)::DOUBLE) / (greatest(1, least(e.nx - 1, e.i + 1) - greatest(0, e.i - 1)) * sp) AS gx,
  (coalesce(yb.density, 0)::DOUBLE - coalesce(ya.density, 0)::DOUBLE) / (greatest(1, least(e.ny - 1, e.j + 1) - greatest(0, e.j - 1)) * sp) AS gy,
  (coalesce(zb.density, 0)::DOUBLE - coalesce(za.density, 0)::DOUBLE) / (greatest(1, least(e.nz - 1, e.k + 1) - greatest(0, e.k - 1)) * sp) AS gz
  FROM ijk e
  LEFT JOIN vox xa ON xa.vid = p + (greatest(0, e.i - 1) - e.i) LEFT JOIN vox xb ON xb.vid = p + (least(e.nx - 1, e.i + 1) - e.i)
  LEFT JOIN vox ya ON ya.vid = p + (greatest(0, e.j - 1) - e.j) * e.nx LEFT JOIN vox yb ON yb.vid = p + (least(e.ny - 1, e.j + 1) - e.j) * e.nx
  LEFT JOIN vox za ON za.vid = p + (greatest(0, e.k - 1) - e.k) * e.nx * e.ny LEFT JOIN vox zb ON zb.vid = p + (least(e.nz - 1, e.k + 1) - e.k) * e.nx * e.ny),
steep AS (SELECT v.*, -(a.gx + (b.gx - a.gx) * t) AS hx, -(a.gy + (b.gy - a.gy) * t) AS hy, -(a.gz + (b.gz - a.gz) * t) AS hz FROM verts v JOIN grad a ON a.p = ia JOIN grad b ON b.p = ib),
facing AS MATERIALIZED (SELECT *, {", ".join(f"CASE WHEN hx * hx + hy * hy + hz * hz > 0 THEN h{c} / sqrt(hx * hx + hy * hy + hz * hz) ELSE {int(c == 'z')} END AS n{c}" for c in "xyz")} FROM steep),
tet_v AS (SELECT tet_id, max(vid) FILTER (slot = 0) AS p0, max(vid) FILTER (slot = 1) AS p1, max(vid) FILTER (slot = 2) AS p2, max(vid) FILTER (slot = 3) AS p3
  FROM crossed c JOIN verts v ON v.lo = least(c.ia, c.ib) AND v.hi = greatest(c.ia, c.ib) GROUP BY tet_id),
fans AS (SELECT tet_id * 2 AS o, p0, p1, p2 FROM tet_v UNION ALL SELECT tet_id * 2 + 1, p0, p2, p3 FROM tet_v WHERE p3 IS NOT NULL),
tri AS (SELECT o, p0 AS a, p1 AS b, p2 AS c,
  ((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)) * (a.nx + b.nx + c.nx) + ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) * (a.ny + b.ny + c.ny) + ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) * (a.nz + b.nz + c.nz) AS turn
  FROM fans JOIN facing a ON a.vid = p0 JOIN facing b ON b.vid = p1 JOIN facing c ON c.vid = p2
  WHERE len(list_distinct([p0, p1, p2])) = 3),
faces AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o) - 1 AS fid, a, CASE WHEN turn < 0 THEN c ELSE b END AS b, CASE WHEN turn < 0 THEN b ELSE c END AS c FROM tri),
vertices AS MATERIALIZED (SELECT vid, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM verts)"""

MESH = """
sides AS MATERIALIZED (SELECT fid, a AS u, b AS v FROM faces UNION ALL SELECT fid, b, c FROM faces UNION ALL SELECT fid, c, a FROM faces),
links AS (SELECT DISTINCT least(u, v) AS lo, greatest(u, v) AS hi FROM sides),
nb AS (SELECT lo AS vid, hi AS near FROM links UNION ALL SELECT hi, lo FROM links),
shaped AS MATERIALIZED (SELECT fid, a, b, c,
  (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS fx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS fy, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS fz, p.x AS px, p.y AS py, p.z AS pz
  FROM faces JOIN vertices p ON p.vid = a JOIN vertices q ON q.vid = b JOIN vertices r ON r.vid = c)"""


def sql(*parts: str, select: str, recursive: str = "") -> str:
    body = ",".join(p.strip("\n") for p in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}{',' + recursive if recursive else ''}\n{select}"
