"""SQL twins of the queries, for a single-node engine on the same tables."""

from __future__ import annotations

_N = """n AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(p_partkey % 40 AS BIGINT) AS c, CAST(p_partkey // 40 AS BIGINT) AS r,
             CAST((p_size - 25) * 4 AS DOUBLE) AS z, CASE WHEN p_size % 11 <> 0 THEN CAST((p_size - 25) * 4 AS DOUBLE) END AS g FROM part)"""
_M = (
    _N
    + """,
dim AS (SELECT max(r) AS mr FROM n),
cell AS (SELECT node_id AS a, r * 39 + c AS k FROM n, dim WHERE c < 39 AND r < mr AND (r * 39 + c) % 17 <> 3),
m AS (SELECT 2 * k AS elem_id, 'quad' AS etype, [a, a + 1, a + 41, a + 40] AS nodes FROM cell WHERE k % 5 = 0
      UNION ALL SELECT 2 * k, 'tria', [a, a + 1, a + 40] FROM cell WHERE k % 5 <> 0
      UNION ALL SELECT 2 * k + 1, 'tria', [a + 1, a + 41, a + 40] FROM cell WHERE k % 5 <> 0)"""
)
_S = """,
en AS (SELECT elem_id, etype, len(nodes) AS sz, unnest(nodes) AS node_id, unnest(range(0, len(nodes))) AS pos FROM m),
s AS (SELECT elem_id, least(a, b) AS u, greatest(a, b) AS v FROM (SELECT elem_id, nodes[i + 1] AS a, nodes[(i + 1) % len(nodes) + 1] AS b FROM (SELECT *, unnest(range(0, len(nodes))) AS i FROM m))),
ed AS (SELECT u, v, CAST(count(*) AS BIGINT) AS n_elem FROM s GROUP BY u, v),
bd AS (SELECT u, v FROM ed WHERE n_elem = 1)"""
_TEXT = "array_to_string(list_transform(nodes, lambda x: CAST(x AS VARCHAR)), '-') AS nodes"
_BOX = ", bx AS (SELECT node_id FROM n WHERE c > 9.5 AND c < 20.5 AND r > 4.5 AND r < 15.5)"
_F = "f AS (SELECT CAST(s_suppkey AS BIGINT) AS fid, CAST((s_suppkey * 7) % 40 AS DOUBLE) AS fx, CAST((s_suppkey * 13) % 50 AS DOUBLE) AS fy FROM supplier)"
_L = "l AS (SELECT CAST(s_suppkey % 10 AS BIGINT) AS line_id, CAST(s_suppkey // 10 AS BIGINT) AS seq, CAST((s_suppkey * 7) % 40 AS DOUBLE) AS x, CAST((s_suppkey * 13) % 50 AS DOUBLE) AS y FROM supplier)"
_P = "p AS (SELECT CAST(event_id AS BIGINT) AS pid, CAST(user_id % 40 + 0.25 * (event_id % 4) AS DOUBLE) AS x, CAST(event_id % 50 + 0.5 AS DOUBLE) AS y FROM events)"
_SRC = "o AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS raster_id, CAST(o_orderkey % 50 AS BIGINT) AS row, CAST(o_custkey % 40 AS BIGINT) AS col, CAST(floor(o_totalprice) AS BIGINT) AS z, o_orderkey AS tie FROM orders)"
_OS = _SRC + ", os AS (SELECT raster_id AS source_index, row, col, CAST(arg_max(z, tie) AS DOUBLE) AS z FROM o GROUP BY raster_id, row, col)"
_BX = "b AS (SELECT CAST(n_nationkey AS BIGINT) AS poly_id, n_nationkey + {0} AS x0, n_regionkey * 3 + {0} AS y0, n_nationkey + {0} + 4 AS x1, n_regionkey * 3 + {0} + 3 AS y1 FROM nation)"


def _boxes(shift: str) -> str:
    return _BX.format(f"CAST({shift} AS DOUBLE)")


def _poly(ring: list[tuple[float, float]], x: str, y: str) -> tuple[str, str]:
    """(odd, on_edge) of the even-odd test as SQL."""
    odd, edge = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        d = lambda v: f"CAST({v} AS DOUBLE)"
        if y1 != y2:
            odd.append(f"CASE WHEN ({d(y1)} > {y}) <> ({d(y2)} > {y}) AND {x} < {d(x1)} + ({y} - {d(y1)}) * {d((x2 - x1) / (y2 - y1))} THEN 1 ELSE 0 END")
        edge.append(f"(({x} - {d(x1)}) * {d(y2 - y1)} - ({y} - {d(y1)}) * {d(x2 - x1)} = 0 AND {x} BETWEEN {d(min(x1, x2))} AND {d(max(x1, x2))} AND {y} BETWEEN {d(min(y1, y2))} AND {d(max(y1, y2))})")
    return f"(({' + '.join(odd)}) % 2 = 1)", f"({' OR '.join(edge)})"


_LS = [(5.0, 1.0), (25.0, 1.0), (25.0, 3.0), (12.0, 3.0), (12.0, 4.0), (5.0, 4.0)]
_WEDGE = [(3.0, 0.0), (30.5, 1.5), (10.5, 4.5)]
_CUT = [(9.5, 1.5), (20.5, 1.5), (20.5, 3.5), (9.5, 3.5)]
_ODD, _EDGE = _poly(_LS, "c", "r")
_WODD, _WEDGED = _poly(_WEDGE, "c", "r")


def _pick(test: str, extra: str = _BOX) -> str:
    return f"WITH {_M}{_S}{extra}, hit AS (SELECT elem_id, sum(CASE WHEN node_id IN (SELECT node_id FROM bx) THEN 1 ELSE 0 END) AS h, count(*) AS k FROM en GROUP BY elem_id) SELECT elem_id, {_TEXT} FROM m JOIN hit USING (elem_id) WHERE {test}"


#: Corner table: every corner with its neighbours, x moved by a share of z.
def _corner(shear: str = "0") -> str:
    return f""",
xy AS (SELECT node_id, c + {shear} AS x, CAST(r AS DOUBLE) AS y FROM n),
co AS (SELECT elem_id, etype, sz, pos, en.node_id, x, y FROM en JOIN xy USING (node_id)),
tri AS (SELECT a.elem_id, a.etype, a.pos AS corner, b.x - a.x AS px, b.y - a.y AS py, d.x - a.x AS qx, d.y - a.y AS qy
        FROM co a JOIN co b ON a.elem_id = b.elem_id AND b.pos = (a.pos + a.sz - 1) % a.sz JOIN co d ON a.elem_id = d.elem_id AND d.pos = (a.pos + 1) % a.sz),
an AS (SELECT elem_id, etype, corner, degrees(acos(least(1.0, greatest(-1.0, (px * qx + py * qy) / sqrt((px * px + py * py) * (qx * qx + qy * qy)))))) AS angle, px * qy - py * qx AS turn FROM tri)"""


_AREA = """,
ar AS (SELECT a.elem_id, a.etype, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM co a JOIN co b ON a.elem_id = b.elem_id AND b.pos = (a.pos + 1) % a.sz GROUP BY 1, 2)"""


def _sub(condition: str) -> str:
    """The mesh restricted to elements with all nodes where ``condition``."""
    return _M.replace("m AS (SELECT 2", "m0 AS (SELECT 2") + f""",
m AS (SELECT * FROM m0 WHERE NOT EXISTS (SELECT 1 FROM (SELECT elem_id AS e, unnest(nodes) AS node_id FROM m0) q JOIN n USING (node_id) WHERE q.e = m0.elem_id AND NOT ({condition})))"""


_COMP = """,
lk AS (SELECT DISTINCT a.elem_id AS a, b.elem_id AS b FROM s a JOIN s b ON a.u = b.u AND a.v = b.v AND a.elem_id <> b.elem_id),
reach(x, y) AS (SELECT elem_id, elem_id FROM m UNION SELECT lk.b, reach.y FROM reach JOIN lk ON lk.a = reach.x WHERE reach.y < lk.b),
cp AS (SELECT x AS elem_id, min(y) AS component FROM reach GROUP BY x)"""
_R = "WITH " + _N + ", ra AS (SELECT r AS row, c AS col, z, g FROM n) "
_GRAD = """, gr AS (SELECT row, col, z, g,
  CASE WHEN lag(z) OVER h IS NULL AND lead(z) OVER h IS NULL THEN CAST(0 AS DOUBLE) WHEN lag(z) OVER h IS NULL THEN (lead(z) OVER h - z) WHEN lead(z) OVER h IS NULL THEN (z - lag(z) OVER h) ELSE (lead(z) OVER h - lag(z) OVER h) / 2 END AS gx,
  CASE WHEN lag(z) OVER w IS NULL AND lead(z) OVER w IS NULL THEN CAST(0 AS DOUBLE) WHEN lag(z) OVER w IS NULL THEN (lead(z) OVER w - z) WHEN lead(z) OVER w IS NULL THEN (z - lag(z) OVER w) ELSE (lead(z) OVER w - lag(z) OVER w) / 2 END AS gy
  FROM ra WINDOW h AS (PARTITION BY row ORDER BY col), w AS (PARTITION BY col ORDER BY row)) """
_RG = "WITH " + _N + ", ra AS (SELECT r AS row, c AS col, z, g FROM n)" + _GRAD
_G = "CAST(9.80665 AS DOUBLE)"
_U = f"CASE WHEN d <= -2 THEN 2 * sqrt({_G} / abs(d)) ELSE sqrt({_G} * 2) END"
_CH = f"CASE WHEN d <= -2 THEN 2 * sqrt({_G} / abs(d)) + sqrt({_G} * abs(d)) ELSE 2 * sqrt({_G} * 2) END"


def _h(expr: str, where: str = "") -> str:
    return f"WITH {_N} SELECT node_id, round(CAST({expr} AS DOUBLE), 6) + 0 AS h FROM n {where}"


def _seg_meets(ring: list[tuple[float, float]]) -> str:
    """Edges (grid edges, no ring vertex on them) that cross an axis-parallel ring."""
    tests = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        turn = lambda ax, ay, bx, by, cx, cy: f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"
        tests.append(
            f"({turn('ux', 'uy', 'vx', 'vy', x1, y1)} <> {turn('ux', 'uy', 'vx', 'vy', x2, y2)} AND {turn(x1, y1, x2, y2, 'ux', 'uy')} <> {turn(x1, y1, x2, y2, 'vx', 'vy')})"
        )
    return " OR ".join(tests)


_CROSS = f""", xe AS (SELECT u, v FROM (SELECT ed.u, ed.v, a.c AS ux, a.r AS uy, b.c AS vx, b.r AS vy FROM ed JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v) WHERE {_seg_meets(_CUT)}),
xn AS (SELECT u AS node_id FROM xe UNION SELECT v FROM xe), ins AS (SELECT node_id FROM n WHERE c BETWEEN 9.5 AND 20.5 AND r BETWEEN 1.5 AND 3.5)"""

ORACLE = {
    "mesh_edges": f"WITH {_M}{_S} SELECT u, v, n_elem FROM ed",
    "boundary_edges": f"WITH {_M}{_S} SELECT u, v FROM bd",
    "edge_lengths": f"WITH {_M}{_S} SELECT u, v, round(sqrt(CAST((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r) AS DOUBLE)), 6) AS length FROM ed JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v",
    "boundary_types": f"WITH {_M}{_S} SELECT u, v, round(sqrt(CAST((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r) AS DOUBLE)), 6) AS length, CASE WHEN a.z >= 0 OR b.z >= 0 THEN 'land' ELSE 'open' END AS btype FROM bd JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v",
    "tria_areas": f"WITH {_M}{_S}{_corner()}{_AREA} SELECT elem_id, round(abs(area), 6) AS area FROM ar WHERE etype = 'tria'",
    "element_area_signed": f"WITH {_M}{_S}{_corner()}{_AREA} SELECT elem_id, etype, area FROM ar",
    "element_angles": f"WITH {_M}{_S}{_corner()} SELECT elem_id, CAST(corner AS INTEGER) AS corner, round(angle, 6) AS angle FROM an",
    "vertex_adjacency": f"WITH {_M}{_S} SELECT DISTINCT a.node_id, b.node_id AS other FROM en a JOIN en b USING (elem_id) WHERE a.node_id <> b.node_id",
    "pinched_nodes": f"WITH {_M}{_S} SELECT node_id, CAST(count(*) AS BIGINT) AS n_boundary FROM (SELECT u AS node_id FROM bd UNION ALL SELECT v FROM bd) GROUP BY node_id HAVING count(*) > 2",
    "interior_nodes": f"WITH {_M}{_S} SELECT DISTINCT node_id FROM en WHERE node_id NOT IN (SELECT u FROM bd) AND node_id NOT IN (SELECT v FROM bd)",
    "incident_edges": f"WITH {_M}{_S}{_BOX} SELECT u, v FROM ed WHERE u IN (SELECT node_id FROM bx) OR v IN (SELECT node_id FROM bx)",
    "size_from_mesh": f"WITH {_M}{_S}, le AS (SELECT u, v, sqrt(CAST((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r) AS DOUBLE)) AS d FROM ed JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v), e2 AS (SELECT u AS node_id, d FROM le UNION ALL SELECT v, d FROM le) SELECT n.node_id, round(coalesce(avg(d), 0), 6) AS h FROM n LEFT JOIN e2 USING (node_id) GROUP BY n.node_id",
    "rect_mesh": f"WITH {_M} SELECT elem_id, {_TEXT} FROM m",
    "element_ids": f"WITH {_M} SELECT elem_id, etype, CAST(row_number() OVER (ORDER BY CASE WHEN etype = 'tria' THEN 0 ELSE 1 END, elem_id) AS BIGINT) AS id FROM m",
    "triangulation": f"WITH {_M} SELECT elem_id, 0 AS part, CASE WHEN len(nodes) = 4 THEN concat_ws('-', nodes[1], nodes[2], nodes[4]) ELSE concat_ws('-', nodes[1], nodes[2], nodes[3]) END AS nodes FROM m UNION ALL SELECT elem_id, 1, concat_ws('-', nodes[2], nodes[3], nodes[4]) FROM m WHERE len(nodes) = 4",
    "verts_in_box": f"WITH {_N}{_BOX} SELECT node_id FROM bx",
    "verts_in_polygon": f"WITH {_N} SELECT node_id, {_ODD} AND NOT {_EDGE} AS strict FROM n WHERE {_ODD} OR {_EDGE}",
    "surrounding_verts": f"WITH {_M}{_S}{_BOX} SELECT DISTINCT node_id FROM en WHERE elem_id IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM bx))",
    "select_adjacent": f"WITH {_M}{_S}{_BOX}, r1 AS (SELECT node_id FROM bx UNION SELECT node_id FROM en WHERE elem_id IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM bx))) SELECT node_id FROM r1 UNION SELECT node_id FROM en WHERE elem_id IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM r1))",
    "lone_elements": f"WITH {_sub('z >= 20')}{_S}, once AS (SELECT node_id FROM en GROUP BY node_id HAVING count(*) = 1) SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id NOT IN (SELECT node_id FROM once))",
    "clip_all": _pick("h = k"),
    "clip_any": _pick("h > 0"),
    "clip_inverse": _pick("h < k"),
    "clip_cross_edges": f"WITH {_M}{_S}{_CROSS} SELECT elem_id, {_TEXT} FROM m WHERE elem_id IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM xn UNION SELECT node_id FROM ins))",
    "clip_cross_edges_inverse": f"WITH {_M}{_S}{_CROSS} SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM ins)) AND elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM xn) GROUP BY elem_id HAVING count(*) >= 2)",
    "remove_by_edge": f"WITH {_M}{_S}, bn AS (SELECT u AS node_id FROM bd UNION SELECT v FROM bd) SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM bn) GROUP BY elem_id HAVING count(*) >= 2)",
    "clip_by_index": f"WITH {_M} SELECT elem_id, {_TEXT} FROM m WHERE elem_id % 7 <> 3",
    "cleanup_isolates": f"WITH {_M}{_S}{_BOX}, k AS (SELECT elem_id FROM en GROUP BY elem_id HAVING sum(CASE WHEN node_id IN (SELECT node_id FROM bx) THEN 1 ELSE 0 END) = count(*)), us AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS nid FROM (SELECT DISTINCT node_id FROM en JOIN k USING (elem_id))) SELECT elem_id, string_agg(CAST(nid AS VARCHAR), '-' ORDER BY pos) AS nodes FROM en JOIN k USING (elem_id) JOIN us USING (node_id) GROUP BY elem_id",
    "cleanup_duplicates": f"WITH {_N}, d AS (SELECT CAST(floor(c / 2) AS DOUBLE) AS x, CAST(floor(r / 2) AS DOUBLE) AS y, arg_min(z, node_id) AS value FROM n GROUP BY 1, 2) SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS BIGINT) AS node_id, x, y, value FROM d",
    "cleanup_duplicate_elements": f"WITH {_M}{_S}, mp AS (SELECT node_id, dense_rank() OVER (ORDER BY floor(c / 2), floor(r / 2)) - 1 AS nid FROM n), mv AS (SELECT elem_id, any_value(etype) AS etype, list(nid ORDER BY pos) AS nodes, list(nid ORDER BY nid) AS k FROM en JOIN mp USING (node_id) GROUP BY elem_id), fi AS (SELECT min(elem_id) AS elem_id FROM mv GROUP BY etype, k) SELECT elem_id, {_TEXT} FROM mv JOIN fi USING (elem_id)",
    "cleanup_skewed": f"WITH {_M}{_S}{_corner('z * 3 / 512')} SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM an WHERE angle < CASE WHEN etype = 'tria' THEN 20.3 ELSE 30.3 END OR angle >= CASE WHEN etype = 'tria' THEN 120.7 ELSE 150.7 END)",
    "cleanup_concave": f"WITH {_M}{_S}{_corner('z * 3 / 512')} SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM an WHERE etype = 'quad' GROUP BY elem_id HAVING min(turn) < 0 AND max(turn) > 0)",
    "cleanup_folded": f"WITH {_M}{_S}, bn AS (SELECT u AS node_id FROM bd UNION SELECT v FROM bd) SELECT elem_id, {_TEXT} FROM m WHERE etype = 'quad' OR elem_id IN (SELECT elem_id FROM en WHERE node_id NOT IN (SELECT node_id FROM bn))",
    "order_ccw": f"WITH {_M}{_S}{_corner()}, ce AS (SELECT elem_id, avg(x) AS mx, avg(y) AS my FROM co GROUP BY elem_id) SELECT elem_id, string_agg(CAST(node_id AS VARCHAR), '-' ORDER BY atan2(y - my, x - mx)) AS nodes FROM co JOIN ce USING (elem_id) GROUP BY elem_id",
    "quads_from_tri": f"WITH {_M}{_S}{_corner()}, be AS (SELECT elem_id, arg_min(corner, round(abs(angle - 90), 6) * 10 + corner) AS corner FROM an WHERE etype = 'tria' GROUP BY elem_id), dg AS (SELECT m.elem_id, nodes[corner + 1] AS tip, least(nodes[(corner + 1) % 3 + 1], nodes[(corner + 2) % 3 + 1]) AS u, greatest(nodes[(corner + 1) % 3 + 1], nodes[(corner + 2) % 3 + 1]) AS v FROM m JOIN be USING (elem_id)), pr AS (SELECT min(elem_id) AS elem_id, u, v, min(tip) AS t1, max(tip) AS t2 FROM dg GROUP BY u, v HAVING count(*) = 2 AND min(tip) <> max(tip)), q AS (SELECT elem_id, unnest([u, v, t1, t2]) AS node_id FROM pr), qx AS (SELECT elem_id, q.node_id, x, y, avg(x) OVER (PARTITION BY elem_id) AS mx, avg(y) OVER (PARTITION BY elem_id) AS my FROM q JOIN xy USING (node_id)) SELECT elem_id, string_agg(CAST(node_id AS VARCHAR), '-' ORDER BY atan2(y - my, x - mx)) AS nodes FROM qx GROUP BY elem_id",
    "components": f"WITH RECURSIVE {_sub('z >= -20')}{_S}{_COMP} SELECT elem_id, component FROM cp",
    "component_areas": f"WITH RECURSIVE {_sub('z >= -20')}{_S}{_corner()}{_AREA}{_COMP} SELECT component, CAST(count(*) AS BIGINT) AS n_elem, sum(abs(area)) AS area FROM cp JOIN ar USING (elem_id) GROUP BY component",
    "sieve_components": f"WITH RECURSIVE {_sub('z >= -20')}{_S}{_corner()}{_AREA}{_COMP}, ca AS (SELECT component, sum(abs(area)) AS area FROM cp JOIN ar USING (elem_id) GROUP BY component) SELECT elem_id, {_TEXT} FROM m JOIN cp USING (elem_id) JOIN ca USING (component) WHERE area > 2",
    "merge_priority": f"WITH {_M}{_S}, bx AS (SELECT node_id FROM n WHERE c > 9.5 AND c < 20.5 AND r > 0.5 AND r < 3.5), hit AS (SELECT elem_id, sum(CASE WHEN node_id IN (SELECT node_id FROM bx) THEN 1 ELSE 0 END) AS h, count(*) AS k FROM en GROUP BY elem_id), fr AS (SELECT m.* FROM m JOIN hit USING (elem_id) WHERE h = k), bb AS (SELECT min(c) AS x0, max(c) AS x1, min(r) AS y0, max(r) AS y1, max(node_id) + 1 AS off FROM n JOIN bx USING (node_id)), inn AS (SELECT node_id FROM n, bb WHERE c > x0 AND c < x1 AND r > y0 AND r < y1), drp AS (SELECT elem_id FROM en GROUP BY elem_id HAVING sum(CASE WHEN node_id IN (SELECT node_id FROM inn) THEN 1 ELSE 0 END) = count(*)) SELECT elem_id, {_TEXT} FROM fr UNION ALL SELECT elem_id + (SELECT coalesce(max(elem_id), 0) + 1 FROM fr), array_to_string(list_transform(nodes, lambda x: CAST(x + off AS VARCHAR)), '-') FROM m, bb WHERE elem_id NOT IN (SELECT elem_id FROM drp)",
    "merge_neighbors": f"WITH {_M}, n2 AS (SELECT node_id, c AS x, r AS y FROM n UNION ALL SELECT node_id + (SELECT max(node_id) + 1 FROM n), c + 39, r FROM n), m2 AS (SELECT * FROM m UNION ALL SELECT elem_id + (SELECT max(elem_id) + 1 FROM m), etype, list_transform(nodes, lambda x: x + sh) FROM m, (SELECT max(node_id) + 1 AS sh FROM n)), mp AS (SELECT node_id, dense_rank() OVER (ORDER BY x, y) - 1 AS nid FROM n2), ee AS (SELECT elem_id, unnest(nodes) AS node_id, unnest(range(0, len(nodes))) AS pos FROM m2) SELECT elem_id, string_agg(CAST(nid AS VARCHAR), '-' ORDER BY pos) AS nodes FROM ee JOIN mp USING (node_id) GROUP BY elem_id",
    "river_quads": f"WITH {_L}, a AS (SELECT line_id % 2 AS river_idx, line_id // 2 AS arc, seq, x, y FROM l), g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM a WINDOW w AS (PARTITION BY river_idx, arc ORDER BY seq)) SELECT q.river_idx, q.arc, q.seq AS seg, (q.x * p.y - p.x * q.y + p.x * p.y2 - p.x2 * p.y + p.x2 * q.y2 - q.x2 * p.y2 + q.x2 * q.y - q.x * q.y2) / 2 + 0 AS area FROM g q JOIN g p ON p.river_idx = q.river_idx AND p.seq = q.seq AND p.arc = q.arc + 1 WHERE q.x2 IS NOT NULL AND p.x2 IS NOT NULL",
    "hfun_constant": _h("CASE WHEN z > -40 AND z < 60 THEN 25 ELSE 100 END"),
    "hfun_feature": f"WITH {_N}, {_F}, d AS (SELECT node_id, sqrt(min((c - fx) * (c - fx) + (r - fy) * (r - fy))) AS d FROM n, f GROUP BY node_id) SELECT node_id, round(least(100, greatest(5, least(40, 0.5::DOUBLE * 10 * d + 10))), 6) AS h FROM d",
    "hfun_patch": _h(f"CASE WHEN {_WODD} OR {_WEDGED} THEN 15 ELSE 100 END"),
    "hfun_flow_limiter": _RG + "SELECT row * 40 + col AS node_id, round(CASE WHEN z > 80 OR z < -80 OR (gx = 0 AND gy = 0) THEN 100 ELSE least(100, least(50, greatest(0.5::DOUBLE, abs(z / (3 * sqrt(gx * gx + gy * gy)))))) END, 6) + 0 AS h FROM gr",
    "hfun_topo_const_min": _h("CASE WHEN z > -20 AND z < 40 THEN 30 ELSE 10 END"),
    "hfun_topo_const_max": _h("CASE WHEN z > 0 THEN 30 ELSE 100 END"),
    "hfun_topo_func": _h("CASE WHEN z > -50 AND NOT (10 > abs(z) / 2) THEN abs(z) / 2 ELSE 10 END"),
    "hfun_courant": f"WITH {_N}, q AS (SELECT node_id, ({_CH.replace('d', 'z').replace('enz', 'end').replace('ENz', 'END')}) AS ch FROM n WHERE z < 0), h1 AS (SELECT node_id, ch, CASE WHEN ch * 100 / 1000 >= 0.8::DOUBLE THEN ch * 100 / 0.8::DOUBLE ELSE 1000 END AS h FROM q) SELECT node_id, round(CASE WHEN ch * 100 / h <= 0.2::DOUBLE THEN ch * 100 / 0.2::DOUBLE ELSE h END, 6) + 0 AS h FROM h1",
    "hfun_region": _h(f"CASE WHEN {_WODD} AND NOT {_WEDGED} THEN 40 ELSE 10 END"),
    "hfun_region_relaxed": f"WITH {_N}, q AS (SELECT *, {_WODD} AND NOT {_WEDGED} AS m FROM n), d AS (SELECT a.node_id, min((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r)) AS d2 FROM q a, q b WHERE NOT a.m AND b.m GROUP BY 1) SELECT q.node_id, round(CAST(CASE WHEN m THEN 40 WHEN d2 <= 16 AND NOT (10 > 40 * (1 - sqrt(d2) * 0.25::DOUBLE)) THEN 40 * (1 - sqrt(d2) * 0.25::DOUBLE) ELSE 10 END AS DOUBLE), 6) AS h FROM q LEFT JOIN d USING (node_id)",
    "hfun_fold": f"WITH {_N}, q AS (SELECT node_id, z, least(60, CASE WHEN z < 0 THEN 30 ELSE 60 END, CASE WHEN c > 9.5 AND c < 20.5 THEN 20 ELSE 60 END) AS h FROM n) SELECT node_id, round(CAST(least(50, greatest(22, CASE WHEN z > 50 AND h <= 35 THEN 35 ELSE h END)) AS DOUBLE), 6) AS h FROM q",
    "hfun_collector_exact": f"WITH {_OS}, q AS (SELECT *, least(CASE WHEN source_index = 1 AND z > 150000 THEN 40 ELSE 1e30 END, CASE WHEN z < 100000 THEN 25 ELSE 1e30 END) AS h FROM os) SELECT source_index, row, col, CAST(least(80, greatest(5, CASE WHEN source_index IN (0, 2) AND z > 300000 AND h <= 60 THEN 60 ELSE h END)) AS DOUBLE) AS h FROM q",
    "hfun_collector_fast": f"WITH {_OS}, t AS (SELECT row, col, arg_max(z, source_index) AS z FROM os GROUP BY row, col), q AS (SELECT *, least(CASE WHEN z > 150000 THEN 40 ELSE 1e30 END, CASE WHEN z < 100000 THEN 25 ELSE 1e30 END) AS h FROM t) SELECT row, col, CAST(least(80, greatest(5, CASE WHEN z > 300000 AND h <= 60 THEN 60 ELSE h END)) AS DOUBLE) AS h FROM q",
    "hfun_priority": f"WITH {_OS} SELECT source_index, row, col, z FROM os WHERE NOT (source_index < 1 AND col > 4.5 AND col < 20.5 AND row > 4.5 AND row < 30.5) AND NOT (source_index < 2 AND col > 15.5 AND col < 30.5 AND row > 10.5 AND row < 40.5)",
    "raster_xyz": _R + "SELECT col * CAST(0.5 AS DOUBLE) AS x, 10 - row * CAST(0.25 AS DOUBLE) AS y, z FROM ra",
    "raster_bbox": _R + "SELECT min(col * CAST(0.5 AS DOUBLE)) AS x0, min(10 - row * CAST(0.25 AS DOUBLE)) AS y0, max(col * CAST(0.5 AS DOUBLE)) AS x1, max(10 - row * CAST(0.25 AS DOUBLE)) AS y1 FROM ra",
    "raster_window": _R + "SELECT row, col, z FROM ra WHERE row BETWEEN 2 AND 4 AND col BETWEEN 10 AND 21",
    "raster_tiles": _R + ", ti AS (SELECT CAST(unnest(range(0, (SELECT max(row) // 8 + 1 FROM ra))) AS BIGINT) AS tile_row), tj AS (SELECT CAST(unnest(range(0, 5)) AS BIGINT) AS tile_col) SELECT tile_row, tile_col, CAST(count(*) AS BIGINT) AS n, sum(z) AS total FROM ra, ti, tj WHERE row >= tile_row * 8 AND row < tile_row * 8 + 10 AND col >= tile_col * 8 AND col < tile_col * 8 + 10 GROUP BY 1, 2",
    "raster_sample": f"WITH {_N}, {_P} SELECT pid, g AS z FROM p LEFT JOIN n ON c = floor(x) AND r = floor(50 - y)",
    "raster_mask_count": _R + "SELECT row, CAST(count(g) AS BIGINT) AS valid, CAST(count(*) - count(g) AS BIGINT) AS missing FROM ra GROUP BY row",
    "raster_clip": f"WITH {_N} SELECT r AS row, c AS col, g AS z FROM n WHERE {_WODD} OR {_WEDGED}",
    "raster_mask": _R + "SELECT row, col, CASE WHEN col BETWEEN 5 AND 30 THEN g END AS z FROM ra",
    "raster_adjust": _R + "SELECT row, col, CASE WHEN g IS NULL THEN g WHEN col BETWEEN 10 AND 20 AND g < 50 THEN greatest(g, -20) ELSE least(g, 40) END AS z FROM ra",
    "raster_avg_filter": _R + ", v AS (SELECT row, col, CASE WHEN g <= 80 THEN g END AS z FROM ra), mx AS (SELECT max(row) AS mr, max(col) AS mc FROM ra), o AS (SELECT unnest([-1, 0, 1]) AS k), t AS (SELECT a.row, a.col, a.z, least(mr, greatest(0, a.row + i.k)) AS sr, least(mc, greatest(0, a.col + j.k)) AS sc FROM v a, mx, o i, o j) SELECT t.row, t.col, round(CASE WHEN any_value(t.z) IS NOT NULL THEN sum(b.z) / count(b.z) END, 6) + 0 AS z FROM t JOIN v b ON b.row = sr AND b.col = sc GROUP BY t.row, t.col",
    "raster_gaussian": _R + ", mx AS (SELECT max(row) AS mr, max(col) AS mc FROM ra), o AS (SELECT k, exp(-2 * CAST(k * k AS DOUBLE)) / (1 + 2 * exp(CAST(-2 AS DOUBLE))) AS w FROM (SELECT unnest([-1, 0, 1]) AS k)), t AS (SELECT a.row, a.col, i.w * j.w AS w, least(mr, greatest(0, a.row + i.k)) AS sr, least(mc, greatest(0, a.col + j.k)) AS sc FROM ra a, mx, o i, o j) SELECT t.row, t.col, round(sum(b.z * w), 6) + 0 AS z FROM t JOIN ra b ON b.row = sr AND b.col = sc GROUP BY t.row, t.col",
    "raster_gradient": _RG + "SELECT row, col, gx, gy FROM gr",
    "raster_slope": _RG + "SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy) / 30)), 6) AS slope FROM gr",
    "raster_resample_avg": _R + "SELECT row // 4 AS row, col // 4 AS col, round(avg(g), 6) + 0 AS z FROM ra GROUP BY 1, 2",
    "raster_resample_nearest": _R + "SELECT row * 2 + i AS row, col * 2 + j AS col, z FROM ra, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE row < 3",
    "raster_warp_nearest": _R + ", t AS (SELECT row, col, floor(row * 0.75::DOUBLE + col * 0.125::DOUBLE + 0.5::DOUBLE) AS sr, floor(col * 0.75::DOUBLE - row * 0.125::DOUBLE + 0.5::DOUBLE) AS sc FROM ra) SELECT t.row, t.col, b.z FROM t LEFT JOIN ra b ON b.row = sr AND b.col = sc",
    "raster_fill_nearest": _R + ", d AS (SELECT a.row, a.col, arg_min(b.g, ((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) * 1000000 + b.row * 1000 + b.col) AS z FROM ra a, ra b WHERE a.g IS NULL AND b.g IS NOT NULL AND abs(a.row - b.row) <= 10 AND abs(a.col - b.col) <= 10 GROUP BY 1, 2) SELECT ra.row, ra.col, coalesce(g, d.z) AS z FROM ra LEFT JOIN d ON d.row = ra.row AND d.col = ra.col",
    "raster_hypsometry": _R + "SELECT z, CAST(sum(count(*)) OVER (ORDER BY z) AS BIGINT) AS n_cum FROM ra GROUP BY z",
    "raster_slope_bins": _RG + "SELECT CAST(floor((z + 100) / 20) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(degrees(atan(sqrt(gx * gx + gy * gy)))), 6) AS mean_slope FROM gr GROUP BY 1",
    "raster_classes": _R + "SELECT row, col, CASE WHEN g BETWEEN -100 AND -40 THEN 'deep' WHEN g BETWEEN -40 AND 0 THEN 'shelf' WHEN g BETWEEN 0 AND 12 THEN 'shore' WHEN g BETWEEN 12 AND 96 THEN 'land' END AS class FROM ra",
    "raster_contour_segments": _R + ", k AS (SELECT a.row, a.col, a.z AS z0, b.z AS z1, e.z AS z2, d.z AS z3 FROM ra a JOIN ra b ON b.row = a.row AND b.col = a.col + 1 JOIN ra d ON d.row = a.row + 1 AND d.col = a.col JOIN ra e ON e.row = a.row + 1 AND e.col = a.col + 1), sd AS (SELECT row, col, 0 AS side, col + (10 - z0) / (z1 - z0) AS x, CAST(row AS DOUBLE) AS y FROM k WHERE (z0 >= 10) <> (z1 >= 10) UNION ALL SELECT row, col, 1, CAST(col + 1 AS DOUBLE), row + (10 - z1) / (z2 - z1) FROM k WHERE (z1 >= 10) <> (z2 >= 10) UNION ALL SELECT row, col, 2, col + (10 - z3) / (z2 - z3), CAST(row + 1 AS DOUBLE) FROM k WHERE (z3 >= 10) <> (z2 >= 10) UNION ALL SELECT row, col, 3, CAST(col AS DOUBLE), row + (10 - z0) / (z3 - z0) FROM k WHERE (z0 >= 10) <> (z3 >= 10)) SELECT row, col, side, round(x, 6) AS x, round(y, 6) AS y FROM sd",
    "raster_domain_area": _R + "SELECT row, CAST(count(*) AS BIGINT) AS cells FROM ra WHERE g BETWEEN -50 AND 20 GROUP BY row",
    "channel_cells": _R + ", i AS (SELECT row, col FROM ra WHERE z <= 60), o AS (SELECT row, col FROM ra WHERE z > 60), er AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE (o.row - i.row) * (o.row - i.row) + (o.col - i.col) * (o.col - i.col) <= 2.25)) SELECT row, col FROM i WHERE NOT EXISTS (SELECT 1 FROM er WHERE (er.row - i.row) * (er.row - i.row) + (er.col - i.col) * (er.col - i.col) <= 2.25)",
    "mosaic_priority": f"WITH {_SRC} SELECT row, col, arg_max(z, raster_id * 1000000000 + tie) AS z FROM o GROUP BY row, col",
    "total_bounds": f"WITH {_P} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p",
    "line_split": f"WITH {_L}, q AS (SELECT *, max(seq) OVER (PARTITION BY line_id) AS la FROM l) SELECT line_id, part, seq, x, y FROM (SELECT line_id, unnest(CASE WHEN seq % 3 = 0 AND seq > 0 AND seq < la THEN [seq // 3 - 1, seq // 3] WHEN seq % 3 = 0 AND seq > 0 THEN [seq // 3 - 1] ELSE [seq // 3] END) AS part, seq, x, y FROM q)",
    "line_resample": f"WITH {_L}, g AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)), d AS (SELECT line_id, seq, x, y, sum(coalesce(s, 0)) OVER (PARTITION BY line_id ORDER BY seq) AS d FROM g), e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(d) OVER w AS d2, max(d) OVER (PARTITION BY line_id) AS t FROM d WINDOW w AS (PARTITION BY line_id ORDER BY seq)), k AS (SELECT CAST(unnest(range(0, 20000)) AS BIGINT) AS k), a AS (SELECT line_id, k, x + (k * 2.5::DOUBLE - d) / (d2 - d) * (x2 - x) AS x, y + (k * 2.5::DOUBLE - d) / (d2 - d) * (y2 - y) AS y FROM e JOIN k ON k * 2.5::DOUBLE >= d AND k * 2.5::DOUBLE < d2 WHERE t >= 2.5 UNION ALL SELECT line_id, CAST(ceil(t / 2.5::DOUBLE) AS BIGINT), x, y FROM e WHERE x2 IS NULL AND t >= 2.5 UNION ALL SELECT line_id, seq, x, y FROM e WHERE t < 2.5) SELECT line_id, k, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM a",
    "line_simplify_collinear": f"WITH {_L}, q AS (SELECT line_id, seq, x, CAST(floor(y / 25) AS DOUBLE) AS y FROM l), s AS (SELECT * FROM (SELECT *, coalesce(x = lag(x) OVER w AND y = lag(y) OVER w, false) AS dup FROM q WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE NOT dup), e AS (SELECT line_id, seq, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, seq, x, y FROM e WHERE NOT coalesce((x - px) * (ny - y) - (y - py) * (nx - x) = 0 AND (x - px) * (nx - x) + (y - py) * (ny - y) > 0, false)",
    "ring_area": f"WITH {_L}, e AS (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, sum(x * ny - nx * y) / 2 AS area FROM e GROUP BY line_id",
    "remove_small_holes": f"WITH {_boxes('0.5')}, r AS (SELECT poly_id, 0 AS ring, 'exterior' AS ring_type, CAST(12 AS DOUBLE) AS area FROM b UNION ALL SELECT poly_id, 1, 'interior', CAST(12 * (poly_id % 5) / 16 AS DOUBLE) FROM b), t AS (SELECT *, sum(CASE WHEN ring = 0 THEN area ELSE -area END) OVER (PARTITION BY poly_id) AS net FROM r) SELECT poly_id, ring, ring_type, area FROM t WHERE ring = 0 OR area / net > 0.1",
    "overlapping_boxes": f"WITH {_boxes('0.5')} SELECT a.poly_id AS a, b.poly_id AS b FROM b a JOIN b b ON a.poly_id < b.poly_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
    "points_in_boxes": f"WITH {_P}, {_boxes('0.5')} SELECT pid, poly_id FROM p JOIN b ON x > x0 AND x < x1 AND y > y0 AND y < y1",
    "points_in_closed_boxes": f"WITH {_N}, {_boxes('0')} SELECT node_id, poly_id FROM n JOIN b ON c >= x0 AND c <= x1 AND r >= y0 AND r <= y1",
    "nearest_feature": f"WITH {_N}, {_F}, d AS (SELECT node_id, fid, (c - fx) * (c - fx) + (r - fy) * (r - fy) AS d2 FROM n, f) SELECT node_id, arg_min(fid, d2 * 1000000 + fid) AS fid, min(d2) AS d2 FROM d GROUP BY node_id",
    "interp_linear": f"WITH {_N}, {_P}, q AS (SELECT pid, x - floor(x) AS fx, y - floor(y) AS fy, floor(x) AS c0, floor(y) AS r0 FROM p), w AS (SELECT pid, r0 + i AS row, c0 + j AS col, (CASE WHEN i = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN j = 1 THEN fx ELSE 1 - fx END) AS w FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT pid, sum(w * g) AS z FROM w LEFT JOIN n ON r = row AND c = col WHERE w > 0 GROUP BY pid HAVING count(g) = count(*)",
    "interp_nearest": f"WITH {_N}, {_P} SELECT pid, g AS z FROM p JOIN n ON r = floor(y + 0.5) AND c = floor(x + 0.5) WHERE g IS NOT NULL",
    "interp_mesh_to_mesh": f"WITH {_M}, tr AS (SELECT elem_id * 2 AS e, CASE WHEN len(nodes) = 4 THEN [nodes[1], nodes[2], nodes[4]] ELSE nodes END AS k FROM m UNION ALL SELECT elem_id * 2 + 1, [nodes[2], nodes[3], nodes[4]] FROM m WHERE len(nodes) = 4), tx AS (SELECT e, a.c AS x0, a.r AS y0, a.z AS z0, b.c AS x1, b.r AS y1, b.z AS z1, d.c AS x2, d.r AS y2, d.z AS z2 FROM tr JOIN n a ON a.node_id = k[1] JOIN n b ON b.node_id = k[2] JOIN n d ON d.node_id = k[3]), {_P}, w AS (SELECT pid, e, z0, z1, z2, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS w0, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / ((y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)) AS w1 FROM p JOIN tx ON x BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND y BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)) SELECT pid, round(arg_min(w0 * z0 + w1 * z1 + (1 - w0 - w1) * z2, e), 6) + 0 AS value FROM w WHERE w0 >= 0 AND w1 >= 0 AND w0 + w1 <= 1 GROUP BY pid",
    "mesh_contour_segments": f"WITH {_M}, tr AS (SELECT elem_id * 2 AS elem_id, CASE WHEN len(nodes) = 4 THEN [nodes[1], nodes[2], nodes[4]] ELSE nodes END AS k FROM m UNION ALL SELECT elem_id * 2 + 1, [nodes[2], nodes[3], nodes[4]] FROM m WHERE len(nodes) = 4), sd AS (SELECT elem_id, least(k[i + 1], k[(i + 1) % 3 + 1]) AS u, greatest(k[i + 1], k[(i + 1) % 3 + 1]) AS v FROM (SELECT *, unnest([0, 1, 2]) AS i FROM tr)) SELECT elem_id, u, v, round(a.c + (10 - a.z) / (b.z - a.z) * (b.c - a.c), 6) + 0 AS x, round(a.r + (10 - a.z) / (b.z - a.z) * (b.r - a.r), 6) + 0 AS y FROM sd JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v WHERE (a.z >= 10) <> (b.z >= 10)",
    "web_mercator": f"WITH {_P} SELECT pid, round(radians(x * 8 - 160) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(y * 3 - 75) / 2)) * 6378137, 3) AS my FROM p",
    "courant_number": f"WITH {_N}, q AS (SELECT node_id, z AS d, c + 100 AS s FROM n) SELECT node_id, round(({_CH}) * 150 / s, 6) AS courant FROM q",
    "particle_velocity": f"WITH {_N}, q AS (SELECT node_id, z AS d FROM n) SELECT node_id, round({_U}, 6) AS velocity FROM q",
    "stream_cell_minimum": "SELECT CAST(user_id % 40 AS BIGINT) AS col, min(value) AS low, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
    "hull_net_area": f"WITH RECURSIVE {_M}{_S}{_corner()}{_AREA}{_COMP} SELECT component, sum(area) AS area FROM cp JOIN ar USING (elem_id) GROUP BY component",
    "mesh_domain": f"WITH {_M}{_S} SELECT elem_id, {_TEXT} FROM m WHERE elem_id IN (SELECT elem_id FROM en JOIN n USING (node_id) WHERE z > -30 AND z < 30)",
    "domain_collect": f"WITH {_SRC} SELECT DISTINCT row, col FROM o WHERE z BETWEEN 100000 AND 250000",
    "domain_combine": f"WITH {_N}, {_SRC}, q AS (SELECT * FROM o WHERE row BETWEEN 5 AND 30 AND col BETWEEN 4 AND 25), x AS (SELECT raster_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM q GROUP BY 1) SELECT DISTINCT row, col, 'raster' AS origin FROM q WHERE z BETWEEN 100000 AND 250000 UNION ALL SELECT r, c, 'base' FROM n WHERE NOT EXISTS (SELECT 1 FROM x WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)",
    "domain_borders": _R + ", d AS (SELECT row, col FROM ra WHERE z BETWEEN 0 AND 60), s AS (SELECT row, col, 0 AS side, row - 1 AS r, col AS c FROM d UNION ALL SELECT row, col, 1, row, col + 1 FROM d UNION ALL SELECT row, col, 2, row + 1, col FROM d UNION ALL SELECT row, col, 3, row, col - 1 FROM d) SELECT row, col, side FROM s WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.row = s.r AND x.col = s.c)",
    "domain_components": "WITH RECURSIVE " + _R[5:] + ", d AS (SELECT row, col, row * 40 + col AS k FROM ra WHERE z BETWEEN 0 AND 60), e AS (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), t(x, y) AS (SELECT k, k FROM d UNION SELECT e.b, t.y FROM t JOIN e ON e.a = t.x WHERE t.y < e.b), c AS (SELECT x, min(y) AS component FROM t GROUP BY x) SELECT row, col, component FROM d JOIN c ON k = x",
    "domain_sieve": "WITH RECURSIVE " + _R[5:] + ", d AS (SELECT row, col, row * 40 + col AS k FROM ra WHERE z BETWEEN 0 AND 60), e AS (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), t(x, y) AS (SELECT k, k FROM d UNION SELECT e.b, t.y FROM t JOIN e ON e.a = t.x WHERE t.y < e.b), c AS (SELECT x, min(y) AS component FROM t GROUP BY x) SELECT row, col, component FROM d JOIN c ON k = x WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 6)",
    "remove_slivers": f"WITH {_M}{_S}{_corner('z / 128')}{_AREA}, sm AS (SELECT node_id FROM en WHERE elem_id IN (SELECT elem_id FROM ar WHERE etype = 'tria' AND abs(area) < 0.2)) SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM sm))",
    "cleanup_pinched": f"WITH {_M}{_S}, pn AS (SELECT node_id FROM (SELECT u AS node_id FROM bd UNION ALL SELECT v FROM bd) GROUP BY node_id HAVING count(*) > 2) SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM pn))",
    "clip_mesh_by_mesh": f"WITH {_M}{_S}{_BOX}, k AS (SELECT elem_id FROM en GROUP BY elem_id HAVING sum(CASE WHEN node_id IN (SELECT node_id FROM bx) THEN 1 ELSE 0 END) = count(*)), kn AS (SELECT DISTINCT c, r FROM en JOIN k USING (elem_id) JOIN n USING (node_id)), hit AS (SELECT node_id FROM n WHERE EXISTS (SELECT 1 FROM kn WHERE (kn.c - n.c) * (kn.c - n.c) + (kn.r - n.r) * (kn.r - n.r) <= 2.25)) SELECT elem_id, {_TEXT} FROM m WHERE elem_id NOT IN (SELECT elem_id FROM en WHERE node_id IN (SELECT node_id FROM hit))",
    "snap_nodes": f"WITH {_N}, {_F} SELECT node_id, min(fid) AS fid FROM n JOIN f ON fx = c AND fy = r GROUP BY node_id",
    "interp_provenance": f"WITH {_N}, {_SRC}, q AS (SELECT node_id, raster_id, o.z, row_number() OVER (PARTITION BY node_id ORDER BY raster_id DESC, tie DESC) AS k FROM n JOIN o ON o.row = n.r AND o.col = n.c) SELECT node_id, raster_id, z FROM q WHERE k = 1",
    "boxes_smaller_than": f"WITH {_boxes('0.5')} SELECT poly_id, (x1 - x0) * (y1 - y0 + poly_id % 4) AS area FROM b WHERE (x1 - x0) * (y1 - y0 + poly_id % 4) < 20",
    "box_largest": f"WITH {_boxes('0.5')} SELECT poly_id, (x1 - x0) * (y1 - y0 + poly_id % 4) AS area FROM b ORDER BY area DESC, poly_id LIMIT 1",
    "line_redistribute": f"WITH {_L}, g AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)), d AS (SELECT line_id, seq, x, y, sum(coalesce(s, 0)) OVER (PARTITION BY line_id ORDER BY seq) AS d FROM g), e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(d) OVER w AS d2, max(d) OVER (PARTITION BY line_id) AS t FROM d WINDOW w AS (PARTITION BY line_id ORDER BY seq)), q AS (SELECT *, greatest(1, floor(t / 3 + 0.5)) AS parts FROM e), k AS (SELECT CAST(unnest(range(0, 20000)) AS BIGINT) AS k), a AS (SELECT line_id, k, x + (k * (t / parts) - d) / (d2 - d) * (x2 - x) AS x, y + (k * (t / parts) - d) / (d2 - d) * (y2 - y) AS y FROM q JOIN k ON k < parts AND k * (t / parts) >= d AND k * (t / parts) < d2 UNION ALL SELECT line_id, CAST(parts AS BIGINT), x, y FROM q WHERE x2 IS NULL AND t > 0) SELECT line_id, k, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM a",
    "line_lengths": f"WITH {_L}, g AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM l WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, round(sum(coalesce(s, 0)), 6) AS length, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY line_id",
    "negative_share": _R + "SELECT row, round(avg(CASE WHEN g < 0 THEN CAST(1 AS DOUBLE) WHEN g >= 0 THEN 0 END), 6) AS share FROM ra GROUP BY row",
    "zone_of_bounds": f"WITH {_P}, b AS (SELECT (min(x * 2 - 100) + max(x * 2 - 100)) / 2 AS lon, (min(y + 10) + max(y + 10)) / 2 AS lat FROM p) SELECT CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone, lat < 0 AS south FROM b",
    "hfun_mesh_feature": f"WITH {_M}{_S}, {_F}, le AS (SELECT u, v, sqrt(CAST((a.c - b.c) * (a.c - b.c) + (a.r - b.r) * (a.r - b.r) AS DOUBLE)) AS d FROM ed JOIN n a ON a.node_id = u JOIN n b ON b.node_id = v), e2 AS (SELECT u AS node_id, d FROM le UNION ALL SELECT v, d FROM le), h AS (SELECT n.node_id, coalesce(avg(d), 0) * 20 AS h FROM n LEFT JOIN e2 USING (node_id) GROUP BY 1), q AS (SELECT node_id, sqrt(min((c - fx) * (c - fx) + (r - fy) * (r - fy))) AS d FROM n, f GROUP BY node_id) SELECT node_id, round(least(h, least(30, 0.5::DOUBLE * 5 * d + 5)), 6) AS h FROM h JOIN q USING (node_id)",
    "raster_generic_range": _R + ", mx AS (SELECT max(row) AS mr, max(col) AS mc FROM ra), o AS (SELECT unnest([-1, 0, 1]) AS k), t AS (SELECT a.row, a.col, least(mr, greatest(0, a.row + i.k)) AS sr, least(mc, greatest(0, a.col + j.k)) AS sc FROM ra a, mx, o i, o j) SELECT t.row, t.col, max(b.z) - min(b.z) AS z FROM t JOIN ra b ON b.row = sr AND b.col = sc GROUP BY t.row, t.col",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k",
    "grd_lines": f"WITH {_M}, ei AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN etype = 'tria' THEN 0 ELSE 1 END, elem_id) AS id FROM m) SELECT 0 AS section, CAST(0 AS BIGINT) AS id, 'lattice' AS line UNION ALL SELECT 1, 0, concat_ws(' ', (SELECT count(*) FROM m), (SELECT count(*) FROM n)) UNION ALL SELECT 2, node_id + 1, concat_ws(' ', node_id + 1, printf('%.16E', CAST(c AS DOUBLE)), printf('%.16E', CAST(r AS DOUBLE)), printf('%.16E', 0 - z)) FROM n UNION ALL SELECT 3, id, concat_ws(' ', id, len(nodes), array_to_string(list_transform(nodes, lambda x: CAST(x + 1 AS VARCHAR)), ' ')) FROM ei",
    "sms2dm_lines": f"WITH {_M}, ei AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN etype = 'tria' THEN 0 ELSE 1 END, elem_id) AS id FROM m) SELECT 0 AS section, CAST(0 AS BIGINT) AS id, 'MESH2D' AS line UNION ALL SELECT CASE WHEN etype = 'tria' THEN 1 ELSE 2 END, id, concat_ws(' ', CASE WHEN etype = 'tria' THEN 'E3T' ELSE 'E4Q' END, id, array_to_string(list_transform(nodes, lambda x: CAST(x + 1 AS VARCHAR)), ' ')) FROM ei UNION ALL SELECT 3, node_id + 1, concat_ws(' ', 'ND', node_id + 1, printf('%.16E', CAST(c AS DOUBLE)), printf('%.16E', CAST(r AS DOUBLE)), printf('%.16E', z)) FROM n",
    "interp_fill_nearest": f"WITH {_N}, {_P}, {_F}, q AS (SELECT pid, x - floor(x) AS fx, y - floor(y) AS fy, floor(x) AS c0, floor(y) AS r0 FROM p), w AS (SELECT pid, r0 + i AS row, c0 + j AS col, (CASE WHEN i = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN j = 1 THEN fx ELSE 1 - fx END) AS w FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), li AS (SELECT pid, sum(w * g) AS z FROM w LEFT JOIN n ON r = row AND c = col WHERE w > 0 GROUP BY pid HAVING count(g) = count(*)), ne AS (SELECT pid, CAST(arg_min(fid, ((x - fx) * (x - fx) + (y - fy) * (y - fy)) * 1000000 + fid) AS DOUBLE) AS v FROM p, f GROUP BY pid) SELECT pid, coalesce(z, v) AS value FROM ne LEFT JOIN li USING (pid)",
    "utm_project": f"""WITH {_P}, k AS (SELECT pid, x * 8 - 160 AS lon, y * 3 - 75 AS lat FROM p),
z AS (SELECT pid, lon, lat, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 END AS INTEGER) AS zone FROM k WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90
      UNION ALL SELECT pid, lon, lat, NULL FROM k WHERE NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)),
c AS (SELECT CAST(1 AS DOUBLE) / 298.257222101 / (2 - CAST(1 AS DOUBLE) / 298.257222101) AS n, sqrt(CAST(1 AS DOUBLE) / 298.257222101 * (2 - CAST(1 AS DOUBLE) / 298.257222101)) AS ec),
a AS (SELECT pid, zone, lat, sinh(atanh(sin(radians(lat))) - ec * atanh(ec * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS l, n FROM z, c),
b AS (SELECT pid, zone, lat, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, CAST(0.9996 AS DOUBLE) * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS m FROM a)
SELECT pid, zone, round(m * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) + 500000, 3) AS easting,
       round(m * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing FROM b""",
    "interp_cubic": f"WITH {_N}, {_P}, q AS (SELECT pid, x - floor(x) AS a, y - floor(y) AS b, floor(x) AS c0, floor(y) AS r0 FROM p), w AS (SELECT pid, r0 + i - 1 AS row, c0 + j - 1 AS col, CASE i WHEN 0 THEN ((-0.5 * b + 1) * b - 0.5) * b WHEN 1 THEN (1.5 * b - 2.5) * b * b + 1 WHEN 2 THEN ((-1.5 * b + 2) * b + 0.5) * b ELSE (0.5 * b - 0.5) * b * b END * CASE j WHEN 0 THEN ((-0.5 * a + 1) * a - 0.5) * a WHEN 1 THEN (1.5 * a - 2.5) * a * a + 1 WHEN 2 THEN ((-1.5 * a + 2) * a + 0.5) * a ELSE (0.5 * a - 0.5) * a * a END AS w FROM q, (SELECT unnest([0, 1, 2, 3]) AS i), (SELECT unnest([0, 1, 2, 3]) AS j)) SELECT pid, round(sum(w * z), 6) + 0 AS z FROM w JOIN n ON r = row AND c = col GROUP BY pid HAVING count(*) = 16",
    "hfun_collector_specs": _RG.rstrip() + f", {_F}, d AS (SELECT row, col, sqrt(min((col - fx) * (col - fx) + (row - fy) * (row - fy))) AS d FROM gr, f GROUP BY row, col), h AS (SELECT row, col, z, least(1e30, CASE WHEN z > 40 OR (gx = 0 AND gy = 0) THEN 1e30 ELSE least(50, greatest(3, abs(z / (3 * sqrt(gx * gx + gy * gy))))) END, CASE WHEN z > -90 AND z < 70 THEN 45 ELSE 1e30 END, greatest(2, least(40, 5 * d + 10)), CASE WHEN col > 3.5 AND col < 6.5 THEN 7 ELSE 1e30 END) AS h FROM gr JOIN d USING (row, col)), t AS (SELECT row, col, CASE WHEN z > 60 AND NOT h > 20 THEN 20 ELSE h END AS h FROM h), u AS (SELECT row, col, CASE WHEN col > 30.5 AND row < 3.5 AND NOT h < 8 THEN 8 ELSE h END AS h FROM t) SELECT row * 40 + col AS node_id, round(CAST(least(60, greatest(2, h)) AS DOUBLE), 6) AS h FROM u",
}


# -- rings, polygons and contours: chains as recursions ------------------------------------

_RING = """,
de AS (SELECT elem_id, nodes[i + 1] AS a, nodes[(i + 1) % len(nodes) + 1] AS b FROM (SELECT *, unnest(range(0, len(nodes))) AS i FROM m)),
db AS (SELECT component, a, b FROM de JOIN bd ON least(a, b) = u AND greatest(a, b) = v JOIN cp USING (elem_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY component, a ORDER BY b) AS o, row_number() OVER (PARTITION BY component, b ORDER BY a) AS q FROM db),
pv AS (SELECT e.a * 1000000 + e.b AS i, f.a * 1000000 + f.b AS p FROM rk e JOIN rk f ON e.component = f.component AND f.b = e.a AND f.q = e.o),
cl(i, x) AS (SELECT i, i FROM pv UNION SELECT cl.i, pv.p FROM cl JOIN pv ON pv.i = cl.x),
ro AS (SELECT i, min(x) AS root FROM cl GROUP BY i),
rn AS (SELECT component, a, b, root, CAST(dense_rank() OVER (PARTITION BY component ORDER BY root) - 1 AS INTEGER) AS ring FROM rk JOIN ro ON i = a * 1000000 + b),
rx AS (SELECT component, ring, CAST(sum(p.c * q.r - q.c * p.r) AS DOUBLE) / 2 AS area FROM rn JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b GROUP BY 1, 2),
rg AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY abs(area) DESC, ring) = 1 THEN 'exterior' ELSE 'interior' END AS ring_type FROM rx)"""
_TYPED = """,
ty AS (SELECT a, b, CASE WHEN ring_type = 'interior' THEN 'interior' WHEN p.z >= 0 OR q.z >= 0 THEN 'land' ELSE 'open' END AS btype
       FROM rn JOIN rg USING (component, ring) JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b),
tb AS (SELECT *, CAST(CASE btype WHEN 'interior' THEN 1 WHEN 'land' THEN 0 END AS INTEGER) AS ibtype FROM ty)"""
_HULL = f"WITH RECURSIVE {_M}{_S}{_COMP}{_RING}"

_POLY = (
    "WITH RECURSIVE "
    + _N
    + """,
ra AS (SELECT r AS row, c AS col, z, g FROM n), d AS (SELECT row, col FROM ra WHERE z BETWEEN 0 AND 60),
f AS (SELECT * FROM (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) v(k, dr, dc)),
e AS (SELECT d.row, d.col, k, dr, dc FROM d, f WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.row = d.row + dr AND x.col = d.col + dc)),
o AS (SELECT e.*, t.dr AS tr, t.dc AS tc, EXISTS (SELECT 1 FROM d x WHERE x.row = e.row + t.dr AND x.col = e.col + t.dc) AS over,
             EXISTS (SELECT 1 FROM d x WHERE x.row = e.row + t.dr + e.dr AND x.col = e.col + t.dc + e.dc) AS corner FROM e JOIN f t ON t.k = (e.k + 1) % 4),
nx AS (SELECT (row * 1000 + col) * 4 + k AS i, row, col, k,
              CASE WHEN NOT over THEN (row * 1000 + col) * 4 + (k + 1) % 4 WHEN NOT corner THEN ((row + tr) * 1000 + col + tc) * 4 + k ELSE ((row + tr + dr) * 1000 + col + tc + dc) * 4 + (k + 3) % 4 END AS j,
              CASE WHEN k IN (1, 2) THEN col + 0.5::DOUBLE ELSE col - 0.5::DOUBLE END AS x, CASE WHEN k IN (2, 3) THEN row + 0.5::DOUBLE ELSE row - 0.5::DOUBLE END AS y,
              CASE WHEN k IN (0, 1) THEN col + 0.5::DOUBLE ELSE col - 0.5::DOUBLE END AS x2, CASE WHEN k IN (1, 2) THEN row + 0.5::DOUBLE ELSE row - 0.5::DOUBLE END AS y2 FROM o),
cl(i, x) AS (SELECT i, i FROM nx UNION SELECT cl.i, nx.j FROM cl JOIN nx ON nx.i = cl.x),
ro AS (SELECT i, min(x) AS root FROM cl GROUP BY i),
lk AS (SELECT a.row * 40 + a.col AS a, b.row * 40 + b.col AS b FROM d a JOIN d b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
re(x, y) AS (SELECT row * 40 + col, row * 40 + col FROM d UNION SELECT lk.b, re.y FROM re JOIN lk ON lk.a = re.x WHERE re.y < lk.b),
cp AS (SELECT x, min(y) AS poly FROM re GROUP BY x),
g AS (SELECT nx.*, poly, root, dense_rank() OVER (PARTITION BY poly ORDER BY root) - 1 AS ring, CASE WHEN j % 4 <> k THEN 1 ELSE 0 END AS turn FROM nx JOIN ro USING (i) JOIN cp ON cp.x = nx.row * 40 + nx.col),
rg AS (SELECT poly, CAST(ring AS BIGINT) AS ring, CASE WHEN ring = 0 THEN 'exterior' ELSE 'interior' END AS ring_type, CAST(sum(turn) AS BIGINT) AS n_corners, sum(x * y2 - x2 * y) / 2 AS area, CAST(count(*) AS DOUBLE) AS length FROM g GROUP BY poly, ring)
"""
)
_LINES = (
    "WITH RECURSIVE "
    + _N
    + """,
b AS (SELECT a.r, a.c, a.z AS z0, p.z AS z1, q.z AS z2, s.z AS z3 FROM n a JOIN n p ON p.r = a.r AND p.c = a.c + 1 JOIN n q ON q.r = a.r + 1 AND q.c = a.c + 1 JOIN n s ON s.r = a.r + 1 AND s.c = a.c),
k AS (SELECT r, c, 0 AS k, z0 AS za, z1 AS zb, (r * 1000 + c) * 2 AS p, c + (10 - z0) / (z1 - z0) AS x, CAST(r AS DOUBLE) AS y FROM b WHERE (z0 >= 10) <> (z1 >= 10)
      UNION ALL SELECT r, c, 1, z1, z2, (r * 1000 + c + 1) * 2 + 1, c + 1, r + (10 - z1) / (z2 - z1) FROM b WHERE (z1 >= 10) <> (z2 >= 10)
      UNION ALL SELECT r, c, 2, z2, z3, ((r + 1) * 1000 + c) * 2, c + (10 - z3) / (z2 - z3), r + 1 FROM b WHERE (z2 >= 10) <> (z3 >= 10)
      UNION ALL SELECT r, c, 3, z3, z0, (r * 1000 + c) * 2 + 1, c, r + (10 - z0) / (z3 - z0) FROM b WHERE (z3 >= 10) <> (z0 >= 10)),
sg AS (SELECT u.p AS i, arg_min(v.p, (v.k - u.k + 4) % 4) AS j FROM k u JOIN k v USING (r, c) WHERE u.za >= 10 AND v.za < 10 GROUP BY u.r, u.c, u.p),
pt AS (SELECT DISTINCT p, x, y FROM k),
cl(i, x) AS (SELECT i, i FROM sg UNION SELECT cl.i, sg.i FROM cl JOIN sg ON sg.j = cl.x),
ro AS (SELECT i, coalesce(min(CASE WHEN x NOT IN (SELECT j FROM sg) THEN x END), min(x)) AS root FROM cl GROUP BY i),
al AS (SELECT root, i AS p FROM ro UNION ALL SELECT root, j FROM ro JOIN sg USING (i) WHERE j NOT IN (SELECT i FROM sg) OR j = root)
SELECT (root // 2000) || '-' || (root // 2 % 1000) || '-' || (root % 2) AS line, root IN (SELECT j FROM sg) AS closed, CAST(count(*) AS BIGINT) AS n, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy
FROM al JOIN pt USING (p) GROUP BY root"""
)


def _border(ring: list[tuple[float, float]], step: float) -> str:
    import math

    out = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        k = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / step))
        out += [f"({x1 + (x2 - x1) * i / k!r}::DOUBLE, {y1 + (y2 - y1) * i / k!r}::DOUBLE)" for i in range(k)]
    return ", ".join(out)


ORACLE |= {
    "hull_rings": _HULL + " SELECT component, ring, area, ring_type FROM rg",
    "boundaries_auto": _HULL + _TYPED + " SELECT a, b, btype, ibtype FROM tb",
    "boundaries_region": _HULL + _TYPED + """, ch AS (SELECT a, b, btype, ibtype, a IN (SELECT node_id FROM n WHERE c > 30.5 AND r < 2.5) OR b IN (SELECT node_id FROM n WHERE c > 30.5 AND r < 2.5) AS hit FROM tb WHERE btype <> 'interior')
SELECT CASE WHEN hit THEN 'open' ELSE btype END AS btype, CASE WHEN NOT hit THEN ibtype END AS ibtype, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY 1, 2""",
    "boundary_runs": _HULL + _TYPED + """, kn AS (SELECT a * 3 + kind AS a, b * 3 + kind AS b, btype FROM (SELECT *, CASE btype WHEN 'open' THEN 0 WHEN 'land' THEN 1 ELSE 2 END AS kind FROM tb)),
un AS (SELECT a, b FROM kn UNION SELECT b, a FROM kn), rr(x, y) AS (SELECT a, a FROM un UNION SELECT un.b, rr.y FROM rr JOIN un ON un.a = rr.x WHERE rr.y < un.b), rm AS (SELECT x, min(y) AS root FROM rr GROUP BY x)
SELECT CAST(root // 3 AS BIGINT) AS bnd, btype, CAST(count(*) AS BIGINT) AS n_edges FROM kn JOIN rm ON rm.x = kn.a GROUP BY 1, 2""",
    "boundary_chains": f"WITH RECURSIVE {_M}{_S}" + """,
de AS (SELECT nodes[i + 1] AS a, nodes[(i + 1) % len(nodes) + 1] AS b FROM (SELECT *, unnest(range(0, len(nodes))) AS i FROM m)),
db AS (SELECT a, b, CASE WHEN p.z >= 0 OR q.z >= 0 THEN 'land' ELSE 'open' END AS btype FROM de JOIN bd ON least(a, b) = u AND greatest(a, b) = v JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b),
rk AS (SELECT *, a * 1000000 + b AS i, row_number() OVER (PARTITION BY btype, a ORDER BY b) AS o, row_number() OVER (PARTITION BY btype, b ORDER BY a) AS q FROM db),
pv AS (SELECT e.i, f.i AS p FROM rk e JOIN rk f ON e.btype = f.btype AND f.b = e.a AND f.q = e.o),
cl(i, x) AS (SELECT i, i FROM rk UNION SELECT cl.i, pv.p FROM cl JOIN pv ON pv.i = cl.x),
ro AS (SELECT i, coalesce(min(CASE WHEN x NOT IN (SELECT i FROM pv) THEN x END), min(x)) AS root FROM cl GROUP BY i),
fw(i, root, seq) AS (SELECT i, root, 0 FROM ro WHERE i = root UNION ALL SELECT pv.i, root, seq + 1 FROM fw JOIN pv ON pv.p = fw.i WHERE pv.i <> root),
al AS (SELECT root, btype, seq, a AS node_id FROM fw JOIN rk USING (i) UNION ALL SELECT root, arg_max(btype, seq), max(seq) + 1, arg_max(b, seq) FROM fw JOIN rk USING (i) GROUP BY root)
SELECT (root // 1000000) || '-' || (root % 1000000) AS chain, btype, CAST(seq AS INTEGER) AS seq, node_id FROM al""",
    "raster_polygons": _POLY + "SELECT poly, ring, ring_type, n_corners, area, length FROM rg",
    "polygon_areas": _POLY + "SELECT poly, CAST(count(*) AS BIGINT) AS n_rings, sum(area) AS area FROM rg GROUP BY poly",
    "polygon_triangles": _POLY + "SELECT poly, CAST(sum(n_corners) + 2 * count(*) - 4 AS BIGINT) AS n, sum(area) AS area FROM rg GROUP BY poly",
    "polygon_points": _POLY + f", {_P} SELECT pid, poly FROM p JOIN cp ON cp.x = CAST(floor(p.y + 0.625) AS BIGINT) * 40 + CAST(floor(p.x + 0.625) AS BIGINT) WHERE floor(p.x + 0.625) < 40",
    "polygon_round_trip": _POLY + "SELECT poly, ring, ring_type, n_corners FROM rg",
    "contour_lines": _LINES,
    "hfun_patch_expansion": f"WITH {_N}, w(x, y) AS (VALUES {_border(_WEDGE, 0.5)}), d AS (SELECT node_id, sqrt(min((c - x) * (c - x) + (r - y) * (r - y))) AS d FROM n, w GROUP BY node_id) "
    f"SELECT node_id, round(CAST(CASE WHEN {_WODD} OR {_WEDGED} THEN 15 ELSE least(60, 0.25::DOUBLE * 15 * d + 15) END AS DOUBLE), 6) AS h FROM n JOIN d USING (node_id)",
    "grd_boundaries": f"WITH {_N}, q AS (SELECT node_id, CASE WHEN r = 0 THEN 1 WHEN c = 0 THEN 1 ELSE 2 END AS bnd, CASE WHEN r = 0 THEN 4 ELSE 5 END AS section, CASE WHEN r = 0 THEN NULL WHEN c = 0 THEN 20 ELSE 1 END AS ib,"
    " CASE WHEN r = 0 THEN c WHEN c = 0 THEN r - 1 ELSE c - 5 END AS seq FROM n WHERE r = 0 OR c = 0 OR (r = 1 AND c BETWEEN 5 AND 8)),"
    " t AS (SELECT s.section, what, count(DISTINCT bnd) AS k, count(bnd) AS m FROM (VALUES (4, 'open boundaries'), (5, 'land boundaries')) s(section, what) LEFT JOIN q USING (section) GROUP BY 1, 2)"
    " SELECT CAST(section AS INTEGER) AS section, CAST(-2 AS BIGINT) AS id, k || ' = Number of ' || what AS line FROM t UNION ALL SELECT section, -1, m || ' = Total number of nodes of ' || what FROM t"
    " UNION ALL SELECT section, bnd * 4294967296, CASE WHEN section = 4 THEN CAST(count(*) AS VARCHAR) ELSE count(*) || ' ' || max(ib) END FROM q GROUP BY section, bnd UNION ALL SELECT section, bnd * 4294967296 + seq + 1, CAST(node_id + 1 AS VARCHAR) FROM q",
    "mesh_difference": f"WITH {_M}, e AS (SELECT elem_id, nodes, unnest(nodes) AS node_id FROM m), k AS (SELECT elem_id, CAST(sum(c) AS DOUBLE) / count(*) AS x, CAST(sum(r) AS DOUBLE) / count(*) AS y FROM e JOIN n USING (node_id) GROUP BY elem_id),"
    f" d AS (SELECT r, c FROM n WHERE z BETWEEN 0 AND 60 AND c BETWEEN 4 AND 30) SELECT elem_id, {_TEXT} FROM m JOIN k USING (elem_id) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.c = floor(k.x + 0.5) AND d.r = floor(k.y + 0.5))",
    "raster_windows": f"WITH {_N}, h AS (SELECT max(r) + 1 AS rows FROM n), w AS (SELECT unnest(range(0, CAST(3 * ((rows + 15) // 16) AS BIGINT))) AS id, rows FROM h), q AS (SELECT id, id // 3 * 16 AS r0, id % 3 * 16 AS c0, rows FROM w),"
    " s AS (SELECT CAST(r0 AS BIGINT) AS r0, CAST(c0 AS BIGINT) AS c0, CAST(least(16, rows - r0) AS BIGINT) AS n_rows, CAST(least(16, 40 - c0) AS BIGINT) AS n_cols FROM q)"
    " SELECT *, CAST(100 + c0 * 0.5 AS DOUBLE) AS x_min, CAST(50 - (r0 + n_rows) * 0.25 AS DOUBLE) AS y_min, CAST(100 + (c0 + n_cols) * 0.5 AS DOUBLE) AS x_max, CAST(50 - r0 * 0.25 AS DOUBLE) AS y_max FROM s",
    "raster_digest": f"WITH {_N}, t AS (SELECT r // 16 AS tr, c // 16 AS tc, md5(string_agg(r || ',' || c || ',' || coalesce(printf('%.6f', g), 'null'), ';' ORDER BY r, c)) AS d FROM n GROUP BY 1, 2) SELECT md5(string_agg(d, '' ORDER BY tr, tc)) AS md5 FROM t",
    "ascii_grid": f"WITH {_N}, h AS (SELECT max(r) + 1 AS rows FROM n), l AS (SELECT 1 AS section, r AS id, string_agg(coalesce(printf('%.6f', g), '-9999.000000'), ' ' ORDER BY c) AS line FROM n GROUP BY r"
    " UNION ALL SELECT 0, unnest([0, 1, 2, 3, 4, 5]), unnest(['ncols 40', 'nrows ' || rows, 'xllcorner 0', 'yllcorner ' || (10 - 2 * rows), 'cellsize 2', 'NODATA_value -9999']) FROM h)"
    " SELECT CAST(section AS INTEGER) AS section, CAST(id AS BIGINT) AS id, substr(line, 1, 30) AS head, CAST(length(line) AS INTEGER) AS n FROM l",
}
ORACLE["crs_round_trip"] = f"WITH {_P} SELECT pid, round(x / 4 + 8, 6) AS lon, round(y * 3 - 75, 6) AS lat FROM p"
_LEVEL = _LINES[: _LINES.index("al AS (")].replace(
    "b AS (SELECT a.r",
    """rim AS (SELECT r + dr AS r, c + dc AS c FROM n, (VALUES (-1), (0), (1)) u(dr), (VALUES (-1), (0), (1)) w(dc) EXCEPT SELECT r, c FROM n),
g AS (SELECT r, c, z FROM n UNION ALL SELECT r, c, 10 - 1e12 FROM rim),
b AS (SELECT a.r""",
).replace("FROM n a JOIN n p ON", "FROM g a JOIN g p ON").replace("JOIN n q", "JOIN g q").replace("JOIN n s", "JOIN g s")
ORACLE["contour_polygons"] = _LEVEL + """ar AS (SELECT root, sum(p.x * q.y - q.x * p.y) / 2 AS area FROM ro JOIN sg USING (i) JOIN pt p ON p.p = i JOIN pt q ON q.p = j GROUP BY root)
SELECT CASE WHEN area > 0 THEN 'exterior' ELSE 'interior' END AS ring_type, CAST(count(*) AS BIGINT) AS n, round(sum(area), 6) AS area FROM ar GROUP BY 1"""
