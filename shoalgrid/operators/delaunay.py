"""Delaunay triangulation of point groups, one group a task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (counter-clockwise index triples, the smallest first) by incremental insertion into a covering triangle.

    Points are inserted strip by strip; each is found by walking from the last
    one, and the triangles whose circles hold it are found by their neighbours,
    so a point costs about the same however many there are.
    """
    n = len(points)
    if n < 3:
        return []
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    width, height = max(xs) - min(xs), max(ys) - min(ys)
    size = max(width, height, 1.0) * 1e4
    cx, cy = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2
    p = [*points, (cx - 2 * size, cy - size), (cx + 2 * size, cy - size), (cx, cy + 2 * size)]
    apex: dict[tuple[int, int], int] = {}  # of the triangle to the left of a directed side

    def put(a, b, c):
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    def turn(a, b, c):
        return (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])

    def holds(a, b, c, q):
        (ax, ay), (bx, by), (dx, dy) = ((p[i][0] - p[q][0], p[i][1] - p[q][1]) for i in (a, b, c))
        r, s, t = ax * ax + ay * ay, bx * bx + by * by, dx * dx + dy * dy
        return ax * (by * t - s * dy) - ay * (bx * t - s * dx) + r * (bx * dy - by * dx) > 0

    def around(i, a, b, c):
        """The triangle that holds point i, by walking from (a, b, c)."""
        for _ in range(4 * n + 100):
            for u, v in ((a, b), (b, c), (c, a)):
                if turn(u, v, i) < 0:
                    a, b, c = v, u, apex[v, u]
                    break
            else:
                return a, b, c
        return next((u, v, w) for (u, v), w in apex.items() if min(turn(u, v, i), turn(v, w, i), turn(w, u, i)) >= 0)

    strips = max(1, round((n / 2) ** 0.5))
    low = min(xs)
    strip = [min(strips - 1, int((x - low) / (width or 1.0) * strips)) for x in xs]
    put(n, n + 1, n + 2)
    at = (n, n + 1, n + 2)
    for i in sorted(range(n), key=lambda k: (strip[k], ys[k] if strip[k] % 2 else -ys[k])):
        a, b, c = around(i, *at)
        del apex[a, b], apex[b, c], apex[c, a]
        sides, rim = [(a, b), (b, c), (c, a)], []
        while sides:
            u, v = sides.pop()
            w = apex.get((v, u))
            if w is not None and holds(v, u, w, i):
                del apex[v, u], apex[u, w], apex[w, v]
                sides += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            put(u, v, i)
        at = (*rim[0], i)
    return sorted((a, b, c) for (a, b), c in apex.items() if a < b and a < c and max(b, c) < n and turn(a, b, c) > 0)


def triangulate(points: DataFrame, key: str) -> DataFrame:
    """(key, tri, x0, y0, ..., y2): a Delaunay triangulation of the distinct points (x, y) of each group."""

    def run(pdf):
        import pandas as pd

        own = pdf[["x", "y"]].drop_duplicates().sort_values(["x", "y"])
        pts = list(zip(own.x.tolist(), own.y.tolist()))
        rows = [(int(pdf[key].iloc[0]), k, *(c for i in t for c in pts[i])) for k, t in enumerate(delaunay(pts))]
        return pd.DataFrame(rows, columns=[key, "tri", "x0", "y0", "x1", "y1", "x2", "y2"])

    return points.groupBy(key).applyInPandas(run, f"{key} long, tri int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
