"""Clipped and thinned lines against plain definitions."""

import math
import random
from collections import defaultdict

from tarnflow.operators import layers


def clip_by_definition(points, box):
    """Pieces of a line inside a box, by cutting each segment at the four sides."""
    x0, y0, x1, y1 = box
    pieces, open_ = [], None
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        f, t = 0.0, 1.0
        for a, d, lo, hi in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
            if d == 0:
                if not lo <= a <= hi:
                    f = 2.0
            else:
                f, t = max(f, min((lo - a) / d, (hi - a) / d)), min(t, max((lo - a) / d, (hi - a) / d))
        if f > t:
            open_ = None
            continue
        if open_ is None or f > 0:
            open_ = [(ax + f * (bx - ax), ay + f * (by - ay))]
            pieces.append(open_)
        if t > f:
            open_.append((ax + t * (bx - ax), ay + t * (by - ay)))
        if t < 1:
            open_ = None
    return pieces


def thin_by_definition(points, tolerance):
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]

    def far(p):
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if size == 0 else min(1, max(0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / size))
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    k = max(range(1, len(points) - 1), key=lambda i: (far(points[i]), -i))
    if far(points[k]) <= tolerance:
        return [points[0], points[-1]]
    return thin_by_definition(points[: k + 1], tolerance)[:-1] + thin_by_definition(points[k:], tolerance)


def test_layers(spark):
    rng, lines = random.Random(6), {}
    for k in range(40):
        x, y = rng.uniform(-2, 12), rng.uniform(-2, 12)
        lines[k] = [(x, y)]
        for _ in range(rng.choice([1, 5, 60])):
            x, y = x + rng.uniform(-1.5, 1.5), y + rng.uniform(-1.5, 1.5) * (k % 7 > 0)  # every seventh runs level
            lines[k].append((x, y))
    lines[99] = [(0, 0), (3, 3), (6, 0), (3, 3), (0, 0)]  # a closed one, along a view's corner
    views = {0: (0, 0, 10, 10), 1: (3, 3, 4, 9), 2: (50, 50, 60, 60), 3: (-1, 4, 5, 4.5)}
    frame = spark.createDataFrame([(k, s, float(x), float(y)) for k, v in lines.items() for s, (x, y) in enumerate(v)], "line int, seq long, x double, y double")
    boxes = spark.createDataFrame([(k, *map(float, b)) for k, b in views.items()], "view_id int, x0 double, y0 double, x1 double, y1 double")
    want = {(v, k, i): p for v, b in views.items() for k, pts in lines.items() for i, p in enumerate(clip_by_definition(pts, b))}
    pieces = defaultdict(list)
    for r in sorted(layers.clipped(frame, boxes).collect()):
        pieces[r.view_id, r.line, r.piece].append((r.x, r.y))
    near = lambda a, b: len(a) == len(b) and all(math.dist(p, q) < 1e-9 for p, q in zip(a, b))
    assert pieces.keys() == want.keys() and all(near(pieces[k], want[k]) for k in want) and max(k[2] for k in want) > 2
    weights = spark.createDataFrame([(k, k * 7 % 5) for k in lines if k != 3], "line int, weight int")
    got, found = defaultdict(list), {}
    for r in sorted(layers.shown(frame, weights, boxes, 6, 0.5).collect(), key=lambda r: (r.view_id, r.line, r.piece, r.seq)):
        got[r.view_id, r.line, r.piece].append((r.x, r.y))
        found[r.view_id, r.line] = (r.rank, r.n_found)
    for v in views:
        inside = sorted({k[1] for k in want if k[0] == v}, key=lambda k: (k == 3, -(k * 7 % 5), k))
        assert {k: r for (w, k), r in found.items() if w == v} == {k: (i + 1, len(inside)) for i, k in enumerate(inside[:6])}
    shown = {k: p for k, p in want.items() if k[:2] in found}
    assert got.keys() == shown.keys() and all(near(got[k], thin_by_definition(p, 0.5)) for k, p in shown.items())
    assert layers.clipped(frame.limit(0), boxes).count() == 0
