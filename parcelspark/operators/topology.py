"""Geometries from arcs: rings, holes, and the convex hull where no ring comes out. Plain Python on one feature at a time."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

Coord = tuple[float, float]
#: Arc ends closer than this on both axes are one point.
TOLERANCE = 1e-6


class TopologyError(ValueError):
    pass


def same(a: Coord, b: Coord) -> bool:
    return abs(a[0] - b[0]) < TOLERANCE and abs(a[1] - b[1]) < TOLERANCE


class _Ends:
    """Loose arc ends by place. A place is a cell of a grid of the tolerance; near ends may lie in neighbouring cells."""

    def __init__(self, arcs: dict[int, list[Coord]]):
        self.at: dict[tuple[int, int], list[tuple[int, bool]]] = defaultdict(list)
        self.arcs = arcs
        for i, a in arcs.items():
            self.at[self._cell(a[0])].append((i, False))
            self.at[self._cell(a[-1])].append((i, True))

    @staticmethod
    def _cell(c: Coord) -> tuple[int, int]:
        return int(c[0] // TOLERANCE), int(c[1] // TOLERANCE)

    def take(self, c: Coord) -> list[Coord] | None:
        """Remove the latest loose arc with an end at ``c`` and return it running away from ``c``."""
        x, y = self._cell(c)
        best: tuple[int, bool] | None = None
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                for i, back in self.at.get((x + dx, y + dy), ()):
                    if i in self.arcs and same(self.arcs[i][-1 if back else 0], c) and (best is None or (i, not back) > (best[0], not best[1])):
                        best = (i, back)
        if best is None:
            return None
        arc = self.arcs.pop(best[0])
        return arc[::-1] if best[1] else arc


def rings(arcs: list[list[Coord]]) -> list[list[Coord]]:
    """Closed rings of arcs in any order and direction.

    Arcs closed in themselves are rings. The others are walked from the latest one on: forward from its end until nothing fits,
    then backward from its start. Walks of at most three vertices are dropped, open ones are closed. No ring is an error.
    """
    out, loose = [], {}
    for i, a in enumerate(arcs):
        if len(a) > 3 and same(a[0], a[-1]):
            out.append(list(a))
        elif a:
            loose[i] = a
    ends = _Ends(loose)
    while loose:
        walk = list(loose.pop(max(loose)))
        while nxt := ends.take(walk[-1]):
            walk += nxt[1:]
        while prev := ends.take(walk[0]):
            walk = prev[:0:-1] + walk
        if len(walk) > 3:
            out.append(walk if same(walk[0], walk[-1]) else [*walk, walk[0]])
    if not out:
        raise TopologyError("no ring can be made of its arcs")
    return out


def strictly_inside(p: Coord, ring: list[Coord]) -> bool:
    """Even-odd; on the outline is outside."""
    x, y = p
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay <= y) != (by <= y) and (side > 0) == (by > ay):
            odd = not odd
    return odd


def nest(found: list[list[Coord]]) -> list[list[list[Coord]]]:
    """Polygons as [outline, holes...] of rings. A ring is a hole of the first other ring that holds its first vertex; a hole
    of a ring that is itself a hole is lost."""
    closed = [r if r[0] == r[-1] else [*r, r[0]] for r in found]
    holder = [next((j for j, o in enumerate(closed) if j != i and strictly_inside(r[0], o)), None) for i, r in enumerate(closed)]
    holes = defaultdict(list)
    for i, j in enumerate(holder):
        if j is not None:
            holes[j].append(closed[i])
    return [[r, *holes[i]] for i, r in enumerate(closed) if holder[i] is None]


def hull(points: list[Coord]) -> list[Coord] | None:
    """Convex hull, closed and counter-clockwise; None below three points."""
    if len(points) < 3:
        return None
    order = sorted(set(points))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(pts: list[Coord]) -> list[Coord]:
        c: list[Coord] = []
        for p in pts:
            while len(c) > 1 and cross(c[-2], c[-1], p) <= 0:
                c.pop()
            c.append(p)
        return c[:-1]

    h = chain(order) + chain(order[::-1])
    return [*h, h[0]] if h else [order[0], order[0]]


def without_dead_ends(arcs: list[list[Coord]]) -> list[list[Coord]]:
    """Arcs that are left when those with an end at which nothing else ends are taken away, again and again."""
    key = lambda c: (round(c[0], 6), round(c[1], 6))
    left = [a for a in arcs if a]
    while True:
        degree = Counter(key(e) for a in left for e in (a[0], a[-1]))
        keep = [a for a in left if degree[key(a[0])] > 1 and degree[key(a[-1])] > 1]
        if len(keep) == len(left):
            return left
        left = keep


def make_valid(parts: list[list[list[Coord]]]) -> list[list[list[Coord]]]:
    """Polygons that bound the same points as ``parts`` by the even-odd rule, without crossings; [] if no area is left.

    All rings are noded exactly, in rational numbers. An edge belongs to the outline if the points at its two sides differ in
    being inside; outline edges, with the inside to their left, are walked to rings turning most sharply left, so that rings
    touch in points at most, and holes go to the smallest ring around them. Time grows with the square of the edges: it is
    for the few geometries that need it.
    """
    edges = [tuple((Fraction(x), Fraction(y)) for x, y in e) for p in parts for r in p for e in zip(r, r[1:]) if e[0] != e[1]]
    cuts: list[set] = [{a, b} for a, b in edges]
    for i, (a, b) in enumerate(edges):
        for j in range(i):
            for p in _meet(a, b, *edges[j]):
                cuts[i].add(p)
                cuts[j].add(p)
    count: Counter = Counter()
    for (a, b), c in zip(edges, cuts):
        along = sorted(c, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        count.update((min(e), max(e)) for e in zip(along, along[1:]))
    pieces = [e for e, n in count.items() if n % 2]  # an edge there and back bounds nothing
    out = defaultdict(list)
    for a, b in pieces:
        left = _inside_left(a, b, pieces)
        out[a if left else b].append(b if left else a)
    rings_ = []
    while out:
        start = next(iter(out))
        walk, at, before = [start], start, None
        while True:
            nxt = min(out[at], key=lambda q: _turn(before, at, q)) if before is not None else out[at][0]
            out[at].remove(nxt)
            if not out[at]:
                del out[at]
            before, at = at, nxt
            walk.append(at)
            if at in walk[:-1]:
                k = walk.index(at)
                rings_.append(walk[k:])
                walk = walk[: k + 1]
                before = walk[-2] if k else None
                if k == 0:
                    break
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:])) / 2
    plain = lambda r: [(float(x), float(y)) for x, y in r]
    outer = sorted((r for r in rings_ if area(r) > 0), key=area)
    holes = defaultdict(list)
    for h in (r for r in rings_ if area(r) < 0):
        mid = ((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2)
        holder = next((k for k, o in enumerate(outer) if strictly_inside(mid, o)), None)
        if holder is not None:
            holes[holder].append(plain(h))
    return [[plain(o), *holes[k]] for k, o in enumerate(outer)]


def _meet(a, b, c, d) -> list:
    """Points that the segments ab and cd have in common: none, one, or the two ends of what they share."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross = r[0] * s[1] - r[1] * s[0]
    q = (c[0] - a[0], c[1] - a[1])
    if cross == 0:
        if q[0] * r[1] != q[1] * r[0]:
            return []
        between = lambda p, u, v: min(u, v) <= p <= max(u, v)
        return [p for p in (c, d) if between(p, a, b)] + [p for p in (a, b) if between(p, c, d)]
    t, u = (q[0] * s[1] - q[1] * s[0]) / cross, (q[0] * r[1] - q[1] * r[0]) / cross
    return [(a[0] + t * r[0], a[1] + t * r[1])] if 0 <= t <= 1 and 0 <= u <= 1 else []


def _inside_left(a, b, pieces) -> bool:
    """Is the side to the left of the piece ab inside: pieces crossed by a ray from its middle, itself counted if it is crossed."""
    mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    flat = a[1] == b[1]
    odd = False
    for c, d in pieces:
        if (c, d) == (a, b):
            continue
        if flat:  # a ray downwards
            c, d, x, y = (c[1], c[0]), (d[1], d[0]), my, mx
        else:  # a ray to the left
            x, y = mx, my
        if (c[1] <= y) != (d[1] <= y) and c[0] + (y - c[1]) * (d[0] - c[0]) / (d[1] - c[1]) < x:
            odd = not odd
    # ``odd`` is the side towards the ray: the lower one, or the left one as seen on the map
    towards_left = (b[0] < a[0]) if flat else (b[1] > a[1])
    return odd if towards_left else not odd


def _turn(before, at, nxt) -> tuple:
    """Order of directions by how sharply left they turn; straight back comes last."""
    u, v = (at[0] - before[0], at[1] - before[1]), (nxt[0] - at[0], nxt[1] - at[1])
    cross, dot = u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1]
    norm = Fraction(v[0] ** 2 + v[1] ** 2)
    side = 0 if cross > 0 else 1 if cross == 0 and dot > 0 else 2 if cross < 0 else 3
    # within a side a falling cosine turns more; squares keep it exact
    cos = (dot * dot if dot > 0 else -dot * dot) / norm
    return (side, cos if side == 0 else -cos)


def _struct(kind: str, parts: list[list[list[Coord]]]) -> dict:
    return {"kind": kind, "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]}


def polygon(arcs: list[list[Coord]]) -> dict | None:
    """Polygon or multipolygon of a feature's arcs, else their convex hull; None without three points."""
    if not arcs:
        return None
    try:
        parts = nest(rings(arcs))
    except TopologyError:
        h = hull([c for a in arcs for c in a])
        return _struct("Polygon", [[h]]) if h else None
    return _struct("Polygon" if len(parts) == 1 else "MultiPolygon", parts)


def line(arcs: list[list[Coord]], single: bool) -> dict | None:
    """Arcs of two vertices or more, in order; a feature that names one arc only is a plain line."""
    good = [a for a in arcs if len(a) >= 2]
    if not good:
        return None
    return _struct("LineString" if single else "MultiLineString", [[a] for a in good])


def point(coords: list[Coord]) -> dict | None:
    return _struct("Point", [[[coords[0]]]]) if coords else None
