"""The area that two polygons share, by a sweep over their heights. Plain Python: a task clips one pair at a time."""

from __future__ import annotations

Point = tuple[float, float]
Edge = tuple[float, float, float, float]


def _edges(rings: list[list[Point]], tag: int) -> list[tuple[Edge, int]]:
    """Edges from low to high, without horizontal ones."""
    out = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if y1 != y2:
                out.append(((x1, y1, x2, y2) if y1 < y2 else (x2, y2, x1, y1), tag))
    return out


def _x(e: Edge, y: float) -> float:
    """Exactly the end points' own values at the ends."""
    if y == e[1]:
        return e[0]
    if y == e[3]:
        return e[2]
    return e[0] + (y - e[1]) / (e[3] - e[1]) * (e[2] - e[0])


def _crossings(edges: list[tuple[Edge, int]]) -> set[float]:
    """Heights at which edges cross, among those whose boxes meet."""
    out, order = set(), sorted(edges, key=lambda e: min(e[0][0], e[0][2]))
    for k, (e, _) in enumerate(order):
        right = max(e[0], e[2])
        for f, _ in order[k + 1 :]:
            if min(f[0], f[2]) > right:
                break
            low, high = max(e[1], f[1]), min(e[3], f[3])
            if low < high:
                a, b = _x(e, low) - _x(f, low), _x(e, high) - _x(f, high)
                if a * b < 0:
                    out.add(low + (high - low) * a / (a - b))
    return out


def shared(a: list[list[Point]], b: list[list[Point]]) -> list[list[Point]]:
    """Rings, each a piece of its own, that together cover what lies in both polygons (even-odd rule over their rings) once. Where the
    shared area splits or joins on the way up, a piece ends and others begin; convex polygons share one piece at most."""
    edges = _edges(a, 0) + _edges(b, 1)
    heights = sorted({y for e, _ in edges for y in (e[1], e[3])} | _crossings(edges))
    open_pieces: list[tuple[list[Point], list[Point]]] = []
    done: list[tuple[list[Point], list[Point]]] = []
    for low, high in zip(heights, heights[1:], strict=False):
        middle = (low + high) / 2
        live = sorted(((_x(e, middle), e, tag) for e, tag in edges if e[1] <= low and e[3] >= high), key=lambda s: s[0])
        inside, strips, start = [False, False], [], None
        for _, e, tag in live:
            before = all(inside)
            inside[tag] = not inside[tag]
            if not before and all(inside):
                start = e
            elif before and start is not None:
                strips.append((start, e))
        bases = [(_x(left, low), _x(right, low)) for left, right in strips]
        meets = lambda base, piece: base[0] < piece[1][-1][0] and base[1] > piece[0][-1][0] or base == (piece[0][-1][0], piece[1][-1][0])
        links = [[k for k, piece in enumerate(open_pieces) if piece[0][-1][1] == low and meets(base, piece)] for base in bases]
        used = [k for found in links for k in found]
        new = []
        for (left, right), base, found in zip(strips, bases, links, strict=True):
            top = ((_x(left, high), high), (_x(right, high), high))
            k = found[0] if len(found) == 1 else None
            if k is not None and used.count(k) == 1 and (open_pieces[k][0][-1][0], open_pieces[k][1][-1][0]) == base:
                piece = open_pieces[k]
                open_pieces[k] = ([], [])
            else:
                piece = ([(base[0], low)], [(base[1], low)])
            piece[0].append(top[0])
            piece[1].append(top[1])
            new.append(piece)
        done += [p for p in open_pieces if p[0]]
        open_pieces = new
    done += open_pieces
    return [ring for ring in (_ring(left, right) for left, right in done) if ring]


def _ring(left: list[Point], right: list[Point]) -> list[Point]:
    """A closed ring, without points that lie on the line between their neighbours."""
    points = [*right, *reversed(left)]
    points = [p for i, p in enumerate(points) if p != points[i - 1]]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])
    kept = [q for i, q in enumerate(points) if turn(points[i - 1], q, points[(i + 1) % len(points)]) != 0]
    return [*kept, kept[0]] if len(kept) > 2 else []
