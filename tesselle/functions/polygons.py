"""Simple polygons, concave ones included: each is cut into triangles, and areas and predicates follow from these."""

from __future__ import annotations

import numpy as np

from .shapes import Points, clip, convex_intersects, cross, polygon_area, segment_distance

#: Areas that differ by less than this share of the larger polygon are the same.
SAME = 1e-9


def opened(ring: Points) -> Points:
    """Counter-clockwise vertices without repeats, the closing one included, and without vertices amid a straight edge."""
    out = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    while len(out) > 2:
        bent = [p for k, p in enumerate(out) if cross(out[k - 1], p, out[(k + 1) % len(out)]) != 0]
        if len(bent) == len(out):
            break
        out = bent
    if len(out) < 3:
        return out
    turned = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1], strict=True))
    return out if turned > 0 else out[::-1]


def crosses_itself(ring: Points) -> bool:
    """Whether two edges of an opened ring cross inside both."""
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    return any(cross(a, b, p) * cross(a, b, q) < 0 and cross(p, q, a) * cross(p, q, b) < 0 for k, (a, b) in enumerate(edges) for p, q in edges[:k])


def triangles(ring: Points) -> list[Points]:
    """Ear clipping. A ring without area gives its own points as one piece; a ring that crosses itself raises an error."""
    left = opened(ring)
    if len(left) < 3:
        return [sorted(set(ring))]
    if crosses_itself(left):
        raise ValueError("the ring crosses itself")
    out = []
    while len(left) > 3:
        for k, p in enumerate(left):
            a, b = left[k - 1], left[(k + 1) % len(left)]
            if cross(a, p, b) <= 0:
                continue
            inside = (q for q in left if q not in (a, p, b))
            if not any(cross(a, p, q) >= 0 and cross(p, b, q) >= 0 and cross(b, a, q) >= 0 for q in inside):
                out.append([a, p, b])
                left = opened(left[:k] + left[k + 1 :])
                break
        else:
            raise ValueError("the ring touches itself")
        if len(left) < 3:
            return out
    return [*out, left]


def touches_itself(ring: Points) -> bool:
    """Whether a corner of an opened ring of upright and level edges lies on an edge that isn't its own."""
    n = len(ring)
    for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
        low, high = tuple(map(min, a, b)), tuple(map(max, a, b))
        if any(j != k and j != (k + 1) % n and low[0] <= p[0] <= high[0] and low[1] <= p[1] <= high[1] for j, p in enumerate(ring)):
            return True
    return False


def rectangles(rings: list[Points]) -> list[tuple]:
    """Disjoint rectangles (x0, y0, x1, y1) that make up what opened rings of upright and level edges hold, without what other
    rings among them take out."""
    level = [(min(p[0], q[0]), max(p[0], q[0]), p[1]) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[1] == q[1]]
    edges = sorted({x for ring in rings for x, _ in ring})
    out, begun = [], {}
    for x, following in zip(edges, [*edges[1:], None], strict=True):
        ys = sorted(y for low, high, y in level if following is not None and low <= x and following <= high)
        here = {(y, top) for y, top in zip(ys[::2], ys[1::2], strict=True) if y < top}
        out += [(begun.pop(side), side[0], x, side[1]) for side in sorted(begun) if side not in here]
        for side in here:
            begun.setdefault(side, x)
    return out


def near_pieces(a: list[Points], b: list[Points]) -> list[tuple[Points, Points]]:
    """The pairs of pieces whose boxes meet."""
    box = lambda p: (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p))
    boxes = [(q, box(q)) for q in b]
    return [(p, q) for p, (x0, y0, x1, y1) in ((p, box(p)) for p in a) for q, (u0, v0, u1, v1) in boxes if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1]


def intersection_area(a: list[Points], b: list[Points]) -> float:
    return sum(polygon_area(clip(p, q)) for p, q in near_pieces(a, b) if len(p) > 2 and len(q) > 2)


def intersects(a: list[Points], b: list[Points]) -> bool:
    """Closed sets: touching counts."""
    return any(convex_intersects(p, q) for p, q in near_pieces(a, b))


def ring_distance(a: Points, b: Points) -> float:
    """Least distance of two boundaries that don't meet."""
    best = np.inf
    for one, two in ((a, b), (b, a)):
        edges = list(zip(two, two[1:] + two[:1], strict=True))
        best = min([best, *(segment_distance(p, u, v) for p in one for u, v in edges)])
    return best


def segment_distances(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to segments (n x 2 each)."""
    edge, off = b - a, p - a
    length = (edge * edge).sum(axis=1)
    t = np.clip((off * edge).sum(axis=1) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    away = off - t[:, None] * edge
    return np.hypot(away[:, 0], away[:, 1])


def triangles_meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether pairs of triangles (n x 3 x 2, each with area) meet as closed sets: no edge of either separates them."""
    apart = np.zeros(len(p), bool)
    # a row for each coordinate: numpy is slow along axes of two or three
    one, two = ([(np.ascontiguousarray(t[:, k, 0]), np.ascontiguousarray(t[:, k, 1])) for k in range(3)] for t in (p, q))
    for shape in (one, two):
        for k in range(3):
            (x, y), (u, v) = shape[k], shape[(k + 1) % 3]
            across, down = v - y, x - u
            ours, theirs = ([cx * across + cy * down for cx, cy in corners] for corners in (one, two))
            most = lambda values: np.maximum(np.maximum(values[0], values[1]), values[2])
            least = lambda values: np.minimum(np.minimum(values[0], values[1]), values[2])
            apart |= (most(ours) < least(theirs)) | (most(theirs) < least(ours))
    return ~apart


def common_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that pairs of counter-clockwise triangles have in common: each is cut by the other's edges in turn."""
    shape = p.copy()
    size = np.full(len(p), 3)
    for k in range(3):
        start, edge = q[:, k, None], (q[:, (k + 1) % 3] - q[:, k])[:, None]
        corners = shape.shape[1]
        number = np.arange(corners)
        real = number < size[:, None]
        following = np.where(number + 1 < size[:, None], number + 1, 0)
        off = shape - start
        here = edge[..., 0] * off[..., 1] - edge[..., 1] * off[..., 0]
        there = np.take_along_axis(here, following, axis=1)
        after = np.take_along_axis(shape, following[..., None], axis=1)
        crossed = real & (((here > 0) & (there < 0)) | ((here < 0) & (there > 0)))
        share = np.where(crossed, here, 0) / np.where(crossed, here - there, 1)
        cut = shape + share[..., None] * (after - shape)
        kept = np.stack([real & (here >= 0), crossed], axis=2).reshape(len(p), -1)
        points = np.stack([shape, cut], axis=2).reshape(len(p), -1, 2)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : corners + 1]
        shape = np.take_along_axis(points, order[..., None], axis=1)
        size = kept.sum(axis=1)
    real = np.arange(shape.shape[1]) < size[:, None]
    shape = np.where(real[..., None], shape, shape[:, :1])  # corners that aren't there repeat the first one
    shape = shape - shape[:, :1]
    turned = np.roll(shape, -1, axis=1)
    area = (shape[..., 0] * turned[..., 1] - shape[..., 1] * turned[..., 0]).sum(axis=1) / 2
    return np.where(size > 2, np.abs(area), 0.0)
