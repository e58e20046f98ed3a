"""Whole-tile raster kernels on dense arrays: labelling, thinning, tracing, cost paths."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of the elliptic structuring element of this radius."""
    out = []
    for dy in range(-radius, radius + 1):
        reach = round(radius * ((radius * radius - dy * dy) ** 0.5) / radius) if radius else 0
        out += [(dy, dx) for dx in range(-reach, reach + 1)]
    return out


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _moved(mask: np.ndarray, dy: int, dx: int, fill: bool = False) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def dilate(mask: np.ndarray, offsets) -> np.ndarray:
    return np.logical_or.reduce([_moved(mask, dy, dx) for dy, dx in offsets])


def erode(mask: np.ndarray, offsets, outside: bool = False) -> np.ndarray:
    """Pixels all of whose offsets are set. Places outside count as empty, so a rim is lost, or as set."""
    return np.logical_and.reduce([_moved(mask, -dy, -dx, outside) for dy, dx in offsets])


def close(mask: np.ndarray, offsets, outside: bool = False) -> np.ndarray:
    return erode(dilate(mask, offsets), offsets, outside)


def label(mask: np.ndarray, steps=FOUR) -> np.ndarray:
    """The least flat position of each pixel's region; -1 outside."""
    big = mask.size
    lab = np.where(mask, np.arange(big).reshape(mask.shape), big)
    while True:
        new = lab.copy()
        for dy, dx in steps:
            moved = np.full_like(lab, big)
            h, w = lab.shape
            moved[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = lab[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
            new = np.minimum(new, moved)
        new = np.where(mask, new, big)
        flat = np.append(new.ravel(), big)
        new = np.where(mask, flat[np.minimum(flat[np.minimum(new, big)], big)], big)  # jump to the label's label
        if np.array_equal(new, lab):
            return np.where(mask, lab, -1)
        lab = new


def drop_small(mask: np.ndarray, least: int, steps=FOUR) -> np.ndarray:
    lab = label(mask, steps)
    count = np.bincount(lab[mask], minlength=mask.size) if mask.any() else np.zeros(mask.size, int)
    return mask & (count[np.maximum(lab, 0)] >= least)


def hysteresis(prob: np.ndarray, high: float, low: np.ndarray | float) -> np.ndarray:
    """Candidates above ``low`` whose 4-connected region holds a seed above ``high``."""
    may = prob >= low
    lab = label(may)
    seeded = np.unique(lab[may & (prob >= high)])
    return may & np.isin(lab, seeded)


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by alternating passes that peel south-east and north-west borders."""
    img = np.pad(mask.astype(bool), 1)
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            ring = [_moved(img, -dy, -dx) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            north, east, south, west = ring[0], ring[2], ring[4], ring[6]
            count = sum(r.astype(np.int8) for r in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1]))
            a, b = (north & east & south, east & south & west) if first else (north & east & west, north & south & west)
            peel = img & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b
            if peel.any():
                img, changed = img & ~peel, True
    return img[1:-1, 1:-1]


def skeleton(mask: np.ndarray, least: int = 80, size: int = 5) -> np.ndarray:
    """Closing by a square, regions below ``least`` dropped, thinned."""
    return thin(drop_small(close(mask.astype(bool), square(size)), least))


def trace(skel: np.ndarray, spur: float = 12.0) -> tuple[list[tuple[float, float]], list[tuple[int, int, float, list]]]:
    """Nodes (x, y) at line ends and junction centres, edges (u, v, length, points as (row, col)).

    One edge joins two nodes at most, the shortest; edges shorter than ``spur`` with a loose end
    go, judged by the degrees before any is dropped; nodes without edges go.
    """
    skel = skel.astype(bool)
    pixels = set(zip(*map(list, np.nonzero(skel))))
    around = {p: [q for dy, dx in EIGHT if (q := (p[0] + dy, p[1] + dx)) in pixels] for p in pixels}
    special = {p for p in pixels if len(around[p]) != 2}
    node_of: dict[tuple, int] = {}
    centres: list[tuple[float, float]] = []
    for p in sorted(special):
        if p in node_of:
            continue
        group, stack = [p], [p]
        node_of[p] = len(centres)
        while stack:
            for q in around[stack.pop()]:
                if q in special and q not in node_of and len(around[q]) > 2 and len(around[p]) > 2:
                    node_of[q] = len(centres)
                    group.append(q)
                    stack.append(q)
        centres.append((float(np.mean([g[1] for g in group])), float(np.mean([g[0] for g in group]))))
    best: dict[tuple[int, int], tuple[float, list]] = {}
    seen = set()
    for p in sorted(special):
        for q in around[p]:
            if (p, q) in seen or node_of.get(q) == node_of[p]:
                continue
            line, before, at = [p], p, q
            while at not in special:
                line.append(at)
                step = [r for r in around[at] if r != before and r not in line]
                if not step:
                    break
                before, at = at, min(step, key=lambda r: (abs(r[0] - at[0]) + abs(r[1] - at[1]), r))
            if at not in special:
                continue
            line.append(at)
            seen |= {(p, q), (at, line[-2])}
            u, v = sorted((node_of[p], node_of[at]))
            length = float(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(line, line[1:])))
            if u != v and (u, v) not in best or u != v and length < best[u, v][0]:
                best[u, v] = (length, line)
    degree = np.bincount([k for e in best for k in e], minlength=len(centres))
    kept = [(u, v, length, line) for (u, v), (length, line) in sorted(best.items()) if not (length < spur and min(degree[u], degree[v]) == 1)]
    used = sorted({k for u, v, _, _ in kept for k in (u, v)})
    new = {k: i for i, k in enumerate(used)}
    return [centres[k] for k in used], [(new[u], new[v], length, line) for u, v, length, line in kept]


def cost_path(prob: np.ndarray, a: tuple[float, float], b: tuple[float, float], margin: int = 24) -> tuple[list[tuple[int, int]], float, float]:
    """Cheapest 8-connected path between two (x, y) places: points (row, col), mean p, length >= 1.

    A step costs its length times the mean of 1.02 - p at its two ends; the search stays in the
    window of the two places widened by ``margin``. Places lie in the pixel that holds them, or in
    the nearest one of the raster.
    """
    start, goal, (y0, y1, x0, x1) = _window(prob.shape, a, b, margin)
    cost = 1.02 - prob
    dist, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, p = heappop(heap)
        if p == goal:
            break
        if d > dist[p]:
            continue
        for dy, dx in EIGHT:
            q = (p[0] + dy, p[1] + dx)
            if y0 <= q[0] < y1 and x0 <= q[1] < x1:
                e = d + (2**0.5 if dy and dx else 1.0) * (cost[p] + cost[q]) / 2
                if e < dist.get(q, np.inf):
                    dist[q], came[q] = e, p
                    heappush(heap, (e, q))
    path = [goal]
    while path[-1] != start:
        path.append(came[path[-1]])
    path.reverse()
    return _measured(prob, path)


def cost_paths(prob: np.ndarray, a: tuple[float, float], ends: list[tuple[float, float]], margin: int = 24) -> list[tuple[list[tuple[int, int]], float, float]]:
    """``cost_path`` from one place to each of ``ends``: one search over the raster serves all ends whose path stays in their window.

    A path that is cheapest in the raster is so in a window that holds it, ties included; the others are searched again.
    """
    h, w = prob.shape
    wide = w + 2
    cost = np.full((h + 2, wide), np.inf)
    cost[1:-1, 1:-1] = 1.02 - prob
    cost = cost.ravel().tolist()
    steps = [(dy * wide + dx, 2**0.5 if dy and dx else 1.0) for dy, dx in EIGHT]
    windows = [_window(prob.shape, a, b, margin) for b in ends]
    flat = lambda p: (p[0] + 1) * wide + p[1] + 1
    start = flat(_window(prob.shape, a, a, margin)[0])
    wanted = {flat(goal) for _, goal, _ in windows}
    dist, came, heap = [np.inf] * len(cost), [-1] * len(cost), [(0.0, start)]
    dist[start] = 0.0
    while heap and wanted:
        d, p = heappop(heap)
        if d > dist[p]:
            continue
        wanted.discard(p)
        here = cost[p]
        for step, long in steps:
            q = p + step
            e = d + long * (here + cost[q]) / 2
            if e < dist[q]:
                dist[q], came[q] = e, p
                heappush(heap, (e, q))
    out = []
    for b, (_, goal, (y0, y1, x0, x1)) in zip(ends, windows):
        path = [flat(goal)]
        while path[-1] != start:
            path.append(came[path[-1]])
        path = [(p // wide - 1, p % wide - 1) for p in reversed(path)]
        inside = all(y0 <= y < y1 and x0 <= x < x1 for y, x in path)
        out.append(_measured(prob, path) if inside else cost_path(prob, a, b, margin))
    return out


def _window(shape: tuple[int, int], a: tuple[float, float], b: tuple[float, float], margin: int) -> tuple:
    """The pixels of two places, and the first and last rows and columns of their window."""
    h, w = shape
    pixel = lambda v, top: min(max(int(v), 0), top - 1)
    start, goal = ((pixel(p[1], h), pixel(p[0], w)) for p in (a, b))
    low = [int(max(0, min(a[k], b[k]) - margin)) for k in (0, 1)]
    high = [int(min(top, max(a[k], b[k]) + margin + 1)) for k, top in ((0, w), (1, h))]
    (x0, y0), (x1, y1) = low, high
    # an end beyond the raster still belongs to the window
    y0, x0 = min(y0, start[0], goal[0]), min(x0, start[1], goal[1])
    y1, x1 = max(y1, start[0] + 1, goal[0] + 1), max(x1, start[1] + 1, goal[1] + 1)
    return start, goal, (y0, y1, x0, x1)


def _measured(prob: np.ndarray, path: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], float, float]:
    length = sum(float(np.hypot(p[0] - q[0], p[1] - q[1])) for p, q in zip(path, path[1:]))
    return path, float(np.mean([prob[p] for p in path])), max(1.0, length)


def resize_bilinear(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """A raster of another size, each place between the four pixels around it; pixel centres lie at halves."""

    def axis(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(wanted) + 0.5) * size / wanted - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(a.shape[0], height), axis(a.shape[1], width)
    rows = a[y0] * (1 - fy)[:, None] + a[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def crop_window(low: float, high: float) -> tuple[int, int]:
    """Whole pixels of a fractional span, at least one."""
    return round(low), max(round(high), round(low) + 1)
