"""Edit distance with moves between two nested schemas, and the script that has it.

A schema is a tree: objects inside, leaves with a kind of content at the ends; the order of
keys means nothing. A script maps nodes of the target to nodes of the source, one to one, roots
to roots, objects to objects and leaves to leaves, and costs

* a rename for every mapped pair, by how unlike the two are (nothing for equal ones: kept),
* a move for every mapped pair that lies elsewhere: ``MOVE`` for each edge between the source
  object it lies in and the one that its target parent (or nearest mapped ancestor) is mapped to,
* ``DELETE`` for every target node and ``ADD`` for every source node without a partner.

Once the objects are mapped, leaves cost nothing to one another, so the best mapping of leaves is
an assignment, solved exactly; the mappings of objects are searched, best first partners, with
the cost so far as a bound. Schemas have few objects. Where more than ``MAPS`` mappings would
be left, each target object only tries its most alike partners, and the cost is then an upper
bound; with one object in the target, as for any flat schema, there is just one mapping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

DELETE = ADD = 0.7
MOVE = 0.15
MAPS = 2000


@dataclass(frozen=True)
class Node:
    """A key with its kind of content, or an object (kind ``object``) with its keys."""

    name: str
    kind: str = "object"
    children: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Script:
    """Cost and steps ``(operation, target path, source path)``: keep, rename, move, delete, add."""

    cost: float
    steps: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]


class _Tree:
    """A schema as lists: objects in preorder (the root is 0) and leaves, with paths and parents."""

    def __init__(self, root: Node):
        self.paths: list[tuple[str, ...]] = []
        self.parents: list[int] = []
        self.leaves: list[tuple[tuple[str, ...], str, int]] = []

        def walk(node: Node, path: tuple[str, ...], parent: int) -> None:
            me = len(self.paths)
            self.paths.append(path)
            self.parents.append(parent)
            for child in node.children:
                below = (*path, child.name)
                if child.kind == "object":
                    walk(child, below, me)
                else:
                    self.leaves.append((below, child.kind, me))

        walk(root, (), -1)

    def apart(self, a: int, b: int) -> int:
        """Edges between two objects."""
        up = {}
        steps = 0
        while a >= 0:
            up[a] = steps
            a, steps = self.parents[a], steps + 1
        steps = 0
        while b not in up:
            b, steps = self.parents[b], steps + 1
        return up[b] + steps


def assign(cost: np.ndarray) -> list[int]:
    """Minimum-cost assignment of rows to columns (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - row_price[i0] - column_price[free]
            better = slack < least[free]
            least[free[better]], back[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            row_price[owner[used]] += delta
            column_price[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _leaves(t: _Tree, s: _Tree, image: list[int], fit: Callable) -> tuple[float, list[int]]:
    """Least cost of the leaves under a mapping of objects, and each target leaf's partner (-1: deleted)."""
    n, m = len(t.leaves), len(s.leaves)
    home = []
    for k in range(len(t.paths)):
        while image[k] < 0:
            k = t.parents[k]
        home.append(image[k])
    moves = [[MOVE * s.apart(a, b) for b in range(len(s.paths))] for a in range(len(s.paths))]
    cost = [[fit(path, kind, other, content) + moves[home[parent]][lies] for other, content, lies in s.leaves] for path, kind, parent in t.leaves]
    # each leaf's cheapest partner, if it beats being left out; where no two want the same one, that is the assignment
    partner = []
    for row in cost:
        least = min(row, default=DELETE + ADD)
        partner.append(row.index(least) if least < DELETE + ADD else -1)
    wanted = [j for j in partner if j >= 0]
    if len(set(wanted)) < len(wanted):
        square = np.full((n, m + n), 2 * (DELETE + ADD))
        square[:, :m] = cost
        square[np.arange(n), m + np.arange(n)] = DELETE + ADD  # left out, and one source leaf more to add
        partner = [j if j < m and cost[i][j] < DELETE + ADD else -1 for i, j in enumerate(assign(square))]
    total = sum(DELETE if j < 0 else cost[i][j] for i, j in enumerate(partner))
    return total + ADD * (m - sum(j >= 0 for j in partner)), partner


def _mappings(t: _Tree, s: _Tree, alike: Callable) -> Iterator[tuple[float, list[int]]]:
    """Mappings of objects (target to source, -1 for none) with their cost, cheap partners first."""
    n, m = len(t.paths), len(s.paths)
    tries = [[]] + [sorted(range(1, m), key=lambda j: alike(t.paths[i], s.paths[j])) for i in range(1, n)]
    width = m
    while n > 1 and width > 2 and float(width) ** (n - 1) > MAPS:
        width -= 1

    def extend(image: list[int], cost: float) -> Iterator[tuple[float, list[int]]]:
        i = len(image)
        if i == n:
            yield cost + ADD * (m - sum(j >= 0 for j in image)), image
            return
        above = t.parents[i]
        while image[above] < 0:
            above = t.parents[above]
        for j in [j for j in tries[i] if j not in image][: width - 1]:
            yield from extend([*image, j], cost + alike(t.paths[i], s.paths[j]) + MOVE * s.apart(image[above], s.parents[j]))
        yield from extend([*image, -1], cost + DELETE)

    yield from extend([0], 0.0)


def edit_script(target: Node, source: Node, fit: Callable, alike: Callable) -> Script:
    """The cheapest script that takes ``target`` to ``source``.

    ``fit(target path, kind, source path, kind)`` is the cost of taking one leaf for another,
    ``alike(target path, source path)`` that of one object for another.
    """
    t, s = _Tree(target), _Tree(source)
    best: tuple[float, list[int], list[int]] | None = None
    for cost, image in _mappings(t, s, alike):
        if best is None or cost < best[0]:
            more, partner = _leaves(t, s, image, fit)
            if best is None or cost + more < best[0]:
                best = (cost + more, image, partner)
    total, image, partner = best
    steps = []

    def pair(path: tuple[str, ...], other: tuple[str, ...], moved: bool) -> None:
        same = path[-1] == other[-1]
        steps.append(("keep" if same and not moved else "move" if same else "rename", path, other))

    def home(k: int) -> int:
        while image[k] < 0:
            k = t.parents[k]
        return image[k]

    for i in range(1, len(image)):
        if image[i] < 0:
            steps.append(("delete", t.paths[i], ()))
        else:
            pair(t.paths[i], s.paths[image[i]], home(t.parents[i]) != s.parents[image[i]])
    for i, j in enumerate(partner):
        if j < 0:
            steps.append(("delete", t.leaves[i][0], ()))
        else:
            pair(t.leaves[i][0], s.leaves[j][0], home(t.leaves[i][2]) != s.leaves[j][2])
    steps += [("add", (), s.paths[j]) for j in range(1, len(s.paths)) if j not in image]
    steps += [("add", (), path) for j, (path, _, _) in enumerate(s.leaves) if j not in partner]
    return Script(float(total), tuple(steps))
