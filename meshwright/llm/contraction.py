"""Connected groups by rounds of local union-find and contraction.

One round takes the links of the round before, spreads them over cells, and lets every cell
run union-find on its own links. A cell reports each of its vertices with the cell's
representative of it. Vertices of several cells then exchange their representatives: the
least becomes the parent, and a link from the parent to each of the others goes into the next
round, which therefore only has vertices that are representatives somewhere. When no link is
left, parents are resolved backwards through the rounds.

A vertex is a pair of longs, so that links are short rows and cells work on plain arrays.
"Least" is by a hash of the vertex, then the vertex: with the vertices' own order, a chain
1-2-3-... would shed one vertex a round; with a random order a constant share goes each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwright.planning.lineage import materialise
from meshwright.planning.skew import look_up

#: Links that one cell is sized for. The grid of a round follows from the links it has.
CELL_LINKS = 250_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over vertices 0..n-1; the root of each, always the least of its group.

    Whole-array hooking (every root takes the least root it is linked to) and pointer
    jumping, until nothing changes.
    """
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _mix(values: np.ndarray) -> np.ndarray:
    """A fixed hash of 64-bit values (splitmix64's finaliser)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _order(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash that vertices are ordered by."""
    return _mix(_mix(x) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _ranked(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vertices in order (hash, then vertex), and the position of each given one."""
    order = _order(x, n)
    _, at, code = np.unique(order, return_index=True, return_inverse=True)
    if not ((x == x[at][code]) & (n == n[at][code])).all():  # two vertices of one hash
        by = np.lexsort((n, x, order))
        new = np.r_[True, (x[by][1:] != x[by][:-1]) | (n[by][1:] != n[by][:-1])]
        code, at = np.empty(len(x), np.int64), by[new]
        code[by] = np.cumsum(new) - 1
    return x[at], n[at], code


_NAMES = ("ax", "an", "bx", "bn")
_LINKS = "ax long, an long, bx long, bn long"


def _columns(held: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in range(4)]


def _forest(held: list[pa.RecordBatch], own: bool) -> pa.RecordBatch:
    """Vertices (a) of some links with their representative (b); representatives themselves only if ``own``."""
    ax, an, bx, bn = _columns(held)
    x, n, code = _ranked(np.concatenate([ax, bx]), np.concatenate([an, bn]))
    root = _roots(code[: len(ax)], code[len(ax) :], len(x))
    keep = slice(None) if own else np.flatnonzero(root != np.arange(len(x)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[keep], n[keep], x[root[keep]], n[root[keep]])], list(_NAMES))


def _runs(batches: Iterator[pa.RecordBatch], limit: int, own: bool) -> Iterator[pa.RecordBatch]:
    """Forests of runs of about ``limit`` links, so that a task holds no more than a run."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= limit:
            yield _forest(held, own)
            held, rows = [], 0
    if held:
        yield _forest(held, own)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each vertex's representatives the least is its parent; the others get linked to that."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ax, an, bx, bn = _columns(held)
    vx, vn, v = _ranked(ax, an)
    rx, rn, r = _ranked(bx, bn)
    by = np.lexsort((r, v))
    v, r = v[by], r[by]
    first = np.r_[True, v[1:] != v[:-1]]
    parent = r[first]  # by vertex
    other = np.flatnonzero((r != parent[v]) & np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
    pairs = np.unique(r[other] * len(rx) + parent[v[other]])
    a, b = pairs // max(1, len(rx)), pairs % max(1, len(rx))
    columns = [np.concatenate(c) for c in ((vx, rx[a]), (vn, rn[a]), (rx[parent], rx[b]), (rn[parent], rn[b]))]
    is_link = np.arange(len(vx) + len(pairs)) >= len(vx)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, is_link)], [*_NAMES, "link"])


def block(end: str, turn: int, side: int):
    """The block of one end ("a" or "b") of a link among ``side``, another in every round."""
    return F.pmod(F.xxhash64(f"{end}x", f"{end}n", F.lit(turn)), F.lit(side)).cast("int")


def contract(
    links: DataFrame, cells: Callable[[DataFrame, int, int], DataFrame], label: str, most: int, cell_links: int = CELL_LINKS
) -> tuple[DataFrame, int]:
    """``(vx, vn, rx, rn)``, vertex and root, for every vertex of ``links``, and a bound of its rows.

    ``links`` has long columns ``ax, an, bx, bn``; ``most`` bounds its rows. ``cells(frame, n,
    round)`` spreads the frame's rows over partitions; each partition is one cell. Nulls must be
    gone already; repeated links, links turned round and links of a vertex to itself are allowed.
    Which vertex is the root of a group is arbitrary but fixed by the vertices.

    Links meet a forest where they are read, which never has more rows than they: a link that is
    repeated by a third of all rows is shuffled once a run.
    """
    frame = links.select(*_NAMES).mapInArrow(lambda it: _runs(it, cell_links, False), _LINKS)
    parents: list[tuple[DataFrame, int]] = []
    turn = 0
    while most or not turn:
        stars = cells(frame, most, turn).mapInArrow(lambda it: _runs(it, 4 * cell_links, True), _LINKS)
        spread = max(1, -(-2 * most // cell_links))
        met = stars.repartitionById(spread, block("a", -1, spread)).mapInArrow(_meet, f"{_LINKS}, link boolean")
        met = materialise(met, f"{label}-met{turn}")
        frame = met.filter("link").select(*_NAMES)
        sizes = {r["link"]: r["count"] for r in met.groupBy("link").count().collect()}
        step = met.filter("not link").select(F.col("ax").alias("vx"), F.col("an").alias("vn"), F.col("bx").alias("rx"), F.col("bn").alias("rn"))
        parents.append((step, sizes.get(False, 0)))
        most, turn = sizes.get(True, 0), turn + 1
    known, _ = parents[-1]
    for step, rows in reversed(parents[:-1]):
        later = known.select(F.col("vx").alias("rx"), F.col("vn").alias("rn"), F.col("rx").alias("tx"), F.col("rn").alias("tn"))
        found = look_up(step, later, ["rx", "rn"], ["vx", "vn"], most=rows)
        known = found.select("vx", "vn", F.coalesce("tx", "rx").alias("rx"), F.coalesce("tn", "rn").alias("rn"))
    return known, parents[0][1]
