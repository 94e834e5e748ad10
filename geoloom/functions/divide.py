"""Separators of small graphs, an array of rows each: the steps of operators.graphs.find_separator and iterated_separator, for all graphs of a batch at once.

Vertices are numbered by graph and id, so the lowest number is the lowest id. `of` is the graph of each."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .packed import _lists, cycled, joined, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

ROWS = 2_000_000
PARTS = np.array(["A", "B", "C"])


def _firsts(*by: np.ndarray) -> np.ndarray:
    """The first row of each value of by[0], in the order of what follows."""
    order = np.lexsort(by[::-1])
    return order[np.diff(by[0][order], prepend=-1) > 0]


def _before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the values up to each, of its own group only; start: the first place of its group."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[1:] - total[start]


def _around(tail: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each dart around its tail, from 1, and the dart behind it."""
    order = np.lexsort((*by[::-1], tail))
    t = tail[order]
    first, last = np.searchsorted(t, t), np.searchsorted(t, t, side="right") - 1
    i = np.arange(len(t))
    place, then = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    place[order] = i - first + 1
    then[order] = order[np.where(i < last, i + 1, first)]
    return place, then


def _ranked(*by: np.ndarray) -> np.ndarray:
    """The number of each row in the order of the columns; equal rows have the same."""
    order = np.lexsort(by[::-1])
    new = np.zeros(len(order), bool)
    for c in by:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _common(u: np.ndarray, v: np.ndarray, level: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Lowest common ancestors, by doubling; a root is its own parent."""
    jumps = [parent]
    while (jumps[-1][jumps[-1]] != jumps[-1]).any():
        jumps.append(jumps[-1][jumps[-1]])
    u, v = np.where(level[u] < level[v], v, u), np.where(level[u] < level[v], u, v)
    for k in reversed(range(len(jumps))):
        u = np.where(level[u] - 2**k >= level[v], jumps[k][u], u)
    for j in reversed(jumps):
        u, v = np.where(j[u] != j[v], j[u], u), np.where(j[u] != j[v], j[v], v)
    return np.where(u == v, u, parent[u])


def _triangulated(tail: np.ndarray, head: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tail, head, twin, edge, s, place around the tail) of darts and of those that cut each face into triangles: see darts.triangulated. edge: a number by (k, a, b)."""
    n = len(tail)
    a, b, s = np.minimum(tail, head), np.maximum(tail, head), (tail > head).astype(np.int64)
    name = np.lexsort((s, b, a))
    if (n % 2) or (a[name[::2]] != a[name[1::2]]).any() or (b[name[::2]] != b[name[1::2]]).any() or (s[name[::2]] == s[name[1::2]]).any():
        raise RuntimeError("half is no embedding of the edges in the plane")
    rank, twin = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[name] = np.arange(n)
    twin[name[::2]], twin[name[1::2]] = name[1::2], name[::2]
    p, cw = _around(tail, pos, rank)
    face, at, size = cycled(rank, cw[twin])
    x = np.flatnonzero((size > 3) & (at >= 2) & (at <= size - 2))
    f, m = face[x], len(x)
    zero = np.zeros(n, np.int64)
    k, low, high = (np.concatenate(c) for c in ((zero, *[at[x] * 2 + s[f]] * 2), (a, a[f], a[f]), (b, b[f], b[f])))
    new = n + np.arange(m)
    t, h = np.concatenate([tail, tail[f], tail[x]]), np.concatenate([head, tail[x], tail[f]])
    place, _ = _around(t, np.concatenate([p, p[f], p[x]]), np.concatenate([zero, -at[x], np.full(m, -1)]))
    return t, h, np.concatenate([twin, new + m, new]), _ranked(k, low, high), np.concatenate([s, np.zeros(m, np.int64), np.ones(m, np.int64)]), place


def _cycle(of: np.ndarray, cost: np.ndarray, level: np.ndarray, parent: np.ndarray, darts: tuple[np.ndarray, ...]) -> np.ndarray:
    """The vertices of the best cycle of each graph that the darts make, for a spanning tree: see darts.dart_cycles."""
    tail, head, twin, edge, s, place = _triangulated(*darts)
    _, cw = _around(tail, place)
    child = np.where(parent[tail] == head, tail, head)
    tree = (tail != head) & (parent[child] == np.where(child == tail, head, tail))
    lowest = np.full(len(of), edge.max(initial=0) + 1)
    np.minimum.at(lowest, child[tree], edge[tree])
    linked = tree & (edge == lowest[child])
    walk, pos, _ = cycled(_ranked(tail, edge, s), np.where(linked, cw[twin], cw))
    order = np.lexsort((pos, walk))
    start = np.searchsorted(walk[order], walk[order])
    down, up = linked & (pos < pos[twin]), linked & (pos > pos[twin])
    met, below = np.empty(len(tail)), np.empty(len(tail))
    met[order] = _before(np.where(down, cost[head], 0.0)[order], start)
    below[order] = _before(np.where(down, cost[head], np.where(up, -cost[tail], 0.0))[order], start)
    total = np.bincount(walk, weights=np.where(down, cost[head], 0.0), minlength=len(tail))[walk] + cost[tail[walk]]
    below += cost[tail[walk]]
    chain = cost.copy()
    chain[head[down]] = below[down]
    x = np.flatnonzero(~linked & (pos < pos[twin]))
    if not len(x):
        return x
    u, v, back = tail[x], head[x], twin[x]
    top = _common(u, v, level, parent)
    inside = met[back] - met[x] - (below[back] - chain[top])
    on = below[x] + below[back] - 2 * chain[top] + cost[top]
    best = _firsts(of[u], np.maximum(inside, total[x] - inside - on), u, v, edge[x])
    found = [top[best]]
    for end in (u[best], v[best]):
        left = top[best]
        while len(end := end[(far := end != left)]):
            left = left[far]
            found.append(end)
            end = parent[end]
    return np.concatenate(found)


def _parts(of: np.ndarray, n: int, cost: np.ndarray, u: np.ndarray, v: np.ndarray, darts: tuple[np.ndarray, ...] | None, most: int) -> np.ndarray:
    """0, 1 or 2 for A, B or C of each vertex of n graphs: see operators.graphs.find_separator. darts: tail, head, pos."""
    size, number = len(of), np.arange(len(of))
    total = np.bincount(of, weights=cost, minlength=n)[of]
    cost = np.where(total == 0, cost, cost / np.where(total == 0, 1, total))
    cut = np.zeros(size, bool)
    for k in range(most):
        live = ~cut[u] & ~cut[v]
        label = joined(size, u[live], v[live])
        weight = np.bincount(label[~cut], weights=cost[~cut], minlength=size)
        roots = np.flatnonzero(~cut & (label == number))
        top = roots[_firsts(of[roots], -weight[roots], roots)]
        top = top[weight[top] * 3 > 2 + 1e-9]
        if not len(top):
            break
        if darts is not None and k:
            raise RuntimeError("half is no embedding of the edges in the plane")
        heavy = np.zeros(size, bool)
        heavy[top] = True
        heavy = ~cut & heavy[label]
        inner = live & heavy[u]
        level, parent = spread(size, np.concatenate([u[inner], v[inner]]), np.concatenate([v[inner], u[inner]]), top)
        rows = np.flatnonzero(heavy)
        wide = level.max() + 1
        profile, row = np.unique(of[rows] * wide + level[rows], return_inverse=True)
        g, lev = profile // wide, profile % wide
        many, held = np.bincount(row), np.bincount(row, weights=cost[rows])
        start = np.searchsorted(g, g)
        many_to, held_to = _before(many, start), _before(held, start)
        end = np.searchsorted(g, g, side="right") - 1
        half = np.flatnonzero(held_to * 2 > held_to[end])
        half = half[_firsts(g[half], lev[half])]
        l1, up_to, all_ = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        l1[g[half]], up_to[g[half]], all_[g[half]] = lev[half], many_to[half], many_to[end[half]]
        l0, l2 = l1.copy(), np.zeros(n, np.int64)
        l2[g[half]] = lev[end[half]] + 1
        a = np.flatnonzero((lev <= l1[g]) & (many + 2 * (l1[g] - lev) <= 2 * np.sqrt(up_to[g])))
        a = a[_firsts(g[a], -lev[a])]
        l0[g[a]] = lev[a]
        b = np.flatnonzero((lev > l1[g]) & (many + 2 * (lev - l1[g] - 1) <= 2 * np.sqrt(all_[g] - up_to[g])))
        b = b[_firsts(g[b], lev[b])]
        l2[g[b]] = lev[b]
        cut[rows[(level[rows] == l0[of[rows]]) | (level[rows] == l2[of[rows]])]] = True
        if darts is None:
            continue
        between = heavy & (level < l2[of])
        weigh = between & (level > l0[of])
        middle = np.bincount(of[weigh], weights=cost[weigh], minlength=n)
        between &= (middle * 3 > 2 + 1e-9)[of]
        if between.any():
            own = between[darts[0]] & between[darts[1]]
            up = np.where(parent < size, parent, number)
            found = _cycle(of, np.where(weigh, cost, 0.0), level, np.where(between, up, number), tuple(d[own] for d in darts))
            cut[found[weigh[found]]] = True
    else:
        raise RuntimeError(f"graphs are not divided after {most} rounds")
    order = roots[np.lexsort((roots, -weight[roots], of[roots]))]
    start = np.searchsorted(of[order], of[order])
    heavier = _before(weight[order], start) - weight[order]
    sum_ = np.bincount(of[order], weights=weight[order], minlength=n)
    second = np.zeros(size, np.int64)
    second[order] = heavier * 3 > sum_[of[order]]
    return np.where(cut, 2, second[label])


def _pieces(of: np.ndarray, u: np.ndarray, v: np.ndarray, darts: tuple[np.ndarray, ...] | None, max_piece: int, most: int, rounds: int) -> np.ndarray:
    """The lowest vertex of each vertex's piece, -1 for separators: see operators.graphs.iterated_separator."""
    piece = np.searchsorted(of, of)
    for _ in range(rounds):
        large = np.bincount(piece[piece >= 0], minlength=len(of)) > max_piece
        rows = np.flatnonzero((piece >= 0) & large[piece])
        if not len(rows):
            return piece
        rows = rows[np.argsort(piece[rows], kind="stable")]
        names, own = np.unique(piece[rows], return_inverse=True)
        place = np.full(len(of), -1)
        place[rows] = np.arange(len(rows))
        same = lambda a, b: (place[a] >= 0) & (piece[a] == piece[b])
        inner = same(u, v)
        half = None
        if darts is not None:
            there = same(darts[0], darts[1])
            half = (place[darts[0][there]], place[darts[1][there]], darts[2][there])
        part = _parts(own, len(names), np.ones(len(rows)), place[u[inner]], place[v[inner]], half, most)
        kept = part < 2
        piece[rows[~kept]] = -1
        low = np.full(2 * len(names), len(of))
        np.minimum.at(low, own[kept] * 2 + part[kept], rows[kept])
        piece[rows[kept]] = low[own[kept] * 2 + part[kept]]
    raise RuntimeError(f"pieces are too large after {rounds} rounds")


def divider(embedded: bool, most: int, max_piece: int | None = None, rounds: int = 0):
    """A function of arrays of (kind, a, b, x): vertices (0, v, null, cost), edges (1, u, v, null) and darts (2, tail, head, pos). It gives (v, part), or with max_piece (v, piece_id)."""

    def some(graphs: pa.Array) -> pa.Array:
        size = graphs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = graphs.flatten()
        g = np.repeat(np.arange(len(size)), size)
        kind, a, b, x = (rows.field(f).fill_null(0).to_numpy(zero_copy_only=False) for f in ("kind", "a", "b", "x"))
        order = np.flatnonzero(kind == 0)
        order = order[np.lexsort((a[order], g[order]))]
        of, name = g[order], a[order]
        value = np.unique(np.concatenate([a, b]))
        key = of * max(len(value), 1) + np.searchsorted(value, name)

        def ends(k: int) -> tuple[np.ndarray, ...]:
            r = np.flatnonzero(kind == k)
            codes = [g[r] * max(len(value), 1) + np.searchsorted(value, c[r]) for c in (a, b)]
            at = [np.searchsorted(key, c) for c in codes]
            known = np.ones(len(r), bool)
            for p, c in zip(at, codes):
                known &= (p < len(key)) & (key[np.minimum(p, len(key) - 1)] == c) if len(key) else False
            return at[0][known], at[1][known], x[r][known]

        u, v, _ = ends(1)
        darts = ends(2) if embedded else None
        if max_piece is None:
            part = _parts(of, len(size), x[order], u, v, darts, most)
            return _lists(of, len(size), {"v": pa.array(name, pa.int64()), "part": pa.array(PARTS[part])})
        piece = _pieces(of, u, v, darts, max_piece, most, rounds)
        return _lists(of, len(size), {"v": pa.array(name, pa.int64()), "piece_id": pa.array(name[np.maximum(piece, 0)] if len(name) else name, pa.int64(), mask=piece < 0)})

    def divide(graphs: pa.Array) -> pa.Array:
        load = np.cumsum(graphs.value_lengths().to_numpy(zero_copy_only=False)) // ROWS  # so many rows at once
        begin = np.flatnonzero(np.diff(load, prepend=-1))
        return pa.concat_arrays([some(graphs.slice(i, j - i)) for i, j in zip(begin, [*begin[1:], len(graphs)])] or [some(graphs)])

    return divide
