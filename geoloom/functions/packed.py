"""Arrow functions over one array of rows for each polygon or graph: Spark groups and shuffles, numpy works on all arrays of a batch of equal length at once."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

HITS = "array<struct<hl:long,hl_x:double,hr:long,hr_x:double>>"
SLOPED = "array<struct<hl:long,hl_x:double,hl_slope:double,hr:long,hr_x:double,hr_slope:double>>"
CELLS = 400_000
PART = 100_000


def in_parts(f):
    """A function of lists, a row for each polygon or graph, that works on rows of some PART elements in all at a time, so that its memory doesn't grow with the batch."""

    @functools.wraps(f)
    def parted(*columns: pa.Array) -> pa.Array:
        size = sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns if pa.types.is_list(c.type))
        part = (np.cumsum(size) - size) // PART
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        if len(begin) < 2:
            return f(*columns)
        return pa.concat_arrays([f(*(c.slice(a, b - a) for c in columns)) for a, b in zip(begin, np.append(begin[1:], len(part)))])

    return parted


@in_parts
def ray_hits(rings: pa.Array) -> pa.Array:
    """hl, hl_x, hr, hr_x for arrays of (e, x, y, rk, next_x, next_y, next_rk, edge): of the edges that enclose a row's rank the nearest left and right of it; of equal places by slope, as just above. edge: whether one begins there."""
    return _hits(rings, False)


@in_parts
def sloped_hits(rings: pa.Array) -> pa.Array:
    """What ray_hits gives, with the slopes of both edges."""
    return _hits(rings, True)


def _hits(rings: pa.Array, sloped: bool) -> pa.Array:
    size = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    flat = rings.flatten()
    e, x, y, rk, nx, ny, nrk, edge = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("e", "x", "y", "rk", "next_x", "next_y", "next_rk", "edge"))
    hit, at = np.full((2, len(flat)), -1, np.int64), np.zeros((2, len(flat)))
    lean = np.zeros((2, len(flat)))
    with np.errstate(all="ignore"):
        slope = (nx - x) / (ny - y)
    for n in np.unique(size[size > 0]):
        starts = first[:-1][size == n]
        wide = max(1, CELLS // (n * n))  # rings at once; a long ring is asked in rows of as many cells
        tall = n if n * n <= CELLS else max(1, CELLS // n)
        for k in range(0, len(starts), wide):
            own = starts[k : k + wide, None] + np.arange(n)
            lo, hi = np.minimum(rk[own], nrk[own])[:, None], np.where(edge[own], np.maximum(rk[own], nrk[own]), -1)[:, None]
            for r in range(0, n, tall):
                ask = own[:, r : r + tall]
                level, here = rk[ask][..., None], x[ask][..., None]
                with np.errstate(all="ignore"):
                    met = x[own][:, None] + (y[ask][..., None] - y[own][:, None]) * slope[own][:, None]
                over = (lo < level) & (level < hi)
                for side, sign in ((0, 1), (1, -1)):
                    near = np.where(over & (sign * met <= sign * here), sign * met, -np.inf)
                    best = near.max(axis=2)
                    steep = np.where((near == best[..., None]) & (near > -np.inf), slope[own][:, None], -np.inf)  # right: the least of (met, -slope)
                    which = np.take_along_axis(own, steep.argmax(axis=2), 1)
                    seen = best > -np.inf
                    hit[side, ask[seen]] = e[which[seen]]
                    at[side, ask[seen]] = sign * best[seen]
                    lean[side, ask[seen]] = slope[which[seen]]
    columns, names = [], []
    for side in (0, 1):
        none = hit[side] < 0
        columns += [pa.array(hit[side], pa.int64(), mask=none), *[pa.array(c[side], pa.float64(), mask=none) for c in ((at, lean) if sloped else (at,))]]
        names += [f"h{'lr'[side]}{c}" for c in (("", "_x", "_slope") if sloped else ("", "_x"))]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(columns, names))


def _numbers(rows: pa.Array) -> list[np.ndarray]:
    """The whole numbers that a column, or a struct of structs, is made of, in the order that tells its values apart."""
    if pa.types.is_struct(rows.type):
        return [c for k in range(rows.type.num_fields) for c in _numbers(rows.field(k))]
    return [rows.to_numpy(zero_copy_only=False).astype(np.int64)]


def cycled(rank: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, ...]:
    """The row of lowest rank on each row's walk, the place counted from it, and the walk's length; rank tells rows apart, then is the next row."""
    n = len(rank)
    row = np.full(rank.max(initial=-1) + 1, -1)
    row[rank] = np.arange(n)
    low, steps, k = rank, np.zeros(n, np.int64), 0
    while True:
        lower = low[then] < low
        if not lower.any():
            break
        steps = np.where(lower, steps[then] + 2**k, steps)
        low, then, k = np.where(lower, low[then], low), then[then], k + 1
    face = row[low]
    long = np.bincount(face, minlength=n)[face]
    return face, (long - steps) % np.maximum(long, 1), long


@in_parts
def walks(graphs: pa.Array) -> pa.Array:
    """face, pos and size for arrays of (h, next): the lowest h on the walk, the place counted from it, and the walk's length; see operators.walks.faces."""
    size = graphs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    flat = graphs.flatten()
    n = len(flat)
    code = np.tile(np.repeat(np.arange(len(size)), size), 2)
    for h, then in zip(_numbers(flat.field("h")), _numbers(flat.field("next"))):
        place = np.unique(np.concatenate([h, then]), return_inverse=True)[1]
        code = np.unique(code * (place.max(initial=0) + 1) + place, return_inverse=True)[1]
    row = np.full(code.max(initial=-1) + 1, -1)
    row[code[:n]] = np.arange(n)
    then = row[code[n:]]
    if (then < 0).any():
        raise ValueError("a walk has no next row")
    face, pos, long = cycled(code[:n], then)
    columns = [flat.field("h").take(pa.array(face)), pa.array(pos, pa.int64()), pa.array(long, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(columns, ["face", "pos", "size"]))


def _nodes(graphs: pa.Array) -> tuple[np.ndarray, ...]:
    """For arrays of (v, to): the number of each row's array, numbers of v and to that grow with array and vertex (to: -1 for none), and per number its array and vertex."""
    size = graphs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = graphs.flatten()
    of = np.repeat(np.arange(len(size)), size)
    there = flat.field("to").is_valid().to_numpy(zero_copy_only=False)
    v, to = flat.field("v").to_numpy(zero_copy_only=False), flat.field("to").fill_null(0).to_numpy(zero_copy_only=False)
    name, place = np.unique(np.concatenate([v, to[there]]), return_inverse=True)
    number, code = np.unique(np.concatenate([of, of[there]]) * max(len(name), 1) + place, return_inverse=True)
    end = np.full(len(v), -1)
    end[there] = code[len(v) :]
    return code[: len(v)], end, number // max(len(name), 1), name[number % max(len(name), 1)] if len(name) else name


def _lists(of: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each of n arrays, from columns in the order of the arrays' numbers."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def spread(n: int, tail: np.ndarray, head: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level (-1: not reached) and parent (n: none) of n vertices, from those of front along edges given both ways."""
    level, parent = np.full(n, -1, np.int32), np.full(n, n)
    level[front] = 0
    order = np.argsort(tail, kind="stable")
    tail, head = tail[order], head[order]
    first = np.searchsorted(tail, np.arange(n + 1))
    k = 0
    while len(front):
        k += 1
        many = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        new = level[head[at]] < 0
        up, down = tail[at][new], head[at][new]
        np.minimum.at(parent, down, up)
        front = np.unique(down)
        level[front] = k
    return level, parent


@in_parts
def levels(graphs: pa.Array) -> pa.Array:
    """(v, level, parent) of what is reached, for arrays of edges (v, to), both ways, and of roots (v, null): one level of all graphs of the batch at a time; parent: the lowest neighbour a level up."""
    a, b, of, name = _nodes(graphs)
    n = len(of)
    level, parent = spread(n, a[b >= 0], b[b >= 0], np.unique(a[b < 0]))
    seen = np.flatnonzero(level >= 0)
    up = parent[seen]
    rooted = up == n
    return _lists(of[seen], len(graphs), {"v": pa.array(name[seen], pa.int64()), "level": pa.array(level[seen]), "parent": pa.array(name[np.where(rooted, 0, up)], pa.int64(), mask=rooted)})


def joined(n: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The lowest of n vertices that each reaches along edges."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[w])
        np.minimum.at(label, label[u], low)  # the roots of both ends get the lower one
        np.minimum.at(label, label[w], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[w]
        u, w = u[apart], w[apart]
    return label


@in_parts
def lowest(graphs: pa.Array) -> pa.Array:
    """(v, component) of the vertices, for arrays of vertices (v, null) and edges (v, to): the lowest vertex reachable."""
    a, b, of, name = _nodes(graphs)
    n = len(of)
    label = joined(n, a[b >= 0], b[b >= 0])
    own = np.unique(a[b < 0])
    best = np.full(n, n)
    np.minimum.at(best, label[own], own)
    return _lists(of[own], len(graphs), {"v": pa.array(name[own], pa.int64()), "component": pa.array(name[best[label[own]]], pa.int64())})


def nearby(rows: int):
    """A function over batches of (gid, v, to), vertices (to: null) and edges, sorted by gid and v. It gives (gid, v, low, own): the lowest vertex that v reaches by the edges of its block of some `rows` rows, and whether v is among the vertices there."""

    def settle(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(blocks).combine_chunks()
        gid, v, to = (t.column(c).combine_chunks() for c in ("gid", "v", "to"))
        g = gid.dictionary_encode()
        there = to.is_valid().to_numpy(zero_copy_only=False)
        of, v, to = g.indices.to_numpy(), v.to_numpy(), to.fill_null(0).to_numpy()
        name, place = np.unique(np.concatenate([v, to[there]]), return_inverse=True)
        number, code = np.unique(np.concatenate([of, of[there]]) * len(name) + place, return_inverse=True)
        low = joined(len(number), code[: len(v)][there], code[len(v) :])
        own = np.zeros(len(number), bool)
        own[code[: len(v)][~there]] = True
        ids = number % len(name)
        return pa.record_batch([g.dictionary.take(pa.array(number // len(name))), pa.array(name[ids], pa.int64()), pa.array(name[ids[low]], pa.int64()), pa.array(own)], ["gid", "v", "low", "own"])

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield settle(held)
                held, n = [], 0
        if n:
            yield settle(held)

    return blocks


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each row's array, and the rows."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), lists.flatten()


def _xxhash64(longs: list[np.ndarray], k: int) -> np.ndarray:
    """Spark's xxhash64 of long columns and a whole number."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def end(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = np.full(len(longs[0]), 42, np.uint64)
    for x in longs:
        h = end(turned((h + p5 + np.uint64(8)) ^ (turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    return end(turned((h + p5 + np.uint64(4)) ^ (np.full(1, k, np.uint64) * p1), 23) * p2 + p3).view(np.int64)


def _matches(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (place in asked, place in the sorted keys) of equal values."""
    first = np.searchsorted(keys, asked)
    many = np.searchsorted(keys, asked, side="right") - first
    return np.repeat(np.arange(len(asked)), many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


ARC = "arc_id:long,region_id:long,first_edge:long,last_edge:long,first_side:string,last_side:string,edge_count:long"
COARSE = f"struct<regions:array<long>,arcs:array<struct<{ARC}>>,chords:array<struct<at:int,region_a:long,region_b:long>>>"
WEIGHED = COARSE.replace(ARC, ARC + ",weight:long")


class Maps:
    """Region maps of a batch as numbers: regions, arcs (known: with edges) and chords of all maps, and what the steps of operators.regions do to them.

    Arrays are without nulls but for ARCs that have no edges. Chords are (chord_id, region_a, region_b, lo, hi, lo_fixed, hi_fixed), fixed: no end that vanishes."""

    def __init__(self, maps: pa.Array, regions: pa.Array, arcs: pa.Array, chords: pa.Array):
        self.n, self.name = len(maps), maps.to_numpy(zero_copy_only=False)
        (r_of, r), (self.a_of, a), (self.c_of, c) = _flat(regions), _flat(arcs), _flat(chords)
        whole = lambda t, f: t.field(f).fill_null(0).to_numpy(zero_copy_only=False)
        ids = np.concatenate([r.to_numpy(zero_copy_only=False), whole(a, "region_id"), whole(c, "region_a"), whole(c, "region_b")])
        value, place = np.unique(ids, return_inverse=True)
        number, code = np.unique(np.concatenate([r_of, self.a_of, self.c_of, self.c_of]) * max(len(value), 1) + place, return_inverse=True)
        self.of_region, self.id_of = number // max(len(value), 1), value[number % max(len(value), 1)] if len(value) else value
        self.alive, self.reg, self.ca, self.cb = np.split(code, np.cumsum([len(r), len(a), len(c)]))
        self.known = a.field("first_edge").is_valid().to_numpy(zero_copy_only=False)
        self.aid, self.first, self.last, self.count = (whole(a, f) for f in ("arc_id", "first_edge", "last_edge", "edge_count"))
        self.side = pa.concat_arrays([a.field("first_side"), a.field("last_side")]).dictionary_encode()
        self.fs, self.ls = np.split(self.side.indices.fill_null(-1).to_numpy(zero_copy_only=False), 2)
        self.lo, self.hi = np.minimum(self.first, self.last), np.maximum(self.first, self.last)
        self.cid, clo, chi = (whole(c, f) for f in ("chord_id", "lo", "hi"))
        self.fixed = [c.field(f).to_numpy(zero_copy_only=False).astype(bool) for f in ("lo_fixed", "hi_fixed")]
        self.edges = np.unique(np.concatenate([clo, chi]))
        self.wide = max(len(self.edges), 1)
        self.ends = [np.searchsorted(self.edges, clo), np.searchsorted(self.edges, chi)]
        self.two = clo != chi
        self.live = np.arange(len(c))

    def at_ends(self, rows: np.ndarray, regions: tuple[np.ndarray, ...], keep) -> np.ndarray:
        """(region, edge) as a number, for the kept ends of chords at each of the regions."""
        return np.concatenate([x[ok] * self.wide + self.ends[e][rows[ok]] for x in regions for e in (0, 1) for ok in [keep(e)]] or [np.zeros(0, np.int64)])

    def measures(self) -> tuple[np.ndarray, np.ndarray]:
        """Degree and weight of each region."""
        x, y = self.ca[self.live], self.cb[self.live]
        weight = np.zeros(len(self.of_region), np.int64)
        np.maximum.at(weight, self.reg, self.count)
        return np.bincount(x, minlength=len(weight)) + np.bincount(y[x != y], minlength=len(weight)), weight

    def merged(self, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The largest edge count of an arc without each of the chords q, which lie between two regions: see operators.regions.merged_weights."""
        live, ends, edges, wide, known, two = self.live, self.ends, self.edges, self.wide, self.known, self.two
        x, y = self.ca[live], self.cb[live]
        used, times = np.unique(np.concatenate([self.at_ends(live, (x,), lambda e: two[live] | (e == 0)), self.at_ends(live, (y,), lambda e: (x != y) & (two[live] | (e == 0)))]), return_counts=True)
        qx, qy = self.ca[q], self.cb[q]
        lo, hi, base = self.lo[known], self.hi[known], self.reg[known] * wide
        keys, which = [], []
        rows = np.flatnonzero(known)
        for edge, nth in ((lo, 0), (hi, 1), (hi + 1, 2)):
            where = np.searchsorted(edges, edge)
            ok = (where < len(edges)) & (edges[np.minimum(where, wide - 1)] == edge)
            if nth == 1:
                ok &= lo != hi
            keys.append(base[ok] + where[ok])
            which.append(rows[ok])
        keys, which = np.concatenate(keys), np.concatenate(which)
        order = np.argsort(keys, kind="stable")
        keys, which = keys[order], which[order]
        pair, bit = [], []
        many = max(len(self.aid), 1)
        for e in (0, 1):
            here = [z * wide + ends[e][q] for z in (qx, qy)]
            free = ~self.fixed[e][q] & (two[q] | (e == 0))
            for h in here:
                free &= times[np.minimum(np.searchsorted(used, h), len(used) - 1)] == 1
            f = np.flatnonzero(free)
            for h in here:
                i, j = _matches(keys, h[f])
                pair.append(f[i] * many + which[j])
                bit.append(np.full(len(i), e + 1))
        met, back = np.unique(np.concatenate(pair), return_inverse=True)
        kind = np.bincount(back, weights=np.concatenate(bit), minlength=len(met)).astype(np.int64)
        chord, n_of = met // many, self.count[met % many] if len(self.aid) else met
        low, high, bridge = (np.bincount(chord[kind == b], weights=n_of[kind == b], minlength=len(q)).astype(np.int64) for b in (1, 2, 3))
        bridged = np.bincount(chord[kind == 3], minlength=len(q)) > 0
        return np.maximum(np.maximum(weight[qx], weight[qy]), np.where(bridged, low + high + bridge, np.maximum(low, high)))

    def contract(self, chosen: np.ndarray, to: np.ndarray) -> None:
        """Takes chords out; to: the region that each goes over to. See operators.regions.contract_chords."""
        self.live = np.setdiff1d(self.live, chosen)
        live, edges, wide = self.live, self.edges, self.wide
        self.ca, self.cb, self.reg, self.alive = to[self.ca], to[self.cb], to[self.reg], np.unique(to[self.alive])
        held = self.at_ends(live, (self.ca[live], self.cb[live]), lambda e: np.ones(len(live), bool))
        gone = np.setdiff1d(self.at_ends(chosen, (self.ca[chosen],), lambda e: ~self.fixed[e][chosen]), held)
        mine = np.isin(self.reg, gone // wide) & self.known
        s = np.flatnonzero(mine)
        s = s[np.lexsort((self.aid[s], self.lo[s], self.fs[s], self.reg[s]))]
        if not len(s):
            return
        lo, hi, reg, fs = self.lo[s], self.hi[s], self.reg[s], self.fs[s]
        where = np.minimum(np.searchsorted(edges, lo), wide - 1)
        glue = (edges[where] == lo) & np.isin(reg * wide + where, gone)
        glue[0] = False
        glue[1:] &= (reg[1:] == reg[:-1]) & (fs[1:] == fs[:-1]) & ((hi[:-1] == lo[1:]) | (hi[:-1] + 1 == lo[1:]))
        start, run = np.flatnonzero(~glue), np.cumsum(~glue) - 1
        final = s[np.lexsort((self.aid[s], hi, run))][np.append(start[1:], len(s)) - 1]  # of each run the arc that reaches highest
        ids, sums = np.minimum.reduceat(self.aid[s], start), np.add.reduceat(self.count[s], start)
        rest, begin = np.flatnonzero(~mine), s[start]
        both = lambda old, of_run: np.concatenate([old[rest], of_run])
        self.first, self.last, self.fs, self.ls = both(self.first, self.first[begin]), both(self.last, self.last[final]), both(self.fs, self.fs[begin]), both(self.ls, self.ls[final])
        self.aid, self.count, self.reg, self.a_of, self.known = both(self.aid, ids), both(self.count, sums), both(self.reg, self.reg[begin]), both(self.a_of, self.a_of[begin]), both(self.known, self.known[begin])
        self.lo, self.hi = np.minimum(self.first, self.last), np.maximum(self.first, self.last)

    def lists(self, weighed: bool = False) -> pa.Array:
        """COARSE: regions, arcs and chords, these as their places. weighed: WEIGHED, arcs with the weight of their region."""
        order = np.argsort(self.a_of, kind="stable")
        longs = lambda z: pa.array(z, pa.int64())
        text = lambda z: self.side.dictionary.take(pa.array(z, mask=z < 0))
        none = ~self.known[order]
        edge = lambda z: pa.array(z[order], pa.int64(), mask=none)
        out = {"arc_id": longs(self.aid[order]), "region_id": longs(self.id_of[self.reg[order]]), "first_edge": edge(self.first), "last_edge": edge(self.last), "first_side": text(self.fs[order]), "last_side": text(self.ls[order]), "edge_count": longs(self.count[order])}
        if weighed:
            out["weight"] = longs(self.measures()[1][self.reg[order]])
        alive, live = np.unique(self.alive), self.live
        at = live - np.searchsorted(self.c_of, self.c_of[live])
        left = _lists(self.c_of[live], self.n, {"at": pa.array(at, pa.int32()), "region_a": longs(self.id_of[self.ca[live]]), "region_b": longs(self.id_of[self.cb[live]])})
        kept = pa.ListArray.from_arrays(pa.array(np.searchsorted(self.of_region[alive], np.arange(self.n + 1)).astype(np.int32)), longs(self.id_of[alive]))
        return pa.StructArray.from_arrays([kept, _lists(self.a_of[order], self.n, out), left], ["regions", "arcs", "chords"])


def coarser(gamma: int, below: int | None, most: int):
    """A function of Maps, map, regions, arcs and chords as arrays: see operators.regions.coarsen, whose rounds it takes for all maps of a batch at once."""

    @in_parts
    def coarse(maps: pa.Array, regions: pa.Array, arcs: pa.Array, chords: pa.Array) -> pa.Array:
        m = Maps(maps, regions, arcs, chords)
        for k in range(most):
            degree, weight = m.measures()
            x, y = m.ca[m.live], m.cb[m.live]
            able = (x != y) & (np.minimum(degree[x], degree[y]) < 3) & (np.maximum(weight[x], weight[y]) <= gamma)
            if below is not None:
                able &= m.cid[m.live] < below
            q = m.live[able]
            if len(q):
                q = q[m.merged(q, weight) <= gamma]
            if not len(q):
                break
            qx, qy = m.ca[q], m.cb[q]
            place = np.empty(len(q), np.int64)
            place[np.lexsort((m.cid[q], _xxhash64([m.name[m.c_of[q]], m.cid[q]], k)))] = np.arange(len(q))
            best = np.full(len(degree), len(q))
            np.minimum.at(best, qx, place)
            np.minimum.at(best, qy, place)
            chosen = q[(best[qx] == place) & (best[qy] == place)]
            to = np.arange(len(degree))
            to[np.maximum(m.ca[chosen], m.cb[chosen])] = np.minimum(m.ca[chosen], m.cb[chosen])
            m.contract(chosen, to)
        else:
            raise RuntimeError(f"chords can still go after {most} rounds")
        return m.lists()

    return coarse


MERGED = "array<struct<chord_id:long,region_a:long,region_b:long,da:long,db:long,merged:long>>"


@in_parts
def merged(maps: pa.Array, regions: pa.Array, arcs: pa.Array, chords: pa.Array) -> pa.Array:
    """MERGED, for Maps as coarser takes them: see operators.regions.merged_weights."""
    m = Maps(maps, regions, arcs, chords)
    degree, weight = m.measures()
    q = m.live[m.ca != m.cb]
    x, y = m.ca[q], m.cb[q]
    longs = [m.cid[q], m.id_of[x], m.id_of[y], degree[x], degree[y], m.merged(q, weight) if len(q) else x]
    return _lists(m.c_of[q], m.n, dict(zip(("chord_id", "region_a", "region_b", "da", "db", "merged"), (pa.array(z, pa.int64()) for z in longs))))


@in_parts
def contracted(maps: pa.Array, regions: pa.Array, arcs: pa.Array, chords: pa.Array, drop: pa.Array) -> pa.Array:
    """WEIGHED, without the chords that drop marks, for Maps as coarser takes them: see operators.regions.contract_chords."""
    m = Maps(maps, regions, arcs, chords)
    chosen = np.flatnonzero(drop.flatten().to_numpy(zero_copy_only=False).astype(bool))
    m.contract(chosen, joined(len(m.of_region), m.ca[chosen], m.cb[chosen]))
    return m.lists(weighed=True)


PIECES = "array<struct<piece:struct<tail:long,head:long>,pos:long,idx:long,size:long,x:double,y:double>>"


@in_parts
def split(rings: pa.Array, diagonals: pa.Array) -> pa.Array:
    """The pieces' corners for arrays of (idx, x, y), in order of idx, which counts from 0, and of (u, v): see operators.triangulation.split_by_diagonals."""
    of, ring = _flat(rings)
    d_of, d = _flat(diagonals)
    idx, u, v = ring.field("idx").to_numpy(zero_copy_only=False), d.field("u").to_numpy(zero_copy_only=False), d.field("v").to_numpy(zero_copy_only=False)
    n = np.bincount(of, minlength=len(rings))
    first = np.cumsum(n) - n
    if (idx != np.arange(len(idx)) - first[of]).any():
        raise ValueError("idx doesn't count from 0")
    after = np.where(idx + 1 < n[of], idx + 1, 0)
    own, at, to = np.concatenate([of, of, d_of, d_of]), np.concatenate([idx, after, u, v]), np.concatenate([after, idx, v, u])
    turn = (to - at) % n[own]
    order = np.lexsort((turn, at, own))
    own, at, to = own[order], at[order], to[order]
    k = np.flatnonzero((own[1:] == own[:-1]) & (at[1:] == at[:-1])) + 1
    side = lambda a, b: pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["tail", "head"])
    own, at, to, then = own[k], at[k], to[k], to[k - 1]
    f = walks(_lists(own, len(rings), {"h": side(to, at), "next": side(at, then)})).flatten()
    row = pa.array(first[own] + to)
    return _lists(own, len(rings), {"piece": f.field("face"), "pos": f.field("pos"), "idx": pa.array(to, pa.int64()), "size": f.field("size"), "x": ring.field("x").take(row), "y": ring.field("y").take(row)})


@in_parts
def areas(rings: pa.Array, triangles: pa.Array) -> pa.Array:
    """Twice the sum of the triangles' areas, for arrays of (idx, x, y), in order of idx, and of (a, b, c)."""
    of, ring = _flat(rings)
    t_of, t = _flat(triangles)
    ids = [ring.field("idx"), *(t.field(c) for c in "abc")]
    place = np.unique(np.concatenate([i.to_numpy(zero_copy_only=False) for i in ids]), return_inverse=True)[1]
    code = np.concatenate([of, t_of, t_of, t_of]) * (place.max(initial=0) + 1) + place
    keys, asked = code[: len(of)], code[len(of) :]
    row = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0)) if len(keys) else np.zeros(0, np.int64)
    (ax, ay), (bx, by), (cx, cy) = ((ring.field("x").take(pa.array(r)).to_numpy(zero_copy_only=False), ring.field("y").take(pa.array(r)).to_numpy(zero_copy_only=False)) for r in np.split(row, 3))
    there = (keys[row] == asked).reshape(3, -1).all(axis=0)
    area = np.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    total = np.bincount(t_of[there], weights=area[there], minlength=len(rings))
    return pa.array(total, pa.float64(), mask=np.bincount(t_of[there], minlength=len(rings)) == 0)
