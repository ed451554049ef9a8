"""A small numpy geometry kernel for what column expressions cannot say: hulls, clipping, sectors, box unions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of (n, 2) points, anticlockwise, not closed (monotone chain)."""
    pts = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    if len(pts) < 3:
        return pts
    # of points that share an x only the lowest and the highest can be corners
    turn = pts[1:, 0] != pts[:-1, 0]
    pts = pts[np.concatenate([[True], turn]) | np.concatenate([turn, [True]])]
    halves = []
    for ordered in (pts.tolist(), pts[::-1].tolist()):
        chain: list[list[float]] = []
        for p in ordered:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return np.array(halves)


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def simple(ring: np.ndarray, chunk: int = 256) -> bool:
    """Whether a ring, closed or not, has area and meets itself nowhere: a sweep over its edges in order of their left ends."""
    ring = np.asarray(ring, dtype=float).reshape(-1, 2)
    if not len(ring) or not np.isfinite(ring).all():
        return False
    ring = ring[(ring != np.roll(ring, -1, axis=0)).any(axis=1)]
    n = len(ring)
    if n < 3 or not area(ring):
        return False
    a, b = ring, np.roll(ring, -1, axis=0)
    order = np.argsort(np.minimum(a[:, 0], b[:, 0]), kind="stable")
    a, b = a[order], b[order]
    left, right = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for begin in range(0, n, chunk):
        end = int(np.searchsorted(left, right[begin : begin + chunk].max(), side="right"))
        p, q, r, s = a[begin : begin + chunk, None], b[begin : begin + chunk, None], a[None, begin:end], b[None, begin:end]
        boxes = (np.minimum(p, q) <= np.maximum(r, s)).all(axis=2) & (np.minimum(r, s) <= np.maximum(p, q)).all(axis=2)
        t1, t2, t3, t4 = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
        meets = boxes & (t1 * t2 <= 0) & (t3 * t4 <= 0)
        i, j = order[begin : begin + chunk, None], order[None, begin:end]
        # neighbours share a corner, and may share no more: one may not run back over the other
        beside = ((i - j) % n == 1) | ((j - i) % n == 1)
        back = beside & (t1 == 0) & (t2 == 0) & (((q - p) * (s - r)).sum(axis=2) < 0)
        if (meets & (i != j) & ~beside).any() or back.any():
            return False
    return True


def clip(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """`ring` inside a convex anticlockwise `window`: cut by one side after the other."""
    out = np.asarray(ring, dtype=float)
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if side[i] * side[j] < 0:
                kept.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(kept)
    return out


def sectors(ring: np.ndarray, n: int) -> list[np.ndarray]:
    """The ring's vertices dealt into n equal angles about their mean; each with the mean, if it has two or more."""
    middle = ring.mean(axis=0)
    angle = np.mod(np.arctan2(*(ring - middle).T[::-1]), 2 * np.pi)
    at = np.minimum((angle / (2 * np.pi / n)).astype(int), n - 1)
    return [np.vstack([middle, ring[at == k][np.argsort(angle[at == k])]]) for k in range(n) if (at == k).sum() >= 2]


def all_sectors(rings: Rings, n: np.ndarray) -> tuple[np.ndarray, Rings]:
    """(owner, parts): what `sectors` makes of each ring, as far as it has area, or else the whole ring; many rings at once."""
    rows, corners = len(rings.starts) - 1, np.diff(rings.starts)
    with np.errstate(invalid="ignore", divide="ignore"):
        middle = [np.bincount(rings.owner, v, rows) / corners for v in (rings.x, rings.y)]
        angle = np.mod(np.arctan2(rings.y - middle[1][rings.owner], rings.x - middle[0][rings.owner]), 2 * np.pi)
        share = np.nan_to_num(angle / (2 * np.pi / n[rings.owner]), nan=-1.0)
    at = np.minimum(share.astype(np.int64), n[rings.owner] - 1)
    order = np.lexsort((angle, at, rings.owner))
    order = order[at[order] >= 0]
    owner, at = rings.owner[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])])[: len(owner)])
    size = np.diff(np.append(first, len(owner)))
    first, size = first[size >= 2], size[size >= 2]
    of = owner[first]
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    inner = np.ones(starts[-1], bool)
    inner[starts[:-1]] = False
    taken = order[np.repeat(first, size) + ragged(size)]
    axes = []
    for v, m in zip((rings.x, rings.y), middle):
        out = np.repeat(m[of], size + 1)
        out[inner] = v[taken]
        axes.append(out)
    parts = Rings(starts, *axes)
    cross = [np.bincount(parts.owner, v, len(of)) for v in (parts.x * parts.y2, parts.y * parts.x2)]
    solid = np.flatnonzero(np.abs(cross[0] - cross[1]) > 0)
    whole = np.flatnonzero(np.bincount(of[solid], minlength=rows) == 0)
    of, both = np.concatenate([of[solid], whole]), (parts.take(solid), rings.take(whole))
    counts = np.concatenate([np.diff(r.starts) for r in both])
    joined = Rings(np.concatenate([[0], np.cumsum(counts)]), *(np.concatenate([getattr(r, k) for r in both]) for k in "xy"))
    order = np.argsort(of, kind="stable")
    return of[order], joined.take(order)


def box_union(boxes: np.ndarray) -> tuple[float, np.ndarray]:
    """(area, bounds) of the largest connected part of a union of boxes (minx, miny, maxx, maxy)."""
    boxes = boxes[(boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])]
    if not len(boxes):
        return 0.0, np.full(4, np.nan)
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    filled = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for x1, y1, x2, y2 in boxes:
        filled[np.searchsorted(xs, x1) : np.searchsorted(xs, x2), np.searchsorted(ys, y1) : np.searchsorted(ys, y2)] = True
    sizes = np.outer(np.diff(xs), np.diff(ys))
    best, best_bounds, seen = 0.0, np.full(4, np.nan), np.zeros_like(filled)
    for start in zip(*np.nonzero(filled)):
        if seen[start]:
            continue
        todo, part = [start], []
        seen[start] = True
        while todo:
            i, j = todo.pop()
            part.append((i, j))
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < filled.shape[0] and 0 <= b < filled.shape[1] and filled[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    todo.append((a, b))
        i, j = np.array(part).T
        if (total := float(sizes[i, j].sum())) > best:
            best, best_bounds = total, np.array([xs[i.min()], ys[j.min()], xs[i.max() + 1], ys[j.max() + 1]])
    return best, best_bounds


def ragged(counts: np.ndarray) -> np.ndarray:
    """The number of each row within its group, of groups that follow each other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _hits(owner: np.ndarray, starts: np.ndarray, test, tests: int = 1, most: int = 1 << 18) -> list[np.ndarray]:
    """For each of some things, how many of its owner's others, from starts[owner] on, pass each of the tests; so many pairs at once at most."""
    count = np.diff(starts)[owner]
    upto, out, begin = np.cumsum(count), [np.zeros(len(owner), np.int64) for _ in range(tests)], 0
    while begin < len(owner):
        end = max(begin + 1, int(np.searchsorted(upto, most + (upto[begin - 1] if begin else 0), side="right")))
        n = count[begin:end]
        who = np.repeat(np.arange(begin, end), n)
        for total, passed in zip(out, test(who, ragged(n) + np.repeat(starts[owner[begin:end]], n))):
            total[begin:end] = np.bincount(who[passed] - begin, minlength=end - begin)
        begin = end
    return out


@dataclass
class Rings:
    """Rings one after the other: the corners of ring i are those from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        counts = np.diff(self.starts)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.after = np.arange(len(self.x)) + 1
        self.after[self.starts[1:][counts > 0] - 1] = self.starts[:-1][counts > 0]
        self.x2, self.y2 = self.x[self.after], self.y[self.after]
        self.left, self.right = np.minimum(self.x, self.x2), np.maximum(self.x, self.x2)
        self.low, self.high = np.minimum(self.y, self.y2), np.maximum(self.y, self.y2)

    def take(self, rows: np.ndarray) -> Rings:
        counts = np.diff(self.starts)[rows]
        at = ragged(counts) + np.repeat(self.starts[rows], counts)
        return Rings(np.concatenate([[0], np.cumsum(counts)]), self.x[at], self.y[at])

    def thin(self) -> Rings:
        """The rings without corners that the next one repeats, such as a closing one; one of each ring stays."""
        keep = (self.x != self.x2) | (self.y != self.y2)
        alone = np.bincount(self.owner[keep], minlength=len(self.starts) - 1) == 0
        keep |= alone[self.owner] & (np.arange(len(keep)) == self.starts[self.owner])
        return Rings(np.concatenate([[0], np.cumsum(np.bincount(self.owner[keep], minlength=len(self.starts) - 1))]), self.x[keep], self.y[keep])

    def span(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest value of each ring's corners; NaN doesn't count, and is what a ring without corners has."""
        some = np.diff(self.starts) > 0
        out = np.full((2, len(some)), np.nan)
        if some.any():
            for k, f in enumerate((np.fmin, np.fmax)):
                out[k, some] = f.reduceat(values, self.starts[:-1][some])
        return out[0], out[1]

    def turn(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.x2[e] - self.x[e]) * (y - self.y[e]) - (self.y2[e] - self.y[e]) * (x - self.x[e])

    def places(self, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether places lie inside the ring that owns them (ray casting over half-open edges), and whether on its edges."""

        def met(who: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            px, py, y1, y2 = x[who], y[who], self.y[e], self.y2[e]
            cast, some = np.zeros(len(e), bool), np.flatnonzero((y1 > py) != (y2 > py))
            f = e[some]
            cast[some] = px[some] < (self.x2[f] - self.x[f]) * (py[some] - y1[some]) / (y2[some] - y1[some]) + self.x[f]
            on, some = np.zeros(len(e), bool), np.flatnonzero((self.low[e] <= py) & (py <= self.high[e]) & (self.left[e] <= px) & (px <= self.right[e]))
            on[some] = self.turn(e[some], px[some], py[some]) == 0
            return cast, on

        cast, on = _hits(owner, self.starts, met, 2)
        return cast % 2 == 1, on > 0


def _any(owner: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=n) > 0


def _marks(rings: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring, x, y) of all corners and of the middles of all edges."""
    return np.tile(rings.owner, 2), np.concatenate([rings.x, (rings.x + rings.x2) / 2]), np.concatenate([rings.y, (rings.y + rings.y2) / 2])


def _apart(inner: Rings, other: Rings) -> np.ndarray:
    """Rings none of whose edges cross one of the other, and that hold no corner of it strictly."""
    turns = lambda one, a, two, b: one.turn(a, two.x[b], two.y[b]) * one.turn(a, two.x2[b], two.y2[b])

    def crossed(e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray]:
        # edges that cross have boxes that meet
        out = (inner.left[e] <= other.right[f]) & (other.left[f] <= inner.right[e]) & (inner.low[e] <= other.high[f]) & (other.low[f] <= inner.high[e])
        some = np.flatnonzero(out)
        e, f = e[some], f[some]
        out[some] = (turns(inner, e, other, f) < 0) & (turns(other, f, inner, e) < 0)
        return (out,)

    n = len(inner.starts) - 1
    held, on = inner.places(other.owner, other.x, other.y)
    return ~_any(inner.owner, _hits(inner.owner, other.starts, crossed)[0] > 0, n) & ~_any(other.owner, held & ~on, n)


def rings_within(inner: Rings, outer: Rings, holes: Rings, hole_of: np.ndarray) -> np.ndarray:
    """Whether each ring lies inside the outer one of its number and outside its holes, `hole_of` names whose; borders may touch.

    The same as `geometry.ring_within`, over many rings at once.
    """
    inner, outer, n = inner.thin(), outer.thin(), len(inner.starts) - 1
    owner, x, y = _marks(inner)
    held, on = outer.places(owner, x, y)
    out = ~_any(owner, ~(held | on), n) & _apart(inner, outer)
    asked = np.flatnonzero(out[hole_of])
    if len(asked):
        holes, hole_of = holes.take(asked), hole_of[asked]
        around = inner.take(hole_of)
        # a hole that is the inner ring itself has no corner strictly inside it, but its middle
        corners = np.diff(holes.starts)
        some = np.flatnonzero(corners > 0)
        middle = [np.bincount(holes.owner, v, len(corners))[some] / corners[some] for v in (holes.x, holes.y)]
        held, on = around.places(some, *middle)
        bad = np.zeros(len(hole_of), bool)
        bad[some] = held & ~on
        holes = holes.thin()
        owner, x, y = _marks(around)
        held, on = holes.places(owner, x, y)
        bad |= _any(owner, held & ~on, len(hole_of)) | ~_apart(around, holes)
        out &= ~_any(hole_of, bad, n)
    return out


def cell_codes(owner: np.ndarray, cells: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """(codes, strides): one number for each cell (owner, c0, c1…); that of a cell beside it is a stride away. Gaps between cells are cut short."""
    ranks = []
    for c in cells:
        seen, at = np.unique(c, return_inverse=True)
        ranks.append((1 + np.concatenate([[0], np.cumsum(np.minimum(np.diff(seen), 2))])[at]).astype(np.int64))
    code, sizes = owner.astype(np.int64), [int(r.max(initial=0)) + 2 for r in ranks]
    for r, size in zip(ranks, sizes):
        code = code * size + r
    return code, [int(np.prod(sizes[k + 1 :], dtype=np.int64)) for k in range(len(sizes))]


def within_reach(owner: np.ndarray, points: np.ndarray, radius: float, enough: int, asked: np.ndarray, counted: np.ndarray | None = None, pairs: int = 1 << 18) -> np.ndarray:
    """How many other points of its owner, of those `counted`, lie within the radius of each point `asked`; counting stops where there are `enough`."""
    code, strides = cell_codes(owner, [np.floor(points[:, d] / radius) for d in range(points.shape[1])])
    order = np.argsort(code, kind="stable")
    order = order if counted is None else order[counted[order]]
    lined = code[order]
    steps = np.array([0])
    for stride in strides[:-1]:
        steps = (steps[:, None] + np.array([0, -stride, stride])).ravel()
    found = np.zeros(len(asked), np.int64)
    for step in steps:
        open_ = np.flatnonzero(found < enough)
        middle = code[asked[open_]] + step
        # cells along the last axis follow each other
        first, last = np.searchsorted(lined, middle - 1), np.searchsorted(lined, middle + 1, side="right")
        count = last - first
        upto, begin = np.cumsum(count), 0
        while begin < len(open_):
            end = max(begin + 1, int(np.searchsorted(upto, pairs + (upto[begin - 1] if begin else 0), side="right")))
            n = count[begin:end]
            who = np.repeat(np.arange(begin, end), n)
            mine, other = asked[open_[who]], order[ragged(n) + np.repeat(first[begin:end], n)]
            gaps = points[mine] - points[other]
            far = gaps[:, 0] * gaps[:, 0]
            for d in range(1, points.shape[1]):
                far = far + gaps[:, d] * gaps[:, d]
            found[open_[begin:end]] += np.bincount(who[(far <= radius * radius) & (mine != other)] - begin, minlength=end - begin)
            begin = end
    return found


def nearest(queries: np.ndarray, points: np.ndarray, k: int, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, distances): each query's k nearest points in order, ties to the earlier point; those of query i are at starts[i] to starts[i + 1].

    Points lie in a grid of about two a cell. A query looks at the cells around it, and at twice as many where the kth point may lie beyond.
    """
    n, dims = points.shape
    if not n or not len(queries):
        return np.zeros(len(queries) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    low, extent = points.min(axis=0), np.ptp(points, axis=0)
    wide, side = np.flatnonzero(extent > 0), 1.0
    while len(wide):
        side = float(np.exp((np.log(extent[wide]).sum() - np.log(max(n / 2, 1))) / len(wide)))
        if (extent[wide] >= side).all() or len(wide) == 1:
            break
        wide = wide[extent[wide] >= side]
    shape = np.ones(dims, np.int64)
    shape[wide] = np.minimum(np.floor(extent[wide] / side), n).astype(np.int64) + 1
    at = lambda p: np.clip(np.floor((p - low) / side), 0, shape - 1).astype(np.int64)
    code = np.ravel_multi_index(tuple(at(points).T), shape)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(shape.prod() + 1))
    slack = 1e-9 * (np.abs(low).max() + extent.max())
    home = at(queries)
    got = []
    todo = [(part, 1) for part in np.array_split(np.arange(len(queries)), -(-len(queries) // 2048))]
    while todo:
        asked, reach = todo.pop()
        lo, hi = np.maximum(home[asked] - reach, 0), np.minimum(home[asked] + reach, shape - 1)
        # the last axis is one run of cells; each place along the others is a run of its own
        who, base = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        for d in range(dims - 1):
            count = (hi - lo)[who, d] + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            who, base = np.repeat(who, count), np.repeat(base, count)
            base = (base + lo[who, d] + step) * shape[d + 1]
        begin, end = first[base + lo[who, -1]], first[base + hi[who, -1] + 1]
        count = end - begin
        if count.sum() > pairs and len(asked) > 1:
            todo += [(half, reach) for half in np.array_split(asked, 2)]
            continue
        place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin, count)]
        who = np.repeat(who, count)
        gap = queries[asked[who]] - points[place]
        far = np.sqrt(sum((gap[:, d] * gap[:, d] for d in range(1, dims)), gap[:, 0] * gap[:, 0]))
        by = np.lexsort((place, far, who))
        who, place, far = who[by], place[by], far[by]
        met = np.bincount(who, minlength=len(asked))
        start = np.cumsum(met) - met
        kept = np.arange(len(who)) - start[who] < k
        last = np.full(len(asked), np.inf)
        last[met >= k] = far[(start + k - 1)[met >= k]]
        place_of = queries[asked]
        below = np.where(lo > 0, place_of - (low + lo * side), np.inf)
        above = np.where(hi < shape - 1, low + (hi + 1) * side - place_of, np.inf)
        wall = np.minimum(below, above).min(axis=1)
        done = np.isinf(wall) | (last < wall - slack)
        kept &= done[who]
        got.append((asked[who[kept]], place[kept], far[kept]))
        if not done.all():
            todo.append((asked[~done], 2 * reach))
    who, place, far = (np.concatenate(part) for part in zip(*got))
    by = np.argsort(who, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(queries)))]), place[by], far[by]
