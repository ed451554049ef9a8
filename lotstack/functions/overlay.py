"""Union, intersection and difference of polygons with holes: a sweep over horizontal bands.

A polygon is a list of rings, inside by the even-odd rule. Edges are cut at all heights where one ends or two cross, so that
they stand side by side within a band; the parities of the polygons between two edges tell whether what lies there is kept.
The borders of what is kept are chained to rings, and holes go to the part around them.

Heights and places closer than `TOLERANCE` times the extent are one, so that nearly equal corners meet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np

TOLERANCE = 1e-10
Polygon = list[np.ndarray]
UNION: Callable[[bool, bool], bool] = lambda a, b: a or b
INTERSECTION: Callable[[bool, bool], bool] = lambda a, b: a and b
DIFFERENCE: Callable[[bool, bool], bool] = lambda a, b: a and not b


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def area(polygon: Polygon) -> float:
    """The area of a part as `overlay` gives it: its outline less its holes."""
    return abs(signed_area(polygon[0])) - sum(abs(signed_area(h)) for h in polygon[1:])


def inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    crossed = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((crossed & (x < at)).sum() % 2)


def _merged(values: np.ndarray, first: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, place): values closer than `gap` to the one before are one, by preference one marked in `first`; each value's place in kept."""
    order = np.lexsort((~first, values))
    ordered = values[order]
    group = np.concatenate([[0], np.cumsum(np.diff(ordered) > gap)])
    place = np.empty(len(values), dtype=int)
    place[order] = group
    kept = np.empty(group[-1] + 1)
    kept[group[::-1]] = ordered[::-1]
    marked = first[order]
    kept[group[marked][::-1]] = ordered[marked][::-1]
    return kept, place


def _crossings(e: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Heights at which edges (x1, y1, x2, y2), y1 < y2, cross within both."""
    e = e[np.argsort(e[:, 1])]
    found = []
    for at in range(0, len(e), chunk):
        a = e[at : at + chunk]
        b = e[at : int(np.searchsorted(e[:, 1], a[:, 3].max(), side="right"))]
        meets = (a[:, None, 3] > b[None, :, 1]) & (a[:, None, 1] < b[None, :, 3])
        meets &= (np.maximum(a[:, None, 0], a[:, None, 2]) >= np.minimum(b[None, :, 0], b[None, :, 2])) & (np.minimum(a[:, None, 0], a[:, None, 2]) <= np.maximum(b[None, :, 0], b[None, :, 2]))
        i, j = np.nonzero(meets)
        p, q = a[i], b[j]
        dx, dy, fx, fy = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1], q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = dx * fy - dy * fx
            t = ((q[:, 0] - p[:, 0]) * fy - (q[:, 1] - p[:, 1]) * fx) / cross
        y = p[:, 1] + t * dy
        good = np.isfinite(y) & (y > np.maximum(p[:, 1], q[:, 1])) & (y < np.minimum(p[:, 3], q[:, 3]))
        found.append(y[good])
    return np.concatenate(found) if found else np.zeros(0)


def _kept_between(edges: list[tuple], ours: int, keep: Callable[[bool, bool], bool]) -> list[tuple]:
    """(left, right) edges of the stretches that are kept; edges of a band in order, each with the polygon that it borders."""
    odd: set[int] = set()
    mine = 0
    out, left, was = [], None, False
    for edge in edges:
        owner = edge[0]
        if owner in odd:
            odd.remove(owner)
            mine -= owner < ours
        else:
            odd.add(owner)
            mine += owner < ours
        now = keep(mine > 0, len(odd) > mine)
        if now and not was:
            left = edge
        elif was and not now:
            if out and out[-1][1][1:3] == left[1:3]:  # nothing lies between
                out[-1] = (out[-1][0], edge)
            elif left[1:3] != edge[1:3]:
                out.append((left, edge))
        was = now
    return out


def _levelled(y: float, below: list[tuple[float, float]], above: list[tuple[float, float]]) -> Iterable[tuple]:
    """Borders along a height: where only one side of it is kept."""
    xs = sorted({x for pair in (*below, *above) for x in pair})
    i = j = 0
    for a, b in zip(xs, xs[1:]):
        while i < len(below) and below[i][1] <= a:
            i += 1
        while j < len(above) and above[j][1] <= a:
            j += 1
        under, over = i < len(below) and below[i][0] <= a, j < len(above) and above[j][0] <= a
        if under and not over:
            yield (b, y), (a, y)
        elif over and not under:
            yield (a, y), (b, y)


def _chained(segments: Iterable[tuple]) -> list[list[tuple[float, float]]]:
    """Rings of directed borders; where several begin, the one most to the left follows, so that parts that touch stay apart."""
    out = defaultdict(list)
    for a, b in segments:
        out[a].append(b)
    rings = []
    for start in list(out):
        while out[start]:
            ring, here, there = [start], start, out[start].pop()
            while there != start:
                ring.append(there)
                nexts = out[there]
                if not nexts:
                    break
                if len(nexts) > 1:
                    dx, dy = there[0] - here[0], there[1] - here[1]
                    turn = lambda n, dx=dx, dy=dy, p=there: np.arctan2(dx * (n[1] - p[1]) - dy * (n[0] - p[0]), dx * (n[0] - p[0]) + dy * (n[1] - p[1]))
                    nexts.append(nexts.pop(max(range(len(nexts)), key=lambda k: turn(nexts[k]))))
                here, there = there, nexts.pop()
            rings.append(ring)
    return rings


def _straightened(ring: list[tuple[float, float]], slack: float) -> np.ndarray:
    """Without corners that lie on the line of their neighbours."""
    points = np.array(ring)
    while len(points) > 2:
        before, after = np.roll(points, 1, axis=0), np.roll(points, -1, axis=0)
        cross = (points[:, 0] - before[:, 0]) * (after[:, 1] - before[:, 1]) - (points[:, 1] - before[:, 1]) * (after[:, 0] - before[:, 0])
        flat = np.abs(cross) <= slack * np.maximum(np.hypot(*(after - before).T), slack)
        drop = flat.copy()
        drop[1:] &= ~flat[:-1]  # never two neighbours at once
        if flat.all() or not drop.any():
            break
        if drop[0] and drop[-1]:
            drop[-1] = False
        points = points[~drop]
    return points


def overlay(ours: list[Polygon], others: list[Polygon], keep: Callable[[bool, bool], bool] = UNION) -> list[Polygon]:
    """The parts of what is kept, [outline, hole…] each, outlines anticlockwise; `keep` is told whether a place lies in one of ours, and of the others.

    Rings may be closed or not, and run either way; points that are not finite are left out, and rings without area add nothing.
    """
    lines, owners = [], []
    for owner, polygon in enumerate([*ours, *others]):
        for ring in polygon:
            ring = np.asarray(ring, dtype=float).reshape(-1, 2)
            ring = ring[np.isfinite(ring).all(axis=1)]
            if len(ring) >= 3:
                lines.append(np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1))
                owners.append(np.full(len(ring), owner))
    if not lines:
        return []
    e, owner = np.concatenate(lines), np.concatenate(owners)
    origin = e[:, :2].min(axis=0)
    extent = float((e[:, :2].max(axis=0) - origin).max())
    if not extent:
        return []
    gap = extent * TOLERANCE
    # corners that nearly meet are one, then heights
    xs, at = _merged(e[:, [0, 2]].reshape(-1), np.zeros(2 * len(e), dtype=bool), gap)
    e[:, [0, 2]] = xs[at].reshape(-1, 2)
    ys, at = _merged(e[:, [1, 3]].reshape(-1), np.zeros(2 * len(e), dtype=bool), gap)
    e[:, [1, 3]] = ys[at].reshape(-1, 2)
    up = e[:, 1] < e[:, 3]
    e = np.where(up[:, None], e, e[:, [2, 3, 0, 1]])
    steep = e[:, 1] < e[:, 3]
    e, owner = e[steep], owner[steep]
    if not len(e):
        return []
    met = _crossings(e)
    levels, _ = _merged(np.concatenate([ys, met]), np.arange(len(ys) + len(met)) < len(ys), gap)
    low, high = np.searchsorted(levels, e[:, 1]), np.searchsorted(levels, e[:, 3])

    # the place of each edge at each height that it reaches; places that nearly meet are one
    count = high - low + 1
    which = np.repeat(np.arange(len(e)), count)
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
    share = (levels[level] - e[which, 1]) / (e[which, 3] - e[which, 1])
    corner = (level == low[which]) | (level == high[which])
    x = np.where(level == low[which], e[which, 0], np.where(level == high[which], e[which, 2], e[which, 0] + share * (e[which, 2] - e[which, 0])))
    order = np.lexsort((x, level))
    for begin, end in zip(*(lambda b: (b[:-1], b[1:]))(np.searchsorted(level[order], np.arange(len(levels) + 1)))):
        if end > begin:
            some = order[begin:end]
            kept, place = _merged(x[some], corner[some], gap)
            x[some] = kept[place]
    first = np.cumsum(count) - count

    bands: list[list[tuple]] = [[] for _ in levels]
    for n in range(len(e)):
        for k in range(low[n], high[n]):
            at = first[n] + k - low[n]
            bands[k].append((owner[n], x[at], x[at + 1]))
    segments, below = [], []
    for k, y in enumerate(levels):
        edges = sorted(bands[k], key=lambda t: (t[1] + t[2], t[2]))
        found = _kept_between(edges, len(ours), keep) if edges else []
        segments += _levelled(y, below, [(a[1], b[1]) for a, b in found if a[1] < b[1]])
        if found:
            top = levels[k + 1]
            for a, b in found:
                segments += [((a[2], top), (a[1], y)), ((b[1], y), (b[2], top))]
        below = [(a[2], b[2]) for a, b in found if a[2] < b[2]]
    rings = [_straightened(r, gap) for r in _chained(segments)]
    rings = [r for r in rings if len(r) >= 3 and abs(signed_area(r)) > gap * extent]
    outlines = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    parts = [[r] for r in outlines]
    for hole in (r for r in rings if signed_area(r) < 0):
        x0, y0 = (hole[0] + hole[1]) / 2
        for part in parts:
            if inside(part[0], x0, y0):
                part.append(hole)
                break
    return parts


#: Problems with more edges than this are swept one by one; pairs of edges of the others are compared at once, so many at a time.
FEW, _PAIRS = 64, 1 << 21


def _merged_by(values: np.ndarray, first: np.ndarray, gap: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_merged` within each key: (kept, keys of the kept, each value's place in kept)."""
    order = np.lexsort((~first, values, key))
    v, k = values[order], key[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (np.diff(v) > gap[order][1:])
    group = np.cumsum(new) - 1
    place = np.empty(len(v), dtype=np.int64)
    place[order] = group
    kept = v[new]
    marked = first[order]
    kept[group[marked][::-1]] = v[marked][::-1]
    return kept, k[new], place


def _nth(key: np.ndarray) -> np.ndarray:
    """The place of each element among those of its key, in their order."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(key)]])))
    return out


def _swept(e: np.ndarray, owner: np.ndarray, ours: np.ndarray, problem: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterable[tuple[int, np.ndarray]]:
    """(problem, ring) of all borders of many small overlays at once: the steps of `overlay`, each over all of them.

    Edges (x1, y1, x2, y2) come with the polygon that they border, a number of its own throughout, whether it is ours, and their problem, in order.
    """
    size = int(problem[-1]) + 1
    low_, high_ = np.full((size, 2), np.inf), np.full((size, 2), -np.inf)
    for k in (0, 1):
        np.minimum.at(low_[:, k], problem, e[:, k])
        np.maximum.at(high_[:, k], problem, e[:, k])
    extent = np.where(np.isfinite(low_[:, 0]), (high_ - low_).max(axis=1), 0.0)
    real = extent[problem] > 0
    e, owner, ours, problem = e[real].copy(), owner[real], ours[real], problem[real]
    gaps = extent * TOLERANCE
    if not len(e):
        return
    twice = np.repeat(problem, 2)
    none = np.zeros(len(twice), dtype=bool)
    xs, _, at = _merged_by(e[:, [0, 2]].reshape(-1), none, gaps[twice], twice)
    e[:, [0, 2]] = xs[at].reshape(-1, 2)
    ys, ys_of, at = _merged_by(e[:, [1, 3]].reshape(-1), none, gaps[twice], twice)
    ends = at.reshape(-1, 2)
    e[:, [1, 3]] = ys[ends]
    up = e[:, 1] < e[:, 3]
    e, ends = np.where(up[:, None], e, e[:, [2, 3, 0, 1]]), np.where(up[:, None], ends, ends[:, ::-1])
    steep = e[:, 1] < e[:, 3]
    e, ends, owner, ours, problem = e[steep], ends[steep], owner[steep], ours[steep], problem[steep]
    if not len(e):
        return

    # heights at which two edges of a problem cross within both
    first = np.searchsorted(problem, problem)
    count = np.searchsorted(problem, problem, side="right") - first
    i = np.repeat(np.arange(len(e)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    meets = (e[i, 3] > e[j, 1]) & (e[i, 1] < e[j, 3]) & (right[i] >= left[j]) & (left[i] <= right[j]) & (i != j)
    i, j = i[meets], j[meets]
    p, q = e[i], e[j]
    dx, dy, fx, fy = p[:, 2] - p[:, 0], p[:, 3] - p[:, 1], q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = dx * fy - dy * fx
        t = ((q[:, 0] - p[:, 0]) * fy - (q[:, 1] - p[:, 1]) * fx) / cross
    y = p[:, 1] + t * dy
    good = np.isfinite(y) & (y > np.maximum(p[:, 1], q[:, 1])) & (y < np.minimum(p[:, 3], q[:, 3]))
    both = np.concatenate([ys_of, problem[i][good]])
    levels, level_of, at = _merged_by(np.concatenate([ys, y[good]]), np.arange(len(both)) < len(ys), gaps[both], both)
    low, high = at[ends[:, 0]], at[ends[:, 1]]

    # the place of each edge at each height that it reaches
    count = high - low + 1
    which = np.repeat(np.arange(len(e)), count)
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[which]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (levels[level] - e[which, 1]) / (e[which, 3] - e[which, 1])
    at_low, at_high = level == low[which], level == high[which]
    x = np.where(at_low, e[which, 0], np.where(at_high, e[which, 2], e[which, 0] + share * (e[which, 2] - e[which, 0])))
    kept, _, at = _merged_by(x, at_low | at_high, gaps[problem[which]], level)
    x = kept[at]

    # edges side by side in each band, and the stretches between them that are kept
    inner = np.flatnonzero(~at_high)
    band, xa, xb, whose = level[inner], x[inner], x[inner + 1], which[inner]
    order = np.lexsort((xb, xa + xb, band))
    band, xa, xb, whose = band[order], xa[order], xb[order], whose[order]
    name = owner[whose]
    turn = np.where(_nth(band * (int(owner.max()) + 1) + name) % 2 == 0, 1, -1)
    mine = np.cumsum(np.where(ours[whose], turn, 0))
    others = np.cumsum(np.where(ours[whose], 0, turn))
    # every band ends with nothing open, so sums over all bands are sums of each
    now = keep(mine > 0, others > 0)
    was = np.concatenate([[False], now[:-1]])
    a, b = np.flatnonzero(now & ~was), np.flatnonzero(was & ~now)
    solid = (xa[a] != xa[b]) | (xb[a] != xb[b])
    a, b = a[solid], b[solid]
    if not len(a):
        return
    new = np.ones(len(a), dtype=bool)
    new[1:] = (band[a[1:]] != band[a[:-1]]) | (xa[a[1:]] != xa[b[:-1]]) | (xb[a[1:]] != xb[b[:-1]])
    begin = np.flatnonzero(new)
    a, b = a[begin], b[np.concatenate([begin[1:], [len(b)]]) - 1]
    band = band[a]
    ax, ay, bx, by = xa[a], xb[a], xa[b], xb[b]

    # borders along a height: where only one side of it is kept
    under, over = ay < by, ax < bx
    at_level = np.concatenate([band[under] + 1, band[under] + 1, band[over], band[over]])
    at_x = np.concatenate([ay[under], by[under], ax[over], bx[over]])
    step = np.concatenate([np.ones(under.sum()), -np.ones(under.sum()), np.zeros(2 * over.sum())])
    rise = np.concatenate([np.zeros(2 * under.sum()), np.ones(over.sum()), -np.ones(over.sum())])
    order = np.lexsort((at_x, at_level))
    at_level, at_x, covered, opened = at_level[order], at_x[order], np.cumsum(step[order]) > 0, np.cumsum(rise[order]) > 0
    apart = (at_level[1:] == at_level[:-1]) & (at_x[1:] > at_x[:-1])
    down, rising = np.flatnonzero(apart & covered[:-1] & ~opened[:-1]), np.flatnonzero(apart & opened[:-1] & ~covered[:-1])
    flat_at = np.concatenate([down, rising])
    flat = np.argsort(flat_at, kind="stable")
    s_from = np.concatenate([at_x[down + 1], at_x[rising]])[flat]
    s_to = np.concatenate([at_x[down], at_x[rising + 1]])[flat]
    s_level = at_level[flat_at[flat]]
    # all borders, height by height: (level, x) to (level, x)
    n = len(band)
    sides = np.arange(2 * n) // 2
    is_b = np.arange(2 * n) % 2 == 1
    from_level = np.concatenate([s_level, np.where(is_b, band[sides], band[sides] + 1)])
    to_level = np.concatenate([s_level, np.where(is_b, band[sides] + 1, band[sides])])
    from_x = np.concatenate([s_from, np.where(is_b, bx[sides], ay[sides])])
    to_x = np.concatenate([s_to, np.where(is_b, by[sides], ax[sides])])
    order = np.lexsort((np.arange(len(from_x)), np.concatenate([s_level, band[sides]])))
    from_level, to_level, from_x, to_x = from_level[order], to_level[order], from_x[order], to_x[order]
    all_level, all_x = np.concatenate([from_level, to_level]), np.concatenate([from_x, to_x])
    order = np.lexsort((all_x, all_level))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(all_level[order]) != 0) | (np.diff(all_x[order]) != 0)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    spots = order[new]
    px, py, of = all_x[spots], levels[all_level[spots]], level_of[all_level[spots]]

    # rings of spots, as `_chained` walks them
    m = len(from_x)
    out: list[list[int]] = [[] for _ in range(len(px))]
    starts, targets = number[:m].tolist(), number[m:].tolist()
    for s, d in zip(starts, targets):
        out[s].append(d)
    walked: list[int] = []
    sizes: list[int] = []
    for start in dict.fromkeys(starts):
        while out[start]:
            begin, here, there = len(walked), start, out[start].pop()
            walked.append(start)
            while there != start:
                walked.append(there)
                nexts = out[there]
                if not nexts:
                    break
                if len(nexts) > 1:
                    dx, dy = px[there] - px[here], py[there] - py[here]
                    angle = [np.arctan2(dx * (py[k] - py[there]) - dy * (px[k] - px[there]), dx * (px[k] - px[there]) + dy * (py[k] - py[there])) for k in nexts]
                    nexts.append(nexts.pop(max(range(len(nexts)), key=angle.__getitem__)))
                here, there = there, nexts.pop()
            sizes.append(len(walked) - begin)
    spot = np.array(walked)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    points, gap = np.stack([px[spot], py[spot]], axis=1), gaps[of[spot]]

    # without corners that lie on the line of their neighbours, ring by ring as `_straightened`
    active = np.ones(len(ring), dtype=bool)
    while active.any():
        start = np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]]))
        end = np.concatenate([start[1:], [len(ring)]]) - 1
        before, after = np.arange(len(ring)) - 1, np.arange(len(ring)) + 1
        before[start], after[end] = end, start
        p, q = points[before], points[after]
        cross = (points[:, 0] - p[:, 0]) * (q[:, 1] - p[:, 1]) - (points[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
        flat = np.abs(cross) <= gap * np.maximum(np.hypot(q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]), gap)
        drop = flat.copy()
        drop[1:] &= ~flat[:-1] | (ring[1:] != ring[:-1])
        length = end - start + 1
        stop = np.logical_and.reduceat(flat, start) | ~np.logical_or.reduceat(drop, start) | (length <= 2)
        drop[end] &= ~(drop[start] & drop[end])
        drop &= ~np.repeat(stop, length)
        if not drop.any():
            break
        points, gap, ring, spot = points[~drop], gap[~drop], ring[~drop], spot[~drop]
    start = np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]])).tolist() + [len(ring)]
    belongs = of[spot]
    for s, t in zip(start, start[1:]):
        yield int(belongs[s]), points[s:t]


def overlays(points: np.ndarray, rings: np.ndarray, polygons: np.ndarray, ours: np.ndarray, problems: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[list[Polygon]]:
    """`overlay` of many problems, those with few edges at once.

    `rings` are the ends of rings in `points`, `polygons` those of polygons in rings, and `problems` those of problems in polygons, each with
    a zero ahead; `ours` tells of each polygon whether it is ours. `keep` works on arrays.
    """
    count = len(problems) - 1
    out: list[list[Polygon]] = [[] for _ in range(count)]
    length = np.diff(rings)
    point_ring = np.repeat(np.arange(len(length)), length)
    # a ring's end meets its beginning
    after = np.arange(1, len(points) + 1)
    after[rings[1:][length > 0] - 1] = rings[:-1][length > 0]
    ring_polygon = np.repeat(np.arange(len(polygons) - 1), np.diff(polygons))
    polygon_problem = np.repeat(np.arange(count), np.diff(problems))
    usable = (length >= 3)[point_ring] if len(points) else np.zeros(0, dtype=bool)
    finite = np.isfinite(points).all(axis=1)
    of = polygon_problem[ring_polygon[point_ring]]
    edges = np.bincount(of, minlength=count)
    alone = edges > FEW
    alone[of[~finite]] = True
    for k in np.flatnonzero(alone):
        sides: tuple[list[Polygon], list[Polygon]] = ([], [])
        for p in range(problems[k], problems[k + 1]):
            sides[0 if ours[p] else 1].append([points[rings[r] : rings[r + 1]] for r in range(polygons[p], polygons[p + 1])])
        out[k] = overlay(*sides, lambda a, b: bool(keep(np.bool_(a), np.bool_(b))))
    taken = np.flatnonzero(usable & ~alone[of])
    pairs = np.cumsum(np.where(alone, 0, edges.astype(np.int64) ** 2)) // _PAIRS
    found: list[list[np.ndarray]] = [[] for _ in range(count)]
    for part in np.split(taken, np.flatnonzero(np.diff(pairs[of[taken]])) + 1):
        if len(part):
            owner = ring_polygon[point_ring[part]]
            for k, ring in _swept(np.concatenate([points[part], points[after[part]]], axis=1), owner - owner[0], ours[owner], of[part] - of[part[0]], keep):
                found[k + of[part[0]]].append(ring)
    flat = [r for own in found for r in own]
    if not flat:
        return out
    size = np.array([len(r) for r in flat])
    start = np.cumsum(size) - size
    every = np.concatenate(flat)
    moved = every - np.repeat(every[start], size, axis=0)
    after = np.arange(1, len(every) + 1)
    after[start + size - 1] = start
    area = np.add.reduceat(moved[:, 0] * moved[after, 1] - moved[:, 1] * moved[after, 0], start) / 2
    extent = np.zeros(count)
    low, high = np.full((count, 2), np.inf), np.full((count, 2), -np.inf)
    for k in (0, 1):
        np.minimum.at(low[:, k], of[taken], points[taken, k])
        np.maximum.at(high[:, k], of[taken], points[taken, k])
    seen = np.isfinite(low[:, 0])
    extent[seen] = (high - low)[seen].max(axis=1)
    least = extent * TOLERANCE * extent
    at = 0
    for k, own in enumerate(found):
        if not own:
            continue
        signed = area[at : at + len(own)].tolist()
        at += len(own)
        good = [(a, r) for a, r in zip(signed, own) if len(r) >= 3 and abs(a) > least[k]]
        parts = [[r] for a, r in sorted((g for g in good if g[0] > 0), key=lambda g: g[0])]
        for hole in (r for a, r in good if a < 0):
            x0, y0 = (hole[0] + hole[1]) / 2
            for part in parts:
                if inside(part[0], x0, y0):
                    part.append(hole)
                    break
        out[k] = parts
    return out
