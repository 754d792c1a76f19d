"""Overlap area of polygon pairs, in Arrow batches: a sweep along x.

The ends of the edges of a pair cut its common window into slabs; in a slab every edge that reaches
into it spans it. Only such edges meet: they are sorted by height, and what lies between two
neighbours belongs to a polygon if an odd number of its edges is below. Slabs in which edges cross
are cut again at the crossings, so heights are always those of trapezoids and areas are exact.

Counting by parity needs no orientation and is what a repair of the line work gives: both lobes of
a ring that crosses itself count, and what two parts, or a shell and a hole that sticks out of it,
both cover is taken out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Meetings of an edge and a slab handled at once: bounds a task's memory whatever the polygons.
CHUNK = 1 << 17
# Heights closer than this, in metres, are not told apart when crossings are looked for.
TOUCHING = 1e-9


def _edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, 4) of all rows and the row of each edge."""
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, 4)
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64) // 4
    return values, np.repeat(np.arange(len(sizes)), sizes)


def _in_window(left: pa.Array, right: pa.Array, window: np.ndarray):
    """Edges that reach into the window of their row along x, relative to its corner, each with
    the left end first: (edges, row, side, low, high); low and high are cut at the window."""
    parts = [_edges(left), _edges(right)]
    edges = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] for p in parts])
    side = np.repeat([0, 1], [len(p[1]) for p in parts])
    edges = edges - window[row][:, [0, 1, 0, 1]]
    edges = np.where((edges[:, 0] > edges[:, 2])[:, None], edges[:, [2, 3, 0, 1]], edges)
    width = (window[:, 2] - window[:, 0])[row]
    low, high = np.maximum(edges[:, 0], 0.0), np.minimum(edges[:, 2], width)
    keep = low < high
    return edges[keep], row[keep], side[keep], low[keep], high[keep]


def _between(slab: np.ndarray, side: np.ndarray, height: np.ndarray, width: np.ndarray):
    """For meetings sorted by (slab, height): area between each and the next of its slab, where
    that is inside both polygons."""
    first = np.ones(len(slab), dtype=bool)
    first[1:] = slab[1:] != slab[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(slab)), 0))
    inside = np.ones(len(slab), dtype=bool)
    for s in (0, 1):
        below = np.cumsum(side == s)
        inside &= (below - (below[start] - (side[start] == s))) % 2 == 1
    inside[:-1] &= ~first[1:]
    inside[-1:] = False
    step = np.zeros(len(slab))
    step[:-1] = height[1:] - height[:-1]
    return np.where(inside, step, 0.0) * width


def _crossed(left: np.ndarray, right: np.ndarray, side: np.ndarray, width: float) -> float:
    """Area of one slab in which edges cross; `left` and `right` are heights at its ends."""
    cuts = [np.array([0.0, 1.0])]
    for i in range(len(left) - 1):
        a, b = left[i] - left[i + 1 :], right[i] - right[i + 1 :]
        over = (a * b < 0) & (np.abs(a) > TOUCHING) & (np.abs(b) > TOUCHING)
        cuts.append(a[over] / (a[over] - b[over]))
    cuts = np.unique(np.concatenate(cuts))
    area, many = 0.0, max(1, CHUNK // len(left))
    for start in range(0, len(cuts) - 1, many):
        part = cuts[start : start + many + 1]
        middle = (part[1:] + part[:-1]) / 2
        height = (left + (right - left) * middle[:, None]).ravel()
        slab = np.repeat(np.arange(len(middle)), len(left))
        order = np.lexsort((height, slab))
        widths = np.diff(part)[slab] * width
        area += _between(slab, np.tile(side, len(middle))[order], height[order], widths).sum()
    return area


def _crossed_alike(left: np.ndarray, right: np.ndarray, side: np.ndarray, width: np.ndarray):
    """`_crossed` of many slabs with the same small number of edges: arrays (slabs, edges)."""
    n, k = left.shape
    i, j = np.triu_indices(k, 1)
    areas = np.empty(n)
    many = max(1, CHUNK // ((len(i) + 1) * k))
    for start in range(0, n, many):
        at = slice(start, start + many)
        a, b = left[at][:, i] - left[at][:, j], right[at][:, i] - right[at][:, j]
        over = (a * b < 0) & (np.abs(a) > TOUCHING) & (np.abs(b) > TOUCHING)
        cuts = np.sort(np.where(over, a / np.where(over, a - b, 1.0), 1.0), axis=1)
        ends = np.ones((len(cuts), 1))
        cuts = np.concatenate([0 * ends, cuts, ends], axis=1)
        middle = (cuts[:, 1:] + cuts[:, :-1]) / 2
        rise = right[at] - left[at]
        height = left[at][:, None, :] + rise[:, None, :] * middle[:, :, None]
        order = np.argsort(height, axis=2, kind="stable")
        height = np.take_along_axis(height, order, axis=2)
        sides = np.take_along_axis(np.broadcast_to(side[at][:, None, :], order.shape), order, axis=2)
        inside = np.logical_and(*[np.cumsum(sides == s, axis=2) % 2 == 1 for s in (0, 1)])[:, :, :-1]
        steps = np.where(inside, np.diff(height, axis=2), 0.0).sum(axis=2)
        areas[at] = (steps * np.diff(cuts, axis=1)).sum(axis=1) * width[at]
    return areas


# Slabs with more edges than this are cut one by one.
ALIKE = 24


def _cut_slabs(slab, y0, y1, sides, bad: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Areas of the slabs `bad`, of widths `width`, among meetings sorted by slab."""
    begins, stops = np.searchsorted(slab, bad), np.searchsorted(slab, bad, side="right")
    sizes = stops - begins
    areas = np.zeros(len(bad))
    for k in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == k)
        if k <= ALIKE:
            at = begins[which][:, None] + np.arange(k)
            areas[which] = _crossed_alike(y0[at], y1[at], sides[at], width[which])
        else:
            for w in which:
                at = slice(begins[w], stops[w])
                areas[w] = _crossed(y0[at], y1[at], sides[at], width[w])
    return areas


def overlap_areas(left: pa.Array, right: pa.Array, window: np.ndarray) -> np.ndarray:
    """Area per row; `left` and `right` are edge lists, `window` is (n, 4) minx miny maxx maxy."""
    total = np.zeros(len(window))
    edges, row, side, low, high = _in_window(left, right, window)
    if not len(edges):
        return total
    # Places where slabs begin or end, by (row, x).
    ends, ends_row = np.concatenate([low, high]), np.concatenate([row, row])
    order = np.lexsort((ends, ends_row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(ends[order]) > 0) | (np.diff(ends_row[order]) > 0)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    x, x_row = ends[order][new], ends_row[order][new]
    first, last = at[: len(low)], at[len(low) :]
    slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])

    # Slabs in runs of about CHUNK meetings; an edge takes part in the runs that it reaches into.
    active = np.zeros(len(x) + 1, dtype=np.int64)
    np.add.at(active, first, 1)
    np.add.at(active, last, -1)
    met = np.cumsum(np.cumsum(active[:-1]))
    start = 0
    while start < len(x):
        before = met[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(met, before + CHUNK, side="right")))
        who = np.flatnonzero((first < stop) & (last > start))
        begin, end = np.maximum(first[who], start), np.minimum(last[who], stop)
        counts = end - begin
        edge = np.repeat(who, counts)
        slab = np.arange(len(edge)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
        start = stop
        if not len(edge):
            continue
        x0, x1 = x[slab], x[slab + 1]
        y0 = edges[edge, 1] + slope[edge] * (x0 - edges[edge, 0])
        y1 = edges[edge, 1] + slope[edge] * (x1 - edges[edge, 0])
        order = np.lexsort((y0 + y1, slab))
        slab, y0, y1, sides = slab[order], y0[order], y1[order], side[edge][order]
        areas = _between(slab, sides, (y0 + y1) / 2, (x1 - x0)[order])
        same = slab[1:] == slab[:-1]
        crossing = same & ((y0[:-1] > y0[1:] + TOUCHING) | (y1[:-1] > y1[1:] + TOUCHING))
        bad = np.unique(slab[1:][crossing])
        if len(bad):
            areas[np.isin(slab, bad)] = 0.0
            np.add.at(total, x_row[bad], _cut_slabs(slab, y0, y1, sides, bad, x[bad + 1] - x[bad]))
        rows = x_row[slab]
        total[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0], weights=areas)
    return np.maximum(total, 0.0)


def overlap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: key columns first, then left_edges, right_edges and the window."""
    for batch in batches:
        window = np.stack([np.asarray(batch[name]) for name in ("x0", "y0", "x1", "y1")], axis=1)
        areas = overlap_areas(batch["left_edges"], batch["right_edges"], window)
        keys = [name for name in batch.schema.names if name.startswith("key_")]
        yield pa.RecordBatch.from_arrays(
            [*(batch[name] for name in keys), pa.array(areas)], names=[*keys, "overlap_m2"]
        )
