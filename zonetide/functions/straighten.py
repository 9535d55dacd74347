"""Which vertices a simplified boundary keeps (numpy, runs inside tasks)."""

from __future__ import annotations

import numpy as np


def _distances(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distance of each point from the segment start-end."""
    chord = end - start
    length = float(chord @ chord)
    if length == 0:
        return np.hypot(*(points - start).T)
    along = np.clip((points - start) @ chord / length, 0, 1)
    return np.hypot(*(points - start - along[:, None] * chord).T)


def _any_inside(points: np.ndarray, loop: np.ndarray) -> bool:
    """Whether some point lies inside the closed loop (even-odd rule)."""
    a, b = loop, np.roll(loop, -1, axis=0)
    rises = (b[:, 1] - a[:, 1])
    for x, y in points:
        spans = (a[:, 1] <= y) != (b[:, 1] <= y)
        at = a[spans, 0] + (y - a[spans, 1]) / rises[spans] * (b[spans, 0] - a[spans, 0])
        if np.count_nonzero(at > x) % 2:
            return True
    return False


def keep_vertices(rings: list[np.ndarray], tolerance: float) -> list[list[int]]:
    """Positions of the kept vertices of each closed ring of one zone.

    Douglas-Peucker from the ring's first vertex. A stretch is straightened when all its
    vertices lie within the tolerance of the chord and no other vertex of the zone lies
    between stretch and chord, so parts and holes never cross. Rings keep 4 points.
    """
    everything = np.concatenate(rings)
    owner = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    position = np.concatenate([np.arange(len(r)) for r in rings])
    by_x = np.argsort(everything[:, 0], kind="stable")
    sorted_x = everything[by_x, 0]

    def is_free(ring: int, i: int, j: int) -> bool:
        stretch = rings[ring][i:j + 1]
        low, high = stretch.min(axis=0), stretch.max(axis=0)
        near = by_x[np.searchsorted(sorted_x, low[0]):
                    np.searchsorted(sorted_x, high[0], side="right")]
        y = everything[near, 1]
        near = near[(y >= low[1]) & (y <= high[1])]
        own = (owner[near] == ring) & (position[near] >= i) & (position[near] <= j)
        own |= np.isin(everything[near], stretch[[0, -1]]).all(axis=1)
        return not _any_inside(everything[near[~own]], stretch)

    result = []
    for number, ring in enumerate(rings):
        last = len(ring) - 1
        if last < 3:
            result.append(list(range(len(ring))))
            continue
        keep = {0, last}
        # The first split turns the closed ring into two open stretches.
        far = 1 + int(np.argmax(_distances(ring[1:last], ring[0], ring[0])))
        keep.add(far)
        pending = [(0, far), (far, last)]
        spare = (-1.0, 0)
        while pending:
            i, j = pending.pop()
            if j - i < 2:
                continue
            away = _distances(ring[i + 1:j], ring[i], ring[j])
            middle = i + 1 + int(np.argmax(away))
            if away.max() <= tolerance and is_free(number, i, j):
                spare = max(spare, (float(away.max()), middle))
                continue
            keep.add(middle)
            pending += [(i, middle), (middle, j)]
        if len(keep) < 4:
            keep.add(spare[1])
        result.append(sorted(keep))
    return result
