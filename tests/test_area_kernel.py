"""The sweep against closed forms, and its cost on long rings."""

import time

import numpy as np
import pyarrow as pa
import pytest

from standcarbon.operators import area_kernel
from standcarbon.operators.area_kernel import overlap_areas


def edges(*rings) -> list[float]:
    found = []
    for ring in rings:
        ring = np.asarray(ring, dtype=float)
        quads = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
        found.append(quads[quads[:, 0] != quads[:, 2]])
    return np.concatenate(found).ravel().tolist()


def rectangle(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def area(first: list, second: list, shift: float = 0.0) -> float:
    sides = [np.array(s).reshape(-1, 4) + shift for s in (first, second)]
    low = np.max([s.reshape(-1, 2).min(axis=0) for s in sides], axis=0)
    high = np.min([s.reshape(-1, 2).max(axis=0) for s in sides], axis=0)
    window = np.array([[*low, *high]])
    return overlap_areas(*(pa.array([s.ravel().tolist()]) for s in sides), window)[0]


ALL = edges(rectangle(-50, -50, 50, 50))
BOW = edges([(0, 0), (10, 10), (10, 0), (0, 10)])


@pytest.mark.parametrize("shift", [0.0, 6_500_000.0])
@pytest.mark.parametrize(
    ("shape", "with_", "expected"),
    [
        (BOW, ALL, 50),
        (BOW, edges(rectangle(0, 0, 5, 10)), 25),
        (BOW, BOW, 50),
        (edges(rectangle(0, 0, 10, 10), rectangle(5, 0, 15, 10)), ALL, 100),
        (edges(rectangle(0, 0, 10, 10), rectangle(5, 5, 15, 15)), ALL, 150),
        (edges(rectangle(0, 0, 10, 10), rectangle(10, 0, 20, 10)), ALL, 200),
        (edges(rectangle(0, 0, 10, 10), rectangle(8, 4, 12, 6)), ALL, 100 - 4 + 4),
        (edges(rectangle(0, 0, 10, 10), rectangle(8, 4, 12, 6)), edges(rectangle(0, 0, 10, 10)), 96),
        (edges(rectangle(0, 0, 10, 10), rectangle(2, 2, 4, 4)), ALL, 96),
        (edges([(0, 0), (10, 0), (0, 10)]), edges([(10, 10), (10, 0), (0, 10)]), 0),
        (edges([(0, 0), (10, 0), (0, 10)]), edges([(0, 0), (10, 0), (10, 10)]), 25),
        (edges(rectangle(0, 0, 10, 10)), edges([(5, -5), (15, 5), (5, 15), (-5, 5)]), 100),
        (edges(rectangle(0, 0, 10, 10)), edges([(5, -2), (12, 5), (5, 12), (-2, 5)]), 100 - 4 * 4.5),
    ],
)
def test_closed_forms(shape, with_, expected, shift):
    for chunk in (area_kernel.CHUNK, 5):
        before, area_kernel.CHUNK = area_kernel.CHUNK, chunk
        try:
            assert area(shape, with_, shift) == pytest.approx(expected, abs=1e-5 if shift else 1e-9)
            assert area(with_, shape, shift) == pytest.approx(expected, abs=1e-5 if shift else 1e-9)
        finally:
            area_kernel.CHUNK = before


def ring(n: int, radius: float, shift: float = 0.0) -> list[float]:
    angle = np.arange(n) * 2 * np.pi / n + 1e-3
    return edges(np.stack([np.cos(angle) * radius + shift, np.sin(angle) * radius], axis=1))


def test_long_rings_in_under_a_second():
    n = 20_000
    a, b = ring(n, 1000.0), ring(n, 1000.0, 500.0)
    began = time.perf_counter()
    got = area(a, b)
    assert time.perf_counter() - began < 1.0
    lens = 2 * 1000**2 * np.arccos(0.25) - 250 * np.sqrt(4 * 1000**2 - 500**2)
    assert got == pytest.approx(lens, rel=1e-6)


def test_many_rows_and_empty_ones():
    left = [edges(rectangle(0, 0, 2, 2)), [], None, ALL, edges(rectangle(5, 5, 6, 6))]
    right = [edges(rectangle(1, 1, 3, 3)), ALL, ALL, BOW, edges(rectangle(0, 0, 1, 1))]
    window = np.array([[1, 1, 2, 2], [0, 0, 1, 1], [0, 0, 1, 1], [0, 0, 10, 10], [5, 5, 1, 1]], dtype=float)
    kind = pa.list_(pa.float64())
    found = overlap_areas(pa.array(left, kind), pa.array(right, kind), window)
    assert found == pytest.approx([1, 0, 0, 50, 0])
