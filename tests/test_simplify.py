import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from arcmesh.operators.simplify import douglas_peucker, simplified, visvalingam

LINE = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], float)


def test_douglas_peucker():
    assert LINE[douglas_peucker(LINE, 1.0)].tolist() == [[0, 0], [2, -0.1], [3, 5], [7, 9], [9, 9]]
    assert douglas_peucker(LINE, 0.0).sum() == 8  # two inner points lie on their chord


def test_visvalingam():
    kept = LINE[visvalingam(LINE, 0.5)]
    assert kept[0].tolist() == [0, 0] and kept[-1].tolist() == [9, 9] and len(kept) < len(LINE)


def test_a_ring_keeps_four_points():
    ring = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    for rule in ("dp", "vw"):
        assert len(simplified(ring, 100.0, rule, True)) >= 4
        assert len(simplified(ring, 100.0, rule, False)) == 2


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=40), st.floats(0.1, 20))
def test_ends_stay_and_no_run_is_too_far(pts, eps):
    p = np.array(pts, float)
    keep = douglas_peucker(p, eps)
    assert keep[0] and keep[-1]
    at = np.flatnonzero(keep)
    for a, b in zip(at, at[1:], strict=False):
        d, n = p[b] - p[a], float((p[b] - p[a]) @ (p[b] - p[a]))
        for q in p[a + 1 : b] - p[a]:
            t = min(max(float(q @ d) / n, 0), 1) if n else 0
            assert np.hypot(*(q - t * d)) <= eps + 1e-9


def test_packages_stand_for_algorithms():
    from arcmesh.operators.simplify import chosen

    assert chosen("shapely", "vw", True) == ("dp", True) and chosen("shapely", "dp", False) == ("dp", False)
    assert chosen("simplification", "dp", True) == ("dp", False) and chosen("simplification", "vw", True) == ("vw", True)


def test_careful_visvalingam_keeps_a_line_from_crossing():
    p = np.array([(0, 0), (5, 1), (10, 0), (10, 5), (5, 0.5), (0, 5)], float)
    assert not visvalingam(p, 6.0)[1] and visvalingam(p, 6.0, careful=True)[1]
