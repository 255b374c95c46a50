"""The recall audit of near vectors: a search that forgets links must be noticed."""

import numpy as np
import pytest

from countloom.llm import near_vectors


class Forgetful(near_vectors.Graph):
    """Loses all links of queries outside the hot group until the beam is wide."""

    hot = None

    def search(self, q, beam, *more):
        ids, sims = super().search(q, beam, *more)
        if self.hot is not None and beam < 2 * near_vectors.BEAM:
            ids[q @ self.hot < 0.9] = -1
        return ids, sims


def shards(hot: int, places: list[int], n: int = 2400):
    """Unit vectors of two shards: a group of copies in both, near pairs at some places, and vectors that are near to none."""
    rng = np.random.default_rng(5)
    left, right = rng.standard_normal((n, 48)), rng.standard_normal((n, 48))
    group = rng.permutation(np.setdiff1d(np.arange(n), places))[:hot]
    centre = rng.standard_normal(48)
    left[group], right[group] = (centre + 0.01 * rng.standard_normal((hot, 48)) for _ in range(2))
    right[places] = left[places] + 0.01 * rng.standard_normal((len(places), 48))
    return near_vectors._unit(left), near_vectors._unit(right), near_vectors._unit(centre[None])[0]


@pytest.mark.parametrize("hot, places", [(800, [5, 77, 301, 505, 808, 1200, 1333, 1717, 2001, 2222]), (0, [7, 500, 1112, 1999])])
@pytest.mark.parametrize("graph", [near_vectors.Graph, Forgetful])
def test_sparse_pairs_are_found_beside_a_hot_group_or_alone(graph, hot, places):
    left, right, centre = shards(hot, places)
    made = graph(right)
    made.hot = centre
    q, node = near_vectors.linked_pairs(left, made, 0.93)
    assert set(zip(*np.nonzero(left @ right.T >= 0.93))) <= set(zip(q.tolist(), node.tolist()))


def test_sparse_pairs_inside_one_shard():
    left, right, centre = shards(0, [7, 500])
    unit = np.concatenate([left, right[[7, 500]]])
    made = Forgetful(unit)
    made.hot = centre
    q, node = near_vectors.linked_pairs(unit, made, 0.93, True)
    assert {(7, 2400), (2400, 7), (500, 2401), (2401, 500)} <= set(zip(q.tolist(), node.tolist()))
