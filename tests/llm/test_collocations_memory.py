import tracemalloc

import numpy as np

from glimmer.llm.collocations import added_up


def test_added_up_makes_no_sorted_copy():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (5, 200_000)).astype(np.uint64)
    n = rng.integers(1, 9, 200_000)
    tracemalloc.start()
    got, counts, first = added_up(keys, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < keys.nbytes
    want: dict = {}
    for key, x in zip(keys.T.tolist(), n.tolist(), strict=True):
        want[tuple(key)] = want.get(tuple(key), 0) + x
    assert dict(zip(map(tuple, got.T.tolist()), counts.tolist(), strict=True)) == want
    assert (keys[:, first] == got).all()
