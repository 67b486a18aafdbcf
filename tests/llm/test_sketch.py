"""The merged sketch: what it lets through, and how much of it the driver holds."""

import pickle

import numpy as np
import pytest
from evidentia.llm import sketch


@pytest.mark.parametrize("share", [0.0001, 0.3, 1.0])
def test_segments_are_held_compressed_and_sent_whole(share):
    rng, size = np.random.default_rng(3), 1 << sketch.SEGMENT_BITS
    cells = {(row, s): np.flatnonzero(rng.random(size) < share).astype(np.uint32) for row in range(2) for s in (0, 3)}
    held = sketch.Repeated(sketch.SEGMENT_BITS + 2)
    for row in range(2):
        held.count(row)
    for (row, s), own in cells.items():
        held.add(row, s, sketch._pack(own))
    kept = sum(len(blob) for own in held.segments.values() for _, _, blob in own)
    assert held.maps is None and kept <= len(cells) * min(size // 8 + 1000, 6 * share * size + 1000)  # no bit map of all cells on the driver
    sent = pickle.loads(pickle.dumps(held))
    h = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    want = np.ones(len(h), bool)
    for row in range(2):
        c = sketch._cells(h.copy(), row, held.bits)
        want &= np.array([int(x) % size in whole for x, whole in ((x, sets[row, int(x) // size]) for sets in [{(r, s): set(cells.get((r, s), np.zeros(0)).tolist()) for r in range(2) for s in range(4)}] for x in c)])
    assert (sent(h) == want).all() and (held(h) == want).all() and want.any() == (share > 0.01)


def test_a_row_without_repeats_lets_nothing_through():
    held = sketch.Repeated(sketch.LEAST_BITS)
    held.count(0)
    assert not pickle.loads(pickle.dumps(held))(np.arange(9, dtype=np.uint64)).any()
