"""The hash of a very long word, wherever it starts."""

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm.words import UNSPACED, Words


@pytest.mark.parametrize("size", [(1 << 19) - 1, 1 << 19, (1 << 19) + 1, 3 << 18, 1 << 20, (1 << 20) + 5])
def test_place_does_not_change_the_hash(size):
    word, seen = "aB" * (size // 2) + "c" * (size % 2), set()
    for before in (0, 1, 5000, 60_000, 130_000, 250_000):
        words = Words(pa.array(["x y z " * (before // 3) + word + " and " + word + " end"]), UNSPACED, lower=True)
        long = np.flatnonzero(words.end - words.start == size)
        assert len(long) == 2 and len(words.hash) == 3 * (before // 3) + 4
        seen |= set(words.hash[long].tolist())
        assert len(set(words.hash[-1:].tolist()) & seen) == 0
    assert len(seen) == 1
