"""What the driver holds while fingerprints are planned for."""

import tracemalloc

import numpy as np

from inkspark.llm import simhash


def test_plan_holds_no_table_of_all_pairs():
    sample = np.random.default_rng(3).integers(0, 1 << 63, simhash.PLAN_SAMPLE).astype(np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    tracemalloc.start()
    parts = simhash.plan(bits.T @ bits, sample, len(sample), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(t for _, t in parts) >= 0 and peak < 20e6
