"""Local energies of a large batch take the memory of a slice."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandlab.operators import scoring as E


def test_a_batch_of_long_texts_is_decoded_in_slices():
    motif = E.Motif.of("m", np.random.default_rng(1).dirichlet([0.4] * 4, 4))
    seqs = pa.array(["ACGTTGCA" * 12_500, None, "", "ACG"] * 300)  # 30 million bases
    tracemalloc.start()
    rows = bases = 0
    for first, ends, values in E.local_energies(seqs, motif, E.Spatial(), True):
        assert first == rows
        rows, bases = rows + len(ends), bases + len(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(seqs) and bases == 300 * 100_003
    assert peak < 20e6, peak  # the texts alone are 30 MB
