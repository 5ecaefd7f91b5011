"""The native energy by tables of words against the vectorised kernel and the form letter by letter."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.operators import scoring as E


@pytest.mark.parametrize("length", [1, 4, 6, 7, 13, 120])
@pytest.mark.parametrize("bidirect", [True, False])
def test_native_energy_equals_the_kernel(spark, length, bidirect):
    rng = np.random.default_rng(length)
    texts = ["".join(rng.choice(list("ACGTNacgtx"), n)) for n in (0, 1, 4, 5, 6, 7, 8, 12, 13, 14, 40, 300)] + [None, "A\U0001f600GT0C" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string").coalesce(1)
    motif = E.Motif.of("m", rng.dirichlet([0.4] * 4, length), 1e-12 if length == 120 else 0.01)  # the long one may underflow
    got = {r.seq_id: r.p for r in df.select("seq_id", E.native_energy(F.col("seq"), motif, bidirect).alias("p")).collect()}
    want = {r.seq_id: r.pwm for r in E.compute_pwm(df, motif, bidirect=bidirect).collect()}
    for i, w in want.items():
        assert got[i] == (None if w is None else pytest.approx(w, abs=1e-8)), texts[i]


def test_native_energy_by_words_is_faster(spark):
    motif = E.Motif.of("m", np.random.default_rng(3).dirichlet([0.4] * 4, 6))
    codes = F.transform(F.split("seq", ""), lambda c: F.array_position(F.array(*map(F.lit, "ACGT")), c).cast("int") - 1)

    def seconds(energy, rows):
        seqs = spark.range(rows).select(F.translate(F.repeat(F.md5(F.col("id").cast("string")), 40), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq")).coalesce(1)
        times = []
        for _ in range(2):
            began = time.perf_counter()
            seqs.select(F.sum(energy)).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    words, letters = (seconds(e, 3000) - seconds(e, 1) for e in (E.native_energy(F.col("seq"), motif), E._energy_by_logs(codes, [motif.forward, motif.reverse])))
    assert words < 0.7 * letters, (words, letters)  # less than half on an idle machine
