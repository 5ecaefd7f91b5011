"""Screens and distributions in the kernel: each pattern leaves a task once, odd letters and unknown responses."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlab.functions import kmers as K

ROWS = [("ACGTACGTTGCA", 1.0, None), ("acgtnacgtt", 2.0, 3.0), ("AC", None, 1.0), ("", 4.0, 1.0), ("AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", None, 0.5), ("AC*GTÄCGT", 5.0, 2.0), ("XACGTX", 0.5, None)]


def brute(k, gaps):
    sums: dict = {}
    for seq, *y in ROWS:
        s = seq.upper()
        forms = [(g, k1) for g in range(gaps + 1) for k1 in (range(2, k - 1) if g else (k,))]
        for p, n in Counter(s[i : i + k1] + "*" * g + s[i + k1 + g : i + k + g] for g, k1 in forms for i in range(max(0, len(s) - k - gaps + 1))).items():
            n = min(n, 19)
            if "N" not in p:
                sums[p] = sums.get(p, np.zeros(6)) + np.array([n, n * n, *(v for r in y for v in (n * (r or 0), n * (r is not None)))])
    return sums


@pytest.mark.parametrize("k, gaps, held", [(3, 0, 1 << 20), (4, 2, 1 << 20), (4, 1, 10)])
def test_sums_of_patterns_equal_brute_force(monkeypatch, k, gaps, held):
    monkeypatch.setattr(K, "HELD", held)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0].upper() for r in ROWS]), pa.array([list(r[1:]) for r in ROWS], pa.list_(pa.float64()))], names=["seq", "y"])
    got: dict = {}
    for out in K._pattern_sums(k, 0, gaps, 0, None, 2)(iter([batch, batch])):
        for p, v in zip(out.column("kmer").to_pylist(), out.column("sums").to_pylist()):
            got[p] = got.get(p, np.zeros(6)) + np.array(v)
    want = brute(k, gaps)
    assert set(got) == set(want)
    for p, v in want.items():
        assert got[p] == pytest.approx(2 * v)


def test_a_pattern_leaves_a_task_once(spark):
    df = spark.createDataFrame([(i, "ACGTTGCATTACG", float(i % 7)) for i in range(500)], "seq_id bigint, seq string, y double").coalesce(1)
    plan = K.screen_kmers(df, ["y"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # patterns aren't exploded into rows


def test_distribution_counts_by_position(spark):
    df = spark.createDataFrame([(0, "acgtn"), (1, "ACGTA"), (2, "NCXTA")], "seq_id bigint, seq string")
    out = K.nucleotide_distribution(df, 2)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.pos: r for r in out.collect()}
    assert rows[1].AC == pytest.approx(2 / 3) and rows[2].CG == pytest.approx(2 / 3) and rows[4].TA == pytest.approx(2 / 3) and rows[5].AA is None


def test_matrix_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, "AAAAC"), (2, "acgÄAA"), (2, "AA"), (3, None), (4, ""), (None, "AAAA"), (5, "A")], "seq_id bigint, seq string")
    out = K.kmer_matrix(df, 2, ["AA", "CG", "AAA"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    assert got == sorted([(1, 3, 0, 0), (2, 2, 1, 0), (2, 2, 1, 0), (3, 0, 0, 0), (4, 0, 0, 0), (None, 0, 0, 0), (5, 0, 0, 0)], key=key)
