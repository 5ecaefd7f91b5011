"""The whole-text forms of the document queries against brute force, on texts far longer than their SQL reads."""

import random
from collections import Counter

import numpy as np
import pytest

from strandlab.plans import registry
from strandlab.sources import motifs as M

BASES = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(n)) for n in (300, 40, 13, 90, 60, 75)]
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "de" if i % 2 else "en", "web") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    dna = {i: "".join(c for c in t if c.isalpha()).translate(BASES) for i, t in enumerate(texts)}
    return dna, lambda name: registry.queries()[name](spark, d).collect()


def local(seq: str, name: str) -> np.ndarray:
    p = np.array([r[2:] for r in M.rows([name])], float)
    p = np.log((p / p.sum(1, keepdims=True) + 0.01) / 1.04)
    codes = ["ACGT".index(c) for c in seq]
    scores = lambda m: [sum(m[k][c] for k, c in enumerate(codes[i : i + len(m)])) for i in range(len(seq) - len(m) + 1)]
    return np.logaddexp(scores(p), scores(p[::-1, ::-1]))


def test_kmers(found):
    dna, run = found
    want = Counter()
    for i, seq in dna.items():
        for k in range(len(seq) - 3):
            w = seq[k : k + 4]
            for kmer in [w] + [w[:g] + "N" + w[g + 1 :] for g in range(4)]:
                want[i, kmer] += 1
    assert {(r.seq_id, r.kmer): r.n for r in run("kmer_counts")} == want


def test_energies(found):
    dna, run = found
    total = {i: np.logaddexp.reduce(local(s, "GATA")) for i, s in dna.items()}
    assert {r.seq_id: r.pwm for r in run("compute_pwm_native")} == pytest.approx(total, abs=1e-5)
    assert {r.seq_id: r.pwm for r in run("extract_pwm") if r.motif == "GATA"} == pytest.approx(total, abs=1e-5)
    assert {r.seq_id: r.best for r in run("best_position")} == {i: int(np.round(local(s, "GATA"), 9).argmax()) + 1 for i, s in dna.items()}
    cumulated = [(sum(total[i] <= v for i in total if i % 2) - sum(total[i] <= v for i in total if not i % 2)) / 3 for v in total.values()]
    assert run("ks_distance")[0].D == pytest.approx(max(cumulated), abs=1e-6)
    assert {r.motif: r.score for r in run("screen_pwm_ks")}["GATA"] == pytest.approx(max(map(abs, cumulated)), abs=1e-6)


def test_positions(found):
    dna, run = found
    got = {(r.seq_id, r.pos): r.pwm for r in run("compute_local_pwm")}
    want = {(i, k + 1): v for i, s in dna.items() for k, v in enumerate(local(s, "SPEC"))}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want, abs=1e-5) and len(got) == sum(map(len, dna.values()))
    hits = {k for k, v in want.items() if v > -6.5}
    assert {(r.seq_id, r.pos) for r in run("screen_local_pwm")} == hits and max(k for _, k in hits) > 60
    assert {r.seq_id: len(r.masked) for r in run("mask_sequences")} == {i: len(s) for i, s in dna.items()}


def test_groups(found):
    _, run = found
    assert all(run(name) for name in ("motif_enrichment_relative", "motif_enrichment_absolute"))
    assert {r.cluster for r in run("screen_pwm_clusters")} <= {"de", "en"}
