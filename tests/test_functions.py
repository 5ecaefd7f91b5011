import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.functions import kmers as K
from strandlab.functions import pssm as P
from strandlab.functions import sequence as S
from strandlab.sources import motifs as M


def column(df, name="x"):
    return [r[name] for r in df.collect()]


def seqs(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "seq_id bigint, seq string")


def test_reverse_complement(spark):
    items = ["ATCG", "atcg", "TATA", "AT-CG", "123", "", None]
    assert column(seqs(spark, items).select(S.rc(F.col("seq")).alias("x"))) == ["CGAT", "CGAT", "TATA", "CG-AT", "321", "", None]


def test_trim_and_wildcards(spark):
    df = seqs(spark, ["AC2GT", "ACGT", "A10T"])
    assert column(df.select(S.gap_to_wildcards(F.col("seq")).alias("x"))) == ["AC**GT", "ACGT", "A**********T"]
    assert column(df.select(S.trimmed(F.col("seq"), 2, 3).alias("x"))) == ["C2", "CG", "10"]


def test_one_hot():
    x = S.one_hot("ANt")
    assert x[0].tolist() == [1, 0, 0, 0] and np.isnan(x[1]).all() and x[2].tolist() == [0, 0, 0, 1]


def test_missing_sequence_is_an_error(spark):
    with pytest.raises(Exception, match="missing values"):
        S.require_sequences(seqs(spark, ["A", None])).collect()


def test_generate_kmers(spark):
    assert len(K.generate_kmers(2)) == 16
    gapped = K.generate_kmers(3, max_gap=2, min_gap=1)
    assert all(1 <= k.count("N") <= 2 for k in gapped) and len(gapped) == len(set(gapped))
    assert len(K.generate_kmers(3, 1, 1, compat=True)) > len(K.generate_kmers(3, 1, 1))
    assert set(column(K.kmers_frame(spark, 3, 2, 1), "kmer")) == set(gapped)
    for bad in ((0,), (2, 3), (2, 0, -1), (2, -1), (3, 1, 2)):
        with pytest.raises(ValueError):
            K.generate_kmers(*bad)


@pytest.mark.parametrize("k", [1, 4, 30])
def test_kmer_counts_of_any_letters(spark, k):
    rng = random.Random(k)
    rows = [(i, "".join(rng.choices("acgtNé😀xyz" if i % 2 else "ACGT", k=n))) for i, n in enumerate((0, 1, 3, 60, 500))] + [(9, None)]
    df = spark.createDataFrame(rows, "seq_id int, seq string")
    want = collections.Counter()
    for i, seq in rows:
        s = (seq or "").upper()
        for at in range(len(s) - k + 1):
            w = s[at : at + k]
            for kmer in [w] + [w[:g] + "N" + w[g + 1 :] for g in range(k)]:
                want[i, kmer] += 1
    assert {(r.seq_id, r.kmer): r.n for r in K.kmer_counts(df, k, max_gap=1).collect()} == want


def test_kmer_counts(spark):
    df = seqs(spark, ["ATCG", "ATCG"])
    count = lambda **o: {(r.seq_id, r.kmer): r.n for r in K.kmer_counts(df, o.pop("k"), **o).collect()}
    assert count(k=2) == {(i, w): 1 for i in (0, 1) for w in ("AT", "TC", "CG")}
    assert {w for _, w in count(k=4, max_gap=1)} == {"ATCG", "NTCG", "ANCG", "ATNG", "ATCN"}
    assert {w for _, w in count(k=4, max_gap=2)} >= {"NNCG", "ANNG", "ATNN"}
    assert {w for _, w in count(k=2, to_range=3)} == {"AT", "TC"}
    assert {w for _, w in count(k=2, to_range=2)} == {"AT"}
    assert {w for _, w in count(k=2, to_range=2, compat=True)} == {"AT", "TC"}
    assert {w for _, w in count(k=3, mask="ANA")} == {"ANC", "TNG"}
    assert {w for _, w in count(k=3, mask="ANA", add_mask=True)} == {"ANC", "TNG", "ATC", "TCG"}
    assert count(k=9) == {}


def test_dinucleotides(spark):
    rows = {r.seq_id: r.asDict() for r in K.dinucleotides(seqs(spark, ["ATCG", "gcta", "AATT", "ATCG" * 1000])).collect()}
    assert {k for k, v in rows[0].items() if v and k != "seq_id"} == {"AT", "TC", "CG"}
    assert {k for k, v in rows[1].items() if v == 1 and k != "seq_id"} == {"GC", "CT", "TA"}
    assert sum(v for k, v in rows[3].items() if k != "seq_id") == 3999
    with pytest.raises(Exception, match="empty sequence"):
        K.dinucleotides(seqs(spark, [""])).collect()


def test_distribution(spark):
    d = {r.pos: r for r in K.nucleotide_distribution(seqs(spark, ["AA", "CC", "GG", "TT", "AC"]), 2, 2).collect()}
    assert all(d[1][w] == pytest.approx(0.2) for w in ("AA", "CC", "GG", "TT", "AC")) and d[2]["AA"] is None
    d = {r.pos: r for r in K.nucleotide_distribution(seqs(spark, ["AAACCC", "GGGAAA", "TTTGGG", "CCCAAA", "AAAGGG"]), 3).collect()}
    assert d[1]["AAA"] == pytest.approx(0.4) and d[2]["AAC"] == pytest.approx(0.2) and d[5]["AAA"] is None
    with pytest.raises(ValueError):
        K.nucleotide_distribution(seqs(spark, ["AAA", "A"]), 2, 3)


def planted(spark, word="GATAAGA", n=600, seed=1):
    rng = np.random.default_rng(seed)
    flank = lambda: "".join(rng.choice(list("ACGT"), 50))
    rows = [(i, flank() + (word if i % 2 else "".join(rng.choice(list("ACGT"), len(word)))) + flank(), float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id bigint, seq string, y double")


def test_screen_finds_the_planted_word(spark):
    out = K.screen_kmers(planted(spark), ["y"], kmer_length=7, min_cor=0.5).collect()
    assert [r.kmer for r in out] == ["GATAAGA"] and out[0].y > 0.5


def test_screen_gapped_and_errors(spark):
    df = planted(spark, "GATTTTAAG")
    top = K.screen_kmers(df, ["y"], kmer_length=6, min_cor=0.3, max_gap=3).first()
    assert top.max_r2 > 0.25
    with pytest.raises(ValueError):
        K.screen_kmers(df, ["y"], min_gap=2, max_gap=1)


def test_candidates(spark):
    cands = K.candidate_kmers(planted(spark), ["y"], [6, 7], 0, 0)
    assert cands[0] == "GATAAGA"
    assert K.osa_distance("ACGT", "AGCT") == 1 and K.osa_distance("ACGT", "CGT") == 1
    assert K.candidate_kmers(planted(spark).withColumn("y", F.lit(1.0)), ["y"], [5]) == ["*****"]


def test_kmers_to_pssm(spark):
    rows = P.kmers_to_pssm(spark.createDataFrame([("ACNT",)], "kmer string")).collect()
    assert len(rows) == 4 and len(rows[0]) == 6
    assert all(sum(r[c] for c in "ACGT") == pytest.approx(1) for r in rows) and rows[2].A == 0.25
    with pytest.raises(Exception, match="may hold"):
        P.kmers_to_pssm(spark.createDataFrame([("AXT",)], "kmer string")).collect()


def test_pssm_laws(spark):
    lib = M.library(spark)
    twice = P.reverse_complement(P.reverse_complement(lib))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, lib.collect()))
    r = P.theoretical_range(lib).collect()
    assert all(x.min_score < x.max_score for x in r)
    assert {x.motif: x.score for x in P.quantile(lib, 1.0).collect()} == pytest.approx({x.motif: x.max_score for x in r})
    assert {x.motif: x.consensus for x in P.consensus(lib).collect()}["SPEC"] == "ACGT"
    uniform = spark.createDataFrame([("U", i, 0.25, 0.25, 0.25, 0.25) for i in range(3)], M.SCHEMA)
    assert P.trim(uniform).count() == 0 and P.consensus(uniform).first().consensus is None
    assert P.concat(lib, lib, gap=2, orientation="rf").where("motif = 'SPEC'").count() == 10
    with pytest.raises(ValueError):
        P.concat(lib, lib, orientation="xx")
    with pytest.raises(ValueError):
        P.validate(lib.drop("A"))
    assert {x.motif: x.kmer for x in P.pssm_to_kmer(lib).collect()}["SPEC"] == "ACGT"


def test_jaspar(spark, tmp_path):
    text = ">MA1 TF\nA [ 1 0 ]\nC [ 1 0 ]\nG [ 2 0 ]\nT [ 0 4 ]\n>MA2 TF\nA [ 1 ]\nC [ 1 ]\nG [ 1 ]\nT [ 1 ]\n>MA3 X\nA [ 3 ]\nC [ 1 ]\nG [ 0 ]\nT [ 0 ]\n"
    (tmp_path / "m.txt").write_text(text)
    rows = {(r.motif, r.pos): r for r in M.read_jaspar(spark, str(tmp_path / "m.txt")).collect()}
    assert set(rows) == {("TF.MA1", 0), ("TF.MA1", 1), ("TF.MA2", 0), ("X", 0)}
    assert rows["TF.MA1", 0].G == 0.5 and rows["TF.MA1", 1]["T"] == 1 and rows["X", 0].A == 0.75


def test_library_round_trip(spark, tmp_path):
    lib = M.library(spark)
    lib.write.csv(str(tmp_path / "m"), header=True)
    back = M.read_motifs(spark, str(tmp_path / "m"), "csv", header=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lib.collect()))
