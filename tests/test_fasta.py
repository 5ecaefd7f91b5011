"""FASTA tiles against a plain reading of the same files."""

import random

import pytest
from pyspark.sql import functions as F

from strandlab.operators import intervals as I
from strandlab.sources import fasta


def plain(text: str) -> dict[str, str]:
    out, name = {}, None
    for line in text.split("\n"):
        if line.startswith(">"):
            name = (line[1:].split() or [""])[0]
            out[name] = ""
        elif name is not None:
            out[name] += "".join(line.split())
    return {k: v for k, v in out.items() if v}


def odd_file(rng: random.Random, names: list[str]) -> str:
    """Lines of all lengths, blank lines, carriage returns, long and short headers, a chromosome in one line."""
    text = rng.choice(["", "ACGT\n", "\n\n"])
    for k, n in enumerate(names):
        end = rng.choice(["\n", "\r\n"])
        text += f">{n}{rng.choice(['', ' some words', ' ' + 'x' * 90])}{end}"
        seq = "".join(rng.choices("ACGTacgtN", k=rng.choice([0, 1, 63, 64, 65, 700])))
        while seq:
            cut = len(seq) if k % 4 == 3 else rng.randint(1, 80)
            text += seq[:cut] + rng.choice([end, end, end + end])
            seq = seq[cut:]
    return text if rng.random() < 0.5 else text.rstrip()


@pytest.mark.parametrize("seed", range(3))
def test_tiles_of_any_ranges_equal_plain_reading(spark, tmp_path, seed):
    rng = random.Random(seed)
    whole = {}
    for f in range(3):
        text = odd_file(rng, [f"c{f}_{k}" for k in range(8)])
        (tmp_path / f"g{f}.fa").write_bytes(text.encode())
        whole |= plain(text)
    for step in (5, 97, 10**6):
        rows = fasta.read_fasta(spark, str(tmp_path), tile=64, range_bytes=step).collect()
        assert all(r.at % 64 == 0 for r in rows) and len({(r.chrom, r.at) for r in rows}) == len(rows)
        got: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: (r.chrom, r.at)):
            assert len(got.get(r.chrom, "")) == r.at
            got[r.chrom] = got.get(r.chrom, "") + r.seq
        assert got == whole


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "g.fa").write_text("".join(f">c{k}\n{'ACGT' * 40}\n" for k in range(5)))
    tiles = fasta.read_fasta(spark, str(tmp_path / "g.fa"), tile=50)
    assert sorted((r.chrom, r.at) for r in tiles.where(F.col("chrom").isin("c1", "c9") & (F.col("at") > 0)).collect()) == [("c1", 50), ("c1", 100), ("c1", 150)]
    reader = fasta.FastaReader({"index": fasta.index_fasta(spark, str(tmp_path / "g.fa")), "tile": "50"})
    left = list(reader.pushFilters([fasta.EqualTo(("chrom",), "c3"), fasta.EqualTo(("at",), 0)]))
    assert [f.attribute for f in left] == [("at",)]
    assert {row[2] for p in reader.partitions() for row in p.rows} == {"c3"}


def test_long_chromosome_stays_in_tiles(spark, tmp_path):
    """One line of 5 MB over many ranges: no row above a tile, tasks share the file."""
    seq = "".join(random.Random(1).choices("ACGT", k=5_000_000))
    (tmp_path / "g.fa").write_text(f">long\n{seq}\n")
    index = fasta.index_fasta(spark, str(tmp_path / "g.fa"), range_bytes=2**18)
    assert spark.read.parquet(index).count() == 20
    genome = I.Genome(fasta.read_fasta(spark, "", tile=2**12, index=index), 2**12)
    assert genome.tiles.agg(F.max(F.length("seq"))).first()[0] == 2**12
    assert genome.lengths().first().length == len(seq)
    df = spark.createDataFrame([("long", 262_100, 262_200), ("long", 4_999_990, 5_000_010)], "chrom string, start int, end int")
    assert sorted((r.start, r.seq) for r in I.intervals_to_seq(df, genome).collect()) == [(262_100, seq[262_100:262_200]), (4_999_990, seq[4_999_990:])]


def test_nothing_in_it_and_compressed(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0
    (tmp_path / "n.fa").write_text("ACGT\n")
    assert fasta.read_fasta(spark, str(tmp_path / "n.fa")).count() == 0
    (tmp_path / "g.fa.gz").write_bytes(b"12")
    with pytest.raises(ValueError, match="compressed"):
        fasta.read_fasta(spark, str(tmp_path / "g.fa.gz"))


def test_written_files_are_read_again(spark, tmp_path):
    rows = [(f"c{k}", at, "ACGTTGCA"[: 8 if at < 16 else k + 1]) for k in range(4) for at in (0, 8, 16)]
    fasta.write_fasta(spark.createDataFrame(rows, "chrom string, at int, seq string"), str(tmp_path / "out"))
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "out"), tile=8).collect())) == sorted(rows)
