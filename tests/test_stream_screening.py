"""A stream's screen equals the screen of all its rows, whatever the batches."""

import random

import pytest

from strandlab.operators import scoring
from strandlab.operators.screening import screen_pwm
from strandlab.sources import motifs as M
from strandlab.streaming import scoring as streaming
from strandlab.streaming import screening

SCHEMA = "seq_id bigint, seq string, a double, b double"


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_any_split_gives_the_same_screen(spark, tmp_path, pieces):
    rng = random.Random(pieces)
    rows = [(i, "".join(rng.choices("ACGT", k=40)), rng.random(), rng.random()) for i in range(120)]
    rows += [(200, None, 0.5, 0.5), (201, "ACGT" * 9, None, 0.5), (202, "AC", 0.1, 0.2), rows[0], rows[0]]
    rng.shuffle(rows)
    lib = scoring.collect_motifs(M.library(spark, ["SPEC", "GATA"]))
    frame = spark.createDataFrame(rows, SCHEMA)
    cuts = sorted(rng.sample(range(len(rows)), pieces - 1))
    for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = streaming.read_sequences(spark, str(tmp_path / "in" / "*"), schema=SCHEMA, max_files=1)
    out = str(tmp_path / "out")
    query = screening.write_screen(screening.screen_stream(stream, ["a", "b"], lib), out, str(tmp_path / "ck"))
    query.awaitTermination()
    got = {r.motif: (r.score, r.n) for r in spark.read.parquet(out).collect()}
    whole = {r.motif: r.score for r in screen_pwm(frame, ["a", "b"], lib, "r2").collect()}
    assert {m: s for m, (s, _) in got.items()} == pytest.approx(whole)
    assert {n for _, n in got.values()} == {122}


def test_later_files_are_merged_into_earlier_sums(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ACGT", k=30)), rng.random(), 0.0) for i in range(60)]
    lib = scoring.collect_motifs(M.library(spark, ["SPEC"]))
    for upto, part in ((25, rows[:25]), (60, rows[25:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.read_sequences(spark, str(tmp_path / "in"), schema=SCHEMA)
        screening.write_screen(screening.screen_stream(stream, "a", lib), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        whole = screen_pwm(spark.createDataFrame(rows[:upto], SCHEMA), "a", lib, "r2").first()
        got = spark.read.parquet(str(tmp_path / "out")).first()
        assert (got.n, got.score) == (upto, pytest.approx(whole.score))
