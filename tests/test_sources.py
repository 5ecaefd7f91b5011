import pytest

from strandlab.functions import pssm as P
from strandlab.operators import session
from strandlab.sources import examples
from strandlab.sources import motifs as M


def test_matrix_round_trip(spark):
    table = P.to_matrix(M.library(spark))
    assert set(table) == set(M.LIBRARY) and P.to_matrix(P.from_matrix(spark, table)) == table
    assert P.validate_spatial([0, 40, 80], [0.1, 1, 0]) == 40
    for bad in (([0, 40, 70], [1, 1, 1]), ([0, 40], [1, -1]), ([0], [1])):
        with pytest.raises(ValueError):
            P.validate_spatial(*bad)


def test_examples(spark):
    df = examples.clustered_sequences(spark, 200, 100)
    rows = df.collect()
    assert len(rows) == 200 and {len(r.seq) for r in rows} == {100} and {r.cluster for r in rows} == set(examples.WORDS)
    assert sum(examples.WORDS[r.cluster] in r.seq for r in rows) > 120
    assert examples.cluster_matrix(df).count() == 1000
    assert examples.response_sequences(spark, 50, 120).columns == ["seq_id", "seq", *examples.WORDS]


def test_set_parallel(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.set_parallel(spark, 3) == 3 and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert session.set_parallel(spark) >= 1
    spark.conf.set("spark.sql.shuffle.partitions", before)
