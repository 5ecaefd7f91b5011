import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strandlab.llm import decontam, quality
from strandlab.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.test_dedup import brute_classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    labels = quality.training_labels(spark.read.parquet(f"{DATA}/labels.parquet"))
    score = quality.fit(docs, labels).scorer()
    kept = {i for i, t in texts.items() if score([t])[0] >= P.KEEP_QUALITY}
    seen, unique = set(), set()
    for i in sorted(kept):
        t = re.sub(r"[ \t-\r]+", " ", texts[i] or "")
        if t not in seen:
            seen.add(t)
            unique.add(i)
    classes = brute_classes([(i, texts[i]) for i in unique])
    one = {i for i in unique if classes[i] == i}

    def leaks(text):
        own = decontam._Grams(decontam.words(text))
        for _, item, _ in items:
            q, a = map(decontam.grams, decontam.question_and_answer(item))
            whole = decontam.grams(decontam.words(item))
            share = lambda part: sum(g in own[len(g)] for g in part) / len(part)
            if decontam.leaks(share(q), share(a), share(whole)):
                return True
        return False

    clean = {i for i in one if not leaks(texts[i])}
    rows = P.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, empty, DATA).columns == docs.columns, name
        assert stage(spark, empty, DATA).count() == 0
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_with_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text, columns with clashing and dotted names."""
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(1, "q r s t u v"), (1, "q r s t u v"), (None, None), (None, ""), (2, None), (3, long), (None, " " * 2_000_000)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    names = ["score", "a.b", "__rid", "__row", "rid", "node", "id", "keep_id", "n_tokens", "bucket", "cell"]
    docs = docs.select("*", *[F.col("n").alias(c) for c in names if c not in ("__rid", "__row")])
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA).collect()
        if name == "packing":
            assert len(out) == len(rows) and len({(r.bucket, r.batch, r.slot) for r in out}) == len(rows)
            continue
        assert stage(spark, docs, DATA).columns == docs.columns, name
        got = sorted(r.n for r in out)
        if name == "exact_dedup":
            assert got == [0, 4, 5, 6]
        elif name == "near_dedup":
            assert got == [0, 4, 5]
        elif name == "decontamination":
            assert got == list(range(7))


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    def docs(rows):
        return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")

    one, two, item = ("".join(f"{w}{i} " for i in range(60)) for w in ("alpha", "beta", "gamma"))
    near = P.keep_one_of_near(spark, docs([(1, one), (None, one + "x"), (None, one + "y"), (1, one + "z"), (1, two), (None, "q r s t u v")]), "")
    assert sorted((r.n, r.doc_id) for r in near.collect()) == [(0, 1), (4, 1), (5, None)] and near.columns == ["doc_id", "text", "n"]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.keep_uncontaminated(spark, docs([(None, "so " + item), (2, "so " + item), (2, one), (None, two)]), str(tmp_path))
    assert sorted(r.n for r in clean.collect()) == [2, 3]


def test_quality_without_labels_keeps_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id bigint, text string")
    assert P.keep_quality(spark, docs, str(tmp_path)).count() == 2


def test_registry():
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
