"""Every registered query of the subpackage on tables with nulls, repeats, ties, empty texts and clashing columns."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlab.llm import pii
from strandlab.llm.registry import ORACLE_SQL, QUERIES

#: Columns of the tables that operators use as names of their own.
CLASHING = ("score", "rank", "kept", "class_id", "rid", "node", "key", "bucket", "held_out", "verdict", "part", "weight")
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def odd_rows() -> dict[str, list[tuple]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    good, bad = "the report explains measured results in clear sentences", "buy now !!! click $$$ free free"
    docs = []
    for i in range(60):
        toxic = i % 3 == 0
        docs.append((i, f"{good if i % 2 else bad} {'vilest slurword' if toxic else 'kind people'} {text(25)}", "en", "a", 1))
    docs += [(100, docs[0][1], "en", "b", 1), (101, docs[0][1] + " tail", None, None, None), docs[3], docs[3]]
    docs += [(200, None, None, None, None), (201, "", "de", "a", 0), (202, " \t\n", "de", "a", 3), (None, "no id here", "en", "a", 1), (None, None, None, None, None)]
    docs += [(203, "mail ann@example.org or call +49 30 123 4567", "en", "a", 1)]
    items = [(1, text(20)), (1, text(20)), (2, ""), (3, None), (None, text(12)), (4, docs[7][1])]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (200, None, None), (0, 0, 1)]
    pages = [(i, f"http://h{i % 3}.example.org/{'es/' if i % 2 else ''}p{i}", f"<nav>menu</nav><article><p>Body {i}</p></article>") for i in range(12)]
    pages += [(20, None, None), (21, "no scheme", ""), (None, "http://x.com/fr/a?q", "<p>only"), pages[0], (22, "HTTP://A.Com/de/", "<article><p>a &amp; b</p></article>")]
    turns = [(c, t, rng.choice(["ann", "bob", "system"]), text(3)) for c in (1, 2) for t in range(6)]
    turns += [(1, 2, None, None), (None, 0, "ann", "x"), (None, None, "bob", ""), turns[0], turns[0], (3, 0, "system", "only context")]
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 4) for i in range(160)]
    vectors += [(300, None, 1), (301, [0.5] * 6, None), (302, [float("nan")] + [0.0] * 5, 2), (303, [float("inf")] + [0.0] * 5, 2), (304, vectors[50][1], 3), (305, [None] + [0.1] * 5, 0)]
    return {"documents": docs, "labels": labels, "pages": pages, "benchmark": items, "conversations": turns, "embeddings": vectors}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Two folders of tables: odd rows with clashing columns, and no rows."""
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    for name, rows in odd_rows().items():
        df = spark.createDataFrame(rows, TABLES[name])
        df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3).write.parquet(f"{odd}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


def result(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows_equal_sql(spark, folders, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folders[0]}/{t}.parquet/*.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    columns = sorted(theirs.columns)
    mine = QUERIES[name](spark, folders[0])
    assert sorted(mine.columns) == columns
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert shown(mine.select(*columns).collect()) == shown(theirs.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["op1_bag_minhash", "op4_length_buckets", "op7_feistel_pseudonyms", "op8_nearest_toxic", "op10_compression_quality"])
def test_a_row_for_each_row(spark, folders, name):
    ids = sorted(str(r[0]) for r in odd_rows()["documents"])
    assert sorted(str(r["doc_id"]) for r in result(spark, folders[0], name)) == ids


def test_near_classes(spark, folders):
    of = {}
    for r in result(spark, folders[0], "op1_bag_minhash"):
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert of[100] == of[101] == of[0] == {0} and of[3] == {3} and of[200] == of[201] == of[202]


@pytest.mark.parametrize("name, divisor, rest, least", [("op8_nearest_toxic", 5, 0, 0.5), ("op10_compression_quality", 4, 2, 0.7)])
def test_splits_and_predictions(spark, folders, name, divisor, rest, least):
    for r in result(spark, folders[0], name):
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_held_out_labels_change_no_score(spark, folders, tmp_path):
    """Turning the labels of held-out rows round leaves every score as it was."""
    for name, label, held in (("op8_nearest_toxic", "toxic", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), ("op10_compression_quality", "quality", "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")):
        folder = str(tmp_path / name)
        spark.read.parquet(f"{folders[0]}/documents.parquet").write.parquet(f"{folder}/documents.parquet")
        labels = spark.read.parquet(f"{folders[0]}/labels.parquet")
        labels.withColumn(label, F.when(F.expr(held), 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{folder}/labels.parquet")
        scores = [sorted((str(r["doc_id"]), r["score"]) for r in result(spark, f, name)) for f in (folders[0], folder)]
        assert scores[0] == scores[1]


def test_pages_and_leaks(spark, folders):
    texts = {r["page_id"]: r["text"] for r in result(spark, folders[0], "op2_nearest_url_text")}
    assert len(texts) == 16 and (texts[3], texts[20], texts[21], texts[22]) == ("Body 3", "", "", "a & b")
    assert 7 in {r["doc_id"] for r in result(spark, folders[0], "op6_bm25_decontamination")}


def test_pseudonyms(spark, folders):
    rows = {r["doc_id"]: r for r in result(spark, folders[0], "op7_feistel_pseudonyms")}
    assert rows[203]["n_found"] == 2 and "ann@example.org" not in rows[203]["text"] and "123 4567" not in rows[203]["text"]
    assert rows[5]["n_found"] == 0 and rows[5]["text"] == odd_rows()["documents"][5][1]


@pytest.mark.xfail(strict=True, reason="a subscriber number in one group behind country and area code isn't taken for a telephone number yet")
def test_unbroken_subscriber_numbers(spark):
    df = spark.createDataFrame([(1, "call +49 30 1234567")], "doc_id bigint, text string")
    assert "1234567" not in pii.pseudonymised(df, "k").first().text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    rows = result(spark, folders[1], name)
    assert name == "op3_length_histogram" or rows == []
