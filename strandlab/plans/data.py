"""DNA from the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.sequence import dna_of_id, dna_of_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table that fewer tasks would scan than there are cores (a small single file); others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def order_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bp per order; price is the response, priority the cluster."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))
    return orders.select(F.col("o_orderkey").cast("bigint").alias("seq_id"), dna_of_id(F.col("o_orderkey")).alias("seq"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderpriority").alias("priority"))


ORDER_DNA = """orders_dna AS (
  SELECT CAST(o_orderkey AS BIGINT) AS seq_id,
         translate(md5(CAST(o_orderkey AS VARCHAR)) || md5(CAST(o_orderkey AS VARCHAR) || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
         CAST(o_totalprice AS DOUBLE) AS price, o_orderpriority AS priority
  FROM orders
)"""


#: Words around which letters are counted: the first match in each sequence.
COUNTED_WORDS = {"GATA": "GA.A..", "EBOX": "CA..TG", "TATA": "T.TA.A.[AG]", "WEAK": "[AT].C..", "SPEC": "AC.T"}


def counted_motifs(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """Motifs of the orders' DNA: how often each letter stands at each place of the words that match a pattern."""
    words = F.array(*(F.struct(F.lit(n).alias("motif"), F.regexp_extract("seq", w, 0).alias("word")) for n, w in COUNTED_WORDS.items() if names is None or n in names))
    letters = order_dna(spark, sf_dir).select(F.inline(words)).where("word <> ''").select("motif", F.posexplode(F.split("word", "")).alias("pos", "b"))
    return letters.groupBy("motif", "pos").agg(*(F.count_if(F.col("b") == c).cast("double").alias(c) for c in "ACGT"))


def counted_sql(names: list[str] | None = None) -> str:
    """The same as CTEs that end in ``m(motif, pos, A, C, G, T)``."""
    words = " UNION ALL ".join(f"SELECT '{n}' AS motif, regexp_extract(seq, '{w}') AS word FROM orders_dna" for n, w in COUNTED_WORDS.items() if names is None or n in names)
    counts = ", ".join(f"CAST(count(*) FILTER (b = '{c}') AS DOUBLE) AS {c}" for c in "ACGT")
    return f"""{ORDER_DNA}, words AS ({words}),
m AS (SELECT motif, CAST(i - 1 AS INTEGER) AS pos, {counts} FROM (SELECT motif, i, substr(word, i, 1) AS b FROM words, range(1, 9) r(i) WHERE i <= length(word)) GROUP BY motif, i)"""


def doc_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA of the whole text of each document; language and source are groups."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(F.col("doc_id").alias("seq_id"), dna_of_text(F.col("text")).alias("seq"), "lang", "source")


DOC_DNA = """docs_dna AS (
  SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq, lang, source
  FROM documents
)"""


def labelled_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' DNA with a binary response."""
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("seq_id"), F.col("quality").cast("int").alias("y"))
    return doc_dna(spark, sf_dir).join(labels, "seq_id")


LABELLED_DNA = f"""{DOC_DNA},
labelled AS (SELECT d.*, CAST(l.quality AS INTEGER) AS y FROM docs_dna d JOIN labels l ON d.seq_id = l.doc_id WHERE l.quality IN (0, 1))"""
