"""Queries on sequences, k-mers and composition, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from strandlab.functions import kmers as K
from strandlab.functions import sequence as S
from strandlab.plans.data import DOC_DNA, ORDER_DNA, doc_dna, order_dna

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("rc", f"WITH {ORDER_DNA} SELECT seq_id, translate(reverse(upper(seq)), 'ACGT', 'TGCA') AS rc FROM orders_dna")
def _(spark, d):
    return order_dna(spark, d).select("seq_id", S.rc(F.col("seq")).alias("rc"))


@query("trim_sequences", f"WITH {ORDER_DNA} SELECT seq_id, substr(seq, 5, 16) AS part, substr(seq, 17, 32) AS centre FROM orders_dna")
def _(spark, d):
    return order_dna(spark, d).select("seq_id", S.trimmed(F.col("seq"), 5, 20).alias("part"), S.centre_crop(F.col("seq"), 32).alias("centre"))


@query("gap_wildcards", f"WITH {ORDER_DNA} SELECT seq_id, substr(seq, 1, 3) || repeat('*', CAST(1 + seq_id % 9 AS INTEGER)) || substr(seq, 4, 2) AS pattern FROM orders_dna")
def _(spark, d):
    coded = F.concat(F.substring("seq", 1, 3), (F.col("seq_id") % 9 + 1).cast("string"), F.substring("seq", 4, 2))
    return order_dna(spark, d).select("seq_id", S.gap_to_wildcards(coded).alias("pattern"))


_LETTERS = "l(c) AS (VALUES ('A'), ('C'), ('G'), ('T'))"


@query("generate_kmers", f"WITH {_LETTERS}, {ORDER_DNA}, k AS (SELECT a.c || b.c || c.c AS kmer FROM l a, l b, l c), g AS (SELECT kmer FROM k UNION SELECT 'N' || substr(kmer, 2) FROM k UNION SELECT substr(kmer, 1, 1) || 'N' || substr(kmer, 3) FROM k UNION SELECT substr(kmer, 1, 2) || 'N' FROM k UNION SELECT 'NN' || substr(kmer, 3) FROM k UNION SELECT substr(kmer, 1, 1) || 'NN' FROM k), s AS (SELECT substr(seq, 1, 3) AS start, count(*) AS n FROM orders_dna GROUP BY 1) SELECT kmer, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN s ON regexp_full_match(start, replace(kmer, 'N', '.')) GROUP BY kmer")
def _(spark, d):
    """All k-mers, gapped ones too, with the number of sequences that begin with them."""
    starts = order_dna(spark, d).groupBy(F.substring("seq", 1, 3).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    fits = F.rlike(F.col("start"), F.concat(F.lit("^"), F.translate("kmer", "N", "."), F.lit("$")))
    return K.kmers_frame(spark, 3, max_gap=2).join(starts, fits, "left").groupBy("kmer").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("kmer_counts", f"WITH {DOC_DNA}, w AS (SELECT seq_id, substr(seq, i, 4) AS w FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM docs_dna)), p AS (SELECT seq_id, w AS kmer FROM w UNION ALL SELECT seq_id, 'N' || substr(w, 2) FROM w UNION ALL SELECT seq_id, substr(w, 1, 1) || 'N' || substr(w, 3) FROM w UNION ALL SELECT seq_id, substr(w, 1, 2) || 'N' || substr(w, 4) FROM w UNION ALL SELECT seq_id, substr(w, 1, 3) || 'N' FROM w) SELECT seq_id, kmer, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    return K.kmer_counts(doc_dna(spark, d), 4, max_gap=1)


@query("kmer_counts_masked", f"WITH {DOC_DNA}, w AS (SELECT seq_id, substr(seq, i, 4) AS w FROM (SELECT seq_id, seq, unnest(range(3, length(seq) - 2)) AS i FROM docs_dna)) SELECT seq_id, substr(w, 1, 1) || 'NN' || substr(w, 4) AS kmer, count(*) AS n FROM w GROUP BY ALL")
def _(spark, d):
    return K.kmer_counts(doc_dna(spark, d), 4, mask="ANNA", from_range=3)


@query("kmer_matrix", f"WITH {ORDER_DNA}, w AS (SELECT seq_id, substr(seq, CAST(i AS INTEGER), 2) AS w FROM orders_dna, range(1, 64) r(i)) SELECT seq_id, count(*) FILTER (w = 'AA') AS AA, count(*) FILTER (w = 'CG') AS CG, count(*) FILTER (w = 'GC') AS GC, count(*) FILTER (w = 'TA') AS TA FROM w GROUP BY seq_id")
def _(spark, d):
    return K.kmer_matrix(order_dna(spark, d), 2, ["AA", "CG", "GC", "TA"])


def _screen_sql(patterns: str, source: str, responses: dict[str, str], min_cor: float) -> str:
    r = list(responses)
    moments = ", ".join(f"avg({e}) AS e_{n}, avg({e} * {e}) AS e2_{n}" for n, e in responses.items())
    sums = ", ".join(f"sum(n * {e}) AS s_{n}" for n, e in responses.items())
    cors = ", ".join(f"(s_{n} / big - (sn / big) * e_{n}) / sqrt((sn2 / big - (sn / big) * (sn / big)) * (e2_{n} - e_{n} * e_{n})) AS {n}" for n in r)
    best = f"greatest({', '.join(f'{n} * {n}' for n in r)})" if len(r) > 1 else f"{r[0]} * {r[0]}"
    return f"""WITH {source}, c AS (SELECT seq_id, kmer, CAST(least(count(*), 19) AS DOUBLE) AS n FROM ({patterns}) GROUP BY ALL),
t AS (SELECT CAST(count(*) AS DOUBLE) AS big, {moments} FROM s),
a AS (SELECT kmer, sum(n) AS sn, sum(n * n) AS sn2, {sums} FROM c JOIN s USING (seq_id) GROUP BY kmer),
x AS (SELECT kmer, sn / big AS avg_n, sn2 / big - (sn / big) * (sn / big) AS avg_var, {cors} FROM a, t)
SELECT kmer, {best} AS max_r2, avg_n, avg_var, {', '.join(r)} FROM x WHERE {best} > {min_cor * min_cor!r}"""


@query("screen_kmers", _screen_sql("SELECT seq_id, substr(seq, CAST(i + 1 AS INTEGER), 4) AS kmer FROM s, range(0, 61) r(i)", f"{ORDER_DNA}, s AS (SELECT * FROM orders_dna)", {"price": "price", "is_low": "CAST(priority = '5-LOW' AS DOUBLE)"}, 0.01))
def _(spark, d):
    df = order_dna(spark, d).withColumn("is_low", (F.col("priority") == "5-LOW").cast("double"))
    return K.screen_kmers(df, ["price", "is_low"], kmer_length=4, min_cor=0.01)


@query("screen_kmers_gapped", _screen_sql("SELECT seq_id, substr(seq, CAST(i + 1 AS INTEGER), 2) || '*' || substr(seq, CAST(i + 4 AS INTEGER), 2) AS kmer FROM s, range(0, 60) r(i) UNION ALL SELECT seq_id, substr(seq, CAST(i + 1 AS INTEGER), 2) || '**' || substr(seq, CAST(i + 5 AS INTEGER), 2) FROM s, range(0, 59) r(i) WHERE i < 59 UNION ALL SELECT seq_id, substr(seq, CAST(i + 1 AS INTEGER), 4) FROM s, range(0, 59) r(i)".replace("range(0, 60)", "range(0, 59)"), f"{ORDER_DNA}, s AS (SELECT * FROM orders_dna)", {"price": "price"}, 0.01))
def _(spark, d):
    return K.screen_kmers(order_dna(spark, d), ["price"], kmer_length=4, min_cor=0.01, max_gap=2)


_PAIRS = ["".join(p) for p in product("ACGT", repeat=2)]


@query("dinucleotides", f"WITH {ORDER_DNA}, w AS (SELECT seq_id, substr(seq, CAST(i AS INTEGER), 2) AS w FROM orders_dna, range(1, 64) r(i)) SELECT seq_id, {', '.join(f'count(*) FILTER (w = {chr(39)}{p}{chr(39)}) AS "{p}"' for p in _PAIRS)} FROM w GROUP BY seq_id")
def _(spark, d):
    return K.dinucleotides(order_dna(spark, d))


def _dist_sql(n: int) -> str:
    words = ["".join(p) for p in product("ACGT", repeat=n)]
    shares = ", ".join(f"count(*) FILTER (w = '{w}') / CAST(count(*) AS DOUBLE) AS {chr(34)}{w}{chr(34)}" for w in words)
    return f"WITH {ORDER_DNA}, w AS (SELECT CAST(i AS INTEGER) AS pos, substr(seq, CAST(i AS INTEGER), {n}) AS w FROM orders_dna, range(1, {66 - n}) r(i)), s AS (SELECT pos, {shares} FROM w GROUP BY pos) SELECT CAST(p.i AS INTEGER) AS pos, {', '.join(f'"{w}"' for w in words)} FROM range(1, 65) p(i) LEFT JOIN s ON s.pos = p.i"


@query("dinucleotide_distribution", _dist_sql(2))
def _(spark, d):
    return K.nucleotide_distribution(order_dna(spark, d), 2)


@query("trinucleotide_distribution", _dist_sql(3))
def _(spark, d):
    return K.nucleotide_distribution(order_dna(spark, d), 3)
