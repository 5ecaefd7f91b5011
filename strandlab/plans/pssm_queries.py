"""Queries on motif tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.functions import pssm as P
from strandlab.plans.data import ORDER_DNA, counted_motifs, counted_sql, order_dna
from strandlab.sources import motifs as M

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_M = counted_sql()
_PRIOR = "p AS (SELECT motif, pos, (A + 0.01) / (A + C + G + T + 0.04) AS A, (C + 0.01) / (A + C + G + T + 0.04) AS C, (G + 0.01) / (A + C + G + T + 0.04) AS G, (T + 0.01) / (A + C + G + T + 0.04) AS T FROM m)"
_PRIOR = _PRIOR.replace("0.01", "CAST(0.01 AS DOUBLE)").replace("0.04", "CAST(0.04 AS DOUBLE)")
_BITS = "b AS (SELECT motif, pos, greatest(2 + A * log2(A) + C * log2(C) + G * log2(G) + T * log2(T), 0) AS bits FROM p)"
_TRIM = "e AS (SELECT motif, min(pos) AS lo, max(pos) AS hi FROM b WHERE bits > 0.1 GROUP BY motif), t AS (SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY pos) - 1 AS pos, A, C, G, T FROM m JOIN e USING (motif) WHERE pos BETWEEN lo AND hi)"


@query("all_motif_datasets", f"WITH {_M} SELECT CASE WHEN motif IN ('GATA', 'EBOX') THEN 'SYN1' ELSE 'SYN2' END || '.' || motif AS motif, pos, A, C, G, T, CASE WHEN motif IN ('GATA', 'EBOX') THEN 'SYN1' ELSE 'SYN2' END AS dataset, motif AS motif_orig FROM m")
def _(spark, d):
    return M.all_datasets({"SYN1": counted_motifs(spark, d, ["GATA", "EBOX"]), "SYN2": counted_motifs(spark, d, ["TATA", "WEAK", "SPEC"])})


@query("get_motif_pssm", f"WITH {_M} SELECT pos, A, C, G, T FROM m WHERE motif = 'TATA'")
def _(spark, d):
    return M.motif_pssm(counted_motifs(spark, d), "TATA")


@query("pssm_add_prior", f"WITH {_M}, {_PRIOR} SELECT * FROM p")
def _(spark, d):
    return P.with_prior(counted_motifs(spark, d))


@query("bits_per_pos", f"WITH {_M}, {_PRIOR}, {_BITS} SELECT * FROM b")
def _(spark, d):
    return P.bits_per_pos(counted_motifs(spark, d))


_RANGE = "r AS (SELECT motif, sum(ln(0.01 + least(A, C, G, T))) AS min_score, sum(ln(0.01 + greatest(A, C, G, T))) AS max_score FROM p GROUP BY motif)"


@query("pssm_theoretical", f"WITH {_M}, {_PRIOR}, {_RANGE} SELECT * FROM r")
def _(spark, d):
    return P.theoretical_range(counted_motifs(spark, d))


@query("pssm_quantile", f"WITH {_M}, {_PRIOR}, {_RANGE} SELECT motif, min_score + 0.8 * (max_score - min_score) AS score FROM r")
def _(spark, d):
    return P.quantile(counted_motifs(spark, d), 0.8)


_CONSENSUS = """WITH %s,
k AS (SELECT motif, pos, list_sort([
  {'k': CAST(floor(CAST(CAST(CAST(A AS FLOAT) / (CAST(A AS FLOAT) + CAST(C AS FLOAT) + CAST(G AS FLOAT) + CAST(T AS FLOAT)) AS FLOAT) * CAST(1000 AS FLOAT) AS FLOAT)) AS INTEGER) * 4, 'l': 'A'},
  {'k': CAST(floor(CAST(CAST(CAST(C AS FLOAT) / (CAST(A AS FLOAT) + CAST(C AS FLOAT) + CAST(G AS FLOAT) + CAST(T AS FLOAT)) AS FLOAT) * CAST(1000 AS FLOAT) AS FLOAT)) AS INTEGER) * 4 + 1, 'l': 'C'},
  {'k': CAST(floor(CAST(CAST(CAST(G AS FLOAT) / (CAST(A AS FLOAT) + CAST(C AS FLOAT) + CAST(G AS FLOAT) + CAST(T AS FLOAT)) AS FLOAT) * CAST(1000 AS FLOAT) AS FLOAT)) AS INTEGER) * 4 + 2, 'l': 'G'},
  {'k': CAST(floor(CAST(CAST(CAST(T AS FLOAT) / (CAST(A AS FLOAT) + CAST(C AS FLOAT) + CAST(G AS FLOAT) + CAST(T AS FLOAT)) AS FLOAT) * CAST(1000 AS FLOAT) AS FLOAT)) AS INTEGER) * 4 + 3, 'l': 'T'}]) AS r FROM m),
c AS (SELECT motif, pos, CASE WHEN r[4].k > 1600 THEN r[4].l WHEN r[4].k + r[3].k >= 2400 THEN CASE least(r[4].l, r[3].l) || greatest(r[4].l, r[3].l) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' END ELSE '*' END AS l FROM k)
SELECT motif, nullif(trim(string_agg(l, '' ORDER BY pos), '*'), '') AS consensus FROM c GROUP BY motif"""


@query("consensus", _CONSENSUS % _M)
def _(spark, d):
    return P.consensus(counted_motifs(spark, d))


@query("pssm_rc", f"WITH {_M}, n AS (SELECT *, max(pos) OVER (PARTITION BY motif) + min(pos) OVER (PARTITION BY motif) - pos AS q FROM m) SELECT motif, q AS pos, T AS A, G AS C, C AS G, A AS T FROM n")
def _(spark, d):
    return P.reverse_complement(counted_motifs(spark, d))


@query("pssm_trim", f"WITH {_M}, {_PRIOR}, {_BITS}, {_TRIM} SELECT * FROM t")
def _(spark, d):
    return P.trim(counted_motifs(spark, d))


@query(
    "pssm_concat",
    f"""WITH {_M}, {_PRIOR}, {_BITS}, {_TRIM},
v AS (SELECT motif, max(pos) OVER (PARTITION BY motif) - pos AS pos, T AS A, G AS C, C AS G, A AS T FROM t),
j AS (SELECT motif, 0 AS part, pos, A, C, G, T FROM t UNION ALL SELECT DISTINCT motif, 1, CAST(i AS BIGINT), 0.25, 0.25, 0.25, 0.25 FROM t, range(0, 3) r(i) UNION ALL SELECT motif, 2, pos, A, C, G, T FROM v)
SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY part, pos) - 1 AS pos, CAST(A AS DOUBLE) AS A, CAST(C AS DOUBLE) AS C, CAST(G AS DOUBLE) AS G, CAST(T AS DOUBLE) AS T FROM j""",
)
def _(spark, d):
    return P.concat(counted_motifs(spark, d), counted_motifs(spark, d), gap=3, orientation="fr")


@query("kmers_to_pssm", "WITH " + ORDER_DNA + ", k AS (SELECT DISTINCT CASE WHEN seq_id % 2 = 0 THEN substr(seq, 1, 4) ELSE substr(seq, 1, 2) || 'N' || substr(seq, 4, 2) END AS kmer FROM orders_dna), c AS (SELECT kmer, CAST(i AS INTEGER) AS pos, substr(kmer, CAST(i AS INTEGER), 1) AS b FROM k, range(1, 6) r(i) WHERE i <= length(kmer)) SELECT kmer, pos, " + ", ".join(f"CASE WHEN b = 'N' THEN 0.25 WHEN b = '{x}' THEN 1 / CAST(1.03 AS DOUBLE) ELSE 0.01 / CAST(1.03 AS DOUBLE) END AS {x}" for x in "ACGT") + " FROM c")
def _(spark, d):
    words = F.when(F.col("seq_id") % 2 == 0, F.substring("seq", 1, 4)).otherwise(F.concat(F.substring("seq", 1, 2), F.lit("N"), F.substring("seq", 4, 2)))
    return P.kmers_to_pssm(order_dna(spark, d).select(words.alias("kmer")).distinct())


@query(
    "pssm_to_kmer",
    f"""WITH {_M}, {_PRIOR}, {_BITS},
n AS (SELECT m.*, bits, row_number() OVER (PARTITION BY motif ORDER BY pos) AS i, count(*) OVER (PARTITION BY motif) AS n, sum(bits) OVER (PARTITION BY motif ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM m JOIN b USING (motif, pos)),
best AS (SELECT motif, i AS start FROM n WHERE i + 3 <= n QUALIFY row_number() OVER (PARTITION BY motif ORDER BY round(s, 9) DESC, i) = 1)
SELECT motif, string_agg(CASE WHEN bits > 0.3 THEN CASE greatest(A, C, G, T) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' ELSE 'T' END ELSE 'N' END, '' ORDER BY i) AS kmer
FROM n JOIN best USING (motif) WHERE i BETWEEN start AND start + 3 GROUP BY motif""",
)
def _(spark, d):
    return P.pssm_to_kmer(counted_motifs(spark, d), kmer_length=4, pos_bits_thresh=0.3)


@query("logo_heights", f"WITH {_M}, {_PRIOR}, {_BITS} SELECT motif, pos, letter, h * bits AS height FROM p JOIN b USING (motif, pos), LATERAL (VALUES ('A', A), ('C', C), ('G', G), ('T', T)) x(letter, h)")
def _(spark, d):
    return P.letter_heights(counted_motifs(spark, d))
