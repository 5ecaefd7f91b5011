"""Queries on motif databases, similarity, intervals and sampling, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlab.operators import intervals as I
from strandlab.operators import motifdb, sampling, similarity
from strandlab.operators.scoring import extract_pwm
from strandlab.operators.session import shared_dir
from strandlab.plans.data import LABELLED_DNA, ORDER_DNA, counted_motifs, counted_sql, labelled_dna, order_dna, table
from strandlab.plans.scoring_queries import ALL, energy_ctes, lse, motif, motifs
from strandlab.sources import fasta
from strandlab.sources import motifs as M

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LOG = ", ".join(f"ln(({c} / (A + C + G + T) + CAST(0.01 AS DOUBLE)) / CAST(1.04 AS DOUBLE)) AS {c}" for c in "ACGT")
_DB = f"WITH {counted_sql()}, d AS (SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY pos) AS pos, {_LOG} FROM m)"


@query("motif_db", f"{_DB} SELECT motif, pos, A, C, G, T, 'forward' AS strand FROM d UNION ALL SELECT motif, max(pos) OVER (PARTITION BY motif) + 1 - pos, T, G, C, A, 'reverse' FROM d")
def _(spark, d):
    db = motifdb.create_motif_db(counted_motifs(spark, d))
    return db.table.withColumn("strand", F.lit("forward")).unionByName(db.reverse.withColumn("strand", F.lit("reverse")))


@query("motif_db_select", f"{_DB} SELECT motif, count(*) AS n FROM d WHERE motif ILIKE '%ta%' GROUP BY motif")
def _(spark, d):
    return motifdb.create_motif_db(counted_motifs(spark, d)).select("ta").table.groupBy("motif").agg(F.count(F.lit(1)).alias("n"))


@query("motif_db_to_dataframe", f"WITH {counted_sql()} SELECT motif, pos + 1 AS pos, {', '.join(f'{c} / (A + C + G + T) AS {c}' for c in 'ACGT')} FROM m")
def _(spark, d):
    return motifdb.create_motif_db(counted_motifs(spark, d)).with_prior(0.05).to_dataframe()


@query("motif_db_score", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['EBOX', 'GATA'], spat=((1.0, 2.0, 1.0), 20))}, e AS ({lse('seq_id, motif')}) SELECT * FROM e")
def _(spark, d):
    factors = {n: (1.0, 2.0, 1.0) for n in ("EBOX", "GATA")}
    return motifdb.create_motif_db(M.library(spark, ["EBOX", "GATA"]), spat_factors=factors, spat_bin_size=20).score(order_dna(spark, d))


_PAIR = f"""WITH {counted_sql()},
p AS (SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY motif) AS len, {', '.join(f'({c} / (A + C + G + T) + CAST(0.01 AS DOUBLE)) / CAST(1.04 AS DOUBLE) AS {c}' for c in 'ACGT')} FROM m),
f AS (SELECT motif, len, k, x.c, x.v FROM p, LATERAL (VALUES (0, A), (1, C), (2, G), (3, T)) x(c, v)),
s AS (SELECT DISTINCT motif, len FROM p),
o AS (SELECT a.motif AS a, b.motif AS b, CAST(r.o AS BIGINT) AS o FROM s a JOIN s b ON (a.len < b.len OR (a.len = b.len AND a.motif <> b.motif)), range(0, 20) r(o) WHERE r.o <= b.len - a.len),
c AS (SELECT o.a, o.b, o.o, x.v AS x, y.v AS y FROM o JOIN f x ON x.motif = o.a JOIN f y ON y.motif = o.b AND y.k = x.k + o.o AND y.c = x.c)"""


@query(
    "pssm_dataset_cor",
    f"""{_PAIR},
r AS (SELECT a, b, o, rank() OVER (w ORDER BY round(x, 12)) + (count(*) OVER (PARTITION BY a, b, o, round(x, 12)) - 1) / 2.0 AS x, rank() OVER (w ORDER BY round(y, 12)) + (count(*) OVER (PARTITION BY a, b, o, round(y, 12)) - 1) / 2.0 AS y FROM c WINDOW w AS (PARTITION BY a, b, o)),
g AS (SELECT a, b, max(score) AS score FROM (SELECT a, b, o, corr(x, y) AS score FROM r GROUP BY ALL) GROUP BY ALL),
u AS (SELECT a AS motif1, b AS motif2, score FROM g UNION SELECT b, a, score FROM g)
SELECT motif1, motif2, max(score) AS score FROM u GROUP BY ALL UNION ALL SELECT DISTINCT motif, motif, 1.0 FROM m""",
)
def _(spark, d):
    return similarity.dataset_similarity(counted_motifs(spark, d))


_PEARSON = "g AS (SELECT a, b, max(score) AS score FROM (SELECT a, b, o, corr(x, y) AS score FROM c GROUP BY ALL) GROUP BY ALL)"
_KL = "g AS (SELECT a, b, min(score) AS score FROM (SELECT a, b, o, sum(x * ln(x / y) + y * ln(y / x)) / 2 AS score FROM c GROUP BY ALL) GROUP BY ALL)"
_ACROSS = "u AS (SELECT a AS motif1, b AS motif2, score FROM g UNION SELECT b, a, score FROM g) SELECT motif1, motif2, %s(score) AS score FROM u WHERE motif1 IN ('EBOX', 'GATA') AND motif2 IN ('SPEC', 'TATA', 'WEAK') GROUP BY ALL"


@query("pssm_dataset_cor_pearson", f"{_PAIR}, {_PEARSON}, {_ACROSS % 'max'}")
def _(spark, d):
    return similarity.dataset_similarity(counted_motifs(spark, d, ["GATA", "EBOX"]), counted_motifs(spark, d, ["TATA", "WEAK", "SPEC"]), "pearson")


@query("pssm_dataset_diff", f"{_PAIR}, {_KL}, {_ACROSS % 'min'}")
def _(spark, d):
    return similarity.dataset_similarity(counted_motifs(spark, d, ["GATA", "EBOX"]), counted_motifs(spark, d, ["TATA", "WEAK", "SPEC"]), "kl")


@query("pssm_match", f"{_PAIR}, {_PEARSON}, u AS (SELECT a AS motif1, b AS motif2, score FROM g UNION SELECT b, a, score FROM g) SELECT motif2 AS motif, max(score) AS cor FROM u WHERE motif1 = 'GATA' AND motif2 <> 'GATA' GROUP BY motif2 UNION ALL SELECT 'GATA', 1.0")
def _(spark, d):
    return similarity.pssm_match(counted_motifs(spark, d, ["GATA"]), counted_motifs(spark, d), "pearson")


def genome(spark, d):
    """One chromosome per nation of 40 lines of 64 hashed bases, in tiles of a line: most intervals touch two."""
    from strandlab.functions.sequence import dna_of_id

    lines = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    tiles = lines.select(F.concat(F.lit("chr"), "n_nationkey").alias("chrom"), (F.col("i") * 64).cast("bigint").alias("at"), dna_of_id(F.concat_ws("-", "n_nationkey", "i")).alias("seq"))
    return I.Genome(tiles, 64)


def intervals(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("chr"), "s_nationkey").alias("chrom"), ((F.col("s_suppkey") * 37) % 2400).cast("int").alias("start"))
    return rows.withColumn("end", (F.col("start") + 64).cast("int")).distinct()


_GENOME = """lines AS (SELECT n_nationkey, CAST(i AS BIGINT) AS i, CAST(n_nationkey AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS key FROM nation, range(0, 40) r(i)),
genome AS (SELECT 'chr' || CAST(n_nationkey AS VARCHAR) AS chrom, string_agg(translate(md5(key) || md5(key || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS seq FROM lines GROUP BY n_nationkey),
iv AS (SELECT DISTINCT 'chr' || CAST(s_nationkey AS VARCHAR) AS chrom, CAST((s_suppkey * 37) % 2400 AS INTEGER) AS start, CAST((s_suppkey * 37) % 2400 AS INTEGER) + 64 AS "end" FROM supplier),
ivs AS (SELECT iv.*, chrom || '_' || CAST(start AS VARCHAR) || '_' || CAST("end" AS VARCHAR) AS seq_id, substr(seq, start + 1, "end" - start) AS seq FROM iv JOIN genome USING (chrom))"""


@query("intervals_to_seq", f"WITH {_GENOME}, n AS (SELECT chrom, start + 12 AS start, start + 52 AS \"end\" FROM iv) SELECT n.chrom, start, \"end\", substr(seq, start + 1, 40) AS seq FROM n JOIN genome USING (chrom)")
def _(spark, d):
    return I.intervals_to_seq(intervals(spark, d), genome(spark, d), 40)


_CONTIGS = f"{ORDER_DNA}, contigs AS (SELECT 'contig' || CAST(seq_id // 4000 AS VARCHAR) AS chrom, string_agg(seq, '' ORDER BY seq_id) AS seq FROM orders_dna GROUP BY 1)"


@query("fasta_tiles", f"WITH {_CONTIGS} SELECT chrom, CAST(i AS BIGINT) AS at, substr(seq, CAST(i + 1 AS INTEGER), 1000) AS seq FROM (SELECT chrom, seq, unnest(range(0, length(seq), 1000)) AS i FROM contigs)")
def _(spark, d):
    """Contigs of the orders' DNA, written as FASTA and read by byte ranges in tiles of 1 000 bases."""
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    contig = F.concat(F.lit("contig"), F.floor(F.col("seq_id") / 4000).cast("string"))
    fasta.write_fasta(order_dna(spark, d).select(contig.alias("chrom"), F.col("seq_id").alias("at"), "seq"), path)
    return fasta.read_fasta(spark, path, tile=1000)


@query("gextract_pwm", f"WITH {energy_ctes(_GENOME, 'ivs', ['EBOX', 'GATA'])}, e AS ({lse('seq_id, motif')}) SELECT chrom, start, \"end\", motif, pwm FROM e JOIN ivs USING (seq_id)")
def _(spark, d):
    return I.extract_interval_pwm(intervals(spark, d), genome(spark, d), motifs("EBOX", "GATA"))


@query("gextract_local_pwm", f"WITH {energy_ctes(_GENOME, 'ivs', ['SPEC'])}, e AS ({lse('seq_id, i')}) SELECT seq_id AS name, CAST(i AS BIGINT) AS pos, pwm FROM e")
def _(spark, d):
    scored = I.interval_local_pwm(intervals(spark, d), genome(spark, d), motif("SPEC"))
    long = scored.select("name", F.posexplode("local").alias("p", "pwm")).where("pwm is not null")
    return long.select("name", (F.col("p") + 1).cast("bigint").alias("pos"), "pwm")


@query("center_by_pssm", f"WITH {energy_ctes(_GENOME, 'ivs', ['TATA'])}, e AS ({lse('seq_id, i')}), b AS (SELECT seq_id, CAST(arg_max(i, (round(pwm, 9), -i)) AS INTEGER) AS best FROM e GROUP BY seq_id) SELECT chrom, start + best - 32 AS start, start + best + 32 AS \"end\" FROM b JOIN ivs USING (seq_id)")
def _(spark, d):
    return I.centre_by_pssm(intervals(spark, d), genome(spark, d), motif("TATA"))


@query("gpwm_quantiles", f"WITH {energy_ctes(_GENOME, 'ivs', ['EBOX', 'GATA'])}, e AS ({lse('seq_id, motif')}) SELECT motif, quantile_cont(pwm, 0.1) AS q10, quantile_cont(pwm, 0.5) AS q50, quantile_cont(pwm, 0.9) AS q90 FROM e GROUP BY motif")
def _(spark, d):
    q = I.pwm_quantiles(64, [0.1, 0.5, 0.9], motifs("EBOX", "GATA"), genome(spark, d), intervals(spark, d))
    return q.select("motif", *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


@query(
    "gextract_pwm_quantile",
    f"""WITH {energy_ctes(_GENOME, 'ivs', ['EBOX', 'GATA'])}, e AS ({lse('seq_id, motif')}),
k AS (SELECT motif, CAST(i AS BIGINT) AS i, i / CAST(10 AS DOUBLE) AS p, quantile_cont(pwm, i / 10) AS v FROM (SELECT motif, list(pwm) AS l FROM e GROUP BY motif), range(0, 11) r(i), LATERAL (SELECT unnest(l) AS pwm) GROUP BY motif, i),
b AS (SELECT e.seq_id, e.motif, e.pwm, max(k.i) AS i FROM e JOIN k ON k.motif = e.motif AND k.v <= e.pwm GROUP BY ALL)
SELECT b.seq_id, b.motif, b.pwm, CASE WHEN b.i = 10 THEN 1.0 ELSE x.p + (y.p - x.p) * (b.pwm - x.v) / (y.v - x.v) END AS q
FROM b JOIN k x ON x.motif = b.motif AND x.i = b.i LEFT JOIN k y ON y.motif = b.motif AND y.i = b.i + 1""".replace("quantile_cont(pwm, i / 10)", "0.0").replace("0.0 AS v FROM (SELECT motif, list(pwm) AS l FROM e GROUP BY motif), range(0, 11) r(i), LATERAL (SELECT unnest(l) AS pwm) GROUP BY motif, i", "x.q[CAST(i AS INTEGER) + 1] AS v FROM (SELECT motif, quantile_cont(pwm, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM e GROUP BY motif) x, range(0, 11) r(i)"),
)
def _(spark, d):
    probs = [i / 10 for i in range(11)]
    found, bases, chosen = intervals(spark, d), genome(spark, d), motifs("EBOX", "GATA")
    scores = I.extract_interval_pwm(found, bases, chosen)
    breaks = I.pwm_quantiles(64, probs, chosen, bases, found)
    return I.to_quantile(scores, breaks, probs, ["motif"]).select(F.concat_ws("_", *I.COORDS).alias("seq_id"), "motif", "pwm", "q")


@query("local_pwm_freq", f"WITH {energy_ctes(_GENOME, 'ivs', ['GATA'])}, e AS ({lse('seq_id, i')}), t AS (SELECT quantile_cont(pwm, 0.95) AS lim FROM e) SELECT seq_id, CAST(i AS BIGINT) AS pos, CAST(pwm > lim + 1e-9 AS INTEGER) AS hit FROM e, t")
def _(spark, d):
    out = I.local_pwm_frequency(intervals(spark, d), genome(spark, d), motif("GATA"), 0.95, background=intervals(spark, d))
    long = out.select(F.concat_ws("_", *I.COORDS).alias("seq_id"), F.posexplode("hits").alias("p", "hit")).where("hit is not null")
    return long.select("seq_id", (F.col("p") + 1).cast("bigint").alias("pos"), "hit")


_DRAWN = """room AS (SELECT chrom, length(seq) - 64 AS room FROM genome),
spread AS (SELECT chrom, room, CAST(sum(room) OVER (ORDER BY chrom ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(room) OVER () AS BIGINT) AS total FROM room),
draws AS (SELECT CAST('0x' || substr(md5(CAST(i AS VARCHAR) || '|60427'), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM range(0, 10000) r(i)),
hits AS (SELECT chrom, CAST(floor(u * total) AS BIGINT) - (upto - room) AS off, room FROM draws, spread),
rv AS (SELECT chrom, CAST(off AS INTEGER) AS start, CAST(off + 64 AS INTEGER) AS "end" FROM hits WHERE off >= 0 AND off < room)"""


@query("random_intervals", f"WITH {_GENOME}, {_DRAWN} SELECT * FROM rv")
def _(spark, d):
    return I.random_intervals(genome(spark, d), 64)


_SCORED = energy_ctes("a0 AS (SELECT 1)", "scored", ["GATA"]).removeprefix("a0 AS (SELECT 1), ")


@query(
    "interval_quantiles_random_background",
    f"""WITH {_GENOME}, {_DRAWN},
scored AS (SELECT 'i' || seq_id AS seq_id, seq FROM ivs UNION ALL SELECT 'r' || CAST(row_number() OVER () AS VARCHAR), substr(seq, start + 1, 64) FROM rv JOIN genome USING (chrom)),
{_SCORED}, e AS ({lse('seq_id')}),
k AS (SELECT i, i * CAST(0.01 AS DOUBLE) AS p, q[CAST(i AS INTEGER) + 1] AS v FROM (SELECT quantile_cont(pwm, [{', '.join(f'{i / 100}' for i in range(101))}]) AS q FROM e WHERE seq_id LIKE 'r%'), range(0, 101) r(i)),
b AS (SELECT e.seq_id, e.pwm, max(k.i) AS i FROM e LEFT JOIN k ON k.v <= e.pwm WHERE e.seq_id LIKE 'i%' GROUP BY ALL)
SELECT chrom, start, "end", 'GATA' AS motif, b.pwm, CASE WHEN b.i IS NULL THEN 0.0 WHEN b.i = 100 THEN 1.0 ELSE x.p + (y.p - x.p) * (b.pwm - x.v) / (y.v - x.v) END AS q
FROM b JOIN ivs ON b.seq_id = 'i' || ivs.seq_id LEFT JOIN k x ON x.i = b.i LEFT JOIN k y ON y.i = b.i + 1""",
)
def _(spark, d):
    return I.interval_pwm_quantiles(intervals(spark, d), genome(spark, d), motifs("GATA"))


@query("cv_folds", f"WITH {ORDER_DNA} SELECT seq_id, CAST(ntile(5) OVER (PARTITION BY priority ORDER BY seq_id) AS INTEGER) AS fold FROM orders_dna")
def _(spark, d):
    return sampling.cv_folds(order_dna(spark, d), 5, "priority", compat=True).select("seq_id", "fold")


_DRAW = "md5(CAST(seq_id AS VARCHAR) || '|60427')"


@query("cv_folds_shuffled", f"WITH {ORDER_DNA} SELECT seq_id, CAST(ntile(5) OVER (PARTITION BY priority ORDER BY {_DRAW}, seq_id) AS INTEGER) AS fold FROM orders_dna")
def _(spark, d):
    return sampling.cv_folds(order_dna(spark, d), 5, "priority").select("seq_id", "fold")


@query("sample_quantile_matched", f"WITH {ORDER_DNA}, q AS (SELECT quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM orders_dna), b AS (SELECT seq_id, CAST(len(list_filter(c, lambda x: price > x)) AS INTEGER) AS bin FROM orders_dna, q), n AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM b GROUP BY bin)), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {_DRAW}, seq_id) AS k FROM b) SELECT seq_id FROM r, n WHERE k <= least(least, CAST(floor(floor((SELECT count(*) FROM b) * 0.2) / 10) AS BIGINT))")
def _(spark, d):
    return sampling.quantile_matched_rows(order_dna(spark, d), "price", 0.2).select("seq_id")


@query("sample_response", f"WITH {LABELLED_DNA}, n AS (SELECT count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1) AS ones FROM labelled), r AS (SELECT seq_id, y, row_number() OVER (PARTITION BY y ORDER BY {_DRAW}, seq_id) AS k FROM labelled) SELECT seq_id, y FROM r, n WHERE y = 1 OR k <= CAST(round(zeros * least(1.0, 0.1 * ones / zeros)) AS BIGINT)")
def _(spark, d):
    return sampling.sample_response(labelled_dna(spark, d), "y", sample_ratio=0.1).select("seq_id", "y")
